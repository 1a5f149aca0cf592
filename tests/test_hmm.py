"""Models and decoding against worked examples and enumeration."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from echotrail.functions import hmm as H

# An ice-cream model (hot and cold days) and a chain that prefers 0, 1, 2 in turn.
HOT_COLD = np.array([[0.0, 0.8, 0.2, 0.0], [0.0, 0.7, 0.3, 1.0], [0.0, 0.4, 0.6, 1.0], [0.0, 0.0, 0.0, 0.0]])
HOT_COLD_PMF = [np.array([0.2, 0.4, 0.4]), np.array([0.5, 0.4, 0.1])]
CHAIN_PMF = [np.array([0.8, 0.15, 0.05]), np.array([0.05, 0.8, 0.15]), np.array([0.15, 0.05, 0.8])]


def _log_emissions(obs, pmf):
    with np.errstate(divide="ignore"):
        return np.log(np.stack([H.discrete_likelihood(np.array(obs), p) for p in pmf], axis=1))


def test_hot_then_cold():
    best = H.decode(HOT_COLD, _log_emissions([2, 2, 2, 0, 0, 0], HOT_COLD_PMF), 1)
    assert best[0].states == (1, 1, 1, 2, 2, 2) and best[0].start == 0


def test_top_sequences_are_sorted():
    found = H.decode(HOT_COLD, _log_emissions([2, 2, 2, 0, 0, 0], HOT_COLD_PMF), 10)
    assert [x.score for x in found] == sorted((x.score for x in found), reverse=True)


def _best_by_enumeration(a, emissions, end, whole):
    best = 0.0
    for start in [0] if whole else range(end + 1):
        for states in product(range(1, len(a) - 1), repeat=end - start + 1):
            p = a[0, states[0]] * emissions[start, states[0] - 1]
            for t in range(1, len(states)):
                p *= a[states[t - 1], states[t]] * emissions[start + t, states[t] - 1]
            best = max(best, p * a[states[-1], -1])
    return best


@pytest.mark.parametrize("stay", [0.25, 0.5])
def test_decoding_is_the_best_of_all_paths(stay):
    a, obs = H.left_to_right(3, stay), [2, 0, 1, 0, 1, 2, 2]
    log_e = _log_emissions(obs, CHAIN_PMF)
    found = H.decode(a, log_e, 10)
    want = sorted((p for t in range(len(obs)) if (p := _best_by_enumeration(a, np.exp(log_e), t, False)) > 0), reverse=True)
    assert [np.exp(x.score) for x in found] == pytest.approx(want, rel=1e-9)
    whole = H.decode(a, log_e, 1)[0]
    assert np.exp(whole.score) == pytest.approx(_best_by_enumeration(a, np.exp(log_e), len(obs) - 1, True))
    for x in found:
        part = np.exp(log_e)[x.start : x.start + len(x.states)]
        assert H.path_probability(a, part, list(x.states)) == pytest.approx(np.exp(x.score))


def test_too_short_a_sequence_has_no_path():
    assert H.decode(H.left_to_right(3), _log_emissions([0, 1], CHAIN_PMF), 3) == []


def test_nearer_points_are_likelier():
    near, far = (H.kernel_likelihood(np.array([x]), np.array([[2.0, 4.0]]), 1.0)[0] for x in ([2.0, 4.0], [2.0, 6.0]))
    assert near > far and near == pytest.approx(1 / (2 * np.pi))
    assert H.kernel_likelihood(np.array([[1e9, np.nan]]), np.array([[0.0, 0.0]]), 1.0)[0] == H.FLOOR


def test_the_query_scores_one_and_others_less():
    rng = np.random.default_rng(1)
    query = rng.normal(size=(4, 5))
    model = H.QueryModel(query)
    score, best = model.score(query)
    assert score == pytest.approx(1.0) and best.states == (1, 2, 3, 4)
    assert model.score(query + 1.5)[0] < 1 and model.score(query[:2]) is None and model.score(np.empty((0, 5))) is None


def test_session_model_prefers_its_own_sequence():
    times, features = np.array([0.0, 1.0, 100.0, 101.0]), np.array([[0.0], [0.1], [5.0], [5.1]])
    model = H.SessionModel(times, features, gap=10, bandwidth=1.0)
    assert np.allclose(model.transitions.sum(axis=1), 1) and model.start.tolist() == pytest.approx([0.9, 0.05, 0.0])
    own, turned = model.log_probability(times, features), model.log_probability(times, features[::-1])
    assert own > turned
