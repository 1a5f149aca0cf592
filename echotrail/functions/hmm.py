"""Hidden Markov models over observation sequences: likelihoods, decoding, scoring.

Plain NumPy, vectorised over states; the operators run it on Arrow batches,
one sequence a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The least likelihood of an observation.
FLOOR = 1e-18


def kernel_likelihood(observations: np.ndarray, centers: np.ndarray, bandwidth: float) -> np.ndarray:
    """Gaussian kernel density of each observation (rows), never under FLOOR."""
    x, c = np.atleast_2d(observations), np.atleast_2d(centers)
    squares = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    with np.errstate(invalid="ignore", over="ignore"):
        p = np.exp(-0.5 * squares / bandwidth**2).sum(axis=1) / (len(c) * 2 * bandwidth**2 * np.pi) ** (c.shape[1] / 2)
    return np.where(p >= FLOOR, p, FLOOR)


def discrete_likelihood(observations: np.ndarray, pmf: np.ndarray) -> np.ndarray:
    return np.asarray(pmf)[np.asarray(observations, dtype=int)]


@dataclass(frozen=True)
class StateSequence:
    """States 1..n from ``start`` on, and the (log) score."""

    states: tuple[int, ...]
    score: float
    start: int


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def decode(transitions: np.ndarray, log_emissions: np.ndarray, k: int = 1) -> list[StateSequence]:
    """The k best state sequences of ``log_emissions`` (times by states), best first.

    transitions: (n + 2) square, with the start state first and the end state
    last. k = 1: the whole sequence. k > 1: sub-sequences may start and end
    anywhere; one, the best, for each time of ending. Equal predecessors: the
    lowest state; a fresh start must be strictly better. None if nothing is
    possible.
    """
    log_a = _log(np.asarray(transitions, dtype=float))
    enter, inner, leave = log_a[0, 1:-1], log_a[1:-1, 1:-1], log_a[1:-1, -1]
    times, n = log_emissions.shape
    best, came, began = np.empty((times, n)), np.full((times, n), -1), np.zeros((times, n), dtype=int)
    best[0] = enter + log_emissions[0]
    for t in range(1, times):
        paths = best[t - 1][:, None] + inner
        came[t] = paths.argmax(axis=0)
        value = paths[came[t], np.arange(n)]
        began[t] = began[t - 1, came[t]]
        if k > 1:
            fresh = enter > value
            value, came[t, fresh], began[t, fresh] = np.where(fresh, enter, value), -1, t
        best[t] = value + log_emissions[t]
    found = []
    for t in range(times) if k > 1 else [times - 1]:
        ends = best[t] + leave
        s = int(ends.argmax())
        if ends[s] == -np.inf:
            continue
        states, at = [], s
        for u in range(t, began[t, s] - 1, -1):
            states.append(at + 1)
            at = came[u, at]
        found.append(StateSequence(tuple(reversed(states)), float(ends[s]), int(began[t, s])))
    return sorted(found, key=lambda x: -x.score)[:k]


def path_probability(transitions: np.ndarray, emissions: np.ndarray, states: list[int]) -> float:
    """The probability of going through these states with these emissions, from start to end."""
    a = np.asarray(transitions, dtype=float)
    steps = [0, *states, len(a) - 1]
    move = np.prod([a[i, j] for i, j in zip(steps, steps[1:], strict=False)])
    return float(move * np.prod([emissions[t, s - 1] for t, s in enumerate(states)]))


def left_to_right(n: int, stay: float = 0.5) -> np.ndarray:
    """Transitions of a chain of n states that starts at the first and ends after the last."""
    a = np.zeros((n + 2, n + 2))
    a[0, 1] = 1.0
    at = np.arange(1, n + 1)
    a[at, at], a[at, at + 1] = stay, 1 - stay
    return a


class QueryModel:
    """A chain with one state for each observation of a query."""

    def __init__(self, observations: np.ndarray, bandwidth: float = 0.75, scale: float = 0.1, k: int = 3):
        self.centers = np.atleast_2d(np.asarray(observations, dtype=float))
        self.bandwidth, self.scale, self.k = bandwidth, scale, k
        self.transitions = left_to_right(len(self.centers))
        own = self.decode(self.centers)
        self.own_score = own.score if own else -np.inf

    def decode(self, observations: np.ndarray) -> StateSequence | None:
        if not len(observations):
            return None
        emissions = np.stack([kernel_likelihood(observations, c, self.bandwidth) for c in self.centers], axis=1)
        found = decode(self.transitions, _log(emissions), self.k)
        return found[0] if found else None

    def score(self, observations: np.ndarray) -> tuple[float, StateSequence] | None:
        """1 / (1 + scale * |difference to the query's own score|), and the states; None without any."""
        best = self.decode(observations)
        return None if best is None else (1 / (1 + self.scale * abs(best.score - self.own_score)), best)


#: What marks the end of a sequence in a session model: its features, and their bandwidth.
END_FEATURE, END_BANDWIDTH, TO_END = 1e6, 1000.0, 1e-15


class SessionModel:
    """A model with a state for each session of some transactions, and an end state.

    Sessions are split where the time between transactions exceeds ``gap``.
    """

    def __init__(self, times: np.ndarray, features: np.ndarray, gap: float, bandwidth: float):
        order = np.argsort(times, kind="stable")
        times, features = np.asarray(times)[order], np.atleast_2d(features)[order]
        session = np.concatenate(([0], np.cumsum(np.diff(times) > gap)))
        n = int(session[-1]) + 2
        size = np.bincount(session)
        self.start = np.zeros(n)
        self.start[: n - 1] = 0.1 / (n - 1)
        self.start[0] = 0.9
        self.transitions = np.zeros((n, n))
        for i in range(n - 1):
            self.transitions[i, i] = size[i] / len(times)
            if i < n - 2:
                self.transitions[i, i + 1] = 1 - self.transitions[i, i] - TO_END
                self.transitions[i, n - 1] = TO_END
            else:
                self.transitions[i, n - 1] = 1 - self.transitions[i, i]
        self.transitions[n - 1, n - 1] = 1.0
        self.centers = [features[session == i] for i in range(n - 1)]
        self.bandwidth = bandwidth

    def log_probability(self, times: np.ndarray, features: np.ndarray) -> float:
        """ln of the probability of the transactions followed by the end mark (scaled forward algorithm)."""
        x = np.atleast_2d(features)[np.argsort(times, kind="stable")]
        end = np.full((1, x.shape[1]), END_FEATURE)
        x = np.vstack([x, end])
        emit = np.stack([*[kernel_likelihood(x, c, self.bandwidth) for c in self.centers], kernel_likelihood(x, end, END_BANDWIDTH)], axis=1)
        forward, total = self.start * emit[0], 0.0
        for t in range(len(x)):
            if t:
                forward = (forward @ self.transitions) * emit[t]
            norm = forward.sum()
            if norm <= 0:
                return -np.inf
            total += np.log(norm)
            forward = forward / norm
        return float(total)
