"""Temporal re-scoring of matches by hidden Markov models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hmm import QueryModel, SessionModel, decode, discrete_likelihood, path_probability
from ..sources.work import save
from .features import normalized
from .observe import aggregate_links

_KEYS = ("match", "bucket", "n")


def normalized_observations(found: DataFrame) -> DataFrame:
    """Observation columns on a common scale, as one array per match in time order."""
    columns = tuple(c for c in found.columns if c not in _KEYS)
    scaled = normalized(found, columns)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", F.array(*columns).alias("v"))))
    return scaled.groupBy("match").agg(ordered.alias("o")).select("match", F.col("o.v").alias("vectors"))


def rescore(found: DataFrame, query_match: int, bandwidth: float = 0.75, scale: float = 0.1) -> DataFrame:
    """(match, score, start, states): how like the query's sequence each match's is.

    All observations are normalised together; the query's make the model (a
    few vectors, sent with the function). Matches without observations have
    no row.
    """
    sequences = save(normalized_observations(save(found, "observations")), "sequences")
    own = sequences.filter(F.col("match") == query_match).first()
    if own is None:
        return found.sparkSession.createDataFrame([], "match long, score double, start int, states array<int>")
    model = QueryModel(np.array(own.vectors), bandwidth, scale)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for match, vectors in zip(frame["match"], frame["vectors"], strict=True):
                got = model.score(np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.empty((0, 0)))
                if got is not None:
                    rows.append((match, got[0], got[1].start, list(got[1].states)))
            yield pd.DataFrame(rows, columns=["match", "score", "start", "states"])

    return sequences.mapInPandas(run, "match long, score double, start int, states array<int>")


def phase_links(links: DataFrame, rescored: DataFrame, bucket: int = 2) -> DataFrame:
    """Aggregated links of each phase: a run of buckets in the same state, within the scored part of a match."""
    order = W.partitionBy("match").orderBy("time", "role_s", "role_t", "usd")
    numbered = links.withColumn("bucket", F.floor((F.row_number().over(order) - 1) / bucket).cast("int"))
    states = rescored.select("match", "start", F.posexplode("states").alias("i", "state")).select("match", (F.col("start") + F.col("i")).alias("bucket"), "state")
    in_time = W.partitionBy("match").orderBy("bucket")
    turn = F.coalesce((F.col("state") != F.lag("state").over(in_time)).cast("int"), F.lit(0))
    phases = states.withColumn("_turn", turn).withColumn("phase", F.sum("_turn").over(in_time.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return aggregate_links(numbered.join(phases.select("match", "bucket", "phase"), ["match", "bucket"]), "phase")


def session_scores(features: DataFrame, query_match: int, columns: list[str], gap_ms: float, bandwidth: float) -> DataFrame:
    """(match, log_probability) under a model whose states are the query's sessions.

    ``features(match, ms, ...)`` holds a row per transaction.
    """
    point = F.struct("ms", F.array(*columns).alias("v"))
    sequences = features.groupBy("match").agg(F.array_sort(F.collect_list(point)).alias("o"))
    sequences = save(sequences, "sessions")
    own = sequences.filter(F.col("match") == query_match).first()
    if own is None:
        return features.sparkSession.createDataFrame([], "match long, log_probability double")
    model = SessionModel(np.array([o.ms for o in own.o], dtype=float), np.array([o.v for o in own.o], dtype=float), gap_ms, bandwidth)
    flat = sequences.select("match", F.col("o.ms").alias("ms"), F.col("o.v").alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [model.log_probability(np.asarray(ms, dtype=float), np.stack(list(v)).astype(float)) for ms, v in zip(frame["ms"], frame["v"], strict=True)]
            yield pd.DataFrame({"match": frame["match"], "log_probability": scores})

    return flat.mapInPandas(run, "match long, log_probability double")


def decoded_symbols(sequences: DataFrame, transitions: list[list[float]], pmfs: list[list[float]]) -> DataFrame:
    """The best states of ``sequences(..., symbols)`` under a discrete model: states, their log score and probability.

    ``transitions`` has the start state first and the end state last; ``pmfs``
    gives each inner state's probability of every symbol. Sequences that are
    empty or impossible have no row.
    """
    schema = sequences.drop("symbols").schema.add("states", T.ArrayType(T.IntegerType())).add("score", "double").add("probability", "double")
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                *keys, symbols = row
                if not len(symbols):
                    continue
                emissions = np.stack([discrete_likelihood(symbols, p) for p in pmfs], axis=1)
                with np.errstate(divide="ignore"):
                    best = decode(np.array(transitions), np.log(emissions))
                if best:
                    rows.append((*keys, list(best[0].states), best[0].score, path_probability(transitions, emissions, list(best[0].states))))
            yield pd.DataFrame(rows, columns=names)

    keys = [c for c in sequences.columns if c != "symbols"]
    return sequences.select(*keys, "symbols").mapInPandas(run, schema)


def external_scores(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """Matches with scores from outside, by their place (``scores(index, score)``); place 0, the query, has 0."""
    joined = matches.drop("score").join(scores.select(F.col("index").alias("match"), "score"), "match", "left")
    return joined.withColumn("score", F.when(F.col("match") == 0, 0.0).otherwise(F.col("score")))
