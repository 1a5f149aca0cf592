"""What travels: the fixpoint writes no transactions, and deviations of some transactions need their users' averages alone."""

from __future__ import annotations

import datetime as dt
import random

from echotrail.operators import activity as A
from echotrail.operators import ingest as I
from echotrail.sources.work import Rounds


def _txn(spark):
    rng = random.Random(2)
    rows = [(i, min(rng.randrange(1, 30), rng.randrange(1, 30)), rng.randrange(1, 30), dt.datetime(2024, 1, 1), 1.0, float(i % 9)) for i in range(150)]
    return spark.createDataFrame(rows, "transid long, source long, target long, time timestamp, amount double, usd double"), rows


def test_fixpoint_writes_ends_and_users_alone(spark, monkeypatch):
    txn, rows = _txn(spark)
    written, own = [], Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df: written.append(set(df.columns)) or own(self, df))
    got = A.activity_fixpoint(txn, 7, "bag").collect()
    left = rows
    while True:
        count = {u: sum((r[1] == u) + (r[2] == u) for r in left) for r in left for u in r[1:3]}
        kept = [r for r in left if count[r[1]] >= 7 and count[r[2]] >= 7]
        if len(kept) == len(left):
            break
        left = kept
    assert sorted(map(tuple, got)) == left and 0 < len(left) < len(rows)
    assert len(written) > 3 and all(c <= {"source", "target", "user"} for c in written)


def test_deviations_of_some_transactions(spark):
    txn, _ = _txn(spark)
    some = txn.filter("transid % 40 = 3")
    want = [tuple(r) for r in I.deviations(txn).filter("transid % 40 = 3").orderBy("transid").collect()]
    got = [tuple(r) for r in I.deviations(txn, some).select(I.deviations(txn).columns).orderBy("transid").collect()]
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in got] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in want] and got
