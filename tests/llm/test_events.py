"""Runs and frequent subsequences against brute force, with all the dirt there may be."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from corvane.llm.runs import collapse_runs
from corvane.llm.subsequences import extension_counts, frequent_subsequences, shorten

SCHEMA = "id long, session_id string, tool_name string, execution_order int, timestamp timestamp_ntz, ingested_at timestamp_ntz, s string, pos string, name int, us string, _cv_block int, prev string, n string"
T0 = datetime(2025, 1, 1)


def rows(n, seed, hot=0.4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        session = None if r.random() < 0.03 else "hot" if r.random() < hot else f"s{r.randrange(8)}"
        tool = None if r.random() < 0.05 else r.choice(["Read", "read ", "READ", "Edit", "run_tests", "runTests", "  "])
        order = None if r.random() < 0.05 else r.randrange(n // 3)
        at = None if r.random() < 0.03 else T0 + timedelta(seconds=r.choice([0, 100, 600, 601, 1200]) * (i % 7))
        row = (i, session, tool, order, at, T0, "x", "y", 1, "z", 5, "p", "q")
        out.append(row)
        if r.random() < 0.1:
            out.append((*row[:5], T0 + timedelta(hours=1), *row[6:]))
    return out


def key(name):
    return re.sub("[^a-z0-9]", "", (name or "").lower()) or None


def sequences(data):
    seen = {}
    for r in data:
        if r[1] is not None and r[0] is not None and (r[0] not in seen or r[5] < seen[r[0]][5]):
            seen[r[0]] = r
    by = {}
    for r in seen.values():
        by.setdefault(r[1], []).append(r)
    return {s: sorted(v, key=lambda r: (r[3] is not None, r[3] or 0, r[0])) for s, v in by.items()}


@pytest.mark.parametrize(("n", "partitions"), [(300, 1), (300, 7), (60, 3)])
def test_runs_match_brute_force(spark, n, partitions):
    data = rows(n, n + partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.session, r.first_id, r.last_id, r.n_events, r.duration_us) for r in collapse_runs(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = set()
    for s, own in sequences(data).items():
        runs = []
        for r in own:
            p = runs[-1][-1] if runs else None
            if p and key(r[2]) and key(r[2]) == key(p[2]) and r[4] and p[4] and abs((r[4] - p[4]).total_seconds()) <= 600:
                runs[-1].append(r)
            else:
                runs.append([r])
        for x in runs:
            first, last = x[0], x[-1]
            us = None if first[4] is None or last[4] is None else round((last[4] - first[4]).total_seconds() * 1e6)
            want.add((s, first[0], last[0], len(x), us))
    assert got == want


def test_runs_of_nothing(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    only_null = [(None, "a", "Read", 1, T0, T0, *["x"] * 2, 1, "z", 5, "p", "q"), (1, None, "Read", 1, T0, T0, *["x"] * 2, 1, "z", 5, "p", "q")]
    assert collapse_runs(spark.createDataFrame(only_null, SCHEMA)).count() == 0


def subsequences(x, k):
    out = {()}
    for a in x:
        out |= {p + (a,) for p in out if len(p) < k}
    return out


def test_shortening_keeps_all_subsequences():
    r = random.Random(4)
    for _ in range(500):
        k = r.randint(1, 4)
        x = [r.randint(0, r.randint(0, 3)) for _ in range(r.randint(0, 14))]
        y = shorten(x, k)
        assert subsequences(x, k) == subsequences(y, k)
    assert len(shorten([r.randint(0, 4) for _ in range(20000)], 5)) < 200


def test_extension_counts():
    import numpy as np

    lists, weights = [[0, 1, 0, 2], [1, 2], [], [2, 0, 1]], np.array([3, 1, 5, 2])
    got = extension_counts(lists, weights, [(), (0,), (0, 1)])
    want = {}
    for p in [(), (0,), (0, 1)]:
        for a in (0, 1, 2):
            n = sum(int(w) for x, w in zip(lists, weights, strict=True) if (*p, a) in subsequences(x, 3))
            if n:
                want[(*p, a)] = n
    assert got == want


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_patterns_match_brute_force(spark, share):
    data = rows(160, 9)
    got = {r.pattern: r.support for r in frequent_subsequences(spark.createDataFrame(data, SCHEMA), min_share=share, min_len=2, max_len=3).collect()}
    lists = [[key(r[2]) for r in own if key(r[2])] for own in sequences(data).values()]
    names = sorted({a for x in lists for a in x})
    need = share * len(lists)
    want = {}
    for n in (2, 3):
        for p in product(names, repeat=n):
            support = sum(p in subsequences(x[:40], 3) if len(x) <= 40 else contains(x, p) for x in lists)
            if support >= need - 1e-9:
                want[">".join(p)] = support
    assert got == want and want


def contains(x, p):
    it = iter(x)
    return all(a in it for a in p)


def test_no_patterns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert frequent_subsequences(df).columns == ["pattern", "length", "support"] and frequent_subsequences(df).count() == 0
    one = spark.createDataFrame([(1, "a", None, 1, T0, T0, *["x"] * 2, 1, "z", 5, "p", "q")], SCHEMA)
    assert frequent_subsequences(one).count() == 0


def test_session_in_many_blocks_and_pieces(spark, monkeypatch):
    from corvane.llm import subsequences as S

    monkeypatch.setattr(S, "PIECE", 16)
    data = rows(400, 31, hot=0.95)
    got = {r.pattern for r in frequent_subsequences(spark.createDataFrame(data, SCHEMA), min_share=0.5, min_len=2, max_len=2).select("pattern").collect()}
    lists = [[key(r[2]) for r in own if key(r[2])] for own in sequences(data).values()]
    want = {f"{a}>{b}" for a in {x for y in lists for x in y} for b in {x for y in lists for x in y} if sum(contains(x, (a, b)) for x in lists) >= 0.5 * len(lists)}
    assert got == want


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame(rows(100, 5), SCHEMA)
    twice = df.unionByName(df)
    assert {tuple(r) for r in collapse_runs(df).collect()} == {tuple(r) for r in collapse_runs(twice).collect()}
    assert frequent_subsequences(twice, min_share=0.4).exceptAll(frequent_subsequences(df, min_share=0.4)).where(F.lit(True)).count() == 0
