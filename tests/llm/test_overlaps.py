from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.overlaps import PAIRS, SEGMENTS, STOP_WORDS, overlap_report, segment_codes, split_overlaps

SCHEMA = "query_id string, query string, split_name string, source string, key string, t boolean, rid string, w int"


def words(text):
    text = re.sub(r"([a-zäöü])([A-ZÄÖÜ])", r"\1 \2", text)
    return sorted(w for w in re.findall(r"[^\W\d_]+", text.lower()) if w not in STOP_WORDS)


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def same(x, y):
    a, b = Counter(words(x)), Counter(words(y))
    if a == b:
        return True
    p, q = list((a - b).elements()), list((b - a).elements())
    return len(p) == len(q) == 1 and one_edit(p[0], q[0])


def data(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["ledger", "lodger", "ledgre", "router", "Router", "token", "tokens", "cacheKey", "cache", "key", "größe", "the", "of", "find", "grid", "gird"]
    out = []
    for i in range(n):
        text = None if r.random() < 0.03 else r.choice([" ", "_", "-", "."]).join(r.choice(vocabulary) for _ in range(r.randint(0, 5)))
        split = None if r.random() < 0.05 else r.choice(["train", "train", "validation", "test", "other"])
        row = (f"q{i}" if r.random() > 0.02 else None, text, split, r.choice(["a", "b", None]), "k", True, "r", 1)
        out.append(row)
        if r.random() < 0.1:
            out.append(row)
    out += [(f"h{i}", "hot ledger router", "train" if i % 2 else "test", "a", "k", True, "r", 1) for i in range(30)]
    return out


def pairs(rows):
    one = {r[0]: r for r in rows if r[0] is not None and r[1] is not None}
    t = [r for r in one.values() if r[2] == "train"]
    e = [r for r in one.values() if r[2] in ("validation", "test")]
    return {(a[0], b[0]) for a in t for b in e if same(a[1], b[1])}


def test_pairs_match_brute_force(spark):
    for seed in (1, 2):
        rows = data(seed)
        got = [(r.train_id, r.eval_id) for r in split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs(rows)


def test_report_counts_pairs(spark):
    rows = data(3)
    report = overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = pairs(rows)
    assert sum(r.pairs for r in report) == len(want)
    assert sum(r.overlapping for r in report) == len({b for _, b in want})


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert split_overlaps(empty).count() == 0 and overlap_report(empty).count() == 0
    blank = spark.createDataFrame([("a", "the of", "train", "x", "k", True, "r", 1), ("b", "", "test", "x", "k", True, "r", 1), ("c", "ledger", "test", "x", "k", True, "r", 1)], SCHEMA)
    assert [(r.train_id, r.eval_id) for r in split_overlaps(blank).collect()] == [("a", "b")]


def test_long_text(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    rows = [("a", long, "train", "x", "k", True, "r", 1), ("b", long + "s", "test", "x", "k", True, "r", 1)]
    assert split_overlaps(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_radius_of_two_leaves_a_shared_block(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        w = [chr(97 + r.randrange(26)) for _ in range(r.randint(2, 12))]
        e = w[:]
        at = r.randrange(len(w))
        kind = r.randrange(4)
        if kind == 0:
            e.insert(at, chr(97 + r.randrange(26)))
        elif kind == 1:
            del e[at]
        elif kind == 2:
            e[at] = chr(97 + r.randrange(26))
        elif at:
            e[at - 1], e[at] = e[at], e[at - 1]
        rows += [(i, "".join(w)), (i, "".join(e))]
    coded = spark.createDataFrame(rows, "i int, x string").select("i", *[c.alias(f"c{n}") for n, c in enumerate(segment_codes(__import__("pyspark").sql.functions.col("x")))]).collect()
    by = {}
    for c in coded:
        by.setdefault(c[0], []).append(c[1:])
    for a, b in by.values():
        assert any(a[i] == b[i] and a[j] == b[j] for i, j in PAIRS)
        assert sum((a[i] ^ b[i]).bit_count() for i in range(SEGMENTS)) <= 2


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_edit_is_symmetric(a, b):
    assert one_edit(a, b) == one_edit(b, a)
