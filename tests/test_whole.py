"""Registered queries over small tables, held against brute force: nothing is cut."""

from __future__ import annotations

import hashlib
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from corvane.plans import logs, scores, tables


def test_errors_of_one_type_are_one_cluster(spark, tmp_path):
    rows = [("Bash", "timeout", False), ("edit", "timeout", False), ("read", "not_found", False), ("Bash", "denied", True), ("grep", "", False)]
    spark.createDataFrame(rows, "tool_name string, error_type string, success boolean").write.parquet(f"{tmp_path}/tool_events.parquet")
    got = {r.id: r.cluster for r in logs.error_clusters(spark, str(tmp_path)).collect()}
    assert got == {"bash/timeout": "bash/timeout", "edit/timeout": "bash/timeout", "read/not_found": "read/not_found", "grep/": "grep/"}


def test_long_and_unlisted_sessions_have_paths(spark, tmp_path):
    rows = [(i, "long", 40 - i, f"T{i}") for i in range(40)] + [(50, "unlisted", 1, "Read"), (51, "unlisted", 1, "Edit"), (51, "unlisted", 1, "Edit"), (52, None, 1, "x"), (53, "long", 5, None)]
    spark.createDataFrame(rows, "id long, session_id string, execution_order int, tool_name string").write.parquet(f"{tmp_path}/tool_events.parquet")
    got = {(r.session_id, r.position): r.tool for r in logs.session_paths(spark, str(tmp_path)).collect()}
    assert got == {("long", 40 - i): f"t{i}" for i in range(40)} | {("unlisted", 1): "read", ("unlisted", 2): "edit"}


KINDS = ["click", "purchase", "search", "share", "view", "error"]


def _events(spark, path):
    t = datetime(2024, 1, 1)
    seqs = {u: [KINDS[(u * 7 + i * (1 + u % 3)) % 6] for i in range(10)] for u in range(12)}
    rows = [(100 * u + i, u, t + timedelta(hours=i), k) for u, s in seqs.items() for i, k in enumerate(s)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{path}/events.parquet")
    return seqs, rows


def test_ngrams_to_eight(spark, tmp_path):
    seqs, _ = _events(spark, tmp_path)
    want = Counter((n, ">".join(s[i : i + n])) for s in seqs.values() for n in range(2, 9) for i in range(len(s) - n + 1))
    assert {(r.length, r.gram): r.n for r in logs.workflow_ngrams_whole(spark, str(tmp_path)).collect()} == want
    scored = {r.gram: r.n for r in logs.workflow_scores_whole(spark, str(tmp_path)).collect()}
    assert scored == {g: n for (_, g), n in want.items() if n >= 3} and any(g.count(">") == 7 for g in scored)


def test_itemsets_and_rules_to_five(spark, tmp_path):
    _, rows = _events(spark, tmp_path)
    has: dict[int, set] = {}
    for _, u, t, k in rows:
        has.setdefault(u, set()).update({f"tool:{k}"} if k != "view" else ())
        has[u].update({f"hour:{t.hour // 6}"} if k == "error" else ())
    n = sum(map(bool, has.values()))
    sets = Counter(c for x in has.values() for k in range(1, 6) for c in combinations(sorted(x), k))
    sets = {c: s for c, s in sets.items() if s >= 0.05 * n}
    assert {r["items"]: r.support for r in logs.frequent_itemsets(spark, str(tmp_path)).collect()} == {"|".join(c): s for c, s in sets.items()}
    want = {("|".join(a), "|".join(x for x in c if x not in a)): s for c, s in sets.items() for k in range(1, len(c)) for a in combinations(c, k) if s / sets[a] >= 0.6}
    got = {(r.antecedent, r.consequent): r.support for r in logs.itemset_rules(spark, str(tmp_path)).collect()}
    assert got == want and any(a.count("|") and b.count("|") for a, b in got)


def test_whole_texts_are_escaped(spark, tmp_path):
    text = "plain words " * 40 + "<a href='x'>&\"</a>"
    spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = "plain words " * 40 + "&lt;a href=&apos;x&apos;&gt;&amp;&quot;&lt;/a&gt;"
    assert [tuple(r) for r in tables.xml_texts(spark, str(tmp_path)).collect()] == [(1, len(want), hashlib.sha256(want.encode()).hexdigest())]


def test_parameters_named_twice_are_kept(spark, tmp_path):
    spark.createDataFrame([("a", "f(payload, payload)"), ("b", "f(payload, limit)")], "id string, signature string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r.id: r.likeness for r in scores.signature_likenesses(spark, str(tmp_path)).collect()} == {"a": 0.75, "b": 1.0}
