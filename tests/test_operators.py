from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import evaluation as V
from corvane.operators import events as E
from corvane.operators import graph as G
from corvane.operators import incremental as I
from corvane.operators import mining as M
from corvane.operators import retrieval as R
from corvane.operators import scoring as S
from corvane.operators.ordering import previous_rows, running_sum


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_reciprocal_rank_and_recall(spark):
    results = spark.createDataFrame([("q1", "x", 1), ("q1", "a", 2), ("q2", "y", 1), ("q2", "z", 2), ("q2", "b", 3), ("q3", "n", 1)], "query string, doc string, rank int")
    relevant = spark.createDataFrame([("q1", "a"), ("q1", "c"), ("q2", "b"), ("q3", "m")], "query string, doc string")
    got = {r.query: r for r in V.per_query(results, relevant).collect()}
    assert got["q1"].rr == 0.5 and got["q2"].rr == pytest.approx(1 / 3) and got["q3"].rr == 0.0
    assert got["q1"].recall_5 == 0.5 and got["q2"].ndcg_ref_5 == pytest.approx(0.5) and got["q1"].ndcg_5 < 1


def test_min_max_of_single_and_equal_scores(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 0.7), ("b", 2, 0.7), ("c", 1, 1.0), ("c", 2, 3.0), ("c", 3, 2.0)], "l string, id int, score double")
    assert sorted((r.l, r.id, r.score) for r in R.min_max(df, "l").collect()) == [("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("c", 1, 0.0), ("c", 2, 1.0), ("c", 3, 0.5)]


def test_fusion_is_symmetric_and_ties_go_by_id(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (1, 2)], "id int, rank int")
    got = R.ranked(R.rrf({"x": a, "y": b}, {"x": 0.5, "y": 0.5}), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score == got[1].score
    full = R.ranked(R.rrf({"x": a, "y": b}, {"x": 0.6, "y": 0.4}), 2).collect()
    assert {r.id for r in R.ranked(R.rrf({"x": a, "y": b}, {"x": 0.6, "y": 0.4}), 1).collect()} <= {r.id for r in full}


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(1.0), 0.0, None]


def test_definitive_backend_wins(spark):
    df = spark.createDataFrame([("semantic", "a", 1, 0, False), ("lsp", "b", 1, 5, True)], "backend string, file string, start_line int, rank int, definitive boolean")
    got = {r.file: r.score for r in R.merge_backends(df).collect()}
    assert math.isinf(got["b"]) and got["a"] == pytest.approx(1 / 60)


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([50, 60, 40, 30, 10])], "g string, i int, s int")
    got = R.budget_fill(df, "g", [F.col("i")], "s", 100, "i").first()
    assert got["items"] == [0, 2, 4] and got.used == 100


def test_rerank_and_summaries(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 1.0, 2.0), (3, 0.5, None), (4, 1.0, 99.0)], "id int, score double, rating double")
    assert {r.id: r.score for r in R.rerank(df).collect()} == {1: pytest.approx(1.0), 3: 0.5, 4: pytest.approx(1.0)}
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    s = spark.createDataFrame([("file_summary", 1, "f", ["a", "b"]), ("symbol_summary", 9, "s", ["a"])], "kind string, rank int, summary string, source_ids array<string>")
    assert {r.id: r.summary for r in R.attach_summaries(chunks, s).collect()} == {"a": "s", "b": "f", "c": None}


GRAPH = [(1, 2), (2, 3), (3, 1), (4, 4), (1, 2), (5, 99)]


def test_pagerank_sums_to_one(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    e = G.distinct_edges(spark.createDataFrame(GRAPH, "src int, dst int"), v)
    assert {tuple(r) for r in e.collect()} == {(1, 2), (2, 3), (3, 1), (4, 4)}
    ranks = {r.id: r["rank"] for r in G.pagerank(v, e).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks[1] == pytest.approx(ranks[2]) and ranks[4] > ranks[5] == ranks[6]
    assert G.pagerank(v.limit(0), e).count() == 0


def test_reach_levels_and_enclosing(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 1), (5, 4)], "src int, dst int")
    assert {tuple(r) for r in G.reach(e, spark.createDataFrame([(3,)], "id int")).collect()} == {(2, 1), (4, 1), (1, 2), (5, 2)}
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "id string, need string")
    assert {tuple(r) for r in G.levels(items, needs).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 1)}
    with pytest.raises(ValueError, match="cycle"):
        G.levels(items, needs.union(spark.createDataFrame([("a", "c")], "id string, need string")), most=5)
    spans = spark.createDataFrame([("f", 1, 500, "outer"), ("f", 60, 130, "inner")], "file string, first int, last int, id string")
    points = spark.createDataFrame([("f", 100), ("f", 300), ("f", 501), ("g", 1)], "file string, line int")
    assert {(r.file, r.line): r.inside for r in G.enclosing(points, spans).collect()} == {("f", 100): "inner", ("f", 300): "outer", ("f", 501): None, ("g", 1): None}


def test_member_path_beats_rank(spark):
    s = spark.createDataFrame([(1, "run", None, "a.py", True, 0.9), (2, "run", "Job", "b.py", False, 0.1)], "id int, name string, parent_name string, file string, exported boolean, rank double")
    assert G.find_symbol(s, "Job.run").first().id == 2 and G.find_symbol(s, "run").first().id == 1 and G.find_symbol(s, "run", "b.py").first().id == 2


def test_change_sets_and_merges(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, h string")
    b = spark.createDataFrame([("y", "2"), ("z", None), ("w", "1")], "k string, h string")
    assert {tuple(r) for r in I.change_set(a, b, "k", "h").collect()} == {("x", "deleted"), ("y", "modified"), ("z", "unchanged"), ("w", "new")}
    old = spark.createDataFrame([("a", None, 1, "old"), ("b", "1", 5, "old")], "lib string, version string, v int, c string")
    new = spark.createDataFrame([("a", None, 2, "new"), ("b", "1", 4, "new"), ("b", "1", 5, "same")], "lib string, version string, v int, c string")
    assert {(r.lib, r.c) for r in I.upsert(old, new, ["lib", "version"], "v").collect()} == {("a", "new"), ("b", "same")}
    child = spark.createDataFrame([("p", "c")], "path string, h string")
    parents = spark.createDataFrame([("p", "x", 1), ("q", "first", 1), ("q", "second", 2), ("r", "x", 2)], "path string, h string, parent_no int")
    assert {tuple(r) for r in I.inherit(child, parents, spark.createDataFrame([("r",)], "path string")).collect()} == {("p", "c"), ("q", "first")}
    assert I.fingerprint(a, "k", "h").first() == I.fingerprint(a.orderBy(F.desc("k")), "k", "h").first() != I.fingerprint(b, "k", "h").first()


@pytest.mark.parametrize("gap,count", [(600, 1), (601, 2)])
def test_gap_of_just_ten_minutes(spark, gap, count):
    df = spark.sql(f"select 1 as u, i as k, timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, i * {gap}) as t from range(2) as r(i)")
    assert E.gap_sessions(df, "u", "t", "k", 600).select("window_no").distinct().count() == count


def test_itemsets_and_rules_against_brute_force(spark):
    from itertools import combinations

    r = random.Random(2)
    baskets = [{x for x in "abcd" if r.random() < 0.6} for _ in range(60)]
    df = spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "e int, i array<string>")
    sets = M.itemsets(df, "e", F.col("i"), 0.2, 5)
    got = {tuple(x["items"]): x.support for x in sets.collect()}
    n = sum(bool(b) for b in baskets)
    want = {c: s for k in range(1, 5) for c in combinations("abcd", k) if (s := sum(set(c) <= b for b in baskets)) >= 0.2 * n}
    assert got == want
    found = {(tuple(x.antecedent), tuple(x.consequent)): x.confidence for x in M.rules(sets, n, 0.6).collect()}
    for (a, c), conf in found.items():
        assert conf == pytest.approx(want[tuple(sorted(a + c))] / want[a])
    assert len(found) == sum(want[s] / want[a] >= 0.6 for s in want for k in range(1, len(s)) for a in combinations(s, k))


def test_folds(spark):
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate([1, 1, -1, 1, 1])], "k string, n int, d int")
    assert M.clamped_fold(df, "k", ["n"], F.col("d") * 0.3, 1.0, 0.5, 1.5).first().value == pytest.approx(1.5)
    v = 0.0
    for d in [1, 1, -1, 1, 1]:
        v = 0.9 * v + 0.1 * d
    assert M.ema(df, "k", ["n"], F.col("d")).first().value == pytest.approx(v)
    a = b = 1.0
    for d in [1, 1, -1, 1, 1]:
        a, b = 1 + (a - 1) * 0.9 + (d > 0), 1 + (b - 1) * 0.9 + (d <= 0)
    got = E.discounted_beta(df, "k", ["n"], F.col("d") > 0, 0.9).first()
    assert (got.alpha, got.beta) == (pytest.approx(a), pytest.approx(b))


def test_error_clusters(spark):
    rows = [("1", "bash", "timeout", ["deadline", "passed"]), ("2", "bash", "timeout", ["deadline", "over"]), ("3", "grep", "syntax", ["unexpected", "token"]), ("4", "read", "timeout", ["deadline", "passed"])]
    got = {r.id: r.cluster for r in M.error_clusters(spark.createDataFrame(rows, "id string, tool string, type string, words array<string>")).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "1"}


def test_statistics(spark):
    assert one(spark, V.normal_cdf(F.col("z")), z=1.96) == pytest.approx(0.975, abs=1e-4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([(5, 3), (4, 4), (6, 1), (2, 3), (9, 5), (7, 7)])], "i int, a double, b double")
    w = V.wilcoxon(df, "a", "b").first()
    assert (w.n, w.w_plus, w.w_minus) == (4, 9.0, 1.0)
    p = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.04), (4, 0.5)], "k int, p double")
    assert [round(r.adjusted, 6) for r in V.bh_adjusted(p, "p", "k").orderBy("k").collect()] == [0.04, 0.04, 0.053333, 0.5]
    assert V.sample_size(0.3, 0.1) == 356
    low, high = V.bootstrap_mean(spark.range(1000).withColumn("x", F.col("id").cast("double")), "x", "id").first()
    assert 470 < low < 499.5 < high < 530
    same = spark.createDataFrame([("c", True), ("t", True)], "g string, x boolean")
    assert V.proportion_test(same, "g", F.col("x"), "c", "t").first().z is None
    r = V.mean_ranks(spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0)], "g string, x double"), ["g"], "x")
    assert sorted(x.mean_rank for x in r.collect()) == [1.5, 1.5, 3.0]


def test_text_functions(spark):
    assert one(spark, X.intent(F.col("q")), q="what calls parse_file").intent == "structural"
    assert one(spark, X.intent(F.col("q")), q="UserService").confidence == 0.85
    assert one(spark, X.intent(F.col("q")), q="how is it done here").intent == "semantic"
    assert one(spark, X.entities(F.col("q")), q="see UserService.load in src/a.py and parse_file") == ["UserService.load", "a.py", "UserService", "parse_file", "src/a.py"]
    assert one(spark, X.normalised_query(F.col("q")), q="How does the Cache a Token") == "cache token"
    assert one(spark, X.glob_match(F.col("p"), "src/**.py"), p="src/a/b.py") and not one(spark, X.glob_match(F.col("p"), "src/*.py"), p="src/a/b.py")
    assert one(spark, X.is_test_path(F.col("p")), p="pkg/a_test.go") and not one(spark, X.is_test_path(F.col("p")), p="src/latest.py")
    v = one(spark, X.version_parts(F.col("v")), v="^1.2.3")
    assert (v.operator, v.major, v.minor, v.patch) == ("^", 1, 2, 3)
    assert one(spark, X.version_parts(F.col("v")), v="latest").major is None
    h = 0
    for c in "user-42":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert one(spark, X.rolling_hash_bucket(F.col("s")), s="user-42") == abs(h) % 100
    assert one(spark, X.token_overlap(F.col("a"), F.col("b")), a="x y", b="y z") == 0.5
    assert one(spark, X.fuzzy_match(F.col("a"), F.col("b")), a="src/user_store.ts", b="userStore") and one(spark, X.xml_escape(F.col("t")), t="<a&'\">") == "&lt;a&amp;&apos;&quot;&gt;"


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_sum_over_blocks(spark, partitions):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 2, 3])) for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {x.i: (x.s, x.s_total) for x in running_sum(spark.createDataFrame(rows, "e string, i int, v int"), "e", [F.col("i").asc()], "v", "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for e, i, _ in rows:
        own = [(j, v or 0) for f, j, v in rows if f == e]
        assert got[i] == (sum(v for j, v in own if j < i), sum(v for _, v in own))


@pytest.mark.parametrize(("partitions", "count"), [(1, 1), (7, 3), (60, 3), (60, 1)])
def test_previous_rows_over_blocks(spark, partitions, count):
    r = random.Random(partitions + count)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(9)) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {x.i: [y.i for y in x.p] for x in previous_rows(spark.createDataFrame(rows, "e string, i int, v int"), "e", [F.col("i").asc()], ["i", "v"], count, "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for e, i, _ in rows:
        assert got[i] == [j for f, j, _ in rows if f == e and j < i][::-1][:count]


def test_streaks_over_blocks(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.random() < 0.6) for i in range(80)]
    got = {x.i: x.streak for x in E.streaks(spark.createDataFrame(rows, "e string, i int, f boolean"), "e", ["i"], F.col("f")).collect()}
    now = {}
    for e, i, f in rows:
        now[e] = now.get(e, 0) + 1 if f else 0
        assert got[i] == now[e]


def test_clamped_fold_over_blocks(spark):
    r = random.Random(11)
    rows = [(r.choice("ab"), i, r.choice([0.3, -0.3, 0.1, None])) for i in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        got = {x.k: x.value for x in M.clamped_fold(spark.createDataFrame(rows, "k string, n int, d double"), "k", ["n"], F.col("d"), 1.0, 0.5, 1.5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k in "ab":
        v = 1.0
        for key, _, d in rows:
            if key == k:
                v = min(max(v + (d or 0.0), 0.5), 1.5)
        assert got[k] == pytest.approx(v)


def test_scores(spark):
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler("", "a") == 0.0 and S.jaro_winkler(None, "a") is None
    assert one(spark, S.salvaged_json(F.col("t")), t='Sure:\n```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert one(spark, S.signature_likeness(F.col("a"), F.col("b")), a="f(x, y)", b="g(y: int)") == pytest.approx((0.5 + 0.5) / 2)
    assert one(spark, S.redacted_map(F.create_map(F.lit("apiKey"), F.col("v"), F.lit("h"), F.lit("Bearer abc"))), v="x") == {"apiKey": "[REDACTED]", "h": "Bearer [REDACTED]"}
    assert one(spark, S.normal_quantile(F.col("p")), p=0.975) == pytest.approx(1.96, abs=1e-3)
    assert [x.kind for x in one(spark, S.expansion_lines(F.col("t")), t="lex: a\nnoise\nvec:b\nhyde :  c")] == ["lex", "vec", "hyde"]
    assert one(spark, S.rollback_reason(F.col("z"), F.lit(1.0), F.lit(1.3), F.lit(1.0), F.lit(1.0)), z=1.0) == "corrections"
    c = one(spark, S.criteria(F.col("t")), t="Always run `make`.\nAlways run `make`.\nplain line")
    assert c.repeated == 1 and c.instructive == pytest.approx(2 / 3)
    local = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "pattern string, count double")
    packets = spark.createDataFrame([("p", 0.9, "a", 20.0), ("q", 0.2, "a", 500.0), ("p", 0.9, "c", 10.0)], "peer string, trust double, pattern string, count double")
    assert {x.pattern: round(x["count"], 6) for x in S.federated(local, packets).collect()} == {"a": 12.0, "b": 5.0, "c": 2.0}
    draws = spark.range(2000).select(S.beta_draw(F.lit(8.0), F.lit(2.0), 1, F.col("id")).alias("x")).agg(F.avg("x"), F.min("x"), F.max("x")).first()
    assert draws[0] == pytest.approx(0.8, abs=0.01) and 0 <= draws[1] and draws[2] <= 1


def test_samples(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(200)], "k int, s string")
    rows = S.stratified(df, "k", "s", 20, 1).collect()
    assert sum(r.s == "big" for r in rows) == 18 and sum(r.s == "small" for r in rows) == 2
    assert {r.k for r in S.sample(df, "k", 10, 4).collect()} == {r.k for r in S.sample(df.repartition(3), "k", 10, 4).collect()}


# Expected values are those of the published rules for each kind of question, test name and outcome.
@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("UserService", "symbol_lookup"), ("handleAuth", "symbol_lookup"), ("class Ledger", "symbol_lookup"), ("def parse_row", "symbol_lookup"), ("func Walk", "symbol_lookup"), ("who calls processPayment", "structural"), ("methods in UserService", "structural"),
        ("callers of flush", "structural"), ("tests for the payment module", "location"), ("handlers in the api folder", "location"), ("main.go", "location"), ("code like this retry", "similarity"), ("same as the retry logic", "similarity"), ("how does authentication work", "semantic"), ("", "semantic"),
    ],
)
def test_intents(spark, q, want):
    assert one(spark, X.intent(F.col("q")), q=q).intent == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/b_test.ts", True), ("a/b.spec.tsx", True), ("a/__tests__/b.ts", True), ("a/PayTestCase.java", True), ("a/PayIT.java", True), ("a/test_x.c", True), ("gtest/x.cpp", True), ("testdata/x.go", True), ("spec/x.py", False), ("a/b.md", False), ("tests/b.md", False), ("a/b.py", False)],
)
def test_test_paths(spark, path, want):
    assert one(spark, X.is_test_path(F.col("p")), p=path) is want


def test_test_symbols_and_outcomes(spark):
    symbol = lambda n, lang: one(spark, X.is_test_symbol(F.col("n"), F.col("l")), n=n, l=lang)
    assert symbol("TestWalk", "go") and symbol("describe", "typescript") and symbol("shouldFail", "java") and not symbol("TestWalk", "java") and not symbol("describe", "python") and not symbol("x", "cobol")
    out = lambda t, i: one(spark, S.outcome_of(F.col("t"), F.col("i")), t=t, i=i)
    assert [out(0, 0), out(4, 3), out(4, 2), out(4, 0)] == ["abandoned", "failure", "partial", "success"]
    safe = lambda p, w: one(spark, S.safety_decision({"red_team": F.lit(0.95), "blue_team": F.lit(0.95), "pattern": F.col("p"), "history": F.lit(0.95)}, F.col("w")), p=p, w=w).decision
    assert [safe(0.95, 0.0), safe(0.95, -0.4), safe(0.1, 0.0), safe(-1.0, 0.0)] == ["auto_deploy", "human_review", "human_review", "reject"]


def test_pagerank_shuffles_no_edges(spark):
    """The links are read in their buckets: within a round only sums by target are exchanged."""
    from corvane.session import bucketed

    links = bucketed(spark.range(1000).selectExpr("id % 50 as src", "id % 77 as dst"), "src", 4)
    ranks = bucketed(spark.range(100).selectExpr("id", "1.0 as rank"), "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = links.join(ranks, links["src"] == ranks["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_keyword_index_gives_what_the_scan_gives(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["grid", "Report", "index", "x1", "other", "words"], k=rng.randrange(0, 12))) if i % 9 else None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, term int")
    index = R.KeywordIndex(df, "id", "text")
    for terms in (["grid", "report"], ["GRID", "grid", "x1"], ["absent"], ["absent", "index"]):
        got = [(r.id, round(r.score, 9), r.rank) for r in index.search(terms, 25).orderBy("rank").collect()]
        assert got == [(r.id, round(r.score, 9), r.rank) for r in R.bm25(df, terms, 25, "id", "text").orderBy("rank").collect()]
    assert index.search([], 5).count() == 0 and R.KeywordIndex(df.limit(0), "id", "text").search(["grid"], 5).count() == 0


def test_symbol_maps(spark):
    from corvane.operators import symbols as Y

    rows = [("a1", "a.py", "load", None, 0.5, 30), ("a2", "a.py", "save", "def save(token)", 0.1, 30), ("b1", "b.py", "token_of", None, 0.3, 60), ("c1", "c.py", "x", None, 0.2, 20)]
    s = spark.createDataFrame(rows, "id string, file string, name string, signature string, rank double, tokens long")
    got = [tuple(r)[0:1] + (r.symbols, r.shown) for r in Y.file_map(s, budget=70).orderBy("place").collect()]
    assert got == [("a.py", 2, "whole"), ("b.py", 1, "header"), ("c.py", 1, "none")]
    assert [r.id for r in Y.question_map(s, "the token").collect()] == ["b1", "a2"] and Y.file_map(s.limit(0)).count() == 0
    edges = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "m"), ("m", "m"), ("m", "z")], "src string, dst string")
    ranks = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("m", 0.5), ("z", 0.5)], "id string, rank double")
    assert {(r.id, r.side, r.other, r.place) for r in Y.context(edges, ranks, 1, 10).collect()} == {("m", "caller", "b", 1), ("m", "callee", "z", 1), ("a", "callee", "m", 1), ("b", "callee", "m", 1), ("z", "caller", "m", 1)}
    df = spark.createDataFrame([("python", "a/src/b%.py", "function", 3), ("go", None, None, None)], "language string, file_path string, chunk_type string, depth int")
    assert df.where(Y.search_filter()).count() == 2 and df.where(Y.search_filter("python", "b%", ["function"], 2, 3)).count() == 1 and df.where(Y.search_filter(path="b_")).count() == 0
    seq = spark.createDataFrame([(e, i, x) for e, xs in enumerate(["abc", "abd", "b"]) for i, x in enumerate(xs, 1)], "entity int, position int, item string")
    assert {(r.pattern, r.support) for r in Y.prefix_patterns(seq, 2).collect()} == {("a", 2), ("a>b", 2)}
    scores = spark.createDataFrame([("q", "m", 1, 0.9), ("q", "n", 2, 0.5), ("q", "m", 3, 0.1), ("r", "n", 4, 0.2)], "query string, model string, item int, score double")
    assert {(r.model, r.mean_rank, r.wins) for r in Y.pooled_ranks(scores).collect()} == {("m", 1.0, 1), ("n", 1.5, 1)}
