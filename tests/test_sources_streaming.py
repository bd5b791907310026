from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking as C
from corvane.sources import files as S
from corvane.streaming import events as T

T0 = datetime(2025, 1, 1)


def test_walk(spark, tmp_path):
    for name, data in (("src/a.py", b"x = 1\n"), ("node_modules/b.js", b"y"), ("img/c.png", b"\x89PNG"), ("src/d.bin2", b"a\x00b"), ("README.md", b"# T\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.size, r.language, r.binary) for r in S.walk(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": (6, "python", False), "img/c.png": (4, None, True), "src/d.bin2": (3, None, True), "README.md": (4, "markdown", False)}


def test_dependencies(spark):
    df = spark.createDataFrame([("p", '{"dependencies": {"a": "^1.2"}, "devDependencies": {"b": "2"}}'), ("broken", "{"), ("none", None)], "path string, content string")
    assert {tuple(r) for r in S.json_dependencies(df, "path", "content").collect()} == {("p", "a", "^1.2", False), ("p", "b", "2", True)}
    lines = spark.createDataFrame([("r", "# c\nnumpy>=1.2\nflask[x]==2.0 ; y\n-r z\nplain\n")], "path string, content string")
    assert {(r.name, r.version) for r in S.line_dependencies(lines, "path", "content", "requirements").collect()} == {("numpy", ">=1.2"), ("flask", "==2.0"), ("plain", None)}
    mod = spark.createDataFrame([("g", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n")], "path string, content string")
    assert [(r.name, r.version) for r in S.line_dependencies(mod, "path", "content", "gomod").collect()] == [("github.com/a/b", "v1.2.3")]
    cargo = spark.createDataFrame([("c", '[package]\nname = "z"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n')], "path string, content string")
    assert {(r.name, r.version) for r in S.line_dependencies(cargo, "path", "content", "cargo").collect()} == {("serde", "1.0"), ("tokio", "1.2")}


def test_listings(spark):
    text = spark.createDataFrame([("A\tx.py",), ("M\ty.py",), ("D\tz.py",), ("R100\told.py\tnew.py",), ("noise",)], "value string")
    assert {tuple(r) for r in S.name_status(text).collect()} == {("added", "x.py", None), ("modified", "y.py", None), ("deleted", "z.py", None), ("renamed", "new.py", "old.py")}
    short = spark.createDataFrame([("?? n.py",), (" M m.py",), ("D  d.py",), ("R  a.py -> b.py",), ("!! i",)], "value string")
    assert {tuple(r) for r in S.porcelain(short).collect()} == {("added", "n.py"), ("modified", "m.py"), ("deleted", "d.py"), ("renamed", "b.py")}
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\ndiff --git a/y b/y\ndiff --git a/x.py b/x.py\n"
    assert spark.createDataFrame([(patch,)], "p string").select(S.patch_files(F.col("p")).alias("f")).first().f == ["x.py", "y"]
    links = spark.createDataFrame([("u", "# T\n- [a](http://a)\n## Docs\n- [b](http://b): note\n")], "path string, content string")
    assert {(r.section, r.title, r.url, r.note) for r in S.llms_links(links, "path", "content").collect()} == {(None, "a", "http://a", None), ("Docs", "b", "http://b", "note")}


def test_evaluation_set_and_runs(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    corpus, queries, judged = S.evaluation_set(spark, str(tmp_path))
    assert corpus.first()._id == "d1" and queries.first().text == "x" and tuple(judged.first()) == ("q1", "d1", 1)
    assert S.run_lines(spark.createDataFrame([("q1", "d1", 1, 0.5)], "query string, doc string, rank int, score double"), "r").first().value == "q1 Q0 d1 1 0.500000 r"


def test_packing_formats(spark, tmp_path):
    df = spark.createDataFrame([("b.py", 'a < "b" & c'), ("a.md", "x\n````\ny")], "path string, content string")
    xml = {r.path: r.block for r in S.packed(df).collect()}
    assert xml["b.py"] == '<file path="b.py">\na &lt; &quot;b&quot; &amp; c\n</file>'
    md = {r.path: r.block for r in S.packed(df, "markdown").collect()}
    assert md["a.md"] == "## a.md\n\n`````markdown\nx\n````\ny\n`````" and md["b.py"].startswith("## b.py\n\n```python\n")
    S.write_packed(S.packed(df, "plain"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")).startswith("==== a.md ====\n")
    rows = S.tree(spark.createDataFrame([("z.py",), ("b/x.py",), ("b/c/y.py",)], "path string")).orderBy("sort_key").collect()
    assert [(r.folder, r.name) for r in rows] == [("", "b"), ("b", "c"), ("b/c", "y.py"), ("b", "x.py"), ("", "z.py")]


def test_chunking(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(65))), (2, ""), (3, None)], "k int, t string")
    got = {(r.id, r.part): (r.first, r.last) for r in C.line_parts(df, "k", "t").collect()}
    assert got == {(1, 1): (1, 30), (1, 2): (31, 65), (2, 1): (1, 1)}
    assert [(r.first, r.last) for r in C.line_blocks(df, "k", "t", 30, 100).orderBy("first").collect()] == [(1, 30), (31, 60)]
    md = spark.createDataFrame([(1, "pre\n# A\nx\n## B\n```\n# no\n```\n### C\n## D\n# E\n")], "k int, t string")
    got = [(r.section, r.level, r.title, r.parent, r.content) for r in C.heading_sections(md, "k", "t").orderBy("section").collect()]
    assert got == [(0, 0, "", None, "pre"), (1, 1, "A", None, "x"), (2, 2, "B", 1, "```\n# no\n```"), (3, 3, "C", 2, ""), (4, 2, "D", 1, ""), (5, 1, "E", None, "")]
    parts = spark.createDataFrame([(1, i, c * n) for i, (c, n) in enumerate([("a", 700), ("b", 700), ("c", 900), ("d", 100), ("e", 2600)])], "k int, o int, c string")
    assert [len(r.content) for r in C.packed_sections(parts, "k", "o", "c").orderBy("piece").collect()] == [1402, 1002, 2600]


def streamed(spark, tmp_path, rows, schema, parts=3):
    """The rows as a file stream, a file for each part, in order."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * step : (i + 1) * step]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def drained(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name).collect()


ROWS = [(i, f"u{i % 3}", T0 + timedelta(minutes=m), i % 4 == 0) for i, m in enumerate([0, 1, 2, 3, 30, 31, 33, 65, 66, 70, 200, 201, 202, 203, 600, 601, 602])]
SCHEMA = "id long, user string, ts timestamp_ntz, bad boolean"


def test_streams_equal_batches(spark, tmp_path):
    stream = streamed(spark, tmp_path, ROWS, SCHEMA)
    got = {(r.bucket, round(r.value, 6), r.samples) for r in drained(T.metric_windows(stream, "ts", F.col("bad").cast("int")), "metric")}
    by = {}
    for _, _, t, bad in ROWS[:-3]:
        by.setdefault(t.replace(minute=0), []).append(int(bad))
    assert got == {(t, round(sum(v) / len(v), 6), len(v)) for t, v in by.items()}


def test_session_windows(spark, tmp_path):
    got = {(r.user, r.started, r.events) for r in drained(T.gap_sessions(streamed(spark, tmp_path, ROWS, SCHEMA), "user", "ts"), "gaps")}
    want = set()
    for u in ("u0", "u1", "u2"):
        own = [t for _, x, t, _ in ROWS if x == u and t < T0 + timedelta(minutes=590)]
        run = []
        for t in own:
            if run and t - run[-1] > timedelta(minutes=10):
                want.add((u, run[0], len(run)))
                run = []
            run.append(t)
        want.add((u, run[0], len(run)))
    assert got == want


def test_stateful_operators(spark, tmp_path):
    rows = [(i, "a" if i < 8 else "b", T0 + timedelta(seconds=[0, 5, 10, 61, 62, 63, 64, 200, 0, 1][i]), False) for i in range(10)]
    allowed = {(r.entity, r.id): r.allowed for r in drained(T.rate_limited(streamed(spark, tmp_path / "r", rows, SCHEMA), "user", "ts", "id", 2, 60), "limited")}
    assert [allowed["a", i] for i in range(8)] == [True, True, False, True, True, False, False, True] and allowed["b", 8] and allowed["b", 9]
    got = drained(T.online_bandit(streamed(spark, tmp_path / "b", ROWS, SCHEMA), "user", "ts", "id", ~F.col("bad"), 0.9), "bandit", "update")
    last = {r.arm: (r.alpha, r.beta) for r in got}
    for u in ("u0", "u1", "u2"):
        a = b = 0.0
        for _, x, _, bad in ROWS:
            if x == u:
                a, b = a * 0.9 + (not bad), b * 0.9 + bad
        assert last[u] == pytest.approx((1 + a, 1 + b))


def test_tool_sessions_close_by_watermark(spark, tmp_path):
    rows = [(1, "a", T0, False), (2, "a", T0 + timedelta(minutes=5), True), (3, "b", T0 + timedelta(minutes=6), False), (4, "c", T0 + timedelta(hours=5), False), (5, "c", T0 + timedelta(hours=9), False)]
    out = drained(T.tool_sessions(streamed(spark, tmp_path, rows, SCHEMA, 5), "user", "ts", F.col("bad"), F.lit("point")), "tools")
    assert {(r.entity, r.events, r.failed, r.outcome) for r in out} >= {("a", 2, 1, "success"), ("b", 1, 0, "success")}


def test_batches_into_table(spark, tmp_path):
    seen = []
    q = T.into_table(streamed(spark, tmp_path, ROWS, SCHEMA), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == len(ROWS)
