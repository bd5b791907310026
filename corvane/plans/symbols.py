"""Queries on symbols, maps, filters, and the statistics of graphs, feedback, validation and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import token_estimate
from corvane.operators import events as E
from corvane.operators import retrieval as R
from corvane.operators import symbols as Y
from corvane.plans.graphs import _EDGES, edges, vertices
from corvane.plans.registry import query
from corvane.session import table

_DEGREE = "d as (select v.id, count(e.dst) / 1000.0 as rank from v left join edges e on e.dst = v.id or e.src = v.id group by 1)"


def _degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees stand for ranks."""
    e = edges(spark, d)
    ends = e.select(F.col("src").alias("id")).unionByName(e.where("src <> dst").select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return vertices(spark, d).select("id").join(ends, "id", "left").select("id", (F.coalesce("n", F.lit(0)) / 1000.0).alias("rank"))


@query(f"""with {_EDGES}, {_DEGREE}, s as (select dst as id, 'caller' as side, src as other from edges where src <> dst union all select src, 'callee', dst from edges where src <> dst),
    p as (select s.*, row_number() over (partition by s.id, side order by rank desc, other) as place from s join d on d.id = s.other)
    select id, side, other, place from p where place <= case side when 'caller' then 5 else 10 end""")
def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    return Y.context(edges(spark, d), _degree(spark, d))


@query(f"with {_EDGES}, {_DEGREE} select dst as id, rank from edges join d on d.id = dst where src = 'c1'")
def callees_of(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("src = 'c1'").select(F.col("dst").alias("id")).join(_degree(spark, d), "id").select("id", F.col("rank").cast("double").alias("rank"))


_SYMBOLS = """sym as (select id, min(file_path) as file, min(name) as name, min(signature) as signature, (len(min(content)) % 97 + 1) / 1000.0::double as rank, ceil(len(min(name)) / 4.0)::bigint + 2 as tokens
    from chunks where id is not null and file_path is not null and name is not null and content is not null group by id)"""


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with names; a number that depends on the length stands for the rank."""
    c = table(spark, d, "chunks").where("id is not null and file_path is not null and name is not null and content is not null")
    one = c.groupBy("id").agg(F.min("file_path").alias("file"), F.min("name").alias("name"), F.min("signature").alias("signature"), F.min("content").alias("content"))
    return one.select("id", "file", "name", "signature", ((F.length("content") % 97 + 1) / F.lit(1000.0)).alias("rank"), (token_estimate(F.col("name")) + 2).alias("tokens"))


@query(f"""with recursive {_SYMBOLS}, best as (select * from sym order by rank desc, id limit 5000), p as (select *, row_number() over (partition by file order by rank desc, id) as n from best),
    f as (select file, round(sum(rank), 9) as importance, count(*) as symbols, sum(case when n <= 20 then tokens else 0 end)::bigint as tokens from p group by 1),
    o as (select *, ceil(len(file || ': (' || symbols || ' symbols)') / 4.0)::bigint as head, row_number() over (order by importance desc, file) as place from f),
    walk(place, used, shown) as (select 0::bigint, 0::bigint, '' union all select o.place, w.used + case when w.used + o.tokens <= 2000 then o.tokens when w.used + o.head < 2000 then o.head else 0 end,
        case when w.used + o.tokens <= 2000 then 'whole' when w.used + o.head < 2000 then 'header' else 'none' end from walk w join o on o.place = w.place + 1)
    select file, round(importance, 6) as importance, symbols, place, shown from walk join o using (place)""")
def repo_map(spark: SparkSession, d: str) -> DataFrame:
    return Y.file_map(_symbols(spark, d).withColumn("rank", F.col("rank").cast("decimal(20,9)"))).select("file", F.round(F.col("importance").cast("double"), 6).alias("importance"), "symbols", F.col("place").cast("long").alias("place"), "shown")


_POINTS = " + ".join(f"case when contains(lower({c}), '{w}') then {n} else 0 end" for w in ("ledger", "token", "router") for c, n in (("name", 10), ("coalesce(signature, '')", 5), ("file", 3)))


@query(f"with {_SYMBOLS} select id, round(({_POINTS}) * (1 + 100 * rank), 6) as relevance from sym where ({_POINTS}) > 0 order by ({_POINTS}) * (1 + 100 * rank) desc, id limit 50")
def question_symbols(spark: SparkSession, d: str) -> DataFrame:
    return Y.question_map(_symbols(spark, d), "of ledger token router").select("id", F.round("relevance", 6).alias("relevance"))


_USABLE = "len(vector) = 64 and len([v for v in vector if v is null or isnan(v) or isinf(v)]) = 0 and len([v for v in vector if v <> 0]) > 0"


def _units(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    usable = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    c = table(spark, d, "chunks").where(F.col("id").isNotNull() & usable).withColumn("depth", F.size(F.split("file_path", "/")))
    return c.groupBy("id").agg(*[F.min(x).alias(x) for x in ("language", "file_path", "chunk_type", "depth", "vector")])


@query(f"""with u as (select id, min(language) as language, min(file_path) as file_path, min(chunk_type) as chunk_type, min(len(string_split(file_path, '/'))) as depth, min(vector) as vector from chunks where id is not null and {_USABLE} group by id),
    q as (select embedding from embeddings where vec_id = 0), s as (select id, list_cosine_similarity(u.vector::double[], q.embedding::double[]) as score from u, q
    where language = 'python' and contains(file_path, 'src') and chunk_type in ('function', 'class') and depth between 2 and 5)
    select id, round(score, 6) as score from s order by s.score desc, id limit 20""")
def unit_search(spark: SparkSession, d: str) -> DataFrame:
    """Code units by vector: twice as many as asked for are fetched under the filters, and the best stay."""
    q = list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])
    rows = _units(spark, d).where(Y.search_filter("python", "src", ["function", "class"], 2, 5))
    return R.vector_topk(rows, q, 40).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"""with files as (select distinct split_part(file_path, '/', 1) as sha, content_hash from chunks where file_path is not null and content_hash is not null),
    c as (select content_hash, min(vector) as vector, min(language) as language from chunks where content_hash is not null and {_USABLE} group by 1), notes as (select content_hash, min(name) as note from chunks where name is not null group by 1),
    q as (select embedding from embeddings where vec_id = 0), best as (select sha, content_hash, list_cosine_similarity(vector::double[], embedding::double[]) as score from files join c using (content_hash), q where language = 'go')
    select sha, content_hash, round(score, 6) as score, note from best left join notes using (content_hash) qualify row_number() over (partition by sha order by best.score desc, content_hash) <= 10""")
def commit_search(spark: SparkSession, d: str) -> DataFrame:
    """Repositories stand for commits: the distinct hashes of each, with their vectors and, where there is one, a note."""
    q = list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])
    all_chunks = table(spark, d, "chunks").where("content_hash is not null")
    files = all_chunks.where("file_path is not null").select(F.substring_index("file_path", "/", 1).alias("sha"), "content_hash").distinct()
    v = F.col("vector")
    usable = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    c = all_chunks.where(usable).groupBy("content_hash").agg(F.min("vector").alias("vector"), F.min("language").alias("language")).where(Y.search_filter("go", columns=("language",) * 4))
    scored = c.select("content_hash", R.cosine(F.col("vector"), R.literal_vector(q)).alias("score"))
    notes = all_chunks.where("name is not null").groupBy("content_hash").agg(F.min("name").alias("note"))
    best = Y.top_per_group(files.join(scored, "content_hash"), "sha", [F.desc("score"), F.col("content_hash")], 10)
    return best.join(notes, "content_hash", "left").select("sha", "content_hash", F.round("score", 6).alias("score"), "note")


@query("""with refs as (select 'c' || o.o_custkey as src, 's' || l.l_suppkey as dst, l.l_returnflag as kind from lineitem l join orders o on o.o_orderkey = l.l_orderkey)
    select kind, count(*) as n, count(*) filter (where dst in (select 's' || s_suppkey from supplier where s_acctbal > 0)) as resolved from refs group by 1""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """References by kind, and those whose target is known."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("known"))
    joined = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(known, "l_suppkey", "left")
    return joined.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("resolved"))


@query("select coalesce(max(len(string_split(file_path, '/'))), 0)::bigint as deepest, count(distinct file_path) as files from chunks")
def unit_depth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").agg(F.coalesce(F.max(F.size(F.split("file_path", "/"))), F.lit(0)).cast("long").alias("deepest"), F.countDistinct("file_path").alias("files"))


@query("select tool_input_hash as target, count(*) as events, count(*) filter (where success = false) as corrections, round(count(*) filter (where success = false) / count(*), 6) as gap from (select distinct on (id) * from tool_events order by id, ingested_at) where tool_input_hash is not null group by 1 having count(*) filter (where success = false) > 0")
def correction_gap(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of tools stand for files; those with a failure at least."""
    ev = table(spark, d, "tool_events").groupBy("id").agg(F.min(F.struct("ingested_at", "tool_input_hash", "success")).alias("r")).select("r.*").where("tool_input_hash is not null")
    per = ev.groupBy(F.col("tool_input_hash").alias("target")).agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("success")).alias("corrections")).where("corrections > 0")
    return per.select("*", F.round(F.col("corrections") / F.col("events"), 6).alias("gap"))


@query("""with s as (select distinct session_id, outcome, duration_ms, tool_count, intervention_count, autonomous_count from agent_sessions where session_id is not null)
    select coalesce(outcome, 'unknown') as outcome, count(*) as sessions, count(*) filter (where intervention_count = 0) as untouched, round(avg(duration_ms), 4) as mean_ms,
    round(avg(case when tool_count > 0 then intervention_count / tool_count end), 6) as correction_rate, round(avg(case when tool_count > 0 then autonomous_count / tool_count end), 6) as autonomy_rate from s group by 1""")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "agent_sessions").where("session_id is not null").select("session_id", "outcome", "duration_ms", "tool_count", "intervention_count", "autonomous_count").distinct()
    rate = lambda c: F.round(F.avg(F.when(F.col("tool_count") > 0, F.col(c) / F.col("tool_count"))), 6)
    return s.groupBy(F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("intervention_count") == 0).alias("untouched"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), rate("intervention_count").alias("correction_rate"), rate("autonomous_count").alias("autonomy_rate"),
    )


@query("""with s as (select distinct session_id, split_part(project_path, '/', -1) as scenario, hash_group, duration_ms from (select *, case when ascii(right(session_id, 1)) % 2 = 0 then 'treatment' else 'baseline' end as hash_group from agent_sessions where session_id is not null))
    select hash_group as arm, coalesce(scenario, 'all') as scenario, count(*) as n, round(avg(duration_ms), 4) as mean_ms from s group by grouping sets ((hash_group), (hash_group, scenario))""")
def arm_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Per arm, and nested by scenario, in one pass."""
    s = table(spark, d, "agent_sessions").where("session_id is not null")
    s = s.select("session_id", F.element_at(F.split("project_path", "/"), -1).alias("scenario"), F.when(F.ascii(F.substring("session_id", -1, 1)) % 2 == 0, "treatment").otherwise("baseline").alias("arm"), "duration_ms").distinct()
    sets = s.groupingSets([["arm"], ["arm", "scenario"]], "arm", "scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))
    return sets.select("arm", F.coalesce("scenario", F.lit("all")).alias("scenario"), "n", "mean_ms")


@query(r"""with q as (select distinct query_id, category, query, split_name, source from queries where query is not null) select source, count(*) as n, count(distinct lower(query)) as different, count(split_name) as in_splits, count(distinct category) as categories from q group by 1""")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").where("query is not null").select("query_id", "category", "query", "split_name", "source").distinct()
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("query")).alias("different"), F.count("split_name").alias("in_splits"), F.countDistinct("category").alias("categories"))


@query("""with s as (select o_orderdate::date as query, l_suppkey as model, l_orderkey * 10 + l_linenumber as item, l_extendedprice as score from lineitem join orders on l_orderkey = o_orderkey),
    p as (select *, row_number() over (partition by query order by score desc, model, item) as place from s), b as (select query, model, min(place) as best from p group by 1, 2), a as (select *, row_number() over (partition by query order by best) as among from b)
    select model, count(*) as queries, round(avg(best), 6) as mean_rank, count(*) filter (where among = 1) as wins from a group by 1""")
def pooled_competition(spark: SparkSession, d: str) -> DataFrame:
    """Days stand for queries, suppliers for models."""
    s = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = s.select(F.to_date("o_orderdate").alias("query"), F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_extendedprice").alias("score"))
    return Y.pooled_ranks(s).select("model", "queries", F.round("mean_rank", 6).alias("mean_rank"), "wins")


@query("""with e as (select session_id, lower(tool_name) as item, row_number() over (partition by session_id order by execution_order nulls first, id) as position from (select distinct id, session_id, execution_order, tool_name from tool_events where session_id is not null and tool_name is not null)),
    h as (select session_id, array_to_string(list(item order by position), '>') as pattern, n as length from e, (select unnest(range(1, 6)) as n) where position <= n group by 1, n having count(*) = n)
    select pattern, length, count(*) as support from h group by 1, 2 having count(*) >= 5""")
def session_openings(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of sessions, of up to five tools, that five sessions share."""
    ev = table(spark, d, "tool_events").where("session_id is not null and tool_name is not null").select("id", "session_id", "execution_order", "tool_name").distinct()
    placed = E.positions(ev, "session_id", ["execution_order", "id"]).select(F.col("session_id").alias("entity"), F.col("_cv_i").alias("position"), F.lower("tool_name").alias("item"))
    return Y.prefix_patterns(placed, 5).withColumn("length", F.col("length").cast("long"))


@query("""select coalesce(lang, 'none') as lang, count(distinct doc_id) as documents, count(distinct repo) as libraries, min(created_at) as first, max(created_at) as last, sum(ceil(coalesce(len(text), 0) / 4.0))::bigint as tokens from documents group by 1""")
def indexed_docs_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("repo").alias("libraries"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.sum(F.coalesce(token_estimate(F.col("text")), F.lit(0))).alias("tokens"))
