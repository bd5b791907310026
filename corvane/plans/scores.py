"""Queries of penalties, samples, decisions and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import scoring as S
from corvane.plans.registry import query
from corvane.session import table

_SYMBOLS = "sym as (select id, name, file_path as file, in_degree from (select min(id) as id, name, file_path, (len(name) % 3)::bigint as in_degree from chunks where name is not null and file_path is not null group by name, file_path))"


@query(f"""with {_SYMBOLS}, res as (select distinct id, name, file_path as file, len(content) / 100.0 as score from chunks where name is not null and file_path is not null),
    hit as (select r.id, r.file, r.name, r.score, s.in_degree, row_number() over (partition by r.id, r.file, r.name, r.score order by (s.file <> r.file)::int, s.id) as n from res r left join sym s using (name))
    select id, round(case when in_degree = 0 then score * 0.6 else score end, 6) as score from hit where n = 1""")
def dead_code_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name's length is a multiple of three stand for unused ones."""
    c = table(spark, d, "chunks").where("name is not null and file_path is not null")
    symbols = c.groupBy("name", "file_path").agg(F.min("id").alias("id")).select("id", "name", F.col("file_path").alias("file"), (F.length("name") % 3).cast("long").alias("in_degree"), F.lit(0.0).alias("rank"))
    results = c.select("id", "name", F.col("file_path").alias("file"), (F.length("content") / 100.0).alias("score")).distinct()
    return S.dead_code_penalty(results, symbols).select("id", F.round("score", 6).alias("score"))


@query("""select e.event_id, round(value * (1 + (user_id % 3) * 0.25) * case event_type when 'purchase' then 0.3 / 0.2 when 'click' then 0.1 / 0.2 else 1 end, 6) as score from events e where value is not null""")
def adaptive_rank(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where("value is not null")
    results = ev.select("event_id", F.col("event_type").alias("type"), F.col("user_id").alias("file"), F.col("value").alias("score"))
    boosts = ev.select(F.col("user_id").alias("file")).distinct().withColumn("boost", 1 + (F.col("file") % 3) * 0.25)
    weights = spark.createDataFrame([("purchase", 0.3, 0.2), ("click", 0.1, 0.2)], "type string, learned double, default double")
    return S.adaptive(results, boosts, weights).select("event_id", F.round("score", 6).alias("score"))


@query("""with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by n_chars, doc_id rows unbounded preceding) as used from documents where n_chars is not null)
    select source, doc_id from r where used <= 20000 * case source when 'issues' then 0.5 when 'readmes' then 0.25 when 'docs_pages' then 0.25 else 0 end""")
def context_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars is not null")
    kept = S.context_share(docs, "source", {"issues": 0.5, "readmes": 0.25, "docs_pages": 0.25}, 20_000, "n_chars", ["n_chars", "doc_id"])
    return kept.select("source", "doc_id")


@query("with r as (select doc_id, case when n_chars < 2000 then 0 when n_chars < 10000 then 1 else 2 end as band from documents) select doc_id, band, row_number() over (partition by band order by doc_id) as turn from r")
def interleaved_sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.interleaved(table(spark, d, "documents"), "doc_id", F.coalesce("n_chars", F.lit(1 << 40))).select("doc_id", "band", "turn")


@query("with s as (select o_orderpriority as g, count(*) as c from orders group by 1) select g, least(c, greatest(1, ceil(c * 200 / (select sum(c) from s)))::bigint) as n from s")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = S.stratified(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 200, 3)
    return rows.groupBy(F.col("o_orderpriority").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(table(spark, d, "customer"), "c_custkey", 100, 5).select("c_custkey")


@query("with n as (select distinct c_name from customer) select a.c_name as a, b.c_name as b, round(jaro_winkler_similarity(a.c_name, b.c_name), 6) as likeness from n a join n b on a.c_name < b.c_name and left(a.c_name, len(a.c_name) - 1) = left(b.c_name, len(b.c_name) - 1)")
def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in their last sign only."""
    n = table(spark, d, "customer").select("c_name").distinct().withColumn("k", F.expr("substring(c_name, 1, length(c_name) - 1)"))
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.c_name") < F.col("b.c_name")))
    return pairs.select(F.col("a.c_name").alias("a"), F.col("b.c_name").alias("b"), F.round(S.jaro_winkler_udf(F.col("a.c_name"), F.col("b.c_name")), 6).alias("likeness"))


@query("select event_type, count(*) as n, sum((props::json->>'k')::bigint)::bigint as k from events group by 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("""with m as (select l_suppkey as model, avg(l_discount) * 10 as a, case when l_suppkey % 4 = 0 then null else avg(l_tax) * 10 end as b, avg(l_quantity) / 50 as c from lineitem group by 1),
    o as (select model, (0.45 * a + 0.30 * coalesce(b, 0) + 0.25 * c) / (0.45 + case when b is null then 0 else 0.30 end + 0.25) as overall from m) select model, round(overall, 6) as overall, row_number() over (order by overall desc, model) as place from o""")
def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted over the parts that are known, then ranked."""
    from pyspark.sql import Window

    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg((F.avg("l_discount") * 10).alias("a"), (F.avg("l_tax") * 10).alias("b"), (F.avg("l_quantity") / 50).alias("c"))
    m = m.withColumn("b", F.when(F.col("model") % 4 != 0, F.col("b"))).withColumn("o", S.normalised_overall({"a": 0.45, "b": 0.30, "c": 0.25}))
    return m.select("model", F.round("o", 6).alias("overall"), F.row_number().over(Window.orderBy(F.desc("o"), "model")).alias("place"))


@query("""select case when tools = 0 then 'abandoned' when c > 0.5 * tools then 'failure' when c > 0 then 'partial' else 'success' end as outcome, count(*) as n
    from (select session_id, max(coalesce(tool_count, 0)) as tools, max(coalesce(intervention_count, 0)) as c from agent_sessions where session_id is not null group by 1) group by 1""")
def session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "agent_sessions").where("session_id is not null")
    a = a.groupBy("session_id").agg(F.max(F.coalesce("tool_count", F.lit(0))).alias("tools"), F.max(F.coalesce("intervention_count", F.lit(0))).alias("c"))
    return a.groupBy(S.outcome_of(F.col("tools"), F.col("c")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select l_suppkey as id, avg(l_quantity) / 50 as red, 1 - avg(l_discount) as blue, case when l_suppkey % 5 > 0 then 1 - avg(l_tax) / 2 end as pattern, max(l_quantity) / 50 as history, -min(l_tax) - (l_suppkey % 3) * 0.2 as worst from lineitem group by l_suppkey),
    s as (select *, 0.3 * red + 0.35 * blue + 0.2 * coalesce(pattern, 0) + 0.15 * history as score from m)
    select id, round(score, 6) as score, case when pattern is not null and not worst < -0.3 and score >= 0.9 then 'auto_deploy' when score >= 0.7 then 'human_review' else 'reject' end as decision from s""")
def safety_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for proposals."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        (F.avg("l_quantity") / 50).alias("red"), (1 - F.avg("l_discount")).alias("blue"), (1 - F.avg("l_tax") / 2).alias("pattern"), (F.max("l_quantity") / 50).alias("history"), (-F.min("l_tax")).alias("w"),
    )
    parts = {"red_team": F.col("red"), "blue_team": F.col("blue"), "pattern": F.when(F.col("id") % 5 > 0, F.col("pattern")), "history": F.col("history")}
    return m.select("id", S.safety_decision(parts, F.col("w") - (F.col("id") % 3) * 0.2).alias("d")).select("id", F.round("d.score", 6).alias("score"), "d.decision")


@query("""with t as (select lower(tool_name) as tool, avg((success)::int) filter (id % 2 = 0) as a, avg((success)::int) filter (id % 2 = 1) as b, count(*) as n from tool_events where tool_name is not null group by 1 having count(*) filter (id % 2 = 0) > 0 and count(*) filter (id % 2 = 1) > 0)
    select case when b < a - 0.02 then 'rollback' when false then 'graduate' when b > a + 0.02 or n < 40 then 'extend' else 'continue' end as decision, count(*) as n from t group by 1""")
def experiment_decisions(spark: SparkSession, d: str) -> DataFrame:
    even, ok = F.col("id") % 2 == 0, F.col("success").cast("int")
    t = table(spark, d, "tool_events").where("tool_name is not null").groupBy(F.lower("tool_name").alias("tool")).agg(F.avg(F.when(even, ok)).alias("a"), F.avg(F.when(~even, ok)).alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(even).alias("x"), F.count_if(~even).alias("y")).where("x > 0 and y > 0")
    decision = S.experiment_decision((F.col("b") > F.col("a") + 0.02).cast("int"), (F.col("b") < F.col("a") - 0.02).cast("int"), F.col("n"))
    return t.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_RULES = {"force": (r"(?i)--force|rm -rf", 0.6), "network": (r"(?i)https?://", 0.2), "shell": (r"(?i)\beval\b|\bexec\b", 0.5)}


@query(r"""select id, array_to_string(list_filter([case when regexp_matches(content, '(?i)--force|rm -rf') then 'force' end, case when regexp_matches(content, '(?i)https?://') then 'network' end, case when regexp_matches(content, '(?i)\beval\b|\bexec\b') then 'shell' end], lambda x: x is not null), ',') as hits,
    round(least(1.0, case when regexp_matches(content, '(?i)--force|rm -rf') then 0.6 else 0 end + case when regexp_matches(content, '(?i)https?://') then 0.2 else 0 end + case when regexp_matches(content, '(?i)\beval\b|\bexec\b') then 0.5 else 0 end), 6)::double as danger
    from (select distinct id, content from chunks) where regexp_matches(content, '(?i)--force|rm -rf|https?://|\beval\b|\bexec\b')""")
def safety_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = S.rule_hits(table(spark, d, "chunks").select("id", "content").distinct(), "content", _RULES).where("danger > 0")
    return rows.select("id", F.concat_ws(",", "hits").alias("hits"), F.round("danger", 6).alias("danger"))


@query("""with l as (select event_type as pattern, count(*) filter (user_id % 3 = 0) as c from events group by 1), p as (select event_type as pattern, user_id % 3 as peer, count(*) as c from events where user_id % 3 > 0 group by 1, 2), t as (select pattern, avg(c) as theirs from p where peer = 1 group by 1)
    select l.pattern, round(case when theirs is null then c else 0.8 * c + 0.2 * theirs end, 4) as count from l left join t using (pattern)""")
def federated_counts(spark: SparkSession, d: str) -> DataFrame:
    """One peer is trusted, one isn't."""
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("pattern"), (F.col("user_id") % 3).alias("peer")).agg(F.count(F.lit(1)).alias("count"))
    packets = c.where("peer > 0").withColumn("trust", F.when(F.col("peer") == 1, 0.9).otherwise(0.5))
    return S.federated(c.where("peer = 0").select("pattern", "count"), packets).select("pattern", F.round("count", 4).alias("count"))


@query("""select subject, count(*) as ratings, count(distinct rater) as raters, count(distinct doc_id) as docs from doc_labels group by 1""")
def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_labels").groupBy("subject").agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("rater").alias("raters"), F.countDistinct("doc_id").alias("docs"))


@query("""with q as (select distinct query_id, category, split_name, source from queries) select source, coalesce(split_name, 'none') as split_name, count(*) as n, count(category) as labelled, round(count(category) / count(*), 6) as share from q group by 1, 2""")
def query_summary(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").select("query_id", "category", "split_name", "source").distinct()
    return q.groupBy("source", F.coalesce("split_name", F.lit("none")).alias("split_name")).agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("labelled"), F.round(F.count("category") / F.count(F.lit(1)), 6).alias("share"))


@query("""select distinct id, round((case when greatest(x, 2) = 0 then 1 else least(x, 2) / greatest(x, 2) end + inter / (len(list_distinct(p)) + 2 - inter)) / 2, 6) as likeness from (select id, len(p) as x, len(list_intersect(list_distinct(p), ['payload', 'limit']))::double as inter, p from
    (select distinct id, list_filter([trim(regexp_extract(y, '(\\w+)', 1)) for y in string_split(regexp_extract(signature, '\\(([^)]*)\\)', 1), ',')], lambda z: z <> '') as p from chunks where signature is not null))""")
def signature_likenesses(spark: SparkSession, d: str) -> DataFrame:
    """All signatures held against one of two parameters; a name that comes twice counts twice as a parameter and once as a name."""
    c = table(spark, d, "chunks").where("signature is not null").select("id", "signature").distinct()
    return c.select("id", F.round(S.signature_likeness(F.col("signature"), F.lit("f(payload, limit)")), 6).alias("likeness")).distinct()


@query()
def instruction_criteria(spark: SparkSession, d: str) -> DataFrame:
    """How specific and instructive each manual is."""
    rows = table(spark, d, "documents").where("source in ('readmes', 'docs_pages') and text is not null")
    return rows.select("doc_id", S.criteria(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("""with h as (select l_orderkey, l_linenumber, l_suppkey, l_shipdate, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber, l_suppkey desc) as r from lineitem) select l_suppkey, count(*) as latest from h where r = 1 group by 1""")
def latest_line_supplier(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_shipdate", -F.col("l_linenumber"), F.col("l_suppkey"))).alias("l_suppkey"))
    return best.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("latest"))
