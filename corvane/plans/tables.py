"""Queries of the relational families: scans, merges, change sets, aggregates over sessions, files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import document_class, duration_band, error_category, glob_match, is_excluded, token_estimate, xml_escape
from corvane.operators import events as E
from corvane.operators import incremental as I
from corvane.plans.registry import query
from corvane.session import table


@query("select count(*) as n, count(distinct id) as ids, count(distinct file_path) as files, count(distinct content_hash) as hashes, count(distinct lower(language)) as languages, max(created_at) as latest from chunks")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("file_path").alias("files"), F.countDistinct("content_hash").alias("hashes"), F.countDistinct(F.lower("language")).alias("languages"), F.max("created_at").alias("latest"))


@query("select coalesce(nullif(chunk_type, ''), 'code_chunk') as kind, count(*) as n from chunks group by 1")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy(F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("code_chunk")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select lower(tool_name) as tool, count(*) as n from tool_events where tool_name is not null group by 1 qualify row_number() over (order by count(*) desc, lower(tool_name)) <= 20")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = E.usage(table(spark, d, "tool_events").where("tool_name is not null").select(F.lower("tool_name").alias("tool")), "tool")
    return rows.orderBy(F.desc("n"), "tool").limit(20)


@query("select lower(tool_name) as tool, count(*) as total, count(*) filter (success = false) as errors, round(count(*) filter (success = false) / count(*), 6) as rate from tool_events where tool_name is not null group by 1 having count(*) > 5")
def tool_error_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_events").where("tool_name is not null").select(F.lower("tool_name").alias("tool"), "success")
    return E.error_rates(rows, "tool", F.coalesce(~F.col("success"), F.lit(False))).withColumn("rate", F.round("rate", 6))


@query("""with s as (select distinct * from agent_sessions) select count(*) as sessions, round(avg(intervention_count / nullif(tool_count, 0)), 6) as interventions, round(avg(duration_ms) filter (tool_count > 0), 6) as duration,
    sum(autonomous_count)::bigint as autonomous from s""")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "agent_sessions").distinct()
    return s.agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg(F.col("intervention_count") / F.nullif("tool_count", F.lit(0))), 6).alias("interventions"),
        F.round(F.avg(F.when(F.col("tool_count") > 0, F.col("duration_ms"))), 6).alias("duration"), F.sum("autonomous_count").alias("autonomous"),
    )


@query("""select o.outcome, count(s.session_id) as n from (select unnest(['success', 'partial', 'failure', 'abandoned', 'unknown']) as outcome) o left join (select distinct session_id, coalesce(outcome, 'unknown') as outcome from agent_sessions) s using (outcome) group by 1""")
def outcome_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of a fixed list, with 0 for those that didn't occur."""
    names = spark.createDataFrame([(x,) for x in ("success", "partial", "failure", "abandoned", "unknown")], "outcome string")
    rows = table(spark, d, "agent_sessions").select("session_id", F.coalesce("outcome", F.lit("unknown")).alias("outcome")).distinct()
    return names.join(rows, "outcome", "left").groupBy("outcome").agg(F.count("session_id").alias("n"))


@query("""select session_id, count(*) as tools, round(count(*) filter (success = false) / count(*), 6) as error_rate, round(avg(duration_ms), 6) as mean_ms, count(distinct tool_name) as kinds
    from (select distinct on (id) * from tool_events where session_id is not null order by id, ingested_at) group by 1""")
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_events").where("session_id is not null").groupBy("id").agg(F.min(F.struct("ingested_at", "session_id", "success", "duration_ms", "tool_name")).alias("r")).select("r.*")
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tools"), F.round(F.count_if(~F.col("success")) / F.count(F.lit(1)), 6).alias("error_rate"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.countDistinct("tool_name").alias("kinds"),
    )


@query("""with ev as (select session_id, count(*) as events from (select distinct id, session_id from tool_events where session_id is not null) group by 1), s as (select session_id, max(tool_count) as tool_count from agent_sessions group by 1)
    select case when s.session_id is null then 'missing' when ev.session_id is null then 'idle' when s.tool_count = ev.events then 'equal' else 'off' end as state, count(*) as n from ev full outer join s using (session_id) group by 1""")
def session_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "tool_events").where("session_id is not null").select("id", "session_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))
    s = table(spark, d, "agent_sessions").groupBy("session_id").agg(F.max("tool_count").alias("tool_count"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "missing").when(F.col("events").isNull(), "idle").when(F.col("tool_count") == F.col("events"), "equal").otherwise("off")
    return ev.join(s, "session_id", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when duration_ms is null then 'unknown' when duration_ms < 100 then 'instant' when duration_ms < 1000 then 'fast' when duration_ms < 10000 then 'medium' when duration_ms < 60000 then 'slow' else 'very_slow' end as band, count(*) as n from tool_events group by 1")
def duration_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_events").groupBy(duration_band(F.col("duration_ms")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select case when regexp_matches(lower(error_type), 'time(d )?-?out|deadline') then 'timeout' when regexp_matches(lower(error_type), 'permission|denied|forbidden|unauthori[sz]ed|eacces') then 'permission' when regexp_matches(lower(error_type), 'not found|no such|enoent|missing|404') then 'not_found'
    when regexp_matches(lower(error_type), 'syntax|parse|unexpected token') then 'syntax' when regexp_matches(lower(error_type), 'type ?error|not assignable|cannot convert') then 'type' when regexp_matches(lower(error_type), 'network|econn|socket|dns|unreachable') then 'network'
    when regexp_matches(lower(error_type), 'invalid|validation|required|schema') then 'validation' else 'unknown' end as category, count(*) as n from tool_events where success = false group by 1""")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_events").where("not success").groupBy(error_category(F.col("error_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("select source, sum(ceil(len(text) / 4.0))::bigint as tokens, count(*) as files from documents where text is not null group by 1")
def token_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return rows.groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("files"))


@query("select id, start_line + (i - 1) as line, trim(l, chr(13)) as text from (select id, start_line, unnest(string_split(content, chr(10))) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from (select distinct id, start_line, content from chunks where content is not null)) where regexp_matches(l, '(?i)todo|fixme')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("content is not null and content rlike '(?i)todo|fixme'").select("id", "start_line", "content").distinct()
    lines = rows.select("id", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "l")).where("l rlike '(?i)todo|fixme'")
    return lines.select("id", (F.col("start_line") + F.col("i")).cast("long").alias("line"), F.expr("trim(both '\r' from l)").alias("text"))


@query("select file_path, start_line + (i - 1) as line, l as text from (select file_path, start_line, unnest(string_split(content, chr(10))) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from (select distinct file_path, start_line, content from chunks where file_path is not null)) where start_line + (i - 1) between 10 and 12")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 10 to 12 of every file."""
    rows = table(spark, d, "chunks").where("file_path is not null and start_line <= 12").select("file_path", "start_line", "content").distinct()
    lines = rows.select("file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.select("file_path", (F.col("start_line") + F.col("i")).cast("long").alias("line"), "text").where("line between 10 and 12")


@query("select event_id, event_type, user_id from events where event_id > 900 order by event_id limit 50")
def activity_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id > 900").orderBy("event_id").limit(50).select("event_id", "event_type", "user_id")


@query("select id, max(created_at) as created_at, count(*) as versions from chunks group by 1 having count(*) > 1")
def repeated_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("versions")).where("versions > 1")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last row per user: early events are what is stored, later ones what comes in."""
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("version"), "event_id", "event_type", "value")
    stored, fresh = rows.where("version.ts < timestamp_ntz'2024-01-15'"), rows.where("version.ts >= timestamp_ntz'2024-01-15'")
    return I.upsert(stored, fresh, ["user_id"], "version").select("user_id", "event_id", "event_type", "value")


@query("select event_type, user_id % 10 as slot, count(*)::bigint as occurrences, max(ts) as seen from events group by 1, 2")
def accumulated_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("slot", F.col("user_id") % 10)
    count = lambda x: x.groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("seen"))
    return I.accumulate(count(rows.where("event_id % 2 = 0")), count(rows.where("event_id % 2 = 1")), ["event_type", "slot"], "occurrences", "seen")


@query("select o_orderkey, o_totalprice from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def keyed_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return I.without_keys(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def keep_last_per_user(spark: SparkSession, d: str) -> DataFrame:
    return I.keep_last(table(spark, d, "events"), 3, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query("select event_type, count(*) as n from events where ts >= (select max(ts) from events) - interval 7 day group by 1")
def retention_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    latest = rows.agg(F.max("ts")).first()[0]
    return I.recent(rows, "ts", F.lit(latest), 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, s_name, case when s_suppkey % 5 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier")
def patched_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    new = s.where("s_suppkey % 5 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(None).cast("string").alias("s_name"))
    return I.patched(s, new, "s_suppkey", ["s_acctbal", "s_name"]).select("s_suppkey", "s_name", "s_acctbal")


@query("""with a as (select o_custkey as k, sum(o_totalprice::decimal(18,2)) as v from orders where o_orderdate < '1999-01-01' group by 1), b as (select o_custkey as k, sum(o_totalprice::decimal(18,2)) as v from orders where o_orderdate >= '1997-01-01' group by 1)
    select case when a.k is null then 'new' when b.k is null then 'deleted' when a.v is not distinct from b.v then 'unchanged' else 'modified' end as change, count(*) as n from a full outer join b on a.k = b.k group by 1""")
def change_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    part = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("p").alias("v"))
    changes = I.change_set(part("o_orderdate < timestamp_ntz'1999-01-01'"), part("o_orderdate >= timestamp_ntz'1997-01-01'"), "k", "v")
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""with cached as (select content_hash, min(len(vector)) as dims from chunks where vector is not null and chunk_type = 'function' group by 1)
    select cached.content_hash is not null as reused, count(*) as n from (select distinct id, content_hash from chunks) c left join cached using (content_hash) group by 1""")
def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of functions are at hand: which chunks need none anew."""
    c = table(spark, d, "chunks")
    cached = c.where("vector is not null and chunk_type = 'function'").select("content_hash", F.size("vector").alias("dims"))
    rows = I.reuse(c.select("id", "content_hash").distinct(), cached, ["content_hash"], "dims")
    return rows.groupBy(F.col("dims").isNotNull().alias("reused")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct content_hash from chunks where split_part(file_path, '/', 1) = 'quarry-mono' and content_hash not in (select content_hash from chunks where split_part(file_path, '/', 1) <> 'quarry-mono' and content_hash is not null)")
def missing_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("content_hash is not null").select("content_hash", (F.substring_index("file_path", "/", 1) == "quarry-mono").alias("here"))
    return I.missing(c.where("here"), c.where("not here"), "content_hash")


@query("""with o as (select o_custkey as path, year(o_orderdate) as y, max(o_orderkey) as h from orders group by 1, 2), child as (select path, h from o where y = 2000), gone as (select distinct path from o where y = 1995),
    inherited as (select path, arg_min(h, 2000 - y) as h from o where y in (1999, 1998) and path not in (select path from child) and path not in (select path from gone) group by path)
    select * from child union all select * from inherited""")
def commit_inheritance(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path"), F.year("o_orderdate").alias("y")).agg(F.max("o_orderkey").alias("h"))
    child, gone = o.where("y = 2000").select("path", "h"), o.where("y = 1995").select("path")
    parents = o.where("y in (1999, 1998)").select("path", "h", (2000 - F.col("y")).alias("parent_no"))
    return I.inherit(child, parents, gone)


@query("select c.c_mktsegment, n.n_name, r.r_name, count(*) as customers from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2, 3")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("c_mktsegment", "n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("""with f as (select split_part(file_path, '/', 1) as repo, file_path, list(distinct content_hash) as hashes from chunks where file_path is not null group by 1, 2)
    select repo, count(distinct file_path) as files, count(distinct h) as hashes from (select repo, file_path, unnest(hashes) as h from f) group by 1""")
def commit_status(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "chunks").where("file_path is not null").groupBy(F.substring_index("file_path", "/", 1).alias("repo"), "file_path").agg(F.collect_set("content_hash").alias("hashes"))
    return f.select("repo", "file_path", F.explode("hashes").alias("h")).groupBy("repo").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("h").alias("hashes"))


@query("select user_id % 20 as key, event_type as endpoint, count(*) as uses from events group by 1, 2")
def key_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("key"), F.col("event_type").alias("endpoint")).agg(F.count(F.lit(1)).alias("uses"))


@query(r"""select distinct file_path from chunks where regexp_matches(file_path, '(?i)^[^/]*/src/.*\.py$') and not list_has_any(string_split(file_path, '/'), ['node_modules', '.git', '.svn', '.hg', 'dist', 'build', 'out', 'target', '.next', '.nuxt', '.cache', 'coverage', '__pycache__', '.venv', 'venv', 'vendor', '.idea', '.vscode', '.turbo', '.output', 'bower_components'])""")
def walked_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "chunks").select("file_path").distinct()
    return f.where(glob_match(F.col("file_path"), "*/src/**.py") & ~is_excluded(F.col("file_path")))


@query(r"""select source, class, count(*) as n from (select source, case when (regexp_matches(l, '\bfunction\b|\bdef \w'))::int + (regexp_matches(l, '\breturns?\b'))::int + (regexp_matches(l, '\bparam(eter)?s?\b'))::int + (regexp_matches(l, '\bmethod\b'))::int + (regexp_matches(l, '\bclass \w'))::int + (regexp_matches(l, '=>|->'))::int + (regexp_matches(l, '\w+\([^)]*\)'))::int >= 3 then 'api_reference'
    when (regexp_matches(l, '\bbest practice'))::int + (regexp_matches(l, '\brecommend'))::int + (regexp_matches(l, '\bshould\b'))::int + (regexp_matches(l, '\bavoid\b'))::int + (regexp_matches(l, '\bprefer\b'))::int + (regexp_matches(l, '\bpattern\b'))::int + (regexp_matches(l, '\bmust\b'))::int >= 2 then 'best_practice' else 'framework_doc' end as class
    from (select source, lower(text) as l from documents where text is not null)) group by 1, 2""")
def document_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("source", document_class(F.col("text")).alias("class"))
    return rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, length(x) as signs, sha256(x) as digest from (select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as x from documents where contains(text, '<'))")
def xml_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with markup, escaped, by length and digest."""
    rows = table(spark, d, "documents").where(F.col("text").contains("<")).select("doc_id", xml_escape(F.col("text")).alias("x"))
    return rows.select("doc_id", F.length("x").cast("long").alias("signs"), F.sha2("x", 256).alias("digest"))


@query("""select lang_key, count(*) as n, min(doc_id) as first from (select doc_id, coalesce(lower(lang), 'unknown') as lang_key from documents) group by 1""")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("unknown")).alias("lang_key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as discount from lineitem where l_shipdate <= '1998-09-02' group by 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"),
    )


@query("""select query_id from queries where split_name is null union select query_id from queries where category is null""")
def incomplete_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.where("split_name is null").select("query_id").union(q.where("category is null").select("query_id")).distinct()


@query("select count(*) as rows_, count(distinct content_hash) as hashes, count(*) - count(distinct id) as repeats from chunks where split_part(file_path, '/', 1) = 'quarry-mono'")
def hot_repository(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(F.substring_index("file_path", "/", 1) == "quarry-mono")
    return c.agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("content_hash").alias("hashes"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeats"))
