"""Queries pN_... and, where it can be said, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.credentials import find_credentials, redacted
from corvane.llm.mixing import mix, share_report
from corvane.llm.neighbours import nearest_neighbours, neighbour_pairs
from corvane.llm.overlaps import overlap_report, split_overlaps
from corvane.llm.packing import fill_report, pack
from corvane.llm.provenance import provenance
from corvane.llm.runs import collapse_runs
from corvane.llm.splitting import split_oversized, unit_starts
from corvane.llm.subjects import assign_subjects, subject_shares
from corvane.llm.subsequences import frequent_subsequences
from corvane.session import table


#: A container of the queries takes one document for so many tokens of its capacity.
TOKENS_A_DOCUMENT = 16


def limit(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A value of the table of limits, which has one row for each name."""
    return int(table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).agg(F.max("amount")).first()[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(table(spark, sf_dir, "chunks")).select("id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_subsequences(table(spark, sf_dir, "tool_events")).select("pattern")


def p2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_subsequences(table(spark, sf_dir, "tool_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest_neighbours(table(spark, sf_dir, "chunks")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlaps(table(spark, sf_dir, "queries"))
    return pairs.select(F.least("train_id", "eval_id").alias("query_id_a"), F.greatest("train_id", "eval_id").alias("query_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "queries"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(table(spark, sf_dir, "chunks")).select(F.col("path").alias("file_path"))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(table(spark, sf_dir, "chunks")).groupBy("reason", "rule").agg(F.count(F.lit(1)).alias("files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_starts(table(spark, sf_dir, "chunks"), limit(spark, sf_dir, "chunk_max"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), limit(spark, sf_dir, "chunk_max"), limit(spark, sf_dir, "chunk_overlap"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(table(spark, sf_dir, "tool_events"))
    return runs.where("n_events >= 2").select(F.col("session").alias("session_id"), "first_id", "last_id")


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(table(spark, sf_dir, "tool_events"))
    return runs.select(F.col("session").alias("session_id"), F.col("name").alias("tool"), "first_id", "last_id", "n_events", "duration_us")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = limit(spark, sf_dir, "container_capacity")
    return pack(table(spark, sf_dir, "documents"), capacity, max_docs=capacity // TOKENS_A_DOCUMENT)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = limit(spark, sf_dir, "container_capacity")
    return fill_report(p8_containers(spark, sf_dir), capacity)


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, containers over a capacity, documents cut though they fit, and documents of which a token is missing or twice."""
    capacity = limit(spark, sf_dir, "container_capacity")
    packed = p8_containers(spark, sf_dir)
    full = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).agg(F.count(F.when((F.col("t") > capacity) | (F.col("n") > capacity // TOKENS_A_DOCUMENT), 1)).alias("over_capacity"))
    each = packed.groupBy("doc").agg(F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.countDistinct("piece").alias("n"), F.count(F.lit(1)).alias("rows"))
    cut, odd = F.count(F.when((F.col("t") <= capacity) & (F.col("n") > 1), 1)), F.count(F.when((F.col("t") != F.col("end")) | (F.col("n") != F.col("rows")), 1))
    return each.agg(F.count(F.lit(1)).alias("documents"), cut.alias("cut_needlessly"), odd.alias("not_whole")).join(F.broadcast(full))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized chunk: the lines its pieces reach from and to, the characters they hold at least once, and pieces over the limit."""
    most = limit(spark, sf_dir, "chunk_max")
    pieces = p6_pieces(spark, sf_dir)
    return pieces.groupBy("id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count(F.when(F.length("content") > most, 1)).alias("over_limit"))


def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with credentials whose lines, or whose text before the first and behind the last value, differ after redaction; ids given back twice."""
    chunks = table(spark, sf_dir, "chunks").where("id is not null and content is not null").groupBy("id").agg(F.min("content").alias("before"))
    both = chunks.join(p1_redacted(spark, sf_dir), "id")
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    return both.agg(F.count(F.when(lines("before") != lines("content"), 1)).alias("lines_changed"), F.count(F.when(F.col("before") == F.col("content"), 1)).alias("unchanged"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("twice"))


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the mix: its target, its cap, its documents, and records used more than the cap or under a source they don't have."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    used = mix(docs, targets).groupBy("doc", "source").agg(F.max("copy").alias("copies"), F.count(F.lit(1)).alias("rows"))
    own = docs.where("doc_id is not null and text is not null and source is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min("source").alias("own"))
    caps = F.broadcast(targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    each = own.join(used, "doc", "full").withColumn("source", F.coalesce("own", "source")).join(caps, "source", "right")
    wrong = (F.col("copies") > F.col("max_repeats")) | (F.col("copies") != F.col("rows")) | (F.col("rows").isNotNull() & F.col("own").isNull())
    return each.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.count("own").alias("documents"), F.count(F.when(wrong, 1)).alias("wrong"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, labels = table(spark, sf_dir, "subjects"), table(spark, sf_dir, "doc_labels")
    return assign_subjects(table(spark, sf_dir, "documents"), subjects=subjects, labels=labels).select(F.col("doc").alias("doc_id"), "subject")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_shares(table(spark, sf_dir, "documents"), subjects=table(spark, sf_dir, "subjects"), labels=table(spark, sf_dir, "doc_labels"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_redacted, p2_found, p2_patterns, p3_found, p4_found, p4_report, p5_found, p5_reasons, p6_found, p6_pieces, p7_found, p7_collapsed,
    p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_shares, p1_whole, p6_whole, p8_whole, p9_whole,
)}

_EVENTS = """
    select id, session_id, execution_order, tool, us from (
        select id, session_id, execution_order, nullif(regexp_replace(lower(tool_name), '[^a-z0-9]', '', 'g'), '') as tool, epoch_us("timestamp") as us,
            row_number() over (partition by id order by ingested_at) as turn
        from tool_events where session_id is not null and id is not null) where turn = 1"""

_RUNS = f"""
    with events as ({_EVENTS}),
    lagged as (select *, lag(tool) over w as ptool, lag(us) over w as pus, row_number() over w as turn from events
        window w as (partition by session_id order by execution_order asc nulls first, id)),
    numbered as (select *, sum(case when tool = ptool and abs(us - pus) <= 600000000 then 0 else 1 end)
        over (partition by session_id order by turn rows unbounded preceding) as run from lagged),
    runs as (select session_id, min(tool) as tool, arg_min(id, turn) as first_id, arg_max(id, turn) as last_id, count(*) as n_events,
        arg_max(us, turn) - arg_min(us, turn) as duration_us from numbered group by session_id, run)
"""

_OVERLAPS = r"""
    with rows as (select query_id, min(split_name) as split, min(source) as source, min(query) as query from queries
        where query_id is not null and query is not null and split_name in ('train', 'validation', 'test') group by query_id),
    words as (select query_id, split, source, list_sort([w for w in string_split_regex(lower(regexp_replace(query, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[^\p{L}]+') if w <> '' and w not in
        ('please','the','a','an','where','is','are','of','in','for','how','does','do','find','show','me','all','to','we','what','which')]) as w from rows),
    holes as (select query_id, split, source, w, w[i] as word, array_to_string(w[:i-1] || w[i+1:], ' ') as rest
        from (select *, unnest(range(1, len(w) + 1)) as i from words)),
    near as (select distinct t.query_id as train_id, e.query_id as eval_id, e.split, e.source from holes t join holes e on t.rest = e.rest and len(t.w) = len(e.w)
        where t.split = 'train' and e.split <> 'train' and t.word <> e.word and damerau_levenshtein(t.word, e.word) = 1),
    pairs as (select * from near union
        select t.query_id, e.query_id, e.split, e.source from words t join words e on t.w = e.w where t.split = 'train' and e.split <> 'train')
"""

_NEIGHBOURS = """
    with units as (select content_hash as name, min(vector::double[]) as x from chunks where len(vector) = 64 and len([v for v in vector if v is null or isnan(v) or isinf(v)]) = 0
        and len([v for v in vector if v <> 0]) > 0 and content_hash is not null group by content_hash),
    pairs as (select a.name, b.name as other, list_cosine_similarity(a.x, b.x) as c from units a join units b on a.name <> b.name),
    best as (select name, other from pairs qualify row_number() over (partition by name order by c desc, other) <= 5)
    select distinct least(name, other) as hash_a, greatest(name, other) as hash_b from best"""

ORACLES = {
    "p1_whole": "select 0::bigint as lines_changed, 0::bigint as unchanged, 0::bigint as twice",
    "p6_whole": """
        select id, start_line as first_line, start_line + length(content) - length(replace(content, chr(10), '')) - (content like '%' || chr(10))::int as last_line, 0::bigint as over_limit
        from (select id, min(coalesce(start_line, 0)) as start_line, min(content) as content from chunks where id is not null and content is not null group by id)
        where length(content) > (select max(amount) from size_limits where limit_name = 'chunk_max')""",
    "p8_whole": "select count(distinct doc_id) as documents, 0::bigint as cut_needlessly, 0::bigint as not_whole, 0::bigint as over_capacity from documents where text is not null",
    "p9_whole": """
        select t.source, max(t.target_share) as target_share, max(t.max_repeats) as max_repeats, count(d.doc) as documents, 0::bigint as wrong from mix_targets t
        left join (select doc_id as doc, min(source) as source from documents where text is not null and source is not null group by doc_id) d using (source) group by t.source""",
    "p3_found": _NEIGHBOURS,
    "p7_found": _RUNS + "select session_id, first_id, last_id from runs where n_events >= 2",
    "p7_collapsed": _RUNS + "select session_id, tool, first_id, last_id, n_events, duration_us from runs",
    "p4_found": _OVERLAPS + "select least(train_id, eval_id) as query_id_a, greatest(train_id, eval_id) as query_id_b from pairs",
    "p4_report": _OVERLAPS + """, exacts as (select distinct e.query_id from words t join words e on t.w = e.w where t.split = 'train' and e.split <> 'train'),
        per as (select eval_id, count(*) as n from pairs group by eval_id)
        select w.split as eval_split, w.source as eval_source, count(*) as records, count(p.eval_id) as overlapping,
            count(x.query_id) as exact_overlapping, coalesce(sum(p.n), 0)::bigint as pairs
        from words w left join per p on p.eval_id = w.query_id left join exacts x on x.query_id = w.query_id
        where w.split <> 'train' group by 1, 2""",
}
