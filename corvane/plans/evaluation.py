"""Queries of the evaluation family. Vectors of equal label stand for relevant documents; suppliers for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import evaluation as V
from corvane.operators import mining as M
from corvane.operators.retrieval import cosine
from corvane.plans.registry import query
from corvane.session import table

#: Query vectors: a stated set of ids against all vectors.
EVERY = 50

_RANKED = f"""q as (select vec_id as query, embedding::double[] as e, label from embeddings where vec_id % {EVERY} = 0), s as (select q.query, v.vec_id as doc, list_cosine_similarity(q.e, v.embedding::double[]) as c, q.label = v.label as rel from q join embeddings v on v.vec_id <> q.query),
    ranked as (select *, row_number() over (partition by query order by c desc, doc) as rank from s), top as (select * from ranked where rank <= 20)"""


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query, doc, rank) of the 20 nearest, and (query, doc) of equal label. The query vectors are the small side."""
    v = table(spark, d, "embeddings")
    q = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("e"), F.col("label").alias("ql"))
    scored = v.join(q, F.col("vec_id") != F.col("query")).select("query", F.col("vec_id").alias("doc"), cosine(F.col("e"), F.col("embedding")).alias("c"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "doc"))).where("rank <= 20").select("query", "doc", "rank")
    relevant = v.join(q.select("query", "ql"), (F.col("label") == F.col("ql")) & (F.col("vec_id") != F.col("query"))).select("query", F.col("vec_id").alias("doc"))
    return ranked, relevant


@query(
    f"with {_RANKED}, w as (select query, count(*) as wanted from s where rel group by 1), h as (select query, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg, count(*) filter (rank <= 10) as n from top where rel group by 1)"
    " select w.query, round(coalesce(1 / first, 0), 6) as rr, round(coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, least(wanted, 10)::bigint + 1) t(i)), 6) as ndcg_10, round(coalesce(dcg, 0), 6) as ndcg_ref_10, round(coalesce(n, 0) / wanted, 6) as recall_10 from w left join h using (query)"
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = V.per_query(*_results(spark, d))
    return rows.select("query", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg_10", "ndcg_ref_10", "recall_10")])


@query(f"with {_RANKED}, w as (select query from s where rel group by 1), h as (select query, min(rank) as first from top where rel group by 1) select round(avg(coalesce(1 / first, 0)), 6) as mrr, round(avg((first is not null and first <= 5)::int), 6) as hit_5, count(*) as queries from w left join h using (query)")
def mean_reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = V.per_query(*_results(spark, d))
    return rows.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("hit_5"), 6).alias("hit_5"), F.count(F.lit(1)).alias("queries"))


_PAIRS = "pairs as (select 's' || a.l_suppkey as model_a, 's' || b.l_suppkey as model_b, case when a.l_discount = b.l_discount then 'tie' when a.l_discount > b.l_discount then 'A' else 'B' end as winner from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    a, b = li.alias("a"), li.alias("b")
    winner = F.when(F.col("a.l_discount") == F.col("b.l_discount"), "tie").when(F.col("a.l_discount") > F.col("b.l_discount"), "A").otherwise("B")
    joined = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return joined.select(F.concat(F.lit("s"), F.col("a.l_suppkey")).alias("model_a"), F.concat(F.lit("s"), F.col("b.l_suppkey")).alias("model_b"), winner.alias("winner"))


@query(
    f"with {_PAIRS}, f as (select model_a as model, (winner = 'A')::int as w, (winner = 'B')::int as l, (winner = 'tie')::int as t from pairs union all select model_b, (winner = 'B')::int, (winner = 'A')::int, (winner = 'tie')::int from pairs)"
    " select model, sum(w)::bigint as wins, sum(l)::bigint as losses, sum(t)::bigint as ties, round((sum(w) + 0.5 * sum(t)) / count(*), 6) as win_rate from f group by 1"
)
def tournament(spark: SparkSession, d: str) -> DataFrame:
    rows = V.tournament(_pairs(spark, d))
    return rows.select("model", "wins", "losses", "ties", F.round("win_rate", 6).alias("win_rate"))


@query("""select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, quantile_cont(l_quantity, 0.5) as median, round(stddev_pop(l_quantity), 6) as std, round(var_pop(l_quantity), 5) as variance, round(kurtosis_pop(l_quantity), 5) as kurtosis,
    quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from lineitem group by 1""")
def basic_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = V.moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return m.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), F.round("variance", 5).alias("variance"), F.round("kurtosis", 5).alias("kurtosis"), "q1", "q3")


_TWO = "two as (select o_custkey, avg(o_totalprice) filter (year(o_orderdate) < 1998) as a, avg(o_totalprice) filter (year(o_orderdate) >= 1998) as b from orders group by 1)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    early = F.year("o_orderdate") < 1998
    return o.groupBy("o_custkey").agg(F.avg(F.when(early, F.col("o_totalprice"))).alias("a"), F.avg(F.when(~early, F.col("o_totalprice"))).alias("b")).where("a is not null and b is not null")


_CDF = "(1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-zz * zz))"


def _p_sql(select: str, source: str) -> str:
    """Two-sided p of a column z by the same polynomial."""
    return f"select {select}, round(2 * (1 - 0.5 * (1 + {_CDF})), 6) as p from (select *, abs(z) / sqrt(2.0) as zz, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as t from ({source}))"


@query(f"with {_TWO}, " + "x as (select count(*) as n, avg(a - b) as m, stddev_samp(a - b) as s from two where a is not null and b is not null) " + _p_sql("n, round(mean_delta, 4) as mean_delta, round(z, 6) as t_stat, round(d, 6) as d", "select n, m as mean_delta, m / (s / sqrt(n)) as z, m / s as d from x"))
def paired_test(spark: SparkSession, d: str) -> DataFrame:
    t = V.paired_t(_two(spark, d), "a", "b")
    return t.select("n", F.round("mean_delta", 4).alias("mean_delta"), F.round("t", 6).alias("t_stat"), F.round("d", 6).alias("d"), F.round("p", 6).alias("p"))


_WILCOXON = f"""with {_TWO}, r as (select abs(a - b) as x, a > b as pos, rank() over (order by abs(a - b)) + (count(*) over (partition by abs(a - b)) - 1) / 2.0 as r, count(*) over (partition by abs(a - b)) as c from two where a is not null and b is not null and a <> b),
    x as (select count(*) as n, sum(r) filter (pos) as wp, sum(r) filter (not pos) as wm, sum(c * c - 1.0) as ties from r) """


@query(_WILCOXON + _p_sql("n, round(wp, 2) as w_plus, round(wm, 2) as w_minus, round(z, 6) as z", "select *, (least(wp, wm) - n * (n + 1) / 4 + 0.5) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48) as z from x"))
def wilcoxon_test(spark: SparkSession, d: str) -> DataFrame:
    w = V.wilcoxon(_two(spark, d), "a", "b")
    return w.select("n", F.round("w_plus", 2).alias("w_plus"), F.round("w_minus", 2).alias("w_minus"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("""with r as (select l_returnflag as a, case l_linestatus when 'F' then 'R' when 'O' then 'N' else l_linestatus end as b from lineitem), t as (select count(*) as n, avg((a = b)::int) as observed from r),
    e as (select sum(x.c * y.c) as xy from (select a as v, count(*) as c from r group by 1) x join (select b as v, count(*) as c from r group by 1) y using (v)) select n, round(observed, 6) as observed, round(xy / (n * n), 6) as expected, round((observed - xy / (n * n)) / (1 - xy / (n * n)), 6) as kappa from t, e""")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_linestatus") == "F", "R").when(F.col("l_linestatus") == "O", "N").otherwise(F.col("l_linestatus")).alias("b"))
    return V.cohen_kappa(rows, "a", "b").select("n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round("kappa", 6).alias("kappa"))


@query(
    "with x as (select count(*) filter (user_id % 2 = 0) as nc, count(*) filter (user_id % 2 = 1) as nt, count(*) filter (user_id % 2 = 0 and event_type = 'error') as ec, count(*) filter (user_id % 2 = 1 and event_type = 'error') as et from events) "
    + _p_sql("nc as n_control, nt as n_treatment, round(ec / nc, 6) as p_control, round(et / nt, 6) as p_treatment, round(z, 6) as z", "select *, (et / nt - ec / nc) / sqrt((ec + et) / (nc + nt) * (1 - (ec + et) / (nc + nt)) * (1 / nc + 1 / nt)) as z from x")
)
def ab_test(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("arm", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment"))
    r = V.proportion_test(rows, "arm", F.col("event_type") == "error", "control", "treatment")
    return r.select("n_control", "n_treatment", *[F.round(c, 6).alias(c) for c in ("p_control", "p_treatment", "z", "p")])


@query("""with p as (select user_id % 50 as k, count(*) filter (event_type = 'error') / count(*) as p from events group by 1), r as (select *, row_number() over (order by p, k) as r, count(*) over () as n from p)
    select k, round(p, 6) as p, round(least(min(p * n / r) over (order by r rows between current row and unbounded following), 1.0), 6) as adjusted from r""")
def false_discovery(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("k")).agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("p"))
    return V.bh_adjusted(p, "p", "k").select("k", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


_SERIES = "series as (select date_trunc('day', ts) as bucket, avg((event_type = 'error')::int) as value, count(*) as samples from events group by 1)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return V.metric_series(table(spark, d, "events"), "ts", (F.col("event_type") == "error").cast("int"), "1 day")


@query(f"with {_SERIES} select strftime(bucket, '%Y-%m-%d') as day, round(value, 6) as value, samples from series")
def metric_windows(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.round("value", 6).alias("value"), "samples")


@query(
    f"with {_SERIES} select strftime(bucket, '%Y-%m-%d') as day, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 5) as z_score, coalesce(count(*) over w >= 10 and abs((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0)) > 2.0, false) as anomaly"
    " from series window w as (order by bucket rows between 29 preceding and current row)"
)
def metric_anomalies(spark: SparkSession, d: str) -> DataFrame:
    rows = V.anomalies(_series(spark, d), "bucket", "value", z=2.0)
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.round("z_score", 5).alias("z_score"), "anomaly")


@query(f"with {_SERIES}, i as (select *, row_number() over (order by bucket)::double as i from series) select strftime(bucket, '%Y-%m-%d') as day, round(regr_slope(value, i) over w, 6) as slope, round(regr_r2(value, i) over w, 5) as r2 from i window w as (order by bucket rows between 6 preceding and current row) qualify row_number() over (order by bucket) >= 7")
def metric_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trend(_series(spark, d), "bucket", "value").withColumn("k", F.row_number().over(Window.orderBy("bucket"))).where("k >= 7")
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.round("slope", 6).alias("slope"), F.round("r2", 5).alias("r2"))


@query("select event_type, round(avg(value) filter (ts < '2024-01-16'), 6) as before, round(avg(value) filter (ts >= '2024-01-16'), 6) as after from events group by 1")
def period_comparison(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(early, F.col("value"))), 6).alias("before"), F.round(F.avg(F.when(~early, F.col("value"))), 6).alias("after"))


@query("select lower(tool_name) as tool, quantile_cont(duration_ms, 0.5) as p50, quantile_cont(duration_ms, 0.95) as p95, round(avg(duration_ms), 4) as mean from tool_events where tool_name is not null and duration_ms is not null group by 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_events").where("tool_name is not null and duration_ms is not null")
    return rows.groupBy(F.lower("tool_name").alias("tool")).agg(F.percentile("duration_ms", F.lit(0.5)).alias("p50"), F.percentile("duration_ms", F.lit(0.95)).alias("p95"), F.round(F.avg("duration_ms"), 4).alias("mean"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as pearson, round(regr_slope(l_extendedprice, l_quantity), 5) as slope from lineitem")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 5).alias("slope"))


@query("""with m as (select 's' || l_suppkey as model, avg(l_discount) as d, avg(l_tax) as t from lineitem group by 1) select model, round(case when max(d) over () = min(d) over () then 1 else (d - min(d) over ()) / (max(d) over () - min(d) over ()) end, 6) as min_max,
    round((t - avg(t) over ()) / nullif(stddev_pop(t) over (), 0), 5) as z_score, round(row_number() over (order by d, model) / count(*) over (), 6) as percentile from m""")
def score_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """Scores of models: min-max, z-score and percentile rank."""
    m = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("model")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    w = Window.partitionBy()
    low, high = F.min("d").over(w), F.max("d").over(w)
    return m.select(
        "model", F.round(F.when(high == low, 1.0).otherwise((F.col("d") - low) / (high - low)), 6).alias("min_max"), F.round((F.col("t") - F.avg("t").over(w)) / F.nullif(F.stddev_pop("t").over(w), F.lit(0.0)), 5).alias("z_score"),
        F.round(F.row_number().over(Window.orderBy("d", "model")) / F.count(F.lit(1)).over(w), 6).alias("percentile"),
    )


@query("""with t as (select o_orderpriority as g, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders), x as (select g, max(o_totalprice) filter (r = 1) - max(o_totalprice) filter (r = 2) as gap, max((o_orderkey % 2 = 0)::int) filter (r = 1) as correct from t group by 1)
    select g, correct, round(gap, 4) as gap from x""")
def contrastive_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") % 2 == 0).alias("hit"), F.col("o_totalprice").alias("s"))
    return M.contrast(rows, "g", "hit", "s").select("g", "correct", F.round("gap", 4).alias("gap"))


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean order price by seeded Poisson weights."""
    return V.bootstrap_mean(table(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("""with p as (select l_suppkey as m, l_returnflag as judge, avg(l_discount) as s from lineitem group by 1, 2) select m as model, round(quantile_cont(s, 0.5), 6) as consensus, round(max(s) - min(s), 6) as spread from p group by 1""")
def judge_consensus(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model"), "l_returnflag").agg(F.avg("l_discount").alias("s"))
    return p.groupBy("model").agg(F.round(F.percentile("s", F.lit(0.5)), 6).alias("consensus"), F.round(F.max("s") - F.min("s"), 6).alias("spread"))


@query("select doc_id, count(distinct subject) as subjects, count(*) as ratings, mode(subject order by subject) as common from doc_labels group by 1 having count(*) > 1")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_labels").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("subjects"), F.sum("c").alias("ratings"), F.min_by("subject", F.struct(-F.col("c"), F.col("subject"))).alias("common")).where("ratings > 1")
