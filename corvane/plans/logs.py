"""Queries on event logs: users of ``events`` and agents of ``tool_events`` stand for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import ascii_words, jaccard, rolling_hash_bucket
from corvane.operators import events as E
from corvane.operators import mining as M
from corvane.plans.registry import query
from corvane.session import table

DAY = 86400.0

_WINDOWS = """marked as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 86400000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    windows as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::int as window_no from marked)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    return E.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", DAY)


@query(f"with {_WINDOWS} select user_id, window_no, count(*) as events, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) as seconds from windows group by 1, 2 having count(*) >= 2")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.session_summary(windows(spark, d), "user_id", "ts").select("user_id", "window_no", "events", F.round("seconds", 3).alias("seconds"))


def _grams(spark: SparkSession, d: str, high: int = 5) -> DataFrame:
    return E.ngrams(windows(spark, d), ["user_id", "window_no"], ["ts", "event_id"], "event_type", "ts", F.col("event_type") != "error", 2, high)


_GRAMS = (
    f"{_WINDOWS}, led as (select user_id, window_no, epoch_us(ts) as t0, "
    + ", ".join(f"lead(event_type, {i}) over w as i{i}, lead(epoch_us(ts), {i}) over w as t{i}x, lead((event_type <> 'error')::int, {i}) over w as o{i}" for i in range(5))
    + " from windows window w as (partition by user_id, window_no order by ts, event_id)), grams as ("
    + " union all ".join(f"select user_id, {n} as length, {' || \'>\' || '.join(f'i{i}' for i in range(n))} as gram, t{n - 1}x - t0 as us, {' + '.join(f'o{i}' for i in range(n))} as ok from led where i{n - 1} is not null" for n in range(2, 6))
    + ")"
)


@query(f"with {_GRAMS} select length, gram, count(*) as n, sum(ok)::bigint as ok from grams group by 1, 2")
def workflow_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _grams(spark, d).groupBy("length", "gram").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))


@query(
    f"with {_GRAMS}, g as (select gram, length, count(*) as n, count(distinct user_id) as entities, sum(ok) / sum(length) as success, avg(us) / 1e6 as seconds from grams group by 1, 2 having count(*) >= 3)"
    " select gram, n, entities, round(0.25 * least(n / 20, 1) + 0.15 * least(entities / 10, 1) + 0.25 * success + 0.1 * (1 - least(seconds / 300, 1)) + 0.15 * least(len(list_distinct(string_split(gram, '>'))) / 5, 1) + 0.1 * least(length / 8, 1), 6) as score from g"
)
def workflow_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.workflows(_grams(spark, d), "user_id").select("gram", "n", "entities", F.round("score", 6).alias("score"))


_MODEL = (
    "lagged as (select event_type as next, "
    + ", ".join(f"lag(event_type, {i}) over w as p{i}" for i in range(1, 4))
    + " from events window w as (partition by user_id order by ts, event_id)), flat as (select 1 as n, '' as context, next from lagged union all select 2, p1, next from lagged where p1 is not null"
    " union all select 3, p2 || '>' || p1, next from lagged where p2 is not null union all select 4, p3 || '>' || p2 || '>' || p1, next from lagged where p3 is not null),"
    " model as (select n, context, next, count(*) as count from flat group by 1, 2, 3)"
)


@query(f"with {_MODEL} select n, context, next, count from model")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.transition_model(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    f"with {_MODEL}, t as (select *, sum(count) over (partition by n, context) as total from model) select n, context, next, count, round((count + 0.1) / (total + 0.1 * (select count(distinct next) from model)), 6) as p,"
    " round(sum(-count / total * log2(count / total)) over (partition by n, context), 6) as entropy from t"
)
def next_event_model(spark: SparkSession, d: str) -> DataFrame:
    rows = E.next_probabilities(E.transition_model(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type"))
    return rows.select("n", "context", "next", "count", F.round("p", 6).alias("p"), F.round("entropy", 6).alias("entropy"))


@query(
    f"with {_MODEL}, lo as (select context, next, (count + 0.1) / (sum(count) over (partition by context) + 0.1 * (select count(distinct next) from model)) as p from model where n = 2),"
    " seen as (select user_id, event_id, event_type, lag(event_type) over w as prev from events window w as (partition by user_id order by ts, event_id))"
    " select s.event_type, count(*) filter (coalesce(lo.p, 0) < 0.195) as deviations, count(*) as n from seen s left join lo on lo.context = s.prev and lo.next = s.event_type where s.prev is not null group by 1"
)
def deviations(spark: SparkSession, d: str) -> DataFrame:
    """Events that the bigram model found unlikely."""
    ev = table(spark, d, "events")
    model = E.next_probabilities(E.transition_model(ev, "user_id", ["ts", "event_id"], "event_type", 2)).where("n = 2").select(F.col("context").alias("prev"), F.col("next").alias("event_type"), "p")
    seen = ev.select("event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev")).where("prev is not null")
    rows = seen.join(F.broadcast(model), ["prev", "event_type"], "left")
    return rows.groupBy("event_type").agg(F.count_if(F.coalesce("p", F.lit(0.0)) < 0.195).alias("deviations"), F.count(F.lit(1)).alias("n"))


@query("""with m as (select user_id, event_id, ts, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as i from events),
    g as (select *, i - row_number() over (partition by user_id, bad order by ts, event_id) as grp from m), s as (select *, case when bad then row_number() over (partition by user_id, bad, grp order by ts, event_id) else 0 end as streak from g)
    select streak, count(*) as n from s group by 1""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    rows = E.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy(F.col("streak").cast("long").alias("streak")).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select *, row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id) as i from events) select count(*) filter (i <= 2) as allowed, count(*) filter (i > 2) as refused from r""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = E.fixed_window_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400)
    return rows.agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("""with t as (select event_type, event_type <> 'error' and value > 50 as hit, row_number() over (partition by event_type order by ts, event_id) as i, count(*) over (partition by event_type) as n from events)
    select event_type as arm, round(1 + sum(pow(0.99, n - i) * hit::int), 5) as alpha, round(1 + sum(pow(0.99, n - i) * (1 - hit::int)), 5) as beta from t group by 1""")
def bandit_posterior(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("event_type") != "error") & (F.col("value") > 50)
    rows = E.discounted_beta(table(spark, d, "events"), "event_type", ["ts", "event_id"], hit)
    return rows.select(F.col("event_type").alias("arm"), F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"))


@query("""with t as (select user_id, (event_type = 'purchase')::int as v, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events)
    select user_id, round(sum(0.1 * pow(0.9, n - i) * v), 6) as value from t group by 1""")
def ema_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = M.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], (F.col("event_type") == "purchase").cast("int"))
    return rows.select("user_id", F.round("value", 6).alias("value"))


@query()
def file_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Clamped boosts: an order-dependent fold per user; tested against plain Python."""
    delta = F.when(F.col("event_type") == "purchase", 0.1).when(F.col("event_type") == "error", -0.1).otherwise(0.0)
    return M.clamped_fold(table(spark, d, "events"), "user_id", ["ts", "event_id"], delta, 1.0, 0.5, 2.0)


_ITEMS = "items as (select distinct user_id as e, 'tool:' || event_type as item from events where event_type <> 'view' union select distinct user_id, 'hour:' || (hour(ts) // 6) from events where event_type = 'error')"


def _items():
    return F.array(F.when(F.col("event_type") != "view", F.concat(F.lit("tool:"), "event_type")), F.when(F.col("event_type") == "error", F.concat(F.lit("hour:"), F.floor(F.hour("ts") / 6).cast("string"))))


@query(f"""with {_ITEMS}, n as (select count(distinct e) as n from items), one as (select item, count(*) as support from items group by 1 having count(*) >= (select ceil(0.05 * n) from n)),
    two as (select a.item || '|' || b.item as items, count(*) as support from items a join items b on a.e = b.e and a.item < b.item group by 1 having count(*) >= (select ceil(0.05 * n) from n))
    select items, support from two union all select item, support from one""")
def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sets of one and two items; larger ones are tested by brute force."""
    sets = M.itemsets(table(spark, d, "events"), "user_id", _items(), 0.05, 2)
    return sets.select(F.array_join("items", "|").alias("items"), "support")


@query(f"""with {_ITEMS}, n as (select count(distinct e) as n from items), one as (select item, count(*) as s from items group by 1),
    two as (select a.item as a, b.item as b, count(*) as s from items a join items b on a.e = b.e and a.item <> b.item group by 1, 2 having count(*) >= (select ceil(0.05 * n) from n))
    select a as antecedent, b as consequent, two.s as support, round(two.s / x.s, 6) as confidence, round(two.s / x.s / (y.s / n.n), 6) as lift from two join one x on x.item = a join one y on y.item = b, n where two.s / x.s >= 0.6""")
def association_rules(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    entities = ev.where("event_type <> 'view'").select("user_id").distinct().count()
    found = M.rules(M.itemsets(ev, "user_id", _items(), 0.05, 2), entities)
    return found.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("""select a.event_id as cause, b.event_id as effect from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'error' and epoch_us(b.ts) > epoch_us(a.ts) and epoch_us(b.ts) - epoch_us(a.ts) <= 43200000000 and abs(b.value - a.value) < 40""")
def corrections_after(spark: SparkSession, d: str) -> DataFrame:
    """Errors within twelve hours of the same user's purchase: an interval join."""
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pairs = E.followed_within(ev.where("event_type = 'purchase'"), ev.where("event_type = 'error'"), ["user_id"], "ts", 43200, F.abs(F.col("b_value") - F.col("a_value")) < 40)
    return pairs.select(F.col("a_event_id").alias("cause"), F.col("b_event_id").alias("effect"))


@query("""with p as (select user_id, event_id, event_type, ts, lag(event_type) over w as before, epoch_us(ts) - lag(epoch_us(ts)) over w as gap from events window w as (partition by user_id order by ts, event_id))
    select before, event_type as after, count(*) as n from p where gap <= 21600000000 and before <> event_type group by 1, 2""")
def refinements(spark: SparkSession, d: str) -> DataFrame:
    """What follows another event of the same user within six hours: an as-of self join."""
    rows = E.previous_within(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", 21600)
    return rows.where("previous is not null and previous <> event_type").groupBy(F.col("previous").alias("before"), F.col("event_type").alias("after")).agg(F.count(F.lit(1)).alias("n"))


_W = "list_distinct([w for w in string_split_regex(lower(query), '[^a-z0-9]+') if w <> ''])"


@query(f"""with q as (select distinct query_id, query, source, added_at from queries where query is not null), p as (select query_id, {_W} as w, lag({_W}) over (partition by source order by added_at, query_id) as v from q)
    select query_id, round(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))), 6) as likeness from p where len(list_intersect(w, v)) > 0""")
def query_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap with the query that came before it from the same source."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "query", "source", "added_at").distinct()
    w = F.array_distinct(ascii_words(F.col("query")))
    rows = q.withColumn("w", w).withColumn("v", F.lag("w").over(Window.partitionBy("source").orderBy("added_at", "query_id"))).where("v is not null")
    return rows.select("query_id", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("likeness")).where("likeness > 0")


@query("select event_type, user_id % 5 as slot, count(distinct user_id) as entities, count(*) as n, sha256(event_type || '|' || (user_id % 5))[1:16] as digest from events group by 1, 2 having count(distinct user_id) >= 5")
def k_anonymous_patterns(spark: SparkSession, d: str) -> DataFrame:
    return M.k_anonymous(table(spark, d, "events").withColumn("slot", F.col("user_id") % 5), ["event_type", "slot"], "user_id")


@query()
def noised_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts with seeded Laplace noise."""
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("noised", F.col("n") + M.laplace_noise(1.0, 3, F.col("event_type")))


@query()
def experiment_groups(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the 32-bit rolling hash of their name."""
    return table(spark, d, "customer").groupBy(rolling_hash_bucket(F.col("c_name"), 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def error_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of failed tool events by tool, type and words, over distinct combinations."""
    bad = table(spark, d, "tool_events").where("not success and tool_name is not null").select(F.lower("tool_name").alias("tool"), F.coalesce("error_type", F.lit("unknown")).alias("type")).distinct()
    rows = bad.select(F.concat_ws("/", "tool", "type").alias("id"), "tool", "type", F.array_distinct(ascii_words(F.col("type"))).alias("words"))
    return M.error_clusters(rows)


@query("select session_id, row_number() over (partition by session_id order by execution_order nulls first, id) as position, lower(tool_name) as tool from (select distinct id, session_id, execution_order, tool_name from tool_events where session_id is not null and tool_name is not null)")
def session_paths(spark: SparkSession, d: str) -> DataFrame:
    """Tools in order, of all sessions: one row per position, so that no session is put together in one task."""
    ev = table(spark, d, "tool_events").where("session_id is not null and tool_name is not null").select("id", "session_id", "execution_order", "tool_name").distinct()
    return E.positions(ev, "session_id", ["execution_order", "id"]).select("session_id", F.col("_cv_i").alias("position"), F.lower("tool_name").alias("tool"))


@query()
def workflow_ngrams_whole(spark: SparkSession, d: str) -> DataFrame:
    """n-grams of 2 to 8 events; tested by brute force."""
    return _grams(spark, d, 8).groupBy("length", "gram").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))


@query()
def workflow_scores_whole(spark: SparkSession, d: str) -> DataFrame:
    """Scores of n-grams of 2 to 8 events."""
    return E.workflows(_grams(spark, d, 8), "user_id").select("gram", "n", "entities", F.round("score", 6).alias("score"))


@query(
    f"with {_ITEMS}, n as (select count(distinct e) as n from items), sets as ("
    + " union all ".join(
        f"select {' || \'|\' || '.join(f'a{i}.item' for i in range(k))} as items, count(*) as support from items a0 {' '.join(f'join items a{i} on a{i}.e = a0.e and a{i - 1}.item < a{i}.item' for i in range(1, k))} group by 1" for k in range(1, 6)
    )
    + ") select items, support from sets where support >= (select ceil(0.05 * n) from n)"
)
def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of one to five items."""
    sets = M.itemsets(table(spark, d, "events"), "user_id", _items(), 0.05, 5)
    return sets.select(F.array_join("items", "|").alias("items"), "support")


@query()
def itemset_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over sets of up to five items, with one or more on each side; tested by brute force."""
    ev = table(spark, d, "events")
    entities = ev.select("user_id", F.explode(_items()).alias("item")).where("item is not null").agg(F.count_distinct("user_id")).first()[0]
    found = M.rules(M.itemsets(ev, "user_id", _items(), 0.05, 5), entities)
    return found.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))
