"""Event logs: sessions by gaps, n-grams, workflows, corrections, refinements.

What depends on the rows before is taken from operators.ordering, so that one entity may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import previous_rows, running_sum


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def gap_sessions(df: DataFrame, entity: str, time: str, key: str, gap_seconds: float, out: str = "window_no") -> DataFrame:
    """Rows with the number of their window: a new one begins where the gap to the event before exceeds ``gap_seconds``.

    A gap of just that length does not split. Order is (time, key).
    """
    order = [F.col(time).asc(), F.col(key).asc()]
    rows = previous_rows(df, entity, order, [time], 1, "_cv_previous")
    gap = micros(F.col(time)) - micros(F.get("_cv_previous", F.lit(0))[time])
    flagged = rows.withColumn("_cv_new", F.when(gap.isNull() | (gap > int(gap_seconds * 1_000_000)), 1).otherwise(0))
    summed = running_sum(flagged.drop("_cv_previous"), entity, order, "_cv_new", "_cv_started")
    return summed.select(*df.columns, (F.col("_cv_started") + F.col("_cv_new")).cast("int").alias(out))


def session_summary(sessions: DataFrame, entity: str, time: str, least: int = 2, window: str = "window_no") -> DataFrame:
    """(entity, window, events, start, end, seconds) of windows of ``least`` events or more."""
    rows = sessions.groupBy(entity, window).agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return rows.where(F.col("events") >= least).withColumn("seconds", (micros(F.col("ended")) - micros(F.col("started"))) / 1e6)


def ngrams(df: DataFrame, by: list[str], order: list[str], item: str, time: str, ok: Column, low: int = 2, high: int = 8) -> DataFrame:
    """(by..., length, gram, us, ok): every run of ``low`` to ``high`` consecutive items of a group, each told at its last item."""
    rows = df.select(*by, *order, F.struct(*by).alias("_cv_entity"), F.col(item).alias("item"), micros(F.col(time)).alias("us"), ok.cast("int").alias("ok"))
    seen = previous_rows(rows, "_cv_entity", [F.col(o).asc() for o in order], ["item", "us", "ok"], high - 1, "_cv_before")
    run = F.concat(F.array(F.struct("item", "us", "ok")), "_cv_before")  # nearest first
    each = F.transform(
        F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.size(run)),
        lambda n: F.struct(
            n.alias("length"), F.array_join(F.reverse(F.transform(F.slice(run, F.lit(1), n), lambda x: x["item"])), ">").alias("gram"), (F.col("us") - F.element_at(run, n)["us"]).alias("us"),
            F.aggregate(F.slice(run, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.coalesce(x["ok"], F.lit(0))).alias("ok"),
        ),
    )
    return seen.select(*by, F.explode(each).alias("g")).select(*by, "g.*")


def workflows(grams: DataFrame, entity: str, least: int = 3) -> DataFrame:
    """(gram, length, n, entities, success, seconds, score): repeated n-grams with a score of how well they could be automated.

    Weights: frequency .25 (of 20), entities .15 (of 10), success .25, brevity .10 (of 300 s), distinct items .15 (of 5), length .10 (of 8).
    """
    rows = grams.groupBy("gram", "length").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("entities"), (F.sum("ok") / F.sum("length")).alias("success"), (F.avg("us") / 1e6).alias("seconds"),
    ).where(F.col("n") >= least)
    kinds = F.size(F.array_distinct(F.split("gram", ">")))
    cap = lambda c, m: F.least(c / m, F.lit(1.0))
    score = 0.25 * cap(F.col("n"), 20) + 0.15 * cap(F.col("entities"), 10) + 0.25 * F.col("success") + 0.1 * (1 - cap(F.col("seconds"), 300)) + 0.15 * cap(kinds, 5) + 0.1 * cap(F.col("length"), 8)
    return rows.withColumn("score", score)


def usage(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def error_rates(df: DataFrame, name: str, failed: Column, more_than: int = 5) -> DataFrame:
    """(name, total, errors, rate) of names with more than ``more_than`` events."""
    rows = df.groupBy(name).agg(F.count(F.lit(1)).alias("total"), F.sum(failed.cast("long")).alias("errors"))
    return rows.where(F.col("total") > more_than).withColumn("rate", F.col("errors") / F.col("total"))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared lines of two line ranges over those of the smaller."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    return shared / F.greatest(F.least(a1 - a0, b1 - b0) + 1, F.lit(1))


def followed_within(first: DataFrame, then: DataFrame, keys: list[str], time: str, seconds: int, condition: Column) -> DataFrame:
    """Pairs of a row of ``first`` (columns a_...) and a later one of ``then`` (b_...) with equal keys, at most ``seconds`` later.

    The interval join is an equality on (keys, time bucket): each first row is listed in its bucket and the next one, so the
    work grows with the pairs that are close in time, not with the square of a key's rows.
    """
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in first.columns]).withColumn("_ta", micros(F.col(f"a_{time}")))
    b = then.select(*[F.col(c).alias(f"b_{c}") for c in then.columns]).withColumn("_tb", micros(F.col(f"b_{time}")))
    width = seconds * 1_000_000
    a = a.withColumn("_k", F.explode(F.array(F.floor(F.col("_ta") / width), F.floor(F.col("_ta") / width) + 1)))
    b = b.withColumn("_k", F.floor(F.col("_tb") / width))
    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    joined = a.alias("a").join(b.alias("b"), [F.col("a._k") == F.col("b._k"), *same])
    return joined.where((F.col("_tb") > F.col("_ta")) & (F.col("_tb") - F.col("_ta") <= width) & condition).drop("_k", "_ta", "_tb")


def previous_within(df: DataFrame, entity: str, time: str, key: str, value: str, seconds: int) -> DataFrame:
    """Rows with ``previous``: the value of the entity's last row before, if at most ``seconds`` older; an as-of self join by lag."""
    rows = previous_rows(df, entity, [F.col(time).asc(), F.col(key).asc()], [time, value], 1, "_cv_previous")
    last = F.get("_cv_previous", F.lit(0))
    near = micros(F.col(time)) - micros(last[time]) <= seconds * 1_000_000
    return rows.select(*df.columns, F.when(near, last[value]).alias("previous"))


def transition_model(df: DataFrame, entity: str, order: list[str], item: str, most: int = 4) -> DataFrame:
    """(n, context, next, count): what follows the last n - 1 items, for n from 1 to ``most``; context is '' for n = 1."""
    rows = previous_rows(df.select(entity, *order, F.col(item).alias("next")), entity, [F.col(o).asc() for o in order], ["next"], most - 1, "_cv_before")
    before = F.transform("_cv_before", lambda x: x["next"])  # nearest first
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(before) + 1, F.lit(most))), lambda n: F.struct(n.alias("n"), F.array_join(F.reverse(F.slice(before, F.lit(1), n - 1)), ">").alias("context")))
    flat = rows.select("next", F.explode(each).alias("g"))
    return flat.groupBy("g.n", "g.context", "next").agg(F.count(F.lit(1)).alias("count"))


def next_probabilities(model: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """(n, context, next, p, entropy): smoothed over the vocabulary; entropy in bits of the raw counts of the context."""
    size = model.agg(F.countDistinct("next").alias("v"))
    w = Window.partitionBy("n", "context")
    total = F.sum("count").over(w)
    share = F.col("count") / total
    return model.join(F.broadcast(size)).select(
        "n", "context", "next", "count", ((F.col("count") + smoothing) / (total + smoothing * F.col("v"))).alias("p"), F.sum(-share * F.log2(share)).over(w).alias("entropy"),
    )


def positions(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Rows with _cv_i, their place in the entity from 1, and _cv_n, the rows of the entity."""
    summed = running_sum(df.withColumn("_cv_one", F.lit(1)), entity, [F.col(o).asc() for o in order], "_cv_one", "_cv_at")
    return summed.select(*df.columns, (F.col("_cv_at") + 1).alias("_cv_i"), F.col("_cv_at_total").alias("_cv_n"))


def discounted_beta(df: DataFrame, arm: str, order: list[str], hit: Column, gamma: float = 0.99) -> DataFrame:
    """(arm, alpha, beta, mean): Beta posterior with counts discounted by gamma for each later trial of the arm.

    The fold 'decay, then add' has the closed form 1 + sum(gamma^(n - i) * hit_i), so that it is an aggregation.
    """
    rows = positions(df.select(arm, *[c for c in order if c != arm], hit.cast("double").alias("hit")), arm, order)
    rows = rows.select(arm, F.pow(F.lit(gamma), F.col("_cv_n") - F.col("_cv_i")).alias("w"), "hit")
    sums = rows.groupBy(arm).agg((1 + F.sum(F.col("w") * F.col("hit"))).alias("alpha"), (1 + F.sum(F.col("w") * (1 - F.col("hit")))).alias("beta"))
    return sums.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def streaks(df: DataFrame, entity: str, order: list[str], flag: Column) -> DataFrame:
    """Rows with ``streak``: how many flagged rows in a row end here; 0 on rows without the flag."""
    keys = [F.col(o).asc() for o in order]
    flagged = df.withColumn("_cv_f", flag.cast("int")).withColumn("_cv_not", 1 - F.col("_cv_f"))
    runs = running_sum(running_sum(flagged, entity, keys, "_cv_not", "_cv_run"), entity, keys, "_cv_f", "_cv_before")
    runs = runs.withColumn("_cv_run", F.col("_cv_run") + F.col("_cv_not"))
    first = runs.where("_cv_f = 1").groupBy(entity, "_cv_run").agg(F.min("_cv_before").alias("_cv_first"))
    joined = runs.join(first, [entity, "_cv_run"], "left")
    return joined.select(*df.columns, F.when(F.col("_cv_f") == 1, F.col("_cv_before") + 1 - F.col("_cv_first")).otherwise(0).alias("streak"))


def fixed_window_limit(df: DataFrame, entity: str, time: str, key: str, per_window: int, seconds: int = 60) -> DataFrame:
    """Rows with ``allowed``: the first ``per_window`` of each tumbling window of an entity."""
    slot = F.floor(micros(F.col(time)) / (seconds * 1_000_000))
    w = Window.partitionBy(entity, "_slot").orderBy(time, key)
    return df.withColumn("_slot", slot).withColumn("allowed", F.row_number().over(w) <= per_window).drop("_slot")
