"""Frequent itemsets, association rules, error clusters, safety scores and learned weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.events import positions
from corvane.operators.ordering import BLOCK, ordered_blocks
from corvane.session import written


def itemsets(df: DataFrame, entity: str, items: Column, min_share: float = 0.05, most: int = 5) -> DataFrame:
    """(items, support): sets of up to ``most`` items that ``min_share`` of the entities hold, by FP-growth over distinct items."""
    from pyspark.ml.fpm import FPGrowth

    baskets = df.select(entity, F.explode(items).alias("item")).where("item is not null").distinct().groupBy(entity).agg(F.collect_set("item").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_share, minConfidence=1.0).fit(written(baskets)).freqItemsets
    return found.where(F.size("items") <= most).select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def rules(sets: DataFrame, entities: int, confidence: float = 0.6) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) over all splits of each set into two parts.

    A set of n items has 2^n - 2 splits, listed by a bit mask; both parts are frequent sets, looked up by joins.
    """
    flat = sets.where(F.size("items") > 1).select("items", "support", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int"))).alias("mask"))
    at = lambda side: F.filter("items", lambda x, i: (F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2) == side)
    split = flat.select("support", at(1).alias("antecedent"), at(0).alias("consequent"))
    part = lambda name: sets.select(F.col("items").alias(name), F.col("support").alias(f"{name}_support"))
    joined = split.join(part("antecedent"), "antecedent").join(part("consequent"), "consequent")
    conf = F.col("support") / F.col("antecedent_support")
    return joined.select("antecedent", "consequent", "support", conf.alias("confidence"), (conf / (F.col("consequent_support") / entities)).alias("lift")).where(F.col("confidence") >= confidence)


def error_clusters(errors: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, cluster): errors linked where .4 same tool + .3 same type + .3 word overlap reach ``least``; connected, named by smallest id.

    ``errors``: id, tool, type, words, one row per distinct (tool, type, words). At ``least`` above .3, linked errors share the
    tool or the type, so that pairs are made within these only; components grow by hash-to-minimum rounds with written tables.
    """
    e = errors.select("id", "tool", "type", "words")
    keyed = e.select("*", F.explode(F.array(F.concat(F.lit("t:"), "tool"), F.concat(F.lit("y:"), "type"))).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    both, either = F.size(F.array_intersect("a.words", "b.words")), F.size(F.array_union("a.words", "b.words"))
    likeness = 0.4 * (F.col("a.tool") == F.col("b.tool")).cast("int") + 0.3 * (F.col("a.type") == F.col("b.type")).cast("int") + 0.3 * F.when(either > 0, both / either).otherwise(1.0)
    links = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).where(likeness >= least).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    links = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = e.select("id", F.col("id").alias("cluster"))
    while True:
        near = links.join(label.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("cluster").alias("near"))
        nxt = written(label.join(near, "id", "left").select("id", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster")))
        moved = nxt.join(label.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").limit(1).count()
        label = nxt
        if not moved:
            return label


def correction_score(lexical: Column, pivot: Column, overwrite: Column, reask: Column) -> Column:
    """0.3 words, 0.2 change of tools, 0.35 overwritten edits, 0.15 the question asked again."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return 0.3 * zero(lexical) + 0.2 * zero(pivot) + 0.35 * zero(overwrite) + 0.15 * zero(reask)


def lexical_correction(text: Column, strong: list[str], weak: list[str], openers: list[str]) -> Column:
    """1 with a strong phrase; else 0.3 + 0.2 for each weak word, +0.3 if the first word opens a correction; 0 without any."""
    low = F.lower(text)
    hit = lambda words: [low.contains(w) for w in words]
    n = sum((c.cast("int") for c in hit(weak)), F.lit(0))
    base = F.when(n > 0, F.least(F.lit(1.0), 0.3 + 0.2 * n)).otherwise(0.0)
    first = F.when(F.substring_index(F.trim(low), " ", 1).isin(openers), 0.3).otherwise(0.0)
    any_strong = F.lit(False)
    for c in hit(strong):
        any_strong = any_strong | c
    return F.when(any_strong, 1.0).otherwise(F.least(F.lit(1.0), base + first))


def clamped_fold(df: DataFrame, key: str, order: list[str], delta: Column, start: float, low: float, high: float) -> DataFrame:
    """(key, value): start plus all deltas in order, clamped to [low, high] after each; the order must be total.

    Steps x -> min(max(x + s, a), b) are closed under composition, so that each block of a key becomes one such step, and a
    key of any size is folded over its few blocks.
    """
    keys = [F.col(o).asc() for o in order]
    rows = ordered_blocks(df.select(key, *[o for o in order if o != key], delta.cast("double").alias("_cv_d")), key, keys)
    clamp = lambda x, a, b: F.least(F.greatest(x, a), b)
    none = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"))

    def then(acc: Column, s: Column, a: Column, b: Column) -> Column:
        return F.struct((acc["s"] + s).alias("s"), clamp(acc["a"] + s, a, b).alias("a"), clamp(acc["b"] + s, a, b).alias("b"))

    lo, hi = F.lit(float(low)), F.lit(float(high))
    step = F.aggregate(F.array_sort(F.collect_list(F.struct(*order, "_cv_d"))), none, lambda acc, x: then(acc, F.coalesce(x["_cv_d"], F.lit(0.0)), lo, hi))
    blocks = rows.groupBy(key, BLOCK).agg(step.alias("f"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct(BLOCK, "f"))), none, lambda acc, x: then(acc, x["f"]["s"], x["f"]["a"], x["f"]["b"]))
    folded = blocks.groupBy(key).agg(whole.alias("f"))
    return folded.select(key, clamp(F.col("f.s") + start, F.col("f.a"), F.col("f.b")).alias("value"))


def ema(df: DataFrame, key: str, order: list[str], value: Column, alpha: float = 0.1, start: float = 0.0) -> DataFrame:
    """(key, value): exponential moving average, in closed form: an aggregation without any order-dependent fold."""
    rows = positions(df.select(key, *[c for c in order if c != key], value.cast("double").alias("v")), key, order)
    rows = rows.select(key, F.col("_cv_n").alias("n"), F.pow(F.lit(1 - alpha), F.col("_cv_n") - F.col("_cv_i")).alias("w"), "v")
    return rows.groupBy(key).agg((alpha * F.sum(F.col("w") * F.col("v")) + start * F.pow(F.lit(1 - alpha), F.max("n"))).alias("value"))


def k_anonymous(df: DataFrame, pattern: list[str], entity: str, k: int = 5) -> DataFrame:
    """(pattern..., entities, n, digest) of patterns seen at ``k`` entities or more."""
    rows = df.groupBy(*pattern).agg(F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("n")).where(F.col("entities") >= k)
    return rows.withColumn("digest", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in pattern]), 256), 1, 16))


def laplace_noise(scale: float, seed: int, *key: Column) -> Column:
    """Seeded noise by inversion; the same key gets the same noise."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit((1 << 40) - 2)).cast("double") / float((1 << 40) - 2) - 0.5 + 1e-13
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def contrast(df: DataFrame, by: str, target: str, score: str) -> DataFrame:
    """(by, correct, gap) from (by, candidate is target, score): is the target on top, and by how much the top leads."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.desc(target))
    rows = df.withColumn("_r", F.row_number().over(w))
    return rows.groupBy(by).agg(F.max(F.when(F.col("_r") == 1, F.col(target).cast("int"))).alias("correct"), (F.max(F.when(F.col("_r") == 1, F.col(score))) - F.max(F.when(F.col("_r") == 2, F.col(score)))).alias("gap"))
