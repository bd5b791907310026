"""Penalties, blends, decisions and samples: small formulas on result rows, most of them single expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.operators.events import positions
from corvane.operators.ordering import running_sum

DEAD_FACTOR, DEAD_RANK = 0.6, 0.001


def dead_code_penalty(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """results (id, name, file, score) with the score times 0.6 where the symbol of that name is unused.

    Of several symbols of a name the one in the same file counts, else the smallest id. symbols: id, name, file, in_degree, rank.
    """
    own = symbols.select(F.col("name"), F.col("file").alias("_f"), F.struct("id", "in_degree", "rank").alias("_s"))
    hits = results.join(own, "name", "left")
    best = hits.groupBy(*results.columns).agg(F.min_by("_s", F.struct((F.col("_f") != F.col("file")).cast("int"), F.col("_s.id"))).alias("_s"))
    unused = (F.col("_s.in_degree") == 0) & (F.col("_s.rank") < DEAD_RANK)
    return best.select(*[c for c in results.columns if c != "score"], F.when(unused, F.col("score") * DEAD_FACTOR).otherwise(F.col("score")).alias("score"))


def adaptive(results: DataFrame, boosts: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times the file's boost and the ratio of learned to default weight of the type; 1 where nothing was learned."""
    joined = results.join(F.broadcast(weights), "type", "left").join(boosts, "file", "left")
    ratio = F.coalesce(F.col("learned") / F.nullif("default", F.lit(0.0)), F.lit(1.0))
    return joined.select(*[c for c in results.columns if c != "score"], (F.col("score") * F.coalesce("boost", F.lit(1.0)) * ratio).alias("score"))


def context_share(df: DataFrame, section: str, shares: dict[str, float], budget: int, size: str, order: list[str]) -> DataFrame:
    """Rows that fit into their section's share of a budget, taken in order while the running sum stays within it."""
    pairs = [F.lit(x) for kv in shares.items() for x in kv]
    room = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(section)), F.lit(0.0)) * budget
    summed = running_sum(df, section, [F.col(o).asc() for o in order], size, "_cv_before")
    return summed.where(F.col("_cv_before") + F.col(size) <= room).select(*df.columns, (F.col("_cv_before") + F.col(size)).alias("used"))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash: the same rows for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows, each stratum by its share, at least one of each; by a seeded hash. ``key`` tells rows apart."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    placed = positions(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), stratum, ["_h", key])
    want = F.greatest(F.lit(1), F.ceil(F.col("_cv_n") * n / F.col("_t")))
    return placed.join(F.broadcast(total)).where(F.col("_cv_i") <= want).select(*df.columns)


def interleaved(df: DataFrame, key: str, size: Column, small: int = 2000, large: int = 10_000) -> DataFrame:
    """Rows with ``band`` and ``turn``: small, medium and large ones in turns, by key within each."""
    banded = df.withColumn("band", F.when(size < small, 0).when(size < large, 1).otherwise(2))
    return positions(banded, "band", [key]).withColumn("turn", F.col("_cv_i")).drop("_cv_i", "_cv_n")


def jaro_winkler(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    turns = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - turns) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def beta_draw(alpha: Column, beta: Column, seed: int, *key: Column) -> Column:
    """A seeded draw of each arm's Beta posterior, by the normal approximation with a hash-made quantile, clamped to [0, 1]."""
    mean = alpha / (alpha + beta)
    sd = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit((1 << 40) - 2)).cast("double") + 1) / float(1 << 40)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean + sd * normal_quantile(u)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, by a rational approximation good to 4.5e-4."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


SENSITIVE = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|credential|private[_-]?key)"


def redacted_map(m: Column) -> Column:
    """A map of strings with the values of sensitive keys blanked, and values that look like bearer tokens."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("[REDACTED]")).otherwise(F.regexp_replace(v, r"(?i)(bearer\s+)\S+", "$1[REDACTED]")))


def salvaged_json(text: Column) -> Column:
    """The first object or array of a model's answer: without fences, from the first to the last bracket; null if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def signature_likeness(a: Column, b: Column) -> Column:
    """Mean of the likeness of the numbers of parameters and the overlap of their names."""
    names = lambda s: F.filter(F.transform(F.split(F.regexp_extract(s, r"\(([^)]*)\)", 1), ","), lambda x: F.trim(F.regexp_extract(x, r"(\w+)", 1))), lambda x: x != "")
    x, y = names(a), names(b)
    most = F.greatest(F.size(x), F.size(y))
    counts = F.when(most == 0, 1.0).otherwise(F.least(F.size(x), F.size(y)) / most)
    union = F.size(F.array_union(x, y))
    return (counts + F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)) / 2


def weighted(parts: dict[str, float]) -> Column:
    """Sum of columns times weights; a null column counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()])


def normalised_overall(parts: dict[str, float]) -> Column:
    """Weighted mean over the columns that are not null."""
    known = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()])
    return F.when(known > 0, weighted(parts) / known)


def outcome_of(tools: Column, interventions: Column) -> Column:
    """How a session went: abandoned without tools, failure with more than an intervention for two tools, partial with any, else success."""
    return F.when(tools == 0, "abandoned").when(interventions * 2 > tools, "failure").when(interventions > 0, "partial").otherwise("success")


# Weights of the parts of a safety score, and the scores for a deployment and for a review.
SAFETY_WEIGHTS = {"red_team": 0.3, "blue_team": 0.35, "pattern": 0.2, "history": 0.15}
DEPLOY, REVIEW = 0.9, 0.7


def safety_decision(parts: dict[str, Column], worst: Column) -> Column:
    """struct(score, decision): weighted sum, absent parts as 0; with a part absent or a factor worse than -0.3 nothing is deployed unseen."""
    score = sum((w * F.coalesce(parts[n], F.lit(0.0)) for n, w in SAFETY_WEIGHTS.items()), F.lit(0.0))
    whole = reduce(lambda a, b: a & b, [parts[n].isNotNull() for n in SAFETY_WEIGHTS])
    alone = whole & ~F.coalesce(worst < -0.3, F.lit(False))
    return F.struct(score.alias("score"), F.when(alone & (score >= DEPLOY), "auto_deploy").when(score >= REVIEW, "human_review").otherwise("reject").alias("decision"))


def rollback_reason(z: Column, corrections_before: Column, corrections_now: Column, errors_before: Column, errors_now: Column) -> Column:
    """Why a deployment is taken back: an anomaly of 3 or more, 20 % more corrections, 30 % more errors; null if it stands."""
    more = lambda now, before, by: (before > 0) & (now > before * (1 + by))
    return F.when(z >= 3, "anomaly").when(more(corrections_now, corrections_before, 0.2), "corrections").when(more(errors_now, errors_before, 0.3), "errors")


def experiment_decision(improved: Column, regressed: Column, n: Column) -> Column:
    return F.when(regressed > 0, "rollback").when(improved >= 2, "graduate").when((improved == 1) | (n < 40), "extend").otherwise("continue")


def federated(local: DataFrame, packets: DataFrame, keep: float = 0.8, trust: float = 0.7) -> DataFrame:
    """(pattern, count): local counts blended with the mean of the trusted peers' counts; patterns known to peers only enter at their share.

    ``local``: pattern, count; ``packets``: peer, trust, pattern, count. Peers below ``trust`` are left out.
    """
    theirs = packets.where(F.col("trust") >= trust).groupBy("pattern").agg(F.avg("count").alias("theirs"))
    joined = local.join(theirs, "pattern", "full_outer")
    return joined.select("pattern", F.when(F.col("theirs").isNull(), F.col("count")).otherwise(keep * F.coalesce("count", F.lit(0)) + (1 - keep) * F.col("theirs")).alias("count"))


def rule_hits(df: DataFrame, text: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows with ``hits``, the names of the rules whose pattern a text matches, and ``danger``, their summed weights up to 1."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, (p, _) in rules.items()]), lambda x: x.isNotNull())
    danger = reduce(lambda a, b: a + b, [F.when(F.col(text).rlike(p), w).otherwise(0.0) for p, w in rules.values()])
    return df.withColumn("hits", hits).withColumn("danger", F.least(F.lit(1.0), danger))


def criteria(text: Column) -> Column:
    """struct(tokens, specific, instructive, repeated, score) of an instruction text: bands of length, lines with code or paths, imperatives, repeats."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.greatest(F.size(lines), F.lit(1))
    part = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))) / n
    tokens = F.ceil(F.length(text) / 4)
    specific, instructive = part(r"`[^`]+`|[\w-]+/[\w.-]+|\b\w+\(\)"), part(r"(?i)^\W*(always|never|use|avoid|prefer|do not|don't|must|run|add|keep|write|check)\b")
    repeated = F.size(lines) - F.size(F.array_distinct(lines))
    length = F.when(tokens < 50, 40).when(tokens <= 2000, 100).when(tokens <= 5000, 70).otherwise(30)
    score = F.greatest(F.lit(0.0), 0.4 * length + 30 * specific + 30 * instructive - 15 * repeated)
    return F.struct(tokens.alias("tokens"), specific.alias("specific"), instructive.alias("instructive"), repeated.alias("repeated"), score.alias("score"))


def expansion_lines(text: Column) -> Column:
    """array of struct(kind, value) of lines 'lex:', 'vec:' and 'hyde:' of a model's answer."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(lex|vec|hyde)\s*:\s*\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\w+)", 1).alias("kind"), F.trim(F.regexp_extract(x, r":\s*(.*)", 1)).alias("value")))
