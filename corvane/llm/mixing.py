"""Sources mixed to target shares of all tokens, by Poisson replication.

A record is used k times: the inverse of a Poisson distribution, capped at the source's max_repeats, at a number u that the
seeded hash of its id gives it, one of BINS. The tokens of each source and bin are summed once; from these sums the mean of a
source's distribution is set so that the copies it gives come to the source's share of the mix. As u is fixed for a record, the
sum is a step function of the mean that grows by the records of one bin at a time, so a source misses its share by no more
than half the tokens of a bin, a record or so where it has fewer records than bins.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import TOKENIZER, with_tokens
from corvane.session import written

#: Numbers u that a record may have: (bin + 1/2) / BINS.
BINS = 1 << 14


def distribution(rate: float, cap: int) -> np.ndarray:
    """P(K <= k) for k = 0 .. cap - 1 of the Poisson distribution of this mean; by logarithms, so for any mean and cap."""
    if cap < 1:
        return np.zeros(0)
    if rate <= 0:
        return np.ones(cap)
    k = np.arange(cap, dtype=np.float64)
    steps = -rate + k * math.log(rate) - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1.0)))])
    return np.minimum(np.cumsum(np.exp(steps)), 1.0)


def times(rate: float, cap: int) -> np.ndarray:
    """How often a record of each bin is used: the inverse distribution at its u, ``cap`` at most."""
    u = (np.arange(BINS) + 0.5) / BINS
    return np.full(BINS, max(0, cap)) if math.isinf(rate) else np.searchsorted(distribution(rate, cap), u, side="right")


def fitted(tokens: np.ndarray, want: float, cap: int) -> np.ndarray:
    """Uses by bin of the mean whose copies come nearest to ``want`` tokens; ``tokens`` are the source's by bin."""
    most = times(math.inf, cap)
    if cap < 1 or want <= 0:
        return np.zeros(BINS, dtype=np.int64)
    if want >= tokens @ most:
        return most
    low, high = 0.0, 1.0
    while tokens @ times(high, cap) < want:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if tokens @ times(mid, cap) < want else (low, mid)
    below, above = times(low, cap), times(high, cap)
    return below if want - tokens @ below <= tokens @ above - want else above


def plan(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None) -> dict[str, tuple[float, int, bool]]:
    """(tokens wanted, cap, short) by source. ``total``: size of the mix in tokens; None: as large as the named sources together.

    A source is short if all its records at its cap are less than its share of the mix; it then gives these.
    """
    size = float(sum(tokens.get(s, 0) for s, _, _ in targets)) if total is None else float(total)
    want = {s: share * size for s, share, _ in targets}
    limit = {s: tokens.get(s, 0) * cap for s, _, cap in targets}
    return {s: (min(want[s], limit[s]), cap, limit[s] < want[s] or (share > 0 and not tokens.get(s))) for s, share, cap in targets}


def sized(df: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """One row per document id: doc, source, tokens (of repeated ids the smallest source, the longest text)."""
    rows = with_tokens(df, doc_id, text, tokenizer, source).where(F.col(source).isNotNull())
    return written(rows.groupBy("doc").agg(F.min(source).alias("source"), F.max("tokens").alias("tokens")))


def _targets(targets: DataFrame, source: str, share: str, cap: str) -> list[tuple[str, float, int]]:
    rows = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(share), F.max(cap)).collect()  # bounded: one row per source named
    return sorted((r[0], float(r[1] or 0), max(0, int(r[2] if r[2] is not None else 1))) for r in rows)


def _drawn(rows: DataFrame, goal: list[tuple[str, float, int]], total: float | None, seed: int) -> tuple[DataFrame, dict[str, tuple[float, int, bool]], dict[str, int]]:
    """Records with their bin and uses (doc, source, tokens, times), the plan, and the tokens of each source."""
    own = rows.where((F.col("tokens") > 0) & F.col("source").isin([g[0] for g in goal])).withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(BINS)).cast("int"))
    by = {g[0]: np.zeros(BINS) for g in goal}
    for r in own.groupBy("source", "bin").agg(F.sum("tokens").alias("t")).collect():  # bounded: BINS rows for each source named
        by[r[0]][r[1]] = r[2]
    have = {s: int(t.sum()) for s, t in by.items()}
    rates = plan(goal, have, total)
    uses = [(s, b, int(n)) for s, (want, cap, _) in rates.items() for b, n in enumerate(fitted(by[s], want, cap)) if n and by[s][b]]
    table = rows.sparkSession.createDataFrame(uses, "source string, bin int, times int")
    return own.join(F.broadcast(table), ["source", "bin"]).select("doc", "source", "tokens", "times"), rates, have


def mix(
    df: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", cap: str = "max_repeats",
    total: float | None = None, seed: int = 11, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(doc, source, copy, tokens, shuffle_key) in the order of shuffle_key: every use of every record.

    Sources without a target stay out, as do null ids, texts and sources; a target without documents gives no row. A null
    share counts as 0, a null cap as 1. No record is used more than its source's cap. Blank texts have no tokens and are never used.
    The same seed gives the same mix. An empty table gives an empty result. Other columns play no part.
    """
    used, _, _ = _drawn(sized(df, doc_id, text, source, tokenizer), _targets(targets, source, share, cap), total, seed)
    copies = used.select("doc", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "tokens")
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc", "copy")).orderBy("shuffle_key", "doc", "copy")


def share_report(
    df: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", cap: str = "max_repeats",
    total: float | None = None, seed: int = 11, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Per target source: target_share, max_repeats, available, wanted and used tokens, records used, most uses of a record, share of the mix reached, short.

    short: its records at the cap of repeats don't reach its share of the mix (also where there are none). The others then
    have more than their share of what came together, and just their share of the size that was planned.
    """
    goal = _targets(targets, source, share, cap)
    used, rates, have = _drawn(sized(df, doc_id, text, source, tokenizer), goal, total, seed)
    per = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.count(F.lit(1)).alias("records"), F.max("times").alias("most_uses"))
    size = "source string, target_share double, max_repeats int, available_tokens long, wanted_tokens long, short boolean"
    share_of = {s: t for s, t, _ in goal}
    planned = df.sparkSession.createDataFrame([(s, share_of[s], c, have[s], round(share_of[s] * (sum(have.values()) if total is None else total)), short) for s, (_, c, short) in rates.items()], size)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = planned.join(per, "source", "left")
    every = per.agg(F.sum("used_tokens").alias("all_tokens"))
    return rows.join(F.broadcast(every)).select(
        "source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", zero("used_tokens"), zero("records"), zero("most_uses"),
        F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share_reached"), "short",
    )
