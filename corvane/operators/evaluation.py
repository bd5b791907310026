"""Retrieval metrics, tournaments, and statistical tests as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import running_sum


def normal_cdf(x: Column) -> Column:
    """Distribution function of the normal, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592
    erf = 1 - poly * t * F.exp(-z * z)
    return 0.5 * (1 + F.when(x < 0, -erf).otherwise(erf))


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def per_query(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query, rr, ndcg_k..., ndcg_ref_k..., recall_k..., hit_k...) for each query with relevant documents.

    ``results``: query, doc, rank from 1; ``relevant``: query, doc. ndcg is scaled by the ideal order of all relevant
    documents; ndcg_ref by 1, as some published figures are, so that it may exceed 1.
    """
    marked = results.join(relevant.select("query", "doc").distinct(), ["query", "doc"], "left_semi")
    gain = 1 / F.log2(F.col("rank") + 1)
    sums = [F.min("rank").alias("first")]
    for k in ks:
        sums += [F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}"), F.sum((F.col("rank") <= k).cast("long")).alias(f"in_{k}")]
    hits = marked.groupBy("query").agg(*sums)
    wanted = relevant.select("query", "doc").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    out = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
        dcg, found = F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)), F.coalesce(F.col(f"in_{k}"), F.lit(0))
        out += [(dcg / ideal).alias(f"ndcg_{k}"), dcg.alias(f"ndcg_ref_{k}"), (found / F.col("wanted")).alias(f"recall_{k}"), (found > 0).cast("int").alias(f"hit_{k}")]
    return wanted.join(hits, "query", "left").select("query", *out)


def tournament(pairs: DataFrame) -> DataFrame:
    """(model, wins, losses, ties, win_rate) from (model_a, model_b, winner A, B or tie); a tie is half a win."""
    side = lambda m, won: F.struct(F.col(m).alias("model"), (F.col("winner") == won).cast("int").alias("w"), ((F.col("winner") != won) & (F.col("winner") != "tie")).cast("int").alias("l"), (F.col("winner") == "tie").cast("int").alias("t"))
    flat = pairs.select(F.explode(F.array(side("model_a", "A"), side("model_b", "B"))).alias("s")).select("s.*")
    sums = flat.groupBy("model").agg(F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.sum("t").alias("ties"))
    return sums.withColumn("win_rate", (F.col("wins") + 0.5 * F.col("ties")) / (F.col("wins") + F.col("losses") + F.col("ties")))


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Population moments, quartiles and range of a column; null and NaN are left out."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    q = lambda p: F.percentile(x, F.lit(p))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), q(0.5).alias("median"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"),
        F.min(x).alias("low"), F.max(x).alias("high"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"),
    )


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_delta, t, p, d): paired test with a normal p value, and Cohen's d of the differences."""
    d = F.col(a) - F.col(b)
    rows = df.where(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("_s"))
    t = F.when(F.col("_s") > 0, F.col("mean_delta") / (F.col("_s") / F.sqrt("n")))
    return rows.select("n", "mean_delta", t.alias("t"), two_sided(t).alias("p"), F.when(F.col("_s") > 0, F.col("mean_delta") / F.col("_s")).alias("d"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, z, p): signed ranks with mean ranks for ties and continuity correction; zero differences are left out.

    Mean ranks come from a running sum of counts over the distinct differences, in range partitions.
    """
    d = F.col(a) - F.col(b)
    groups = df.select(d.alias("d")).where("d is not null and d <> 0").groupBy(F.abs("d").alias("x")).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    ranks = running_sum(groups.withColumn("e", F.lit(0)), "e", [F.col("x").asc()], "c", "before").withColumn("r", F.col("before") + (F.col("c") + 1) / 2)
    sums = ranks.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("plus")).alias("w_plus"), F.sum(F.col("r") * (F.col("c") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (w - n * (n + 1) / 4 + 0.5) / F.sqrt(var))
    return sums.select("n", "w_plus", "w_minus", z.alias("z"), two_sided(z).alias("p"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    left, right = rows.groupBy(F.col(a).alias("v")).agg(F.count(F.lit(1)).alias("x")), rows.groupBy(F.col(b).alias("v")).agg(F.count(F.lit(1)).alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    return total.join(F.broadcast(chance)).select("n", "observed", (F.col("xy") / (F.col("n") * F.col("n"))).alias("expected")).withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def proportion_test(df: DataFrame, group: str, hit: Column, control: str, treatment: str) -> DataFrame:
    """(n_control, n_treatment, p_control, p_treatment, z, p): two proportions, pooled; null where the pooled share is 0 or 1."""
    is_c, is_t = F.col(group) == control, F.col(group) == treatment
    n = lambda g: F.sum(g.cast("long"))
    rows = df.agg(n(is_c).alias("n_control"), n(is_t).alias("n_treatment"), (F.sum((is_c & hit).cast("long")) / n(is_c)).alias("p_control"), (F.sum((is_t & hit).cast("long")) / n(is_t)).alias("p_treatment"))
    nc, nt = F.col("n_control"), F.col("n_treatment")
    pool = (F.col("p_control") * nc + F.col("p_treatment") * nt) / (nc + nt)
    z = F.when((pool > 0) & (pool < 1), (F.col("p_treatment") - F.col("p_control")) / F.sqrt(pool * (1 - pool) * (1 / nc + 1 / nt)))
    return rows.withColumn("z", z).withColumn("p", two_sided(F.col("z")))


def bh_adjusted(df: DataFrame, p: str, key: str) -> DataFrame:
    """Rows with ``adjusted``: Benjamini-Hochberg, the running minimum of p * n / rank from the largest p down. For lists of tests."""
    order = Window.orderBy(p, key)
    rows = df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    low = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("adjusted", F.least(low, F.lit(1.0))).drop("_r", "_n")


def sample_size(base: float, effect: float, z_alpha: float = 1.96, z_power: float = 0.84) -> int:
    """Per group, to see ``effect`` (absolute) on a proportion of ``base``."""
    import math

    p1, p2 = base, base + effect
    mean = (p1 + p2) / 2
    top = (z_alpha * math.sqrt(2 * mean * (1 - mean)) + z_power * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2
    return math.ceil(top / effect**2)


def bootstrap_mean(df: DataFrame, x: str, key: str, rounds: int = 200, seed: int = 5) -> DataFrame:
    """(low, high): 95 % interval of the mean by Poisson bootstrap: each row takes part 0, 1, 2... times in each round by a seeded hash.

    One pass: per round a weighted sum, so that no resample is ever made.
    """
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), i, F.col(key)), F.lit(1 << 30)) / float(1 << 30))
    steps = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518]
    weight = lambda i: sum(((u(i) >= s).cast("int") for s in steps), F.lit(0))
    flat = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(key), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("i"))
    means = flat.withColumn("w", weight(F.col("i"))).groupBy("i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def mean_ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Rows with ``mean_rank``: rank by x within the group, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return df.withColumn("mean_rank", F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2)


def metric_series(df: DataFrame, time: str, value: Column, width: str, keep: int = 720) -> DataFrame:
    """(bucket, value, samples): tumbling means, the last ``keep`` buckets."""
    rows = df.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.avg(value).alias("value"), F.count(value).alias("samples"))
    return rows.select(F.col("w.start").alias("bucket"), "value", "samples").orderBy(F.desc("bucket")).limit(keep)


def anomalies(series: DataFrame, order: str, value: str, last: int = 30, least: int = 10, z: float = 2.5) -> DataFrame:
    """A short series with ``z_score`` against its last points, the current one included, and ``anomaly``."""
    w = Window.orderBy(order).rowsBetween(-(last - 1), 0)
    std, n = F.stddev_pop(value).over(w), F.count(value).over(w)
    score = F.when(std > 0, (F.col(value) - F.avg(value).over(w)) / std)
    return series.withColumn("z_score", score).withColumn("anomaly", F.coalesce((n >= least) & (F.abs(score) > z), F.lit(False)))


def trend(series: DataFrame, order: str, value: str, points: int = 7) -> DataFrame:
    """A short series with slope and r2 of a line through its last ``points`` points against their position."""
    w = Window.orderBy(order)
    rows = series.withColumn("_i", F.row_number().over(w).cast("double"))
    last = w.rowsBetween(-(points - 1), 0)
    return rows.withColumn("slope", F.regr_slope(value, "_i").over(last)).withColumn("r2", F.regr_r2(value, "_i").over(last)).drop("_i")
