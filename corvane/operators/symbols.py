"""Symbols of a code base: filters of a search, the surroundings of a symbol, maps of files and of what a question names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import top_per_group


def search_filter(
    language: str | None = None, path: str | None = None, types: list[str] | None = None, least_depth: int | None = None, most_depth: int | None = None,
    columns: tuple[str, str, str, str] = ("language", "file_path", "chunk_type", "depth"),
) -> Column:
    """The conditions that are given, all of them: equal language, a path that contains a text as it is, one of some types, a depth."""
    lang, file, kind, depth = (F.col(c) for c in columns)
    given = [
        lang == language if language is not None else None, file.contains(path) if path is not None else None, kind.isin(types) if types is not None else None,
        depth >= least_depth if least_depth is not None else None, depth <= most_depth if most_depth is not None else None,
    ]
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in given if c is not None], F.lit(True))


def context(edges: DataFrame, ranks: DataFrame, callers: int = 5, callees: int = 10) -> DataFrame:
    """(id, side, other, place): the highest ranked symbols that refer to each symbol, and those it refers to; distinct, loops left out."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    sides = links.select(F.col("dst").alias("id"), F.lit("caller").alias("side"), F.col("src").alias("other")).unionByName(links.select(F.col("src").alias("id"), F.lit("callee").alias("side"), F.col("dst").alias("other")))
    rated = sides.join(ranks.select(F.col("id").alias("other"), "rank"), "other").withColumn("g", F.struct("id", "side"))
    best = top_per_group(rated, "g", [F.desc("rank"), F.col("other")], max(callers, callees))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("rank"), "other")))  # ten rows a group
    return placed.where(F.col("place") <= F.when(F.col("side") == "caller", callers).otherwise(callees)).select("id", "side", "other", "place")


def file_map(symbols: DataFrame, budget: int = 2000, top: int = 5000, per_file: int = 20) -> DataFrame:
    """(file, importance, symbols, place, shown): files by the summed rank of the ``top`` symbols, as far as a budget of tokens goes.

    ``symbols``: id, file, rank, tokens. A file shows its ``per_file`` highest symbols; one that doesn't fit shows its header alone
    (a quarter of the length of its line), or nothing, and the next ones are tried. The fold runs over ``top`` rows at most.
    """
    best = symbols.orderBy(F.desc("rank"), "id").limit(top)
    placed = best.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("rank"), "id")))
    files = placed.groupBy("file").agg(F.sum("rank").alias("importance"), F.count(F.lit(1)).alias("symbols"), F.sum(F.when(F.col("n") <= per_file, F.col("tokens")).otherwise(0)).alias("tokens"))
    files = files.withColumn("head", F.ceil(F.length(F.concat("file", F.lit(": ("), F.col("symbols").cast("string"), F.lit(" symbols)"))) / 4))
    listed = files.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "file", "symbols", "tokens", "head"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("shown"))

    def step(acc: Column, x: Column) -> Column:
        whole, header = acc["used"] + x["tokens"] <= budget, acc["used"] + x["head"] < budget
        cost = F.when(whole, x["tokens"]).when(header, x["head"]).otherwise(0)
        return F.struct((acc["used"] + cost).cast("long").alias("used"), F.concat(acc["shown"], F.array(F.when(whole, "whole").when(header, "header").otherwise("none"))).alias("shown"))

    folded = listed.select(F.arrays_zip("rows", F.aggregate("rows", start, step)["shown"].alias("shown")).alias("z")).select(F.posexplode("z").alias("place", "z"))
    return folded.select(F.col("z.rows.file").alias("file"), (-F.col("z.rows.o")).alias("importance"), F.col("z.rows.symbols").alias("symbols"), (F.col("place") + 1).alias("place"), F.col("z.shown").alias("shown"))


def question_map(symbols: DataFrame, question: str, top: int = 50) -> DataFrame:
    """(id, relevance): per word of the question 10 points in the name, 5 in the signature and 3 in the path, times 1 + 100 ranks; the best ``top``."""
    words = [w for w in question.lower().split() if len(w) > 2]
    points = lambda c, n, w: F.when(F.coalesce(F.lower(c).contains(w), F.lit(False)), n).otherwise(0)
    total = sum((points(c, n, w) for w in words for c, n in (("name", 10), ("signature", 5), ("file", 3))), F.lit(0))
    scored = symbols.select("id", (total * (1 + 100 * F.col("rank"))).alias("relevance")).where("relevance > 0")
    return scored.orderBy(F.desc("relevance"), "id").limit(top)


def pooled_ranks(scores: DataFrame) -> DataFrame:
    """(model, queries, mean_rank, wins): every model's best place in the pool of each query, and its place among the models.

    ``scores``: query, model, item, score. Pools are bounded by the models times what each enters.
    """
    pool = scores.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "model", "item")))
    best = pool.groupBy("query", "model").agg(F.min("place").alias("best"))
    among = best.withColumn("among", F.row_number().over(Window.partitionBy("query").orderBy("best")))
    return among.groupBy("model").agg(F.count(F.lit(1)).alias("queries"), F.avg("best").alias("mean_rank"), F.count_if(F.col("among") == 1).alias("wins"))


def prefix_patterns(sequences: DataFrame, least: int, longest: int = 5) -> DataFrame:
    """(pattern, length, support): beginnings of sequences that at least ``least`` of them share. ``sequences``: entity, position from 1, item.

    Only the first ``longest`` events of an entity are put together.
    """
    heads = sequences.where(F.col("position") <= longest).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda x: x["item"]).alias("head"))
    cut = heads.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("head")), lambda n: F.slice("head", F.lit(1), n))).alias("p"))
    return cut.groupBy(F.array_join("p", ">").alias("pattern"), F.size("p").alias("length")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
