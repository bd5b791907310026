"""Ranked retrieval: exact vector top-k, BM25, reciprocal rank fusion and what follows it.

Every ranking has a total order: score descending, then id ascending. Filters are applied before ranking. A ranked list is a
DataFrame (id, rank, score) with rank from 1; lists are small (k rows), so that fusion never shuffles the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ascii_words
from corvane.session import written

RRF_K = 60
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.6, 0.4
UNKNOWN_TYPE, TEST_FACTOR = 0.1, 0.3

# Weights of document types by use case, where a type that is not named has UNKNOWN_TYPE.
TYPE_WEIGHTS = {
    "fim": {"code_chunk": 0.40, "symbol_summary": 0.08, "idiom": 0.12, "usage_example": 0.20, "framework_doc": 0.07, "best_practice": 0.03, "api_reference": 0.10, "session_observation": 0.05},
    "search": {"code_chunk": 0.15, "file_summary": 0.20, "symbol_summary": 0.20, "idiom": 0.12, "usage_example": 0.08, "anti_pattern": 0.05, "framework_doc": 0.10, "best_practice": 0.05, "api_reference": 0.05, "session_observation": 0.20},
    "navigation": {"code_chunk": 0.15, "file_summary": 0.25, "symbol_summary": 0.28, "idiom": 0.08, "project_doc": 0.04, "framework_doc": 0.10, "best_practice": 0.02, "api_reference": 0.08, "session_observation": 0.15},
}
# Weights of search backends.
BACKEND_WEIGHTS = {"symbol-graph": 1.2, "lsp": 1.5, "tree-sitter": 1.1, "semantic": 1.0, "location": 0.9}


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; 0 where a length is 0, null where the sizes differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda p: p * p), F.lit(0.0), add))
    size = norm(x) * norm(y)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(size == 0, F.lit(0.0)).otherwise(dot / size)


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ranked(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their rank. The limit comes first, so that the window sees k rows only."""
    top = df.orderBy(F.desc(score), F.asc(key)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def vector_topk(df: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, score, rank): the k vectors nearest to one query by cosine. The query is part of the plan; nothing is joined."""
    scored = df.select(F.col(key).alias("id"), cosine(F.col(vector), literal_vector(query)).alias("score")).where("score is not null")
    return ranked(scored, k)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, tf, length): the inverted index. Words are lower-case runs of a-z and 0-9."""
    words = df.select(F.col(key).alias("id"), ascii_words(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


class KeywordIndex:
    """Postings written once, in folders by a hash of the term and sorted by term within; a query reads only what its terms ask for."""

    FOLDERS = 64

    def __init__(self, df: DataFrame, key: str, text: str):
        lengths = df.where(F.col(text).isNotNull()).select(F.size(ascii_words(F.col(text))).alias("length"))
        self.rows, self.mean = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
        listed = postings(df.where(F.col(text).isNotNull()), key, text).withColumn("folder", self._folder(F.col("term")))
        # A folder is split where the corpus is large, so that no frequent term is one task or one file.
        split = F.pmod(F.xxhash64("id"), F.lit(1 + (self.rows or 0) // 500_000))
        self.postings = written(listed.repartition("folder", split).sortWithinPartitions("folder", "term"), "folder")
        self.key_type = dict(self.postings.dtypes)["id"]

    def _folder(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.FOLDERS)).cast("int")

    def search(self, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score, rank) by BM25. Folders are pruned, terms pushed down; scores are summed by id, map side first."""
        spark, own = self.postings.sparkSession, list(dict.fromkeys(t.lower() for t in terms))
        if not own or not self.rows:
            return spark.createDataFrame([], f"id {self.key_type}, score double, rank int")
        folders = [r[0] for r in spark.createDataFrame([(t,) for t in own], "term string").select(self._folder(F.col("term"))).collect()]
        hits = self.postings.where(F.col("folder").isin(folders) & F.col("term").isin(own))
        df = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row for each term of the query
        idf = F.log(1 + (self.rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / self.mean))
        return ranked(hits.join(df, "term").groupBy("id").agg(F.sum(part).alias("score")), k)


def bm25(df: DataFrame, terms: list[str], k: int, key: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, rank) by BM25 for a few query terms, in one pass over the corpus.

    Term counts come from array filters instead of an explode: the corpus is not shuffled, only document counts are summed.
    """
    own = list(dict.fromkeys(t.lower() for t in terms))
    equals = lambda t: lambda x: x == F.lit(t)
    words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), ascii_words(F.col(text)).alias("w"))
    counts = words.select("id", F.size("w").alias("length"), *[F.size(F.filter("w", equals(t))).alias(f"tf{i}") for i, t in enumerate(own)])
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(own))])
    hit = reduce(lambda a, c: a | c, [F.col(f"tf{i}") > 0 for i in range(len(own))])
    joined = counts.where(hit).join(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    return ranked(joined.select("id", reduce(lambda a, c: a + c, [part(i) for i in range(len(own))]).alias("score")), k)


def rrf(lists: Mapping[str, DataFrame], weights: Mapping[str, float], k: int = RRF_K) -> DataFrame:
    """(id, score, <list>_rank...): sum of weight / (k + rank) over ranked lists; rank from 1."""
    parts = [df.select("id", (F.lit(float(weights[n])) / (k + F.col("rank"))).alias("part"), F.lit(n).alias("list"), "rank") for n, df in lists.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.sum("part").alias("score"), *[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists])


def type_weight(kind: Column, use_case: str) -> Column:
    known = TYPE_WEIGHTS.get(use_case, {})
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(UNKNOWN_TYPE)) if pairs else F.lit(UNKNOWN_TYPE)


def type_aware(fused: DataFrame, rows: DataFrame, weight: Column, is_test: Column | None = None, tests: str = "downrank") -> DataFrame:
    """Fused scores times the weight of the row's type, and of test files: kept, downranked or left out (their ranks stay taken)."""
    out = fused.join(rows, "id")
    score = F.col("score") * weight
    if is_test is not None and tests == "downrank":
        score = score * F.when(is_test, TEST_FACTOR).otherwise(1.0)
    if is_test is not None and tests == "exclude":
        out = out.where(~is_test)
    return out.withColumn("score", score)


def over_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores of a short list divided by its largest."""
    return df.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy()))


def hybrid(vector_list: DataFrame, keyword_list: DataFrame, rows: DataFrame, weight: Column, k: int, is_test: Column | None = None, tests: str = "downrank") -> DataFrame:
    """Vector and keyword lists fused, weighted by type, cut to k and scaled to the best."""
    fused = rrf({"vector": vector_list, "keyword": keyword_list}, {"vector": VECTOR_WEIGHT, "keyword": KEYWORD_WEIGHT})
    return over_max(ranked(type_aware(fused, rows, weight, is_test, tests), k))


def min_max(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Scores of each list scaled to [0, 1]; a single or constant list gets 1."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))


def overlay(cloud: DataFrame, local: DataFrame, dirty: DataFrame, path: str, k: int, key: str = "id") -> DataFrame:
    """Remote results without locally changed paths, and local ones, each scaled on its own; the k best of both."""
    clean = cloud.join(dirty.select(path).distinct(), path, "left_anti").withColumn("origin", F.lit("cloud"))
    both = clean.unionByName(local.withColumn("origin", F.lit("local")))
    return ranked(min_max(both, "origin"), k, key=key)


def merge_backends(results: DataFrame, k: int = RRF_K) -> DataFrame:
    """(file, start_line, score, backends): sum of backend weight / (k + rank from 0); a definitive hit scores infinity.

    ``results``: backend, file, start_line, rank (from 0), definitive.
    """
    pairs = [F.lit(x) for kv in BACKEND_WEIGHTS.items() for x in kv]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("backend")), F.lit(1.0))
    merged = results.groupBy("file", "start_line").agg(
        F.sum(weight / (k + F.col("rank"))).alias("sum"), F.max("definitive").alias("definitive"), F.array_sort(F.collect_set("backend")).alias("backends"),
    )
    return merged.select("file", "start_line", F.when(F.col("definitive"), F.lit(float("inf"))).otherwise(F.col("sum")).alias("score"), "backends")


def rerank(df: DataFrame, rating: str = "rating", score: str = "score", least: float = 3.0) -> DataFrame:
    """0.3 of the score and 0.7 of a rating clamped to 0..10; ratings under ``least`` drop out, absent ones keep the score."""
    r = F.least(F.greatest(F.col(rating), F.lit(0.0)), F.lit(10.0))
    return df.where(F.col(rating).isNull() | (r >= least)).withColumn(score, F.when(F.col(rating).isNull(), F.col(score)).otherwise(0.3 * F.col(score) + 0.7 * r / 10))


def attach_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """chunks (id, ...) with the first-ranked summary that names them in source_ids; symbol summaries before file summaries."""
    order = F.struct((F.col("kind") != "symbol_summary").cast("int"), F.col("rank"), F.col("summary"))
    flat = summaries.select("kind", "rank", "summary", F.explode("source_ids").alias("id"))
    return chunks.join(flat.groupBy("id").agg(F.min_by("summary", order).alias("summary")), "id", "left")


def budget_fill(df: DataFrame, group: str, order: list[Column], size: str, budget: int, item: str) -> DataFrame:
    """(group, items, used): greedy fill in order that skips what doesn't fit and goes on. Groups must be bounded (top-k lists)."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(size).cast("long").alias("size"), F.col(item).alias("item")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(df.dtypes)[item]}>").alias("items"))
    fits = lambda acc, x: acc["used"] + x["size"] <= budget
    folded = F.aggregate("rows", start, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["items"], F.array(x["item"])).alias("items"))).otherwise(acc))
    return listed.select(group, folded.alias("f")).select(group, "f.items", "f.used")
