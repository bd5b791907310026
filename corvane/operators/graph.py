"""Reference graphs as DataFrames: vertices (id, ...), edges (src, dst). Iterations cut their lineage by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import bucketed, drop, written


def distinct_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges once each, both ends known; loops stay."""
    ids = vertices.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select("src", "dst").distinct()


def resolve_names(references: DataFrame, symbols: DataFrame, exported: str = "exported") -> DataFrame:
    """references (src, name, ...) with ``dst``: the smallest id of the exported symbols of that name, null if there is none."""
    target = symbols.where(F.col(exported)).groupBy("name").agg(F.min("id").alias("dst"))
    return references.join(target, "name", "left")


def degrees(vertices: DataFrame, references: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): counts of reference rows, 0 where there are none. Both directions in one aggregation."""
    ends = references.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return vertices.select("id").join(sums, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank), summing to 1: (1 - d) / n + d * sum(rank / out degree), ``rounds`` times; what vertices without edges hold is lost, then all is scaled.

    ``edges`` are distinct. They are written once, with the share of each, in buckets by src, and the vertices in as many by id; so
    a round shuffles only the sums by dst, at most a row for each vertex and task, whatever the number of edges. Every
    ``cut_every`` rounds the ranks, a row per vertex, are written and those before them deleted.
    """
    ids = bucketed(vertices.select("id").distinct(), "id")
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    edges = written(edges)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = bucketed(edges.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("share")), "src")
    ranks, last = ids.withColumn("rank", F.lit(1.0 / n)), None
    for i in range(1, rounds + 1):
        sent = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = ids.join(sent, ids["id"] == sent["dst"], "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % cut_every == 0:
            old, ranks = last, bucketed(ranks, "id")
            last = ranks
            if old is not None:
                drop(old)
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.join(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 10, backwards: bool = True) -> DataFrame:
    """(id, depth): everything that leads to ``starts`` (or follows from them) within ``depth`` steps, by the fewest steps; starts left out.

    Breadth first: each round joins only the newest frontier, and what was seen before is left out by an anti join.
    """
    step = written(edges.select(F.col("dst" if backwards else "src").alias("at"), F.col("src" if backwards else "dst").alias("id")).distinct())
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.select(F.col("id").alias("at")).join(step, "at").select("id").distinct().join(seen, "id", "left_anti")
        frontier = written(nxt.withColumn("depth", F.lit(d)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def callers(edges: DataFrame, ranks: DataFrame, target: str | int) -> DataFrame:
    """(id, rank): distinct sources of edges into ``target``."""
    return edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct().join(ranks, "id").select("id", "rank")


def dead(vertices: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int = 100, most: float = 0.001) -> DataFrame:
    """Vertices that nothing refers to, not exported, not tests, of a rank of ``most`` or less; the least ranked first."""
    unused = vertices.where("not exported and not is_test").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return unused.join(ranks, "id").where(F.col("rank") <= most).orderBy("rank", "id").limit(limit)


def untested(vertices: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int = 50, least: float = 0.01) -> DataFrame:
    """Vertices of a rank of ``least`` or more, not tests, without a caller that is one; the highest ranked first."""
    tests = vertices.where("is_test").select(F.col("id").alias("src"))
    tested = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return vertices.where("not is_test").join(tested, "id", "left_anti").join(ranks, "id").where(F.col("rank") >= least).orderBy(F.desc("rank"), "id").limit(limit)


def by_group(reached: DataFrame, vertices: DataFrame, group: str) -> DataFrame:
    """Per group: vertices reached, and the fewest steps."""
    return reached.join(vertices.select("id", group), "id").groupBy(group).agg(F.count(F.lit(1)).alias("reached"), F.min("depth").alias("nearest"))


def find_symbol(symbols: DataFrame, name: str, hint: str | None = None) -> DataFrame:
    """The one definition of a name: Class.member paths first, then the hinted file, exported, highest rank, smallest id.

    ``symbols``: id, name, parent_name, file, exported, rank.
    """
    member, parent = name.rsplit(".", 1)[-1], name.rsplit(".", 1)[0] if "." in name else None
    hits = symbols.where(F.col("name") == member)
    order = [F.desc(F.coalesce(F.col("parent_name") == parent, F.lit(False)))] if parent else []
    order += [F.desc(F.coalesce(F.col("file").contains(hint), F.lit(False)))] if hint else []
    return hits.orderBy(*order, F.desc("exported"), F.desc("rank"), F.asc("id")).limit(1)


def levels(items: DataFrame, needs: DataFrame, most: int = 32) -> DataFrame:
    """(id, level): longest chain of prerequisites below each item; 0 without any. ``needs``: (id, need), without cycles."""
    out = items.select("id").distinct().withColumn("level", F.lit(0))
    for _ in range(most):
        up = needs.join(out.select(F.col("id").alias("need"), "level"), "need").groupBy("id").agg((F.max("level") + 1).alias("up"))
        nxt = written(out.join(up, "id", "left").select("id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        changed = nxt.join(out.withColumnRenamed("level", "old"), "id").where("level <> old").limit(1).count()
        out = nxt
        if not changed:
            return out
    raise ValueError("needs has a cycle or is deeper than most")


def enclosing(points: DataFrame, spans: DataFrame, file: str = "file") -> DataFrame:
    """points (file, line, ...) with the id of the smallest span (file, first, last, id) that holds the line; null if none does.

    The range join is an equality on blocks of lines: a span is listed in each block of 64 lines it touches.
    """
    blocks = spans.select("*", F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor(F.col("last") / 64))).alias("_b"))
    keyed = points.select(file, "line").distinct().withColumn("_b", F.floor(F.col("line") / 64))
    hit = keyed.join(blocks, [file, "_b"]).where("line between first and last")
    best = hit.groupBy(file, "line").agg(F.min_by("id", F.struct(F.col("last") - F.col("first"), F.col("id"))).alias("inside"))
    return points.join(best, [file, "line"], "left")


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
