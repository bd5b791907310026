"""Text cut by lines, headings and sizes, with array expressions: no text leaves its row for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def line_parts(df: DataFrame, key: str, text: str, lines: int = 30, tail: int = 10) -> DataFrame:
    """(id, part, parts, first, last, content): parts of ``lines`` lines, from 1; a tail of fewer than ``tail`` joins the part before."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.split(F.col(text), "\n").alias("l"))
    whole, rest = F.floor(F.size("l") / lines), F.size("l") % lines
    count = F.greatest(F.lit(1), whole + F.when(rest >= tail, 1).otherwise(0)).cast("int")
    cut = rows.withColumn("parts", count).select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    first = (F.col("part") - 1) * lines + 1
    last = F.when(F.col("part") == F.col("parts"), F.size("l")).otherwise(F.col("part") * lines)
    return cut.select("id", "part", "parts", first.alias("first"), last.alias("last"), F.array_join(F.slice("l", first, last - first + 1), "\n").alias("content"))


def line_blocks(df: DataFrame, key: str, text: str, lines: int = 30, least: int = 200) -> DataFrame:
    """(id, first, last, content): blocks of ``lines`` lines, without those of fewer than ``least`` characters when trimmed."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.split(F.col(text), "\n").alias("l"))
    cut = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(lines))).alias("first"))
    last = F.least(F.col("first") + lines - 1, F.size("l"))
    out = cut.select("id", "first", last.alias("last"), F.array_join(F.slice("l", F.col("first"), F.lit(lines)), "\n").alias("content"))
    return out.where(F.length(F.trim("content")) >= least)


def heading_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, section, level, title, parent, content): sections of Markdown by headings; section 0 is what comes before the first.

    parent is the number of the nearest section above of a smaller level, null at the top. Headings in fences count as text.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n").alias("l"))
    fold = F.aggregate(
        "l", F.struct(F.lit(False).alias("fence"), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("title"), F.array().cast("array<string>").alias("body"))).alias("out")),
        lambda acc, x: F.when(
            ~acc["fence"] & x.rlike(r"^#{1,6}\s+\S"),
            F.struct(acc["fence"].alias("fence"), F.concat(acc["out"], F.array(F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(x, r"^#+\s+(.*?)\s*#*$", 1)).alias("title"), F.array().cast("array<string>").alias("body")))).alias("out")),
        ).otherwise(
            F.struct(
                F.when(x.rlike(r"^\s*(```|~~~)"), ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
                F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.transform(F.slice(acc["out"], -1, 1), lambda s: F.struct(s["level"].alias("level"), s["title"].alias("title"), F.concat(s["body"], F.array(x)).alias("body")))).alias("out"),
            )
        ),
    )
    sections = rows.select("id", fold["out"].alias("s")).select("id", "s", F.posexplode("s").alias("section", "own"))
    above = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"))), lambda x: (x["i"] < F.col("section")) & (x["level"] < F.col("own.level")) & (x["level"] > 0))
    return sections.select("id", "section", "own.level", "own.title", F.array_max(F.transform(above, lambda x: x["i"])).alias("parent"), F.array_join("own.body", "\n").alias("content"))


def packed_sections(df: DataFrame, key: str, order: str, content: str, target: int = 1500, most: int = 2500, least: int = 200) -> DataFrame:
    """(id, piece, content): a document's sections put together up to ``target`` characters; what stays under ``least`` joins the piece before.

    A section beyond ``most`` stands by itself. A document's sections are gathered, so a document must fit into a task.
    """
    rows = df.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"]).alias("c"))
    start = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    joins = lambda a, x: (F.size(a) > 0) & ((F.length(last(a)) + F.length(x) + 2 <= target) | ((F.length(x) < least) & (F.length(last(a)) + F.length(x) + 2 <= most)))
    folded = F.aggregate("c", start, lambda a, x: F.when(F.coalesce(joins(a, x), F.lit(False)), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a, F.lit(-1)), F.lit("\n\n"), x)))).otherwise(F.concat(a, F.array(x))))
    return rows.select("id", F.posexplode(folded).alias("piece", "content"))


def children(units: DataFrame) -> DataFrame:
    """units (id, parent, depth, ...) with the number of their children, the deepest first: the order of bottom-up summaries."""
    counts = units.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return units.join(counts, "id", "left").withColumn("children", F.coalesce("children", F.lit(0))).orderBy(F.desc("depth"), "id")
