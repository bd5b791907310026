"""Sources and sinks on files: trees of text, manifests, listings, patches, evaluation sets; packed documents and run files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import is_excluded, language_of, xml_escape

#: Endings that are never text.
BINARY = "png jpg jpeg gif bmp ico webp pdf zip gz tar bz2 xz 7z jar class so dll dylib exe o a bin wasm woff woff2 ttf eot mp3 mp4 avi mov sqlite db pyc parquet".split()


def walk(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, modified, content, language, binary) of all files below ``root``, without excluded directories."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.length(F.lit(root.rstrip("/"))) + 2
    bare = F.regexp_replace("path", r"^file:/*", "/")
    rows = files.select(F.substring(bare, base, F.length("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    ending = F.lower(F.substring_index("path", ".", -1))
    binary = ending.isin(BINARY) | (F.locate("00", F.hex(F.substring("content", 1, 4096))) > 0) & F.hex(F.substring("content", 1, 4096)).rlike("^(?:..)*?00")
    return rows.where(~is_excluded(F.col("path"))).select("*", language_of(F.col("path")).alias("language"), binary.alias("binary"))


def as_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def json_dependencies(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, name, version, dev) of package.json texts; broken ones give nothing."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = df.select(F.col(path).alias("path"), F.from_json(F.col(content), schema).alias("j"))
    part = lambda field, dev: parsed.select("path", F.explode(F.col(f"j.{field}")).alias("name", "version")).withColumn("dev", F.lit(dev))
    return part("dependencies", False).unionByName(part("devDependencies", True))


def line_dependencies(df: DataFrame, path: str, content: str, kind: str) -> DataFrame:
    """(path, name, version) of requirements, go.mod or Cargo texts, line by line."""
    pattern = {
        "requirements": r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===)\s*[^#;\s,]+)?",
        "gomod": r"^\s*(?:require\s+)?([\w.-]+\.[\w-]+(?:/[\w.-]+)*)\s+(v\S+)",
        "cargo": r"^\s*([A-Za-z][\w-]*)\s*=\s*(?:\{[^}]*version\s*=\s*)?\"([^\"]+)\"",
    }[kind]
    lines = df.select(F.col(path).alias("path"), F.explode(F.split(content, "\n")).alias("l"))
    if kind == "requirements":
        lines = lines.where(~F.col("l").rlike(r"^\s*(#|-|$)"))
    if kind == "cargo":
        lines = lines.where(~F.col("l").rlike(r"^\s*(name|version|edition|authors|license|description)\s*="))
    rows = lines.select("path", F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"))
    return rows.where("name <> ''").select("path", "name", F.nullif("version", F.lit("")).alias("version"))


def llms_links(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, section, title, url, note) of the link lists of llms.txt texts; links before any heading have a null section."""
    sections = df.select(F.col(path).alias("path"), F.explode(F.split(F.concat(F.lit("\n"), F.col(content)), r"\n(?=## )")).alias("s"))
    heads = sections.select("path", F.nullif(F.trim(F.regexp_extract("s", r"^## ([^\n]*)", 1)), F.lit("")).alias("section"), F.explode(F.split("s", "\n")).alias("l"))
    link = r"^\s*[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)(?::\s*(.*))?"
    rows = heads.where(F.col("l").rlike(link))
    return rows.select("path", "section", F.regexp_extract("l", link, 1).alias("title"), F.regexp_extract("l", link, 2).alias("url"), F.nullif(F.trim(F.regexp_extract("l", link, 3)), F.lit("")).alias("note"))


def name_status(df: DataFrame, text: str = "value") -> DataFrame:
    """(change, path, old_path) of lines of a name-status listing; other lines give nothing."""
    f = F.split(F.col(text), "\t")
    letter = F.substring(f[0], 1, 1)
    change = F.when(letter == "A", "added").when(letter.isin("M", "T"), "modified").when(letter == "D", "deleted").when(letter == "R", "renamed").when(letter == "C", "added")
    moved = letter.isin("R", "C")
    return df.where(F.col(text).rlike(r"^[AMTDRC]\d*\t")).select(change.alias("change"), F.when(moved, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), F.when(moved, F.get(f, F.lit(1))).alias("old_path"))


def porcelain(df: DataFrame, text: str = "value") -> DataFrame:
    """(change, path) of lines of a short status; untracked files are added."""
    code, rest = F.substring(F.col(text), 1, 2), F.regexp_replace(F.expr(f"substring({text}, 4)"), r'^"|"$', "")
    change = F.when(code == "??", "added").when(code.contains("D"), "deleted").when(code.contains("R"), "renamed").when(code.contains("A"), "added").when(code.rlike("[MTU]"), "modified")
    return df.where(F.col(text).rlike(r"^[ MTADRCU?!]{2} \S")).select(change.alias("change"), F.substring_index(rest, " -> ", -1).alias("path")).where("change is not null")


def patch_files(patch: Column) -> Column:
    """Distinct paths that a unified diff touches."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1)))


def evaluation_set(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (_id, title, text), queries (_id, text) and judgements (query, doc, relevance) of a folder in the usual layout."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string, routerLabel string").json(f"{root}/queries.jsonl")
    judged = spark.read.option("sep", "\t").option("header", "true").schema("query string, doc string, relevance int").csv(f"{root}/qrels")
    return corpus, queries, judged


def packed(files: DataFrame, style: str = "xml", path: str = "path", content: str = "content") -> DataFrame:
    """(path, block): one block of a packed document per file; written in order of path it is the document."""
    p, c = F.col(path), F.coalesce(F.col(content), F.lit(""))
    if style == "xml":
        block = F.concat(F.lit('<file path="'), xml_escape(p), F.lit('">\n'), xml_escape(c), F.lit("\n</file>"))
    elif style == "markdown":
        runs = F.transform(F.regexp_extract_all(c, F.lit("(`{3,})"), F.lit(1)), lambda x: F.length(x))
        fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
        block = F.concat(F.lit("## "), p, F.lit("\n\n"), fence, F.coalesce(language_of(p), F.lit("")), F.lit("\n"), c, F.lit("\n"), fence)
    else:
        block = F.concat(F.lit("==== "), p, F.lit(" ====\n"), c)
    return files.select(p.alias("path"), block.alias("block"))


def write_packed(blocks: DataFrame, to: str, parts: int = 1) -> None:
    """Blocks in order of path as text files; one part is one document, more parts are read in order of their names."""
    ranged = blocks.repartitionByRange(parts, "path") if parts > 1 else blocks.coalesce(1)
    ranged.sortWithinPartitions("path").select("block").write.mode("overwrite").text(to)


def run_lines(results: DataFrame, run: str) -> DataFrame:
    """Lines 'query Q0 doc rank score run' of ranked results (query, doc, rank, score)."""
    return results.select(F.concat_ws(" ", "query", F.lit("Q0"), "doc", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(run)).alias("value"))


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, name, is_file, depth, sort_key): every folder and file once; ordered by sort_key, folders come before files."""
    parts = F.split(F.col(path), "/")
    at = paths.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    is_file = F.col("depth") == F.size("p")
    own = F.slice("p", 1, F.col("depth"))
    marked = F.transform(own, lambda x, i: F.concat(F.when(is_file & (i == F.col("depth") - 1), "1").otherwise("0"), F.lower(x)))
    return at.select(F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("folder"), F.element_at(own, -1).alias("name"), is_file.alias("is_file"), "depth", F.array_join(marked, "\x01").alias("sort_key")).distinct()
