"""Queries of text segmentation, packed documents and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking as C
from corvane.plans.registry import query
from corvane.session import shared_dir, table
from corvane.sources import files as S
from corvane.streaming import events as T


@query("""with r as (select doc_id as id, string_split(text, chr(10)) as l from documents where text is not null), c as (select id, l, greatest(1, len(l) // 30 + case when len(l) % 30 >= 10 then 1 else 0 end) as parts from r),
    p as (select id, l, parts, unnest(range(1, parts + 1)) as part from c) select id, part::int as part, parts::int as parts, ((part - 1) * 30 + 1)::int as first, (case when part = parts then len(l) else part * 30 end)::int as last from p""")
def line_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_parts(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("id", "part", "parts", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query("""with r as (select distinct id, string_split(content, chr(10)) as l from chunks where content is not null), c as (select id, l, unnest(range(1, len(l) + 1, 30)) as first from r)
    select id, first::int as first, least(first + 29, len(l))::int as last from c where len(trim(array_to_string(l[first:first + 29], chr(10)))) >= 200""")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.line_blocks(table(spark, d, "chunks").select("id", "content").distinct(), "id", "content")
    return rows.select("id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query()
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of manuals by headings; tested on planted cases."""
    docs = table(spark, d, "documents").where("source in ('readmes', 'docs_pages', 'adrs')")
    return C.heading_sections(docs, "doc_id", "text").select("id", "section", "level", "title", "parent", F.length("content").alias("size"))


@query("""select path, md5('<file path="' || replace(replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '">' || chr(10) || replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || chr(10) || '</file>') as digest
    from (select distinct file_path || '#' || start_line as path, content from chunks where file_path is not null and start_line is not null and content is not null)""")
def packed_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("file_path is not null and start_line is not null and content is not null")
    files = c.select(F.concat_ws("#", "file_path", F.col("start_line").cast("string")).alias("path"), "content").distinct()
    return S.packed(files).select("path", F.md5("block").alias("digest"))


@query("""with p as (select distinct string_split(file_path, '/') as p from chunks where file_path is not null), t as (select p, unnest(range(1, len(p) + 1)) as depth from p)
    select distinct array_to_string(p[1:depth - 1], '/') as folder, p[depth] as name, depth = len(p) as is_file, depth::int as depth from t""")
def path_tree(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    return S.tree(paths, "file_path").select("folder", "name", "is_file", F.col("depth").cast("int").alias("depth"))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, round(avg((event_type = 'error')::int), 6) as value, count(*) as samples from events group by 1 qualify row_number() over (order by day desc) > 1")
def streamed_metric_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily means by a stream over the event file, drained once into a table; the last day is still open."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}"
    windows = T.metric_windows(stream, "ts", (F.col("event_type") == "error").cast("int"), "1 day")
    q = windows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(windows.schema).parquet(f"{out}/rows")
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.round("value", 6).alias("value"), "samples")
