"""Queries on reference graphs. Customers order from suppliers: an edge from each customer to each supplier of its order lines.

A second graph is read from source: a chunk that calls a name refers to the chunk that defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.plans.registry import query
from corvane.session import table, written

_REFS = "refs as (select 'c' || o.o_custkey as src, 's' || l.l_suppkey as dst, l.l_orderkey as line from lineitem l join orders o on o.o_orderkey = l.l_orderkey)"
_V = "v as (select 'c' || c_custkey as id, c_acctbal > 0 as exported, c_mktsegment as file from customer union all select 's' || s_suppkey, s_acctbal > 0, 'suppliers' from supplier)"
_EDGES = f"{_REFS}, {_V}, edges as (select distinct src, dst from refs where src in (select id from v) and dst in (select id from v))"


def references(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_orderkey").alias("line"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("exported"), F.col("c_mktsegment").alias("file"))
    return c.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("exported"), F.lit("suppliers").alias("file")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_edges(references(spark, d), vertices(spark, d))


@query(f"with {_EDGES} select src, dst from edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"with {_REFS}, {_V}, e as (select id, 0 as i, 0 as o from v union all select dst, 1, 0 from refs union all select src, 0, 1 from refs) select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from e where id in (select id from v) group by id")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(vertices(spark, d), references(spark, d))


def _rank_sql(rounds: int = 20) -> str:
    """Chained rounds over edges both ways, so that rank flows in a circle."""
    parts = [f"with {_EDGES}, bidi as (select src, dst from edges union select dst, src from edges), n as (select count(*) as n from v), links as (select b.src, b.dst, 1.0::double / o.c as share from bidi b join (select src, count(*) as c from bidi group by 1) o using (src)), r0 as (select id, 1.0::double / n as rank from v, n)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} as materialized (select v.id, 0.15::double / n.n + 0.85::double * coalesce(s.got, 0) as rank from v cross join n left join (select l.dst, sum(l.share * r.rank) as got from links l join r{i - 1} r on r.id = l.src group by 1) s on s.dst = v.id)")
    return ", ".join(parts)


def both_ways(spark: SparkSession, d: str) -> DataFrame:
    e = written(edges(spark, d))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def ranks(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(vertices(spark, d), both_ways(spark, d))


@query(_rank_sql() + " select id, round(rank / (select sum(rank) from r20), 9) as rank from r20")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return ranks(spark, d).select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql() + " select file, round(sum(rank) / (select sum(rank) from r20), 8) as importance from r20 join v using (id) group by 1")
def file_importance(spark: SparkSession, d: str) -> DataFrame:
    joined = ranks(spark, d).join(vertices(spark, d), "id").groupBy("file").agg(F.sum("rank").alias("importance"))
    return joined.select("file", F.round("importance", 8).alias("importance"))


@query(_rank_sql() + " select v.id, round(rank / (select sum(rank) from r20), 9) as rank from r20 join v using (id) where not exported and id not in (select dst from edges) and rank / (select sum(rank) from r20) <= 0.001 order by rank, id limit 100")
def dead_vertices(spark: SparkSession, d: str) -> DataFrame:
    r = ranks(spark, d).withColumn("rank", F.col("rank"))
    found = G.dead(vertices(spark, d).withColumn("is_test", F.lit(False)), edges(spark, d), r)
    return found.select("id", F.round("rank", 9).alias("rank"))


@query(
    _rank_sql()
    + ", t as (select id, left(id, 1) = 'c' and substring(id, 2)::bigint % 7 = 0 as is_test from v) select id, round(rank / (select sum(rank) from r20), 9) as rank from r20 join t using (id) where not is_test and id not in (select dst from edges where src in (select id from t where is_test)) and rank / (select sum(rank) from r20) >= 0.0005"
)
def test_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh customer stands for a test."""
    is_test = (F.substring("id", 1, 1) == "c") & (F.expr("try_cast(substring(id, 2) as bigint)") % 7 == 0)
    found = G.untested(vertices(spark, d).withColumn("is_test", is_test), edges(spark, d), ranks(spark, d), limit=1_000_000, least=0.0005)
    return found.select("id", F.round("rank", 9).alias("rank"))


_CHAIN = "chain as (select distinct l_suppkey as src, l_partkey + 1000000 as dst from lineitem where l_returnflag = 'R' union select distinct l_partkey + 1000000, l_suppkey from lineitem where l_returnflag = 'A')"


@query(f"with recursive {_CHAIN}, walk(id, depth) as (select 3::bigint, 0 union select c.src, w.depth + 1 from walk w join chain c on c.dst = w.id where w.depth < 10) select id, min(depth) as depth from walk where id <> 3 group by id")
def impact(spark: SparkSession, d: str) -> DataFrame:
    """Everything that leads to one supplier: suppliers to parts over returned lines, parts to suppliers over accepted ones."""
    li = table(spark, d, "lineitem")
    part = F.col("l_partkey") + 1000000
    down = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), part.alias("dst"))
    up = li.where("l_returnflag = 'A'").select(part.alias("src"), F.col("l_suppkey").alias("dst"))
    start = spark.createDataFrame([(3,)], "id long")
    return G.reach(down.unionByName(up), start, 10).select("id", "depth")


@query(f"with {_EDGES} select distinct src as id from edges where dst = 's3'")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("dst = 's3'").select(F.col("src").alias("id")).distinct()


@query(r"""with sym as (select name, min(id) as dst from chunks where name is not null and chunk_type in ('function', 'class', 'shell-function', 'method') group by 1),
    calls as (select distinct id as src, unnest(regexp_extract_all(content, '\b([A-Za-z_]\w+)\s*\(', 1)) as name from chunks where content is not null and id is not null)
    select c.src, c.name, s.dst from calls c join sym s using (name) where c.src <> s.dst""")
def code_references(spark: SparkSession, d: str) -> DataFrame:
    """Calls by name in source text, resolved to the smallest id that defines the name. A textual approximation of a parser."""
    c = table(spark, d, "chunks")
    symbols = c.where("name is not null and chunk_type in ('function', 'class', 'shell-function', 'method')").select("id", "name", F.lit(True).alias("exported"))
    calls = c.where("content is not null and id is not null").select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w+)\s*\("), F.lit(1))).alias("name")).distinct()
    return G.resolve_names(calls, symbols).where("dst is not null and src <> dst").select("src", "name", "dst")


@query("""with spans as (select distinct id, file_path, start_line as a, coalesce(end_line, start_line + len(string_split(content, chr(10))) - 1) as b from chunks where file_path is not null and start_line is not null),
    points as (select distinct file_path, x::int as line from (select distinct file_path from chunks where file_path is not null), (select unnest([5, 40, 90]) as x)),
    hit as (select p.file_path, p.line, s.id, row_number() over (partition by p.file_path, p.line order by s.b - s.a, s.id) as r from points p left join spans s on s.file_path = p.file_path and p.line between s.a and s.b)
    select file_path as file, line, id as inside from hit where r = 1""")
def enclosing_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The smallest chunk that holds lines 5, 40 and 90 of each file."""
    c = table(spark, d, "chunks").where("file_path is not null and start_line is not null")
    last = F.coalesce("end_line", F.col("start_line") + F.size(F.split("content", "\n")) - 1)
    spans = c.select("id", F.col("file_path").alias("file"), F.col("start_line").alias("first"), last.alias("last")).distinct()
    points = table(spark, d, "chunks").where("file_path is not null").select(F.col("file_path").alias("file")).distinct().select("file", F.explode(F.array(F.lit(5), F.lit(40), F.lit(90))).alias("line"))
    return G.enclosing(points, spans).select("file", "line", "inside")


@query("""with recursive needs as (select p_partkey as id, p_partkey // 3 as need from part where p_partkey > 0), lv(id, level) as (select 0::bigint, 0 union all select n.id, l.level + 1 from needs n join lv l on l.id = n.need)
    select level, count(*) as n from lv group by 1""")
def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    """Parts stand for document types; each needs the part of a third of its number."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    needs = items.where("id > 0").select("id", F.expr("id div 3").alias("need"))
    return G.levels(items, needs).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select distinct id, name, file_path, chunk_type from chunks where name is not null and file_path is not null)
    select name, id from c qualify row_number() over (partition by name order by (chunk_type = 'class') desc, len(file_path), id) = 1""")
def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The one definition of every name: classes first, then the shortest path, then the smallest id."""
    c = table(spark, d, "chunks").where("name is not null and file_path is not null").select("id", "name", "file_path", "chunk_type").distinct()
    order = F.struct(F.col("chunk_type").isNull() | (F.col("chunk_type") != "class"), F.length("file_path"), F.col("id"))
    return c.groupBy("name").agg(F.min_by("id", order).alias("id"))


@query("with c as (select distinct id, name, file_path from chunks where name is not null and file_path is not null) select name, count(distinct file_path) as files, min(id) as first from c group by 1 having count(distinct file_path) > 1")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("name is not null and file_path is not null")
    return c.groupBy("name").agg(F.countDistinct("file_path").alias("files"), F.min("id").alias("first")).where("files > 1")
