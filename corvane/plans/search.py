"""Queries of the retrieval family: documents with the vectors of equal id stand for chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import INTENT_RULES, LANGUAGE_OF_TESTS, TEST_DIRS, TEST_FILES, content_id, entities, intent, is_test_path, language_of, normalised_query, query_hash, test_language, token_estimate
from corvane.operators import retrieval as R
from corvane.operators.events import positions
from corvane.plans.registry import query
from corvane.session import table, written

TERMS = ["grid", "report", "index", "schedule"]
# Stand-ins: which document type a source plays.
KINDS = {"readmes": "file_summary", "docs_pages": "framework_doc", "adrs": "best_practice", "issues": "session_observation", "commit_messages": "code_chunk", "review_comments": "idiom"}
_KIND_SQL = "case source " + " ".join(f"when '{s}' then '{k}'" for s, k in KINDS.items()) + " else 'project_doc' end"
_WEIGHT_SQL = f"case {_KIND_SQL} " + " ".join(f"when '{k}' then {w}" for k, w in R.TYPE_WEIGHTS["search"].items()) + " else 0.1 end"


def kind(source: Column) -> Column:
    pairs = [F.lit(x) for kv in KINDS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit("project_doc"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that belong to a document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(docs, "vec_id", "left_semi")


_INDEXES: dict[tuple, R.KeywordIndex] = {}


def keyword_index(spark: SparkSession, d: str) -> R.KeywordIndex:
    """The index of the documents, built once in a session for the same files."""
    docs = table(spark, d, "documents")
    at = (spark.sparkContext.applicationId, tuple(sorted(docs.inputFiles())))
    if at not in _INDEXES:
        _INDEXES[at] = R.KeywordIndex(docs, "doc_id", "text")
    return _INDEXES[at]


def _legs(spark: SparkSession, d: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    return R.vector_topk(_vectors(spark, d), _query_vector(spark, d), k, "vec_id", "embedding"), keyword_index(spark, d).search(TERMS, k)


_VECTOR = """vec as (select e.vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score
    from embeddings e join documents d on d.doc_id = e.vec_id, (select embedding from embeddings where vec_id = 0) q),
    vector_list as (select id, score, row_number() over (order by score desc, id) as rank from vec qualify rank <= 30)"""
_WORDS = "[w for w in string_split_regex(lower(text), '[^a-z0-9]+') if w <> '']"
_BM25 = (
    f"words as (select doc_id as id, {_WORDS} as w from documents where text is not null), counts as (select id, len(w) as length, "
    + ", ".join(f"len([x for x in w if x = '{t}']) as tf{i}" for i, t in enumerate(TERMS))
    + " from words), stats as (select count(*) as n, avg(length) as mean, "
    + ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(TERMS)))
    + " from counts), bm as (select id, "
    + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(TERMS)))
    + " as score from counts, stats where "
    + " or ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    + "), keyword_list as (select id, score, row_number() over (order by score desc, id) as rank from bm qualify rank <= 30)"
)
_FUSED = """fused as (select id, sum(p) as score, min(v) as vector_rank, min(k) as keyword_rank from (
    select id, 0.6 / (60 + rank) as p, rank as v, null as k from vector_list union all select id, 0.4 / (60 + rank), null, rank from keyword_list) group by id)"""


@query(f"with {_VECTOR} select id, round(score, 6) as score, rank from vector_list")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d)[0].select("id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_BM25} select id, round(score, 6) as score, rank from keyword_list")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d)[1].select("id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_VECTOR}, {_BM25}, {_FUSED} select id, round(score, 8) as score, vector_rank, keyword_rank from fused")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    v, b = _legs(spark, d)
    fused = R.rrf({"vector": v, "keyword": b}, {"vector": R.VECTOR_WEIGHT, "keyword": R.KEYWORD_WEIGHT})
    return fused.select("id", F.round("score", 8).alias("score"), "vector_rank", "keyword_rank")


@query(
    f"with {_VECTOR}, {_BM25}, {_FUSED}, weighted as (select id, d.source, score * {_WEIGHT_SQL} as score from fused join documents d on d.doc_id = id),"
    " best as (select *, row_number() over (order by score desc, id) as rank from weighted qualify rank <= 10)"
    " select id, source, round(score / max(score) over (), 6) as score, rank from best"
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    v, b = _legs(spark, d)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    best = R.hybrid(v, b, rows, R.type_weight(kind(F.col("source")), "search"), 10)
    return best.select("id", "source", F.round("score", 6).alias("score"), "rank")


@query(
    f"with {_VECTOR}, {_BM25}, {_FUSED}, rows as (select id, score * {_WEIGHT_SQL} * case when coalesce(lang, '') = 'de' then 0.3 else 1 end as score from fused join documents d on d.doc_id = id)"
    " select id, round(score, 8) as score from rows"
)
def hybrid_test_downrank(spark: SparkSession, d: str) -> DataFrame:
    """Rows in German stand for test files."""
    v, b = _legs(spark, d)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", (F.coalesce("lang", F.lit("")) == "de").alias("test"))
    fused = R.rrf({"vector": v, "keyword": b}, {"vector": R.VECTOR_WEIGHT, "keyword": R.KEYWORD_WEIGHT})
    out = R.type_aware(fused, rows, R.type_weight(kind(F.col("source")), "search"), F.col("test"))
    return out.select("id", F.round("score", 8).alias("score"))


@query(
    f"with {_VECTOR}, {_BM25}, clean as (select v.id, v.score from vector_list v join documents d on d.doc_id = v.id where coalesce(d.repo, '') not in (select coalesce(repo, '') from documents where source = 'adrs')),"
    " scaled as (select id, 'cloud' as origin, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end as score from clean"
    " union all select id, 'local', case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end from keyword_list)"
    " select id, origin, round(score, 6) as score from scaled"
)
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    v, b = _legs(spark, d)
    repo = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("repo", F.lit("")).alias("repo"))
    dirty = table(spark, d, "documents").where("source = 'adrs'").select(F.coalesce("repo", F.lit("")).alias("repo"))
    merged = R.overlay(v.drop("rank").join(repo, "id"), b.drop("rank").join(repo, "id"), dirty, "repo", 60)
    return merged.select("id", "origin", F.round("score", 6).alias("score"))


_BACKENDS = """lists as (select 'semantic' as backend, id, rank - 1 as rank from vector_list union all select 'location', id, rank - 1 from keyword_list union all
    select 'symbol-graph', doc_id, row_number() over (order by n_chars desc, doc_id) - 1 from documents qualify row_number() over (order by n_chars desc, doc_id) <= 20)"""


@query(
    f"with {_VECTOR}, {_BM25}, {_BACKENDS} select id as file, id % 7 as start_line, round(sum(case backend when 'symbol-graph' then 1.2 when 'location' then 0.9 else 1.0 end / (60 + rank)), 8) as score,"
    " array_to_string(list_sort(list(distinct backend)), ',') as backends from lists group by 1, 2"
)
def backend_merge(spark: SparkSession, d: str) -> DataFrame:
    v, b = _legs(spark, d)
    long = R.ranked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")), 20)
    rows = reduce(DataFrame.unionByName, [x.select(F.lit(n).alias("backend"), "id", (F.col("rank") - 1).alias("rank")) for n, x in (("semantic", v), ("location", b), ("symbol-graph", long))])
    merged = R.merge_backends(rows.select("backend", F.col("id").alias("file"), (F.col("id") % 7).alias("start_line"), "rank", F.lit(False).alias("definitive")))
    return merged.select("file", "start_line", F.round("score", 8).alias("score"), F.concat_ws(",", "backends").alias("backends"))


@query(f"with {_VECTOR} select id, round(case when id % 3 = 0 then score else 0.3 * score + 0.7 * least(id % 13, 10) / 10 end, 6) as score from vector_list where id % 3 = 0 or id % 13 >= 3")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """A rating that depends on the id stands for a model's."""
    rated = _legs(spark, d)[0].withColumn("rating", F.when(F.col("id") % 3 != 0, (F.col("id") % 13).cast("double")))
    return R.rerank(rated).select("id", F.round("score", 6).alias("score"))


@query("""with files as (select file_path, min(id) as id, list(distinct id) as ids from chunks where file_path is not null group by file_path),
    s as (select 'file_summary' as kind, row_number() over (order by file_path) as rank, 'file ' || file_path as summary, unnest(ids) as id from files
        union all select 'symbol_summary', row_number() over (order by id, start_line), 'symbol ' || name, id from (select distinct id, name, start_line from chunks where chunk_type = 'class' and name is not null)),
    first as (select id, arg_min(summary, (kind <> 'symbol_summary')::int * 1000000000 + rank) as summary from s group by id)
    select case when summary like 'symbol%' then 'symbol' when summary is null then 'none' else 'file' end as summary_kind, count(*) as n from (select distinct id from chunks) left join first using (id) group by 1""")
def summary_join(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    files = chunks.where("file_path is not null").groupBy("file_path").agg(F.collect_set("id").alias("source_ids"))
    per_file = files.select(F.lit("file_summary").alias("kind"), F.xxhash64("file_path").alias("rank"), F.concat(F.lit("file "), "file_path").alias("summary"), "source_ids")
    symbols = chunks.where("chunk_type = 'class' and name is not null").select("id", "name", "start_line").distinct()
    per_symbol = symbols.select(F.lit("symbol_summary").alias("kind"), F.xxhash64("id", "start_line").alias("rank"), F.concat(F.lit("symbol "), "name").alias("summary"), F.array("id").alias("source_ids"))
    joined = R.attach_summaries(chunks.select("id").distinct(), per_file.unionByName(per_symbol))
    label = F.when(F.col("summary").isNull(), "none").when(F.col("summary").startswith("symbol"), "symbol").otherwise("file")
    return joined.groupBy(label.alias("summary_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""select id, max(case when name ilike '%ledger%' then 1.0 when signature ilike '%ledger%' then 0.8 when content ilike '%ledger%' then 0.5 end)::double as score from chunks
    where name ilike '%ledger%' or signature ilike '%ledger%' or content ilike '%ledger%' group by id""")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains("ledger"), F.lit(False))
    score = F.when(has("name"), 1.0).when(has("signature"), 0.8).when(has("content"), 0.5)
    return table(spark, d, "chunks").select("id", score.alias("score")).where("score is not null").groupBy("id").agg(F.max("score").alias("score"))


_INTENT_SQL = "case " + " ".join(f"when {' or '.join(f"regexp_matches(trim(query), '{p}')" for p in ps)} then '{name}'" for name, _, ps in INTENT_RULES) + " else 'semantic' end"


@query(f"select category, {_INTENT_SQL} as intent, count(*) as n from queries where query is not null group by 1, 2")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "queries").where("query is not null").select("category", intent(F.col("query")).alias("i"))
    return rows.groupBy("category", F.col("i.intent").alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select entity, count(*) as n from (select unnest(list_distinct(regexp_extract_all(query, '\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b', 1) || regexp_extract_all(query, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)
    || regexp_extract_all(query, '\b([a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)\b', 1) || regexp_extract_all(query, '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b', 1) || regexp_extract_all(query, '([\w-]+(?:/[\w.-]+)+)', 1))) as entity
    from queries where query is not null) group by 1 having count(*) > 1""")
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "queries").where("query is not null").select(F.explode(entities(F.col("query"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_STOP = "'" + "','".join("a an the is are was were be been being have has had do does did will would could should may might must can of in to for with on at by from as into and or but not no if then else when where what which who how why this that these those it its".split()) + "'"


@query(f"select query_id, array_to_string(list_sort([w for w in string_split_regex(lower(query), '\\s+') if len(w) > 1 and w not in ({_STOP})]), ' ') as normalised from (select distinct query_id, query from queries where query is not null)")
def query_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("query is not null").select("query_id", "query").distinct().select("query_id", normalised_query(F.col("query")).alias("normalised"))


@query(f"select hash, count(*) as n from (select sha256(array_to_string(list_sort([w for w in string_split_regex(lower(query), '\\s+') if len(w) > 1 and w not in ({_STOP})]), ' '))[1:16] as hash from queries where query is not null) group by 1 having count(*) > 1")
def repeated_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "queries").where("query is not null").select(query_hash(F.col("query")).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_TEST_LANGUAGE_SQL = "case lower(regexp_extract(file_path, '[^.]*$')) " + " ".join(f"when '{e}' then '{n}'" for e, n in LANGUAGE_OF_TESTS.items()) + " end"
_TEST_SQL = " or ".join(f"(l = '{n}' and regexp_matches(file_path, '{p}'))" for rules in (TEST_FILES, TEST_DIRS) for n, p in rules.items())


@query(f"""select l as language, count(*) filter (where coalesce({_TEST_SQL}, false)) as tests, count(*) filter (where not coalesce({_TEST_SQL}, false)) as others
    from (select distinct file_path, {_TEST_LANGUAGE_SQL} as l from chunks where file_path is not null) group by 1""")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    marked = rows.select(test_language(F.col("file_path")).alias("language"), is_test_path(F.col("file_path")).alias("t"))
    return marked.groupBy("language").agg(F.count_if("t").alias("tests"), F.count_if(~F.col("t")).alias("others"))


@query("""select language_by_path, count(*) as files from (select distinct file_path, case lower(regexp_extract(file_path, '[^.]*$')) when 'py' then 'python' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'javascript'
    when 'mjs' then 'javascript' when 'jsx' then 'javascript' when 'go' then 'go' when 'rs' then 'rust' when 'sh' then 'shell' when 'bash' then 'shell' when 'sql' then 'sql' when 'yaml' then 'yaml' when 'yml' then 'yaml' when 'md' then 'markdown'
    when 'ini' then 'ini' when 'cfg' then 'ini' when 'env' then 'ini' when 'java' then 'java' end as language_by_path from chunks where file_path is not null) group by 1""")
def languages_by_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    return rows.groupBy(language_of(F.col("file_path")).alias("language_by_path")).agg(F.count(F.lit(1)).alias("files"))


@query("select id, sha256(file_path || ':' || start_line || ':' || content)[1:16] as digest from (select distinct id, file_path, start_line, content from chunks where file_path is not null and start_line is not null and content is not null)")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("file_path is not null and start_line is not null and content is not null").select("id", "file_path", "start_line", "content").distinct()
    return rows.select("id", content_id(F.col("file_path"), F.col("start_line"), F.col("content"), size=16).alias("digest"))


@query("""with c as (select id, min(language) as language, min(chunk_type) as chunk_type from chunks where language is not null and chunk_type is not null and id is not null group by id),
    o as (select *, row_number() over (partition by language, chunk_type order by sha256(id || '7'), id) - 1 as i, count(*) over (partition by language, chunk_type) as n from c)
    select t.id as target, x.id as distractor, k.turn from o t, (select unnest(range(1, 10)) as turn) k join o x on x.language = t.language and x.chunk_type = t.chunk_type and x.i = (t.i + k.turn) % t.n where k.turn < t.n""")
def distractors_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Nine others of the same language and type for every chunk, or as many as there are: those behind it on the ring of a seeded hash.

    Positions on the ring are running counts over blocks, so that a hot language and type is no single task; each target
    meets just its nine places.
    """
    c = table(spark, d, "chunks").where("language is not null and chunk_type is not null and id is not null").groupBy("id").agg(F.min("language").alias("language"), F.min("chunk_type").alias("chunk_type"))
    keyed = c.select("id", F.concat_ws("\n", "language", "chunk_type").alias("g"), F.sha2(F.concat("id", F.lit("7")), 256).alias("h"))
    ring = written(positions(keyed, "g", ["h", "id"]).select("id", "g", (F.col("_cv_i") - 1).alias("i"), F.col("_cv_n").alias("n")))
    asked = ring.select(F.col("id").alias("target"), "g", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("turn")).where("turn < n")
    places = asked.select("target", "g", F.expr("(i + turn) % n").alias("i"), "turn")
    return places.join(ring.select("g", "i", F.col("id").alias("distractor")), ["g", "i"]).select("target", "distractor", F.col("turn").cast("long").alias("turn"))
