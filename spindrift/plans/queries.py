"""The engine's operators bound to the driver's tables, and the same in SQL where SQL can express it.

Documents stand for files and chunks, embeddings for vectors, benchmark passages for keyword queries, parts for
symbols, and events for changes. Every query reads its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions.chunks import DECLARATIONS, MAX_UNIT_TOKENS
from ..operators import bm25, evaluation, fusion, metrics, symbols, tables, vector
from ..operators.chunking import chunk_files, units_of
from ..operators.embedding import HashProvider, embed
from ..schemas import CHUNKS
from ..shared import shared_dir
from ..sources.files import documents_as_files, gitignore_rules, without_ignored
from ..streaming import batch, live
from . import render
from .samples import code_files, files_sql, units_sql
from .store import ChunkStore, KeywordIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The SQL of searches rounds distances and scores to these digits before it ranks them.
_SQL_DIGITS = 6

# --- vectors

_ROWS = "SELECT vec_id, label, embedding FROM embeddings"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NEAR = f"""SELECT e.vec_id, e.label, round({_D2.format(a='e.embedding', b='q.embedding')}, 6) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


def _embeddings(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", "embedding")


def _first_vector(rows: DataFrame):
    return rows.orderBy("vec_id").select("embedding").first()["embedding"]


@query(f"SELECT vec_id, label, distance, round(1 / (1 + distance), 6) AS score FROM ({_NEAR}) ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark, d):
    rows = _embeddings(spark, d)
    found = vector.vector_topk(rows, _first_vector(rows), 10, "vec_id", "embedding", order_digits=_SQL_DIGITS)
    return found.select("vec_id", "label", "distance", "score")


@query(f"""SELECT e.vec_id, round(1 - {_DOT.format(a='e.embedding', b='q.embedding')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} *
  {_DOT.format(a='q.embedding', b='q.embedding')}), 6) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY distance, vec_id LIMIT 10""")
def vector_topk_cosine(spark, d):
    rows = _embeddings(spark, d)
    return vector.vector_topk(rows, _first_vector(rows), 10, "vec_id", "embedding", "cosine", order_digits=_SQL_DIGITS).select("vec_id", "distance")


_BATCH = f"""SELECT q.vec_id AS query_id, e.vec_id AS key, round({_D2.format(a='e.embedding', b='q.embedding')}, 6) AS distance
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"""
_BATCH_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM ({_BATCH})"""


def _batch(spark, d, k: int) -> DataFrame:
    """The stated query set of a search: the rows whose id is divisible by 100."""
    rows = _embeddings(spark, d)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.vector_topk_batch(rows, asked, k, "vec_id", "embedding", order_digits=_SQL_DIGITS)


@query(f"SELECT query_id, key, distance, round(1 / (1 + distance), 6) AS score, rank FROM ({_BATCH_RANKED}) WHERE rank <= 10")
def vector_topk_batch(spark, d):
    return _batch(spark, d, 10).select("query_id", "key", "distance", "score", "rank")


@query(f"""WITH cut AS (SELECT *, round(1 / (1 + distance), 6) AS score FROM ({_NEAR}) ORDER BY distance, vec_id LIMIT 15),
  best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM cut)
  SELECT vec_id, label, score FROM best WHERE n = 1 ORDER BY score DESC, vec_id LIMIT 5""")
def vector_unique_files(spark, d):
    rows = _embeddings(spark, d)
    near = vector.vector_topk(rows, _first_vector(rows), 15, "vec_id", "embedding", order_digits=_SQL_DIGITS)
    return vector.unique_files(near, 5, "label", key="vec_id").select("vec_id", "label", "score")


@query("""SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS d FROM embeddings)""")
def distance_score(spark, d):
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return _embeddings(spark, d).select("vec_id", F.round(X.distance_score(norm), 6).alias("score"))


# --- keywords

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_BM25 = f"""words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  lengths AS (SELECT doc_id, len(w)::BIGINT AS dl FROM words),
  stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
  posted AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY 1, 2),
  frequency AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
  scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN posted USING (term) JOIN frequency USING (term) JOIN lengths USING (doc_id), stats GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def _asked(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


@query(f"""WITH asked AS (SELECT 0 AS query_id, unnest(['the', 'hethnd', 'tionre']) AS term), {_BM25}
  SELECT doc_id, score, rank FROM ranked WHERE rank <= 10""")
def bm25_topk(spark, d):
    return bm25.bm25_search(_docs(spark, d), _asked(spark, "The hethnd TIONRE"), 10, "doc_id", "text", order_digits=_SQL_DIGITS).select("doc_id", "score", "rank")


def _chunks(spark, d) -> DataFrame:
    """Documents as chunk rows: one chunk for each file."""
    files = documents_as_files(_t(spark, d, "documents"))
    given = {"id": F.col("doc_id").cast("string"), "start_line": F.lit(1), "end_line": F.lit(1)}
    known = set(files.columns)
    names = [tuple(x.split()) for x in CHUNKS.split(", ")]
    return files.select(*((given[n] if n in given else F.col(n) if n in known else F.lit(None)).cast(t).alias(n) for n, t in names))


def _stored(spark, rows: DataFrame) -> ChunkStore:
    """A new store in the shared folder."""
    store = ChunkStore(spark, f"{shared_dir(spark)}/spindrift-{uuid.uuid4().hex}/chunks", buckets=16)
    store.append(rows)
    return store


_ITEMS = f"asked AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS term FROM benchmark)"


def _items(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_ITEMS}, {_BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_batch(spark, d):
    return bm25.bm25_search(_docs(spark, d), _items(spark, d), 5, "doc_id", "text", order_digits=_SQL_DIGITS).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_ITEMS}, {_BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_index_batch(spark, d):
    """From a stored keyword index of a stored table; ids are numbers in text, so ties go by their number."""
    store = _stored(spark, _chunks(spark, d))
    keywords = KeywordIndex(spark, f"{store.paths.root}/keywords")
    keywords.refresh(store)
    posted, lengths = (t.withColumn("doc_id", F.col("id").cast("long")) for t in keywords.tables())
    return bm25.bm25_search_index(posted, lengths, _items(spark, d), 5, "doc_id", order_digits=_SQL_DIGITS).select("query_id", "doc_id", "score", "rank")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1")
def term_stats(spark, d):
    return bm25.term_stats(bm25.postings(_docs(spark, d), "doc_id", "text"))


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS dl FROM documents")
def doc_lengths(spark, d):
    return bm25.doc_stats(_docs(spark, d), "doc_id", "text")


@query(f"SELECT count(*) AS n, round(avg(len({_WORDS})), 6) AS avgdl FROM documents")
def corpus_stats(spark, d):
    found = bm25.corpus_stats(bm25.doc_stats(_docs(spark, d), "doc_id", "text"))
    return found.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(r"""SELECT doc_id, translate(text, '+-&|!(){}[]^"~*?:\/', '                   ') AS escaped FROM documents""")
def query_escape(spark, d):
    return _docs(spark, d).select("doc_id", X.escape_query(F.col("text")).alias("escaped"))


# --- fusion

_BY_PRICE = "(SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)"
_BY_SIZE = "(SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part)"
_BY_NAME = "(SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_name, p_partkey) AS rank FROM part)"


def _part_lists(spark, d, lists: int) -> list[DataFrame]:
    """Whole ranked lists."""
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size", "p_name")
    orders = ([F.desc("p_retailprice"), "p_partkey"], [F.desc("p_size"), "p_partkey"], ["p_name", "p_partkey"])
    return [fusion.ranked_whole(part, o).select("p_partkey", "p_brand", "rank") for o in orders[:lists]]


def _fused_sql(key: str, *lists: tuple[str, float], k: int = 60, limit: int = 20) -> str:
    both = " UNION ALL ".join(f"SELECT {key}, {w} / ({k} + rank) AS part FROM {x}" for x, w in lists)
    return f"SELECT {key}, round(sum(part), 9) AS score FROM ({both}) GROUP BY 1 ORDER BY score DESC, {key} LIMIT {limit}"


@query(_fused_sql("p_partkey", (_BY_PRICE, 0.7), (_BY_SIZE, 0.3)))
def rrf_fuse(spark, d):
    a, b = _part_lists(spark, d, 2)
    return fusion.rrf_fuse([(a, 0.7), (b, 0.3)], ["p_partkey"], 20).select("p_partkey", "score")


@query(_fused_sql("p_partkey", (_BY_PRICE, 0.5), (_BY_SIZE, 0.3), (_BY_NAME, 0.2), k=10))
def rrf_three_lists(spark, d):
    a, b, c = _part_lists(spark, d, 3)
    return fusion.rrf_fuse([(a, 0.5), (b, 0.3), (c, 0.2)], ["p_partkey"], 20, k=10).select("p_partkey", "score")


@query(_fused_sql("p_brand", (_BY_PRICE, 0.7), (_BY_SIZE, 0.3)))
def rrf_repeated_keys(spark, d):
    a, b = (x.select("p_brand", "rank") for x in _part_lists(spark, d, 2))
    return fusion.rrf_fuse([(a, 0.7), (b, 0.3)], ["p_brand"], 20).select("p_brand", "score")


@query("SELECT round(0.7 / (60 + p_size) + 0.3 / (60 + p_partkey), 9) AS score, p_partkey FROM part")
def rrf_score(spark, d):
    given = F.array(*(F.struct(F.col(r).cast("long").alias("rank"), F.lit(w).alias("weight")) for r, w in (("p_size", 0.7), ("p_partkey", 0.3))))
    return _t(spark, d, "part").select(F.round(fusion.rrf_score(given), 9).alias("score"), "p_partkey")


@query(f"""WITH asked AS (SELECT 0 AS query_id, unnest(['the', 'of', 'hethnd']) AS term), {_BM25},
  v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({_NEAR})),
  fused AS (SELECT doc_id, 0.7 / (60 + rank) AS part FROM v WHERE rank <= 30 UNION ALL SELECT doc_id, 0.3 / (60 + rank) FROM ranked WHERE rank <= 30)
  SELECT doc_id, round(sum(part), 9) AS score FROM fused GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_topk(spark, d):
    rows = _embeddings(spark, d)
    near = vector.vector_topk(rows, _first_vector(rows), 30, "vec_id", "embedding", order_digits=_SQL_DIGITS).withColumnRenamed("vec_id", "doc_id")
    words = bm25.bm25_search(_docs(spark, d), _asked(spark, "the of hethnd"), 30, "doc_id", "text", order_digits=_SQL_DIGITS)
    lists = fusion.ranked(near, ["distance", "doc_id"]).select("doc_id", "rank"), words.select("doc_id", "rank")
    return fusion.hybrid(*lists, ["doc_id"], 10).select("doc_id", "score")


# --- symbols: parts by name, with their type as kind and brand as parent

_SYMBOLS = """(SELECT p_name AS name, p_type AS kind, p_brand || '/' || p_partkey || '.rs' AS file_path, p_size AS start_line, p_brand AS parent,
  CASE p_size % 3 WHEN 1 THEN 'public' WHEN 2 THEN 'private' END AS visibility FROM part)"""
_SYMBOL_COLUMNS = ("name", "kind", "file_path", "start_line", "score")


def _symbols(spark, d):
    part = _t(spark, d, "part")
    path = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".rs"))
    return part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("symbol_name"), F.col("p_type").alias("semantic_kind"), path.alias("file_path"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.lit(None).cast("string").alias("signature"),
        F.col("p_brand").alias("parent"), F.when(F.col("p_size") % 3 > 0, F.when(F.col("p_size") % 3 == 1, "public").otherwise("private")).alias("visibility"), F.lit("rust").alias("language"),
    ).transform(symbols.symbols)


def _name(sql: str) -> str:
    return f"SELECT name, kind, file_path, start_line, score FROM ({sql}) ORDER BY score DESC, name, file_path, start_line LIMIT 20"


@query(_name(f"SELECT *, 1.0::DOUBLE AS score FROM {_SYMBOLS} WHERE name = 'red widget'"))
def symbol_exact(spark, d):
    return symbols.find_symbol(_symbols(spark, d), "red widget", "exact").select(*_SYMBOL_COLUMNS)


@query(_name(f"SELECT *, 0.9::DOUBLE AS score FROM {_SYMBOLS} WHERE starts_with(lower(name), 're')"))
def symbol_prefix(spark, d):
    return symbols.find_symbol(_symbols(spark, d), "RE", "prefix").select(*_SYMBOL_COLUMNS)


@query(_name(f"SELECT *, 0.8::DOUBLE AS score FROM {_SYMBOLS} WHERE contains(lower(name), 'ring')"))
def symbol_contains(spark, d):
    return symbols.find_symbol(_symbols(spark, d), "RING", "contains").select(*_SYMBOL_COLUMNS)


@query(_name(f"SELECT *, round(1 / (1 + levenshtein(lower(name), 'red widgt')), 6)::DOUBLE AS score FROM {_SYMBOLS} WHERE levenshtein(lower(name), 'red widgt') <= 3"))
def symbol_fuzzy(spark, d):
    found = symbols.find_symbol(_symbols(spark, d), "red Widgt", "fuzzy", limit=None)
    rounded = found.withColumn("score", F.round("score", 6)).select(*_SYMBOL_COLUMNS)
    return rounded.orderBy(F.desc("score"), "name", "file_path", "start_line").limit(20)


@query(_name(f"SELECT *, 0.9::DOUBLE AS score FROM {_SYMBOLS} WHERE starts_with(lower(name), 's') AND lower(kind) = lower((SELECT min(p_type) FROM part))"))
def symbol_kind_filter(spark, d):
    kind = _t(spark, d, "part").agg(F.min("p_type")).first()[0]
    return symbols.find_symbol(_symbols(spark, d), "s", "prefix", kind=kind.upper()).select(*_SYMBOL_COLUMNS)


@query(_name(f"SELECT *, 0.9::DOUBLE AS score FROM {_SYMBOLS} WHERE starts_with(lower(name), 's') AND regexp_matches(file_path, '^Brand#1.*/.*7\\.rs$')"))
def symbol_glob(spark, d):
    return symbols.find_symbol(_symbols(spark, d), "s", "prefix", file_glob="Brand#1*/*7.rs").select(*_SYMBOL_COLUMNS)


@query(f"SELECT kind, count(*) OVER (PARTITION BY kind) AS of_kind, start_line, name, file_path FROM {_SYMBOLS}")
def list_symbols_grouped(spark, d):
    return symbols.by_kind(symbols.list_symbols(_symbols(spark, d))).select("kind", "of_kind", "start_line", "name", "file_path")


@query(f"SELECT name, kind, file_path, start_line FROM {_SYMBOLS} WHERE parent = (SELECT min(p_brand) FROM part)")
def list_symbols_of_parent(spark, d):
    least = _t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return symbols.list_symbols(_symbols(spark, d)).where(F.col("parent") == least).select("name", "kind", "file_path", "start_line")


@query(f"SELECT name, kind, file_path, start_line FROM {_SYMBOLS} WHERE visibility = 'public'")
def list_symbols_visible(spark, d):
    return symbols.list_symbols(_symbols(spark, d), visibility="PUBLIC").select("name", "kind", "file_path", "start_line")


@query(f"SELECT name, kind, file_path, start_line FROM {_SYMBOLS} WHERE kind IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part)")
def list_symbols_of_kinds(spark, d):
    ends = _t(spark, d, "part").agg(F.min("p_type"), F.max("p_type")).first()
    return symbols.list_symbols(_symbols(spark, d), kinds=[e.upper() for e in ends]).select("name", "kind", "file_path", "start_line")


@query(f"SELECT name, kind, file_path, start_line FROM {_SYMBOLS} WHERE file_path = (SELECT min(p_brand || '/' || p_partkey || '.rs') FROM part)")
def list_symbols_of_file(spark, d):
    path = _symbols(spark, d).agg(F.min("file_path")).first()[0]
    return symbols.list_symbols(_symbols(spark, d), path).select("name", "kind", "file_path", "start_line")


@query("SELECT count(*) AS symbols, count(DISTINCT p_name) AS names FROM part")
def symbol_count(spark, d):
    return symbols.count(_symbols(spark, d))


@query("SELECT count(*) AS total_references, count(DISTINCT p_brand) AS files_affected FROM part")
def files_affected(spark, d):
    return symbols.files_affected(_t(spark, d, "part").select(F.col("p_brand").alias("file_path")))


@query("SELECT DISTINCT p_type AS kind FROM part")
def symbol_kinds(spark, d):
    return symbols.kinds(_symbols(spark, d))


@query(f"SELECT name, file_path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line) AS n FROM {_SYMBOLS}) WHERE n = 1")
def first_definitions(spark, d):
    return symbols.first_definition(_symbols(spark, d)).select("name", "file_path", "start_line")


_FILES = "(SELECT doc_id, source || '/' || doc_id || '.' || lang AS file_path, text AS content, lang AS language, doc_id AS mtime FROM documents)"


def _files(spark, d):
    return documents_as_files(_t(spark, d, "documents"))


@query(f"""SELECT file_path, split_part(content, chr(10), 1) AS line_content FROM (
  SELECT * FROM {_FILES} WHERE regexp_matches(content, '(^|[^\\p{{L}}\\p{{N}}_])hethnd([^\\p{{L}}\\p{{N}}_]|$)') ORDER BY file_path LIMIT 50)""")
def find_references_text(spark, d):
    chunks = _files(spark, d).withColumn("start_line", F.lit(1))
    return symbols.references_text(chunks, "hethnd").select("file_path", "line_content")


@query(f"""SELECT file_path, line_content FROM (SELECT file_path, split_part(content, chr(10), 1) AS line_content, row_number() OVER (ORDER BY file_path) AS n
  FROM {_FILES} WHERE regexp_matches(content, '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)')) WHERE n BETWEEN 2 AND 50""")
def references_without_definition(spark, d):
    """The definition's file goes after the limit, so fewer than the limit are left."""
    chunks = _files(spark, d).withColumn("start_line", F.lit(1))
    first = symbols.references_text(chunks, "the", limit=1).first()["file_path"]
    return symbols.references_text(chunks, "the", first).select("file_path", "line_content")


@query(f"""SELECT f.file_path, v.distance, split_part(f.content, chr(10), 1) AS line_content
  FROM (SELECT * FROM ({_NEAR}) ORDER BY distance, vec_id LIMIT 50) v JOIN {_FILES} f ON f.doc_id = v.vec_id""")
def find_references_vector(spark, d):
    rows = _embeddings(spark, d)
    near = vector.vector_topk(rows, _first_vector(rows), 50, "vec_id", "embedding", order_digits=_SQL_DIGITS)
    hits = near.join(_files(spark, d), F.col("doc_id") == F.col("vec_id"))
    return symbols.references_vector(hits).select("file_path", "distance", "line_content")


# --- files and the table


@query(f"SELECT DISTINCT file_path FROM {_FILES}")
def list_files(spark, d):
    return tables.list_files(_files(spark, d))


@query(f"SELECT DISTINCT file_path FROM {_FILES} WHERE regexp_matches(file_path, '^src1.*/.*[0-4]\\.(de|.r)$') AND regexp_matches(file_path, '^src1.*/.*[0-4]\\.[df].$')")
def list_files_glob(spark, d):
    return tables.list_files(_files(spark, d), "src1*/*[0-4].[df]?")


@query("SELECT source AS file_path, max(doc_id) AS mtime FROM documents GROUP BY 1")
def file_max_mtime(spark, d):
    return tables.file_mtimes(_t(spark, d, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("mtime")))


@query("SELECT count(DISTINCT source) AS files, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes FROM documents")
def index_stats(spark, d):
    docs = _t(spark, d, "documents")
    counted = tables.counts(docs.select(F.col("source").alias("file_path")))
    size = docs.agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return counted.join(F.broadcast(size), F.lit(True))


@query(f"""WITH stored AS (SELECT file_path, max(CASE WHEN language = 'de' THEN mtime - 1 ELSE mtime END) AS stored FROM {_FILES} WHERE language <> 'fr' GROUP BY 1)
  SELECT file_path, mtime FROM {_FILES} LEFT JOIN stored USING (file_path) WHERE stored IS NULL OR mtime > stored""")
def changed_files(spark, d):
    files = _files(spark, d).select("file_path", "mtime", "language")
    stored = files.where("language <> 'fr'").withColumn("mtime", F.when(F.col("language") == "de", F.col("mtime") - 1).otherwise(F.col("mtime")))
    return tables.changed_files(files.select("file_path", "mtime"), stored)


@query(f"SELECT file_path FROM {_FILES} WHERE language = 'fr'")
def vanished_files(spark, d):
    files = _files(spark, d)
    return tables.vanished_files(files.where("language <> 'fr'"), files)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'F'""")
def upsert_snapshot(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), "o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return tables.replace_files(orders, new).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_file(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_linenumber")
    gone = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_path"))
    return tables.delete_files(lines, gone).withColumnRenamed("file_path", "l_orderkey")


@query(f"SELECT file_path FROM {_FILES} WHERE NOT (contains(file_path, 'src1') OR contains(file_path, '9.e'))")
def ignore_substring(spark, d):
    return _files(spark, d).where(~P.is_ignored(F.col("file_path"), ("src1", "9.e"))).select("file_path")


@query(f"SELECT file_path FROM {_FILES} WHERE NOT list_has_any(string_split(file_path, '/'), ['src1', '9.e'])")
def ignore_component(spark, d):
    return _files(spark, d).where(~P.is_ignored(F.col("file_path"), ("src1", "9.e"), "component")).select("file_path")


@query(f"SELECT file_path FROM {_FILES} WHERE regexp_extract(file_path, '[.]([^./]*)$', 1) IN ('en', 'fr')")
def extension_filter(spark, d):
    return _files(spark, d).where(P.has_extension(F.col("file_path"), ("en", "fr"))).select("file_path")



@query("""SELECT p_partkey, x AS ext, CASE x WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'h' THEN 'cpp' WHEN 'tsx' THEN 'typescript' ELSE x END AS language,
  CASE x WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' END AS unit_language,
  CASE x WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'h' THEN 'c' WHEN 'tsx' THEN 'tsx' END AS parser_language
  FROM (SELECT p_partkey, ['rs', 'py', 'h', 'tsx', 'hxy'][(p_partkey % 5 + 1)::INT] AS x FROM part)""")
def detect_language(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("rs", "py", "h", "tsx", "hxy"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return _t(spark, d, "part").select(
        "p_partkey", P.extension(path).alias("ext"), P.detect_language(path).alias("language"),
        P.detect_language(path, "unit").alias("unit_language"), P.detect_language(path, "parser").alias("parser_language"),
    )


# --- scalar functions

_LINES = "CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END"


@query(f"SELECT doc_id, array_to_string(({_LINES})[1:50], chr(10)) AS header FROM documents")
def file_header(spark, d):
    return _docs(spark, d).select("doc_id", X.file_header(F.col("text")).alias("header"))


@query(f"SELECT doc_id, len({_LINES})::BIGINT AS n_lines FROM documents")
def line_split(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"))


@query(f"""SELECT doc_id, array_to_string(list_transform(l[1:5], lambda x: '   ' || x), chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '   ...' ELSE '' END AS preview
  FROM (SELECT doc_id, {_LINES} AS l FROM documents)""")
def preview(spark, d):
    return _docs(spark, d).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, floor(strlen(text) / 4)::BIGINT AS tokens, ceil(strlen(text) / 4)::BIGINT AS billed FROM documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.billed_tokens(F.col("text")).alias("billed"))


@query(r"SELECT c_custkey, lower(regexp_replace(c_name || ' & ' || c_mktsegment, '[^\p{L}\p{N}_-]', '-', 'g')) AS name FROM customer")
def sanitize_name(spark, d):
    name = F.concat("c_name", F.lit(" & "), F.col("c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", X.sanitize_name(name).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0)
  WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE printf('%d B', b) END AS size FROM (SELECT o_orderkey, o_custkey * o_custkey * o_orderkey AS b FROM orders)""")
def human_bytes(spark, d):
    size = F.col("o_custkey") * F.col("o_custkey") * F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", X.human_bytes(size).alias("size"))


@query("""SELECT page_id, CASE WHEN length(url) <= 24 THEN url ELSE substr(url, 1, 21) || '...' END AS head,
  CASE WHEN length(url) <= 24 THEN url ELSE '...' || right(url, 21) END AS tail FROM pages""")
def truncated(spark, d):
    return _t(spark, d, "pages").select("page_id", X.truncate_end(F.col("url"), 24).alias("head"), X.truncate_start(F.col("url"), 24).alias("tail"))


@query("""SELECT p_partkey, levenshtein(p_name, 'small ring')::INTEGER AS edits, CASE WHEN levenshtein(p_name, 'small ring') <= 4 THEN levenshtein(p_name, 'small ring') ELSE -1 END::INTEGER AS near,
  round(1 / (1 + levenshtein(p_name, 'small ring')), 6) AS score FROM part""")
def edit_distance(spark, d):
    name, other = F.col("p_name"), F.lit("small ring")
    edits = X.edit_distance(name, other)
    return _t(spark, d, "part").select("p_partkey", edits.alias("edits"), X.edit_distance(name, other, 4).alias("near"), F.round(X.distance_score(edits), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100, 0) AS percent, round(l_tax * 100, 1) AS percent1 FROM lineitem")
def score_percent(spark, d):
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.score_percent(F.col("l_discount")).alias("percent"), X.score_percent(F.col("l_tax"), 1).alias("percent1")
    )


# --- reports


@query("""WITH e AS (SELECT event_type AS stage, 'u' || user_id || '/' || event_id AS path, event_type || ' ' || round(value, 2) AS error FROM events),
  n AS (SELECT stage, count(*) AS n FROM e GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY path, error) AS i FROM e)
  SELECT stage, n, path FROM f JOIN n USING (stage) WHERE i <= 5""")
def error_report_top5(spark, d):
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"))
    errors = _t(spark, d, "events").select(path.alias("path"), F.col("event_type").alias("stage"), F.col("props").alias("error"))
    return tables.error_report(errors).select("stage", "n", "path")


@query("SELECT sum(l_linenumber)::BIGINT AS l_linenumber, sum(l_suppkey)::BIGINT AS l_suppkey FROM lineitem")
def merged_stats(spark, d):
    return tables.merged_stats(_t(spark, d, "lineitem").select("l_linenumber", "l_suppkey"))


_IGNORE = "# written by hand\n*.fr\nsrc1*/\n!*.en\n/src2/*7.??\nsrc3/**\n!src3/*9.de\n"


@query(f"""SELECT file_path FROM {_FILES} WHERE NOT (file_path LIKE 'src1%/%' OR file_path LIKE 'src3/%' AND NOT regexp_matches(file_path, '9\\.de$|\\.en$|^$')
  AND NOT regexp_matches(file_path, '^src3/[^/]*9\\.de$') OR regexp_matches(file_path, '^src2/[^/]*7\\.[^/][^/]$')
  OR file_path LIKE '%.fr' OR regexp_matches(file_path, '^src3/.*\\.en$'))""")
def gitignore_filter(spark, d):
    return without_ignored(_files(spark, d).select("file_path"), gitignore_rules(_IGNORE))


_CHANGED_DOCS = """(SELECT doc_id, source || '/' || doc_id || '.' || lang AS file_path, CASE lang WHEN 'de' THEN 'changed hethnd ' || text ELSE text END AS text, lang
  FROM documents WHERE lang <> 'es')"""


def _changed_store(spark, d) -> tuple[ChunkStore, KeywordIndex, dict]:
    """A store of all documents but the French, with its keyword index; then the French come, the German change, the Spanish go."""
    rows = _chunks(spark, d)
    store = _stored(spark, rows.where("language <> 'fr'"))
    keywords = KeywordIndex(spark, f"{store.paths.root}/keywords")
    keywords.refresh(store)
    changed = rows.where("language in ('fr', 'de')").withColumn(
        "content", F.when(F.col("language") == "de", F.concat(F.lit("changed hethnd "), F.col("content"))).otherwise(F.col("content"))
    )
    counts = store.merge(changed, rows.where("language = 'es'"))
    keywords.refresh(store)
    return store, keywords, counts


@query(f"SELECT file_path, text AS content FROM {_CHANGED_DOCS}")
def store_changes(spark, d):
    store, _, _ = _changed_store(spark, d)
    return store.read(vectors=False).select("file_path", "content")


@query("""SELECT count(*) FILTER (lang IN ('fr', 'de')) AS created, count(*) FILTER (lang IN ('de', 'es')) AS removed, count(*) FILTER (lang <> 'es') AS stored FROM documents""")
def store_counts(spark, d):
    store, _, counts = _changed_store(spark, d)
    return spark.createDataFrame([(counts["created"], counts["removed"], store.count())], "created long, removed long, stored long")


@query(f"""WITH asked AS (SELECT 0 AS query_id, unnest(['hethnd', 'changed', 'the']) AS term), {_BM25.replace('FROM documents', f'FROM {_CHANGED_DOCS}')}
  SELECT doc_id, score, rank FROM ranked WHERE rank <= 20""")
def watch_then_bm25(spark, d):
    """Keyword search over an index that was refreshed after changes."""
    _, keywords, _ = _changed_store(spark, d)
    posted, lengths = (t.withColumn("doc_id", F.col("id").cast("long")) for t in keywords.tables())
    return bm25.bm25_search_index(posted, lengths, _asked(spark, "the changed hethnd"), 20, "doc_id", order_digits=_SQL_DIGITS).select("doc_id", "score", "rank")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE lang = 'en'")
def store_migrated(spark, d):
    """A table that was copied elsewhere, with what was deleted before; the first one is cleared."""
    store = _stored(spark, _chunks(spark, d))
    store.delete(_files(spark, d).where("language <> 'en'").select("file_path"))
    moved = store.migrate(f"{store.paths.root}-moved", keep=True)
    store.clear()
    left = store.count()
    return moved.read(vectors=False).agg((F.count(F.lit(1)) + left).alias("n"), F.countDistinct(F.substring_index("file_path", "/", 1)).alias("sources"))


@query(f"""SELECT '# 10 results for: x' || chr(10) || chr(10) || string_agg('## ' || n || '. ' || file_path || ':1-1 (' || printf('%.1f', 100.0 / n) || '%)' || chr(10) || '```' || chr(10) ||
  content || chr(10) || '```', chr(10) || chr(10) ORDER BY n) AS shown FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM {_FILES}) WHERE n <= 10""")
def render_results(spark, d):
    first = fusion.ranked(_files(spark, d).orderBy("doc_id").limit(10), ["doc_id"])
    hits = first.select("file_path", "content", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), (1 / F.col("rank")).alias("score"), "rank").orderBy("rank")
    return spark.createDataFrame([(render.search_results("x", hits),)], "shown string")


_BUCKETS = "[0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 'inf'::DOUBLE]"


@query(f"""WITH s AS (SELECT round(coalesce(sum(value), 0), 2) AS total, round(coalesce(avg(value), 0), 6) AS average FROM events),
  b AS (SELECT unnest({_BUCKETS})::DOUBLE AS le)
  SELECT le::VARCHAR AS le, (SELECT count(*) FROM events WHERE value / 100 <= le) AS n, total, average FROM b, s""")
def latency_histogram(spark, d):
    rows = _t(spark, d, "events").withColumn("seconds", F.col("value") / 100)
    found = metrics.histogram(rows, "seconds", metrics.BUCKETS["search_latency_seconds"])
    sums = rows.agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("average"))
    name = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return found.select(name.alias("le"), "n").join(F.broadcast(sums), F.lit(True))


# --- changes: events by user as path

_CHANGES = """(SELECT 'u' || user_id AS path, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'created'
  WHEN 'error' THEN 'deleted' ELSE 'renamed' END AS change_type, CASE WHEN event_type = 'purchase' THEN 'u' || (user_id + 1) END AS from_path, ts, event_id FROM events)"""


def _changes(spark, d):
    e = _t(spark, d, "events")
    kind = F.create_map(*map(F.lit, ("click", "modified", "view", "modified", "signup", "created", "error", "deleted", "purchase", "renamed")))
    path = lambda u: F.concat(F.lit("u"), u.cast("string"))
    return e.select(
        path(F.col("user_id")).alias("path"), kind[F.col("event_type")].alias("change_type"),
        F.when(F.col("event_type") == "purchase", path(F.col("user_id") + 1)).alias("from_path"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )


@query(f"""WITH c AS (SELECT * FROM {_CHANGES}), l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS n FROM c),
  away AS (SELECT DISTINCT l.path FROM l JOIN c ON c.from_path = l.path AND (c.ts, c.event_id) > (l.ts, l.event_id) WHERE n = 1)
  SELECT path, change_type, event_id FROM l WHERE n = 1 AND path NOT IN (SELECT path FROM away)""")
def change_last_per_path(spark, d):
    return batch.last_per_path(_changes(spark, d), "ts", "event_id").select("path", "change_type", "event_id")


@query(f"""WITH c AS (SELECT *, ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS gap FROM {_CHANGES}),
  s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM c)
  SELECT path, floor(epoch(min(ts)))::BIGINT AS started, floor(epoch(max(ts)))::BIGINT + 7200 AS ended, count(*) AS n FROM s GROUP BY path, burst""")
def change_debounce(spark, d):
    found = batch.debounced(_changes(spark, d), "2 hours")
    return found.select("path", F.unix_seconds("burst_start").alias("started"), F.unix_seconds("burst_end").alias("ended"), "n")


_RATES = """WITH s AS (SELECT floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY second RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM s)"""


@query(_RATES.format(w=600) + " SELECT second, n, recent, round(recent / 600, 6) AS rate FROM r")
def change_rate(spark, d):
    found = batch.rates(_changes(spark, d), 600)
    return found.select("second", "n", "recent", F.round("rate", 6).alias("rate"))


@query(_RATES.format(w=600).replace("sum(n)", "sum(CASE WHEN n >= 2 THEN 0 ELSE n END)") + """ SELECT second, n, CASE WHEN n >= 2 THEN 'threshold' ELSE 'rate' END AS reason FROM r
  WHERE n >= 2 OR recent / 600 >= 0.012""")
def mass_change(spark, d):
    return batch.mass_changes(_changes(spark, d), 2, 0.012, 600).select("second", "n", "reason")


@query(_RATES.format(w=7200) + " SELECT second, n, recent, round(recent / 7200, 6) AS rate FROM r")
def change_rate_long(spark, d):
    found = batch.rates(_changes(spark, d), 7200)
    return found.select("second", "n", "recent", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT unnest(range((epoch(ts)::BIGINT // 3600 - 1), epoch(ts)::BIGINT // 3600 + 1)) * 3600 AS started FROM (SELECT date_trunc('second', ts) AS ts FROM events))
  SELECT started, started + 7200 AS ended, count(*) AS n, round(count(*) / 7200, 9) AS rate FROM e GROUP BY 1""")
def windowed_rates(spark, d):
    found = live.windowed_rates(_changes(spark, d), window="2 hours", slide="1 hour")
    return found.select(F.unix_seconds("start").alias("started"), F.unix_seconds("end").alias("ended"), "n", F.round("rate", 9).alias("rate"))


_GIT = "['.git/HEAD', 'a/.git/refs/heads/x', '.git/MERGE_MSG', 'b/.git/rebase-apply/1', '.git/FETCH_HEAD', '.git/ORIG_HEAD', '.git/refs/stash', '.git/index', 'src/a.rs', 'x.git/HEAD']"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_GIT}[(event_id % 10 + 1)::INT] AS path FROM events),
  o AS (SELECT *, CASE WHEN NOT list_contains(string_split(path, '/'), '.git') THEN NULL
    WHEN contains(path, '.git/HEAD') OR contains(path, '.git/refs/heads') THEN 'checkout' WHEN contains(path, '.git/MERGE_HEAD') OR contains(path, '.git/MERGE_MSG') THEN 'merge'
    WHEN contains(path, '.git/rebase-merge') OR contains(path, '.git/rebase-apply') THEN 'rebase' WHEN contains(path, '.git/FETCH_HEAD') THEN 'pull'
    WHEN contains(path, '.git/ORIG_HEAD') THEN 'reset' WHEN contains(path, '.git/refs/stash') THEN 'stash' END AS op FROM e),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id, op IS NULL ORDER BY event_id) AS i FROM o),
  g AS (SELECT user_id, bool_or(list_contains(string_split(path, '/'), '.git')) AS is_git, max(CASE WHEN op IS NOT NULL AND i = 1 THEN op END) AS first,
    bool_or(path = '.git/index') AS idx FROM f GROUP BY 1),
  h AS (SELECT user_id, is_git, coalesce(first, CASE WHEN idx THEN 'checkout' END) AS operation FROM g)
  SELECT *, (CASE operation WHEN 'checkout' THEN 5000 WHEN 'merge' THEN 4000 WHEN 'rebase' THEN 6000 WHEN 'pull' THEN 5000 WHEN 'reset' THEN 3000
    WHEN 'stash' THEN 2000 ELSE 3000 END)::INTEGER AS delay_ms FROM h""")
def git_classify(spark, d):
    names = F.array(*(F.lit(x.strip(" '")) for x in _GIT.strip("[]").split(",")))
    changes = _t(spark, d, "events").select("user_id", "event_id", F.element_at(names, (F.col("event_id") % 10 + 1).cast("int")).alias("path"))
    return batch.git_batches(changes, ["user_id"], "event_id")


@query(f"SELECT event_id FROM (SELECT event_id, path || ['.rs', '.py', '.md', ''][(event_id % 4 + 1)::INT] AS path FROM {_CHANGES}) WHERE NOT contains(path, '7') AND regexp_matches(path, '\\.(rs|py)$')")
def watch_filter(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (".rs", ".py", ".md", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return batch.watched(_changes(spark, d).withColumn("path", F.concat("path", ends)), ("rs", "py"), ("7",)).select("event_id")


# --- evaluation: vectors of the query's own label are what a search should find


@query(f"""WITH hits AS (SELECT r.query_id, r.rank, r.key AS item, (e.label = q.label) AS hit FROM ({_BATCH_RANKED}) r JOIN embeddings e ON e.vec_id = r.key
    JOIN embeddings q ON q.vec_id = r.query_id WHERE r.rank <= 10),
  total AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 GROUP BY 1),
  m AS (SELECT query_id, count(*) FILTER (hit) / count(*) AS p, count(*) FILTER (hit) AS found, count(*) AS rows, min(rank) FILTER (hit) AS first,
    coalesce(sum(CASE WHEN rank = 1 THEN 1.0 ELSE 1 / log2(rank) END) FILTER (hit), 0) AS dcg FROM hits GROUP BY 1),
  x AS (SELECT m.*, found / n AS r, n FROM m JOIN total USING (query_id))
  SELECT query_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
    round(coalesce(1 / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, rows) + 1), lambda i: CASE WHEN i = 1 THEN 1.0 ELSE 1 / log2(i) END)), 6) AS ndcg FROM x""")
def eval_measures(spark, d):
    rows = _embeddings(spark, d)
    results = _batch(spark, d, 10).select("query_id", "rank", F.col("key").alias("item"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    totals = asked.join(rows.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("n_expected")), "wanted").select("query_id", "n_expected")
    judged = results.join(rows.select(F.col("vec_id").alias("item"), "label"), "item").join(asked, "query_id")
    return evaluation.measures(judged.select("query_id", "rank", "item", F.when(F.col("label") == F.col("wanted"), 1).alias("hit")), totals)


@query(f"""WITH hits AS (SELECT r.query_id, count(*) FILTER (e.label = q.label) / 10 AS p FROM ({_BATCH_RANKED}) r JOIN embeddings e ON e.vec_id = r.key
    JOIN embeddings q ON q.vec_id = r.query_id WHERE r.rank <= 10 GROUP BY 1) SELECT query_id, round(p, 6) AS "precision" FROM hits WHERE p < 0.3""")
def below_threshold(spark, d):
    measures = eval_measures(spark, d)
    least = measures.select("query_id", F.lit(0.3).alias("min_precision"), F.lit(0.0).alias("min_recall"))
    return evaluation.below_threshold(measures, least).select("query_id", "precision")


# --- chunking: the line chunker's loop as a recursive query


def _lines_sql(files: str, target: int, shared: int, origin: str = "") -> str:
    """CTEs up to ``pieces`` (file_path, language, first, last, content): pieces of ``target`` bytes that overlap by ``shared`` bytes."""
    declares = "|".join(x.replace(" ", "[ ]") for x in DECLARATIONS)
    blank = "regexp_matches(row, '^\\s*(\\}|\\};)?\\s*$')"
    step = f"""SELECT *, CASE WHEN filled < n AND near > start AND near >= filled - filled // 5 THEN near ELSE least(filled, n - 1) END AS last FROM (
      SELECT *, list_max(list_filter(good, lambda x: x <= filled)) AS near FROM (
        SELECT s.file_path, s.start, n, ends, good, content_rows, start + len(list_filter(ends[start + 2:], lambda x: x < ends[start + 1] + {max(target, 1)})) AS filled
        FROM {{}} s JOIN a USING (file_path)))"""
    content = "array_to_string(content_rows[start + 1:last + 1], chr(10))"
    first = f"len(list_filter(ends[1:last + 1], lambda x: x < ends[last + 2] - {shared} + 1)) - 1" if shared else "last"
    return f"""files AS (SELECT * FROM {files}),
  rows AS (SELECT file_path, unnest({_LINES.replace('text', 'content')}) AS row, unnest(range(len({_LINES.replace('text', 'content')}))) AS i FROM files),
  good AS (SELECT *, {blank} OR coalesce(regexp_matches(lead(row) OVER (PARTITION BY file_path ORDER BY i), '^\\s*({declares})\\s*\\S'), false) AS good,
    sum(strlen(row) + 1) OVER (PARTITION BY file_path ORDER BY i)::BIGINT AS e FROM rows),
  a AS (SELECT file_path, count(*) AS n, list_prepend(0::BIGINT, list(e ORDER BY i)) AS ends, coalesce(list(i ORDER BY i) FILTER (good), []) AS good, list(row ORDER BY i) AS content_rows
    FROM good GROUP BY 1),
  walk AS (SELECT file_path, 0::BIGINT AS start FROM a UNION ALL
    SELECT file_path, CASE WHEN following > start THEN following ELSE last + 1 END FROM (
      SELECT *, last + 1 - least(last + 1 - greatest({first}, 0), 5) AS following FROM ({step.format('walk')}) WHERE last < n - 1)),
  pieces AS (SELECT file_path, (start + 1)::INTEGER AS start_line, (last + 1)::INTEGER AS end_line, {content} AS content FROM ({step.format('walk')}) WHERE regexp_matches({content}, '\\S'))"""


_ID = "sha256(file_path || chr(31) || start_line || chr(31) || end_line)"


@query(f"""WITH RECURSIVE {_lines_sql(_FILES, 2048, 204)}
  SELECT {_ID} AS id, file_path, start_line, end_line, language, length(p.content)::INTEGER AS n_chars FROM pieces p JOIN files USING (file_path)""")
def line_chunks(spark, d):
    files = _files(spark, d).select("file_path", "content", "mtime")
    return chunk_files(files, "line").select("id", "file_path", "start_line", "end_line", "language", F.length("content").alias("n_chars"))


@query(f"""WITH RECURSIVE {_lines_sql(_FILES, 200, 40)}
  SELECT file_path, start_line, end_line, content FROM pieces""")
def line_chunks_small(spark, d):
    files = _files(spark, d).select("file_path", "content", "mtime")
    return chunk_files(files, "line", 50, 10).select("file_path", "start_line", "end_line", "content")


# the semicolon behind a C type belongs to the declaration around it
_UNIT_CONTENT = """rtrim(ltrim(array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10))),
  CASE WHEN u.language IN ('c', 'cpp') AND kind IN ('struct', 'class', 'enum') THEN ';' ELSE '' END)"""


@query(f"SELECT file_path, language, kind, name, start_line, end_line, signature, parent, visibility, doc FROM {units_sql()}")
def code_units(spark, d):
    return units_of(code_files(_t(spark, d, "part")))


@query(f"""SELECT {_ID} AS id, file_path, start_line, end_line, u.language, 'unit' AS origin, kind AS semantic_kind, name AS symbol_name, signature, parent, visibility,
  length({_UNIT_CONTENT})::INTEGER AS n_chars FROM {units_sql()} u JOIN {files_sql()} f USING (file_path)""")
def unit_chunks(spark, d):
    """Every unit a chunk of its own."""
    found = chunk_files(code_files(_t(spark, d, "part")), least=1)
    return found.select("id", "file_path", "start_line", "end_line", "language", "origin", "semantic_kind", "symbol_name", "signature", "parent", "visibility", F.length("content").alias("n_chars"))


@query(f"""SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, arg_min(name, start_line * 1000 - end_line) AS symbol_name, 'merged' AS origin,
  string_agg({_UNIT_CONTENT}, chr(10) || chr(10) ORDER BY start_line, end_line DESC) AS content FROM {units_sql()} u JOIN {files_sql()} f USING (file_path) GROUP BY 1""")
def unit_chunks_merged(spark, d):
    """All units of a file are too small for a chunk of their own."""
    found = chunk_files(code_files(_t(spark, d, "part")), least=100_000)
    return found.select("file_path", "start_line", "end_line", "symbol_name", "origin", "content")


@query(f"""WITH RECURSIVE {_lines_sql(_FILES, MAX_UNIT_TOKENS * 4, MAX_UNIT_TOKENS // 10 * 4)},
  c AS (SELECT file_path, count(*) AS line_chunks, 0 AS unit_chunks, 'line_based' AS method FROM pieces GROUP BY 1
    UNION ALL SELECT file_path, 0, count(*), 'ast' FROM {units_sql()} GROUP BY 1)
  SELECT file_path, unit_chunks::BIGINT AS unit_chunks, 0::BIGINT AS merged_chunks, line_chunks::BIGINT AS line_chunks, method FROM c""")
def chunking_stats(spark, d):
    files = _files(spark, d).select("file_path", "content", "mtime").unionByName(code_files(_t(spark, d, "part")))
    return tables.chunking_stats(chunk_files(files, least=1))


# --- embedding by the hash provider


def _vectors_sql(source: str, size: int = 64) -> str:
    """CTEs up to ``vectors`` (doc_id, i, x) of the texts of ``source`` (doc_id, text)."""
    return f"""seeds AS (SELECT doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 16))::UBIGINT::HUGEINT AS state FROM {source}),
  states AS (SELECT doc_id, 0 AS i, state FROM seeds UNION ALL
    SELECT doc_id, i + 1, (state * 1103515245 + 12345) % 18446744073709551616::HUGEINT FROM states WHERE i < {size}),
  plain AS (SELECT doc_id, i - 1 AS i, ((state // 65536) % 1000)::DOUBLE / 1000 AS v FROM states WHERE i > 0),
  norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM plain GROUP BY 1),
  vectors AS (SELECT doc_id, i, (v / norm)::FLOAT::DOUBLE AS x FROM plain JOIN norms USING (doc_id))"""


@query(f"WITH RECURSIVE {_vectors_sql('documents')} SELECT doc_id, i::INTEGER AS i, x FROM vectors")
def embed_texts(spark, d):
    found = embed(_docs(spark, d), HashProvider(64), "text").select("doc_id", F.posexplode("vector").alias("i", "x"))
    return found.select("doc_id", "i", F.col("x").cast("double").alias("x"))


@query(f"""WITH RECURSIVE both_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'open a connection'), {_vectors_sql('both_texts')},
  near AS (SELECT v.doc_id, round(sum((v.x - q.x) * (v.x - q.x)), 6) AS distance FROM vectors v JOIN vectors q ON v.i = q.i AND q.doc_id = -1 WHERE v.doc_id >= 0 GROUP BY 1)
  SELECT doc_id, distance, round(1 / (1 + distance), 6) AS score FROM near ORDER BY distance, doc_id LIMIT 10""")
def semantic_topk(spark, d):
    """A text query: embedded by the provider, then the nearest documents."""
    provider = HashProvider(64)
    rows = embed(_docs(spark, d), provider, "text").select("doc_id", "vector")
    return vector.vector_topk(rows, provider.embed_query("open a connection"), 10, "doc_id", order_digits=_SQL_DIGITS).select("doc_id", "distance", "score")


@query("""SELECT s_suppkey, lower(regexp_replace(s_name, '[^\\p{L}\\p{N}_-]', '-', 'g')) || '-' || substr(md5('/work/' || s_name), 1, 8) AS project_id FROM supplier""")
def project_ids(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", X.project_id(F.concat(F.lit("/work/"), F.col("s_name"))).alias("project_id"))
