"""The engine: build or refresh an index, and answer queries over it."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, fusion, tables, vector
from ..operators import symbols as lookup
from ..operators.chunking import chunk_files
from ..operators.embedding import HashProvider, Provider, embed
from ..operators.metrics import Metrics
from ..sources.changes import ChangeSource
from ..sources.files import get_file, ignore_rules, list_tree, read_tree, without_ignored
from ..streaming.live import watch
from .config import Config
from .store import ChunkStore, KeywordIndex, scratch

log = logging.getLogger(__name__)
KEY = ["file_path", "start_line", "end_line"]


class Engine:
    def __init__(self, spark: SparkSession, root: str, base: str, config: Config | None = None, provider: Provider | None = None):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.provider = provider or HashProvider()
        self.store = ChunkStore(spark, f"{base}/chunks", self.provider.dimension)
        self.keywords = KeywordIndex(spark, f"{base}/keywords")
        self.metrics = Metrics()

    # building

    def _listing(self) -> DataFrame:
        c = self.config.indexer
        files = list_tree(self.spark, self.root, c.extensions, c.ignore_patterns)
        return without_ignored(files, ignore_rules(self.spark, self.root, self.config.indexer.global_ignore_file))

    def stale(self) -> bool:
        """Something is new, newer or gone."""
        listed, table = self._listing(), self.store.read(vectors=False)
        return not tables.changed_files(listed, table).isEmpty() or not tables.vanished_files(listed, table).isEmpty()

    def index(self, force: bool = False) -> dict[str, int]:
        """Read, chunk and embed what changed, and publish it with what went as one version.

        The tree is listed once, and texts are cut into chunks once; both are written below the index and read from there.
        """
        began, c = time.time(), self.config.indexer
        with scratch(self.store.paths) as held:
            listed = held(self._listing(), "listing")
            table = self.store.read(vectors=False)
            changed = listed if force else held(tables.changed_files(listed, table), "changed")
            files, read_errors = read_tree(self.spark, self.root, changed.select("file_path"), c.extensions, c.ignore_patterns)
            chunks = held(chunk_files(files, "ast" if c.chunker_strategy == "ast" else "line", c.chunk_size, None, c.min_chunk_tokens, c.max_chunk_tokens), "chunks")
            errors = read_errors.unionByName(
                chunks.where("error is not null").select(F.col("file_path").alias("path"), F.lit("chunking").alias("stage"), "error")
            )
            n_changed, n_listed, n_errors = changed.count(), listed.count(), errors.count()
            gone = tables.vanished_files(listed, table).union(changed.select("file_path")).distinct()
            counted = {"created": 0, "removed": 0}
            if n_changed or not gone.isEmpty():
                asked = time.time()
                counted = self.store.merge(embed(chunks.where("error is null").drop("origin", "error"), self.provider, batch=self.config.embeddings.batch_size), gone)
                self.metrics.observe("embedding_latency_seconds", time.time() - asked)
                self.metrics.count("embeddings_total", by=counted["created"])
                self.keywords.refresh(self.store)
                self.store.vacuum()
        self.metrics.observe("indexing_duration_seconds", time.time() - began)
        self.metrics.gauge("indexed_chunks", self.store.count())
        log.info("indexed %s: %d of %d files, %d chunks, %d errors", self.root, n_changed, n_listed, counted["created"], n_errors)
        return {"files": n_listed, "changed_files": n_changed, "chunks": counted["created"], "errors": n_errors}

    def watch(self, checkpoint: str):
        """Start the stream that merges changes of the tree as they happen, into the table and the keyword index."""
        self.spark.dataSource.register(ChangeSource)
        c = self.config
        stream = self.spark.readStream.format("file_changes").option("path", self.root).option("state", f"{checkpoint}/listings").load()

        def read(paths: DataFrame) -> DataFrame:
            return read_tree(self.spark, self.root, paths, c.indexer.extensions, c.indexer.ignore_patterns)[0]

        return watch(
            stream, self.store, read, self.provider, checkpoint, f"{c.watcher.debounce_ms} milliseconds", keywords=self.keywords, metrics=self.metrics,
            collect={"delay_ms": c.watcher.collection_delay_ms, "files": c.watcher.threshold_files, "rate": c.watcher.threshold_rate},
            strategy="ast" if c.indexer.chunker_strategy == "ast" else "line", extensions=c.indexer.extensions, ignored=c.indexer.ignore_patterns,
        )

    # searching

    def _queries(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def vector_search(self, query: str, k: int = 10) -> DataFrame:
        """Ids, paths and vectors are ranked; only the k best rows are read whole."""
        asked = self.provider.embed_query(query)
        near = vector.vector_topk(self.store.read().select("id", "file_path", "vector"), asked, k).select("id", "file_path", "distance", "score")
        rows = self.store.rows_of(near, k)
        return rows.orderBy("distance", "id").select("id", "content", *KEY, "score", "file_header")

    def keyword_search(self, query: str, k: int = 10) -> DataFrame:
        posted, lengths = self.keywords.tables()
        hits = bm25.bm25_search_index(posted, lengths, self._queries(query), k, ["id", "file_path"]).select("id", "file_path", "score", "rank")
        rows = self.store.rows_of(hits, k)
        return rows.orderBy("rank").select("id", "content", *KEY, "score", F.lit(None).cast("string").alias("file_header"))

    def hybrid_search(self, query: str, k: int = 10) -> DataFrame:
        s = self.config.search
        far = fusion.OVERFETCH * k
        lists = [fusion.ranked(df, [F.desc("score"), "id"]) for df in (self.vector_search(query, far), self.keyword_search(query, far))]
        return fusion.hybrid(lists[0], lists[1], KEY, k, (s.vector_weight, s.keyword_weight), s.rrf_k)

    def search(self, query: str, k: int | None = None, mode: str | None = None, unique: bool = False) -> DataFrame:
        """mode is vector, bm25 or hybrid; hybrid falls back to vector while there is no keyword index."""
        k, mode = k or self.config.search.default_limit, mode or self.config.search.mode
        self.metrics.count("search_requests_total")
        if mode == "hybrid" and not self.keywords.exists():
            mode = "vector"
        run = {"vector": self.vector_search, "bm25": self.keyword_search, "hybrid": self.hybrid_search}[mode]
        return vector.unique_files(run(query, vector.OVERFETCH * k), k, key="start_line") if unique else run(query, k)

    # lookups

    def symbols(self) -> DataFrame:
        return lookup.symbols(self.store.read(vectors=False))

    def find_symbol(self, query: str, **options) -> DataFrame:
        return lookup.find_symbol(self.symbols(), query, **options)

    def list_symbols(self, **options) -> DataFrame:
        return lookup.list_symbols(self.symbols(), **options)

    def find_references(self, name: str, exclude_file: str | None = None, limit: int = lookup.REFERENCE_LIMIT, mode: str = "vector") -> DataFrame:
        if mode == "text":
            return lookup.references_text(self.store.read(vectors=False), name, exclude_file, limit)
        return lookup.references_vector(self.vector_search(name, limit), exclude_file)

    def list_files(self, glob: str | None = None) -> DataFrame:
        return tables.list_files(self.store.read(vectors=False), glob)

    def get_file(self, path: str) -> str:
        return get_file(self.root, path, spark=self.spark)

    def stats(self) -> dict:
        row = tables.counts(self.store.read(vectors=False)).first()
        return {"files": row["files"], "chunks": row["chunks"], "index_size_bytes": self.store.size(), "root": self.root, "mode": self.config.search.mode}
