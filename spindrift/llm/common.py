"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a side of a join may have to be broadcast (thin rows of ids, digests or counters).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) a temporary folder is set; elsewhere that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; everything of one application goes when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = f"{shared_dir(spark)}/spindrift-{app}-{uuid.uuid4().hex[:8]}"
        _scratch[app] = root
        atexit.register(_remove, spark, root)
    return f"{_scratch[app]}/{tag}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone already: the shared folder's owner cleans up
        return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage without keeping anything on an executor: a lost executor costs the
    recomputation of nothing that stands before the written table.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else ``df`` as it is.

    ``df`` should be cheap to count (a materialized table). Beyond the limit the join stays a
    shuffled one, which Spark splits where it is skewed.
    """
    return F.broadcast(df) if df.count() <= limit else df


#: Rows, and bytes, that travel to a Python worker at once: texts can be long, and a worker holds a batch in several forms.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches, and memory given back when a task ends (idle workers stay alive).

    Spark reads the size of batches from the session when a plan runs, so the session's bounds are lowered, and stay so.
    """
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held_out(column: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder by 5; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))
