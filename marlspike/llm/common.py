"""What the operators share: reading tables, intermediate tables on shared storage, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset (tests on one machine) a temporary folder is chosen."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(f"file://{tempfile.mkdtemp(prefix='marlspike-')}")
        atexit.register(shutil.rmtree, _OWN_ROOT[0].removeprefix("file://"), ignore_errors=True)
    return _OWN_ROOT[0]


class Scratch:
    """Intermediate tables of one run, as Parquet in the shared folder: they cut the lineage and survive lost executors.

    A table goes with :meth:`drop` as soon as nothing reads it any more; the folder goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.kept = 0
        self.tables: dict[str, DataFrame] = {}
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.kept += 1
        return f"{self.root}/{self.kept:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again with the same schema."""
        path = self.path(name)
        kind = df.schema
        df.write.parquet(path)
        del df
        self.sweep()
        out = self.spark.read.schema(kind).parquet(path)
        self.tables[path] = out
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned."""
        for path in [p for p, t in self.tables.items() if t is df]:
            del self.tables[path]
            self._delete(path)

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Delete all other tables, as the result no longer reads them."""
        for table in [t for t in self.tables.values() if not any(t is n for n in needed)]:
            self.drop(table)

    def sweep(self) -> None:
        """Let Spark's cleaner see which shuffles nothing refers to any more, so that their files go now."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the process does
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, most: int, weight: str = "1") -> DataFrame:
    """A stored table, marked for broadcast if its measured weight is at most ``most``; otherwise Spark joins it by a shuffle."""
    measured = df.agg(F.coalesce(F.expr(f"sum({weight})"), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if measured <= most else df


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of so many rows, so that a task never holds a whole batch as Python objects.

    Arrow's pool gives back what it doesn't use when the batches end, as the worker lives on beside those of other stages;
    a worker that gets no other task for a while gives back the rest.
    """
    while _WAITING:
        _WAITING.pop().cancel()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    _WAITING.append(threading.Timer(IDLE, let_go))
    _WAITING[-1].daemon = True
    _WAITING[-1].start()


#: Seconds after a task in which a worker keeps its object for the next one; tasks of a stage follow each other sooner.
IDLE = 3.0
_WAITING: list[threading.Timer] = []
_HELD: dict = {}


def held_by_worker(key, make: Callable):
    """An object that a worker keeps between its tasks. It keeps one at a time, whatever operator it belongs to: workers are used again by later stages."""
    got = _HELD.get(key)
    if got is None:
        if _HELD:
            let_go()
        got = _HELD[key] = make()
    return got


def let_go() -> None:
    """Drop the held object and give its memory back to the system, where the C library can: freed alone, it stays with the worker."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held_out(column: str, folds: int):
    """True for the rows whose crc32 of the id as text is a multiple of ``folds``; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == 0, F.lit(False))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``: the smallest id that can be reached, for every id with an edge.

    Alternates large-star and small-star steps until nothing changes. Each step is a min per node and a join on
    the node, so a node with a third of all edges is pre-aggregated, and its join can be split by Spark.
    """
    e = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            break
        seen = (n, total)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step = small.select("e.*").where("a <> b").distinct()
        after = scratch.keep(step, "edges")
        scratch.drop(e)
        e = after
    return e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.col("m").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
