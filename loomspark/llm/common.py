"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a task handles at once; bounds the memory of one step.
STEP_ROWS = 256
#: Rows and bytes of an Arrow batch that Spark hands to a task.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle that is dealt by hand: the session's own number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to Python: texts may be long, and a batch is held whole in memory.

    Spark reads these settings when a plan runs, so they stay set for the session; smaller ones are kept.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name).lower().removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_text(text: str | None) -> bytes:
    """A text compressed for a shuffle; a null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + (_ZSTD.compress(data, asbytes=True) if data else b"")


def unpack_bytes(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return _ZSTD.decompress(packed[8:], size, asbytes=True) if size else b""


def unpack_text(packed: bytes) -> str:
    return unpack_bytes(packed).decode("utf-8", "surrogatepass")


def giving_back(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after which the worker gives freed memory back to the system.

    Workers stay for later tasks, also of other operators; what one held (memos, models, batches) would otherwise count for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def map_batches(df: DataFrame, f: Callable[[dict], dict | None], schema: str, types: pa.Schema) -> DataFrame:
    """Apply f to slices of at most STEP_ROWS rows: from a dict of Python lists to a dict of columns."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                out = f({name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c.name], type=c.type) for c in types], schema=types)

    return df.mapInArrow(giving_back(run), schema)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply f to batches of whole rows that it only selects from; columns may have any name (in batches they are c0, c1, ...)."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(giving_back(f), plain.schema).toDF(*df.columns)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's shared folder from spark.checkpoint.dir; only a local session may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="loomspark-checkpoint-")
    context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table in the shared folder; in a loop, the table of a round before may be given up for it.

    Unlike a checkpointed plan, a table has its true size: a checkpoint keeps the estimate of the plan behind it, which
    multiplies with every join of a loop.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    if old := getattr(instead_of, "table_path", None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return table


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (src, dst).

    Each round hooks every node, and the node that it is labelled with, to the smallest label among its
    neighbours, then halves paths by looking up its label's label.  Labels only fall, and rounds go on until
    none does; as roots are hooked too, their number grows with the logarithm of a component's size in
    whatever order the ids come.  Groups are only ever aggregated with min, never collected.
    """
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct())
    after = stored(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("component")))
    seen = None
    while True:
        labels = after.select("id", "component")
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        seen = stored(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("near")), instead_of=seen)
        roots = seen.filter("near < old").groupBy(F.col("old").alias("id")).agg(F.min("near").alias("over"))
        hooked = seen.join(roots, "id", "left").select("id", "old", F.least("near", "over").alias("component"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("above"))
        after = stored(hooked.join(up, "component", "left").select("id", "old", F.coalesce("above", "component").alias("component")), instead_of=after)
        if after.filter("old <> component").isEmpty():
            return after.select("id", "component")
