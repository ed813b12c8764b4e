"""Tables: readers, writers, keyed upserts and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; only a local session may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="loomspark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, so that a lost executor costs no recomputation.

    A written table also has its true size.  A checkpointed plan would keep the estimate of the plan behind it, which
    multiplies with every join, so that after some dozens of rounds the planner handles numbers of gigabytes.  In a
    loop, the table of a round before may be given up for the new one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.table_path = path
    old = getattr(instead_of, "table_path", None)
    if old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return stored


def bucketed(df: DataFrame, buckets: int, column: str) -> tuple[DataFrame, str]:
    """df as a table of buckets by a column in the shared folder, which groups by the column read without a shuffle, and its name, to be dropped."""
    spark, name = df.sparkSession, f"loomspark_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name), name


def version(df: DataFrame) -> str:
    """A name for the state of a table of files: their number of rows, size and newest time."""
    r = df.select(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_path").alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.max("s").alias("s"), F.max("t").alias("t")).agg(F.sum("n"), F.sum("s"), F.max("t")).first()
    return "-".join(str(x) for x in r)


def append(df: DataFrame, path: str, partition: str = "snapshot_id") -> None:
    """Bulk insert: one directory for each snapshot, so that reads prune by it."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def insert_or_ignore(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key old lacks, one a key (the smallest row)."""
    own = W.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    return new.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r").join(old.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All keys of both, the newest row of each by `order`; of equal ones new wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    own = W.partitionBy(*keys).orderBy(F.desc("_new"), order.desc())
    return both.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r", "_new")


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Delete-and-insert by key: only the partitions that df holds are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Cascade delete of one table: the rows whose key is not among those deleted."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: dict[str, Column]) -> dict[str, DataFrame]:
    """All tables without what is deleted and all that hangs on it.

    links are foreign keys (table, column, table it points to, column there) without cycles, gone conditions for what is deleted first.
    Tables are walked from those that are pointed to; each link takes out, by an anti-join, what points to rows that are gone above.
    A null points to nothing, and a condition that is null deletes nothing.
    """
    left, order, todo = dict(tables), [], set(tables)
    while todo:
        ready = sorted(t for t in todo if not any(c == t and p in todo and p != t for c, _, p, _ in links))
        if not ready:
            raise ValueError("foreign keys go round in a circle")
        order += ready
        todo -= set(ready)
    lost: dict[str, DataFrame] = {}
    for name in order:
        above = [(column, lost[parent].select(F.col(key).alias(column)).distinct()) for child, column, parent, key in links if child == name and parent in lost]
        dead = F.coalesce(gone[name], F.lit(False)) if name in gone else F.lit(False)
        taken = [tables[name].join(keys, column, "left_semi").select(*tables[name].columns) for column, keys in above]
        taken += [tables[name].filter(dead)] if name in gone else []
        left[name] = tables[name].filter(~dead)
        for column, keys in above:
            left[name] = left[name].join(keys, column, "left_anti").select(*tables[name].columns)
        if taken:
            rows = taken[0]
            for more in taken[1:]:
                rows = rows.unionByName(more)
            lost[name] = checkpoint(rows)
    return left


def export_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size_bytes, modified, content, checksum) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^[^:]*:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.replace(rel, F.lit(base), F.lit("")).alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content", F.sha1("content").alias("checksum"))


def write_graph(nodes: DataFrame, edges: DataFrame, communities: DataFrame, path: str) -> None:
    """A graph as JSON lines below a folder: a schema line, then a line for each node, edge and community."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit("schema").alias("record"), F.to_json(F.struct(F.lit("1.1").alias("version"))).alias("value"))
    lines = head
    for record, df in (("node", nodes), ("edge", edges), ("community", communities)):
        lines = lines.unionByName(df.select(F.lit(record).alias("record"), F.to_json(F.struct(*df.columns)).alias("value")))
    lines.select(F.to_json(F.struct("record", "value"))).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str, record: str, schema: str) -> DataFrame:
    """The nodes, edges or communities of a written graph."""
    lines = spark.read.schema("record string, value string").json(path)
    return lines.filter(F.col("record") == record).select(F.from_json("value", schema).alias("v")).select("v.*")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, name, content): Markdown files of a folder, whole; bytes that are not UTF-8 are left out."""
    from loomspark.functions.paths import lenient_text

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), lenient_text(F.col("content"), 1 << 30).alias("content"))
