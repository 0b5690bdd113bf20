"""What the operators share: session settings, tables in the shared folder, and reading inputs."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches that stay small where texts are long; a smaller setting of the session stays."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns to the machine what this worker has freed. A worker waits a minute for its next task, and would
    keep some 250 MB meanwhile that its executor's other processes need."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` over a task's batches, which gives back memory at its end."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def lean_group(work: Callable) -> Callable:
    """`work` over a group, which gives back memory at its end."""

    def run(key, table):
        out = work(key, table)
        give_back()
        return out

    return run


def lean_cogroup(work: Callable) -> Callable:
    """As lean_group, over two groups."""

    def run(key, left, right):
        out = work(key, left, right)
        give_back()
        return out

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a session on one machine (tests) may go without it
    and gets a local folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def kept(df: DataFrame, what: str, *, by: list[str] | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trellis/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trellis_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a table that `kept` wrote, once nothing that is still to run reads it."""
    forget_path(df.sparkSession, df._trellis_path)


def forget_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_column(df: DataFrame, name: str = "text"):
    """The text, null as the empty string."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


#: Plan nodes that give the same rows in the same partitions and order whenever they run.
_STEADY = {"Project", "Filter", "ColumnarToRow", "InputAdapter", "BroadcastHashJoin", "MapInArrow", "MapInPandas", "AdaptiveSparkPlan"}


def settled(df: DataFrame) -> DataFrame:
    """The frame, such that reading it twice gives the same rows in the same partitions and order: itself where its plan
    only scans files, maps, filters and looks up broadcast tables, and without random numbers; else a written table."""
    execution = df._jdf.queryExecution()

    def steady(node) -> bool:
        name = node.nodeName()
        if name.startswith("Scan ") and "FileSourceScan" in node.getClass().getSimpleName():
            return True
        if name == "BroadcastExchange":
            return steady(node.children().apply(0))
        if name == "Range":
            return True
        if name == "AdaptiveSparkPlan":
            return steady(node.inputPlan())
        inside = node.children()
        return (name in _STEADY or name.startswith("WholeStageCodegen")) and inside.size() > 0 and all(steady(inside.apply(i)) for i in range(inside.size()))

    return df if execution.analyzed().deterministic() and steady(execution.executedPlan()) else kept(df, "settled")


def hot_keys(counts: DataFrame, key: str, n_rows: int, *, at_most: int = 100_000, least: int = 256) -> tuple[DataFrame, int]:
    """Of `counts` (key, n) the keys of more rows than a limit, and the limit. Rows sum to `n_rows` and the limit is at
    least its `at_most`th part, so there are at most `at_most` such keys, however large the table: they may be broadcast."""
    limit = max(least, -(-n_rows // at_most))
    return counts.where(F.col("n") > limit).select(key, "n"), limit


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, counts: DataFrame, n_rows: int, how: str = "inner") -> DataFrame:
    """A join on `key`, which is unique on the right. A key with many rows on the left (counted in `counts`: key, n) is
    parted by a hash of the left's column `spread`, and its row on the right repeated for each part, so that no
    task gets a whole hot key. Other keys are joined as ever."""
    hot, limit = hot_keys(counts, key, n_rows)
    hot = F.broadcast(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_hot", "_parts")
    copies = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
