"""What the corpus operators share: readers, folds, checkpoints and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker holds at once; a single longer text is a step alone.
STEP_BYTES = 8 << 20
#: Rows of an Arrow batch between the JVM and Python. Texts of a few KB then take a few MB.
BATCH_ROWS = 1024
#: Ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 5


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder of spark.checkpoint.dir; a folder of our own only where none is set and there is no cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written into the checkpoint folder and read again, for loops: their sizes are true ones,
    whereas a checkpoint keeps its plan's estimate, which each join of a loop multiplies. Those
    that a round no longer needs are deleted."""

    def __init__(self, spark: SparkSession):
        checkpoint_dir(spark)
        self.spark, self.top, self.paths = spark, f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but_last: int = 0) -> None:
        """Delete all tables but the last ones."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for k, path in enumerate(self.paths[: len(self.paths) - but_last]):
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
                self.paths[k] = ""


_state: dict = {}


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks. It has one place: another key's state makes way, so
    that the operators of a pipeline do not add up in a worker's memory."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def ids_without_kept(decided: DataFrame) -> DataFrame:
    """__gone: the ids (doc_id) of which no row is kept. Rows that share an id go or stay together."""
    gone = decided.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("any"))
    return gone.where(~F.col("any")).select("__gone")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is not in gone's column __gone.

    Few ids are broadcast, so that no text moves; their number is counted first, and more than
    ``BROADCAST_IDS`` meet the documents in a shuffled join.
    """
    gone = checkpointed(gone.where("__gone IS NOT NULL").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each take about step_bytes; null texts become empty ones."""
    for batch in batches:
        k = batch.schema.get_field_index(text)
        column = batch.column(k).fill_null("")
        batch = batch.set_column(k, text, column)
        sizes = pa.compute.binary_length(column).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > step_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


