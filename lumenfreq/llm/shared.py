"""What the corpus operators share: the shared folder, written tables, null-safe inputs."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else, for bytes and for str.
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Stands for a null id inside numpy code; sorts before every other id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_at.isDefined():
            return set_at.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lumenfreq-")
        spark.sparkContext.setCheckpointDir(at)
        return shared_dir(spark)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lf-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lf_path = path
    return out


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete tables of materialise(), or folders, that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in written:
        path = jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.lf_path)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of a batch that goes to a Python worker at most, inside small_batches().
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside hands rows to Python in batches of BATCH_BYTES: JVM and worker hold several copies of a batch each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives freed memory back to the system: allocators keep it otherwise, and a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def releasing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that calls release() when its task ends."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


#: Rows of a few numbers that are sent to all tasks at most; tables beyond that are joined by shuffles.
FEW = 500_000


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """df (a written table of narrow rows), marked for broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tasks_for(df: DataFrame, each: int = 1 << 27) -> int:
    """Tasks for a shuffle in line with df: as many as the session says, and more where df's files hold more than `each` bytes a task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n_partitions(df.sparkSession), -(-size // each) if size < 1 << 50 else 0)  # beyond that its size is unknown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))
