"""Files of any file system that Spark reaches, through Hadoop's interface; and scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
#: Spark's size of a plan that has none is above this.
_UNKNOWN = 1 << 60
#: All cores work on an input of at least this many bytes a core.
_SMALL = 256 << 10
#: The most tasks that rows are dealt to.
_MOST = 20_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    p, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def list_ages(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in a folder, with the seconds since each was changed."""
    p, fs = _path(spark, folder)
    found = fs.listStatus(p) if fs.exists(p) else []
    return [(x.getPath().getName(), time.time() - x.getModificationTime() / 1000) for x in found]


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that must not exist yet; fails if another writer was first."""
    p, fs = _path(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; a local one only where that is unset. Removed at the end."""
    sc = spark.sparkContext
    if sc.applicationId not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="inkwell-scratch-")
        _SCRATCH[sc.applicationId] = folder = f"{base.rstrip('/')}/inkwell-scratch-{uuid.uuid4().hex}"

        def clean() -> None:
            if sc._jsc is not None:
                remove(spark, folder)

        atexit.register(clean)
    return _SCRATCH[sc.applicationId]


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of what a plan reads, by Spark's statistics; None where a source doesn't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size if size < _UNKNOWN else None


def dealt(df: DataFrame, each: int, *keys: str, ranged: bool = False) -> DataFrame:
    """Rows dealt out by keys (ranged: by ranges of them) to tasks whose number grows with the input, one for `each` bytes of
    it, so that what a task holds does not; to Spark's own number where the input's size is not known."""
    deal = df.repartitionByRange if ranged else df.repartition
    size = input_bytes(df)
    if size is None:
        return deal(*keys)
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // _SMALL))
    return deal(min(max(-(-size // each), few, 1), _MOST), *keys)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a scratch table and read back: it has one content, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
