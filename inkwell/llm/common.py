"""Helpers shared by the training-data operators: shipping code, shared storage and batching."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: all but space and U+0009 to U+000D.
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="inkwell-")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "inkwell")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(os.path.realpath(path))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="inkwell-checkpoint-")
            sc.setCheckpointDir(base)
        _FOLDERS[sc.applicationId] = folder = f"{base.rstrip('/')}/inkwell-{uuid.uuid4().hex}"
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

        def clean() -> None:
            if sc._jsc is not None:
                p = jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(conf).delete(p, True)

        atexit.register(clean)
    return _FOLDERS[sc.applicationId]


def written(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


def whole_text(col: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def slices(lists: dict[str, list], text: str, limit: int = 2_000_000) -> Iterator[dict[str, list]]:
    """Cut parallel lists into runs of about `limit` characters, at least one row each."""
    start, size, n = 0, 0, len(lists[text])
    for i in range(n):
        size += len(lists[text][i])
        if size >= limit or i == n - 1:
            yield {k: v[start : i + 1] for k, v in lists.items()}
            start, size = i + 1, 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
