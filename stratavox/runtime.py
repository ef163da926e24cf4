"""Session helpers shared by all operators: lineage cuts in the shared folder, the size of Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, the same for all operators: the setting is read when a plan runs, so an
#: operator must not change it for others. Operators that want fewer rows slice batches in the task.
ARROW_BYTES = 4 << 20
_settled: list[str] = []


def get_session(app: str = "stratavox", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use; a running one is reused."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="stratavox-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    Unlike localCheckpoint the rows survive lost executors, and unlike checkpoint() they are
    columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratavox/{name}-{uuid.uuid4().hex}"
    if not _settled:
        atexit.register(release, spark)
    _settled.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settled_within(spark: SparkSession) -> Iterator[None]:
    """Tables that settle() writes inside go at the end, when all that reads them has been written out: for drivers that live
    long, such as streams."""
    before = len(_settled)
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that settle() has written, but for the first `keep`; results that still read them must have been written
    out. Runs by itself when the driver ends."""
    jvm = spark._jvm
    while len(_settled) > keep:
        path = _settled.pop()
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception as e:  # one table that can't be deleted doesn't keep the others; the session may have ended first
            if spark.sparkContext._jsc is None:
                return
            print(f"{path} was not deleted: {e}", file=sys.stderr)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: unless it is on PYTHONPATH or was itself shipped as a zip file, a zip of it
    goes to the executors once per Spark context."""
    sc = spark.sparkContext
    home = Path(__file__).resolve().parent
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if getattr(sc, "_stratavox_shipped", False) or str(home.parent) in known or not home.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="stratavox-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/stratavox-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(path)
    sc._stratavox_shipped = True


def arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python operators of this session receive."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@contextmanager
def restored(spark: SparkSession, *keys: str) -> Iterator[None]:
    """Settings of the session as they were before, whatever operators set meanwhile."""
    before = {k: spark.conf.get(k, None) for k in (*keys, "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(df: DataFrame, **sums: Column) -> tuple[DataFrame, Observation]:
    """The same rows, with their number as `rows` and other sums observed as they go by, without a pass of their own."""
    by = Observation()
    return df.observe(by, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]), by


def seen(by: Observation, name: str = "rows") -> int:
    """An observed sum; 0 where Spark knew beforehand that there are no rows and left the counting out of the plan."""
    try:
        return by.get[name]
    except Py4JJavaError:
        return 0


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store, hidden files too, which Spark's readers skip."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
