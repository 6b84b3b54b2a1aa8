"""Session helpers: where intermediate tables live and how lineage is cut.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir``,
which every executor shares, so a lost executor never loses them. Only a local
session without that setting gets a folder of its own.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def local_session(app: str = "skarn", cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="skarn-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/skarn/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per context, as a zip in the shared folder: for clusters and sessions whose workers don't have it on their path."""
    from skarn.sources.files import write_bytes

    sc = spark.sparkContext
    if getattr(sc, "_skarn_shipped", False):
        return
    home = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    path = f"{scratch_dir(spark)}/skarn/code-{uuid.uuid4().hex}/skarn.zip"
    write_bytes(spark, path, packed.getvalue())
    sc.addPyFile(path)
    sc._skarn_shipped = True


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read many times."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within the block, the shuffle files of a query are deleted as soon as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str = "bucketed") -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder that is bucketed and sorted by ``key``: joins on it don't shuffle it again. Its catalogue entry ends with the block."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"skarn_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as the session has cores or shuffle partitions: for Python stages over rows that are few but dear."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def clear_written(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; call it once the results that read them are consumed."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Join ``left`` to ``table`` (one row per key) where a few keys may hold most of ``left``.

    ``table[weight]`` is the number of ``left`` rows with the key. Keys above ``share``
    of all rows can't be more than ``1 / share``, so they are broadcast whatever the
    data's size; all other keys are shuffled and none of them is hot. ``table`` is read
    several times, so pass one that is written. ``weight`` is dropped from the result.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) > share * total).drop(weight))
    rest = table.where(F.col(weight) <= share * total).drop(weight)
    return left.join(hot, on, "inner").unionByName(left.join(hot.select(*on), on, "left_anti").join(rest, on, how))
