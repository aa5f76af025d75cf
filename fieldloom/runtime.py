"""Session helpers: shared working tables, size-checked broadcasts, test tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it was counted.
BROADCAST_ROWS = 200_000
#: Bytes of it, in memory.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (tests, a single machine) a temporary one is
    set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="fieldloom-")
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def stage(df: DataFrame, hint: str = "stage", sort: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a local checkpoint the table survives lost executors. It is removed when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{hint}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path  # for unstage()
    return out


def unstage(df: DataFrame) -> None:
    path = getattr(df, "_fieldloom_path", None)
    if path:
        remove(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def size_of(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df``, measured now, has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes; else ``df`` for a shuffled join.

    A staged table is measured by its files (compressed, so a quarter of the bound
    counts). Give it a staged or otherwise cheap table: the count is an action.
    """
    path = getattr(df, "_fieldloom_path", None)
    if path and size_of(df.sparkSession, path) > BROADCAST_BYTES // 4:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of ``df``'s, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application: they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="fieldloom-code-"), "fieldloom.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("fieldloom", os.path.relpath(path, here)))
    sc.addPyFile(made)
