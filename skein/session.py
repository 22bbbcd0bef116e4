"""Sessions with the engine's settings, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skein", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override, with `__` for dots in their names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when nothing refers to them
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a local session gets a temporary one, the same all session long; a cluster is refused,
    as its executors would each write to a disk of their own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="skein-")
    return _own["folder"]


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Tables of a loop, written to the shared folder, until the loop's result is.

    A checkpoint keeps the size that was guessed for its plan, and the guess for a join is a product: in a loop of
    joins it gets twice as many digits every round. A table that is read again has the size that it has.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.home, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.home}/{self.n}")
        return self.spark.read.parquet(f"{self.home}/{self.n}")

    def end(self, df: DataFrame) -> DataFrame:
        """df without lineage; the loop's tables go."""
        out = cut(df)
        if self.n:
            remove(self.spark, self.home)
        return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, through the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers can import it from any place."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._skein_shipped = True
