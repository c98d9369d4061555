"""Intermediate tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one is set only
    where the session names none (local tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{top.name}-source.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    context._strandline_shipped = True


class Scratch:
    """Parquet tables under the shared folder; ``drop`` frees those a job is done with."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table: later failures and reuse
        reread it instead of recomputing what came before."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes and texts
        # lets Spark's cleaner free the shuffle files of what has just been written
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        if self.made == 1:  # the driver's end removes what is left
            target = self._hadoop(self.root)
            self._files(target).deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, target):
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        target = self._hadoop(path)
        self._files(target).delete(target, True)
