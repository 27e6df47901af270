"""Tables, shared scratch space and code shipping for any kind of cluster."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a directory of part files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; a cluster has none to give."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            configured = current.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            configured = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured)
        _removed_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return configured


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    sc = spark.sparkContext
    mine = f"{shared_dir(spark)}/sieveline/{sc.applicationId}"
    if mine not in _SCRATCH:
        at = sc._jvm.org.apache.hadoop.fs.Path(mine)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(at)
        _removed_at_exit(spark, mine)
        _SCRATCH.add(mine)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """``cut``, and how many rows meet ``condition``: counted as they are written, not by a job that reads them again.

    Tasks that ran twice may count twice, so that only nothing and something are told apart for certain.
    """
    observed = df.observe("met", F.count_if(F.expr(condition)).alias("n"))
    kept = cut(observed)
    met = observed._jdf.queryExecution().observedMetrics().get("met")
    return kept, met.get().getLong(0) if met.isDefined() else kept.where(condition).count()  # a plan that turned out empty observes nothing


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"sieveline/{f.relative_to(root)}")
    target = scratch(spark, "code") + ".zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
