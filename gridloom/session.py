"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for local runs and tests; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 4, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    conf = LOCAL_CONF | {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return SparkSession.builder.appName("gridloom").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's spark.checkpoint.dir, or, where that is unset in a local session (tests), a temporary one.

    On a cluster it must be set: raises RuntimeError, as a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
    sc.setCheckpointDir(path)
    made = sc._jsc.sc().getCheckpointDir().get()
    _delete_at_end(spark, made)
    return made


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """The application takes the folder with it when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that a query keeps while it runs; deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    _delete_at_end(spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: later plans start at the files, which outlive any executor.

    With spark.cleaner.referenceTracking.cleanCheckpoints (set in LOCAL_CONF) the files go when the frame does, else with the application.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, as the shuffle files of plans that are done with stay on the executors' disks until it does. Long jobs call it once
    per batch; a collection takes some tenths of a second."""
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # the driver's own file server hands it out
    archive = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / "gridloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
