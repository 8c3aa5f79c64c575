"""Sessions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications that have been sent this package.
_SENT: set[str] = set()
#: Paths in the shared folder, by application.
_WRITTEN: dict[str, list[str]] = {}


def importable(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one if all of the
    session runs on this machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet, to the shared folder or to ``path``, and read again: its lineage ends here, and jobs after it
    read the table. One that ``path`` holds already is taken up as it is, as by a driver that starts again.
    """
    spark = df.sparkSession
    target = path or shared_path(spark, what)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, in whatever store its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def clear(spark: SparkSession) -> None:
    """Deletes what :func:`written` and :func:`shared_path` have put into the shared folder for this application; results that
    read it must be done with.
    """
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
