"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cnvspark.session import importable


#: Folders that :func:`kept` has written, by the id of the application; :func:`scratch` deletes them.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by Spark's own reader."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset the session gets a temporary one if all of it runs on this machine, as in tests; otherwise a folder of
    one machine would lose data, which is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new, not yet existing path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends here, and every executor sees it."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A step whose result is the last that :func:`kept` writes in it: on leaving, the other folders that it wrote are deleted."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    yield
    for path in written[before:-1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del written[before:-1]


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a bounded number of rows, which the driver holds, as a literal of the plan (numbers and strings)."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(':'.join(x.split()) for x in schema.split(','))}>>")))


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """A 128-bit key of a whole text (null: empty); equal texts have equal keys."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def single_threaded() -> None:
    """Keeps native thread pools of a Python worker to the one core that Spark gave its task."""
    for name in ("TOKENIZERS_PARALLELISM", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ[name] = "false" if name.startswith("TOK") else "1"


#: What the Python code of operators remembers between tasks: how each forgets it, and whose memory this worker holds now.
_FORGET: dict[str, Callable[[], object]] = {}
_HOLDS: list[str] = []


def remembers(owner: str, forget: Callable[[], object]) -> None:
    """Tells how an operator's code forgets what it remembers in a Python worker."""
    _FORGET[owner] = forget


def working(owner: str) -> None:
    """For code that is about to remember things between tasks. Spark goes on to use a Python worker for other stages, so what other
    operators have remembered in it is forgotten first, and its memory goes back to the machine.
    """
    if _HOLDS != [owner]:
        for other, forget in _FORGET.items():
            if other != owner:
                forget()
        _HOLDS[:] = [owner]
        give_back()


def give_back() -> None:
    """Gives the memory that this process no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` cut, and in no more partitions than its rows need, ``rows`` in each: what is shuffled next comes from few tasks."""
    df = cut(df)
    return df.coalesce(df.count() // rows + 1)
