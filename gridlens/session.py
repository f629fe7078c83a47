"""Session settings and the scratch area every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Settings that must be known when the session starts: no call-site capture per column.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "gridlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the library's settings; ``conf`` keys replace ``.`` by ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **START_CONF}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_session_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else has built; its time zone stays."""
    for key, value in SESSION_CONF.items():
        if key != "spark.sql.session.timeZone":
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables.

    On a cluster it lies in the shared folder named by ``spark.checkpoint.dir``.
    A machine-local folder is used only by a local master.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/gridlens-{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix=f"gridlens-{label}-") + "/table"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code to the executors, once per application.

    Python code in tasks imports it, and executors need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="gridlens-code-"), "gridlens_code.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


# Bytes of rows that a task and its Python worker exchange at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches end with the row that reaches ``most`` bytes. A lower bound of the session stays.

    Spark's own bound is 64 MB, and of each batch in work there are copies outside the heap of an executor and in its
    worker, for each of its tasks and each way. Spark reads the setting when a plan runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) > most:
        spark.conf.set(name, str(most))


# Folders made inside each open scope, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables staged inside it are deleted, and nothing else.

    Read what you need before the scope ends, or stage the result with ``outer=True``.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """:func:`scratch_dir` for files that tasks write; inside a :func:`scratch` scope it lives as long as the scope."""
    path = scratch_dir(spark, label)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the scratch area and read it back.

    Operators that look at their input more than once (exact quantiles, histograms, chunked
    series) would otherwise repeat the whole upstream per look. The stored copy also cuts
    the lineage, so a lost executor does not bring the upstream back. Inside a :func:`scratch`
    scope the copy lives until the scope ends, with ``outer`` until the enclosing one does.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    scope = _SCOPES[:-1] if outer else _SCOPES
    if scope:
        scope[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """:func:`stage` several independent frames; their write jobs run at the same time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        stored = pool.map(stage, frames.values(), frames)
        return dict(zip(frames, stored))
