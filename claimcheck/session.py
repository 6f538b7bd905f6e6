"""Session settings, the shared folder for cut lineage, and plan inspection."""

from __future__ import annotations

import contextlib
import io
import os
import pathlib
import tempfile
import threading
import uuid
import zipfile

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


_stage_paths: dict[str, list[str]] = {}
_owned = threading.local()
#: Lets Spark delete the shuffle files of a job when the job ends, and not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How stages are written: vectors of counts and texts take much less room than by the default codec.
STAGE_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def local_session(cores: str = "8", app: str = "claimcheck", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small tables with heavy rows: do not merge them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans here hold many small expressions; recording a call site for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="claimcheck-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a query writes and reads back."""
    return os.path.join(shared_folder(spark), f"claimcheck-{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Store a stage as a table in the shared folder and read it back.

    Cuts lineage (a lost executor costs no recompute), lets several branches read the
    stage, and keeps later filters from being pushed through its expressions.  What was
    shuffled for it is not kept beside it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.options(**STAGE_FILES).parquet(path)
    _stage_paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    getattr(_owned, "paths", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, names: list[str]) -> None:
    sc = spark.sparkContext
    for name in names:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> int:
    """Delete the stages this application stored; frames that read them become unusable."""
    paths = _stage_paths.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextlib.contextmanager
def own_stages(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the stages that this thread stored inside the block.

    For a job that has written its results by then, such as a micro-batch.
    """
    before, _owned.paths = getattr(_owned, "paths", []), []
    try:
        yield
    finally:
        mine, _owned.paths = _owned.paths, before
        kept = _stage_paths.get(spark.sparkContext.applicationId, [])
        kept[:] = [p for p in kept if p not in mine]
        _delete(spark, mine)


def materialize_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """``materialize`` what ``build`` makes, and delete the stages that it stored on the way."""
    with own_stages(spark):
        out = materialize(build(), name)
        path = _owned.paths.pop()
    getattr(_owned, "paths", []).append(path)
    return out


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan as text (for tests that guard plan shape)."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per Spark context).

    A cluster job may pass it with ``--py-files`` instead; then this changes nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_claimcheck_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="claimcheck-py-")) / "claimcheck.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, pathlib.Path(root.name) / module.relative_to(root))
    sc.addPyFile(str(target))
    sc._claimcheck_shipped = True
