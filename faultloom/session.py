"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # the JVM does not compile methods over 8000 bytes of bytecode; a wide projection of CASE
    # chains is larger than that as one method and runs four times faster split up
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS that the given session has not set itself."""
    chosen = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "faultloom", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.driver.host": "localhost",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir as the cluster names it.

    Where the setting is absent (local runs and tests) a temporary folder takes its place, is
    recorded in the session, so later calls agree, and goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="faultloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_open_scopes: list[list[str]] = []


def work_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path under the shared folder; it goes with the innermost `steps` unless kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_scopes and not keep:
        _open_scopes[-1].append(path)
    return path


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """A scope for intermediate tables: what work_dir and settle make in it is deleted at its end.

    Results that are still to be read must be written elsewhere before the scope ends.
    """
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in made:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
