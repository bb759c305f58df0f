"""Session helpers: table loading, checkpoint folder, sized broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder of this machine is used; on a cluster that would lose data with an
    executor, so it is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Like a checkpoint, but columnar: later readers prune columns and see exact sizes. The folder is
    unique to the call.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_folder(spark), f"{label}-{uuid.uuid4().hex}.parquet")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written by this application and not yet removed.
_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Remove all tables that ``written`` has made so far; call it when no result built on them is read
    any more. The number of tables removed."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


@atexit.register
def _clean_files() -> None:
    """What is left at the end of the application, where it lies in a file system seen from here."""
    for path in _WRITTEN:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves that ``df`` has at most ``max_rows`` rows."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def clean_name(col):
    """Names compare after trimming blanks and lower-casing."""
    return F.lower(F.btrim(col, F.lit(" \t\n\x0b\f\r")))


#: Session settings the engine is designed for; ``tune`` applies those the caller left unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the engine's defaults to a session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers find it
    wherever they run. The archive is served by the driver."""
    context = spark.sparkContext
    if getattr(context, "_sparkloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sparkloom", os.path.relpath(full, here)))
    context.addPyFile(archive)
    context._sparkloom_shipped = True
