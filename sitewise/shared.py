"""Tables written into the cluster's shared folder, to cut lineage where executors can be lost."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_shipped: set[str] = set()


def _own_dir() -> str:
    """A temporary folder of the driver, removed when it ends."""
    made = tempfile.mkdtemp(prefix="sitewise-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver found it; once for a context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():  # else the package was itself read from a zip, which the workers have
        target = Path(_own_dir()) / f"{home.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, Path(home.name) / f.relative_to(home))
        sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset on a local master (tests), an own one."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not named and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"{SETTING} must name a folder that all executors of {master} share")
    if not named and app not in _own:
        _own[app] = "file://" + _own_dir()
    return named or _own[app]


def written(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: what is read again survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/sitewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sitewise_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read any more."""
    path = getattr(df, "_sitewise_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
