"""What a Spark session needs before it runs the package's Python inside tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Tables that `written` made, by the identity of their DataFrame.
_tables: dict[int, tuple[weakref.ref, str]] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application, so that tasks import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        bundle = os.path.join(tempfile.mkdtemp(prefix="loomgrid-"), "loomgrid_sources.zip")
        with zipfile.ZipFile(bundle, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(bundle)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Only a session on this machine alone gets one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomgrid-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(out)] = weakref.ref(out), path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written``, once all that reads them is written itself."""
    for df in tables:
        kept, path = _tables.pop(id(df), (None, None))
        if path and kept() is df:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
