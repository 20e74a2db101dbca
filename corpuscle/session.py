"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Parquet only: filters and column lists reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers do not share the driver's ``sys.path``; on a cluster they do not share its disk either.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a scan that yields fewer partitions than the cluster has cores enough of them.

    A Parquet file is split only at row groups, so a small input arrives as one partition and would
    keep one core busy. Only then are the (already pruned) rows shuffled round-robin; a scan with
    enough partitions is returned untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in this one process gets a temporary folder, removed at its
    end; any other raises, as its executors may not see this machine's disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return _LOCAL[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder as the workers' file system sees it; the folder must be a mounted one."""
    folder = shared_folder(spark)
    if ":/" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} is no mounted folder")
    return f"{re.sub('^file:/*', '/', folder)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
