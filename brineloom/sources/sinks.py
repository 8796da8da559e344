"""Writers: staged replacement of a table, upsert by key, point series, provenance."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import socket
import subprocess
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_name(dest: str) -> str:
    """Beside ``dest``, with the host and process that write it."""
    host = "".join(c if c.isalnum() else "_" for c in socket.gethostname())
    return f"{dest.rstrip('/')}.part-{host}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


def replace_table(df: DataFrame, dest: str, partition_by: Sequence[str] = (), rows_per_file: int = 0, kind: str = "parquet") -> None:
    """Write beside ``dest`` and swap it in only when all of it is written; on failure nothing
    changes and the scratch goes.  Goes through Spark's own file systems.  kind: parquet, or csv
    (one file with a header, for reports)."""
    spark = df.sparkSession
    part = scratch_name(dest)
    (scratch, fs), (final, _) = _path(spark, part), _path(spark, dest)
    try:
        writer = df.write.option("compression", "zstd") if kind == "parquet" else df.coalesce(1).write.option("header", True)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.format(kind).save(part)
        old, _ = _path(spark, f"{part}.old")
        had = fs.exists(final)
        if had and not fs.rename(final, old):
            raise OSError(f"{dest} can't be moved aside")
        if not fs.rename(scratch, final):
            if had:
                fs.rename(old, final)
            raise OSError(f"{dest} can't be put in place")
        if had:
            fs.delete(old, True)
    finally:
        if fs.exists(scratch):
            fs.delete(scratch, True)


def sweep(spark: SparkSession, dest: str, max_age_s: float = 6 * 3600) -> int:
    """Delete scratch beside ``dest`` whose writer is gone; returns how many.

    A process of this host is asked for; of other hosts, what nobody has touched for so long goes.
    """
    _, fs = _path(spark, dest)
    here, gone = scratch_name("").split("-")[1], 0
    for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{dest.rstrip('/')}.part-*")) or []:
        named = s.getPath().getName().rsplit(".part-", 1)[1].split("-")
        if len(named) == 3 and named[0] == here and named[1].isdigit():
            dead = not _alive(int(named[1]))
        else:
            dead = datetime.datetime.now().timestamp() - s.getModificationTime() / 1000 > max_age_s
        gone += dead and bool(fs.delete(s.getPath(), True))
    return gone


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def write_text(spark: SparkSession, dest: str, text: str) -> None:
    """A small file, written beside and swapped in."""
    part = scratch_name(dest)
    (scratch, fs), (final, _) = _path(spark, part), _path(spark, dest)
    stream = fs.create(scratch, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(final, False)
    if not fs.rename(scratch, final):
        raise OSError(f"{dest} can't be put in place")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it does not have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(new)


def wide_points(points: DataFrame, sites: Sequence, value: str, at: str = "day", site: str = "site") -> DataFrame:
    """(at, one column a site); the sites are given, so their number is known."""
    return points.groupBy(at).pivot(site, list(sites)).agg(F.first(value))


def wanted_not_cached(want: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    return want.join(cached.select(*keys), list(keys), "left_anti")


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def provenance(spark: SparkSession, config: dict, version: str = "0") -> DataFrame:
    """One run_meta row: UTC now, version, commit with -dirty, key of the configuration."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()
    commit = git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return spark.createDataFrame([(now, version, commit, config_key(config), json.dumps(config, sort_keys=True, default=str))], "written timestamp_ntz, version string, commit string, config_key string, config string")
