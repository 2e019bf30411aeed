"""K1 with one commit: a report's sections become visible together.

A writer puts all sections into a folder of its own, which no reader looks at, and then renames one small manifest
into place. Readers take the newest manifest of a report and read the folder it names. A writer that dies before
the rename leaves the previous report as it was; its folder is dead weight that ``sweep`` removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _read(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def manifests(spark: SparkSession, out_dir: str, report_id: str) -> list[str]:
    """Committed manifests of a report, oldest first."""
    return [n for n in _names(spark, f"{out_dir.rstrip('/')}/manifests/{report_id}") if n.endswith(".json")]


def publish(tables: dict[str, DataFrame], out_dir: str, report_id: str) -> dict:
    """Write every section, then commit them with one rename; returns the manifest."""
    tables = {n: df for n, df in tables.items() if df is not None and not n.startswith("_")}
    spark = next(iter(tables.values())).sparkSession
    base = out_dir.rstrip("/")
    folder = f"{base}/data/{report_id}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    where = f"{base}/manifests/{report_id}"
    manifest = {"report_id": report_id, "folder": folder, "sections": {n: df.schema.jsonValue() for n, df in tables.items()}}
    draft = f"{where}/{uuid.uuid4().hex}.draft"
    fs, p = _fs(spark, draft)
    out = fs.create(p)
    try:
        out.write(json.dumps(manifest).encode())
    finally:
        out.close()
    # the next free number; a rename onto a number that another writer has taken fails, and the next one is tried
    done = manifests(spark, base, report_id)
    number = int(done[-1].split(".")[0]) + 1 if done else 0
    while not _commit(spark, draft, f"{where}/{number:012d}.json"):
        number += 1
    return manifest | {"number": number}


def _commit(spark: SparkSession, draft: str, final: str) -> bool:
    """Renames without replacing: False if the name is taken."""
    jvm = spark.sparkContext._jvm
    ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, draft)[0].getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    fs, to = _fs(spark, final)
    try:
        ctx.rename(_fs(spark, draft)[1], to, options)
    except Exception:
        if fs.exists(to):
            return False
        raise
    return True


def published(spark: SparkSession, out_dir: str, report_id: str) -> dict[str, DataFrame]:
    """The sections of the newest committed report; empty if there is none."""
    from pyspark.sql.types import StructType
    done = manifests(spark, out_dir, report_id)
    if not done:
        return {}
    m = _read(spark, f"{out_dir.rstrip('/')}/manifests/{report_id}/{done[-1]}")
    return {n: spark.read.schema(StructType.fromJson(s)).parquet(f"{m['folder']}/{n}") for n, s in m["sections"].items()}


def sweep(spark: SparkSession, out_dir: str, report_id: str, keep: int = 1) -> list[str]:
    """Removes data folders that none of the ``keep`` newest manifests names. Not while a writer is at work."""
    base = out_dir.rstrip("/")
    held = {_read(spark, f"{base}/manifests/{report_id}/{n}")["folder"].rsplit("/", 1)[-1] for n in manifests(spark, base, report_id)[-keep:]}
    gone = [n for n in _names(spark, f"{base}/data/{report_id}") if n not in held]
    for n in gone:
        fs, p = _fs(spark, f"{base}/data/{report_id}/{n}")
        fs.delete(p, True)
    return gone
