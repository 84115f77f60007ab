"""Keyed tables fed by streams: rows of any age update their bucket, and a repeated batch changes nothing.

A table is a folder with ``data/<version>/_bucket=<b>/`` files and one small manifest per committed batch, which names the
folder that holds each bucket now. A batch reads the present rows of the buckets it touches, combines them with its own, writes
new folders for those buckets and then a manifest; the manifest's success mark commits it. Readers follow the newest manifest,
so they never see half a batch, and read no version that has been replaced. A batch whose manifest exists is passed over.

One stream writes to a table at a time. Replaced folders and folders of failed attempts are left to ``expire``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, target: str) -> list[str]:
    """Names of committed manifests, oldest first."""
    fs, root = _files(spark, f"{target}/manifest")
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    return [n for n in names if fs.exists(_files(spark, f"{target}/manifest/{n}/_SUCCESS")[1])]


def _folders(spark: SparkSession, target: str, names: list[str]) -> dict[str, str]:
    """Bucket to folder below ``target``; one entry per bucket ever filled."""
    if not names:
        return {}
    rows = spark.read.schema("bucket string, folder string").parquet(f"{target}/manifest/{names[-1]}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _read(spark: SparkSession, target: str, folders: dict[str, str], schema: StructType) -> DataFrame:
    """Rows of the given buckets with their bucket."""
    fields = StructType([f for f in schema if f.name != BUCKET])
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(fields).parquet(*[f"{target}/{f}" for f in folders.values()])
    bucket = F.regexp_extract(F.col("_metadata.file_path"), f"/{BUCKET}=([^/]*)/", 1)
    return rows.withColumn(BUCKET, bucket).select(*schema.names)


def merge_batch(
    batch: DataFrame, batch_id: int, target: str, writer: str, bucket: Column, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame]
) -> None:
    """Merges one batch into the table; rows without a bucket are left out. Buckets are names of letters, digits and ``-_.``.

    ``combine`` brings the union of old and new rows (with ``_bucket``) back to one row per key, in the same columns.
    """
    spark = batch.sparkSession
    names = _manifests(spark, target)
    mark = f"-{writer}-{batch_id}"
    if any(n.endswith(mark) for n in names):
        return
    new = batch.withColumn(BUCKET, bucket.cast("string")).filter(F.col(BUCKET).isNotNull()).persist()
    try:
        present = _folders(spark, target, names)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        old = _read(spark, target, {b: present[b] for b in touched if b in present}, new.schema)
        seq = f"{int(names[-1].split('-')[0]) + 1 if names else 0:010d}"
        version = f"data/{seq}-{uuid.uuid4().hex}"
        if touched:
            rows = combine(old.unionByName(new))
            rows.repartitionByRange(BUCKET, *keys).write.partitionBy(BUCKET).parquet(f"{target}/{version}")
        folders = present | {b: f"{version}/{BUCKET}={b}" for b in touched}
        spark.createDataFrame(sorted(folders.items()), "bucket string, folder string").coalesce(1).write.parquet(f"{target}/manifest/{seq}{mark}")
    finally:
        new.unpersist()


def run_merge(
    rows: DataFrame, target: str, checkpoint: str, bucket: Column, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Merges every micro-batch of ``rows`` until the source is empty. Batches are known by checkpoint folder and number."""
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, target, writer, bucket, keys, combine)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table as of its newest manifest; empty before the first."""
    return _read(spark, target, _folders(spark, target, _manifests(spark, target)), StructType([f for f in schema if f.name != BUCKET]))


def expire(spark: SparkSession, target: str) -> int:
    """Deletes the versions that the newest manifest does not name; no reader or writer may be at work. Returns their number."""
    used = {f.split("/")[1] for f in _folders(spark, target, _manifests(spark, target)).values()}
    fs, root = _files(spark, f"{target}/data")
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in used] if fs.exists(root) else []
    for path in old:
        fs.delete(path, True)
    return len(old)
