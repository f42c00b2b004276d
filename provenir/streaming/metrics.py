"""Metrics retention as a stream: each batch of snapshots folds into the kept history, bucket by bucket."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.operators.metrics import MAX_SNAPSHOTS, retain

#: Hash buckets of a history. A batch rewrites the buckets of its objects only.
BUCKETS = 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^\w+:/", path) else (fs.LocalFileSystem(), path)


class History:
    """A history at ``target``: folders of buckets, and numbered manifests that say which folder each bucket is."""

    def __init__(self, target: str):
        self.target = target.rstrip("/")
        self.files, self.base = _opened(self.target)

    def manifests(self) -> list[dict]:
        """Those that are kept, oldest first."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/manifests", allow_not_found=True))
        names = sorted(i.path for i in found if re.search(r"/\d{12}\.json$", i.path))
        return [json.loads(self.files.open_input_stream(n).read()) for n in names]

    def put(self, manifest: dict) -> None:
        self.files.create_dir(f"{self.base}/manifests", recursive=True)
        part = f"{self.base}/manifests/part-{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as out:
            out.write(json.dumps(manifest).encode())
        self.files.move(part, f"{self.base}/manifests/{manifest['number']:012d}.json")

    def expire(self) -> None:
        """Keep the last two manifests, and the folders that they name."""
        kept = self.manifests()[-2:]
        named = {f for m in kept for f in m["buckets"].values()}
        for info in self.files.get_file_info(fs.FileSelector(f"{self.base}/manifests", allow_not_found=True)):
            if not any(info.path.endswith(f"/{m['number']:012d}.json") for m in kept):
                self.files.delete_file(info.path)
        for batch in self.files.get_file_info(fs.FileSelector(f"{self.base}/data", allow_not_found=True)):
            name = posixpath.basename(batch.path)
            mine = {f for f in named if f.startswith(f"{name}/")}
            if not mine:
                self.files.delete_dir(batch.path)
                continue
            for bucket in self.files.get_file_info(fs.FileSelector(batch.path)):
                if bucket.type == fs.FileType.Directory and f"{name}/{posixpath.basename(bucket.path)}" not in mine:
                    self.files.delete_dir(bucket.path)

    def read(self, spark: SparkSession, schema, manifest: dict | None, buckets: set[int] | None = None) -> DataFrame:
        """The snapshots that a manifest names, of some buckets or of all."""
        some = [f"{self.target}/data/{f}" for b, f in (manifest or {"buckets": {}})["buckets"].items() if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)


def history(spark: SparkSession, target: str, schema) -> DataFrame:
    """The kept snapshots at ``target``."""
    all_ = History(target)
    return all_.read(spark, schema, next(reversed(all_.manifests()), None))


def fold(target: str, keep: int = MAX_SNAPSHOTS, *, stream: str = "snapshots", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last ``keep`` snapshots (id, seq, ...) per object at ``target``.

    Only the buckets of the batch's objects are read and written, so work follows the batch and not the history. A batch
    is in the history once its manifest is: until then readers see the one before, and a batch that is repeated starts
    from there again, with the same result. Folders that the last two manifests don't name are deleted. ``stream`` names
    the checkpoint: a stream that starts anew on another one takes another name and goes on with the history. One stream
    writes a history at a time; the number of buckets stays as it was at first. Rows without an id are left out.
    """
    held = History(target)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = held.manifests()
        if kept and (kept[-1]["stream"], kept[-1]["batch"]) == (stream, number):
            kept.pop()  # this batch again
        base = kept[-1] if kept else {"number": -1, "buckets": {}, "size": buckets}
        size = base["size"]
        new = batch.filter("id is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")).persist()
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
        folder = f"{base['number'] + 1:012d}"
        if touched:
            before = held.read(spark, batch.schema, base, touched)
            out = retain(before, new.drop("bucket"), keep).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(size)).cast("int"))
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{held.target}/data/{folder}")
        new.unpersist()
        names = base["buckets"] | {str(b): f"{folder}/bucket={b}" for b in touched}
        held.put({"number": base["number"] + 1, "stream": stream, "batch": number, "size": size, "buckets": names})
        held.expire()

    return run
