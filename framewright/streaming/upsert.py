"""A table that a stream keeps up to date by key: new rows are added, and a row replaces an older one of its key.

Rows are dealt out to buckets by key. A micro-batch rewrites the buckets that it touches, each as a new version beside the old
one, and then commits by replacing the manifest, which names the version of every bucket and the last batch. A batch that
is run again, after a failure before or after the commit, finds this out from the manifest; so the table is the same
as without the failure. Readers follow the manifest and see whole batches only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.framefiles import opened

MANIFEST = "_manifest.json"


class UpsertTable:
    """keys: the columns of the key; order: the column by which the later of two rows of a key is known, unique for a key."""

    def __init__(self, path: str, keys: list[str], order: str, buckets: int = 16):
        self.path, self.keys, self.order, self.buckets = path, keys, order, buckets

    def manifest(self) -> dict:
        system, root = opened(self.path)
        if not system.get_file_info(f"{root}/{MANIFEST}").is_file:
            return {"batch": -1, "schema": None, "buckets": self.buckets, "versions": {}}
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())

    def _commit(self, manifest: dict) -> None:
        system, root = opened(self.path)
        temporary = f"{root}/_{uuid4().hex}.json"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps(manifest).encode())
        system.move(temporary, f"{root}/{MANIFEST}")

    def _rows(self, spark: SparkSession, manifest: dict, buckets: list[str]) -> DataFrame | None:
        folders = [f"{self.path}/{manifest['versions'][b]}" for b in buckets if b in manifest["versions"]]
        return spark.read.schema(manifest["schema"]).parquet(*folders) if folders else None

    def read(self, spark: SparkSession) -> DataFrame:
        m = self.manifest()
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.path}: nothing is committed")
        rows = self._rows(spark, m, list(m["versions"]))
        return rows if rows is not None else spark.createDataFrame([], m["schema"])

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. A batch that is committed already changes nothing."""
        m = self.manifest()
        if batch_id <= m["batch"]:
            return
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        spark, n = batch.sparkSession, m["buckets"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n))
        newest = Window.partitionBy(*self.keys).orderBy(F.desc(self.order))
        last = lambda rows: rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
        batch.persist()
        try:
            touched = [str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most n
            if touched:
                old = self._rows(spark, m, touched)
                rows = last(batch if old is None else old.select(*batch.columns).unionByName(batch)).withColumn("_bucket", bucket)
                version = f"batch={batch_id}-{uuid4().hex}"
                rows.repartition(max(len(touched), 1), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
                m["versions"].update({b: f"{version}/_bucket={b}" for b in touched})
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            self._commit(m | {"batch": batch_id, "schema": schema})
        finally:
            batch.unpersist()

    def sink(self) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: self.upsert(batch, batch_id)

    def vacuum(self) -> int:
        """Deletes the folders of versions that no bucket refers to; only while nothing reads older ones or writes."""
        system, root = opened(self.path)
        from pyarrow import fs

        used = {v.partition("/")[0] for v in self.manifest()["versions"].values()}
        stale = [i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name not in used]
        for i in stale:
            system.delete_dir(i.path)
        return len(stale)
