"""A table by key of which a merge rewrites only the partitions that its rows fall into."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has changed the same partitions meanwhile."""


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists; of several writers one succeeds. A local one appears whole (by a
    hard link); other stores create files exclusively."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        local = p.toUri().getPath()
        draft = f"{local}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class KeyedTable:
    """Rows by key in `partitions` hash partitions. A version is a small file that names the folder of every
    partition; it is created at once or not at all, and folders are never changed after."""

    def __init__(self, spark: SparkSession, path: str, key: str, partitions: int = 64):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions
        at = spark._jvm.org.apache.hadoop.fs.Path
        self._root = at(f"{self.path}/versions")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, number: int) -> dict | None:
        text = "".join(r[0] for r in self.spark.read.text(f"{self._root.toString()}/v{number:020d}.json", wholetext=True).collect())
        try:
            return json.loads(text)
        except ValueError:  # its writer died
            return None

    def versions(self) -> list[int]:
        return [n for n in self._listed() if self._manifest(n)]

    def newest(self) -> tuple[int, dict]:
        """The number and content of the newest complete version."""
        for n in reversed(self._listed()):
            if m := self._manifest(n):
                return n, m
        return 0, {"batch": 0, "schema": None, "partitions": self.partitions, "folders": {}}

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/{f}" for k, f in sorted(manifest["folders"].items()) if only is None or int(k) in only]
        return self.spark.read.schema(manifest["schema"]).parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(self.newest()[1])

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], *, number: int | None = None) -> list[int]:
        """Merge rows by key into the partitions they fall into; returns those. Numbered batches are taken in
        once: one whose number is not above the last is left out.

        The rows are written first, then the version is claimed. A version that came between stays, if it
        touched other partitions; otherwise this merge fails with Conflict and nothing of it is seen.
        """
        base, manifest = self.newest()
        if number is not None and number <= manifest["batch"]:
            return []
        place = F.pmod(F.xxhash64(self.key), F.lit(manifest["partitions"])).cast("int")
        touched = sorted(r[0] for r in batch.select(place).distinct().collect())
        if not touched:
            return []
        stored = self._rows(manifest, touched)
        merged = batch if stored is None else combine(stored, batch).select(batch.columns)
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("_part", place).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        schema = batch._jdf.schema().toDDL()
        while True:
            now, current = self.newest()
            if now != base:
                changed = {k for k in {*current["folders"], *manifest["folders"]} if current["folders"].get(k) != manifest["folders"].get(k)}
                if changed & set(map(str, touched)) or number is not None and number <= current["batch"]:
                    raise Conflict(f"partitions {sorted(changed)} have changed since version {base}")
            text = json.dumps({"batch": current["batch"] if number is None else number, "schema": schema, "partitions": manifest["partitions"], "folders": current["folders"] | {str(k): f"{folder}/_part={k}" for k in touched}})
            if create_new(self.spark, f"{self._root.toString()}/v{max([0, *self._listed()]) + 1:020d}.json", text):
                return touched
