"""Keyed tables with merge: the latest row of each key, in immutable files behind an atomic manifest.

A table is cut into parts by a column. A merge rewrites only the parts that its batch touches, into a new folder, and then publishes a manifest that
names the folder of every part. Readers see one manifest or the next, never a mixture; merging the same batch again changes
nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.store.files import SharedFiles

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Conflict(Exception):
    """Another writer published first."""


def safe(name: str) -> str:
    """An identifier that may go into SQL text; raises ValueError for anything else."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


def merge_statement(target: str, staging: str, columns: list[str], keys: list[str], where: str | None = None) -> str:
    """A MERGE for table formats that have one: keys are never updated, all other columns overwritten, not accumulated."""
    cols, on = [safe(c) for c in columns], [safe(k) for k in keys]
    if not on or not set(on) <= set(cols):
        raise ValueError("keys must be columns")
    sets = ", ".join(f"t.{c} = s.{c}" for c in cols if c not in on)
    return (
        f"MERGE INTO {safe(target)} t USING {safe(staging)} s ON {' AND '.join(f't.{k} <=> s.{k}' for k in on)}"
        + (f" WHEN MATCHED{' AND ' + where if where else ''} THEN UPDATE SET {sets}" if sets else "")
        + f" WHEN NOT MATCHED THEN INSERT ({', '.join(cols)}) VALUES ({', '.join('s.' + c for c in cols)})"
    )


def staging_name(job: str, target: str) -> str:
    """The same for every run of a job, so that a retry overwrites."""
    return f"stg_{safe(job)}_{safe(target)}"


class KeyedTable:
    PARTS = "_part"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], part: str | None = None):
        """part: the column that cuts the table, one of the keys; without it the table is one part."""
        if part is not None and part not in keys:
            raise ValueError("the part column must be a key, or a key could be in two parts")
        self.spark, self.path, self.schema, self.keys, self.part = spark, path.rstrip("/"), schema, list(keys), part
        self.files = SharedFiles(spark, self.path)

    def _manifest(self) -> dict:
        names = self.files.names("_manifests")
        return {"notes": {}} | json.loads(self.files.read(f"_manifests/{names[-1]}")) if names else {"version": 0, "parts": {}, "batches": {}, "notes": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some parts (those that there are): no file of another part is opened."""
        there = self._manifest()["parts"]
        return self._read(sorted(f for p, f in there.items() if parts is None or p in parts))

    @property
    def parts(self) -> list[str]:
        return sorted(self._manifest()["parts"])

    @property
    def batches(self) -> dict[str, int]:
        """The last batch of each writer."""
        return self._manifest()["batches"]

    @property
    def notes(self) -> dict:
        """What the last replacement published along with its content."""
        return self._manifest()["notes"]

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def merge(self, batch: DataFrame, keep_first: tuple[str, ...] = (), writer: str = "batch", batch_id: int | None = None) -> int:
        """Overwrites the rows of the batch's keys and adds new ones; the version after.

        keep_first: columns whose old value stays unless it is null. The batch must have each key once. With a batch_id, a batch that the
        writer merged before is left out.
        """
        now = self._manifest()
        if batch_id is not None and now["batches"].get(writer, -1) >= batch_id:
            return now["version"]
        columns = self.schema.names
        fresh = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(self.PARTS, F.coalesce(F.col(self.part).cast("string"), F.lit("null")) if self.part else F.lit("all"))
        fresh = fresh.persist()
        try:
            touched = [r[0] for r in fresh.select(self.PARTS).distinct().collect()]  # parts, not rows
            old = self._read([now["parts"][p] for p in touched if p in now["parts"]])
            if keep_first:
                was = old.select(*self.keys, *[F.col(c).alias("_was_" + c) for c in keep_first])
                on = [F.col("n." + k).eqNullSafe(F.col("o." + k)) for k in self.keys]
                both = fresh.alias("n").join(was.alias("o"), on, "left")
                fresh_rows = both.select(*[F.coalesce(F.col("_was_" + c), F.col("n." + c)).alias(c) if c in keep_first else F.col("n." + c) for c in [*columns, self.PARTS]])
            else:
                fresh_rows = fresh
            part_of = F.coalesce(F.col(self.part).cast("string"), F.lit("null")) if self.part else F.lit("all")
            gone = fresh.select(*[F.col(k).alias("_k_" + k) for k in self.keys])
            stays = old.withColumn(self.PARTS, part_of).join(gone, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in self.keys], "left_anti")
            version = now["version"] + 1
            folder = f"v{version:08d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
            fresh_rows.select(*columns, self.PARTS).unionByName(stays.select(*columns, self.PARTS)).withColumn("_folder", F.col(self.PARTS)).drop(self.PARTS).hint("rebalance", "_folder").write.partitionBy("_folder").parquet(f"{self.path}/{folder}")
            written = {n.split("=", 1)[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_folder=")}
            if len(written) != len(touched):
                raise RuntimeError("a part was lost in writing")
            names = {self._escaped(p): p for p in touched}
            parts = now["parts"] | {names[k]: v for k, v in written.items()}
            batches = now["batches"] | ({writer: batch_id} if batch_id is not None else {})
            if not self.files.publish(f"_manifests/{version:08d}.json", json.dumps({"version": version, "parts": parts, "batches": batches, "notes": now["notes"]})):
                raise Conflict(self.path)
            return version
        finally:
            fresh.unpersist()

    def _escaped(self, value: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def replace(self, rows: DataFrame, replaced: Callable[[str], bool] = lambda part: True, notes: dict | None = None) -> int:
        """New content for the parts that `replaced` names (all of them by default), published at once and with notes; rows must belong to such parts."""
        now = self._manifest()
        version = now["version"] + 1
        folder = f"v{version:08d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        part_of = F.coalesce(F.col(self.part).cast("string"), F.lit("null")) if self.part else F.lit("all")
        cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        cast.withColumn("_folder", part_of).hint("rebalance", "_folder").write.partitionBy("_folder").parquet(f"{self.path}/{folder}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        fresh = {unescape(n.split("=", 1)[1]): f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_folder=")}
        if not all(map(replaced, fresh)):
            raise ValueError("rows of a part that is not replaced")
        parts = {p: f for p, f in now["parts"].items() if not replaced(p)} | fresh
        if not self.files.publish(f"_manifests/{version:08d}.json", json.dumps({"version": version, "parts": parts, "batches": now["batches"], "notes": now["notes"] if notes is None else notes})):
            raise Conflict(self.path)
        return version

    def vacuum(self) -> None:
        """Deletes the folders and manifests that are no longer current; no reader of an older one may be at work."""
        named = {f.split("/")[0] for f in self._manifest()["parts"].values()}
        for n in self.files.names(""):
            if n.startswith("v") and n not in named:
                self.files.delete(n)
        for n in self.files.names("_manifests")[:-1]:
            self.files.delete(f"_manifests/{n}")
