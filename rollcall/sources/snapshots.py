"""The stored table as versions that become visible in one step.

A version holds only the rows a merge wrote. It counts once its marker file exists,
and the marker is created last and by one call, so a reader sees all of a version or
nothing of it. A row with an id that an earlier version has replaces that row. Writing
therefore costs as much as the change, not as much as the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.schemas import CANDIDATE

ROW = T.StructType([*CANDIDATE.fields, T.StructField("is_update", T.BooleanType())])


class Snapshots:
    """Versions under one folder of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = ROW):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def markers(self) -> list[dict]:
        """What each published version says of itself, oldest first."""
        folder = self._path("published")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        if not names:
            return []
        lines = self.spark.read.text(f"{self.root}/published", wholetext=True)
        found = [json.loads(row[0]) for row in lines.collect() if row[0].strip()]
        return sorted(found, key=lambda m: m["version"])

    def version(self) -> int:
        """Number of the newest version; changes whenever the table does."""
        markers = self.markers()
        return markers[-1]["version"] if markers else 0

    def has_batch(self, batch: str) -> bool:
        return any(m["batch"] == batch for m in self.markers())

    def publish(
        self,
        rows: DataFrame,
        batch: str,
        replaces_all: bool = False,
        encoder: str | None = None,
        gate: Callable[[DataFrame], None] | None = None,
    ) -> bool:
        """Write a version; a batch that is already there is not written again.

        `encoder` is the id of what made the vectors; None for rows without any. `gate` looks at the
        written rows before they count: if it raises, the version is not published.
        """
        markers = self.markers()
        if any(m["batch"] == batch for m in markers):
            return False
        version = (markers[-1]["version"] if markers else 0) + 1
        if "is_update" not in rows.columns:
            rows = rows.withColumn("is_update", F.lit(False))
        folder = f"rows/{version:08d}-{uuid.uuid4().hex}"
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        rows.select(*columns).write.parquet(f"{self.root}/{folder}")
        if gate is not None:
            gate(self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}"))
        marker = {"version": version, "batch": batch, "folder": folder, "all": replaces_all}
        marker["encoder"] = encoder
        # Fails if another writer published this version first.
        out = self._fs.create(self._path("published", f"{version:08d}.json"), False)
        try:
            out.write(bytearray(json.dumps(marker).encode()))
        finally:
            out.close()
        return True

    def _current(self) -> list[dict]:
        """Markers of the versions that make up the table, from the last whole one on."""
        markers = self.markers()
        return markers[max((i for i, m in enumerate(markers) if m["all"]), default=0) :]

    def encoder(self) -> str | None:
        """The encoder of all stored vectors, from the markers alone; mixed ones are refused."""
        found = {m["encoder"] for m in self._current() if m.get("encoder")}
        if len(found) > 1:
            raise ValueError(f"the table holds vectors of several encoders: {sorted(found)}")
        return found.pop() if found else None

    def read(self) -> DataFrame:
        """The current table: per id the newest version."""
        markers = self._current()
        columns = [f.name for f in CANDIDATE.fields if f.name in self.schema.names]
        if not markers:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        rows = None
        for marker in markers:
            part = self.spark.read.schema(self.schema).parquet(f"{self.root}/{marker['folder']}")
            part = part.withColumn("_version", F.lit(marker["version"]))
            rows = part if rows is None else rows.unionByName(part)
        if len(markers) == 1:
            return rows.select(*columns)
        # Only replaced ids have more than one version, and they are few next to the table.
        newest = rows.where("is_update").groupBy("id").agg(F.max("_version").alias("_newest"))
        current = F.col("_newest").isNull() | (F.col("_version") >= F.col("_newest"))
        return rows.join(newest, "id", "left").where(current).select(*columns)

    def compact(self, versions: int = 1) -> None:
        """Write the current table as one version, if it is made of more than so many."""
        if len(self._current()) > versions:
            batch = f"compact-{uuid.uuid4().hex}"
            self.publish(self.read(), batch, replaces_all=True, encoder=self.encoder())
