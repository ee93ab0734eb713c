"""Versioned keyed tables: every change is a new snapshot, published by creating the next version's file, which only one writer can.

A table is a folder: ``data/<id>`` holds Parquet snapshots, ``versions/<n>.json`` points to one and names what was applied. A change
reads the newest snapshot, merges, writes its own data, and renames its pointer onto version n + 1 without overwriting. If another
writer was first, that fails, and the change is merged again with what the other one left: no field is lost. A change with an id (a
stream's batch) is recorded with its version and applied once, whatever the number of reruns. Renaming without overwriting is one step
on HDFS; on a local disk it is a check and a step, so writers of one driver take turns there. Snapshots that lost a race are removed.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.tables import upserted


_LOCK = threading.Lock()


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    applied: dict[str, int]  # the last change of each source


class Table:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str) -> None:
        self.spark, self.path, self.keys, self.column = spark, path.rstrip("/"), keys, version
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def newest(self) -> Version | None:
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        return self.version(numbers[-1]) if numbers else None

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._at(f"versions/{number:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame | None:
        """The newest snapshot, or that of an earlier version; None before the first change."""
        v = self.newest() if number is None else self.version(number)
        return None if v is None else self.spark.read.parquet(f"{self.path}/data/{v.data}")

    def _publish(self, v: Version) -> bool:
        """Creates the version's file unless it is there: a file of our own is renamed onto the name, which fails where that is taken."""
        own, name = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{v.number:09d}.json")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(json.dumps(v.__dict__), "utf-8"))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self._hadoop.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            with _LOCK:
                context.rename(own, name, how)
        except Py4JJavaError as error:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in error.java_exception.toString():
                return False
            raise
        return True

    def upsert(self, changes: DataFrame, source: str | None = None, change: int | None = None, tries: int = 20) -> Version:
        """Merges the changes by key: for each field the latest value that isn't null, by the version column
        (a merged row has its latest version, which then stands for all of its fields). With a source and a change
        number, a change not above the source's last is skipped. The version that holds the changes."""
        for _ in range(tries):
            base = self.newest()
            if base and source is not None and change is not None and base.applied.get(source, -1) >= change:
                return base
            number = base.number + 1 if base else 0
            data = uuid.uuid4().hex
            now = self.read(base.number) if base else None
            merged = upserted(changes.limit(0) if now is None else now, changes, self.keys, self.column)
            merged.write.parquet(f"{self.path}/data/{data}")
            applied = dict(base.applied) if base else {}
            if source is not None and change is not None:
                applied[source] = change
            v = Version(number, data, applied)
            if self._publish(v):
                return v
            self._fs.delete(self._at(f"data/{data}"), True)
        raise RuntimeError(f"{self.path}: {tries} other changes came first")

    def kept(self, versions: int) -> None:
        """Removes all but the newest versions and their data."""
        newest = self.newest()
        for n in range(max(0, (newest.number if newest else 0) - versions + 1)):
            if self._fs.exists(self._at(f"versions/{n:09d}.json")):
                v = self.version(n)
                self._fs.delete(self._at(f"versions/{n:09d}.json"), False)
                self._fs.delete(self._at(f"data/{v.data}"), True)


def fed(stream: DataFrame, table: Table, name: str, checkpoint: str):
    """A streaming query that upserts every batch into the table once, whatever is rerun."""
    return stream.writeStream.foreachBatch(lambda batch, i: table.upsert(batch, name, i)).queryName(name).option("checkpointLocation", checkpoint)
