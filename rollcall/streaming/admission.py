"""A streaming source that lets in a bounded number of files a minute and hands out their paths.

Files of an inbox and retries that have come due share one rate. Which of them are let in is written to
a log before the stream hears of it, and an offset is a position in this log. So a stream that is started
again gets the same files for the same offsets, no file twice, and a file that appears late
under an old name or date is still let in. The log also says how many were let in within the last minute.
"""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rollcall.functions.files import SUPPORTED_EXTENSIONS
from rollcall.sources.paths import located

FILES_PER_MINUTE = 14
ADMITTED = "path string, source_file string, length long, attempt int"


@dataclass
class Admitted(InputPartition):
    rows: list[tuple[str, str, int, int]]


class AdmittingReader(DataSourceStreamReader):
    """Options: `path` (the inbox), `log`, `retries` (a folder of JSON lines with path, source_file,
    length and attempt) and `perMinute`."""

    def __init__(self, options: dict):
        self.inbox, self.log = options["path"], options["log"].rstrip("/")
        self.retries = options.get("retries")
        self.per_minute = int(options.get("perminute", options.get("perMinute", FILES_PER_MINUTE)))
        self.clock = time.time
        self.seen: set[str] = set()
        self.lines_read: dict[str, int] = {}
        self.recent: list[tuple[float, int]] = []
        self.position = 0
        for entry in self._entries(0):
            self._remember(entry)

    # The log: one file for each time that files were let in.

    def _entries(self, after: int, upto: int | None = None) -> Iterator[dict]:
        system, folder = located(self.log)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for info in sorted(found, key=lambda i: i.base_name):
            number = info.base_name.removesuffix(".json")
            if number.isdigit() and after < int(number) and (upto is None or int(number) <= upto):
                with system.open_input_file(info.path) as file:
                    yield json.loads(file.read()) | {"number": int(number)}

    def _remember(self, entry: dict) -> None:
        self.position = entry["number"]
        self.recent.append((entry["at"], len(entry["rows"])))
        for path, _, _, attempt in entry["rows"]:
            self.seen.add(f"{attempt}:{path}")

    def _admit(self, rows: list[tuple], now: float) -> None:
        system, folder = located(self.log)
        system.create_dir(folder, recursive=True)
        entry = {"at": now, "rows": rows}
        # Written beside and then renamed, so an entry is there as a whole or not at all.
        name = f"{folder}/{self.position + 1:012d}.json"
        with system.open_output_stream(f"{name}.part") as file:
            file.write(json.dumps(entry).encode())
        system.move(f"{name}.part", name)
        self._remember(entry | {"number": self.position + 1})

    def _due(self) -> list[tuple]:
        if not self.retries:
            return []
        system, folder = located(self.retries)
        rows = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if info.is_file and info.base_name.endswith(".json") and not info.base_name.startswith((".", "_")):
                with system.open_input_file(info.path) as file:
                    for line in file.read().decode().splitlines():
                        row = json.loads(line)
                        rows.append((row["path"], row["source_file"], row.get("length", 0), row["attempt"]))
        return sorted(rows, key=lambda r: (r[3], r[0]))

    def _arrived(self) -> list[tuple]:
        system, folder = located(self.inbox)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        usable = [i for i in found if i.is_file and i.base_name.lower().endswith(tuple(SUPPORTED_EXTENSIONS))]
        usable.sort(key=lambda i: (i.mtime_ns or 0, i.base_name))
        return [(self._uri(i.path), i.base_name, i.size, 0) for i in usable]

    def _uri(self, path: str) -> str:
        """A path of the inbox's file system as an address that others can open."""
        parts = urlsplit(self.inbox)
        if parts.scheme in ("", "file"):
            return path
        return f"{parts.scheme}://{parts.netloc}{path}" if path.startswith("/") else f"{parts.scheme}://{path}"

    # What Spark calls.

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        now = self.clock()
        self.recent = [(at, n) for at, n in self.recent if at > now - 60]
        room = self.per_minute - sum(n for _, n in self.recent)
        if room > 0:
            waiting = [r for r in [*self._due(), *self._arrived()] if f"{r[3]}:{r[0]}" not in self.seen]
            if waiting:
                self._admit(waiting[:room], now)
        return {"position": self.position}

    def partitions(self, start: dict, end: dict) -> list[Admitted]:
        return [Admitted([tuple(r) for r in e["rows"]]) for e in self._entries(start["position"], end["position"])] or [Admitted([])]

    def read(self, partition: Admitted) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """The log stays: it tells which files were let in."""


class AdmittingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "admitting"

    def schema(self) -> str:
        return ADMITTED

    def streamReader(self, schema) -> AdmittingReader:
        return AdmittingReader(dict(self.options))


def admitted_files(spark: SparkSession, inbox: str, log: str, retries: str | None = None, per_minute: int = FILES_PER_MINUTE):
    """A stream of (path, source_file, length, attempt), at most `per_minute` rows in any minute."""
    spark.dataSource.register(AdmittingSource)
    reader = spark.readStream.format("admitting").option("log", log).option("perMinute", per_minute)
    if retries:
        reader = reader.option("retries", retries)
    return reader.load(inbox)


def read_files(admitted: DataFrame) -> DataFrame:
    """Adds `content`, read by the tasks from each path; null where the file is gone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):  # one file at a time is held
                one = batch.iloc[i : i + 1]
                system, path = located(one["path"].iloc[0])
                try:
                    with system.open_input_file(path) as file:
                        content = file.read()
                except FileNotFoundError:
                    content = None
                yield one.assign(content=[content])

    return admitted.mapInPandas(run, f"{ADMITTED}, content binary")


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (name, content) rows as one file each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = located(folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with system.open_output_stream(f"{place}/{name}") as file:
                    file.write(content.encode() if isinstance(content, str) else bytes(content))
            yield pd.DataFrame({"written": [len(batch)]})

    rows.select("name", "content").mapInPandas(run, "written long").write.format("noop").mode("overwrite").save()


def write_archives(rows: DataFrame, folder: str) -> None:
    """Write (archive, doc_id, member, text) rows as one zip file per archive, which is of bounded size."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, text in rows.sort_values("doc_id")[["member", "text"]].itertuples(index=False):
                archive.writestr(member, text)
        system, place = located(folder)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{rows['archive'].iloc[0]}") as file:
            file.write(held.getvalue())
        return pd.DataFrame({"members": [len(rows)]})

    rows.groupBy("archive").applyInPandas(pack, "members long").write.format("noop").mode("overwrite").save()
