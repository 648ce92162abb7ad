"""Files at the edges of a run, as data sources of Spark: target lists that people keep by hand, and the roster as files for a spreadsheet.

    spark.dataSource.register(targets.TargetFiles)
    spark.read.format("target_files").load("/shared/targets")          # a file or a folder; a task for each file
    df.write.format("csv_files").option("rows", 50000).mode("overwrite").save("/shared/roster")

Both read and write folders that driver and executors share (a mounted path). Nothing counts before the commit at the end of a job, so a lost task or a second attempt leaves no part of a file."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

TARGETS = "file string, section string, line int, name string, department string, url string, enabled boolean, note string, problem string"
# Sections and keys of a target list.
SECTION, KEY = re.compile(r"^(faculty|news|grants):$"), re.compile(r"^([a-z_]+):\s*(.*)$")
KEYS = {"university_name": "name", "name": "name", "department": "department", "url": "url", "enabled": "enabled", "disabled_reason": "note", "note": "note"}


def parsed(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """Rows of TARGETS of one list: an entry begins with a dash or a section; `problem` says why one can't be used (no name, no address, in no section). Lines that are no key of an entry are passed over, comments too."""
    section, entry, began = None, {}, 0

    def flush():
        if entry:
            lacks = "in no section" if section is None else "no name" if not entry.get("name") else "no address" if not entry.get("url") else None
            yield (file, section, began, *(entry.get(k) or None for k in ("name", "department", "url")), entry.get("enabled") == "true", entry.get("note") or None, lacks)

    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if found := SECTION.match(text):
            yield from flush()
            section, entry = found[1], {}
            continue
        if text.startswith("- "):
            yield from flush()
            entry = {}
        if (pair := KEY.match(re.sub(r"^-\s*", "", text))) and pair[1] in KEYS:
            began = began if entry else number
            entry[KEYS[pair[1]]] = re.sub(r"^[\"']|[\"']$", "", pair[2]).strip()
    yield from flush()


@dataclass
class File(InputPartition):
    path: str


class TargetFiles(DataSource):
    """Target lists: one partition a file, rows of TARGETS."""

    @classmethod
    def name(cls) -> str:
        return "target_files"

    def schema(self) -> str:
        return TARGETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return TargetReader(self.options["path"])


class TargetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[File]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        inside = sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.endswith((".yaml", ".yml")))
        return [File(f) for f in inside] if os.path.isdir(self.path) else [File(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace") as lines:
            yield from parsed(lines, os.path.basename(partition.path))


def usable(rows: DataFrame, section: str) -> DataFrame:
    """Entries of a section that have all they need; those that are off stay, with their reason."""
    return rows.where(F.col("problem").isNull() & (F.col("section") == section))


def enabled_targets(rows: DataFrame, section: str = "faculty") -> DataFrame:
    return usable(rows, section).where("enabled")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CsvFiles(DataSource):
    """Files that a spreadsheet opens: each begins with a byte-order mark and the header and has `rows` rows at most (option, 100,000); lines end in CRLF, cells are text as they come.

    Options: rows; header (off: column names aren't written)."""

    @classmethod
    def name(cls) -> str:
        return "csv_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CsvWriter(self.options["path"], schema.names, int(self.options.get("rows", 100_000)), overwrite, str(self.options.get("header", "true")).lower() != "false")


def cell(value) -> str:
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return '"' + text.replace('"', '""') + '"' if re.search('[",\n\r]', text) else text


class CsvWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], rows: int, overwrite: bool, header: bool):
        self.path, self.names, self.rows, self.overwrite, self.header = path.removeprefix("file://"), names, rows, overwrite, header
        self.run = uuid.uuid4().hex
        self.staged = f"{self.path}/.staged-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.staged, exist_ok=True)
        files, out, n = [], None, 0
        try:
            for row in iterator:
                if out is None or n == self.rows:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.csv")
                    out, n = open(f"{self.staged}/{files[-1]}", "w", encoding="utf-8", newline=""), 0  # noqa: SIM115
                    out.write("﻿" + (",".join(map(cell, self.names)) + "\r\n" if self.header else ""))
                out.write(",".join(map(cell, row)) + "\r\n")
                n += 1
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Puts the files of the tasks that count in place; those of lost or repeated attempts go."""
        os.makedirs(self.path, exist_ok=True)
        before = [f for f in os.listdir(self.path) if f.endswith(".csv")]
        for f in (f for m in messages if m for f in m.files):
            os.replace(f"{self.staged}/{f}", f"{self.path}/{f}")
        for f in before if self.overwrite else []:
            os.remove(f"{self.path}/{f}")
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def register(spark) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(TargetFiles)
    spark.dataSource.register(CsvFiles)
