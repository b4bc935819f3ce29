"""PGM files as a Spark data source: ``spark.read.format("pgm").load(folder)`` and ``images.write.format("pgm").save(folder)``.

Read: (path, h, w, px), one partition for at most ``filesPerPartition`` (64) files; a file that is no PGM is left out.
Written: rows (img, h, w, px), one file ``<img>.pgm`` each; ``levels`` is auto (default), auto2, auto3 or "low,high", and ``ascii`` writes P2.
Tasks write hidden files of their own; the driver gives them their names when all tasks are done, so a failed job leaves no
file and a task that runs twice counts once.  Two rows of one name are an error.  Mode ``overwrite`` replaces the PGM files of the folder, once the new ones are written.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenfuse.sources import files


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _listed(path: str) -> list[str]:
    from pyarrow import fs

    where, top = _folder(path)
    found = where.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".pgm") and not f.base_name.startswith("."))


@dataclass
class Some(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, str]]


class PgmReader(DataSourceReader):
    def __init__(self, path: str, each: int) -> None:
        self.path, self.each = path, each

    def partitions(self) -> list[Some]:
        paths = _listed(self.path)
        return [Some(paths[i : i + self.each]) for i in range(0, len(paths), self.each)]

    def read(self, partition: Some) -> Iterator[tuple]:
        where, _ = _folder(self.path)
        for p in partition.paths if partition else []:
            with where.open_input_stream(p) as f:
                x = files.decode_pgm(f.read())
            if x is not None:
                yield p, x.shape[0], x.shape[1], x.ravel().tolist()


class PgmWriter(DataSourceWriter):
    def __init__(self, path: str, levels: str, ascii_body: bool, overwrite: bool) -> None:
        self.path, self.overwrite, self.ascii_body = path, overwrite, ascii_body
        self.levels = tuple(float(x) for x in levels.split(",")) if "," in levels else levels
        self.job = f".pgm-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        where, top = _folder(self.path)
        where.create_dir(f"{top}/{self.job}", recursive=True)
        parts = []
        for r in rows:
            name = re.sub(r"[/\0]", "_", str(r["img"]))
            x = np.array(r["px"], float).reshape(r["h"], r["w"])
            with where.open_output_stream(part := f"{top}/{self.job}/{uuid.uuid4().hex}") as out:
                out.write(files.encode_pgm(files.to_levels(x, self.levels), self.ascii_body))
            parts.append((part, f"{top}/{name}.pgm"))
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        where, top = _folder(self.path)
        where.create_dir(top, recursive=True)
        parts = [p for m in messages if m for p in m.parts]
        if len({to for _, to in parts}) < len(parts):
            self.abort(messages)
            raise ValueError("two images have one name")
        for part, to in parts:
            where.move(part, to)
        if self.overwrite:
            for old in set(_listed(self.path)) - {to for _, to in parts}:
                where.delete_file(old)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What the job wrote and did not name goes."""
        from pyarrow import fs

        where, top = _folder(self.path)
        if where.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{top}/{self.job}")


class PgmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgm"

    def schema(self) -> str:
        return "path string, h int, w int, px array<double>"

    def reader(self, schema: StructType) -> PgmReader:
        return PgmReader(self.options["path"], max(1, int(self.options.get("filesPerPartition", 64))))

    def writer(self, schema: StructType, overwrite: bool) -> PgmWriter:
        missing = {"img", "h", "w", "px"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return PgmWriter(self.options["path"], self.options.get("levels", "auto"), self.options.get("ascii", "false").lower() == "true", overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("pgm")`` known to a session."""
    spark.dataSource.register(PgmSource)
