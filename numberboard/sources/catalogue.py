"""Several tables that change together: one commit switches all of them.

A version is a small file that names the folders of every table. Folders are written first and never
changed; the file is put in place last, by a rename that fails if that version exists. So readers see all tables of a
commit or none, a failed attempt leaves folders that nobody reads, and of two writers that began from the same version
the second gets ``Conflict`` and has to decide anew. Added rows are folders of their own; eight of one
level are folded into one of the next, so a table has few folders and a row is rewritten once per level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS

FAN = 8
PARTITIONED = {"plate_patterns": ("pattern",)}


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Snapshot:
    """Folders, each with its level, of every table in one version."""

    version: int = 0
    folders: Mapping[str, list[tuple[str, int]]] = field(default_factory=dict)


class Catalogue:
    def __init__(self, spark: SparkSession, root: str, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        path = self._hadoop.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for; version 0 has no tables."""
        if version is None:
            pattern, files = self._path("versions/*.json")
            found = files.globStatus(pattern) or []
            version = max((int(status.getPath().getName().split(".")[0]) for status in found), default=0)
        if not version:
            return Snapshot()
        text = self.spark.read.text(f"{self.root}/versions/{version:010}.json", wholetext=True).first().value
        return Snapshot(version, {name: [tuple(x) for x in folders] for name, folders in json.loads(text).items()})

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table of the newest version, or of the snapshot given, with its declared schema."""
        folders = (snapshot or self.snapshot()).folders.get(name)
        if not folders:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        return self._read(name, [folder for folder, _ in folders])

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*(f"{self.root}/{folder}" for folder in folders)).select(SCHEMAS[name].names)

    def commit(
        self, since: Snapshot, replaced: Mapping[str, DataFrame] | None = None, added: Mapping[str, DataFrame] | None = None
    ) -> Snapshot:
        """The next version after ``since``: tables with new content, and tables with further rows."""
        folders = {name: list(held) for name, held in since.folders.items()}
        for name, rows in (replaced or {}).items():
            folders[name] = [(self._write(name, rows), 0)]
        for name, rows in (added or {}).items():
            held = folders.setdefault(name, [])
            held.append((self._write(name, rows), 0))
            # The first folder is the table as it was loaded; what was added since folds.
            while len(held) > self.fan and len({level for _, level in held[-self.fan :]}) == 1:
                last = held[-self.fan :]
                held[-self.fan :] = [(self._write(name, self._read(name, [folder for folder, _ in last])), last[0][1] + 1)]
        version = since.version + 1
        self._switch(version, json.dumps(folders))
        return Snapshot(version, folders)

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/written={uuid.uuid4().hex}"
        by = PARTITIONED.get(name, ())
        # Rebalanced by the partition, so that a large one is cut into several files and small ones are not.
        (rows.hint("rebalance", *by) if by else rows).write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        return folder

    def _switch(self, version: int, text: str) -> None:
        final, files = self._path(f"versions/{version:010}.json")
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        files.mkdirs(final.getParent())
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} exists: the tables have changed since") from error
            raise
