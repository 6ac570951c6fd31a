"""A Python data source that lists a directory tree: spark.read.format("file_inventory").

walk() lists a tree level by level: the folders of a level are a table that all tasks list,
and the folders found in it, less those visited before, are the next. The data source lists
without that: each entry of the tree's first two levels is a partition. Rows carry what scans need before any content is read;
folder is the real path of the folder that was listed, whatever links led there;
content comes only with the option content=true, and only for names that match a pattern
and files up to a size. Errors become rows with a message, not failures.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.patterns import DEFAULT_IGNORED, wildcard_regex
from ..shared import saved

SCHEMA = (
    "relative_path string, absolute_path string, entry_kind string, file_size bigint, mtime_ns bigint, storage_id bigint, "
    "file_id bigint, was_link boolean, stable boolean, sha256 string, content binary, message string, "
    "folder string"
)


FOLDER = "folder"
VISITED = "The folder was visited before."


class Ignore:
    """The same rules as functions.patterns.ignores, for one path at a time."""

    def __init__(self, patterns: list[str]):
        found = [re.sub("/+$", "", p.strip().replace("\\", "/").lstrip("/")) for p in patterns if p.strip() and not p.strip().startswith("#")]
        self.segments = [re.compile(wildcard_regex(p).replace(r"\z", r"\Z")) for p in found if p and "/" not in p]
        self.paths = [re.compile(wildcard_regex(p).replace(r"\z", r"\Z")) for p in found if "/" in p]
        self.folders = [re.compile(wildcard_regex(p + "/*").replace(r"\z", r"\Z")) for p in found if "/" in p]

    def __call__(self, path: str, is_directory: bool) -> bool:
        if any(s.match(x) for x in path.split("/") for s in self.segments) or any(p.match(path) for p in self.paths):
            return True
        return is_directory and any(p.match(path + "/") for p in self.folders)


class Start(InputPartition):
    def __init__(self, relative: str, deep: bool):
        super().__init__(relative)
        self.relative, self.deep = relative, deep


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k: options.get(k, "false").lower() == "true"
        self.root = os.path.realpath(options["path"])
        self.ignore = Ignore(options.get("ignore", "\n".join(DEFAULT_IGNORED)).split("\n"))
        self.follow, self.outside = flag("followlinks"), flag("allowoutsideroot")
        self.content, self.digest = flag("content"), flag("sha256")
        self.most = int(options.get("maxbytes", 64 << 20))
        self.names = re.compile(options.get("names", ""))
        at = os.stat(self.root)
        self.pinned = (at.st_dev, at.st_ino)

    def partitions(self) -> list[InputPartition]:
        """The root's own entries in one partition, each folder of the first level as one
        for its files, and each of the second level as one for its whole subtree."""
        out, todo = [Start("", False)], [("", 1)]
        while todo:
            relative, level = todo.pop()
            for name, info in self._entries(relative):
                path = f"{relative}/{name}" if relative else name
                if not isinstance(info, str) and self._is_folder(path, info) and not self.ignore(path, True):
                    out.append(Start(path, level == 2))
                    if level < 2:
                        todo.append((path, level + 1))
        return out

    def _entries(self, relative: str) -> list[tuple[str, os.stat_result | str]]:
        folder = os.path.join(self.root, relative)
        try:
            names = sorted(os.listdir(folder), key=os.fsencode)
        except OSError as e:
            return [("", str(e.strerror))]
        out = []
        for n in names:
            try:
                out.append((n, os.lstat(os.path.join(folder, n))))
            except OSError as e:
                out.append((n, str(e.strerror)))
        return out

    def _is_folder(self, path: str, info: os.stat_result) -> bool:
        if stat.S_ISLNK(info.st_mode):
            return self.follow and os.path.isdir(os.path.join(self.root, path)) and self._allowed(path)
        return stat.S_ISDIR(info.st_mode)

    def _allowed(self, path: str) -> bool:
        real = os.path.realpath(os.path.join(self.root, path))
        return self.outside or real == self.root or real.startswith(self.root + os.sep)

    def read(self, partition: Start) -> Iterator[tuple]:
        if not self.pinned_still():
            yield self._message(partition.relative, "The root was replaced during the scan.")
            return
        seen = set()
        todo = [partition.relative]
        while todo:
            relative = todo.pop()
            real = os.path.realpath(os.path.join(self.root, relative))
            if real in seen:
                yield self._message(relative, VISITED)
                continue
            seen.add(real)
            inner = []
            for row in self.listed(relative):
                if row[2] != FOLDER:
                    yield row
                else:
                    inner.append(row[0])
            if partition.deep:
                todo += reversed(inner)

    def listed(self, relative: str) -> Iterator[tuple]:
        """The rows of one folder's entries; a folder to be listed in turn is a row of kind
        FOLDER, its real path as absolute_path."""
        real = os.path.realpath(os.path.join(self.root, relative))
        for name, info in self._entries(relative):
            path = f"{relative}/{name}".strip("/")
            if isinstance(info, str):
                yield self._message(path, info)
                continue
            linked = stat.S_ISLNK(info.st_mode)
            if linked and not self.follow:
                continue
            if linked and not self._allowed(path):
                yield self._message(path, "The link leaves the root.")
                continue
            folder = self._is_folder(path, info)
            if self.ignore(path, folder):
                if folder:
                    yield (path, None, "ignored", None, None, None, None, linked, True, None, None, "", real)
            elif folder:
                yield (path, os.path.realpath(os.path.join(self.root, path)), FOLDER, None, None, None, None, linked, True, None, None, "", real)
            else:
                yield (*self._file(path, linked)[:-1], real)

    def pinned_still(self) -> bool:
        at = os.stat(self.root)
        return (at.st_dev, at.st_ino) == self.pinned

    def _message(self, path: str, text: str) -> tuple:
        return (path, None, "warning", None, None, None, None, False, False, None, None, text, None)

    def _file(self, path: str, linked: bool) -> tuple:
        absolute = os.path.join(self.root, path)
        try:
            before = os.stat(absolute)
            if not stat.S_ISREG(before.st_mode):
                return (path, absolute, "unsupported", None, None, None, None, linked, True, None, None, "Not a regular file.", None)
            digest = content = None
            stable = True
            if (self.content or self.digest) and self.names.search(os.path.basename(path)) and before.st_size <= self.most:
                with open(absolute, "rb") as f:
                    opened = os.fstat(f.fileno())
                    hashed, kept = hashlib.sha256(), []
                    while block := f.read(1 << 20):
                        hashed.update(block)
                        if self.content:
                            kept.append(block)
                    after = os.fstat(f.fileno())
                same = lambda a, b: (a.st_dev, a.st_ino, a.st_size, a.st_mtime_ns) == (b.st_dev, b.st_ino, b.st_size, b.st_mtime_ns)
                stable = same(before, opened) and same(opened, after)
                digest = hashed.hexdigest() if self.digest else None
                content = b"".join(kept) if self.content else None
        except OSError as e:
            return self._message(path, str(e.strerror))
        message = "" if stable else "The file changed while it was read."
        return (path, absolute, "file", before.st_size, before.st_mtime_ns, before.st_dev, before.st_ino, linked, stable, digest, content, message, None)


def walk(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The rows of a whole tree, with the data source's options. Levels follow each other,
    and every folder is listed once, by its real path: of several paths to it the one of
    the least level counts, of those the least, and a warning takes the place of each
    other. What is held besides the tables of a level is its number of folders."""
    reader = InventoryReader({k.lower(): v for k, v in options.items()})
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for relative in batch.column(0).to_pylist():
                sound = reader.pinned_still()
                for row in reader.listed(relative) if sound else [reader._message(relative, "The root was replaced during the scan.")]:
                    rows.append(row)
                    held += len(row[10] or b"")
                    if len(rows) == 1000 or held > 64 << 20:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, arrow)

    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([("", reader.root)], "relative_path string, folder string")
    seen, found, others, n = frontier.select("folder"), [], [], 1
    while n:
        level = saved(frontier.repartition(min(n, tasks)).select("relative_path").mapInArrow(run, SCHEMA), "level")
        found.append(level.where(F.col("entry_kind") != FOLDER))
        folders = level.where(F.col("entry_kind") == FOLDER).select("relative_path", F.col("absolute_path").alias("folder"))
        frontier = folders
        if reader.follow:  # else every folder has one path
            least = folders.groupBy("folder").agg(F.min("relative_path").alias("relative_path"))
            frontier = saved(least.join(seen, "folder", "left_anti").select("relative_path", "folder"), "frontier")
            others.append(folders.join(frontier, ["relative_path", "folder"], "left_anti"))
            seen = saved(seen.unionByName(frontier.select("folder")), "visited")
        n = frontier.count()
    told = {"entry_kind": F.lit("warning"), "was_link": F.lit(False), "stable": F.lit(False), "message": F.lit(VISITED)}
    fields = StructType.fromDDL(SCHEMA)
    for again in others:
        found.append(again.select("relative_path", *[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields[1:]]))
    return reduce(DataFrame.unionByName, found)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def visited_once(listed: DataFrame) -> DataFrame:
    """Rows of an inventory that followed links, without those of folders that another path
    reached too: the least path counts, and a warning takes the place of each other one."""
    at = listed.withColumn("_at", F.regexp_replace("relative_path", "/?[^/]*$", ""))
    ways = at.where("folder is not null").select("folder", "_at").distinct()
    first = ways.groupBy(F.col("folder").alias("_real")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = at.join(first, at.folder == F.col("_real"), "left")
    again = F.col("_first").isNotNull() & (F.col("_at") != F.col("_first"))
    kept = met.where(~again).select(listed.columns)
    told = {"relative_path": F.col("_at"), "entry_kind": F.lit("warning"), "was_link": F.lit(False), "stable": F.lit(False), "message": F.lit("The folder was visited before.")}
    others = met.where(again).select("_at").distinct()
    return kept.unionByName(others.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in listed.schema]))


class InventorySource(DataSource):
    """Options: path; ignore (patterns, one a line); followLinks, allowOutsideRoot;
    content, sha256, names (a regular expression of base names), maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventorySource)
