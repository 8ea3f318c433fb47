"""Blank-line separated records as a splittable Spark data source.

A file is cut into byte ranges.  Each range finds its first record by itself: it
looks for the first blank line that ends at or behind its start, and reads on
past its end to complete its last record, so every record belongs to exactly
one range whatever the cut.  Line ends may be LF, CRLF or CR, also mixed.

The source yields raw records (``file, start, closed, value``); parsing them is
left to column expressions.  Files are opened through ``pyarrow.fs`` (local
paths, HDFS, S3, GCS and whatever else it knows).
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "sentiforge_records"
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20
# two line ends or more, a CRLF is never taken for two; it starts with a set of characters, which the engine looks for quickly
_BREAKS = re.compile(rb"[\r\n](?:\r|(?<=\n)\n|\n[\r\n])[\r\n]*")
_TAIL = 4            # bytes of the longest two line ends


def records(f, start: int, end: int, block: int = _BLOCK) -> Iterator[tuple[int, bool, bytes]]:
    """(offset, ended by a blank line, bytes) of the records that begin in ``start <= offset < end``."""
    base = max(0, start - _TAIL)
    f.seek(base)
    held, scan = bytearray(), 0
    at = 0 if start == 0 else None      # where the present record begins
    while True:
        data = f.read(block)
        held += data
        whole = not data
        for m in _BREAKS.finditer(held, scan):
            if m.end() == len(held) and not whole:
                break                    # the blank lines may go on
            if at is not None and base + m.start() > at:
                yield at, True, bytes(held[at - base:m.start()])
            if base + m.end() >= start:
                at = base + m.end()
                if at >= end:
                    return
        if whole:
            if at is not None and at < base + len(held):
                yield at, False, bytes(held[at - base:])
            return
        keep = max(0, len(held) - _TAIL) if at is None else at - base
        del held[:keep]
        base += keep
        scan = max(0, len(held) - _TAIL)
        while scan and held[scan - 1:scan] in (b"\r", b"\n"):
            scan -= 1                    # a run of line ends is looked at as one


def _opened(path: str):
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str, int]]:
    """(as given to ``_opened``, path inside the file system, size) of a file, a folder or a glob, hidden names left out."""
    from pyarrow import fs
    system, inner = _opened(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in inner for c in "*?["):
        root = posixpath.dirname(inner[:re.search(r"[*?\[]", inner).start()]) or "/"
        pattern = re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]" else re.escape(c) for c in inner) + r"\Z")
        every = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [i for i in every if pattern.match(i.path)]
    else:
        found = [system.get_file_info(inner)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    out = []
    for i in found:
        inside = system.get_file_info(fs.FileSelector(i.path)) if i.type == fs.FileType.Directory else [i]
        out += [(prefix + j.path, j.path, j.size) for j in inside
                if j.type == fs.FileType.File and not posixpath.basename(j.path).startswith(("_", "."))]
    return sorted(out)


class Ranges(InputPartition):
    """Byte ranges ``(file, start, end)`` of one task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        """Ranges of ``splitBytes`` at most; small files share a task up to that size."""
        out, pack, size = [], [], 0
        for path in self.paths:
            for name, _, length in _files(path):
                for start in range(0, length, self.split):
                    end = min(start + self.split, length)
                    if pack and size + end - start > self.split:
                        out.append(Ranges(pack))
                        pack, size = [], 0
                    pack.append((name, start, end))
                    size += end - start
        return [*out, Ranges(pack)] if pack or not out else out

    def read(self, partition):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.string())],
                names=["file", "start", "closed", "value"])

        rows, size = [], 0
        for name, start, end in partition.ranges:
            system, inner = _opened(name)
            with system.open_input_file(inner) as f:
                for at, closed, raw in records(f, start, end):
                    rows.append((name, at, closed, raw.decode("utf-8", "replace")))
                    size += len(raw)
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class RecordSource(DataSource):
    """``spark.read.format("sentiforge_records")``; options ``paths`` (a JSON list) and ``splitBytes``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "file string, start long, closed boolean, value string"

    def reader(self, schema):
        return RecordReader(self.options)


def read_records(spark: SparkSession, paths, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, start, closed, value)`` of the records of a file, folder or glob, or of a list of them."""
    spark.dataSource.register(RecordSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(NAME).option("paths", json.dumps(paths)).option("splitBytes", str(split_bytes)).load()
