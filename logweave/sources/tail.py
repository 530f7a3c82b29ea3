"""Growing text files as a stream: what is appended to a file arrives once, across restarts.

A Python data source whose offsets are, for each file, the bytes up to the end of its last whole line. A batch
reads the bytes between two offsets in ranges of bounded size, one to a task; a line belongs to the range in which it begins.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweave.functions import text as T

FORMAT = "growing_lines"
#: Bytes of a range, of a step back in search of the last line's end, and lines of one batch of rows.
RANGE_BYTES, STEP_BYTES, BATCH_LINES = 64 << 20, 64 << 10, 10_000


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


def whole_lines(store: pafs.FileSystem, path: str, size: int) -> int:
    """Bytes of the file up to the end of its last whole line."""
    with store.open_input_file(path) as file:
        at = size
        while at > 0:
            begin = max(0, at - STEP_BYTES)
            found = file.read_at(at - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


class Range(InputPartition):
    """Lines of ``path`` that begin at ``begin`` or later and before ``end``; ``first`` is where a line is known to begin."""

    def __init__(self, path: str, first: int, begin: int, end: int):
        self.path, self.first, self.begin, self.end = path, first, begin, end


def lines_of(store: pafs.FileSystem, part: Range) -> Iterator[bytes]:
    with store.open_input_file(part.path) as file:
        at, rest = part.begin, b""
        if part.begin > part.first:
            # the line that holds the byte before the range belongs to an earlier range
            at = part.begin - 1
            while True:
                block = file.read_at(STEP_BYTES, at)
                found = block.find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += len(block)
                if not block:
                    return
        while at < part.end or rest:
            block = file.read_at(STEP_BYTES, at + len(rest))
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if at >= part.end:
                    return
                yield line
                at += len(line) + 1
            if not block:
                return
            if at >= part.end:
                return


class TailReader(DataSourceStreamReader):
    def __init__(self, uri: str, glob: str):
        self.uri, self.glob = uri, glob
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = _store(self.uri)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        ends = {}
        for f in found:
            if f.is_file and fnmatch.fnmatch(f.base_name, self.glob):
                size, end = self.seen.get(f.path, (-1, 0))
                if size != f.size:
                    end = whole_lines(store, f.path, f.size)
                    self.seen[f.path] = (f.size, end)
                ends[f.path] = end
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if stop < first:
                first = 0  # the file was cut off or replaced: it is read from its beginning
            out += [Range(path, first, at, min(at + RANGE_BYTES, stop)) for at in range(first, stop, RANGE_BYTES)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.uri)
        name = partition.path.rsplit("/", 1)[-1]
        held: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.string())], names=["source", "line"])

        for line in lines_of(store, partition):
            held.append(line.decode("utf-8", "replace"))
            if len(held) == BATCH_LINES:
                yield batch()
                held = []
        if held:
            yield batch()


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source string, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("glob", "*"))


def follow_text_logs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of the files at ``path`` (a folder or one file) as a stream: (source = file name, line), whitespace around it gone.

    Files may appear, grow, be cut off or replaced; a line is read once it is whole. Broken UTF-8 becomes the replacement character.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(FORMAT).option("path", path)
    raw = (reader.option("glob", glob) if glob else reader).load()
    return raw.select("source", T.strip(F.col("line")).alias("line"))
