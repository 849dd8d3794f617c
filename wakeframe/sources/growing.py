"""A stream of the lines of files that grow: only complete lines, each once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Bytes that a task reads at most, and that are looked through at once for the last line end.
SPLIT_BYTES = 32 << 20
LOOK_BYTES = 1 << 16


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceStreamReader):
    """Offsets are the bytes of complete lines of each file, ``{path: bytes}``."""

    def __init__(self, path: str, suffix: str):
        self.system, self.folder = _open(path.rstrip("/"))
        self.suffix = suffix

    def initialOffset(self) -> dict:
        return {}

    def _complete(self, path: str, size: int) -> int:
        """Bytes up to and with the last line end."""
        with self.system.open_input_file(path) as f:
            stop = size
            while stop > 0:
                start = max(0, stop - LOOK_BYTES)
                at = f.read_at(stop - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def latestOffset(self) -> dict:
        files = self.system.get_file_info(fs.FileSelector(self.folder, recursive=True))
        own = [f for f in files if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", "."))]
        return {f.path: self._complete(f.path, f.size) for f in sorted(own, key=lambda f: f.path)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        """Byte ranges; a line belongs to the range in which it begins. A file that shrank begins anew."""
        out = []
        for path, stop in end.items():
            low = start.get(path, 0) if start.get(path, 0) <= stop else 0
            out += [_Range(path, a, min(a + SPLIT_BYTES, stop)) for a in range(low, stop, SPLIT_BYTES)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with self.system.open_input_file(part.path) as f:
            start, data = part.start, f.read_at(part.stop - part.start, part.start)
            if start and f.read_at(1, start - 1) != b"\n":  # the range before has the line
                data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
            at = part.stop
            while data and not data.endswith(b"\n"):
                more = f.read_at(LOOK_BYTES, at)
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
                at += len(more)
                if not more:
                    break
        lines = data.decode("utf-8", "replace").split("\n")[:-1]
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines), pa.string()), pa.array(lines, pa.string())], ["file", "value"])

    def commit(self, end: dict) -> None:
        """Nothing is held outside the offsets."""


class GrowingLines(DataSource):
    """``readStream.format("growing_lines").option("path", folder)`` -> (file, value); option ``suffix`` picks files."""

    @classmethod
    def name(cls):
        return "growing_lines"

    def schema(self):
        return "file string, value string"

    def streamReader(self, schema):
        return _Reader(self.options["path"], self.options.get("suffix", ""))
