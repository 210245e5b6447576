"""Plain files in the shared folder, written and read by tasks. Any store that pyarrow's file systems reach will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext


def system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def attempt_path(folder: str, stem: str, number: int, suffix: str) -> str:
    """A name that no other attempt of any task writes: a failed attempt's file is never taken for a result, since only
    the names that successful tasks return are read."""
    c = TaskContext.get()
    return f"{folder}/{stem}-{c.partitionId():06d}-{c.taskAttemptId()}-{number:04d}{suffix}"


class Blocks:
    """Random access to a file by blocks, of which the last few are kept."""

    def __init__(self, uri: str, size: int = 1 << 20, kept: int = 4):
        fs, path = system(uri)
        self.length = fs.get_file_info(path).size
        self.file = fs.open_input_file(path)
        self.size, self.most, self.kept = size, kept, {}

    def _block(self, k: int) -> bytes:
        if k not in self.kept:
            while len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            self.kept[k] = self.file.read_at(min(self.size, self.length - k * self.size), k * self.size)
        return self.kept[k]

    def read(self, start: int, n: int) -> bytes:
        end, out = min(self.length, start + n), []
        while start < end:
            k, at = divmod(start, self.size)
            part = self._block(k)[at : at + end - start]
            out.append(part)
            start += len(part)
        return b"".join(out)

    def stream(self, start: int, step: int = 1 << 16) -> Iterator[bytes]:
        while start < self.length:
            part = self.read(start, min(step, self.size - start % self.size))
            yield part
            start += len(part)

    def find(self, what: bytes, start: int, end: int | None = None) -> int:
        """Place of the next occurrence, which lies before ``end``, or -1."""
        end = self.length if end is None else min(end, self.length)
        while start < end:
            part = self.read(start, min(self.size + len(what) - 1, end - start))
            if (at := part.find(what)) >= 0:
                return start + at
            start += self.size
        return -1

    def close(self) -> None:
        self.file.close()
