"""Files read by ranges inside tasks: rows carry paths, a task seeks to the bytes it needs, and memory is bounded by a chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, Protocol

#: Bytes that one read of a whole file takes at a time.
CHUNK = 1 << 22


class Bytes(Protocol):
    """Something of known size that can be read at any place."""

    size: int

    def read(self, at: int, n: int) -> bytes: ...


class Held:
    """Bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n] if at >= 0 and n > 0 else b""


class Part:
    """A stretch of other bytes with places counted from its own beginning."""

    def __init__(self, whole: Bytes, at: int, size: int):
        self.whole, self.at = whole, at
        self.size = max(0, min(size, whole.size - at))

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self.whole.read(self.at + at, n) if at >= 0 and n > 0 else b""


class File:
    """A file of any file system that Arrow knows, opened where it lies; plain paths are on a disk that all workers mount."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path:
            system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        else:
            system, inner = fs.LocalFileSystem(), path
        self.file: Any = system.open_input_file(inner)
        self.size: int = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self.file.read_at(n, at) if at >= 0 and n > 0 else b""

    def chunks(self, size: int = CHUNK) -> Iterator[bytes]:
        at = 0
        while data := self.read(at, size):
            yield data
            at += len(data)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *error: object) -> None:
        self.file.close()


def sha256(file: File) -> str:
    """SHA-256 of a whole file in hex, read chunk by chunk."""
    digest = hashlib.sha256()
    for data in file.chunks():
        digest.update(data)
    return digest.hexdigest()
