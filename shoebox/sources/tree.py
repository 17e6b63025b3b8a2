"""A file tree as a Spark data source: folders are listed by tasks, other applications' libraries are never entered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from shoebox.functions import media

FORMAT = "media_tree"
#: The driver lists folders level by level until it knows this many, which become the tasks' parts.
FOLDERS = 256
#: Levels that the driver lists at most; what lies below is listed by the tasks.
LEVELS = 4


@dataclass
class Folder(InputPartition):
    """A folder with all below it, or (``deep`` false) its own files alone."""

    path: str
    deep: bool


def _managed(path: str) -> bool:
    low = path.lower()
    return low.endswith(media.MANAGED_ENDING) or any(mark in low for mark in media.MANAGED_MARKS)


def _media_type(name: str) -> str | None:
    low = name.lower()
    dot = low.rfind(".")
    if dot < 1:
        return None
    return "photo" if low[dot:] in media.PHOTO_EXTENSIONS else "video" if low[dot:] in media.VIDEO_EXTENSIONS else None


def _listed(root: str):  # noqa: ANN202
    """The file system of a root, how its paths begin, and the inner root."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), "", root
    system, inner = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return system, root[: len(root) - len(inner)] if root.endswith(inner) else "", inner


def _entries(system, path: str) -> tuple[list, list[str]]:  # noqa: ANN001
    """Files and folders of one folder; none where it cannot be read or is gone."""
    from pyarrow import fs

    try:
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    except OSError:
        return [], []
    files = [f for f in found if f.type == fs.FileType.File]
    return files, sorted(f.path for f in found if f.type == fs.FileType.Directory and not _managed(f.path))


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"

    def partitions(self) -> list[Folder]:
        system, _, inner = _listed(self.root)
        level, done = [inner], []
        for _ in range(LEVELS):
            below = [f for path in level for f in _entries(system, path)[1]]
            if not below or len(level) + len(done) >= FOLDERS:
                break
            done += [Folder(path, False) for path in level]
            level = below
        return done + [Folder(path, True) for path in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, prefix, _ = _listed(self.root)
        open_ = [partition.path]
        while open_:
            files, folders = _entries(system, open_.pop())
            open_ += folders if partition.deep else []
            for f in files:
                kind = _media_type(f.base_name)
                if kind and not _managed(f.path):
                    yield prefix + f.path, f.mtime, f.size, kind


class MediaTree(DataSource):
    """Media files below the folder of option ``path``: ``path``, ``mtime``, ``bytes``, ``media_type``.

    Folders that cannot be read and files that vanish are passed over; nothing is opened.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, mtime timestamp, bytes long, media_type string"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaTree)
