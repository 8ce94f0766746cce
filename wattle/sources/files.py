"""File access of the Python data sources: the same calls for a shared folder and a store
named by a scheme, in tasks and in the driver's planning worker."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` (a folder or URI) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def data_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The data files under ``path`` (or ``path`` itself) by name; hidden ones are left out."""
    files, root = filesystem(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(suffixes))


@dataclass
class WrittenPart(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class StagedParts:
    """Parts that tasks write under a hidden folder of the job and the driver moves to
    their names at commit: a part of a failed or repeated attempt is never seen, as only
    the files of the attempts that Spark reports are moved, in the order of partitions."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def stage(self) -> str:
        return posixpath.join(filesystem(self.path)[1], f"_staged-{self.job}")

    def new_file(self) -> tuple[fs.FileSystem, str, int]:
        files, _ = filesystem(self.path)
        files.create_dir(self.stage(), recursive=True)
        task = TaskContext.get()
        return files, posixpath.join(self.stage(), uuid.uuid4().hex), task.partitionId() if task else 0

    def publish(self, messages: list, name: str, extra: dict[str, bytes] | None = None) -> None:
        """Move the parts to ``name`` (a format of the running number), those with rows only;
        ``extra`` are small files besides."""
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        old = [f for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        if old and not self.overwrite:
            raise FileExistsError(f"{self.path} holds files already")
        for f in old:
            files.delete_file(f.path)
        for file, content in (extra or {}).items():
            with files.open_output_stream(posixpath.join(root, file)) as out:
                out.write(content)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        for i, m in enumerate(parts):
            files.move(m.file, posixpath.join(root, name.format(i + 1)))
        self.discard()

    def discard(self) -> None:
        files, _ = filesystem(self.path)
        if files.get_file_info(self.stage()).type == fs.FileType.Directory:
            files.delete_dir(self.stage())
