"""Files of a media library: a listing that reads ends of large files only, and a feed of what is added, changed and removed.

Both are Python data sources over Arrow's file systems (local, HDFS, S3), so nothing needs a file's content in one piece:
``spark.read.format("media_files")`` and ``spark.readStream.format("media_changes")`` once ``register`` has been called.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from framelake.functions.media import AUDIO, IMAGE, VIDEO

#: Bytes at either end of a video or sound file that its hash covers; a part of an image that is read at once.
EDGE, PART = 65_536, 1 << 20
#: Files in one split.
SPLIT = 256
KIND = {e: kind for kind, extensions in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO)) for e in extensions}


def kind_by_name(path: str) -> str | None:
    return KIND.get(os.path.splitext(path.rsplit("/", 1)[-1])[1].lower())


def file_system(folder: str):
    """Arrow's file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def look(folder: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change in milliseconds) of the supported files below a folder, by path; names only, no content.
    Hidden files and folders, and node_modules, are left out."""
    from pyarrow import fs

    store, base = file_system(folder)
    base = base.rstrip("/")
    out = []
    for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        inside = f.path[len(base) :].strip("/").split("/")
        if f.type == fs.FileType.File and kind_by_name(f.path) and not any(p.startswith(".") or p == "node_modules" for p in inside):
            out.append((f.path, f.size, (f.mtime_ns or 0) // 1_000_000))
    return sorted(out)


def content_hash(store, path: str, size: int, mtime: int) -> tuple[str, int]:
    """SHA-256 and the bytes read for it: of an image's whole content, part by part; of other media by size, time and both ends,
    the tail only where the ends don't overlap. A file's place is no part of it."""
    digest, read = hashlib.sha256(), 0
    with store.open_input_file(path) as f:
        if kind_by_name(path) == "image":
            while part := f.read(PART):
                digest.update(part)
                read += len(part)
            return digest.hexdigest(), read
        digest.update(f"v1|{size}|{mtime}|".encode())
        for at in (0, size - EDGE)[: 1 + (size > 2 * EDGE)]:
            f.seek(at)
            part = f.read(EDGE)
            digest.update(part)
            read += len(part)
    return digest.hexdigest(), read


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class MediaFiles(DataSource):
    """Option ``path``: the folder. A file that vanishes, or that can't be read, has no hash."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "file_path string, file_name string, file_size long, mtime long, kind string, file_hash string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return MediaFilesReader(self.options["path"])


class MediaFilesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        found = look(self.folder)
        return [Files(found[i : i + SPLIT]) for i in range(0, len(found), SPLIT)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = file_system(self.folder)
        for path, size, mtime in partition.rows:
            try:
                digest, read = content_hash(store, path, size, mtime)
            except OSError:
                digest, read = None, 0
            yield path, path.rsplit("/", 1)[-1], size, mtime, kind_by_name(path), digest, read


class MediaChanges(DataSource):
    """Options ``path``: the folder; ``state``: a folder for snapshots, beside the query's checkpoint; ``settle``: seconds after
    which a second look must see the same."""

    @classmethod
    def name(cls) -> str:
        return "media_changes"

    def schema(self) -> str:
        return "event string, file_path string, file_size long, mtime long, kind string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MediaChangesReader(self.options["path"], self.options["state"], float(self.options.get("settle", "2")))


class MediaChangesReader(DataSourceStreamReader):
    """The offset is the number of a snapshot; a batch is the difference of two.

    A snapshot is written whole before its number is known to the query, and deleted when a batch that ends with a later one
    is committed, so a restart repeats the same difference or none. Files that differ from the last snapshot enter the next
    one when two looks agree on them: a file that is still being written waits.
    """

    def __init__(self, folder: str, state: str, settle: float):
        self.folder, self.state, self.settle = folder, state, settle

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        number = max(self._numbers(), default=0)
        old, first = self._snapshot(number), {p: (s, m) for p, s, m in look(self.folder)}
        if first == old:
            return {"snapshot": number}
        time.sleep(self.settle)
        second = {p: (s, m) for p, s, m in look(self.folder)}
        new = dict(old)
        for path in first.keys() | second.keys() | old.keys():
            if first.get(path) == second.get(path):
                if path in second:
                    new[path] = second[path]
                else:
                    new.pop(path, None)
        if new == old:
            return {"snapshot": number}
        self._write(number + 1, new)
        return {"snapshot": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        events = [("add" if p not in old else "change", p, *new[p]) for p in sorted(new) if old.get(p) != new[p]]
        events += [("unlink", p, *old[p]) for p in sorted(old) if p not in new]
        return [Files(events[i : i + 16 * SPLIT]) for i in range(0, len(events), 16 * SPLIT)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for event, path, size, mtime in partition.rows:
            yield event, path, size, mtime, kind_by_name(path)

    def commit(self, end: dict) -> None:
        store, base = file_system(self.state)
        for n in self._numbers():
            if n < end["snapshot"]:
                store.delete_file(f"{base}/{n}.json")

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, base = file_system(self.state)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def _snapshot(self, number: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        store, base = file_system(self.state)
        with store.open_input_stream(f"{base}/{number}.json") as f:
            return {p: (s, m) for p, s, m in map(json.loads, f.read().decode().splitlines())}

    def _write(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        store, base = file_system(self.state)
        store.create_dir(base, recursive=True)
        draft = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write("\n".join(json.dumps([p, *files[p]]) for p in sorted(files)).encode())
        store.move(draft, f"{base}/{number}.json")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaFiles)
    spark.dataSource.register(MediaChanges)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder: file_path, file_name, file_size, mtime, kind, file_hash, bytes_read."""
    register(spark)
    return spark.read.format("media_files").option("path", folder).load()


def changes(spark: SparkSession, folder: str, state: str, settle: float = 2.0) -> DataFrame:
    """A stream of (event add, change or unlink, file_path, file_size, mtime, kind)."""
    register(spark)
    return spark.readStream.format("media_changes").option("path", folder).option("state", state).option("settle", str(settle)).load()
