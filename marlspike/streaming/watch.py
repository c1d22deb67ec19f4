"""A folder as a stream of changes: a Spark data source whose offsets are snapshots of the folder's listing.

Each snapshot is a file in the folder that ``snapshots`` names, which the tasks must be able to read. A batch compares
two snapshots, so that a batch that is repeated after a failure has the same rows, and a change is told exactly once.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHANGES = "path string, kind string, mtime timestamp, length long"
KINDS = ("file_created", "file_modified", "file_deleted")


def listing(root: str) -> dict[str, tuple[int, int]]:
    """path: (mtime in microseconds, length) of all files below a folder; what goes meanwhile isn't there."""
    out: dict[str, tuple[int, int]] = {}
    todo = [root]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        todo.append(e.path)
                    elif e.is_file():
                        s = e.stat()
                        out[e.path] = (s.st_mtime_ns // 1000, s.st_size)
        except FileNotFoundError:
            continue
    return out


def changes(before: dict, after: dict) -> Iterator[tuple[str, str, int, int]]:
    for path in sorted({*before, *after}):
        if path not in before:
            yield (path, KINDS[0], *after[path])
        elif path not in after:
            yield (path, KINDS[2], *before[path])
        elif before[path] != after[path]:
            yield (path, KINDS[1], *after[path])


class Share(InputPartition):
    """The paths of one part, by their hash, between two snapshots."""

    def __init__(self, start: int, end: int, part: int, parts: int):
        self.start, self.end, self.part, self.parts = start, end, part, parts


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.kept = options["snapshots"].removeprefix("file://")
        self.parts = int(options.get("parts", "4"))
        os.makedirs(self.kept, exist_ok=True)

    def _place(self, n: int) -> str:
        return os.path.join(self.kept, f"{n:012d}.json")

    def _load(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        with open(self._place(n), encoding="utf-8") as f:
            return {p: tuple(x) for p, x in json.load(f).items()}

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The number of the newest snapshot; a new one is made if the folder has changed since."""
        made = sorted(int(f.split(".")[0]) for f in os.listdir(self.kept) if f.endswith(".json"))
        last = made[-1] if made else 0
        now = listing(self.root)
        if now != self._load(last):
            last += 1
            with open(f"{self._place(last)}.part", "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(f"{self._place(last)}.part", self._place(last))
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(start["snapshot"], end["snapshot"], i, self.parts) for i in range(self.parts)]

    def read(self, partition: Share) -> Iterator[tuple]:
        mine = lambda files: {p: x for p, x in files.items() if zlib.crc32(p.encode()) % partition.parts == partition.part}
        for path, kind, mtime, length in changes(mine(self._load(partition.start)), mine(self._load(partition.end))):
            yield path, kind, datetime.fromtimestamp(mtime / 1e6, timezone.utc), length

    def commit(self, end: dict) -> None:
        """Snapshots before the committed one aren't needed any more."""
        for name in os.listdir(self.kept):
            if name.endswith(".json") and int(name.split(".")[0]) < end["snapshot"] - 1:
                os.remove(os.path.join(self.kept, name))


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes").option("path", ...).option("snapshots", ...)``: path, kind, mtime, length."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))
