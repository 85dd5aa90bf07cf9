"""An object tree as a stream of changes, whose offset is the newest modification seen."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tableferry.functions.names import glob_to_regex
from tableferry.sources.files import locate

CHANGES = "key string, size bigint, modified timestamp"
# Objects written within so many microseconds of the newest one are listed again, as more may come in the same instant.
OVERLAP = 1_000_000
MOST_PARTITIONS = 64


class Folders(InputPartition):
    """Folders of the root that one task lists; '' stands for the objects that lie in the root itself."""

    def __init__(self, names: list[str], after: int, until: int):
        self.names, self.after, self.until = names, after, until


class ObjectReader(DataSourceStreamReader):
    """Lists the tree when asked for the latest offset, and again, folder by folder in the tasks, for a batch's rows.

    The offset is kept in the query's checkpoint, so a stopped watch goes on where it ended. Nothing but the mark is held.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.prefix = options["root"], options.get("prefix") or ""
        self.pattern, self.again = options.get("pattern") or "", options.get("again") or ""

    def initialOffset(self) -> dict:
        return {"modified": -1, "again": 0}

    def latestOffset(self) -> dict:
        newest = max((us for _, _, us in self.found([*self.folders(), ""])), default=-1)
        again = 0
        if self.again:
            store, path = locate(self.again)
            again = int(time.time() * 1000) if store.get_file_info(path).is_file else 0
        return {"modified": newest, "again": again}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folders = self.folders()
        parts = [folders[i::MOST_PARTITIONS] for i in range(min(MOST_PARTITIONS, len(folders)))]
        return [Folders(names, start["modified"] - OVERLAP, end["modified"]) for names in [[""], *parts]]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for key, size, us in self.found(partition.names):
            if partition.after < us <= partition.until:
                yield key, size, datetime.fromtimestamp(us / 1e6, timezone.utc)

    def _children(self, folder: str):
        from pyarrow import fs

        store, path = locate(f"{self.root}/{folder}".rstrip("/"))
        return store.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def folders(self) -> list[str]:
        return sorted(i.base_name for i in self._children("") if not i.is_file)

    def found(self, names: list[str]) -> Iterator[tuple[str, int, int]]:
        """``(key, size, modified in microseconds)`` of the objects under the folders that prefix and pattern allow."""
        wanted = re.compile(glob_to_regex(self.pattern)) if self.pattern else None
        waiting = list(names)
        while waiting:
            folder = waiting.pop()
            for info in self._children(folder):
                key = f"{folder}/{info.base_name}" if folder else info.base_name
                if not info.is_file:
                    if folder:
                        waiting.append(key)
                elif key.startswith(self.prefix) and (not wanted or wanted.search(info.base_name)):
                    yield key, int(info.size or 0), (info.mtime_ns or 0) // 1000


class ObjectSource(DataSource):
    """Format ``objects``: the objects under ``root`` that changed, with options ``prefix``, ``pattern`` and ``again``.

    While a file lies at ``again``, a batch is due even if nothing changed.
    """

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ObjectReader:
        return ObjectReader(dict(self.options))
