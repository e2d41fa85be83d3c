"""Stream sources for what changes in place: logs that grow, and folders whose files come, change and go.

Both list their folder on the driver, as Spark's own file source does, and read on the executors. `path` may be any that Arrow's
file systems know.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD, BLOCK = 256, 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; file: URIs come with one slash or three."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[fs.FileInfo]:
    """Files below a folder but for hidden ones, by path."""
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    own = lambda x: not any(part.startswith((".", "_")) for part in x.path[len(root) :].strip("/").split("/"))
    return sorted((x for x in found if x.type == fs.FileType.File and own(x)), key=lambda x: x.path)


class _Lines(InputPartition):
    def __init__(self, path: str, start: int, low: int, high: int):
        super().__init__((path, start, low, high))


def resumed(path: str, file: dict, before: dict, now: dict) -> int:
    """Where to read on in a file: behind what was read of it, also where it has got another name meanwhile (rotation); else at its start.

    A file is known by its head, the first line or the first HEAD bytes of it. One that is shorter than what was read of it is another.
    """
    same = lambda old: old["head"] == file["head"] and old["end"] <= file["end"]
    if path in before and same(before[path]):
        return before[path]["end"]
    gone = [old for name, old in before.items() if (name not in now or now[name]["head"] != old["head"]) and same(old)]
    return max((old["end"] for old in gone), default=0)


class LogReader(DataSourceStreamReader):
    """Whole lines that files of a folder have got since the last batch, by byte offsets for each file.

    An offset says how far each file was read and by what head it is known; a last line without its end waits. Rotated files, that go on
    under another name in the folder, are read on there, and their successors from the start.
    """

    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, _ = _opened(self.path)
        files = {}
        for info in _listed(self.path):
            with system.open_input_file(info.path) as file:
                head = file.read(HEAD)
                cut = head.find(b"\n") + 1
                end = self._last_line(file, info.size)
            if end:
                files[info.path] = {"head": hashlib.sha256(head[: cut or HEAD]).hexdigest(), "end": end}
        return {"files": files}

    @staticmethod
    def _last_line(file, size: int, step: int = 1 << 16) -> int:
        """The end of the last whole line of the file's first `size` bytes."""
        high = size
        while high > 0:
            low = max(0, high - step)
            file.seek(low)
            at = file.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now, out = start["files"], end["files"], []
        for path, file in sorted(now.items()):
            first = resumed(path, file, before, now)
            out += [_Lines(path, first, low, min(low + self.block, file["end"])) for low in range(first, file["end"], self.block)]
        return out

    def read(self, partition: _Lines) -> Iterator[pa.RecordBatch]:
        """Lines that begin in [low, high) of a file that is read from start on."""
        path, start, low, high = partition.value
        system, _ = _opened(self.path)
        with system.open_input_file(path) as file:
            at = low
            if low > start:  # the line that holds the byte before began in another range
                file.seek(low - 1)
                at = low - 1 + len(self._line(file))
            file.seek(at)
            offsets, lines, held = [], [], 0
            while at < high:
                line = self._line(file)
                if not line:
                    break
                offsets.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at, held = at + len(line), held + len(line)
                if held > 4 << 20:
                    yield self._batch(path, offsets, lines)
                    offsets, lines, held = [], [], 0
            if lines:
                yield self._batch(path, offsets, lines)

    @staticmethod
    def _line(file, step: int = 1 << 16) -> bytes:
        """The bytes up to the next line's end, and the file left behind them."""
        parts, at = [], file.tell()
        while part := file.read(step):
            cut = part.find(b"\n")
            if cut >= 0:
                parts.append(part[: cut + 1])
                break
            parts.append(part)
        line = b"".join(parts)
        file.seek(at + len(line))
        return line

    @staticmethod
    def _batch(path: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLog(DataSource):
    """(file, at, line) of text files that are appended to; `path` is their folder."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(dict(self.options))


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(rows)


class FolderReader(DataSourceStreamReader):
    """What became of a folder's files from one listing to the next: created, modified (by size or time), deleted.

    A listing is written below `listings` and the offset names it, so that offsets stay short; a listing that says the same keeps its number.
    """

    def __init__(self, options: dict):
        self.path, self.listings, self.most = options["path"], options["listings"].rstrip("/"), int(options.get("files", 1000))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _stored(self, number: int) -> dict:
        if not number:
            return {}
        system, root = _opened(self.listings)
        with system.open_input_file(f"{root}/{number:09d}.json") as file:
            return json.loads(file.read())

    def latestOffset(self) -> dict:
        system, root = _opened(self.listings)
        system.create_dir(root, recursive=True)
        last = max((int(x.base_name[:9]) for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".json")), default=0)
        now = {x.path: [x.size, x.mtime_ns] for x in _listed(self.path)}
        if now != self._stored(last):
            last += 1
            with system.open_output_stream(f"{root}/{last:09d}.part") as file:
                file.write(json.dumps(now).encode())
            system.move(f"{root}/{last:09d}.part", f"{root}/{last:09d}.json")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self._stored(start["listing"]), self._stored(end["listing"])
        rows = [(p, "deleted", None, None) for p in before.keys() - now.keys()]
        rows += [(p, "modified" if p in before else "created", *now[p]) for p in now if before.get(p) != now[p]]
        rows.sort(key=lambda r: r[0])
        return [_Changes(rows[k : k + self.most]) for k in range(0, len(rows), self.most)] or [_Changes([])]

    def read(self, partition: _Changes) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        rows = []
        for path, kind, size, modified in partition.value:
            digest = None
            if kind != "deleted":
                try:
                    with system.open_input_stream(path) as file:
                        own = hashlib.sha256()
                        while part := file.read(1 << 20):
                            own.update(part)
                    digest = own.hexdigest()
                except FileNotFoundError:  # gone since; the next listing says so
                    pass
            rows.append((path, kind, size, modified and modified // 1000, digest))
        kinds = pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "kind", "length", "modified", "hash"])

    def commit(self, end: dict) -> None:
        """Listings before the one that was handed over are not asked for again, but for the one it is compared with after a restart."""
        system, root = _opened(self.listings)
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.endswith(".json") and int(x.base_name[:9]) < end["listing"] - 1:
                system.delete_file(x.path)


class WatchedFolder(DataSource):
    """(path, kind, length, modified, hash) of the changes below a folder; `listings` is a folder of its own for what was seen."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return "path string, kind string, length long, modified timestamp, hash string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def growing_log(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", folder).option("block", str(block)).load()


def folder_changes(spark: SparkSession, folder: str, listings: str) -> DataFrame:
    spark.dataSource.register(WatchedFolder)
    return spark.readStream.format("watched_folder").option("path", folder).option("listings", listings).load()
