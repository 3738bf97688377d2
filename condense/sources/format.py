"""The store and its logs as a Spark data source: ``spark.read.format("condense")``.

A store is a folder with a file a content, named by the content's SHA-256, and possibly ``index.json``.  Reading is
planned by the first characters of hashes, so a filter on ``hash`` leaves few partitions, and of those only
the files asked for.  Writing has two phases: tasks write files under names that no reader takes, and only the
commit of the job gives them their own.  Paths are those of a file system that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STORE = "hash string, content string, size bigint, created_at bigint, last_ref bigint, workspace string, source string, command string, file_path string"
LOG = "type string, session string, level string, at string, line string"
_NAMES = [c.split()[0] for c in STORE.split(", ")]


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters going to its planner."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CondenseSource)


def _path(options: dict) -> str:
    path = options.get("path", "")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _is_hash(name: str) -> bool:
    return len(name) == 64 and set(name) <= set("0123456789abcdef")


class CondenseSource(DataSource):
    """Options: ``path``, and ``kind``: ``store`` (the default) or ``log``."""

    @classmethod
    def name(cls) -> str:
        return "condense"

    def schema(self) -> str:
        return LOG if self.options.get("kind") == "log" else STORE

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(_path(self.options)) if self.options.get("kind") != "log" else LogReader(_path(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StoreWriter(_path(self.options), [f.name for f in schema.fields])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(_path(self.options))


class Hashes(InputPartition):
    """Hashes that begin alike, with what the index says of them."""

    def __init__(self, rows: list[dict]):
        self.value = rows


class StoreReader(DataSourceReader):
    """The rows of the index; where there is none, or it cannot be read or is empty, it is made anew from the files, as far as these
    are what their names say."""

    def __init__(self, path: str):
        self.path, self.asked = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("hash",):
                self.asked = {f.value} if self.asked is None else self.asked & {f.value}
            elif isinstance(f, In) and f.attribute == ("hash",):
                self.asked = set(f.value) if self.asked is None else self.asked & set(f.value)
            yield f  # Spark filters again, which costs nothing

    def _index(self) -> list[dict]:
        try:
            with open(f"{self.path}/index.json", encoding="utf-8") as f:
                rows = json.load(f)["blobs"]
            rows = [r for r in rows if _is_hash(str(r.get("hash", "")))]
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            rows = []
        if rows:
            return rows
        return [{"hash": name} for name in sorted(os.listdir(self.path)) if _is_hash(name)]

    def partitions(self) -> list[InputPartition]:
        own: dict[str, list[dict]] = {}
        for r in self._index():
            if self.asked is None or r["hash"] in self.asked:
                own.setdefault(r["hash"][:2], []).append(r)
        return [Hashes(rows) for _, rows in sorted(own.items())]

    def read(self, partition: Hashes) -> Iterator[tuple]:
        for r in partition.value:
            try:
                with open(f"{self.path}/{r['hash']}", "rb") as f:
                    data = f.read()
                at = int(os.stat(f"{self.path}/{r['hash']}").st_mtime * 1000)
            except OSError:
                continue  # a row without its file is no row
            if len(r) == 1 and hashlib.sha256(data).hexdigest() != r["hash"]:
                continue
            text = data.decode("utf-8", "replace")
            row = {"content": text, "size": len(text), "created_at": at, "last_ref": at, "workspace": "", "source": "", **r}
            yield tuple(row.get(c) for c in _NAMES)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]], rows: list[dict]):
        self.files, self.rows = files, rows


class StoreWriter(DataSourceWriter):
    """Adds contents to a store: ``content`` and, if they are there, the index's other columns."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        os.makedirs(path, exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        files, rows, seen = [], [], set()
        for r in iterator:
            row = dict(zip(self.names, r, strict=True))
            text = row.pop("content", None)
            if text is None:
                continue
            data = text.encode()
            hash_ = hashlib.sha256(data).hexdigest()
            if hash_ not in seen:
                seen.add(hash_)
                own = f"{self.path}/.{uuid.uuid4().hex}.part"
                with open(own, "wb") as f:
                    f.write(data)
                files.append((own, hash_))
            now = int(time.time() * 1000)
            rows.append({"size": len(text), "created_at": now, "last_ref": now, **{k: v for k, v in row.items() if v is not None}, "hash": hash_})
        return Written(files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for own, hash_ in m.files if m else ():
                os.replace(own, f"{self.path}/{hash_}")  # equal names are equal contents
        held = {r["hash"]: r for r in StoreReader(self.path)._index()}
        for m in messages:
            for r in m.rows if m else ():
                old = held.get(r["hash"], {})
                held[r["hash"]] = {**old, **r, "created_at": min(old.get("created_at", r["created_at"]), r["created_at"]), "last_ref": max(old.get("last_ref", 0), r["last_ref"])}
        own = f"{self.path}/.{uuid.uuid4().hex}.part"
        with open(own, "w", encoding="utf-8") as f:
            json.dump({"rev": int(time.time() * 1000), "blobs": list(held.values())}, f)
        os.replace(own, f"{self.path}/index.json")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for own, _ in m.files if m else ():
                if os.path.exists(own):
                    os.remove(own)


class Lines(InputPartition):
    """Bytes ``begin`` to ``end`` of a log file; both are ends of lines."""

    def __init__(self, file: str, begin: int, end: int):
        self.value = (file, begin, end)


def _events(partition: Lines) -> Iterator[tuple]:
    file, begin, end = partition.value
    with open(file, "rb") as f:
        f.seek(begin)
        for line in f.read(end - begin).decode("utf-8", "replace").splitlines():
            try:
                e = json.loads(line)
            except ValueError:
                continue  # a line that is cut or malformed
            if isinstance(e, dict) and e.get("type") is not None:
                yield tuple(None if e.get(k) is None else str(e[k]) for k in ("type", "session", "level", "t")) + (line,)


def _complete(file: str, begin: int) -> int:
    """The end of the last complete line of a file, from ``begin`` on."""
    with open(file, "rb") as f:
        f.seek(0, 2)
        at = f.tell()
        while at > begin:
            start = max(begin, at - 65_536)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return begin


def _logs(path: str) -> list[str]:
    return sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith((".ndjson", ".json")) and not n.startswith((".", "_"))) if os.path.isdir(path) else []


class LogReader(DataSourceReader):
    """The events of all files of a folder, a partition a file; malformed lines are dropped."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Lines(f, 0, os.path.getsize(f)) for f in _logs(self.path)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        return _events(partition)


class LogStream(DataSourceStreamReader):
    """Events as they are appended: an offset is how far each file has been read, which is always the end of a line."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, start: dict | None = None, limit=None) -> dict:
        return {f: _complete(f, 0) for f in _logs(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Lines(f, start.get(f, 0), at) for f, at in sorted(end.items()) if at > start.get(f, 0)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        return _events(partition)

    def commit(self, end: dict) -> None:
        pass
