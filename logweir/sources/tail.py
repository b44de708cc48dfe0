"""Streaming source for growing and rotating logs.

A log is known by what it holds, not by its name. The offset of a log keeps an identity, the byte
after its last whole line, a hash of the bytes before that (the mark), and a chain of hashes at
places that lie four times as far apart each time (the links). A file goes on as the log whose
mark it holds at the log's offset; under another name, it has to hold the links too. All other
files are new logs and are read from their start. So a log that is emptied, replaced or
written anew is a new one, a renamed log goes on under its new name, a log that was touched gives
nothing, and a log that is gone keeps its offset until it is back. Which log a file is gets
decided once, when it is looked at; ranges of bytes follow from two offsets alone. Only bytes
behind the offset are read. Long ranges are cut into chunks, so a backlog of one log is read by
many tasks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweir.sources.storage import is_log, list_folder_times, read_range, read_text

SCHEMA = "file string, was string, reset boolean, block bigint, pos bigint, value string"
CHUNK_BYTES = 32 * 1024 * 1024
LOOK_BYTES = 64 * 1024
# Bytes hashed by a link, and the end of the first link; each next one lies four times further.
LINK_BYTES = 4 * 1024
# Changed logs that are looked at side by side.
LOOKERS = 16


@dataclass
class ByteRange(InputPartition):
    """Bytes of one log. ``skip_to_line`` marks a chunk that starts inside the range; ``was``
    is the name under which the bytes before the range were read, if it has changed."""

    file: str
    was: str | None
    uri: str
    reset: bool
    start: int
    end: int
    range_end: int
    skip_to_line: bool


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[ByteRange]


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        known = self.options.get("known")
        return TailReader(
            self.options["path"], int(self.options.get("chunkBytes", CHUNK_BYTES)),
            json.loads(read_text(known).splitlines()[-1]) if known else {},
            int(self.options.get("tasks", 0)))


def _hash(*parts: bytes) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()[:16]


def mark_at(uri: str, end: int) -> str:
    """Hash of the LOOK_BYTES (or all) before this place; empty where the file is shorter."""
    start = max(end - LOOK_BYTES, 0)
    data = read_range(uri, start, end - start)
    return _hash(data) if len(data) == end - start else ""


def links_upto(uri: str, end: int, known: list[str]) -> list[str]:
    """Chain of hashes at LINK_BYTES, 4 and 16 times as far, and so on up to ``end``."""
    links, at = list(known), LINK_BYTES * 4 ** len(known)
    while at <= end:
        before = links[-1] if links else ""
        links.append(_hash(before.encode(), read_range(uri, at - LINK_BYTES, LINK_BYTES)))
        at *= 4
    return links


def line_end(uri: str, first: int, size: int) -> int:
    """The place after the last line end behind ``first``; ``first`` if there is none."""
    at = size
    while at > first:
        start = max(at - LOOK_BYTES, first)
        newline = read_range(uri, start, at - start).rfind(b"\n")
        if newline >= 0:
            return start + newline + 1
        at = start
    return first


def new_log() -> dict:
    return {"id": uuid.uuid4().hex[:16], "end": 0, "mark": "", "links": [], "size": -1, "changed": 0}


def advanced(uri: str, log: dict, size: int, changed: int) -> dict:
    """The offset of a log after its last whole line now."""
    end = line_end(uri, log["end"], size)
    if end == log["end"] and log["size"] >= 0:
        return log  # nothing, or a line that is still being written
    return {"id": log["id"], "end": end, "mark": mark_at(uri, end),
            "links": links_upto(uri, end, log["links"]), "size": size, "changed": changed}


class Homeless:
    """Logs that are not under their names any more, found by how a file begins: by their first
    link, or where they are shorter than it, by the mark over all they hold."""

    def __init__(self, logs: dict[str, dict]) -> None:
        self.logs = logs
        self.taken: set[str] = set()
        self.by_link: dict[str, list[str]] = {}
        self.short: dict[int, dict[str, list[str]]] = {}
        for name, log in sorted(logs.items()):
            if log["links"]:
                self.by_link.setdefault(log["links"][0], []).append(name)
            else:
                marks = self.short.setdefault(log["end"], {})
                marks.setdefault(log["mark"], []).append(name)

    def like(self, head: bytes) -> list[str]:
        """Names of logs that begin like a file with this head, longest first."""
        found = self.by_link.get(_hash(b"", head), []) if len(head) == LINK_BYTES else []
        for end in sorted((e for e in self.short if e <= len(head)), reverse=True):
            found = found + self.short[end].get(_hash(head[:end]), [])
        return [n for n in found if n not in self.taken]


class TailReader(DataSourceStreamReader):
    """``known`` are the offsets that the query starts or goes on from. More ranges than ``tasks``
    are read several by a task; 0 stands for a task for each."""

    def __init__(
        self, folder: str, chunk_bytes: int, known: dict | None = None, tasks: int = 0
    ) -> None:
        self.folder = folder.rstrip("/")
        self.chunk_bytes = chunk_bytes
        self.tasks = tasks
        self.first = dict(known or {})
        self.seen: dict[str, dict] = dict(self.first)
        # Size and time of change at the last look, where that left the offset as it was.
        self.stats: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        listed = {
            name: (size, changed) for name, is_folder, size, changed in list_folder_times(self.folder)
            if not is_folder and is_log(name)}
        doubtful = sorted(n for n in listed if self._stat(n) != listed[n])
        with ThreadPoolExecutor(LOOKERS) as pool:
            looked = dict(zip(doubtful, pool.map(lambda n: self._goes_on(n, *listed[n]), doubtful)))
        fresh = [n for n in doubtful if looked[n] is False]
        away = {n for n in self.seen if n not in listed} | {n for n in fresh if n in self.seen}
        homeless = Homeless({n: self.seen[n] for n in away if self.seen[n]["end"]})
        found: dict[str, str] = {}
        for name in fresh:
            if other := self._other_name(name, listed[name][0], homeless):
                found[name] = other
                homeless.taken.add(other)
        logs = {name: self.seen[old] for name, old in found.items()}
        for name in doubtful:
            log = logs.get(name) or (self.seen[name] if looked[name] else new_log())
            try:
                if looked[name] is not None:
                    self.seen[name] = advanced(f"{self.folder}/{name}", log, *listed[name])
                    self.stats[name] = listed[name]
            except OSError:
                continue  # gone in the meantime: try again next time
        # A log that goes on under another name is not waited for under the old one.
        for old in set(found.values()) - set(listed):
            self.seen.pop(old, None)
        return {name: dict(log) for name, log in self.seen.items()}

    def _stat(self, name: str) -> tuple[int, int] | None:
        log = self.seen.get(name)
        return self.stats.get(name, (log["size"], log["changed"]) if log else None)

    def _goes_on(self, name: str, size: int, changed: int) -> bool | None:
        """Whether the file still is the log of this name; None where it cannot be read."""
        log = self.seen.get(name)
        if log is None:
            return False
        try:
            # Written again without growing: the whole chain has to be the same.
            return self._holds(name, size, log, chain=size <= log["size"])
        except OSError:
            return None

    def _holds(self, name: str, size: int, log: dict, chain: bool) -> bool:
        if size < log["end"]:
            return False
        uri = f"{self.folder}/{name}"
        return not log["end"] or (
            mark_at(uri, log["end"]) == log["mark"]
            and (not chain or links_upto(uri, log["end"], []) == log["links"]))

    def _other_name(self, name: str, size: int, homeless: Homeless) -> str | None:
        """The name of a log that is no longer under it and that this file goes on from."""
        try:
            head = read_range(f"{self.folder}/{name}", 0, min(size, LINK_BYTES))
            for old in homeless.like(head):
                if old != name and self._holds(name, size, homeless.logs[old], chain=True):
                    return old
        except OSError:
            pass  # gone in the meantime
        return None

    def partitions(self, start: dict, end: dict) -> list[ByteRange | ByteRanges]:
        ranges: list[ByteRange] = []
        before = {log["id"]: (name, log) for name, log in start.items()}
        for name, now in sorted(end.items()):
            old, log = before.get(now["id"], (None, None))
            was = old if old not in (None, name) else None
            if log and not was and now["end"] == log["end"]:
                continue
            first = log["end"] if log else 0
            for cut in list(range(first, now["end"], self.chunk_bytes)) or [first]:
                ranges.append(
                    ByteRange(
                        name, was, f"{self.folder}/{name}", log is None, cut,
                        min(cut + self.chunk_bytes, now["end"]), now["end"], cut > first,
                    )
                )
        return in_tasks(ranges, self.tasks) if 0 < self.tasks < len(ranges) else ranges

    def read(self, partition: ByteRange | ByteRanges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if isinstance(partition, ByteRanges) else [partition]:
            yield from self._read(part)

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        lines = read_lines(partition)
        if partition.start == partition.range_end:
            lines = [None]  # an emptied or renamed log: one marker row says so
        n = len(lines)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([partition.file] * n, pa.string()),
                pa.array([partition.was] * n, pa.string()),
                pa.array([partition.reset] * n, pa.bool_()),
                pa.array([partition.start] * n, pa.int64()),
                pa.array(range(n), pa.int64()),
                pa.array(lines, pa.string()),
            ],
            names=["file", "was", "reset", "block", "pos", "value"],
        )


def in_tasks(ranges: list[ByteRange], tasks: int) -> list[ByteRanges]:
    """Neighbouring ranges dealt to about as many tasks, or to as many as keep each at
    CHUNK_BYTES. Opening a log counts as LOOK_BYTES."""
    sizes = [r.end - r.start + LOOK_BYTES for r in ranges]
    limit = min(sum(sizes) // tasks + 1, CHUNK_BYTES)
    groups, held = [], limit
    for one, size in zip(ranges, sizes):
        if held + size > limit:
            groups.append(ByteRanges([]))
            held = 0
        groups[-1].ranges.append(one)
        held += size
    return groups


def read_lines(part: ByteRange) -> list[str]:
    """Lines that start inside the chunk; the last one may end behind it. A log that has been
    cut short since it was looked at gives no line: the next look sees the rotation."""
    back = 1 if part.skip_to_line else 0
    wanted = part.end - part.start + back
    data = read_range(part.uri, part.start - back, wanted)
    if len(data) < wanted:
        return []
    if back:
        # The line that runs into this chunk belongs to the chunk before.
        cut = data.find(b"\n")
        if cut < 0:
            return []
        data = data[cut + 1 :]
    at = part.end
    while data and not data.endswith(b"\n") and at < part.range_end:
        more = read_range(part.uri, at, min(LOOK_BYTES, part.range_end - at))
        if not more:
            return []
        newline = more.find(b"\n")
        data += more if newline < 0 else more[: newline + 1]
        at += len(more)
    # Later bytes of a line that is still being written are not part of the range.
    return data.decode("utf-8", "replace").split("\n")[:-1]
