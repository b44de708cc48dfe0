"""Deletes that follow each other, each in one step.

A folder of versions holds numbered manifests and what deletes have written. A manifest names
the places of all logs: the folder the logs came from, and one for every delete of which a log
is still current. A delete writes its logs to a folder of its own, then publishes the next
manifest by one rename. Until then nobody sees it; a reader of an earlier version goes on reading
that version, since nothing it names is ever changed. A delete that fails leaves only a folder
that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, SparkSession

from logweir.plans.logset import LogSet, files_of
from logweir.plans.session import configure
from logweir.sources import files
from logweir.sources.storage import delete_folder, list_children, publish_text, qualified, read_text


class LogVersions:
    """The logs of ``path`` under deletes, whose results and manifests are in ``home``."""

    def __init__(self, spark: SparkSession, path: str, home: str) -> None:
        self.spark = configure(spark)
        self.home = qualified(spark, home)
        self.manifests = f"{self.home}/manifests"
        if not self.numbers():
            self._publish(0, [files.resolve_path(spark, path)])

    def numbers(self) -> list[int]:
        """Published versions, ascending."""
        names = [c.name for c in list_children(self.spark, self.manifests)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.manifests}/{number:09d}.json"

    def _publish(self, number: int, places: list[files.LogPath]) -> None:
        rows = [{"folder": p.folder, "name": p.name, "in_parts": p.in_parts,
                 "only": None if p.only is None else sorted(p.only), "without": sorted(p.without)}
                for p in places]
        publish_text(self.spark, self._file(number), json.dumps(rows))

    def places(self, number: int) -> list[files.LogPath]:
        return [
            files.LogPath(r["folder"], r["name"], r["in_parts"],
                          None if r["only"] is None else frozenset(r["only"]), frozenset(r["without"]))
            for r in json.loads(read_text(self._file(number)))]

    def open(self, number: int | None = None) -> LogSet:
        """The logs of a version, by default the last one."""
        source, *rewritten = self.places(self.numbers()[-1] if number is None else number)
        return files_of(self.spark, source, tuple(rewritten))

    def delete(self, doomed: Column, drop_orphans: Column | None = None) -> LogSet:
        """Delete entries of the last version and publish the next one; line numbers are then
        those of the new state. If no entry is meant, there is no new version. Of two deletes
        from one version the second to finish fails and changes nothing."""
        number = self.numbers()[-1]
        log = self.open(number)
        folder = f"{self.home}/deletes/{number + 1:09d}-{uuid.uuid4().hex}"
        after = log.rewrite(doomed, folder, drop_orphans)
        if after is not log:
            self._publish(number + 1, after.sources)
        return after

    def forget(self, keep: int = 1) -> None:
        """Remove all but the last versions, and the written logs that no version left names."""
        numbers = self.numbers()
        kept = {p.folder for n in numbers[-keep:] for p in self.places(n)}
        for number in numbers[:-keep]:
            delete_folder(self.spark, self._file(number))
        for child in list_children(self.spark, f"{self.home}/deletes"):
            if int(child.name.partition("-")[0]) <= numbers[-1] and child.path not in kept:
                delete_folder(self.spark, child.path)
