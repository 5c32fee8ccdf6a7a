"""A folder of numbered commits: each number is claimed by one writer, and readers need the last ones alone."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

# Commits between two folds.
FOLD_EVERY = 10


class CommitLog:
    """Small JSON documents named by their number, below one folder of any store that Spark reaches.

    A commit is written beside the log and moved to its number in one step that fails if the number is taken, so of two writers one
    goes on to the next number. Order is that of the numbers; no clock is asked. `folded-N` holds what commits up to N come
    to, so a reader opens the last fold and the commits after it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self) -> list[str]:
        folder = self._path(self.folder)
        return [s.getPath().getName() for s in self._store.listStatus(folder)] if self._store.exists(folder) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names() if n[0].isdigit())

    def folds(self) -> list[int]:
        return sorted(int(n.removeprefix("folded-").removesuffix(".json")) for n in self._names() if n.startswith("folded-"))

    def _read(self, name: str) -> dict:
        stream = self._store.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, name: str, record: dict) -> bool:
        """Write a document under a name that nobody has; False if somebody was first."""
        beside, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        stream = self._store.create(beside, False)
        try:
            stream.write(json.dumps(record).encode())
        finally:
            stream.close()
        try:
            if self._store.getScheme() == "file":  # a local rename replaces what is there; a link does not
                os.link(beside.toUri().getPath(), final.toUri().getPath())
                return True
            # Stores that refuse to rename onto a name do so in one step.
            return not self._store.exists(final) and self._store.rename(beside, final)
        except FileExistsError:
            return False
        finally:
            self._store.delete(beside, False)

    def append(self, record: dict) -> int:
        """Commit under the next free number, and give it."""
        number = (self.numbers() or self.folds() or [-1])[-1] + 1
        while not self._claim(f"{number:020}.json", record):
            number += 1
        return number

    def claim(self, number: int, record: dict) -> bool:
        return self._claim(f"{number:020}.json", record)

    def last(self) -> tuple[int, dict | None]:
        """The newest commit and its number, or (-1, None)."""
        numbers = self.numbers()
        return (numbers[-1], self._read(f"{numbers[-1]:020}.json")) if numbers else (-1, None)

    def tail(self) -> tuple[dict | None, list[tuple[int, dict]]]:
        """The last fold, and the commits after it in order."""
        folds = self.folds()
        fold = self._read(f"folded-{folds[-1]:020}.json") if folds else None
        after = [n for n in self.numbers() if not folds or n > folds[-1]]
        return fold, [(n, self._read(f"{n:020}.json")) for n in after]

    def fold(self, number: int, record: dict) -> None:
        """Keep what commits up to `number` come to. What the fold before stood for is no longer needed."""
        before = self.folds()
        self._claim(f"folded-{number:020}.json", record)
        for old in before[:-1]:
            self._store.delete(self._path(f"{self.folder}/folded-{old:020}.json"), False)
        for n in self.numbers() if before else []:
            if n <= before[-1]:
                self.forget(n)

    def forget(self, number: int) -> None:
        self._store.delete(self._path(f"{self.folder}/{number:020}.json"), False)

    def remove(self, folder: str) -> None:
        """Remove a data folder that no commit names any more."""
        self._store.delete(self._path(folder), True)
