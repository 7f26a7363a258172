"""Tables that are replaced in one step: staged folders and a log of commits.

A version is an entry of the log: which folder holds each table. Frames are
written to new folders first, and only then does an entry name them, so whoever reads sees
all tables of a version or none, a failure leaves the old version, and a
table may be rewritten from itself. Going back is an entry that names old folders;
nothing is copied. Entries are created exclusively: of two writers that began
with one version, the second gets :class:`Conflict`. (The store's
create-if-absent decides; a store without one needs a single writer.)
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, str]
    facts: dict[str, Any] = field(default_factory=dict)


class Versions:
    """The versions of a set of named tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._class = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._class(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        log = self._class(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._store.listStatus(log)] if self._store.exists(log) else []
        return sorted(int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit() and n.endswith(".json"))

    def _entry(self, number: int) -> Version | None:
        """An entry of the log; None if its writer died while writing it."""
        stream = self._store.open(self._class(f"{self.path}/log/{number:012d}.json"))
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return Version(number, held["tables"], held["facts"])

    def latest(self) -> Version:
        """The newest version; number 0 without tables if there is none."""
        for number in reversed(self._numbers()):
            if entry := self._entry(number):
                return entry
        return Version(0, {})

    def get(self, number: int) -> Version:
        found = self._entry(number) if number in self._numbers() else None
        if found is None:
            raise KeyError(f"no version {number}")
        return found

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table of a version (of the newest one)."""
        return self.spark.read.parquet(f"{self.path}/{(self.latest() if number is None else self.get(number)).tables[name]}")

    def stage(self, df: DataFrame, by: str | None = None) -> str:
        """Write ``df`` to a new folder that no version names yet (partitioned by a column); the folder, below ``path``."""
        folder = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{folder}")
        return folder

    def parts(self, folder: str) -> list[str]:
        """The names of the folders in a staged folder."""
        return sorted(s.getPath().getName() for s in self._store.listStatus(self._class(f"{self.path}/{folder}")) if s.isDirectory())

    def commit(self, base: Version, tables: dict[str, str], /, **facts: Any) -> Version:
        """Make ``tables`` the version after ``base``. Raises :class:`Conflict` if there is a newer one than ``base``."""
        numbers = self._numbers()
        number = max([base.number, *numbers]) + 1
        if self.latest().number != base.number:
            raise Conflict(f"version {base.number} is no longer the newest")
        body = json.dumps({"tables": tables, "facts": facts}).encode()
        try:
            out = self._store.create(self._class(f"{self.path}/log/{number:012d}.json"), False)
        except Py4JJavaError as error:
            raise Conflict(f"version {number} was committed meanwhile") from error
        out.write(bytearray(body))
        out.close()
        return Version(number, tables, facts)

    def replace(self, frames: dict[str, DataFrame], /, **facts: Any) -> Version:
        """Write ``frames`` and commit them together; tables that are not named stay as they were. Frames may read the newest version."""
        base = self.latest()
        staged = {name: self.stage(df) for name, df in frames.items()}
        return self.commit(base, base.tables | staged, **(base.facts | facts))

    def restore(self, number: int) -> Version:
        """Make the tables of an older version the newest again."""
        old = self.get(number)
        return self.commit(self.latest(), old.tables, **(old.facts | {"restored": number}))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions names (also those that were staged and never committed); how many."""
        used = set()
        entries = [e for n in self._numbers() if (e := self._entry(n))]
        for entry in entries[-keep:]:
            used |= {t.split("/")[1] for t in entry.tables.values()}
        folder = self._class(f"{self.path}/data")
        gone = [s.getPath() for s in (self._store.listStatus(folder) if self._store.exists(folder) else []) if s.getPath().getName() not in used]
        for path in gone:
            self._store.delete(path, True)
        for entry in entries[:-keep]:
            self._store.delete(self._class(f"{self.path}/log/{entry.number:012d}.json"), False)
        return len(gone)
