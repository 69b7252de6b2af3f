"""Tables with versions, and commits over several of them at once.

A commit writes its tables to folders of their own and then puts down one small numbered file
that names the folder of every table. That file is renamed into place, which fails if the
number is taken: until then nothing of the commit can be seen, and after it all can.
Tables that a commit does not write keep the folder they had.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit came first, or a rule of the commit is broken."""


class Store:
    """The tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """All version numbers, ascending."""
        if not self._fs.exists(self._path("_versions")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("_versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def latest(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version's file says: tables (name to folder and schema) and notes."""
        version = self.latest() if version is None else version
        if not version:
            return {"tables": {}, "notes": {}}
        stream = self._fs.open(self._path(f"_versions/{version:010d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it was in a version (default: the newest)."""
        table = self.entry(version)["tables"].get(name)
        if table is None:
            raise KeyError(f"no table {name} in version {self.latest() if version is None else version}")
        return self.spark.read.schema(table["schema"]).parquet(*(f"{self.root}/{f}" for f in table["folders"]))

    def has(self, name: str, version: int | None = None) -> bool:
        return name in self.entry(version)["tables"]

    def commit(self, tables: dict[str, DataFrame] | None = None, parent: int | None = None, append: dict[str, DataFrame] | None = None, keys: list[tuple[str, str, str, str]] = (), check: Callable[[dict[str, DataFrame]], None] | None = None, notes: dict | None = None) -> int:
        """The number of the new version, which has all of the tables, or none if anything fails.

        tables replace what was there and may be made from it; append adds rows to a table
        without touching those it has. parent: the version that they were made from (default:
        the newest); if another commit came since, this one fails. keys: (table, column, other
        table, its column) that must all be there, nulls apart. check sees the new tables and
        may raise. Every rule is looked at before the version's file is put down.
        """
        parent = self.latest() if parent is None else parent
        before = self.entry(parent)["tables"]
        staged = f"data/{uuid.uuid4().hex}"
        found = dict(before)
        try:
            for name, df in (tables or {}).items():
                df.write.parquet(f"{self.root}/{staged}/{name}")
                found[name] = {"folders": [f"{staged}/{name}"], "schema": self._ddl(df)}
            for name, df in (append or {}).items():
                there = found.get(name, {"folders": [], "schema": self._ddl(df)})
                if there["schema"] != self._ddl(df):
                    raise Conflict(f"rows for {name} have other columns than the table")
                df.write.parquet(f"{self.root}/{staged}/{name}-more")
                found[name] = there | {"folders": [*there["folders"], f"{staged}/{name}-more"]}
            new = lambda name: self.spark.read.schema(found[name]["schema"]).parquet(*(f"{self.root}/{f}" for f in found[name]["folders"]))
            for table, column, other, key in keys:
                lost = new(table).select(F.col(column).alias("k")).filter("k IS NOT NULL").join(new(other).select(F.col(key).alias("k")), "k", "left_anti")
                if lost.limit(1).count():
                    raise Conflict(f"{table}.{column} names rows that {other} does not have")
            if check:
                check({name: new(name) for name in found})
            return self._publish(parent + 1, {"tables": found, "notes": notes or {}})
        except BaseException:
            self._fs.delete(self._path(staged), True)
            raise

    @staticmethod
    def _ddl(df: DataFrame) -> str:
        return df._jdf.schema().toDDL()

    def _publish(self, version: int, entry: dict) -> int:
        """Write the version's file beside its place and rename it there; a taken number is a conflict."""
        self._fs.mkdirs(self._path("_versions"))
        draft, final = self._path(f"_versions/.draft-{uuid.uuid4().hex}"), self._path(f"_versions/{version:010d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), never_over)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise
        return version

    def rollback(self, version: int) -> int:
        """A new version with the tables of an old one."""
        return self._publish(self.latest() + 1, self.entry(version) | {"notes": {"rollback": version}})

    def forget(self, keep: int) -> int:
        """Drop all but the newest `keep` versions, and the folders that no version names; gives back how many folders went.

        Not to be run beside a commit: folders that are being written have no name yet.
        """
        numbers = self.versions()
        for version in numbers[:-keep] if keep else numbers:
            self._fs.delete(self._path(f"_versions/{version:010d}.json"), False)
        named = {f.split("/")[1] for v in self.versions() for t in self.entry(v)["tables"].values() for f in t["folders"]}
        gone = 0
        if self._fs.exists(self._path("data")):
            for f in self._fs.listStatus(self._path("data")):
                if f.getPath().getName() not in named:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone
