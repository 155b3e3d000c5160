"""Several tables as one version: a log of manifests, of which a reader pins one and a writer adds the next or is refused."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Versions:
    """Tables below a folder that executors and drivers share.

    ``_log/<number>.json`` names the folders of all tables of a version, with some values of the caller. Tables are written
    whole before their manifest appears by a rename that fails if the name is taken, so a writer that dies leaves the former
    version as it was, and of two writers with the same base one gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        log = self._hadoop(f"{self.path}/_log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """0 before the first commit."""
        return max(self.numbers(), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.latest() if number is None else number
        if not number:
            return {"tables": {}, "values": {}}
        stream = self._fs.open(self._hadoop(self._name(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(number)["tables"][name])

    def written(self, df: DataFrame, name: str, partition: str | None = None) -> str:
        """Write a table of the version to come; its folder."""
        at = f"{self.path}/data/{uuid.uuid4().hex}/{name}"
        (df.write.partitionBy(partition) if partition else df.write).parquet(at)
        return at

    def commit(self, base: int, tables: dict[str, str | None], values: dict | None = None) -> int:
        """The version after ``base``: its tables with those given in place (None: dropped) and its values updated."""
        now = self.manifest(base)
        kept = {n: p for n, p in (now["tables"] | tables).items() if p}
        text = json.dumps({"tables": kept, "values": now["values"] | (values or {})}, sort_keys=True)
        draft, final = f"{self.path}/_log/.{uuid.uuid4().hex}", self._name(base + 1)
        out = self._fs.create(self._hadoop(draft), True)
        out.write(text.encode())
        out.close()
        if not self._claimed(draft, final):
            raise Conflict(f"version {base + 1} of {self.path} exists")
        return base + 1

    def write(self, base: int, tables: dict[str, DataFrame], values: dict | None = None) -> int:
        return self.commit(base, {n: self.written(df, n) for n, df in tables.items()}, values)

    def rotate(self, keep: int = 5) -> list[int]:
        """Drop all but the newest ``keep`` versions, and the folders that no version left refers to; the numbers dropped.

        Readers of a version that goes must have ended, and no writer may be at work: its folders have no manifest yet.
        """
        numbers = self.numbers()
        gone, left = numbers[: max(0, len(numbers) - keep)], numbers[max(0, len(numbers) - keep) :]
        used = {p for n in left for p in self.manifest(n)["tables"].values()}
        for n in gone:
            self._fs.delete(self._hadoop(self._name(n)), False)
        data = self._hadoop(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if not any(f"/{f.getPath().getName()}/" in p for p in used):
                self._fs.delete(f.getPath(), True)
        return gone

    def _name(self, number: int) -> str:
        return f"{self.path}/_log/{number:012d}.json"

    def _claimed(self, draft: str, final: str) -> bool:
        """Rename unless the name is taken, in one step; a local rename would overwrite, a hard link doesn't."""
        if urlparse(self.path).scheme in ("", "file"):
            plain = lambda p: urlparse(p).path
            try:
                os.link(plain(draft), plain(final))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(plain(draft))
        return bool(self._fs.rename(self._hadoop(draft), self._hadoop(final)))
