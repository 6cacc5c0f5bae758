"""Numbered versions in a shared folder: each number is made once, whoever tries.

A version is a small JSON file that is written elsewhere and then takes its
name in one step, which fails if the name is taken. Readers take the highest
number, so they see a whole version or the one before it. Local folders and
HDFS have such a step; object stores need a file system that adds one.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; it goes when the application ends. A local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="fieldbook-")
        sc.setCheckpointDir(root)
    folder = f"{root}/fieldbook/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


class Commits:
    """The versions of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.folder))

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def add(self, number: int, content: dict) -> bool:
        """Make a version of this number; False if there is one."""
        part, whole = f"{self.folder}/.part-{uuid.uuid4().hex}", f"{self.folder}/{number:012d}.json"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a local rename would replace the file
                local = lambda p: unquote(urlparse(p).path) if p.startswith("file:") else p
                try:
                    os.link(local(part), local(whole))
                    return True
                except FileExistsError:
                    return False
            return not self.fs.exists(self.path(whole)) and self.fs.rename(self.path(part), self.path(whole))
        finally:
            self.fs.delete(self.path(part), False)

    def drop(self, number: int) -> None:
        self.fs.delete(self.path(f"{self.folder}/{number:012d}.json"), False)


class Snapshot:
    """A table that is overwritten as a whole; readers see the old one or the new one.

    Each write goes to a folder of its own, and a version then points to it. A
    write that died leaves a folder that nothing points to; repeated with the
    same number it takes effect once. The versions before the last `keep` are
    deleted, so readers that started earlier have that many writes' time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.versions = Commits(spark, f"{self.path}/_versions")

    def write(self, rows: DataFrame, number: int | None = None) -> bool:
        """Overwrite the table; False if a write of this number, or a later one, is there already. Of two writers at once one wins."""
        last = self.versions.latest()
        number = (last[0] + 1 if last else 0) if number is None else number
        if last and number <= last[0]:
            return False
        folder = f"data-{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{folder}")
        won = self.versions.add(number, {"folder": folder, "schema": rows.schema.json()})
        if won:
            for old in self.versions.numbers()[: -self.keep]:
                gone = self.versions.read(old)["folder"]
                self.versions.drop(old)
                self.versions.fs.delete(self.versions.path(f"{self.path}/{gone}"), True)
        return won

    def read(self) -> DataFrame | None:
        """The table, or None before the first write."""
        last = self.versions.latest()
        if last is None:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(last[1]["schema"]))).parquet(f"{self.path}/{last[1]['folder']}")


@dataclass
class Lease:
    """The right to do something alone for some seconds, among all drivers that share a folder."""

    commits: Commits
    owner: str
    number: int
    until: float

    def renew(self, seconds: float, now: float | None = None) -> bool:
        """Hold on; False if the lease has been lost to another owner."""
        until = (time.time() if now is None else now) + seconds
        if not self.commits.add(self.number + 1, {"owner": self.owner, "until": until}):
            return False
        self.number, self.until = self.number + 1, until
        return True

    def release(self) -> None:
        """Let others in at once."""
        self.renew(0, now=0)


def lease(spark: SparkSession, folder: str, seconds: float, owner: str | None = None, now: float | None = None) -> Lease | None:
    """A lease, or None while another owner holds one that has not expired.

    Owners' clocks may differ by less than the seconds that a holder leaves
    between its last renewal and the expiry.
    """
    now = time.time() if now is None else now
    owner = owner or uuid.uuid4().hex
    commits = Commits(spark, folder)
    last = commits.latest()
    if last and last[1]["until"] > now:
        return None
    number = last[0] + 1 if last else 0
    if not commits.add(number, {"owner": owner, "until": now + seconds}):
        return None
    for old in commits.numbers():
        if old < number - 8:
            commits.drop(old)
    return Lease(commits, owner, number, now + seconds)
