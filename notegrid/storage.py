"""Versioned Parquet tables and materialisation in the shared folder."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is set only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="notegrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one job, in a folder of their own in the shared folder; close() deletes the folder.

    A job that has written its result elsewhere needs its steps no more; what is written has no lineage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, new_path(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Conflict(Exception):
    """Another writer committed the version first."""


class VersionedTable:
    """A table as full states with numbers 1, 2, ...; a reader takes the highest one that has been committed.

    A writer writes its state into a folder of its own and then commits it under the number after the version that
    it was made from. The commit is a file that is created only if it isn't there (atomic on HDFS, local disks and
    stores with conditional writes; elsewhere one writer at a time must be seen to by the caller), and names the
    folder. So of two writers with one base the second is refused, and upsert() then starts again from what the
    first one made. A commit file that stays empty (its writer died between creating and filling it) ends later
    writes with an error instead of being passed over; readers keep to the version before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _commits(self) -> dict[int, int]:
        """Number: length of its commit file."""
        root = self._at("commits")
        return {int(s.getPath().getName()): s.getLen() for s in self._fs.listStatus(root) if s.getPath().getName().isdigit()} if self._fs.exists(root) else {}

    def latest(self) -> int:
        """Number of the newest version; 0 without any."""
        return max((n for n, size in self._commits().items() if size), default=0)

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._at(f"commits/{number}"))
        try:
            return self._jvm.org.apache.hadoop.io.Text.readString(stream)
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        number = version or self.latest()
        if not number:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/{self._folder(number)}")

    def stage(self, df: DataFrame) -> str:
        """Write a state that no version has yet; its folder's name."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, folder: str, base: int) -> int:
        """Make a staged state the version after base; Conflict if there is one already, or one that isn't finished."""
        number = base + 1
        if max(self._commits(), default=0) > base:
            raise Conflict(f"version {number} of {self.path} exists, or is being committed: {self._at(f'commits/{number}')}")
        try:
            stream = self._fs.create(self._at(f"commits/{number}"), False)
        except Exception as error:  # noqa: BLE001  what the store throws if the file is there
            raise Conflict(f"version {number} of {self.path} exists") from error
        self._jvm.org.apache.hadoop.io.Text.writeString(stream, folder)
        stream.close()
        return number

    def drop(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)

    def write(self, df: DataFrame, base: int | None = None, tries: int = 20) -> int:
        """New version with all of df. base: the version that df was made from; a later one is a Conflict. None: df replaces whatever is there."""
        folder = self.stage(df)
        for left in range(tries, 0, -1):
            try:
                return self.commit(folder, self.latest() if base is None else base)
            except Conflict:
                if base is not None or left == 1:
                    self.drop(folder)
                    raise
                time.sleep(0.2)
        raise AssertionError

    def upsert(self, changes: DataFrame, key: str = "id", tries: int = 20) -> int:
        """New version with the changed rows in place of the old ones; made anew if another writer was first."""
        for left in range(tries, 0, -1):
            base = self.latest()
            old = self.read(base)
            try:
                return self.write(old.join(changes.select(key), key, "left_anti").select(*old.columns).unionByName(changes.select(*old.columns)), base)
            except Conflict:
                if left == 1:
                    raise
                time.sleep(0.2)
        raise AssertionError


class AppendedTable:
    """A table in parts, each written once; a part counts from when its marker is there.

    A job that was stopped before the marker writes its part anew, and of rows that two jobs wrote under one key one
    is read (their other columns must agree, or either must do).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def append(self, df: DataFrame) -> None:
        part = f"part-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        df.select(*columns).write.parquet(f"{self.path}/{part}")
        self._fs.create(self._at(f"commits/{part}"), False).close()

    def read(self, where: str = "true") -> DataFrame:
        """The rows for which `where` holds, one of each key."""
        root = self._at("commits")
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]).filter(where).dropDuplicates(self.key)
