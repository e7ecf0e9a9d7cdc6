"""A response cache that stays where it is: bucketed by key, so lookups move the requests only.

A cache is a folder of versions, each a table in buckets; the file ``current`` names the one in use. Answers are appended in
waves, each whole or not at all, so a run that breaks off is taken up after its last wave. When appends have left many files,
``compact`` writes the next version with one file a bucket and then switches to it.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import opened

BUCKETS, FILES = 200, 8  # buckets of a new cache; files a bucket, on average, from which on it is compacted


class Cache:
    """key, response in buckets of ``key`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.fs, self.root = opened(path)
        self.fs.create_dir(self.root)
        at = posixpath.join(self.root, "current")
        if self.fs.get_file_info(at).type != pafs.FileType.File:
            self._use(0, buckets)
        with self.fs.open_input_stream(at) as f:
            self.version, self.buckets = map(int, f.read().split())

    def _use(self, version: int, buckets: int) -> None:
        at = posixpath.join(self.root, "current")
        with self.fs.open_output_stream(at + ".new") as f:
            f.write(f"{version} {buckets}".encode())
        self.fs.move(at + ".new", at)

    def _name(self, version: int) -> str:
        """The session's name for a version's table."""
        name = f"response_cache_{hashlib.sha256(f'{self.path}/{version}'.encode()).hexdigest()[:16]}"
        where = f"{self.path.rstrip('/')}/v{version}"
        self.fs.create_dir(posixpath.join(self.root, f"v{version}"))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, response STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def table(self) -> DataFrame:
        name = self._name(self.version)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _append(self, rows: DataFrame, version: int) -> None:
        # a task holds whole buckets, so that a wave adds one file to each
        rows.select("key", "response").repartition(self.buckets, "key").write.insertInto(self._name(version))

    def files(self) -> int:
        return sum(i.base_name.endswith(".parquet") for i in self.fs.get_file_info(pafs.FileSelector(posixpath.join(self.root, f"v{self.version}"), allow_not_found=True)))

    def compact(self, most: int = FILES) -> bool:
        """One file a bucket again, if there are more than ``most`` on average; a broken compaction leaves the old version."""
        if self.files() <= most * self.buckets:
            return False
        old, new = self.version, self.version + 1
        place = posixpath.join(self.root, f"v{new}")
        if self.fs.get_file_info(place).type == pafs.FileType.Directory:  # of a compaction that broke off
            self.fs.delete_dir(place)
        # read as plain files, as a bucketed scan would pass for the partitioning asked for
        self._append(self.spark.read.schema("key string, response string").parquet(f"{self.path.rstrip('/')}/v{old}"), new)
        self._use(new, self.buckets)
        self.version = new
        self.spark.sql(f"DROP TABLE {self._name(old)}")
        self.fs.delete_dir(posixpath.join(self.root, f"v{old}"))
        return True

    def known(self, requests: DataFrame) -> DataFrame:
        """``requests`` (with ``key``) that have a response."""
        return requests.join(self.table().hint("shuffle_merge"), "key")

    def missing(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.table().select("key").hint("shuffle_merge"), "key", "left_anti")

    def answered(self, requests: DataFrame, respond: Callable[[DataFrame], DataFrame], waves: int = 1) -> DataFrame:
        """All ``requests`` with their response; what the cache lacks is asked for in waves, each kept before the next."""
        for wave in range(waves):
            part = requests.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
            self._append(respond(self.missing(part).dropDuplicates(["key"])), self.version)
        self.compact()
        return self.known(requests)
