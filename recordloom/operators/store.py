"""A snapshot store of records in a folder of any Hadoop file system.

Layout: base/<version>/ (Parquet sorted by id), wal/<version>/ (pending actions), index/<name>/<version>/, and
manifest/<version>.json. A version exists once its manifest does; a manifest is written aside and then renamed, which
fails if its number is taken, so of two writers with the same base version one fails and looks again: if the versions in between touched other records it goes on
from the newest, else it raises CommitConflict. Readers use one version throughout and need no lock.

Actions are pending until `threshold` of them are; then a commit writes a new base. A manifest also names the last batch
of each stream that its version holds, so a batch is applied and marked in one step. Indexes are built aside and renamed
too, once for each version. Freshness is a version number, never a clock.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import CommitConflict
from recordloom.operators import index, log
from recordloom.sources.text import ACTIONS, RECORDS

THRESHOLD = 100
INDEXES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "packed": index.packed_by_key,
    "exploded": index.exploded_by_key,
    "numeric": lambda pairs: index.numeric(index.exploded_by_key(pairs)),
    "profile": index.profile,
    "universe": index.universe,
}


@dataclass(frozen=True)
class Version:
    number: int = 0
    base: str | None = None
    wal: tuple[str, ...] = field(default=())
    pending: int = 0
    next_seq: int = 0
    #: The actions that made this version, for conflict checks.
    made_by: str | None = None
    #: The last batch of each stream of actions that this version holds.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, threshold: int = THRESHOLD) -> None:
        self.spark, self.root, self.threshold = spark, root.rstrip("/"), threshold
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def versions(self) -> list[int]:
        folder = f"{self.root}/manifest"
        if not self._exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        numbers = self.versions()
        if not numbers:
            return Version()
        row = self.spark.read.text(f"{self.root}/manifest/{numbers[-1] if number is None else number}.json", wholetext=True).first()
        found = json.loads(row["value"])
        return Version(**found | {"wal": tuple(found["wal"])})

    def _renamed(self, aside: str, path: str) -> bool:
        """Whether what was written aside now has its name; if another has it, ours goes."""
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(aside), self._path(path), options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or self._exists(path):
                return False
            raise
        return True

    def _publish(self, version: Version) -> bool:
        """Whether this manifest is the first of its number."""
        aside = f"{self.root}/manifest/.{version.number}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), False)
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()
        return self._renamed(aside, f"{self.root}/manifest/{version.number}.json")

    def base(self, v: Version) -> DataFrame:
        return self.spark.read.schema(RECORDS).parquet(v.base) if v.base else self.spark.createDataFrame([], RECORDS)

    def pending(self, v: Version) -> DataFrame:
        return self.spark.read.schema(ACTIONS).parquet(*v.wal) if v.wal else self.spark.createDataFrame([], ACTIONS)

    def records(self, v: Version | None = None, only: DataFrame | None = None) -> DataFrame:
        """Records of a version (default: the newest), pending actions replayed; if asked, only those of some ids."""
        v = v or self.version()
        base, pending = self.base(v), self.pending(v)
        if only is not None:
            base, pending = (x.join(only, "uuid", "left_semi") for x in (base, pending))
        return log.replayed_cells(base, pending) if v.wal else base

    def apply(self, wal: DataFrame, compact: bool = False, batch: tuple[str, int] | None = None) -> Version:
        """Validates all actions against the newest version and commits them as one, or raises and changes nothing.

        A batch (of a stream, its number) that a version already holds isn't applied again.
        """
        wal = wal.select("seq", "op", "uuid", "fields").persist()
        try:
            return self._applied(wal, compact, batch)
        finally:
            wal.unpersist()

    def load(self, base: DataFrame, pending: DataFrame) -> Version:
        """Adds the records of a database and then its pending actions, as one commit."""
        adding = base.select(F.lit(0).cast("long").alias("seq"), F.lit("+").alias("op"), "uuid", "fields")
        return self.apply(adding.unionByName(pending.select((F.col("seq") + 1).alias("seq"), "op", "uuid", "fields")))

    def _applied(self, wal: DataFrame, compact: bool, batch: tuple[str, int] | None) -> Version:
        base, touched = self.version(), wal.select("uuid").distinct()
        while True:
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            batches = base.batches | dict([batch] if batch else [])
            now = self.records(base, touched).persist()  # as many records as the actions touch
            try:
                log.validate(now, wal)
            finally:
                now.unpersist()
            number = base.number + 1
            n, top = wal.agg(F.count(F.lit(1)), F.coalesce(F.max("seq"), F.lit(0))).first()
            if not n and not compact:
                return base
            made = f"{self.root}/wal/{number}-{uuid.uuid4().hex}"
            wal.select((F.col("seq") + base.next_seq).alias("seq"), "op", "uuid", "fields").write.parquet(made)
            after = Version(number, base.base, (*base.wal, made), base.pending + n, base.next_seq + top + 1, made, batches)
            if compact or after.pending >= self.threshold:
                folder = f"{made.replace('/wal/', '/base/')}"
                self.records(after).orderBy("uuid").write.parquet(folder)
                after = Version(number, folder, (), 0, 0, made, batches)
            if self._publish(after):
                return after
            base = self._rebased(base, wal)

    def _rebased(self, base: Version, wal: DataFrame) -> Version:
        newest = self.version()
        for n in range(base.number + 1, newest.number + 1):
            made = self.version(n).made_by
            if made and not self.spark.read.schema(ACTIONS).parquet(made).select("uuid").join(wal.select("uuid"), "uuid", "left_semi").isEmpty():
                raise CommitConflict(f"version {n} touched the same records")
        return newest

    def compact(self) -> Version:
        return self.apply(self.spark.createDataFrame([], ACTIONS), compact=True)

    def holds(self, folder: str, criteria: str) -> bool:
        """Whether a folder holds what criteria gave for the newest version, as noted by note()."""
        path = f"{folder}/_of"
        if not self._exists(path):
            return False
        read = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8") == self._mark(criteria)
        finally:
            read.close()

    def note(self, folder: str, criteria: str) -> None:
        """Notes in a folder, once it is written, what its output is of."""
        out = self._fs.create(self._path(f"{folder}/_of"), True)
        try:
            out.write(bytearray(self._mark(criteria).encode()))
        finally:
            out.close()

    def _mark(self, criteria: str) -> str:
        return f"{self.root} {self.version().number} {hashlib.sha256(criteria.encode()).hexdigest()}"

    def index(self, name: str) -> DataFrame:
        """An index of the newest version, built unless it is there already."""
        v = self.version()
        folder = f"{self.root}/index/{name}/{v.number}"
        if not self._exists(folder):
            aside = f"{self.root}/index/{name}/.{v.number}-{uuid.uuid4().hex}"
            INDEXES[name](index.pairs_of(self.records(v))).write.parquet(aside)
            self._renamed(aside, folder)
        return self.spark.read.parquet(folder)
