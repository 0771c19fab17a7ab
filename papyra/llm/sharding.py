"""Sharding by size-tiered compaction, with atomically committed, versioned manifests.

Every arrival becomes a run of small immutable Parquet shards.  Runs are tiered by size, each tier ``fan_in`` times
as large as the one before; as soon as a tier holds ``fan_in`` runs they are merged into one run of shards of about
``target_bytes``.  A manifest lists the live runs and their shards; version n + 1 is written beside its place and
moved there by a rename that fails if another writer was first, so readers see a whole version or the one before.
The last ``keep`` versions stay readable (:meth:`ShardedTable.read`): shards are deleted once no kept version lists them.

All files are in a folder that the cluster shares, reached through Spark and Hadoop's file systems only.  Shards are
written by ordinary Spark jobs into a folder of their own and aren't listed before the job has committed, so a lost
executor or driver leaves at most files that no manifest names.  Merging deals rows round to as many shards as the
target size asks for (one exchange of the rows merged); only manifests (a line per shard) come to the driver.

Runs are numbered in the order of their arrival or merge, and shards within them, so that the same arrivals make shards of
the same names.  A writer that loses a race for a version tries again with the next one; after ``tries`` of them it raises
:class:`Conflict`, and the arrival is then in no version.

Defined results: every row of every arrival stays exactly once, with all columns, nulls and repeats; an empty
arrival is a run without rows (a table of such arrivals alone reads as empty, with their columns); a null arrival number
is an arrival of its own; appending after a failed append or merge is safe.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import unused


@dataclass
class Run:
    """An immutable set of shards: folder, number in the order of commits, path of each shard and its bytes."""

    name: str
    number: int
    shards: list[tuple[str, int]]

    @property
    def bytes(self) -> int:
        return sum(n for _, n in self.shards)


@dataclass
class Version:
    """What a manifest says."""

    number: int
    runs: list[Run]
    columns: StructType


class Conflict(RuntimeError):
    """Another writer has committed that version."""


def merged(old: StructType, new: StructType) -> StructType:
    """The columns of both, the old ones first; a column never changes its type."""
    known = {f.name: f for f in old}
    for f in new:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType([*old, *(f for f in new if f.name not in known)])


class ShardedTable:
    """A table of shards below ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, tier_bytes: int = 4 << 20, keep: int = 2, tries: int = 20) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.tier_bytes, self.keep, self.tries = target_bytes, fan_in, tier_bytes, keep, tries
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.Path(name)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return sorted((s.getPath().toString(), int(s.getLen())) for s in self.fs.listStatus(path))

    def versions(self) -> list[int]:
        """The versions that are still there, in order."""
        return [int(p.rsplit("/", 1)[1][:-5]) for p, _ in self._names(f"{self.root}/manifest") if p.endswith(".json")]

    def manifest(self, number: int | None = None) -> Version:
        """A version, the last one by default; version 0 has no runs and no columns."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Version(0, [], StructType())
        stream = self.fs.open(self._path(f"{self.root}/manifest/{number:010d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(told["number"], [Run(r["name"], r["number"], [tuple(s) for s in r["shards"]]) for r in told["runs"]], StructType.fromJson(told["columns"]))

    def _commit(self, version: Version) -> None:
        draft, place = (self._path(f"{self.root}/manifest/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"{version.number:010d}.json"))
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": version.number, "runs": [asdict(r) for r in version.runs], "columns": version.columns.jsonValue()}).encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(draft.toUri(), self.conf)
        try:
            context.rename(draft, place, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {version.number}") from error
            raise

    def _forget(self) -> None:
        """Delete versions older than the last ``keep``, and the runs that only they list."""
        numbers = self.versions()
        kept = {r.name for n in numbers[-self.keep :] for r in self.manifest(n).runs}
        for n in numbers[: -self.keep]:
            for run in self.manifest(n).runs:
                if run.name not in kept:
                    self.fs.delete(self._path(f"{self.root}/runs/{run.name}"), True)
            self.fs.delete(self._path(f"{self.root}/manifest/{n:010d}.json"), False)

    def _written(self, name: str, number: int) -> Run:
        return Run(name, number, [(p, n) for p, n in self._names(f"{self.root}/runs/{name}") if p.endswith(".parquet")])

    def append(self, arrival: DataFrame) -> None:
        """Add an arrival as a run of its own, then merge what is due."""
        name = uuid.uuid4().hex
        arrival.write.parquet(f"{self.root}/runs/{name}")
        self._add(name, arrival.schema)

    def append_each(self, arrivals: DataFrame, column: str) -> None:
        """Add one run for each value of ``column`` (which isn't kept), in the values' order, all written by one job."""
        name = uuid.uuid4().hex
        columns = StructType([f for f in arrivals.schema if f.name != column])
        arrivals.write.partitionBy(column).parquet(f"{self.root}/runs/{name}")
        folders = [p for p, _ in self._names(f"{self.root}/runs/{name}") if f"/{column}=" in p]
        for folder in sorted(folders, key=lambda p: (len(p), p)):
            self._add(f"{name}/{folder.rsplit('/', 1)[1]}", columns)
        if not folders:  # no rows: the columns are still to be known
            self._add(name, columns)

    def _add(self, name: str, columns: StructType) -> None:
        for _ in range(self.tries):
            last = self.manifest()
            number = last.number + 1
            try:
                self._commit(Version(number, [*last.runs, self._written(name, number)], merged(last.columns, columns)))
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{self.tries} versions in a row; the arrival is in none")
        self._forget()
        self.compact()

    def tier(self, run: Run) -> int:
        return 0 if run.bytes <= self.tier_bytes else 1 + int(math.log(run.bytes / self.tier_bytes, self.fan_in))

    def compact(self) -> None:
        """Merge tiers that hold ``fan_in`` runs, the smallest first, until none does.

        A merge that loses a race is left to the winner, or to the next append, after ``tries`` of them.
        """
        lost = 0
        while lost < self.tries:
            last = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for run in last.runs:
                tiers.setdefault(self.tier(run), []).append(run)
            due = [t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]
            if not due:
                return
            old = tiers[due[0]]
            made = self._merge(old, last)
            gone = {r.name for r in old}
            try:
                self._commit(Version(last.number + 1, [r for r in last.runs if r.name not in gone] + [made], last.columns))
            except Conflict:
                self.fs.delete(self._path(f"{self.root}/runs/{made.name}"), True)
                lost += 1
                continue
            self._forget()

    def _merge(self, runs: list[Run], last: Version) -> Run:
        name = uuid.uuid4().hex
        paths = [p for r in runs for p, _ in r.shards]
        if paths:
            shards = max(1, round(sum(r.bytes for r in runs) / self.target_bytes))
            self.spark.read.schema(last.columns).parquet(*paths).repartition(shards).write.parquet(f"{self.root}/runs/{name}")
        return self._written(name, last.number + 1)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default, with ``shard``: number of its run and of the shard in it.

        The column is called ``shard_`` if rows have a shard.
        """
        version = self.manifest(number)
        paths = [p for r in version.runs for p, _ in r.shards]
        if not version.columns.fields:
            raise ValueError(f"version {version.number} of {self.root} has no columns")
        if not paths:
            rows = self.spark.createDataFrame([], version.columns)
            return rows.withColumn(unused(rows, "shard"), F.lit(None).cast("string"))
        rows = self.spark.read.schema(version.columns).parquet(*paths)
        folder, file = F.regexp_extract("_metadata.file_path", "/runs/(.*)/[^/]+$", 1), F.regexp_extract("_metadata.file_name", "^part-(\\d+)", 1)
        runs = F.create_map(*[F.lit(x) for r in version.runs if r.shards for x in (r.name, r.number)])
        return rows.withColumn(unused(rows, "shard"), F.format_string("%06d-%s", F.element_at(runs, F.url_decode(folder)), file))
