"""A sharded store with size-tiered compaction (operator 3), on DataFrame functions alone.

Arrivals are appended as runs, folders of small Parquet files that are never changed. compact() merges runs of similar
size, FANOUT at a time, into files of a target size, until no FANOUT runs are alike. What the store holds is what its latest
manifest lists. A manifest is written aside and renamed to the next version's name, which fails if that exists; so a
version appears whole or not at all, two writers cannot both commit it, and a job that dies leaves only unlisted files.
vacuum() removes older manifests with the runs that only they list, and, when GRACE seconds have passed since they were
written, runs that no manifest lists: until then another writer may be about to commit them. A commit checks that its runs
are there and that no later version is. Readers of an older version keep reading it until vacuum().
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT, TARGET = 4, 64 << 20
#: Runs are alike if each is at most so many times as large as the smallest.
ALIKE = 2.0
#: Seconds for which runs that no manifest lists are left alone.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Run:
    path: str  # below the store's root
    bytes: int
    files: int
    level: int  # merges that its rows have been through


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("manifest"))

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        path = self._path(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    # Manifests

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> tuple[int, list[Run], StructType | None]:
        """(version, runs, schema) of a version, the latest by default; (0, [], None) of an empty store."""
        held = self.versions()
        version = (held[-1] if held else 0) if version is None else version
        if not version:
            return 0, [], None
        stream = self.fs.open(self._path(f"manifest/v{version:09d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return version, [Run(**r) for r in told["runs"]], StructType.fromJson(told["schema"])

    def _commit(self, version: int, runs: list[Run], schema: StructType) -> int:
        """Make version the latest; Conflict if another writer was first or has removed a run since."""
        if gone := [r.path for r in runs if not self.fs.exists(self._path(r.path))]:
            raise Conflict(f"runs are gone: {gone[:3]}")
        aside = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"runs": [asdict(r) for r in runs], "schema": schema.jsonValue()}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(f"manifest/v{version:09d}.json"), none)
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(self._path(f"manifest/v{version:09d}.json")):
                raise Conflict(f"version {version} exists") from e
            raise
        # Where vacuum() has removed the manifest that another writer had given this number, later ones tell of it.
        if self.versions()[-1] > version:
            self.fs.delete(self._path(f"manifest/v{version:09d}.json"), False)
            raise Conflict(f"a version after {version} exists")
        return version

    # Runs

    def _run(self, path: str, level: int) -> Run:
        sizes = [s.getLen() for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return Run(path, int(sum(sizes)), len(sizes), level)

    def _write(self, df: DataFrame, run: str, level: int) -> list[Run]:
        """A run for each value of column `run`, in one job."""
        name = f"runs/{uuid.uuid4().hex}"
        df.write.partitionBy(run).parquet(f"{self.root}/{name}")
        return [self._run(f"{name}/{folder}", level) for folder in self._names(name) if "=" in folder]

    def append(self, df: DataFrame, batch: Column | None = None) -> int:
        """Append df as one run, or one for each value of batch, and commit; returns the version."""
        version, runs, schema = self.manifest()
        if schema is not None and schema != _nullable(df.schema):
            raise ValueError("the store's rows have other columns")
        own = _unused(df)
        new = self._write(df.withColumn(own, batch if batch is not None else F.lit(0)), own, 0)
        return self._commit(version + 1, runs + new, _nullable(df.schema))

    def _alike(self, runs: list[Run]) -> list[list[Run]]:
        """Groups of fanout runs to merge: the smallest that are alike."""
        out, group = [], []
        for r in sorted((r for r in runs if r.bytes < self.target * self.fanout**8), key=lambda r: (r.bytes, r.path)):
            while group and r.bytes > ALIKE * max(group[0].bytes, 1):
                group.pop(0)
            group.append(r)
            if len(group) == self.fanout:
                out.append(group)
                group = []
        return out

    def compact(self) -> int:
        """Merge until no fanout runs are alike, a version for each round; returns the latest version."""
        while True:
            version, runs, schema = self.manifest()
            groups = self._alike(runs)
            if not groups:
                return version
            self._merge(version, runs, schema, groups)

    def _merge(self, version: int, runs: list[Run], schema: StructType, groups: list[list[Run]]) -> int:
        own, parts = None, None
        for k, group in enumerate(groups):
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.path}" for r in group])
            own = own or _unused(rows)
            # Whole tasks are put together, so rows are rewritten without a shuffle.
            rows = rows.coalesce(max(1, -(-sum(r.bytes for r in group) // self.target))).withColumn(own, F.lit(k))
            parts = rows if parts is None else parts.unionByName(rows)
        gone = {r.path for g in groups for r in g}
        new = self._write(parts, own, 1 + max(r.level for g in groups for r in g))
        return self._commit(version + 1, [r for r in runs if r.path not in gone] + new, schema)

    def read(self, version: int | None = None) -> DataFrame:
        _, runs, schema = self.manifest(version)
        if schema is None:
            raise ValueError(f"nothing was appended to {self.root}")
        held = [f"{self.root}/{r.path}" for r in runs if r.files]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete all manifests but the latest `keep`, the runs that only those list, and runs that none lists once they
        are older than `grace` seconds; returns how many runs went."""
        held = self.versions()
        live = {r.path for v in held[-keep:] for r in self.manifest(v)[1]}
        once = {r.path for v in held[:-keep] for r in self.manifest(v)[1]} - live
        for v in held[:-keep]:
            self.fs.delete(self._path(f"manifest/v{v:09d}.json"), False)
        gone = 0
        for job in self._names("runs"):
            folders = [f"runs/{job}/{f}" for f in self._names(f"runs/{job}") if "=" in f]
            old = time.time() - self.fs.getFileStatus(self._path(f"runs/{job}")).getModificationTime() / 1000 > grace
            dead = [f for f in folders if f in once or old and f not in live]
            for f in dead:
                self.fs.delete(self._path(f), True)
            if folders and len(dead) == len(folders):
                self.fs.delete(self._path(f"runs/{job}"), True)
            gone += len(dead)
        return gone


def _nullable(schema: StructType) -> StructType:
    """The schema as Parquet gives it back."""
    out = json.loads(schema.json())
    for f in out["fields"]:
        f["nullable"] = True
    return StructType.fromJson(out)


def _unused(df: DataFrame) -> str:
    name = "run"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def shard(docs: DataFrame, root: str, batch: Column, target: int = TARGET, fanout: int = FANOUT) -> DataFrame:
    """Append docs in arrivals by batch, compact, drop what the latest version doesn't list, and return its rows.

    Every row comes back once, with all its columns, whatever they are called: nulls, empty texts, repeated rows and equal
    ids are rows like others. An empty table makes a version without runs, and no rows.
    """
    store = Store(docs.sparkSession, root, target, fanout)
    store.append(docs, batch)
    store.compact()
    store.vacuum()
    return store.read()
