"""What a run leaves for the next: atoms, evidence and fingerprints of policies, and which batches of which streams they hold.

A table is a log of parts. A run adds one part with the rows that it changed, in folders by bucket of the policy, and reads only the buckets of the policies that
it touches, so its work goes with its flows and not with what is stored. Of rows with equal keys the newest part's counts. FAN parts of a level are merged into
one of the next, so a row is written again as often as the logarithm of the parts.

One small commit file names the parts that count. A commit is a new file, so tables and batch numbers change together or not at all. Folders that no commit names any more are removed
after the next one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.policies import POLICY
from .files import Files

#: Folders of keys seen, beyond which they are written to one again.
SEEN_FOLDERS = 32
SEEN = "kind string, key string"
#: Buckets of policies; parts of a level that are merged.
BUCKETS, FAN = 64, 8


def bucket() -> Column:
    return F.pmod(F.xxhash64(*POLICY), F.lit(BUCKETS)).cast("int")


class State:
    def __init__(self, spark: SparkSession, output_dir: str):
        self.spark, self.files, self.root = spark, Files(spark), f"{output_dir}/.state"
        self.next: dict[str, Any] = {}
        self.merged: set[str] = set()  # folders that the next commit leaves out
        commits = [n for n in self.files.names(self.root) if n.startswith("commit-") and n.endswith(".json")]
        self.number = max((int(n[7:-5]) for n in commits), default=0)
        self.now: dict[str, Any] = json.loads(self.files.read(f"{self.root}/commit-{self.number}.json")) if commits else {}

    def _parts(self, name: str) -> list[dict[str, Any]]:
        """Parts of a table, oldest first: folder, level and buckets."""
        return self.next.get("parts", {}).get(name, self.now.get("parts", {}).get(name, []))

    def _there(self, path: str) -> str:
        """A folder that the commit names. One that is gone raises: going on would lose what was stored."""
        if not self.files.exists(path):
            raise FileNotFoundError(f"the state in {self.root} names {path}, which is gone")
        return path

    def _read(self, parts: Sequence[dict[str, Any]], schema: T.StructType, keys: Sequence[str], buckets: set[int] | None = None) -> DataFrame:
        """Rows of some parts, in some buckets; of equal keys those of the newest part."""
        found = None
        for age, part in enumerate(parts):
            inside = [b for b in part["buckets"] if buckets is None or b in buckets]
            self._there(part["folder"])
            if inside:
                rows = self.spark.read.schema(schema).parquet(*[f"{part['folder']}/bucket={b}" for b in inside]).withColumn("__age", F.lit(age))
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], schema)
        rest = [c for c in schema.names if c not in keys]
        newest = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__age").alias("__row"))
        return newest.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in schema.names])

    def stored(self, name: str, schema: T.StructType, keys: Sequence[str], policies: DataFrame | None = None) -> DataFrame:
        """The table as last committed, or its rows of some policies; empty where there is none."""
        if policies is None:
            return self._read(self._parts(name), schema, keys)
        touched = {r[0] for r in policies.select(bucket()).distinct().collect()}  # BUCKETS numbers at most
        return self._read(self._parts(name), schema, keys, touched).join(policies.select(*POLICY).distinct(), POLICY, "left_semi")

    def _write(self, df: DataFrame, name: str, folder: str | None, level: int) -> list[dict[str, Any]]:
        title = f"{name.split(':')[0]}-{hashlib.sha256(name.encode()).hexdigest()[:8]}"
        path = f"{folder or self.root}/{'.' if folder else ''}{title}/{uuid.uuid4().hex}"
        df.withColumn("bucket", bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        buckets = [int(n[7:]) for n in self.files.names(path) if n.startswith("bucket=")]
        return [{"folder": path, "level": level, "buckets": sorted(buckets)}] if buckets else []

    def add(self, df: DataFrame, name: str, keys: Sequence[str], folder: str | None = None) -> None:
        """Adds a part with changed or new rows to the table that the next commit names, and merges parts of a level that are many."""
        parts = [*self._parts(name), *self._write(df, name, folder, 0)]
        level = 0
        while len(full := [p for p in parts if p["level"] == level]) >= FAN:  # they are the newest but for lower levels, which are empty now
            rows = self._read(full, df.schema, keys)
            parts = [*[p for p in parts if p["level"] > level], *self._write(rows, name, folder, level + 1)]
            self.merged |= {p["folder"] for p in full}
            level += 1
        self.next.setdefault("parts", {})[name] = parts

    def batch(self, stream: str) -> int:
        """The last batch of a stream that is in the tables; -1 for a stream that is not known."""
        return self.now.get("batches", {}).get(stream, -1)

    def seen(self) -> DataFrame:
        paths = [self._there(p) for p in self.now.get("seen", [])]
        return self.spark.read.schema(SEEN).parquet(*paths) if paths else self.spark.createDataFrame([], SEEN)

    def add_seen(self, new: DataFrame) -> int:
        """Adds keys that were never seen before; their number."""
        known, path = self.now.get("seen", []), f"{self.root}/{uuid.uuid4().hex}"
        if len(known) >= SEEN_FOLDERS:
            self.seen().unionByName(new).write.parquet(path)
            self.next["seen"] = [path]
            return self.spark.read.schema(SEEN).parquet(path).count() - self.seen().count()
        new.write.parquet(path)
        n = self.spark.read.schema(SEEN).parquet(path).count()
        if n:
            self.next["seen"] = [*known, path]
        return n

    def commit(self, stream: str | None = None, batch: int | None = None) -> None:
        old = self.now
        made = {"parts": old.get("parts", {}) | self.next.get("parts", {}), "seen": self.next.get("seen", old.get("seen", [])), "batches": dict(old.get("batches", {}))}
        if stream is not None:
            made["batches"][stream] = batch
        self.files.write(f"{self.root}/commit-{self.number + 1}.json", json.dumps(made))
        folders = lambda state: {*state.get("seen", []), *(p["folder"] for parts in state.get("parts", {}).values() for p in parts)}
        for path in (folders(old) | self.merged) - folders(made):
            self.files.delete(path)
        self.files.delete(f"{self.root}/commit-{self.number}.json")
        self.now, self.next, self.merged, self.number = made, {}, set(), self.number + 1
