"""Documents of policies, read, compared and written by the tasks that hold their rows.

Rows are dealt to tasks by policy and sorted, so a task has the rows of one policy in memory at a time, and the document that they make. Neither rows nor texts
pass the driver. A document is put in its place whole, by a rename or (on object stores) by the end of its upload, and making it twice gives the same text,
so a task that is lost or run twice leaves no half document and no wrong one.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.policies import POLICY
from .files import Files

#: Names of the same store with Spark's readers and with Arrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Results of a task that go back at once.
ROWS = 1000


class Store:
    """Small files below a folder, as Python tasks see them."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(uri)
        self.renames, self.missing = uri.startswith(("file:", "hdfs:")), fs.FileType.NotFound

    def read(self, name: str) -> str:
        """Text of a file; empty where there is none."""
        path = f"{self.base}/{name}"
        if self.fs.get_file_info(path).type == self.missing:
            return ""
        with self.fs.open_input_file(path) as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """Puts ``text`` in place of the file at once: no reader sees half of it."""
        path = f"{self.base}/{name}"
        folder, _, last = path.rpartition("/")
        if not self.renames:
            with self.fs.open_output_stream(path) as f:
                f.write(text.encode())
            return
        self.fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{last}.{uuid.uuid4().hex}.part"
        try:
            with self.fs.open_output_stream(part) as f:
                f.write(text.encode())
            self.fs.move(part, path)
        except BaseException:
            if self.fs.get_file_info(part).type != self.missing:
                self.fs.delete_file(part)
            raise


class DriverStore:
    """The same by Spark's own file access, which only the driver has."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder

    def read(self, name: str) -> str:
        return self.files.read(f"{self.folder}/{name}")

    def write(self, name: str, text: str) -> None:
        self.files.write(f"{self.folder}/{name}", text)


def uri(spark: SparkSession, folder: str) -> str | None:
    """A folder's address for ``Store``; none for a file system that only Spark's own access can reach."""
    scheme, _, rest = Files(spark).qualified(folder).partition(":")
    return f"{SCHEMES[scheme]}:{rest if rest.startswith('//') else f'//{rest}'}" if scheme in SCHEMES else None


Work = Callable[[Any, str, str, list[dict[str, Any]]], Iterable[tuple]]


def _each(store: Any, rows: Iterator[dict[str, Any]], work: Work) -> Iterator[tuple]:
    for key, own in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in POLICY)):
        yield from work(store, *key, list(own))


def by_policy(df: DataFrame, folder: str, work: Work, schema: str, order: Iterable[str] = ()) -> DataFrame:
    """What ``work`` (a store of the files below ``folder``, namespace, workload, the policy's rows in ``order``) gives for each policy.

    Where only the driver can reach the folder's file system, the driver does the work, one policy at a time."""
    spark, at = df.sparkSession, uri(df.sparkSession, folder)
    made = to_arrow_schema(spark.createDataFrame([], schema).schema)
    if at is None:
        rows = (r.asDict(recursive=True) for r in df.orderBy(*POLICY, *order).toLocalIterator())
        return spark.createDataFrame(list(_each(DriverStore(spark, folder), rows, work)), schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = _each(Store(at), (r for b in batches for r in b.to_pylist()), work)
        while some := list(itertools.islice(results, ROWS)):
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in some], made)

    return df.repartition(*POLICY).sortWithinPartitions(*POLICY, *order).mapInArrow(task, schema)
