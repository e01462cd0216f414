"""A live relay of flow records as a Spark source: ``spark.read`` or ``spark.readStream`` with ``format("flow_relay")``.

A relay is a TCP server with a buffer of envelopes for each of its nodes. It is asked by one line of JSON and answers in lines:

    {"ask": "ends"}                                                      -> {"begins": [n, ...], "ends": [n, ...]}, a number a node
    {"ask": "read", "node": i, "from": a, "to": b, "filters": [...]}     -> {"at": n, "event": {...}} for each event from a to before b that meets a filter, then {"done": b}

A filter is {"verdict": [...], "source_namespaces": [...], "destination_namespaces": [...]}; the fields of one are all met, of several filters any. Events that
are lost (``lost_events``) always come. The driver asks for the ends only; each node's events are read by a task of its own. A connection that breaks is taken up again
behind the last event that came, so tasks neither lose nor repeat events; what the relay's buffer no longer has is counted as lost events.

Columns: value (the envelope as a line of a capture), node, position, verdict, source_namespace and destination_namespace. In a batch, equality and ``in`` on the last three and on node are
pushed to the relay; in a stream, options say what is read.

Options: address (host:port), namespaces (comma-separated; none: all), verdicts (default DROPPED; empty: all), starting (``earliest``, the default, or ``latest``), timeout
(seconds, 10), retries (5).
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

FORMAT = "flow_relay"
SCHEMA = "value string, node int, position bigint, verdict string, source_namespace string, destination_namespace string"


def filters_for(namespaces: Sequence[str], verdicts: Sequence[str]) -> list[dict[str, list[str]]]:
    """Flows with one of the verdicts from or to a pod of the namespaces; of any if none is named."""
    base = {"verdict": list(verdicts)} if verdicts else {}
    if not namespaces:
        return [base] if base else []
    return [base | {f"{side}_namespaces": list(namespaces)} for side in ("source", "destination")]


class Client:
    """One question at a time over a connection of its own."""

    def __init__(self, address: str, timeout: float = 10, retries: int = 5):
        host, _, port = address.rpartition(":")
        if not host or not port.isdigit():
            raise ValueError(f"{address!r} is no host:port")
        self.at, self.timeout, self.retries = (host.strip("[]"), int(port)), timeout, retries

    def _lines(self, question: dict[str, Any]) -> Iterator[dict[str, Any]]:
        with socket.create_connection(self.at, self.timeout) as s, s.makefile("rwb") as f:
            f.write(json.dumps(question).encode() + b"\n")
            f.flush()
            for line in f:
                yield json.loads(line)

    def _again(self, tried: int, why: Exception) -> int:
        if tried >= self.retries:
            raise ConnectionError(f"the relay at {self.at[0]}:{self.at[1]} doesn't answer") from why
        time.sleep(min(2.0, 0.1 * 2**tried))
        return tried + 1

    def ends(self) -> dict[str, list[int]]:
        tried = 0
        while True:
            try:
                return next(self._lines({"ask": "ends"}))
            except (OSError, StopIteration, ValueError) as e:
                tried = self._again(tried, e)

    def read(self, node: int, begin: int, end: int, filters: list[dict[str, list[str]]]) -> Iterator[tuple[int, dict[str, Any]]]:
        """Events of a node by place. Each is given once, however often the connection breaks; a break that brings nothing new counts as a try."""
        at, tried = begin, 0
        while at < end:
            try:
                for answer in self._lines({"ask": "read", "node": node, "from": at, "to": end, "filters": filters}):
                    if "done" in answer:
                        at = end
                        break
                    if answer["at"] >= at:
                        yield answer["at"], answer["event"]
                        at, tried = answer["at"] + 1, 0
                else:
                    raise ConnectionError("the answer ended early")
            except (OSError, ValueError) as e:
                tried = self._again(tried, e)


def _client(options) -> Client:
    return Client(options["address"], float(options.get("timeout", 10)), int(options.get("retries", 5)))


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


class Share(InputPartition):
    """A node's events from ``begin`` to before ``end``; ``lost``: so many before them are gone from the relay's buffer."""

    def __init__(self, node: int, begin: int, end: int, lost: int = 0):
        super().__init__(None)
        self.node, self.begin, self.end, self.lost = node, begin, end, lost


def _shares(begins: Sequence[int], oldest: Sequence[int], ends: Sequence[int]) -> list[Share]:
    made = []
    for node, end in enumerate(ends):
        begin = begins[node] if node < len(begins) else 0
        held = min(end, max(begin, oldest[node] if node < len(oldest) else 0))
        if end > begin:
            made.append(Share(node, held, end, held - begin))
    return made


def _rows(client: Client, share: Share, filters: list[dict[str, list[str]]]) -> Iterator[tuple]:
    if share.lost:
        yield json.dumps({"lost_events": {"num_events_lost": share.lost}}), share.node, share.begin - 1, None, None, None
    for at, event in client.read(share.node, share.begin, share.end, filters):
        flow = event.get("flow") or {}
        space = lambda side: (flow.get(side) or {}).get("namespace")  # noqa: E731, B023
        yield json.dumps(event, ensure_ascii=False), share.node, at, flow.get("verdict"), space("source"), space("destination")


class RelaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.client, self.filters, self.nodes = _client(options), filters_for(_names(options.get("namespaces", "")), _names(options.get("verdicts", "DROPPED"))), None

    def pushFilters(self, filters):
        """Takes what the relay can do; each column once, and then all filters have the field."""
        fields = {("verdict",): "verdict", ("source_namespace",): "source_namespaces", ("destination_namespace",): "destination_namespaces"}
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            field = fields.get(f.attribute) if values else None
            if values and f.attribute == ("node",):
                self.nodes = {int(v) for v in values} & (self.nodes if self.nodes is not None else {int(v) for v in values})
            elif field:
                have = self.filters or [{}]
                self.filters = [x | {field: [v for v in values if field not in x or v in x[field]]} for x in have]
                yield f  # Spark checks again, so that lost events, which always come, don't pass it
            else:
                yield f

    def partitions(self) -> list[Share]:
        now = self.client.ends()
        return [s for s in _shares(now["begins"], now["begins"], now["ends"]) if self.nodes is None or s.node in self.nodes]

    def read(self, partition: Share) -> Iterator[tuple]:
        return _rows(self.client, partition, self.filters)


class _Stream(DataSourceStreamReader):
    """Offsets are a count of events a node. What a batch holds is fixed by its offsets in the checkpoint, so a batch that runs again reads the same events."""

    def __init__(self, options):
        self.client, self.filters = _client(options), filters_for(_names(options.get("namespaces", "")), _names(options.get("verdicts", "DROPPED")))
        self.newest = options.get("starting", "earliest") == "latest"

    def initialOffset(self) -> dict:
        now = self.client.ends()
        return {str(i): n for i, n in enumerate(now["ends"] if self.newest else now["begins"])}

    def latestOffset(self) -> dict:
        return {str(i): n for i, n in enumerate(self.client.ends()["ends"])}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        nodes = max([int(i) + 1 for i in end], default=0)
        count = lambda offset: [int(offset.get(str(i), 0)) for i in range(nodes)]
        return _shares(count(start), self.client.ends()["begins"], count(end))

    def read(self, partition: Share) -> Iterator[tuple]:
        return _rows(self.client, partition, self.filters)

    def commit(self, end: dict) -> None:
        """The relay keeps its own buffer, so nothing is given back to it."""


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Python sources have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RelaySource)


def read(spark: SparkSession, address: str, namespaces: Sequence[str] = (), **options: str) -> DataFrame:
    """What the relay holds now, as lines of a capture with their node and position."""
    register(spark)
    return spark.read.format(FORMAT).options(address=address, namespaces=",".join(namespaces), **options).load()


def stream(spark: SparkSession, address: str, namespaces: Sequence[str] = (), **options: str) -> DataFrame:
    """What comes, as lines of a capture with their node and position."""
    register(spark)
    return spark.readStream.format(FORMAT).options(address=address, namespaces=",".join(namespaces), **options).load()
