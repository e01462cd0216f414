"""Captures of flow records: one JSON envelope a line, plain or gzip, as a batch or a stream."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.files import Files, shared_folder

_ENDPOINT = "struct<identity:bigint,namespace:string,labels:array<string>,pod_name:string>"
#: The fields that are read; their names are as in the files, where case matters.
FLOW = (
    "struct<time:timestamp,verdict:string,drop_reason_desc:string,traffic_direction:string,node_name:string,"
    f"source:{_ENDPOINT},destination:{_ENDPOINT},IP:struct<source:string,destination:string>,"
    "l4:struct<TCP:struct<destination_port:bigint>,UDP:struct<destination_port:bigint>,ICMPv4:struct<type:bigint>,"
    "ICMPv6:struct<type:bigint>,SCTP:struct<destination_port:bigint>>,"
    "l7:struct<type:string,http:struct<method:string,url:string>,dns:struct<query:string,qtypes:array<string>>>>"
)
ENVELOPE = f"struct<flow:{FLOW},lost_events:struct<num_events_lost:bigint>>"
_KNOWN = ["flow", "lost_events", "node_name", "time"]


def _spooled(spark: SparkSession) -> str:
    """Standard input as a file in the folder that executors share, written in chunks."""
    path = f"{shared_folder(spark, 'stdin')}.jsonl"
    raw = getattr(sys.stdin, "buffer", None)
    read = (lambda: raw.read(1 << 20)) if raw else (lambda: sys.stdin.read(1 << 20).encode())
    Files(spark).append_chunks(path, iter(read, b""))
    return path


#: Splits that the driver sums and broadcasts at most, some 200 bytes each; runs of splits that are summed apart where there are more.
SPLITS, RUNS = 50_000, 256


def _running(counts: DataFrame, order: list[str]) -> DataFrame:
    """``counts`` (order, n) with ``before``: the sum of n over all earlier rows. Rows fall into about RUNS runs between keys that a sample of at most that many
    gives; sums are taken within runs and over the runs, so no window holds all rows."""
    key = F.struct(*order)
    bounds = [tuple(r) for r in counts.orderBy(F.xxhash64(*order), *order).limit(RUNS).select(*order).collect()]
    if not bounds:
        return counts.withColumn("before", F.lit(0).cast("long"))
    places = F.broadcast(counts.sparkSession.createDataFrame([(sorted(bounds),)], f"bounds array<{counts.select(key.alias('k')).schema['k'].dataType.simpleString()}>"))  # one row
    cut = counts.join(places).withColumn("run", F.size(F.filter("bounds", lambda b: b <= key))).drop("bounds")
    sums = cut.groupBy("run").agg(F.sum("n").alias("s"))
    first = sums.select("run", F.coalesce(F.sum("s").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # RUNS + 1 rows at most
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("inside", inside).join(F.broadcast(first), "run").withColumn("before", F.col("first") + F.col("inside")).drop("run", "first", "inside")


def numbered(rows: DataFrame) -> DataFrame:
    """Lines (value, seq) of rows with value, file and begun (lines of files) or value, node and position (events of a relay).

    seq is the arrival order, from 0 without gaps: by file name and place in the file, or by node and place there, however Spark cuts and packs them into
    tasks. A first pass counts the lines of each split. Up to SPLITS of them are summed by the driver and broadcast; more are summed by Spark and joined."""
    live = "node" in rows.columns
    split = ["node"] if live else ["file", "begun"]
    if live:
        within = F.row_number().over(Window.partitionBy("node").orderBy("position")).cast("long") - 1  # a node's events of one batch
        named = rows.select("value", "node", within.alias("at"))
        counts = rows.groupBy("node").agg(F.lit(0).cast("long").alias("low"), F.count(F.lit(1)).alias("n"))
    else:
        named = rows.select("value", *split, F.monotonically_increasing_id().alias("at"))
        counts = named.groupBy(*split).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    taken = counts.limit(SPLITS + 1).collect()
    if len(taken) <= SPLITS:
        before, shifts = 0, []
        for r in sorted(taken, key=lambda r: tuple(r[c] for c in split)):
            shifts.append((*[r[c] for c in split], before - r["low"]))
            before += r["n"]
        kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in split)
        joined = named.join(F.broadcast(rows.sparkSession.createDataFrame(shifts, f"{kinds}, shift long")), split)
    else:
        written = shared_folder(rows.sparkSession, "splits")
        counts.write.parquet(written)
        held = _running(rows.sparkSession.read.schema(counts.schema).parquet(written), split)
        joined = named.join(held.select(*split, (F.col("before") - F.col("low")).alias("shift")), split)
    return joined.select("value", (F.col("at") + F.col("shift")).alias("seq"))


def _with_place(rows: DataFrame) -> DataFrame:
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begun"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, seq) of a file, a folder or standard input (``-``); see ``numbered``. A missing path raises. Gzip is read in one task a file."""
    return numbered(_with_place(spark.read.text(_spooled(spark) if path == "-" else path)))


def parse(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``rows`` (value, ...) with line_kind and the envelope's flow and lost events.

    Kinds: blank, malformed (no JSON, or neither a flow nor lost events), lost, non_dropped, flow. ``strict`` also calls
    envelopes with unknown fields at their top malformed."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    got = rows.withColumn("__text", text).withColumn("envelope", F.from_json("__text", ENVELOPE))
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("__text"), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in _KNOWN]))) > 0
    bad = F.col("envelope.flow").isNull()
    kind = F.when(F.col("__text") == "", "blank").when(bad & F.col("envelope.lost_events").isNotNull(), "lost").when(bad | (unknown if strict else F.lit(False)), "malformed")
    kind = kind.when(F.coalesce(F.col("envelope.flow.verdict"), F.lit("")) != "DROPPED", "non_dropped").otherwise("flow")
    return got.withColumn("line_kind", kind).drop("__text")


def counters() -> list[Column]:
    """lines_read, flows_emitted, non_dropped, malformed and lost_events over parsed lines. Blank lines count as read and nothing else."""
    count = lambda name, *kinds: F.count_if(F.col("line_kind").isin(*kinds)).alias(name)
    lost = F.coalesce(F.sum("envelope.lost_events.num_events_lost"), F.lit(0)).alias("lost_events")
    return [F.count(F.lit(1)).alias("lines_read"), count("flows_emitted", "flow"), count("non_dropped", "non_dropped"), count("malformed", "malformed", "lost"), lost]


def scan_counters(parsed: DataFrame) -> DataFrame:
    """One row: lines_read, flows_emitted, non_dropped, malformed."""
    return parsed.agg(*counters()).drop("lost_events")


def observed(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """``parsed`` that counts as it is read for the first time: the observation has the ``counters`` then, without a scan of their own."""
    watch = Observation()
    return parsed.observe(watch, *counters()), watch


def flows(parsed: DataFrame) -> DataFrame:
    """The flow records of a parsed capture, one row each, under the names that the operators use."""
    f = parsed.filter("line_kind = 'flow'").select("seq", "envelope.flow.*")
    return normalise(f.withColumnsRenamed({"traffic_direction": "direction", "drop_reason_desc": "drop_reason", "IP": "ip"}))


def normalise(raw: DataFrame) -> DataFrame:
    """Absent text is empty and an absent reason the unset one, as in the records' own format."""
    return raw.withColumns({"verdict": F.coalesce("verdict", F.lit("")), "drop_reason": F.coalesce("drop_reason", F.lit("DROP_REASON_UNKNOWN")), "direction": F.coalesce("direction", F.lit("TRAFFIC_DIRECTION_UNKNOWN")), "node_name": F.coalesce("node_name", F.lit(""))})


def read_flows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return flows(parse(lines(spark, path), strict))


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files as they come into a folder, with their file and place; ``streaming.live`` numbers and parses those of each micro-batch."""
    reader = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    return _with_place(reader.text(folder))


def in_namespaces(names: Sequence[str]) -> Column:
    """Flows from or to pods of the namespaces; every flow if none is named."""
    if not names:
        return F.lit(True)
    own = lambda side: F.coalesce(F.col(f"{side}.namespace").isin(list(names)), F.lit(False))
    return own("source") | own("destination")


def lost_events(parsed: DataFrame) -> DataFrame:
    """One row: events lost in all."""
    return parsed.agg(F.coalesce(F.sum("envelope.lost_events.num_events_lost"), F.lit(0)).alias("lost_events"))


def lost_by_window(losses: DataFrame, time: str = "time", lost: str = "num_events_lost", width: str = "30 seconds") -> DataFrame:
    """window_start, lost and running_total of each window that lost events. The total runs over the windows alone, one row each."""
    by = losses.groupBy(F.window(time, width).alias("w")).agg(F.sum(lost).alias("lost")).filter("lost > 0")
    return by.select(F.col("w.start").alias("window_start"), "lost", F.sum("lost").over(Window.orderBy("w.start")).alias("running_total"))


def snapshot(policies: Sequence[DataFrame], manager: str) -> DataFrame:
    """Live policies (namespace, name, managed_by, ...) that ``manager`` owns; of equal names in a namespace the one of the later list."""
    tagged = [p.withColumn("__n", F.lit(i)) for i, p in enumerate(policies)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    last = F.row_number().over(Window.partitionBy("namespace", "name").orderBy(F.desc("__n")))
    return every.filter(F.col("managed_by") == manager).withColumn("__k", last).filter("__k = 1").drop("__n", "__k")


def flow_schema() -> T.StructType:
    """Schema of a normalised flow row."""
    schema = T._parse_datatype_string(FLOW)
    names = {"traffic_direction": "direction", "drop_reason_desc": "drop_reason", "IP": "ip"}
    return T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(names.get(f.name, f.name), f.dataType) for f in schema.fields]])
