"""Flows as they arrive: each micro-batch goes through the same run as a whole capture.

Batches merge into the stored atoms and evidence, so rule keys, counts and times do not depend on how the stream is cut. The number of a
batch is committed with the tables that hold it, under the id that the stream's checkpoint gives it: a batch that is delivered again is
skipped, and another stream into the same output starts with its own first batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import session as runs
from ..plans.session import Batch, Options, Result, Session
from ..plans.state import State
from ..sources import capture


def stream_id(spark, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint when it first started."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _step(options: Options, checkpoint: str, session: Session, live: DataFrame | None, results: list[Result] | None, show: Callable[[Result], None] | None, namespaces: Sequence[str], strict: bool) -> Callable[[DataFrame, int], None]:
    def handle(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        stream = stream_id(spark, checkpoint)
        if not options.dry_run and number <= State(spark, options.output_dir).batch(stream):
            return
        kept = rows.persist()  # a relay is asked once for a batch
        try:
            if kept.isEmpty():
                return
            parsed, scan = capture.observed(capture.parse(capture.numbered(kept), strict))
            result = runs.run(capture.flows(parsed).filter(capture.in_namespaces(namespaces)), options, live, Batch(stream, number, session), scan)
        finally:
            kept.unpersist()
        if results is not None:
            results.append(result)
        if show:
            show(result)

    return handle


def start(
    lines: DataFrame, options: Options, checkpoint: str, every: str | None = "5 seconds", results: list[Result] | None = None, session: Session | None = None,
    live: DataFrame | None = None, show: Callable[[Result], None] | None = None, namespaces: Sequence[str] = (), strict: bool = False,
) -> StreamingQuery:
    """Starts the run over a stream of lines (``capture.stream_lines`` or ``relay.stream``): ``every`` so often, or over all that is there and no more where that is None.

    All its batches are one session of evidence; ``session`` goes on with one that was begun, and ``finish`` closes it."""
    writer = lines.writeStream.foreachBatch(_step(options, checkpoint, session or Session.begin(), live, results, show, namespaces, strict)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop_after_batch(query: StreamingQuery) -> None:
    """Stops a stream when the batch that is on its way is through."""
    while query.isActive and query.status["isTriggerActive"]:
        query.awaitTermination(0.2)
    query.stop()
