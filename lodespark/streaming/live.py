"""Streams that change state: index updates with control events, retractions, sessions that end by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodespark.operators.incremental import VersionedTarget, latest_per

#: Changes in one batch from which on a full pass is cheaper than single updates.
MANY_CHANGES = 512


def wants_resync(batch: DataFrame, many: int = MANY_CHANGES) -> bool:
    """Whether a batch of changes (path, kind) asks for a full pass: a resync event, a changed ignore file, or ``many`` distinct paths."""
    row = batch.agg(
        F.coalesce(F.max((F.col("kind") == "resync") | F.col("path").rlike(r"(^|/)\.gitignore$")), F.lit(False)).alias("asked"), F.count_distinct("path").alias("n")
    ).first()
    return bool(row["asked"]) or row["n"] >= many


def index_updates(target: VersionedTarget, read, resync):
    """A function for ``foreachBatch`` over changes (path, kind, at): the last change of each path counts, and a resync takes the place of all changes of its batch.

    ``read(paths)`` gives the rows of changed paths, ``resync()`` all rows; either must hold the target's columns. A batch that is
    delivered again after a failure changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if target.published(number):
            return
        if wants_resync(batch):
            target.process(resync(), number)
        else:
            last = latest_per(batch.where(F.col("path").isNotNull()), ["path"], ["at"])
            target.process(read(last.select("path")), number)

    return run


def debounced(events: DataFrame, wait: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """path, at, n: one row for each burst of changes of a path (path, at) without a pause of ``wait``, at the time of its last change."""
    rows = events.where(F.col("path").isNotNull() & F.col("at").isNotNull()).withColumn("at", F.col("at").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("path", F.session_window("at", wait).alias("w")).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).select("path", F.col("last").alias("at"), "n")


_STATE = "counts string, iteration long, anchor string, last double"
_OUT = "session string, target string, kept long, iteration long, anchor string, ended boolean"


def session_states(events: DataFrame, idle: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """session, target, kept, iteration, anchor, ended: what each session holds, told when it ends by itself after ``idle`` without an event.

    ``events``: session, at, kind (prompt, event, failure, end), target, id. Starting twice is starting once; a failure takes back the latest
    event of its target that is still there; ``end`` ends the session at once. ``kept`` are the events of a target that are left.
    """
    import json

    span = pd.Timedelta(idle).total_seconds() * 1000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, iteration, anchor, last = state.get if state.exists else ("{}", 0, None, 0.0)
        held: dict[str, int] = json.loads(counts)

        def told() -> pd.DataFrame:
            rows = [(key[0], t, n, iteration, anchor, True) for t, n in sorted(held.items()) if n > 0] or [(key[0], None, 0, iteration, anchor, True)]
            return pd.DataFrame(rows, columns=["session", "target", "kept", "iteration", "anchor", "ended"])

        if state.hasTimedOut:
            yield told()
            state.remove()
            return
        # at, id: the order of events whatever the order of arrival within a batch
        rows = pd.concat(list(chunks)).sort_values(["at", "id"], kind="stable")
        over = False
        for r in rows.itertuples():
            iteration += 1
            if r.kind == "prompt":
                anchor = str(r.id)
            elif r.kind == "event" and r.target is not None:
                held[r.target] = held.get(r.target, 0) + 1
            elif r.kind == "failure" and held.get(r.target, 0) > 0:
                held[r.target] -= 1
            over = over or r.kind == "end"
            last = max(last, r.at.timestamp() * 1000)
        if over:
            yield told()
            if state.exists:
                state.remove()
            return
        state.update((json.dumps(held), iteration, anchor, last))
        state.setTimeoutTimestamp(int(max(last + span, state.getCurrentWatermarkMs() + 1)))

    rows = events.where(F.col("session").isNotNull() & F.col("at").isNotNull()).select(F.col("session").cast("string").alias("session"), F.col("at").cast("timestamp").alias("at"), "kind", F.col("target").cast("string").alias("target"), F.col("id").cast("bigint").alias("id"))
    return rows.withWatermark("at", late).groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def classified(events: DataFrame, tool: Column, tool_input: Column) -> DataFrame:
    """``events`` with target and event_type (read, edit, neutral) from the name and JSON input of the tool that ran."""
    from lodespark.functions import mentions

    rows = events.withColumn("target", mentions.tool_target(tool_input))
    return rows.withColumn("event_type", mentions.tool_event(tool, F.col("target")))
