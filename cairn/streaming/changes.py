"""Event streams: debounced rebuilds, file changes folded into the graph, growth of a workspace, and a log of activity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions import paths
from cairn.operators import build, timeline
from cairn.operators.graph import PropertyGraph


def debounce(events: DataFrame, ts: str = "ts", gap: str = "30 seconds", watermark: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``started, due, n`` (and the keys): one rebuild per run of events that are less than ``gap`` apart, due when it has been quiet.

    Works on tables and, with a ``watermark``, on streams; there a run is given out once it is closed.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("_ts", watermark)
    by = list(keys)
    if timed.isStreaming and not by:  # a session over all events is one sequence by its nature; streams need a key beside the window
        timed, by = timed.withColumn("_all", F.lit(0) * F.second("_ts")), ["_all"]
    runs = timed.groupBy(F.session_window("_ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("due"), "n")


def _exits(f: np.ndarray, l: np.ndarray) -> np.ndarray:
    """For each poll the last one that is triggered, directly or over others, if it set the mark."""
    n = len(f)
    after = np.full(n, n)
    for values in (f, l):  # the next greater value, by a stack
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            while stack and values[stack[-1]] <= values[i]:
                stack.pop()
            if stack:
                after[i] = min(after[i], stack[-1])
            stack.append(i)
    out = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            out[i] = out[after[i]]
    return out


def _stretches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by workspace and stretch with the bounds of whole stretches; the last one waits for the next batch."""
    rest = None
    for pdf in parts:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = ((pdf["_workspace"] == pdf["_workspace"].iloc[-1]) & (pdf["_part"] == pdf["_part"].iloc[-1])).to_numpy()
        rest, whole = pdf[last], pdf[~last]
        if len(whole):
            yield whole, _bounds(whole)
    if rest is not None:
        yield rest, _bounds(rest)


def _bounds(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    w, p = pdf["_workspace"].to_numpy(), pdf["_part"].to_numpy()
    at = [0, *(np.flatnonzero((w[1:] != w[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(pdf)]
    return list(zip(at, at[1:]))


def _stretch_marks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a stretch of polls makes of any mark it begins with: the polls that exceed all before them, and the mark that each leads to."""
    first = lambda v: np.concatenate(([True], v[1:] > np.maximum.accumulate(v)[:-1]))
    for pdf, bounds in _stretches(parts):
        f, l = pdf["file_count"].to_numpy(), pdf["line_count"].to_numpy()
        kept, ends = [], []
        for a, b in bounds:
            at = np.flatnonzero(first(f[a:b]) | first(l[a:b]))
            kept.append(at + a)
            ends.append(_exits(f[a:b], l[a:b])[at] + a)
        at, end = np.concatenate(kept), np.concatenate(ends)
        yield pd.DataFrame({"_workspace": pdf["_workspace"].to_numpy()[at], "_part": pdf["_part"].to_numpy()[at], "_at": at, "_f": f[at], "_l": l[at], "_ef": f[end], "_el": l[end]})


def _fold_marks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mark with which each stretch begins; rows come sorted by workspace, stretch and place, and only the last mark is held."""
    columns = ["_workspace", "_part", "_mf", "_ml"]
    workspace = part = mark = None
    done = False
    for pdf in parts:
        out = []
        for w, p, _, f, l, ef, el in pdf.itertuples(index=False):
            if w != workspace:
                workspace, part, mark = w, None, None
            if p != part:
                part, done = p, False
                out.append((w, p, *(mark or (None, None))))
            if not done and (mark is None or f > mark[0] or l > mark[1]):
                mark, done = (ef, el), True
        yield pd.DataFrame(out, columns=columns).astype({"_mf": "Int64", "_ml": "Int64"})


def _stretch_triggers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, bounds in _stretches(parts):
        counts = list(zip(pdf["file_count"].tolist(), pdf["line_count"].tolist()))
        marks = list(zip(pdf["_mf"].tolist(), pdf["_ml"].tolist()))
        kept = []
        for a, b in bounds:
            mark = None if pd.isna(marks[a][0]) else marks[a]
            for i in range(a, b):
                grew = mark is not None and (counts[i][0] > mark[0] or counts[i][1] > mark[1])
                if grew or mark is None:
                    mark = counts[i]
                if grew:
                    kept.append(i)
        yield pdf.iloc[kept].drop(columns=["_workspace", "_part", "_order", "_mf", "_ml"])


def growth_triggers(polls: DataFrame, workspace: str = "workspace", order: str = "poll", chunk: int = 10_000) -> DataFrame:
    """Polls (``file_count, line_count``) in which either count exceeds the mark: both counts of the last such poll of the workspace, at first those of its first poll.

    A mark may therefore have a lower count than an earlier poll. Stretches of ``chunk`` values of ``order`` are reduced, all at once, to what they
    make of any mark; these few rows are folded per workspace in order, holding one mark; then each stretch is gone through from
    its mark. So one workspace's log is spread over tasks. Null orders, workspaces and counts are left out; of equal orders the smaller counts come first.
    """
    kind, columns = polls.schema[workspace].dataType.simpleString(), polls.columns
    known = polls.where(F.col(workspace).isNotNull() & F.col(order).isNotNull() & F.col("file_count").isNotNull() & F.col("line_count").isNotNull())
    rows = known.withColumn("_workspace", F.col(workspace)).withColumn("_part", F.floor(F.col(order) / chunk)).withColumn("_order", F.col(order))
    rows = rows.withColumn("file_count", F.col("file_count").cast("bigint")).withColumn("line_count", F.col("line_count").cast("bigint"))
    by = ["_workspace", "_part"]
    order_of = [*by, "_order", "file_count", "line_count"]
    small = rows.select(*order_of).repartition(*by).sortWithinPartitions(*order_of)
    marks = small.mapInPandas(_stretch_marks, f"_workspace {kind}, _part bigint, _at bigint, _f bigint, _l bigint, _ef bigint, _el bigint")
    ordered = marks.repartition("_workspace").sortWithinPartitions(*by, "_at")
    begun = ordered.mapInPandas(_fold_marks, f"_workspace {kind}, _part bigint, _mf bigint, _ml bigint")
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.join(begun, by).repartition(*by).sortWithinPartitions(*order_of).mapInPandas(_stretch_triggers, out)


def latest_changes(events: DataFrame, path: str = "path", ts: str = "ts") -> DataFrame:
    """``path, change``: what happened to each file last."""
    return events.groupBy(path).agg(F.max_by("change", ts).alias("change")).withColumnRenamed(path, "path")


def as_found(changes: DataFrame, present: DataFrame) -> DataFrame:
    """``path, change`` with ``deleted`` for files that are gone by now: those that are not in ``present`` (``path``)."""
    here = present.select("path", F.lit(True).alias("_here")).distinct()
    return changes.join(here, "path", "left").select("path", F.when(F.col("_here").isNull(), "deleted").otherwise(F.col("change")).alias("change"))


def watched(events: DataFrame, suffixes: tuple[str, ...] | None = None, path: str = "path") -> DataFrame:
    """Events of files with one of the suffixes, those of known languages by default."""
    return events.where(paths.ending(path).isin(*(suffixes or tuple(paths.LANGUAGES))))


def fold_changes(
    stream: DataFrame, store: timeline.Timeline, parse: Callable[[DataFrame], PropertyGraph], checkpoint: str, now: Callable[[], float],
    emit: Callable[[DataFrame, DataFrame, int], None] | None = None, suffixes: tuple[str, ...] | None = None,
    present: Callable[[], DataFrame] | None = None, rebuild: Callable[[], PropertyGraph] | None = None,
) -> StreamingQuery:
    """Apply each batch of ``path, change, ts`` events to the latest snapshot and record the next one.

    ``parse`` builds the graph of the files of a batch that still exist; files that are not in ``present()`` (``path``) count as deleted.
    Events of other ``suffixes`` are passed over. Before the first snapshot ``rebuild`` gives the whole graph, if there is one.
    A batch that is replayed after a failure is recognised by its label and not recorded again. ``emit`` gets the changes of nodes and
    of edges between the last two snapshots, and the batch's number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        label = f"batch {number}"
        if store.rows("snapshots").where(F.col("label") == label).take(1):
            return
        changes = latest_changes(watched(batch, suffixes))
        if not changes.take(1):
            return
        before = store.latest()
        if before is None and rebuild:
            store.record(rebuild(), label, now())
            return
        if present:
            changes = as_found(changes, present())
        fresh = parse(changes.where("change <> 'deleted'"))
        after = build.update(store.load(), changes, fresh, now())
        new = store.record(after, label, now())
        if emit and before:
            emit(*store.delta(before, new), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def activity_ring(events: DataFrame, keep: int = 100, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest ``keep`` events; the rest of the order is by ``key``. A top-k, not a sort of the whole log."""
    return events.orderBy(F.desc(ts), F.desc(key)).limit(keep)


def activity_stats(events: DataFrame, tool: str = "tool", ok: str = "ok", duration: str = "duration") -> DataFrame:
    """``tool, calls, errors, mean_duration``."""
    return events.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col(ok), True)).alias("errors"), F.avg(duration).alias("mean_duration"))


def summarize_args(args: DataFrame, *columns: str) -> DataFrame:
    """Long texts cut to 117 characters and dots."""
    return args.select(*[paths.truncated(c, 120, 117, "...").alias(c) if c in columns else F.col(c) for c in args.columns])


def envelope(df: DataFrame, error: str | None = None) -> DataFrame:
    """Rows as ``status, data, error``."""
    return df.select(F.lit("ok" if error is None else "error").alias("status"), F.to_json(F.struct("*")).alias("data"), F.lit(error).cast("string").alias("error"))
