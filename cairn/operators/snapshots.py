"""Full snapshots compared by Merkle digests: changes between neighbours, and histories of attributes.

Rows are reduced to ``node_id, pos, digest`` (``pos`` numbers the snapshots that are listed). Node ids fall
into hash ranges; a range's digest per snapshot is the xor of its rows' hashes, and sixteen ranges make one of
the next level. From the root downwards only ranges whose digests differ between neighbouring snapshots are
entered, and only the rows of differing leaf ranges are compared one by one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import materialize

FAN_OUT_BITS = 4


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def canonical_json(text: str | None, ignore: tuple[str, ...] = ()) -> str | None:
    """One spelling for equal JSON values: members sorted, null members left out, 3.0 written as 3.

    ``ignore`` names members of the outer object that don't count. Null stays null; a text that is no
    JSON is kept as it is, marked so that it equals no value.
    """
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return "\0" + text
    if isinstance(value, dict):
        for name in ignore:
            value.pop(name, None)
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _canonical_udf(ignore: tuple[str, ...]):
    @F.pandas_udf("string")
    def canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([canonical_json(t, ignore) for t in texts], dtype=object)

    return canonical


def positions(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, pos, created_at`` of the listed snapshots, numbered from 0 in the order of their ids.

    The list of snapshots is metadata: one row per delivery, not per node.
    """
    listed = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("created_at").alias("created_at"))
    return listed.select("snapshot_id", (F.row_number().over(Window.orderBy("snapshot_id")) - 1).alias("pos"), "created_at")


def last_position(order: DataFrame) -> int:
    """The number of the last listed snapshot, whether it has rows or not; 0 if none is listed."""
    return order.agg(F.max("pos")).first()[0] or 0


def settled_rows(rows: DataFrame, snapshots: DataFrame, ignore: tuple[str, ...] = ("last_seen",), keep_attrs: bool = False) -> DataFrame:
    """``node_id, pos, digest`` (``attrs`` too if asked for): the row that holds of each node and snapshot.

    That is the one with the latest ``recorded_at`` (null counts as earliest; of equal times the greatest
    digest). Rows of unlisted snapshots and without node id are left out. Null attributes are a value of their
    own, and a text that is no JSON object equals only itself.
    """
    order = positions(snapshots).select("snapshot_id", "pos")
    listed = rows.select("snapshot_id", "node_id", "attrs", "recorded_at").where("node_id is not null").join(order, "snapshot_id")
    text = _canonical_udf(ignore)("attrs")
    digest = F.xxhash64(F.coalesce(text, F.lit("\0\0")))
    value = [F.col("recorded_at"), digest.alias("digest")] + ([F.col("attrs")] if keep_attrs else [])
    best = listed.select("node_id", "pos", F.struct(*value).alias("v")).groupBy("node_id", "pos").agg(F.max("v").alias("v"))
    return best.select("node_id", "pos", "v.digest", *(["v.attrs"] if keep_attrs else []))


def _tree(rows: DataFrame) -> DataFrame:
    """``pos, leaf, digest, n``: one digest per snapshot and leaf range."""
    mixed = F.xxhash64("node_id", "digest")
    return rows.groupBy("pos", "leaf").agg(F.bit_xor(mixed).alias("digest"), F.count(F.lit(1)).alias("n"))


def _bits(rows: float, leaf_rows: int) -> int:
    """The bits of hashes that make leaf ranges of about ``leaf_rows`` rows."""
    return FAN_OUT_BITS * max(0, math.ceil(math.log(max(1.0, rows / leaf_rows), 2**FAN_OUT_BITS)))


def _leaf(bits: int):
    return F.shiftrightunsigned(F.xxhash64("node_id", F.lit(77)), 64 - bits) if bits else F.lit(0).cast("bigint")


def _levels(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """``pos, range, digest, n`` of every level, the root first: each is rolled up from the next finer one, a sixteenth of it in size."""
    levels = [leaves.withColumnRenamed("leaf", "range")]
    for _ in range(FAN_OUT_BITS, bits + 1, FAN_OUT_BITS):
        up = levels[0].groupBy("pos", F.shiftrightunsigned("range", FAN_OUT_BITS).alias("range")).agg(F.bit_xor("digest").alias("digest"), F.sum("n").alias("n"))
        levels.insert(0, materialize(up, "level"))
    return levels


def _descend(levels: list[DataFrame], last: int) -> DataFrame:
    """``pos, leaf``: leaf ranges that differ between snapshot ``pos - 1`` and ``pos``, found from the root down."""
    open_ = None
    for here in levels:
        old = here.where(F.col("pos") < last).select((F.col("pos") + 1).alias("pos"), "range", "digest", "n", F.lit(-1).alias("side"))
        sides = here.select("pos", "range", "digest", "n", F.lit(1).alias("side")).unionByName(old)
        if open_ is not None:
            entered = open_.select("pos", F.col("range").alias("up"))
            sides = sides.withColumn("up", F.shiftrightunsigned("range", FAN_OUT_BITS)).join(entered, ["pos", "up"], "left_semi")
        equal = (F.bit_xor("digest") == 0) & (F.sum(F.col("n") * F.col("side")) == 0)
        differing = sides.groupBy("pos", "range").agg(equal.alias("equal")).where(~F.col("equal") & (F.col("pos") > 0)).select("pos", "range")
        open_ = materialize(differing, "ranges")  # a plan over all levels would weigh on the driver
    return open_.select("pos", F.col("range").alias("leaf"))


def changes(rows: DataFrame, last: int, leaf_rows: int = 4) -> DataFrame:
    """``node_id, pos, kind``: nodes added, removed or modified from snapshot ``pos - 1`` to ``pos``, up to snapshot ``last``.

    ``rows`` is a settled table (``node_id, pos, digest``), materialized, as it is read twice. ``leaf_rows`` is
    the aim for rows per leaf range and snapshot: it sets how fine the tree is, not the result.
    """
    n, per = rows.agg(F.count(F.lit(1)), F.countDistinct("pos")).first()
    bits = _bits(n / max(1, per), leaf_rows)
    placed = rows.select("node_id", "pos", "digest", _leaf(bits).alias("leaf"))
    open_ = _descend(_levels(materialize(_tree(placed), "digests"), bits), last)
    new = placed.select("node_id", "pos", "leaf", F.col("digest").alias("new"), F.lit(None).cast("bigint").alias("old"))
    old = placed.select("node_id", (F.col("pos") + 1).alias("pos"), "leaf", F.lit(None).cast("bigint").alias("new"), F.col("digest").alias("old"))
    sides = new.unionByName(old).join(open_, ["pos", "leaf"], "left_semi")
    both = sides.groupBy("pos", "leaf", "node_id").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    return both.select("node_id", "pos", _kind().alias("kind")).where("kind is not null")


def _kind():
    return F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "modified")


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, ignore: tuple[str, ...] = ("last_seen",)) -> DataFrame:
    """``snapshot_from, snapshot_to, node_id, change_kind`` between each listed snapshot and the one before it.

    The first snapshot has no changes. A listed snapshot without rows removes all nodes. Empty tables give no rows.
    """
    settled = materialize(settled_rows(rows, snapshots, ignore), "settled")
    order = positions(snapshots)
    to = order.select(F.col("pos"), F.col("snapshot_id").alias("snapshot_to"))
    from_ = order.select((F.col("pos") + 1).alias("pos"), F.col("snapshot_id").alias("snapshot_from"))
    found = changes(settled, last_position(order)).join(from_.join(to, "pos"), "pos")
    return found.select("snapshot_from", "snapshot_to", "node_id", F.col("kind").alias("change_kind"))


def _runs(settled: DataFrame, order: DataFrame) -> DataFrame:
    """``node_id, pos_from, pos_to``: the longest runs of neighbouring snapshots with equal attributes.

    They follow from the changes alone: a version starts in the first snapshot or where a node was added or
    modified, and lasts until the snapshot before its next change, or to the last one.
    """
    last = last_position(order)
    found = changes(settled, last)
    first = settled.where("pos = 0").select("node_id", "pos", F.lit("added").alias("kind"))
    each = found.unionByName(first)
    follows = F.lead("pos").over(Window.partitionBy("node_id").orderBy("pos"))
    spans = each.withColumn("next", follows).where("kind <> 'removed'")
    return spans.select("node_id", F.col("pos").alias("pos_from"), F.coalesce(F.col("next") - 1, F.lit(last)).alias("pos_to"))


def version_runs(rows: DataFrame, snapshots: DataFrame, ignore: tuple[str, ...] = ("last_seen",)) -> DataFrame:
    """``node_id, snapshot_from, snapshot_to`` of every version of every node."""
    settled = materialize(settled_rows(rows, snapshots, ignore), "settled")
    order = positions(snapshots)
    a = order.select(F.col("pos").alias("pos_from"), F.col("snapshot_id").alias("snapshot_from"))
    b = order.select(F.col("pos").alias("pos_to"), F.col("snapshot_id").alias("snapshot_to"))
    return _runs(settled, order).join(a, "pos_from").join(b, "pos_to").select("node_id", "snapshot_from", "snapshot_to")


def attribute_history(rows: DataFrame, snapshots: DataFrame, ignore: tuple[str, ...] = ("last_seen",)) -> DataFrame:
    """Every version with its attributes and the period it was valid.

    ``node_id, version`` (from 1), ``snapshot_from, snapshot_to, valid_from, valid_to`` (``created_at`` of the
    first snapshot of the version and of the first one after it; null while it is current), ``is_current``, ``attrs``
    as delivered in its first snapshot, ``first_seen`` from there and ``last_seen`` from its last snapshot.
    """
    settled = materialize(settled_rows(rows, snapshots, ignore, keep_attrs=True), "settled")
    order = positions(snapshots)
    a = order.select(F.col("pos").alias("pos_from"), F.col("snapshot_id").alias("snapshot_from"), F.col("created_at").alias("valid_from"))
    b = order.select(F.col("pos").alias("pos_to"), F.col("snapshot_id").alias("snapshot_to"))
    c = order.select((F.col("pos") - 1).alias("pos_to"), F.col("created_at").alias("valid_to"))
    runs = _runs(settled.select("node_id", "pos", "digest"), order)
    # first and last row of each version in one pass over the settled rows, which are dealt by node like the versions
    ends = runs.join(settled.select("node_id", "pos", "attrs"), "node_id").where("pos = pos_from or pos = pos_to")
    member = lambda name: F.get_json_object("attrs", f"$.{name}").cast("double")
    first, last = F.col("pos") == F.col("pos_from"), F.col("pos") == F.col("pos_to")
    whole = ends.groupBy("node_id", "pos_from", "pos_to").agg(
        F.max(F.when(first, F.col("attrs"))).alias("attrs"), F.max(F.when(first, member("first_seen"))).alias("first_seen"), F.max(F.when(last, member("last_seen"))).alias("last_seen")
    )
    whole = whole.join(a, "pos_from").join(b, "pos_to").join(c, "pos_to", "left")
    version = F.row_number().over(Window.partitionBy("node_id").orderBy("pos_from"))
    return whole.select(
        "node_id", version.alias("version"), "snapshot_from", "snapshot_to", "valid_from", "valid_to",
        F.col("valid_to").isNull().alias("is_current"), "attrs", "first_seen", "last_seen",
    )


class History:
    """A history that grows by one snapshot at a time, in tables below a folder that all executors share.

    Of the last snapshot the settled rows and the digests of every level are kept. ``append`` reads the new snapshot's rows and these: it
    compares the digests from the root down, takes the rows of differing leaf ranges alone, and appends what changed as events. Each snapshot
    writes folders of its own and its head last, so a try that broke off is written anew and nothing counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, ignore: tuple[str, ...] = ("last_seen",), leaf_rows: int = 4) -> None:
        self.spark, self.path, self.ignore, self.leaf_rows = spark, path, ignore, leaf_rows

    def heads(self) -> DataFrame:
        """``snapshot_id, created_at, bits`` of the snapshots that were appended."""
        schema = "created_at double, bits int, snapshot_id bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/heads")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _state(self, snapshot_id: int, name: str) -> str:
        return f"{self.path}/state/{snapshot_id}/{name}"

    def append(self, rows: DataFrame, snapshot_id: int, created_at: float) -> None:
        """Add a full snapshot: ``rows`` (``node_id, attrs, recorded_at``) of this snapshot, whose id must exceed all earlier ones."""
        last = self.heads().orderBy(F.desc("snapshot_id")).first()
        if last is not None and snapshot_id <= last.snapshot_id:
            raise ValueError(f"snapshot {snapshot_id} is not after {last.snapshot_id}")
        listed = self.spark.createDataFrame([(snapshot_id, created_at)], "snapshot_id bigint, created_at double")
        delivered = rows.select(F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), "node_id", "attrs", "recorded_at")
        settled = materialize(settled_rows(delivered, listed, self.ignore, keep_attrs=True).drop("pos"), "settled")
        bits = last.bits if last is not None else _bits(settled.count(), self.leaf_rows)
        read = self.spark.read.parquet
        # rows lie in the order of leaf ranges, so that the next snapshot reads the files of differing ranges only
        settled.withColumn("leaf", _leaf(bits)).repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(self._state(snapshot_id, "rows"))
        new = read(self._state(snapshot_id, "rows"))
        leaves = _tree(new.withColumn("pos", F.lit(1))).drop("pos").withColumnRenamed("leaf", "range")
        for level in range(bits, -1, -FAN_OUT_BITS):
            leaves.write.mode("overwrite").parquet(self._state(snapshot_id, f"level{level}"))
            up = read(self._state(snapshot_id, f"level{level}"))
            leaves = up.groupBy(F.shiftrightunsigned("range", FAN_OUT_BITS).alias("range")).agg(F.bit_xor("digest").alias("digest"), F.sum("n").alias("n"))
        if last is None:
            events = new.select("node_id", F.lit("added").alias("kind"), "attrs", F.lit(None).cast("double").alias("last_seen"))
        else:
            levels = [
                read(self._state(snapshot_id, f"level{k}")).withColumn("pos", F.lit(1)).unionByName(read(self._state(last.snapshot_id, f"level{k}")).withColumn("pos", F.lit(0)))
                for k in range(0, bits + 1, FAN_OUT_BITS)
            ]
            open_ = _descend(levels, 1).select("leaf")
            a = new.join(open_, "leaf", "left_semi").select("node_id", F.col("digest").alias("new"), "attrs")
            old = read(self._state(last.snapshot_id, "rows")).join(open_, "leaf", "left_semi")
            b = old.select("node_id", F.col("digest").alias("old"), F.get_json_object("attrs", "$.last_seen").cast("double").alias("last_seen"))
            events = a.join(b, "node_id", "full_outer").select("node_id", _kind().alias("kind"), "attrs", "last_seen").where("kind is not null")
        events.write.mode("overwrite").parquet(f"{self.path}/events/snapshot_id={snapshot_id}")
        head = self.spark.createDataFrame([(float(created_at), bits)], "created_at double, bits int")
        head.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/snapshot_id={snapshot_id}")

    def versions(self) -> DataFrame:
        """The same rows as ``attribute_history`` over all appended snapshots."""
        heads = self.heads()
        last = heads.orderBy(F.desc("snapshot_id")).first()
        if last is None:
            raise ValueError("nothing was appended")
        order = positions(heads)
        events = self.spark.read.option("basePath", f"{self.path}/events").schema("node_id string, kind string, attrs string, last_seen double, snapshot_id bigint").parquet(f"{self.path}/events")
        events = events.join(order.select("snapshot_id", "pos", F.col("created_at").alias("valid_from")), "snapshot_id")  # those of appended snapshots
        w = Window.partitionBy("node_id").orderBy("pos")
        spans = events.select("*", F.lead("pos").over(w).alias("next"), F.lead("last_seen").over(w).alias("closed")).where("kind <> 'removed'")
        spans = spans.withColumn("pos_to", F.coalesce(F.col("next") - 1, F.lit(last_position(order))))
        ends = order.select(F.col("pos").alias("pos_to"), F.col("snapshot_id").alias("snapshot_to"))
        after = order.select((F.col("pos") - 1).alias("pos_to"), F.col("created_at").alias("valid_to"))
        now = self.spark.read.parquet(self._state(last.snapshot_id, "rows")).select("node_id", F.get_json_object("attrs", "$.last_seen").cast("double").alias("now"))
        whole = spans.join(ends, "pos_to").join(after, "pos_to", "left").join(now, "node_id", "left")
        return whole.select(
            "node_id", F.row_number().over(w).alias("version"), F.col("snapshot_id").alias("snapshot_from"), "snapshot_to", "valid_from", "valid_to",
            F.col("valid_to").isNull().alias("is_current"), "attrs", F.get_json_object("attrs", "$.first_seen").cast("double").alias("first_seen"),
            F.when(F.col("next").isNull(), F.col("now")).otherwise(F.col("closed")).alias("last_seen"),
        )
