"""Ordered operators that scale without one task per key: carry-forward, as-of, quiet time, medians.

What fits one task is one window.  More rows are cut by range of key and order, from a
sample, into pieces of about equal count: neither a key that holds most rows nor a burst
makes a piece long.  Inside a piece a window does the work; what a piece must know of
earlier ones is one row per key and piece, carried over a small table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelake.functions.storage import shared_folder

#: Rows that one task orders or folds at once, about.
ROWS_PER_PIECE = 1_000_000


def seconds(ts: str) -> Column:
    """Epoch seconds with microseconds, as double."""
    return F.unix_micros(ts).cast("double") / 1e6


def _cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, written to the checkpoint folder; a local master without one gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def in_pieces(rows: DataFrame, total: int, *order: str) -> DataFrame:
    """Rows with the number of their ``_piece``: pieces follow ``order`` and have about ROWS_PER_PIECE of the rows each."""
    return _cut(rows.repartitionByRange(max(1, -(-total // ROWS_PER_PIECE)), *order).withColumn("_piece", F.spark_partition_id()))


def carry_last(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` strictly before each row in ``order`` within ``by``."""
    rows = df.withColumn("_value", value)
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = rows.count()
    if total <= ROWS_PER_PIECE:
        return rows.withColumn(name, F.last("_value", True).over(before(*by))).drop("_value")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = in_pieces(rows, total, *by, *order)
    there, rank = F.col("_value").isNotNull(), F.struct(*order)
    per = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("_piece").alias("_piece_no")).agg(F.max_by(F.when(there, F.col("_value")), F.when(there, rank)).alias("_last"))
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_piece_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.last("_last", True).over(earlier)).drop("_last")
    match = F.col("_piece") == F.col("_piece_no")
    for b, k in zip(by, keys, strict=True):
        match = match & F.col(b).eqNullSafe(F.col(k))
    local = rows.withColumn("_inside", F.last("_value", True).over(before(*by, "_piece")))
    return local.join(per, match, "left").withColumn(name, F.coalesce("_inside", "_before")).drop("_piece", "_value", "_inside", "_piece_no", "_before", *keys)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, payload: Column, name: str, forward: bool = False) -> DataFrame:
    """Left rows with the payload of the nearest right row at or before (``forward``: at or after) their time.

    Rows without a time on the left get null; ties on the right go to the greatest payload.
    """
    sign = -1 if forward else 1
    a = left.select(*by, F.lit(1).alias("_side"), (sign * seconds(left_ts)).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    b = right.where(F.col(right_ts).isNotNull()).select(*by, F.lit(0).alias("_side"), (sign * seconds(right_ts)).alias("_t"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_p"))
    both = carry_last(a.unionByName(b), by, ["_t", "_side", "_p"], F.col("_p"), "_near")
    return both.where("_side = 1").select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_near")).alias(name))


def _chain(times: np.ndarray, micros: int) -> np.ndarray:
    """For each time the place of the next one beyond the time to live; their number where there is none."""
    return np.searchsorted(times, times + micros, side="right")


def _lasts(table: pa.Table, micros: int) -> pa.Table:
    """(_key, _t, _last): the last accepted time of a piece for each time at which a chain may enter it.

    A chain from an earlier piece enters within a time to live of the piece's first time,
    or else at the first one behind that.
    """
    t = np.sort(table["_t"].to_numpy())
    n, after = len(t), _chain(t, micros)
    last = np.where(after < n, after, np.arange(n))
    while not np.array_equal(further := last[last], last):  # pointers double
        last = further
    some = min(int(np.searchsorted(t, t[0] + micros, side="right")) + 1, n)
    key = table["_key"].combine_chunks().take(pa.array(np.zeros(some, np.int64)))
    return pa.table({"_key": key, "_t": t[:some], "_last": t[last[:some]]})


def _accepted(table: pa.Table, micros: int) -> pa.Table:
    """(_key, _t) of the chain that begins at the piece's ``_entry``."""
    t = np.sort(table["_t"].to_numpy())
    after = _chain(t, micros)
    at, found = int(np.searchsorted(t, table["_entry"][0].as_py())), []
    while at < len(t):
        found.append(at)
        at = int(after[at])
    return pa.table({"_key": table["_key"].combine_chunks().take(pa.array(np.zeros(len(found), np.int64))), "_t": t[found]})


def accept_after_quiet(hits: DataFrame, by: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """The times (by, ts) of hits that a time-to-live from the last accepted hit lets through.

    The first hit of a key is accepted, and after an accepted hit the next one later than
    the ttl; a gap of exactly the ttl is still suppressed.  Times are cut into pieces by
    their number (``in_pieces``), whatever the ttl.  A piece is a map from the times at
    which a chain may enter it to those at which it leaves; from there the chain goes on
    to the next time beyond the ttl, in whichever piece that is.  These hops are composed
    with themselves, so that they double in length, until the entries of a key are known;
    then each entered piece marks its chain.  No task holds a key or an island of hits.
    """
    micros = ttl_seconds * 1_000_000
    key = F.struct(F.lit(0).alias("_"), *by).alias("_key")
    times = hits.select(key, F.unix_micros(ts).alias("_t")).where("_t is not null").distinct()
    shown = lambda kept: kept.select(*[F.col("_key")[b].alias(b) for b in by], F.timestamp_micros("_t").alias(ts))
    if micros <= 0:
        return shown(times)
    of = lambda *names: StructType([times.schema["_key"], *[StructField(n, LongType()) for n in names]])
    times = _cut(times)
    total, entered = times.count(), times.groupBy("_key").agg(F.min("_t").alias("_t"))
    if total <= ROWS_PER_PIECE:
        placed, entries = times, entered.withColumnRenamed("_t", "_entry")
        piece = ["_key"]
    else:
        placed = in_pieces(times, total, "_key", "_t")
        piece = ["_key", "_piece"]
        lasts = _cut(placed.groupBy(*piece).applyInArrow(lambda t: _lasts(t, micros), of("_t", "_last")))
        # later times come first, and of equal ones the asking row: so it sees only entries beyond its own
        asks = lasts.select("_key", "_t", (-F.col("_last") - micros).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_to"))
        tells = lasts.select("_key", "_t", (-F.col("_t")).alias("_at"), F.lit(1).alias("_side"), F.col("_t").alias("_to"))
        seen = carry_last(asks.unionByName(tells), ["_key"], ["_at", "_side"], F.col("_to"), "_next")
        hops = _cut(seen.where("_side = 0 and _next is not null").select("_key", "_t", "_next"))
        entered = _cut(entered)
        size = entered.count()
        while True:
            entered = _cut(entered.unionByName(entered.join(hops, ["_key", "_t"]).select("_key", F.col("_next").alias("_t"))))
            before, size = size, entered.count()
            if size == before:
                break
            further = hops.select("_key", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
            hops = _cut(hops.join(further, ["_key", "_next"]).select("_key", "_t", F.col("_far").alias("_next")))
        entries = placed.join(entered, ["_key", "_t"]).select(*piece, F.col("_t").alias("_entry"))
    return shown(placed.join(entries, piece).groupBy(*piece).applyInArrow(lambda t: _accepted(t, micros), of("_t")))


#: Distinct values of a key that are put in one list at the end of a selection, and parts into which the others are cut in a round.
LISTED_VALUES, PARTS = 10_000, 64


def exact_median(df: DataFrame, by: list[str], value: str, name: str, accuracy: int = 10_000) -> DataFrame:
    """Median of a column by keys, by repeated counting.

    Equal values are counted first.  Of many rows an approximate bracket of the middle is
    asked for; while one has more than LISTED_VALUES distinct values, these are cut into PARTS, the
    rows of each part are counted, and the parts that hold the middle are the new bracket.
    So lists have a fixed bound, and one key may hold all rows, and one value too.  Null
    values do not count; a key without values has a null.
    """
    names = [*[f"_k{i}" for i in range(len(by))], "_one"]
    rows = df.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.lit(0).alias("_one"), F.col(value).cast("double").alias("_v"))
    key = F.struct(*names).alias("_key")  # a struct is joined whole, nulls inside it too
    keyed = rows.select(key, "_v")
    counted = keyed.where("_v is not null").groupBy("_key", "_v").agg(F.count("*").alias("_c"))
    if keyed.count() <= LISTED_VALUES:
        bounds, inside = counted.groupBy("_key").agg(F.sum("_c").alias("_n"), F.lit(0).cast("long").alias("_below")), counted
    else:
        slack = 2.0 / accuracy
        ends = F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], accuracy)
        placed = counted.join(keyed.groupBy("_key").agg(ends[0].alias("_low"), ends[1].alias("_high"), F.count("_v").alias("_n")), "_key")
        below = F.coalesce(F.sum(F.when(F.col("_v") < F.col("_low"), F.col("_c"))), F.lit(0))
        bounds = placed.groupBy("_key").agg(F.max("_n").alias("_n"), below.alias("_below"))
        bounds, inside = _narrowed(bounds, placed.where("_v between _low and _high").select("_key", "_v", "_c"), accuracy)
    listed = inside.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_in"))

    def at(rank: Column) -> Column:
        step = lambda s, x: F.struct((s["seen"] + x["_c"]).alias("seen"), F.when(s["hit"].isNull() & (s["seen"] + x["_c"] > rank), x["_v"]).otherwise(s["hit"]).alias("hit"))
        return F.aggregate("_in", F.struct(F.col("_below").alias("seen"), F.lit(None).cast("double").alias("hit")), step)["hit"]

    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
    found = bounds.join(listed, "_key").select("_key", middle.alias(name))
    return keyed.select("_key").distinct().join(found, "_key", "left").select(*[F.col("_key")[k].alias(b) for k, b in zip(names, by, strict=False)], name)


def _narrowed(bounds: DataFrame, inside: DataFrame, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Brackets of at most LISTED_VALUES distinct values: (_key, _n, _below) and the values (_key, _v, _c) in them."""
    while True:
        bounds, inside = _cut(bounds), _cut(inside)
        if (inside.groupBy("_key").count().agg(F.max("count")).first()[0] or 0) <= LISTED_VALUES:
            return bounds, inside
        edges = inside.groupBy("_key").agg(F.array_distinct(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], accuracy)).alias("_edges"))
        parts = inside.join(F.broadcast(edges) if edges.count() <= 1000 else edges, "_key").withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
        sums = parts.groupBy("_key", "_part").agg(F.sum("_c").alias("_sum")).join(bounds, "_key")
        upto = Window.partitionBy("_key").orderBy("_part")
        sums = sums.withColumn("_before", F.col("_below") + F.sum("_sum").over(upto) - F.col("_sum"))
        middle = (F.col("_before") <= F.floor(F.col("_n") / 2)) & (F.col("_before") + F.col("_sum") > F.floor((F.col("_n") - 1) / 2))
        held = _cut(sums.where(middle).select("_key", "_part", "_n", "_before"))
        inside = parts.join(held.select("_key", "_part"), ["_key", "_part"]).drop("_part")
        bounds = held.groupBy("_key").agg(F.max("_n").alias("_n"), F.min("_before").alias("_below"))
