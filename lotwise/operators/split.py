"""Splits, samples and lots, all decided by a row's hashed key.

A random order is the order of ``md5(seed|row_id)``.  Hash prefixes cut that order into equally
filled buckets, so positions in it are found from bucket sizes (a table of fixed size) and, where
a position falls inside a bucket, from that bucket alone.  The features never move.
"""

import math
import operator
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_hex, keyed_uniform
from lotwise.functions.vectors import let

BUCKET_DIGITS = 4  # 65,536 buckets: the proven size of every offset table below


def _keyed(df, *seed_parts):
    hashed = keyed_hex(*seed_parts, F.col("row_id"))
    return df.withColumn("_key", F.struct(hashed.alias("h"), F.col("row_id").alias("r"))).withColumn(
        "_bucket", F.substring("_key.h", 1, BUCKET_DIGITS)
    )


def _bucket_starts(keyed, by=()):
    """Rows per bucket and rows in the buckets before it."""
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket")
    return sizes.withColumn(
        "_start",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )


def random_rank(df, *seed_parts, by=()):
    """1-based position of every row in the keyed random order, as column ``rn``."""
    keyed = _keyed(df, *seed_parts)
    starts = _bucket_starts(keyed.select(*by, "_key", "_bucket"), by)
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key"))
    starts = starts.drop("_n") if by else F.broadcast(starts.drop("_n"))
    return (
        keyed.join(starts, [*by, "_bucket"])
        .withColumn("rn", (F.col("_start") + inside).cast("bigint"))
        .drop("_key", "_bucket", "_start")
    )


def _first_n_condition(df, seed, n_expr):
    """Condition on ``_key`` that holds for the first n rows of the random order."""
    keyed = _keyed(df.select("row_id"), seed)
    starts = _bucket_starts(keyed)
    total = F.sum("_n").over(Window.partitionBy())
    cut = starts.withColumn("_k", n_expr(total)).where(
        (F.col("_start") < F.col("_k")) & (F.col("_k") <= F.col("_start") + F.col("_n"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    last = (
        keyed.join(F.broadcast(cut.select("_bucket", "_start", "_k")), "_bucket")
        .withColumn("rn", F.col("_start") + inside)
        .where(F.col("rn") == F.col("_k"))
        .select("_key")
    )
    return F.coalesce(F.col("_key") <= last.scalar(), F.lit(False))


def train_test_split(df, test_ratio, seed):
    """The first ceil(ratio * N) rows of the random order are the test set, the rest train.

    Exact and free of shuffles: each side is a filter against the key of the last test row.
    """
    in_test = _first_n_condition(df, seed, lambda n: F.ceil(n * F.lit(float(test_ratio))))
    marked = _keyed(df, seed).withColumn("_test", in_test).drop("_key", "_bucket")
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def validation_split(train, test, valid_size, seed=0):
    """Validation is the test set when ``valid_size`` is 0, else a part of the training set."""
    if valid_size == 0:
        return train, test
    return train_test_split(train, valid_size, seed)


def sample_rows(df, n, seed):
    """n rows without replacement."""
    chosen = _first_n_condition(df, seed, lambda total: F.least(total, F.lit(int(n))))
    return _keyed(df, seed).where(chosen).drop("_key", "_bucket")


def tail_split(df, k=20):
    """The k rows with the highest ``row_id`` are the test set (k is a small report size)."""
    last = df.select("row_id").orderBy(F.desc("row_id")).limit(k)
    edge = last.agg(F.min("row_id").alias("edge")).scalar()
    return df.where(F.col("row_id") < edge), df.where(F.col("row_id") >= edge)


def unbalance_classes(df, n_pos=2000, positive=1.0):
    """First ``n_pos`` positives by ``row_id`` and all other rows."""
    first = df.where(F.col("y") == positive).select("row_id").orderBy("row_id").limit(n_pos)
    edge = first.agg(F.max("row_id").alias("edge")).scalar()
    return df.where((F.col("y") != positive) | (F.col("row_id") <= edge))


def lot_size_of(lot_ratio, n, max_iter=1):
    """Rows per lot: a ratio up to 1 is a share of n, above 1 a row count; never above all updates."""
    size = max(1, math.ceil(lot_ratio * n)) if lot_ratio <= 1 else int(lot_ratio)
    return min(size, int(n * max_iter))


def lot_plan(df, lot_ratio, max_iter):
    """One row: lot size, updates (whole lots only) and number of lots."""
    ratio = float(lot_ratio)
    n = F.col("n")
    wanted = F.greatest(F.lit(1), F.ceil(n * F.lit(ratio))) if ratio <= 1 else F.lit(int(ratio))
    return (
        df.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("all_updates", (n * F.lit(float(max_iter))).cast("bigint"))
        .withColumn("lot_size", F.least(wanted.cast("bigint"), F.col("all_updates")))
        .withColumn("updates", F.col("all_updates") - F.col("all_updates") % F.col("lot_size"))
        .withColumn("lots", F.expr("updates div lot_size"))
        .select("n", "lot_size", "updates", "lots")
    )


def assign_lots(df, lot_size, epochs, seed, mode="exact"):
    """Rows with their ``epoch`` and ``lot``; lots are numbered through all epochs.

    ``exact``: a new random order per epoch, cut into consecutive lots; a lot may span two epochs
    and rows after the last whole lot are left out.  ``hash``: lots of about equal size by a hash
    of the key, no ranking at all.  ``poisson``: every row joins every lot independently with
    probability lot_size / N, so a row may appear in several lots or none.
    """
    per_epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    lots_per_epoch = F.ceil(n / F.lit(lot_size)).cast("int")
    if mode == "exact":
        ranked = random_rank(df.withColumn("epoch", per_epoch), seed, F.col("epoch"), by=["epoch"])
        place = F.col("epoch") * n + F.col("rn") - 1
        lots = F.floor(n * F.lit(epochs) / F.lit(lot_size))
        return (
            ranked.withColumn("lot", F.floor(place / F.lit(lot_size)).cast("int"))
            .where(F.col("lot") < lots)
            .drop("rn")
        )
    if mode == "hash":
        spread = F.floor(keyed_uniform(seed, F.col("epoch"), F.col("row_id")) * lots_per_epoch)
        return df.withColumn("epoch", per_epoch).withColumn(
            "lot", (F.col("epoch") * lots_per_epoch + spread).cast("int")
        )
    if mode == "poisson":
        steps = F.floor(n * F.lit(epochs) / F.lit(lot_size)).cast("int")
        block = F.least(lots_per_epoch, F.lit(CHAIN_LOTS))
        keyed = df.withColumns({"_steps": steps, "_rate": F.least(F.lit(1.0), F.lit(float(lot_size)) / n), "_block": block})
        starts = F.sequence(F.lit(0), F.floor((F.col("_steps") - 1) / F.col("_block")).cast("int"))
        joined = _joined_lots(starts, F.col("_rate"), F.col("_block"), seed)
        return (
            keyed.withColumn("lot", F.explode(F.filter(joined, lambda t: t < F.col("_steps"))))
            .withColumn("epoch", F.floor(F.col("lot") / lots_per_epoch).cast("int"))
            .drop("_steps", "_rate", "_block")
        )
    raise ValueError(f"unknown lot mode {mode!r}")


# Up to this many lots per epoch are told apart by comparing a row's key with their last keys.
FEW_LOTS = 64


def _lot_ends(keys, lot_size, whole, shift):
    """Last key of each of the first ``whole`` lots, in order; the first one lacks ``shift`` rows.

    Two narrow jobs over the keys: bucket sizes (at most 65,536 numbers) tell in which bucket and
    at which place a lot ends, then only those buckets are ranked.
    """
    sizes = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("_bucket").toArrow()
    buckets, ends = sizes["_bucket"].to_pylist(), np.cumsum(sizes["n"].to_numpy())
    positions = lot_size * np.arange(1, whole + 1) - shift
    found = np.searchsorted(ends, positions)
    places = positions - np.concatenate(([0], ends))[found]
    wanted = [
        (F.col("_bucket") == buckets[f]) & (F.col("_place") == int(p)) for f, p in zip(found, places)
    ]
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    ranked = keys.where(F.col("_bucket").isin(sorted({buckets[f] for f in found})))
    ranked = ranked.withColumn("_place", inside).where(reduce(operator.or_, wanted))
    return [r["_key"] for r in ranked.select("_key").orderBy("_key").collect()]


def slice_lots(df, lot_size, n, *seed_parts, skip=0):
    """Lot of every row within one epoch, for a known row count; the tail beyond whole lots is -1.

    The first ``skip`` rows of the order (fewer than a lot) come before lot 0 and are -1 too.

    Lots larger than a bucket are told apart by the keys at which they end, so the rows stay where
    they are; small lots are cut from full ranks.
    """
    shift = (lot_size - skip) % lot_size
    whole = (n + shift) // lot_size
    own = lambda lot: F.when(lot < whole, lot - int(shift > 0)).otherwise(F.lit(-1))
    if whole <= FEW_LOTS:
        keyed = _keyed(df, *seed_parts)
        lot = F.lit(-1)
        ends = _lot_ends(_keyed(df.select("row_id"), *seed_parts), lot_size, whole, shift) if whole else []
        for number, end in reversed(list(enumerate(ends, -int(shift > 0)))):
            edge = F.struct(F.lit(end["h"]).alias("h"), F.lit(end["r"]).cast(df.schema["row_id"].dataType).alias("r"))
            lot = F.when(F.col("_key") <= edge, F.lit(number)).otherwise(lot)
        return keyed.withColumn("lot", lot).drop("_key", "_bucket")
    if n // 16**BUCKET_DIGITS > lot_size:
        lot = F.floor((F.col("rn") - 1 + shift) / F.lit(lot_size)).cast("int")
        return random_rank(df, *seed_parts).withColumn("lot", own(lot)).drop("rn")
    keys = _keyed(df.select("row_id"), *seed_parts)
    starts = _bucket_starts(keys).withColumn("_start", F.col("_start") + shift)
    starts = starts.withColumn("_first", F.expr(f"_start div {lot_size}"))
    crossed = F.expr(f"(_start + _n) div {lot_size} > _first")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    # A bucket holds about n / 65,536 rows and a lot at least that many: few cuts per bucket.
    cuts = (
        keys.join(F.broadcast(starts.where(crossed)), "_bucket")
        .withColumn("rn", F.col("_start") + inside)
        .where(F.col("rn") % lot_size == 0)
        .groupBy("_bucket")
        .agg(F.collect_list("_key").alias("_cuts"))
    )
    table = starts.select("_bucket", "_first").join(cuts, "_bucket", "left")
    passed = F.coalesce(
        F.size(F.filter("_cuts", lambda c: c < F.col("_key"))), F.lit(0)
    )
    lot = (F.col("_first") + F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).cast("int")
    return (
        _keyed(df, *seed_parts)
        .join(F.broadcast(table), "_bucket")
        .withColumn("lot", own(lot))
        .drop("_key", "_bucket", "_first", "_cuts")
    )


def spanning_lot(df, lot, lot_size, n, seed):
    """Column ``lots`` of the lot that holds an epoch's last rows and the next one's first.

    A row that is in both ends is in the lot twice; a row of neither has an empty list.
    """
    epoch = lot * lot_size // n
    tail = (epoch + 1) * n - lot * lot_size
    ends = {"_tail": (epoch, n - tail), "_head": (epoch + 1, lot_size - tail)}
    for name, (of, size) in ends.items():
        first = _first_n_condition(df, f"{seed}|{of}", lambda _, size=size: F.lit(size).cast("bigint"))
        inside = first if name == "_head" else ~first
        inside = F.lit(name == "_tail") if size == 0 else inside
        df = _keyed(df, f"{seed}|{of}").withColumn(name, F.when(inside, F.lit(lot).cast("int"))).drop("_key", "_bucket")
    return df.withColumn("lots", F.array_compact(F.array("_tail", "_head"))).drop("_tail", "_head")


# Lots of a chain of skips; it begins anew after so many, or with the epoch.
CHAIN_LOTS = 1 << 12
# Skips that are taken in the first stretch; a row that joins more lots of a block goes on in a second.
FIRST_SKIPS = 24


def _joined_lots(blocks, rate, size, seed):
    """Ordered lots that a row joins in the given blocks of ``size`` lots: skip sampling.

    Between two lots that a row joins with probability ``rate`` each lie floor(ln u / ln(1 - rate))
    lots that it does not join.  The uniforms are keyed by seed, block, row and number of the skip, so
    a draw is made for each lot joined and one more, none for the lots passed over.
    """

    def skip(block, j):
        u = keyed_uniform(seed, "skip", block, F.col("row_id"), j)
        return F.when(rate < 1.0, F.floor(F.log(u) / F.log(F.lit(1.0) - rate))).otherwise(F.lit(0)).cast("bigint")

    def go(block, numbers, state):
        def step(s, j):
            # A row that is past the block's end draws no more.
            moved = F.struct(
                (s["at"] + 1 + skip(block, j)).alias("at"), F.array_append(s["lots"], (block * size + s["at"]).cast("int")).alias("lots"),
            )
            return F.when(s["at"] < size, moved).otherwise(s)

        return F.aggregate(numbers, state, step)

    def of_block(block):
        start = F.struct(skip(block, F.lit(0)).alias("at"), F.array().cast("array<int>").alias("lots"))
        first = let(go(block, F.sequence(F.lit(1), F.lit(FIRST_SKIPS)), start), lambda s: F.when(
            s["at"] < size, go(block, F.sequence(F.lit(FIRST_SKIPS + 1), size.cast("int") + FIRST_SKIPS), s)
        ).otherwise(s))
        return first["lots"]

    return F.flatten(F.transform(blocks, of_block))


def poisson_lots(df, lot_size, n, steps, seed):
    """Ordered list of the lots a row joins among ``steps`` (a range of lot numbers)."""
    rate, block = F.lit(min(1.0, lot_size / n)), min(-(-n // lot_size), CHAIN_LOTS)
    blocks = F.sequence(F.lit(steps.start // block), F.lit((steps.stop - 1) // block))
    joined = _joined_lots(blocks, rate, F.lit(block), seed)
    return df.withColumn("lots", F.filter(joined, lambda t: (t >= steps.start) & (t < steps.stop)))


# Up to this many parts are cut out of the buckets; more are numbered by full ranks of the keys.
CUT_PARTS = 16**BUCKET_DIGITS


def assign_partitions(df, k, seed):
    """Random near-equal parts 0..k-1; the first N mod k parts are one row larger.

    Parts end at positions of the random order.  A bucket that no end falls into belongs to one part;
    the others are ranked, keys only, to find the keys at which parts end.  Features are not moved.
    """
    keys = _keyed(df.select("row_id"), seed)
    if k > CUT_PARTS:
        n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        ranked = random_rank(df.select("row_id"), seed)
        numbered = ranked.select("row_id", _part_of(F.col("rn") - 1, n, k).alias("part"))
        return df.join(numbered, "row_id")
    starts = _bucket_starts(keys).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    part_of = lambda at: _part_of(at, F.col("_total"), k)
    starts = starts.withColumns({"_first": part_of(F.col("_start")), "_last": part_of(F.col("_start") + F.col("_n") - 1)})
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    cut = starts.where(F.col("_first") < F.col("_last"))
    cuts = (
        keys.join(F.broadcast(cut), "_bucket")
        .withColumn("rn", F.col("_start") + inside)
        .where(part_of(F.col("rn") - 1) < part_of(F.col("rn")))
        .groupBy("_bucket")
        .agg(F.collect_list("_key").alias("_cuts"))
    )
    table = starts.select("_bucket", "_first").join(cuts, "_bucket", "left")  # 65,536 rows at most
    passed = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_key"))), F.lit(0))
    return (
        _keyed(df, seed)
        .join(F.broadcast(table), "_bucket")
        .withColumn("part", (F.col("_first") + F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).cast("int"))
        .drop("_key", "_bucket", "_first", "_cuts")
    )


def _part_of(at, n, k):
    """Part of the row at a place (from 0) of the random order of n rows."""
    small, large = F.floor(n / F.lit(k)), n % F.lit(k)
    in_large = large * (small + 1)
    return F.when(at < in_large, F.floor(at / (small + 1))).otherwise(
        large + F.floor((at - in_large) / F.greatest(small, F.lit(1)))
    ).cast("int")
