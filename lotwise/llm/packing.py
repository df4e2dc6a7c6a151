"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the largest length is cut; its whole pieces fill bins of their own and only
the rest is packed.  Rests are dealt into shards of about SHARD items.  In a shard the longest go
first: an item takes the open bin with the least room that fits; where none does, a bin is opened.
Which size is opened for items of which lengths is chosen for all permitted lengths together: from
the sizes of least cost per token on, one choice after the other is changed as long as the cost of
the shard's bins, packed and shrunk, falls.  At the end each bin shrinks to the cheapest permitted
length that holds its content.

Only keys and lengths are moved, equal ones as one row and their number.  Shards lose at most their
last bins' room, under one part in thousands, and each needs memory for its own items only.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm.words import Words, pieces

SIZES = (512, 1024, 2048, 4096)
SHARD = 20_000

_LENGTHS = "doc_id bigint, n_tokens bigint"
_PACKED = "doc_id bigint, chunk bigint, n_tokens bigint, bin string, bin_size int, start int"


def default_cost(size, largest):
    """Work of a sequence: linear and, through attention, quadratic in its length, plus a fixed part."""
    return 32.0 + size + size * size / (8.0 * largest)


def word_lengths(docs, key="doc_id", text="text"):
    """(key, n_tokens): words of the whole text and one end mark; 1 for null and empty texts."""

    def count(batches):
        for batch in batches:
            for piece in pieces(batch):
                n = Words.of(piece.column(1)).counts() + 1
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, _LENGTHS).withColumnRenamed("doc_id", key)


def pack(lengths, sizes=SIZES, cost=default_cost, key="doc_id", length="n_tokens"):
    """One row per piece of a document: ``key``, ``chunk``, ``n_tokens``, ``bin``, ``bin_size``, ``start``.

    ``bin`` names the sequence, ``start`` is the piece's place in it, ``chunk`` counts the pieces
    of a document.  Null lengths and those below one have nothing to pack and give no row.
    Repeated rows are packed each.  Ties go to the longer item, then the smaller key, the earlier
    chunk and the smaller bin size; a null key comes first.  Other columns are ignored.
    """
    sizes = sorted(set(sizes))
    largest = sizes[-1]
    prices = {s: float(cost(s, largest)) for s in sizes}
    items = lengths.select(F.col(key).cast("bigint").alias("doc_id"), F.col(length).cast("bigint").alias("n"))
    alike = items.filter("n > 0").groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))
    rest = F.col("n") % largest
    shards = max(1, -(-(alike.filter(rest > 0).agg(F.sum("copies")).first()[0] or 0) // SHARD))
    copies = alike.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    whole = F.floor(F.col("n") / largest).cast("bigint")
    full = copies.filter(whole > 0).select(
        "doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("chunk")
    )
    named = F.concat_ws("-", F.lit("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n", "copy", "chunk")
    full = full.select(
        "doc_id", "chunk", F.lit(largest).cast("bigint").alias("n_tokens"), named.alias("bin"),
        F.lit(largest).cast("int").alias("bin_size"), F.lit(0).alias("start"),
    )
    rests = copies.filter(rest > 0).select(
        "doc_id", whole.alias("chunk"), rest.alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(shards)).alias("shard"),
    )
    packed = rests.groupBy("shard").applyInArrow(lambda t: _pack_table(t, sizes, prices), _PACKED)
    return packed.unionByName(full).withColumnRenamed("doc_id", key)


def _pack_table(table, sizes, prices):
    keys = table.column("doc_id").to_pylist()
    chunks = table.column("chunk").to_numpy()
    lengths = table.column("n_tokens").to_numpy()
    order_key = np.array([np.iinfo(np.int64).min if k is None else k for k in keys], dtype=np.int64)
    order = np.lexsort((chunks, order_key, -lengths))
    longest_first = lengths[order].tolist()
    bins, starts, final = best_fit(longest_first, sizes, prices, opened_sizes(longest_first, sizes, prices))
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "doc_id": pa.array([keys[i] for i in order], pa.int64()),
        "chunk": pa.array(chunks[order], pa.int64()),
        "n_tokens": pa.array(lengths[order], pa.int64()),
        "bin": pa.array([f"{shard}-{b}" for b in bins], pa.string()),
        "bin_size": pa.array([final[b] for b in bins], pa.int32()),
        "start": pa.array(starts, pa.int32()),
    })


def opened_sizes(lengths, sizes, prices):
    """The size to open for items of each class: those that need at least ``sizes[i]``.

    The choices depend on each other through the room that bins leave to shorter items, so each
    change is judged by the cost of the whole packing.
    """
    chosen = [min(sizes[i:], key=lambda s: (prices[s] / s, s)) for i in range(len(sizes))]
    least = total_price(lengths, sizes, prices, chosen)
    changed = True
    while changed:
        changed = False
        for i in range(len(sizes)):
            for size in sizes[i:]:
                trial = [*chosen[:i], size, *chosen[i + 1 :]]
                price = least if trial == chosen else total_price(lengths, sizes, prices, trial)
                if price < least:
                    chosen, least, changed = trial, price, True
    return chosen


def total_price(lengths, sizes, prices, chosen):
    return sum(prices[s] for s in best_fit(lengths, sizes, prices, chosen)[2])


def best_fit(lengths, sizes, prices, chosen):
    """Bin and start of every length (longest first), and the final size of every bin.

    ``chosen`` has the size to open for items that need at least ``sizes[i]``.  Open bins are listed
    by their room; a bit mask of rooms in use finds the least that fits.
    """
    rooms = {}
    mask = 0
    filled, bins, starts = [], [], []
    for n in lengths:
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room = chosen[bisect.bisect_left(sizes, n)]
            b = len(filled)
            filled.append(0)
        bins.append(b)
        starts.append(filled[b])
        filled[b] += n
        room -= n
        if room:
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room
    final = [min((s for s in sizes if s >= f), key=lambda s: (prices[s], s)) for f in filled]
    return bins, starts, final
