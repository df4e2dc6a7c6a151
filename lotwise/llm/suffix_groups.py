"""Removal of repeated word passages by prefix-partitioned, truncated suffix trees.

Every word that starts ``window`` words of its document is a suffix, cut to ``window`` words.
Suffixes are split into groups by variable-length prefixes: a first word whose suffixes fit a
group's share of memory is a group, a more frequent one is split by its first two words, then
four, and at last by all words of the suffix.  In a group the subtree is made by sorting: the
suffixes below one node at depth ``window`` are neighbours, and a node with two or more is an
internal node, that is a maximal repeat's left part.  The words below such nodes are removed.

What is moved: documents go once into blocks of bounded size by their id; each block sends every
distinct suffix once per group, as 64-bit names (sorted, as differences); a group answers each
block with one bit per suffix.  A hot passage therefore counts once per block, and no group holds
more than its share, whatever the number of copies.  Within a group of g suffixes two different
ones share a name with a chance of g**2 / 2**65; the number of groups follows the corpus, so g
does not.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm.words import WORD_BASE, Words, mix, pieces

WINDOW = 35
BLOCK_BYTES = 12 << 20
GROUP_SUFFIXES = 2 << 20
LENGTHS = (1, 2, 4)
BUCKETS = 1024

_CENSUS = "length int, bucket int, n bigint"
_NAMES = "part bigint, block bigint, names binary"
_REPLY = "block bigint, part bigint, shared binary"
_RESULT = "row_no bigint, kept_text string, n_words bigint, removed array<struct<start:int,end:int>>"


def remove_repeats(docs, window=WINDOW, key="doc_id", text="text"):
    """Documents without the words of passages that also start anywhere else.

    A window is ``window`` consecutive words (runs of bytes other than space and 0x09-0x0D) of one
    document.  Returns one row per row of ``docs``: ``key``, ``n_words``, ``removed`` (ranges of
    word positions, end exclusive) and ``kept_text`` (other words joined by one space).  Null and
    empty texts have no words and an empty ``kept_text``; texts shorter than a window keep all.
    Repeated rows are repeats of each other, also under one ``key`` or a null one.  Other columns
    are ignored.  Windows are judged on the input, not on what is left.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("row_no"), F.col(text).alias("text"))
    total, bytes_, counts = _census(rows, window)
    blocks = max(1, -(-bytes_ // BLOCK_BYTES))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, -(-total // GROUP_SUFFIXES))
    grouping = _Grouping(counts, parts, max(1, total // (4 * parts)), window)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row_no", "text"), F.lit(blocks)))
    names = dealt.groupBy("block").applyInArrow(lambda t: _send(t, grouping, window), _NAMES)
    replies = names.groupBy("part").applyInArrow(_answer, _REPLY)
    resolved = (
        dealt.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(lambda t, r: _resolve(t, r, grouping, window), _RESULT)
    )
    return resolved.withColumnRenamed("row_no", key)


class _Grouping:
    """The group of every suffix: shortest prefix whose bucket fits, all words otherwise."""

    def __init__(self, counts, parts, limit, window):
        self.small = {length: counts[length] <= limit for length in LENGTHS}
        self.parts, self.window = parts, window

    def split(self, words):
        """(first word index, name, part) of every suffix of these documents."""
        at, names = words.runs(self.window)
        chosen = mix(names * np.uint64(WORD_BASE) + np.uint64(self.window))
        open_ = np.ones(len(at), dtype=bool)
        for length in LENGTHS:
            if length > self.window or not open_.any():
                break
            prefix = words.run_names(length)[at]
            take = open_ & self.small[length][prefix % np.uint64(BUCKETS)]
            chosen[take] = mix((prefix[take] % np.uint64(BUCKETS)) * np.uint64(8) + np.uint64(length))
            open_ &= ~take
        return at, names, (chosen % np.uint64(self.parts)).astype(np.int64)


def _census(rows, window):
    """Suffixes per prefix bucket, over all documents; the numbers that come back are fixed in count."""

    def count(batches):
        seen = {length: np.zeros(BUCKETS, dtype=np.int64) for length in LENGTHS}
        bytes_ = total = 0
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column(0))
                bytes_ += len(words.data)
                at = words.run_starts(window)
                total += len(at)
                for length in LENGTHS:
                    if length <= window and len(at):
                        prefix = words.run_names(length)[at] % np.uint64(BUCKETS)
                        seen[length] += np.bincount(prefix.astype(np.int64), minlength=BUCKETS)
        out = [(0, 0, bytes_), (0, 1, total)]
        out += [(length, b, int(n)) for length in LENGTHS for b, n in enumerate(seen[length]) if n]
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame(out, columns=["length", "bucket", "n"]).astype({"length": "int32", "bucket": "int32"}),
            preserve_index=False,
        )

    found = rows.select("text").mapInArrow(count, _CENSUS).groupBy("length", "bucket").agg(F.sum("n").alias("n"))
    counts = {length: np.zeros(BUCKETS, dtype=np.int64) for length in (0, *LENGTHS)}
    for length, bucket, n in found.collect():
        counts[length][bucket] = n
    return int(counts[0][1]), int(counts[0][0]), counts


def _block_suffixes(words, grouping):
    """Suffixes of a block in the order of (part, name), the same whenever it is computed."""
    at, names, part = grouping.split(words)
    order = np.lexsort((names, part))
    at, names, part = at[order], names[order], part[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (part[1:] != part[:-1])
    return at, names, part, new


def _send(table, grouping, window):
    block = table.column("block")[0].as_py()
    words = Words.of(table.column("text"))
    _, names, part, new = _block_suffixes(words, grouping)
    names, part = names[new], part[new]
    ids, low = np.unique(part, return_index=True)
    packed = [_pack(names[a:b]) for a, b in zip(low, [*low[1:], len(part)])]
    return pa.table({
        "part": pa.array(ids, pa.int64()),
        "block": pa.array(np.full(len(ids), block), pa.int64()),
        "names": pa.array(packed, pa.binary()),
    })


def _pack(names):
    """Sorted names as differences, bytes of equal weight together, so that compression bites."""
    gaps = np.diff(names, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data):
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _answer(table):
    """One subtree group: flags the names that more than one block sent."""
    lists = [_unpack(x) for x in table.column("names").to_pylist()]
    names = np.concatenate(lists)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    twin = np.zeros(len(names), dtype=bool)
    same = ranked[1:] == ranked[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    shared = np.empty(len(names), dtype=bool)
    shared[order] = twin
    cuts = np.cumsum([0, *map(len, lists)])
    flags = [shared[a:b] for a, b in zip(cuts, cuts[1:])]
    kept = [i for i, f in enumerate(flags) if f.any()]
    blocks, parts = table.column("block").to_pylist(), table.column("part").to_pylist()
    return pa.table({
        "block": pa.array([blocks[i] for i in kept], pa.int64()),
        "part": pa.array([parts[i] for i in kept], pa.int64()),
        "shared": pa.array([np.packbits(flags[i]).tobytes() for i in kept], pa.binary()),
    })


def _resolve(table, replies, grouping, window):
    words = Words.of(table.column("text"))
    at, names, part, new = _block_suffixes(words, grouping)
    node = np.cumsum(new) - 1
    n_nodes = int(node[-1]) + 1 if len(node) else 0
    repeated = np.bincount(node, minlength=n_nodes) > 1
    first_of_part = part[new]
    for p, bits in zip(replies.column("part").to_pylist(), replies.column("shared").to_pylist()):
        low, high = np.searchsorted(first_of_part, [p, p + 1])
        repeated[low:high] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low).astype(bool)
    starts = at[repeated[node]] if n_nodes else at
    cover = np.zeros(len(words.name) + 1, dtype=np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    texts, removed = [], []
    for i, (a, b) in enumerate(zip(words.first, words.first[1:])):
        texts.append(words.text(keep, i).decode())
        gone = np.diff(np.concatenate(([0], (~keep[a:b]).view(np.int8), [0])))
        removed.append([
            {"start": s, "end": e} for s, e in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist())
        ])
    return pa.table({
        "row_no": table.column("row_no"),
        "kept_text": pa.array(texts, pa.string()),
        "n_words": pa.array(words.counts(), pa.int64()),
        "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    })
