"""Repeated passages by a sparse suffix array over minimiser positions.

Suffixes are kept where one of ``passage - GRAM + 1`` consecutive runs of GRAM words is the
smallest by name: two copies of a passage keep the same positions, about one word in eighteen.
Only suffixes whose first GRAM words start another kept suffix can have a neighbour, so only these
get their context: ``passage`` words to the right and to the left, as 32-bit names.  They are
sorted by the words to the right (then left); a suffix is compared with the NEAR before it and
every match is extended both ways.  A match of ``passage`` words or more is reported with both its
places; longer passages are the union of the matches along them.  The nearest suffix has the
longest match to the right, but not always to the left, so this is whole only where at most
NEAR + 1 suffixes begin with the same GRAM words: these are all compared with each other.

Where more do (a line that many documents share), the passages themselves are grouped: each passage
whose smallest run is such a frequent one is named by its words, and equal names are repeats.
Equal passages have the same smallest run, so every passage is found in one of the two ways.

The order is range-partitioned with document and position as last keys; suffixes on both sides of a
partition's edge are compared in a second step.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm.tables import commit
from lotwise.llm.words import Words, pieces, sliding

PASSAGE = 50
GRAM = 16
NEAR = 8
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

_SAMPLES = "uid bigint, gram bigint, pos int"
_SUFFIX = "right binary, left binary, uid bigint, pos int"
_MATCH = "uid bigint, start int, end int, right binary, left binary, pos int"
_WINDOW = "window bigint, uid bigint, start int"
_ORDER = ("right", "left", "uid", "pos")


def repeated_passages(docs, passage=PASSAGE, key="doc_id", text="text"):
    """One row per repeated stretch: ``key``, ``start``, ``end`` (word positions, end exclusive), ``words``.

    A stretch is a union of passages of ``passage`` or more words (runs of bytes other than space
    and 0x09-0x0D) that also start elsewhere, in another document or the same one.  Null, empty
    and shorter texts have none.  Repeated rows are repeats of each other, each with its own rows
    in the result.  Other columns are ignored.
    """
    if passage < GRAM:
        raise ValueError(f"a passage has {GRAM} words at least")
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("uid")
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples = rows.select("uid", "text").mapInArrow(lambda b: _sample(b, passage), _SAMPLES)
    grams = samples.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    shared = samples.join(grams, "gram").groupBy("uid").agg(
        F.collect_set(F.when(F.col("n") <= NEAR + 1, F.col("pos"))).alias("at"),
        F.collect_set(F.when(F.col("n") > NEAR + 1, F.col("pos"))).alias("often"),
    )
    sampled = rows.select("uid", "text").join(shared, "uid")
    suffixes = sampled.mapInArrow(lambda b: _suffixes(b, passage), _SUFFIX)
    ranked = suffixes.repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
    windows = sampled.mapInArrow(lambda b: _windows(b, passage), _WINDOW)
    windows = windows.repartition(partitions, "window").sortWithinPartitions("window")
    matches = ranked.mapInArrow(lambda b: _neighbours(b, passage), _MATCH)
    matches = commit(matches.unionByName(windows.mapInArrow(lambda b: _equal(b, passage), _MATCH)), "matches")

    # rows of a small partition are at both its edges; equal rows are never in two partitions
    edges = matches.filter("right is not null").select(*_ORDER).distinct()
    edges = edges.repartition(1).sortWithinPartitions(*_ORDER)
    crossing = edges.mapInArrow(lambda b: _neighbours(b, passage, edges=True), _MATCH)
    found = matches.unionByName(crossing).filter("right is null")
    span = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")
    stretches = found.groupBy("uid").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    stretches = stretches.select("uid", F.explode(_union("spans")).alias("s"))
    return rows.select("doc_id", "uid").join(stretches, "uid").select(
        F.col("doc_id").alias(key), "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("words")
    )


def _sample(batches, passage):
    width = passage - GRAM + 1
    for batch in batches:
        for piece in pieces(batch):
            words = Words.of(piece.column(piece.schema.get_field_index("text")))
            at, grams = _grams(words)
            chosen = at[_smallest_of_some_window(grams, width)[at]]
            document = words.document()[chosen]
            uid = piece.column(piece.schema.get_field_index("uid")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid[document]),
                    pa.array(grams[chosen].view(np.int64)),
                    pa.array((chosen - words.first[document]).astype(np.int32)),
                ],
                ["uid", "gram", "pos"],
            )


def _grams(words):
    """Words at which GRAM words of a document begin, and the name of these for each word (_LAST: none)."""
    at = words.run_starts(GRAM)
    grams = np.full(len(words.name), _LAST)
    grams[at] = words.run_names(GRAM)[at] if len(at) else grams[at]
    return at, grams


def _smallest_of_some_window(values, width):
    """Flags values that are the minimum of a window of ``width`` that holds them."""
    if len(values) < width:
        return np.zeros(len(values), dtype=bool)
    low = sliding(values, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)))
    return sliding(padded, width, np.maximum) == values


def _suffixes(batches, passage):
    for batch in batches:
        for piece in pieces(batch):
            column = {name: piece.column(i) for i, name in enumerate(piece.schema.names)}
            words = Words.of(column["text"])
            ahead = (words.name >> np.uint64(32)).astype(">u4")
            right_of, left_of = ahead.tobytes(), ahead[::-1].tobytes()
            n = len(ahead)
            right, left, uids, positions = [], [], [], []
            for uid, low, high, at in zip(column["uid"].to_pylist(), words.first, words.first[1:], column["at"].to_pylist()):
                low, high = int(low), int(high)
                for pos in at:
                    p = low + pos
                    if p >= high:
                        continue
                    right.append(right_of[4 * p : 4 * min(p + passage, high)])
                    left.append(left_of[4 * (n - p) : 4 * (n - max(p - passage, low))])
                    uids.append(uid)
                    positions.append(pos)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(right, pa.binary()), pa.array(left, pa.binary()),
                    pa.array(uids, pa.int64()), pa.array(positions, pa.int32()),
                ],
                ["right", "left", "uid", "pos"],
            )


def _windows(batches, passage):
    """Passages whose smallest run of GRAM words is a frequent one, by name."""
    width = passage - GRAM + 1
    for batch in batches:
        for piece in pieces(batch.filter(pa.compute.greater(pa.compute.list_value_length(batch["often"]), 0))):
            column = {name: piece.column(i) for i, name in enumerate(piece.schema.names)}
            words = Words.of(column["text"])
            _, grams = _grams(words)
            often = column["often"].flatten().to_numpy()
            often = often + np.repeat(words.first[:-1], pa.compute.list_value_length(column["often"]).to_numpy())
            often = often[often < len(grams)]
            frequent = np.full(len(grams), _LAST)
            frequent[often] = grams[often]
            at, names = words.runs(passage)
            hit = sliding(frequent, width, np.minimum)[at] == sliding(grams, width, np.minimum)[at]
            document = words.document()[at[hit]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[hit].view(np.int64)),
                    pa.array(column["uid"].to_numpy()[document]),
                    pa.array((at[hit] - words.first[document]).astype(np.int32)),
                ],
                ["window", "uid", "start"],
            )


def _equal(batches, passage):
    """Passages of a sorted partition that have an equal one; a batch's last row waits for the next."""
    held, before = None, None
    for batch in batches:
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("window", "uid", "start")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        same = np.concatenate(([before is not None and before == rows[0][0]], rows[0][1:] == rows[0][:-1]))
        yield _spans(*(x[:-1][same[:-1] | same[1:]] for x in rows[1:]), passage)
        held, before = [x[-1:] for x in rows], rows[0][-2] if len(rows[0]) > 1 else before
    if held is not None and before is not None and before == held[0][0]:
        yield _spans(*held[1:], passage)


def _spans(uid, start, passage):
    none = pa.nulls(len(uid), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uid), pa.array(start), pa.array(start + np.int32(passage)), none, none, pa.nulls(len(uid), pa.int32()),
        ],
        ["uid", "start", "end", "right", "left", "pos"],
    )


def _matrix(contexts, passage):
    """Contexts as rows of ``passage`` words, and how many of these are theirs."""
    data = b"".join(x.ljust(4 * passage, b"\0") for x in contexts)
    return np.frombuffer(data, dtype=np.uint32).reshape(-1, passage), np.array([len(x) // 4 for x in contexts])


def _common(words, sizes, back):
    """Words that each row shares with the one ``back`` rows before, from the beginning on."""
    differs = np.ones((len(words) - back, words.shape[1] + 1), dtype=bool)
    differs[:, :-1] = words[back:] != words[:-back]
    return np.minimum(differs.argmax(axis=1), np.minimum(sizes[back:], sizes[:-back]))


def _neighbours(batches, passage, edges=False):
    """Matches inside a sorted partition, and its first and last suffixes for the step across edges.

    Equal rows are repeated rows of the input, but among ``edges`` they may be one row twice.
    """
    held, seen = None, 0
    for batch in batches:
        batch = batch.select(list(_ORDER))
        if not len(batch):
            continue
        if seen < NEAR:
            yield _edges(batch.slice(0, NEAR - seen))
            seen += len(batch)
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        yield _matches(rows, 0 if held is None else len(held), passage, edges)
        held = rows.slice(max(0, len(rows) - NEAR)).combine_chunks().to_batches()[0]
    if held is not None:
        yield _edges(held)


def _matches(rows, old, passage, edges):
    """Matches of every row from ``old`` on with the NEAR rows before it."""
    column = {c: rows.column(c) for c in _ORDER}
    ahead, behind = (_matrix(column[c].to_pylist(), passage) for c in ("right", "left"))
    uid, pos = column["uid"].to_numpy(), column["pos"].to_numpy()
    found = []
    for back in range(1, min(NEAR, len(rows) - 1) + 1):
        right, left = _common(*ahead, back), _common(*behind, back)
        long = (right + left >= passage) & (np.arange(back, len(rows)) >= old)
        if edges:
            long &= (uid[back:] != uid[:-back]) | (pos[back:] != pos[:-back])
        at = np.flatnonzero(long)
        for place in (at, at + back):
            found.append((uid[place], pos[place] - left[at], pos[place] + right[at]))
    uid, start, end = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
    spans = np.unique(np.stack((uid, start.astype(np.int64), end.astype(np.int64)), axis=1), axis=0)
    none = pa.nulls(len(spans), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(spans[:, 0]), pa.array(spans[:, 1].astype(np.int32)), pa.array(spans[:, 2].astype(np.int32)),
            none, none, pa.nulls(len(spans), pa.int32()),
        ],
        ["uid", "start", "end", "right", "left", "pos"],
    )


def _edges(batch):
    none = pa.nulls(len(batch), pa.int32())
    column = {c: batch.column(batch.schema.get_field_index(c)) for c in _ORDER}
    return pa.RecordBatch.from_arrays(
        [column["uid"], none, none, column["right"], column["left"], column["pos"]],
        ["uid", "start", "end", "right", "left", "pos"],
    )


def _union(spans):
    """Sorted spans (start * 2**32 + end) as their union in order; the last span grows or a new one begins."""
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    merged = F.aggregate(
        F.transform(spans, lambda s: F.struct(
            F.shiftright(s, 32).cast("int").alias("start"), s.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("end")
        )),
        F.array(start),
        lambda done, s: F.when(
            s["start"] <= F.element_at(done, -1)["end"],
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    return F.slice(merged, 2, F.greatest(F.size(merged) - 1, F.lit(0)))
