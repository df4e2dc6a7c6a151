"""Resampling towards a target distribution by the importance of hashed features.

Features are the words of a text and runs of them, hashed into buckets.  How often each bucket occurs
in all documents and in the target gives its gain, an array of fixed size; a document's weight is the
sum over its features.  A keyed Gumbel draw is added, so that the highest scores are a sample without
replacement in proportion to the exponentials of the weights.

Exact ranks come from parallel sorting by regular sampling.  The scored rows, a few numbers each, are
written as locally sorted runs.  Every so many rows of a run, one is a sample; the samples' own
regular places are the splitters.  Rows go to the segment between two splitters and are merged there;
the counts of the segments before give the ranks.  Equal rows are told apart by their place in the
runs, so no key can fill a segment of its own.  Segments beyond the draw are not moved.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.tables import commit

BUCKETS = 10_000
#: the gains travel with every task: 8 bytes a bucket
MOST_BUCKETS = 1 << 20
#: rows of a segment, where the session's shuffle partitions are fewer
SEGMENT_ROWS = 1 << 20
#: samples for each segment
SAMPLES = 32
#: bytes of text whose words are listed at a time, and words whose buckets a task remembers
PIECE_BYTES = 1 << 20
REMEMBERED = 1 << 18

_KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
#: lower-cases A-Z; bytes outside words become spaces
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))

_COUNTS = "bucket int, n bigint"
_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
_AT_BITS = 33  # places of monotonically_increasing_id: rows within a partition


def resample(
    docs, target, percent=10, least_words=20, longest=1, buckets=BUCKETS, seed=2024,
    key="doc_id", text="text", target_text="text",
):
    """Every document's ``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the N documents with at least ``least_words`` words, the floor(percent * N / 100) highest scores
    are drawn; ``rank`` is their place (1, 2, ...), null for all others.  Ties go to the smaller key, a
    null key last; equal rows get ranks of their own, in any order.  Features are all runs of 1 to
    ``longest`` words of the whole text; null and empty texts have none and weigh 0.  The key is cast
    to a long; a null one draws like an empty one.  Other columns are ignored.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    table = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, target_text), buckets)
    rows = scored(docs, table, longest, seed, key, text).withColumn("fit", F.col("n_words") >= least_words)
    ranked = ranks(rows, lambda n: int(n * percent // 100))
    return ranked.select(F.col("doc_id").alias(key), "n_words", "n_features", "weight", "score", "rank")


def bucket_counts(docs, longest=1, buckets=BUCKETS, text="text"):
    """Frame ``(bucket, n)`` over all features of all texts; tasks add up their own rows first."""

    def count(batches):
        bucket_of, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, hashed in bucket_of.pieces(value.as_py(), longest):
                    bucket_of.add(hashed, total)
        bucket_of.flush(total)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, _COUNTS)
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus, target, buckets=BUCKETS):
    """Thousandths of the log of the target's share of a bucket over the corpus's, both smoothed by one."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets are supported")
    of = []
    for counts in (corpus, target):
        got, full = counts.toArrow(), [0] * buckets
        for bucket, n in zip(got["bucket"].to_pylist(), got["n"].to_pylist()):
            full[bucket] = n
        of.append(full)
    there, here = (float(sum(full) + buckets) for full in of)
    ratio = [(t + 1.0) * there / ((s + 1.0) * here) for s, t in zip(*of)]
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], dtype=np.int64)


def scored(docs, table, longest=1, seed=2024, key="doc_id", text="text"):
    """``(doc_id, n_words, n_features, weight, score)`` of every document, by one array of gains."""

    def run(batches):
        bucket_of = Buckets(len(table))
        for batch in batches:
            keys, rows = batch.column(0), []
            for k, value in zip(keys.to_pylist(), batch.column(1)):
                words = features = weight = 0
                for n, hashed in bucket_of.pieces(value.as_py(), longest):
                    words += n
                    features += len(hashed)
                    weight += int(table[hashed].sum())
                rows.append((words, features, weight, weight + noise(seed, k)))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight", "score"]
            )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCORED)


def noise(seed, key):
    """A keyed Gumbel draw in thousandths."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8]
    return math.floor(-1000.0 * math.log(-math.log((int(digits, 16) + 0.5) / 4294967296.0)))


class Buckets(dict):
    """Bucket of each feature, remembered for words that come again."""

    def __init__(self, buckets):
        super().__init__()
        self.buckets, self.waiting, self.size = buckets, [], 0

    def __missing__(self, feature):
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def pieces(self, text, longest):
        """(number of words, buckets of the features that end in them) for pieces of a text in order."""
        before = []
        for words in word_lists(text):
            features, count = list(words), len(words)
            joined, start = before + words, len(before)
            for width in range(2, longest + 1):
                first = max(width - 1, start)
                features += [b" ".join(joined[i - width + 1 : i + 1]) for i in range(first, len(joined))]
            yield count, np.fromiter(map(self.__getitem__, features), dtype=np.int32, count=len(features))
            before = joined[len(joined) - min(len(joined), longest - 1) :]
            if len(self) > REMEMBERED:
                self.clear()

    def add(self, hashed, total):
        self.waiting.append(hashed)
        self.size += len(hashed)
        if self.size > REMEMBERED:
            self.flush(total)

    def flush(self, total):
        if self.waiting:
            total += np.bincount(np.concatenate(self.waiting), minlength=self.buckets)
        self.waiting, self.size = [], 0


def word_lists(text):
    """Lower-cased words of a text (letters and digits of ASCII, all other characters), piece by piece."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + PIECE_BYTES) if len(data) > low + PIECE_BYTES else -1
        high = len(data) if high < 0 else high
        words = data[low:high].split()
        if words:
            yield words
        low = high


def ranks(rows, most=lambda n: n):
    """``rows`` with ``rank``: exact places of those with ``fit`` by falling score, then rising ``doc_id``.

    Needs the columns ``doc_id``, ``score`` and ``fit``.  Places beyond ``most(number of fit rows)``
    are null, as are those of rows that are not fit.
    """
    spark = rows.sparkSession
    names = list(rows.columns)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = rows.sortWithinPartitions(F.desc("fit"), *order).withColumn("at", F.monotonically_increasing_id())
    runs = commit(runs, "runs")
    n = runs.filter("fit").count()
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    last = most(n)
    splitters = _splitters(runs, n, segments)
    dealt_schema = T.StructType([*runs.schema.fields, T.StructField("segment", T.IntegerType())])
    dealt = runs.mapInArrow(_dealer(splitters, segments, runs.columns), dealt_schema)
    sizes = dealt.filter("fit").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(segments + 1, dtype=np.int64)
    counts[sizes["segment"].to_numpy() + 1] = sizes["n"].to_numpy()
    starts = np.cumsum(counts)[:-1]
    used = int(np.searchsorted(starts, last))
    moved = dealt.filter(F.col("fit") & (F.col("segment") < used)).repartitionById(max(1, used), F.col("segment"))
    moved = moved.sortWithinPartitions("segment", *order, "at")
    schema = T.StructType([*dealt_schema.fields, T.StructField("rank", T.LongType())])
    placed = moved.mapInArrow(_counter(starts, last, schema.names), schema).select(*names, "rank")
    rest = dealt.filter(~F.col("fit") | (F.col("segment") >= used))
    return placed.unionByName(rest.select(*names, F.lit(None).cast("bigint").alias("rank")))


def _splitters(runs, n, segments):
    """The keys that part the segments, in order: regular places of the runs' regular samples."""
    step = max(1, n // (SAMPLES * segments))
    run, place = F.shiftright("at", _AT_BITS), F.col("at").bitwiseAND(F.lit((1 << _AT_BITS) - 1))
    # Runs begin at places of their own, so that short ones are sampled in proportion too.
    chosen = runs.filter(F.col("fit") & (place % step == F.pmod(F.xxhash64(run), F.lit(step))))
    keys = np.sort(_keys(chosen.select("score", "doc_id", "at").toArrow()))
    return keys[len(keys) * np.arange(1, segments) // segments] if len(keys) else keys


def _keys(table):
    """Sort keys as one structured array: falling score, null ids last, rising id, place."""
    ids = table["doc_id"]
    keys = np.zeros(len(ids), dtype=[("score", "<i8"), ("null", "<i8"), ("doc_id", "<i8"), ("at", "<i8")])
    keys["score"] = -np.asarray(table["score"])
    keys["null"] = np.asarray(ids.is_null())
    keys["doc_id"] = np.asarray(ids.fill_null(0))
    keys["at"] = np.asarray(table["at"])
    return keys


def _dealer(splitters, segments, names):
    """A map that adds each row's segment; rows that are not fit get the last one."""

    def run(batches):
        for batch in batches:
            named = {c: batch.column(i) for i, c in enumerate(names)}
            segment = np.searchsorted(splitters, _keys(named), side="right") if len(splitters) else np.zeros(batch.num_rows)
            segment = np.where(np.asarray(named["fit"].fill_null(False)), segment, segments - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment.astype(np.int32))], [*names, "segment"])

    return run


def _counter(starts, last, names):
    """A map over rows sorted by segment and key: ranks by counting on from the segment's start."""

    def run(batches):
        now, seen = None, 0
        for batch in batches:
            segment = np.asarray(batch.column(batch.num_columns - 1))
            if not len(segment):
                continue
            first = np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1))
            inside = np.arange(len(segment)) - np.repeat(first, np.diff(np.append(first, len(segment))))
            if segment[0] == now:
                inside[segment == now] += seen
            now, seen = segment[-1], int(inside[-1]) + 1
            rank = starts[segment] + inside + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, mask=rank > last)], names)

    return run
