"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ranged by length; a task holds a stretch of lengths and cuts it into buckets.  The
largest vectors give every query a first k-th score.  A bucket can hold a better score for a query
only if the cosine reaches ``score / (length of query * longest of bucket)``, its local threshold:
above one the whole bucket is passed over; a high threshold bounds single coordinates, so vectors
outside the range of the query's largest coordinates are passed over; a low one only bounds the
length.  Products of the rest are computed in full, so the result is exact.

Queries are a stated set and go to the tasks in blocks of bounded size; every block is one more
pass over the vectors.  A task returns k rows a query at most, and the k best of these remain.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

SCALE = 256
QUERY_BYTES = 16 << 20
SEEDS = 2_048
BUCKET = 1_024
FOCUS = 3
COORDINATE_FROM = 0.4
EXACT = float(1 << 53)

_HIT = "query_no bigint, query_id bigint, vec_id bigint, score bigint"


def whole_components(vectors, vec="embedding", key="vec_id"):
    """(key, v): floor(SCALE * x) of every component, without vectors that are null or hold a null
    or non-finite component."""
    double = F.transform(F.col(vec), lambda x: x.cast("double"))
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(double, lambda x: (F.lit(float(SCALE)) * x).cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), whole.alias("v"), finite.alias("finite"))
    return rows.filter("finite").select("vec_id", F.transform("v", lambda x: _floor(x)).alias("v"))


def _floor(x):
    """Floor as a double, also beyond the range of a long."""
    return F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)


def top_k(vectors, queries, k=5):
    """(query_id, rank, vec_id, score) of the k best inner products of every query.

    Both tables have ``vec_id`` and ``v`` (whole numbers as doubles).  Vectors under the query's
    own id are no candidates.  Shorter vectors are continued by zeros.  Ties go to the smaller
    ``vec_id``, null ids first; repeated rows count each, as candidates and as queries.  Sums
    beyond 2**53 are added exactly and cut to the range of a long.
    """
    spark = vectors.sparkSession
    sized = vectors.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    seeds = [(r.vec_id, r.v) for r in sized.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(partitions, F.desc("norm"), "vec_id")
    hits = None
    for block in _blocks(queries):
        part = ranged.mapInArrow(_searcher(block, seeds, k), _HIT)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], _HIT)
    best = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _blocks(queries):
    """Lists of (number, id, vector), about QUERY_BYTES each."""
    size = queries.agg(F.sum(8 + 8 * F.size("v"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    for number in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == number).select("vec_id", "v")
        rows = sorted(part.collect(), key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.v))
        yield [(number << 32 | i, r.vec_id, r.v) for i, r in enumerate(rows)]


_NULL = np.iinfo(np.int64).min


def _ids(ids):
    return np.array([_NULL if i is None else i for i in ids], dtype=np.int64)


def _padded(vectors, width):
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class _Queries:
    """A block of queries in one task: their best k so far and the score a candidate must reach."""

    def __init__(self, block, seeds, k):
        self.no = [q[0] for q in block]
        self.id = _ids(q[1] for q in block)
        self.k, self.raw = k, [q[2] for q in block]
        self.width = max((len(v) for v in self.raw), default=0)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((_padded(self.raw, self.width) ** 2).sum(axis=1))
        self.longest = float(self.norm.max(initial=0.0))
        self.least = np.full(len(block), -np.inf)
        self.best = [[] for _ in block]
        self._seed(seeds)

    def _seed(self, seeds):
        ids, vectors = _ids(i for i, _ in seeds), [v for _, v in seeds]
        width = max([self.width, *map(len, vectors)])
        v = _padded(vectors, width)
        with np.errstate(over="ignore"):
            norm = np.sqrt((v**2).sum(axis=1))
        plain = norm * max(self.longest, 1.0) < EXACT
        ids, v = ids[plain], v[plain]
        if len(ids) < self.k + 1 or not self.longest < EXACT:
            return
        scores = _padded(self.raw, width) @ v.T
        scores[self.id[:, None] == ids[None, :]] = -np.inf
        self.least = np.partition(scores, -self.k, axis=1)[:, -self.k]

    def add(self, q, ids, scores):
        own = ids != self.id[q]
        best = self.best[q]
        best += zip((-scores[own]).tolist(), ids[own].tolist())
        if len(best) >= self.k:
            best.sort()
            del best[self.k :]
            self.least[q] = max(self.least[q], -best[-1][0])

    def rows(self):
        found = [(no, i, n, int(-s)) for no, i, best in zip(self.no, self.id.tolist(), self.best) for s, n in best]
        columns = list(zip(*found)) if found else [[]] * 4
        columns[1:3] = [[None if x == _NULL else x for x in c] for c in columns[1:3]]
        names = ["query_no", "query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _searcher(block, seeds, k):
    def search(batches):
        queries = _Queries(block, seeds, k)
        for batch in batches:
            ids = _ids(batch.column(batch.schema.get_field_index("vec_id")).to_pylist())
            vectors = batch.column(batch.schema.get_field_index("v")).to_pylist()
            norm = batch.column(batch.schema.get_field_index("norm")).to_numpy() ** 0.5
            plain = norm * max(queries.longest, 1.0) < EXACT
            order = np.flatnonzero(plain)[np.argsort(-norm[plain], kind="stable")]
            width = max([queries.width, *map(len, vectors)], default=0)
            q = _padded(queries.raw, width)
            for low in range(0, len(order), BUCKET):
                chosen = order[low : low + BUCKET]
                _bucket(queries, q, ids[chosen], _padded([vectors[i] for i in chosen], width), norm[chosen])
            for i in np.flatnonzero(~plain):
                _exactly(queries, ids[i : i + 1], vectors[i])
        yield queries.rows()

    return search


def _bucket(queries, q, ids, v, norm):
    """One bucket: passes over it, bounds coordinates or lengths, and verifies the rest."""
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(queries.norm * norm[0] > 0, queries.least / (queries.norm * norm[0]), -np.inf)
        unit = np.where(norm[:, None] > 0, v / norm[:, None], 0.0)
    local[(queries.norm * norm[0] == 0) & (queries.least > 0)] = np.inf
    open_ = local <= 1.0 + slack
    by_coordinate = open_ & (local >= COORDINATE_FROM)
    for i in np.flatnonzero(by_coordinate):
        mine = q[i] / queries.norm[i]
        focus = np.argsort(-np.abs(mine))[:FOCUS]
        rest = np.flatnonzero(_feasible(unit[:, focus], mine[focus], min(local[i], 1.0)))
        scores = v[rest] @ q[i]
        good = scores >= queries.least[i]
        queries.add(i, ids[rest[good]], scores[good])
    by_length = np.flatnonzero(open_ & ~by_coordinate)
    if len(by_length):
        long = norm * queries.norm[by_length].max() >= queries.least[by_length].min() - 1e-6
        ids, v = ids[long], v[long]
        scores = v @ q[by_length].T
        for column, i in enumerate(by_length):
            mine = scores[:, column]
            good = np.flatnonzero(mine >= queries.least[i])
            if len(good):
                queries.add(i, ids[good], mine[good])


def _feasible(unit, mine, t):
    """Vectors whose coordinates allow a cosine of ``t`` or more with the query.

    With one coordinate x of a unit vector known, the cosine is at most
    ``x * m + sqrt((1 - x**2) * (1 - m**2))``, m being the query's coordinate.
    """
    rest = np.sqrt(np.maximum(1 - unit**2, 0.0) * np.maximum(1 - mine**2, 0.0))
    return (unit * mine + rest >= t - 1e-6).all(axis=1)


def _exactly(queries, ids, vector):
    """Products too large for doubles, with whole numbers of any size, cut to the range of a long."""
    v = [int(x) for x in vector]
    for i, raw in enumerate(queries.raw):
        score = sum(int(a) * b for a, b in zip(raw, v))
        score = min(max(score, -(1 << 63)), (1 << 63) - 1)
        best = queries.best[i]
        if ids[0] != queries.id[i]:
            best.append((-score, int(ids[0])))
            best.sort()
            del best[queries.k :]
