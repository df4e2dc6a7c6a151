"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five consecutive words (a shorter text is one shingle); its weight in a text is its
count times ``ln(1 + N / df)``, df of all N documents hold it.  Document frequencies are summed in
buckets of names: stretches of documents send their sorted names and get the sums back in that
order, so names travel once and nothing passes through the driver.  A text is sampled SAMPLES times by improved consistent weighted
sampling: two texts draw the same (shingle, level) with the probability of their weighted Jaccard
similarity.  ROWS draws make a band; texts that share a band are candidates; every candidate pair
kept as a link has its exact weighted Jaccard similarity computed.  At 0.8 a pair is missed by all
bands with a probability of 3e-5.

Copies are one node, named by a digest of the text.  In a bucket every text is compared with one
pivot, the text whose buckets are largest; texts of one component need no more comparisons.  Where
buckets still hold several components, texts are compared across them if they share a passage of
their prefixes (the rarest passages, without which the rest weighs too little for a link) and if
what they do not hold alone could make a link.  A passage is all shingles that the same texts hold.
Both bounds are exact; a text that differs from all others by more than a link allows meets none
of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.llm.tables import commit, unused
from lotwise.llm.words import Words, mix, pieces

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: share of the documents up to which shingles weigh alike: none, every frequency is counted
RARE = 0.0
STRETCH_BYTES = 1 << 22
POOL = 1 << 14
GATHER = 16_384
LISTED = 64
PAIRS = 512
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_NAMES = "bucket int, stretch int, names binary, dfs binary"
_SUMS = "stretch int, bucket int, dfs binary"
_SKETCH = "doc_id bigint, digest binary, weight double, bands array<bigint>, dfs binary"
_WEIGHTS = "node binary, shingles binary, uneven binary"
_ENTRY = "node binary, shingle bigint, weight double"
_PAIR = "a binary, b binary, similarity double"


def near_duplicates(docs, similarity=SIMILARITY, key="doc_id", text="text"):
    """One row per row of ``docs``: ``key``, ``class_id``, ``n_links``, ``class_size``, ``is_kept``.

    ``class_id`` is the smallest key of the class (null if all its keys are null), ``n_links`` the
    number of different texts the document's text is linked to, ``is_kept`` holds for one row of
    each class.  Null texts and texts without words are classes of one row: there is nothing to
    compare.  Repeated rows are copies, also under one key.  Other columns are ignored.
    """
    found = _classified(docs, similarity, key, text)
    return found.select(F.col("doc_id").alias(key), "class_id", "n_links", "class_size", "is_kept")


def kept_documents(docs, similarity=SIMILARITY, key="doc_id", text="text"):
    """``docs`` with one row of each class of near duplicates, all columns as they are.

    Rows without words all stay.
    """
    own, of = unused(docs.columns, "_key"), unused(docs.columns, "_of")
    found = _classified(docs, similarity, key, text)
    keys = found.groupBy(F.col("doc_id").alias(own), F.col("digest").alias(of)).agg(
        F.max("is_kept").alias("kept"), F.max(F.col("is_kept") & F.col("worded") & (F.col("copies") > 1)).alias("repeated")
    )
    # What goes, or stays once of several equal rows, is less than what stays as it is.
    away = commit(keys.filter("not kept or repeated"), "away")
    same = F.col(key).cast("bigint").eqNullSafe(F.col(own)) & _digest(F.col(text)).eqNullSafe(F.col(of))
    single = docs.join(away.select(own, of), same, "left_anti")
    repeated = away.filter("repeated").select(own, of)
    if repeated.isEmpty():
        return single
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    return single.unionByName(docs.join(repeated, same).groupBy(own, of).agg(row).select("row.*"))


def _digest(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _classified(docs, similarity, key, text):
    """(doc_id, digest, worded, class_id, n_links, class_size, is_kept, copies) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    idf = _Idf(rows)
    named = rows.withColumn("digest", _digest(F.col("text")))
    sketches = commit(_sketches(named, idf), "sketches")
    worded = sketches.filter("bands is not null")
    texts = worded.groupBy("digest").agg(
        F.min("doc_id").alias("sample"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
    )
    buckets = commit(_buckets(texts), "buckets")

    sizes = buckets.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = buckets.join(sizes, ["band", "value"])
    reach = shared.groupBy("node").agg(F.sum("n").alias("reach"))
    shared = commit(shared.join(reach, "node"), "shared")
    pivots = shared.groupBy("band", "value").agg(F.max(F.struct("reach", "node")).alias("pivot"))
    shared = shared.join(pivots, ["band", "value"])
    pairs = shared.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
    pairs = commit(pairs.filter("a <> b").distinct(), "pairs")
    links = commit(_verify(pairs, named, sketches, texts, idf).filter(F.col("similarity") >= similarity), "links")
    found = commit(components(links), "components")

    rest = commit(_across(shared, found, pairs, named, sketches, texts, idf, similarity), "across")
    if not rest.isEmpty():
        more = _verify(rest, named, sketches, texts, idf).filter(F.col("similarity") >= similarity)
        links = commit(links.unionByName(more), "links")
        found = commit(components(links), "components")

    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    of_text = found.join(degree, found.node == degree.a).select("node", "component", "n_links")
    joined = sketches.join(of_text, sketches.digest == of_text.node, "left").select(
        "doc_id", "digest", F.col("bands").isNotNull().alias("worded"),
        F.coalesce("component", F.when(F.col("bands").isNotNull(), F.col("digest"))).alias("class"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.monotonically_increasing_id().alias("row"),
    )
    joined = commit(joined, "classed")
    classes = joined.filter("worded").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "digest", "row")).alias("kept"),
    )
    copies = joined.filter("worded").groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    kept = classes.join(
        copies, F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.digest") == F.col("digest"))
    ).select("class", "class_id", "class_size", F.col("kept.row").alias("kept_row"), "copies")
    return joined.join(kept, "class", "left").select(
        "doc_id", "digest", "worded",
        F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "n_links",
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        (~F.col("worded") | (F.col("kept_row") == F.col("row"))).alias("is_kept"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"),
    )


def shingles(words):
    """(document, shingle) of all documents, in order; a text under five words is one shingle."""
    at, names = words.runs(SHINGLE)
    document = words.document()
    counts = words.counts()
    owner = document[at]
    for k in range(1, SHINGLE):
        short = words.first[:-1][counts == k]
        if len(short):
            owner = np.concatenate((owner, document[short]))
            names = np.concatenate((names, words.run_names(k)[short]))
    order = np.lexsort((names, owner))
    return owner[order], names[order]


def _counted(words):
    """Different shingles of each document: (document, shingle, count)."""
    owner, names = shingles(words)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], names[first], np.diff(np.append(first, len(owner)))


class _Idf:
    """Weights of shingles from the numbers of documents that hold them."""

    def __init__(self, rows):
        self.n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.floor = max(1.0, RARE * self.n)
        self.top = float(np.log1p(self.n / self.floor))
        self.stretches = int(size) // STRETCH_BYTES + 1

    def weights(self, df):
        out = np.log1p(self.n / np.maximum(df, self.floor))
        out[df <= self.floor] = self.top
        return out


def _sketches(named, idf):
    """Sketch of every row, with the document frequencies of its shingles in order of their names."""
    parts = idf.stretches
    of = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int")
    rows = named.select("doc_id", "digest", "text", of.alias("stretch"))
    names = rows.groupBy("stretch").applyInArrow(lambda t: _stretch_names(t, parts), _NAMES)
    sums = names.groupBy("bucket").applyInArrow(_sums, _SUMS)
    return rows.groupBy("stretch").cogroup(sums.groupBy("stretch")).applyInArrow(lambda t, u: _sketch(t, u, idf), _SKETCH)


def _read(table):
    """(piece, what _counted finds in it) of a stretch's pieces."""
    cut = (piece for batch in table.to_batches() for piece in pieces(batch))
    return [(piece, _counted(Words.of(piece.column(piece.schema.get_field_index("text"))))) for piece in cut]


def _held(read):
    """Different shingles of a stretch in order, and how many of its documents hold each."""
    found = [names for _, (_, names, _) in read]
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)


def _stretch_names(table, parts):
    names, df = _held(_read(table))
    bucket = (names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(bucket[:1] == bucket[:1], bucket[1:] != bucket[:-1])).tolist()
    ranges = list(zip(cuts, [*cuts[1:], len(names)]))
    return pa.Table.from_arrays(
        [
            pa.array(bucket[cuts].astype(np.int32)),
            pa.array(np.full(len(cuts), table.column("stretch")[0].as_py(), dtype=np.int32)),
            pa.array([_pack_names(names[a:b]) for a, b in ranges], pa.binary()),
            pa.array([_pack_counts(df[a:b]) for a, b in ranges], pa.binary()),
        ],
        ["bucket", "stretch", "names", "dfs"],
    )


def _sums(table):
    """For each stretch the documents everywhere that hold its names of one bucket, in their order."""
    listed = [_unpack_names(x) for x in table.column("names").to_pylist()]
    df = np.concatenate([_unpack_counts(x) for x in table.column("dfs").to_pylist()])
    names, place = np.unique(np.concatenate(listed), return_inverse=True)
    total = np.zeros(len(names), dtype=np.int64)
    np.add.at(total, place, df)
    sums = np.split(total[place], np.cumsum([len(x) for x in listed])[:-1])
    return pa.Table.from_arrays(
        [table.column("stretch"), table.column("bucket"), pa.array([_pack_counts(x) for x in sums], pa.binary())],
        ["stretch", "bucket", "dfs"],
    )


def _pack_names(names):
    """Sorted names as the bytes of their differences, high bytes together: these are mostly zero."""
    steps = np.diff(names, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_names(packed):
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(counts):
    """How many there are, which of them are not one (a bit each), and these."""
    other = counts != 1
    return np.uint32(len(counts)).tobytes() + np.packbits(other).tobytes() + counts[other].astype(np.int64).tobytes()


def _unpack_counts(packed):
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    counts, end = np.ones(n, dtype=np.int64), 4 + -(-n // 8)
    counts[np.unpackbits(np.frombuffer(packed[4:end], np.uint8), count=n).view(bool)] = np.frombuffer(packed[end:], np.int64)
    return counts


class _Draws:
    """The random variates of consistent weighted sampling, one row for each of POOL hash values.

    Shingles that fall on one row share its variates; among equals the smaller name is drawn.
    """

    def __init__(self, top):
        rng = np.random.default_rng(20)
        shape = (POOL, SAMPLES)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, dtype=np.float32)
        self.top_level, self.top_value = self.at(slice(None), np.float32(np.log(top)))

    def at(self, row, ln_weight):
        """Level and value ln(a) of the draws of a row at a weight."""
        r, beta = self.r[row], self.beta[row]
        level = np.floor(ln_weight / r + beta)
        return level.astype(np.int32), self.ln_c[row] - r * (level - beta) - r


def _row(names):
    return (names >> np.uint64(40)).astype(np.int64) % POOL


def _draw(draws, names, weights, top):
    """(value, sample) of one document for each of the SAMPLES."""
    best = np.full(SAMPLES, np.inf, dtype=np.float32)
    sample = np.full(SAMPLES, _LAST)
    for low in range(0, len(names), GATHER):
        name, weight = names[low : low + GATHER], weights[low : low + GATHER]
        row = _row(name)
        value = draws.top_value[row]
        other = np.flatnonzero(weight != top)
        if len(other):
            other_level, value[other] = draws.at(row[other], np.log(weight[other]).astype(np.float32)[:, None])
        least = value.min(axis=0)
        i, k = np.divmod(np.flatnonzero(value == least), SAMPLES)
        level = draws.top_level[row[i], k].astype(np.int64)
        if len(other):
            place = np.minimum(np.searchsorted(other, i), len(other) - 1)
            own = other[place] == i
            level[own] = other_level[place[own], k[own]]
        drawn = np.full(SAMPLES, _LAST)
        np.minimum.at(drawn, k, mix(name[i] + level.view(np.uint64) * _SPREAD))
        sample = np.where(least < best, drawn, np.where(least == best, np.minimum(drawn, sample), sample))
        best = np.minimum(best, least)
    return sample


_DRAWS = {}


def _draws(top):
    if top not in _DRAWS:
        _DRAWS.clear()
        _DRAWS[top] = _Draws(top)
    return _DRAWS[top]


def _sketch(table, sums, idf):
    read = _read(table)
    held, _ = _held(read)
    order = np.argsort(sums.column("bucket").to_numpy())
    listed = sums.column("dfs").to_pylist()
    total = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack_counts(listed[i]) for i in order)])
    schema = pa.schema({
        "doc_id": pa.int64(), "digest": pa.binary(), "weight": pa.float64(),
        "bands": pa.list_(pa.int64()), "dfs": pa.binary(),
    })
    sketched = [_sketch_piece(piece, *counted, held, total, idf).cast(schema) for piece, counted in read]
    return pa.Table.from_batches(sketched, schema)


def _sketch_piece(piece, owner, names, count, held, total, idf):
    draws = _draws(idf.top)
    column = {name: piece.column(i) for i, name in enumerate(piece.schema.names)}
    df = total[np.searchsorted(held, names)]
    weights = idf.weights(df) * count
    cuts = np.searchsorted(owner, np.arange(len(piece) + 1))
    sums = np.concatenate(([0.0], np.cumsum(weights)))
    drawn = [np.zeros((0, SAMPLES), dtype=np.uint64)]
    drawn += [_draw(draws, names[a:b], weights[a:b], idf.top)[None] for a, b in zip(cuts, cuts[1:]) if a < b]
    sample = np.concatenate(drawn).reshape(-1, BANDS, ROWS)
    name = np.zeros(sample.shape[:2], dtype=np.uint64)
    for r in range(ROWS):
        name = mix(name * _SPREAD + sample[:, :, r])
    worded = iter(name.view(np.int64))
    bands = [next(worded) if a < b else None for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [
            column["doc_id"],
            column["digest"],
            pa.array(sums[cuts[1:]] - sums[cuts[:-1]]),
            pa.array(bands, pa.list_(pa.int64())),
            pa.array([_pack_counts(df[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        ],
        ["doc_id", "digest", "weight", "bands", "dfs"],
    )


def _buckets(texts):
    """(band, value, node, weight) of every text."""
    return texts.select(
        F.posexplode("bands").alias("band", "value"), F.col("digest").alias("node"), "weight"
    )


def _verify(pairs, named, sketches, texts, idf):
    """Exact weighted Jaccard similarity of pairs of texts."""
    weighed = _weighed(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), named, sketches, texts, idf)
    left = weighed.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("uneven").alias("ua"))
    right = weighed.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("uneven").alias("ub"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(lambda b: _compare(b, np.float32(idf.top)), _PAIR)


def _weighed(nodes, named, sketches, texts, idf):
    """(node, shingles, weights) of texts, sorted by shingle; the text is read at one of its copies."""
    wanted = texts.join(nodes, F.col("digest") == F.col("node"))
    wanted = wanted.select(F.col("digest").alias("d"), F.col("sample").alias("s"))
    source = named.join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("s")), "left_semi")

    counted = sketches.join(nodes, F.col("digest") == F.col("node"), "left_semi")
    counted = counted.groupBy("digest").agg(F.first("dfs").alias("dfs"))
    top = np.float32(idf.top)

    def weigh(batches):
        for batch in batches:
            for piece in pieces(batch):
                owner, names, count = _counted(Words.of(piece.column(piece.schema.get_field_index("text"))))
                dfs = piece.column(piece.schema.get_field_index("dfs")).to_pylist()
                df = np.concatenate([_unpack_counts(x) for x in dfs])
                weights = (idf.weights(df) * count).astype(np.float32)
                cuts = np.searchsorted(owner, np.arange(len(piece) + 1)).tolist()
                packed = [_pack(names[a:b], weights[a:b], top) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(piece.schema.get_field_index("digest")),
                        pa.array([p[0] for p in packed], pa.binary()),
                        pa.array([p[1] for p in packed], pa.binary()),
                    ],
                    ["node", "shingles", "uneven"],
                )

    weighed = source.select("digest", "text").join(counted, "digest").mapInArrow(weigh, _WEIGHTS)
    return weighed.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("uneven").alias("uneven"))


def _pack(names, weights, top):
    """Sorted shingles by the upper 48 bits of their names, and the weights that are not ``top``."""
    high = (names >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
    at = np.flatnonzero(weights != top)
    return high.tobytes(), at.astype(np.uint32).tobytes() + weights[at].tobytes()


def _unpack(shingles, uneven, top):
    high = np.frombuffer(shingles, np.uint8).reshape(-1, 6)
    names = np.zeros((len(high), 8), dtype=np.uint8)
    names[:, :6] = high
    weights = np.full(len(high), top)
    at, own = uneven[: len(uneven) // 2], uneven[len(uneven) // 2 :]
    weights[np.frombuffer(at, np.uint32)] = np.frombuffer(own, np.float32)
    return names.view(np.uint64).ravel(), weights


def _slices(batches, rows=PAIRS):
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def _compare(batches, top):
    for batch in _slices(batches):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        sides = [zip(column[s].to_pylist(), column[u].to_pylist()) for s, u in (("sa", "ua"), ("sb", "ub"))]
        similar = [_weighted_jaccard(*_unpack(*a, top), *_unpack(*b, top)) for a, b in zip(*sides)]
        yield pa.RecordBatch.from_arrays(
            [column["a"], column["b"], pa.array(similar, pa.float64())], ["a", "b", "similarity"]
        )


def _weighted_jaccard(sa, wa, sb, wb):
    """Sum of smaller weights over sum of larger ones; shingles are sorted and different."""
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    both = sb[at] == sa
    shared = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    return shared / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared)


def _across(shared, found, tried, named, sketches, texts, idf, similarity):
    """Untried pairs of texts in different components of one bucket that share a prefix passage.

    Shingles that the same texts hold are one passage, named by the digests of these texts: what
    texts have in common is a few of them, and what a text has alone leaves before it is sorted.
    A pair is formed at its rarest common passage, and only if what weighs no rarer could make a
    link, where both lists are short enough to travel along; at each common one otherwise.
    """
    members = shared.select("band", "value", "node", "weight").join(found, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    members = members.join(mixed.filter("low <> high").select("band", "value"), ["band", "value"])
    members = commit(members.select("node", "weight", "component").distinct(), "members")

    top = np.float32(idf.top)
    weighed = _weighed(members.select("node"), named, sketches, texts, idf)
    entries = commit(weighed.mapInArrow(lambda b: _entries(b, top), _ENTRY), "entries")
    held = entries.groupBy("shingle").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("nodes")).filter("df > 1")
    held = held.select("shingle", "df", F.xxhash64("df", "nodes").alias("passage"))
    entries = entries.join(held, "shingle").groupBy("node", "passage").agg(F.first("df").alias("df"), F.sum("weight").alias("own"))
    common_first = Window.partitionBy("node").orderBy(F.desc("df"), "passage")
    entries = entries.withColumn("reached", F.sum("own").over(common_first.rowsBetween(Window.unboundedPreceding, 0)))
    entries = entries.withColumn("common", F.sum("own").over(Window.partitionBy("node")))
    entries = entries.select("node", "passage", "df", "reached", "common").join(members, "node")
    slack = F.lit(similarity * (1 - 1e-6))
    prefix = entries.filter(F.col("reached") >= slack * F.col("weight"))
    whole = common_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.collect_list("passage").over(whole)
    prefix = prefix.withColumn("listed", F.when(F.size(listed) <= LISTED, listed))
    prefix = commit(prefix.select("node", "passage", "component", "weight", "common", "reached", "listed"), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    rarest = F.element_at(F.array_intersect("a.listed", "b.listed"), -1)
    overlap = F.least("a.common", "b.common", F.when(rarest.isNotNull(), F.least("a.reached", "b.reached")))
    near = (
        (F.col("a.passage") == F.col("b.passage"))
        & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.component") != F.col("b.component"))
        & (overlap >= slack * (F.col("a.weight") + F.col("b.weight") - overlap))
        & F.coalesce(rarest == F.col("a.passage"), F.lit(True))
    )
    pairs = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _entries(batches, top):
    for batch in _slices(batches):
        unpacked = [_unpack(s, u, top) for s, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        of = np.repeat(np.arange(len(unpacked)), [len(names) for names, _ in unpacked])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(of)),
                pa.array(np.concatenate([names for names, _ in unpacked]).view(np.int64)),
                pa.array(np.concatenate([weights for _, weights in unpacked]).astype(np.float64)),
            ],
            ["node", "shingle", "weight"],
        )
