"""Operators on repeated text against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.llm.near_duplicates import RARE, kept_documents, near_duplicates
from lotwise.llm.sparse_suffixes import repeated_passages
from lotwise.llm.suffix_groups import remove_repeats

SPACE = "[\x20\x09-\x0d]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def covered(lists, window):
    """Flags of words below a window that also starts elsewhere."""
    count = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for words in lists:
        flags = [False] * len(words)
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts that share passages of many lengths, with repeats inside one text and copies."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [fresh(n) for n in (36, 49, 50, 51, 60, 90, 140, 200)]
    texts = []
    for _ in range(60):
        words = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 3)
            words += p[cut : len(p) - rng.randrange(0, len(p) // 4)] + fresh(rng.randrange(0, 40))
        texts.append(" ".join(words))
    texts += [texts[5], "same " * 120, None, ""]
    return list(enumerate(texts))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("window", [3, 35])
def test_remove_repeats(spark, corpus, window):
    lists = {i: split(t) for i, t in corpus}
    gone = dict(zip(lists, covered(list(lists.values()), window)))
    for row in remove_repeats(docs(spark, corpus), window).collect():
        words, flags = lists[row.doc_id], gone[row.doc_id]
        assert row.n_words == len(words)
        assert row.kept_text == " ".join(w for w, f in zip(words, flags) if not f)
        assert [p for r in row.removed for p in range(r.start, r.end)] == [i for i, f in enumerate(flags) if f]


def test_repeated_passages(spark, corpus):
    lists = {i: split(t) for i, t in corpus}
    expected = dict(zip(lists, covered(list(lists.values()), 50)))
    got = {i: [False] * len(w) for i, w in lists.items()}
    for row in repeated_passages(docs(spark, corpus)).collect():
        assert row.words == row.end - row.start >= 50
        for p in range(row.start, row.end):
            assert not got[row.doc_id][p]
            got[row.doc_id][p] = True
    assert got == expected


def test_passages_that_end_or_begin_in_a_frequent_line(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, notice = fresh(40), fresh(60)
    lists = [fresh(30) + line + fresh(8) for _ in range(600)] + [fresh(20) + notice + fresh(20) for _ in range(60)]
    for a, b, words in ((40, 570, 16), (100, 333, 30), (7, 8, 9)):
        lists[a][30 - words : 30] = lists[b][30 - words : 30] = fresh(words)
    lists[50][70:] = lists[500][70:] = fresh(12)
    lists[610][5:20] = lists[650][5:20] = fresh(15)
    expected = covered(lists, 50)
    got = [[False] * len(w) for w in lists]
    rows = [(i, " ".join(w)) for i, w in enumerate(lists)]
    for row in repeated_passages(docs(spark, rows)).collect():
        got[row.doc_id][row.start : row.end] = [True] * (row.end - row.start)
    assert got == expected and all(any(expected[i]) for i in (40, 570, 100, 333, 50, 500))


def jaccard(a, b, weight):
    shared = sum(min(a[s], b[s]) * weight(s) for s in a.keys() & b.keys())
    return shared / (sum(n * weight(s) for s, n in (a + b).items()) - shared)


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"{base}-{rng.randrange(400)}" for _ in range(120)]
        for copy in range(10):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    shingles = {i: collections.Counter(tuple(split(t)[j : j + 5]) for j in range(116)) for i, t in rows}
    df = collections.Counter(s for c in shingles.values() for s in c)
    weight = lambda s: math.log1p(len(rows) / max(df[s], RARE * len(rows)))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in shingles:
        for j in range(i):
            if jaccard(shingles[i], shingles[j], weight) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    found = {r.doc_id: r for r in near_duplicates(docs(spark, rows)).collect()}
    assert {i: r.class_id for i, r in found.items()} == {i: root(i) for i in parent}
    assert {i for i, r in found.items() if r.is_kept} == {root(i) for i in parent}
    kept = [r.doc_id for r in kept_documents(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted({root(i) for i in parent})


def test_unique_text_weighs_more_than_lines_of_a_few_percent(spark):
    """5 % of the documents hold a notice: two of them with 20 own words each are alike only without the weights."""
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    notice, story = fresh(300), fresh(300)
    lists = [notice + fresh(20) for _ in range(20)] + [fresh(60) for _ in range(378)] + [story + fresh(20), story + fresh(4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(lists)]
    counts = [collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in lists]
    df = collections.Counter(s for c in counts for s in c)
    true = lambda s: math.log1p(len(rows) / df[s])
    assert jaccard(counts[0], counts[1], lambda s: 1.0) >= 0.8 > jaccard(counts[0], counts[1], true)
    assert jaccard(counts[-1], counts[-2], true) >= 0.8
    found = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert found == {**{i: i for i in range(399)}, 399: 398}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(139, 200), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 100}


def test_odd_rows(spark, odd):
    rows = odd.count()
    kept = remove_repeats(odd).collect()
    assert len(kept) == rows and {r.n_words for r in kept if r.doc_id in (1, 2, 3)} == {0}
    assert [r.kept_text for r in kept if r.doc_id == 4] == ["", ""]
    found = near_duplicates(odd)
    assert found.count() == rows
    assert sorted(r.class_size for r in found.filter("doc_id = 4").collect()) == [2, 2]
    once = kept_documents(odd)
    assert once.columns == odd.columns and once.count() == rows - 1
    spans = repeated_passages(odd).collect()
    assert {(r.doc_id, r.start, r.end) for r in spans} == {(4, 0, 20_000)} and len(spans) == 2
    for result in (remove_repeats, near_duplicates, kept_documents, repeated_passages):
        assert result(odd.limit(0)).count() == 0
        assert result(odd.filter(F.col("text").isNull())).count() in (0, 2)


def test_names_and_counts_are_packed_without_loss():
    import numpy as np

    from lotwise.llm.near_duplicates import _pack_counts, _pack_names, _unpack_counts, _unpack_names

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        names = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        counts = rng.choice([1, 1, 1, 2, 5, 10**10], n)
        assert np.array_equal(_unpack_names(_pack_names(names)), names)
        assert np.array_equal(_unpack_counts(_pack_counts(counts)), counts)


def test_kept_rows_with_columns_named_like_the_operators_own(spark):
    from lotwise.llm.near_duplicates import kept_documents

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, 1, "a"), (1, words, 1, "a"), (2, words + " end", 2, "b"), (3, "other text of some words here", 3, "c"), (None, None, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key int, _OF string")
    got = sorted((r.doc_id or 0, r._key, r._OF) for r in kept_documents(docs).collect())
    assert got in ([(0, 4, "d"), (1, 1, "a"), (3, 3, "c")], [(0, 4, "d"), (2, 2, "b"), (3, 3, "c")])


def test_texts_that_share_a_long_passage_meet_at_it_once(spark, monkeypatch):
    """Six texts of one bucket share 300 words: one row each is joined, not one for each common shingle."""
    from lotwise.llm import near_duplicates as near

    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(300)
    texts = docs(spark, [(i, " ".join(passage + fresh(3))) for i in range(6)])
    idf = near._Idf(texts)
    named = texts.withColumn("digest", near._digest(F.col("text")))
    sketches = near.commit(near._sketches(named, idf), "sketches")
    of = sketches.select("digest", F.col("doc_id").alias("sample"), "weight", "bands")
    shared = of.select(F.lit(0).alias("band"), F.lit(0).alias("value"), F.col("digest").alias("node"), "weight")
    none = shared.limit(0).select("node", F.col("node").alias("component"))
    tried = none.select(F.col("node").alias("a"), F.col("component").alias("b"))
    written, commit = {}, near.commit

    def counted(df, name, *more):
        written[name] = commit(df, name, *more)
        return written[name]

    monkeypatch.setattr(near, "commit", counted)
    pairs = near._across(shared, none, tried, named, sketches, of, idf, 0.8).collect()
    assert len(pairs) == len(set(pairs)) == 15
    assert written["entries"].count() == 6 * 299 and written["prefixes"].count() == 6


def test_a_stretch_counts_the_shingles_of_a_text_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lotwise.llm import near_duplicates as near

    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(9)] + [None, ""]
    digests = [bytes([i]) * 16 for i in range(10)]
    table = pa.table({"doc_id": range(11), "digest": [*digests, None], "text": texts, "stretch": np.zeros(11, np.int32)})
    sums = near._sums(near._stretch_names(table, 1))
    idf = near._Idf.__new__(near._Idf)
    idf.n, idf.floor, idf.top = 11, 1.0, float(np.log1p(11))
    read, counted = [], near._counted
    monkeypatch.setattr(near, "_counted", lambda words: read.append(len(words.counts())) or counted(words))
    sketch = near._sketch(table, sums, idf)
    assert sum(read) == len(sketch) == 11 and [b is None for b in sketch.column("bands").to_pylist()] == [False] * 9 + [True] * 2
