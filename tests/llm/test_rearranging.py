"""Fill-in-the-middle, byte-level BPE and resampling against plain Python and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotwise.llm import byte_bpe, resampling
from lotwise.llm.byte_bpe import FOREST, Vocabulary, decode, encode, merge_many, merge_one
from lotwise.llm.fill_in_middle import rearrange, restored
from lotwise.llm.query_byte_bpe import digests
from lotwise.llm.resampling import resample, scored, word_lists

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def vocabulary():
    with open(BPE, "rb") as file:
        return Vocabulary(file.read())


# ---------------------------------------------------------------- fill-in-the-middle


def filled(key, text, unit=None, sentinels=("<P>", "<S>", "<M>"), plain=10, spm=20, seed=1):
    text = text or ""
    units = list(text) if unit is None else re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= 100 - plain or "".join(units) != text:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = dict(zip("psm", ("".join(units[:a]), "".join(units[b:]), "".join(units[a:b]))))
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, a, b - a, "".join(dict(zip("psm", sentinels))[c] + parts[c] for c in form)


def test_rearranged_texts_and_their_restoration(spark, odd):
    texts = ["a", "é漢😀\n\r ", "x<P>y", "<", "<P", "a\\b$1", " ", "\n\n", "ab" * 50, "<S<M<P", "𝒳" * 30]
    rows = [(i, t) for i, t in enumerate(texts * 20)] + [(r.doc_id, r.text) for r in odd.collect()]
    found = rearrange(spark.createDataFrame(rows, "doc_id bigint, text string"))
    again = found.withColumn("again", restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, *r.fim) for r in again))) == sorted(map(repr, ((k, t, *filled(k, t)) for k, t in rows)))
    assert all(r.again == (r.text or "") for r in again)
    assert {r.fim.form for r in again} == {"plain", "psm", "spm"}


def test_units_and_sentinels_of_ones_own(spark):
    unit, marks = r"[^\n]*\n|[^\n]+\z", ("$1\\", "@{x}", "#m")
    rows = [(i, t) for i, t in enumerate(["one\ntwo\nthree", "a\n", "\n\n\nx", "no end", "a\nb\n", "#m\n"] * 8)]
    found = rearrange(spark.createDataFrame(rows, "k int, body string"), 7, unit, 0, 50, marks, "k", "body", "out")
    got = {r.k: (*r.out, r.again) for r in found.withColumn("again", restored(F.col("out.output"), F.col("out.form"), marks)).collect()}
    assert got == {k: (*filled(k, t, r"[^\n]*\n|[^\n]+\Z", marks, 0, 50, 7), t) for k, t in rows}
    gaps = rearrange(spark.createDataFrame([(1, "a b c")], "doc_id int, text string"), unit="[a-z]", plain_percent=0).first().fim
    assert tuple(gaps) == (3, "plain", None, None, "a b c")
    for wrong in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("<P>", "<S>", "")):
        with pytest.raises(ValueError):
            rearrange(spark.createDataFrame(rows, "k int, text string"), sentinels=wrong, key="k")


def test_very_long_texts_and_clashing_names(spark):
    long = "0123456789\n" * 100_000
    rows = spark.createDataFrame([(5, long, 1, "x", 2)], "doc_id bigint, text string, _work int, FIM string, `_work_` int")
    got = rearrange(rows).first()
    assert tuple(got.fim) == filled(5, long) and got._work == 1 and got._work_ == 2
    assert rearrange(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- byte-level BPE


def test_every_character_and_odd_texts_are_encoded_like_the_library(vocabulary, library):
    texts = [
        " x".join(f"{chr(c)}a{chr(c)}{chr(c)} {chr(c)}" for c in range(low, low + 256) if not 0xD800 <= c < 0xE000)
        for low in range(0, 0x30000, 256)
    ]
    rng = random.Random(4)
    letters = "ab' \n\t\x1c\x85é漢'll'S's12  .,!?　"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "x" * 5000, "", "ab" * 70, " " * 300 + "x"]
    check(vocabulary, library, texts)


def check(vocabulary, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, dtype="<u4") for b in vocabulary.encode(texts)]
    assert [g.tolist() for g in got] == want
    assert [vocabulary.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_long_texts_are_cut_between_words(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 4)
    rng = random.Random(5)
    parts = ["a", "bcd efg", "<|endoftext|>", "  ", "\n", "word-like", "x" * 90]
    check(vocabulary, library, [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)])


def naive(symbols, merges):
    symbols = list(symbols)
    while True:
        found = [(merges.of_pair[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.of_pair]
        if not found:
            return symbols
        rank, at = min(found)
        symbols[at : at + 2] = [int(merges.result[rank])]


def test_trees_give_the_leftmost_lowest_merge(vocabulary):
    rng = np.random.default_rng(3)
    merges = byte_bpe.Merges([(0, 0, 3), (0, 1, 4), (3, 3, 5), (1, 2, 6), (4, 6, 7), (5, 0, 8)])
    for size in (8, 16, FOREST):
        lengths = rng.integers(1, size + 1, 200)
        rows = rng.integers(0, 3, (200, size))
        want = [naive(r[:n].tolist(), merges) for r, n in zip(rows, lengths)]
        assert [merge_one(r[:n].tolist(), merges) for r, n in zip(rows, lengths)] == want
        flat, ends = merge_many(rows.copy(), lengths, merges)
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == want
    assert merge_one([0] * 200_000, byte_bpe.Merges([(0, 0, 1), (1, 1, 2)])) == [2] * 50_000


def test_encoded_and_decoded_frames(spark, odd, library):
    rows = odd.withColumn("IDS", F.lit(3)).withColumn("c0", F.lit("kept"))
    coded = decode(encode(rows, BPE), BPE)
    got = coded.collect()
    assert coded.columns == [*odd.columns, "ids", "c0", "decoded"]
    assert len(got) == odd.count() and {r.c0 for r in got} == {"kept"}
    for row in got:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == (row.text or "")
    odd_ids = spark.createDataFrame([([104, None, 10**6, -5, 50256],), (None,), ([],), ([130, 97],)], "ids array<int>")
    want = [library.decode([104, 50256], skip_special_tokens=False), "", "", library.decode([130, 97], skip_special_tokens=False)]
    assert [r.decoded for r in decode(odd_ids, BPE).collect()] == want
    assert encode(rows.limit(0), BPE).count() == 0


def test_digests_are_of_little_endian_ids(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([1, None]), "text": ["", ""], "ids": pa.array([[1, 70000], []], pa.list_(pa.int32())), "decoded": ["é", ""],
    })
    got = next(digests([batch])).to_pylist()
    assert got[0]["ids_sha256"] == hashlib.sha256(bytes([1, 0, 0, 0, 112, 17, 1, 0])).hexdigest()
    assert got[1] == {"doc_id": None, "n_tokens": 0, "ids_sha256": hashlib.sha256().hexdigest(), "decoded_sha256": hashlib.sha256().hexdigest()}
    assert got[0]["decoded_sha256"] == hashlib.sha256("é".encode()).hexdigest()


def test_unsupported_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        encode(spark.createDataFrame([("a",)], "text string"), public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) for g in grams)


def resampled(docs, target, percent, least, longest, buckets, seed):
    def folded(texts):
        total = Counter()
        for text in texts:
            for code, n in features(text, longest)[1].items():
                total[code % buckets] += n
        return total

    s, t = folded(x for _, x in docs), folded(target)
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    rows = []
    for key, text in docs:
        words, found = features(text, longest)
        weight = sum(gain[code % buckets] * n for code, n in found.items())
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, words, sum(found.values()), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[5] = rank
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (2, 50, 3), (3, 100, 0)])
def test_resampled_documents(spark, odd, monkeypatch, longest, percent, least):
    monkeypatch.setattr(resampling, "PIECE_BYTES", 64)
    rng = random.Random(6)
    vocabulary = ["Alpha", "beta", "ÄÖ", "x9", "the", "of", "and", "rare"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += docs[:30] + [(None, docs[3][1])] * 12 + [(r.doc_id, r.text) for r in odd.collect()]
    target = ["the ALPHA of x9", None, "", "beta--beta"]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, at int, fit string").repartition(5)
    got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, longest, 97, 11).collect()
    assert sorted(repr(tuple(r)) for r in got) == resampled(docs, target, percent, least, longest, 97, 11)


def test_equal_rows_are_spread_over_segments_and_ranked_once(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("score"), (F.col("id") % 5 > 0).alias("fit"),
    )
    ranked = resampling.ranks(rows.repartition(9))
    got = ranked.where("fit").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    keys = [(-r.score, r.doc_id) for r in got]
    assert keys == sorted(keys) and ranked.where("not fit and rank is null").count() == 4000
    part = F.spark_partition_id()
    assert ranked.where("rank is not null").groupBy(part).count().agg(F.max("count")).first()[0] < 2 * 16_000 / 8


def test_empty_tables_and_pieces_of_long_texts(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in resample(one, none, percent=100).orderBy("doc_id").collect()][1][:4] == (2, 0, 0, 0)
    assert scored(none, np.zeros(8, dtype=np.int64)).count() == 0
    monkeypatch.setattr(resampling, "PIECE_BYTES", 10)
    text = "Word after word, aStretchWithoutAnEnd " * 9
    assert [w for ws in word_lists(text) for w in ws] == [w.encode() for w in WORD.findall(text.lower())]
    with pytest.raises(ValueError):
        resample(one, one, percent=101)
    with pytest.raises(ValueError):
        resample(one, one, buckets=0)
