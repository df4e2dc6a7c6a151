"""Vector search, URL rules, revisits, packing and the pipeline on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import vector_search
from lotwise.llm.packing import SHARD, SIZES, best_fit, default_cost, opened_sizes, pack, total_price, word_lengths
from lotwise.llm.revisits import canonical_url, resolve_revisits
from lotwise.llm.url_rules import judge, rules_table
from lotwise.llm.vector_search import top_k, whole_components


@pytest.mark.parametrize("spread", [0.05, 1.0, 8.0])
def test_top_k_matches_all_products(spark, spread, monkeypatch):
    monkeypatch.setattr(vector_search, "SEEDS", 40)
    monkeypatch.setattr(vector_search, "BUCKET", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    x = np.concatenate([base[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 8))] * 1 + [base])
    x[5] = x[6] = x[7]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    df = whole_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = top_k(df, df.filter("vec_id % 5 = 0")).collect()
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, len(x), 5):
        scores = whole @ whole[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.rank, r.vec_id, r.score) for r in mine] == [(n, i, scores[i]) for n, i in enumerate(order, 1)]


def test_vectors_with_odd_components(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf")]),
        (7, [1e300, -1e300]), (50, [0.0, -1.0]), (None, [3.0, 3.0]), (1, [1.0]),
    ]
    df = whole_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted(r.vec_id is None and -1 or r.vec_id for r in df.collect()) == [-1, 0, 1, 1, 2, 7, 50]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.filter("vec_id % 50 = 0")).collect()]
    u = 256 * 256
    assert sorted(g for g in got if g[0] == 0) == [(0, 1, None, 9 * u), (0, 2, 1, u), (0, 3, 1, u), (0, 4, 2, 0), (0, 5, 50, -2 * u)]
    assert (50, 1, 7, 2**63 - 1) in got
    assert top_k(df.limit(0), df.limit(0)).count() == 0 and top_k(df, df.limit(0)).count() == 0


URLS = [
    ("http://Shop.Example.org/es/1?x", "shop.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://example.org/en/27#a", "example.org", "/en/27", "org/", "allow"),
    ("https://myexample.org", "myexample.org", "", None, "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"), ("http://a.com/DE/", "a.com", "/DE/", None, "allow"),
    ("//a.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://É.com/fr/?://b.org/", "É.com", "/fr/", "com/fr/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(u[0], "x") for u in URLS + URLS[:1]], "url string, verdict string")
    got = sorted((tuple(r) for r in judge(pages, rules_table(spark)).collect()), key=str)
    assert got == sorted(URLS + URLS[:1], key=str)
    assert judge(pages.limit(0), rules_table(spark)).count() == 0
    assert {r.verdict for r in judge(pages, rules_table(spark).limit(0), "none").collect()} == {"none"}


def test_canonical_url(spark):
    urls = {
        "HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#f": "example.com/a?a=1&b=2", "https://example.com": "example.com",
        "example.com/?ref=1": "example.com", "http://h/p?refer=1": "h/p?refer=1", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("c", canonical_url(F.col("url")))
    assert {r.url: r.c for r in rows.collect()} == urls


def test_revisits_match_a_scan_over_all_records(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "other"])
        headers = {k: v for k, v in (("etag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("last-modified", rng.choice(["m", "n", None])), ("date", str(i)), ("x", str(i))) if v}
        url = rng.choice(["http://h/1", "https://www.h/1/", "http://h/2", None]) if rng.random() < 0.9 else f"http://u/{i}"
        rows.append((i, url, rng.choice([None, *range(40)]), kind, headers, f"d{i}"))
    log = spark.createDataFrame(rows, "record_id bigint, url string, time int, kind string, headers map<string,string>, digest string")
    key = {"http://h/1": "h/1", "https://www.h/1/": "h/1", "http://h/2": "h/2"}
    got = {r.record_id: r for r in resolve_revisits(log.withColumn("outcome", F.lit("x"))).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, url, time, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        of = key.get(url, (url or "")[7:] or None)
        earlier = [r for r in rows if r[3] == "response" and of and key.get(r[1], (r[1] or "")[7:] or None) == of and time is not None and r[2] is not None and r[2] < time]
        if not earlier:
            assert got[i].outcome == "missing" and got[i].refers_to is None
            continue
        stored = max(earlier, key=lambda r: (r[2], r[0]))
        assert got[i].refers_to == stored[0]
        tags = [h.get("etag", "").removeprefix("W/") for h in (stored[4], headers)]
        dates = [h.get("last-modified") for h in (stored[4], headers)]
        agreed = tags[0] == tags[1] if all(tags) else None not in dates and dates[0] == dates[1]
        assert got[i].outcome == ("resolved" if agreed else "mismatch")
        if agreed:
            assert got[i].headers == {**stored[4], **{k: v for k, v in headers.items() if k != "x"}} and got[i].digest == stored[5]
    assert resolve_revisits(log.limit(0)).count() == 0


def test_best_fit_matches_a_scan_over_open_bins():
    rng = random.Random(7)
    prices = {s: default_cost(s, SIZES[-1]) for s in SIZES}
    lengths = sorted((rng.choice([rng.randint(1, 4096), rng.randint(1, 300)]) for _ in range(400)), reverse=True)
    chosen = opened_sizes(lengths, SIZES, prices)
    bins, starts, final = best_fit(lengths, SIZES, prices, chosen)
    room, filled = [], []
    for n, b, start in zip(lengths, bins, starts):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[b] == min(fits)
        else:
            assert b == len(room)
            room.append(next(c for s, c in zip(SIZES, chosen) if s >= n))
            filled.append(0)
        assert start == filled[b]
        filled[b], room[b] = filled[b] + n, room[b] - n
    assert final == [min((s for s in SIZES if s >= f), key=prices.get) for f in filled]


def test_sizes_are_chosen_together():
    prices = {s: default_cost(s, SIZES[-1]) for s in SIZES}
    rng = random.Random(8)
    for low, high in [(550, 800), (20, 90), (300, 380), (10, 3000)]:
        lengths = sorted((rng.randint(low, high) for _ in range(1500)), reverse=True)
        chosen = opened_sizes(lengths, SIZES, prices)
        price = total_price(lengths, SIZES, prices, chosen)
        single = [total_price(lengths, SIZES, prices, [s] * 4) for s in SIZES if s >= lengths[0]]
        greedy = total_price(lengths, SIZES, prices, [1024, 1024, 2048, 4096])
        assert price <= min(single) and price <= greedy
        for i in range(4):
            for s in SIZES[i:]:
                assert price <= total_price(lengths, SIZES, prices, [*chosen[:i], s, *chosen[i + 1 :]])
        if low == 550:
            assert chosen[1] > 1024 and price < 0.97 * greedy


def test_long_texts_and_repeated_rows_do_not_fill_a_shard(spark):
    rows = [(i, 400 * 4096 + 5 * (i % 2)) for i in range(10)] + [(7, 100)] * (3 * SHARD)
    got = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"))
    assert got.filter("bin like 'whole-%'").count() == 4000 == got.filter("n_tokens = 4096").select("bin").distinct().count()
    shards = got.filter("not bin like 'whole-%'").groupBy(F.substring_index("bin", "-", 1).alias("s")).count().collect()
    assert sum(r["count"] for r in shards) == 3 * SHARD + 5 and max(r["count"] for r in shards) < 1.1 * SHARD


def test_pack_keeps_every_token_once(spark, odd):
    rows = [(i, n) for i, n in enumerate([1, 4096, 4097, 9000, 700, 0, -3])] + [(None, 5), (8, None), (1, 4096)]
    lengths = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = pack(lengths).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id in (2, 3)) == [(2, 1), (2, 4096), (3, 808), (3, 4096), (3, 4096)]
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows if n and n > 0)
    places = {}
    for r in got:
        places.setdefault((r.bin, r.bin_size), []).append((r.start, r.start + r.n_tokens))
    for (_, size), used in places.items():
        used.sort()
        assert used[-1][1] <= size and all(a[1] == b[0] for a, b in zip(used, used[1:])) and used[0][0] == 0
    assert pack(lengths.limit(0)).count() == 0
    assert sum(r.n_tokens for r in word_lengths(odd).collect()) == 40_000 + 2 + 2 + odd.count()


def test_pipeline_stages(spark, odd, tmp_path):
    long = " ".join(f"common{i % 37} word{i}" for i in range(40))
    item = "what is the capital city of the country that lies in the middle"
    rows = [(1, long), (2, long + " end"), (3, f"{item} and more text follows here"), (4, "my token = abcdefgh12345 is here"), (5, None), (6, "1234")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left.append(sorted(r.doc_id for r in docs.collect()))
    assert left[0] == [1, 2, 3, 4] and len(left[1]) in (3, 4) and 3 not in left[2] and left[3] == left[2]
    masked = docs.filter("doc_id = 4").first()
    assert masked.text == "my [secret] is here" and masked.n_chars == len(masked.text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed) == left[3]
