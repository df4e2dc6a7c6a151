"""Recipes on small files written in the layouts they expect."""

import bz2
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.plans.recipes import (
    BANK_COLUMNS, CENSUS_COLUMNS, CLICK_COLUMNS, RECIPES, load_dataset,
)

RNG = np.random.default_rng(0)


def write(root, name, text, packed=False):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if packed:
        path.write_bytes(bz2.compress(text.encode()))
    else:
        path.write_text(text)


def libsvm(n, width, labels, entries=None):
    lines, x = [], np.zeros((n, width))
    for i in range(n):
        index = np.sort(RNG.choice(width, entries or max(1, width // 2), replace=False))
        x[i, index] = np.round(RNG.normal(size=len(index)), 3) + 0.01
        pairs = " ".join(f"{j + 1}:{x[i, j]}" for j in index)
        lines.append(f"{labels[i]} {pairs}")
    return "\n".join(lines) + "\n", x


def places(text):
    """Line numbers by content key, for a file without repeated lines."""
    return {hashlib.md5(line.encode()).hexdigest() + "-0": i for i, line in enumerate(text.splitlines())}


def arrays(df, text=None):
    """Labels and features, in the order of the file's lines if its text is given."""
    rows = df.collect()
    order = places(text) if text else {}
    rows.sort(key=lambda r: order.get(r["row_id"], r["row_id"]))
    return np.array([r["y"] for r in rows]), np.array([r["features"] for r in rows], dtype=float)


def unit_rows(x):
    return x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, s)


@pytest.mark.parametrize("name,low", [("phishing", 0), ("mushrooms", 2)])
def test_binary_label_files(spark, tmp_path, name, low):
    recipe = RECIPES[name]
    labels = [1 if i % 3 else low for i in range(40)]
    text, _ = libsvm(40, recipe.width, labels)
    write(tmp_path, recipe.files[0], text)
    train, test = load_dataset(spark, name, str(tmp_path))
    (yt, xt), (yv, xv) = arrays(train), arrays(test)
    assert len(yv) == 10 and len(yt) == 30
    assert sorted(np.concatenate([yt, yv]).tolist()) == sorted(1.0 if v == 1 else -1.0 for v in labels)
    np.testing.assert_allclose(np.linalg.norm(xt, axis=1), 1.0)


@pytest.mark.parametrize("name", ["cpusmall", "abalone", "cadata"])
def test_regression_files(spark, tmp_path, name):
    recipe = RECIPES[name]
    text, x = libsvm(40, recipe.width, [i / 7 for i in range(40)])
    write(tmp_path, recipe.files[0], text)
    train, test = load_dataset(spark, name, str(tmp_path))
    place = places(text)
    rows = {place[r["row_id"]]: r for r in train.collect()}
    assert np.mean([r["y"] for r in rows.values()]) == pytest.approx(0, abs=1e-12)
    ids = sorted(rows)
    scale = np.abs(x[ids]).max(axis=0)
    want = unit_rows(x[ids] / np.where(scale == 0, 1, scale))
    np.testing.assert_allclose(np.array([rows[i]["features"] for i in ids]), want, atol=1e-12)
    shift = np.mean([i / 7 for i in ids])
    for r in test.collect():
        assert r["y"] == pytest.approx(place[r["row_id"]] / 7 - shift)


def test_compressed_pair(spark, tmp_path):
    recipe = RECIPES["msd"]
    for name, n in zip(recipe.files, (12, 5)):
        write(tmp_path, name + ".bz2", libsvm(n, 90, list(range(n)))[0], packed=True)
    train, test = load_dataset(spark, "msd", str(tmp_path), suffix=".bz2")
    assert (train.count(), test.count()) == (12, 5)
    y, x = arrays(test)
    assert sorted(y.tolist()) == [i - 5.5 for i in range(5)] and x.shape == (5, 90)


def test_wide_text_files_stay_sparse(spark, tmp_path):
    for name, n in zip(RECIPES["E2006"].files, (9, 4)):
        write(tmp_path, name, libsvm(n, 2000, list(range(n)), entries=6)[0])
    train, test = load_dataset(spark, "E2006", str(tmp_path))
    row = test.first()
    assert row["width"] == 150360 and len(row["values"]) == 6
    assert np.linalg.norm(train.first()["values"]) == pytest.approx(1.0)
    write(tmp_path, RECIPES["news20small"].files[0], libsvm(10, 3000, [1, -1] * 5, entries=5)[0])
    train, test = load_dataset(spark, "news20small", str(tmp_path))
    assert (train.count(), test.count()) == (8, 2)
    write(tmp_path, RECIPES["E2006small"].files[0], libsvm(8, 500, list(range(8)), entries=5)[0])
    assert load_dataset(spark, "E2006small", str(tmp_path))[1].count() == 2


def test_pair_without_scaling_and_column_shares(spark, tmp_path):
    text, x = libsvm(6, 2000, [1, -1] * 3, entries=2000)
    for name in RECIPES["epsilon"].files:
        write(tmp_path, name, text)
    y, got = arrays(load_dataset(spark, "epsilon", str(tmp_path))[0], text)
    np.testing.assert_allclose(got, x)
    assert y.tolist() == [1, -1] * 3
    text, x = libsvm(20, 28, [0, 1] * 10, entries=28)
    write(tmp_path, RECIPES["higgs"].files[0], text)
    train, _ = load_dataset(spark, "higgs", str(tmp_path))
    rows = train.collect()
    total = np.abs(np.array([r["values"] for r in rows])).sum(axis=0)
    np.testing.assert_allclose(total, 1.0)


@pytest.mark.parametrize("name", ["iris", "breastcancer", "diabetes"])
def test_plain_tables(spark, tmp_path, name):
    recipe = RECIPES[name]
    x = RNG.normal(size=(50, recipe.width))
    y = [i % 3 if name == "iris" else i % 2 for i in range(50)]
    head = ",".join([f"f{i}" for i in range(recipe.width)] + ["y"])
    body = "\n".join(",".join(map(str, [*x[i], y[i]])) for i in range(50))
    write(tmp_path, recipe.files[0], head + "\n" + body + "\n")
    train, test = load_dataset(spark, name, str(tmp_path))
    yt, xt = arrays(train)
    if name == "iris":
        assert xt.shape == (40, 2) and set(yt) == {1.0, -1.0}
        assert test.count() == 10
    elif name == "breastcancer":
        assert set(yt) == {1.0, -1.0}
        np.testing.assert_allclose(np.linalg.norm(xt, axis=1), 1.0)
    else:
        assert sorted(r["row_id"] for r in test.collect()) == list(range(30, 50))
        np.testing.assert_allclose(xt.mean(axis=0), 0, atol=1e-12)
        np.testing.assert_allclose(xt.std(axis=0), 1)


def test_bank_file(spark, tmp_path):
    levels = {
        "job": [f"j{i:02d}" for i in range(12)], "marital": ["d", "m", "s", "u"],
        "default": ["no", "unknown", "yes"], "housing": ["no", "unknown", "yes"],
        "loan": ["no", "unknown", "yes"], "poutcome": ["failure", "nonexistent", "success"],
    }
    lines = [",".join(n for n, _ in BANK_COLUMNS)]
    for i in range(48):
        row = [
            str(i % 2) if n == "y" else levels[n][i % len(levels[n])] if n in levels
            else "t" if kind == "string" else "1"
            for n, kind in BANK_COLUMNS
        ]
        lines.append(",".join(row))
    lines.append(",".join([""] + row[1:]))
    write(tmp_path, RECIPES["banking"].files[0], "\n".join(lines) + "\n")
    train, test = load_dataset(spark, "banking", str(tmp_path))
    y, x = arrays(train)
    # 12 + 4 + 3 + 3 + 3 + 3 indicators, five of them dropped; the row with a null is gone.
    assert x.shape == (36, 23) and test.count() == 12 and set(y) == {1.0, -1.0}
    both = np.concatenate([x, arrays(test)[1]])
    # Of the jobs, the last is dropped: every other column of the first eleven holds 4 rows.
    assert both[:, :11].sum(axis=0).tolist() == [4] * 11


def test_click_log(spark, tmp_path):
    lines = []
    for i in range(60):
        numbers = [str(i % (j + 2)) if (i + j) % 5 else "" for j in range(13)]
        texts = [f"v{(i * (j + 1)) % 4}" if (i + j) % 7 else "" for j in range(25)]
        lines.append("\t".join([str(i % 2), *numbers, *texts]))
    write(tmp_path, RECIPES["clicks"].files[0], "\n".join(lines) + "\n")
    train, test = load_dataset(spark, "clicks", str(tmp_path))
    assert (train.count(), test.count()) == (40, 20)
    both = np.concatenate([arrays(train)[1], arrays(test)[1]])
    assert both.shape == (60, 38)
    np.testing.assert_allclose(both.max(axis=0) - both.min(axis=0), 1.0)
    np.testing.assert_allclose(both.mean(axis=0), 0.0, atol=1e-12)


def test_census_pair(spark, tmp_path):
    def line(i, dot):
        values = {
            "workClass": ["Private", "Private", "?", "State"][i % 4], "education": "HS",
            "marital-status": "Never" if i % 2 else "Married", "occupation": "Sales" if i % 5 else "?",
            "relationship": "Own", "race": "White", "sex": "Male" if i % 3 else "Female",
            "native-country": "US", "income": (">50K" if i % 4 == 0 else "<=50K") + dot,
        }
        return ", ".join(values.get(n, str(20 + i * (k + 1))) for k, (n, _) in enumerate(CENSUS_COLUMNS))

    train_name, test_name = RECIPES["adult"].files
    write(tmp_path, train_name, "\n".join(line(i, "") for i in range(24)) + "\n")
    write(tmp_path, test_name, "|1x3 Cross validator\n" + "\n".join(line(i, ".") for i in range(9)) + "\n")
    train, test = load_dataset(spark, "adult", str(tmp_path))
    (yt, xt), (yv, xv) = arrays(train), arrays(test)
    assert (len(yt), len(yv)) == (24, 9)
    want = [1.0 if i % 4 == 0 else -1.0 for i in range(24)]
    assert sorted(yv.tolist()) == sorted(want[:9])
    # Five numbers; of the texts only three have a second level.
    ages = 20 + np.arange(24.0)
    assert xt.shape[1] == xv.shape[1] == 5 + 3
    np.testing.assert_allclose(np.linalg.norm(xt, axis=1), 1.0)
    # Keys are digests, so rows are told by label and side of the mean.
    assert sorted(zip(yt, np.sign(xt[:, 0]))) == sorted(zip(want, np.sign(ages - ages.mean())))


def test_unknown_dataset_is_refused(spark):
    with pytest.raises(ValueError):
        load_dataset(spark, "moons", "/nowhere")


def test_click_columns_are_complete():
    assert len(CLICK_COLUMNS) == 39


def test_run_label_spells_out_the_parameters():
    from lotwise.sources.writers import run_label

    assert run_label({"lambda": 1e-4, "K": 4, "seed": 1}, "log_") == "log_la0.0001_K4_se1"


def test_keys_follow_from_content_alone(spark, tmp_path, monkeypatch):
    """Files cut at two sizes give the same keys, repeated lines included."""
    from lotwise.sources import readers

    lines = [f"{i % 9}.0 1:{i}.5 4:2.0" for i in range(300)] + ["1.0 2:3.0"] * 25 + ["", "# nothing", "7.0 1:0.5 # kept"]
    (tmp_path / "rows").write_text("\n".join(lines))
    found = []
    for size, copies in (("128m", 1 << 16), ("300", 4)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        monkeypatch.setattr(readers, "COPIES", copies)
        try:
            rows = readers.scan_libsvm(spark, str(tmp_path / "rows"), 4)
            found.append((rows.rdd.getNumPartitions(), sorted(map(repr, rows.collect()))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][1] == found[1][1] and len(found[0][1]) == 326
    keys = [r.row_id for r in rows.collect()]
    digest = hashlib.md5(b"1.0 2:3.0").hexdigest()
    assert len(set(keys)) == 326 and {f"{digest}-{i}" for i in range(25)} <= set(keys)
    assert hashlib.md5(b"7.0 1:0.5").hexdigest() + "-0" in keys
    table = spark.createDataFrame([(1, None, [1.0]), (1, None, [1.0]), (None, "x", None)], "a int, b string, c array<double>")
    assert readers.with_content_key(table).select("row_id").distinct().count() == 3


@pytest.mark.parametrize("solver, k", [("COCOA", 3), ("PSCD", 1)])
def test_training_on_content_keys(spark, tmp_path, solver, k):
    from lotwise.plans.fit import fit
    from lotwise.plans.params import RunParams
    from lotwise.sources import readers

    (tmp_path / "rows").write_text("\n".join(f"{2 * (i % 2) - 1} 1:{i / 40} 2:{(i % 7) / 7}" for i in range(40)))
    rows = readers.scan_libsvm(spark, str(tmp_path / "rows"), 2)
    got = fit(rows, "ridge", solver, RunParams(lambda_=0.1, lot_ratio=0.5, max_iter=1, out_iter=2, k=k, seed="s"), fit_intercept=False)
    long = rows.join(got.alpha[0], "row_id").select("alpha", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    sums = long.groupBy("e.indices").agg(F.sum(F.col("alpha") * F.col("e.values")).alias("v")).orderBy("indices").collect()
    assert [r.v for r in sums] == pytest.approx(list(got.shared[0]), abs=1e-9)
