"""Dataset recipes: where the files are, how they are read, and which operators follow.

A recipe is data.  ``steps`` names the operators in order; each step takes and returns the pair
(train, test).  A new table needs an entry here, or a ``Recipe`` of its own, and no code.
"""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from lotwise.operators import clean, encode, scale, split
from lotwise.sources import readers
from lotwise.sources.scratch import commit, scratch_path

# Columns of the census files, in file order, and the roles the recipe gives them.
CENSUS_COLUMNS = [
    ("age", "int"), ("workClass", "string"), ("fnlwgt", "int"), ("education", "string"),
    ("education-num", "int"), ("marital-status", "string"), ("occupation", "string"),
    ("relationship", "string"), ("race", "string"), ("sex", "string"), ("capital-gain", "int"),
    ("capital-loss", "int"), ("hours-per-week", "int"), ("native-country", "string"),
    ("income", "string"),
]
CENSUS_DROPPED = ["fnlwgt", "education"]
CENSUS_IMPUTED = ["workClass", "occupation", "native-country"]
CENSUS_LOW_INCOME = ["<=50K", "<=50K."]

# Columns of the bank marketing file, in file order, and the positions left out.
BANK_COLUMNS = [
    ("age", "int"), ("job", "string"), ("marital", "string"), ("education", "string"),
    ("default", "string"), ("housing", "string"), ("loan", "string"), ("contact", "string"),
    ("month", "string"), ("day_of_week", "string"), ("duration", "int"), ("campaign", "int"),
    ("pdays", "int"), ("previous", "int"), ("poutcome", "string"), ("emp_var_rate", "double"),
    ("cons_price_idx", "double"), ("cons_conf_idx", "double"), ("euribor3m", "double"),
    ("nr_employed", "double"), ("y", "int"),
]
BANK_DROPPED = [0, 3, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19]
BANK_ENCODED = ["job", "marital", "default", "housing", "loan", "poutcome"]
BANK_DROPPED_INDICATORS = [12, 16, 18, 21, 24]

# The click log has a label, 13 numbers and 25 texts.
CLICK_COLUMNS = (
    [("y", "double")] + [(f"n{i}", "double") for i in range(1, 14)]
    + [(f"c{i}", "string") for i in range(14, 39)]
)
CLICK_POSITIVES = 2000


@dataclass(frozen=True)
class Recipe:
    """``files`` are names below the dataset root; one file is split, two are train and test."""

    files: tuple
    width: int = 0
    read: str = "libsvm"
    steps: tuple = ()
    split: tuple = ()
    options: dict = field(default_factory=dict)


def _both(operator):
    return lambda pair, *args: tuple(operator(side, *args) for side in pair)


STEPS = {
    "labels_from": _both(lambda df, positive: clean.remap_label(df, float(positive))),
    "nonzero_labels": _both(lambda df: clean.remap_label(df, F.col("y") != 0)),
    "keep_features": _both(clean.keep_features),
    "to_dense": _both(encode.to_dense),
    "pad_features": _both(encode.pad_features),
    "row_l2_normalize": _both(scale.row_l2_normalize),
    "col_l1_normalize": _both(scale.col_l1_normalize),
    "max_abs_scale": lambda pair: tuple(scale.max_abs_scale(pair[0], side) for side in pair),
    "standard_scale_each": lambda pair: scale.standard_scale_each(*pair),
    "center_target": lambda pair: scale.center_target(*pair),
}

SCALED = (("max_abs_scale",), ("row_l2_normalize",))
REGRESSION = (("center_target",), *SCALED)

# File names, widths, test shares, seeds and the order of steps.  News and report
# texts stay in the sparse layout; their vectors are too wide to be written out in full.
RECIPES = {
    "iris": Recipe(("iris.csv",), 4, "table",
                   (("keep_features", 2), ("nonzero_labels",)), (0.2, "iris")),
    "breastcancer": Recipe(("breast_cancer.csv",), 30, "table",
                           (("labels_from", 1), ("standard_scale_each",), ("row_l2_normalize",)),
                           (0.2, 42)),
    "diabetes": Recipe(("diabetes.csv",), 10, "table", (("standard_scale_each",),), ("tail", 20)),
    "higgs": Recipe(("higgs/HIGGS",), 28, "libsvm", (("col_l1_normalize",),), (0.25, 42)),
    "phishing": Recipe(("phishing/phishing",), 68, "libsvm",
                       (("to_dense",), ("labels_from", 1), *SCALED), (0.25, 42)),
    "mushrooms": Recipe(("mushrooms/mushrooms",), 112, "libsvm",
                        (("to_dense",), ("labels_from", 1), *SCALED), (0.25, 42)),
    "epsilon": Recipe(("epsilon/epsilon_normalized", "epsilon/epsilon_normalized.t"), 2000,
                      "libsvm", (("to_dense",),)),
    "banking": Recipe(("bank_marketing/banking.csv",), 0, "bank", (), (0.25, 0)),
    "news20": Recipe(("news20/news20.binary",), 1355191, "libsvm", SCALED, (0.25, 42)),
    "news20small": Recipe(("news20/news20small",), 1355191, "libsvm", SCALED, (0.2, 42)),
    "cpusmall": Recipe(("cpusmall/cpusmall",), 12, "libsvm",
                       (("to_dense",), *REGRESSION), (0.25, 42)),
    "abalone": Recipe(("abalone/abalone",), 8, "libsvm",
                      (("to_dense",), *REGRESSION), (0.25, 42)),
    "cadata": Recipe(("cadata/cadata",), 8, "libsvm",
                     (("to_dense",), *REGRESSION), (0.25, 42)),
    "msd": Recipe(("yearPredictionMSD/YearPredictionMSD", "yearPredictionMSD/YearPredictionMSD.t"),
                  90, "libsvm", (("to_dense",), *REGRESSION)),
    "E2006": Recipe(("E2006/E2006.train", "E2006/E2006.test"), 150360, "libsvm", REGRESSION),
    "E2006small": Recipe(("E2006/E2006.small",), 150360, "libsvm", (), (0.25, 42)),
    "adult": Recipe(("adult/adult.data", "adult/adult.test"), 0, "census"),
    "clicks": Recipe(("dac_sample.txt",), 0, "clicks", (), (0.33, 4)),
}


def apply_steps(pair, steps):
    for name, *args in steps:
        pair = STEPS[name](pair, *args)
    return pair


def split_pair(df, rule):
    share, seed = rule
    return split.tail_split(df, seed) if share == "tail" else split.train_test_split(df, share, seed)


def _committed(spark, df, name):
    """File rows are read and keyed once; all later steps read the written table."""
    return commit(df, scratch_path(spark, name))


def _libsvm(spark, paths, recipe):
    return [readers.scan_libsvm(spark, p, recipe.width) for p in paths]


def _table(spark, paths, recipe):
    names = [f"f{i}" for i in range(recipe.width)]
    schema = readers.struct_of([(n, "double") for n in [*names, "y"]])
    raw = readers.scan_csv(spark, paths[0], schema, header=True)
    # The last rows of a file are told by their order in it, everything else by what rows say.
    keyed = readers.with_row_id(raw) if recipe.split[0] == "tail" else readers.with_content_key(raw)
    return [encode.assemble(keyed, names, [])]


def load_bank(spark, path):
    """Bank marketing: drop nulls and columns, encode, drop a level of most categories."""
    raw = readers.scan_csv(spark, path, readers.struct_of(BANK_COLUMNS), header=True)
    kept = clean.drop_columns(clean.drop_nulls(raw), BANK_DROPPED)
    # Counted with the label as column 0: number 1 is the first indicator.
    coded = encode.one_hot(kept, BANK_ENCODED)
    coded = clean.drop_columns(coded, BANK_DROPPED_INDICATORS)
    names = [c for c in coded.columns if c != "y"]
    rows = readers.with_content_key(coded.withColumn("y", F.col("y").cast("double")))
    return clean.remap_label(encode.assemble(rows, [], names), 1.0)


def load_clicks(spark, path):
    """Click log: nulls to 0, texts to codes, 2,000 positives, range scaling before the split."""
    raw = readers.with_row_id(readers.scan_tsv(spark, path, readers.struct_of(CLICK_COLUMNS)))
    filled = clean.fill_constant(raw, 0)
    texts = [n for n, kind in CLICK_COLUMNS if kind == "string"]
    numbers = [n for n, kind in CLICK_COLUMNS if kind == "double" and n != "y"]
    coded = encode.category_codes(_committed(spark, filled, "clicks"), texts)
    fewer = split.unbalance_classes(coded, CLICK_POSITIVES)
    fewer = readers.with_content_key(_committed(spark, fewer.drop("row_id"), "clicks-kept"))
    rows = scale.mean_range_normalize(encode.assemble(fewer, numbers, texts))
    return clean.remap_label(rows, 1.0)


def load_census(spark, train_path, test_path):
    """Census: scaled numbers and frequency-coded categories, imputed, then max-abs and unit rows.

    Numbers and modes of the test file come from the test file itself; category order comes from
    both files.
    """
    schema = readers.struct_of(CENSUS_COLUMNS)
    sides = [
        readers.scan_csv(spark, train_path, schema, header=False, null_value="?"),
        readers.scan_csv(spark, test_path, schema, header=True, null_value="?"),
    ]
    low = F.trim("income").isin(*CENSUS_LOW_INCOME)
    sides = [
        _committed(spark, readers.with_content_key(
            clean.drop_columns(s, CENSUS_DROPPED)
            .withColumn("y", F.when(low, F.lit(-1.0)).otherwise(F.lit(1.0))).drop("income")
        ), "census")
        for s in sides
    ]
    numbers = [c for c in clean.columns_of_type(sides[0], "int") if c != "row_id"]
    texts = [c for c in clean.columns_of_type(sides[0], "string") if c != "row_id"]
    filled = [clean.fill_mode(s, CENSUS_IMPUTED) for s in sides]
    # Category order counts the values as read, before imputation.
    counts = encode.level_counts(sides[0].select(*texts).unionByName(sides[1].select(*texts)), texts)
    marked = encode.one_hot_freq(*filled, texts, drop_first=True, counts=counts)
    out = []
    for frame in marked:
        names = [c for c in frame.columns if c not in ("row_id", "y", *numbers)]
        numeric = scale.standard_scale(
            encode.assemble(frame, numbers, []), encode.assemble(frame, numbers, names).select(
                "row_id", "y", F.slice("features", 1, len(numbers)).alias("features"),
                F.slice("features", len(numbers) + 1, max(1, len(names))).alias("_marks"),
            )
        )
        joined = F.concat("features", "_marks")
        out.append(numeric.withColumn("features", joined).drop("_marks"))
    return apply_steps(tuple(out), SCALED)


def load_dataset(spark, name, root, suffix=""):
    """Train and test frames of a named recipe; files lie below ``root``.

    ``suffix`` is added to file names, for example ``.bz2``.  Unknown names raise.
    """
    if name not in RECIPES:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(RECIPES)}")
    recipe = RECIPES[name]
    paths = [f"{root.rstrip('/')}/{f}{suffix}" for f in recipe.files]
    if recipe.read == "census":
        return load_census(spark, *paths)
    if recipe.read == "bank":
        return split_pair(_committed(spark, load_bank(spark, paths[0]), "bank"), recipe.split)
    if recipe.read == "clicks":
        return split_pair(_committed(spark, load_clicks(spark, paths[0]), "clicks"), recipe.split)
    frames = {"libsvm": _libsvm, "table": _table}[recipe.read](spark, paths, recipe)
    frames = [_committed(spark, f, name) for f in frames]
    # A single file is split by its keys before scaling, a pair is used as it is.
    pair = split_pair(frames[0], recipe.split) if len(frames) == 1 else tuple(frames)
    return apply_steps(pair, recipe.steps)
