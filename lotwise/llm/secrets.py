"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of WINDOW and more characters of a class (hexadecimal, Base64).  A window moves
over a candidate; its sum of ``c * log2(c)`` over character counts c changes only by the character
that enters and the one that leaves, so a step counts these two.  Windows whose entropy reaches the
class's bound are united to spans; candidates of an allowed form and windows that hold an allowed
word add none.

Only DataFrame functions run, in one pass without a shuffle: positions come from the lengths of the
pieces between matches, and texts without a match stop at one test per pattern.  A candidate is read
in stretches of BLOCK window starts and what they find is joined, so that the work per character
does not depend on the candidate's length; matches are placed BLOCK at a time for the same reason.
"""

import math

from pyspark.sql import functions as F

from lotwise.llm.tables import unused

#: fixed values: the base patterns; only the first one's matches have to be tested afterwards
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{12,}"), ("hex", r"[0-9a-f]{32,}")]
ASSIGN_VALUE = 8

WINDOW = 24
SCALE = 1 << 20
#: kind, candidate pattern, least entropy of a window in bits
CLASSES = [
    ("entropy_hex", rf"[0-9A-Fa-f]{{{WINDOW},}}", 3.3),
    ("entropy_base64", rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}", 4.0),
]
BLOCK = 256
#: candidates that are no secrets: identifiers in groups, integrity digests
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    r"|^sha(1|256|384|512)-"
)
#: samples and sequences: a window that holds one of these is no secret, whatever is beside it
ALLOWED_WORDS = r"(?i:example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh)"
KINDS = [name for name, _ in BASE] + [name for name, _, _ in CLASSES]
MASK = "[secret]"
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def scan(docs, text="text"):
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end), end exclusive.

    Positions are code points; ``rank`` is the kind's place in KINDS; arrays are ordered by start,
    then rank.  ``base`` has the leftmost non-overlapping matches of each base pattern; an
    assignment needs a value of eight or more characters and one that fails is dropped, not
    searched again.  ``spans`` adds entropy spans that no base span covers.  Null and empty texts
    have none.  Rows and other columns stay, but columns of these two names are replaced.
    """
    docs = docs.drop("base", "spans")
    hits, values_, added_ = (unused(docs.columns, n) for n in ("_hits", "_values", "_added"))
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(hits, F.struct(*[_matches(value, p).alias(n) for n, p in BASE + [c[:2] for c in CLASSES]]))
    values = F.when(value.rlike(ASSIGN), F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(1)))
    found = found.withColumn(values_, values)
    base = [_base_spans(hits, values_, name, rank) for rank, (name, _) in enumerate(BASE)]
    found = found.withColumn("base", F.array_sort(F.concat(*base)).cast(_SPAN))
    added = [_entropy_spans(hits, name, len(BASE) + i, bound) for i, (name, _, bound) in enumerate(CLASSES)]
    found = found.withColumn(added_, F.concat(*added).cast(_SPAN))
    fresh = F.filter(
        added_, lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]))
    )
    found = found.withColumn("spans", F.array_sort(F.concat("base", fresh)))
    return found.drop(hits, values_, added_)


def redact(docs, text="text", size=None):
    """``docs`` with every span of its texts, overlapping ones as one, replaced by MASK.

    Null texts stay null.  ``size`` names a column that takes the new number of code points.  All
    other columns stay as they are, whatever their names.
    """
    columns = docs.columns
    raw = unused(columns, "_text")
    own = {n: unused(columns, f"_{n}") for n in columns if n.lower() in ("base", "spans")} | {text: raw}
    found = scan(docs.withColumnsRenamed(own), raw)
    value = F.col(raw)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    merged = F.aggregate(
        "spans", start,
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] < s["at"], s["done"]).otherwise(F.concat(
                s["done"], F.substring(value, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK)
            )).alias("done"),
        )),
        lambda s: F.concat(s["done"], F.substring(value, s["at"] + 1, F.length(value))),
    )
    touched = F.size("spans") > 0
    out = {c: F.col(own.get(c, c)) for c in columns}
    out[text] = F.when(touched, merged).otherwise(value)
    if size is not None:
        out[size] = F.when(touched, F.length(merged).cast(docs.schema[size].dataType)).otherwise(out[size])
    return found.select(*[value.alias(c) for c, value in out.items()])


def listed(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _matches(text, pattern):
    """(word, start) of all matches; a match starts after the pieces and matches before it."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    none = F.array().cast("array<struct<word:string,start:int>>")
    found = F.arrays_zip(words.alias("word"), F.slice(between, 1, F.size(words)).alias("gap"))
    placed = _bound(found, lambda m: F.flatten(F.transform(
        _bound(_blocks(m), lambda b: F.arrays_zip(b.alias("part"), _offsets(b).alias("at"))),
        lambda block: _placed(block["part"], block["at"], none),
    )))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _bound(value, use):
    """``use`` of a value that is evaluated once: inside a lambda other columns are evaluated per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values):
    """An array as an array of BLOCK elements each."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))


def _offsets(blocks):
    """Characters before each block."""
    sizes = F.transform(
        blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["word"]))
    )
    return F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )


def _placed(block, before, none):
    return F.aggregate(
        block,
        F.struct(before.alias("at"), none.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.length(x["word"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(x["word"].alias("word"), (s["at"] + x["gap"]).alias("start")))).alias("out"),
        ),
        lambda s: s["out"],
    )


def _span(start, rank, end):
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))


def _base_spans(column, values, name, rank):
    hits = F.col(column)[name]
    if name == "assign":
        kept = F.filter(hits, lambda _, i: F.length(F.get(F.col(values), i)) >= ASSIGN_VALUE)
    else:
        kept = hits
    return F.transform(kept, lambda m: _span(m["start"], rank, m["start"] + F.length(m["word"])))


def weighted_count(c):
    """``c * log2(c)`` as a whole number of 2**-20, so that sums do not depend on their order."""
    return round(c * math.log2(c) * SCALE) if c else 0


def _entropy_spans(column, name, rank, bound):
    limit = math.floor(WINDOW * (math.log2(WINDOW) - bound) * SCALE)
    table = F.array(*[F.lit(weighted_count(c)).cast("bigint") for c in range(WINDOW + 2)])
    candidates = F.filter(F.col(column)[name], lambda m: ~m["word"].rlike(ALLOWED))
    return F.flatten(F.transform(candidates, lambda m: _candidate(m["word"], m["start"], table, limit, rank)))


def _candidate(word, start, table, limit, rank):
    """Spans of a candidate: those of its stretches, joined where they touch."""
    stretch = f"(?=(.{{{WINDOW},{BLOCK + WINDOW - 1}}})).{{1,{BLOCK}}}"
    parts = F.regexp_extract_all(word, F.lit(stretch), F.lit(1))
    found = F.flatten(F.transform(parts, lambda part, i: _windows(part, start + i * BLOCK, table, limit, rank)))
    # ends grow along the list, so a union is told by its first and its last span
    return _bound(found, lambda spans: F.zip_with(
        F.filter(spans, lambda x, i: F.coalesce(F.get(spans, i - 1)["end"] < x["start"], F.lit(True))),
        F.filter(spans, lambda x, i: F.coalesce(F.get(spans, i + 1)["start"] > x["end"], F.lit(True))),
        lambda first, last: _span(first["start"], rank, last["end"]),
    ))


def _windows(word, start, table, limit, rank):
    """Spans of a stretch: unions of windows whose sum is at most ``limit`` and that hold no allowed word."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def step(s, i):
        held = F.least(i - 1, F.lit(WINDOW))
        before = F.substring(word, i - held, held)
        entering = _count(before, F.substring(word, i, F.lit(1)))
        grown = s["sum"] + F.get(table, entering + 1) - F.get(table, entering)
        whole = F.substring(word, i - WINDOW, F.lit(WINDOW + 1))
        leaving = _count(whole, F.substring(word, i - WINDOW, F.lit(1)))
        total = F.when(i > WINDOW, grown - F.get(table, leaving) + F.get(table, leaving - 1)).otherwise(grown)
        window = F.substring(word, i - WINDOW + 1, F.lit(WINDOW))
        hit = (i >= WINDOW) & (total <= limit) & ~window.rlike(ALLOWED_WORDS)
        low, high = start + i - WINDOW, start + i
        joins = F.coalesce(F.try_element_at(s["out"], F.lit(-1))["end"] >= low, F.lit(False))
        longer = F.concat(
            F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1),
            F.array(F.struct(F.try_element_at(s["out"], F.lit(-1))["start"].alias("start"), F.lit(rank).alias("rank"), high.alias("end"))),
        )
        fresh = F.concat(s["out"], F.array(_span(low, rank, high)))
        out = F.when(hit & joins, longer).when(hit, fresh).otherwise(s["out"])
        return F.struct(total.alias("sum"), out.alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda s: s["out"])


def _count(text, char):
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))
