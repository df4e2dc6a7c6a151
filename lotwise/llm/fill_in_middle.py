"""Fill-in-the-middle: texts rearranged so that a model learns to fill a gap.

A text is cut into n units (code points unless told otherwise).  Two hashed draws give the places a
and b of the cuts; one match of a pattern made for the row, with the possessive counted groups
``unit{a}`` and ``unit{b-a}``, captures prefix, middle and suffix and writes them in their new order.
Possessive groups never give back what they took, so a match is one walk over the text.

All of it is DataFrame functions on the row itself: nothing is moved.
"""

import re

from pyspark.sql import functions as F

from lotwise.llm.tables import unused

#: one code point, line ends included
CODE_POINT = "(?s:.)"
#: before prefix, suffix and middle
SENTINELS = ("<P>", "<S>", "<M>")
#: units that are counted at a time
BLOCK = 4096


def rearrange(
    docs, seed=1, unit=CODE_POINT, plain_percent=10, spm_percent=20, sentinels=SENTINELS,
    key="doc_id", text="text", into="fim",
):
    """``docs`` with the struct column ``into``: ``n``, ``form``, ``prefix``, ``middle``, ``output``.

    ``n`` counts the units of the whole text; ``prefix`` and ``middle`` are sizes in units, null for
    the form ``plain``, whose output is the text as it is.  Plain are ``plain_percent`` of the rows,
    empty and null texts (output: empty), texts that hold a sentinel, and texts that ``unit``, matched
    over and over from the start, does not cover to the end.  Of the others ``spm_percent`` are
    ``spm`` (suffix, prefix, middle), the rest ``psm`` (prefix, suffix, middle).

    Draws depend on seed and ``key`` alone (a null key draws as an empty one), so repeated rows are
    treated alike.  All columns stay; one that is named like ``into`` is replaced.
    """
    check_sentinels(sentinels)
    own = unused(docs.columns, "_work")
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.withColumn(own, F.struct(sha.alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("body")))
    whole = F.struct(f"{own}.*", unit_count(F.col(f"{own}.body"), unit).alias("units"))
    rows = rows.withColumn(own, whole)
    draw = [F.conv(F.substring(f"{own}.sha", at, 8), 16, 10).cast("bigint") for at in (1, 9, 17, 25)]
    body, n = F.col(f"{own}.body"), F.col(f"{own}.units")
    kept = (n == 0) | (draw[2] % 100 >= 100 - plain_percent)
    for mark in sentinels:
        kept = kept | F.contains(body, F.lit(mark))
    if unit != CODE_POINT:
        kept = kept | ~body.rlike(rf"\A(?:{unit})*+\z")
    form = F.when(kept, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    places = [draw[i] % (n + 1) for i in (0, 1)]
    rows = rows.withColumn(own, F.struct(
        f"{own}.*", F.least(*places).alias("low"), F.greatest(*places).alias("high"), form.alias("form"),
    ))
    low, high, form = (F.col(f"{own}.{c}") for c in ("low", "high", "form"))
    moved = form != "plain"
    one_match = F.concat(
        F.lit(rf"\A(?<prefix>(?:{unit}){{"), low, F.lit(rf"}}+)(?<middle>(?:{unit}){{"), high - low,
        F.lit(r"}+)(?<suffix>(?s:.*+))"),
    )
    order = F.when(form == "psm", _replacement(sentinels, "psm")).otherwise(_replacement(sentinels, "spm"))
    done = F.struct(
        n.alias("n"), form.alias("form"), F.when(moved, low).alias("prefix"),
        F.when(moved, high - low).alias("middle"),
        F.when(moved, F.regexp_replace(body, one_match, order)).otherwise(body).alias("output"),
    )
    return rows.withColumn(into, done).drop(own)


def restored(output, form, sentinels=SENTINELS):
    """The text behind a rearranged ``output`` of the given ``form``, as a column."""
    parts = F.split(output, "|".join(rf"\Q{mark}\E" for mark in sentinels), 4)
    prefix, suffix = (F.get(parts, F.when(form == "psm", one).otherwise(other)) for one, other in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def unit_count(body, unit=CODE_POINT):
    """Number of units of a text.

    Blocks of BLOCK units are taken first, so that what is listed at a time is as long as the text at
    most, and only the last block is counted unit by unit.  Units with gaps between them are counted
    one by one.
    """
    blocks = F.regexp_extract_all(body, F.lit(f"(?:{unit}){{1,{BLOCK}}}+"), F.lit(0))
    last = F.regexp_count(F.element_at(blocks, -1), F.lit(unit))
    count = F.when(F.size(blocks) == 0, 0).otherwise((F.size(blocks) - 1) * BLOCK + last)
    if unit != CODE_POINT:
        covered = body.rlike(rf"\A(?:{unit})*+\z")
        count = F.when(covered, count).otherwise(F.regexp_count(body, F.lit(unit)))
    return count.cast("bigint")


def check_sentinels(sentinels):
    """Sentinels must be told apart wherever they stand: their first character opens sentinels only."""
    firsts = {mark[:1] for mark in sentinels}
    if len(sentinels) != 3 or "" in firsts or any(c in mark[1:] for mark in sentinels for c in firsts):
        raise ValueError("three sentinels are needed, whose first characters occur nowhere else in them")
    if any(a != b and b.startswith(a) for a in sentinels for b in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("no sentinel may begin another")


def _replacement(sentinels, form):
    marks = dict(zip("psm", (re.sub(r"([\\$])", r"\\\1", mark) for mark in sentinels)))
    groups = {"p": "${prefix}", "s": "${suffix}", "m": "${middle}"}
    return "".join(marks[c] + groups[c] for c in form)
