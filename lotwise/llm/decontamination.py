"""Benchmark decontamination: test items inside documents with a budget of edits.

An item of m characters may differ in up to ``rate * m`` of them.  It is cut into one piece more
than its budget: wherever it occurs, at least one piece occurs unchanged (pigeonhole).  Pieces of a
block of items are found together in one automaton pass; a hit is checked upwards, first with the
pieces beside it (p pieces may hold p - 1 edits), at last as the whole item, each time by Myers'
bit-parallel distance.

Documents are never moved: each task reads its own.  Items are taken in blocks of bounded size,
each of which is one more pass over the documents.
"""

import bisect
import heapq

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

RATE = 0.08
BLOCK_BYTES = 500_000

_MATCH = "doc_id bigint, item_id bigint, distance int, budget int, start int, end int"
_KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
_TABLE = bytes(i if i in _KEPT else 32 for i in range(256))


def normalise(text):
    """Lower case; runs of ASCII characters other than letters and digits become one space."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()).decode()


def matches(docs, items, rate=RATE, key="doc_id", text="text", item_key="item_id", item_text="text"):
    """One row per place of a document that holds an item.

    Columns: ``key``, ``item_key``, ``distance``, ``budget``, ``start``, ``end``; places are
    characters of the normalised text, and of overlapping places of one item the best is reported
    (then the first).  Items without a budget match whole words only.  Null texts and items, and
    those without letters or digits, match nothing.  Repeated rows and items are reported each.
    Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in _blocks(items, item_key, item_text):
        part = rows.mapInArrow(_finder(block, rate), _MATCH)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _MATCH)
    return found.withColumnsRenamed({"doc_id": key, "item_id": item_key})


def without_matches(docs, items, rate=RATE, text="text", item_key="item_id", item_text="text"):
    """``docs`` without the rows that hold an item; all columns stay as they are."""
    for block in _blocks(items, item_key, item_text):
        docs = docs.mapInArrow(_filter(block, rate, docs.columns.index(text)), docs.schema)
    return docs


def _blocks(items, key, text):
    """Lists of (key, normalised text); a block is about BLOCK_BYTES, or one item."""
    rows = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for number in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        block = [(r.item_id, normalise(r.text)) for r in part.collect()]
        yield [(i, t) for i, t in block if t]


class _Item:
    """An item, its pieces and the masks of its characters for every level of checking."""

    def __init__(self, key, text, rate):
        self.key, self.budget = key, int(rate * len(text))
        self.text = text if self.budget else f" {text} "
        n = self.budget + 1
        self.cuts = [len(self.text) * i // n for i in range(n + 1)]
        self.patterns = {}

    def pattern(self, low, high):
        """The pieces from ``low`` to ``high`` as a Myers pattern."""
        if (low, high) not in self.patterns:
            self.patterns[low, high] = Myers(self.text[self.cuts[low] : self.cuts[high]])
        return self.patterns[low, high]

    def survives(self, text, piece, at):
        """Whether the pieces around a hit, two, four and so on, fit in their share of the budget."""
        n, width = self.budget + 1, 2
        while width < n:
            low = piece // width * width
            high = min(low + width, n)
            if high - low > 1 and not self._near(text, low, high, piece, at):
                return False
            width *= 2
        return True

    def _near(self, text, low, high, piece, at):
        budget = high - low - 1
        start = at - (self.cuts[piece] - self.cuts[low]) - budget
        end = at + (self.cuts[high] - self.cuts[piece]) + budget
        return self.pattern(low, high).best(text, max(start, 0), end)[0] <= budget


class Myers:
    """Bit-parallel edit distance of a pattern to the best matching stretch of a text."""

    def __init__(self, pattern):
        self.pattern, self.size, self.masks = pattern, len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distances(self, text, low, high):
        """The distance of the best stretch of ``text[low:high]`` that ends after each character."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = full, 0, self.size
        masks, out = self.masks, []
        for c in text[low:high]:
            same = masks.get(c, 0)
            vertical = same | minus
            diagonal = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            out.append(score)
        return out

    def best(self, text, low, high):
        """(distance, end) of the best stretch within ``text[low:high]``, the first among equals."""
        found = self.distances(text, low, high)
        least = min(found, default=self.size)
        return (least, low + 1 + found.index(least)) if least < self.size else (self.size, low)


class _Search:
    """The automaton of all pieces of a block of items."""

    def __init__(self, block, rate):
        self.items = [_Item(key, text, rate) for key, text in block]
        places = {}
        for i, item in enumerate(self.items):
            for piece, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                places.setdefault(item.text[a:b], []).append((i, piece))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, raw):
        """(item, distance, start, end) of every place of an item in a text."""
        text = f" {normalise(raw)} "
        if not self.items or len(text) == 2:
            return []
        windows = {}
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for i, piece in where:
                item = self.items[i]
                start = at - item.cuts[piece] - item.budget
                end = start + len(item.text) + 2 * item.budget
                known = windows.setdefault(i, [])
                if known and known[-1][0] <= start and end <= known[-1][1]:
                    continue
                if item.survives(text, piece, at):
                    known.append((max(start, 0), end))
        found = []
        for i, ranges in windows.items():
            item = self.items[i]
            for low, high in _merged(ranges):
                found += self._verify(item, text, low, high)
        return found

    def _verify(self, item, text, low, high):
        """Places within a range that do not overlap, taken from the best (then the first) on.

        One pass gives the distance at every end.  A taken place changes only distances of
        stretches that would begin before its end, which are computed anew: as many characters as
        an item and its budget have.
        """
        pattern, reverse = item.pattern(0, item.budget + 1), Myers(item.text[::-1])
        reach = len(item.text) + item.budget
        high = min(high, len(text))
        at_end = dict(_within(pattern.distances(text, low, high), low, item.budget))
        queue = [(distance, end) for end, distance in at_end.items()]
        heapq.heapify(queue)
        starts, ends, out = [], [], []
        while queue:
            distance, end = heapq.heappop(queue)
            if at_end.get(end) != distance:
                continue
            place = bisect.bisect_left(starts, end)
            floor = ends[place - 1] if place else low
            back = text[max(floor, end - reach) : end][::-1]
            start = end - reverse.best(back, 0, len(back))[1]
            ceiling = starts[place] if place < len(starts) else high
            starts.insert(place, start)
            ends.insert(place, end)
            out.append((item, distance, start - 1, end - 1))
            upto = min(end + reach, ceiling)
            for gone in range(start + 1, upto + 1):
                at_end.pop(gone, None)
            for late, anew in _within(pattern.distances(text, end, upto), end, item.budget):
                at_end[late] = anew
                heapq.heappush(queue, (anew, late))
        return sorted(out, key=lambda found: found[2])


def _within(distances, low, budget):
    """(end, distance) where the distance is within the budget."""
    return [(end, d) for end, d in enumerate(distances, low + 1) if d <= budget]


def _merged(ranges):
    out = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _finder(block, rate):
    def find(batches):
        search = _Search(block, rate)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [
                (key, item.key, distance, item.budget, start, end)
                for key, text in zip(keys, batch.column(1))
                for item, distance, start, end in search.find(text.as_py())
            ]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            names = ["doc_id", "item_id", "distance", "budget", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return find


def _filter(block, rate, text):
    def keep(batches):
        search = _Search(block, rate)
        for batch in batches:
            clean = pa.array([not search.find(t.as_py()) for t in batch.column(text)], pa.bool_())
            yield batch.filter(clean)

    return keep
