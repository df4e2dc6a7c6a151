"""Byte-level BPE: texts to token ids and back, for a vocabulary file of a public tokenizer.

A text is split at special tokens and then by the vocabulary's pattern.  In a piece every symbol but
the last is a leaf of a segment tree: the rank of the merge with its right neighbour, and its place.
The root is the leftmost merge of lowest rank; a merge changes three leaves, each of which is carried
to the root in logarithmic time, until no pair can be merged.  Short pieces are merged many at a time,
one tree in each row of a matrix; a long piece has a tree of its own.

Documents are not moved: each task encodes its own, about a megabyte at a time, and remembers the ids
of words it has met.  The vocabulary travels as one broadcast of the file, whose size is checked.
"""

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import types as T

from lotwise.llm.words import pieces

#: a larger vocabulary file is refused: it is sent to every executor
MOST_BYTES = 64 << 20
#: words whose ids a task remembers; beyond that it forgets all and starts anew
REMEMBERED = 1 << 18
#: longer words are not remembered
LONG_WORD = 256
#: characters of text that are split into words at a time
BLOCK_CHARS = 1 << 20
#: pieces of up to so many bytes are merged together
FOREST = 64

# The characters of Unicode's White_Space, and the pattern of byte-level pieces.
SPACES = r"\t-\r \x85\xa0  -     　"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: a word with the space before it, or white space; pieces never cross the end of one
WORDS = rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_letters():
    """The character that stands for each byte in vocabulary files.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the characters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a byte-level BPE file in the JSON form of the tokenizers library."""

    def __init__(self, blob):
        spec = json.loads(blob)
        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens") or []
        flags = [t for t in added for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        if model["type"] != "BPE" or not byte_level or spec.get("normalizer") or odd or flags:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        letters = byte_letters()
        of_letter = {c: bytes([b]) for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        if not ids.keys() >= set(letters):
            raise ValueError("a byte-level vocabulary needs all 256 bytes")
        self.byte_ids = np.array([ids[c] for c in letters], dtype="<u4")
        self.merges = Merges([
            (ids[left], ids[right], ids[left + right])
            for left, right in (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
        ])
        table = {i: b"".join(of_letter[c] for c in token) for token, i in ids.items()}
        table.update((i, content.encode()) for content, i in self.special.items())
        self.tokens = [table.get(i, b"") for i in range(max(table) + 1)]
        self.pieces, self.words = regex.compile(PIECES), regex.compile(WORDS)
        names = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.block_end = regex.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
        self.known = {}

    def encode(self, texts):
        """Ids of each text as little-endian unsigned 32-bit integers, in bytes."""
        out, waiting, size = [], [], 0
        for text in texts:
            if size + len(text) > BLOCK_CHARS:
                out += self._encoded(waiting)
                waiting, size = [], 0
            if len(text) > BLOCK_CHARS:
                out.append(b"".join([self._encoded([block])[0] for block in self._blocks(text)]))
            else:
                waiting.append(text)
                size += len(text)
        return out + self._encoded(waiting)

    def _blocks(self, text):
        """Stretches of a long text that end before a space between two words, never inside a special token."""
        low = 0
        while low < len(text):
            found = self.block_end.search(text, low + BLOCK_CHARS) if len(text) > low + BLOCK_CHARS else None
            while found and self._cuts_special(text, found.start()):
                found = self.block_end.search(text, found.end())
            high = found.start() if found else len(text)
            yield text[low:high]
            low = high

    def _cuts_special(self, text, at):
        return any(text.find(name, max(0, at - len(name) + 1), at + len(name) - 1) >= 0 for name in self.special)

    def _encoded(self, texts):
        """Words are encoded by themselves, each different one once as long as it is remembered."""
        known, split, rare = self.known, [], []
        for text in texts:
            parts = self.at_special.split(text) if self.at_special else [text]
            split.append([self.words.findall(part) if i % 2 == 0 else part for i, part in enumerate(parts)])
        new = {w for parts in split for part in parts[::2] for w in part}.difference(known)
        cut = {word: self.pieces.findall(word) for word in new}
        ids = self._merged({p for found in cut.values() for p in found})
        for word, found in cut.items():
            known[word] = ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found])
            if len(word) > LONG_WORD:
                rare.append(word)
        out = []
        for parts in split:
            of = [
                np.uint32(self.special[part]).astype("<u4").tobytes() if i % 2 else b"".join([known[w] for w in part])
                for i, part in enumerate(parts)
            ]
            out.append(of[0] if len(of) == 1 else b"".join(of))
        if len(known) > REMEMBERED:
            known.clear()
        for word in rare:
            known.pop(word, None)
        return out

    def _merged(self, pieces):
        """Ids of each piece, in bytes."""
        found, by_size = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if len(raw) == 1:
                found[piece] = self.byte_ids[raw[0]].tobytes()
            elif len(raw) > FOREST:
                symbols = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
                found[piece] = np.array(merge_one(symbols, self.merges), dtype="<u4").tobytes()
            else:
                by_size.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, members in by_size.items():
            lengths = np.array([len(raw) for _, raw in members])
            joined = np.frombuffer(b"".join([raw.ljust(size, b"\0") for _, raw in members]), dtype=np.uint8)
            ids, ends = merge_many(self.byte_ids[joined].reshape(len(members), size).astype(np.int64), lengths, self.merges)
            blob, start = ids.astype("<u4").tobytes(), 0
            for (piece, _), end in zip(members, (4 * ends).tolist()):
                found[piece] = blob[start:end]
                start = end
        return found

    def decode(self, ids):
        """Text of an array of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] if 0 <= i < len(tokens) else b"" for i in ids.tolist()]).decode("utf-8", "replace")


NONE = 1 << 62  # no merge: above every leaf


class Merges:
    """Ranks of pairs of ids and the ids that they become, for one pair or for arrays of pairs."""

    def __init__(self, triples):
        self.of_pair = {(left, right): rank for rank, (left, right, _) in enumerate(triples)}
        self.result = np.array([new for *_, new in triples], dtype=np.int64)
        self.base = 1 + max([max(t) for t in triples], default=0)
        pairs = np.array([left * self.base + right for left, right in self.of_pair], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], NONE)
        self.ranks = np.append(np.array(list(self.of_pair.values()), dtype=np.int64)[order], 0)

    def leaves(self, left, right, size, place):
        """``rank * size + place`` of pairs of ids, NONE where they do not merge."""
        wanted = left * self.base + right
        at = np.searchsorted(self.pairs, wanted)
        known = (self.pairs[at] == wanted) & (np.maximum(left, right) < self.base)
        return np.where(known, self.ranks[at] * size + place, NONE)


def merge_one(symbols, merges):
    """Symbols of a piece after all merges.

    Leaves and nodes of the tree hold ``rank * n + place``, so the smaller one has the lower rank and,
    among equal ranks, stands further to the left.
    """
    n, ranks, result = len(symbols), merges.of_pair, merges.result.tolist()
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = array("q", [NONE]) * (2 * size)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def leaf(left, right):
        rank = ranks.get((symbols[left], symbols[right]))
        return NONE if rank is None else rank * n + left

    for i in range(n - 1):
        tree[size + i] = leaf(i, i + 1)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(place, value):
        node = size + place
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    alive = bytearray(b"\1") * n
    while tree[1] != NONE:
        rank, at = divmod(tree[1], n)
        symbols[at] = result[rank]
        gone = after[at]
        alive[gone] = 0
        after[at] = right = after[gone]
        put(gone, NONE)
        if right < n:
            before[right] = at
        put(at, leaf(at, right) if right < n else NONE)
        if before[at] >= 0:
            put(before[at], leaf(before[at], at))
    return [s for s, on in zip(symbols, alive) if on]


def merge_many(symbols, lengths, merges):
    """The same for many pieces, one in each row: their symbols in a row, and where each piece ends."""
    count, size = symbols.shape
    places = np.arange(size)
    pairs = places[:-1] < lengths[:, None] - 1
    tree = np.full((count, 2 * size), NONE, dtype=np.int64)
    leaves = merges.leaves(symbols[:, :-1], symbols[:, 1:], size, places[:-1])
    tree[:, size:-1] = np.where(pairs, leaves, NONE)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    after = np.tile(places + 1, (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))  # its last column takes what has no place
    alive = places < lengths[:, None]
    rows = np.arange(count)

    def put(rows, place, values):
        node = size + place
        tree[rows, node] = values
        while node[0] > 1:  # all leaves are equally deep
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    while True:
        root = tree[rows, 1]
        going = root != NONE
        if not going.any():
            break
        rows, root = rows[going], root[going]
        rank, at = np.divmod(root, size)
        symbols[rows, at] = merges.result[rank]
        gone = after[rows, at]
        alive[rows, gone] = False
        right = after[rows, gone]
        after[rows, at] = right
        before[rows, right] = at
        put(rows, gone, NONE)
        inside = right < lengths[rows]
        value = merges.leaves(symbols[rows, at], symbols[rows, np.minimum(right, size - 1)], size, at)
        put(rows, at, np.where(inside, value, NONE))
        left = before[rows, at]
        some = left >= 0
        if some.any():
            r, a, b = rows[some], left[some], at[some]
            put(r, a, merges.leaves(symbols[r, a], symbols[r, b], size, a))
    return symbols[alive], np.cumsum(alive.sum(axis=1))


_loaded = {}


def vocabulary(shared):
    """The vocabulary behind a broadcast file, built once per worker process."""
    blob = shared.value
    name = hash(blob)
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Vocabulary(blob)
    return _loaded[name]


def share(spark, path):
    """Reads a vocabulary file on the driver, checks its size and form, and sends it to the executors."""
    with open(path, "rb") as file:
        blob = file.read(MOST_BYTES + 1)
    if len(blob) > MOST_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MOST_BYTES} bytes")
    Vocabulary(blob)
    return spark.sparkContext.broadcast(blob)


def encode(docs, path, text="text", into="ids"):
    """``docs`` with the column ``into``: token ids (array of int) of every whole text.

    Special tokens inside a text become their ids; none is added, nothing is cut or padded.  Null and
    empty texts give an empty array.  All columns stay; one that is named like ``into`` is replaced.
    """
    shared = share(docs.sparkSession, path)
    schema, at = _with_column(docs, into, T.ArrayType(T.IntegerType(), False))
    source = docs.columns.index(text)
    return docs.mapInArrow(encoded_batches(shared, source, at, schema.names), schema)


def decode(rows, path, ids="ids", into="decoded"):
    """``rows`` with the column ``into``: the text of every array of ids, special tokens included.

    Null arrays, null ids and ids outside the vocabulary stand for no text.  All columns stay; one
    that is named like ``into`` is replaced.
    """
    shared = share(rows.sparkSession, path)
    schema, at = _with_column(rows, into, T.StringType())
    source = rows.columns.index(ids)
    return rows.mapInArrow(decoded_batches(shared, source, at, schema.names), schema)


def encoded_batches(shared, source, at, names):
    """A map over Arrow batches: a column of ids at place ``at``, made of the texts in column ``source``."""

    def run(batches):
        coder = vocabulary(shared)
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[source]):
                texts = [t or "" for t in piece.column(source).to_pylist()]
                ids = [np.frombuffer(i, dtype="<u4") for i in coder.encode(texts)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield _placed(piece, at, column, names)

    return run


def decoded_batches(shared, source, at, names):
    """A map over Arrow batches: a column of texts at place ``at``, made of the ids in column ``source``."""

    def run(batches):
        coder = vocabulary(shared)
        for batch in batches:
            texts = []
            for row in batch.column(source):
                values = row.values.drop_null() if row.is_valid else ()
                texts.append(coder.decode(values.to_numpy(zero_copy_only=False)) if len(values) else "")
            yield _placed(batch, at, pa.array(texts, pa.string()), names)

    return run


def _placed(batch, at, column, names):
    """A batch with a column put, or replaced, at a place."""
    columns = list(batch.columns)
    columns[at : at + 1] = [column]
    return pa.RecordBatch.from_arrays(columns, names)


def _with_column(df, name, kind):
    """Schema of ``df`` with a column put last, or in the place of the one of that name; and its place."""
    fields = list(df.schema.fields)
    places = [i for i, f in enumerate(fields) if f.name.lower() == name.lower()]
    at = places[0] if places else len(fields)
    fields[at : at + 1] = [T.StructField(name, kind)]
    return T.StructType(fields), at
