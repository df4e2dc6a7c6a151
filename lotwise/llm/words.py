"""Words of many documents as NumPy arrays: positions and 64-bit names, without a loop per word.

A word is a run of bytes other than space and 0x09-0x0D, so UTF-8 text is never decoded.  Names
are polynomial fingerprints modulo 2**64, finished with a bit mixer; a sequence of words is named
by the same polynomial over the names of its words, from prefix sums.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

PIECE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and whatever is not ASCII
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def take(self, n):
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base, size):
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        return np.cumprod(table, dtype=np.uint64)


_BYTE_POWERS, _WORD_POWERS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x):
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of several documents in order.

    ``data`` bytes of all documents; ``start``/``end`` byte range of each word; ``name`` its 64-bit
    name; ``first`` index of each document's first word, with the total count appended.
    """

    def __init__(self, data, offsets, of_word=NOT_SPACE):
        self.data = data
        starts, ends, names = [], [], []
        for low, high in _chunks(data, offsets, of_word):
            s, e, h = _scan(data, low, high, offsets, of_word)
            starts.append(s)
            ends.append(e)
            names.append(h)
        empty = np.zeros(0, dtype=np.int64)
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.name = np.concatenate(names) if names else empty.astype(np.uint64)
        self.first = np.searchsorted(self.start, offsets)

    @classmethod
    def of(cls, texts, of_word=NOT_SPACE):
        """Words of an Arrow string array, made of the bytes flagged in ``of_word``; nulls have none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if data is None or not len(texts) or offsets[-1] == offsets[0]:
            return cls(np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64), of_word)
        view = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        return cls(view, offsets - offsets[0], of_word)

    def counts(self):
        return np.diff(self.first)

    def document(self):
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def runs(self, k):
        """(index of first word, name) of every run of k words inside one document."""
        n = len(self.name)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = self.run_starts(k)
        return at, self.run_names(k)[at]

    def run_starts(self, k):
        """Indexes of words at which k words of the same document begin."""
        n = len(self.name)
        inside = np.zeros(n + 1, dtype=np.int32)
        counts = self.counts()
        long = counts >= k
        np.add.at(inside, self.first[:-1][long], 1)
        np.add.at(inside, self.first[:-1][long] + counts[long] - k + 1, -1)
        return np.flatnonzero(np.cumsum(inside[:n]))

    def run_names(self, k):
        """Names of k words from each word on, also across documents; the last k-1 are missing."""
        n = len(self.name)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        up, down = _WORD_POWERS.take(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.name * up, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))

    def text(self, keep, at):
        """Bytes of document ``at`` with the words flagged in ``keep``, joined by one space."""
        low, high = self.first[at], self.first[at + 1]
        chosen = np.flatnonzero(keep[low:high]) + low
        data = self.data.data if self.data.flags.c_contiguous else memoryview(self.data.tobytes())
        return b" ".join([data[s:e] for s, e in zip(self.start[chosen].tolist(), self.end[chosen].tolist())])


def _chunks(data, offsets, of_word):
    """Ranges of about CHUNK_BYTES that begin and end outside words."""
    low, n = 0, len(data)
    while low < n:
        high = low + CHUNK_BYTES
        if high >= n:
            high = n
        else:
            step = 4096
            while high < n:
                gap = np.flatnonzero(~of_word[data[high : high + step]])
                nearest = int(gap[0]) + high if len(gap) else min(high + step, n)
                after = np.searchsorted(offsets, high)
                if after < len(offsets) and offsets[after] <= nearest:
                    high = int(offsets[after])
                    break
                high = nearest
                if len(gap):
                    break
        yield low, high
        low = high


def _scan(data, low, high, offsets, of_word):
    piece = data[low:high]
    word = of_word[piece]
    cuts = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high, "left")] - low
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    begins = word & ~before
    begins[cuts] = word[cuts]
    stops = np.zeros(len(word) + 1, dtype=bool)
    stops[:-1] = before & ~word
    stops[cuts] |= before[cuts]
    stops[-1] = word[-1] if len(word) else False
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = _BYTE_POWERS.take(len(piece))
    sums = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    names = mix((sums[end] - sums[start]) * down[start])
    return start + low, end + low, names


def pieces(batch, column="text", limit=PIECE_BYTES):
    """Slices of a record batch whose texts hold about ``limit`` bytes (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float))
    group = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def sliding(x, width, best):
    """``best`` (np.minimum or np.maximum) over ``width`` values from each position on."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out
