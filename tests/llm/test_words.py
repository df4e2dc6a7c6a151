import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import words as module
from lotwise.llm.words import Words, pieces, sliding


@pytest.mark.parametrize("seed", range(20))
def test_words_and_runs_match_regular_expressions(seed, monkeypatch):
    monkeypatch.setattr(module, "CHUNK_BYTES", 37)
    random.seed(seed)
    docs = [
        None if random.random() < 0.1 else "".join(random.choice("ab \n\té") for _ in range(random.choice([0, 1, 5, 50, 200])))
        for _ in range(random.randint(0, 6))
    ]
    words = Words.of(pa.array(docs, pa.string()))
    expected = [re.findall(rb"[^\x20\x09-\x0d]+", (d or "").encode()) for d in docs]
    got = [[bytes(words.data[s:e]) for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first, words.first[1:])]
    assert got == expected
    names = {}
    for word, name in zip([w for d in expected for w in d], words.name.tolist()):
        assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)
    at, runs = words.runs(3)
    flat = [(i, j) for i, d in enumerate(expected) for j in range(max(0, len(d) - 2))]
    assert [words.first[i] + j for i, j in flat] == at.tolist()
    seen = {}
    for (i, j), name in zip(flat, runs.tolist()):
        assert seen.setdefault(tuple(expected[i][j : j + 3]), name) == name
    assert len(set(seen.values())) == len(seen)


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (0, 5, 900, 3, 0, 40)])], ["text"])
    parts = list(pieces(batch, limit=20))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16])
def test_sliding(width):
    x = np.random.default_rng(width).integers(0, 99, 50)
    assert sliding(x, width, np.minimum).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]
