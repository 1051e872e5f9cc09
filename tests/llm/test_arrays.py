from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.arrays import chunks, rolled, sliding_min, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é한\t\n\x0b\x0c\r\x1c\x85   ", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words(texts, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    words = words_of(column)
    data = words.data.tobytes()
    for r, text in enumerate(texts[skip:]):
        found = [data[words.at[k] : words.at[k + 1] - 1].decode() for k in range(words.rows[r], words.rows[r + 1])]
        assert found == WORD.findall(text or "")
    ids, different = words.encoded()
    assert len(different) == len({w for t in texts[skip:] for w in WORD.findall(t or "")}) and len(ids) == len(words)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_chunks_are_the_batch(texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    assert [x for part in chunks(batch, "text", most) for x in part.column("text").to_pylist()] == texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_sliding_min(values, width):
    x = np.array(values, np.int64)
    assert sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_rolled_tells_orders_apart():
    x = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    h = rolled(x, 3).tolist()
    assert h[0] == h[3] and h[0] != h[6] and rolled(x[:2], 3).tolist() == []
