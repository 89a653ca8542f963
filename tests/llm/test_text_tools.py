import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fraglake.llm import _text, _tokens

texts = st.lists(st.text(alphabet=st.sampled_from("aB é\n\t.,0*漢"), max_size=40), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 60))
def test_spans_are_the_words_of_each_text(rows, limit):
    found = []
    for w in _text.windows(pa.array(rows, type=pa.string()), limit):
        starts, ends, first = _text.spans(_text.NOT_SPACE[w.data], w.offsets)
        raw = w.data.tobytes()
        found += [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in rows]


def test_hashes_of_equal_spans_are_equal_wherever_they_stand():
    data = np.frombuffer(b"abc xabc abd", dtype=np.uint8)
    h = _text.SpanHash(data)(np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] != h[2]
    assert _text.hash_words([b"abc"])[0] == h[0]


def test_nulls_and_slices():
    column = pa.array(["x", None, "", "yz"])[1:]
    assert [w.data.tobytes() for w in _text.windows(column, 100)] == [b"yz"]
    assert list(_text.windows(pa.array([], type=pa.string()))) == []


def equal(a, b):
    return [x.tolist() for x in a] == [x.tolist() for x in b]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abs' \n\t. \u3000\x1c9é\0<|>,"), max_size=30), max_size=6))
def test_pieces_encode_like_whole_texts(rows):
    encoder = _tokens.encoder(_tokens.vocabulary_path())
    assert equal(encoder.encode(rows), encoder._raw(rows))


def test_encoding_survives_turnover_of_the_cache():
    encoder = _tokens.PieceEncoder(_tokens.vocabulary_path(), cache_pieces=3)
    rows = [f"w{i} w{i % 5} again and again" for i in range(40)]
    for i in range(0, 40, 4):
        assert equal(encoder.encode(rows[i : i + 4]), encoder._raw(rows[i : i + 4]))


def test_long_pieces_and_long_texts(monkeypatch):
    encoder = _tokens.PieceEncoder(_tokens.vocabulary_path())
    rows = ["x" * 23 + " " + "y" * 24 + " " + "é" * 12 + " " + "z" * 300, " ".join(f"word{i}," for i in range(3000)), "<|endoftext|> a<|endoftext|>b|, don't!'s it's,'s x|y", "", "w" * 9000]
    assert equal(encoder.encode(rows), encoder._raw(rows))
    monkeypatch.setattr(_text, "WINDOW_BYTES", 500)
    assert equal(encoder.encode_window(np.frombuffer(rows[1].encode(), dtype=np.uint8), np.array([0, len(rows[1])])), encoder._raw(rows[1:2]))
