import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import blocks, suffixes, textcodes
from foliant.llm.substring import COVER, PERIOD, is_cover

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té漢\x0b\x85 ", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    data = [None if t is None else t.encode() for t in texts]
    buf, offsets = textcodes.join_texts(data)
    starts, ends = textcodes.word_spans(buf)
    words = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    codes = textcodes.span_hashes(buf, starts, ends)
    assert len(set(zip(words, codes.tolist(), strict=True))) == len(set(words)) == len(set(codes.tolist()))
    doc = textcodes.owner(offsets, starts)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    windows = textcodes.window_hashes(codes, 3)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert len(set(zip(grams, windows.tolist(), strict=True))) == len(set(grams)) == len(set(windows.tolist()))


def test_hashes_dont_depend_on_slices(monkeypatch):
    buf, _ = textcodes.join_texts([b"some words of a text " * 50])
    starts, ends = textcodes.word_spans(buf)
    whole = textcodes.span_hashes(buf, starts, ends), textcodes.window_hashes(textcodes.span_hashes(buf, starts, ends), 5)
    monkeypatch.setattr(textcodes, "SLICE", 17)
    again = textcodes.span_hashes(buf, starts, ends), textcodes.window_hashes(textcodes.span_hashes(buf, starts, ends), 5)
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_packing_and_cells(keys, n):
    keys = np.unique(np.array(keys, np.uint64))
    (data,) = blocks.expand(blocks.squeeze(blocks.pack_sorted(keys)))
    assert (blocks.unpack_sorted(data) == keys).all()
    parts = list(blocks.cells(keys, n))
    assert sum(s.stop - s.start for _, s in parts) == len(keys) and all(b < n for b, _ in parts)


@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=12), st.sampled_from([2, 7, 20]))
@settings(max_examples=150, deadline=None)
def test_suffix_lookup(text, wanted, bits):
    depth = 9
    code = np.array(text + [0] * depth)
    start = np.arange(len(text))
    keys = suffixes.pack(code, start, len(text) - start, bits, depth)
    order = suffixes.order_of(keys)
    flat = np.array([x for w in wanted for x in w] + [0] * depth)
    size = np.array([len(w) for w in wanted])
    low, high = suffixes.lookup([k[order] for k in keys], suffixes.pack(flat, np.cumsum(size) - size, size, bits, depth), size, bits)
    for w, a, b in zip(wanted, low, high, strict=True):
        assert sorted(start[order][a:b].tolist()) == [i for i in range(len(text)) if text[i : i + len(w)] == w]


def test_cover():
    assert is_cover(PERIOD, COVER) and not is_cover(7, (0, 1))
