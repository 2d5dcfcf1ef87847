"""Line dedup: clashing column names, occupied buckets, and banding against all pairs."""

import itertools

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import blocks, lines

FOLDER = "/root/testdata/sf0.001"


def test_callers_columns_stay(shipped):
    rows = [(1, "one line of some length\nanother line of some length", 7, 8, "mine", True), (2, "one line of some length", 9, 8, "too", False), (3, None, 1, 2, None, True)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, n_removed int, N_LINES int, kept_sha256 string, `_null` boolean")
    got = lines.deduplicate(df)
    assert got.columns == [*df.columns, "n_lines_", "n_removed_", "kept_sha256_"]
    by = {r[0]: r for r in got.collect()}
    assert [tuple(by[i])[2:6] for i in (1, 2, 3)] == [r[2:] for r in rows]
    assert [(by[i].n_lines_, by[i].n_removed_, by[i].text) for i in (1, 2, 3)] == [(2, 0, rows[0][1]), (1, 1, ""), (0, 0, None)]


def test_cells_are_the_occupied_ones():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    few, many = list(blocks.cells(keys, 1 << 10)), list(blocks.cells(keys, 1 << 40))
    assert len(few) <= 1000 and len(many) == 1000  # a block never has more cells than keys
    shift = np.uint64(64 - 10)
    assert all((keys[s] >> shift == b).all() for b, s in few) and sum(s.stop - s.start for _, s in few) == 1000


@given(st.lists(st.text(alphabet="ab \tA\x0b", max_size=12), max_size=12))
@settings(max_examples=100, deadline=None)
def test_lines_are_known_by_their_words(raw):
    block = blocks.Block(blocks.squeeze(np.array([5]).tobytes(), np.array([len("\n".join(raw).encode()) + 1]).tobytes(), "\n".join(raw).encode() + b"\n", b""))
    found = lines.Lines(block)
    wanted = [" ".join(x.lower().split()) for x in "\n".join(raw).split("\n")]
    assert [found.distinct[i].decode() if i >= 0 else "" for i in found.which[0]] == wanted


def test_bands_find_nearly_all_similar_pairs():
    texts = {" ".join(x.lower().split()) for t in pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist() for x in (t or "").split("\n")} - {""}
    texts = sorted(texts)[:1500]
    near = [t[:-3] + "xyz" for t in texts if len(t) > 80] + [t[3:] for t in texts if len(t) > 80]
    texts += near
    sets = lines.shingle_sets(texts)
    keys = [set(k) for k in lines.band_keys([t.encode() for t in texts]).tolist()]
    n, owners = len(texts), {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            owners.setdefault(x, []).append(i)
    close = {p for own in owners.values() if len(own) < 200 for p in itertools.combinations(own, 2)}
    close = [(i, j) for i, j in close if lines.similar(sets[i], sets[j], 0.8)]
    assert n > 1500 and len(close) > 500
    assert sum(bool(keys[i] & keys[j]) for i, j in close) / len(close) > 0.99
