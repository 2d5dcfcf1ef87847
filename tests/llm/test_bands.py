"""Compression bands: they reject what passes the base rule, keep what is labelled good, and equal brute force."""

import bisect

import numpy as np
import pyarrow.parquet as pq
import zstandard

from foliant.llm import quality

FOLDER = "/root/testdata/sf0.01"


def labelled():
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"], label.get(r["doc_id"])) for r in rows]


def brute_force(text):
    """The verdict of the bands, by every chunk that the rule names."""
    data = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    if not data:
        return False
    _, low, high = quality.BANDS[bisect.bisect_right([b[0] for b in quality.BANDS], len(data))]
    pieces = [(data, low, high)]
    for size, low, high, limit in quality.CHUNKS:
        if size <= len(data) < limit:
            starts = [*range(0, len(data) - size, size // 2), len(data) - size]
            assert set().union(*(range(s, s + size) for s in starts)) == set(range(len(data)))
            pieces += [(data[s : s + size], low, high) for s in starts]
    return all(low <= ratio(b) <= high for b, low, high in pieces)


def test_verdicts(spark, shipped):
    rows = labelled()
    got = {r.doc_id: r for r in quality.judge(shipped.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert all(got[i].kept == (not got[i].base_failed and brute_force(t)) for i, t, _ in rows)
    passed = [(i, q) for i, _, q in rows if not got[i].base_failed]
    good, bad = [i for i, q in passed if q == 1], [i for i, q in passed if q == 0]
    assert all(got[i].kept for i in good) and len(good) > 300
    assert sum(not got[i].kept for i in bad) / len(bad) > 0.5  # rejected by ratio alone


def test_bands_cover_what_is_fitted():
    data = [(t or "").encode() for _, t, q in labelled() if q == 1]
    data = [t for t in data if len(t.split()) >= 50]
    sizes = np.array([len(t) for t in data])
    ratios = np.array([len(t) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(t)) for t in data])
    normal = ratios < 2.6  # repeated passages fail the base rule
    limits = [b[0] for b in quality.BANDS]
    fit = quality.fitted(sizes[normal], ratios[normal], limits, (0.0, 0.0))
    assert sum(f is not None for f in fit) >= 8
    assert all(low <= f[1] and f[0] == limit for f, (limit, low, high) in zip(fit, quality.BANDS, strict=True) if f)
