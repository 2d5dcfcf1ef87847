"""Exact substring removal with difference-cover anchors.

A window is ``width`` consecutive words of one text.  Let D be a difference cover modulo v: every
residue is a difference of two members.  Then for any two positions i and j some shift k < v puts
both i+k and j+k on members of D.  So two equal windows at i and j share an equal, aligned anchor
of width-v+1 words, and only the positions whose residue is in D are hashed (6 of 31).

Anchors that occur in two texts mark where equal windows can start; from there matches extend:
just those windows are hashed at full width, and the smallest doc_id that holds each is found.
No pairs of texts are formed, so a passage in thousands of texts costs each of them its own words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, answer, ask, bits, blocks_of, buckets_for, cells, expand, from_bits, from_planes, meet, merged, pack_sorted, planes, rows, squeeze, unpack_sorted, with_null_id
from .runtime import cut
from .textcodes import IS_SPACE, U64, owner, runs, span_hashes, window_hashes, word_spans

WIDTH = 50
PERIOD = 31
#: A perfect difference set: each nonzero residue modulo 31 is a difference just once.
COVER = (1, 5, 11, 24, 25, 27)

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
#: Bucket numbers of the second exchange, so that a block can tell them from the first's.
SECOND = 1 << 24


def is_cover(period: int, members: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in members for b in members} == set(range(period))


class Words:
    def __init__(self, block: Block):
        self.starts, self.ends = word_spans(block.buf)
        self.doc = owner(block.offsets, self.starts)
        self.codes = span_hashes(block.buf, self.starts, self.ends)
        self.per_doc = np.bincount(self.doc, minlength=len(block))
        first = np.concatenate(([0], np.cumsum(self.per_doc)))
        self.first, self.end = first[:-1], first[1:]
        n = len(self.codes)
        self.at = np.arange(n) - self.first[self.doc]
        self.left = self.end[self.doc] - np.arange(n)

    def anchors(self, width: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        """Word positions of the anchors of texts that have a window at all."""
        member = np.zeros(period, np.bool_)
        member[list(cover)] = True
        return np.flatnonzero(member[self.at % period] & (self.left >= width - period + 1) & (self.per_doc[self.doc] >= width))

    def windows(self, width: int, period: int, marked: np.ndarray) -> np.ndarray:
        """Starts of the windows with a marked anchor at a shift below the period."""
        n = len(self.codes)
        sums = np.zeros(n + 1, np.int64)
        sums[1:] = np.cumsum(np.bincount(marked, minlength=n))
        upto = np.minimum(np.arange(n) + period, n)
        return np.flatnonzero((sums[upto] > sums[:-1]) & (self.left >= width))


def deduplicate(docs: DataFrame, *, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Remove each word covered by a window that also starts in a text with a smaller doc_id.

    Input: doc_id, text and any other columns.  Result for each row: doc_id, n_words, n_removed,
    kept (the words left, joined by one space) and kept_sha256.  A null or empty text has no
    words.  Windows are judged on the input.  Rows that repeat a doc_id count as one text's rows:
    neither removes words of the other.  A null doc_id counts as the smallest."""
    if not is_cover(period, cover):
        raise ValueError("not a difference cover")
    if width < period:
        raise ValueError("a window must be as long as the period")
    short = width - period + 1
    table, size = blocks_of(docs, label="substring")
    n_first = buckets_for(size, 0.17 * len(cover) / period)
    n_second = buckets_for(size, 0.05)

    def anchor_keys(block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
        w = Words(block)
        at = w.anchors(width, period, cover)
        return w, at, window_hashes(w.codes, short)[at] if len(at) else np.zeros(0, U64)

    def ask_anchors(block: Block) -> list[tuple[int, bytes]]:
        w, at, keys = anchor_keys(block)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], block.ids[w.doc[at[order]]]
        first = runs(keys)
        if not len(first):
            return []
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        keys = keys[first]
        return [(b, squeeze(pack_sorted(keys[s]), bits(several[s]))) for b, s in cells(keys, n_first)]

    def merge_anchors(asked: list[bytes]) -> tuple[list[bytes], int, int]:
        """An anchor is marked if two texts have it."""
        parts = [expand(x) for x in asked]
        keys = [unpack_sorted(p[0]) for p in parts]
        several = np.concatenate([from_bits(p[1], len(k)) for p, k in zip(parts, keys, strict=True)])
        order, number, first = merged(keys)
        sizes = np.diff(np.concatenate((first, [len(order)])))
        marked = (sizes > 1) | np.logical_or.reduceat(several[order], first)
        flags = np.empty(len(order), np.bool_)
        flags[order] = marked[number]
        ends = np.cumsum([len(k) for k in keys])
        return [bits(flags[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)], 0, 0

    def candidates(block: Block, got: dict[int, bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, starts of the windows that may occur elsewhere, and their hashes."""
        w, at, keys = anchor_keys(block)
        if not len(keys):
            return w, np.zeros(0, np.int64), np.zeros(0, U64)
        order = np.argsort(keys, kind="stable")
        srt = keys[order]
        first = runs(srt)
        unique = srt[first]
        marked = np.concatenate([from_bits(got[b], s.stop - s.start) for b, s in cells(unique, n_first)])
        flags = np.empty(len(keys), np.bool_)
        flags[order] = np.repeat(marked, np.diff(np.concatenate((first, [len(srt)]))))
        start = w.windows(width, period, at[flags])
        return w, start, window_hashes(w.codes, width)[start] if len(start) else np.zeros(0, U64)

    def window_runs(w: Words, start: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order that sorts by key, starts of equal keys, smallest id of each."""
        order = np.argsort(keys, kind="stable")
        srt = keys[order]
        first = runs(srt)
        least = np.minimum.reduceat(ids[w.doc[start[order]]], first) if len(first) else np.zeros(0, np.int64)
        return order, first, srt[first], least

    def ask_windows(block: Block, got: dict[int, bytes], number: int) -> pa.Table:
        w, start, keys = candidates(block, got)
        _, _, keys, least = window_runs(w, start, keys, block.ids)
        return pa.Table.from_batches([rows(number, [(SECOND + b, squeeze(pack_sorted(keys[s]), planes(least[s]))) for b, s in cells(keys, n_second)])])

    def merge_windows(asked: list[bytes]) -> tuple[list[bytes], int, int]:
        """Whether a smaller id than the block's smallest has the window."""
        parts = [expand(x) for x in asked]
        keys = [unpack_sorted(p[0]) for p in parts]
        least = np.concatenate([from_planes(p[1], np.int64) for p in parts])
        order, number, first = merged(keys)
        smallest = np.minimum.reduceat(least[order], first)
        flags = np.empty(len(order), np.bool_)
        flags[order] = smallest[number] < least[order]
        ends = np.cumsum([len(k) for k in keys])
        return [bits(flags[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)], 0, 0

    def finish(block: Block, got: dict[int, bytes], _: int) -> pa.Table:
        w, start, keys = candidates(block, {b: p for b, p in got.items() if b < SECOND})
        order, first, unique, least = window_runs(w, start, keys, block.ids)
        n = len(w.codes)
        gone = np.zeros(n + 1, np.int64)
        if len(start):
            elsewhere = np.concatenate([from_bits(got[SECOND + b], s.stop - s.start) for b, s in cells(unique, n_second)])
            sizes = np.diff(np.concatenate((first, [len(order)])))
            at = start[order]
            out = at[np.repeat(elsewhere, sizes) | (block.ids[w.doc[at]] > np.repeat(least, sizes))]
            np.add.at(gone, out, 1)
            np.add.at(gone, out + width, -1)
        removed = np.cumsum(gone[:n]) > 0
        kept = keep_words(block, w, ~removed)
        removed_per_doc = np.bincount(w.doc[removed], minlength=len(block))
        return pa.table([pa.array(block.ids), pa.array(w.per_doc), pa.array(removed_per_doc), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())], schema=RESULT)

    marks = cut(answer(ask(table, ask_anchors), merge_anchors).select("block", "bucket", "payload"), "anchors")
    asked = meet(table, marks, ask_windows, "block long, bucket int, payload binary")
    both = marks.unionByName(answer(asked, merge_windows).select("block", "bucket", "payload"))
    return with_null_id(meet(table, both, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))


def keep_words(block: Block, w: Words, keep: np.ndarray) -> list[bytes]:
    """For each text, its kept words joined by one space."""
    edge = np.zeros(len(block.buf) + 1, np.int8)
    edge[w.starts[keep]] = 1
    edge[w.ends[keep]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(np.bool_)
    inside[w.ends[keep]] = True  # one white-space byte after each word; the newline after a text at least
    out = block.buf[inside].copy()
    out[IS_SPACE[out]] = 32
    size = np.bincount(w.doc[keep], weights=(w.ends - w.starts + 1)[keep], minlength=len(block)).astype(np.int64)
    ends = np.cumsum(size)
    data = out.tobytes()
    return [data[max(0, e - s) : max(e - s, e - 1)] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
