"""Language-model scoring with a weighted backoff automaton.

A state is a history of up to order-1 tokens that training text holds; an arc is an n-gram.
With c the training counts and h the count of the history, an arc of order k has probability

    p_k = (c_k + mu * p_{k-1}) / (h + mu)

(Dirichlet smoothing; it sums to one over the vocabulary and one unknown word), where p_1 is the
add-0.1 estimate.  Where training has no such n-gram, the failure arc of weight
log10(mu / (h + mu)) leads to the state of the next shorter history; a history that training
lacks is no state.  A text is one traversal from the start state: each token follows failure arcs,
adding their weights, until the state has an arc for it, adds the arc's weight and moves to the
arc's target, the longest suffix of what was read that is a state.

Counts cover the whole training part.  The automaton isn't broadcast: every block of texts gets
from the hash buckets just the n-grams that its own texts hold (see :mod:`foliant.llm.blocks`) and
builds the part of the automaton that they can touch, so memory doesn't follow the size of the
model.  A block's texts are cut into stretches that take their steps side by side; a stretch that
doesn't begin a text reads order-1 tokens before it from the empty state, which leads to the state
that the whole text would have there, since a state is the longest known suffix.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, Block, answer, ask, blocks_of, buckets_for, cells, expand, from_planes, meet, merged, pack_sorted, planes, squeeze, unpack_sorted, with_null_id
from .runtime import cut
from .textcodes import TO_LOWER, U64, mix, owner, span_hashes, word_spans

END, START = U64(0x9D8F3A1B5C7E2461), U64(0x3C6EF372FE94F82B)
#: Leaves 56 bits of the key of an n-gram; two of n distinct ones are taken for one with chance n^2 / 2^57.
SHORT_KEY = ~U64(0x7F)
ADD = 0.1
#: Tokens of a text that one traversal takes; longer texts are traversed in stretches side by side.
STRETCH = 256
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def is_held_out(doc_id: int, folds: int, fold: int) -> bool:
    """crc32 of the id as text; a null id counts as the text ''."""
    return zlib.crc32(b"" if doc_id == NULL_ID else str(doc_id).encode()) % folds == fold


class Tokens:
    """Token codes of a block: the words of each text, then one end."""

    def __init__(self, block: Block, folds: int, fold: int):
        buf = TO_LOWER[block.buf]
        starts, ends = word_spans(buf)
        doc = owner(block.offsets, starts)
        n_docs = len(block)
        per_doc = np.bincount(doc, minlength=n_docs)
        self.last = np.cumsum(per_doc + 1) - 1
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if n_docs else np.zeros(0, np.int64)
        self.codes = np.full(len(starts) + n_docs, END)
        self.codes[np.arange(len(starts)) + doc] = span_hashes(buf, starts, ends)
        self.held = np.fromiter((is_held_out(int(i), folds, fold) for i in block.ids), np.bool_, n_docs)
        self.train = np.repeat(~self.held, per_doc + 1)
        self.doc_start = np.zeros(len(self.codes), np.bool_)
        self.doc_start[self.first] = True

    def keys(self, order: int) -> list[np.ndarray]:
        """For each order, a key of the n-gram that ends at each token: 62 bits for words, which bit
        0 marks, and 56 for longer n-grams, since these make up nearly all that is exchanged."""
        out, gram, before = [], self.codes, self.codes
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate(([START], before[:-1]))
                before[self.doc_start] = START
                gram = mix(gram * U64(0x9E3779B97F4A7C15) + before)
            key = (mix(gram + U64(k)) >> U64(2)) << U64(1)
            out.append(key | U64(1) if k == 1 else key & SHORT_KEY)
        return out


class Automaton:
    """The part of the model that the texts of a block can touch.

    State 0 is the empty history, states 1 to order-1 are histories of that many start marks (a
    text begins in the last), the others are n-grams of orders below the model's that training
    holds.  ``arc_key`` sorts the arcs by (state, token); ``fail`` and ``fail_weight`` are the failure
    arcs."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, doc_start: np.ndarray, n_train_docs: int, n_all: int, n_words: int, mu: float):
        """grams: (order, tokens) numbers of the n-grams that end at each token, distinct over the
        orders; counts: training count of each number."""
        order, n = grams.shape
        self.order, self.size = order, len(counts)
        flat = grams.ravel()
        seen = np.zeros(self.size, np.int32)
        seen[flat[::-1]] = np.arange(len(flat), dtype=np.int32)[::-1]  # a place of each n-gram
        level, at = seen // max(n, 1), seen % max(n, 1)
        is_state = (counts > 0) & (level < order - 1)
        self.state_of = np.zeros(self.size, np.int32)
        self.state_of[is_state] = np.arange(order, order + int(is_state.sum()))
        self.fail = np.maximum(np.arange(order + int(is_state.sum())) - 1, 0)
        self.fail_weight = np.zeros(len(self.fail))
        self.fail_weight[1:order] = np.log10(mu / (n_train_docs + mu))
        shorter = np.zeros(self.size, np.int32)  # the n-gram without its first token
        longer = level > 0
        shorter[longer] = grams[level[longer] - 1, at[longer]]
        mine = self.state_of[is_state]
        self.fail[mine] = np.where(level[is_state] > 0, self.state_of[shorter[is_state]], 0)
        self.fail_weight[mine] = np.log10(mu / (counts[is_state] + mu))
        # Arc probabilities, from the shortest order up.
        p = (counts + ADD) / (n_all + ADD * (n_words + 1))
        source = np.zeros(self.size, np.int32)
        for k in range(1, order):
            here = np.flatnonzero((level == k) & (counts > 0))
            begins = doc_start[at[here]]
            history = np.where(begins, 0, grams[k - 1, np.maximum(at[here] - 1, 0)])
            before = np.where(begins, n_train_docs, counts[history])
            p[here] = (counts[here] + mu * p[shorter[here]]) / (before + mu)
            source[here] = np.where(begins, k, self.state_of[history])
        arcs = np.flatnonzero(counts > 0)
        key = source[arcs].astype(np.int64) * self.size + grams[0, at[arcs]]
        by = np.argsort(key)
        arcs = arcs[by]
        self.arc_key, self.arc_weight = key[by], np.log10(p[arcs])
        self.arc_target = np.where(is_state[arcs], self.state_of[arcs], self.state_of[shorter[arcs]] if order > 1 else 0)
        self.unknown = float(np.log10(ADD / (n_all + ADD * (n_words + 1))))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after reading one token each, weights gathered)."""
        after, weight = np.zeros(len(state), np.int64), np.zeros(len(state))
        open_, state = np.arange(len(state)), state.copy()
        while len(open_):
            key = state[open_] * self.size + token[open_]
            place = np.searchsorted(self.arc_key, key)
            hit = np.zeros(len(open_), np.bool_)
            inside = place < len(self.arc_key)
            hit[inside] = self.arc_key[place[inside]] == key[inside]
            taken = open_[hit]
            after[taken] = self.arc_target[place[hit]]
            weight[taken] += self.arc_weight[place[hit]]
            open_ = open_[~hit]
            lost = state[open_] == 0
            weight[open_[lost]] += self.unknown
            open_ = open_[~lost]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return after, weight

    def traverse(self, tokens: np.ndarray, first: np.ndarray, last: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """(weight of each token, state after it) for texts of tokens first..last, both included."""
        pieces = (last - first) // stretch + 1
        text = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + nth * stretch
        warm = np.where(nth > 0, np.minimum(self.order - 1, begin - first[text]), 0)
        size = np.minimum(begin + stretch, last[text] + 1) - begin + warm
        by = np.argsort(-size, kind="stable")
        begin, warm, size, nth = begin[by], warm[by], size[by], nth[by]
        state = np.where(nth > 0, 0, self.order - 1)
        weights, states = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # stretches of more tokens
        for i, m in enumerate(running.tolist()):
            at = begin[:m] - warm[:m] + i
            state[:m], weight = self.step(state[:m], tokens[at])
            counted = warm[:m] <= i
            weights[at[counted]], states[at[counted]] = weight[counted], state[:m][counted]
        return weights, states


def score_texts(docs: DataFrame, *, order: int = 3, mu: float = 60.0, folds: int = 10, fold: int = 0) -> DataFrame:
    """Score every text by a model of the texts outside one fold.

    Input: doc_id, text and any other columns.  Result: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).  A null or empty text has the end as its one token.
    Repeated rows count and score as often as they occur.  An empty table gives no rows."""
    table, size = blocks_of(docs, label="lm")
    n_buckets = buckets_for(size, 0.17 * order)

    def requests(block: Block) -> list[tuple[int, bytes]]:
        t = Tokens(block, folds, fold)
        flagged = np.concatenate([(k << U64(1)) | t.train for k in t.keys(order)])
        flagged.sort()
        keys = flagged >> U64(1)
        first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        counts = np.add.reduceat((flagged & U64(1)).astype(np.uint32), first).astype(np.uint32)
        keys = keys[first] << U64(1)
        return [(b, squeeze(pack_sorted(keys[s]), planes(counts[s]))) for b, s in cells(keys, n_buckets)]

    def merge(asked: list[bytes]) -> tuple[list[bytes], int, int]:
        parts = [expand(x) for x in asked]
        keys = [unpack_sorted(p[0]) for p in parts]
        counts = np.concatenate([from_planes(p[1], np.uint32) for p in parts]).astype(np.int64)
        order_, number, first = merged(keys)
        totals = np.add.reduceat(counts[order_], first)
        word = ((np.concatenate(keys)[order_[first]] >> U64(1)) & U64(1)).astype(np.bool_)
        back = np.empty(len(order_), np.int64)
        back[order_] = totals[number]
        ends = np.cumsum([len(k) for k in keys])
        out = [squeeze(planes(back[lo:hi].astype(np.uint64))) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        return out, int(totals[word].sum()), int(np.count_nonzero(totals[word]))

    answers = cut(answer(ask(table, requests), merge), "lm-counts")
    got = answers.agg(F.sum("total_a"), F.sum("total_b")).first()
    n_all, n_words = int(got[0] or 0), int(got[1] or 0)

    def finish(block: Block, got: dict[int, bytes], _: int) -> pa.Table:
        t = Tokens(block, folds, fold)
        keys = t.keys(order)
        every = np.concatenate(keys)
        order_ = np.argsort(every)
        srt = every[order_]
        number = np.zeros(len(srt), np.int32)
        number[1:] = srt[1:] != srt[:-1]
        number = np.cumsum(number, dtype=np.int32)
        del keys, srt
        counts = np.concatenate([from_planes(expand(got[b])[0], np.uint64) for b in sorted(got)]).astype(np.int64)
        grams = np.empty(len(every), np.int32)
        grams[order_] = number
        grams = grams.reshape(order, -1)
        ones = counts[grams[0]]
        del every, order_, number
        automaton = Automaton(grams, counts, t.doc_start, int(ones[t.last[0]]) if len(t.last) else 0, n_all, n_words, mu)
        steps, _ = automaton.traverse(grams[0], t.first, t.last)
        logs = np.log10((ones + ADD) / (n_all + ADD * (n_words + 1)))
        known = (ones > 0).astype(np.int64)
        return pa.table(
            [
                pa.array(block.ids), pa.array(t.held), pa.array(t.last - t.first + 1),
                pa.array(np.add.reduceat(known, t.first)), pa.array(np.add.reduceat(logs, t.first)), pa.array(np.add.reduceat(steps, t.first)),
            ],
            schema=RESULT,
        )

    scored = meet(table, answers, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return with_null_id(scored).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

