"""The backoff automaton against brute force: its states, weights, and stretches."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import lm

MU = 5.0


def build(texts, train, order):
    """(automaton, tokens, first, last, counts by n-gram) of small texts; 0 ends a text."""
    rows = [[*t, 0] for t in texts]
    grams, starts = [], []
    for row in rows:
        for i in range(len(row)):
            history = ["<"] * max(0, order - 1 - i) + row[max(0, i - order + 1) : i]
            grams.append([tuple(history[len(history) - k :]) + (row[i],) for k in range(order)])
            starts.append(i == 0)
    counts: Counter = Counter()
    at = 0
    for row, trained in zip(rows, train, strict=True):
        for g in grams[at : at + len(row)]:
            counts.update(g if trained else [])
        at += len(row)
    index: dict = {}
    numbers = np.array([[index.setdefault(g[k], len(index)) for g in grams] for k in range(order)])
    by_number = np.array([counts[g] for g in index])
    n_all = sum(c for g, c in counts.items() if len(g) == 1)
    n_words = sum(len(g) == 1 for g in counts)
    sizes = np.array([len(r) for r in rows])
    last = np.cumsum(sizes) - 1
    automaton = lm.Automaton(numbers, by_number, np.array(starts), sum(train), n_all, n_words, MU)
    return automaton, numbers, last - sizes + 1, last, counts, rows, index


@given(st.lists(st.tuples(st.lists(st.integers(1, 3), max_size=9), st.booleans()), min_size=1, max_size=6), st.integers(1, 4), st.integers(3, 12))
@settings(max_examples=150, deadline=None)
def test_traversal(corpus, order, stretch):
    texts, train = [t for t, _ in corpus], [b for _, b in corpus]
    automaton, numbers, first, last, counts, rows, index = build(texts, train, order)
    weights, states = automaton.traverse(numbers[0], first, last, stretch)
    n_all = sum(c for g, c in counts.items() if len(g) == 1)
    n_words = sum(len(g) == 1 for g in counts)

    def count(gram):
        return sum(train) if gram and set(gram) == {"<"} else counts[gram]

    def prob(history, w):
        if not history:
            return (counts[(w,)] + 0.1) / (n_all + 0.1 * (n_words + 1))
        return (counts[(*history, w)] + MU * prob(history[1:], w)) / (count(history) + MU)

    at = 0
    for row in rows:
        for i, w in enumerate(row):
            history = tuple((["<"] * (order - 1) + row)[i : i + order - 1])
            assert math.isclose(weights[at], math.log10(prob(history, w)), rel_tol=1e-9)
            read = tuple((["<"] * (order - 1) + row)[i + 1 : i + order])
            known = next((read[k:] for k in range(len(read)) if counts[read[k:]]), ())
            assert states[at] == (automaton.state_of[index[known]] if known else 0)
            at += 1


def test_failure_arcs_shorten_the_history():
    automaton, numbers, *_ = build([[1, 2, 3, 1, 2], [2, 3]], [True, True], 3)
    depth = {0: 0, 1: 1, 2: 2}
    for g in range(automaton.size):
        if automaton.state_of[g]:
            depth[int(automaton.state_of[g])] = int((numbers == g).any(axis=1).argmax()) + 1
    assert len(depth) == len(automaton.fail) > 6
    assert all(depth[int(f)] == depth[s] - 1 for s, f in enumerate(automaton.fail) if s)
    assert (automaton.fail_weight[1:] < 0).all()


@pytest.mark.parametrize("stretch", [4, 7, 1000])
def test_stretches_change_nothing(stretch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 5, n).tolist() for n in (0, 1, 50, 3)]
    automaton, numbers, first, last, *_ = build(texts, [True, True, False, True], 3)
    weights, states = automaton.traverse(numbers[0], first, last, stretch)
    whole = automaton.traverse(numbers[0], first, last, 10**6)
    assert np.allclose(weights, whole[0]) and (states == whole[1]).all()
