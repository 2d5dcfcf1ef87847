"""Encoding against the library: whole texts, odd units, and units of any length."""

import random
import time

import pyarrow.parquet as pq
import pytest
import sentencepiece

from foliant.llm import sentencepiece_sa

FOLDER = "/root/testdata/sf0.001"
_rng = random.Random(7)
ODD = [
    "", " ", "  ", "   a", " a", "  漢", "漢  漢", " " * 40 + "x", "a" * 300, "\n\n a\n  b", "\t\tx", "é" * 700, "ab" * 2000 + " " + "  " * 9, "\x00", "a\x00b", "👍👍 👍", "." * 40, "x▁y  ▁z", "\n", " \n ", "word  two   three    four" + " " * 17,
    *("".join(_rng.choice("abet hon .\n漢é ") for _ in range(_rng.randint(1, 1500))) for _ in range(60)), *("".join(_rng.choice("abcdefghijklmnopqrstuvwxyzABCDE0123456789+/") for _ in range(_rng.randint(200, 3000))) for _ in range(20)),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL_PATH)


def test_whole_texts(library):
    own = sentencepiece_sa.load()
    texts = [r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    for lo in range(0, len(texts), 50):  # later texts meet units that earlier ones left
        assert [x.tolist() for x in own.encode(texts[lo : lo + 50])] == [library.encode(t or "") for t in texts[lo : lo + 50]]


@pytest.mark.parametrize("limits", [{}, {"SHORT": 3, "STRETCH": 37, "SLICE": 100}, {"SHORT": 0, "STRETCH": 16, "SLICE": 20, "VERDICTS": 5}, {"SLICE": 64, "KEEP": 3}])
def test_odd_units_at_any_slicing(library, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sentencepiece_sa, name, value)
    own = sentencepiece_sa.load()
    for _ in range(2):
        ids = own.encode(ODD)
        assert [x.tolist() for x in ids] == [library.encode(t) for t in ODD]
        assert [own.decode(x) for x in ids] == [t.replace("▁", " ") for t in ODD]


@pytest.mark.parametrize("word", [" " + "x" * 8000, " " + "abcdefgh" * 125_000, "the" * 100_000, " " * 50_000 + "y"])
def test_unbroken_words_take_linear_time(library, word):
    own = sentencepiece_sa.load()
    began = time.process_time()
    (ids,) = own.encode([word])
    assert time.process_time() - began < 20 and ids.tolist() == library.encode(word)


def test_unigram_lattice():
    model = sentencepiece_sa.Model([("▁", -2.0, 1), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.0, 1), ("aab", -2.1, 1), ("▁a", -2.5, 1)], sentencepiece_sa.UNIGRAM)
    own = sentencepiece_sa.Tokenizer(model)
    pieces, scores = [p[0] for p in model.pieces], {p[0]: p[1] for p in model.pieces}

    def best(text):
        table = [(0.0, [])]
        for end in range(1, len(text) + 1):
            table.append(max((table[lo][0] + scores[text[lo:end]], table[lo][1] + [pieces.index(text[lo:end])]) for lo in range(end) if text[lo:end] in scores))
        return table[-1]

    for text in ("aab", "abab", "aaab", "baab" * 100):
        (ids,) = own.encode([text])
        assert abs(sum(model.pieces[i][1] for i in ids) - best("▁" + text)[0]) < 1e-9
