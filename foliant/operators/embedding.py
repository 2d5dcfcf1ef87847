"""Tokenizing and embedding of chunks in Arrow batches."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import strip_accents
from foliant.shipping import ship

UNKNOWN, CLS, SEP = "[UNK]", "[CLS]", "[SEP]"
LONGEST_WORD, BATCH = 100, 16
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


def _is_punctuation(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c).startswith("P")


def basic_tokens(text: str, lower: bool = True) -> list[str]:
    """Words and single marks: controls go, CJK characters stand alone, accents are stripped."""
    spaced = []
    for c in text:
        if c in "\t\n\r" or unicodedata.category(c) == "Zs":
            spaced.append(" ")
        elif c in "\0�" or unicodedata.category(c) in ("Cc", "Cf"):
            continue
        else:
            spaced.append(f" {c} " if _is_cjk(c) else c)
    out = []
    for word in "".join(spaced).split():
        word = strip_accents(word.lower()) if lower else word
        part = ""
        for c in word:
            if _is_punctuation(c):
                out += [part] * bool(part) + [c]
                part = ""
            else:
                part += c
        out += [part] * bool(part)
    return out


class WordPiece:
    def __init__(self, vocabulary: dict[str, int], lower: bool = True):
        self.vocabulary, self.lower = vocabulary, lower
        self.longest = max(map(len, vocabulary), default=1)

    def pieces(self, word: str) -> list[str]:
        if len(word.encode("utf-16-le")) // 2 > LONGEST_WORD:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return [UNKNOWN]
        return out

    def encode(self, text: str, most: int = 512) -> list[int]:
        ids: list[int] = []
        for word in basic_tokens(text, self.lower):
            ids += [self.vocabulary.get(p, self.vocabulary[UNKNOWN]) for p in self.pieces(word)]
            if len(ids) >= most - 2:
                break
        return [self.vocabulary[CLS], *ids[: most - 2], self.vocabulary[SEP]]


def pool(states: np.ndarray, mask: np.ndarray, how: str = "cls") -> np.ndarray:
    """(batch, tokens, d) to unit vectors; a zero vector stays."""
    v = states[:, 0] if how == "cls" else (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm == 0, 1, norm)).astype(np.float32)


def hashed_vector(text: str, dimensions: int = 64) -> list[float]:
    """A vector without a model: signed counts of hashed tokens, normalised; alike everywhere."""
    v = np.zeros(dimensions)
    for t in basic_tokens(text):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1 if h >> 63 else -1
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32).tolist()


def in_length_order(texts: list[str], run: Callable[[list[str]], list], batch: int = BATCH) -> list:
    """Results of batches of like lengths, in the order of the texts."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list = [None] * len(texts)
    for lo in range(0, len(order), batch):
        part = order[lo : lo + batch]
        for i, x in zip(part, run([texts[i] for i in part]), strict=True):
            out[i] = x
    return out


def embed(text: Column, *, prefix: str = "", dimensions: int = 64, model: Callable[[], Callable[[list[str]], list]] | None = None) -> Column:
    """Vectors of a text column.  ``model`` opens a model once a task; without one, hashed vectors."""

    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        infer = model() if model else lambda texts: [hashed_vector(t, dimensions) for t in texts]
        for s in batches:
            yield pd.Series(in_length_order([prefix + (t or "") for t in s], infer))

    return run(text)
