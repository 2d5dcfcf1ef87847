"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds the vectors of its
letters, the first rotated twice and the second once; a text's vector bundles (adds) those of its
trigrams, and a language's prototype bundles the normalised vectors of its training texts.  A
text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, ship

DIMENSIONS = 1024
SEED = 0x1D
#: Trigram vectors that a worker keeps; beyond that it starts afresh, which costs time only.
CACHE = 1 << 15

#: A text of at least so many letters must have a cosine above this with some prototype.  Random
#: letters, base64 and hexadecimal digits of 20 to 5000 bytes have 0.15 at most, other scripts about
#: 0.05; of the given texts with 50 characters or more the least, one word over and over, has 0.229.
LEAST_LETTERS, LEAST_COSINE = 40, 0.16

_LETTERS: dict[int, np.ndarray] = {}


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of a code point (0: a gap between words); alike in every process."""
    found = _LETTERS.get(code)
    if found is None or len(found) != dimensions:
        if len(_LETTERS) > 4096:
            _LETTERS.clear()
        found = _LETTERS[code] = (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return found


class Alphabet:
    """Lower-case letters of code points, 0 for all others; looked up once for each code point."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
                self.table[c] = (ord(low) if len(low) == 1 else c) if low and chr(c).isalpha() else 0
            out = self.table[codes]
        return out


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.alphabet = Alphabet()
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((0, dimensions), np.int8)
        self.n_letters = 0  # of the text encoded last

    def _place(self, keys: list[int]) -> list[int]:
        new = [k for k in keys if k not in self.rows]
        if new:
            if len(self.rows) + len(new) > CACHE:
                self.rows.clear()
                new = keys
            lo = len(self.rows)
            if len(self.vectors) < lo + len(new):
                more = np.zeros((max(1024, lo + len(new), min(CACHE, 2 * len(self.vectors))), self.dimensions), np.int8)
                more[:lo] = self.vectors[:lo]
                self.vectors = more
            for i, k in enumerate(new):
                a, b, c = (letter_vector(x, self.dimensions) for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))
                self.vectors[lo + i] = np.roll(a, 2) * np.roll(b, 1) * c
                self.rows[k] = lo + i
        return [self.rows[k] for k in keys]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The text's vector, or None if it has no letter."""
        letters = self.alphabet.letters(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))
        self.n_letters = int(np.count_nonzero(letters))
        if not self.n_letters:
            return None
        letters = np.concatenate(([0], letters, [0])).astype(np.int64)
        keep = np.ones(len(letters), np.bool_)
        keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
        letters = letters[keep]
        if len(letters) < 3:
            return None
        keys, counts = np.unique((letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:], return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for lo in range(0, len(keys), 2048):
            rows = self._place(keys[lo : lo + 2048].tolist())
            total += counts[lo : lo + 2048].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def _unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def learn(docs: DataFrame, *, folds: int = 4, fold: int = 2, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each non-null lang, from all texts outside the held-out fold; null, empty and
    letterless texts add nothing, repeated rows count as often as they occur, and an empty table
    gives no prototypes.

    Tasks add up their own texts; their sums meet in two steps.  The driver gets one vector a
    language."""
    ship(docs.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold:
                    continue
                v = encoder.encode(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + _unit(v).astype(np.float64)
            release()
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tobytes() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("vector", pa.binary())]))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in group.column("vector").to_pylist())
        return pa.table({"lang": [group.column("lang")[0].as_py()], "vector": pa.array([total.tobytes()], pa.binary())})

    shape = "lang string, vector binary"
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = known.mapInArrow(part, shape).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = sums.groupBy("lang", "part").applyInArrow(add, shape).groupBy("lang").applyInArrow(add, shape)
    return {r.lang: _unit(np.frombuffer(r.vector, np.float64)).astype(np.float32) for r in sums.orderBy("lang").collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, folds: int = 4, fold: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """Input: doc_id, text and any other columns.  Result for each row: doc_id, held_out,
    lang_pred and score (the cosine, 0 to 1).  A null text, one without a letter, or no prototype at all gives
    ``und`` with score 0; the first language in order wins a tie."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(shared.value)
        matrix = np.stack([shared.value[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)
        encoder = Encoder(dimensions)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                v = encoder.encode(text) if names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = matrix @ _unit(v)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], *, least: float = LEAST_COSINE, letters: int = LEAST_LETTERS, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is identified.

    Those that :func:`identify` calls ``und`` go (null, empty, without a letter, or no prototype at
    all), and so do texts of ``letters`` letters or more whose best cosine isn't above ``least``:
    encoded data and languages that weren't learned.  Shorter texts can't be told and stay.
    Repeated rows fare alike; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(prototypes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.stack([v for _, v in sorted(shared.value.items())]) if shared.value else None
        encoder = Encoder(dimensions)
        for batch in batches:
            stay = []
            for text in batch.column(at).to_pylist():
                v = encoder.encode(text) if matrix is not None else None
                stay.append(v is not None and (encoder.n_letters < letters or float((matrix @ _unit(v)).max()) > least))
            yield batch.filter(pa.array(stay, pa.bool_()))
            release()

    return docs.mapInArrow(run, docs.schema)
