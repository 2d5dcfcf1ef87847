"""Quality rules with compression bands.

The zstandard ratio (bytes over compressed bytes) of a text must lie in the band of its length
class: repetitive text compresses too well, random or encoded text too little, and short text
carries the frame's overhead.  Chunks of fixed sizes have bands of their own, which find a
repetitive or incompressible stretch inside a text whose overall ratio looks usual.  Chunks overlap
by half and the last one ends with the text, so that no byte of a text of the least size is left
out; one chunk outside its band is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, ship
from .textcodes import IS_SPACE, U64, join_texts, mix, owner, span_hashes, window_hashes, word_spans

# Fixed values: (bytes below which the row holds, least ratio, largest ratio).  Largest ratios of 362
# to 32768 bytes are those of the texts labelled good at scale 0.1 (3243 rows pass the base rule) plus
# 0.08, least ones theirs less 0.2 or more, both read off by fitted(); outside they follow the trend.
BANDS = (
    (64, 0.4, 2.5),
    (128, 0.7, 2.3),
    (256, 0.9, 1.8),
    (362, 1.1, 1.8),
    (512, 1.2, 1.92),
    (724, 1.25, 1.96),
    (1024, 1.35, 2.06),
    (1448, 1.45, 2.12),
    (2048, 1.6, 2.23),
    (2896, 1.7, 2.24),
    (4096, 1.75, 2.3),
    (5793, 1.85, 2.37),
    (8192, 1.9, 2.43),
    (11585, 1.95, 2.46),
    (16384, 2.0, 2.49),
    (23170, 2.0, 2.52),
    (32768, 2.0, 2.56),
    (46341, 2.0, 2.62),
    (65536, 2.0, 2.68),
    (131072, 2.0, 2.8),
    (262144, 2.0, 2.95),
    (1 << 20, 2.0, 3.2),
    (1 << 62, 2.0, 3.6),
)
#: (bytes of a chunk, least ratio, largest ratio, bytes below which a text is cut so).  Base64 has
#: 1.05, 1.18, 1.26 and 1.31 at these sizes, texts labelled good 1.26, 1.39, 1.65 and 2.07 at least
#: and 1.62, 1.82, 2.04 and 2.26 at most; their largest ratios are taken with 0.06 to 0.08 more.
CHUNKS = (
    (256, 1.1, 1.7, 512),
    (512, 1.25, 1.9, 1024),
    (1024, 1.35, 2.11, 1 << 62),
    (4096, 1.4, 2.32, 1 << 62),
)
LEVEL = 3
BATCH = 1 << 20

SYMBOL = np.zeros(256, np.bool_)
SYMBOL[list(b"#*$%&|<>")] = True


def fitted(sizes: np.ndarray, ratios: np.ndarray, limits: list[int], slack: tuple[float, float] = (0.2, 0.08), least_rows: int = 5) -> list[tuple[int, float, float] | None]:
    """(limit, least, largest ratio) of each length class, from texts known to be good: their range,
    wider by ``slack``.  Classes with fewer than ``least_rows`` texts give None."""
    out: list[tuple[int, float, float] | None] = []
    for below, limit in zip([0, *limits], limits, strict=False):
        mine = ratios[(sizes >= below) & (sizes < limit)]
        out.append((limit, float(mine.min()) - slack[0], float(mine.max()) + slack[1]) if len(mine) >= least_rows else None)
    return out


def in_band(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bool, float]:
    """(whether the whole and its chunks are in their bands, ratio of the whole)."""
    n = len(text)
    if not n:
        return False, 0.0
    ratio = n / len(compressor.compress(text))
    low, high = next((lo, hi) for limit, lo, hi in BANDS if n < limit)
    if not low <= ratio <= high:
        return False, ratio
    for size, low, high, limit in CHUNKS:
        if size <= n < limit:
            for i in (*range(0, n - size, size // 2), n - size):
                if not low <= size / len(compressor.compress(text[i : i + size])) <= high:
                    return False, ratio
    return True, ratio


def _measures(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    n = len(texts)
    buf, offsets = join_texts(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    starts, ends = word_spans(buf)
    doc = owner(offsets, starts)
    n_words = np.bincount(doc, minlength=n)
    # Lines with a word: from the newline before to the newline after.
    newline = np.flatnonzero(buf == 10)
    line = np.searchsorted(newline, starts)
    first_word = np.concatenate(([True], line[1:] != line[:-1])) if len(line) else np.zeros(0, np.bool_)
    line = line[first_word]
    begin = np.where(line > 0, newline[np.maximum(line - 1, 0)] + 1, 0)
    codes = span_hashes(buf, begin, newline[line])
    line_doc = doc[first_word]
    n_lines = np.bincount(line_doc, minlength=n)
    distinct = np.unique(mix(codes + mix(line_doc.astype(U64))), return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(line_doc[distinct], minlength=n)
    # Words inside 3-word windows that the text has twice or more.
    words = span_hashes(buf, starts, ends)
    grams = window_hashes(words, 3)
    repeated = np.zeros(len(words) + 1, np.int64)
    if len(grams):
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        keys = mix(grams[inside] + mix(doc[inside].astype(U64)))
        order = np.argsort(keys)
        srt = keys[order]
        same = srt[1:] == srt[:-1]
        twice = np.zeros(len(srt), np.bool_)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 3, -1)
    in_repeat = np.cumsum(repeated[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": per_text(~IS_SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOL[buf]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(doc[in_repeat], minlength=n),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"


def judge(docs: DataFrame) -> DataFrame:
    """Input: doc_id, text and any other columns.  Result for each row: doc_id, the base measures,
    base_failed (n_words < 50 or over half of the words repeat), kept, and the whole text's ratio.
    Null and empty texts measure 0 and fail; repeated rows are judged alike."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size < BATCH and i < len(texts) - 1:
                    continue
                part = texts[lo : i + 1]
                m = _measures(part)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                verdicts = [in_band(t or b"", compressor) for t in part]
                m |= {"base_failed": failed, "kept": ~failed & np.array([v for v, _ in verdicts]), "ratio": [r for _, r in verdicts]}
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), *(pa.array(x) for x in m.values())], names=["doc_id", *m])
                release()
                lo, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
