"""Texts that hold given strings: equal to trying each pair, in one pass, and the evaluation made of them."""

import io
import random
from contextlib import redirect_stdout

import duckdb
import pytest

from foliant.operators import quotes
from foliant.plans import registry


def _cases(seed, letters):
    r = random.Random(seed)
    texts = ["".join(r.choices(letters, k=r.randrange(0, 60))) for _ in range(60)] + [None, "", letters * 3]
    cuts = [t[i : i + r.randrange(1, 30)] for t in texts if t for i in (r.randrange(len(t)),)]
    return texts, sorted({*cuts, "", letters[0], letters[0] * 9, *(c + letters[0] for c in cuts), "nowhere to be found"})


@pytest.mark.parametrize(("segment", "spread"), [(1 << 18, 1 << 20), (7, 3), (1, 1)])
@pytest.mark.parametrize("letters", ["ab", "aé客😀 ", "abcdefghijklmnopqrstuvwxyz"])
def test_pairs_equal_brute_force(monkeypatch, segment, spread, letters):
    monkeypatch.setattr(quotes, "SEGMENT", segment)
    monkeypatch.setattr(quotes, "SPREAD", spread)
    texts, strings = _cases(segment, letters)
    got = quotes.Strings([s.encode() for s in strings]).pairs([t if t is None else t.encode() for t in texts]).tolist()
    assert got == [i * len(strings) + j for i, t in enumerate(texts) for j, s in enumerate(strings) if t is not None and s in t]


DOCS = [(1, "one two three four five"), (2, "two three four five six"), (2, "two three four five"), (3, "three four five"), (None, "two three four five"), (4, None), (5, "")]
ITEMS = [(1, "two three four"), (1, "two three four"), (2, "five"), (3, ""), (4, None), (None, "three four"), (5, "one two three four five"), (6, "not there")]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], ITEMS[4:6], []])
def test_evaluation_equals_sql(spark, tmp_path, items):
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.queries()["retrieval_evaluation"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['retrieval_evaluation']})").fetchall()


def test_documents_are_read_once_and_not_tried_with_each_item(spark):
    with redirect_stdout(io.StringIO()) as out:
        registry.queries()["retrieval_evaluation"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = out.getvalue()
    assert plan.split("(1)")[0].count("Scan parquet") == 1 and "NestedLoop" not in plan and "Window" not in plan
