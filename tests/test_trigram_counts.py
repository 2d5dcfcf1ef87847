import io
from contextlib import redirect_stdout

import duckdb

from foliant.operators import lexical
from foliant.plans import registry

OWN = [(1, "aaaa AAA"), (2, None), (3, ""), (4, "ab"), (5, "x😀abc 😀ABC"), (6, "客戶報價單與報價"), (7, "ΑΣ İstanbul ΟΔΟΣ"), (1, "aaa"), (8, "a\nb\x00c"), (9, "abc")]


def _expected(folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(db.execute(registry.oracle_sql()["trigram_postings"]).fetchall())


def test_counts_equal_sql(spark, tmp_path):
    """Characters outside the basic plane, and those whose lower case depends on their neighbours or is longer."""
    spark.createDataFrame(OWN, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, registry.queries()["trigram_postings"](spark, str(tmp_path)).collect())) == _expected(tmp_path)


def test_pieces_and_merges_give_the_same(monkeypatch):
    import pyarrow as pa

    def total():
        out = {}
        for b in lexical._counts(iter([pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in OWN], pa.string())})] * 3)):
            for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[g] = out.get(g, 0) + n
        return out

    want = total()
    for piece, held in ((1, 1 << 20), (2, 4), (5, 1), (1000, 10)):
        monkeypatch.setattr(lexical, "PIECE", piece)
        monkeypatch.setattr(lexical, "HELD", held)
        assert total() == want
    assert want["abc"] == 9 and want["aaa"] == 12


def test_exchange_holds_no_documents(spark, tmp_path):
    spark.createDataFrame(OWN, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with redirect_stdout(io.StringIO()) as out:
        registry.queries()["trigram_postings"](spark, str(tmp_path)).explain("formatted")
    assert "hashpartitioning(trigram" in out.getvalue() and "doc_id" not in out.getvalue()
