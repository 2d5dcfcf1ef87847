"""Search from the written index equals the scan, and reads only its own trigrams."""

import io
from contextlib import redirect_stdout

from foliant.operators import lexical

SMALL = "/root/testdata/sf0.001"
OWN = [(1, "aaaa aaa"), (2, "Bananas and bananarama"), (3, None), (4, ""), (5, "ab"), (6, "x😀abc 😀abc"), (7, "客戶報價單與報價"), (8, "the The THE")]


def test_index_equals_scan(spark, tmp_path):
    docs = spark.createDataFrame(OWN, "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text"))
    index = lexical.write_index(docs, str(tmp_path / "i"), files_per_bucket=2)
    for terms in (("aaa",), ("anan", "the"), ("😀abc", "abc"), ("報價單", "客戶報"), ("tion", "heit", "nosuchterm"), ("ingen thh",)):
        want = [(r.doc_id, round(r.score, 9)) for r in lexical.bm25(docs, terms, "doc_id", "text", 50).collect()]
        assert [(r.doc_id, round(r.score, 9)) for r in lexical.indexed_bm25(index, terms, "doc_id", 50).collect()] == want, terms
    assert lexical.keyword_search(docs, "tion heit zu", 20, index=index).collect() == lexical.keyword_search(docs, "tion heit zu", 20).collect()


def test_index_is_pruned(spark, tmp_path):
    index = lexical.write_index(spark.read.parquet(f"{SMALL}/documents.parquet"), str(tmp_path / "i"))
    with redirect_stdout(io.StringIO()) as out:
        lexical.indexed_bm25(index, ("tion",), "doc_id", 5).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(trigram, [ion,tio])" in plan and "text" not in plan
