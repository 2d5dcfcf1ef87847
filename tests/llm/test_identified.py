"""The language stage rejects what is like no prototype and nothing else."""

import base64
import random

import pyarrow.parquet as pq

from foliant.llm import langid

FOLDER = "/root/testdata/sf0.001"


def test_only_unlike_texts_go(shipped):
    docs = shipped.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.learn(docs)
    given = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rng = random.Random(2)
    junk = [(10_000 + n, base64.b64encode(rng.randbytes(n)).decode()) for n in range(40, 400, 7)] + [(20_000 + n, rng.randbytes(n).hex()) for n in range(80, 400, 7)]
    junk += [(30_000, "Привет мир, это обычный русский текст о погоде и природе"), (30_001, None), (30_002, ""), (30_003, "12 34 %"), (30_004, "これは日本語の普通の文章です。天気がいいですね、散歩に行きましょう。明日も晴れるでしょうか。")]
    short = [(40_000, "zq"), (40_001, "zqx jkv")]
    df = shipped.createDataFrame(given + junk + short, "doc_id long, text string")
    got = {r.doc_id for r in langid.keep_identified(df, model).collect()}
    letters = {i for i, t in given if t and any(c.isalpha() for c in t)}
    assert got == letters | {i for i, _ in short}
    assert langid.keep_identified(df, {}).count() == 0 and langid.keep_identified(df.limit(0), model).count() == 0
