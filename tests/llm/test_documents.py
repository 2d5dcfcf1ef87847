"""Operators on documents against brute force, and on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from foliant.llm import decontam, langid, lines, lm, quality, sentencepiece_sa, simhash, substring
from foliant.llm.components import components

FOLDER = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(shipped):
    return shipped.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def low(text):
    return (text or "").encode().lower().decode()


def shingles(line):
    line = line.ljust(lines.SHINGLE, "\0")
    return {line[i : i + lines.SHINGLE] for i in range(len(line) - lines.SHINGLE + 1)}


def union(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return find


@pytest.mark.parametrize("order", [2, 3])
def test_lm_matches_the_formula(docs, rows, order):
    mu = 20.0
    got = {r.doc_id: r for r in lm.score_texts(docs, mu=mu, order=order).collect()}
    tokens = {r["doc_id"]: [*re.findall(WORD, low(r["text"])), None] for r in rows}
    grams, history = Counter(), Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            padded = ["<"] * (order - 1) + t
            for at in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    grams[tuple(padded[at - k + 1 : at + 1])] += 1
                    history[tuple(padded[at - k + 1 : at]), k] += 1
    n = history[(), 1]
    v = sum(len(g) == 1 for g in grams)
    for i, t in tokens.items():
        padded = ["<"] * (order - 1) + t
        base = score = 0.0
        for at in range(order - 1, len(padded)):
            p = (grams[padded[at],] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                p = (grams[tuple(padded[at - k + 1 : at + 1])] + mu * p) / (history[tuple(padded[at - k + 1 : at]), k] + mu)
            score += math.log10(p)
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(t), n, sum(grams[w,] > 0 for w in t))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_lm_arcs_sum_to_one():
    counts, h, mu, below = {"a": 3, "b": 1}, 4, 20.0, {"a": 0.5, "b": 0.2, "c": 0.3}
    assert sum((counts.get(w, 0) + mu * p) / (h + mu) for w, p in below.items()) == pytest.approx(1)


def test_substring_matches_brute_force(docs, rows):
    words = {r["doc_id"]: re.findall(WORD, r["text"]) for r in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    got = {r.doc_id: r for r in substring.deduplicate(docs).collect()}
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                keep[j : j + 50] = [False] * 50
        text = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].kept_sha256) == (len(w), keep.count(False), text, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("options", [{}, {"tile": 8, "parts": 5}])
def test_simhash_matches_brute_force(docs, rows, options):
    fp = {}
    for r in rows:
        w = re.findall(WORD, low(r["text"]))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    find = union((a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, **options).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_simhash_tree_spans_dense_and_sparse_groups():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), rng.integers(0, 1 << 63, 60).astype(np.uint64)]))
    a, b = simhash.tree(fps, 4)
    find, full = union(zip(a, b, strict=True)), union((x, y) for x in fps.tolist() for y in fps.tolist() if (x ^ y).bit_count() <= 4)
    assert len(a) < len(fps) and [find(x) for x in fps.tolist()] == [full(x) for x in fps.tolist()]


def test_components_of_a_chain_and_a_star(shipped):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (3, 2)]
    got = {r.node: r.component for r in components(shipped.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(shipped.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("piece", [1 << 24, 900])
def test_decontamination_matches_brute_force(shipped, docs, rows, piece):
    item = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    bench += [(1001, "of the"), (1002, None), (1003, "..."), (1004, " ".join(rows[10]["text"].split()[:7])), (1005, rows[3]["text"]), (None, "the")]
    windows = {}
    for i, t in bench:
        w = re.findall(item, low(t))
        for j in range(max(1, len(w) - 9)):
            if w and i is not None:
                windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    test = shipped.createDataFrame(bench, "item_id long, text string")
    found = decontam.find(docs, test, piece_bytes=piece)
    got = {r.doc_id: r for r in found.collect()}
    for r in rows:
        w = re.findall(item, low(r["text"]))
        hit, items = [False] * len(w), set()
        for j in range(len(w)):
            for n in sizes:
                if len(k := tuple(w[j : j + n])) == n and k in windows:
                    hit[j : j + n] = [True] * n
                    items |= windows[k]
        g = got[r["doc_id"]]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(w), sum(hit), len(items), any(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    clean = decontam.remove(docs, test, piece_bytes=piece)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, g in got.items() if not g.contaminated}


def test_longest_match(shipped):
    text = " ".join(f"w{i}" for i in range(40))
    r = decontam.find(shipped.createDataFrame([(1, f"x y {text} z")], "doc_id long, text string"), shipped.createDataFrame([(7, f"q {text}")], "item_id long, text string")).first()
    assert (r.longest_match, r.match_at, r.n_hit) == (40, 2, 40)


@pytest.mark.parametrize("options", [{}, {"crowd": 2, "tile": 3}])
def test_lines_match_brute_force(docs, rows, options):
    name = lambda x: " ".join(re.findall(WORD, low(x)))
    first = {}
    for r in rows:
        for k, x in enumerate(r["text"].split("\n")):
            if name(x):
                first[name(x)] = min(first.get(name(x), (1 << 62, 0)), (r["doc_id"], k))
    sets = sorted(((shingles(x), x) for x in first), key=lambda s: (len(s[0]), s[1]))
    pairs = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if len(a) < 0.8 * len(b):
                break
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((x, y))
    find = union(pairs)
    keeper = {}
    for x, at in first.items():
        keeper[find(x)] = min(keeper.get(find(x), at), at)
    got = {r.doc_id: r for r in lines.deduplicate(docs, **options).collect()}
    for r in rows:
        raw = r["text"].split("\n")
        stay = [x for k, x in enumerate(raw) if not name(x) or keeper[find(name(x))] == (r["doc_id"], k)]
        g = got[r["doc_id"]]
        assert (g.n_lines, g.n_removed, g.text) == (len(raw), len(raw) - len(stay), "\n".join(stay))
        assert (g.lang, g.source) == (r["lang"], r["source"])


def test_line_trees_span_their_components():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 90):
        base = [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) for _ in range(3)]
        texts = [base[i % 3][: rng.integers(60, 90)] + "x" * int(rng.integers(0, 9)) for i in range(n)]
        names = rng.permutation(n).astype(np.int64)
        sets = [shingles(t) for t in texts]
        a, b = lines.spanning_tree(names, lines.shingle_sets(texts), 0.8)
        full = union((int(names[i]), int(names[j])) for i in range(n) for j in range(n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        find = union(zip(a, b, strict=True))
        assert len(a) < n or n == 0
        assert [find(int(x)) for x in names] == [full(int(x)) for x in names]


def test_quality_measures(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        w = re.findall(WORD, r["text"])
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                repeat |= {i, i + 1, i + 2}
        full = [x for x in r["text"].split("\n") if re.search(WORD, x)]
        g = got[r["doc_id"]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(full) - len(set(full)), len(repeat))
        assert g.base_failed == (len(w) < 50 or 2 * len(repeat) > len(w)) and not (g.kept and g.base_failed)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    clean = [g for i, g in got.items() if labels.get(i) == 1 and not g.base_failed]
    assert clean and all(g.kept for g in clean)


def test_quality_bands(shipped):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x100, 0x800, 12)) for _ in range(300))
    text = {1: "the same words again and again " * 200, 2: noise}
    got = {r.doc_id: r.kept for r in quality.judge(shipped.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False}


def test_quality_finds_a_bad_stretch_anywhere(rows):
    compressor = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    prose = " ".join(r["text"] for r in rows if labels.get(r["doc_id"]) == 1).encode()
    rng = np.random.default_rng(1)
    noise = rng.integers(33, 127, 30_000).astype(np.uint8).tobytes()
    coded = base64.b64encode(rng.bytes(30_000))
    for good, bad in ((4096, 3900), (1950, 1950), (12_288, 4096), (20_480, 20_480), (40_000, 1600), (500, 400), (240, 260)):
        assert quality.in_band(prose[: good + bad], compressor)[0]
        for junk in (noise, coded):
            assert not quality.in_band(prose[:good] + junk[:bad], compressor)[0], (good, bad)
            assert not quality.in_band(junk[:bad] + prose[:good], compressor)[0], (good, bad)
            assert not quality.in_band(prose[: good // 2] + junk[:bad] + prose[good // 2 : good], compressor)[0], (good, bad)


def test_languages(docs, rows):
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]].held_out == (r in held) for r in rows)
    right = sum(got[r["doc_id"]].lang_pred == r["lang"] for r in held)
    assert right / len(held) > 0.95 and all(0 <= g.score <= 1 for g in got.values())


def test_sentencepiece_equals_the_library():
    import sentencepiece

    own, other = sentencepiece_sa.load(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL_PATH)
    texts = [r["text"][:3000] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()[:40]]
    texts += ["", "  ", "a  b   c", "x\n\ny \n z", " lead", "trail ", "漢字 és ☃\x00", "     many", "▁▁a ▁", "x" * 300, "🤗🤗", "1234567 3.14"]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == other.encode(texts)
    assert [own.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]
    assert all(own.merge(t.replace(" ", "▁")) is not None for t in texts[-5:])


def test_awkward_rows(odd, none, shipped):
    bench = shipped.createDataFrame([(1, "same text of two rows"), (None, "x"), (2, None)], "item_id long, text string")
    model = langid.learn(odd)
    runs = {
        "lm": lambda d: lm.score_texts(d), "simhash": lambda d: simhash.near_duplicates(d), "substring": lambda d: substring.deduplicate(d), "decontam": lambda d: decontam.find(d, bench), "lines": lambda d: lines.deduplicate(d),
        "quality": lambda d: quality.judge(d), "langid": lambda d: langid.identify(d, model), "sentencepiece": lambda d: sentencepiece_sa.encode(d),
    }
    got = {}
    for name, run in runs.items():
        got[name] = run(odd).collect()
        assert len(got[name]) == odd.count(), name
        assert run(none).count() == 0, name
        assert sorted(str(r.doc_id) for r in got[name]) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect()), name
    by = {n: {r.doc_id: r for r in rs} for n, rs in got.items()}
    assert by["lm"][1].n_tokens == by["lm"][2].n_tokens == 1
    assert by["simhash"][1].fingerprint == "0" * 16 and by["simhash"][3].component_id == 1 and by["simhash"][8].component_id == 6
    assert by["substring"][5].n_words == 5000 and by["substring"][1].kept == ""
    assert by["decontam"][6].n_hit == 5 and by["decontam"][1].n_words == 0
    assert by["lines"][1].text is None and by["lines"][6].n_removed == 0 and by["lines"][8].n_removed == 1 and by["lines"][2].text == ""
    assert {c for c in odd.columns} <= set(lines.deduplicate(odd).columns)
    assert by["langid"][1].lang_pred == by["langid"][3].lang_pred == "und" and by["langid"][6].lang_pred in ("x", "y")
    assert by["quality"][1].base_failed and not by["quality"][5].kept
    assert by["sentencepiece"][1].ids == [] and all(r.round_trip for r in got["sentencepiece"])
