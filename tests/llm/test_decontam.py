"""Edit matching against dynamic programming over every place of every text."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstead.llm import decontam


def nearest(pattern, text):
    """Least edit distance of pattern to a part of text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(0, 4), max_size=120))
def test_myers(pattern, text):
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    assert decontam.myers(text, masks, len(pattern))[0] == min(len(pattern), nearest(pattern, text))


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words) or 1)
        words[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["very", "new"][:1]])
    return words


def planted(texts, rng):
    items = [(i, texts(rng.randrange(1, 60), 50)) for i in range(25)]
    docs = [(100 + i, texts(rng.randrange(0, 80), 50)) for i in range(20)]
    for i, (item, text) in enumerate(items):
        body = edited(text.split(), rng.randrange(0, 10), rng)
        docs.append((i, f"{texts(30, 50)}, {' '.join(body).upper()}! {texts(20, 50)}"))
    return items, docs


def brute(items, docs, rate=0.2):
    found = {}
    for d, text in docs:
        for i, item in items:
            w = decontam.words(item)
            if w and (k := nearest(w, decontam.words(text or ""))) <= int(len(w) * rate):
                found[d, i] = k
    return found


def test_against_brute_force(spark, texts):
    items, docs = planted(texts, random.Random(3))
    want = brute(items, docs)
    assert len(want) > 20 and max(want.values()) > 2
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block, held in ((1 << 21, 1 << 25), (1000, 1 << 25), (1000, 3000)):
        got = decontam.leaks(d, b, block_bytes=block, round_bytes=held).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
        kept = decontam.without_leaks(d, b, block_bytes=block, round_bytes=held)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    for r in got:
        part = decontam.words(dict(docs)[r["doc_id"]])[r["first_word"] : r["last_word"] + 1]
        assert nearest(decontam.words(dict(items)[r["item_id"]]), part) == r["distance"]


def test_common_pieces():
    """Questions that begin alike, and a text with that beginning 800 times."""
    items = [(i, f"what is the capital of w{i}") for i in range(2000)]
    rng = random.Random(1)
    text = " ".join(f"what is the {rng.choice(['capital', 'x', 'name of', 'capital of', f'w{rng.randrange(2000)}'])} y{rng.randrange(50)}" for _ in range(800))
    index = decontam.PieceIndex(items, 0.2)
    few = [(0, text[:1500]), (1, "what is the w7 of capital w9"), (2, "so what is the old capital of w12 then"), (3, "what is the what is the capital w3")]
    codes = lambda t: np.array([index.codes.get(w, -1) for w in decontam.words(t)])
    begun = time.perf_counter()
    found = index.search(codes(text))
    assert time.perf_counter() - begun < 1
    assert {i for i, *_ in found} == set(range(2000))  # "capital of", one word off
    plain = text.replace("capital", "name")
    begun = time.perf_counter()
    assert index.search(codes(plain)) == [] and time.perf_counter() - begun < 1
    assert {(d, h[0]): h[2] for d, t in few for h in index.search(codes(t))} == brute(items, few)


def test_unspaced_scripts(spark):
    """Items in scripts without spaces, copied into longer clauses, with a character changed, dropped or added."""
    items = [
        (1, "水在标准大气压下于一百度沸腾，在零度结冰。"), (2, "光合作用は植物が光をエネルギーに変える過程です。"), (3, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"),
        (4, "ភ្នំពេញជារាជធានីនៃប្រទេសកម្ពុជា"), (5, "用Python3计算前十个质数的和是多少"),
    ]
    docs = []
    for i, text in items:
        m = len(text) // 2
        for j, body in enumerate((text, text[: m - 1] + "龍" + text[m:], text[: m - 1] + text[m:], text[:m] + "龍" + text[m:])):
            docs.append((10 * i + j, f"众所周知我们都说{body}这是真的"))
    docs += [(100, "水在火上。一百度很热，零度很冷。"), (101, "กรุงเทพ และ เมืองไทย"), (102, "Water boils at 100 degrees."), (103, "用Python4计算")]
    want = brute(items, docs)
    assert set(want) == {(10 * i + j, i) for i, _ in items for j in range(4)} and set(want.values()) == {0, 1}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(d, b).collect()} == want
    assert {r["doc_id"] for r in decontam.without_leaks(d, b).collect()} == {100, 101, 102, 103}
    assert decontam.words("Foo_bar naïve 東京tower2本 ที่") == ["foo", "bar", "naïve", "東", "京", "tower2", "本", "ท", "ี", "่"]


def test_table(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in documents.where("n_chars < 1500").select("doc_id", "text").limit(120).collect()]
    holders = [tuple(r) for r in documents.select("doc_id", "text").collect() if any(t in r["text"] for _, t in items)]
    docs = list(dict(docs + holders).items())
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    have = {(r["doc_id"], r["item_id"]) for r in got}
    assert have >= {(d, i) for d, t in holders for i, x in items if x in t} and holders
    short = [(d, t) for d, t in docs if len(t) < 3000][:25]
    assert brute(items, short) == {(d, h[0]): h[2] for d, t in short for h in decontam.search_all([t], [items], "table", 0.2)[0]}


def test_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "...", "x"), (None, "one two", "x"), (4, "one two three four five six", "x"), (4, "one two three four five six", "x"), (5, "a b c d", "x")], "item_id long, text string, distance string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(edges, bench).collect()}
    assert got == {(6, 4), (7, 4), (10, 5), (11, 5)}
    assert decontam.without_leaks(edges, bench).columns == edges.columns
    assert decontam.leaks(nothing, bench).count() == 0
    assert decontam.leaks(edges, bench.limit(0)).count() == 0 and decontam.without_leaks(edges, bench.limit(0)).count() == edges.count()
