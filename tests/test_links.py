"""Links to symbols against a plain search."""

import random
import re

from loomstead.operators import links

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, symbols):
    out = {}
    for doc in {d for d, _ in docs if d is not None}:
        kept = set()
        for text in [t for d, t in docs if d == doc]:
            ws, found = split(text), set()
            for _, name in symbols:
                ns = split(name)
                found |= {(i, i + len(ns)) + tuple(ns) for i in range(len(ws)) if ns and ws[i : i + len(ns)] == ns}
            kept |= {f for f in found if not any(g[0] <= f[0] and g[1] >= f[1] and g != f for g in found)}
        for s, name in symbols:
            starts = [f[0] for f in kept if list(f[2:]) == split(name)]
            if starts:
                out[doc, s] = (len(starts), min(starts))
    return out


def run(spark, docs, symbols):
    rows = links.symbol_links(spark.createDataFrame(docs, "id long, text string, phrase string") if docs and len(docs[0]) == 3 else spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame(symbols, "sid string, name string"), "sid", "name").collect()
    got = {(r["doc"], r["symbol"]): (r["places"], r["first_place"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_search(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(links, "SPAN", 5)  # names cross the ends of blocks
    text = lambda n: " ".join(rng.choice("get Set user users all É1 x_y".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(30)] + [(3, text(40)), (4, None), (5, ""), (None, "get user"), (7, "get user"), (7, "get user")]
    symbols = [(f"s{i}", text(rng.randrange(1, 4))) for i in range(25)] + [("n", None), ("e", "--"), ("a", "getUser"), ("b", "GETUSER"), ("c", "never said")]
    want = plain(docs, symbols)
    assert want and run(spark, docs, symbols) == want


def test_long_text_and_clashing_columns(spark):
    """A name many times in a very long text; a longer name takes the places of the one inside it."""
    docs = [(1, "open the file " * 20_000 + "open the door", "clash"), (2, "the file", "clash")]
    got = run(spark, docs, [("f", "the file"), ("o", "Open the File"), ("t", "the")])
    assert got == {(1, "o"): (20_000, 0), (1, "t"): (1, 60_001), (2, "f"): (1, 0)}


def test_empty(spark):
    assert links.symbol_links(spark.createDataFrame([], "id long, text string"), "id", "text", spark.createDataFrame([], "sid string, name string"), "sid", "name").count() == 0
    assert run(spark, [(1, "a b")], [("s", "c")]) == {}
