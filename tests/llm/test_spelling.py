"""Spelling variants against brute force over all pairs of words, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from checks import same

from loomstead.llm import spelling

SCHEMA = "doc_id long, text string"


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute(rows):
    words, out = counted(rows), {}
    for w, n in words.items():
        around = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(around, default=None)
        out[w] = [best[1] if best and -best[0] >= 10 * n else None, n, len(around), -best[0] if best and -best[0] >= 10 * n else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def got(df):
    return {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    """Words of few letters and their misspellings, chains of forms, ties, letters twice in a row, ends of the pattern."""
    rng, out = random.Random(5), []
    words = ["".join(rng.choice(("ab", "abÀé")[i % 2]) for _ in range(rng.randrange(7, 7 + (2, 5)[i % 2]))) for i in range(150)] + ["aaaaaaa", "aaaaaaaa", "bbbbbbbbb", "ÿÿÿÿÿÿÿ"]
    for i in range(250):
        text = " ".join(rng.choice(words) for _ in range(40))
        out.append((i, text))
    chain = ["wonderful", "wonderfull", "wonderfulll", "wonderfullly"]
    out += [(1000 + i, f"{chain[0]} " * 100 + f"{chain[1]}-" * 9 if i < 25 else f"{chain[2]} ") for i in range(40)]
    out += [(2000, "wonderfullly wonderfullly"), (2001, "Thirteen thirteem thirteem THIRTEEN thirtee×n"), (2002, "ab " * 9 + "wonder1ful ßßßßßßß ßßßßßßß ÀÀÀÀÀÀÀ")]
    return out


def test_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert sum(w[0] is not None for w in want.values()) > 3 and max(w[2] for w in want.values()) > 5
    assert got(spelling.group(df)) == want
    # each word is in several parts, and halves that many share are joined instead
    assert got(spelling.group(df, part=50)) == want
    assert got(spelling.group(df, part=50, hot=4)) == want


def test_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(spelling.group(spark.createDataFrame(rows, SCHEMA)), con, spelling.GROUP_SQL)


def test_long_words(spark, monkeypatch):
    """Words longer than a block of candidates."""
    monkeypatch.setattr(spelling, "BLOCK", 64)
    rng = random.Random(2)
    base = "".join(rng.choice("abc") for _ in range(700))
    rows = [(None, w) for w in [base, base[:300] + base[301:], base[:600] + "cab"[("abc".index(base[600]))] + base[601:], base + "a", base[:5] * 200] for _ in range(3)] * 2
    want = brute(rows)
    assert sorted(w[2] for w in want.values())[-1] == 3 and got(spelling.group(spark.createDataFrame(rows, SCHEMA))) == want


def test_edges(spark, edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()] * 2
    assert got(spelling.group(edges.unionAll(edges))) == brute(rows) != {}
    assert spelling.group(nothing).count() == 0
    once = spark.createDataFrame([(None, "lettersx lettersx"), (None, "lettersx"), (1, None)], SCHEMA)
    assert got(spelling.group(once)) == {"lettersx": [None, 3, 0, None, "lettersx"]}
