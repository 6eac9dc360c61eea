"""Components against brute force over all pairs of full sets."""

import random
import re

import pytest

from loomstead.llm import neardup


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(docs):
    """{doc_id: (size, smallest id reachable)}; pairs that share nothing are found by an index."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i in sets:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for a in sets:
        for b in {b for s in sets[a] for b in index[s] if b > a}:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, docs, **how):
    got = neardup.group(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **how).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    return want


def test_table(spark, documents):
    want = check(spark, [tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_groups(spark, texts, seed):
    """Copies with few to many edits, borderline ones, a passage and a line that many share, chains, short texts."""
    rng = random.Random(seed)
    docs, passage, base = [], texts(60, 10_000), texts(120, 10_000).split()
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        docs.append(" ".join(copy))
    docs += [f"{texts(rng.randrange(5, 40), 10_000)} {passage} {texts(rng.randrange(5, 40), 10_000)}" for _ in range(120)]
    docs += [f"{texts(rng.randrange(1, 9), 5)} the same short line here" for _ in range(80)]
    chain = texts(100, 10_000).split()
    for _ in range(40):
        chain = [*chain[4:], *[f"c{rng.random()}" for _ in range(4)]]
        docs.append(" ".join(chain))
    docs += [texts(rng.randrange(0, 7), 3) for _ in range(60)] + docs[:5] + [docs[0].upper(), docs[0].replace(" ", " \n")]
    rng.shuffle(docs)
    want = check(spark, list(enumerate(docs)))
    sizes = {}
    for _, c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) > neardup.LONG
    if seed == 1:
        check(spark, list(enumerate(docs)), risk=0)


def test_meetings_of_shared_blocks(spark, texts):
    """300 documents of 12 of 24 shared blocks each: no link, and fewer meetings than pairs."""
    rng = random.Random(3)
    blocks = [texts(16, 10_000) for _ in range(24)]
    docs = [(i, " ".join(rng.sample(blocks, 12))) for i in range(300)]
    want = check(spark, docs)
    assert len({c for _, c in want.values()}) == 300
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lists = neardup.whole_lists(neardup.full_sets(df, df.select("doc_id")), 75)
    none = spark.createDataFrame([], "doc_id long, component long")
    assert neardup.meetings(lists, none, None)[0].count() < 300 * 299 / 2


def test_slabs(monkeypatch, texts):
    import pyarrow as pa

    rows = pa.array([texts(3000), "x" * 9000, None, "a b c d e f " * 900, texts(50)])
    whole = [s.tolist() for _, _, sets in neardup.shingle_sets(rows, 1 << 30) for s in sets]
    monkeypatch.setattr(neardup, "SLAB", 1000)
    assert [s.tolist() for _, _, sets in neardup.shingle_sets(rows, 1 << 30) for s in sets] == whole


def test_joined_instead_of_filtered(spark, documents, monkeypatch):
    wanted = documents.where("doc_id % 3 = 0").select("doc_id")
    by_filter = {r["doc_id"]: r["values"] for r in neardup.full_sets(documents, wanted).collect()}
    monkeypatch.setattr(neardup, "MOST_BITS", 1)
    assert {r["doc_id"]: r["values"] for r in neardup.full_sets(documents, wanted).collect()} == by_filter and len(by_filter) > 100


def test_edges(spark, edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.group(edges).collect() if r["doc_id"] is not None}
    assert got == {**brute(rows)}
    assert got[1] == got[2][:1] + (1,) and got[6][1] == got[7][1] == 6 and got[10][1] == got[11][1] == 10
    kept = neardup.keep_first(edges)
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 12]
    assert kept.where("doc_id IS NULL").count() == 2
    assert neardup.group(nothing).count() == 0 and neardup.keep_first(nothing).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(1, 400).selectExpr("id - 1 as a", "id as b").unionByName(spark.createDataFrame([(1000, 2000), (1500, 2000)], "a long, b long"))
    got = {r["doc_id"]: r["component"] for r in neardup.connected(links).collect()}
    assert got == {i: 0 for i in range(400)} | {1000: 1000, 1500: 1000, 2000: 1000}


def test_risk():
    assert neardup.least_shared(64, 75) == 27


def test_frequent_values(spark, monkeypatch):
    """Few words: lists are long, and their members are listed by further common values; copies with an edit stay linked."""
    rng = random.Random(8)
    texts = [[rng.choice("abcd") for _ in range(60)] for _ in range(500)]
    for i in range(0, 120, 2):
        texts[i + 1] = list(texts[i])
        for _ in range(rng.choice([1, 1, 2])):
            texts[i + 1][rng.randrange(60)] = rng.choice("abcd")
    monkeypatch.setattr(neardup, "DEEP", 4)
    depths, whole = [], neardup.deepened

    def watched(*given):
        out = whole(*given)
        depths.extend(len(r["path"]) for r in out[0].select("path").distinct().collect())
        return out

    monkeypatch.setattr(neardup, "deepened", watched)
    # heads and short lists find most pairs before: without them the lists have to
    monkeypatch.setattr(neardup, "star_pairs", lambda lists, *_: spark.createDataFrame([], "a long, b long, na long, nb long"))
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(neardup, "SHORT", 1)
    want = check(spark, docs, risk=0)
    assert 400 < len({c for _, c in want.values()}) < 500
    assert max(depths) > 1


def test_meetings_grow_in_proportion(spark):
    """Documents of few words meet a bounded number of times each, and twice as many not four times as often."""

    def met(n):
        rng = random.Random(1)
        df = spark.createDataFrame([(i, " ".join(rng.choice("abcde") for _ in range(60))) for i in range(n)], "doc_id long, text string")
        values = neardup.weighted_values(neardup.full_sets(df, df.select("doc_id")))
        none = spark.createDataFrame([], "doc_id long, component long")
        lists, _ = neardup.deepened(neardup.weighted_lists(values, 75), values, none, 75)
        return neardup.meetings(lists, none, None)[0].count()

    few, many = met(4000), met(8000)
    # an entry meets SHORT others in long lists that stay, and half of DEEP in the others; a set of 56 has ten entries
    each = 10 * (neardup.SHORT + neardup.DEEP // 2)
    assert few <= 4000 * each and many <= 8000 * each and many < 3 * few


def test_few_links_in_one_task(spark):
    rng = random.Random(6)
    rows = [tuple(sorted(rng.sample(range(900), 2))) for _ in range(500)]
    links = spark.createDataFrame(rows, "a long, b long")
    results = [{r["doc_id"]: r["component"] for r in neardup.connected(links, few).collect()} for few in (0, 100, 10**6)]
    assert results[0] == results[1] == results[2] and len(results[0]) == len({x for row in rows for x in row})


def test_near_copies_meet_in_few_lists(spark, texts, monkeypatch):
    """Of a large group of near copies each meets the head a few times, not in all lists that they share."""
    rng, base, docs = random.Random(5), texts(300, 20_000).split(), []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(300), 3):
            words[at] = f"edit{i}x{at}"
        docs.append((i, " ".join(words)))
    entries, plain = [], neardup.skew_safe_left_join

    def counted(left, right, keys, *more):
        if keys == ["value", "class"]:
            entries.append(left.count())
        return plain(left, right, keys, *more)

    monkeypatch.setattr(neardup, "skew_safe_left_join", counted)
    want = check(spark, docs)
    assert {c for _, c in want.values()} == {0}
    # two classes of size at most
    assert entries and sum(entries) <= 2 * 2 * 3 * len(docs)
