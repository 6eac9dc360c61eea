"""Token counts, packing and the id coder against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from edges import EDGES, LONG
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstead.llm import idcoder, packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtabcXYZ019.,!<|>é\u00a0")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_any_text(library, text):
    assert tokens.encoder(BYTES).encode(text).tolist() == ids_of(library, BYTES, text)
    assert tokens.encoder(BYTES).count([text]) == [len(ids_of(library, BYTES, text))]
    assert idcoder.word_encoder(WORDS).encode_batch([text])[0].tolist() == ids_of(library, WORDS, text)


def test_tables(library, documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    assert tokens.encoder(BYTES).count(texts) == [len(ids_of(library, BYTES, t)) for t in texts]
    assert all(a.tolist() == ids_of(library, WORDS, t) for a, t in zip(idcoder.word_encoder(WORDS).encode_batch(texts), texts, strict=True))


def test_safe_chunks(library):
    text = LONG[:200_000] + "é" + LONG[:100_000]
    assert "".join(tokens.safe_chunks(text)) == text and len(list(tokens.safe_chunks(text))) > 3
    assert tokens.encoder(BYTES).count([text]) == [len(ids_of(library, BYTES, text))]


@settings(max_examples=250, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtXΣςİ019.,!<|>é\u00a0\u0301\x85\x1c。、日本かな")), max_size=80))
def test_any_cut(library, text):
    """Pieces cut at the first safe place encode as the whole does."""
    pieces = list(tokens.safe_chunks(text, 1))
    assert "".join(pieces) == text
    for path in (BYTES, WORDS):
        assert [i for p in pieces for i in ids_of(library, path, p)] == ids_of(library, path, text)


def test_long_texts_of_any_script():
    for unit in ("日本語の文章、これは長い。", "ab1 ", "слово\n"):
        assert len(list(tokens.safe_chunks(unit * 100_000))) > 3


def test_batches(library, documents):
    """Texts encode alike alone and together, whatever stands beside them."""
    texts = ["", " ", "one", "one two", "\n", "ONE!! it's", "日本 mixed", "", *[r["text"] for r in documents.select("text").limit(40).collect()]]
    encoder = idcoder.word_encoder(WORDS)
    assert [x.tolist() for x in encoder.encode_batch(texts)] == [ids_of(library, WORDS, t) for t in texts]
    assert [x.tolist() for x in encoder.encode_batch(["", "  "])] == [[], []] and encoder.encode_batch([]) == []


def test_counts(library, edges, nothing):
    got = sorted(tokens.count_tokens(edges, BYTES).collect(), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(ids_of(library, BYTES, t)), n > 1024) for i, t in EDGES], key=lambda r: str(r))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(nothing, BYTES).count() == 0


def check_packing(library, rows, docs, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, texts in docs.items():
        ids = [np.array([*ids_of(library, BYTES, t), 1], "<u4") for t in texts]
        want = sorted((s, len(x[s : s + size]), zlib.crc32(x[s : s + size].tobytes()), len(x)) for x in ids for s in range(0, len(x), size))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i]) == want
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return 1 - sum(r["length"] for r in rows) / size / len(by_sequence)


def grouped(pairs):
    out = {}
    for i, t in pairs:
        out.setdefault(i, []).append(t)
    return out


def test_packing(library, documents, edges, nothing):
    docs = grouped((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    assert check_packing(library, packing.pack(documents, BYTES).collect(), docs, 2048) < 0.01
    check_packing(library, packing.pack(edges, BYTES).collect(), grouped(EDGES), 2048)
    check_packing(library, packing.pack(edges, BYTES, size=7).collect(), grouped(EDGES), 7)
    assert packing.pack(nothing, BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_patterns(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    placed = {}
    for pattern, count in patterns:
        assert count > 0 and sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            placed[length] = placed.get(length, 0) + n * count
    assert placed == histogram
    ranks = {}
    for length, first, last, *_ in packing.places(patterns):
        ranks.setdefault(length, []).append((first, last))
    for length, spans in ranks.items():
        assert sorted(spans)[0][0] == 0 and sum(b - a + 1 for a, b in spans) == histogram[length]


def test_ranks_of_a_hot_length(spark):
    pieces = spark.range(30_000).selectExpr("id as doc_id", "0L as start", "if(id % 3 = 0, 7L, id % 100) as length", "id as ids_crc32", "1L as doc_tokens")
    got = packing.ranked(pieces, 30_000, per_bucket=100).groupBy("length").agg({"rank": "max", "*": "count"}).collect()
    assert all(r["max(rank)"] + 1 == r["count(1)"] for r in got)
    assert packing.ranked(pieces, 30_000).select("length", "rank").distinct().count() == 30_000


def test_all_ids_in_a_segment():
    """A segment may hold every id of 16 bits, be it once or beside frequent ones."""
    every = np.random.default_rng(3).permutation(1 << 16).astype(np.uint16)
    for ids in (every, np.concatenate([every, np.tile(every[:7], 20_000)])):
        assert (idcoder.read_segment(idcoder.write_segment([1], [ids]))[1][0] == ids).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65_535), max_size=50), max_size=8), st.integers(0, 2**32))
def test_segments(parts, seed):
    rng = np.random.default_rng(seed)
    ids = [np.array(p, np.uint16) for p in parts] + [rng.integers(0, 9, 5000).astype(np.uint16), rng.integers(0, 65_535, 3000).astype(np.uint16), np.full(4097, 5, np.uint16)]
    names = [None if k % 3 == 1 else k - 2 for k in range(len(ids))]
    data = idcoder.write_segment(names, ids)
    back, got = idcoder.read_segment(data)
    assert back == names and all(a.tolist() == b.tolist() for a, b in zip(ids, got, strict=True))


def test_damage():
    data = bytearray(idcoder.write_segment([1, 2], [np.arange(3000, dtype=np.uint16), np.arange(9, dtype=np.uint16)]))
    for at in (0, 20, 33, 40, 90, len(data) - 300):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            idcoder.read_segment(bytes(bad))
    assert len(idcoder.write_segment([1], [np.full(100_000, 7, np.uint16)])) < 3000
    assert idcoder.read_segment(idcoder.write_segment([], [])) == ([], [])


def test_ratio(documents):
    """The segments take a sixth less, at least, than zlib on the same blocks, and each order helps."""
    encoder = idcoder.word_encoder(WORDS)
    flat = np.concatenate(encoder.encode_batch([r["text"] or "" for r in documents.select("text").collect()]))
    flat = flat[: len(flat) // idcoder.BLOCK * idcoder.BLOCK]
    size = len(idcoder.write_segment([1], [flat]))
    deflated = sum(len(zlib.compress(flat[a : a + idcoder.BLOCK].astype("<u2").tobytes(), 9)) for a in range(0, len(flat), idcoder.BLOCK))
    assert size < deflated * 5 / 6
    # pairs that recur are cheap by order 1, longer patterns by order 2, frequent ids by order 0
    rng = np.random.default_rng(5)
    words = rng.choice(100, 40_960)
    by = lambda x: len(idcoder.write_segment([1], [x.astype(np.uint16)]))
    follower, two = rng.permutation(100) + 100, words.copy()
    two[1::2] = follower[two[::2]]
    assert by(two) < 0.7 * by(words)
    # two ids tell the third, one tells nothing
    three = np.tile(np.cumsum(np.repeat(np.arange(1, 17), 17)) % 17, 150)
    assert by(three) < 0.7 * by(rng.permutation(three))
    assert by(rng.geometric(0.2, 40_960)) < 0.6 * by(words)


def test_destination(spark, documents, tmp_path):
    place = f"file://{tmp_path}/ids"
    idcoder.write_ids(documents.limit(20), WORDS, destination=place)
    kept = idcoder.read_ids(spark.read.parquet(place))
    assert kept.count() == 20 and kept.agg({"start": "min"}).first()[0] == 0


def test_id_files(library, documents, edges, nothing):
    for df, segment in ((documents, idcoder.BLOCK * idcoder.LANES), (documents, 100_000), (edges, 30_000)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = idcoder.read_ids(idcoder.write_ids(df, WORDS, segment_ids=segment)).collect()
        n, starts = 0, {}
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = np.array([*ids_of(library, WORDS, t), 1], "<u4")
            starts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
            n += len(ids)
        found, total = {}, 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == total
            total += r["n_tokens"]
            found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert total == n and order == sorted(order, key=lambda i: (i is not None, i or 0))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in starts.items()}
    assert idcoder.read_ids(idcoder.write_ids(nothing, WORDS)).count() == 0
