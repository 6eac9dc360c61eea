"""Token-id output by an adaptive context-mixing range coder.

Ids go in ascending order of doc_id into segments, each with a directory of its documents, frequency tables of its ids
and blocks of BLOCK ids. A block starts from nothing but the tables. An order-2 and an order-1 model predict the next id
by what followed the last ids before, in cells that check whose they are; order 0 gives each id of the segment its
chance by one of TABLES frequency tables, made for blocks that are alike (their language, say), of which the block's
ids so far choose. Whether order 2 is right, order 1, or neither has its chances from two adaptive distributions, one
by how often the predictions have been right and one by what was right last, mixed by a weight that moves to the one
which was nearer. Arithmetic coding stores which is right and, if neither is, the id by its chance of order 0.
Each block has its length and a checksum of its ids, so blocks are read one by one; the blocks of a segment are coded
and decoded side by side, a numpy lane each.

A segment, little-endian: MAGIC; numbers of documents, ids, blocks and different ids, bytes of the tables (64 bits
each); CRC-32 of the numbers and the directory (32 bits). The directory: whether each doc_id is there (bytes), doc_ids
and lengths (64 bits); the tables: different ids by falling frequency (32 bits) and TABLES lists of their shares (16
bits), deflated if there is more than one id. For each block the number of its 32-bit digits and the CRC-32 of its
ids as unsigned 32-bit integers (32 bits each); the digits of all blocks. Damaged segments raise ValueError.

Null texts count as empty: a document of the end id alone. Rows without doc_id come first; repeated rows are
documents each, equal ids in the order of a hash of their texts (ties). Very long texts are split for the encoder where no
token spans, and cut over blocks; a document lies in one segment. Other columns of docs, whatever their names, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import materialize
from loomstead.llm.tokens import by_bytes, byte_alphabet, safe_chunks

MAGIC = b"TIDC0003"
BLOCK, LANES = 2048, 4096
#: Contexts of order 1, and as many of order 2, that a lane remembers, each with a check of its key.
CONTEXTS = 512
#: Frequency tables of order 0 in a segment, out of 2^FINE each; a block's choice of one is made anew every CHUNK ids.
TABLES, CHUNK, FINE = 4, 64, 16
SEGMENTS = "file long, segment long, n_ids long, data binary"
RECORDS = "doc_id long, file long, segment long, begin long, n_tokens long, ids_crc32 long"
#: Distributions over three outcomes are two rising thresholds and their end, 2^BITS, in FIELD bits each of one integer.
BITS, FIELD = 14, 21
_END = 1 << BITS
_FIELDS, _SLOW = ((m | m << FIELD) for m in (_END - 1, (_END >> 5) - 1))
_TOP = _END << 2 * FIELD
_EVEN = _END // 3 | 2 * _END // 3 << FIELD
#: What an outcome adds after a 32nd of each threshold is taken off: thresholds stay apart and inside.
_STEP = np.array([sum(((_END >> 5) - 3 + j if outcome <= j else j + 1) << FIELD * j for j in range(2)) for outcome in range(3)])
_WEIGHTS = 64
#: Hashes of the last id and of the last two: the former tell all ids of 16 bits apart, the latter are of 22 bits.
_MULTIPLIERS = np.array([[0x9E3779B1], [0x85EBCA77]], np.uint32).view(np.int32)
_SHIFTS, _KEYS = np.array([[0], [10]], np.int32), np.array([[0xFFFF], [0x3FFFFF]], np.int32)
#: The coder's register has 62 bits, of which 32 at a time leave. An interval is at least 2^30 wide, enough for BITS + FINE.
_REST, _LEAST = (1 << 30) - 1, 1 << 30


def _slabs(grid: np.ndarray, rows: int = 256) -> list[np.ndarray]:
    return [grid[a : a + rows] for a in range(0, len(grid), rows)]


class Frequencies:
    """Order 0: the segment's ids by rank, and TABLES distributions over them, each of blocks that are alike."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.ids, self.shares, self.n = ids.astype(np.uint32), shares.astype(np.int64), len(ids)
        begin = np.cumsum(self.shares, axis=1) - self.shares
        #: first slot and number of slots of each rank in each table
        self.spans = (begin | self.shares << FINE + 1).ravel()
        bits = np.round(8 * (FINE - np.log2(self.shares))).astype(np.int64)
        #: eighths of a bit that each rank costs in the four tables, packed
        self.costs = sum(bits[k] << 16 * k for k in range(TABLES))

    @classmethod
    def of(cls, grid: np.ndarray) -> Frequencies:
        """From blocks (a row each); like blocks are found by k-means on hashed counts."""
        counts = sum(np.bincount(part.ravel(), minlength=1 << 16) for part in _slabs(grid))
        ids = np.flatnonzero(counts)
        ids = ids[np.argsort(-counts[ids], kind="stable")]
        counts, place = counts[ids], np.zeros(len(counts), np.uint16)
        place[ids] = np.arange(len(ids))
        ranks, width = place[grid], 512
        seen = []
        for part in _slabs(ranks):
            cells = (part & width - 1) + np.arange(len(part), dtype=np.int64)[:, None] * width
            seen.append(np.sqrt(np.bincount(cells.ravel(), minlength=len(part) * width).reshape(len(part), width).astype(np.float32)))
        seen = np.concatenate(seen)
        centres = [seen.mean(0)]
        for _ in range(TABLES - 1):
            centres.append(seen[np.min([((seen - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
        for _ in range(6):
            kind = np.argmin([((seen - c) ** 2).sum(1) for c in centres], axis=0)
            centres = [seen[kind == k].mean(0) if (kind == k).any() else c for k, c in enumerate(centres)]
        whole = counts / counts.sum()
        shares = []
        for k in range(TABLES):
            own = sum(np.bincount(part.ravel(), minlength=len(ids)) for part in _slabs(ranks[kind == k])).astype(float) if (kind == k).any() else np.zeros(len(ids))
            mixed = 0.95 * own / max(own.sum(), 1) + 0.05 * whole
            share = 1 + np.floor(mixed / mixed.sum() * ((1 << FINE) - len(ids))).astype(np.int64)
            share[share.argmax()] += (1 << FINE) - share.sum()
            shares.append(share)
        made = cls(ids, np.array(shares))
        made.ranks = ranks
        return made

    def to_bytes(self) -> bytes:
        return zlib.compress(self.ids.astype("<u4").tobytes() + self.shares.astype("<u2").tobytes(), 6) if self.n > 1 else self.ids.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, n: int) -> Frequencies:
        if n == 1:
            return cls(np.frombuffer(data, "<u4"), np.full((TABLES, 1), 1 << FINE))
        raw = zlib.decompress(data)
        return cls(np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", TABLES * n, 4 * n).reshape(TABLES, n))

    def slots(self) -> np.ndarray:
        """The rank at each slot of each table."""
        return np.concatenate([np.repeat(np.arange(self.n, dtype=np.uint16), s) for s in self.shares])


class Choice:
    """The table that would have coded a lane's ids so far in the fewest bits."""

    def __init__(self, lanes: int, tables: Frequencies):
        self.costs, self.spent = tables.costs, np.zeros((TABLES, lanes), np.int64)

    def after(self, ranks: np.ndarray) -> np.ndarray:
        packed = self.costs[ranks].sum(0)
        for k in range(TABLES):
            self.spent[k] += packed >> 16 * k & 0xFFFF
        return self.spent.argmin(0)


class Model:
    """What each lane has seen of its block: the same on both sides. Rows of two are of order 1 and order 2."""

    def __init__(self, lanes: int):
        pair = np.arange(2 * lanes).reshape(2, lanes)
        self.row = pair * CONTEXTS
        # a cell: check of the key (13 bits), how often in a row it was right (2), rank (16)
        self.cells = np.full(2 * lanes * CONTEXTS, -0x10000, np.int32)
        self.past, self.products = np.zeros((2, lanes), np.int32), np.empty((2, lanes), np.int32)
        # one distribution by how far to trust each order and whether they agree, one by what was right last
        self.distributions, self.base, self.context = np.full(2 * lanes * 64, _EVEN), pair * 64, np.empty((2, lanes), np.int64)
        self.hits, self.weight, self.seen = np.zeros(lanes, np.int64), np.full(lanes, _WEIGHTS // 2), 0

    def predict(self) -> np.ndarray:
        """The mixed thresholds between order 2 and order 1 being right, and order 0 being needed."""
        np.multiply(self.past, _MULTIPLIERS, out=self.products)
        self.products[1] += self.products[0]
        self.products >>= _SHIFTS
        self.products &= _KEYS
        self.at, self.check = self.row + (self.products & CONTEXTS - 1), (self.products & -CONTEXTS) << 9
        cell = self.cells[self.at]
        self.known, self.ranks = (cell & -0x40000) == self.check, cell & 0xFFFF
        self.trust = (cell >> 16 & 3) * self.known
        np.add(self.trust[1] * 4 + self.trust[0], (self.ranks[0] == self.ranks[1]) * 16, out=self.context[0])
        self.context[1] = self.hits
        self.context += self.base
        self.both = self.distributions[self.context]
        mixed = (self.both[1] - self.both[0]) * self.weight
        mixed += self.both[0] << 6
        mixed >>= 6
        mixed &= _FIELDS
        mixed |= _TOP
        return mixed

    def update(self, ranks: np.ndarray, outcome: np.ndarray) -> None:
        self.seen += 1
        if self.seen % 4 == 0:
            # the weight moves to the distribution that gave the outcome more room
            shift = outcome * FIELD
            room = ((self.both | _TOP) >> shift & 0x1FFFFF) - (self.both << FIELD >> shift & 0x1FFFFF)
            self.weight += np.sign(room[1] - room[0])
            np.minimum(np.maximum(self.weight, 1), _WEIGHTS - 1, out=self.weight)
        self.both -= self.both >> 5 & _SLOW
        self.both += _STEP[outcome]
        self.distributions[self.context] = self.both
        # one more time right, at most three; or a new cell
        cell = np.minimum(self.trust, 2) * (self.ranks == ranks)
        cell += 1
        cell <<= 16
        cell |= self.check
        cell |= ranks
        self.cells[self.at] = cell
        self.past[1] = self.past[0]
        self.past[0] = ranks
        self.hits = (self.hits << 2 | outcome) & 63


def encode_blocks(ranks: np.ndarray, tables: Frequencies) -> list[np.ndarray]:
    """The 32-bit digits of each row of ranks (lanes x BLOCK)."""
    lanes = len(ranks)
    model, choice, everyone, table = Model(lanes), Choice(lanes, tables), np.arange(lanes), np.zeros(lanes, np.int64)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, 1 << 62)
    owners, digits = [], []

    def shift_out(who: np.ndarray) -> None:
        held = low[who]
        owners.append(who.astype(np.uint16))
        digits.append(held >> 30)
        low[who] = (held & _REST) << 32
        wide[who] <<= 32

    for t in range(0, BLOCK, CHUNK):
        part = np.ascontiguousarray(ranks[:, t : t + CHUNK].T).astype(np.int32)
        spans = tables.spans[part + table * tables.n]
        starts, lacks = spans & 0x1FFFF, (1 << FINE) - (spans >> FINE + 1)
        for column, start, lack in zip(part, starts, lacks, strict=True):
            thresholds = model.predict()
            right = model.known & (model.ranks == column)
            outcome = np.subtract(2, right[0], dtype=np.int64)
            outcome *= ~right[1]
            needed, shift = outcome >> 1, outcome * FIELD
            begin = thresholds << FIELD >> shift & 0x1FFFFF
            unit = wide >> BITS
            low += unit * begin
            unit = unit * ((thresholds >> shift & 0x1FFFFF) - begin) >> FINE
            low += unit * (start * needed)
            np.multiply(unit, (1 << FINE) - lack * needed, out=wide)
            shift_out(np.flatnonzero(wide < _LEAST))
            model.update(column, outcome)
        table = choice.after(part)
    for _ in range(2):
        shift_out(everyone)
    owner, digit = np.concatenate(owners), np.concatenate(digits)
    digit = digit[np.argsort(owner, kind="stable")]
    ends = np.cumsum(np.bincount(owner, minlength=lanes))
    # carries go to the digit before
    over = digit >> 32
    while over.any():
        digit &= 0xFFFFFFFF
        digit[:-1] += over[1:]
        over = digit >> 32
    return np.split(digit.astype("<u4"), ends[:-1])


def decode_blocks(digits: np.ndarray, counts: np.ndarray, tables: Frequencies) -> np.ndarray:
    """lanes x BLOCK ranks from the digits of the blocks, of which each has counts."""
    lanes = len(counts)
    model, choice, table = Model(lanes), Choice(lanes, tables), np.zeros(lanes, np.int64)
    slots, spans = tables.slots(), tables.spans
    digits = np.concatenate([digits.astype(np.int64), np.zeros(2, np.int64)])
    # the register ends 2 bits before a digit does
    follow = (digits[:-1] & 3) << 30 | digits[1:] >> 2
    at = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    value, wide, last = digits[at] << 30 | digits[at + 1] >> 2, np.full(lanes, 1 << 62), len(follow) - 1
    at += 1
    out = np.empty((BLOCK, lanes), np.uint16)
    for t in range(BLOCK):
        thresholds = model.predict()
        unit = wide >> BITS
        outcome = (value >= unit * (thresholds & 0x1FFFFF)).astype(np.int64)
        outcome += value >= unit * (thresholds >> FIELD & 0x1FFFFF)
        needed, shift = outcome >> 1, outcome * FIELD
        begin = thresholds << FIELD >> shift & 0x1FFFFF
        value -= unit * begin
        unit = unit * ((thresholds >> shift & 0x1FFFFF) - begin) >> FINE
        slot = np.minimum(value // unit, (1 << FINE) - 1)
        found = slots[slot + (table << FINE)].astype(np.int32)
        span = spans[found + table * tables.n]
        value -= unit * ((span & 0x1FFFF) * needed)
        np.multiply(unit, (1 << FINE) - ((1 << FINE) - (span >> FINE + 1)) * needed, out=wide)
        np.copyto(found, model.ranks[0], where=outcome == 1)
        np.copyto(found, model.ranks[1], where=outcome == 0)
        more = np.flatnonzero(wide < _LEAST)
        place = at[more]
        value[more] = value[more] << 32 | follow[np.minimum(place, last)]
        wide[more] <<= 32
        at[more] = place + 1
        model.update(found, outcome)
        out[t] = found
        if t % CHUNK == CHUNK - 1:
            table = choice.after(out[t - CHUNK + 1 : t + 1])
    return out.T


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment of whole documents."""
    lengths = np.array([len(x) for x in ids], "<i8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    blocks = -(-len(flat) // BLOCK)
    grid = np.full(blocks * BLOCK, flat[0] if blocks else 0, flat.dtype)
    grid[: len(flat)] = flat
    tables = Frequencies.of(grid.reshape(blocks, BLOCK)) if blocks else None
    coded = [d for a in range(0, blocks, LANES) for d in encode_blocks(tables.ranks[a : a + LANES], tables)] if tables else []
    counts = np.array([len(d) for d in coded], "<u4")
    wide = flat.astype("<u4")
    sums = np.array([zlib.crc32(wide[a : a + BLOCK]) for a in range(0, len(flat), BLOCK)], "<u4")
    there = np.array([d is not None for d in doc_ids], np.uint8)
    packed = tables.to_bytes() if tables else b""
    directory = there.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.tobytes() + packed
    numbers = np.array([len(ids), len(flat), blocks, tables.n if tables else 0, len(packed)], "<i8").tobytes()
    head = MAGIC + numbers + np.array([zlib.crc32(numbers + directory)], "<u4").tobytes()
    return b"".join([head, directory, counts.tobytes(), sums.tobytes(), *[d.tobytes() for d in coded]])


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids, and the ids of each, of a segment whose checksums hold."""
    if data[:8] != MAGIC or len(data) < 52:
        raise ValueError("not a segment")
    docs, n_ids, blocks, distinct, packed = np.frombuffer(data, "<i8", 5, 8).tolist()
    at = 52
    if min(docs, packed) < 0 or zlib.crc32(data[8:48] + data[at : at + 17 * docs + packed]) != int.from_bytes(data[48:52], "little"):
        raise ValueError("damaged directory")
    there = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = [d if t else None for d, t in zip(np.frombuffer(data, "<i8", docs, at + docs).tolist(), there, strict=True)]
    lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    tables = Frequencies.from_bytes(data[at : at + packed], distinct) if blocks else None
    at += packed
    counts, sums = np.frombuffer(data, "<u4", blocks, at).astype(np.int64), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    if at + 8 * blocks + 4 * int(counts.sum()) != len(data):
        raise ValueError("damaged block lengths")
    digits = np.frombuffer(data, "<u4", int(counts.sum()), at + 8 * blocks)
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(blocks * BLOCK, "<u4")
    for a in range(0, blocks, LANES):
        b = min(blocks, a + LANES)
        try:
            ranks = decode_blocks(digits[ends[a] : ends[b]], counts[a:b], tables)
        except IndexError as e:
            raise ValueError("damaged blocks") from e
        for k in range(0, b - a, 256):
            part = tables.ids[ranks[k : k + 256]]
            flat[(a + k) * BLOCK : (a + k + len(part)) * BLOCK] = part.ravel()
    flat = flat[:n_ids]
    for k in range(blocks):
        if zlib.crc32(flat[k * BLOCK : (k + 1) * BLOCK]) != sums[k]:
            raise ValueError(f"damaged block {k}")
    return doc_ids, np.split(flat, np.cumsum(lengths)[:-1]) if docs else []


#: Characters on which lower case, normal form and classes are the same everywhere, and white space is as usual.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-©«-´¶-¹»-ÿŒœ–—‘’“”…]")
#: The split pattern of the word-level vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
_MARK = "\x01"
#: Chunks of text whose ids a worker keeps, some tens of megabytes.
KNOWN = 1 << 19
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """A BPE vocabulary file (.json) whose tokens end at white space, as the tokenizers library reads it.

    No token spans white space, so texts of plain characters are split there and each distinct chunk of a batch is
    encoded once; the same merges run in tiktoken, with a mark as the end of each word. Texts with other characters
    or special strings go through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        if self.exact.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special, self.fast = [t["content"] for t in spec["added_tokens"]], None
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        plain = end and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        expected = json.dumps(spec["pre_tokenizer"]) + json.dumps(spec["normalizer"])
        if plain and len(set(merges)) == len(merges) and all(x in expected for x in ("NFC", "Lowercase", "Removed", '"use_regex": false')):
            self._build(model["vocab"], merges, end)

    def _build(self, vocab: dict[str, int], merges: list[str], end: str) -> None:
        import tiktoken

        to_byte = byte_alphabet()
        mark = _MARK.encode()
        raw = lambda t: bytes(to_byte[c] for c in (t[: -len(end)] if t.endswith(end) else t)) + (mark if t.endswith(end) else b"")
        ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        # the mark joins a word's last byte before anything else
        order = [bytes([b]) for b in range(256)] + [x for b in range(256) if (x := bytes([b]) + mark) in ids] + [raw(m) for m in merges]
        self.ids = np.array([ids.get(x, -1) for x in order])
        self.known = self.nothing = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.fast = tiktoken.Encoding("words", pat_str=rf"[^{_MARK}\n]+{_MARK}|\n", mergeable_ranks={x: i for i, x in enumerate(order)}, special_tokens={})

    def _encode_new(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids and all ids of chunks."""
        # a mark after each word; most chunks are one word, or one with a stop behind it
        word, stop = pc.utf8_is_alpha(distinct), pc.match_substring_regex(distinct, r"^\p{L}+[.,;:!?]$")
        other = pc.invert(pc.or_(word, stop))
        stopped = distinct.filter(stop)
        marked = pa.concat_arrays([
            pc.binary_join_element_wise(distinct.filter(word), _MARK, ""),
            pc.binary_join_element_wise(pc.utf8_slice_codeunits(stopped, 0, -1), _MARK, pc.utf8_slice_codeunits(stopped, -1), _MARK, ""),
            pc.replace_substring_regex(distinct.filter(other), f"({WORD_PATTERN})", rf"\1{_MARK}"),
        ])
        rank = np.empty(len(distinct), np.int64)
        rank[np.concatenate([np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (word, stop, other)])] = np.arange(len(distinct))
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(marked)], marked), "\n")[0].as_py()
        codes = self.fast.encode_to_numpy(lines, disallowed_special=())
        # a line end stands between two chunks
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        first = np.concatenate([[0], ends[:-1] + 1])
        return first[rank], (ends - first)[rank], self.ids[codes].astype(np.uint16)

    def _chunk_ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, of which chunks of earlier batches are known; beyond KNOWN of them all are forgotten."""
        if len(self.known[0]) > KNOWN:
            self.known = self.nothing
        chunks, first, lengths, pool = self.known
        at = pc.index_in(distinct, chunks)
        new = distinct.filter(pc.is_null(at))
        if len(new):
            f, n, ids = self._encode_new(new)
            first, lengths, pool = np.concatenate([first, f + len(pool)]), np.concatenate([lengths, n]), np.concatenate([pool, ids])
            number = np.full(len(distinct), -1)
            number[pc.is_null(at).to_numpy(zero_copy_only=False)] = np.arange(len(chunks), len(chunks) + len(new))
            at = np.where(number < 0, pc.fill_null(at, -1).to_numpy(zero_copy_only=False), number)
            self.known = pa.concat_arrays([chunks, new]), first, lengths, pool
        else:
            at = at.to_numpy(zero_copy_only=False)
        return first[at], lengths[at], pool

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Arrow lowers, splits and finds the distinct chunks; the ids of texts are then laid out from theirs."""
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = chunks.flatten().dictionary_encode()
        # a mark after each word; most chunks are one word, or one with a stop behind it
        distinct = coded.dictionary
        first, lengths, pool = self._chunk_ids(distinct)
        at = coded.indices.to_numpy()
        lengths = lengths[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        place = np.repeat((first[at] - total[:-1]).astype(np.int32), lengths)
        place += np.arange(total[-1], dtype=np.int32)
        words = np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(pool[place], total[words][:-1])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint16."""
        plain = [self.fast is not None and not _ODD.search(t) and not any(s in t for s in self.special) for t in texts]
        fast = iter(self._encode_plain(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())) if any(plain) else [])
        parts = [list(safe_chunks(t)) for t, p in zip(texts, plain, strict=True) if not p]
        slow = iter(self.exact.encode_batch_fast([c for chunks in parts for c in chunks], add_special_tokens=False))
        whole = iter([np.concatenate([np.array(next(slow).ids, np.uint16) for _ in chunks]) for chunks in parts])
        return [next(fast) if p else next(whole) for p in plain]


def word_encoder(path: str) -> WordEncoder:
    """Loaded once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, path: str, end_id: int = 1, destination: str | None = None, segment_ids: int = BLOCK * LANES, partition_bytes: int = 24 << 20) -> DataFrame:
    """SEGMENTS of docs (doc_id, text) in ascending order of doc_id, as stored.

    They are Parquet files in the folder `destination`, which must not exist yet, or in the shared folder for
    intermediate tables. A task takes about partition_bytes of text, which gives it enough blocks to code side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, segment, held, docs_held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            data = write_segment(docs_held, held)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([segment], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["file", "segment", "n_ids", "data"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in by_bytes(sizes, 1 << 23):
                part = batch.slice(a, b - a)
                coded = word_encoder(path).encode_batch([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                    docs_held.append(doc_id)
                    held.append(np.append(ids, np.uint16(end_id)))
                    n += len(held[-1])
                    if n >= segment_ids:
                        yield close()
                        segment, held, docs_held, n = segment + 1, [], [], 0
        if docs_held:
            yield close()

    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    key = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(1 + size // partition_bytes, key, tie).sortWithinPartitions(key, tie)
    return materialize(ordered.mapInArrow(run, SEGMENTS), destination)


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in SEGMENTS, read from their data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, segment = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                doc_ids, ids = read_segment(batch.column(2)[k].as_py())
                sizes = np.array([len(x) for x in ids], np.int64)
                sums = [zlib.crc32(x.tobytes()) for x in ids]
                columns = [doc_ids, [file] * len(ids), [segment] * len(ids), np.cumsum(sizes) - sizes, sizes, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "file", "segment", "begin", "n_tokens", "ids_crc32"])

    # a row for each file, then the segments of each
    totals = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = totals.select("file", F.coalesce(F.sum("n").over(before(Window.orderBy("file"))), F.lit(0)).alias("file_base"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("file").orderBy("segment"))), F.lit(0))
    bases = segments.select("file", "segment", inside.alias("base")).join(files, "file")
    records = materialize(segments.select("file", "segment", "data").mapInArrow(run, RECORDS))
    return records.join(bases, ["file", "segment"]).select("doc_id", (F.col("file_base") + F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
