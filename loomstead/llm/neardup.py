"""Near-duplicates by bottom-k sketches from one hash function.

Words are runs of anything but ASCII white space, A-Z in lower case; a document's set has the distinct hashes of its
five-word shingles, or of all its words if they are fewer. Documents whose sets have a similarity of 0.75 or more
are linked, confirmed on the full sets; a component is what links reach.

1. Equal sets form a class, of which the smallest doc_id goes on.
2. Each class keeps its k smallest hashes. Two linked sets share c of them at least (all but 1 in 10^8 borderline
   pairs; surely where sketches hold whole sets), so they share one of the size - c + 1 retained values of each that
   are rarest over the corpus: only these get into the inverted lists. A passage that many documents share, but that
   makes up less than that part of them, brings no two of them together.
3. Lists are kept by classes of size. In short lists everyone meets; in those of a set's ENDS rarest and most
   frequent listed values it meets the member that has least to itself, which in a group of near copies is the one
   closest to all. Overlaps in the union's sketch filter the pairs, exact similarity verifies them.
4. Pairs inside a component need no more work. What is left in lists over several components: in lists of up to
   LONG members, pairs across components meet; the members of longer lists are indexed again by their full sets and
   by narrow classes of size. There values that lie in the same sets, such as those of a shared passage, are one value
   with a weight, and a set that has a seventh of its values to itself is in no list of its size.
5. Where such a list has more than DEEP members, its members are listed anew by the next value that they can have in common, and
   again, as long as that makes meetings fewer. So those who meet in it have several values in common, and frequent
   values alone bring no two together.

   Lists with the same entries are looked at once, and pairs meet in the list of their rarest common value (the rarest
   ones) only if enough values are left behind it.

Null and empty texts, and rows without doc_id, are linked with nothing; the latter have no component and are kept.
Exact repeats of a row are one document, and of texts with equal sets (ties) the smallest doc_id stands for all. Very
long texts are hashed in slabs, in memory of some ten times their size. Other columns of docs, whatever their
names, are not read, and `keep_first` gives them back. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import materialize, settled, skew_safe_left_join
from loomstead.llm.tokens import by_bytes

SHINGLE, SIMILARITY, RETAINED = 5, 75, 64
#: The chance that sketches lose a pair of the least similarity that is linked; 0 takes full sets throughout.
RISK = 1e-8
#: Lists in which everyone meets at once, and lists beyond which members are indexed again.
SHORT, LONG = 4, 32
#: In longer lists of sketches a set meets the head only in so many lists of its rarest and of its most frequent values.
ENDS = 3
#: Lists of full sets beyond which members are listed by a further value.
DEEP = 8
#: Classes of size of full sets.
NARROW = 1.04
SKETCHES = "doc_id long, n_shingles long, class binary, sketch array<long>"
SETS = "doc_id long, values array<long>"
#: Texts of which full sets are wanted are marked in a filter of FILTER_BITS bits for each, which goes to the tasks that
#: read texts again; a filter of more than MOST_BITS (8 MB) isn't made, wanted texts are then shuffled by a join.
FILTER_BITS, MOST_BITS = 12, 1 << 26
#: Texts longer than twice this are hashed in slabs.
SLAB = 1 << 20
#: Entries of a list that meet the others in one task.
PART = 512
#: Links that one task puts together.
FEW = 1 << 18
_M1, _M2, _M3, _P, _Q = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            table = np.full(max(n, 1 << 19), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def _slab_words(raw: np.ndarray, bounds: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of raw begin, and their hashes; bounds are between texts."""
    ink = ~gaps[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    begin = np.flatnonzero(ink & (first[:-1] | ~np.concatenate([[False], ink[:-1]])))
    end = np.flatnonzero(ink & (first[1:] | ~np.concatenate([ink[1:], [False]]))) + 1
    power, inverse = _power_tables(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    return begin, _mix((total[end] - total[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64) * _M3)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The same, in slabs of about SLAB bytes that end at gaps (the bytes between words) or between texts."""
    if len(raw) <= 2 * SLAB:
        return _slab_words(raw, bounds, gaps)
    begins, hashes, start = [], [], 0
    while start < len(raw):
        end = min(start + SLAB, len(raw))
        following = bounds[np.searchsorted(bounds, end)]
        while end < following and not (gap := gaps[raw[end : min(end + 4096, following)]]).any():
            end = min(end + 4096, following)
        if end < following:
            end += int(gap.argmax())
        inside = bounds[(bounds > start) & (bounds < end)] - start
        begin, word = _slab_words(raw[start:end], np.concatenate([[0], inside, [end - start]]), gaps)
        begins.append(begin + start)
        hashes.append(word)
        start = end
    return np.concatenate(begins), np.concatenate(hashes)


def _sets(raw: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not len(raw):
        return [np.zeros(0, np.int64)] * len(sizes)
    begin, word = word_hashes(raw, bounds)
    edges = np.searchsorted(begin, bounds)
    n = len(word)
    wide = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        wide[: n - j] = wide[: n - j] * _Q + word[j:]
    wide = (_mix(wide + np.uint64(SHINGLE)) >> np.uint64(1)).astype(np.int64)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(wide[a : b - SHINGLE + 1]))
        elif b > a:
            few = np.zeros(1, np.uint64)
            for w in word[a:b]:
                few = few * _Q + w
            out.append((_mix(few + np.uint64(b - a)) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def raw_batches(texts: pa.Array, batch_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes of their texts, sizes), about batch_bytes at a time, null texts empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in by_bytes(sizes, batch_bytes):
        part = texts.slice(a, b - a).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
        yield a, b, data[offsets[0] : offsets[-1]], np.diff(offsets)


def shingle_sets(texts: pa.Array, batch_bytes: int = 1 << 18) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end, the sorted distinct hashes (63 bits) of each text's shingles), about batch_bytes at a time."""
    for a, b, raw, sizes in raw_batches(texts, batch_bytes):
        yield a, b, _sets(raw, sizes)


def sketches(docs: DataFrame, retained: int = RETAINED) -> DataFrame:
    """SKETCHES of every row of docs (doc_id, text); class is a digest of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in shingle_sets(batch.column(1)):
                classes = [blake2b(values.tobytes(), digest_size=16).digest() for values in sets]
                columns = [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(classes, pa.binary()), _lists([values[:retained] for values in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHES)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """SETS of the documents in wanted (doc_id), which are read again.

    A filter sized by the number of wanted documents tells tasks which texts to leave out where they lie; beyond
    MOST_BITS the texts are joined with the wanted ids first. Either way only the sets of few others are shuffled.
    """
    wanted = materialize(wanted.distinct())
    named, count = docs.where(F.col("doc_id").isNotNull()), wanted.count()
    if count * FILTER_BITS > MOST_BITS:
        chosen = named.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return materialize(chosen.mapInArrow(lambda batches: _set_batches(batches), SETS))
    bits = 1 << max(16, (count * FILTER_BITS - 1).bit_length())
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = wanted.select(F.bitmap_bucket_number(spot + 1).alias("k"), F.bitmap_bit_position(spot + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    marks = np.zeros(bits, bool)
    for r in maps:
        part = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        marks[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(marks).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        yield from _set_batches(batch.filter(pa.array(marked[batch.column(2).to_numpy()])) for batch in batches)

    read = named.select("doc_id", "text", spot.alias("bit")).mapInArrow(run, SETS)
    return materialize(read.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets in shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), _lists(sets)], names=["doc_id", "values"])


def least_shared(retained: int, similarity: int, risk: float = RISK) -> int:
    """The most c for which fewer than c of the union's retained values are shared by a linked pair with this risk at most."""
    p, below = similarity / 100, 0.0
    for c in range(retained + 1):
        below += comb(retained, c) * p**c * (1 - p) ** (retained - c)
        if below > risk:
            return c
    return retained


def required(n: Column, retained: int, similarity: int, risk: float) -> Column:
    """How many retained values a set of n shares with a linked one."""
    # partners of sets that small are retained as a whole too
    return F.when(n <= retained * similarity // 100, F.ceil(n * similarity / 100)).otherwise(least_shared(retained, similarity, risk))


def _class(n: Column, ratio: float) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(ratio)))


def _shared_values(sets: DataFrame, held: Column) -> DataFrame:
    """doc_id, n, shared (its values that other sets have, the rarest first), alone (how many others have not)."""
    postings = sets.select("doc_id", "n", F.explode("values").alias("value"))
    common = materialize(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    total = common.agg(F.sum("df")).first()[0] or 0
    known = skew_safe_left_join(postings, common.withColumn("rows", F.col("df")), ["value"], "rows", total).where(F.col("df").isNotNull())
    shared = known.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    return shared.withColumn("alone", held - F.size("shared"))


def _entries(shared: DataFrame, ratio: float, least: Column, similarity: int, held: Column) -> DataFrame:
    """The lists: value, path (its df and itself), class, doc_id, n, alone, place (of the value among the set's, the rarest first), own, ends.

    A list is of one value and, for linked pairs, of the size class of the smaller set: a set is entered under its
    own class and under those of smaller partners. `least` is what it shares at least with a set of its class
    column's sizes, so that of its rarest values held - least + 1 suffice; values that nobody else has come first. ends
    marks the first and the last ENDS of these. A column `component` of shared stays.
    """
    own, lowest = _class(F.col("n"), ratio), _class(F.ceil(F.col("n") * similarity / 100), ratio)
    dealt = shared.withColumn("class", F.explode(F.sequence(lowest, own)))
    taken = F.greatest(F.lit(0), held - least + 1 - F.col("alone")).cast("int")
    more = [c for c in ("component",) if c in shared.columns]
    rows = dealt.select("class", "doc_id", "n", "alone", *more, F.least(taken, F.size("shared")).alias("_m"), F.posexplode(F.slice("shared", F.lit(1), taken)).alias("_p", "_v"))
    path, ends = F.array(F.struct("_v.df", "_v.value")).alias("path"), (F.col("_p") < ENDS) | (F.col("_p") >= F.col("_m") - ENDS)
    return materialize(rows.select("_v.value", path, "class", "doc_id", "n", "alone", (F.col("alone") + F.col("_p")).alias("place"), (F.col("class") == own).alias("own"), ends.alias("ends"), *more))


def sketch_values(classes: DataFrame, retained: int) -> DataFrame:
    """What the sketches of classes (doc_id, n, sketch) share, a row for each, as a table."""
    return materialize(_shared_values(classes.select("doc_id", "n", F.col("sketch").alias("values")), F.least("n", F.lit(retained))))


def sketch_lists(shared: DataFrame, retained: int, similarity: int, risk: float) -> DataFrame:
    """Lists of sketch_values."""
    held = F.least("n", F.lit(retained))
    return _entries(shared, 100 / similarity, required(F.col("n"), retained, similarity, risk), similarity, held)


def weighted_values(sets: DataFrame) -> DataFrame:
    """doc_id, n, df, value, w, place: the values of sets (doc_id, values) that others have too, as a table.

    Values that lie in the same sets are one, the smallest, with their number as weight w. place is how many of the
    set's values come before it: those that nobody else has, then the rarest.
    """
    postings = sets.select("doc_id", F.size("values").cast("long").alias("n"), F.explode("values").alias("value"))
    digest = (F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    common = materialize(postings.groupBy("value").agg(F.count("*").alias("df"), *digest).where("df > 1"))
    total = common.agg(F.sum("df")).first()[0] or 0
    known = skew_safe_left_join(postings, common.withColumn("rows", F.col("df")), ["value"], "rows", total).where(F.col("df").isNotNull())
    weighted = known.groupBy("doc_id", "n", "df", "x", "y").agg(F.min("value").alias("value"), F.count("*").alias("w"))
    rarest = Window.partitionBy("doc_id").orderBy(F.desc("df"), F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return materialize(weighted.select("doc_id", "n", "df", "value", "w", (F.col("n") - F.sum("w").over(rarest)).alias("place")))


def _least(n: Column, size_class: Column, similarity: int, ratio: float) -> Column:
    """What a set of n shares at least with a linked one of this class, or of a higher one."""
    smallest = F.greatest(F.ceil(n * similarity / 100), F.floor(F.pow(F.lit(ratio), size_class)))
    return F.ceil((n + smallest) * similarity / (100 + similarity))


def whole_lists(sets: DataFrame, similarity: int, ratio: float = NARROW) -> DataFrame:
    """Lists of full sets, by narrow classes of size, which tell how much must be shared."""
    return weighted_lists(weighted_values(sets), similarity, ratio)


def weighted_lists(values: DataFrame, similarity: int, ratio: float = NARROW) -> DataFrame:
    """The same of weighted_values; lists have what _entries gives, and got, the weight of what is listed by."""
    own, lowest = _class(F.col("n"), ratio), _class(F.ceil(F.col("n") * similarity / 100), ratio)
    dealt = values.withColumn("class", F.explode(F.sequence(lowest, own))).where(F.col("n") - F.col("place") >= _least(F.col("n"), F.col("class"), similarity, ratio))
    path = F.array(F.struct("df", "value")).alias("path")
    return materialize(dealt.select("value", path, "class", "doc_id", "n", F.lit(0).cast("long").alias("alone"), "place", (F.col("class") == own).alias("own"), F.col("w").alias("got")))


#: What an entry brings to a meeting.
_ENTRY = ("doc_id", "n", "alone", "place")


def _fits(whole: bool, similarity: int) -> Column:
    """Whether x and y (structs of _ENTRY), who meet in a list, can be linked."""
    n = {c: F.col(f"{c}.n") for c in "xy"}
    fits = (F.least(n["x"], n["y"]) * 100 >= F.greatest(n["x"], n["y"]) * similarity) & (F.col("x.doc_id") != F.col("y.doc_id"))
    if whole:  # in the list of their rarest common values they share nothing else before them, and no value that one of them has alone
        fits &= F.least(n["x"] - F.col("x.place"), n["y"] - F.col("y.place")) * (100 + similarity) >= (n["x"] + n["y"]) * similarity
    return fits


def _pairs(met: DataFrame, fits: Column) -> DataFrame:
    """Distinct pairs a < b with na, nb, of met (structs x and y of _ENTRY)."""
    ordered = F.col("x.doc_id") < F.col("y.doc_id")
    first, second = F.when(ordered, F.col("x")).otherwise(F.col("y")), F.when(ordered, F.col("y")).otherwise(F.col("x"))
    return met.where(fits).select(first["doc_id"].alias("a"), second["doc_id"].alias("b"), first["n"].alias("na"), second["n"].alias("nb")).distinct()


def star_pairs(lists: DataFrame, whole: bool, similarity: int) -> DataFrame:
    """Each entry of a list with the one that has least to itself, and everyone in short lists.

    A set of a group of near copies has the same head in most of its lists, so of sketches only the entries at its `ends`
    meet it; who is not linked thereby still meets across components.
    """
    least = SHORT if not whole else 1
    starred = lists if whole else lists.where("ends")
    entry, fits = F.struct(*_ENTRY), _fits(whole, similarity)
    heads = lists.groupBy("value", "class").agg(F.min(F.when(F.col("own"), F.struct("alone", "doc_id", "n", "place"))).alias("x"), F.count("*").alias("m"), *([F.count("*").alias("rows")] if whole else [F.count(F.when(F.col("ends"), 1)).alias("rows")]))
    heads = materialize(heads.where((F.col("m") > 1) & F.col("x").isNotNull()))
    long = heads.where((F.col("m") > least) & (F.col("rows") > 0)).drop("m")
    total = long.agg(F.sum("rows")).first()[0] or 0
    stars = skew_safe_left_join(starred, long, ["value", "class"], "rows", total).where(F.col("x").isNotNull()).select(F.struct(*[f"x.{c}" for c in _ENTRY]).alias("x"), entry.alias("y"))
    few = materialize(lists.join(heads.where(F.col("m").between(3 if whole else 2, SHORT)).select("value", "class"), ["value", "class"]))
    all_few = few.select("value", "class", entry.alias("x"), "own").join(few.where("own").select("value", "class", entry.alias("y")), ["value", "class"])
    return materialize(_pairs(stars.unionByName(all_few.select("x", "y")), fits))


def _placed(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def meetings(lists: DataFrame, components: DataFrame, longest: int | None) -> tuple[DataFrame, DataFrame]:
    """Who meets (x, y) across components in lists of at most `longest` entries, and who is in longer ones (doc_id).

    Lists with a column `component` have been placed already.

    In each list those outside its largest component meet everyone of another component; short lists of one value are
    done by star_pairs. Of lists with the same entries, such as those of a passage, only that of the rarest value is
    looked at.
    """
    placed = lists if "component" in lists.columns else materialize(_placed(lists, components))
    digest = (F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("x"))
    parts = placed.groupBy("value", "path", "class", "component").agg(F.count("*").alias("m"), F.count(F.when(F.col("own"), 1)).alias("own"), *digest)
    mixed = parts.groupBy("value", "path", "class").agg(
        F.sum("m").alias("m"), F.sum("own").alias("own"), F.count("*").alias("parts"), F.max(F.struct("m", "component"))["component"].alias("main"),
        F.sum("s").alias("s"), F.bit_xor("x").alias("x"),
    )
    mixed = mixed.where((F.col("parts") > 1) & (F.col("own") > 0) & ((F.col("m") > SHORT) | (F.size("path") > 1)))
    mixed = materialize(mixed.groupBy("class", "m", "s", "x").agg(F.min(F.struct("path", "value"))["value"].alias("value"), F.first("main").alias("main")))
    here = mixed.where(F.col("m") <= longest) if longest else mixed
    members = materialize(placed.join(here.select("value", "class", "main", F.ceil(F.col("m") / PART).cast("int").alias("parts")), ["value", "class"]))
    # long lists are dealt over several tasks by their outsiders
    left = members.where("component <> main").select("value", "class", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), *_side("x"))
    right = members.select("value", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), *_side("y"))
    # pairs of two outsiders meet once
    met = left.join(right, ["value", "class", "part"]).where((F.col("x_.component") != F.col("y_.component")) & (F.col("x_.own") | F.col("y_.own")) & (F.col("y_.main") | (F.col("x.doc_id") < F.col("y.doc_id"))))
    if not longest:
        return met, placed.select("doc_id").limit(0)
    return met, materialize(placed.join(mixed.where(F.col("m") > longest), ["value", "class"], "left_semi").select("doc_id").distinct())


def deepened(lists: DataFrame, values: DataFrame, components: DataFrame, similarity: int, ratio: float = NARROW) -> tuple[DataFrame, DataFrame]:
    """weighted_lists in which those of more than DEEP members are listed by further common values, and pairs beside.

    A list's members are listed anew by each value behind the last that leaves enough values for a link. A list stays
    as it is where that doesn't halve its meetings. Members who have enough in common already, and perhaps nothing else,
    are linked with the smallest of them, as all of them are with each other: these are the pairs (structs x and y).
    """
    placed = materialize(_placed(lists, components))
    entry, kept, sure, enough = F.struct(*_ENTRY), None, None, placed.where("own").count() * SHORT
    while True:
        parts = placed.groupBy("value", "class", "component").agg(F.count("*").alias("m"), F.count(F.when(F.col("own"), 1)).alias("own"), F.min(F.struct("n", *_ENTRY[:1], *_ENTRY[2:])).alias("head"))
        sizes = parts.groupBy("value", "class").agg(F.sum("m").alias("m"), F.max("m").alias("main"), F.sum("own").alias("own"), F.min("head").alias("head"))
        cost = (F.col("m") - F.col("main")) * F.col("m")
        crowded = materialize(sizes.where((F.col("m") > DEEP) & (F.col("m") > F.col("main")) & (F.col("own") > 0)).select("value", "class", cost.alias("cost"), "head"))
        if (crowded.agg(F.sum("cost")).first()[0] or 0) <= enough:
            break
        split = placed.join(crowded, ["value", "class"])
        ahead = values.select("doc_id", F.struct("df", F.col("value")).alias("_v"), "w", F.col("place").alias("_place"))
        further = split.select("value", "class", "path", "doc_id", "n", "alone", "own", "got", "component", "cost").join(ahead, "doc_id").where(F.col("_v") > F.element_at("path", -1))
        further = further.where(F.col("got") + F.col("n") - F.col("_place") >= _least(F.col("n"), F.col("class"), similarity, ratio))
        # what is skipped can't be shared
        below = materialize(further.select(
            F.col("value").alias("_parent"), "cost", F.xxhash64("value", "_v").alias("value"), F.concat("path", F.array("_v")).alias("path"), "class", "doc_id", "n", "alone",
            (F.col("_place") - F.col("got")).alias("place"), "own", (F.col("got") + F.col("w")).alias("got"), "component",
        ))
        lesser = below.groupBy("_parent", "cost", "value", "class", "component").agg(F.count("*").alias("m")).groupBy("_parent", "cost", "value", "class").agg(((F.sum("m") - F.max("m")) * F.sum("m")).alias("c"))
        pays = materialize(lesser.groupBy(F.col("_parent").alias("value"), "class").agg(F.sum("c").alias("c"), F.first("cost").alias("cost")).where(F.col("c") * 2 <= F.col("cost")).select("value", "class"))
        # members without a further value that could be shared are only in the list itself
        alone = crowded.join(below.select(F.col("_parent").alias("value"), "class").distinct(), ["value", "class"], "left_anti").select("value", "class")
        gone = materialize(pays.unionByName(alone))
        if gone.isEmpty():
            break
        head = F.struct(F.col("head.doc_id").alias("doc_id"), F.col("head.n").alias("n"), F.col("head.alone").alias("alone"), F.col("head.place").alias("place"))
        done = placed.join(crowded.join(gone, ["value", "class"], "left_semi"), ["value", "class"]).where(F.col("got") * (100 + similarity) >= (F.col("n") + F.col("head.n")) * similarity)
        pairs = done.select(entry.alias("x"), head.alias("y")).where("x.doc_id <> y.doc_id")
        rest = placed.join(gone, ["value", "class"], "left_anti")
        sure, kept = (pairs if sure is None else sure.unionByName(pairs)), (rest if kept is None else kept.unionByName(rest))
        placed = materialize(below.join(gone.withColumnRenamed("value", "_parent"), ["_parent", "class"], "left_semi").select(*placed.columns))
    left = (placed if kept is None else kept.unionByName(placed)).drop("component")
    return materialize(left), materialize((sure if sure is not None else placed.select(entry.alias("x"), entry.alias("y")).limit(0)))


def _side(name: str) -> tuple[Column, Column]:
    return F.struct(*_ENTRY).alias(name), F.struct("component", "own", (F.col("component") == F.col("main")).alias("main")).alias(f"{name}_")


def cross_pairs(lists: DataFrame, components: DataFrame, longest: int | None, whole: bool, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of those who meet and can be linked, and who is in longer lists (doc_id)."""
    met, crowded = meetings(lists, components, longest)
    return materialize(_pairs(met, _fits(whole, similarity))), crowded


def estimated(pairs: DataFrame, classes: DataFrame, retained: int, similarity: int, risk: float) -> DataFrame:
    """The pairs that the sketch of their union doesn't rule out: a, b."""
    of = lambda side: classes.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared, union = F.array_intersect("sa", "sb"), F.array_union("sa", "sb")
    in_sketch = F.size(F.array_intersect(shared, F.slice(F.array_sort(union), 1, retained)))
    whole = F.greatest("na", "nb") <= retained
    likely = F.when(whole, F.size(shared) * 100 >= F.size(union) * similarity).otherwise(in_sketch >= least_shared(retained, similarity, risk))
    return materialize(both.where(likely).select("a", "b"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("values").alias(f"v{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("va", "vb"))
    return materialize(both.where(shared * 100 >= (F.size("va") + F.size("vb") - shared) * similarity).select("a", "b"))


def _followed(pointer: DataFrame, ahead: DataFrame) -> DataFrame:
    """pointer (a, p) with q, where p points to in ahead; an end that very many point to is no hot key."""
    sizes = pointer.groupBy("p").agg(F.count("*").alias("rows"))
    ends = sizes.join(ahead.select(F.col("a").alias("p"), F.col("p").alias("q")), "p")
    return skew_safe_left_join(pointer, ends, ["p"], "rows", pointer.count())


def connected(links: DataFrame, few: int | None = None) -> DataFrame:
    """doc_id, component (the smallest id reachable) of all ends of links (a, b).

    Each id hooks onto its smallest neighbour, pointers are followed to their ends, and the graph between those
    ends goes the same way until no link is left; the last `few` links at most are put together in one task. Only
    counts reach the driver.
    """
    few = FEW if few is None else few
    rest, found = materialize(links.distinct()), None
    while (left := rest.count()) > few:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:
            jumped = materialize(_followed(pointer, pointer).select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            pointer = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        found = pointer if found is None else _over(found, pointer)
        at = lambda side: pointer.select(F.col("a").alias(side), F.col("p").alias(f"p{side}"))  # noqa: E731, B023
        ends = rest.join(at("a"), "a").join(at("b"), "b").where("pa <> pb")
        rest = materialize(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if left or found is None:
        last = materialize(rest.repartition(1).mapInArrow(_together, "a long, p long"))
        found = last if found is None else _over(found, last)
    return found.select(F.col("a").alias("doc_id"), F.col("p").alias("component"))


def _over(found: DataFrame, pointer: DataFrame) -> DataFrame:
    """found (a, p), whose ends point further."""
    return materialize(_followed(found, pointer).select("a", F.coalesce("q", "p").alias("p")))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id reachable of each end of a few links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(above, above)
            x = above
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    ids = sorted(parent)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["a", "p"])


def whole_links(sets: DataFrame, similarity: int, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between full sets (doc_id, values), and known ones, that connect what all links connect."""
    values = weighted_values(sets)
    lists = weighted_lists(values, similarity)
    # these pairs are bounded by what full sets can share, so a sketch says no more
    links = verified(star_pairs(lists, True, similarity), sets, similarity)
    links = materialize(links.unionByName(known)) if known else links
    components = connected(links)
    deep, sure = deepened(lists, values, components, similarity)
    met, _ = meetings(deep, components, None)
    pairs = materialize(_pairs(met.select("x", "y").unionByName(sure), _fits(True, similarity)))
    return links if pairs.isEmpty() else materialize(links.unionByName(verified(pairs, sets, similarity)))


def links_between(docs: DataFrame, classes: DataFrame, retained: int, similarity: int, risk: float) -> DataFrame:
    """Links (a, b) that connect what all links between classes (doc_id, n, sketch) connect."""
    if risk <= 0:
        return whole_links(full_sets(docs, classes.select("doc_id")), similarity)

    def confirm(pairs: DataFrame) -> DataFrame:
        likely = estimated(pairs, classes, retained, similarity, risk)
        if likely.isEmpty():
            return likely
        ends = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
        return verified(likely, full_sets(docs, ends), similarity)

    shared = sketch_values(classes, retained)
    links = confirm(star_pairs(sketch_lists(shared, retained, similarity, risk), False, similarity))
    # components go to sets, not to each entry of their lists
    components = connected(links)
    placed = sketch_lists(_placed(shared, components), retained, similarity, risk)
    pairs, crowded = cross_pairs(placed, components, LONG, False, similarity)
    if not pairs.isEmpty():
        links = materialize(links.unionByName(confirm(pairs)))
    return links if crowded.isEmpty() else whole_links(full_sets(docs, crowded), similarity, links)


def group(docs: DataFrame, retained: int = RETAINED, similarity: int = SIMILARITY, risk: float = RISK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    A link between sets of the least similarity is lost with a chance of `risk` for each sketch that it has to pass; at
    risk 0 nothing is sketched, lists are of full sets, and no link is lost. The result is a table, and those on the
    way to it are gone.
    """
    return settled(partial(_group, docs, retained, similarity, risk))


def _group(docs: DataFrame, retained: int, similarity: int, risk: float) -> DataFrame:
    sketched = materialize(sketches(docs, retained))
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    reached = connected(links_between(docs, classes.select("doc_id", "n", "sketch"), retained, similarity, risk))
    by_class = materialize(classes.select("class", "doc_id", "rows").join(reached, "doc_id", "left").select("class", "rows", F.coalesce("component", "doc_id").alias("component")))
    rows = skew_safe_left_join(sketched.select("doc_id", "n_shingles", "class"), by_class, ["class"], "rows", sketched.count())
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, retained: int = RETAINED, similarity: int = SIMILARITY, risk: float = RISK) -> DataFrame:
    """The rows of docs, with their columns, that are the first of their component; a repeated row stays once."""
    kept = group(docs, retained, similarity, risk).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


#: DuckDB: all pairs that share a shingle, by plain counting.
GROUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT s.doc_id, len(s.shingles) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""
