"""Links from documents to the symbols that they name: a phrase index by each name's rarest word, longest match wins.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A name is looked up by the one of its
words that the documents hold least often (ties: the first), so frequent words of a name cost nothing; only where that
word stands is the whole name compared. A match inside a longer one of its text doesn't count. Texts of any length are cut into
blocks, each with the words that a name needs beyond its ends.

Null or empty texts and names without words link nothing, nor do documents without an id. Rows of one id count as one
document: a name at the same place in several of them is one place. Symbols of equal names get the same links.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.sources.shared import materialize

#: Words of a block, at least.
SPAN = 256
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def postings(names: DataFrame, documents: DataFrame) -> DataFrame:
    """word, offset, phrase: each name under its rarest word in documents (text); names with a word that none holds are left out.

    Both tables are written, so Spark knows their size: it broadcasts them below its threshold, beyond it shuffles.
    """
    placed = materialize(names.select("phrase", F.posexplode("phrase").alias("offset", "word")))
    spoken = documents.select(F.explode(words("text")).alias("word")).join(placed.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counted = placed.join(spoken, "word", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("key"))
    return materialize(counted.where("key.n > 0").select("key.word", "key.offset", "phrase"))


def matches(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc, start, end (in words, from 0, end excluded), phrase: where documents (doc, text) hold names (phrase), longest only.

    Each word goes to the join with the words around it, so a hit is verified where it is found.
    """
    around = names.agg(F.coalesce(F.max(F.size("phrase")), F.lit(1))).first()[0] - 1
    span = max(SPAN, around)
    split = documents.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("_text"), words("text").alias("_all")).where(F.size("_all") > 0)
    # a block: words [_from, ...), of which those from _first on, span at most, are its own
    first = lambda at: F.struct(at.alias("_first"), F.greatest(at - around, F.lit(0)).alias("_from"), F.slice("_all", F.greatest(at - around, F.lit(0)) + 1, span + 2 * around).alias("_words"))
    blocks = split.select("doc", "_text", F.inline(F.transform(F.sequence(F.lit(0), F.size("_all") - 1, F.lit(span)), first)))
    own = F.slice("_words", F.col("_first") - F.col("_from") + 1, F.lit(span))
    said = blocks.select("*", F.posexplode(own).alias("_i", "word")).withColumn("_at", F.col("_first") + F.col("_i"))
    lead = F.least(F.col("_at"), F.lit(around))  # words before it that go along
    said = said.select("doc", "_text", "word", "_at", lead.alias("_lead"), F.slice("_words", F.col("_at") - lead - F.col("_from") + 1, F.lit(2 * around + 1)).alias("_near"))
    held = (F.col("_lead") >= F.col("offset")) & (F.slice("_near", F.greatest(F.col("_lead") - F.col("offset"), F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    start = (F.col("_at") - F.col("offset")).cast("long")
    found = said.join(postings(names, documents), "word").where(held).select("doc", "_text", start.alias("start"), (start + F.size("phrase")).alias("end"), "phrase").distinct()
    before = Window.partitionBy("doc", "_text").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("end").over(before)).where("_reach IS NULL OR _reach < end").select("doc", "start", "end", "phrase").distinct()


def symbol_links(documents: DataFrame, doc: str, text: str, symbols: DataFrame, symbol: str, name: str) -> DataFrame:
    """doc, symbol, places (how often the symbol's name stands in the document) and first_place (in words, from 0)."""
    named = symbols.select(F.col(symbol).alias("symbol"), words(name).alias("phrase")).where(F.size("phrase") > 0).distinct()
    found = matches(documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")), named.select("phrase").distinct())
    counted = found.groupBy("doc", "phrase").agg(F.count("*").alias("places"), F.min("start").alias("first_place"))
    return counted.join(named, "phrase").select("doc", "symbol", "places", "first_place")
