"""Texts and names that operators must bear."""

LONG = "The quick brown fox, " * 60_000
#: (doc_id, text): nulls, empty and very long texts, ties, repeats, odd characters.
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, LONG), (5, LONG), (6, "one two three four five six"), (7, "ONE two three four five six"),
    (8, "don't <|endoftext|> it's"), (9, "naïve Straße İ Ω 日本語 \u0301e \x00 \x1c \u2028 😀"), (10, "a b c d"), (11, "a b c d"), (None, "no id"), (None, None), (12, "x" * 70_000),
]
#: Extra columns whose names the operators use inside.
CLASHING = ["score", "n_tokens", "n", "value", "class", "sketch", "component", "hits", "words", "length", "rank", "bucket", "media", "data", "rows", "quality", "item_id", "template", "start"]
