"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Progress and label of each project status.
PROGRESS = {"idle": 0, "analyzing": 45, "complete": 100, "failed": 0}
STATUS_LABELS = {"idle": "IDLE", "analyzing": "ANALYZING", "complete": "COMPLETE", "failed": "FAILED"}


def lookup(key: Column, table: dict, default) -> Column:
    """table[key], else default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def equals_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def is_given(value: Column, kind: str = "string") -> Column:
    """Whether a required field is there: null, '' and 0 are not."""
    return F.coalesce(value, F.lit("")) != "" if kind == "string" else F.coalesce(value, F.lit(0)) != 0


def first_given(*values: Column) -> Column:
    """The first that isn't null, though '' then counts as none."""
    return F.nullif(F.coalesce(*values), F.lit(""))


def strip(text: Column) -> Column:
    """text without any white space at its ends, not blanks alone."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def initials(email: Column) -> Column:
    """The first two characters before the @, in upper case."""
    return F.upper(F.substring(F.split_part(email, F.lit("@"), F.lit(1)), 1, 2))


def path_list(text: Column) -> Column:
    """Lines as an array, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def path_text(paths: Column) -> Column:
    return F.array_join(paths, "\n")


def append_distinct(values: Column, new: Column) -> Column:
    """values with the stripped new one at its end, unless it is empty or there."""
    added = strip(new)
    return F.when((added != "") & ~F.array_contains(values, added), F.array_append(values, added)).otherwise(values)


def hash_bucket(text: Column, buckets: int) -> Column:
    """h = code + ((h << 5) - h) over the UTF-16 units, of which only the shift wraps to 32 bits; then |h| mod buckets."""
    half, whole = 1 << 31, 1 << 32
    step = lambda h, c: c + (F.pmod(h * 32 + half, F.lit(whole)) - half) - h
    beyond = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000) % 1024)
    units = lambda c: F.when(F.ascii(c) < 0x10000, F.array(F.ascii(c))).otherwise(beyond(F.ascii(c)))
    total = F.aggregate(F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), units)), F.lit(0).cast("long"), step)
    return (F.abs(total) % buckets).cast("int")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def base64url(data: Column) -> Column:
    """Base64 with - and _, without padding and line ends."""
    plain = F.regexp_replace(F.base64(data), "[\r\n]", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def url_base(url: Column) -> Column:
    """A service's address without white space, closing slashes and then /rest/v1."""
    return strip(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/rest/v1$", ""))


def without_prefix(text: Column, prefix: str) -> Column:
    """What follows prefix, null where it isn't there."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30))


def to_number(text: Column) -> Column:
    """A number other than 0, else null; '' counts as 0."""
    return F.nullif(F.when(strip(text) == "", 0.0).otherwise(strip(text).try_cast("double")), F.lit(0.0))


def long_date(at: Column) -> Column:
    """January 5, 2024."""
    return F.date_format(at, "MMMM d, yyyy")


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts; a null part counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def identity(*parts: Column) -> Column:
    """An id of the form of a UUID that follows from the natural key, so it is the same when a task runs again."""
    digits = content_hash(*parts)
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def check_key(key: str) -> bytes:
    """An AES-256 key from exactly 64 hexadecimal digits."""
    if len(key) != 64:
        raise ValueError("the encryption key must have 64 hexadecimal digits")
    return bytes.fromhex(key)


def encrypt(text: Column, key: str) -> Column:
    """AES-256-GCM as hex(iv):hex(tag):hex(ciphertext), with a random iv of 12 bytes and a tag of 16."""
    sealed = F.hex(F.aes_encrypt(text.cast("binary"), F.lit(check_key(key)), F.lit("GCM")))
    size = F.length(sealed)
    return F.lower(F.concat_ws(":", sealed.substr(1, 24), sealed.substr(size - 31, F.lit(32)), sealed.substr(F.lit(25), size - 56)))


def decrypt(token: Column, key: str) -> Column:
    """The text of encrypt(), null for tampered tokens, other than three parts or an empty part.

    An empty text encrypts to an empty part and is therefore not decrypted.
    """
    parts = F.split(token, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: p != "")
    sealed = F.concat(F.unhex(part(1)), F.unhex(part(3)), F.unhex(part(2)))
    return F.when(whole, F.try_aes_decrypt(sealed, F.lit(check_key(key)), F.lit("GCM")).cast("string"))
