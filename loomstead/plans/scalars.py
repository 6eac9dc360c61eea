"""Scalar functions over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions import scalars as fn
from loomstead.plans.base import Registry, Tables

query = Registry()
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'idle' WHEN 'P' THEN 'analyzing' WHEN 'F' THEN 'complete' ELSE 'other' END"


@query("SELECT doc_id, quality IS NOT NULL AS connected FROM documents LEFT JOIN labels USING (doc_id)")
def flag_is_connected(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("connected"))


@query("SELECT c_custkey, nullif(coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END, c_name), '') AS role FROM customer")
def resolve_role_default(t: Tables) -> DataFrame:
    given = F.when(F.col("c_mktsegment") == "MACHINERY", "").when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.select("c_custkey", fn.first_given(given, F.col("c_name")).alias("role"))


@query("SELECT c_custkey, upper(substr(split_part(c_name || '@x.org', '@', 1), 1, 2)) AS initials FROM customer")
def initials(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.initials(F.concat("c_name", F.lit("@x.org"))).alias("initials"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', chr(10) || chr(9)), chr(10)), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> ''), chr(10)) AS paths FROM part")
def parse_path_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.path_text(fn.path_list(F.replace("p_name", F.lit(" "), F.lit("\n\t")))).alias("paths"))


@query("SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'steel') THEN p_name ELSE p_name || ' steel' END AS names FROM part")
def array_append_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(fn.append_distinct(F.split("p_name", " "), F.lit("  steel ")), " ").alias("names"))


@query(f"SELECT o_orderkey, upper({_STATUS}) AS label, CASE o_orderstatus WHEN 'P' THEN 45 WHEN 'F' THEN 100 ELSE 0 END AS progress FROM orders")
def status_label_progress(t: Tables) -> DataFrame:
    o = F.col("o_orderstatus")
    status = F.when(o == "O", "idle").when(o == "P", "analyzing").when(o == "F", "complete").otherwise("other")
    return t.orders.select("o_orderkey", F.upper(status).alias("label"), fn.lookup(status, fn.PROGRESS, 0).alias("progress"))


@query("""SELECT c_custkey, CAST(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: c + (((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) - h)) % 6 AS INTEGER) AS bucket FROM customer""")
def hash_bucket(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.hash_bucket(F.col("c_name"), 6).alias("bucket"))


@query("SELECT o_custkey, CAST(count(*) AS VARCHAR) || ' member' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label FROM orders GROUP BY 1")
def plural_label(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", fn.plural(F.col("n"), "member").alias("label"))


@query("SELECT page_id, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS encoded FROM pages")
def base64url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.base64url(F.encode("url", "utf-8")).alias("encoded"))


@query("SELECT page_id, lower(hex(encode(url))) AS digits, url AS back FROM pages")
def hex_round_trip(t: Tables) -> DataFrame:
    digits = fn.hex_lower(F.encode("url", "utf-8"))
    return t.pages.select("page_id", digits.alias("digits"), F.decode(F.unhex(digits), "utf-8").alias("back"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url || '/rest/v1//', '/+$', ''), '/rest/v1$', '')) AS base FROM pages")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.url_base(F.concat("url", F.lit("/rest/v1//"))).alias("base"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) END AS rest FROM pages")
def prefix_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.without_prefix(F.col("url"), "https://").alias("rest"))


@query("SELECT page_id, nullif(TRY_CAST(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS DOUBLE), 0) AS number FROM pages WHERE regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) <> ''")
def number_coercion(t: Tables) -> DataFrame:
    last = F.regexp_extract("url", "/([^/?#]*)([?#].*)?$", 1)
    return t.pages.select("page_id", last.alias("last")).where("last <> ''").select("page_id", fn.to_number(F.col("last")).alias("number"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS shown FROM orders")
def format_month_day_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fn.long_date(F.col("o_orderdate")).alias("shown"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 60 AS issued, CAST(epoch(o_orderdate) AS BIGINT) + 600 AS expires FROM orders")
def token_validity_window(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", (at - 60).alias("issued"), (at + 600).alias("expires"))


@query("SELECT doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(text, '')) AS hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.content_hash(F.col("lang"), F.col("text")).alias("hash"))


@query("SELECT c_custkey, c_name AS decrypted, CASE WHEN c_name = '' THEN 0 ELSE 3 END AS parts FROM customer")
def encryption_round_trip(t: Tables) -> DataFrame:
    key = "0123456789abcdef" * 4
    sealed = t.customer.select("c_custkey", fn.encrypt(F.col("c_name"), key).alias("token"))
    return sealed.select("c_custkey", fn.decrypt(F.col("token"), key).alias("decrypted"), F.size(F.split("token", ":")).alias("parts"))
