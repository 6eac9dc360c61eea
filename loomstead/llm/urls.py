"""URL filters by a path-template tree.

Per host, path segments form a tree. Segments that vary are generalised into wildcards: numbers and hexadecimal
ids by their form, others where a node has many children for its pages. Branches of a host that have the same form
and whose labels don't differ significantly are merged, and a template is rejected if its share of blocked labels,
smoothed towards the share over all pages, reaches a threshold. Rules on hosts and path prefixes come first, and
what they say of pages are the labels.

A null url, or one without "://", has an empty host and path; such pages, and templates without any label, are
allowed unless a rule says otherwise. Repeated rows are pages each, with or without page_id. Of rules that fit, that
with the longest name (host and path) wins. Urls of any length are judged whole: a very long path is a deep branch, or a long
segment. Other columns of pages, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import lower_ascii, materialize, skew_safe_left_join


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: judge_sql() knows this many levels and makes one "**" of all segments beyond; judge() goes on as deep as `depth` says.
DEPTH = 4
#: A node with more children than this, for less than SPREAD pages each, gets a wildcard child.
MANY, SPREAD = 16, 2
#: Labels by which the share over all pages counts; share from which templates are rejected; deviation that differs.
WEIGHT, REJECT, DEVIATION = 4.0, 0.5, 1.96


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    found = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_r"))
    host = F.regexp_extract("_r", "^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_r, length(regexp_extract(_r, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0)
    return found.select("page_id", lower_ascii(host).alias("host"), path.alias("path"))


def rule_of(rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct of name and verdict, else null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column, depth: int | None) -> Column:
    """The path with numbers and hexadecimal ids generalised; with a depth, what follows it is one "**"."""
    formed = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike("^[0-9]+([.][A-Za-z0-9]+)?$"), F.regexp_replace(s, "^[0-9]+", "<n>")).when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("<h>")).otherwise(s),
    )
    if depth is None:
        return F.concat(F.lit("/"), F.array_join(formed, "/"))
    return F.concat(F.lit("/"), F.array_join(F.slice(formed, 1, depth), "/"), F.when(F.size(formed) > depth, "/**").otherwise(""))


def with_templates(counted: DataFrame, depth: int | None) -> DataFrame:
    """counted (host, shape, ...) with template: level by level, nodes with many children get a wildcard.

    A node of at most MANY shapes has no more children than that, nor has any node below it: its paths are finished
    as they are, and the others go on until none is left. Each level reads the unfinished paths of the level above.
    """
    columns = [*counted.columns, "template"]
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    segments = segments if depth is None else F.slice(segments, 1, depth)
    done = []
    here = materialize(counted.withColumn("template", F.lit("")).withColumn("_left", segments))
    while True:
        done.append(here.where(F.size("_left") == 0).select(*columns))
        here = here.where(F.size("_left") > 0)
        if not (total := here.count()):
            break
        here = here.withColumn("_s", F.element_at("_left", 1))
        fixed = F.col("_s").startswith("<") | F.col("_s").startswith("*")
        children = here.groupBy("host", "template", "_s").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        free = F.when(~fixed, 1)
        nodes = children.groupBy("host", "template").agg(F.count(free).alias("kids"), F.sum(F.when(free.isNotNull(), F.col("n"))).alias("pages"), F.sum("rows").alias("rows"))
        wide = F.coalesce((F.col("kids") > MANY) & (F.col("kids") * SPREAD > F.col("pages")), F.lit(False))
        large = nodes.where(F.col("rows") > MANY).select("host", "template", "rows", wide.alias("_w"))
        joined = skew_safe_left_join(here, large, ["host", "template"], "rows", total)
        step = F.when(F.col("_w") & ~fixed, "*").otherwise(F.col("_s"))
        whole = F.concat("template", F.lit("/"), F.array_join("_left", "/"))
        template = F.when(F.col("_w").isNull(), whole).otherwise(F.concat("template", F.lit("/"), step))
        left = F.when(F.col("_w").isNull(), F.slice("_left", 1, 0)).otherwise(F.expr("slice(_left, 2, size(_left))"))
        here = materialize(joined.withColumns({"template": template, "_left": left}).drop("_s", "_w"))
    deep = F.when(F.col("shape").endswith("/**"), "/**").otherwise("") if depth is not None else F.lit("")
    return reduce(DataFrame.unionByName, done).withColumn("template", F.concat(F.when(F.col("template") == "", "/").otherwise(F.col("template")), deep))


def merged(templates: DataFrame) -> DataFrame:
    """templates (host, template, labelled, blocked) with branch, the merged template, and its counts of labels."""
    form = F.array_join(F.transform(F.split("template", "/"), lambda s: F.when((s == "") | s.startswith("<") | s.startswith("*"), s).otherwise("+")), "/")
    own = templates.withColumn("form", form)
    pooled = own.where("labelled > 0").groupBy("host", "form").agg(F.sum("labelled").alias("all"), F.sum("blocked").alias("bad"))
    # every row counts for the join, labelled or not
    pooled = own.groupBy("host", "form").agg(F.count("*").alias("rows")).join(pooled, ["host", "form"])
    near = skew_safe_left_join(own, pooled, ["host", "form"], "rows", templates.count())
    d = {c: F.col(c).cast("double") for c in ("labelled", "blocked", "all", "bad")}
    apart = d["blocked"] * d["all"] - d["bad"] * d["labelled"]
    similar = (F.col("labelled") > 0) & (apart * apart <= DEVIATION**2 * d["labelled"] * d["bad"] * (d["all"] - d["bad"]))
    return near.withColumn("branch", F.when(similar, F.col("form")).otherwise(F.col("template"))).drop("form", "all", "bad")


def judge(pages: DataFrame, rules: tuple[Rule, ...], reject: float = REJECT, depth: int | None = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url).

    With depth None, as the query has it, the tree is as deep as the paths. With a depth it is cut there, as in the SQL.
    """
    ruled = parsed(pages).withColumn("_rule", rule_of(rules)).withColumn("shape", shape(F.col("path"), depth))
    counted = ruled.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("_rule").alias("labelled"), F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("blocked")
    )
    shapes = materialize(with_templates(counted, depth))
    templates = materialize(merged(shapes.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("shapes"))))
    total = shapes.agg(F.sum("labelled"), F.sum("blocked"), F.sum("n"), F.count("*")).first()
    labelled, blocked, n_pages, n_shapes = (x or 0 for x in total)
    share = blocked / labelled if labelled else 0.0
    branches = templates.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum("shapes").alias("rows"), F.count("*").alias("templates"))
    purity = (F.col("b") + F.lit(WEIGHT * share)) / (F.col("l") + F.lit(WEIGHT))
    graded = branches.select("host", "branch", F.col("templates").alias("rows"), F.round(purity, 6).alias("purity"), ((purity >= reject) & (F.col("l") > 0)).alias("_reject"))
    by_template = skew_safe_left_join(templates.select("host", "template", "branch", "shapes"), graded, ["host", "branch"], "rows", templates.count())
    by_shape = skew_safe_left_join(shapes.select("host", "shape", "template", "n"), by_template.withColumnRenamed("shapes", "rows"), ["host", "template"], "rows", n_shapes)
    verdicts = materialize(by_shape.select("host", "shape", "n", "branch", "purity", "_reject"))
    judged = skew_safe_left_join(ruled, verdicts, ["host", "shape"], "n", n_pages)
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_reject"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"), F.col("branch").alias("template"), "purity")


def judge_sql(rules: tuple[Rule, ...], reject: float = REJECT) -> str:
    """DuckDB: the same tree level by level."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')" for r in ordered]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, ordered, strict=True))
    said = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ordered, strict=True))
    ctes, last = [], "c0"
    for d in range(1, DEPTH + 1):
        ctes.append(f"""
n{d} AS (SELECT host, template FROM (SELECT host, template, s, sum(n) AS n FROM (SELECT *, nullif(string_split(shape, '/')[{d + 1}], '') AS s FROM {last}) WHERE s IS NOT NULL AND NOT prefix(s, '<') AND NOT prefix(s, '*') GROUP BY ALL) GROUP BY ALL HAVING count(*) > {MANY} AND count(*) * {SPREAD} > sum(n)),
c{d} AS (SELECT c.host, c.shape, c.n, c.labelled, c.blocked, CASE WHEN c.s IS NULL THEN c.template WHEN w.host IS NOT NULL AND NOT prefix(c.s, '<') AND NOT prefix(c.s, '*') THEN c.template || '/*' ELSE c.template || '/' || c.s END AS template
  FROM (SELECT *, nullif(string_split(shape, '/')[{d + 1}], '') AS s FROM {last}) c LEFT JOIN n{d} w ON c.host = w.host AND c.template = w.template)""")
        last = f"c{d}"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
u AS (SELECT *, CASE {name} END AS rule, CASE {said} END AS said,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+([.][A-Za-z0-9]+)?$') THEN regexp_replace(s, '^[0-9]+', '<n>') WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}$') THEN '<h>' ELSE s END) AS segs FROM p),
v AS (SELECT * EXCLUDE (segs), '/' || array_to_string(segs[1:{DEPTH}], '/') || CASE WHEN len(segs) > {DEPTH} THEN '/**' ELSE '' END AS shape FROM u),
c0 AS (SELECT host, shape, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked, '' AS template FROM v GROUP BY host, shape),{",".join(ctes)},
s AS (SELECT host, shape, n, labelled, blocked, CASE WHEN template = '' THEN '/' ELSE template END || CASE WHEN suffix(shape, '/**') THEN '/**' ELSE '' END AS template FROM {last}),
t AS (SELECT host, template, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b, array_to_string(list_transform(string_split(template, '/'), lambda x: CASE WHEN x = '' OR prefix(x, '<') OR prefix(x, '*') THEN x ELSE '+' END), '/') AS form FROM s GROUP BY host, template),
g AS (SELECT *, sum(l) OVER (PARTITION BY host, form) AS la, sum(b) OVER (PARTITION BY host, form) AS ba FROM t),
m AS (SELECT *, CASE WHEN l > 0 AND (b * la - ba * l) * (b * la - ba * l) <= {DEVIATION**2} * l * ba * (la - ba) THEN form ELSE template END AS branch FROM g),
q AS (SELECT host, branch, sum(l) AS l, (sum(b) + {WEIGHT} * (SELECT coalesce(sum(b) / nullif(sum(l), 0), 0) FROM t)) / (sum(l) + {WEIGHT}) AS purity FROM m GROUP BY host, branch)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.said, CASE WHEN q.purity >= {reject} AND q.l > 0 THEN 'block' ELSE 'allow' END) AS verdict, q.branch AS template, round(q.purity, 6) AS purity
FROM v JOIN s ON v.host = s.host AND v.shape = s.shape JOIN m ON s.host = m.host AND s.template = m.template JOIN q ON m.host = q.host AND m.branch = q.branch
"""
