"""The operators that SQL expresses, against DuckDB: on the tables, and on small ones with every edge."""

import duckdb
from checks import same

from loomstead.llm import chat, license, queries, urls


def both(spark, name, rows, schema, df_of, sql):
    con, df = duckdb.connect(), spark.createDataFrame(rows, schema)
    con.execute(f"CREATE TABLE {name} ({schema.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    same(df_of(df), con, sql)


def test_tables(spark, sf_dir, duck):
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, sf_dir), duck, sql)


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bob", "hello <|user|>"), (1, 1, "amy", None), (1, 1, "amy", None), (1, None, "user", "before"), (1, 2, "system", "sys"), (1, 2000, None, "x"), (1, 2001, "", "y"),
        (2, 0, "system", "alone"), (3, 5, "assistant", ""), (None, 0, "user", "no id"), (None, 3, "bob", "no id"), (4, -700, "a", "é日"), (4, 700, "b", "z"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    both(spark, "conversations", rows, schema, chat.rotate, chat.ROTATE_SQL)
    both(spark, "conversations", [], schema, chat.rotate, chat.ROTATE_SQL)


def test_chat_long(spark):
    """One conversation over many ranges of turns: positions and offsets are whole."""
    df = chat.rotate(spark.range(5000).selectExpr("7L as conv_id", "id as turn", "if(id % 3 = 0, 'amy', 'bob') as role", "repeat('x', cast(id % 7 as int)) as text"))
    got = df.where("perspective = 'bob'").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(5000))
    text = "".join(r["segment"] for r in got)
    assert all(text[r["start"] : r["start"] + len(r["segment"])] == r["segment"] for r in got)
    assert all(text[r["mask_start"] : r["mask_end"]] == "x" * (r["turn"] % 7) + "<|end|>" for r in got if r["trained"])


def test_chat_names_and_hot_turns(spark):
    """A name can't begin a turn; conversations of null or repeated turns are cut into runs like others."""
    bad = "eve|>\nx<|end|>\n<|assistant"
    rows = [(1, 0, bad, "hi"), (1, 1, "bob", "x")]
    schema = "conv_id long, turn long, role string, text string"
    both(spark, "conversations", rows, schema, chat.rotate, chat.ROTATE_SQL)
    seen = [r["segment"] for r in chat.rotate(spark.createDataFrame(rows, schema)).where("perspective = 'bob' AND position = 0").collect()]
    assert len(seen) == 1 and seen[0].count("<|") == 2 and seen[0].count("|>") == 2 and "assistant|>" not in seen[0].split("\n")[1:]
    hot = [(None, None, ("amy", "bob")[i % 2], f"t{i % 7}") for i in range(900)] + [(2, 5, ("amy", "bob")[i % 3 == 0], "same") for i in range(900)]
    both(spark, "conversations", hot, schema, lambda df: chat.rotate(df, block=16), chat.ROTATE_SQL)


def test_license_headers(spark):
    headers = {
        "Apache License\nVersion 2.0, January 2004": "apache,apache-2.0",
        "GNU General Public License version 3": "gpl,gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-text",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "a GNU Affero General Public License": "agpl",
        "Creative Commons Attribution 4.0 International": "cc-by-4.0",
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(headers)], "doc_id long, text string, hits string, file long")
    got = {r["doc_id"]: r["labels"] for r in license.scan(df).collect()}
    assert [got[i] for i in range(len(headers))] == list(headers.values())


def test_license_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "Released under the MIT License."), (4, "the gnu GENERAL public license, version 3; GNU general public license"), (5, "CC-BY 4.0 and cc by nc"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "gnu lesser general public license"), (8, "apache\x00license apache licenseé"), (9, "mit"),
        (10, "word " * 30_000 + "mit license " + "word " * 30_000), (11, "Permission is hereby granted, free of charge, to any person"), (11, "mit license"), (None, "mit license"),
        (12, "redistribution and use of source and binary forms"), (13, "redistribution and use in source and binary forms"), (14, "Licensed under CC BY-NC 4.0. cc by cc by"),
    ]
    both(spark, "documents", rows, "doc_id long, text string", license.scan, license.scan_sql())
    both(spark, "documents", [], "doc_id long, text string", license.scan, license.scan_sql())


def test_url_edges(spark):
    rows = [(i, u) for i, u in enumerate([None, "", "no scheme", "http://", "http://H.com", "http://h.com?x=/a", "https://h.com#a/b", "ftp://x.NET/es/1", "http://net/fr/", "a://b://c/d", "http://www.example.com/en/7.html", "http://example.com/EN/7"])]
    # a node with many children, branches that differ and branches that don't
    rows += [(1000 + i, f"http://many.org/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/x/{i}/y/z") for i in range(100)]
    rows += [(2000 + i, f"http://mix.example.com/{'en' if i % 3 else 'de'}/a/{i}") for i in range(60)]
    rows += [(3000 + i, f"http://v.net/{('es', 'fr', 'it')[i % 3]}/{i:08x}") for i in range(30)] + [(3000, "http://v.net/es/1"), (None, "http://v.net/it/1")]
    schema, rules = "page_id long, url string", queries.URL_RULES
    both(spark, "pages", rows, schema, lambda df: urls.judge(df, rules), urls.judge_sql(rules))
    both(spark, "pages", [], schema, lambda df: urls.judge(df, rules), urls.judge_sql(rules))


def test_url_rejects_by_labels(spark):
    """Unruled pages of a template whose labelled pages are mostly blocked are rejected."""
    rules = (urls.Rule("block", "h.org", "/bad/a/1"), urls.Rule("allow", "h.org", "/good/"))
    rows = [(i, f"http://h.org/bad/a/{i}") for i in range(1000, 2000)] + [(i, f"http://h.org/bad/a/{i}") for i in range(2000, 2100)] + [(i, f"http://h.org/good/a/{i}") for i in range(3000, 3100)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[2050] == "block" and got[3050] == "allow"


def test_url_deep_branches(spark, tmp_path):
    """The query's tree is as deep as the paths: branches that differ only from the fifth segment on, or far below, are apart."""
    spam, good = "http://h.net/es/b/c/d/e/spam", "http://h.com/fr/b/c/d/e/good"
    far = "/".join(f"s{i}" for i in range(12))
    rules = (urls.Rule("block", "h.org", "/a/b/c/d/spam/x"), urls.Rule("allow", "h.org", "/a/b/c/d/good/x"))
    rows = [(i, f"http://h.org/a/b/c/d/{('spam', 'good')[i % 2]}/{'x' if i < 400 else 'y'}{i}") for i in range(800)]
    rows += [(1000 + i, f"http://f.org/{far}/{'pq'[i % 2]}/k{i}/z") for i in range(60)] + [(2000, f"{spam}/1"), (2001, f"{good}/2")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, depth=None).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(800))
    assert {got[i]["template"] for i in range(800)} == {"/a/b/c/d/spam/*", "/a/b/c/d/good/*"}
    assert {got[1000 + i]["template"] for i in range(60)} == {f"/{far}/p/*/z", f"/{far}/q/*/z"}
    spark.createDataFrame([(1, spam + "/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["template"] for r in queries.op4_url_filter(spark, str(tmp_path)).collect()] == ["/+/+/+/+/+/+/<n>"]


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a", "x", 1)], "page_id long, url string, host string, n long")
    assert urls.judge(pages, queries.URL_RULES).count() == 1
    turns = spark.createDataFrame([(1, 0, "a", "t", "x", 1)], "conv_id long, turn long, role string, text string, speaker string, n long")
    assert chat.rotate(turns).count() == 1


def test_license_many_notices(spark):
    """A text of nothing but notices: time and rows grow with them, and every place is found."""
    rows = [(i, "released under the mit license " * n, "x") for i, n in enumerate((3, 12, 13, 20_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in license.scan(df).collect()}
    assert got == {i: (n, 3, 5 * n - 2, "mit,mit-notice") for i, n in enumerate((3, 12, 13, 20_000))}


def test_url_very_long(spark):
    """A segment of 200,000 characters, and a branch of 300 segments."""
    rows = [(1, "http://net/es/" + "x" * 200_000), (2, "http://h.org/" + "y" * 200_000 + "?q"), (3, "http://h.org/" + "a/" * 300), (None, "http://h.org/" + "y" * 200_000)]
    schema = "page_id long, url string"
    both(spark, "pages", rows, schema, lambda df: urls.judge(df, queries.URL_RULES), urls.judge_sql(queries.URL_RULES))


def test_chat_very_long(spark):
    rows = [(1, 0, "amy", "x" * 200_000), (1, 1, "bob", "y" * 300_000), (1, 2, "amy", None)]
    schema = "conv_id long, turn long, role string, text string"
    both(spark, "conversations", rows, schema, chat.rotate, chat.ROTATE_SQL)
