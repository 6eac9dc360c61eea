"""Landed pages: chains, pushed filters, damage."""

import json

import pytest
from loomstead.sources import pages
from pyspark.sql import functions as F


def landed(spark, folder, *answers):
    rows = [(owner, page, json.dumps({"next": after, "repositories": items} if items is not None else {"next": after})) for owner, page, after, items in answers]
    pages.land(spark.createDataFrame(rows, "owner string, page string, body string"), str(folder))


def read(spark, folder):
    return pages.pages(spark, f"file://{folder}", field="repositories")


def test_chains_and_filters(spark, tmp_path):
    repo = lambda n: {"id": n, "name": f"ré{n}", "owner": {"login": "x"}}
    landed(spark, tmp_path, ("a", "1", "p/2", [repo(1), repo(2)]), ("a", "p/2", None, [repo(3)]), ("a", "9", None, [repo(99)]), ("b c", "1", None, []), (None, "1", None, [repo(4)]), ("d", "1", None, [repo(5), repo(5)]))
    items = read(spark, tmp_path)
    got = items.select("owner", "page", "position", F.from_json("item", "id long, name string").alias("i"))
    assert sorted((str(r["owner"]), r["page"], r["position"], r["i"]["id"], r["i"]["name"]) for r in got.collect()) == [
        ("None", "1", 0, 4, "ré4"), ("a", "1", 0, 1, "ré1"), ("a", "1", 1, 2, "ré2"), ("a", "p/2", 0, 3, "ré3"), ("d", "1", 0, 5, "ré5"), ("d", "1", 1, 5, "ré5")]
    assert items.rdd.getNumPartitions() == 4
    one = items.where("owner = 'a' AND position = 0")
    assert one.rdd.getNumPartitions() == 1 and {r["page"] for r in one.collect()} == {"1", "p/2"}
    two = items.where("owner IN ('a', 'd', 'nobody')")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 5
    assert items.where("owner = 'nobody'").count() == 0 and items.where("owner IS NULL").count() == 1


def test_newest_page_counts(spark, tmp_path):
    landed(spark, tmp_path, ("a", "1", None, [1]))
    landed(spark, tmp_path, ("a", "1", None, [2, 3]))
    assert [r["item"] for r in read(spark, tmp_path).orderBy("position").collect()] == ["2", "3"]


@pytest.mark.parametrize("answers, told", [
    ([("a", "1", "2", [1])], "no page 2"),
    ([("a", "1", "2", [1]), ("a", "2", "1", [2])], "leads back"),
    ([("a", "1", None, None)], "no repositories"),
])
def test_listings_that_are_not_whole(spark, tmp_path, answers, told):
    landed(spark, tmp_path, *answers)
    with pytest.raises(Exception, match=told):
        read(spark, tmp_path).collect()
