"""The domain's tables, tiny: nulls, ties, misses, case."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead import schemas
from loomstead.functions import scalars as fn
from loomstead.operators import decisions, graph, mutations, ranking, relational, snapshot
from loomstead.plans import api
from loomstead.sources import tables

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def table(spark, name, *rows):
    """A domain table from dicts; missing columns are null."""
    schema = schemas.domain_schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'bigint'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def world(spark):
    p = lambda i, user, name, status="idle": {"id": i, "user_id": user, "repo_owner": "Acme", "repo_name": name, "branch": "main", "status": status, "created_at": T1}
    s = lambda i, p, at: {"id": i, "project_id": p, "commit_hash": i, "branch": "main", "file_count": 0, "symbol_count": 0, "workflow_count": 0, "status": "complete", "warnings": [], "created_at": at}
    f = lambda i, s: {"id": i, "snapshot_id": s, "target_type": "section", "target_id": "t", "reason": "r", "changed_files": [], "created_at": T1}
    m = lambda p, u, tier: {"project_id": p, "user_id": u, "permission_tier": tier, "developer_role": "backend", "joined_at": T1}
    return {
        "users": table(spark, "users", *[{"id": u, "email": f"{u}@X.org", "created_at": T1} for u in ("u1", "u2", "u3")]),
        "projects": table(spark, "projects", p("p1", "u1", "One"), p("p2", "u1", "Two_%", "failed"), p("p3", "u2", "Three", "complete")),
        "project_members": table(spark, "project_members", m("p1", "u1", "owner"), m("p1", "u2", "admin"), m("p2", "u1", "owner"), m("p3", "u2", "owner")),
        "project_settings": table(spark, "project_settings", {"project_id": "p1", "ignored_paths": [], "ai_enabled": True, "default_developer_role": "backend", "file_limit": 5, "loc_limit": 9}),
        "project_invitations": table(
            spark, "project_invitations",
            *[{"id": i, "project_id": p, "email": e, "permission_tier": "developer", "developer_role": r, "invited_by": "u1", "status": st, "created_at": T1}
              for i, p, e, r, st in [("i1", "p1", "U3@x.ORG", None, "pending"), ("i2", "p2", "u3@x.org", "backend", "revoked"), ("i3", "p3", "u1@x.org", "backend", "pending")]],
        ),
        "analysis_snapshots": table(spark, "analysis_snapshots", s("s1", "p1", T1), s("s2", "p1", T2), s("s3", "p1", T2), s("s4", "p2", T1)),
        "analysis_jobs": table(spark, "analysis_jobs"),
        "stale_flags": table(spark, "stale_flags", f("f1", "s3"), f("f2", "s3"), f("f3", "s1")),
        "github_connections": table(spark, "github_connections", *[{"id": i, "user_id": "u1", "github_user_id": n, "github_username": i, "access_token_encrypted": "x", "scopes": [], "created_at": T1} for i, n in (("g1", 1), ("g2", 2))]),
    }


def test_list_projects(world):
    got = {r["id"]: (r["stale_count"], r["permission_tier"]) for r in api.list_projects(world, "u1").collect()}
    assert got == {"p1": (2, "owner"), "p2": (0, "owner")}
    assert {r["id"] for r in api.list_projects(world, "u2").collect()} == {"p1", "p3"}
    assert api.list_projects(world, "u3").count() == 0


def test_search_and_filters(world):
    projects = world["projects"].withColumn("stale_count", F.lit(0))
    names = lambda df: sorted(r["repo_name"] for r in df.collect())
    assert names(relational.search(projects, "_%", "repo_owner", "repo_name", "branch")) == ["Two_%"]
    assert len(names(relational.search(projects, "ACME", "repo_owner", "repo_name", "branch"))) == 3
    assert len(names(relational.search(projects, "", "repo_name"))) == 3
    assert names(relational.by_named_status(projects, "active")) == ["One"]
    assert names(relational.by_named_status(projects, "completed")) == ["Three"]
    assert names(relational.by_named_status(projects, "stale")) == []
    assert len(names(relational.by_named_status(projects, "all"))) == 3


def test_project_with_settings(world):
    assert api.get_project(world, "p1").first()["settings"]["file_limit"] == 5
    assert api.get_project(world, "p2").first()["settings"] is None


def test_create_update_delete_project(world, spark):
    new = spark.createDataFrame([("p9", "u3", "Acme", "Nine", "main", "backend")], "id string, user_id string, repo_owner string, repo_name string, branch string, developer_role string")
    after, clash = api.create_projects(world, new, T2)
    assert clash.count() == 0 and after["projects"].where("id = 'p9'").first()["status"] == "idle"
    assert after["project_settings"].where("project_id = 'p9'").first()["ignored_paths"] == ["node_modules", "dist", ".git", ".env"]
    assert after["project_members"].where("project_id = 'p9'").first()["permission_tier"] == "owner"
    again, clash = api.create_projects(after, new.withColumn("id", F.lit("p10")), T2)
    assert clash.count() == 1 and again["projects"].count() == 4
    left, forbid = mutations.cascade(world, "projects", spark.createDataFrame([("p1",)], "id string"))
    assert {k: v.count() for k, v in left.items()} == {"users": 3, "projects": 2, "project_members": 2, "project_settings": 0, "project_invitations": 2, "analysis_snapshots": 1, "analysis_jobs": 0, "stale_flags": 0, "github_connections": 2}
    assert not any(v.count() for v in forbid.values())
    left, forbid = mutations.cascade(world, "users", spark.createDataFrame([("u1",)], "id string"))
    assert left["projects"].count() == 1 and forbid["project_invitations"].count() == 1


def test_analyze(world):
    after, answer = api.analyze(world, "p1", "u1", "j1", T2)
    assert after["projects"].where("id = 'p1'").first()["status"] == "analyzing"
    job = after["analysis_jobs"].first()
    assert (job["status"], job["progress_pct"], job["job_type"]) == ("queued", 0, "initial") and answer.first()["mode"] == "initial"


def test_members_and_invitations(world):
    assert [r["user_id"] for r in api.list_members(world, "p1").orderBy("position").collect()] == ["u1", "u2"]
    assert api.list_invitations(world, "p1").first()["invited_by_email"] == "u1@X.org"
    assert [r["id"] for r in api.my_invitations(world, "u3@X.ORG").collect()] == ["i1"]


def test_changes_by_route(world, spark):
    change = spark.createDataFrame([("p1", None, False, 7, True)], "project_id string, loc_limit int, has_loc_limit boolean, file_limit int, has_file_limit boolean")
    row = api.update_settings(world, change)["project_settings"].first()
    assert (row["file_limit"], row["loc_limit"], row["ignored_paths"]) == (7, 9, [])
    ids = spark.createDataFrame([("i1", "p1", "u1"), ("i1", "p2", "u1"), ("i3", "p1", "nobody"), ("i9", "p1", "u1")], "id string, project_id string, by string")
    after, decided = api.revoke_invitations(world, ids)
    before = {r["id"]: r["status"] for r in world["project_invitations"].collect()}
    assert {r["id"]: r["status"] for r in after["project_invitations"].collect()} == {**before, "i1": "revoked"}
    assert {(r["id"], r["project_id"]): r["decision"] for r in decided.where("id <> 'i1' OR project_id = 'p1'").collect()} == {("i1", "p1"): "ok", ("i3", "p1"): "403 not a member", ("i9", "p1"): "404"}
    gone = spark.createDataFrame([("p1", "u2", "u1"), ("p1", "nobody", "u1"), ("p1", "u1", "u1")], "project_id string, user_id string, by string")
    after, decided = api.remove_members(world, gone)
    assert after["project_members"].count() == 3 and {r["user_id"]: r["decision"] for r in decided.collect()} == {"u2": "ok", "nobody": "404", "u1": "403"}
    change = spark.createDataFrame([("p1", "u2", "u1", "admin", True, None, False), ("p1", "u9", "u1", "admin", True, None, False), ("p1", "u1", "u2", "developer", True, None, False)], "project_id string, user_id string, by string, permission_tier string, has_permission_tier boolean, developer_role string, has_developer_role boolean")
    after, decided = api.update_members(world, change)
    assert {r["user_id"]: r["decision"] for r in decided.collect()}["u2"] == "ok" and {r["user_id"]: r["decision"] for r in decided.collect()}["u9"] == "404"
    tiers = {r["user_id"]: r["permission_tier"] for r in after["project_members"].where("project_id = 'p1'").collect()}
    assert tiers["u2"] == "admin" and tiers["u1"] == "owner"
    new = spark.createDataFrame(
        [("n1", "p1", "u1", "New@x.org", "developer", None), ("n2", "p1", "u1", "new@X.org", "admin", None), ("n3", "p1", "u1", "", "developer", None), ("n4", "p1", "nobody", "z@x.org", "developer", None), ("n5", "p1", "u1", "U3@x.org", "developer", None)],
        "id string, project_id string, by string, email string, permission_tier string, developer_role string",
    )
    after, decided = api.create_invitations(world, new, T2)
    assert {r["id"]: r["decision"] for r in decided.collect()} == {"n1": "201", "n2": "409", "n3": "400", "n4": "403 not a member", "n5": "409"}
    made = after["project_invitations"].where("id = 'n1'").first()
    assert (made["status"], made["invited_by"]) == ("pending", "u1")
    asked = spark.createDataFrame([("i1", "U3@X.ORG"), ("i1", "other@x.org"), ("i9", "a")], "id string, by_email string")
    assert {(r["id"], r["by_email"]): (r["decision"], r["repo_name"] is not None) for r in api.invitation(world, asked).collect()} == {("i1", "U3@X.ORG"): ("ok", True), ("i1", "other@x.org"): ("403", False), ("i9", "a"): ("404", False)}
    again = world["github_connections"].where("id = 'g1'").withColumns({"id": F.lit("new"), "github_username": F.lit("renamed"), "scopes": F.array(F.lit("repo"))})
    saved = {r["id"]: (r["github_username"], r["scopes"]) for r in api.save_connections(world, again)["github_connections"].collect()}
    assert saved == {"g1": ("renamed", ["repo"]), "g2": ("g2", [])}


def test_profile_takes_latest_connection(world):
    row = api.profile(world, "u1").first()
    assert row["github_connected"] and row["github_username"] == "g2"
    assert not api.profile(world, "u2").first()["github_connected"]


def test_accept_batch(world, spark):
    asked = spark.createDataFrame(
        [("i1", "u3", "u3@x.org", "frontend"), ("i1", "u4", "u3@x.org", "frontend"), ("i2", "u3", "u3@x.org", None), ("i3", "u1", "no@x.org", None), ("i9", "u1", "a", None)],
        "invitation_id string, user_id string, email string, developer_role string",
    )
    decided, after, new = decisions.accept_batch(asked, world["project_invitations"], world["project_members"], F.lit(T2))
    got = {(r["invitation_id"], r["user_id"]): r["decision"] for r in decided.collect()}
    assert got == {("i1", "u3"): "accept", ("i1", "u4"): "409 not pending", ("i2", "u3"): "409 not pending", ("i3", "u1"): "403", ("i9", "u1"): "404"}
    assert after.where("status = 'accepted'").first()["accepted_by"] == "u3"
    assert [tuple(r)[:4] for r in new.collect()] == [("p1", "u3", "developer", "frontend")]


def test_upsert_and_partial(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "z")], "k int, v string, w string")
    assert sorted(map(tuple, mutations.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", "z")]
    part = spark.createDataFrame([(1, None, True, "n", False)], "k int, v string, has_v boolean, w string, has_w boolean")
    assert sorted(map(tuple, mutations.update_partial(old, part, ["k"], ["v", "w"]).collect()), key=str) == [(1, None, "x"), (2, "b", "y")]
    assert mutations.violations(old, {"v": F.col("v") == "a", "n": F.lit(None).cast("boolean")}).count() == 1


def test_repeated_keys_and_nulls(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (1, "z", 3)], "k int, v string, o int")
    assert sorted(map(tuple, mutations.upsert(old, twice, ["k"], ["v"], order="o").select("k", "v").collect())) == [(1, "z"), (2, "y")]
    with pytest.raises(Exception, match="several changes"):
        mutations.upsert(old, twice, ["k"], ["v"]).collect()
    part = twice.withColumn("has_v", F.lit(True))
    assert sorted(map(tuple, mutations.update_partial(old, part, ["k"], ["v"], order="o").collect())) == [(1, "z")]
    texts = spark.createDataFrame([(1, None), (2, "secret"), (3, "fine")], "i int, t string")
    assert [r["i"] for r in relational.without_secrets(texts, "t", "secret").orderBy("i").collect()] == [1, 3]
    assert [r["i"] for r in relational.without_ignored(texts, "t", ["sec"]).orderBy("i").collect()] == [1, 3]
    assert one(spark, snapshot.confidence(F.col("a").cast("int")), a="no number"[:0] or "0") == "low"
    assert texts.select(snapshot.confidence(F.lit(None).cast("int"))).first()[0] == "low"
    receipts = spark.createDataFrame([(1, "n", "h")], "id int, node_stable_key string, node_hash string")
    nodes = spark.createDataFrame([("n", "h"), ("n", "g"), ("n", "h")], "stable_key string, hash string")
    assert [r["stale"] for r in snapshot.stale_receipts(receipts, nodes).collect()] == [False]


def test_requests_in_turn(world, spark):
    """What a refused request asked for stays open for the next."""
    invitations = world["project_invitations"].where("id IN ('i1', 'i3')").withColumns({"project_id": F.lit("p1"), "email": F.lit("u3@x.org"), "status": F.lit("pending")})
    asked = spark.createDataFrame([("i1", "u3", "u3@x.org", "frontend"), ("i3", "u3", "u3@x.org", "frontend"), ("i3", "u5", "U3@x.org", "frontend"), ("i1", "u6", "u3@x.org", "frontend")], "invitation_id string, user_id string, email string, developer_role string")
    decided, after, new = decisions.accept_batch(asked, invitations, world["project_members"], F.lit(T2))
    assert {(r["invitation_id"], r["user_id"]): r["decision"] for r in decided.collect()} == {("i1", "u3"): "accept", ("i3", "u3"): "409 member", ("i3", "u5"): "accept", ("i1", "u6"): "409 not pending"}
    assert {r["id"]: r["accepted_by"] for r in after.collect()} == {"i1": "u3", "i3": "u5"} and new.count() == 2


def test_constraints(world, spark):
    assert mutations.duplicates(world["projects"], ["user_id", "repo_owner", "repo_name", "branch"]).count() == 0
    twice = world["projects"].unionByName(world["projects"])
    assert mutations.duplicates(twice, ["id"]).count() == 3
    assert mutations.orphans(world["stale_flags"], "snapshot_id", world["analysis_snapshots"].where("id = 's1'"), "id").count() == 2
    for name, df in world.items():
        assert mutations.nulls(df, schemas.required_columns(name)).count() == 0


@pytest.mark.parametrize("text", ["a", "héllo wörld", "x" * 10_000, "a:b:c", "日本"])
def test_encryption(text, spark):
    key = "0f" * 32
    df = spark.createDataFrame([(text,)], "t string").withColumn("e", fn.encrypt(F.col("t"), key)).cache()
    token = df.first()["e"]
    assert [len(x) for x in token.split(":")] == [24, 32, 2 * len(text.encode())]
    assert df.select(fn.decrypt(F.lit(token), key)).first()[0] == text
    assert df.select(fn.encrypt(F.col("t"), key)).first()[0] != token
    flipped = token[:-1] + ("0" if token[-1] != "0" else "1")
    assert df.select(fn.decrypt(F.lit(flipped), key)).first()[0] is None


def test_encryption_edges(spark):
    key = "0f" * 32
    assert one(spark, fn.decrypt(fn.encrypt(F.col("a"), key), key), a="") is None
    assert one(spark, fn.decrypt(F.col("a"), key), a="aa:bb") is None
    with pytest.raises(ValueError):
        fn.check_key("00")


def test_scalars(spark):
    assert one(spark, fn.initials(F.col("a")), a="ada@x.org") == "AD"
    assert one(spark, fn.path_list(F.col("a")), a=" a \n\n\tb\r\n") == ["a", "b"]
    assert one(spark, fn.append_distinct(F.col("a"), F.lit(" b ")), a=["a", "a"]) == ["a", "a", "b"]
    assert one(spark, fn.append_distinct(F.col("a"), F.lit(" ")), a=["a"]) == ["a"]
    assert one(spark, fn.first_given(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, fn.base64url(F.encode(F.col("a"), "utf-8")), a="?" * 80) == "Pz8_" * 26 + "Pz8"
    assert one(spark, fn.to_number(F.col("a")), a="0") is None and one(spark, fn.to_number(F.col("a")), a=" 12 ") == 12
    assert one(spark, fn.url_base(F.col("a")), a="https://h/rest/v1/") == "https://h"
    assert one(spark, fn.plural(F.col("a"), "member"), a=1) == "1 member"

    def wrapped(text):
        h = 0
        for c in text:
            h = ord(c) + (((h << 5) + 2**31) % 2**32 - 2**31) - h
        return abs(h) % 6

    for text in ("", "Ada", "a long name " * 20):
        assert one(spark, fn.hash_bucket(F.col("a"), 6), a=text) == wrapped(text)


def test_graph_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.reach(edges, start, 9).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["node"]: r["path"] for r in graph.reach(edges, start, 9).collect()}["d"] == ["a", "b", "c", "d"]
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}


def test_snapshot_and_ranking(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "stable_key string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "stable_key string, hash string")
    assert {r[0]: r[1] for r in snapshot.diff(old, new).collect()} == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}
    scores = spark.createDataFrame([("w", 999.999)], "id string, entrypoint_exposure double")
    assert str(scores.select(ranking.composite({"entrypoint_exposure": 1.0})).first()[0]) == "999.999"


def test_numbers_of_large_partitions(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0L, id % 50) as k", "(id * 7919) % 5000 as o", "1L as n").unionByName(spark.createDataFrame([(None, 1, 1), (None, 2, 1)], "k long, o long, n long"))
    got = relational.numbered_by_range(rows, ["k"], F.col("o"), total="all", running={"sum": "n"})
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    both = got.join(want, (got.k.eqNullSafe(want.k)) & (got.o == want.o))
    assert both.count() == 5002 and both.where("position <> w OR sum <> w").isEmpty()
    assert got.where("k = 0").first()["all"] == rows.where("k = 0").count()
    # runs of steps meet at their ends
    monkeypatch.setattr(relational, "RUN", 4)
    lag = rows.withColumns({"p": F.lag("o").over(Window.partitionBy("k").orderBy("o")), "f": F.lead("o").over(Window.partitionBy("k").orderBy("o"))})
    met = relational.steps(rows, "k", "o", "o").select("k", "o", "previous", "following")
    assert sorted(map(str, met.collect())) == sorted(map(str, lag.select("k", "o", F.col("p").alias("previous"), F.col("f").alias("following")).collect()))
    ranked = ranking.rank(rows.where("k IS NOT NULL"), "o", "k")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 5001))
    assert one(spark, fn.identity(F.col("a"), F.col("b")), a="x", b=1) == one(spark, fn.identity(F.col("a"), F.col("b")), a="x", b=1)


def test_sources(spark, tmp_path):
    (tmp_path / "repos.json").write_text('{"total_count": 1, "repositories": [{"id": 7, "name": "r", "full_name": "o/r", "private": true, "default_branch": "main", "owner": {"login": "o"}, "more": 1}]}')
    assert tuple(tables.repositories(spark, str(tmp_path / "repos.json")).first()) == (7, "r", "o/r", True, "main", "o")
    (tmp_path / "branches.json").write_text('[{"name": "main", "commit": {"sha": "abc"}, "protected": false}]')
    assert tables.landed(spark, str(tmp_path / "branches.json"), tables.BRANCHES).first()["commit"]["sha"] == "abc"
    files = tmp_path / "tree" / "src"
    files.mkdir(parents=True)
    (files / "a.ts").write_text("x")
    assert tables.repository_files(spark, str(tmp_path / "tree")).first()["bytes"] == 1
    users = table(spark, "users", {"id": "u", "email": "e", "created_at": T1})
    assert tables.insert_returning(users, str(tmp_path / "users")).count() == tables.domain_table(spark, str(tmp_path), "users").count() == 1
    back = tables.from_json(tables.as_json(users), "users")
    assert back.collect() == users.collect()
    tables.export_json(users, str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 1


def test_job_stream(spark, tmp_path):
    from loomstead.streaming import jobs

    queue, out = tmp_path / "queue", tmp_path / "out"
    queue.mkdir()
    job = lambda i, requested: {"id": i, "project_id": "p", "requested_by": requested, "job_type": "initial", "status": "queued", "progress_pct": 0, "created_at": T1}
    table(spark, "analysis_jobs", job("j1", "ok"), job("j2", "bad")).write.mode("append").parquet(str(queue))

    def work(claimed):
        return claimed.select("id", F.when(F.col("requested_by") == "bad", "no such archive").alias("error"))

    jobs.run(spark, str(queue), str(out), work, str(tmp_path / "checkpoint"), retries=2)
    got = {r["id"]: (r["status"], r["progress_pct"], r["attempts"]) for r in jobs.latest(spark, str(out)).collect()}
    assert got == {"j1": ("complete", 100, 1), "j2": ("failed", 0, 2)}
    jobs.run(spark, str(queue), str(out), work, str(tmp_path / "checkpoint"), retries=2)
    assert jobs.latest(spark, str(out)).count() == 2
    table(spark, "analysis_jobs", job("j3", "ok"), job("j4", "lost")).write.mode("append").parquet(str(queue))
    jobs.run(spark, str(queue), str(out), lambda claimed: work(claimed.where("requested_by <> 'lost'")), str(tmp_path / "checkpoint"), retries=2)
    got = {r["id"]: (r["status"], r["error_message"]) for r in jobs.latest(spark, str(out)).collect()}
    assert got["j3"] == ("complete", None) and got["j4"] == ("failed", "no result")
    assert {r["status"] for r in spark.read.parquet(str(out)).where("id = 'j4'").collect()} == {"running", "queued", "failed"}


def test_guarded_routes(spark, world):
    """A stranger, a developer, an admin and an owner at the routes that read, set, analyze and delete."""
    member = {"project_id": "p1", "user_id": "u3", "permission_tier": "developer", "developer_role": "backend", "joined_at": T2}
    world = world | {"project_members": world["project_members"].unionByName(table(spark, "project_members", member)), "users": world["users"].unionByName(table(spark, "users", {"id": "u4", "email": "d@x.org", "created_at": T1}))}
    asked = spark.createDataFrame([("p1", "u1"), ("p1", "u2"), ("p1", "u3"), ("p1", "u4"), ("p1", None), ("p2", "u1"), ("p9", "u1")], "project_id string, by string")
    told = lambda df: {(r["project_id"], r["by"]): r["decision"] for r in df.collect()}
    stranger, anyone = "403 not a member", {("p1", None): "401", ("p9", "u1"): "403 not a member", ("p1", "u4"): "403 not a member"}
    got = api.read_projects(world, asked)
    assert told(got) == anyone | {("p1", "u1"): "ok", ("p1", "u2"): "ok", ("p1", "u3"): "ok", ("p2", "u1"): "ok"}
    rows = {(r["project_id"], r["by"]): r for r in got.collect()}
    assert rows["p1", "u3"]["settings"]["file_limit"] == 5 and rows["p1", "u3"]["by_tier"] == "developer" and rows["p1", "u4"]["repo_name"] is None and rows["p2", "u1"]["settings"] is None
    members = api.read_members(world, asked)
    assert told(members)["p1", "u4"] == stranger and [r["user_id"] for r in members.where("by = 'u3'").orderBy("position").collect()] == ["u1", "u2", "u3"]
    invitations = api.read_invitations(world, asked)
    assert [r["id"] for r in invitations.where("by = 'u2'").collect()] == ["i1"] and told(invitations)["p1", None] == "401"
    after, answers = api.analyze_projects(world, asked.withColumn("job", F.concat(F.lit("j"), F.coalesce("by", F.lit("")))), T2)
    assert told(answers) == anyone | {("p1", "u1"): "202", ("p1", "u2"): "202", ("p1", "u3"): "403 tier", ("p2", "u1"): "202"}
    assert {r["id"]: r["status"] for r in after["projects"].collect()} == {"p1": "analyzing", "p2": "analyzing", "p3": "complete"} and after["analysis_jobs"].count() == 3
    after, _, decided = api.delete_projects(world, asked)
    assert told(decided) == anyone | {("p1", "u1"): "ok", ("p1", "u2"): "403 tier", ("p1", "u3"): "403 tier", ("p2", "u1"): "ok"}
    assert [r["id"] for r in after["projects"].collect()] == ["p3"] and {r["project_id"] for r in after["project_members"].collect()} == {"p3"}


def test_settings_in_turn(spark, world):
    schema = "project_id string, by string, turn int, file_limit int, has_file_limit boolean, ai_enabled boolean, has_ai_enabled boolean"
    rows = [("p1", "u1", 1, 10, True, None, False), ("p1", "u2", 2, 20, True, False, True), ("p1", "u1", 3, None, False, None, None), ("p1", "u3", 4, 99, True, None, False), ("p2", "u1", 5, 7, True, None, False), ("p1", "u2", 6, None, False, True, True)]
    after, decided = api.change_settings(world, spark.createDataFrame(rows, schema), "turn")
    assert {r["turn"]: r["decision"] for r in decided.collect()} == {1: "ok", 2: "ok", 3: "400", 4: "403 not a member", 5: "404", 6: "ok"}
    row = after["project_settings"].where("project_id = 'p1'").first()
    assert row["file_limit"] == 20 and row["ai_enabled"] is True and row["loc_limit"] == 9


def test_members_in_turn(spark, world):
    """An admin makes a developer an admin and may then change them no more; the owner may."""
    member = {"project_id": "p1", "user_id": "u3", "permission_tier": "developer", "developer_role": "backend", "joined_at": T2}
    world = world | {"project_members": world["project_members"].unionByName(table(spark, "project_members", member))}
    schema = "project_id string, user_id string, by string, turn int, permission_tier string, has_permission_tier boolean, developer_role string, has_developer_role boolean"
    rows = [
        ("p1", "u3", "u2", 1, "admin", True, None, False), ("p1", "u3", "u2", 2, "developer", True, None, False), ("p1", "u3", "u1", 3, None, False, "frontend", True),
        ("p1", "u3", "u1", 4, None, False, None, False), ("p1", "u9", "u1", 1, "admin", True, None, False), ("p1", "u1", "u2", 1, "developer", True, None, False),
    ]
    after, decided = api.update_members(world, spark.createDataFrame(rows, schema), "turn")
    assert {(r["user_id"], r["turn"]): r["decision"] for r in decided.collect()} == {("u3", 1): "ok", ("u3", 2): "403", ("u3", 3): "ok", ("u3", 4): "400", ("u9", 1): "404", ("u1", 1): "403"}
    got = {(r["project_id"], r["user_id"]): (r["permission_tier"], r["developer_role"]) for r in after["project_members"].collect()}
    assert got["p1", "u3"] == ("admin", "frontend") and got["p1", "u1"] == ("owner", "backend") and len(got) == 5


def test_hash_of_units_beyond_the_first_plane(spark):
    def bucket(text, n):
        units, h = text.encode("utf-16-be"), 0
        for i in range(0, len(units), 2):
            shifted = (h << 5) & 0xFFFFFFFF
            h = int.from_bytes(units[i : i + 2]) + (shifted - (1 << 32) if shifted >= 1 << 31 else shifted) - h
        return abs(h) % n

    for text in ("a😀b", "𝒳@x.org", "\U0010ffff", "é日"):
        assert one(spark, fn.hash_bucket(F.col("a"), 97), a=text) == bucket(text, 97)
