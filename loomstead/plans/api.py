"""What each route of the API does, over the domain's tables by name; writes give the tables next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.scalars import equals_ignoring_case, first_given, is_given
from loomstead.operators import decisions, mutations, relational
from loomstead.schemas import DEFAULTS, UNIQUE
from loomstead.sources.shared import materialize

#: The tiers that manage a project.
MANAGERS = ["owner", "admin"]

Tables = dict[str, DataFrame]


def _defaults(table: str) -> dict:
    return {c: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for c, v in DEFAULTS[table].items()}


def list_projects(t: Tables, user: str) -> DataFrame:
    """The projects that the user is a member of, newest first (position), with the flags of their latest snapshot."""
    members = t["project_members"].select("project_id", "user_id", "permission_tier", "developer_role").where(F.col("user_id") == user).drop("user_id")
    mine = t["projects"].join(members, t["projects"].id == members.project_id).drop("project_id")
    ids = mine.select("id")
    snapshots = t["analysis_snapshots"].join(ids.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("project_id", "created_at", F.col("id").alias("snapshot_id"))
    counts = relational.latest_with_count(ids, "id", snapshots, "project_id", "created_at", "snapshot_id", t["stale_flags"].select("snapshot_id"), "snapshot_id")
    return relational.numbered_by_range(mine.join(counts.select("id", "stale_count"), "id"), [], F.desc("created_at"), F.asc("id"))


def get_project(t: Tables, project: str) -> DataFrame:
    """The project with its settings as a row, null without."""
    nested = relational.nest(t["project_settings"], "project_id", "settings")
    p = t["projects"].where(F.col("id") == project)
    return p.join(nested, p.id == nested.project_id, "left").drop("project_id")


def create_projects(t: Tables, new: DataFrame, at: datetime) -> tuple[Tables, DataFrame]:
    """Projects (id, user_id, repo_owner, repo_name, branch, developer_role) with settings and owner, all three or none.

    The second result has those refused because the user has the same repository and branch already.
    """
    unique = UNIQUE["projects"][1]
    rest = [c for c in new.columns if c not in ("id", *unique)]
    chosen = new.join(t["projects"].select(*unique), unique, "left_anti").groupBy(*unique).agg(F.min(F.struct("id", *rest)).alias("_c"))
    # of several alike the smallest id; written, so that all three tables get the same
    fresh = materialize(chosen.select(*unique, "_c.*"))
    now, role = F.lit(at).cast("timestamp"), F.coalesce(first_given(F.col("developer_role")), F.lit("fullstack"))
    projects = fresh.drop("developer_role").withColumn("created_at", now)
    settings = fresh.select(F.col("id").alias("project_id"), role.alias("default_developer_role"))
    owners = fresh.select(F.col("id").alias("project_id"), "user_id", F.lit("owner").alias("permission_tier"), role.alias("developer_role"), now.alias("joined_at"))
    after = {
        "projects": mutations.insert(t["projects"], projects, _defaults("projects")),
        "project_settings": mutations.insert(t["project_settings"], settings, _defaults("project_settings")),
        "project_members": mutations.insert(t["project_members"], owners),
    }
    return t | after, new.join(fresh.select("id"), "id", "left_anti")


def read_projects(t: Tables, asked: DataFrame) -> DataFrame:
    """asked (project_id, by) with the decision (401, 403, 404, ok) and, if ok, the project, its settings and the caller's tier."""
    nested = relational.nest(t["project_settings"], "project_id", "settings")
    known = t["projects"].withColumnRenamed("id", "project_id").join(nested, "project_id", "left")
    rows = _guarded(t, asked, []).join(known.withColumn("_there", F.lit(True)), "project_id", "left")
    decided = rows.withColumn("decision", F.coalesce("decision", F.when(F.col("_there").isNull(), "404").otherwise("ok")))
    shown = [c for c in known.columns if c != "project_id"]
    return decided.select("project_id", "by", "decision", *[F.when(F.col("decision") == "ok", F.col(c)).alias(c) for c in [*shown, "by_tier"]])


def _guarded(t: Tables, asked: DataFrame, allowed: list[str]) -> DataFrame:
    """asked with the caller's tier and, where the guard refuses, a decision, else null."""
    return access(t, asked, allowed).withColumn("decision", F.when(F.col("access") != "allow", F.col("access"))).drop("access")


def update_settings(t: Tables, changes: DataFrame) -> Tables:
    """Per column of settings, changes (project_id, <column>, has_<column>) set what is supplied."""
    columns = [c for c in t["project_settings"].columns if f"has_{c}" in changes.columns]
    return t | {"project_settings": mutations.update_partial(t["project_settings"], changes, ["project_id"], columns)}


def change_settings(t: Tables, changes: DataFrame, order: str) -> tuple[Tables, DataFrame]:
    """update_settings as owners and admins may: changes also have `by` and an order; the decision on each.

    Refused (401, 403), without a field (400), of a project without settings (404), else ok. Several changes of one
    project are done one after another: of each field the last counts.
    """
    columns = [c for c in t["project_settings"].columns if f"has_{c}" in changes.columns]
    fields = sum((F.coalesce(F.col(f"has_{c}"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    there = t["project_settings"].select("project_id", F.lit(True).alias("_there"))
    ruled = decisions.ladder((fields == 0, "400"), (F.col("_there").isNull(), "404"), otherwise="ok")
    decided = _guarded(t, changes, MANAGERS).join(there, "project_id", "left").withColumn("decision", F.coalesce("decision", ruled))
    done = mutations.merged(decided.where("decision = 'ok'"), ["project_id"], columns, order)
    return update_settings(t, done), decided.select("project_id", "by", order, "decision")


def delete_project(t: Tables, project: DataFrame) -> tuple[Tables, dict[str, DataFrame]]:
    return mutations.cascade(t, "projects", project)


def delete_projects(t: Tables, asked: DataFrame) -> tuple[Tables, dict[str, DataFrame], DataFrame]:
    """Of asked (project_id, by) the projects that `by` owns go with all that hangs on them; the decision on each."""
    decided = materialize(_guarded(t, asked, ["owner"]).withColumn("decision", F.coalesce("decision", F.lit("ok"))).select("project_id", "by", "decision"))
    after, forbid = delete_project(t, decided.where("decision = 'ok'").select(F.col("project_id").alias("id")).distinct())
    return after, forbid, decided


def analyze(t: Tables, project: str, user: str, job: str, at: datetime) -> tuple[Tables, DataFrame]:
    """Marks the project and queues a job, whether or not one runs already; the mode is always initial."""
    named = t["projects"].where(F.col("id") == project)
    queued = named.select(F.lit(job).alias("id"), F.col("id").alias("project_id"), F.lit(user).alias("requested_by"), F.lit("initial").alias("job_type"), F.lit(at).cast("timestamp").alias("created_at"))
    projects = mutations.update_guarded(t["projects"], named.select("id"), "id", F.lit(True), {"status": F.lit("analyzing")}).drop("changed")
    after = {"projects": projects, "analysis_jobs": mutations.insert(t["analysis_jobs"], queued, _defaults("analysis_jobs"))}
    return t | after, queued.select(F.col("id").alias("job_id"), F.lit("queued").alias("status"), F.lit("initial").alias("mode"))


def analyze_projects(t: Tables, asked: DataFrame, at: datetime) -> tuple[Tables, DataFrame]:
    """asked (project_id, by, job): owners and admins mark their projects and queue a job each (202); the answer to each."""
    branches = t["projects"].select(F.col("id").alias("project_id"), "branch")
    decided = _guarded(t, asked, MANAGERS).join(branches, "project_id", "left")
    decided = materialize(decided.withColumn("decision", F.coalesce("decision", F.when(F.col("branch").isNull(), "404").otherwise("202"))).select("project_id", "by", "job", "branch", "decision"))
    ok = decided.where("decision = '202'")
    queued = ok.select(F.col("job").alias("id"), "project_id", F.col("by").alias("requested_by"), F.lit("initial").alias("job_type"), F.lit(at).cast("timestamp").alias("created_at"))
    projects = mutations.update_guarded(t["projects"], ok.select(F.col("project_id").alias("id")), "id", F.lit(True), {"status": F.lit("analyzing")}).drop("changed")
    after = {"projects": projects, "analysis_jobs": mutations.insert(t["analysis_jobs"], queued, _defaults("analysis_jobs"))}
    shown = lambda c: F.when(F.col("decision") == "202", c)
    return t | after, decided.select("project_id", "by", "decision", shown(F.col("job")).alias("job_id"), shown(F.lit("queued")).alias("status"), shown(F.lit("initial")).alias("mode"), shown(F.col("branch")).alias("branch"))


def read_members(t: Tables, asked: DataFrame) -> DataFrame:
    """Of asked (project_id, by) a row for each member of a project that `by` is a member of, else one with the decision."""
    rows = t["project_members"].join(t["users"].select(F.col("id").alias("user_id"), "email"), "user_id")
    return _listed(t, asked, rows, F.asc("joined_at"), F.asc("user_id"))


def read_invitations(t: Tables, asked: DataFrame, status: str = "pending") -> DataFrame:
    """The same of the invitations of that status, newest first."""
    inviters = t["users"].select(F.col("id").alias("invited_by"), F.col("email").alias("invited_by_email"))
    return _listed(t, asked, t["project_invitations"].where(F.col("status") == status).join(inviters, "invited_by", "left"), F.desc("created_at"), F.asc("id"))


def _listed(t: Tables, asked: DataFrame, rows: DataFrame, *order) -> DataFrame:
    decided = _guarded(t, asked, []).withColumn("decision", F.coalesce("decision", F.lit("ok"))).select("project_id", "by", "decision")
    named = decided.where("decision = 'ok'").join(rows, "project_id").select("project_id", "by", "decision", *[c for c in rows.columns if c != "project_id"])
    return relational.numbered_by_range(named, ["project_id", "by"], *order).unionByName(decided.where("decision <> 'ok'"), allowMissingColumns=True)


def list_members(t: Tables, project: str) -> DataFrame:
    """Members with their address, in the order of joining (position)."""
    rows = t["project_members"].where(F.col("project_id") == project).join(t["users"].select(F.col("id").alias("user_id"), "email"), "user_id")
    return relational.numbered_by_range(rows, ["project_id"], F.asc("joined_at"), F.asc("user_id"))


def list_invitations(t: Tables, project: str, status: str = "pending") -> DataFrame:
    rows = t["project_invitations"].where((F.col("project_id") == project) & (F.col("status") == status))
    inviters = t["users"].select(F.col("id").alias("invited_by"), F.col("email").alias("invited_by_email"))
    return relational.numbered_by_range(rows.join(inviters, "invited_by", "left"), ["project_id"], F.desc("created_at"), F.asc("id"))


def my_invitations(t: Tables, email: str) -> DataFrame:
    """Pending invitations for an address, whatever its case, with project and inviter."""
    rows = t["project_invitations"].where(equals_ignoring_case(F.col("email"), F.lit(email)) & (F.col("status") == "pending"))
    projects = t["projects"].select(F.col("id").alias("project_id"), "repo_owner", "repo_name", "branch")
    inviters = t["users"].select(F.col("id").alias("invited_by"), F.col("email").alias("invited_by_email"))
    return rows.join(projects, "project_id").join(inviters, "invited_by", "left").orderBy(F.desc("created_at"), "id")


def access(t: Tables, asked: DataFrame, allowed: list[str]) -> DataFrame:
    """asked (project_id, user_id as `by`, ...) with the caller's tier (by_tier) and the guard's decision (access)."""
    tiers = t["project_members"].select("project_id", F.col("user_id").alias("by"), F.col("permission_tier").alias("by_tier"))
    return asked.join(tiers, ["project_id", "by"], "left").withColumn("access", decisions.access(F.col("by"), F.col("by_tier"), allowed))


def create_invitations(t: Tables, new: DataFrame, at: datetime) -> tuple[Tables, DataFrame]:
    """Invitations (id, project_id, by, email, permission_tier, developer_role), and the decision on each id.

    Owners and admins invite; of several for one project and address only the smallest id is the first.
    """
    there = t["project_invitations"].where("status = 'pending'").select("project_id", F.lower("email").alias("_e")).distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("project_id", "_e", "_asked").orderBy("id"))
    guarded = access(t, new, MANAGERS).withColumn("_e", F.lower("email")).join(there, ["project_id", "_e"], "left")
    proper = (F.col("access") == "allow") & is_given(F.col("email")) & is_given(F.col("permission_tier"))
    pending = F.col("_there").isNotNull() | (F.col("_asked") & (first > 1))
    ruled = decisions.create_invitation(F.col("email"), F.col("permission_tier"), F.col("_pending"))
    decided = guarded.withColumn("_asked", proper).withColumn("_pending", pending).withColumn("decision", F.when(F.col("access") != "allow", F.col("access")).otherwise(ruled))
    rows = decided.where("decision = '201'").select("id", "project_id", "email", "permission_tier", "developer_role", F.col("by").alias("invited_by"), F.lit(at).cast("timestamp").alias("created_at"))
    return t | {"project_invitations": mutations.insert(t["project_invitations"], rows, _defaults("project_invitations"))}, decided.select("id", "decision")


def invitation(t: Tables, asked: DataFrame) -> DataFrame:
    """asked (id, by_email) with the decision (404, 403, ok) and, if ok, the invitation with its project."""
    projects = t["projects"].select(F.col("id").alias("project_id"), "repo_owner", "repo_name", "branch")
    rows = asked.join(t["project_invitations"].join(projects, "project_id"), "id", "left")
    decision = decisions.ladder((F.col("email").isNull(), "404"), (~equals_ignoring_case(F.col("email"), F.col("by_email")), "403"), otherwise="ok")
    named = rows.withColumn("decision", decision)
    return named.select("id", "by_email", "decision", *[F.when(F.col("decision") == "ok", F.col(c)).alias(c) for c in named.columns if c not in ("id", "by_email", "decision")])


def accept_invitations(t: Tables, requests: DataFrame, at: datetime) -> tuple[Tables, DataFrame]:
    """Requests (invitation_id, user_id, email, developer_role) decided; the accepted make members."""
    decided, after, new = decisions.accept_batch(requests, t["project_invitations"], t["project_members"], F.lit(at).cast("timestamp"))
    return t | {"project_invitations": after, "project_members": mutations.insert(t["project_members"], new)}, decided


def revoke_invitations(t: Tables, ids: DataFrame) -> tuple[Tables, DataFrame]:
    """Of ids (id, project_id, by) the pending ones of that project become revoked; the decision on each."""
    known = t["project_invitations"].where("status = 'pending'").select("id", "project_id", F.lit(True).alias("_there"))
    guarded = access(t, ids, MANAGERS).join(known, ["id", "project_id"], "left")
    decided = guarded.withColumn("decision", decisions.ladder((F.col("access") != "allow", "refused"), (F.col("_there").isNull(), "404"), otherwise="ok"))
    decided = decided.withColumn("decision", F.when(F.col("decision") == "refused", F.col("access")).otherwise(F.col("decision")))
    after = mutations.update_guarded(t["project_invitations"], decided.where("decision = 'ok'"), "id", F.lit(True), {"status": F.lit("revoked")})
    return t | {"project_invitations": after.drop("changed")}, decided.select("id", "project_id", "decision")


def _targets(t: Tables, keys: DataFrame) -> DataFrame:
    """keys (project_id, user_id, by, ...) with the target's tier and the guard's decision."""
    tiers = t["project_members"].select("project_id", "user_id", F.col("permission_tier").alias("target_tier"))
    return access(t, keys, MANAGERS).join(tiers, ["project_id", "user_id"], "left")


def update_members(t: Tables, changes: DataFrame, order: str | None = None) -> tuple[Tables, DataFrame]:
    """changes (project_id, user_id, by, permission_tier, has_permission_tier, developer_role, has_developer_role).

    With an order several changes of one member are decided and done one after another, each on what the one before
    left; without one they are refused. Callers have the tier that they had before the batch. There are as many rounds as
    changes of one member, over the members named alone.
    """
    columns, keys = ["permission_tier", "developer_role"], ["project_id", "user_id"]
    fields = sum((F.coalesce(F.col(f"has_{c}"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    ruled = decisions.update_member(F.col("by_tier"), F.col("target_tier"), fields)
    given = F.when(F.col("access") != "allow", F.col("access")).otherwise(ruled)
    sets = [*columns, *[f"has_{c}" for c in columns]]
    if not order:
        decided = _targets(t, changes).withColumn("decision", given)
        after = mutations.update_partial(t["project_members"], decided.where("decision = 'ok'").select(*keys, *sets), keys, columns)
        return t | {"project_members": after}, decided.select(*keys, "decision")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    asked = materialize(access(t, changes, MANAGERS).withColumn("_turn", turn))
    first = named = materialize(t["project_members"].join(asked.select(*keys).distinct(), keys, "left_semi"))
    decided = asked.where("_turn = 0").select(*keys, order, F.lit(None).cast("string").alias("decision"))
    for turn_now in range(1, (asked.agg(F.max("_turn")).first()[0] or 0) + 1):
        now = asked.where(F.col("_turn") == turn_now).join(named.select(*keys, F.col("permission_tier").alias("target_tier")), keys, "left")
        done = materialize(now.withColumn("decision", given).select(*keys, order, *sets, "decision"))
        named = materialize(mutations.update_partial(named, done.where("decision = 'ok'").select(*keys, *sets), keys, columns).select(*first.columns))
        decided = decided.unionByName(done.select(*keys, order, "decision"))
    after = mutations.upsert(t["project_members"], named, keys, columns)
    return t | {"project_members": after}, decided


def remove_members(t: Tables, keys: DataFrame) -> tuple[Tables, DataFrame]:
    """Of keys (project_id, user_id, by) members go, but for owners; the decision on each."""
    decided = _targets(t, keys).withColumn("decision", F.when(F.col("access") != "allow", F.col("access")).otherwise(decisions.remove_member(F.col("target_tier"))))
    gone = decided.where("decision = 'ok'").select("project_id", "user_id")
    return t | {"project_members": mutations.delete(t["project_members"], gone, ["project_id", "user_id"])}, decided.select("project_id", "user_id", "decision")


def profile(t: Tables, user: str) -> DataFrame:
    """The user and whether an account is connected. Of several connections the latest counts, ties by id."""
    last = t["github_connections"].where(F.col("user_id") == user).groupBy("user_id").agg(F.max(F.struct("created_at", "id", "github_username"))["github_username"].alias("github_username"))
    rows = t["users"].where(F.col("id") == user)
    return rows.join(last, rows.id == last.user_id, "left").drop("user_id").withColumn("github_connected", F.col("github_username").isNotNull())


def save_connections(t: Tables, rows: DataFrame) -> Tables:
    """Upsert by user and account, the latest (created_at) of each: name, token and scopes change, id and created_at stay."""
    after = mutations.upsert(t["github_connections"], rows, ["user_id", "github_user_id"], ["github_username", "access_token_encrypted", "scopes"], order="created_at")
    return t | {"github_connections": after.select(*t["github_connections"].columns)}
