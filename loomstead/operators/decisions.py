"""Business rules as ordered CASE expressions; the first that fits decides. Batches are decided in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.scalars import equals_ignoring_case, first_given, is_given
from loomstead.operators.relational import in_allowed
from loomstead.sources.shared import materialize


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first step whose condition holds; null conditions don't."""
    out = F.lit(otherwise)
    for condition, name in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def access(user: Column, tier: Column, allowed: list[str]) -> Column:
    """401 without a user, 403 without membership or an allowed tier, else allow."""
    return ladder((user.isNull(), "401"), (tier.isNull(), "403 not a member"), (~in_allowed(tier, allowed), "403 tier"), otherwise="allow")


def accept_invitation(there: Column, invited: Column, email: Column, status: Column, role: Column, member: Column) -> Column:
    return ladder(
        (~there, "404"), (~equals_ignoring_case(invited, email), "403"), (status != "pending", "409 not pending"),
        (role.isNull(), "400 no role"), (member, "409 member"), otherwise="accept",
    )


def create_invitation(email: Column, tier: Column, pending: Column) -> Column:
    return ladder((~(is_given(email) & is_given(tier)), "400"), (pending, "409"), otherwise="201")


def update_member(actor: Column, target: Column, fields: Column) -> Column:
    """Admins change developers only; what tier they give isn't looked at."""
    return ladder((target.isNull(), "404"), ((actor == "admin") & (target != "developer"), "403"), (fields == 0, "400"), otherwise="ok")


def remove_member(target: Column) -> Column:
    """Only owners are safe: admins may remove each other."""
    return ladder((target.isNull(), "404"), (target == "owner", "403"), otherwise="ok")


def accept_batch(requests: DataFrame, invitations: DataFrame, members: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decided requests (invitation_id, user_id, email, developer_role), next invitations and new members.

    Requests are taken in the order of user_id and invitation_id: after the first that is accepted an invitation isn't
    pending any more, and a user is a member. All that come first both of their invitation and of their user and
    project are accepted at once, those that they rule out go, and so on until none is left.
    """
    asked = requests.withColumnRenamed("developer_role", "asked_role").withColumnRenamed("email", "asked_email")
    inv = invitations.select("id", "project_id", F.col("email").alias("invited"), "permission_tier", F.col("developer_role").alias("given_role"), "status")
    own = members.select("project_id", "user_id").distinct().withColumn("_member", F.lit(True))
    joined = asked.join(inv, asked.invitation_id == inv.id, "left").join(own, ["project_id", "user_id"], "left")
    joined = joined.withColumn("role", first_given(F.col("given_role"), F.col("asked_role")))
    first = accept_invitation(F.col("id").isNotNull(), F.col("invited"), F.col("asked_email"), F.col("status"), F.col("role"), F.col("_member").isNotNull())
    guessed = materialize(joined.withColumn("guess", first).withColumn("_o", F.struct("user_id", "invitation_id", F.monotonically_increasing_id().alias("n"))))
    rest, taken = guessed.where("guess = 'accept'").select("_o", "invitation_id", "project_id", "user_id"), None
    while not rest.isEmpty():
        least = lambda *keys: F.min("_o").over(Window.partitionBy(*keys))
        now = materialize(rest.withColumn("_i", least("invitation_id")).withColumn("_u", least("project_id", "user_id")).where("_o = _i AND _o = _u").drop("_i", "_u"))
        taken = now if taken is None else taken.unionByName(now)
        rest = materialize(rest.join(now.select("invitation_id"), "invitation_id", "left_anti").join(now.select("project_id", "user_id"), ["project_id", "user_id"], "left_anti"))
    taken = taken if taken is not None else rest
    by = guessed.join(taken.select("invitation_id", F.col("_o").alias("_w")), "invitation_id", "left")
    ok = F.col("guess") == "accept"
    decided = by.withColumn("decision", F.when(ok & (F.col("_w") == F.col("_o")), "accept").when(ok & (F.col("_w") < F.col("_o")), "409 not pending").when(ok, "409 member").otherwise(F.col("guess")))
    won = decided.where("decision = 'accept'")
    new = won.select("project_id", "user_id", "permission_tier", F.col("role").alias("developer_role"), at.alias("joined_at"))
    marks = won.select("invitation_id", F.col("user_id").alias("_by"))
    after = invitations.join(marks, invitations.id == marks.invitation_id, "left")
    hit = F.col("_by").isNotNull()
    changed = {"status": F.when(hit, "accepted").otherwise(F.col("status")), "accepted_by": F.coalesce("_by", "accepted_by"), "accepted_at": F.when(hit, at).otherwise(F.col("accepted_at"))}
    return decided.select("invitation_id", "user_id", "decision"), after.select(*[changed.get(c, F.col(c)).alias(c) for c in invitations.columns]), new
