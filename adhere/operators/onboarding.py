"""New owners: profiles from sign-ups, backfill, share codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import cut_lineage

MAX_CODE_ROUNDS = 64


def profiles_from_signups(signups: DataFrame) -> DataFrame:
    """Names from the sign-up's own data, else from the mail address."""
    meta = F.col("raw_user_meta_data")
    username = F.coalesce(N.json_field(meta, "username"), N.username_of(F.col("email")))
    return signups.select(
        "owner_id", "email", username.alias("username"),
        F.coalesce(N.json_field(meta, "display_name"), username).alias("display_name"))


def backfill_names(profiles: DataFrame) -> DataFrame:
    """Fill in what profiles from before these columns lack."""
    username = F.coalesce("username", N.username_of(F.col("email")))
    return profiles.withColumns({
        "username": username, "display_name": F.coalesce("display_name", username)})


def assign_share_codes(profiles: DataFrame) -> DataFrame:
    """(owner_id, share_code) for all profiles; codes already there stay.

    Every owner without a code proposes the one its key digests to. A code
    that is free goes to the smallest key proposing it; the others try their
    next digest in the next round. A round joins only what is still open
    against the codes given out, is written to the shared folder, and leaves a
    small fraction of its input. The result depends on the keys only, not on
    partitioning, so a lost executor cannot change it.
    """
    taken = profiles.where(F.col("share_code").isNotNull()).select("owner_id", "share_code")
    waiting = profiles.where(F.col("share_code").isNull()).select("owner_id")
    for attempt in range(MAX_CODE_ROUNDS):
        proposed = waiting.select(
            "owner_id", N.code_candidate(F.col("owner_id"), attempt).alias("share_code"))
        winners = (proposed.join(taken.select("share_code"), "share_code", "left_anti")
                   .groupBy("share_code").agg(F.min("owner_id").alias("owner_id"))
                   .select("owner_id", "share_code"))
        winners = cut_lineage(winners)
        taken = taken.unionByName(winners)
        waiting = cut_lineage(waiting.join(winners, "owner_id", "left_anti"))
        if waiting.isEmpty():
            return taken
    raise RuntimeError("share codes are running out; lengthen them")
