"""Tenant, chat and operations queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.settings import ROLES


def list_files(files: DataFrame, versions: DataFrame | None = None, status: str | None = None, name_like: str | None = None) -> DataFrame:
    """Files that aren't deleted, newest first, with the storage key of their current version."""
    from sparkrag.operators.ingest import current_versions

    rows = files.where(~F.col("is_deleted"))
    if status:
        rows = rows.where(F.col("status") == status)
    if name_like:
        rows = rows.where(F.contains(F.lower("filename"), F.lit(name_like.lower())))
    return (rows if versions is None else current_versions(rows, versions)).orderBy(F.desc("created_at"), "file_id")


def list_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with their message counts, newest first."""
    counts = messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"))
    return chats.join(counts, "chat_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).orderBy(F.desc("created_at"), "chat_id")


def chat_detail(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """(chat_id, messages): messages in order, each with its citations in order."""
    fields = [c for c in citations.columns if c not in ("chat_id", "message_id")]
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"]))).alias("citations"))
    rows = messages.join(cited, "message_id", "left")
    message = F.struct("seq", "message_id", "role", "content", F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)).alias("citations"))
    return rows.groupBy("chat_id").agg(F.array_sort(F.collect_list(message), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("messages"))


def user_workspaces(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    return memberships.join(workspaces, "workspace_id").select("user_id", "workspace_id", "slug", "role")


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    return memberships.join(users, "user_id").select("workspace_id", "user_id", "email", "role")


def role_rank(role: Column) -> Column:
    """1 for the least role; 0 for none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0))


def access_decisions(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests (user_id, workspace_id, min_role) with decision allow, forbidden or not_found."""
    rows = requests.join(memberships.select("user_id", "workspace_id", "role"), ["user_id", "workspace_id"], "left")
    decision = F.when(F.col("role").isNull(), "not_found").when(role_rank(F.col("role")) < role_rank(F.col("min_role")), "forbidden").otherwise("allow")
    return rows.select(*requests.columns, decision.alias("decision"))


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    live = sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return live.join(users.where("is_active").select("user_id"), "user_id", "left_semi")


def revoke_all(sessions: DataFrame, user_ids: DataFrame, now: Column) -> DataFrame:
    gone = user_ids.select("user_id").distinct().withColumn("_gone", F.lit(True))
    return sessions.join(gone, "user_id", "left").withColumn("revoked_at", F.when(F.col("_gone") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).select(*sessions.columns)


def last_admin(memberships: DataFrame) -> DataFrame:
    """Workspaces with one admin or none."""
    return memberships.groupBy("workspace_id").agg(F.count_if(F.col("role") == "admin").alias("n_admins")).where("n_admins <= 1")


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("workspace_id", "status").agg(F.count("*").alias("n_files"))


def recent_failures(files: DataFrame, n: int = 10) -> DataFrame:
    """The latest n failed files of each workspace."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), "file_id")
    return files.where("status = 'failed'").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).select("workspace_id", "file_id", "filename", "error", "created_at")


def apply_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """messages with the last feedback (message_id, value up|down|null, ts) of assistants' messages."""
    last = feedback.groupBy("message_id").agg(F.max(F.struct("ts", "value")).alias("_f"))
    own = F.when((F.col("role") == "assistant") & F.col("_f").isNotNull(), F.col("_f.value")).otherwise(F.col("feedback"))
    return messages.join(last, "message_id", "left").withColumn("feedback", own).select(*messages.columns)


def reconcile_counts(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(table_name, left_rows, right_rows, matches) of two copies of tables."""

    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        out = None
        for table, df in tables.items():
            one = df.agg(F.count("*").alias(name)).select(F.lit(table).alias("table_name"), name)
            out = one if out is None else out.unionByName(one)
        return out

    rows = counts(a, "left_rows").join(counts(b, "right_rows"), "table_name", "full_outer")
    return rows.withColumn("matches", F.col("left_rows").eqNullSafe(F.col("right_rows")))
