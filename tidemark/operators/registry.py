"""Client registry, licences, devices and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import MOBILE_MARKS


def license_status(status: Column, expires_at: Column, today: str) -> Column:
    """Dates compare as text (L1)."""
    return F.when(status == "Revoked", "Revoked").when((expires_at == "Lifetime") | (expires_at >= today), "Active").otherwise("Expired")


def device_slots(mobile: Column, pc: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(mobile) & has(pc), "both").when(has(mobile), "mobile").when(has(pc), "pc").otherwise("none")


def kpis(registry: DataFrame, today: str) -> DataFrame:
    active = F.count_if(license_status(F.col("status"), F.col("expires_at"), today) == "Active")
    return registry.agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("expired_or_revoked"))


def recipients(registry: DataFrame) -> DataFrame:
    """Distinct chat ids of active clients that have one."""
    chat = F.trim("telegram_id")
    return registry.where((F.col("status") == "Active") & (chat != "")).select(chat.alias("chat_id")).distinct()


def outbox(messages: DataFrame, to: DataFrame) -> DataFrame:
    """Each message for each recipient (A6). Spark sends the messages to the recipients if they are as few as they should be."""
    return to.crossJoin(messages)


def upsert(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes replace those of the same key; of several, the one that came last (H5)."""
    newest = changes.groupBy("key").agg(F.max_by(F.struct(*registry.columns), F.struct("created_at", "ingest")).alias("r")).select("r.*")
    return registry.join(newest.select("key"), "key", "left_anti").select(*registry.columns).unionByName(newest)


def without_keys(registry: DataFrame, keys: DataFrame) -> DataFrame:
    return registry.join(keys.select("key"), "key", "left_anti")


def apply_edits(registry: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: seq, key, op (chat, reset, revoke, delete), arg; the last one of a kind counts, a delete always."""
    last = lambda op, what: F.max_by(F.when(F.col("op") == op, what), F.when(F.col("op") == op, F.col("seq")))
    by_key = edits.groupBy("key").agg(last("chat", F.col("arg")).alias("new_chat"), F.bool_or(F.col("op") == "reset").alias("reset"), F.bool_or(F.col("op") == "revoke").alias("revoke"), F.bool_or(F.col("op") == "delete").alias("gone"))
    rows = registry.join(by_key, "key", "left").where(~F.coalesce("gone", F.lit(False)))
    reset, revoke = F.coalesce("reset", F.lit(False)), F.coalesce("revoke", F.lit(False))
    changed = {
        "telegram_id": F.coalesce("new_chat", "telegram_id"),
        "status": F.when(revoke, "Revoked").otherwise(F.col("status")),
        "bound_mobile_id": F.when(reset, "").otherwise(F.col("bound_mobile_id")),
        "bound_pc_id": F.when(reset, "").otherwise(F.col("bound_pc_id")),
    }
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in registry.columns))


def audit(presented: DataFrame, registry: DataFrame, today: str, salt: str, prefix: str) -> DataFrame:
    """key, verdict, days_left for presented keys (L3); the first rule that holds counts."""
    clean = F.upper(F.trim("presented"))
    rows = presented.select("presented", clean.alias("key")).join(registry.select("key", "status"), "key", "left")
    part = F.split("key", "-")
    rows = rows.select("presented", "status", (F.size(part) == 4).alias("four"), F.get(part, F.lit(0)).alias("p0"), F.get(part, F.lit(1)).alias("name"), F.get(part, F.lit(2)).alias("until"), F.get(part, F.lit(3)).alias("sig"))
    signed = F.upper(F.substring(F.sha2(F.concat_ws(":", "name", "until", F.lit(salt)).cast("binary"), 256), 1, 4))
    ours = F.col("four") & (F.col("p0") == prefix) & (F.col("sig") == signed)
    date = F.when(F.col("until").rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp("until", F.lit("yyyyMMdd"))))
    days = F.datediff(date, F.lit(today).cast("date"))
    verdict = F.when(F.col("status") == "Revoked", "revoked").when(ours & (F.col("until") == "LIFETIME"), "lifetime").when(ours & (days >= 0), "valid").when(ours & (days < 0), "expired").otherwise("unrecognized")
    return rows.select("presented", verdict.alias("verdict"), F.when(verdict == "valid", days).alias("days_left"))


def fingerprint(ip: Column, agent: Column) -> tuple[Column, Column]:
    """Device class and id from the forwarded address and the browser's name; null if either is missing (L4)."""
    first = F.trim(F.split_part(ip, F.lit(","), F.lit(1)))
    low = F.lower(agent)
    mobile = F.lit(False)
    for mark in MOBILE_MARKS:
        mobile = mobile | F.contains(low, F.lit(mark))
    there = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(agent, F.lit("")) != "")
    device = F.substring(F.sha2(F.concat(first, F.lit(":"), F.substring(low, 1, 80)).cast("binary"), 256), 1, 16)
    return F.when(there, F.when(mobile, "Mobile").otherwise("PC")), F.when(there, device)


def first_binding(logins: DataFrame) -> DataFrame:
    """logins (login_ts, login_id, key, dev_type, device_id) with bound and violation.

    The first non-empty device of a (key, dev_type) binds; later ones that differ are violations, empty ones too.
    Each task sends one row a key; no key's logins are sorted, and Spark can split those of a hot key in the join.
    """
    at, there = F.struct("login_ts", "login_id"), F.coalesce("device_id", F.lit("")) != ""
    first = logins.where(there).groupBy("key", "dev_type").agg(F.min_by("device_id", at).alias("first"), F.min(at).alias("since"))
    rows = logins.alias("l").join(first.alias("f"), F.col("l.key").eqNullSafe(F.col("f.key")) & F.col("l.dev_type").eqNullSafe(F.col("f.dev_type")), "left").select("l.*", "first", "since")
    rows = rows.withColumn("bound", F.when(at >= F.col("since"), F.col("first")))
    return rows.drop("first", "since").withColumn("violation", F.coalesce(F.col("bound") != F.coalesce("device_id", F.lit("")), F.lit(False)))


def sessions(events: DataFrame, hours: int = 120) -> DataFrame:
    """device_id, session, start, last, n: activity with no gap over `hours`; a gap of exactly that long still renews (J5, batch)."""
    order = Window.partitionBy("device_id").orderBy("ts")
    gap = F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {hours} HOURS")
    rows = events.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("device_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
