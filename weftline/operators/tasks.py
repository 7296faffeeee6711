"""Task tables: states, expiry, capacity, pages of a listing, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# States and limits of tasks.
TERMINAL = ("completed", "failed", "cancelled")
LEAST_TTL_MS, MOST_TTL_MS, DEFAULT_TTL_MS = 1_000, 86_400_000, 60_000
MOST_TASKS, MOST_PER_OWNER, PAGE_SIZE = 5_000, 1_000, 50


def task_ttl(ttl_ms: Column) -> Column:
    return F.least(F.greatest(F.coalesce(ttl_ms, F.lit(DEFAULT_TTL_MS)), F.lit(LEAST_TTL_MS)), F.lit(MOST_TTL_MS))


def states(events: DataFrame) -> DataFrame:
    """(task_id, owner_key, status, created_at, updated_at) from task events (task_id, owner_key, ts, status): the first terminal event is final."""
    done = F.col("status").isin(*TERMINAL)
    return events.groupBy("task_id").agg(
        F.min_by("owner_key", "ts").alias("owner_key"),
        F.coalesce(F.min_by(F.when(done, F.col("status")), F.when(done, F.col("ts"))), F.max_by("status", "ts")).alias("status"),
        F.min("ts").alias("created_at"),
        F.coalesce(F.min(F.when(done, F.col("ts"))), F.max("ts")).alias("updated_at"),
    )


def live(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks whose age is not over their time to live."""
    age = F.unix_millis(now) - F.unix_millis(F.col("created_at"))
    return tasks.filter(age <= task_ttl(F.col("ttl_ms")))


def by_id(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (task_id, owner_key) with the task's status and times, null where there is none; an owner sees own tasks alone, a null owner_key any."""
    known = tasks.select(F.col("task_id").alias("_id"), F.col("owner_key").alias("_owner"), "status", "created_at", "updated_at")
    mine = (F.col("task_id") == F.col("_id")) & (F.col("owner_key").isNull() | (F.col("owner_key") == F.col("_owner")))
    return requests.join(known, mine, "left").drop("_id", "_owner")


def cancel(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (task_id, owner_key) with the status after the request and error: an unknown task or one in a terminal state cannot be cancelled."""
    found = by_id(tasks, requests)
    final = F.col("status").isin(*TERMINAL)
    error = F.when(F.col("status").isNull(), F.lit("Task not found")).when(final, F.concat(F.lit("Cannot cancel task: already "), F.col("status")))
    return found.select(*requests.columns, F.when(F.col("status").isNotNull() & ~final, F.lit("cancelled")).otherwise(F.col("status")).alias("status"), error.alias("error"))


def capacity_errors(tasks: DataFrame, owners: DataFrame, total: int = MOST_TASKS, per_owner: int = MOST_PER_OWNER) -> DataFrame:
    """``owners`` (owner_key) with error: why a further task of the owner is refused, or null. The total is looked at first."""
    held = tasks.groupBy("owner_key").agg(F.count(F.lit(1)).alias("_own"))
    whole = tasks.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    own = F.coalesce(F.col("_own"), F.lit(0))
    error = F.when(F.lit(whole >= total), F.lit(f"Task capacity reached ({total} total tasks)")).when(own >= per_owner, F.lit(f"Task capacity reached for owner ({per_owner} tasks)"))
    return owners.join(held, "owner_key", "left").select(*owners.columns, error.alias("error"))


def over_capacity(tasks: DataFrame, per_owner: int = MOST_PER_OWNER) -> DataFrame:
    """Owners that have reached their capacity."""
    return tasks.groupBy("owner_key").agg(F.count(F.lit(1)).alias("tasks")).filter(F.col("tasks") >= per_owner)


def cancel_owner(tasks: DataFrame, owner: str) -> DataFrame:
    open_ = (F.col("owner_key") == owner) & ~F.col("status").isin(*TERMINAL)
    return tasks.withColumn("status", F.when(open_, F.lit("cancelled")).otherwise(F.col("status")))


def cursor(offset: Column) -> Column:
    """An offset as a cursor: base64 for URLs, without padding."""
    return F.translate(F.rtrim(F.base64(F.encode(offset.cast("string"), "UTF-8")), F.lit("=")), "+/", "-_")


def offset_of(cursor_: Column) -> Column:
    """A cursor's offset, null for what is no cursor."""
    text = F.translate(cursor_, "-_", "+/")
    padded = F.rpad(text, F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8").try_cast("long")


def listing(tasks: DataFrame, owner: str, offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """A page of an owner's tasks in order of creation, with the next page's cursor where there is one."""
    mine = tasks.filter(F.col("owner_key") == owner).orderBy("created_at", "task_id").offset(offset).limit(size + 1)
    # the page and one row more: both windows see no other rows
    placed = mine.withColumns({"_place": F.row_number().over(W.orderBy("created_at", "task_id")), "_rows": F.count(F.lit(1)).over(W.partitionBy())})
    more = F.when(F.col("_rows") > size, cursor(F.lit(offset + size)))
    return placed.filter(F.col("_place") <= size).withColumn("next_cursor", more).drop("_place", "_rows")


def request_id(context: Column) -> Column:
    """The request's id in a JSON context: a string, or a number as text; else null."""
    v = F.variant_get(F.try_parse_json(context), "$.requestId", "variant")
    return F.when(F.schema_of_variant(v).isin("STRING") | F.schema_of_variant(v).rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "string"))


def session_id(context: Column) -> Column:
    """The session's id in a JSON context: its own field, else the request's session header; null unless a string."""
    v = F.try_parse_json(context)
    text = lambda path: F.when(F.schema_of_variant(F.variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.coalesce(text("$.sessionId"), text("$.requestInfo.headers['mcp-session-id']"))


def owner_key(session: Column, client: Column, token: Column) -> Column:
    tagged = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(name), x))
    return F.coalesce(tagged("session:", session), tagged("client:", client), tagged("token:", token), F.lit("default"))
