"""Host safety over stored DNS answers: alias chains and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.config import BLOCKED_HOSTS, BLOCKED_SUFFIXES
from weftline.functions.urls import is_blocked_ip, normalize_dns_name

MOST_ALIASES = 5


def unsafe_name(name):
    hit = name.isin(*BLOCKED_HOSTS)
    for s in BLOCKED_SUFFIXES:
        hit = hit | name.endswith(s)
    return hit


def host_safety(hosts: DataFrame, aliases: DataFrame, addresses: DataFrame) -> DataFrame:
    """``hosts`` (host) with reason: why a host must not be fetched, or null.

    ``aliases`` (host, target) hold one alias for each name; a chain of up to MOST_ALIASES is followed, and a blocked name
    on it rejects. ``addresses`` (host, ip): any blocked address of the last name rejects; none at all is no data.
    """
    step = aliases.select(normalize_dns_name(F.col("host")).alias("_from"), normalize_dns_name(F.col("target")).alias("_to"))
    out = hosts.withColumn("_name", normalize_dns_name(F.col("host"))).withColumn("_bad", unsafe_name(F.col("_name")))
    for _ in range(MOST_ALIASES):
        out = out.join(step, F.col("_name") == F.col("_from"), "left")
        out = out.select(*hosts.columns, F.coalesce("_to", "_name").alias("_name"), (F.col("_bad") | F.coalesce(unsafe_name(F.col("_to")), F.lit(False))).alias("_bad"))
    known = addresses.select(normalize_dns_name(F.col("host")).alias("_host"), is_blocked_ip(F.col("ip")).alias("_blocked")).groupBy("_host").agg(F.max("_blocked").alias("_blocked"))
    out = out.join(known, F.col("_name") == F.col("_host"), "left")
    reason = F.when(F.col("_bad"), "EBLOCKED").when(F.col("_host").isNull(), "ENODATA").when(F.col("_blocked"), "EBLOCKED")
    return out.select(*hosts.columns, reason.alias("reason"))
