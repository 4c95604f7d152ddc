"""What a request carries, scanned by content.

A request sends a list of messages, most of which earlier requests sent too. Its
membership table names them by digest; each distinct message is scanned once,
and a request's context is the sum over its members. A request that drops or
replaces messages (a compacted conversation) simply has other members, so its
counts may fall. Scanning is per message: a match that would span two messages
isn't one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect


def digest(text: Column) -> Column:
    """The 256-bit address of a message's text."""
    return F.unhex(F.sha2(text, 256))


def scanned_messages(messages: DataFrame, rules=None) -> DataFrame:
    """(digest, hits) of every distinct message of `messages` (digest, text), each scanned once."""
    once = messages.groupBy("digest").agg(F.any_value("text").alias("text"))
    return detect.with_scan(once, rules=rules, sample_cap=0).select("digest", "hits")


def request_hits(members: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """(key…, type, hits) per request. A message that a request holds twice counts twice. Members
    are counted per message before the join, so only messages with findings meet it."""
    held = members.groupBy(*key, "digest").agg(F.count(F.lit(1)).alias("times"))
    found = scanned.where(F.size("hits") > 0).select("digest", F.inline("hits"))
    return (held.join(found, "digest").groupBy(*key, "type")
            .agg(F.sum(F.col("count") * F.col("times")).alias("hits")))
