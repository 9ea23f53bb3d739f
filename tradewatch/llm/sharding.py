"""Sharding by a permutation-filled lookup table.

Every shard has a preference list over the slots of a prime-sized table: offset and step come
from two hashes of its name, so the list visits every slot once. Shards take turns; at its
turn a shard claims its most preferred free slot, until the table is full. Shares differ by one
slot at most, and when a shard comes or goes few slots change hands.

The table depends on the shard names and its size alone. It is filled by one SQL fold whose state
is the list of remaining preferences (shards x slots), then broadcast: its size is the number of
slots, a parameter. A row's place is one hash and one look-up; rows are not shuffled.

Defined results: NULL keys count as the text "null" and share a shard; equal keys always do;
an empty key and a very long one are keys like any other. Repeated shard names count once. Columns named ``slot`` or
``shard`` are replaced, also where one of them is the key; all other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(16))
SLOTS = 2053


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def hash60(text: Column) -> Column:
    """A number below 2 ** 60 from the text (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row per slot."""
    names = sorted(set(shards))
    if not names or not is_prime(slots) or slots < len(names):
        raise ValueError("give at least one shard and a prime number of slots, not fewer than shards")
    one = spark.range(1).select(F.array(*[F.lit(n) for n in names]).alias("names"))
    prefs = F.transform("names", lambda n: F.transform(
        F.sequence(F.lit(0), F.lit(slots - 1)),
        lambda j: ((hash60(F.concat(n, F.lit(":offset"))) % slots + j * (hash60(F.concat(n, F.lit(":step"))) % (slots - 1) + 1)) % slots).cast("int")))
    start = F.struct(prefs.alias("free"), F.array().cast("array<int>").alias("claimed"))

    def turn(state: Column, t: Column) -> Column:
        slot = F.element_at(F.element_at(state["free"], (t % len(names)).cast("int") + 1), 1)
        return F.struct(F.transform(state["free"], lambda p: F.array_remove(p, slot)).alias("free"),
                        F.concat(state["claimed"], F.array(slot)).alias("claimed"))

    filled = one.select("names", F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn)["claimed"].alias("claimed"))
    claims = filled.select("names", F.posexplode("claimed").alias("t", "slot"))
    return claims.select("slot", F.element_at("names", (F.col("t") % len(names) + 1).cast("int")).alias("shard"))


def shard(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of its key."""
    place, held = "_slot", {c.lower() for c in df.columns}
    while place in held:
        place = "_" + place
    table = lookup_table(df.sparkSession, shards, slots).withColumnRenamed("slot", place)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    out = df.withColumn(place, (hash60(key) % slots).cast("int")).drop("slot", "shard")
    return out.join(F.broadcast(table), place).withColumnRenamed(place, "slot")


SQL = f"""
WITH RECURSIVE names AS (SELECT 'shard-' || lpad(i::VARCHAR, 3, '0') AS name, i FROM range({len(SHARDS)}) t(i)),
prefs AS (SELECT list(p ORDER BY i) AS free FROM (SELECT i, list_transform(range({SLOTS}), lambda j:
  (('0x' || substr(md5(name || ':offset'), 1, 15))::BIGINT % {SLOTS} + j * (('0x' || substr(md5(name || ':step'), 1, 15))::BIGINT % {SLOTS - 1} + 1)) % {SLOTS}) AS p FROM names)),
claims AS (SELECT 0 AS t, free, free[1][1] AS slot FROM prefs
  UNION ALL SELECT t + 1, next, next[(t + 1) % {len(SHARDS)} + 1][1] FROM (
    SELECT t, list_transform(free, lambda p: list_filter(p, lambda s: s <> slot)) AS next FROM claims WHERE t < {SLOTS - 1}))
SELECT doc_id, c.slot::INTEGER AS slot, 'shard-' || lpad((t % {len(SHARDS)})::VARCHAR, 3, '0') AS shard
FROM documents JOIN claims c ON c.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SLOTS}
"""
