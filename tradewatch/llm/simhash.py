"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has the majority bit of the XXH64 values of its word shingles. Two
fingerprints are linked when at most ``max_distance`` of their 64 bits differ; groups are the
connected components.

Ball hashing: if two fingerprints differ in two bits, flipping one bit on either side makes them
meet, so every fingerprint emits all variants within half the radius (one flip) and the shuffle
on variants brings linked ones together. Three bits have no whole half: emitting radius one and
two would be 2 081 rows for each fingerprint. Instead the 64 bits are cut into three blocks and
one block is left out in turn. Of three differing bits either

* one block holds exactly one: leave it out, the rest differs in two bits and meets; the left-out
  values differ in one bit, a second ball of radius one over them; or
* all three are in one block: the rest is equal, and only inside such groups of equal rest the
  block's values emit their balls of radius one and two.

That is 130 rows for each distinct fingerprint (rest within one flip, three times).

No pairs are made within a group. Members of a variant whose left-out values are equal are all
within two bits of each other, so a star to the smallest one keeps every component; the second
ball ties smallest members to smallest members. Every link is still verified by its bit count.
Equal fingerprints (exact copies, texts without words) are one node with its smallest id.
No side of these joins is broadcast: the planner sizes a ball by the rows before its flips are made.

Defined results: NULL texts count as empty; texts without words have fingerprint zero, fewer
words than a shingle give one shingle of all words. A group whose ids are all NULL has a NULL
component id. Repeated rows come out once each. Very long texts are hashed in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import sorted_side, written
from tradewatch.llm.components import components

#: bit ranges of the three blocks
BLOCKS = ((0, 22), (22, 43), (43, 64))
_PIECE = 1 << 20


def _pieces(raw: bytes, width: int):
    """Word lists of successive parts of ``raw``; each but the first starts with the last
    ``width - 1`` words before it."""
    if len(raw) <= _PIECE:
        yield raw.split()
        return
    tail: list[bytes] = []
    start = 0
    while start < len(raw):
        end = start + _PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = tail + raw[start:end].split()
        start = end
        if len(words) >= width or start >= len(raw):
            yield words
            tail = words[len(words) - (width - 1):] if len(words) >= width and width > 1 else []
        else:
            tail = words


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(64, np.int64), 0
    hashed = xxhash.xxh64_digest
    for words in _pieces(raw, width):
        if not words or (total and len(words) < width):
            continue
        line = b" ".join(words)
        if len(words) <= width:
            digests = hashed(line, seed)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:len(words) - width].tolist()]
            digests = b"".join([hashed(line[a:b], seed) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(bits)
    if not total:
        return 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(width: int = 3, seed: int = 42):
    """Column function: text to fingerprint as a signed 64-bit integer."""

    @F.arrow_udf(T.LongType())
    def simhash(text: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t.as_py(), width, seed) for t in text), np.uint64, len(text))
        return pa.array(out.view(np.int64))

    return simhash


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _array(values) -> str:
    """A constant array as SQL text (one parse instead of a call for every element)."""
    return f"array({', '.join(f'{_signed(x)}L' if _signed(x) > -(1 << 63) else 'shiftleft(1L, 63)' for x in values)})"


def _table(rows: list[list[int]]) -> Column:
    """A constant array of arrays; element t of it lists the patterns of block t."""
    return F.expr(f"array({', '.join(map(_array, rows))})")


def _flipped(patterns: Column) -> Column:
    """The left-out value with each pattern of its block flipped, one row each."""
    return F.explode(F.element_at(patterns, F.col("t") + 1))


def _masks() -> list[int]:
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in BLOCKS]


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Distinct fingerprints (column fp) to verified links (a, b) with the same components as
    all pairs within ``max_distance`` (2 or 3)."""
    if max_distance not in (2, 3):
        raise ValueError("max_distance must be 2 or 3")
    outside = [[0, *(1 << b for b in range(64) if not lo <= b < hi)] for lo, hi in BLOCKS]
    variants = fps.select("fp", F.posexplode(_table(outside)).alias("t", "flips"))
    variants = variants.select("t", "fp", F.element_at(F.expr(_array(_masks())), F.col("t") + 1).alias("m"), F.explode("flips").alias("f"))
    variants = variants.select("t", F.col("fp").bitwiseAND(F.bitwise_not("m")).bitwiseXOR(F.col("f")).alias("v"), "fp",
                               F.col("fp").bitwiseAND(F.col("m")).alias("d"))
    # one sort by (t, v, d, fp) serves both windows; frames are running or one row away
    met = Window.partitionBy("t", "v").orderBy("d", "fp")
    alike = Window.partitionBy("t", "v", "d").orderBy("fp")
    near = variants.withColumn("other", F.coalesce(F.lag("fp").over(met), F.lead("fp").over(met)))
    near = near.withColumn("rep", F.first("fp").over(alike)).filter(F.col("other").isNotNull())
    near = written(near.select("t", "v", "d", "fp", "rep"), "met")
    found = near.filter("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    if max_distance == 3:
        found = found.unionByName(_one_bit_apart(near)).unionByName(_three_in_one_block(near))
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).distinct()


def _one_bit_apart(near: DataFrame) -> DataFrame:
    """Smallest members of one variant whose left-out values differ in one bit."""
    reps = near.filter("fp = rep").select("t", "v", "d", "fp")
    ones = _table([[1 << b for b in range(lo, hi)] for lo, hi in BLOCKS])
    ball = reps.select("t", "v", "d", F.col("fp").alias("a"), _flipped(ones).alias("f"))
    ball = ball.select("t", "v", "a", F.col("d").bitwiseXOR(F.col("f")).alias("d"))
    return ball.join(sorted_side(reps.withColumnRenamed("fp", "b")), ["t", "v", "d"]).filter("a < b").select("a", "b")


def _three_in_one_block(near: DataFrame) -> DataFrame:
    """Fingerprints with an equal rest whose left-out values differ in three bits: balls of
    radius one meet balls of radius two. All that share a radius-one variant are linked already,
    so its smallest owner stands for them."""
    block = F.element_at(F.expr(_array(_masks())), F.col("t") + 1)
    same = near.filter(F.col("v") == F.col("fp").bitwiseAND(F.bitwise_not(block))).select("t", "v", "d", "fp").distinct()
    ones = _table([[1 << b for b in range(lo, hi)] for lo, hi in BLOCKS])
    twos = _table([[(1 << i) | (1 << j) for i in range(lo, hi) for j in range(lo, i)] for lo, hi in BLOCKS])
    one, two = (same.select("t", "v", "d", "fp", _flipped(x).alias("f"))
                .select("t", "v", "fp", F.col("d").bitwiseXOR(F.col("f")).alias("d")) for x in (ones, twos))
    one = one.groupBy("t", "v", "d").agg(F.min("fp").alias("a"))
    return two.withColumnRenamed("fp", "b").join(sorted_side(one), ["t", "v", "d"]).filter("a <> b").select("a", "b")


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", max_distance: int = 3) -> DataFrame:
    """``prints`` (id_col, fp, ...) with ``group_fp``, the smallest fingerprint (signed) of the
    component, and ``component_id``, the smallest id in it."""
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "fingerprints")
    found = components(links(nodes.select("fp"), max_distance))
    roots = nodes.join(sorted_side(found.withColumnRenamed("node", "fp")), "fp", "left").withColumn("group_fp", F.coalesce("root", "fp"))
    ids = roots.groupBy("group_fp").agg(F.min("_least").alias("component_id"))
    members = written(roots.join(sorted_side(ids), "group_fp").select("fp", "group_fp", "component_id"), "members")
    return prints.drop("component_id", "group_fp").join(sorted_side(members), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
             max_distance: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest id stays (a
    NULL id counts as larger than any other; of several such rows one stays). The columns are
    those of ``docs``. Rows are told apart by id and a hash of all columns but maps, so no copy of
    the texts is written; rows that agree in both are repeats of one row."""
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    prints = docs.select(F.col(id_col).alias("id"), key.alias("row"), fingerprints(width)(F.col(text_col)).alias("fp"))
    groups = near_duplicates(written(prints, "simhash"), "id", max_distance)
    first = groups.groupBy("group_fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    stay = first.select(F.col("first.id").alias("_stay_id"), F.col("first.row").alias("_row"))
    kept = docs.withColumn("_row", key).join(stay, "_row").filter(F.col(id_col).eqNullSafe(F.col("_stay_id")))
    return kept.dropDuplicates(["_row"]).select(*docs.columns)
