"""Audit of filter interactions with wide packed counters.

Five filters judge every document; the document's failures are a mask of five bits. What happens to it
under one order of the filters depends on the mask alone: it is removed at the first step whose filter it
fails, counts as redundant at each later step whose filter it fails, and is kept up to its removal. There
are 120 orders of 5 steps, so 600 (order, step) outcomes.

Wide packed counters: every mask (with its two label bits) is mapped to one big integer whose fields hold
all 600 outcomes of the six counts. Documents are counted per (part, mask) first (combined on the map side),
then each part sums count x integer and unpacks the fields once. A field is as wide as the part's total needs,
so no sum carries into the next field. The fields of one part are at most 128 integers, whatever the input.

Filters (words are maximal runs without ASCII white space, case-sensitive): A fewer than 200 words; B fewer
than half of the words distinct; C more than 3 % of the code points in A-Z; D holds any of ``#$%&*|``; E the
text equals that of a smaller document id. For E the texts meet by SHA-256: all rows of a text but those with
its least id fail, so the copies of a hot text are one aggregate and are found by a join on (text, id).

Defined results: NULL texts are empty (fewer than 200 words; equal to other empty and NULL texts); a NULL part
is the empty string. A document without an id has no smaller id and is no one's copy; it has no labels.
Repeated rows count once each; rows with the same id and text do not make each other a copy. If labels repeat
an id, one row that says so is enough. An empty table gives no rows. Texts are judged whole, one at a time.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: the counts that one packed integer holds, each as 600 fields
KINDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_GOOD, _TOXIC = 32, 64

RESULT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
                       *(T.StructField(k, T.LongType()) for k in (*KINDS, "shapley"))])


def failed(text: str | None) -> int:
    """The bits of filters A to D that a text fails (bit 0 is A)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * len(text or "")) << 2
            | (len(raw.translate(None, _MARKS)) < len(raw)) << 3)


@F.arrow_udf(T.IntegerType())
def failures(text: pa.Array) -> pa.Array:
    return pa.array([failed(t.as_py()) for t in text], pa.int32())


def packed(key: int, width: int) -> int:
    """The integer of a key (mask and label bits): field (kind, order, step) holds 0 or 1, ``width`` bits each."""
    mask, good, toxic = key & 31, bool(key & _GOOD), bool(key & _TOXIC)
    out, field = 0, {k: i * len(ORDERS) * len(FILTERS) for i, k in enumerate(KINDS)}
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = mask >> FILTERS.index(letter) & 1
            here = bool(bit) and not gone
            found = {"kept": not gone and not bit, "removed": here, "redundant": bool(bit) and gone,
                     "unique_fails": mask == 1 << FILTERS.index(letter), "good_lost": here and good, "toxic_lost": here and toxic}
            out |= sum(1 << (field[k] + o * len(FILTERS) + s) * width for k in KINDS if found[k])
            gone = gone or here
    return out


def _unpacked(total: int, width: int) -> list[int]:
    low = (1 << width) - 1
    n, size = len(KINDS) * len(ORDERS) * len(FILTERS), width // 8
    raw = total.to_bytes(n * size, "little")
    return [int.from_bytes(raw[i:i + size], "little") & low for i in range(0, n * size, size)]


def audit_part(counts: pa.Table) -> pa.Table:
    """One part's (part, key, n) rows to its 600 rows."""
    keys, ns = counts["key"].to_pylist(), counts["n"].to_pylist()
    width = -(-(sum(ns).bit_length() + 1) // 8) * 8  # whole bytes that hold the part's total
    fields = _unpacked(sum(n * packed(k, width) for k, n in zip(keys, ns)), width)
    steps = len(ORDERS) * len(FILTERS)
    out = {k: fields[i * steps:(i + 1) * steps] for i, k in enumerate(KINDS)}
    letters = "".join(ORDERS)
    share = {x: sum(n for n, y in zip(out["removed"], letters) if x == y) for x in FILTERS}
    out["shapley"] = [share[x] for x in letters]
    part = counts["part"][0].as_py()
    cols = {"part": [part] * steps, "filter_order": [o for o in ORDERS for _ in FILTERS], "step": list(range(1, 6)) * len(ORDERS), **out}
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds)})


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): the failures of all five filters and the number of equal rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), failures(F.col(text_col)).alias("own"))
    rows = rows.groupBy("digest", "id", "part", "own").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("is_first", F.lit(True))
    judged = rows.join(firsts, ["digest", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    return judged.select("id", "part", F.col("own").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"), "n")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per (part, order of the filters, step) with the counts of ``KINDS`` and ``shapley``."""
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = masks(docs, id_col, text_col, part_col).join(said, "id", "left")
    key = F.col("mask") + F.when(F.col("good"), _GOOD).otherwise(0) + F.when(F.col("toxic"), _TOXIC).otherwise(0)
    counts = known.groupBy("part", key.cast("int").alias("key")).agg(F.sum("n").alias("n"))
    return counts.groupBy("part").applyInArrow(audit_part, RESULT)


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
f AS (SELECT doc_id, part, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
  100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) AS C, regexp_matches(d.text, '[#$%&*|]') AS D,
  coalesce(doc_id > first, false) AS E FROM d JOIN firsts ON d.text = firsts.text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, [A, B, C, D, E] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, x.i AS step, o[x.i] AS this, o[1:x.i - 1] AS before FROM orders, x),
j AS (SELECT part, filter_order, step, this, n, good, toxic, fails, fails[this] AS bad, len(list_filter(before, lambda k: fails[k])) > 0 AS gone FROM m, steps),
r AS (SELECT part, filter_order, step, this, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN bad AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND bad AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND bad AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, this))::BIGINT AS shapley FROM r
"""
