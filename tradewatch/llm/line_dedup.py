"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. A line is removed if an earlier line (order: document id, hash of the
text, line number) has a Jaccard similarity of at least ``num / den`` with it. Equal sets are one class: its first
line stands for it, the later ones go at once; the join sees classes only.

The join is a prefix join. Words are ordered by rarity, and two similar sets must share a word among
their first ``n - ceil(t * n) + 1``. Rows (word, position, size, class, bitmap) are joined on the
word under the length filter, the positional filter (words left after the shared one) and a bitmap
filter (the parity bitmaps of two sets differ in at most as many bits as the sets do in words). Long sets
also have the half of a bitmap of 128 bits; the other half is what the one of 64 bits differs from it in.
All joins are semi joins: whether a partner exists is asked, pairs are never made. The first keeps
classes with some partner that the filters cannot rule out. The second has their prefixes and keeps them at the
words where they meet a partner first: two similar sets pass all filters at the first word that their
prefixes share, so they need to meet only there. What they share is at most the words common to both
prefixes and the rest of the set whose prefix ends first. Only the lines of classes that are left are read again, and
the third verifies the Jaccard similarity with earlier lines. Rows of the first two carry 31 bits of a word:
equal bits of different words add candidates, which the last join, on whole codes, rules out.

Classes and lines are found again by bitmaps of the hashes of their keys, which are broadcast, so texts are
not shuffled. What passes a bitmap by chance is dropped by the join on the key itself.

Rarity: occurrences are counted in ``2 ** BITS`` hash ranges of the words over all documents; the
table is a constant of that many bytes in the plan. Any order of words gives the same result; the
counts decide how few partners a shared word has. Words are compared by 56 bits of XXH64.

Work at scale: the word counts are combined on the map side into at most ``2 ** BITS`` rows; a line
that occurs everywhere is one class; a word that is everywhere is last in the order and reaches
the prefix of very short lines alone. The adaptive skew join splits what is left.

Defined results: NULL texts have no lines to remove; lines without words stay. Rows with the
same id and the same text are one document, and none of them is a copy of the others. Rows that share
an id but not the text are documents of their own, in the order of the XXH64 of their texts. NULL ids
come last, and every row without an id is a document of its own, equal texts included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewatch.llm.common import written

BITS = 18
#: bits of the largest bitmap, 2 ** 28 (32 MB): with many more keys more rows pass by chance, and are shuffled
MOST_SLOTS = 28
#: sets of so many words have a bitmap of 128 bits: parities of 64 bits say little of more than about 140 words
LONG = 96
_SPACES = "[\\x20\\x09-\\x0D]+"
_TABS = "\t\x0b\x0c\r"  # the line feed ends a line
_LOW56 = (1 << 56) - 1


def _has(text: Column, parts) -> Column:
    """Whether one of ``parts`` is in the text. Bytes are compared, which takes less time than a pattern."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])


def _odd(line: Column) -> Column:
    """Whether a line is other than words with one space in between."""
    return _has(line, [*_TABS, "  "]) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))


def _words(line: Column) -> Column:
    """Words of a line that has some. Most lines have one space between words, which needs no pattern."""
    return F.when(_odd(line), F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _SPACES)).otherwise(F.split(line, " "))


def rarity(docs: DataFrame, text_col: str) -> str:
    """One character per hash range of words: 4 * log2 of its occurrences, rounded (32 added)."""
    text = F.col(text_col)
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    w = docs.select(F.explode(F.when(_has(text, _TABS), F.split(text, _SPACES)).otherwise(plain)).alias("w"))
    counts = w.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << BITS) - 1)).alias("range")).count()
    marks = counts.select("range", F.chr(F.least(F.round(4 * F.log2(F.col("count"))), F.lit(90)).cast("int") + 32).alias("mark"))
    every = docs.sparkSession.range(1 << BITS).select(F.col("id").alias("range")).join(marks, "range", "left")
    # at most 2 ** BITS rows, whatever the input; rows of 4096 ranges first, then one text
    some = every.groupBy(F.floor(F.col("range") / 4096).alias("part")).agg(F.sort_array(F.collect_list(
        F.struct("range", F.coalesce("mark", F.lit(" ")).alias("mark")))).alias("marks"))
    rows = some.select("part", F.array_join(F.col("marks.mark"), "").alias("marks")).orderBy("part").collect()
    return "".join(r["marks"] for r in rows)


def _codes(line: Column, marks: str) -> Column:
    """Distinct words as numbers in order of rarity: the mark of the hash range above 56 hash bits."""
    table = F.split(F.lit(",".join(str(ord(m)) for m in marks)), ",").cast("array<bigint>")  # a constant of the plan
    hashes = F.transform(_words(line), lambda w: F.xxhash64(w))
    mark = lambda h: F.get(table, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    codes = F.transform(hashes, lambda h: F.shiftleft(mark(h), 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW56))))
    return F.sort_array(F.array_distinct(codes))


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _hash (of the text) and _copy, which with the id are the key of a document. Rows
    without an id are written, so that their numbers (_copy, else 0) stay the same."""
    known = docs.filter(F.col(id_col).isNotNull()).withColumn("_copy", F.lit(0).cast("long"))
    unknown = written(docs.filter(F.col(id_col).isNull()).withColumn("_copy", F.monotonically_increasing_id()), "line-no-ids")
    return known.unionByName(unknown).withColumn("_hash", F.xxhash64(text_col))


def _with_removed(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``told_apart`` with ``removed`` (NULL if there is nothing to remove), without the key."""
    gone = gone.select(F.col(id_col).alias("_id"), F.col("_hash").alias("_h"), F.col("_copy").alias("_c"), "removed")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & (F.col("_copy") == F.col("_c"))
    return docs.join(gone, same, "left").drop("_id", "_h", "_c", "_hash", "_copy")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, line): place orders lines by document (id as it is, NULL last; hash; copy) and line number."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col("_hash").alias("hash"), F.col("_copy").alias("copy"),
                      F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return out.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "copy", "line_no").alias("place"), "line")


def _sets(lines: DataFrame, marks: str) -> DataFrame:
    """(place, codes, n, cls) of the lines that have words."""
    some = F.when(_odd(F.col("line")), F.col("line").rlike("[^\\x20\\x09-\\x0D]")).otherwise(F.col("line") != "")
    out = lines.filter(some).select("place", _codes(F.col("line"), marks).alias("codes"))
    return out.select("place", "codes", F.size("codes").alias("n"), F.xxhash64("codes").alias("cls"))


def _slot(key: str, slots: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(slots - 1))


def key_bitmap(keys: DataFrame, key: str, per_row: int) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of the slots that ``key`` has in ``keys``, 32768 to a bucket, and the number of
    slots, ``per_row`` or more for each row."""
    slots = 1 << min(MOST_SLOTS, max(15, (per_row * keys.count()).bit_length()))
    taken = keys.select((_slot(key, slots) + 1).alias("slot"))  # both functions count from 1
    return taken.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")), slots


def _marked(rows: DataFrame, key: str, keys: DataFrame, per_row: int) -> DataFrame:
    """Every row whose ``key`` is in ``keys``, and few others."""
    bitmap, slots = key_bitmap(keys, key, per_row)
    at = rows.withColumn("slot", _slot(key, slots)).withColumn("bucket", F.shiftright("slot", 15) + 1)
    byte = F.substring("bitmap", F.shiftright(F.col("slot").bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), F.col("slot").bitwiseAND(F.lit(7)).cast("int"))
    return at.join(F.broadcast(bitmap), "bucket").filter(hit == 1).select(*rows.columns)


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """Rows of ``told_apart`` to (place, removed): every line with words, and whether an earlier line is similar."""
    marks = rarity(docs, text_col)
    lines = _lines(docs, id_col, text_col)
    prefix = F.slice("codes", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int") + 1)
    prefix = F.transform(prefix, lambda c: c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    bitmap = F.expr("aggregate(codes, 0L, (b, c) -> b ^ shiftleft(1L, cast(c & 63 AS int)))")
    half = F.expr(f"CASE WHEN n >= {LONG} THEN aggregate(codes, 0L, (b, c) -> b ^ shiftleft(shiftright(c, 6) & 1L, cast(c & 63 AS int))) ELSE 0L END")
    sets = written(_sets(lines, marks).select("place", "cls", "n", bitmap.alias("bits"), half.alias("half"), prefix.alias("prefix")), "line-sets")
    firsts = written(sets.groupBy("cls").agg(F.min(F.struct("place", "n", "bits", "half", "prefix")).alias("f")).select("cls", "f.*"), "line-classes")

    # an overlap of o is enough if o / (n + m - o) >= num / den, that is (num + den) * o >= num * (n + m)
    enough = lambda o: (num + den) * o >= num * (F.col("x.n") + F.col("y.n"))
    close_size = (den * F.col("x.n") >= num * F.col("y.n")) & (den * F.col("y.n") >= num * F.col("x.n"))
    # for the first shared word in the order nothing before it is shared; one such row is enough
    left_over = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    bits, half = F.col("x.bits").bitwiseXOR(F.col("y.bits")), F.col("x.half").bitwiseXOR(F.col("y.half"))
    at_most = lambda apart: F.shiftright(F.col("x.n") + F.col("y.n") - apart, 1)
    both_long = (F.col("x.n") >= LONG) & (F.col("y.n") >= LONG)
    even = enough(at_most(F.bit_count(bits))) & (~both_long | enough(at_most(F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half)))))
    same_word = (F.col("x.word") == F.col("y.word")) & (F.col("x.cls") != F.col("y.cls")) & close_size
    rows = firsts.select("cls", "n", "bits", "half", F.posexplode("prefix").alias("pos", "word"))
    possible = rows.alias("x").join(rows.alias("y"), same_word & enough(left_over) & even, "left_semi")
    possible = written(possible.select("cls", "word"), "line-candidates")  # partners meet at one of these words

    # in the next joins both sides have the same columns, so that one exchange serves both
    heads = _marked(firsts, "cls", possible, 8).select("cls", "n", "bits", "half", F.array_distinct("prefix").alias("prefix")).join(possible, "cls")
    common = F.array_intersect("x.prefix", "y.prefix")  # in the order of x; equal bits of two words count in the rest
    rest = F.greatest(F.col("x.n") - F.size("x.prefix"), F.col("y.n") - F.size("y.prefix"))
    meet = heads.alias("x").join(heads.alias("y"), same_word & even & (F.get(common, F.lit(0)) == F.col("x.word")) & enough(F.size(common) + rest), "left_semi")
    meet = written(meet.select("cls", "word").distinct(), "line-meetings")

    live = _marked(firsts.select("cls", "place"), "cls", meet, 8).join(meet.select("cls").distinct(), "cls", "left_semi")
    live = written(live.select("cls", F.col("place").alias("own")), "line-live")
    words = _sets(_marked(lines, "place", live.select(F.col("own").alias("place")), 64), marks)
    words = written(words.select("cls", "place", "n", "codes"), "line-words")
    found = words.join(live, "cls").filter(F.col("place") == F.col("own")).drop("own").join(meet, "cls")
    shared = F.size(F.array_intersect("x.codes", "y.codes"))
    later = found.alias("x").join(found.alias("y"), same_word & (F.col("y.place") < F.col("x.place")) & enough(shared), "left_semi")
    later = later.select("cls").distinct().withColumn("similar", F.lit(True))
    judged = sets.select("place", "cls").join(firsts.select("cls", F.col("place").alias("first")), "cls").join(later, "cls", "left")
    return judged.select("place", (F.coalesce("similar", F.lit(False)) | (F.col("first") < F.col("place"))).alias("removed"))


def _removed(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    gone = line_matches(docs, id_col, text_col, **options).filter("removed")
    key = F.col("place.doc_id").alias(id_col), F.col("place.hash").alias("_hash"), F.col("place.copy").alias("_copy")
    return gone.groupBy(*key).agg(F.sort_array(F.collect_set("place.line_no")).alias("removed"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, _hash, _copy, removed): the numbers of the lines to remove (from 0, ascending), for documents that have some."""
    return _removed(told_apart(docs.select(id_col, text_col), id_col, text_col), id_col, text_col, **options)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed lines taken out of the text, and their numbers in ``removed``."""
    docs = told_apart(docs.drop("removed"), id_col, text_col)
    out = _with_removed(docs, _removed(docs, id_col, text_col, **options), id_col)
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i))
    return out.withColumn(text_col, F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id_col, n_lines, n_removed and ``removed``, the line numbers as text."""
    docs = told_apart(docs.select(id_col, text_col), id_col, text_col)
    n = F.size(F.split(F.col(text_col), "\n", -1))
    sizes = docs.select(id_col, "_hash", "_copy", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    out = _with_removed(sizes, _removed(docs, id_col, text_col, **options), id_col)
    return out.select(id_col, "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


#: Brute force over all pairs: for small inputs only.
SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS ws FROM l),
w AS (SELECT doc_id, line_no, len(ws) AS n, list_sort(ws) AS ws FROM s WHERE len(ws) > 0),
c AS (SELECT ws, n, min((doc_id, line_no)) AS first, row_number() OVER () AS cls FROM w GROUP BY ALL),
e AS (SELECT cls, first, n, unnest(ws) AS word FROM c),
f AS (SELECT word, count(*) AS c FROM e GROUP BY word),
p AS (SELECT e.*, row_number() OVER (PARTITION BY cls ORDER BY f.c, e.word) AS pos FROM e JOIN f USING (word)),
q AS (SELECT DISTINCT x.cls AS cx, y.cls AS cy FROM p x JOIN p y ON x.word = y.word AND y.first < x.first
  WHERE x.pos <= x.n - ceil(x.n * 4 / 5) + 1 AND y.pos <= y.n - ceil(y.n * 4 / 5) + 1),
later AS (SELECT DISTINCT cx FROM q JOIN c x ON cx = x.cls JOIN c y ON cy = y.cls WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)),
gone AS (SELECT w.doc_id, w.line_no FROM w JOIN c ON w.ws = c.ws LEFT JOIN later ON cls = cx WHERE cx IS NOT NULL OR first < (w.doc_id, w.line_no)),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
