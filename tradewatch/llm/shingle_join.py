"""N-gram Jaccard join of whole documents by a grouped prefix join.

A document is the set of its distinct word shingles. Two documents are linked when their Jaccard similarity is
at least ``num / den``; the result is the connected components of all links.

* Classes: equal sets (exact copies among them) are one class, known by 128 bits of XXH3 over the sorted
  shingle hashes. What follows sees classes only, so thousands of copies cost one row.
* Order: shingles are ordered by a mark of their frequency, then by hash. Marks come from counts of all shingles
  of all documents in ``2 ** BITS`` hash ranges (two bytes each are broadcast, whatever the input). Any order
  gives the same result; this one keeps widespread shingles out of the prefixes: a prefix holds the shingles of
  the emptiest ranges, and a shingle in many documents fills its own.
* Prefix: two similar sets of n and m shingles share one among their first ``n - ceil(t * n) + 1``. Classes with
  the same size and the same prefix are collapsed into one group, the unit of the join on prefix shingles.
  Classes and groups are numbered when their tables are written, so the rows of the joins carry numbers of eight
  bytes, not hashes. Group pairs pass the length filter (sizes within the threshold) and the positional filter (what can still
  be shared after the common shingle).
* Members: the pairs that are left are expanded to classes, filtered by histograms (64 counts of hash ranges:
  the histograms of two sets differ by no more than the sets do) and verified on the shingles themselves,
  from the texts of one document of each class.

Components need no pair whose ends are tied already. So a few joins come first in which each group meets only the first
group of its shingle and size band (a window that reads row by row) and each class the first of its own group: a
number of pairs in proportion to the prefixes. First is the group in which the shingle comes earliest, which has the fewest
shingles of its own and so the best chance; ties differ from shingle to shingle and from round to round (by hash). The components of those links are known before the last
join, which makes all pairs that are left: those between groups of different components. A shingle with very many groups is
dealt to blocks: each pair of blocks is a join key of its own.

Defined results: A-Z is lower-cased, words are runs without ASCII white space. Fewer words than a shingle give one
shingle of all words; texts without words (NULL, empty) have no shingles and are linked with nothing, not even with
each other. Rows with the same id and text are one document; every row comes out. ``component_id`` is the smallest
id reachable; NULL ids are reached but are never smallest, unless a component has no other. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import written
from tradewatch.llm.components import components

BITS = 20
#: hash ranges whose counts one row carries
CHUNK = 4096
#: slots of the filter that keeps texts without a candidate from being shuffled
SLOT_BITS = 23
#: groups of one shingle that meet in one task before they are dealt to blocks
BLOCK = 2048


def shingles(text: str | None, width: int) -> list[bytes]:
    """The word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:len(words) - width].tolist()]
    return [line[a:b] for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]


def hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles."""
    digests = b"".join(map(xxhash.xxh64_digest, shingles(text, width)))
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def _ranges(hs: np.ndarray) -> np.ndarray:
    return (hs >> np.uint64(64 - BITS)).astype(np.int64)


def _sets(width: int):
    """Map function: (id, row) of each document to its size and class, and the task's counts of hash ranges: one row for
    each ``CHUNK`` ranges, two bytes a count (a count beyond them is spread over several rows)."""
    schema = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("chunk", pa.int32()), ("counts", pa.list_(pa.int16()))])

    def run(batches):
        seen, kind = np.zeros(1 << BITS, np.int64), None
        for batch in batches:
            ids, out = batch.column(0), []
            kind = ids.type
            for text in batch.column(2):
                hs = hashes(text.as_py(), width)
                np.add.at(seen, _ranges(hs), 1)
                out.append((len(hs), xxhash.xxh128_digest(hs.tobytes())))
            k = len(out)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, schema.field("counts").type)], schema=pa.schema([pa.field("id", kind), *schema]))
        while kind is not None and seen.any():
            some = np.minimum(seen, 32767).reshape(-1, CHUNK)
            seen -= some.reshape(-1)
            for chunk in np.flatnonzero(some.any(axis=1)):
                counts = pa.array([some[chunk].astype(np.int16)], schema.field("counts").type)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                                                  pa.array([chunk], pa.int32()), counts], schema=pa.schema([pa.field("id", kind), *schema]))

    return run


def _marks(counted: DataFrame) -> np.ndarray:
    """1024 * log2 of the occurrences in each hash range, two bytes each, however large the input is."""
    # whole chunks are exchanged, and their counts added up where they arrive
    chunks = counted.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    counts = chunks.select("chunk", F.posexplode("counts").alias("at", "n")).filter("n > 0").groupBy("chunk", "at").agg(F.sum("n").alias("n"))
    rows = counts.select((F.col("chunk") * CHUNK + F.col("at")).alias("range"), F.round(1024 * F.log2("n")).cast("int").alias("mark")).toArrow()
    marks = np.zeros(1 << BITS, np.uint64)
    marks[rows["range"].to_numpy()] = rows["mark"].to_numpy()
    return marks.astype(np.uint16)


def _ceil(a, b):
    return -(-a // b)


def _prefixes(marks, width: int, num: int, den: int):
    """Column function: text to (n, cls, prefix, gid, histogram); gid is a hash of size and prefix."""
    kind = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("cls", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
                         T.StructField("gid", T.BinaryType()), T.StructField("hist", T.BinaryType())])

    @F.arrow_udf(kind)
    def prefixes(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            hs = hashes(t.as_py(), width)
            n = len(hs)
            # by mark, then by hash (a stable sort: equal upper bits keep the order of the hashes)
            place = marks.value[_ranges(hs)].astype(np.uint64) << np.uint64(48) | hs >> np.uint64(16)
            prefix = hs[np.argsort(place, kind="stable")[:n - _ceil(num * n, den) + 1]] if n else hs
            hist = np.minimum(np.bincount((hs & np.uint64(63)).astype(np.int64), minlength=64), 65535).astype(np.uint16)
            rows.append((n, xxhash.xxh128_digest(hs.tobytes()), prefix.view(np.int64).tolist(),
                         xxhash.xxh128_digest(n.to_bytes(8, "little") + prefix.tobytes()), hist.tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["n", "cls", "prefix", "gid", "hist"])

    return prefixes


def _close(num: int, den: int):
    """Column function: can two sets of these sizes and histograms reach the threshold?"""

    @F.arrow_udf(T.BooleanType())
    def close(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        hx, hy = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, 64).astype(np.int32) for c in (x, y))
        both = n.to_numpy(zero_copy_only=False).astype(np.int64) + m.to_numpy(zero_copy_only=False)
        return pa.array(np.abs(hx - hy).sum(axis=1) <= both - 2 * _ceil(num * both, num + den))

    return close


def _similar(width: int, num: int, den: int):
    """Column function: Jaccard similarity of two texts against the threshold, on the shingles themselves. Pairs come
    sorted by the second text, whose set is kept from one pair to the next."""

    @F.arrow_udf(T.BooleanType())
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out, last, b = [], None, set()
        for s, t in zip(x.to_pylist(), y.to_pylist()):
            if t != last:
                last, b = t, set(shingles(t, width))
            a = set(shingles(s, width))
            both = len(a & b)
            out.append(den * both >= num * (len(a) + len(b) - both))
        return pa.array(out)

    return similar


def _met(spark: SparkSession, rows: DataFrame):
    """Column function: may a text hash be among ``rows`` (column text_hash)? Bits of hash ranges, 2 ** SLOT_BITS at most."""
    slot = F.pmod("text_hash", F.lit(1 << SLOT_BITS))
    words = rows.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(1 << SLOT_BITS - 6, np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little"))

    @F.arrow_udf(T.BooleanType())
    def met(text_hash: pa.Array) -> pa.Array:
        return pa.array(shared.value[text_hash.to_numpy(zero_copy_only=False) % (1 << SLOT_BITS)].astype(bool))

    return met


class _Join:
    """The classes, groups and texts of one run."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.spark, self.width, self.num, self.den = docs.sparkSession, width, num, den
        self.docs = docs  # (id, row, text); row is the XXH64 of the text
        kind = docs.schema["id"].dataType.simpleString()
        out = f"id {kind}, row long, n int, cls binary, chunk int, counts array<smallint>"
        counted = written(docs.mapInArrow(_sets(width), out), "shingle-sets")
        self.rows = counted.filter("cls IS NOT NULL").select("id", "row", "n", "cls")
        marks = self.spark.sparkContext.broadcast(_marks(counted))
        sets = docs.select("id", "row", _prefixes(marks, width, num, den)(F.col("text")).alias("s")).select("id", "row", "s.*").filter("n > 0")
        sets = sets.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"),
                                       F.first(F.struct("n", "prefix", "gid", "hist")).alias("s"))
        # numbers are taken as written: a task that runs again may number anew, its result is committed once
        sets = written(sets.select(F.monotonically_increasing_id().alias("num"), F.col("cls").alias("set"), "first.id", "first.row", "s.*"), "shingle-sets-numbered")
        self.first = sets.select(F.col("num").alias("cls"), "set", "id", "row")
        groups = sets.groupBy("gid").agg(F.first(F.struct("n", "prefix")).alias("g"))
        groups = written(groups.select(F.monotonically_increasing_id().alias("group"), "gid", "g.n", "g.prefix"), "shingle-groups")
        self.classes = written(sets.select(F.col("num").alias("cls"), "n", "gid", "hist").join(groups.select("gid", "group"), "gid")
                               .select("cls", "n", F.col("group").alias("gid"), "hist"), "shingle-classes")
        self.posts = self._posts(groups.select(F.col("group").alias("gid"), "n", "prefix"))

    def _enough(self, x, y):
        """Do an overlap's upper bounds (of either side) allow the threshold for sets of sizes x.n and y.n?"""
        left = F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos"))
        near = (self.den * F.col(f"{x}n") >= self.num * F.col(f"{y}n")) & (self.den * F.col(f"{y}n") >= self.num * F.col(f"{x}n"))
        return near & ((self.num + self.den) * left >= self.num * (F.col(f"{x}n") + F.col(f"{y}n")))

    def _posts(self, groups: DataFrame) -> DataFrame:
        """(token, band, gid, n, pos) of the prefix shingles that several groups have. Sizes of one band are within the
        threshold of each other."""
        groups = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
        band = F.floor(F.log(F.col("n")) / F.log(F.lit(self.den / self.num))).cast("int")
        by_token = Window.partitionBy("token").orderBy("gid")
        rows = groups.withColumn("other", F.coalesce(F.lag("gid").over(by_token), F.lead("gid").over(by_token))).filter("other IS NOT NULL")
        return written(rows.select("token", band.alias("band"), "gid", "n", "pos"), "shingle-posts")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Class pairs (a, b) that reach the threshold."""
        about = self.classes.select("cls", "n", "hist")
        pairs = pairs.join(about.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha")), "a")
        pairs = pairs.join(about.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb")), "b")
        pairs = written(pairs.filter(_close(self.num, self.den)("na", "nb", "ha", "hb")).select("a", "b"), f"{name}-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.first.drop("set"), "cls")
        wanted = written(wanted.withColumnRenamed("row", "text_hash"), f"{name}-wanted")
        texts = self.docs.filter(_met(self.spark, wanted)(F.col("row")))
        same = texts["row"].eqNullSafe(wanted["text_hash"]) & texts["id"].eqNullSafe(wanted["id"])
        texts = written(texts.join(wanted, same).select("cls", "text").dropDuplicates(["cls"]), f"{name}-texts")
        pairs = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
        pairs = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        return written(pairs.filter(_similar(self.width, self.num, self.den)("x", "y")).select("a", "b"), f"{name}-links")

    def _members(self, tied: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes with their group and component so far, and each group's least and greatest component."""
        member = self.classes.select("gid", "cls").join(tied.withColumnRenamed("node", "cls"), "cls", "left")
        member = written(member.select("gid", "cls", F.coalesce("root", "cls").alias("root")), "shingle-members")
        return member, member.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))

    def _to_first(self, seed: int, tied: DataFrame) -> DataFrame:
        """Each class against the first class of its own group and of the first groups of its shingles, unless the
        two are tied already."""
        member, _ = self._members(tied)
        lead = written(member.groupBy("gid").agg(F.min(F.struct("cls", "root")).alias("b")).select("gid", F.col("b.cls").alias("b"), F.col("b.root").alias("rb")), "shingle-leads")
        order = Window.partitionBy("token", "band").orderBy("pos", F.xxhash64("token", "gid", F.lit(seed)), "gid")
        posts = self.posts.withColumn("first", F.first(F.struct("gid", "n", "pos")).over(order))
        posts = posts.select("gid", "n", "pos", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("gid", "n", "pos")))
        met = posts.filter("gid <> first_gid").filter(self._enough("", "first_")).select("gid", F.col("first_gid").alias("other")).distinct()
        other = met.join(lead.withColumnRenamed("gid", "other"), "other").select("gid", "b", "rb")
        pairs = member.join(other.unionByName(lead), "gid").filter("root <> rb").select(F.col("cls").alias("a"), "b")
        return pairs.distinct()

    def _across(self, tied: DataFrame) -> DataFrame:
        """Class pairs of candidate groups whose classes lie in different components so far."""
        member, spread = self._members(tied)
        posts = self.posts.select("token", "gid", "n", "pos").join(spread, "gid")
        per_token = posts.groupBy("token").agg(F.count("*").alias("size"), F.min("lo").alias("tlo"), F.max("hi").alias("thi")).filter("tlo <> thi")
        posts = posts.join(per_token.select("token", F.expr(f"cast(size div {BLOCK} + 1 AS int)").alias("blocks")), "token")
        posts = posts.withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        x = posts.select("*", every.alias("o")).select("token", F.col("own").alias("bx"), F.col("o").alias("by"), "gid", "n", "pos", "lo", "hi").alias("x")
        y = posts.select("*", every.alias("o")).select("token", F.col("o").alias("bx"), F.col("own").alias("by"), "gid", "n", "pos", "lo", "hi").alias("y")
        tied_up = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
                     & (F.col("x.gid") < F.col("y.gid")) & self._enough("x.", "y.") & ~tied_up)
        met = met.select(F.col("x.gid").alias("gx"), F.col("y.gid").alias("gy")).distinct()
        within = spread.filter("lo <> hi").select(F.col("gid").alias("gx"), F.col("gid").alias("gy"))
        sides = [member.select(F.col("gid").alias(f"g{s}"), F.col("cls").alias(c), F.col("root").alias(f"r{s}")) for s, c in (("x", "a"), ("y", "b"))]
        pairs = met.unionByName(within).join(sides[0], "gx").join(sides[1], "gy").filter("rx <> ry AND (gx <> gy OR a < b)")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self, rounds: int) -> DataFrame:
        """(node, root) of the classes that have a link."""
        found, tied = None, self.classes.select(F.col("cls").alias("node"), F.col("cls").alias("root"))
        for step in range(rounds + 1):
            pairs = self._to_first(step, tied) if step < rounds else self._across(tied)
            links = self._verified(pairs, f"shingle-{step}")
            found = links if found is None else found.unionByName(links)
            tied = components(found)
        return tied


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10, rounds: int = 1) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of ``docs``; linked at a similarity of ``num / den``.
    ``rounds`` joins with first groups come before the complete one; any number gives the same result."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    run = _Join(plain, width, num, den)
    tied = run.components(rounds).withColumnRenamed("node", "cls")
    classes = run.first.select("cls", "set", "id").join(tied, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = written(classes.join(least, "root").select(F.col("set").alias("cls"), "component_id"), "shingle-components")
    linked = run.rows.filter("n > 0").join(classes, "cls").select("id", "n", "component_id")
    alone = run.rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


#: Pairs that share a shingle of their prefixes, all verified; components by reachability: for small inputs only.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
f AS (SELECT shingle, count(*) AS c FROM e GROUP BY shingle),
p AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.shingle) AS pos FROM e JOIN f ON e.shingle = f.shingle),
head AS (SELECT doc_id, n, shingle FROM p WHERE pos <= n - (9 * n + 9) // 10 + 1),
q AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM head x JOIN head y ON x.shingle = y.shingle AND x.doc_id < y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n),
links AS (SELECT a, b FROM q JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id
  WHERE 190 * len(list_intersect(x.g, y.g)) >= 90 * (len(x.g) + len(y.g))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, b FROM reach r JOIN sym ON r.other = a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON s.doc_id = r.doc_id
"""
