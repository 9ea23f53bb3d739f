"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also
starts anywhere else.

Sorting every suffix of a corpus would write several times its size. Only suffixes that can repeat
are sorted, and nothing that repeats is left out:

1. Tiles. Every window of ``length`` bytes has one anchor, the place of its least k-gram hash
   among its first ``WIDTH`` places; that is a function of the window's bytes, so equal windows have
   equal anchors. Neighbouring windows with one anchor form a tile. All of them hold the core, the
   ``length - WIDTH`` bytes from the anchor on: a core that occurs once has no repeated window, equal
   tiles repeat in all windows. One row of two hashes per tile is shuffled.
2. Suffix merge. What is left are different tiles around one core, one copy of each. Their
   suffixes from the anchor on are sorted in the tasks that read them, dealt out by sampled
   splitters, exchanged as front-coded runs and merged by a loser tree that re-compares no known
   prefix. The neighbours in that order give the longest match of each suffix, which rules out the
   windows that reach beyond it.
3. Exact check of the windows left: equal windows have equal core and offset, so their hashes are
   compared within (core, range of offsets), and a window repeats if two tiles have it.

Work at scale: texts are shuffled twice (to cut the tiles, to cut the result), everything else is
hashes. A passage in a third of all documents is one tile per distinct surrounding; its suffixes
are dealt out by up to ``length`` bytes, and a suffix that fills ranges of its own by tile (whatever its
neighbours there, its windows are allowed or more). The number of ranges follows the number of tiles.
Windows are dealt by core and offset, those of a core that fills a range by their hashes, where equal
ones of one range are found at once and one of them goes on. Equal windows and cores are taken from
equal 64-bit hashes.

Defined results: NULL texts count as empty. Texts shorter than ``length`` are kept whole.
Repeated rows repeat each other and lose all windows; rows are told apart by id and text hash, and
each row comes out once. Very long texts are cut into tiles piece by piece.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import written
from tradewatch.llm.lcp_merge import decode_run, front_code, merge

WIDTH = 256
_GRAM = 8
_PIECE = 1 << 20
_OFFSETS = 16
_TILES = 8192  # of one range
_KNOWN = np.uint64(1 << 63)  # in a window's reference: found to repeat already

_PLACES = T.ArrayType(T.StructType([T.StructField("core", T.LongType()), T.StructField("tile", T.LongType()), T.StructField("places", T.ArrayType(T.LongType()))]))
_PLACE_ARROW = pa.list_(pa.struct([("core", pa.int64()), ("tile", pa.int64()), ("places", pa.list_(pa.int64()))]))


def tiles(raw: bytes, length: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of every tile."""
    firsts, lasts, anchors = [], [], []
    for start in range(0, max(0, len(raw) - length + 1), _PIECE):
        piece = np.frombuffer(raw, np.uint8, min(len(raw) - start, _PIECE + length - 1), start)
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece, _GRAM)).view("<u8").ravel()
        ranked = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) << np.uint64(32)
        ranked |= np.uint64(0xFFFFFFFF) - np.arange(len(ranked), dtype=np.uint64)  # of equal hashes the last
        reach = 1
        while reach < width:
            ranked = np.minimum(ranked[:-reach], ranked[reach:])
            reach *= 2
        anchor = (np.uint64(0xFFFFFFFF) - (ranked[:len(piece) - length + 1] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        firsts.append(cut + start)
        lasts.append(np.append(cut[1:], len(anchor)) - 1 + start)
        anchors.append(anchor[cut] + start)
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


def _hash(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _tile_rows(length: int):
    """Column function: text to its different tiles and their places (a place packs first window,
    extent and anchor). A text that repeats itself has few different tiles."""

    @F.arrow_udf(_PLACES)
    def rows(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            raw, found = _raw(t), {}
            for lo, hi, a in zip(*(x.tolist() for x in tiles(raw, length))):
                key = _hash(raw[a:a + length - WIDTH]), _hash(raw[lo:hi + length])
                found.setdefault(key, []).append(lo << 20 | (hi - lo) << 10 | (a - lo))
            out.append([{"core": c, "tile": t, "places": p} for (c, t), p in found.items()])
        return pa.array(out, _PLACE_ARROW)

    return rows


_TILE_TEXTS = T.ArrayType(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("data", T.BinaryType())]))


def _tile_texts(length: int):
    """Column function: (text, places) to the bytes of each tile and of its part before the anchor."""

    @F.arrow_udf(_TILE_TEXTS)
    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, ps in zip(text, places.to_pylist()):
            raw = _raw(t)
            out.append([{"left": p & 1023, "data": raw[p >> 20:(p >> 20) + (p >> 10 & 1023) + length]} for p in ps])
        return pa.array(out, pa.list_(pa.struct([("left", pa.int32()), ("data", pa.binary())])))

    return cut


_RUNS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("suffixes", T.BinaryType()), T.StructField("lefts", T.ArrayType(T.BinaryType())),
                      T.StructField("core", T.ArrayType(T.LongType())), T.StructField("tile", T.ArrayType(T.LongType()))])
_RUNS_ARROW = pa.schema([("part", pa.int32()), ("suffixes", pa.binary()), ("lefts", pa.list_(pa.binary())), ("core", pa.list_(pa.int64())), ("tile", pa.list_(pa.int64()))])
_WINDOWS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("core", T.ArrayType(T.LongType())), T.StructField("tile", T.ArrayType(T.LongType())),
                         T.StructField("refs", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
_WINDOWS_ARROW = pa.schema([("part", pa.int32()), ("core", pa.list_(pa.int64())), ("tile", pa.list_(pa.int64())), ("refs", pa.binary()), ("hashes", pa.binary())])
_FOUND = T.StructType([T.StructField("core", T.LongType()), T.StructField("tile", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])


def _sorted_runs(bounds: list[tuple[bytes, int]]):
    """Batches of tiles (core, tile, left, data) to sorted front-coded runs, one per range of suffixes;
    a bound with a share above 1 is a range of one suffix, dealt by tile to so many parts."""

    def ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
        at = 0
        for bound, share in bounds:
            lo = bisect.bisect_left(rows, bound, at, key=lambda r: r[0])
            yield rows[at:lo]
            at = lo
            if share > 1:
                at = bisect.bisect_right(rows, bound, lo, key=lambda r: r[0])
                yield from ([r for r in rows[lo:at] if r[3] % share == k] for k in range(share))
        yield rows[at:]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(((d[k:], d[:k], c, t) for c, t, k, d in zip(*(batch.column(i).to_pylist() for i in range(4)))), key=lambda r: r[0])
            out = []
            for part, some in enumerate(ranges(rows)):
                if some:
                    suffixes, lefts, core, tile = zip(*some)
                    out.append({"part": part, "suffixes": front_code(suffixes), "lefts": lefts, "core": core, "tile": tile})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RUNS_ARROW)

    return runs


def _dealt_by_hash(found: list[tuple[int, int, np.ndarray]], parts: int) -> Iterator[dict]:
    """Windows (core, tile, hashes of the windows 0, 1, ...) of one range to rows of _WINDOWS. Of equal
    windows one goes where its hash says; the others need no more comparison and go by tile."""
    if not found:
        return
    core, tile = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
    hashes = np.concatenate([f[2] for f in found])
    owner = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
    window = np.concatenate([np.arange(len(f[2]), dtype=np.uint64) for f in found])
    _, first, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    to = (tile % parts)[owner]
    to[first] = (hashes[first] % np.uint64(parts)).astype(np.int64)
    known = np.where(count[back] > 1, _KNOWN, np.uint64(0))
    order = np.argsort(to, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        who, ref = np.unique(owner[at], return_inverse=True)
        yield {"part": int(to[at[0]]), "core": core[who].tolist(), "tile": tile[who].tolist(),
               "refs": (ref.astype(np.uint64) << np.uint64(10) | window[at] | known[at]).astype("<u8").tobytes(), "hashes": hashes[at].astype("<u8").tobytes()}


def _matched_windows(length: int, parts: int, hot: frozenset[int]):
    """Merge the runs of one range; of every tile keep the windows that its longest match allows."""

    def windows(key: tuple, runs: pa.Table) -> pa.Table:
        rows = runs.to_pylist()
        out: list[tuple[list[int], list[int], list[np.ndarray], list[int]]] = [([], [], [], []) for _ in range(parts)]
        taken, hot_out = [0] * len(rows), []

        def emit(item: tuple[bytes, int, int], longest: int) -> None:
            suffix, r, i = item
            left, core, tile = rows[r]["lefts"][i], rows[r]["core"][i], rows[r]["tile"][i]
            data, k = left + suffix, len(left)
            # window j has the offset k - j to the anchor and needs length - (k - j) bytes from there
            last = min(len(data) - length, longest - length + k)
            if core in hot:
                if last >= 0:
                    hot_out.append((core, tile, np.array([xxhash.xxh64_intdigest(data[j:j + length], core & 0xFFFFFFFF) for j in range(last + 1)], np.uint64)))
                return
            for block in range((k - last) // _OFFSETS, k // _OFFSETS + 1) if last >= 0 else ():
                js = range(max(0, k - block * _OFFSETS - _OFFSETS + 1), min(last, k - block * _OFFSETS) + 1)
                if len(js):
                    cores, ids, refs, hashes = out[xxhash.xxh32_intdigest(core.to_bytes(8, "little", signed=True), block) % parts]
                    refs.append(np.arange(js.start, js.stop, dtype=np.uint64) | np.uint64(len(ids) << 10))
                    hashes.extend([xxhash.xxh64_intdigest(data[j:j + length], core & 0xFFFFFFFF) for j in js])
                    cores.append(core)
                    ids.append(tile)

        before = None  # (item, prefix shared with the one before it)
        for suffix, shared, r in merge([decode_run(x["suffixes"]) for x in rows]):
            if before:
                emit(before[0], max(before[1], shared))
            # the neighbour of the first and of the last one may be in another range: allow all
            before = ((suffix, r, taken[r]), shared if before else length)
            taken[r] += 1
        if before:
            emit(before[0], length)
        return pa.Table.from_pylist([{"part": p, "core": c, "tile": i, "refs": np.concatenate(refs).astype("<u8").tobytes(),
                                      "hashes": np.array(h, "<u8").tobytes()} for p, (c, i, refs, h) in enumerate(out) if h]
                                    + list(_dealt_by_hash(hot_out, parts)), schema=_WINDOWS_ARROW)

    return windows


def _repeated(key: tuple, lists: pa.Table) -> pa.Table:
    """Runs of windows (a to b) of a tile that some other tile has as well."""
    rows = lists.to_pylist()
    hashes = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows])
    refs = [np.frombuffer(r["refs"], "<u8") for r in rows]
    base = np.cumsum([0] + [len(r["tile"]) for r in rows])
    owner = np.concatenate([((x & ~_KNOWN) >> np.uint64(10)).astype(np.int64) + b for x, b in zip(refs, base)])
    window = np.concatenate([(x & np.uint64(1023)).astype(np.int64) for x in refs])
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = (count[back] > 1) | (np.concatenate(refs) >= _KNOWN)
    place = np.sort(owner[hit] << 10 | window[hit])
    start = np.flatnonzero(np.append(True, np.diff(place) != 1)) if len(place) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(place)) - 1 if len(place) else start
    core, tile = (np.array([x for r in rows for x in r[c]], np.int64) for c in ("core", "tile"))
    who = place[start] >> 10
    return pa.table({"core": core[who], "tile": tile[who], "a": (place[start] & 1023).astype(np.int32), "b": (place[end] & 1023).astype(np.int32)})


def _live_tiles(docs: DataFrame, length: int) -> DataFrame:
    """(id, hash, places, whole, emit, core, tile): tiles whose core repeats. ``whole``: the tile repeats in
    all windows; ``emit``: the first copy of a tile whose core has other tiles too."""
    every = docs.select("id", "hash", F.explode(_tile_rows(length)(F.col("text"))).alias("t")).select("id", "hash", "t.*")
    around, same = Window.partitionBy("core"), Window.partitionBy("core", "tile")
    copies = F.size("places")
    every = every.withColumn("n", F.sum(copies).over(same)).withColumn("first", F.row_number().over(same.orderBy("id", "hash")) == 1)
    every = every.withColumn("around", F.sum(copies).over(around)).filter("around > 1")
    whole, emit = F.col("n") > 1, (F.col("n") < F.col("around")) & F.col("first")
    return every.select("id", "hash", "places", whole.alias("whole"), emit.alias("emit"), F.when(emit, F.col("core")).alias("core"), F.when(emit, F.col("tile")).alias("tile"))


def _sample(suffix_rows: DataFrame, n: int, parts: int, length: int, sample_per_part: int = 40) -> list[bytes]:
    """Sorted sample of about ``sample_per_part`` suffixes for each part."""
    if parts < 2 or not n:
        return []
    s = suffix_rows.sample(min(1.0, sample_per_part * parts / n), seed=11).select(F.expr(f"substring(data, left + 1, {length})").alias("s"))
    return sorted(bytes(r["s"]) for r in s.toLocalIterator())


def _bounds(found: list[bytes], parts: int) -> list[tuple[bytes, int]]:
    """Range bounds of the suffix exchange, each with the number of ranges that it alone would fill."""
    return sorted(Counter(found[i * len(found) // parts] for i in range(1, parts)).items()) if found else []


def _hot_cores(found: list[bytes], parts: int, length: int) -> frozenset[int]:
    """Cores that fill a range or more."""
    count = Counter(s[:length - WIDTH] for s in found)
    return frozenset(_hash(c) for c, k in count.items() if k * parts >= len(found))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(id, hash, text) to (id, hash, starts): runs (a, b) of window starts that repeat."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    live = written(_live_tiles(docs, length), "tiles")
    lists = live.filter("emit").groupBy("id", "hash").agg(F.collect_list(F.struct(F.element_at("places", 1).alias("place"), "core", "tile")).alias("t"))
    cut = docs.join(lists, docs["id"].eqNullSafe(lists["id"]) & (docs["hash"] == lists["hash"])).select(
        F.explode(F.arrays_zip("t", _tile_texts(length)(docs["text"], F.col("t.place")).alias("x"))).alias("z"))
    cut = cut.select("z.t.core", "z.t.tile", "z.x.left", "z.x.data").dropDuplicates(["core", "tile"])
    cut = written(cut, "tile-texts")
    n = cut.count()
    parts = max(parts, -(-n // _TILES))
    found = _sample(cut, n, parts, length)
    runs = cut.mapInArrow(_sorted_runs(_bounds(found, parts)), _RUNS)
    lists = runs.groupBy("part").applyInArrow(_matched_windows(length, parts, _hot_cores(found, parts, length)), _WINDOWS)
    found = lists.groupBy("part").applyInArrow(_repeated, _FOUND)
    lo = F.shiftright("place", 20)
    some = live.filter("emit AND NOT whole").withColumn("place", F.element_at("places", 1)).join(found, ["core", "tile"]).select("id", "hash", (lo + F.col("a")).alias("a"), (lo + F.col("b")).alias("b"))
    all_of = live.filter("whole").withColumn("place", F.explode("places")).select("id", "hash", lo.alias("a"), (lo + F.shiftright("place", 10).bitwiseAND(F.lit(1023))).alias("b"))
    return some.unionByName(all_of).groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b")).alias("starts"))


_SPAN_LIST = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])


def _cut_out(length: int, with_bytes: bool):
    @F.arrow_udf(_SPAN_LIST)
    def cut(text: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text, starts.to_pylist()):
            raw, spans = _raw(t), []
            for a, b in sorted((s["a"], s["b"] + length) for s in found or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                        "spans": spans, "kept": kept if with_bytes else None})
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                                        ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]))

    return cut


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_bytes: bool = False) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte
    ranges) and, on request, kept (the remaining bytes)."""
    if length < WIDTH + _GRAM:
        raise ValueError(f"length must be at least {WIDTH + _GRAM}: a window holds its {WIDTH} first places and their {_GRAM}-grams")
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    starts = repeated_spans(keyed, length).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "starts")
    out = keyed.join(starts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return out.select(F.col("id").alias(id_col), _cut_out(length, with_bytes)(F.col("text"), F.col("starts")).alias("c")).select(id_col, "c.*")
