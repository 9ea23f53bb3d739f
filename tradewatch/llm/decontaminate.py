"""Benchmark decontamination with suffix arrays over the training text.

The training documents are taken in shards (a few MB of text each, whole documents). A shard's
word-level suffix array is built where its batch is read and every test suffix is looked up in
it by binary search; the ranges found give the places where windows of the test items occur
verbatim, and joining them along diagonals gives the longest matches with their locations. A
document whose words lie in such places to a sufficient share is contaminated.

Work at scale: no shuffle and no order between shards, each document is read once. Words that
occur in no test item are numbered 0 and end every match, so only places followed by enough
test words enter the suffix array (nothing that could match is left out).

The test items are broadcast in blocks of at most ``block_bytes`` of text, read one after the
other from the item table; one more block is one more pass, so a large benchmark needs time,
not memory.

Defined results: a NULL or empty text has no words, no hits, and is contaminated only by the
rule's own arithmetic (never, as ``n_hit`` is 0). Items without words are ignored; a NULL item id
counts as the empty string. Items with equal text count each. Repeated documents are judged each
on its own. Columns of the input that share a name with an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words: ASCII letters (lower-cased) and digits and everything beyond ASCII; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20
_SHARD = 4 << 20

_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()),
                       T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
                        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(_MATCH))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _numbered(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a text, in pieces so that no list of all its words is held."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    parts, start = [], 0
    while start < len(raw):
        end = len(raw) if len(raw) - start <= _PIECE else raw.find(b" ", start + _PIECE)
        end = len(raw) if end < 0 else end
        piece = raw[start:end].split()
        parts.append(np.fromiter((vocabulary.get(w, 0) for w in piece), np.uint32, len(piece)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class TestItems:
    """One block of test items: numbered words, distinct windows, and where each occurs."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not numbers:
                continue
            for at in range(max(1, len(numbers) - window + 1)):
                places.setdefault(tuple(numbers[at:at + window]), []).append((len(self.ids), at))
            self.ids.append(item_id)
        self.windows = sorted(places)
        self.places = [places[w] for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if self.windows else window
        low, high = np.zeros((len(self.windows), window), ">u4"), np.full((len(self.windows), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(self.windows):
            low[i, :len(w)] = high[i, :len(w)] = w
        self.low, self.high = _keys(low), _keys(high)


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, whose order is that of the rows."""
    return np.ascontiguousarray(matrix, ">u4").view(f"S{4 * matrix.shape[1]}").ravel()


def find_windows(numbers: np.ndarray, test: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of test windows in a shard (word numbers, 0 between documents):
    (place, window) pairs, from the suffix array of the places where a match can start."""
    none = np.zeros(0, np.int64)
    if not test.windows or not len(numbers):
        return none, none
    stops = np.append(np.flatnonzero(numbers == 0), len(numbers))
    run = stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))
    starts = np.flatnonzero(run >= test.shortest)
    if not len(starts):
        return none, none
    padded = np.append(numbers, np.zeros(test.window, np.uint32))
    offsets = np.arange(test.window)
    suffixes = np.where(offsets < run[starts][:, None], padded[starts[:, None] + offsets], 0)
    keys = _keys(suffixes)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.searchsorted(ordered, test.low, "left")
    count = np.searchsorted(ordered, test.high, "right") - first
    window = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return starts[order[rank]], window


def _spans(places: np.ndarray, lengths: np.ndarray, known) -> list[dict]:
    """Maximal runs of covered words from window places, lengths and spans known before."""
    first = np.append(places, [s["first"] for s in known]).astype(np.int64)
    last = np.append(places + lengths, [s["last"] + 1 for s in known]).astype(np.int64)
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(first[cut], last[np.append(cut[1:], len(first)) - 1])]


def _longest(places: np.ndarray, window: np.ndarray, test: TestItems) -> list[dict]:
    """Windows of one document joined along diagonals of the same item."""
    rows = sorted((item, place - at, place, int(test.lengths[w]))
                  for place, w in zip(places.tolist(), window.tolist()) for item, at in test.places[w])
    out: list[dict] = []
    before = None
    for item, diagonal, place, length in rows:
        if before and before[:2] == (item, diagonal) and place <= before[2] + 1:
            out[-1]["n_words"] = place + length - out[-1]["doc_word"]
        else:
            out.append({"item_id": test.ids[item], "item_word": place - diagonal, "doc_word": place, "n_words": length})
        before = (item, diagonal, place)
    return out


def _search(test_of, with_matches: bool):
    """Column function (text, result so far) to the result with one more block of items."""

    def shard(texts: list[str | None], known: list[dict | None], test: TestItems) -> Iterator[dict]:
        numbered = [_numbered(t, test.vocabulary) for t in texts]
        gap = np.zeros(1, np.uint32)
        begins = np.cumsum([0] + [len(n) + 1 for n in numbered])
        place, window = find_windows(np.concatenate([x for n in numbered for x in (n, gap)]) if numbered else gap, test)
        owner = np.searchsorted(begins, place, "right") - 1
        order = np.argsort(owner, kind="stable")
        place, window, owner = place[order], window[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, n in enumerate(numbered):
            at, w = place[cuts[i]:cuts[i + 1]] - begins[i], window[cuts[i]:cuts[i + 1]]
            so_far = known[i] or {"spans": [], "items": [], "matches": []}
            items = {test.ids[item] for x in np.unique(w).tolist() for item, _ in test.places[x]}
            yield {"n_words": len(n), "spans": _spans(at, test.lengths[w], so_far["spans"]),
                   "items": sorted(items | set(so_far["items"])),
                   "matches": (so_far["matches"] or []) + (_longest(at, w, test) if with_matches else [])}

    @F.arrow_udf(_RESULT)
    def search(text: pa.Array, known: pa.Array) -> pa.Array:
        test, out, texts, first, size = test_of(), [], [], 0, 0
        for i in range(len(text)):
            texts.append(text[i].as_py())
            size += len(texts[-1] or "")
            if size >= _SHARD or i == len(text) - 1:
                out += shard(texts, known[first:i + 1].to_pylist(), test)
                texts, first, size = [], i + 1, 0
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                                        ("items", pa.list_(pa.string())),
                                        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()),
                                                                        ("doc_word", pa.int64()), ("n_words", pa.int64())])))]))

    return search


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text; one empty block if there are none."""
    block, size, none = [], 0, True
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= block_bytes:
            yield block
            block, size, none = [], 0, False
    if block or none:
        yield block


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13, with_matches: bool = False,
                  block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct column ``contamination``: n_words, spans (covered runs of words),
    items (ids of items with a window in the text, as sorted strings) and, on request, matches
    (item_id, item_word, doc_word, n_words): the longest verbatim matches and where they are."""
    sc = docs.sparkSession.sparkContext
    found = F.lit(None).cast(_RESULT)
    for block in _blocks(items, item_id, item_text, block_bytes):
        shared = sc.broadcast(TestItems(block, window))
        found = _search(lambda shared=shared: shared.value, with_matches)(F.col(text_col), found)
    return docs.withColumn("contamination", found)


@F.arrow_udf(T.StringType())
def sha256_of_list(items: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(",".join(x.as_py() or []).encode()).hexdigest() for x in items], pa.string())


def with_verdict(docs: DataFrame, items: DataFrame, share: int = 20, **options) -> DataFrame:
    """``contamination`` with n_words, n_hit, n_items and ``contaminated``: some word is hit, and
    at least one in ``share`` words is."""
    out = contamination(docs, items, **options)
    c = F.col("contamination")
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = out.withColumn("n_words", c["n_words"]).withColumn("n_hit", hit).withColumn("n_items", F.size(c["items"]).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
