"""Language-model scores with stupid backoff, computed relationally.

The score of a word is its relative frequency after the longest context that the counts know:
c(context word) / c(context) if the n-gram was seen at least ``min_count`` times, else ``backoff`` times
the score with a context shorter by one word; single words are c(word) / N. A document's score
is the sum of the natural logarithms. Counts come from all documents.

Relations, packed: documents are cut into blocks of a few MB. For each order a block lists its
distinct n-grams (64-bit hashes) with their counts, dealt out by hash to partitions: these rows are
the exploded n-grams of the block. A partition adds the lists up to its part of the count table and
answers each block with the counts of the block's n-grams, in the block's order. The answers are
joined to the blocks, and every block sums its documents. Only sorted lists travel, as compressed
differences, so the exchange is a few bytes per distinct n-gram of a block.

Work at scale: the number of partitions follows the number of blocks, so a partition's share of the
lists stays the same size. An n-gram that is everywhere is one entry per block. Two n-grams are taken
for one if their 64-bit hashes agree.

Defined results: NULL and empty texts have no words and score 0. Repeated documents count and are
scored each. Words are A-Z lower-cased and separated by ASCII white space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import written

_BLOCK = 6 << 20

_BLOCKS = T.StructType([T.StructField("block", T.StringType()), T.StructField("n_words", T.LongType()),
                        T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])
_LISTS = T.StructType([T.StructField("block", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()),
                       T.StructField("size", T.LongType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_SCORES = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())])


def _squeeze(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _differences(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hash of two hashes."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _cut(blocks_of: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size, rows, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def block() -> pa.RecordBatch:
            words = sum(len(t.encode("utf-8", "surrogatepass").split()) for t in texts)
            return pa.RecordBatch.from_pylist([{"block": f"{part}-{seq}", "n_words": words, "rows": rows, "texts": texts}], schema=_ARROW_BLOCKS)

        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                rows.append(row.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= blocks_of:
                    yield block()
                    seq, size, rows, texts = seq + 1, 0, [], []
        if rows:
            yield block()

    return cut


_ARROW_BLOCKS = pa.schema([("block", pa.string()), ("n_words", pa.int64()), ("rows", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])
_ARROW_LISTS = pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block and the first word of each text (one more at the end)."""
    known: dict[bytes, int] = {}
    ids, starts = [], [0]
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        starts.append(starts[-1] + len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    return hashes[np.concatenate(ids)] if len(known) else np.zeros(0, np.uint64), np.array(starts)


def _grams(words: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: n, places of the last words and hashes of the n-grams that end there."""
    place_in_text = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    hashes = words
    yield 1, np.arange(len(words)), words
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[n - 1:] = _mix(hashes[n - 2:-1], words[n - 1:]) if len(words) >= n else longer[n - 1:]
        hashes = longer
        ends = np.flatnonzero(place_in_text >= n - 1)
        yield n, ends, hashes[ends]


def _deal(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in ordered hashes: equal ranges of the hash space."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _lists(order: int, parts: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, starts = _word_hashes(texts.as_py())
                for n, _, hashes in _grams(words, starts, order):
                    grams, counts = np.unique(hashes, return_counts=True)
                    at = _deal(grams, parts)
                    rows = [{"block": block, "part": p, "n": n, "size": int(b - a), "grams": _squeeze(_differences(grams[a:b])),
                             "counts": _squeeze(counts[a:b].astype(np.uint32))} for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_LISTS)

    return lists


def _answer(key: tuple, lists: pa.Table) -> pa.Table:
    """Add up the lists of one part and order; give each block the sums of its n-grams."""
    rows = lists.select(["grams", "counts"]).to_pylist()
    grams = [np.cumsum(_expand(r["grams"], "<u8"), dtype=np.uint64) for r in rows]
    every, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, back, np.concatenate([_expand(r["counts"], "<u4") for r in rows]).astype(np.uint64))
    sums, at, out = total[back].astype("<u8"), 0, []
    for g in grams:
        out.append(_squeeze(sums[at:at + len(g)]))
        at += len(g)
    return lists.set_column(lists.column_names.index("counts"), "counts", pa.array(out, pa.binary())).set_column(
        lists.column_names.index("grams"), "grams", pa.array([b""] * len(out), pa.binary())).select(_LISTS.names).cast(_ARROW_LISTS)


def _sum_up(order: int, backoff: float, min_count: int, n_total: int):
    def score(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        by = {}
        for r in answers.select(["n", "part", "counts"]).to_pylist():
            by.setdefault(r["n"], []).append((r["part"], r["counts"]))
        for block in blocks.select(["rows", "texts"]).to_pylist():
            words, starts = _word_hashes(block["texts"])
            counts = {}
            for n, ends, hashes in _grams(words, starts, order):
                back = np.unique(hashes, return_inverse=True)[1]
                known = np.concatenate([_expand(data, "<u8") for _, data in sorted(by.get(n, []))]) if n in by else np.zeros(0, np.uint64)
                counts[n] = np.zeros(len(words))
                counts[n][ends] = known[back]
            log = np.log(np.maximum(counts[1], 1)) - math.log(max(n_total, 1))
            for n in range(2, order + 1):
                # the context ends one word before; n-grams not seen often enough keep the shorter score
                context = np.maximum(np.append(0, counts[n - 1][:-1]), 1)
                log = np.where(counts[n] >= min_count, np.log(np.maximum(counts[n], 1)) - np.log(context),
                               np.where(np.arange(len(words)) > np.repeat(starts[:-1], np.diff(starts)) + n - 2, log + math.log(backoff), log))
            sums = np.add.reduceat(np.append(log, 0.0), np.minimum(starts[:-1], len(log))) if len(starts) > 1 else []
            for row, size, total in zip(block["rows"], np.diff(starts).tolist(), np.asarray(sums).tolist()):
                out.append({"row": row, "n_words": size, "log_score": total if size else 0.0})
        return pa.Table.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())]))

    return score


def score(docs: DataFrame, row_col: str = "doc_id", text_col: str = "text", order: int = 2, backoff: float = 0.4,
          min_count: int = 2, block_bytes: int = _BLOCK) -> DataFrame:
    """(row_col, n_words, log_score), one row per document. Words too near to the start of a text
    for a full context use the longest that there is, without a backoff factor."""
    blocks = written(docs.select(F.col(row_col).cast("long"), F.col(text_col)).mapInArrow(_cut(block_bytes), _BLOCKS), "lm-blocks")
    state = blocks.agg(F.count("*"), F.sum("n_words")).first()
    parts, n_total = max(1, min(state[0], 1 << 20) // 4), state[1] or 0
    lists = blocks.select("block", "texts").mapInArrow(_lists(order, parts), _LISTS)
    answers = lists.groupBy("part", "n").applyInArrow(_answer, _LISTS)
    scored = blocks.groupBy("block").cogroup(answers.select("block", "n", "part", "counts").groupBy("block")).applyInArrow(
        _sum_up(order, backoff, min_count, n_total), _SCORES)
    return scored.withColumnRenamed("row", row_col)


SQL = """
WITH w AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))),
b AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w),
c1 AS (SELECT word, count(*) AS c FROM w GROUP BY word), n AS (SELECT count(*) AS n FROM w),
c2 AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, CASE WHEN c2.c >= 2 THEN ln(c2.c / p.c::DOUBLE)
    WHEN b.prev IS NOT NULL THEN ln(0.4 * c1.c / n.n::DOUBLE) ELSE ln(c1.c / n.n::DOUBLE) END AS lp
  FROM b JOIN c1 ON b.word = c1.word CROSS JOIN n LEFT JOIN c2 ON b.prev = c2.prev AND b.word = c2.word LEFT JOIN c1 p ON p.word = b.prev)
SELECT d.doc_id, count(s.doc_id) AS n_words, round(coalesce(sum(lp), 0), 3) + 0.0 AS log_score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""

#: The same with contexts of up to two words.
SQL_ORDER3 = """
WITH w AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))),
b AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev, lag(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS prev2 FROM w),
c1 AS (SELECT word, count(*) AS c FROM w GROUP BY word), n AS (SELECT count(*) AS n FROM w),
c2 AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY ALL),
c3 AS (SELECT prev2, prev, word, count(*) AS c FROM b WHERE prev2 IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, CASE WHEN c3.c >= 2 THEN ln(c3.c / q.c::DOUBLE)
    WHEN c2.c >= 2 THEN ln(CASE WHEN b.prev2 IS NULL THEN 1 ELSE 0.4 END * c2.c / p.c::DOUBLE)
    ELSE ln(CASE WHEN b.prev IS NULL THEN 1 WHEN b.prev2 IS NULL THEN 0.4 ELSE 0.4 * 0.4 END * c1.c / n.n::DOUBLE) END AS lp
  FROM b JOIN c1 ON b.word = c1.word CROSS JOIN n LEFT JOIN c2 ON b.prev = c2.prev AND b.word = c2.word LEFT JOIN c1 p ON p.word = b.prev
    LEFT JOIN c3 ON b.prev2 = c3.prev2 AND b.prev = c3.prev AND b.word = c3.word LEFT JOIN c2 q ON b.prev2 = q.prev AND b.prev = q.word)
SELECT d.doc_id, count(s.doc_id) AS n_words, round(coalesce(sum(lp), 0), 3) + 0.0 AS log_score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
