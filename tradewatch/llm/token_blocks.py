"""Token ids in binary blocks: patched frame of reference.

Texts are encoded, each document gets an end id, and the ids of all documents in order of their
id form one stream. The stream is stored as a table of segments (Parquet written by Spark, so it
lives in any store and every task's part is committed once). A segment holds whole documents;
its payload is a sequence of blocks of ``BLOCK`` ids, and its index lists where each block starts.

Block layout, little-endian: header (uint16 ids, uint8 width, uint16 exceptions, uint32 minimum);
ids minus the minimum, their low ``width`` bits packed, first id in the lowest bits; then the
exceptions: uint16 positions and uint32 high parts. ``width`` is the smallest that holds the
given percentile of the block; what needs more bits is patched from the exception list.

Work at scale: one range shuffle of the texts by document id, then encoding, packing and writing
are narrow. Segment starts come from one row per partition. The tokenizer splits a text into
pieces and encodes each on its own, so pieces seen before come from a bounded table per task.

Defined results: NULL and empty texts are the end id alone. NULL ids come first; rows with the same
id are neighbours, ordered by a hash of the text, and keep one entry each. A document is
never split over segments, so a very long one makes a long segment.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import fresh_path

BLOCK = 4096
PERCENTILE = 95.0
_HEADER = struct.Struct("<HBHI")
_SEGMENT_IDS = 1 << 18
KNOWN_WORDS = 500_000
_IDLE_SECONDS = 3.0

SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_lengths", T.ArrayType(T.LongType())), T.StructField("block_starts", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType())])


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65 535 ids."""
    low = int(ids.min()) if len(ids) else 0
    rest = (ids - low).astype(np.uint32)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length() if len(ids) else 0
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return (_HEADER.pack(len(ids), width, len(over), low) + np.packbits(bits.ravel(), bitorder="little").tobytes()
            + over.astype("<u2").tobytes() + (rest[over] >> np.uint32(width)).astype("<u4").tobytes())


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block that starts at ``at``."""
    n, width, exceptions, low = _HEADER.unpack_from(data, at)
    at += _HEADER.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    out = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += size
    if exceptions:
        where = np.frombuffer(data, "<u2", exceptions, at)
        out[where] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
    return out + np.uint32(low)


def pack(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Block starts and payload of a segment."""
    starts, parts, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        parts.append(pack_block(ids[i:i + BLOCK]))
        starts.append(at)
        at += len(parts[-1])
    return starts, b"".join(parts)


def unpack(starts: list[int], payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only the blocks that hold them are read."""
    last = len(starts) * BLOCK if last is None else last
    blocks = range(first // BLOCK, min(len(starts), -(-last // BLOCK)))
    if not len(blocks):
        return np.zeros(0, np.uint32)
    return np.concatenate([unpack_block(payload, starts[b]) for b in blocks])[first - blocks[0] * BLOCK:last - blocks[0] * BLOCK]


def _holes(parts: list[bytes | None]) -> list[int]:
    at, found = -1, []
    for _ in range(parts.count(None)):
        at = parts.index(None, at + 1)
        found.append(at)
    return found


class Encoder:
    """Encodes texts as the tokenizer does, keeping the ids of words and pieces it has met.

    Used for tokenizers whose model works on each pre-tokenized piece alone, whose pieces never
    hold white space, and whose last token of a piece carries the end-of-word suffix: the file's normalizer and
    pre-tokenizer must be ``NORMALIZER`` and ``SPLIT``, its added tokens must hold ``<|``. Texts with
    characters whose classes the two regular-expression engines may see differently, or with the
    marks of added tokens, go to the tokenizer whole; so does everything for other tokenizers."""

    #: The pieces of the word-end vocabulary after white space is dropped.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The steps before the model that ``_words`` and ``_learn`` stand for.
    NORMALIZER = {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    #: Latin-1 characters left to the tokenizer: separators beyond ASCII and numbers that are no digits.
    ODD = bytes([*range(0x1C, 0x20), 0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
    LOWER = bytes(ord(chr(c).lower()) for c in range(256))

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_piece = bool(suffix) and self._as_expected()
        if self.by_piece:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.find = regex.compile(self.PIECES).findall
            # for pieces that are normalized and cut already
            self.of_pieces = Tokenizer.from_file(path)
            self.of_pieces.normalizer = None
            self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}  # words and pieces in Latin-1 to their ids
        self.known_words = known_words
        self.forget = threading.Timer(0, self.known.clear)

    def _as_expected(self) -> bool:
        steps = [part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        added = self.tokenizer.get_added_tokens_decoder().values()
        return steps == [self.NORMALIZER, self.SPLIT] and all("<|" in t.content for t in added)

    def _words(self, text: str) -> list[bytes] | None:
        """Lower-cased words in Latin-1; None if the text must go to the tokenizer as it is."""
        if not self.by_piece or "<|" in text:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if len(raw.translate(None, self.ODD)) < len(raw) else raw.translate(self.LOWER).split()

    def _learn(self, words: list[bytes]) -> None:
        """Encode the new pieces of new words in one go; a piece ends at an end-of-word token."""
        known = self.known
        cut, new = [], []
        for w in words:
            text = w.decode("latin-1")
            if text.isalpha():  # letters alone are one piece
                new.append(w)
            else:
                pieces = [p.encode("latin-1") for p in self.find(text)]
                cut.append((w, pieces))
                new += [p for p in pieces if p not in known]
        new = list(dict.fromkeys(new))
        if new:
            text = b" ".join(new).decode("latin-1")
            ids = np.array(self.of_pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) != len(new):
                raise ValueError("the tokenizer does not mark the ends of pieces")
            flat = ids.tobytes()
            known.update(zip(new, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        for w, pieces in cut:
            if len(pieces) != 1 or pieces[0] != w:
                known[w] = b"".join([known[p] for p in pieces])

    def idle(self) -> None:
        """Give the table's memory back unless another task comes soon."""
        self.forget = threading.Timer(_IDLE_SECONDS, self.known.clear)
        self.forget.daemon = True
        self.forget.start()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._words(t) for t in texts]
        if len(self.known) > self.known_words:  # the words met first are mostly the frequent ones
            self.known = dict(itertools.islice(self.known.items(), self.known_words // 2))
        of = self.known.get
        parts = [list(map(of, words or ())) for words in split]
        lacking = [(i, j) for i, p in enumerate(parts) for j in _holes(p)]
        if lacking:
            self._learn(list({split[i][j] for i, j in lacking}))
            for i, j in lacking:
                parts[i][j] = self.known[split[i][j]]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if words is None
                else np.frombuffer(b"".join(p), "<u4") for t, words, p in zip(texts, split, parts)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, known_words: int) -> Encoder:
    """One per Python worker; Spark reuses workers for further tasks."""
    return Encoder(path, known_words)


def _writer(tokenizer: str, end_id: int, known_words: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer, known_words), TaskContext.get().partitionId()
        coder.forget.cancel()
        seq = first = held = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []

        def segment() -> pa.RecordBatch:
            starts, payload = pack(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "first": first, "n_ids": held, "doc_ids": docs, "doc_lengths": [len(x) for x in ids],
                "block_starts": starts, "payload": payload}], schema=_ARROW)

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                some = [t or "" for t in texts[at:at + 256].to_pylist()]
                for doc, encoded in zip(doc_ids[at:at + 256].to_pylist(), coder.encode(some)):
                    ids.append(np.append(encoded, np.uint32(end_id)))
                    docs.append(doc)
                    held += len(ids[-1])
                    if held >= _SEGMENT_IDS:
                        yield segment()
                        seq, first, held, ids, docs = seq + 1, first + held, 0, [], []
        if docs:
            yield segment()
        coder.idle()

    return encode


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("doc_lengths", pa.list_(pa.int64())), ("block_starts", pa.list_(pa.int64())), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
          known_words: int = KNOWN_WORDS) -> None:
    """Encode all documents and write the segments below ``path``. Segments are numbered by
    (part, seq); ``first`` counts the ids of the same part before a segment. ``known_words`` bounds
    the table of encoded words in each Python worker (about 200 bytes a word); a larger one
    encodes fewer words twice. The ids are the same."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(_writer(tokenizer, end_id, known_words), SEGMENTS).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and ``before``, the number of ids in all parts before it: one row per part, and a
    part is as many documents as one task encodes."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))


_DIGEST = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                                    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


@F.arrow_udf(_DIGEST)
def _digests(start: pa.Array, doc_ids: pa.Array, lengths: pa.Array, starts: pa.Array, payload: pa.Array) -> pa.Array:
    out = []
    for at, docs, sizes, index, data in zip(start, doc_ids, lengths, starts, payload):
        ids = unpack(index.as_py(), data.as_py()).astype("<u4")
        rows, begin = [], 0
        for doc, size in zip(docs.as_py(), sizes.as_py()):
            rows.append({"doc_id": doc, "start": at.as_py() + begin, "n_tokens": size, "ids_crc32": zlib.crc32(ids[begin:begin + size].tobytes())})
            begin += size
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32."""
    docs = segments(spark, path).select("part", F.explode(_digests("first", "doc_ids", "doc_lengths", "block_starts", "payload")).alias("d"))
    return docs.join(part_starts(spark, path), "part").select(
        "d.doc_id", (F.col("before") + F.col("d.start")).alias("start"), "d.n_tokens", "d.ids_crc32")


def read_ids(spark: SparkSession, path: str, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of the stream, from the blocks that hold them."""
    s = segments(spark, path).join(part_starts(spark, path), "part").withColumn("start", F.col("before") + F.col("first"))
    rows = s.filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)).orderBy("start")
    parts = [unpack(r["block_starts"], bytes(r["payload"]), max(0, first - r["start"]), min(r["n_ids"], last - r["start"]))
             for r in rows.toLocalIterator()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_and_read_back(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "token-blocks")
    write(docs, path, tokenizer, **options)
    return digests(spark, path)
