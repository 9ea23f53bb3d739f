"""Alignment of two tokenizers' outputs by merge-path partitioning, and links between their tokens.

Both tokenizers cut the same bytes: tokenizer A is given a space and the text, tokenizer B the text, before which
it puts the space itself. A byte offset where a token of A and a token of B both end closes a group; all A tokens of a group
are linked with all its B tokens. A pair of ids counts as many documents as hold it linked.

* Merge path: merging the ends of A and B is a walk through a grid, one step for each end. Diagonals a fixed number of
  steps apart are searched for the walk's crossing (all at once, by bisection), which divides the merge into
  independent pieces of equal work, whatever the documents are. Each piece emits the offsets that both sides have within it; an
  equal pair that a cut separates is found from the neighbours of the cut. Groups are stitched from the offsets of all
  pieces, so a group may reach over any number of pieces.
* Blocks: documents are read in blocks of ``block_bytes`` of text. A block keeps its different groups once, which
  documents have them how often, and its different id pairs with the number of documents that hold them.
* Counts: the pairs of all blocks are added up by a window on the pair (a block has a pair once, so even a pair that is
  everywhere is one row for each block). The highest count of each A id is a table bounded by A's vocabulary and
  is broadcast. Counts go back to their blocks, where the documents' figures are sums over their groups.

A is the tokenizers library's; where its file says plain byte-level BPE with the usual split, texts in Latin-1 without very
long runs are encoded by tiktoken with the same vocabulary, which gives the same ids several times faster; all
others take the library itself. B is a sentencepiece model. Strings of special tokens are plain text for both.

Defined results: texts that are NULL or empty, or whose joined token bytes differ from a space and the text in A or in
B, have no tokens: all their numbers are 0 and groups_sha256 is the empty string. Repeated rows are documents of
their own (each counts). An empty table gives no rows. A text is encoded whole; a very long one is a block of its own.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import written

BLOCK_BYTES = 24 << 20
#: bytes of text that are encoded and aligned at a time within a block
CHUNK_BYTES = 1 << 20
#: merge steps of one piece
PIECE = 1 << 16
#: (document, pair) rows that are counted at a time
_COUNT_ROWS = 1 << 21


# ---------------------------------------------------------------------------------------------- merge path


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """Where the merge of the sorted ends ``a`` and ``b`` (a first where equal) crosses every ``work``-th diagonal: how many
    ends of ``a`` come before it. Each search is over its diagonal alone; all run side by side."""
    d = np.arange(0, len(a) + len(b) + work, work, dtype=np.int64)
    d[-1] = len(a) + len(b)
    lo, hi = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        open_ = lo < hi
        # a[mid] goes before b[d - mid - 1]: the crossing lies further along a
        i, j = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        further = a[i] <= b[j]
        lo, hi = np.where(open_ & further, mid + 1, lo), np.where(open_ & ~further, mid, hi)
    return np.stack([lo, d - lo], axis=1)


def _overlap(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """The ends that A and B both have in one piece, or on its first cut: the last of A before the cut may equal the first of B after it."""
    mine = a[i0:i1]
    found = np.searchsorted(mine, b[j0:j1])
    inside = found < len(mine)
    same = np.zeros(j1 - j0, bool)
    same[inside] = mine[found[inside]] == b[j0:j1][inside]
    if i0 and j0 < j1 and a[i0 - 1] == b[j0]:
        same[0] = True
    return b[j0:j1][same]


def common_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> np.ndarray:
    """The ends that both have, ascending, from the pieces of the merge."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64)
    cuts = diagonals(a, b, work).tolist()
    pieces = [_overlap(a, b, i0, i1, j0, j1) for (i0, j0), (i1, j1) in zip(cuts, cuts[1:])]
    return np.concatenate(pieces)


# ---------------------------------------------------------------------------------------------- tokenizers


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, and the others, in order, as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class ByteLevel:
    """Tokenizer A from its file: ids of texts and the bytes of every id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        vocab, chars = self.slow.get_vocab(with_added_tokens=True), _byte_of_char()
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = entry.encode() if entry in added else bytes(chars[c] for c in entry)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        pre, model = about.get("pre_tokenizer") or {}, about["model"]
        plain = (about.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        ranks = {self.bytes[i]: i for e, i in vocab.items() if e not in added}
        # a merge's rank is its id there, so ids must be in the order of the merges
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        in_order = [vocab[m] for m in merged]
        plain = plain and in_order == sorted(in_order) and in_order[:1] == [256] and len(ranks) == 256 + len(merged)
        # fixed value: the split of byte-level BPE with use_regex
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("a", pat_str=split, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and text and ord(max(text)) < 256 and max(map(len, text.split(" "))) < 500 and " " * 500 not in text:
            return self.fast.encode_ordinary(text)
        return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """Tokenizer B from its model file; a piece's bytes are its UTF-8 with U+2581 as space, or the byte it stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        at = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in at]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def tokens(a: ByteLevel, b: Pieces, text: str | None) -> tuple[list[int], list[int]]:
    """The ids of A and B, none for a text whose joined token bytes are not a space and the text."""
    if not text:
        return [], []
    whole = (" " + text).encode("utf-8", "surrogatepass")
    ids_b = b.encode(text)
    if b"".join(map(b.bytes.__getitem__, ids_b)) != whole:
        return [], []
    ids_a = a.encode(" " + text)
    if b"".join(map(a.bytes.__getitem__, ids_a)) != whole:
        return [], []
    return ids_a, ids_b


# ---------------------------------------------------------------------------------------------- blocks


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[k], starts[k] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def _links(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of a group and how many links each stands for. A small group has a row for every link; of a
    large one (a long text whose ends rarely meet) repeated ids are counted first, so no large product is made of them."""
    a, b = key[1:1 + key[0]], key[1 + key[0]:]
    if len(a) * len(b) <= 64:
        pairs = (a[:, None] << 32 | b[None, :]).ravel()
        return pairs, np.ones(len(pairs), np.int64)
    (a, n_a), (b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] << 32 | b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel()


class _Block:
    """Documents of a block: their groups as numbers in a dictionary of different groups."""

    def __init__(self, a: ByteLevel, b: Pieces, work: int):
        self.a, self.b, self.work = a, b, work
        self.len_a, self.len_b = (np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)) for t in (a, b))
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        self.ids, self.rows, self.docs, self.waiting = [], [], [], []
        self.size = self.chunk = 0

    def add(self, doc_id, text: str | None) -> None:
        self.ids.append(doc_id)
        self.waiting.append(tokens(self.a, self.b, text))
        n = 4 * len(text or "")  # at most
        self.size, self.chunk = self.size + n, self.chunk + n
        if self.chunk >= 4 * CHUNK_BYTES:
            self.align()

    def align(self) -> None:
        """Groups of the documents waiting, all in one merge."""
        n_a, n_b = (np.fromiter((len(x[s]) for x in self.waiting), np.int64, len(self.waiting)) for s in (0, 1))
        ids_a, ids_b = (np.fromiter((i for x in self.waiting for i in x[s]), np.int64, int(n.sum())) for s, n in ((0, n_a), (1, n_b)))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        # every document ends in both, so no group reaches over two documents
        ends = common_ends(ends_a, ends_b, self.work)
        to_a, to_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        from_a, from_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (to_a, to_b))
        g_a, g_b = to_a - from_a, to_b - from_b
        # a group's key: how many ids of A, the ids of A, the ids of B
        starts = np.cumsum(1 + g_a + g_b) - (1 + g_a + g_b)
        keys = np.empty(int((1 + g_a + g_b).sum()), np.uint32)
        keys[starts] = g_a
        keys[_ragged(starts + 1, g_a)] = ids_a
        keys[_ragged(starts + 1 + g_a, g_b)] = ids_b
        offsets = np.append(starts, len(keys)) * 4
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(keys)]).dictionary_encode()
        here = []
        for key in coded.dictionary.to_pylist():
            i = self.number.setdefault(key, len(self.names))
            if i == len(self.names):
                k = np.frombuffer(key, np.uint32).tolist()
                self.names.append(",".join(map(str, k[1:1 + k[0]])) + "|" + ",".join(map(str, k[1 + k[0]:])))
            here.append(i)
        groups = np.array(here, np.int64)[coded.indices.to_numpy()] if len(ends) else np.zeros(0, np.int64)
        links = np.concatenate([[0], np.cumsum(g_a * g_b)])
        # a document's groups are those that close up to its last end
        last = np.searchsorted(to_a, np.cumsum(n_a), side="right").tolist()
        first = 0
        for x, y, upto in zip(n_a.tolist(), n_b.tolist(), last):
            mine = groups[first:upto] if x else groups[:0]
            name = hashlib.sha256(";".join(map(self.names.__getitem__, mine.tolist())).encode()).hexdigest() if x else ""
            n_links = int(links[first + len(mine)] - links[first])
            self.rows.append((x, y, len(mine), n_links, name))
            self.docs.append([z.astype(np.uint32) for z in np.unique(mine, return_counts=True)])
            first += len(mine)
        self.waiting, self.chunk = [], 0

    def pairs(self):
        """(codes, documents, sizes, at, weights): the different id pairs as ``a << 32 | b``, how many documents hold each, and for
        every group how many pairs it has, their places and how many links each stands for."""
        parts = [_links(np.frombuffer(k, np.uint32).astype(np.int64)) for k in self.number]
        sizes = np.array([len(x) for x, _ in parts], np.int64)
        links, weights = (np.concatenate([x[s] for x in parts]) if parts else np.zeros(0, np.int64) for s in (0, 1))
        codes, at = np.unique(links, return_inverse=True)
        starts, held = np.cumsum(sizes) - sizes, np.zeros(len(codes), np.int64)
        counts = [len(x[0]) for x in self.docs]
        first = 0
        while first < len(counts):
            upto, rows = first, 0
            while upto < len(counts) and (upto == first or rows + counts[upto] <= _COUNT_ROWS // 8):
                rows, upto = rows + counts[upto], upto + 1
            groups = np.concatenate([x[0] for x in self.docs[first:upto]]).astype(np.int64)
            doc = np.repeat(np.arange(upto - first), counts[first:upto])
            row = np.repeat(doc, sizes[groups]) * len(codes) + at[_ragged(starts[groups], sizes[groups])]
            held += np.bincount(np.unique(row) % max(len(codes), 1), minlength=len(codes))
            first = upto
        return codes, held, sizes, at, weights

    def row(self, number: int, id_type) -> pa.RecordBatch:
        """The block as one row; what is only read back here is packed."""
        if self.waiting:
            self.align()
        codes, held, sizes, at, weights = self.pairs()
        counts = np.array([len(x[0]) for x in self.docs], np.uint32)
        parts = [sizes.astype(np.uint32), at.astype(np.uint32), weights.astype(np.uint32), counts, *(np.concatenate([x[s] for x in self.docs]) for s in (0, 1))]
        packed = [zstandard.compress(x.tobytes(), 1) for x in parts]
        cols = list(zip(*self.rows))
        arrays = [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(id_type)), pa.array([codes], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64())),
                  *(pa.array([list(c)], pa.list_(pa.string() if k == 4 else pa.int64())) for k, c in enumerate(cols)), pa.array([packed], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "codes", "held", "n_a", "n_b", "n_groups", "n_links", "names", "packed"])


def _blocks(path_a: str, path_b: str, block_bytes: int, work: int):
    def run(batches):
        a, b = ByteLevel(path_a), Pieces(path_b)
        number = TaskContext.get().partitionId() << 32
        block, id_type = _Block(a, b, work), None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if block.size >= 4 * block_bytes:
                    yield block.row(number, id_type)
                    number, block = number + 1, _Block(a, b, work)
        if block.ids:
            yield block.row(number, id_type)

    return run


def _figures(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """One block and the counts of its pairs to its documents' rows."""
    block = blocks.slice(0, 1)
    sizes, at, weights, n_groups, groups, times = (np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.int64) for x in block["packed"][0].as_py())
    value, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    place = counts["at"].to_numpy()
    value[place], best[place] = counts["n"].to_numpy(), counts["is_best"].to_numpy()

    def summed(values, lengths):
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(lengths)
        return total[ends] - total[ends - lengths]

    per_doc = [summed(times * summed(x[at] * weights, sizes)[groups], n_groups) if len(groups) else np.zeros(len(n_groups), np.int64) for x in (best, value)]
    col = lambda name: block[name].combine_chunks().flatten()
    return pa.table([col("ids"), *(col(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(per_doc[0]), pa.array(per_doc[1]), col("names")],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, work: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"block long, ids array<{kind}>, codes array<long>, held array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
              "n_links array<long>, names array<string>, packed array<binary>")
    blocks = written(docs.select(id_col, text_col).mapInArrow(_blocks(path_a, path_b, block_bytes, work), schema), "align-blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("codes", "held")).alias("at", "p")).select("block", "at", "p.codes", "p.held")
    pairs = pairs.withColumn("n", F.sum("held").over(Window.partitionBy("codes"))).select("block", "at", F.shiftright("codes", 32).alias("a"), "n")
    pairs = written(pairs, "align-counts")
    # one row for each id of A: its vocabulary is the bound
    best = F.broadcast(pairs.groupBy("a").agg(F.max("n").alias("most")))
    counts = pairs.join(best, "a").select("block", "at", "n", (F.col("n") == F.col("most")).cast("int").alias("is_best"))
    rest = blocks.select("block", "ids", "n_a", "n_b", "n_groups", "n_links", "names", "packed")
    result = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])
    out = rest.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_figures, result)
    return out.withColumnRenamed("id", id_col)
