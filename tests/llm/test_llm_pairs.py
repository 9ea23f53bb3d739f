"""The shingle join, the filter audit and the tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter
from itertools import accumulate, permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import corpus
from tradewatch.llm import align, filter_audit, queries, shingle_join


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = corpus.frame(spark)
    return df.cache(), rows


# ---------------------------------------------------------------------------------------------- shingle join


def joined_brute(rows, width, num, den):
    """rows: list of (id, text); Counter of (id, n, component id)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def joined(df, **options):
    return Counter(tuple(r) for r in shingle_join.near_duplicates(df, **options).collect())


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (2, 3, 5)])
def test_shingle_join_equals_brute_force(docs, width, num, den, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(shingle_join, "BLOCK", 2)  # every shingle of several groups is dealt to blocks
    assert joined(df, width=width, num=num, den=den) == joined_brute([(r[0], r[1]) for r in rows], width, num, den)


def test_shingle_join_links_chains_that_no_first_group_sees(spark):
    """Near copies of one text, each a few words from the next, so that ends of the chain are not similar."""
    rnd, texts = random.Random(4), []
    base = [corpus.word(rnd) for _ in range(120)]
    for k in range(25):
        base = list(base)
        base[(7 * k) % 120] = corpus.word(rnd)
        texts.append(" ".join(base))
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 10)) + [(500, texts[3].upper()), (None, texts[5]), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = joined_brute(rows, 3, 9, 10)
    assert joined(df) == want and max(Counter(c for _, _, c in want.elements()).values()) > 5


def test_shingle_join_of_an_empty_table_and_of_texts_without_words(spark):
    assert joined(corpus.empty(spark)) == Counter()
    df = spark.createDataFrame([(2, ""), (1, None), (3, " \t")], "doc_id long, text string")
    assert joined(df) == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1})


def test_shingle_join_takes_string_ids_and_a_very_long_text(spark):
    rnd = random.Random(8)
    long = " ".join(corpus.word(rnd) for _ in range(60_000))
    rows = [("b", long), ("a", long + " one more"), ("c", "short text here")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r[0], r[2]) for r in joined(df)} == {("a", "a"), ("b", "a"), ("c", "c")}


# ---------------------------------------------------------------------------------------------- filter audit


def audit_brute(rows, labels):
    """rows: list of (id, text, part); labels: list of (id, quality, toxic)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *said in labels if d is not None and said[k] == 1} for k in (0, 1))
    out = {}
    for d, t, part in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                n = out.setdefault((part or "", order, step), [0] * 6)
                here = fails[x] and not gone
                for k, hit in enumerate((not gone and not fails[x], here, fails[x] and gone, fails[x] and sum(fails.values()) == 1, here and d in good, here and d in toxic)):
                    n[k] += hit
                gone = gone or here
    share = Counter()
    for (part, order, step), n in out.items():
        share[part, order[step - 1]] += n[1]
    return {(*k, *n, share[k[0], k[1][k[2] - 1]]) for k, n in out.items()}


def test_audit_equals_brute_force(spark, docs):
    df, rows = docs
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, None), (3, 1, 1), (None, 1, 1), (10_000, 1, 1)]
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cols = ["part", "filter_order", "step", *filter_audit.KINDS, "shapley"]
    got = [tuple(r) for r in got.select(*cols).collect()]
    assert len(got) == 1200 and set(got) == audit_brute([(r[0], r[1], r[2]) for r in rows], labels)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(corpus.empty(spark), labels).count() == 0
    one = spark.createDataFrame([(1, "A#" * 100_000, None)], "doc_id long, text string, lang string")
    assert {r.part for r in filter_audit.audit(one, labels).collect()} == {""}


def test_packed_fields_do_not_run_into_each_other():
    import pyarrow as pa

    n = [(1 << 50) - 1, 1, (1 << 40) + 5]
    part = filter_audit.audit_part(pa.table({"part": ["p"] * 3, "key": [1, 31 + 32, 16 + 64], "n": n}))
    first = part.filter(pa.compute.equal(part["filter_order"], "ABCDE")).to_pylist()
    assert [r["removed"] for r in first] == [n[0] + n[1], 0, 0, 0, n[2]]
    assert [r["kept"] for r in first] == [n[2], n[2], n[2], n[2], 0]
    assert [r["toxic_lost"] for r in first] == [0, 0, 0, 0, n[2]] and [r["good_lost"] for r in first] == [n[1], 0, 0, 0, 0]


# ---------------------------------------------------------------------------------------------- alignment


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_the_merge_emit_all_common_ends(a, b, work):
    x, y = (np.array(sorted(s), np.int64) for s in (a, b))
    assert align.common_ends(x, y, work).tolist() == sorted(a & b)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 80), min_size=1), st.sets(st.integers(1, 80), min_size=1), st.integers(1, 9))
def test_pieces_of_the_merge_are_of_equal_work(a, b, work):
    cuts = align.diagonals(*(np.array(sorted(s), np.int64) for s in (a, b)), work)
    steps = np.diff(cuts.sum(axis=1))
    assert cuts[0].tolist() == [0, 0] and cuts[-1].tolist() == [len(a), len(b)]
    assert (steps[:-1] == work).all() and (np.diff(cuts, axis=0) >= 0).all()


@pytest.fixture(scope="module")
def tokenizers():
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    return paths, align.ByteLevel(paths[0]), align.Pieces(paths[1])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=60))
def test_fast_ids_are_those_of_the_tokenizer(tokenizers, text):
    _, a, _ = tokenizers
    assert a.fast is not None and a.encode(" " + text) == a.slow.encode(" " + text, add_special_tokens=False).ids


def align_brute(rows, a, b):
    held, per = Counter(), []
    for d, t in rows:
        ids = (a.slow.encode(" " + t, add_special_tokens=False).ids, b.model.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(tok.bytes[i] for i in x) != whole for tok, x in zip((a, b), ids)):
            per.append((d, None))
            continue
        ends = [list(accumulate(len(tok.bytes[i]) for i in x)) for tok, x in zip((a, b), ids)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ni, nj = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((ids[0][i:ni], ids[1][j:nj]))
            i, j = ni, nj
        held.update({(x, y) for g, h in groups for x in g for y in h})
        per.append((d, (len(ids[0]), len(ids[1]), groups)))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = Counter()
    for d, v in per:
        if v is None:
            out[d, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        links = [(x, y) for g, h in v[2] for x in g for y in h]
        name = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in v[2])
        out[d, v[0], v[1], len(v[2]), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(name.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("block_bytes", "work"), [(2000, 3), (1 << 20, 1 << 16)])
def test_alignment_equals_brute_force(spark, docs, tokenizers, block_bytes, work):
    df, rows = docs
    paths, a, b = tokenizers
    odd = ["▁ already", "<s> </s> <0x41> <|endoftext|>", "a" * 3000, "  two spaces", "日本語 テキスト", " nbsp em", "x\ty\n\nz ", "🙂👍🏽 é", "<unk>"]
    more = spark.createDataFrame([(900 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    table = df.select("doc_id", "text", "n_words").unionByName(more, allowMissingColumns=True)
    got = Counter(tuple(r) for r in align.align(table, *paths, block_bytes=block_bytes, work=work).collect())
    assert got == align_brute([(r[0], r[1]) for r in rows] + [(900 + k, t) for k, t in enumerate(odd)], a, b)


def test_alignment_of_an_empty_table_and_a_long_text(spark, tokenizers):
    paths, a, b = tokenizers
    assert align.align(corpus.empty(spark), *paths).count() == 0
    rnd = random.Random(2)
    long = " ".join(corpus.word(rnd) for _ in range(30_000)) + "q" * 5000
    df = spark.createDataFrame([("k", long), (None, long)], "doc_id string, text string")
    got = Counter(tuple(r) for r in align.align(df, *paths, block_bytes=10_000).collect())
    assert got == align_brute_long([("k", long), (None, long)], a, b)


def align_brute_long(rows, a, b):
    """Like align_brute, with the ends looked up in tables."""
    out = Counter()
    ids = (a.slow.encode(" " + rows[0][1], add_special_tokens=False).ids, b.model.encode(rows[0][1]))
    ends = [list(accumulate(len(tok.bytes[i]) for i in x)) for tok, x in zip((a, b), ids)]
    at = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        groups.append((ids[0][i:at[0][e]], ids[1][j:at[1][e]]))
        i, j = at[0][e], at[1][e]
    n = sum(len(g) * len(h) for g, h in groups)
    name = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()
    for d, _ in rows:  # every pair is in both documents
        out[d, len(ids[0]), len(ids[1]), len(groups), n, n, 2 * n, name] += 1
    return out
