"""Operators on texts against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import corpus
from tradewatch.llm import components, decontaminate, lcp_merge, lm_score, line_dedup, quality, queries, simhash, substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = corpus.frame(spark)
    return df.cache(), rows


def fp_brute(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(prints):
    """prints: list of (id, fingerprint); smallest id (NULL last) per row."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return Counter((d, f, least.get(root(f))) for d, f in prints)


def test_fingerprint_in_pieces_equals_whole(monkeypatch):
    text = " ".join(corpus.word(random.Random(1)) for _ in range(500)) + "  \n tail " * 30
    whole = simhash.fingerprint(text)
    assert whole == fp_brute(text)
    monkeypatch.setattr(simhash, "_PIECE", 37)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_simhash_groups_equal_brute_force(spark, docs):
    df, rows = docs
    rnd = random.Random(3)
    prints = [(r[0], fp_brute(r[1])) for r in rows]
    for _ in range(40):  # chains of flips, inside one block and across blocks
        f = rnd.choice(prints)[1]
        lo, hi = rnd.choice([(0, 64), (0, 22), (22, 43), (43, 64)])
        for b in rnd.sample(range(lo, hi), rnd.choice([1, 2, 3, 3, 4])):
            f ^= 1 << b
        prints.append((1000 + len(prints), f))
    table = spark.createDataFrame([(d, simhash._signed(f)) for d, f in prints], "doc_id long, fp long")
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(table).collect())
    assert got == components_brute(prints)
    got_fp = Counter((r.doc_id, r.f % (1 << 64)) for r in df.select("doc_id", simhash.fingerprints()("text").alias("f")).collect())
    assert got_fp == Counter((r[0], fp_brute(r[1])) for r in rows)


def test_long_lines_that_share_words_are_no_candidates(spark, monkeypatch):
    rng, counted = random.Random(5), {}
    pool = [f"w{k}" for k in range(400)]
    lines = [rng.sample(pool, 160) for _ in range(12)]
    texts = [(k, " ".join(w)) for k, w in enumerate(lines)]

    def seen(df, name, written=line_dedup.written):
        out = written(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", seen)
    out = line_dedup.summary(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert counted["line-classes"] == 12 and counted["line-candidates"] == 0 and not any(r.n_removed for r in out)
    # one with 8 other words, one with 40 other words, white space of all kinds
    texts.append((20, "\t" + "  ".join(lines[3][8:] + [f"x{k}" for k in range(8)])))
    texts.append((21, " ".join(lines[4][40:] + [f"y{k}" for k in range(40)])))
    texts += [(22, " \t\r\n \x0b\n\n" + "\x0c".join(lines[5])), (23, None), (24, "")]
    out = line_dedup.summary(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.removed) for r in out if r.n_removed) == [(20, "0"), (22, "3")]


def test_no_side_of_the_links_and_components_is_broadcast(spark):
    # three fingerprints within one block: both balls have rows, and the planner takes them for a few hundred bytes
    prints = [(0, 0, 0, 0), (0, 0, 7, 0), (0, 0, 3, 0)]
    near = spark.createDataFrame(prints, "t int, v long, d long, fp long").withColumn("fp", F.col("d"))
    near = near.withColumn("rep", F.col("fp"))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    for df in (simhash._one_bit_apart(near), simhash._three_in_one_block(near), components._large_star(edges), components._small_star(edges)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    table = spark.createDataFrame([(1, 0), (2, 7), (3, 1 << 40), (4, 1 << 41)], "doc_id long, fp long")
    out = simhash.near_duplicates(table)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_keep_one_keeps_the_smallest_id_of_each_group(spark, docs):
    df, rows = docs
    groups = {}
    for d, f, c in components_brute([(r[0], fp_brute(r[1])) for r in rows]):
        groups.setdefault(c, set()).add(d)
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(groups, key=str)
    assert kept[0].asDict().keys() == set(df.columns)
    assert simhash.keep_one(corpus.empty(spark)).count() == 0


def removed_brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [264, 400])
def test_substrings_equal_brute_force(docs, length, monkeypatch):
    df, rows = docs
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in substring_dedup.dedup_substrings(df, length=length).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, removed_brute([r[1] for r in rows], length)))


def test_tiles_of_pieces_cover_all_windows_once(monkeypatch):
    raw = " ".join(corpus.word(random.Random(5)) for _ in range(900)).encode()
    monkeypatch.setattr(substring_dedup, "_PIECE", 700)
    lo, hi, a = substring_dedup.tiles(raw, 400)
    assert [x for p, q in zip(lo, hi) for x in range(p, q + 1)] == list(range(len(raw) - 399))
    assert ((a >= hi) & (a - lo < substring_dedup.WIDTH)).all()
    assert len(substring_dedup.tiles(b"", 400)[0]) == len(substring_dedup.tiles(b"x" * 399, 400)[0]) == 0


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.dedup_substrings(corpus.empty(spark)).count() == 0


def test_equal_suffixes_are_dealt_to_many_parts():
    rnd = random.Random(8)
    rows = [(5, t, 20, rnd.randbytes(20) + b"s" * 300) for t in range(900)] + [(t, t, 20, rnd.randbytes(320)) for t in range(1000, 1100)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("core", "tile", "left", "data"), r)) for r in rows])
    runs = substring_dedup._sorted_runs(substring_dedup._bounds(sorted(d[k:] for _, _, k, d in rows), 20))([batch])
    sizes = Counter({r["part"]: len(r["tile"]) for out in runs for r in out.to_pylist()})
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 2 * len(rows) // 20


def test_windows_of_a_hot_core_are_dealt_by_hash():
    rnd = random.Random(8)
    known = [(7, t, np.array([rnd.randrange(1 << 62) for _ in range(99)] + [4711], np.uint64)) for t in range(400)]
    rows = [r for part in (known[:200], known[200:]) for r in substring_dedup._dealt_by_hash(part, 20)]
    size = Counter()
    for r in rows:
        size[r["part"]] += len(r["hashes"]) // 8
    assert sum(size.values()) == 40_000 and max(size.values()) < 3_000
    out = Counter()
    for p in size:
        found = substring_dedup._repeated((p,), pa.Table.from_pylist([r for r in rows if r["part"] == p], schema=substring_dedup._WINDOWS_ARROW))
        out.update((r["tile"], r["a"], r["b"]) for r in found.to_pylist())
    assert out == Counter((t, 99, 99) for t in range(400))


def test_a_passage_after_many_texts_equals_brute_force(spark):
    rnd = random.Random(12)
    passage = " ".join(corpus.word(rnd) for _ in range(120))
    texts = [" ".join(corpus.word(rnd) for _ in range(60)) + " " + passage + rnd.choice(["", " and", " " + corpus.word(rnd)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == Counter((i, *b) for i, b in enumerate(removed_brute(texts, 400)))
    assert sum(r[2] for r in got) > 60 * 400


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(4)
    for _ in range(200):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 30))) for _ in range(rnd.randrange(0, 8))) for _ in range(rnd.randrange(0, 9))]
        assert all([s for s, _ in lcp_merge.decode_run(lcp_merge.front_code(r))] == r for r in runs)
        got = list(lcp_merge.merge([lcp_merge.decode_run(lcp_merge.front_code(r)) for r in runs]))
        assert [g[0] for g in got] == sorted(s for r in runs for s in r)
        assert all(lcp_merge.common_prefix(x[0], y[0]) == y[1] for x, y in zip(got, got[1:]))


def stats_brute(text):
    text = text or ""
    w = text.encode().split()
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_quality_statistics_and_verdicts(spark, docs):
    df, rows = docs
    judged = quality.judge(df, drop_text=True).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged)
    want = Counter()
    for r in rows:
        s = stats_brute(r[1])
        want[(r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want
    assert all(not r.kept for r in judged if r.base_failed)
    assert set(quality.judge(df).columns) >= set(df.columns) - {"kept", "n_words"}
    assert quality.judge(corpus.empty(spark)).count() == 0


def test_verdicts_equal_an_em_over_single_documents(spark, docs):
    """EM written anew, document by document: verdicts and probabilities of the operator."""
    import math

    names = [r.name for r, _ in quality.RULES]
    got = quality.judge(docs[0]).select("base_failed", "kept", "p_good", "n_words", "n_repeat_words", *[f"v_{n}" for n in names]).collect()
    for r in got:  # two of the rules by hand, the rest of the votes is taken as it is
        assert r["v_long_enough"] == (-1 if r["n_words"] < 10 else 1 if r["n_words"] >= 40 else 0)
        assert r["v_no_repeats"] == (-1 if r["n_repeat_words"] / max(r["n_words"], 1) > 0.2 else 0)
    seen, prior = [[r[f"v_{n}"] for n in names] for r in got], 0.85
    p = [0.2 if -1 in v else 0.95 for v in seen]
    for _ in range(200):
        rate = {}
        for j in range(len(names)):
            for cls, share in (("good", lambda x: x), ("bad", lambda x: 1 - x)):
                total = sum(share(x) for x in p) + 3
                for vote in (-1, 0, 1):
                    rate[cls, j, vote] = (sum(share(x) for x, v in zip(p, seen) if v[j] == vote) + 1) / total
        odds = {(j, v): 0.0 if v == 0 or rate["good", j, -1] >= rate["bad", j, -1] else math.log(rate["good", j, v] / rate["bad", j, v])
                for j in range(len(names)) for v in (-1, 0, 1)}
        z = [math.log(prior / (1 - prior)) + sum(odds[j, x] for j, x in enumerate(v)) for v in seen]
        before, p = p, [1 / (1 + math.exp(-x)) for x in z]
        if max(abs(a - b) for a, b in zip(p, before)) < 1e-9:
            break
    assert all(abs(r["p_good"] - x) < 1e-6 for r, x in zip(got, p))
    assert [r["kept"] for r in got] == [not r["base_failed"] and x >= 0.5 for r, x in zip(got, p)]
    assert len({r["kept"] for r in got}) == 2


def test_repeated_words_on_small_alphabets():
    rnd = random.Random(2)
    for _ in range(500):
        text = " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 40)))
        assert quality.text_statistics(text)[5] == stats_brute(text)[4]


def test_em_finds_junk_that_two_rules_see():
    """Two defect rules that agree on a tenth of the documents make them bad; the rest stays."""
    patterns = np.array([[0, 0, 1], [-1, -1, 1], [-1, 0, 1]])
    m = quality.fit(patterns, np.array([880.0, 100.0, 1.0]), ["a", "b", "c"])
    odds = m.log_odds()
    z = np.log(m.prior / (1 - m.prior)) + np.array([sum(odds[j, v + 1] for j, v in enumerate(p)) for p in patterns])
    assert z[0] > 0 > z[1]


def contamination_brute(text, items, window=13):
    w, hit, found = decontaminate.words(text), set(), set()
    for item, t in items:
        iw = decontaminate.words(t)
        k = min(window, len(iw))
        starts = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for p in range(len(w) - k + 1 if iw else 0):
            if tuple(w[p:p + k]) in starts:
                hit.update(range(p, p + k))
                found.add(str(item))
    return len(w), len(hit), len(found), sorted(found)


def test_contamination_equals_brute_force(spark, docs):
    df, rows = docs
    pieces = [(1, " ".join(rows[0][1].split()[5:40])), (2, rows[1][1][:200].upper()), (10, "one"), (11, ""), (12, None), (3, "One"), (4, "same line of, words")]
    items = spark.createDataFrame(pieces, "item_id long, text string")
    want = Counter()
    for r in rows:
        n, hit, k, found = contamination_brute(r[1], pieces)
        want[(r[0], n, hit, k, hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)] += 1
    for block_bytes in (1 << 20, 100):  # one block of items, and one for every item or two
        out = decontaminate.with_verdict(df.drop("n_words", "items"), items, block_bytes=block_bytes, with_matches=True)
        got = out.withColumn("sha", decontaminate.sha256_of_list(out.contamination["items"])).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in got) == want
        for r in got:
            for m in r.contamination["matches"]:
                w, iw = decontaminate.words(r.text), decontaminate.words(dict((str(a), b) for a, b in pieces)[m.item_id])
                assert w[m.doc_word:m.doc_word + m.n_words] == iw[m.item_word:m.item_word + m.n_words]
    assert decontaminate.with_verdict(df, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.with_verdict(corpus.empty(spark), items).count() == 0


def test_numbering_in_pieces(monkeypatch):
    text = " ".join(corpus.word(random.Random(9)) for _ in range(300)) + ",,end"
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(decontaminate.words(text)))}
    whole = decontaminate._numbered(text, known)
    monkeypatch.setattr(decontaminate, "_PIECE", 20)
    assert (decontaminate._numbered(text, known) == whole).all()


def lines_brute(rows):
    lines = []
    for key in dict.fromkeys(r[0] for r in rows):
        for r in rows:
            if r[0] == key and r[1] is not None:
                lines += [((key is None, key or 0, i), key, i, frozenset(x.split(" ")) - {""}) for i, x in enumerate(r[1].replace("\t", " ").split("\n"))]
    gone = {}
    for place, key, i, words in lines:
        if words and any(p < place and 5 * len(words & o) >= 4 * len(words | o) for p, _, _, o in lines if o):
            gone.setdefault(key, set()).add(i)
    return {k: sorted(v) for k, v in gone.items()}


def test_line_dedup_equals_brute_force(spark, docs):
    df, rows = docs
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()}
    assert got == lines_brute(rows)
    assert got
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    for r in rows:
        gone = got.get(r[0], [])
        if r[0] is not None and r[1] is not None:
            assert texts[r[0]] == "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
    assert line_dedup.summary(corpus.empty(spark)).count() == 0


def test_lines_that_share_few_words_are_not_read_again(spark, monkeypatch):
    rnd, sizes, write = random.Random(3), {}, line_dedup.written

    def counted(df, name):
        sizes[name] = (out := write(df, name)).count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    # long lines: each two share a rare word and few others, and a bitmap of 64 bits cannot tell them apart
    lines = [[f"rare{i // 2}", *(f"w{k}" for k in rnd.sample(range(5000), 299))] for i in range(200)]
    near = [["first", "of", "near", "copies", *(f"n{i}" for i in range(40))], ["first", "of", "near", "copies", *(f"n{i}" for i in range(39)), "other"]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(lines + near)] + [(999, " \t ".join(near[0])), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == lines_brute(rows) == {201: [0], 999: [0]}
    assert sizes["line-candidates"] > 100 and sizes["line-words"] < 20  # 32768 slots at least: hardly a line passes by chance


def test_marked_rows_hold_every_key(spark):
    rows = spark.range(50_000).selectExpr("id AS cls", "named_struct('a', id, 'b', if(id % 3 = 0, null, id)) AS place")
    for key in ("cls", "place"):
        keys = rows.filter("cls % 100 = 7")
        for some, most in ((keys, 1500), (keys.limit(0), 0)):
            got = {r.cls for r in line_dedup._marked(rows, key, some, 64).collect()}
            assert got >= {r.cls for r in some.collect()} and len(got) <= most


def test_lines_of_rows_that_share_an_id(spark):
    shared = "a line that stands in many of the texts"
    rows = [(1, f"{shared}\nown line of the first text"), (None, f"{shared}\nnothing like it anywhere else"), (None, "unique first words here\nsecond of them"),
            (None, "copy without any id\n\nof two lines"), (None, "copy without any id\n\nof two lines"), (None, None), (None, ""), (2, "repeated number one\nits own tail"),
            (2, "other text of number\nrepeated number one"), (2, "repeated number one\nits other end"), (3, "equal rows\nstay"), (3, "equal rows\nstay")]
    copies, docs = Counter(), []
    for d, t in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        docs.append(((d is None, d or 0, h - (1 << 64) if h >> 63 else h, copies[t] if d is None else 0), d, t))
        copies[t] += d is None
    lines = [(key, i, set(x.split())) for key, _, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    texts, sizes = Counter(), Counter()
    for key, d, t in docs:
        gone = {i for k, i, w in lines if k == key and w and any((k2, j) < (k, i) and 5 * len(w & o) >= 4 * len(w | o) for k2, j, o in lines if o)}
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        texts[d, left] += 1
        sizes[d, 0 if t is None else t.count("\n") + 1, len(gone), ",".join(map(str, sorted(gone)))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == texts
    assert Counter(tuple(r) for r in line_dedup.summary(df).collect()) == sizes
    assert texts[None, "nothing like it anywhere else"] == texts[None, "unique first words here\nsecond of them"] == texts[None, "copy without any id\n\nof two lines"] == 1


def score_brute(rows, order, backoff=0.4, min_count=2):
    import math

    texts = [(r[1] or "").encode().lower().split() for r in rows]
    c = Counter(tuple(t[i:i + n]) for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(len(t) for t in texts)
    out = Counter()
    for r, t in zip(rows, texts):
        s = 0.0
        for i in range(len(t)):
            n, factor = min(order, i + 1), 1.0
            while n > 1 and c[tuple(t[i - n + 1:i + 1])] < min_count:
                n, factor = n - 1, factor * backoff
            below = c[tuple(t[i - n + 1:i])] if n > 1 else total
            s += math.log(factor * c[tuple(t[i - n + 1:i + 1])] / below)
        out[(r[0], len(t), round(s, 4) + 0.0)] += 1
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, docs, order):
    df, rows = docs
    got = lm_score.score(df, order=order, block_bytes=3000).collect()
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 4) + 0.0) for r in got) == score_brute(rows, order)
    assert lm_score.score(corpus.empty(spark), order=order).count() == 0


def test_registered_scores_tell_longer_phrases_apart(spark, tmp_path):
    rows = [(0, "a b a c a"), (1, "a b a c a"), (2, "a c a b a")]  # the same words and pairs, other triples
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op10_lm_score_order3"](spark, str(tmp_path)).collect()}
    assert got[0] == got[1] != got[2]
    brute = score_brute(rows, 3)
    assert all((d, 5, pytest.approx(s, abs=1e-3)) in list(brute) for d, s in got.items())
