"""Sharding, url rules, token blocks, mixing, the pipeline and the registered queries."""

import os
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import corpus
from tools.check import digest
from tradewatch.llm import mixing, quality, queries, sharding, simhash, token_blocks, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = corpus.frame(spark)
    return df.cache(), rows


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, ref = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(ref.columns)
    assert digest(got) == digest(ref)


def fill(names, slots):
    """The table by turns, slot by slot."""
    import hashlib

    h = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    free = [[(h(n + ":offset") % slots + j * (h(n + ":step") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner, turn = {}, 0
    while len(owner) < slots:
        mine = free[turn % len(names)]
        owner[next(s for s in mine if s not in owner)] = names[turn % len(names)]
        turn += 1
    return owner


def test_sharding_table(spark, docs):
    df, rows = docs
    names = ["a", "b", "c", "d", "e"]
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 101).collect()}
    assert got == fill(names, 101)
    share = Counter(got.values())
    assert max(share.values()) - min(share.values()) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 101).collect()}
    moved = sum(1 for s in got if got[s] != "e" and got[s] != fewer[s])
    assert moved < 40
    out = sharding.shard(df, "doc_id", names, 101).collect()
    assert len(out) == len(rows) and all(r.shard == got[r.slot] for r in out)
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 100)
    assert sharding.shard(corpus.empty(spark), "doc_id", names, 101).count() == 0


@pytest.mark.parametrize("key", ["slot", "Shard", "_slot"])
def test_sharding_of_any_column_names(spark, key):
    keys = ["a", "b", "", None, "x" * 100_000, "a"]
    names = ["slot", "_slot", "__slot", "shard"]
    df = spark.createDataFrame([(k, 7) for k in keys], f"{key} string, other int")
    for n in names:
        if n not in [c.lower() for c in df.columns]:
            df = df.withColumn(n, F.lit(n))
    got = sharding.shard(df.select(key, *[c for c in df.columns if c != key]), key, slots=101)
    assert len(got.columns) == len({c.lower() for c in got.columns})
    plain = {r["k"]: (r["slot"], r["shard"]) for r in sharding.shard(spark.createDataFrame([(k,) for k in keys], "k string"), "k", slots=101).collect()}
    assert sorted((r["slot"], r["shard"]) for r in got.collect()) == sorted(plain[k] for k in keys)
    if "_slot" in got.columns and key != "_slot":
        assert {r["_slot"] for r in got.select("_slot").collect()} == {"_slot"}
    assert sharding.shard(df.limit(0), key, slots=101).count() == 0


def test_listed_and_mined_url_rules(spark):
    urls = ([f"http://spam.bad-{i}.net/win/{i}" for i in range(30)] + [f"https://good{i}.net/news/{i}?a=1#x" for i in range(60)]
            + ["https://A.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en/2", "https://x.com/fr/1", "https://com/de/", "https://x.com/de",
               "http://xorg/es/", "spam.bad/win", None, "", "http://", "https://good1.net/news/1?a=1#x", "http://spam.new.net/win/7"])
    pages = spark.createDataFrame([(i, u, "extra", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(i, 0 if i < 30 else 1, None if i % 2 else 0) for i in range(90)] + [(None, 0, 1), (9999, None, None)],
                                   "doc_id long, quality int, toxic int")
    out = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(out) == len(urls)
    verdict = {u: (out[i].host, out[i].path, out[i].rule, out[i].verdict) for i, u in enumerate(urls)}
    assert verdict["https://A.Example.ORG/es/1"] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert verdict["https://example.org/en/12"][2:] == ("example.org/en/1", "block")
    assert verdict["https://example.org/en/2"][2:] == ("org/", "allow")
    assert verdict["https://x.com/fr/1"][2:] == ("com/fr/", "allow") and verdict["https://com/de/"][2:] == ("com/de/", "block")
    assert verdict["https://x.com/de"] == ("x.com", "/de", None, "allow")
    assert verdict["http://xorg/es/"] == ("xorg", "/es/", None, "allow")
    for nothing in ("spam.bad/win", None, "", "http://"):
        assert verdict[nothing] == ("", "", None, "allow")
    assert verdict["http://spam.new.net/win/7"][3] == "block"  # a combination learnt from the labels
    assert all(out[i].verdict == "block" for i in range(30)) and all(out[i].verdict == "allow" for i in range(30, 90))
    assert Counter(r.verdict for r in url_filter.judge(pages, labels.limit(0)).collect())["block"] == 3
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def mined_brute(baskets, least, confidence):
    """Least token sets, of any size, that enough bad urls have and that are bad often enough."""
    every, bad = Counter(), Counter()
    for tokens, b in baskets:
        for k in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), k):
                every[items] += 1
                bad[items] += b
    rules = {frozenset(i) for i, n in every.items() if bad[i] >= least and bad[i] / n >= confidence}
    return rules, {r for r in rules if not any(r - {x} in rules for x in r)}


def test_mined_rules_of_any_size_equal_brute_force(spark):
    rnd = random.Random(6)
    urls = [(f"http://a.b/c/d?u{i}=1", True) for i in range(12)] + [("http://h.b/c/d/e", True)] * 3
    for u in ("http://a.b/c", "http://a.b/d", "http://a/c/d", "http://b/c/d"):  # three of the four tokens, each as often good
        urls += [(f"{u}?v{i}=1", False) for i in range(12)]
    for _ in range(150):
        host, segments = rnd.choice(["m.n", "m.o", "n.o"]), rnd.sample("pqrst", rnd.randrange(1, 5))
        urls.append((f"http://{host}/{'/'.join(segments)}", {"p", "q", "r"} <= set(segments) and host != "n.o" or rnd.random() < 0.3))
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    token = {r.url: set(r.t) for r in table.select("url", url_filter.tokens("url").alias("t")).collect()}
    every, least = mined_brute([(token[u], b) for u, b in urls], 10, 0.6)
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, (_, b) in enumerate(urls)], "doc_id long, quality int, toxic int")
    mined = url_filter.mine(spark.createDataFrame(urls, "url string, bad boolean")).collect()
    assert Counter(frozenset(r["items"]) for r in mined) == Counter(least)
    assert frozenset({"h:a", "h:b", "p:c", "p:d"}) in least and max(map(len, least)) > 3
    for r in url_filter.judge(table, labels, rules=()).collect():
        assert r.verdict == ("block" if any(x <= token[r.url] for x in every) else "allow")


def test_blocks_round_trip_and_ranges():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 4096, 4097, 9000):
        for hi in (0, 1, 300, 50000, 2**32 - 1):
            ids = rng.integers(0, hi, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
            if n > 10:
                ids[3] = 2**32 - 1  # an outlier for the exception list
            starts, payload = token_blocks.pack(ids)
            assert (token_blocks.unpack(starts, payload) == ids).all()
            assert (token_blocks.unpack(starts, payload, 5, 4100) == ids[5:4100]).all()


def test_token_files_equal_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    df, rows = docs
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    path = token_blocks.fresh_path(spark, "tokens-test")
    token_blocks.write(df, path, queries.tokenizer_path())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_blocks.digests(spark, path).collect())
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    stream = token_blocks.read_ids(spark, path, 0, 1 << 40)
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter(r[1:] for r in got) == want
    at = 0
    for start, _, n, crc in got:
        assert start == at and zlib.crc32(stream[at:at + n].astype("<u4").tobytes()) == crc
        at += n
    assert at == len(stream) and (token_blocks.read_ids(spark, path, 100, 5000) == stream[100:5000]).all()
    assert token_blocks.encode_and_read_back(corpus.empty(spark), queries.tokenizer_path()).count() == 0


def test_encoder_table_starts_afresh():
    e = token_blocks.Encoder(queries.tokenizer_path(), known_words=20)
    for t in corpus.texts(seed=11, n=30):
        assert e.encode([t or ""])[0].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_are_encoded_whole(tmp_path):
    """The fast path stands for one normalizer and one split; any other file goes to its tokenizer."""
    import json

    from tokenizers import Tokenizer

    with open(queries.tokenizer_path()) as f:
        spec = json.load(f)
    assert token_blocks.Encoder(queries.tokenizer_path()).by_piece
    cased = {**spec, "normalizer": {"type": "Sequence", "normalizers": spec["normalizer"]["normalizers"][:2]}}
    joined = {**spec, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {**spec["pre_tokenizer"]["pretokenizers"][0], "pattern": {"Regex": r"\S+"}}, spec["pre_tokenizer"]["pretokenizers"][1]]}}
    mark = {"id": 49408, "content": "world", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    marked = {**spec, "added_tokens": [*spec["added_tokens"], mark]}
    texts = ["Hello World", "it's 42 words, isn't it?", "", "hello world again"]
    for i, other in enumerate((cased, joined, marked, {**spec, "normalizer": None})):
        path = tmp_path / f"t{i}.json"
        path.write_text(json.dumps(other))
        coder, plain = token_blocks.Encoder(str(path)), Tokenizer.from_file(str(path))
        assert not coder.by_piece
        assert [x.tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def water_fill(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = water_fill(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in mine)
        assert all(r.taken <= 2 * r.size and r.taken == r.times * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
    again = mixing.mix(df.repartition(3), buckets=8).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    copies = Counter(r.doc_id for r in mixing.repeated(mixing.mix(df)).collect())
    times = Counter()
    for r in got:
        times[r.doc_id] += r.times
    assert copies == +times
    assert mixing.mix(corpus.empty(spark)).count() == 0
    nothing = mixing.mix(df.withColumn("text", df.lang.substr(1, 0))).collect()
    assert all(r.size == r.taken == 0 and r.target == 0 for r in nothing)


def test_mixing_agrees_on_rows_without_an_id_and_takes_any_names(spark):
    rows = [(None, f"word{i} and two more", "s", i, 7) for i in range(40)] + [(3, f"text {i}", "s", i, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _u int, _p_target int")
    a, b = (Counter((r.text, r._u, r._p_target, r.taken) for r in mixing.mix(d, share=0.5).collect()) for d in (df.repartition(7), df.coalesce(1)))
    assert a == b and {k[3] for k in a} >= {0}
    assert mixing.mix(df).columns == ["doc_id", "text", "source", "_u", "_p_target", "size", "source_size", "target", "times", "taken"]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_pipeline_stages_are_the_operators(spark):
    """Each stage against what its operator's brute force says of the rows before it."""
    from tests.llm.test_llm_texts import components_brute, contamination_brute, fp_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_id_output"]
    out = stages["quality_rules"](spark, docs, SF)
    assert out.columns == docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    failed = {r.doc_id for r in quality.judge(docs).filter("base_failed").collect()}
    clean = {d for d, x in labels.items() if x.quality == 1 and d not in failed}
    assert kept.isdisjoint(failed) and clean <= kept and len(kept) < len(before)
    out = spark.createDataFrame(out.collect(), docs.schema)
    rows = out.collect()
    out = stages["simhash_near_dedup"](spark, out, SF)
    assert {r.doc_id for r in out.collect()} == {c for _, _, c in components_brute([(r.doc_id, fp_brute(r.text)) for r in rows])}
    out = spark.createDataFrame(out.collect(), docs.schema)
    clean = set()
    for r in out.collect():
        n, hit, _, _ = contamination_brute(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    out = stages["benchmark_decontamination"](spark, out, SF)
    assert {r.doc_id for r in out.collect()} == clean
    out = spark.createDataFrame(out.collect(), docs.schema)
    mixed = stages["source_mixing"](spark, out, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= clean
    last = stages["token_id_output"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mixed.collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, last))


def test_near_dedup_stage_writes_no_table_by_way_of_a_broadcast(spark, docs, monkeypatch):
    df, rows = docs
    plans = {}

    def seen(df, name, written=simhash.written):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr("tradewatch.llm.components.written", seen)
    kept = corpus_pipeline.simhash_near_dedup(spark, df, SF)
    assert 0 < kept.count() < len(rows)
    assert {"met", "edges", "members"} <= set(plans) and not [n for n, ps in plans.items() if "Broadcast" in "".join(ps)]


def test_simhash_of_unlabelled_links_is_validated(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 5)
