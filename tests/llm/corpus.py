"""A small corpus with the awkward cases every operator must take: NULLs in any column, empty,
short and long texts, ties, repeated rows, near copies, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, shard string, fp long, n_words long, size long, target string, kept string, removed string, items string, host string"


def word(rnd):
    return "".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(2, 8)))


def texts(seed=7, n=60):
    rnd = random.Random(seed)
    passages = [" ".join(word(rnd) for _ in range(k)) for k in (70, 110, 160)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word(rnd) for _ in range(rnd.randrange(1, 90))))
        text = rnd.choice([" ", "\n"]).join(parts)
        if out and rnd.random() < 0.4:
            w = rnd.choice(out).split(" ")
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = word(rnd)
            text = " ".join(w)
        out.append(text)
    return out + ["", None, " \t\n", "one", "two words", "x" * 399, "y" * 401, "z" * 1300, "ab " * 600, out[0], out[0],
                  "\n".join(["same line of words here"] * 5), "A!! B!! " * 40, "it's 12,5 <|endoftext|> ﬁ 漢字 \x1c ½"]


def frame(spark, seed=7, n=60):
    ts = texts(seed, n)
    rows = [(i, t, "en", ["s1", "s2", "é", None][i % 4], len(t or ""), 1, "x", 5, 6, 7, "t", "k", "r", "i", "h") for i, t in enumerate(ts)]
    rows += [rows[3], rows[3], (None, "text without an id " * 20, None, None, None, None, None, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
