"""Quality rules as weak supervision.

Every document gets a few statistics of its whole text. Rules turn them into votes: 1 (good),
-1 (bad) or 0 (abstain). Expectation-maximisation over the counts of all vote patterns
estimates how often each rule is right on good and on bad documents; the posterior probability of "good" decides, in place of "all rules must pass".

Work at scale: the statistics are one narrow pass (Arrow batches, no shuffle). EM sees one row per *vote pattern*, at most 3 ** number of rules whatever the input; this
count table is the only thing that reaches the driver. The posterior is a sum of per-rule log
odds, evaluated as a Spark expression, so nothing is joined.

Defined results: NULL and empty texts have no words, fail the base check and are not kept.
Repeated rows are judged alike, each on its own. Extra columns pass through; columns of the
input that share a name with an added column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.llm.common import written

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
           "n_distinct_words", "n_upper_words", "n_shout_words", "n_symbol_words")
_SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS])


def _repeated_words(ids: np.ndarray, n: int, width: int) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text. Windows
    are renumbered densely while they grow, so that equal codes mean equal windows."""
    if len(ids) <= width:
        return 0
    code, size = ids, n
    for step in range(1, width):
        code = code[:-1] * n + ids[step:]
        if size > 2**31 or step == width - 1 or size * n * n > 2**62:
            code = np.unique(code, return_inverse=True)[1]
            size = len(code)
        else:
            size *= n
    at = np.flatnonzero(np.bincount(code)[code] > 1)
    if not len(at):
        return 0
    return int(width + np.minimum(np.diff(at), width).sum())


def text_statistics(text: str | None, width: int = 5) -> tuple[int, ...]:
    """The statistics of one text, in the order of the fields above."""
    if not text:
        return (0,) * len(_FIELDS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    upper = shout = marked = 0
    counts = np.bincount(ids, minlength=len(known)) if n else ids
    for w, i in known.items():
        if w.isupper() and len(w) > 1:
            upper += int(counts[i])
        if w.endswith(b"!!"):
            shout += int(counts[i])
        if len(w.translate(None, SYMBOLS)) < len(w):
            marked += int(counts[i])
    return (n, len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), _repeated_words(ids, len(known), width), len(known), upper, shout, marked)


@F.arrow_udf(_SCHEMA)
def _statistics(text: pa.Array) -> pa.Array:
    rows = np.array([text_statistics(t.as_py()) for t in text], np.int64).reshape(-1, len(_FIELDS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(_FIELDS))


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the text statistics and ``base_failed`` appended."""
    out = df.drop(*[f for f in _FIELDS if f != text_col]).withColumn("_stats", _statistics(F.col(text_col)))
    out = out.select(*[c for c in out.columns if c != "_stats"], "_stats.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad`` (for ``rising``: below it) and good at or below ``good`` (at or
    above); abstains between. A rule without ``good`` only looks for a defect: its absence says
    nothing about the other defects, so it abstains then."""

    name: str
    bad: float
    good: float | None = None
    rising: bool = False

    def vote(self, value: Column) -> Column:
        out = F.when(value < self.bad if self.rising else value > self.bad, -1)
        if self.good is not None:
            out = out.when(value >= self.good if self.rising else value <= self.good, 1)
        return out.otherwise(0).cast("tinyint")


def _per(c: str, total: str = "n_words") -> Column:
    return F.col(c) / F.greatest(F.col(total), F.lit(1))


#: (rule, measured value); thresholds are words, or ratios to the words or lines of the text.
RULES: tuple[tuple[Rule, object], ...] = (
    (Rule("long_enough", 10, 40, rising=True), lambda: F.col("n_words")),
    (Rule("rich_words", 0.15, 0.3, rising=True), lambda: _per("n_distinct_words")),
    (Rule("words_short", 14.0), lambda: _per("word_chars")),
    (Rule("words_long", 2.0, rising=True), lambda: _per("word_chars")),
    (Rule("few_symbols", 0.35), lambda: _per("n_symbols")),
    (Rule("unmarked_words", 0.3), lambda: _per("n_symbol_words")),
    (Rule("lines_differ", 0.5), lambda: _per("n_dup_lines", "n_lines")),
    (Rule("no_repeats", 0.2), lambda: _per("n_repeat_words")),
    (Rule("not_upper", 0.4), lambda: _per("n_upper_words")),
    (Rule("no_shouting", 0.2), lambda: _per("n_shout_words")),
)


def votes() -> list[Column]:
    return [rule.vote(value()).alias(f"v_{rule.name}") for rule, value in RULES]


@dataclass
class LabelModel:
    """``bad[j][v + 1]`` and ``good[j][v + 1]``: how often rule j votes v (-1, 0, 1) on bad and
    on good documents, so its accuracies are ``bad[j][0]`` and ``good[j][2]``; ``prior``: share
    of good documents."""

    names: list[str]
    prior: float
    good: np.ndarray
    bad: np.ndarray

    def log_odds(self) -> np.ndarray:
        """Per rule and vote. 0 for an abstention, which is no evidence, and for a rule that
        says bad more often on good documents than on bad ones."""
        odds = np.log(self.good / self.bad)
        odds[:, 1] = 0.0
        odds[self.good[:, 0] >= self.bad[:, 0]] = 0.0
        return odds

    def posterior(self) -> Column:
        """Probability of "good" from the vote columns."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (down, none, up) in zip(self.names, self.log_odds().tolist()):
            v = F.col(f"v_{name}")
            z = z + F.when(v > 0, up).when(v < 0, down).otherwise(none)
        return 1 / (1 + F.exp(-z))


def fit(patterns: np.ndarray, counts: np.ndarray, names: list[str], prior: float = 0.85, steps: int = 200,
        tol: float = 1e-9) -> LabelModel:
    """EM over vote patterns (one row each) and their counts. It starts from "a document with a
    bad vote is bad with probability 0.8, any other with 0.05", which also fixes which of the
    two classes is the bad one; every rate is smoothed by one document per vote and class."""
    k = len(names)
    if not len(counts):
        return LabelModel(names, prior, np.full((k, 3), 1 / 3), np.full((k, 3), 1 / 3))
    is_vote = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    p = np.where((patterns < 0).any(axis=1), 0.2, 0.95)
    for _ in range(steps):
        good, bad = (np.einsum("n,njv->jv", counts * w, is_vote) + 1 for w in (p, 1 - p))
        m = LabelModel(names, prior, good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True))
        z = math.log(prior / (1 - prior)) + np.einsum("njv,jv->n", is_vote, m.log_odds())
        before, p = p, 1 / (1 + np.exp(-z))
        if np.abs(p - before).max() < tol:
            break
    return m


def judge(df: DataFrame, text_col: str = "text", threshold: float = 0.5, prior: float = 0.85,
          drop_text: bool = False) -> DataFrame:
    """``df`` with the statistics, ``base_failed``, one vote column per rule, ``p_good`` and
    ``kept`` (base check passed and ``p_good >= threshold``). With ``drop_text`` the statistics are
    written once; otherwise they are computed for the fit and again for the verdict, which is
    cheaper than a second copy of all texts."""
    names = [r.name for r, _ in RULES]
    drop = [f"v_{n}" for n in names] + ["p_good", "kept"]
    stats = with_statistics(df.drop(*[c for c in drop if c != text_col]), text_col)
    stats = stats.select("*", *votes())
    if drop_text:
        stats = written(stats.drop(text_col), "quality")
    cols = [f"v_{n}" for n in names]
    # at most 3 ** len(RULES) rows, whatever the size of the input
    seen = stats.groupBy(*cols).count().collect()
    model = fit(np.array([[r[c] for c in cols] for r in seen], np.int64).reshape(-1, len(cols)),
                np.array([r["count"] for r in seen], float), names, prior)
    judged = stats.withColumn("p_good", model.posterior())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
