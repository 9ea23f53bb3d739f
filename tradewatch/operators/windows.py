"""Window operators that stay correct and parallel when one key holds a large share of rows.

A plain ``Window.partitionBy(account)`` sends all rows of an account to one task. The
operators here add a *time slice* to the partition key:

* ``rolling`` (D9): RANGE frames (count/sum/avg/stddev/min/max over the last N seconds).
  Each row is also copied, as context, into the later slices whose rows can look back to
  it; frames are evaluated per (keys, slice) and the context rows dropped. Exact for any
  frame up to the context length, with duplication ``frame / slice`` of the input.
* ``rolling_partials`` (D9, D12): the same frames from mergeable partials. A frame is the rows of
  its own time bucket so far, the whole buckets before it, and the tail of the bucket where it
  starts; each part costs time in proportion to its rows, however many rows a frame holds.
* ``sequence_index``: the global 1-based position of each row within its key (ROWS
  frames need positions). Positions are assembled from per-slice counts, so the only
  per-key sort is over slice summaries.
* ``rows_count_flag`` / ``rows_last_non_null``: ROWS-N-PRECEDING frames computed from
  prefix sums and index look-ups (equi-joins on a unique (key, position)).
* ``latest_by`` (D8): newest row per key as a group limit, which every task applies before the
  exchange, so a hot key never lands whole in one task.
* ``latest_by_stored`` (D8): the same rows from a written table, which is read twice so that only
  hashes of the keys, and whole rows of repeated keys alone, are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewatch.functions.timefn import epoch_micros
from tradewatch.operators.joins import explode_slices
from tradewatch.session import checkpoint_dir

DAY_US = 86_400_000_000


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
              keep_null_keys: bool = False) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order`` tuple.

    NULLs in an order field sort lowest, so a row with an unparsable time never wins over
    a row with a time. ``row_number() = 1`` is a group limit: every task keeps one row per
    key before the exchange, so a hot key brings one row from each task.
    """
    ordc = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    src = df if keep_null_keys else df.filter(_all_not_null(keys))
    w = Window.partitionBy(*keys).orderBy(*ordc)
    return src.withColumn("_newest", F.row_number().over(w)).filter("_newest = 1").drop("_newest")


def latest_by_stored(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``latest_by`` for rows that come straight from a written table and can be read again.

    Hashes of the keys that occur twice or more are written first. Their size is then known: a small
    table of them is broadcast, and rows whose key occurs once are not shuffled at all; a large one
    takes a shuffled join. Different keys that share a hash only go through the window together.
    """
    src = df.filter(_all_not_null(keys)).withColumn("_key", F.xxhash64(*keys))
    path = checkpoint_dir(df.sparkSession, "repeated-keys")
    src.groupBy("_key").count().filter("count > 1").select("_key").write.parquet(path)
    repeated = df.sparkSession.read.schema("_key long").parquet(path)
    newest = latest_by(src.join(repeated, "_key", "left_semi"), keys, order)
    return src.join(repeated, "_key", "left_anti").unionByName(newest).drop("_key")


def _all_not_null(keys: Sequence[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull()
    return c


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    specs: dict[str, tuple[Column, int]],
    slice_us: int | None = None,
) -> DataFrame:
    """Add one column per ``specs[name] = (aggregate, frame_us[, post])``, evaluated over
    ``RANGE BETWEEN frame PRECEDING AND CURRENT ROW`` ordered by ``ts`` within ``keys``;
    ``post`` (optional) maps the windowed value (e.g. ``F.size`` of a ``collect_set``).

    Peers (equal ``ts``) are inside each other's frame, as in SQL RANGE frames. Frames
    sharing the partition/order share one sort (one Window node).
    """
    max_frame = max(spec[1] for spec in specs.values())
    slice_us = int(slice_us or max(4 * max_frame, DAY_US))
    t = "_rt_us"
    base = df.withColumn(t, epoch_micros(ts))
    x = explode_slices(base, F.col(t), slice_us, max_frame)
    w = Window.partitionBy(*keys, "_slice").orderBy(t)
    out = x
    for name, spec in specs.items():
        agg, frame = spec[0], spec[1]
        col = agg.over(w.rangeBetween(-int(frame), 0))
        if len(spec) > 2:
            col = spec[2](col)
        out = out.withColumn(name, col)
    return out.filter(~F.col("_ctx")).drop("_ctx", "_slice", t)


class _Measure:
    """One mergeable partial: its columns over rows, over partials of whole buckets, and the value of merged parts."""

    def __init__(self, kind: str, value: str):
        self.kind, self.value = kind, value

    def partial(self, keep: Column) -> Column:
        """Aggregate of the rows for which ``keep`` holds."""
        x = F.when(keep, F.col(self.value))
        if self.kind == "count":
            return F.count(x)
        if self.kind in ("sum", "min", "max"):
            return getattr(F, self.kind)(x)
        if self.kind == "distinct":
            return F.collect_set(x)
        raise ValueError(f"no such measure: {self.kind}")

    def over_buckets(self, part: str, w) -> Column:
        """Aggregate of the partials ``part`` of the buckets in the window ``w``."""
        if self.kind in ("distinct", "moments"):
            every = F.flatten(F.collect_list(part).over(w))
            return F.array_distinct(every) if self.kind == "distinct" else every
        return getattr(F, {"count": "sum"}.get(self.kind, self.kind))(part).over(w)

    def merged(self, parts: list[Column]) -> Column:
        if self.kind == "count":
            return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0).cast("long"))
        if self.kind == "sum":
            some = F.coalesce(*parts)
            return F.when(some.isNotNull(), sum((F.coalesce(p, F.lit(0) * some) for p in parts[1:]), F.coalesce(parts[0], F.lit(0) * some)))
        if self.kind in ("min", "max"):
            return (F.least if self.kind == "min" else F.greatest)(*parts) if len(parts) > 1 else parts[0]
        return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])) if len(parts) > 1 else parts[0]


def _deviation(parts: list[Column]) -> Column:
    """Sample standard deviation of merged (n, mean, m2) triples; equal values give 0 up to the rounding of their means."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<n:bigint,mean:double,m2:double>>")) for p in parts]))
    return F.aggregate(every, zero, merge, lambda t: F.when(t["n"] > 1, F.sqrt(t["m2"] / (t["n"] - 1))))


#: value of each kind from its partials
_NEEDS = {"count": ("count",), "sum": ("sum",), "min": ("min",), "max": ("max",), "distinct": ("distinct",), "avg": ("sum", "count"), "stddev": ("moments",)}


def rolling_partials(df: DataFrame, keys: Sequence[str], ts: str, specs: dict[str, tuple[str, Column, int]], bucket_us: int) -> DataFrame:
    """Add one column per ``specs[name] = (kind, value, frame_us)``: ``kind`` (count, sum, avg, stddev, min, max,
    distinct) of ``value`` over ``RANGE BETWEEN frame PRECEDING AND CURRENT ROW`` by ``ts`` within ``keys``, peers
    included. Every frame must be a multiple of ``bucket_us``.

    A frame of m buckets that ends at time t in bucket b has three parts:

    * rows of b up to t: a running frame over (keys, b);
    * the buckets b - m + 1 to b - 1: a frame over the partials of the buckets (one row per key and bucket);
    * rows of b - m from t - frame on: they are copied into b at their time plus the frame, where they are a
      running frame from the other end.

    Running frames add row by row, so the cost grows with the rows and not with rows times rows in a frame; one key's rows
    are spread over its buckets. Counts, sums, minimums and value sets add up; the standard deviation is merged from
    (n, mean, m2). Rows without a time are in each other's frames only; NULL values count nowhere.
    """
    frames = sorted({f for _, _, f in specs.values()})
    if any(f % bucket_us for f in frames):
        raise ValueError("every frame must be a multiple of bucket_us")
    t, b, role = "_rp_t", "_rp_bucket", "_rp_role"
    values: dict[str, str] = {}
    for kind, value, _ in specs.values():
        values.setdefault(str(value), f"_rp_v{len(values)}")
    named = {values[str(value)]: value for _, value, _ in specs.values()}
    needed = {}  # (measure, value) -> frames
    for kind, value, frame in specs.values():
        for m in _NEEDS[kind]:
            needed.setdefault((m, values[str(value)]), set()).add(frame)

    base = df.select("*", *[c.alias(n) for n, c in named.items()], epoch_micros(ts).alias(t))
    base = base.withColumn(b, F.floor(F.col(t) / F.lit(bucket_us)).cast("long"))

    def moments(value: str, keep: Column, over) -> Column:
        x = F.when(keep, F.col(value))
        triple = F.struct(over(F.count(x)).alias("n"), F.coalesce(over(F.avg(x)), F.lit(0.0)).alias("mean"),
                          F.coalesce(over(F.var_pop(x)) * over(F.count(x)), F.lit(0.0)).alias("m2"))
        return F.array(triple)

    # a row once as itself (role 0) and once for each frame, moved into the bucket where that frame ends
    copies = F.explode(F.concat(F.array(F.struct(F.lit(0).alias(role), F.col(t).alias("_rp_at"))), F.when(F.col(t).isNotNull(), F.array(
        *[F.struct(F.lit(i).alias(role), (F.col(t) + F.lit(f)).alias("_rp_at")) for i, f in enumerate(frames, 1)])).otherwise(F.array())))
    others = [c for c in df.columns if c not in keys]
    x = base.select("*", copies.alias("_rp_c")).select(*keys, *named, F.col(f"_rp_c.{role}").alias(role), F.col("_rp_c._rp_at").alias(t),
                                                       *[F.when(F.col(f"_rp_c.{role}") == 0, F.col(c)).alias(c) for c in others])
    x = x.withColumn(b, F.floor(F.col(t) / F.lit(bucket_us)).cast("long"))
    so_far = Window.partitionBy(*keys, b).orderBy(F.col(t)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy(*keys, b).orderBy(F.col(t).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own, edge, mid = {}, {}, {}
    cols = []
    for k, ((m, v), needs) in enumerate(needed.items()):
        for r, name, w in [(0, f"_rp_o{k}", so_far), *((frames.index(f) + 1, f"_rp_e{k}_{f}", from_here) for f in sorted(needs))]:
            keep = F.col(role) == r
            cols.append((moments(v, keep, lambda c, w=w: c.over(w)) if m == "moments" else _Measure(m, v).partial(keep).over(w)).alias(name))
            if r == 0:
                own[m, v] = name
            else:
                edge[m, v, frames[r - 1]] = name
    x = x.select("*", *cols).filter(F.col(role) == 0)

    if frames[-1] > bucket_us:
        every = F.lit(True)
        parts = base.filter(F.col(t).isNotNull()).groupBy(*keys, b).agg(*[(moments(v, every, lambda c: c) if m == "moments" else _Measure(m, v).partial(every)).alias(f"_rp_p{k}")
                                             for k, (m, v) in enumerate(needed)])
        for k, ((m, v), needs) in enumerate(needed.items()):
            for f in sorted(needs):
                if f > bucket_us:
                    w = Window.partitionBy(*keys).orderBy(b).rangeBetween(1 - f // bucket_us, -1)
                    mid[m, v, f] = f"_rp_m{k}_{f}"
                    parts = parts.withColumn(mid[m, v, f], _Measure(m, v).over_buckets(f"_rp_p{k}", w))
        parts = parts.select(*[F.col(c).alias(f"_rp_k{i}") for i, c in enumerate([*keys, b])], *mid.values())
        same = F.lit(True)
        for i, c in enumerate([*keys, b]):
            same = same & F.col(c).eqNullSafe(F.col(f"_rp_k{i}"))
        x = x.join(parts, same, "left")

    out = []
    for name, (kind, value, f) in specs.items():
        v = values[str(value)]
        found = [[F.col(c) for c in (own[m, v], mid.get((m, v, f)), edge[m, v, f]) if c] for m in _NEEDS[kind]]
        if kind == "stddev":
            col = _deviation(found[0])
        elif kind == "avg":
            col = F.try_divide(_Measure("sum", v).merged(found[0]), F.nullif(_Measure("count", v).merged(found[1]), F.lit(0)))
        else:
            col = _Measure(kind, v).merged(found[0])
            col = F.size(col).cast("long") if kind == "distinct" else col
        out.append(col.alias(name))
    return x.select(*df.columns, *out)


def sequence_index(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str],
    prefix_cols: Sequence[str] = (),
    slice_us: int = DAY_US,
    idx_col: str = "_idx",
) -> DataFrame:
    """Global position (1-based) of each row in ``keys`` ordered by (ts, *tiebreak), plus
    running sums ``_cum_<c>`` of ``prefix_cols`` (inclusive), without a whole-key sort."""
    t = epoch_micros(ts)
    base = df.withColumn("_slice", F.floor(t / F.lit(slice_us)).cast("long"))
    w_in = Window.partitionBy(*keys, "_slice").orderBy(F.col(ts), *[F.col(c) for c in tiebreak])
    run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = base.withColumn("_rn", F.row_number().over(w_in))
    for c in prefix_cols:
        x = x.withColumn(f"_in_{c}", F.sum(F.col(c)).over(run))
    # slice totals come from the input, not from the windowed rows (no second window pass)
    stats = base.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c)).alias(f"_tot_{c}") for c in prefix_cols]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_n_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    for c in prefix_cols:
        stats = stats.withColumn(f"_before_{c}", F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)))
    stats = stats.drop("_n", *[f"_tot_{c}" for c in prefix_cols])
    y = x.join(stats, on=[*keys, "_slice"], how="inner")
    y = y.withColumn(idx_col, (F.col("_n_before") + F.col("_rn")).cast("long"))
    for c in prefix_cols:
        y = y.withColumn(f"_cum_{c}", F.col(f"_before_{c}") + F.col(f"_in_{c}"))
    return y.drop("_rn", "_n_before", *[f"_in_{c}" for c in prefix_cols],
                  *[f"_before_{c}" for c in prefix_cols])


def _pinned(df: DataFrame, materialize: bool) -> DataFrame:
    """The input of the ROWS-frame operators is read three times (positions, slice totals,
    look-back join); a reliable checkpoint computes it once (shared checkpoint folder)."""
    if not materialize:
        return df
    from tradewatch.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_sum(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], value: str,
    preceding: int, out: str, slice_us: int = DAY_US, materialize: bool = True,
) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY ts, tiebreak ROWS preceding PRECEDING
    AND CURRENT ROW)`` as prefix(i) - prefix(i - preceding - 1)."""
    df = _pinned(df, materialize)
    x = sequence_index(df, keys, ts, tiebreak, prefix_cols=[value], slice_us=slice_us)
    cum = f"_cum_{value}"
    back = x.select(*keys, (F.col("_idx") + F.lit(preceding + 1)).alias("_idx"),
                    F.col(cum).alias("_cum_back"))
    y = x.join(back, on=[*keys, "_idx"], how="left")
    y = y.withColumn(out, F.col(cum) - F.coalesce(F.col("_cum_back"), F.lit(0)))
    return y.drop(cum, "_cum_back", "_idx", "_slice")


def rows_last_non_null(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], value: str,
    preceding: int, out: str, slice_us: int = DAY_US, materialize: bool = True,
) -> DataFrame:
    """``LAST_VALUE(value IGNORE NULLS) OVER (... ROWS preceding PRECEDING AND CURRENT ROW)``.

    The position of the latest non-null row at or before each row is a running max,
    assembled from per-slice maxima; its value is fetched by an equi-join on (key, position).
    """
    df = _pinned(df, materialize)
    x = sequence_index(df, keys, ts, tiebreak, slice_us=slice_us)
    x = x.withColumn("_nn", F.when(F.col(value).isNotNull(), F.col("_idx")))
    w_in = (Window.partitionBy(*keys, "_slice").orderBy("_idx")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_nn_in", F.max("_nn").over(w_in))
    per_slice = x.groupBy(*keys, "_slice").agg(F.max("_nn").alias("_nn_slice"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("_nn_before", F.max("_nn_slice").over(before)).drop("_nn_slice")
    x = x.join(per_slice, on=[*keys, "_slice"], how="inner")
    x = x.withColumn("_last_nn", F.coalesce(F.col("_nn_in"), F.col("_nn_before")))
    vals = x.filter(F.col("_nn").isNotNull()).select(
        *keys, F.col("_idx").alias("_last_nn"), F.col(value).alias("_v_back"))
    y = x.join(vals, on=[*keys, "_last_nn"], how="left")
    y = y.withColumn(out, F.when(F.col("_idx") - F.col("_last_nn") <= preceding, F.col("_v_back")))
    return y.drop("_nn", "_nn_in", "_nn_before", "_last_nn", "_v_back", "_idx", "_slice")


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "_rownum") -> DataFrame:
    """1-based position of every row in the total order ``order`` (a distributed
    zipWithIndex): a range-partitioned sort, per-partition row counts (one small row per
    partition), their running offsets, and offset + position inside the partition.

    No step moves all rows into one task. The sorted frame is checkpointed (reliable
    checkpoint folder) so that the partition ids used for the counts and for the rows are
    the same ones, also after an executor loss.
    """
    from tradewatch.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    ordc = [F.col(c) if isinstance(c, str) else c for c in order]
    mid = F.monotonically_increasing_id()
    s = df.orderBy(*ordc).withColumn("_mid", mid).checkpoint(eager=True)
    s = s.withColumn("_part", F.shiftright(F.col("_mid"), 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # one row per partition: a size bound independent of the data volume
    r = s.join(F.broadcast(offsets), on="_part", how="inner")
    return r.withColumn(out, (F.col("_off") + F.col("_pos") + F.lit(1)).cast("long")).drop(
        "_mid", "_part", "_pos", "_off")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          salt_buckets: int = 16, salt_col: str | None = None, rank_col: str = "_rank") -> DataFrame:
    """The first ``k`` rows per ``keys`` in ``order`` (1-based ``rank_col``).

    Two phases so a key with very many rows is never sorted whole in one task: the top ``k``
    per (keys, salt) first (``salt`` = hash of ``salt_col`` or of the row), then the top
    ``k`` of those at most ``k * salt_buckets`` candidates per key.
    """
    h = F.xxhash64(F.col(salt_col)) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns])
    x = df.withColumn("_salt", F.pmod(h, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    x = x.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return x.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
