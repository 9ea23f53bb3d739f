"""Join operators Catalyst does not plan well on its own.

* ``either_key_join`` (D1): ``ON (l.a = r.k OR l.b = r.k) AND l.c = r.c`` would be planned
  as an equi-join on ``c`` alone with the OR as a residual (a near cross product per chain).
  Exploding the distinct candidate keys turns it into one equi-join; the keys that a sketch finds
  frequent are dealt to several tasks.
* ``interval_join`` (D2): band joins ``lo <= r.t - l.t <= hi`` become an equi-join on
  (keys, time bucket) plus an exact residual filter; the bucket also splits hot keys.
* ``asof_join``: latest right row at or before each left row within a tolerance, computed
  by a time-sliced union + ``last(ignorenulls)`` instead of a fan-out join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewatch.functions.timefn import epoch_micros

DAY_US = 86_400_000_000

#: Tasks to which the rows of a frequent address are dealt.
HOT_COPIES = 32


def either_key_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_key: str,
    on_also: Sequence[str] = (),
    how: str = "inner",
    match_col: str = "_match_key",
    hot_copies: int = 0,
    sketch_of: DataFrame | None = None,
) -> DataFrame:
    """``left JOIN right ON (left.k1 = right.key OR left.k2 = ...) AND left.x = right.x``.

    One output row per (left row, right row) pair, exactly as the OR join gives: the
    candidate keys of a left row are de-duplicated first, so a right row that equals both
    ends matches once. ``how='left'`` adds unmatched left rows once (null right columns).
    The matched key is kept in ``match_col``. ``hot_copies`` above 1 deals the left rows of
    frequent keys to that many tasks (``deal_hot_keys``); the rows are the same. The keys are sketched
    on ``left``, or on ``sketch_of`` where ``left`` is dear to compute twice.
    """
    cand = F.array_distinct(F.array(*[F.col(k) for k in left_keys]))

    def ends(df: DataFrame) -> DataFrame:
        return df.withColumn(match_col, F.explode(cand)).filter(F.col(match_col).isNotNull())

    exploded = ends(left)
    r = right.withColumnRenamed(right_key, match_col)
    join_cols = [match_col, *on_also]
    if hot_copies > 1:
        dealt, copied = deal_hot_keys(exploded, r, match_col, hot_copies, ends(sketch_of) if sketch_of is not None else exploded)
        inner = dealt.join(copied, on=[*join_cols, "_salt"], how="inner").drop("_salt")
    else:
        inner = exploded.join(r, on=join_cols, how="inner")
    if how == "inner":
        return inner
    if how != "left":
        raise ValueError("either_key_join supports how='inner' or 'left'")
    # left rows without any match: flag each candidate key against the distinct right keys
    # (no row identity needed), keep rows where no flag is set, pad the right columns
    rk = r.select(*join_cols).distinct()
    flagged = left
    flags = []
    for i, k in enumerate(left_keys):
        f = f"_em{i}"
        flags.append(f)
        flagged = flagged.join(
            rk.withColumnRenamed(match_col, k).withColumn(f, F.lit(True)),
            on=[k, *on_also], how="left",
        )
    none = F.lit(True)
    for f in flags:
        none = none & F.col(f).isNull()
    unmatched = flagged.filter(none).drop(*flags)
    for c in inner.columns:
        if c not in unmatched.columns:
            unmatched = unmatched.withColumn(c, F.lit(None).cast(inner.schema[c].dataType))
    return inner.unionByName(unmatched.select(*inner.columns))


def frequent_keys(df: DataFrame, key: str, share: int, tracked: int = 4096) -> Column:
    """The keys that at least one in ``share`` rows of ``df`` have, as an array in a one-row subquery.

    A frequent-items sketch of ``tracked`` counters is built per task and merged, so the keys are never
    shuffled or counted one by one. Every key above the share is in it (for ``share`` well below
    ``tracked``); one slightly below may be too, so use it where a wrong guess costs time, not results.
    """
    top = df.agg(F.expr(f"approx_top_k({key}, {int(share)}, {int(tracked)})").alias("top"), F.count(key).alias("n"))
    often = F.filter("top", lambda t: t["count"] * F.lit(int(share)) >= F.col("n"))
    return top.select(F.transform(often, lambda t: t["item"])).scalar()


def deal_hot_keys(left: DataFrame, right: DataFrame, key: str, copies: int, sketched: DataFrame,
                  share: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``, a further join column: left rows of a key that one in ``share`` rows of ``sketched``
    has are dealt by a hash of the row to ``copies`` salts, right rows of such a key are copied to all of
    them. All other rows have salt 0. At most ``share`` keys are hot, so the right side grows by at most
    ``share * (copies - 1)`` times the rows of a key, and the join gives the same rows for any set of hot keys."""
    hot = frequent_keys(sketched.select(key), key, share)
    is_hot = F.coalesce(F.array_contains(hot, F.col(key)), F.lit(False))
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(copies)).cast("int")).otherwise(0))
    copied = (right.withColumn("_hot", is_hot)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(copies - 1)).otherwise(0)))).drop("_hot"))
    return dealt, copied


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: Column,
    right_t: Column,
    lo: int,
    hi: int,
    residual: Column | None = None,
    bucket: int | None = None,
    left_alias: str = "l",
    right_alias: str = "r",
    how: str = "inner",
) -> DataFrame:
    """Band join ``lo <= right_t - left_t <= hi`` on equal ``keys``.

    ``left_t``/``right_t`` are integer time expressions (e.g. epoch seconds) evaluated on
    each side. One side is copied to the (at most two) buckets of the other side its band
    can touch; the equi-join on (keys, bucket) keeps a hot key spread over many tasks, and
    the exact band plus ``residual`` is applied afterwards. Columns are addressed as
    ``l.<col>`` / ``r.<col>`` in ``residual`` and in the output of an inner join.
    ``how='left_semi'`` / ``'left_anti'`` copy the right side instead, so every left row
    is returned at most once (existence tests without materialising pairs).
    """
    width = int(bucket or max(hi - lo, 1))
    l = left.withColumn("_bt", left_t.cast("long"))
    r = right.withColumn("_bt", right_t.cast("long"))
    if how == "inner":
        first = F.floor((F.col("_bt") + F.lit(lo)) / F.lit(width)).cast("long")
        last = F.floor((F.col("_bt") + F.lit(hi)) / F.lit(width)).cast("long")
        l = l.withColumn("_bk", F.explode(F.sequence(first, last)))
        r = r.withColumn("_bk", F.floor(F.col("_bt") / F.lit(width)).cast("long"))
    elif how in ("left_semi", "left_anti"):
        first = F.floor((F.col("_bt") - F.lit(hi)) / F.lit(width)).cast("long")
        last = F.floor((F.col("_bt") - F.lit(lo)) / F.lit(width)).cast("long")
        r = r.withColumn("_bk", F.explode(F.sequence(first, last)))
        l = l.withColumn("_bk", F.floor(F.col("_bt") / F.lit(width)).cast("long"))
    else:
        raise ValueError(f"interval_join: unsupported how={how}")
    la, ra = l.alias(left_alias), r.alias(right_alias)
    cond = [F.col(f"{left_alias}.{k}") == F.col(f"{right_alias}.{k}") for k in keys]
    cond.append(F.col(f"{left_alias}._bk") == F.col(f"{right_alias}._bk"))
    delta = F.col(f"{right_alias}._bt") - F.col(f"{left_alias}._bt")
    cond.append(delta.between(lo, hi))
    if residual is not None:
        cond.append(residual)
    out = la.join(ra, on=_and(cond), how=how)
    if how != "inner":
        out = out.drop("_bt", "_bk")
    return out


def _and(conds: Sequence[Column]) -> Column:
    c = conds[0]
    for x in conds[1:]:
        c = c & x
    return c


def time_slices(t_us: Column, slice_us: int, context_us: int, ctx_col: str = "_ctx",
                slice_col: str = "_slice") -> list[Column]:
    """Columns that place a row in its own time slice and, as a context copy, in every later
    slice whose rows can look back to it (``t >= slice_start - context_us``).

    Returns ``[slice, ctx]`` expressions to be used with ``explode`` of an array of structs.
    """
    n = max(1, math.ceil(context_us / slice_us)) if context_us > 0 else 0
    home = F.floor(t_us / F.lit(slice_us)).cast("long")
    entries = [F.struct(home.alias(slice_col), F.lit(False).alias(ctx_col))]
    for k in range(1, n + 1):
        s = home + F.lit(k)
        entries.append(
            F.when(t_us >= s * F.lit(slice_us) - F.lit(context_us),
                   F.struct(s.alias(slice_col), F.lit(True).alias(ctx_col)))
        )
    return entries


def explode_slices(df: DataFrame, t_us: Column, slice_us: int, context_us: int) -> DataFrame:
    """Copy each row into its home slice and the later slices that need it as context."""
    arr = F.filter(F.array(*time_slices(t_us, slice_us, context_us)), lambda x: x.isNotNull())
    return df.withColumn("_sl", F.explode(arr)).select("*", "_sl._slice", "_sl._ctx").drop("_sl")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance_us: int,
    right_cols: Sequence[str],
    right_order: Sequence[str] = (),
    slice_us: int | None = None,
    prefix: str = "asof_",
) -> DataFrame:
    """For every left row, columns of the latest right row with the same keys and
    ``left_ts - tolerance <= right_ts <= left_ts`` (ties on time: largest ``right_order``).

    Spark-native form of the reference's fan-out interval join + "last value": both sides
    are unioned, sliced by time (a right row is copied into the next slice when it is within
    the tolerance of that slice's start), and ``last(ignorenulls)`` runs per (keys, slice).
    No pair is ever materialised and a hot key is split into time slices.
    Output: all left columns plus ``prefix + col`` for each right column (null if none).
    """
    slice_us = int(slice_us or max(4 * tolerance_us, DAY_US))
    lcols = left.columns
    R = right.withColumn("_t", epoch_micros(right_ts)).select(
        *keys, "_t", F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in right_cols], F.col("_t").alias("_rt")).alias("_r"),
        (F.struct(*[F.col(c) for c in right_order]) if right_order else F.lit(0)).alias("_ro"),
    )
    L = left.select(
        *keys,
        epoch_micros(left_ts).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in lcols]).alias("_l"),
        F.lit(None).cast(R.schema["_r"].dataType).alias("_r"),
    )
    R = R.withColumn("_l", F.lit(None).cast(L.schema["_l"].dataType))
    L = L.withColumn("_ro", F.lit(None).cast(R.schema["_ro"].dataType))
    R = explode_slices(R, F.col("_t"), slice_us, tolerance_us).drop("_ctx")
    L = L.withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_us)).cast("long"))
    U = L.unionByName(R)
    w = (Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_ro")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = U.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    ok = F.col("_m._rt") >= F.col("_t") - F.lit(tolerance_us)
    out = m.select(
        "_l.*",
        *[F.when(ok, F.col(f"_m.{c}")).alias(prefix + c) for c in right_cols],
    )
    return out
