"""Reproducible thinning and imbalance-aware under-sampling.

Randomness is a hash of the row's identity (``md5``), never ``rand()``, so the same
rows are drawn under any partition layout and by the SQL oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failcast.functions.expressions import hash_order
from failcast.operators.labels import time_range
from failcast.scratch import materialize

HASH = "_h"
REPLICATE_CHUNK = 100_000


def content_key(cols) -> Column:
    """A 128-bit fingerprint of a row's content (two differently seeded 64-bit hashes):
    a deterministic tie-break between rows that share an order key."""
    cols = [F.col(c) for c in cols]
    return F.concat_ws(":", F.xxhash64(F.lit(1), *cols).cast("string"), F.xxhash64(F.lit(2), *cols).cast("string"))


def _take_lowest_entries(slice_df: DataFrame, cols, need, order_col: str, group_col: str | None = None,
                         chunk: int = REPLICATE_CHUNK) -> DataFrame:
    """Keep, per group, the ``need`` rows of ``slice_df`` lowest in (``order_col``, content).

    Rows first collapse to distinct contents with their multiplicity (map-side combined,
    so thousands of copies of one row never gather in one task); the entries are ranked
    and each kept entry is emitted as many times as it is kept, in chunks of at most
    ``chunk`` rows spread over tasks. Copies are interchangeable, so this equals ranking
    the rows themselves. ``need`` is a Column (per group, or a scalar subquery)."""
    grp = [group_col] if group_col else []
    aggs = [F.count(F.lit(1)).alias("_m"), F.first(F.struct(*cols)).alias("_row")]
    if group_col:
        aggs.append(F.first(need).alias("_need"))   # constant within a group
        need = F.col("_need")
    entries = slice_df.groupBy(*grp, order_col, content_key(cols).alias("_ck")).agg(*aggs)
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*grp).orderBy(order_col, "_ck")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = F.least(F.greatest(need - before, F.lit(0)), F.col("_m"))
    kept = entries.select("_ck", "_row", keep.alias("_keep")).filter(F.col("_keep") > 0)
    chunks = (kept.select("_ck", "_row", "_keep",
                          F.explode(F.sequence(F.lit(0), F.floor((F.col("_keep") - 1) / chunk))).alias("_chunk"))
              .repartition("_ck", "_chunk"))
    n = F.least(F.lit(chunk), F.col("_keep") - F.col("_chunk") * chunk)
    return chunks.select("_row", F.explode(F.sequence(F.lit(1), n)).alias("_i")).select("_row.*")


def sample_per_group(df: DataFrame, keys, k: int, seed, order_cols) -> DataFrame:
    """Keep the ``k`` rows with the lowest hash per group (top-k per group).

    ``k`` is a literal, so Catalyst adds a partial ``WindowGroupLimit`` before the
    shuffle: each map task forwards at most ``k`` rows per group, and a hot group
    never arrives whole at one reducer. Rows sharing the hash (same identity) are
    ordered by their content, so the choice never depends on partition layout.
    """
    w = Window.partitionBy(*keys).orderBy(hash_order(*order_cols, seed=seed), content_key(df.columns))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= int(k)).drop("_rn")


def training_cohort(labelled: DataFrame, train, tags_end, horizon_days: int, k: int, seed,
                    mode: str = "all", leak_guard: bool = True,
                    group_keys=("serial_number", "model", "month"),
                    order_cols=("serial_number", "model", "dt"), day_col: str = "dt",
                    time_col: str = "fault_time") -> DataFrame:
    """Positives near a fault plus thinned negatives of the train range.

    Positives: ``label = 1``, ``fault - day <= horizon``, ``day >= train_lo`` and
    ``fault < tags_end``. With ``leak_guard=False`` (the reference rule) positives are
    taken from all days after ``train_lo``; ``True`` also requires ``day < train_hi``.
    Negatives: ``mode='all'`` keeps ``k`` label-0 rows per (device, month) of the train
    range; ``mode='faulty_only'`` keeps every label-0 row of devices that have a fault.
    """
    lo, hi = train
    pos = labelled.filter((F.col("label") == 1)
                          & (F.datediff(F.col(time_col), F.col(day_col)) <= horizon_days)
                          & (F.col(day_col) >= F.lit(lo).cast("date"))
                          & (F.col(time_col) < F.lit(tags_end).cast("date")))
    if leak_guard:
        pos = pos.filter(F.col(day_col) < F.lit(hi).cast("date"))
    train_rows = time_range(labelled, lo, hi, day_col)
    if mode == "all":
        neg = sample_per_group(train_rows.filter(F.col("label") == 0), group_keys, k, seed, order_cols)
    elif mode == "faulty_only":
        neg = train_rows.filter(F.col(time_col).isNotNull() & (F.col("label") == 0))
    else:
        raise ValueError(f"mode must be 'all' or 'faulty_only', not {mode!r}")
    return neg.unionByName(pos)


def hardness(df: DataFrame, score_col: str = "p", label_col: str = "label", fn=None, out: str = "hardness") -> DataFrame:
    """Per-row hardness ``fn(label, score)``; default squared error."""
    fn = fn or (lambda y, p: (y - p) * (y - p))
    return df.withColumn(out, fn(F.col(label_col).cast("double"), F.col(score_col)))


def _bin_of(h: Column, lo, hi, k: int) -> Column:
    """Number of the last edge ``lo + i * step`` (i < k) that ``h`` reaches; NULL for a NULL or NaN ``h``.

    The division only finds the neighbourhood, the edges decide, so a value that equals an
    edge is in the bin that begins there. A range too small for k steps is one bin."""
    step = (hi - lo) / F.lit(float(k))
    guess = F.least(F.floor(F.try_divide(h - lo, step)), F.lit(k - 1))
    reached = lambda i: h >= lo + i.cast("double") * step
    fixed = F.when(~reached(guess), guess - 1).when((guess < k - 1) & reached(guess + 1), guess + 1).otherwise(guess)
    bins = F.when((hi == lo) | (step == 0), F.lit(0)).otherwise(F.greatest(fixed, F.lit(0)))
    return F.when(h.isNotNull() & ~F.isnan(h), bins).cast("int")


def hardness_bins(df: DataFrame, k: int, h_col: str = "hardness", out: str = "bin") -> DataFrame:
    """``k`` equal-width bins between the min and max hardness; the max falls in the last
    bin. When all hardness values are equal every row is in bin 0 (the random path). A row
    without a hardness is in no bin (NULL), so no draw takes it.
    The bounds are one scalar subquery (a struct), so the plan stays lazy."""
    known = F.when(~F.isnan(h_col), F.col(h_col))
    bounds = df.agg(F.struct(F.min(known).alias("lo"), F.max(known).alias("hi")).alias("b")).scalar()
    return df.withColumn(out, _bin_of(F.col(h_col), bounds["lo"], bounds["hi"], k))


def pace(i: int, n: int) -> float:
    """Self-paced factor tan(pi/2 * i / (n - 1)); infinite at the last round."""
    return math.inf if i >= n - 1 else math.tan(math.pi * 0.5 * i / (n - 1))


def bin_quotas(binned: DataFrame, n_min, i: int, n: int, k: int | None = None, h_col: str = "hardness",
               bin_col: str = "bin") -> DataFrame:
    """Per non-empty bin: size, mean hardness, weight ``1/(mean + alpha)`` and quota
    ``floor(n_min * w / sum(w)) + 1`` (``n_min`` a number or a scalar Column).

    At the last round alpha is infinite and the weights are equal by definition,
    which is applied exactly instead of through a huge float. If hardness is flat (all
    rows in bin 0) the quota is ``n_min``: plain random under-sampling. With ``k >= 2``
    bins, flat hardness is exactly "one non-empty bin" (otherwise the min and max fall
    in the first and last bin), read off the at most ``k`` stats rows.
    """
    n_min = n_min if isinstance(n_min, Column) else F.lit(int(n_min))
    stats = binned.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(h_col).alias("mean_hardness"))
    alpha = pace(i, n)
    if math.isinf(alpha):
        weight = F.lit(1.0)
    else:
        weight = F.lit(1.0) / (F.col("mean_hardness") + F.lit(alpha))
    stats = stats.withColumn("weight", weight)
    everything = Window.partitionBy()  # over <= k rows
    if k is not None and k >= 2:
        flat = F.count(F.lit(1)).over(everything) == 1
    else:
        bounds = binned.agg(F.struct(F.min(h_col).alias("lo"), F.max(h_col).alias("hi")).alias("b")).scalar()
        flat = bounds["hi"] == bounds["lo"]
    quota = F.floor(n_min * F.col("weight") / F.sum("weight").over(everything)).cast("long") + 1
    return stats.withColumn("quota", F.when(flat, n_min.cast("long")).otherwise(quota))


def draw_by_quota(df: DataFrame, quotas: DataFrame, group_col: str, order_col: str = HASH,
                  prefix_len: int = 4) -> DataFrame:
    """Per group, keep the ``quota`` rows with the smallest ``order_col`` - exactly, and
    without ranking whole groups.

    ``quotas`` holds one row per group (``group_col``, ``quota``) and is small by
    contract (bins: at most k rows), so it is broadcast. The hex order key is cut into
    ``16**prefix_len`` ordered sub-buckets; per (group, sub-bucket) counts are prefix-
    summed, which finds for each group the one boundary sub-bucket where the quota runs
    out. Rows below it are kept by a filter, rows above it dropped, and only rows of the
    boundary sub-bucket (about size / 16**prefix_len of a group) are ranked, as distinct
    contents with counts (``_take_lowest_entries``), so copies sharing a key stay
    distributed. Same rows as ``row_number() OVER (PARTITION BY group ORDER BY key,
    content) <= quota``.
    """
    q = F.broadcast(quotas.select(group_col, F.col("quota").cast("long").alias("_quota")))
    sub = F.substring(F.col(order_col), 1, prefix_len)
    counts = (df.groupBy(group_col, sub.alias("_sub")).agg(F.count(F.lit(1)).alias("_c"))
              .join(q, group_col))
    before = F.coalesce(F.sum("_c").over(
        Window.partitionBy(group_col).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    edge = counts.filter((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_c") >= F.col("_quota")))
    edge = F.broadcast(edge.select(group_col, F.col("_sub").alias("_bsub"),
                                   (F.col("_quota") - F.col("_before")).alias("_need")))

    cols = df.columns
    live = df.join(q, group_col).filter(F.col("_quota") > 0).join(edge, group_col, "left")
    whole = live.filter(F.col("_bsub").isNull() | (sub < F.col("_bsub"))).select(*cols)
    part = _take_lowest_entries(live.filter(sub == F.col("_bsub")), cols, F.col("_need"), order_col, group_col)
    return whole.unionByName(part)


def draw_lowest(df: DataFrame, n: Column, order_col: str = HASH, prefix_len: int = 4) -> DataFrame:
    """The ``n`` rows with the smallest ``order_col`` (``n`` a scalar Column), exactly.

    Single-group form of ``draw_by_quota``: per sub-bucket counts (at most
    ``16**prefix_len`` rows) are prefix-summed, the boundary sub-bucket and the number
    still needed from it are scalar subqueries, rows below it pass a filter and only the
    boundary slice is ranked (as distinct contents with counts). Same rows as
    ``row_number() OVER (ORDER BY key, content) <= n``."""
    sub = F.substring(F.col(order_col), 1, prefix_len)
    counts = df.groupBy(sub.alias("_sub")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))  # over <= 16**prefix_len rows
    counts = counts.withColumn("_before", before)
    edge = (counts.filter((F.col("_before") < n) & (F.col("_before") + F.col("_c") >= n))
            .select(F.struct(F.col("_sub").alias("sub"), (n - F.col("_before")).alias("need")).alias("e"))
            .scalar())
    live = df.filter(n > 0)
    whole = live.filter(edge.isNull() | (sub < edge["sub"]))
    part = _take_lowest_entries(live.filter(sub == edge["sub"]), df.columns, edge["need"], order_col)
    return whole.unionByName(part)


def repeated(df: DataFrame, times: str, chunk: int = REPLICATE_CHUNK) -> DataFrame:
    """Each row as often as its column ``times`` says, that column dropped; rows repeated more than once
    spread over tasks in chunks of at most ``chunk`` rows."""
    cols = [c for c in df.columns if c != times]
    row = F.struct(*cols).alias("_row")
    chunks = (df.where(F.col(times) > 1)
              .select(row, times, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / chunk))).alias("_chunk"))
              .repartition(F.xxhash64("_row"), "_chunk"))
    n = F.least(F.lit(chunk).cast("long"), F.col(times) - F.col("_chunk") * chunk)
    many = chunks.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_i")).select("_row.*")
    return df.where(F.col(times) == 1).select(*cols).unionByName(many)


def _digits(rows: int) -> int:
    """Hex digits of the order key that cut ``rows`` rows into slices of about a thousand."""
    return min(8, max(1, math.ceil(math.log(max(rows, 1) / 1000, 16)))) if rows > 1000 else 1


def _rows(weight: str | None) -> Column:
    """Number of rows, where a row stands for ``weight`` equal ones."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def count_rows(df: DataFrame, weight: str | None = None) -> int:
    return df.agg(_rows(weight)).first()[0] or 0


def _slice_counts(df: DataFrame, digits: int, order_col: str, group_col: str, h_col: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows (and hardness) per group and slice of the order key, written once."""
    total = [F.sum(F.col(h_col) * F.col(weight) if weight else F.col(h_col)).alias("h")] if h_col else []
    sub = F.substring(F.col(order_col), 1, digits).alias("slice")
    return materialize(df.groupBy(group_col, sub).agg(_rows(weight).alias("c"), *total), "slices")


def _draw_quotas(df: DataFrame, counts: DataFrame, quotas: dict, digits: int, order_col: str, group_col: str, weight: str | None = None) -> DataFrame:
    """Per group its ``quotas[group]`` rows lowest in (order key, content), in one read of ``df``.

    The slice in which a group's quota runs out is found on the slice counts; one filtered
    read takes the rows up to it, and only that slice is ranked. With ``weight`` a row stands for that many
    equal ones and no other row has its order key; the drawn rows carry how many of them are drawn."""
    wanted = F.create_map(*[x for g, q in quotas.items() for x in (F.lit(int(g)), F.lit(int(q)).cast("long"))])[F.col(group_col)]
    before = F.sum("c").over(Window.partitionBy(group_col).orderBy("slice")) - F.col("c")
    edges = (counts.withColumn("before", before).withColumn("quota", wanted)
             .where("quota > before AND quota <= before + c").select(group_col, "slice", (F.col("quota") - F.col("before")).alias("need")).collect())
    edge = {r[group_col]: (r["slice"], r.need) for r in edges}  # a row a group at most
    whole = {g: edge.get(g, ("g" if q > 0 else "", 0)) for g, q in quotas.items()}  # 'g' is above, '' below every slice
    of = lambda i, kind: F.create_map(*[x for g, v in whole.items() for x in (F.lit(int(g)), F.lit(v[i]).cast(kind))])[F.col(group_col)]
    sub, last = F.substring(F.col(order_col), 1, digits), of(0, "string")
    taken = materialize(df.where(sub <= last), "drawn")
    below = taken.where((sub < last) | (last == "g"))
    if weight is None:
        return below.unionByName(_take_lowest_entries(taken.where(sub == last), df.columns, of(1, "long"), order_col, group_col))
    here = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(of(1, "long") - F.coalesce(F.sum(weight).over(here), F.lit(0)), F.lit(0))
    ranked = taken.where(sub == last).withColumn(weight, F.least(left, F.col(weight)))
    return below.unionByName(ranked.where(F.col(weight) > 0))


def undersample_random(majority: DataFrame, minority: DataFrame, order: Column, n=None, weight: str | None = None) -> DataFrame:
    """Cold start: draw ``min(|minority|, |majority|)`` majority rows by hash order (or ``n``),
    label them as majority, and append the minority. Two reads of the majority class.
    ``weight``: see ``_draw_quotas``."""
    n_min = count_rows(minority, weight) if n is None else int(n)
    df = majority.withColumn(HASH, order).withColumn("_all", F.lit(0))
    digits = _digits(majority.count())
    drawn = _draw_quotas(df, _slice_counts(df, digits, HASH, "_all", weight=weight), {0: n_min}, digits, HASH, "_all", weight).drop(HASH, "_all")
    return drawn.unionByName(minority, allowMissingColumns=True)


def paced_quotas(stats: list, n_min: int, i: int, n: int, flat: bool) -> dict:
    """Quota per bin from at most k (bin, rows, mean hardness) tuples, as ``bin_quotas``."""
    if flat:
        return {b: n_min for b, _, _ in stats}
    alpha = pace(i, n)
    weight = {b: 1.0 if math.isinf(alpha) else 1.0 / (mean + alpha) for b, _, mean in sorted(stats)}
    total = sum(weight.values())
    return {b: math.floor(n_min * w / total) + 1 for b, w in weight.items()}


def undersample_self_paced(majority: DataFrame, minority: DataFrame, order: Column, i: int, n: int, k: int,
                           score_col: str = "p", label_col: str = "label", hardness_fn=None,
                           keep_bin: bool = False, weight: str | None = None) -> DataFrame:
    """One paced round: hardness -> k bins -> quotas -> exact per-bin hash draw, then the
    minority appended. Rows without a score are in no bin and are never drawn.
    ``weight``: see ``_draw_quotas``.

    Three reads of the majority class: hardness bounds and row count; rows and hardness per
    bin and slice of the order key; the drawn rows."""
    scored = hardness(majority, score_col, label_col, hardness_fn).where(F.col("hardness").isNotNull() & ~F.isnan("hardness"))
    n_min = count_rows(minority, weight)
    bounds = scored.agg(F.min("hardness").alias("lo"), F.max("hardness").alias("hi"), F.count(F.lit(1)).alias("rows")).first()
    lo, hi = bounds.lo or 0.0, bounds.hi or 0.0
    binned = scored.withColumn("bin", _bin_of(F.col("hardness"), F.lit(lo), F.lit(hi), k)).withColumn(HASH, order)
    digits = _digits(bounds.rows // max(1, k))
    counts = _slice_counts(binned, digits, HASH, "bin", "hardness", weight)
    stats = [(r.bin, r.rows, r.mean) for r in counts.groupBy("bin").agg(F.sum("c").alias("rows"), (F.sum("h") / F.sum("c")).alias("mean")).collect()]
    if stats:
        quotas = paced_quotas(stats, n_min, i, n, flat=len(stats) == 1 if k >= 2 else hi == lo)
        drawn = _draw_quotas(binned, counts, quotas, digits, HASH, "bin", weight).drop(HASH)
    else:
        drawn = binned.drop(HASH)
    if not keep_bin:
        drawn = drawn.drop("bin", "hardness")
    return drawn.unionByName(minority, allowMissingColumns=True)
