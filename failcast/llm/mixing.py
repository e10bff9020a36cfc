"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral gives the
source's target share and its cumulative token demand; a source's documents, in hash
order and as often as needed, supply that demand, and a document's training position is
the time at which the demand reaches its first word (the inverse of the cumulative
demand). Documents are then range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from failcast.llm.words import BLOCK_BYTES, find_words, text_bytes
from failcast.scratch import materialize

@dataclass(frozen=True)
class Schedule:
    """Weight over time as straight lines between (time, weight) knots, the first at 0 and the last at 1."""
    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(w for _, w in self.knots) < 0 or not self.total:
            raise ValueError("knots must rise in time from 0 to 1, with weights of 0 or more and not all 0")

    @property
    def lines(self) -> list[tuple[float, float, float, float, float]]:
        """(start, length, weight there, slope, integral before) of each line."""
        out, done = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            out.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), done))
            done += (w0 + w1) / 2 * (t1 - t0)
        return out

    @property
    def total(self) -> float:
        return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]))


def time_of(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` (0 to 1) of a schedule's integral is reached."""
    area, case = share * schedule.total, None
    for start, _, weight, slope, before in reversed(schedule.lines):
        rest = F.greatest(area - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * rest, F.lit(0.0)))
        here = start + F.when(root + weight > 0, 2 * rest / (root + weight)).otherwise(F.lit(0.0))
        case = F.when(area >= before, here) if case is None else case.when(area >= before, here)
    return F.least(F.coalesce(case, F.lit(0.0)), F.lit(1.0))


#: Sources in order take these in turn; their integrals are 3, 1 and 2.
SCHEDULES = (Schedule(((0.0, 4.0), (1.0, 2.0))), Schedule(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))), Schedule(((0.0, 2.0), (1.0, 2.0))))


@F.arrow_udf(LongType())
def word_count(column: pa.Array) -> pa.Array:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    data, offsets = text_bytes(column)
    out, at = [], 0
    while at < len(column):
        to = max(at + 1, int(offsets.searchsorted(offsets[at] + BLOCK_BYTES, "right")) - 1)
        out += find_words(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]).counts.tolist()
        at = to
    return pa.array(out, pa.int64())


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: __source, __null, source_size, source_no, target.

    ``sizes``: __source (never null), __null, size. Sources are numbered by code point, null last,
    over a range sort; targets share ``share`` of all sizes by weight and stop at ``most`` times the
    source's size, the excess being shared again until none is above. Only sums reach the driver.
    """
    total = sizes.groupBy("__null", "__source").agg(F.sum("size").alias("source_size"))
    placed = materialize(total.orderBy("__null", "__source")
                         .withColumn("__part", F.spark_partition_id())
                         .withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sources")
    before, seen = [], 0
    for r in sorted(placed.groupBy("__part").count().collect()):  # a row per partition
        before.append((r["__part"], seen))
        seen += r["count"]
    number = F.col("__at") + F.coalesce(F.create_map(*[F.lit(x) for pair in before for x in pair])[F.col("__part")], F.lit(0)) if before else F.lit(0)
    weights = F.array(*[F.lit(float(s.total)) for s in schedules])
    placed = placed.withColumn("source_no", number.cast("long")).withColumn(
        "__weight", F.get(weights, (F.col("source_no") % len(schedules)).cast("int")))
    cap = most * F.col("source_size")
    level, stopped = 0.0, -1
    while True:  # ends when no further source stops: each round stops one more at least
        full = cap <= level * F.col("__weight")
        row = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("given"),
                         F.sum(F.when(~full, F.col("__weight"))).alias("open"), F.count_if(full).alias("stopped")).first()
        if row.stopped == stopped or not row.open:
            break
        stopped, level = row.stopped, (share * row["all"] - (row.given or 0.0)) / row.open
    target = F.when(cap <= level * F.col("__weight"), cap).otherwise(level * F.col("__weight"))
    return placed.select("__source", "__null", "source_size", "source_no", target.cast("double").alias("target"))


def assign(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, taken and positions.

    A source's documents stand in the order of the md5 of their id (null ids first), then id, size
    and a hash of the text; the mix reads that row of words, again and again, until the source's
    target is met. taken: the words it reads of this document, repeats counted (the document
    at the end may be read in part). positions: the training time of each start (0 to 1), ascending;
    empty where nothing is read. Texts without words have size 0 and are never read. Equal rows get
    equal shares up to their order, so a result is the same in every run and partition layout.
    Columns of these names are replaced; an empty table gives an empty result.

    A hot source is cut into slices of its hash range; only slices are ranked in one task.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "positions")
    own = docs.columns
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in own], word_count(F.col("text")).alias("size"), F.col("source").isNull().alias("__null"),
        F.coalesce(F.col("source"), F.lit("")).alias("__source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__key"), F.xxhash64("text").alias("__text"))
    narrow = materialize(keyed.select("__source", "__null", "__key", "size"), "sizes")
    sources = materialize(source_targets(narrow, schedules, share, most), "targets")
    rows, digits = narrow.count(), 1
    while 256 ** digits < rows:  # as many slices as rows in a slice, about
        digits += 1
    slice_of = F.substring("__key", 1, digits)
    slices = narrow.groupBy("__source", "__null", slice_of.alias("__slice")).agg(F.sum("size").alias("words"))
    along = Window.partitionBy("__source", "__null").orderBy("__slice")
    starts = (slices.withColumn("__before", F.sum("words").over(along) - F.col("words")).drop("words")
              .join(sources, ["__source", "__null"]))
    inside = Window.partitionBy("__source", "__null", "__slice").orderBy("__key", "doc_id", "size", "__text")
    placed = (keyed.withColumn("__slice", slice_of).withColumn("__in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .join(starts, ["__source", "__null", "__slice"]).withColumn("__start", F.col("__before") + F.col("__in")))
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    begins = lambda i: F.col("__start") + i.cast("long") * F.col("source_size")
    goal = F.floor("target")
    read = lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begins(i)))
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda a, i: a + read(i))
    starts_read = F.filter(passes, lambda i: read(i) > 0)
    which = F.col("source_no") % len(schedules)

    def time(i):
        part = begins(i) / F.col("target")
        case = None
        for k, s in enumerate(schedules):
            here = time_of(s, part)
            case = F.when(which == k, here) if case is None else case.when(which == k, here)
        return case

    return placed.select(*[F.col(f"`{c}`") for c in own], "size", "source_size", "target", taken.alias("taken"),
                         F.transform(starts_read, time).alias("positions"),
                         F.transform(starts_read, lambda i: read(i)).alias("__read"))


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The curriculum: a whole document for each time it is read, range-sorted by training position.

    A document's last reading counts where half its words or more are read. Columns are those of
    ``docs`` and ``position``.
    """
    whole = F.filter(F.arrays_zip("positions", "__read"), lambda x: 2 * x["__read"] >= F.col("size"))
    made = assign(docs, **options).withColumn("__pass", F.explode(whole)).withColumn("position", F.col("__pass.positions"))
    out = made.select(*[F.col(f"`{c}`") for c in docs.columns if c != "position"], "position")
    n = [partitions] if partitions else []
    return out.repartitionByRange(*n, "position").sortWithinPartitions("position")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, times_started and first_position, in training order."""
    made = assign(docs.select("doc_id", "source", "text"))
    out = made.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("times_started"),
                      F.round(F.array_min("positions"), 9).alias("first_position"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def mixed_sql() -> str:
    """The same result in DuckDB SQL; the three schedules' inverses are written out."""
    return r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(no % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
ranked AS (SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
final AS (SELECT level FROM ranked WHERE cap > level * weight ORDER BY cap / weight, no LIMIT 1),
t AS (SELECT w.*, least(cap, coalesce((SELECT level FROM final), 0) * weight) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.no,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, greatest(0, least(size, floor(target) - begins))::BIGINT AS once,
             greatest(0, least(size, floor(target) - begins - source_size))::BIGINT AS twice FROM p),
a AS (SELECT *, CASE WHEN once > 0 THEN begins / target END AS part FROM r)
SELECT doc_id, size, source_size, target, once + twice AS taken, ((once > 0)::INT + (twice > 0)::INT)::BIGINT AS times_started,
       round(CASE no % 3 WHEN 0 THEN 2 * (3 * part) / (sqrt(16 - 4 * (3 * part)) + 4)
                         WHEN 1 THEN 2 * part / (sqrt(0.25 + 2 * part) + 0.5)
                         ELSE part END, 9) AS first_position
FROM a"""
