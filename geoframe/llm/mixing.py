"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: sources share `share` times all words by weight; a source stops at `cap`
times its own words and the others take what it leaves, by weight.  Every source
lays its documents on a line in an order by md5 of the id; the mix takes the line
from its start, again and again, until the source's target is met, so that the
words taken are the target's whole part, and a document's are cut only at the end
(or, with whole_documents, rounded to all or nothing).

Curriculum: a source's weight varies over training time as a piecewise linear
schedule.  Its integral is the source's cumulative demand; its inverse at a
document's place on the line is the training position, in [0, 1), and documents
are range-sorted by it.

Places on the line are sums over all earlier rows of a source.  They come from
sums by (source, slice of the md5 order) and sums within a slice, so that no task
holds a whole source.

Defined results: a null text has size 0; sources rank by code point with null
last and are one source if equal; rows with size 0 or of a source of size 0 are
taken 0 times and have no position; repeated rows count as many documents (equal
rows stand side by side on the line, and which is which makes no difference); rows
without an id are ordered by their text; a very long text is one document like any
other and is never cut apart; an empty table gives an empty result.  All other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm._shared import renamed

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: By source rank, repeating: (time, weight) knots. The heaviest sources start high and make room for the lighter ones.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) rows -> also rank (from 0) and target. A row per source; their number bounds the windows here."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levelled = ranked.withColumn("rest", rest).withColumn("weights", F.sum("weight").over(after))
    stops = F.col("most") * F.col("weights") <= F.col("rest") * F.col("weight")
    levelled = levelled.withColumn("stops", F.min(stops).over(order))
    free = levelled.withColumn("free", F.first(F.when(~F.col("stops"), F.struct("rest", "weights")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("free.rest") * F.col("weight") / F.col("free.weights"))
    return free.select("source", "source_size", "rank", target.alias("target"))


def inverse_demand(knots: tuple, done: Column) -> Column:
    """The time in [0, 1] at which a share `done` of a schedule's integral is reached."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, found, low = sum(areas), None, 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        left, slope = done * F.lit(total) - F.lit(low), (w1 - w0) / (t1 - t0)
        time = F.lit(t0) + F.lit(2.0) * left / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0))))
        low += area
        inside = done * F.lit(total) < F.lit(low)
        found = F.when(inside, time) if found is None else found.when(inside, time)
    return found.otherwise(F.lit(1.0))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, cap: int, schedules: tuple, whole_documents: bool, slice_digits: int) -> DataFrame:
    """docs with its columns called c0, c1, ... and a struct mix: size, source_size, target, taken, visits (array of position and words)."""
    own, (id_, text, source) = renamed(docs, id_col, text_col, source_col)
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_).cast("string"), F.md5(body.cast("binary"))).cast("binary"))
    rows = own.withColumn("size", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumn("key", key)
    rows = rows.withColumn("slice", F.substring("key", 1, slice_digits)).withColumn("source", F.struct(F.col(source).alias("source")))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    targets = source_targets(slices.groupBy("source").agg(F.sum("sum").alias("source_size")).select("source.source", "source_size"), weights, share, cap)
    slices = slices.join(targets.withColumn("source", F.struct("source")), "source").select("source", "slice", F.struct("before", "source_size", "target", "rank").alias("line"))
    within = Window.partitionBy("source", "slice").orderBy("key", id_, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(slices, ["source", "slice"])
    size, source_size, target = F.col("size"), F.col("line.source_size"), F.col("line.target")
    start = F.col("line.before") + F.col("at")

    def visit(turn: Column) -> Column:
        begins = turn * source_size + start
        words = F.least(size, F.floor(target) - begins)
        if whole_documents:
            words = F.when(2 * words >= size, size).otherwise(F.lit(0))
        done = F.try_divide(begins, target)
        which = F.col("line.rank") % len(schedules)
        time = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            time = F.when(which == k, inverse_demand(knots, done)).otherwise(time)
        return F.struct(time.alias("position"), words.alias("words"))

    visits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), visit), lambda v: v["words"] > 0)
    taken = F.aggregate(F.col("visits"), F.lit(0).cast("long"), lambda n, v: n + v["words"])
    mix = F.struct(size.alias("size"), source_size.alias("source_size"), target.alias("target"), taken.alias("taken"), F.col("visits").alias("visits"))
    return placed.withColumn("visits", visits).select(*own.columns, mix.alias("mix"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, schedules: tuple = SCHEDULES, whole_documents: bool = False, slice_digits: int = 3) -> DataFrame:
    """docs with struct __mix (with one more underscore in front for each such column of the user's): size, source_size, target, taken, visits (array of position and words)."""
    name = "__mix"
    while name in docs.columns:
        name = f"_{name}"
    return _placed(docs, id_col, text_col, source_col, weights, share, cap, schedules, whole_documents, slice_digits).toDF(*docs.columns, name)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, schedules: tuple = SCHEDULES, slice_digits: int = 3) -> DataFrame:
    """A row for each time the mix takes a document whole, all columns as they were, range-sorted by training position; the id parts equal positions."""
    placed = _placed(docs, id_col, text_col, source_col, weights, share, cap, schedules, True, slice_digits)
    order = ["visit.position", f"c{docs.columns.index(id_col)}"]
    visits = placed.withColumn("visit", F.explode("mix.visits")).repartitionByRange(*order).sortWithinPartitions(*order)
    return visits.select(*placed.columns[:-1]).toDF(*docs.columns)
