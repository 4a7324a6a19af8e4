"""Accuracy reports, losses and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geoframe.functions import geo, ordered
from geoframe.functions.draws import digest
from geoframe.functions.lineage import by_group, checkpointed
from geoframe.operators import fit, neighbors, sensor


def pair_distances(coords: DataFrame) -> DataFrame:
    """Distance in metres between each tie point's positions (lat, lon) from every two images i < j."""
    side = lambda n: coords.select("point_id", F.col("image_id").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}"))
    j = side("i").join(side("j"), "point_id").filter("i < j")
    return j.select("point_id", "i", "j", geo.haversine_m(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")).alias("distance"))


def middle_values(df: DataFrame, col: str, accuracy: int = 100_000) -> tuple[float | None, float | None]:
    """The values of col at the two middle ranks of the whole table (one and the same, if rows are odd in number); None for none.

    Approximate quantiles part the values into those below, about and above the middle.
    The parts' exact sizes say where the middle ranks lie, and only that part is ranked,
    so the result is exact however good the quantiles are.  df is read three times.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL")
    bounds = values.agg(F.percentile_approx("v", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)).first()[0]
    if bounds is None:
        return None, None
    values = values.withColumn("part", F.when(F.col("v") < bounds[0], 0).when(F.col("v") <= bounds[1], 1).otherwise(2))
    sizes = {r["part"]: r["count"] for r in values.groupBy("part").count().collect()}
    n, before, found = sum(sizes.values()), 0, {}
    for part in sorted(sizes):
        ranks = {r - before for r in ((n - 1) // 2, n // 2) if before <= r < before + sizes[part]}
        if ranks:
            upto = values.filter(F.col("part") == part).groupBy("v").count().select("v", F.sum("count").over(Window.orderBy("v")).alias("upto"))
            row = upto.agg(*(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(str(r)) for r in ranks)).first()
            found |= {r + before: row[str(r)] for r in ranks}
        before += sizes[part]
    return found[(n - 1) // 2], found[n // 2]


def summary(dist: DataFrame, thresholds: tuple = (0.5, 1, 3), by: tuple = ()) -> DataFrame:
    """Median, mean, largest, least distance and the shares under each threshold."""
    name = lambda t: f"at_{t}m".replace(".", "_")
    shares = [F.avg((F.col("distance") < t).cast("double")).alias(name(t)) for t in thresholds]
    rest = (F.avg("distance").alias("mean"), F.max("distance").alias("max"), F.min("distance").alias("min"), *shares)
    dist = checkpointed(dist.select(*by, "distance"))
    if by:
        medians = ordered.quantiles(dist, list(by), "distance", [0.5]).select(*by, F.col("value").alias("median"))
        return ordered.same(dist.groupBy(*by).agg(*rest), medians, list(by), "left").select(*by, "median", "mean", "max", "min", *map(name, thresholds))
    low, high = middle_values(dist, "distance")
    median = F.lit(None if low is None else 0.5 * low + 0.5 * high).cast("double")
    return dist.agg(median.alias("median"), *rest)


def append_log(row: DataFrame, path: str) -> None:
    """Adds rows to a log table, which is made if it is not there."""
    row.write.mode("append").parquet(path)


def tanh_clamp(loss: Column, progress: Column | float, most: float) -> Column:
    r = progress if isinstance(progress, Column) else F.lit(float(progress))
    t = F.sqrt(F.lit(1.0) - r * r) * most + 1.0
    return t * F.tanh(loss / t)


def smooth_l1(d: Column, beta: float) -> Column:
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - beta / 2)


def confidence_weight(df: DataFrame, by: str, col: str = "conf", name: str = "weight") -> DataFrame:
    """max(conf - mean of the batch + 1, 0)."""
    means = df.groupBy(by).agg(F.avg(col).alias("__m"))
    return df.join(means, by).withColumn(name, F.greatest(F.col(col) - F.col("__m") + 1.0, F.lit(0.0))).drop("__m")


def confidence_schedule(df: DataFrame, progress: float, by: str) -> DataFrame:
    """conf pushed away from 0.5 as training goes on, then as a weight about 1 within by."""
    pushed = F.when(F.col("conf") > 0.5, 0.5 + 0.4 * progress).when(F.col("conf") < 0.5, 0.5 - 0.4 * progress).otherwise(F.col("conf"))
    return confidence_weight(df.withColumn("conf", pushed), by, "conf", "conf")


def residual_confidence(r: Column, t: Column | float) -> Column:
    return F.when(r > t, 0.1).when((r >= 0) & (r < t), 0.9).otherwise(0.5)


def residual_to_confidence(df: DataFrame, t: float, residual: str = "residual") -> DataFrame:
    return df.withColumn("conf", residual_confidence(F.col(residual), t))


def classify_confidence(patches: DataFrame, div: float, size: int = 16) -> DataFrame:
    """Patch centres (in cells) and whether conf reaches div."""
    centre = {c: (F.col(f"patch_{c}") + 0.5) * size for c in ("row", "col")}
    return patches.withColumns(centre | {"reaches": F.col("conf") >= div})


def drop_nonfinite(log: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """Rows of keys for which every row's loss is finite."""
    odd = F.col(loss).isNull() | F.isnan(loss) | (F.abs(loss) == float("inf"))
    bad = log.filter(odd).select(*keys).distinct()
    return log.join(bad, keys, "left_anti")


def known_residuals(df: DataFrame, t: float | None = None, cols: tuple = ("residual",)) -> DataFrame:
    """Rows whose residuals are all known (at least 0), and, with t, at most t."""
    for c in cols:
        df = df.filter((F.col(c) >= 0) if t is None else F.col(c).between(0, t))
    return df


def residual_report(pred: DataFrame, truth: DataFrame, models: DataFrame, by: str = "image_id", key: str = "patch_id", progress: float = 0.5, clamp: float = 1000.0) -> DataFrame:
    """Per batch the weighted object, height and image residuals, bias and affine regularity, and their total.

    pred: key, x, y, h.  truth: by, key, x, y, h, line, samp, conf.
    """
    t = confidence_schedule(truth, progress, by).select(by, key, F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("h").alias("th"), F.col("line").alias("l_line"), F.col("samp").alias("l_samp"), "conf")
    j = sensor.mercator_to_image(pred.select(key, "x", "y", "h").join(t, key), models).withColumnsRenamed({"line": "t_line", "samp": "t_samp"})
    dl, ds = F.col("t_line") - F.col("l_line"), F.col("t_samp") - F.col("l_samp")
    w = F.col("conf")
    clamped = lambda c: tanh_clamp(c, progress, clamp)
    report = j.groupBy(by).agg(
        F.avg(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) * w).alias("obj"), F.avg(F.abs(F.col("h") - F.col("th")) * w).alias("height"),
        F.avg(clamped(F.sqrt(dl * dl + ds * ds)) * w).alias("photo"), F.sqrt(F.pow(F.avg(clamped(dl) * w), 2) + F.pow(F.avg(clamped(ds) * w), 2)).alias("bias"),
    )
    report = report.join(fit.affine_regularity(j, by), by, "left")
    return report.withColumn("total", F.col("obj") + 10.0 * F.col("height") + F.col("photo") + F.col("bias") + F.coalesce("regularity", F.lit(0.0)))


def image_residual_report(pred: DataFrame, truth: DataFrame, models: DataFrame, by: str = "image_id", key: str = "patch_id", progress: float = 0.5, clamp: float = 1000.0, tolerance: float = 5.0) -> DataFrame:
    """residual_report() of single images: clamped height residuals, and a predicted height that is `tolerance` or more off is replaced by the true one before it is projected.

    real_photo is the plain mean of the clamped image residuals where conf is over 0.5.
    """
    c = F.col
    sure = truth.select(by, key, (c("conf") > 0.5).alias("sure"))
    t = confidence_schedule(truth, progress, by).select(by, key, c("x").alias("tx"), c("y").alias("ty"), c("h").alias("th"), c("line").alias("l_line"), c("samp").alias("l_samp"), "conf").join(sure, [by, key])
    off = F.abs(c("h") - c("th"))
    j = pred.select(key, "x", "y", "h").join(t, key).withColumn("off", off).withColumn("h", F.when(c("off") < tolerance, c("h")).otherwise(c("th")))
    j = sensor.mercator_to_image(j, models).withColumnsRenamed({"line": "t_line", "samp": "t_samp"})
    dl, ds, w = c("t_line") - c("l_line"), c("t_samp") - c("l_samp"), c("conf")
    clamped = lambda v: tanh_clamp(v, progress, clamp)
    photo = clamped(F.sqrt(dl * dl + ds * ds))
    report = j.groupBy(by).agg(
        F.avg(F.sqrt(F.pow(c("x") - c("tx"), 2) + F.pow(c("y") - c("ty"), 2)) * w).alias("obj"), F.avg(clamped(c("off")) * w).alias("height"), F.avg(photo * w).alias("photo"),
        F.avg(F.when(c("sure"), photo)).alias("real_photo"), F.sqrt(F.pow(F.avg(clamped(dl) * w), 2) + F.pow(F.avg(clamped(ds) * w), 2)).alias("bias"),
    )
    report = report.join(fit.affine_regularity(j, by), by, "left")
    return report.withColumn("total", c("obj") + 10.0 * c("height") + c("photo") + c("bias") + F.coalesce("regularity", F.lit(0.0)))


def pair_similarity(f1: DataFrame, f2: DataFrame, shift: int, margin: float = 7.0, key: str = "patch_id", col: str = "feature") -> DataFrame:
    """Mean dot products of features with their partner and with the feature `shift` rows on (keys are 0 to n - 1), and the two hinge losses."""
    n = f1.count()
    a, b = f1.select(key, F.col(col).alias("f1")), f2.select(key, F.col(col).alias("f2"))
    moved = lambda df, name: df.select(F.pmod(F.col(key) + shift, F.lit(max(n, 1))).alias(key), F.col(name).alias(f"{name}n"))
    j = a.join(b, key).join(moved(a, "f1"), key).join(moved(b, "f2"), key)
    d = j.select(neighbors.dot(F.col("f1"), F.col("f2")).alias("pos"), F.explode(F.array(neighbors.dot(F.col("f1"), F.col("f1n")), neighbors.dot(F.col("f2"), F.col("f2n")))).alias("neg"))
    hinge = lambda c: F.greatest(c, F.lit(0.0))
    return d.agg(F.avg("pos").alias("positive"), F.avg("neg").alias("negative"), F.avg(hinge(1.0 - F.col("pos"))).alias("positive_loss"), F.avg(hinge(F.col("neg") - margin)).alias("negative_loss"))


def pair_consistency(p1: DataFrame, p2: DataFrame, t: float, key: str = "patch_id") -> DataFrame:
    """Mean distance and 100 x mean height difference of two predictions where both residuals are at most t."""
    side = lambda df, n: df.select(key, *(F.col(c).alias(f"{c}{n}") for c in ("x", "y", "h", "residual")))
    j = side(p1, 1).join(side(p2, 2), key).filter((F.col("residual1") <= t) & (F.col("residual2") <= t))
    return j.agg(F.avg(F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))).alias("dis_obj"), (F.avg(F.abs(F.col("h1") - F.col("h2"))) * 100.0).alias("dis_height")).withColumn("dis_total", F.col("dis_obj") + F.col("dis_height"))


def residual_threshold(res: DataFrame, col: str = "residual") -> DataFrame:
    """The lower median of known residuals, as one row."""
    known = checkpointed(res.filter(F.col(col) >= 0).select(col))
    return known.agg(F.lit(middle_values(known, col)[0]).cast("double").alias("threshold"))


def finetune_report(df: DataFrame, epoch: int, key: str = "patch_id") -> DataFrame:
    """Weighted object and height errors and the confidence loss of both images of a pair.

    df: image (1 or 2), key, x, y, h, tx, ty, th, conf, residual.
    """
    threshold = residual_threshold(df).select(F.lit(1).alias("__k"), "threshold")
    j = df.withColumn("__k", F.lit(1)).join(threshold, "__k").withColumn("target", residual_confidence(F.col("residual"), F.col("threshold")))
    j = confidence_weight(j, "image", "target")
    known = F.col("residual") >= 0
    log = lambda c: F.greatest(F.log(c), F.lit(-100.0))
    bce = -(F.col("target") * log(F.col("conf")) + (1.0 - F.col("target")) * log(1.0 - F.col("conf")))
    each = j.groupBy("image").agg(
        F.avg(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) * F.col("weight")).alias("obj"),
        F.avg(F.abs(F.col("h") - F.col("th")) * F.col("weight")).alias("height"), F.avg(F.when(known, bce)).alias("bce"), F.max("threshold").alias("threshold"),
    )
    return each.agg((F.sum("obj") * 0.5).alias("loss_obj"), (F.sum("height") * 0.5).alias("loss_height"), (F.sum("bce") * 0.5 * 1000.0 * min(1.0, epoch / 3.0)).alias("loss_conf"), F.max("threshold").alias("threshold"))


def epoch_rollup(log: DataFrame, run: str = "run") -> DataFrame:
    """Mean loss of each epoch: over the iterations of each run, then over runs."""
    return log.groupBy(run, "epoch").agg(F.avg("loss").alias("loss")).groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count("*").alias("n_runs"))


def iteration_means(log: DataFrame, every: int = 10, run: str = "run") -> DataFrame:
    """Mean loss of each `every` iterations of a run's epoch."""
    return log.groupBy(run, "epoch", F.floor(F.col("iter") / every).cast("int").alias("step")).agg(F.avg("loss").alias("loss"))


def best_so_far(log: DataFrame, patience: int = 100, factor: float = 10.0, run: str = "run", order: str = "iter", cool_down: int = 0) -> DataFrame:
    """Best loss up to each check, checks since it improved, whether the loss diverged, and the first stop (a stale run of `patience`, or divergence), after cool_down checks.

    A run's checks are one ordered series; runs are independent.  A long run is cut
    into ranges, which are scanned apart: the number of checks and the best loss
    before a range, then the last check before it that was better, are carried into it.
    """
    by, c = [run], F.col
    ranged = ordered.in_ranges(log, by, [order])
    local = Window.partitionBy(run, ordered.PART).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    start = ordered.carried(ranged, by, {"__n": F.count("*"), "__best": F.min("loss")}, {"__n": F.sum("__n"), "__best": F.min("__best")})
    df = ordered.same(ranged, start, [run, ordered.PART])
    before = F.least(F.min("loss").over(local.rowsBetween(Window.unboundedPreceding, -1)), c("__best"))
    df = df.withColumns({"n": F.row_number().over(local) + F.coalesce("__n", F.lit(0)), "__before": before, "best": F.least(F.min("loss").over(upto), c("__best"))})
    df = df.withColumn("__better", F.when(c("__before").isNull() | (c("loss") < c("__before")), c("n"))).drop("__n", "__best", "__before")
    last = ordered.carried(df, by, {"__last": F.max("__better")}, {"__last": F.max("__last")})
    df = ordered.same(df, last, [run, ordered.PART])
    df = df.withColumn("no_update", c("n") - F.greatest(F.max("__better").over(upto), c("__last")))
    df = df.withColumn("diverged", (c("no_update") > 0) & (c("loss") > factor * c("best"))).drop("__better", "__last")
    stops = df.groupBy(run, ordered.PART).agg(F.min(F.when((c("no_update") >= patience) | c("diverged"), c("n"))).alias("__stop"))
    stops = stops.withColumn("stop_at", F.min("__stop").over(Window.partitionBy(run)) + cool_down).drop("__stop")
    return ordered.same(df, stops, [run, ordered.PART]).select(*log.columns, "n", "best", "no_update", "diverged", "stop_at")


def epoch_delta(log: DataFrame) -> DataFrame:
    """Change of the epoch's loss against the epoch before. log: an epoch a row."""
    return log.withColumn("delta", F.col("loss") - F.lag("loss").over(Window.orderBy("epoch")))


def rank_by(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Each row's rank within its group; a large group is ranked by ranges of its order."""
    return ordered.numbered(ordered.in_ranges(df, [by], order), [by], order, "rank").select(*df.columns, "rank")


def eta(log: DataFrame, total: int, run: str = "run", time: str = "seconds") -> DataFrame:
    """Elapsed seconds since the run's first row, share done and seconds left at the pace so far."""
    ranged = ordered.in_ranges(log, [run], [time])
    first = ordered.carried(ranged, [run], {"__first": F.min(time)}, {"__first": F.min("__first")})
    df = ordered.same(ordered.numbered(ranged, [run], [time], "done"), first, [run, ordered.PART])
    local = Window.partitionBy(run, ordered.PART).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("elapsed", F.col(time) - F.least("__first", F.min(time).over(local)))
    df = df.withColumns({"progress": F.col("done") / F.lit(float(total)), "eta": F.col("elapsed") / F.col("done") * (total - F.col("done"))})
    return df.select(*log.columns, "done", "elapsed", "progress", "eta")


#: Shares of a group that may bound its least rows, and the accuracy of the bounds: a rank is off by 1 / ACCURACY of the group at most.
_SHARES, _ACCURACY = [2.0**-k for k in range(12)], 20_000


def _lowest_part(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """Rows of df with the n least ones by key of every group among them, ties and nulls included."""
    if not isinstance(df.schema[key].dataType, NumericType):
        return df
    found = df.groupBy(by).agg(F.count(key).alias("__n"), F.percentile_approx(key, _SHARES, _ACCURACY).alias("__q"))
    bound = None
    for k, share in enumerate(_SHARES):  # the last that holds wins: the least share
        holds = F.lit(share - 3 / _ACCURACY) * F.col("__n") >= n
        here = F.when(holds, F.get("__q", F.lit(k)))
        bound = here if bound is None else F.coalesce(here, bound)
    bounds = found.select(F.col(by).alias("__by"), bound.alias("__bound")).filter("__bound IS NOT NULL")
    near = by_group(df.withColumn("__by", F.col(by)), bounds, "__by", "left")
    return near.filter(F.col("__bound").isNull() | F.col(key).isNull() | (F.col(key) <= F.col("__bound"))).select(*df.columns)


def lowest_n_cyclic(df: DataFrame, by: str, order: list[str], n: int = 10000) -> DataFrame:
    """Exactly n rows of each group, least first, beginning again where a group has fewer; an empty group has none.

    Column position runs from 0 to n - 1.  Each kept row is repeated in place.

    Where the first order key is a number, rows beyond a bound that surely leaves n of
    their group are passed over before any are sorted.
    """
    df = _lowest_part(df, by, order[0], n)
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order))  # tasks pass on n rows of a group at most
    ranked = df.withColumn("rank", first).filter(F.col("rank") <= n)
    sizes = ranked.groupBy(by).agg(F.count("*").alias("__n"))
    at = F.sequence(F.col("rank") - 1, F.lit(n - 1), F.col("__n").cast("int"))
    return ranked.join(sizes, by).withColumn("position", F.explode(at)).drop("rank", "__n")


def epoch_shuffle(df: DataFrame, epoch: int, n: int | None = None, key: str = "pair_id") -> DataFrame:
    """Rows in an order that is the same for all readers of an epoch; the first n of them."""
    shuffled = df.orderBy(digest(key, F.lit(epoch)), key)
    return shuffled if n is None else shuffled.limit(n)
