"""Nearest neighbours between point tables, by buckets as wide as the search radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions.draws import digest, uniform


def l2_normalize(df: DataFrame, col: str) -> DataFrame:
    """Each array to length one; a zero array stays."""
    norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return df.withColumn("__n", norm).withColumn(col, F.transform(F.col(col), lambda v: F.when(F.col("__n") == 0, v.cast("double")).otherwise(v / F.col("__n")))).drop("__n")


def concat_features(df: DataFrame, first: str, second: str, name: str = "feature") -> DataFrame:
    return df.withColumn(name, F.concat(first, second))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _near(a: DataFrame, b: DataFrame, cols: tuple[str, str], radius: float, by: list[str]) -> DataFrame:
    """Rows of a with every row of b (prefixed b_) in their own and the eight buckets around; every b within radius is among them."""
    u, v = cols
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    left = a.withColumn("__i", F.explode(F.transform(around, lambda k: k + cell(u)))).withColumn("__j", F.explode(F.transform(around, lambda k: k + cell(v))))
    right = b.select(*by, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in by)).withColumns({"__i": F.floor(F.col(f"b_{u}") / F.lit(float(radius))), "__j": F.floor(F.col(f"b_{v}") / F.lit(float(radius)))})
    return left.join(right, [*by, "__i", "__j"]).drop("__i", "__j")


def _weighted_arrays(rows: str, name: str) -> Column:
    """Mean of the arrays of a list of structs (w, arrays), element by element, weighted by w."""
    first, rest = F.element_at(rows, 1), F.slice(rows, 2, F.size(rows))
    scaled = lambda x: F.transform(x[name], lambda v: v * x["w"])
    total = F.aggregate(rest, scaled(first), lambda acc, x: F.zip_with(acc, scaled(x), lambda p, q: p + q))
    weight = F.aggregate(F.transform(rows, lambda x: x["w"]), F.lit(0.0), lambda s, w: s + w)
    return F.transform(total, lambda v: v / weight)


def knn_idw(queries: DataFrame, patches: DataFrame, k: int = 4, limit: float = 256.0, metric: str = "l2sq", values: tuple = ("conf", "x", "y", "h"), query_key: str = "query_id", patch_key: str = "patch_id", by: tuple = (), arrays: tuple = ()) -> DataFrame:
    """Inverse-distance mean of values, and of arrays, over each query's k nearest patches of its own group (by), in (line, samp).

    A query counts only if its k-th distance is under limit (squared for l2sq), so
    buckets of that radius hold all neighbours that can count.  Equal distances go
    to the smaller patch.  A patch is told apart by by and patch_key.  Queries at one place are answered once.
    """
    radius = limit**0.5 if metric == "l2sq" else limit
    place = [*by, "line", "samp"]
    near = _near(queries.select(*place).distinct(), patches.select(patch_key, *place, *values), ("line", "samp"), radius, list(by))
    d2 = F.pow(F.col("line") - F.col("b_line"), 2) + F.pow(F.col("samp") - F.col("b_samp"), 2)
    near = near.withColumn("d", d2 if metric == "l2sq" else F.sqrt(d2)).filter(F.col("d") < limit)
    order = Window.partitionBy(*place).orderBy("d", f"b_{patch_key}")
    best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).withColumn("w", 1.0 / (F.col("d") + 1e-6))
    means, lists = [(F.sum(F.col("w") * F.col(f"b_{v}")) / F.sum("w")).alias(v) for v in values], []
    if arrays:  # fetched for the nearest alone
        best = best.join(patches.select(*by, F.col(patch_key).alias(f"b_{patch_key}"), *(F.col(a).alias(f"b_{a}") for a in arrays)), [*by, f"b_{patch_key}"])
        lists = [F.sort_array(F.collect_list(F.struct("n", "w", *(F.transform(f"b_{a}", lambda v: v.cast("double")).alias(a) for a in arrays)))).alias("__near")]
    found = best.groupBy(*place).agg(F.count("*").alias("n"), *means, *lists).filter(F.col("n") == k)
    found = found.select(*place, *values, *(_weighted_arrays("__near", a).alias(a) for a in arrays))
    return queries.select(query_key, *place).join(found, place).select(query_key, *by, *values, *arrays)


def nearest_within(a: DataFrame, b: DataFrame, limit: float, a_key: str = "a_id", b_key: str = "b_id", cols: tuple = ("x", "y")) -> DataFrame:
    """For each row of a its nearest row of b under limit; equal distances go to the smaller key."""
    near = _near(a.select(a_key, *cols), b.select(b_key, *cols), cols, limit, [])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"b_{c}"), 2) for c in cols), F.lit(0.0)))
    best = near.withColumn("d", d).filter(F.col("d") < limit).groupBy(a_key).agg(F.min(F.struct("d", f"b_{b_key}")).alias("m"))
    return best.select(a_key, F.col(f"m.b_{b_key}").alias(b_key), F.col("m.d").alias("distance"))


def far_negatives(anchors: DataFrame, cands: DataFrame, min_dist: float = 100.0, seed: int = 0, tries: int = 4, a_key: str = "a_id", b_key: str = "b_id", cols: tuple = ("x", "y")) -> DataFrame:
    """A pseudo-random candidate for each anchor: the first of `tries` draws at least min_dist away, or else the last.

    Candidates get running numbers by slices of their order, so that no task numbers them all.
    """
    numbered = running_number(cands.select(b_key, *cols), b_key, "__k")
    n = cands.count()
    if n == 0:
        return anchors.select(a_key, F.lit(None).cast(cands.schema[b_key].dataType).alias(b_key), F.lit(None).cast("double").alias("distance")).limit(0)
    draws = anchors.select(a_key, *cols, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.floor(uniform(a_key, t, F.lit(seed)) * F.lit(float(n))))).alias("try", "__k"))
    j = draws.join(numbered.select("__k", b_key, *(F.col(c).alias(f"b_{c}") for c in cols)), "__k")
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"b_{c}"), 2) for c in cols), F.lit(0.0)))
    rank = F.when(F.col("distance") >= min_dist, F.col("try")).otherwise(F.lit(2 * tries) - F.col("try"))
    return j.withColumn("distance", d).groupBy(a_key).agg(F.min_by(F.struct(b_key, "distance"), rank).alias("m")).select(a_key, "m.*")


def running_number(df: DataFrame, key: str, name: str, slice_digits: int = 4) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of a hash of key: counts of slices (65,536 of them) first, then numbers within each."""
    h = df.withColumn("__h", digest(key)).withColumn("__s", F.substring("__h", 1, slice_digits))
    before = h.groupBy("__s").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__s").orderBy("__h", key))
    return h.withColumn("__n", within).join(before, "__s").withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__h", "__s", "__n", "__before")


def feature_pca(df: DataFrame, k: int = 3, col: str = "feature", key: str = "patch_id") -> DataFrame:
    """The first k principal components of centred features, as an array column pca.

    The covariance comes from one aggregate (MLlib); only the k directions, as wide as a feature, reach the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = df.select(key, array_to_vector(F.transform(F.col(col), lambda v: v.cast("double"))).alias("__v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(vectors).transform(vectors)
    done = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return done.select(key, vector_to_array("__p").alias("pca"))
