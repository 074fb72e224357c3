"""Land-cover labels, spatial folds, classification and clustering of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["row", "col"]


def footprint_samples(cells: DataFrame, n: int, size: float) -> DataFrame:
    """n x n evenly spaced points in each cell's square."""
    grid = F.sequence(F.lit(0), F.lit(n - 1))
    rows = cells.select(*KEYS, "x", "y", F.explode(grid).alias("i")).withColumn("j", F.explode(grid))
    at = lambda c, k: F.col(c) - size / 2 + (F.col(k) + 0.5) * size / n
    return rows.select(*KEYS, (F.col("i") * n + F.col("j")).alias("point"), at("x", "j").alias("px"), at("y", "i").alias("py"))


def footprint_label(points: DataFrame, tiles: DataFrame, size: float, valid: list[int], least_purity: float = 0.0) -> DataFrame:
    """Dominant valid class of each cell's points, with purity, valid and covered shares.

    Points meet tiles by the number of the square they fall into (``tile_x``, ``tile_y``); of
    several tiles there the first by ``tile`` counts. Ties of classes go to the lowest code.
    """
    spots = points.withColumns({"tile_x": F.floor(F.col("px") / size).cast("int"), "tile_y": F.floor(F.col("py") / size).cast("int")})
    first = tiles.groupBy("tile_x", "tile_y").agg(F.min_by("code", "tile").alias("code"))
    j = spots.join(first, ["tile_x", "tile_y"], "left")
    good = F.col("code").isin(*valid)
    n = j.groupBy(*KEYS, F.when(good, F.col("code")).alias("code")).agg(F.count("*").alias("n"), F.sum(F.col("code").isNotNull().cast("int")).alias("covered"))
    g = n.groupBy(*KEYS).agg(F.sum("n").alias("n_points"), F.sum(F.when(F.col("code").isNotNull(), F.col("n"))).alias("n_valid"), F.sum("covered").alias("n_covered"), F.max_by("code", F.when(F.col("code").isNotNull(), F.struct("n", -F.col("code")))).alias("code"), F.max(F.when(F.col("code").isNotNull(), F.col("n"))).alias("most"))
    purity = F.col("most") / F.col("n_valid")
    return g.select(*KEYS, F.when(purity >= least_purity, F.col("code")).alias("code"), purity.alias("purity"), (F.coalesce("n_valid", F.lit(0)) / F.col("n_points")).alias("valid_fraction"), (F.col("n_covered") / F.col("n_points")).alias("tile_fraction"), "n_points")


def spatial_folds(df: DataFrame, klass: str, block: str, folds: int) -> DataFrame:
    """A fold for each block, blocks kept whole: at most as many folds as the rarest class has blocks, and two at least.

    Blocks are ranked by their commonest class, then by their rows, largest first, and dealt to folds to
    and fro: of each class every fold gets as many blocks as any other but for one, and large blocks
    of one turn are made up for in the next. The rank is by ranges, so no task sees all blocks.
    """
    from terracause.operators.ranks import ranked

    per = df.groupBy(klass).agg(F.countDistinct(block).alias("_k")).agg(F.min("_k").alias("_k")).first()["_k"] or 0
    n = max(2, min(folds, per))
    own = df.groupBy(block, klass).agg(F.count("*").alias("_n")).groupBy(block).agg(F.max_by(klass, F.struct("_n", klass)).alias("_c"), F.sum("_n").alias("_n"))
    turn = F.col("_r") % (2 * n)
    return ranked(own, [F.asc("_c"), F.desc("_n"), F.asc(block)], "_r").select(block, F.when(turn < n, turn).otherwise(2 * n - 1 - turn).cast("int").alias("fold"))


def confusion(df: DataFrame, truth: str, guess: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), truth, guess).agg(F.count("*").alias("n"))


def confusion_metrics(df: DataFrame, truth: str, guess: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1 from the confusion counts."""
    keys = keys or []
    c = confusion(df, truth, guess, keys)
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    true_side = c.groupBy(*keys, F.col(truth).alias("_k")).agg(F.sum("n").alias("_t"), F.sum(hit).alias("_h"))
    said_side = c.groupBy(*keys, F.col(guess).alias("_k")).agg(F.sum("n").alias("_s"))
    j = true_side.join(said_side, [*keys, "_k"], "full")
    t, s, h = (F.coalesce(x, F.lit(0)) for x in ("_t", "_s", "_h"))
    f1 = F.when(t + s > 0, 2 * h / (t + s))
    g = j.select(*keys, t.alias("t"), h.alias("h"), f1.alias("f1"), F.when(t > 0, h / t).alias("recall"))
    agg = [F.sum("t").alias("n"), (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("weighted_f1")]
    return g.groupBy(*keys).agg(*agg) if keys else g.agg(*agg)


def class_weights(df: DataFrame, klass: str) -> DataFrame:
    """``weight`` of each row: rows over (classes x rows of its class)."""
    n = df.groupBy(klass).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n.crossJoin(F.broadcast(total))), klass).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def _pipeline(features: list[str], kind: str, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_f_{f}" for f in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    if kind == "forest":
        steps.append(RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="weight", numTrees=20, maxDepth=5, seed=seed))
    else:
        steps.append(LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="weight", maxIter=50, regParam=0.01))
    return Pipeline(stages=steps)


def spatial_cv(df: DataFrame, features: list[str], klass: str, fold: str, kind: str = "forest", seed: int = 1) -> DataFrame:
    """Predictions of each fold by a model trained on the others: ``truth``, ``guess``, and the majority class of the training rows.

    ``klass`` holds whole numbers from 0. The samples are written once, since every fold's fit reads them several times.
    """
    from terracause.sources.tables import scratch, table_replace

    typed = df.select(*dict.fromkeys([*KEYS, fold, klass]), F.col(klass).cast("double").alias("_label"), *[F.col(f).cast("double").alias(f) for f in features if f not in (*KEYS, fold, klass)])
    typed = table_replace(typed, scratch(df.sparkSession, "samples"))
    folds = sorted(r[0] for r in typed.select(fold).distinct().collect())
    out = None
    for k in folds:
        train, test = class_weights(typed.where(F.col(fold) != k), klass), typed.where(F.col(fold) == k)
        model = _pipeline(features, kind, seed).fit(train)
        most = train.groupBy(klass).count().orderBy(F.desc("count"), klass).first()[0]
        part = model.transform(test).select(*KEYS, F.lit(k).alias("fold"), F.col(klass).alias("truth"), F.col("prediction").cast("int").alias("guess"), F.lit(most).alias("majority"))
        out = part if out is None else out.unionByName(part)
    return out


def feature_importance(df: DataFrame, features: list[str], klass: str, kind: str = "forest", seed: int = 1) -> DataFrame:
    """Importances of a forest, or mean absolute coefficients of a logistic regression, fitted on all rows."""
    import numpy as np

    typed = class_weights(df, klass).withColumn("_label", F.col(klass).cast("double")).withColumns({f: F.col(f).cast("double") for f in features})
    last = _pipeline(features, kind, seed).fit(typed).stages[-1]
    values = last.featureImportances.toArray() if kind == "forest" else np.abs(last.coefficientMatrix.toArray()).mean(0)
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def graph_order(df: DataFrame, features: list[str]) -> DataFrame:
    """Score on the first principal component; its sign makes the largest loading positive. The rows are written once: the fit and the scores read them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    from terracause.sources.tables import scratch, table_replace

    data = assembled(table_replace(df, scratch(df.sparkSession, "vectors")), features)
    model = PCA(k=1, inputCol="_x", outputCol="_p").fit(data)
    load = model.pc.toArray()[:, 0]
    sign = 1.0 if load[abs(load).argmax()] >= 0 else -1.0
    return model.transform(data).withColumn("score", vector_to_array("_p")[0] * sign).drop("_x", "_p")


def graph_cluster(df: DataFrame, features: list[str], k: int, seed: int = 1) -> tuple[DataFrame, float]:
    """Clusters by bisecting k-means, which scales where a Ward tree over all pixels doesn't; and their silhouette.

    The rows are written once, since every round of the fit reads them.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from terracause.sources.tables import scratch, table_replace

    data = assembled(table_replace(df, scratch(df.sparkSession, "vectors")), features)
    out = BisectingKMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(data).transform(data)
    several = out.select("cluster").distinct().count() > 1
    score = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(out) if several else float("nan")
    return out.drop("_x"), score


def cluster_centroids(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Mean of each feature per cluster, as long rows."""
    g = df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])
    return g.select(cluster, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])))


def cluster_cosine(centroids: DataFrame, cluster: str) -> DataFrame:
    """Cosine similarity of every pair of centroids."""
    a = centroids.select(F.col(cluster).alias("a"), "feature", F.col("value").alias("x"))
    b = centroids.select(F.col(cluster).alias("b"), "feature", F.col("value").alias("y"))
    g = a.join(b, "feature").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("_d"), F.sum(F.col("x") * F.col("x")).alias("_p"), F.sum(F.col("y") * F.col("y")).alias("_q"))
    return g.select("a", "b", F.try_divide("_d", F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.sqrt(F.col("_p") * F.col("_q")))).alias("cosine"))


