"""Classification and clustering with Spark ML and with plain aggregates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.aggregates import class_weights, scores
from granary.operators.sampling import draw
from granary.plans.staging import stage


def vectors(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def centroid_predictions(df: DataFrame, key: str, cls: str, vec: str, strip: str) -> DataFrame:
    """Leave-one-strip-out: each row gets the class whose mean vector over the other strips is nearest. (key, strip, truth, pred)."""
    long = df.select(key, cls, strip, F.posexplode(F.col(vec).cast("array<double>")).alias("d", "x"))
    part = long.groupBy(strip, cls, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = part.groupBy(cls, "d").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    held = df.select(strip).distinct()
    rest = held.crossJoin(whole).join(part, [strip, cls, "d"], "left").withColumn("n", F.col("tn") - F.coalesce("n", F.lit(0)))
    mean = rest.where("n > 0").select(strip, F.col(cls).alias("pred"), "d", ((F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.col("n")).alias("m"))
    mean = mean.groupBy(strip, "pred").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda e: e["m"]).alias("mean"))
    model = mean.groupBy(strip).agg(F.collect_list(F.struct("pred", "mean")).alias("model"))  # one row a strip, one entry a class
    dist = lambda m: F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.transform("model", lambda m: F.struct(F.round(dist(m), 9).alias("dist"), m["pred"].alias("pred"))))
    return df.join(model, strip).select(key, strip, F.col(cls).alias("truth"), near["pred"].alias("pred"))


def cross_validate(df: DataFrame, cls: str, strip: str, estimator, strips: list, usable=None) -> DataFrame:
    """(strip, truth, pred): out-of-fold predictions over the strips.

    estimator: of Spark ML, or a function that gives one for so many training
    rows. usable: which rows may train; all are predicted.
    """
    out = None
    for s in strips:
        train = df.where(F.col(strip) != s)
        train = train if usable is None else train.where(usable)
        p = _fitted(train, cls, estimator).transform(df.where(F.col(strip) == s))
        p = p.select(F.col(strip).alias("strip"), F.col(cls).alias("truth"), F.col("prediction").cast("int").alias("pred"))
        out = p if out is None else out.union(p)
    return out


def _fitted(train: DataFrame, cls: str, estimator):
    """The estimator's model of the training rows, classes weighed alike."""
    train = train.join(F.broadcast(class_weights(train, cls)), cls)
    return (estimator(train.count()) if callable(estimator) else estimator).fit(train)


def logistic(c: float = 1.0):
    """Balanced multinomial logistic regression for so many rows: the penalty's weight is 1 / (C x rows)."""
    return lambda n: LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", regParam=1.0 / (c * max(1, n)), maxIter=60)


def forest(trees: int = 60) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, minInstancesPerNode=2, seed=7)


def boosting(rounds: int = 200) -> OneVsRest:
    """Gradient boosting of shallow trees, one class against the rest each."""
    return OneVsRest(labelCol="label", weightCol="weight", classifier=GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=7))


def perceptron(layers: list[int]) -> MultilayerPerceptronClassifier:
    """A dense network with sigmoid layers."""
    return MultilayerPerceptronClassifier(labelCol="label", layers=layers, maxIter=200, seed=7)


def parameter_count(layers: list[int]) -> int:
    """Weights and biases of dense layers of these widths."""
    return sum((a + 1) * b for a, b in zip(layers, layers[1:], strict=False))


def nested_cross_validate(df: DataFrame, cls: str, strip: str, candidates: dict, strips: list) -> DataFrame:
    """(strip, truth, pred, chosen): each strip is predicted by the candidate that does best across the strips left, by balanced accuracy, the first on ties."""
    out, df = None, df.persist()
    for s in strips:
        rest, best = [x for x in strips if x != s], (-1.0, None)
        for name, estimator in candidates.items():
            p = cross_validate(df.where(F.col(strip) != s), cls, strip, estimator, rest).withColumn("all", F.lit(1))
            got = scores(p, ["all"], "truth", "pred").first()["balanced"]
            best = max(best, (got, name), key=lambda x: x[0])
        p = _fitted(df.where(F.col(strip) != s), cls, candidates[best[1]]).transform(df.where(F.col(strip) == s))
        p = p.select(F.col(strip).alias("strip"), F.col(cls).alias("truth"), F.col("prediction").cast("int").alias("pred"), F.lit(best[1]).alias("chosen"))
        out = p if out is None else out.union(p)
    return out


def importance(df: DataFrame, cls: str, estimator, names: list[str] | None = None) -> DataFrame:
    """(feature, importance) of a forest, or the mean size of a logistic model's weights, the largest first."""
    model = _fitted(df, cls, estimator)
    got = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficientMatrix.toArray()).mean(axis=0)
    names = names or [f"f{i}" for i in range(len(got))]
    return df.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, got, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def label_ablation(df: DataFrame, cls: str, strip: str, estimator, strips: list, sure) -> DataFrame:
    """(training, n, accuracy, balanced): all labels against the sure ones as training rows, both scored on all rows."""
    out = None
    for name, usable in (("all", None), ("sure", sure)):
        one = scores(cross_validate(df, cls, strip, estimator, strips, usable).withColumn("training", F.lit(name)), ["training"], "truth", "pred")
        out = one if out is None else out.union(one)
    return out


def scored_blocks(pixels: DataFrame, model, block: str, classes: int) -> DataFrame:
    """pixels with `probs` of a fitted model; blocks stay together, so a writer partitioned by block needs no further shuffle."""
    out = model.transform(pixels.repartition(block))
    return out.withColumn("probs", F.slice(vector_to_array("probability"), 1, classes)).drop("probability", "rawPrediction")


def best_kmeans(df: DataFrame, ks: range, seeds: int = 3) -> DataFrame:
    """(k, cost, silhouette) of the best of some seeds for each k; squared Euclidean silhouette."""
    spark, rows = df.sparkSession, []
    for k in ks:
        model = min((KMeans(k=k, seed=s, maxIter=20).fit(df) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(df)))))
    return spark.createDataFrame(rows, "k int, cost double, silhouette double")


def few_label_curve(df: DataFrame, cls: str, key: str, vec: str, sizes: list[int], draws: int) -> DataFrame:
    """(labels, mean, std): balanced accuracy of the nearest centroid of few labels, over draws; std is of the sample.

    The draws are those of few_labels with the seeds 0, 1, ...; all sizes and
    draws share one plan, in which each is a row with its centroids.
    """
    most = max(sizes)
    d = df.select(key, F.col(cls).alias("pred"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("seed")).withColumn("_d", draw(F.col(key), F.col("seed")))
    # No draw takes more than `most` of a class, so that the order over all classes is of few rows.
    top = d.withColumn("_c", F.row_number().over(Window.partitionBy("seed", "pred").orderBy("_d", key))).where(F.col("_c") <= most)
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.when(F.col("_c") == 1, 0).otherwise(1), "_d", key))
    wanted = F.array(*map(F.lit, sizes))
    train = stage(top.withColumn("_p", place).withColumn("labels", F.explode(F.filter(wanted, lambda n: n >= F.col("_p")))).select("labels", "seed", key, "pred"), "few-labels")
    long = train.join(df.select(key, vec), key).select("labels", "seed", "pred", F.posexplode(F.col(vec).cast("array<double>")).alias("d", "x"))
    mean = long.groupBy("labels", "seed", "pred", "d").agg(F.avg("x").alias("m")).groupBy("labels", "seed", "pred").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda e: e["m"]).alias("mean"))
    models = mean.groupBy("labels", "seed").agg(F.collect_list(F.struct("pred", "mean")).alias("model")).join(train.groupBy("labels", "seed").agg(F.collect_set(key).alias("taken")), ["labels", "seed"])
    rest = df.select(key, F.col(cls).alias("truth"), F.col(vec).cast("array<double>").alias("v")).crossJoin(F.broadcast(stage(models, "centroids"))).where(~F.array_contains("taken", F.col(key)))
    dist = lambda m: F.aggregate(F.zip_with("v", m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = rest.select("labels", "seed", "truth", F.array_min(F.transform("model", lambda m: F.struct(F.round(dist(m), 9).alias("dist"), m["pred"].alias("pred"))))["pred"].alias("pred"))
    return scores(near, ["labels", "seed"], "truth", "pred").groupBy("labels").agg(F.avg("balanced").alias("mean"), F.stddev("balanced").alias("std"))


def stratified_folds(df: DataFrame, cls: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(cls).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(w), F.lit(k)))


def pseudo_labels(df: DataFrame, prob: str, labelled: str, least: float = 0.95, weight: float = 0.3) -> DataFrame:
    """Unlabelled rows whose likeliest class is sure enough, with the weight they train with."""
    return df.where(~F.col(labelled) & (F.array_max(prob) >= least)).withColumn("pred", F.array_position(prob, F.array_max(prob)).cast("int") - 1).withColumn("weight", F.lit(weight))
