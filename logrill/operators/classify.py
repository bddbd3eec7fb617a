"""Message categories: training, prediction, evaluation."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.text import weak_label
from logrill.session import materialize


def load_training(rows: DataFrame) -> DataFrame:
    """(message, label): the given category, else the rule label; no empty messages."""
    given = F.nullif(F.col("category"), F.lit("")) if "category" in rows.columns else F.lit(None)
    return rows.where(F.coalesce("message", F.lit("")) != "").withColumn(
        "label", F.coalesce(given, weak_label("message"))).drop("category")


def predict_category(events: DataFrame, model=None) -> DataFrame:
    """Most likely category and its probability; without a model the rule label at 0."""
    if model is None:
        return events.withColumns({
            "predicted_category": weak_label("message"), "predicted_confidence": F.lit(0.0)})
    return model.predict(events)


def stratified_split(rows: DataFrame, id_column: str = "event_id", label: str = "label",
                     test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the same share of every label, chosen by a seeded hash.

    A label may hold most rows, so the share is not cut by a rank over the label.
    The hash is spread over buckets, the bucket in which the share ends is found
    from counts, and only that bucket is ranked.
    """
    buckets = 4096
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    hashed = rows.withColumn("_h", digest).withColumn(
        "_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    assert buckets == 16 ** 3
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy(label))
    quota = counts.select(
        label, "_b", (F.floor(total * test_share) - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_left"),
        "_n")
    placed = hashed.join(quota, [label, "_b"], "left")
    inside = Window.partitionBy(label, "_b").orderBy("_h", id_column)
    cut = placed.where((F.col("_left") > 0) & (F.col("_left") < F.col("_n"))).withColumn(
        "_rn", F.row_number().over(inside)).where(F.col("_rn") <= F.col("_left")).select(
        id_column, F.lit(True).alias("_chosen"))
    out = placed.join(cut, id_column, "left")
    return out.withColumn("is_test", (F.col("_left") >= F.col("_n")) | F.coalesce("_chosen", F.lit(False))).drop(
        "_h", "_b", "_left", "_n", "_chosen")


def classification_report(predicted: DataFrame, label: str = "label",
                          prediction: str = "predicted_category") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    confusion = predicted.groupBy(F.col(label).alias("_l"), F.col(prediction).alias("_p")).agg(
        F.count("*").alias("_n"))
    sides = confusion.select("_n", F.explode(F.array(
        F.struct(F.col("_l").alias("category"), F.lit(1).alias("_true"), F.lit(0).alias("_said")),
        F.struct(F.col("_p").alias("category"), F.lit(0).alias("_true"), F.lit(1).alias("_said")))).alias("s"),
        (F.col("_l") == F.col("_p")).alias("_hit"))
    sums = sides.select("s.*", "_n", "_hit").groupBy("category").agg(
        F.sum(F.col("_n") * F.col("_true")).alias("support"),
        F.sum(F.col("_n") * F.col("_said")).alias("_said"),
        F.sum(F.when(F.col("_hit"), F.col("_n") * F.col("_true")).otherwise(0)).alias("_hits"))
    precision = F.when(F.col("_said") > 0, F.col("_hits") / F.col("_said")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("_hits") / F.col("support")).otherwise(0.0)
    both = sums.select("category", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1)


MIN_TRAINING_ROWS = 100
FOLDS = 3


def _tree_depth(parts: int) -> int:
    """The depth at which treeAggregate leaves the fewest partial sums of `parts` to the driver."""
    def left(depth):
        scale, n = max(2, int(np.ceil(parts ** (1 / depth)))), parts
        while n > scale + -(-n // scale):
            n //= scale
        return n

    return min(range(2, 6), key=lambda depth: (left(depth), depth))


def _machines(svm: LinearSVC, train: DataFrame, classes: int) -> list:
    """One model per class against the rest. Of two classes each is the rest of the other, so the only
    machine is that of the second; the margin of the first is its negative."""
    if classes == 2:
        return [svm.setLabelCol("_y").setFeaturesCol("features").setWeightCol("_weight").fit(train)]
    return OneVsRest(classifier=svm, labelCol="_y", featuresCol="features", weightCol="_weight",
                     predictionCol="_class", parallelism=4).fit(train).models


def _margins(machines: list, rows: DataFrame, classes: int) -> DataFrame:
    """Add ``_m``: the margin of every class."""
    out, margins = rows, []
    for c, model in enumerate(machines):
        model.setRawPredictionCol(f"_r{c}").setPredictionCol(f"_c{c}")
        out = model.transform(out)
        margins.append(vector_to_array(f"_r{c}")[1])
    if classes == 2:
        margins = [-margins[0], margins[0]]
    return out.withColumn("_m", F.array(*margins)).select(*rows.columns, "_m")


def _sigmoids(held: DataFrame, classes: int) -> list[tuple[float, float]]:
    """Slope and offset of a sigmoid per class (Platt, 1999).

    Margins are counted in bins of a thousandth between -20 and 20, a bounded
    table that holds all the fit needs; targets are smoothed, so separable
    classes stay finite.
    """
    margin = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("m"))), 3)
    bins = held.select("_y", F.posexplode("_m").alias("c", "m")).groupBy(
        "c", margin.alias("m"), (F.col("_y") == F.col("c")).alias("y")).agg(F.count("*").alias("n")).toPandas()
    found = []
    for c in range(classes):
        part = bins[bins["c"] == c]
        m, n, y = part["m"].to_numpy(float), part["n"].to_numpy(float), part["y"].to_numpy(bool)
        positive, negative = n[y].sum(), n[~y].sum()
        target = np.where(y, (positive + 1) / (positive + 2), 1 / (negative + 2))
        x = np.column_stack([m, np.ones(len(m))])
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ w)))
            slope = x.T @ (n * (p - target))
            curve = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        found.append((float(w[0]), float(w[1])))
    return found


class CategoryModel:
    """Calibrated one-vs-rest margins, averaged over the folds."""

    def __init__(self, features, folds, labels):
        self.features, self.folds, self.labels = features, folds, labels

    def predict(self, events: DataFrame) -> DataFrame:
        """Add ``predicted_category`` and ``predicted_confidence``.

        Every distinct message is scored once.
        """
        messages = events.select("message").distinct()
        scored = self.features.transform(messages)
        shares = []
        for i, (svm, platt) in enumerate(self.folds):
            scored = _margins(svm, scored, len(self.labels))
            p = [1 / (1 + F.exp(-(F.lit(a) * F.col("_m")[c] + F.lit(b)))) for c, (a, b) in enumerate(platt)]
            scored = scored.withColumn(f"_p{i}", F.array(*p)).drop("_m")
            total = F.aggregate(f"_p{i}", F.lit(0.0), lambda s, x: s + x)
            shares.append([F.col(f"_p{i}")[c] / total for c in range(len(self.labels))])
        mean = [sum(s[c] for s in shares) / len(shares) for c in range(len(self.labels))]
        best = F.array_max(F.array(*[
            F.struct(m.alias("p"), F.lit(-c).alias("c")) for c, m in enumerate(mean)]))
        named = scored.withColumn("_best", best).select(
            "message", F.element_at(F.array(*[F.lit(n) for n in self.labels]), (1 - F.col("_best.c")).cast("int"))
            .alias("predicted_category"), F.col("_best.p").alias("predicted_confidence"))
        return events.drop("predicted_category", "predicted_confidence").join(named, "message")


def train_classifier(rows: DataFrame, features: int = 20_000, min_df: float = 2, max_iter: int = 1000,
                     tolerance: float = 1e-4) -> CategoryModel:
    """TF-IDF of one- and two-word terms, linear SVMs with balanced class weights,
    sigmoid calibration on held-out folds. ``rows``: (event_id, message, label).

    A solver ends at the tolerance; max_iter only keeps a failing one from running on."""
    rows = materialize(rows.select("event_id", "message", "label"), "training")  # read by every fit
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    if total < MIN_TRAINING_ROWS:
        raise ValueError(f"need at least {MIN_TRAINING_ROWS} training rows, got {total}")
    labels = sorted(counts)
    words = RegexTokenizer(inputCol="message", outputCol="_w", pattern=r"\b\w\w+\b", gaps=False)
    pairs = NGram(n=2, inputCol="_w", outputCol="_w2")
    both = SQLTransformer(statement="SELECT *, concat(_w, _w2) AS _terms FROM __THIS__")
    vectors = [CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=features, minDF=min_df),
               IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]
    drop = SQLTransformer(statement="SELECT * EXCEPT (_w, _w2, _terms, _tf, _idf) FROM __THIS__")
    weight = F.element_at(F.create_map(*[
        F.lit(x) for n in labels for x in (n, total / (len(labels) * counts[n]))]), F.col("label"))
    indexed = rows.select(
        "event_id", "message", F.array_position(F.array(*[F.lit(n) for n in labels]), F.col("label")).cast("double").alias("_y"),
        weight.alias("_weight")).withColumn("_y", F.col("_y") - 1)
    prepared = Pipeline(stages=[words, pairs, both, *vectors, drop]).fit(indexed)
    train = prepared.transform(indexed).withColumn(
        "_fold", F.pmod(F.xxhash64("event_id"), F.lit(FOLDS))).select(
        "features", "_y", "_weight", "_fold").persist()
    # every evaluation of the loss sends its last partial sums to the driver
    svm = LinearSVC(maxIter=max_iter, tol=tolerance, aggregationDepth=_tree_depth(train.rdd.getNumPartitions()))
    folds = []
    for fold in range(FOLDS):
        model = _machines(svm, train.where(F.col("_fold") != fold), len(labels))
        held = _margins(model, train.where(F.col("_fold") == fold), len(labels)).select("_m", "_y").persist()
        platt = _sigmoids(held, len(labels))
        held.unpersist()
        folds.append((model, platt))
    train.unpersist()
    return CategoryModel(prepared, folds, labels)
