"""Queries over category training, prediction and evaluation."""

from pyspark.sql import functions as F

from logrill.operators import classify
from logrill.sources import fixture as fx


def _training(spark, sf):
    return classify.load_training(fx.events(spark, sf).select("event_id", "message"))


def predict_category(spark, sf):
    return classify.predict_category(fx.log_events(spark, sf)).select(
        "event_id", "predicted_category", "predicted_confidence")


def stratified_split(spark, sf):
    return classify.stratified_split(_training(spark, sf)).select("event_id", "label", "is_test")


def classification_report(spark, sf):
    """Rule labels judged against labels in which critical events count as SYSTEM."""
    rows = fx.events(spark, sf).withColumn(
        "label", F.when(F.col("severity") == "crit", "SYSTEM").otherwise(F.col("predicted_category")))
    report = classify.classification_report(rows)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def train_classifier(spark, sf):
    """Quality of a trained model on the rows held out."""
    split = classify.stratified_split(_training(spark, sf))
    model = classify.train_classifier(split.where("not is_test").select("event_id", "message", "label"))
    return classify.classification_report(model.predict(split.where("is_test")))


def train_classifier_documents(spark, sf):
    """The same for documents with a given label."""
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("message"),
        F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("category"))
    split = classify.stratified_split(classify.load_training(docs))
    model = classify.train_classifier(split.where("not is_test").select("event_id", "message", "label"))
    return classify.classification_report(model.predict(split.where("is_test")))


QUERIES = {f.__name__: f for f in (
    predict_category, stratified_split, classification_report, train_classifier, train_classifier_documents)}
