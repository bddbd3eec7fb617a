"""Message templates by masking or by token-tree clustering."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import col
from logrill.functions.text import mask_template
from logrill.session import materialize

WILDCARD = "<*>"
MOST_TOKENS = 32  # different tokens in one place of a leaf, beyond which the place is a wildcard
FEWER_TOKENS = (8, 2, 1)  # the same, one after the other, for leaves that still have too many templates
MOST_TEMPLATES, COMPARED = 1024, 1 << 27  # templates of a leaf, and tokens compared between them
LEAF_ROWS, LEAF_LETTERS = 4096, 1 << 23  # a leaf with no more is mined as one group


def mine_templates(events: DataFrame, mode: str = "mask", message: str = "message",
                   depth: int = 4, similarity: float = 0.4) -> DataFrame:
    """Add ``template_id``, ``template`` and ``template_size`` to every message.

    mask: digits masked, the id is a content hash. drain: fixed-depth token tree
    (He et al., ICWS 2017), whose templates merge tokens that differ to wildcards;
    they depend on the set of messages only. A null message counts as an empty one.
    """
    if mode == "mask":
        with_template = events.withColumn("template", mask_template(F.coalesce(col(message), F.lit(""))))
        with_template = with_template.withColumn("template_id", F.md5("template"))
    elif mode == "drain":
        masked = mask_template(F.coalesce(col(message), F.lit("")))
        found = _drain(events.select(masked.alias("_masked")), depth, similarity)
        with_template = events.withColumn("_masked_id", F.md5(masked)).join(found, "_masked_id", "left").drop("_masked_id")
    else:
        raise ValueError("mode must be mask or drain")
    sizes = with_template.groupBy("template_id").agg(F.count("*").alias("template_size"))
    return with_template.join(sizes, "template_id")


def _tokens(c):
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _merged(templates: list[str], similarity: float) -> tuple[list[str], list[int]]:
    """Join templates of equal length that share at least `similarity` of their tokens, directly or through others.

    Equal wildcards are not shared tokens. Where joined templates differ, theirs
    has a wildcard. The order of the templates does not matter.
    """
    number = {WILDCARD: 0}
    known = np.array([[number.setdefault(t, len(number)) for t in template.split(" ")] for template in templates], np.int64)
    member, texts, names = np.full(len(known), -1), [], list(number)
    for first in range(len(known)):
        if member[first] >= 0:
            continue
        member[first], reached = len(texts), [first]
        for i in reached:
            left = np.flatnonzero(member < 0)
            near = left[((known[left] == known[i]) & (known[i] != 0)).sum(axis=1) >= similarity * known.shape[1]]
            member[near] = len(texts)
            reached.extend(near.tolist())
        same = (known[reached] == known[first]).all(axis=0)
        texts.append(" ".join(names[t] if s else WILDCARD for t, s in zip(known[first], same)))
    return texts, member.tolist()


def _generalised(rows: DataFrame, most: int) -> DataFrame:
    """Wildcards in `tokens` where rows of a leaf hold more than `most` different tokens in one place.

    Only leaves of more than `most` rows can; their tokens are counted in two
    steps, so a leaf with most rows is spread by its tokens.
    """
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("leaf")
    large = rows.join(sizes, "leaf", "left_semi")
    places = large.select("leaf", F.posexplode("tokens").alias("place", "token")).distinct()
    varied = places.groupBy("leaf", "place").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    wild = varied.groupBy("leaf").agg(F.collect_set("place").alias("_wild"))
    masked = F.transform("tokens", lambda t, i: F.when(F.array_contains("_wild", i), WILDCARD).otherwise(t))
    return rows.join(wild, "leaf", "left").withColumn(
        "tokens", F.when(F.col("_wild").isNull(), F.col("tokens")).otherwise(masked)).drop("_wild")


def _drain(masked: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(_masked_id, template_id, template) for every distinct masked message.

    A leaf of the tree holds the messages of one token count and equal leading
    tokens. Places with more than MOST_TOKENS different tokens in a leaf become
    wildcards, and only the templates that are left are compared. A leaf that
    still has more than its allowance is generalised further, by fewer tokens
    each time; in the end every place that varies is a wildcard. A leaf of bounded
    size moves once and is mined in one place; only larger ones are spread.
    """
    tokens = _tokens("_masked")
    heads = F.transform(F.slice(tokens, 1, max(depth - 2, 1)),
                        lambda t: F.when(t.rlike("[0-9]|<\\*>"), WILDCARD).otherwise(t))
    leaf = F.concat_ws(" ", F.size(tokens).cast("string"), F.array_join(heads, " "))
    texts = materialize(masked.select("_masked").distinct().select(
        F.md5("_masked").alias("_masked_id"), leaf.alias("leaf"), F.array_join(tokens, " ").alias("before")), "drain")
    sizes = materialize(texts.groupBy("leaf").agg(
        F.count("*").alias("_n"), F.sum(F.length("before")).alias("_letters")), "leaves")
    bounded, several = (F.col("_n") <= LEAF_ROWS) & (F.col("_letters") <= LEAF_LETTERS), F.col("_n") > 1
    limits = MOST_TOKENS, FEWER_TOKENS, MOST_TEMPLATES, COMPARED

    def mined(key, frame):
        return pd.DataFrame({"_masked_id": frame["_masked_id"], "leaf": key[0],
                             "template": _leaf_templates(frame["before"].tolist(), similarity, *limits)})

    def of(which):
        return sizes.where(which).select("leaf")

    template_id = F.md5(F.concat_ws("\t", "leaf", "template")).alias("template_id")
    alone = texts.withColumnRenamed("before", "template").select("_masked_id", "leaf", template_id, "template").join(
        of(~several), "leaf", "left_semi").drop("leaf")  # a text alone in its leaf is its template
    found = texts.join(of(several & bounded), "leaf", "left_semi").groupBy("leaf").applyInPandas(
        mined, "_masked_id string, leaf string, template string")
    if sizes.where(several & ~bounded).limit(1).count():
        large = texts.join(of(several & ~bounded), "leaf", "left_semi")
        found = found.unionByName(_drain_large(large, similarity))
    return found.select("_masked_id", template_id, "template").unionByName(alone)


def _leaf_templates(texts: list[str], similarity: float, most_tokens: int, fewer_tokens: tuple[int, ...],
                    most_templates: int, compared: int) -> list[str]:
    """The template of each text of a whole leaf; what `_drain_large` does to a leaf that is spread over tasks."""
    number = {WILDCARD: 0}
    known = np.array([[number.setdefault(t, len(number)) for t in text.split(" ")] for text in texts], np.int64)

    def generalised(most):
        if len(known) <= most:
            return known
        varied = (np.diff(np.sort(known, axis=0), axis=0) != 0).sum(axis=0) + 1 > most
        return np.where(varied, 0, known)

    known = generalised(most_tokens)
    allowed = max(1, min(most_templates, int(np.sqrt(compared / known.shape[1]))))
    for most in fewer_tokens:
        if len(np.unique(known, axis=0)) <= allowed:
            break
        known = generalised(most)
    distinct, at = np.unique(known, axis=0, return_inverse=True)
    names = list(number)
    found = [" ".join(names[t] for t in row) for row in distinct]
    if len(found) > 1:
        joined, member = _merged(found, similarity)
        found = [joined[m] for m in member]
    return [found[i] for i in at.reshape(-1)]


def _drain_large(texts: DataFrame, similarity: float) -> DataFrame:
    """(_masked_id, leaf, template) of the leaves that are too large for one group."""
    rows = texts.select("_masked_id", "leaf", F.filter(F.split("before", " "), lambda t: t != "").alias("tokens"))
    rows = materialize(_generalised(rows, MOST_TOKENS), "drain")
    allowed = F.least(F.lit(MOST_TEMPLATES), F.floor(F.sqrt(F.lit(COMPARED) / F.greatest(F.size("tokens"), F.lit(1)))))
    for most in FEWER_TOKENS:
        templates = rows.select("leaf", "tokens").distinct()
        full = templates.groupBy("leaf").agg(F.count("*").alias("_n"), F.min(allowed).alias("_most")).where(
            F.col("_n") > F.greatest("_most", F.lit(1))).select("leaf")
        if not full.limit(1).count():
            break
        more = _generalised(rows.join(full, "leaf", "left_semi"), most)
        rows = materialize(rows.join(full, "leaf", "left_anti").unionByName(more), "drain")

    def merged(key, frame):
        texts, member = _merged(frame["before"].tolist(), similarity)
        return pd.DataFrame({"leaf": key[0], "before": frame["before"], "template": [texts[m] for m in member]})

    before = F.array_join("tokens", " ").alias("before")
    templates = rows.groupBy("leaf", "tokens").agg(F.lit(1)).select("leaf", before)
    several = templates.groupBy("leaf").agg(F.count("*").alias("_n")).where("_n > 1").select("leaf")
    joined = templates.join(several, "leaf", "left_semi").groupBy("leaf").applyInPandas(
        merged, "leaf string, before string, template string")
    found = rows.select("_masked_id", "leaf", before).join(joined, ["leaf", "before"], "left")
    return found.select("_masked_id", "leaf", F.coalesce("template", "before").alias("template"))
