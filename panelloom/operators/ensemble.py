"""Self-paced ensembles for rare events: each tree sees all positives and a sample of negatives by how hard the trees before find them."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.shared import written

#: Members after which the summed scores are written; until then a score is a sum of few trees.
WRITE_EVERY = 4


def _added(frame: DataFrame, model) -> DataFrame:
    """``frame`` with the member's probability added to ``total``."""
    return model.transform(frame).withColumn("total", F.col("total") + vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")


def self_paced(train: DataFrame, test: DataFrame, keys: list[str], members: int = 20, bins: int = 10, depth: int = 5, label: str = "active", seed: int = 0) -> DataFrame:
    """``test`` with ``y_prob``, the mean of ``members`` trees. Both frames have ``features`` and ``label``; ``keys`` tell rows apart.

    Rows carry the sum of the members' scores so far: a new member is added to it once, so the work grows with the members and not with their
    square. Negatives fall into bins by their mean score, and a bin's share of the sample is inverse to its mean score plus a
    pace that rises with the members, so that the first trees see easy negatives as they are and the last ones every bin alike. Which rows
    are drawn is a hash of their keys, so it is the same twice.
    """
    start = lambda df: df.withColumn("total", F.lit(0.0))
    held = written(start(train.select(*keys, "features", F.col(label).cast("double").alias(label))))
    wanted, negatives = held.agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)), F.sum(F.when(F.col(label) > 0, 0).otherwise(1))).first()
    tested, models = start(test), []
    if not wanted or not negatives:  # one class: its share is the forecast
        return tested.withColumn("y_prob", F.lit(1.0 if wanted else 0.0)).drop("total")
    for k in range(members):
        score = F.col("total") / max(k, 1)
        cell = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
        stats = held.filter(F.col(label) <= 0).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("h")).collect()  # a row for each bin
        pace = {r.bin: 1.0 / (r.h + k / members + 1e-9) if k else float(r.n) for r in stats}
        share = {r.bin: min(1.0, wanted * pace[r.bin] / sum(pace.values()) / r.n) for r in stats}
        draw = F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 30)) / float(1 << 30)
        chance = F.element_at(F.create_map(*[x for b, v in share.items() for x in (F.lit(b), F.lit(v))]), cell)
        model = DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed + k).fit(held.filter((F.col(label) > 0) | (draw < chance)))
        models.append(model)
        held = _added(held, model)
        if (k + 1) % WRITE_EVERY == 0 and k + 1 < members:
            held = written(held)
    for model in models:
        tested = _added(tested, model)
    return tested.withColumn("y_prob", F.col("total") / members).drop("total")
