"""Group-robust training by balanced batches: one gradient and one q step per batch.

The model is a logistic one over numeric columns. Every batch holds the same number of
rows of each group. A step is one aggregate over its batch: mean loss and mean gradient
by group; groups x (columns + 2) numbers pass through the driver, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import sigmoid
from plumbline.functions.session import cut
from plumbline.operators.contexts import balanced_batches
from plumbline.operators.contracts import ContractError
from plumbline.operators.profile import log_loss
from plumbline.roles import require


@dataclass(frozen=True)
class LogisticModel:
    """Intercept and one weight per column."""

    columns: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def probability(self) -> Column:
        # one array literal: new weights don't make Spark compile new code at every step
        known = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")
        x = F.array(*[F.col(c).cast("double") for c in self.columns])
        z = F.aggregate(F.zip_with(x, known, lambda a, w: a * w), F.lit(self.intercept), lambda s, v: s + v)
        return sigmoid(z)


def group_weights_step(q: dict, loss: dict, sizes: dict, step: float, adjustment: float) -> dict:
    """q after one exponentiated-gradient step, in log space; a zero step leaves it as it is."""
    if step == 0:
        return q
    moved = {g: math.log(q[g]) + step * (loss[g] + adjustment / math.sqrt(sizes[g])) for g in q}
    top = max(moved.values())
    total = sum(math.exp(m - top) for m in moved.values())
    return {g: math.exp(m - top) / total for g, m in moved.items()}


def batched_group_dro(
    df: DataFrame, columns: Sequence[str], batch_size: int, steps: int, step: float, rate: float, adjustment: float = 0.0,
    group: str = "grp", target: str = "y", seed: object = 0, row_id: str = "row_id",
) -> tuple[LogisticModel, DataFrame]:
    """``steps`` updates from zero weights; returns the model and ``step, group, q, loss, objective``.

    At each step the group losses of the batch move q, and the model then goes down the
    gradient of the sum over groups of q x (loss + adjustment / sqrt(group size)).
    """
    require(steps >= 1 and step >= 0 and rate > 0, "steps and rate must be positive and step not negative")
    sizes = {r[group]: r["count"] for r in df.groupBy(group).count().collect()}
    if None in sizes:
        raise ContractError("every row needs a group")
    per_epoch = math.ceil(sum(sizes.values()) / batch_size)
    plan = balanced_batches(df, group, batch_size, -(-steps // per_epoch), seed, row_id)
    number = (F.col("epoch") * per_epoch + F.col("step")).cast("int")
    rows = df.select(row_id, target, *columns)
    # sorted by step, so that a step reads the parts of the table that hold its batch
    served = cut(
        plan.select(number.alias("number"), group, row_id).where(F.col("number") < steps).join(rows, row_id)
        .repartitionByRange("number").sortWithinPartitions("number")
    )
    q = {g: 1.0 / len(sizes) for g in sizes}
    model = LogisticModel(tuple(columns), 0.0, (0.0,) * len(columns))
    history = []
    for i in range(steps):
        error = F.col("__p") - F.col(target)
        means = [F.avg(error)] + [F.avg(error * F.col(c)) for c in columns]
        found = (
            served.where(F.col("number") == i).withColumn("__p", model.probability()).groupBy(group)
            .agg(F.avg(log_loss(F.col("__p"), F.col(target))).alias("loss"), F.array(*means).alias("gradient")).collect()
        )
        if len(found) != len(sizes):
            raise ContractError(f"step {i} has rows of {len(found)} groups, expected {len(sizes)}")
        loss = {r[group]: r["loss"] for r in found}
        q = group_weights_step(q, loss, sizes, step, adjustment)
        objective = sum(q[g] * (loss[g] + adjustment / math.sqrt(sizes[g])) for g in sizes)
        slope = [sum(q[r[group]] * r["gradient"][j] for r in found) for j in range(len(columns) + 1)]
        moved = tuple(w - rate * s for w, s in zip(model.weights, slope[1:]))
        model = LogisticModel(model.columns, model.intercept - rate * slope[0], moved)
        history += [(i, g, q[g], loss[g], objective) for g in sizes]
    kind = df.schema[group].dataType.simpleString()
    return model, df.sparkSession.createDataFrame(history, f"step int, `{group}` {kind}, q double, loss double, objective double")
