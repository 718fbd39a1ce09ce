"""Metric aggregations: one pass of conditional counts, guarded ratios, four digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, digits: int = 4) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(0.0), digits)


def binary(truth: Column, pred: Column, where: Column | None = None) -> dict[str, Column]:
    cond = F.lit(True) if where is None else where
    tp, fp = F.count_if(cond & truth & pred), F.count_if(cond & ~truth & pred)
    fn, tn = F.count_if(cond & truth & ~pred), F.count_if(cond & ~truth & ~pred)
    recall, precision = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "recall": F.round(recall, 4), "precision": F.round(precision, 4),
            "f1": F.round(F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0), 4), "fpr": ratio(fp, fp + tn)}
