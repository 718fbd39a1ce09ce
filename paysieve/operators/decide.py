"""Decision job: part scores -> part verdict -> one verdict per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.fusion_rules import FUSION_STAGES
from paysieve.functions.scoring import STAGES, VIEW_STAGES, batch_scores, lowered_views, score_views, view_discrepancy
from paysieve.session import reuse

def moving_average(series: Column, width: int = 4) -> Column:
    """Centred average with zero edges: positions -2..+1 divided by the width."""
    n = F.size(series)
    return F.transform(series, lambda _x, i: F.aggregate(
        F.slice(series, F.greatest(i - 1, F.lit(1)), F.least(i + 2, n) - F.greatest(i - 1, F.lit(1)) + 1), F.lit(0.0), lambda a, v: a + v) / width)


def trend_residual(series: Column) -> tuple[Column, Column]:
    """(mean |x - trend|, trend[last] - trend[first]) of one array."""
    t = moving_average(series)
    resid = F.aggregate(F.zip_with(series, t, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v) / F.size(series)
    return resid, F.element_at(t, -1) - F.element_at(t, 1)


def anomaly(resid: Column, slope: Column, third: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(resid * 2.0 + F.abs(slope) + third * 0.1)))


def pseudo_series(text: Column, location: Column, depth: Column, **given: Column) -> Column:
    """The first fifteen features in model order, zero padded to sixteen; ``given`` replaces some."""
    feats = list({**X.all_features(text, location, depth), **given}.values())[:15]
    return F.array(*[f.cast("double") for f in feats], F.lit(0.0))


def add_series(df: DataFrame, location: Column) -> DataFrame:
    df = df.withColumn("series", reuse(f"pseudo_series:{location}", lambda: pseudo_series(F.col("norm"), location, F.col("depth"))))
    resid, slope = trend_residual(F.col("series"))
    df = df.withColumns({"resid": resid, "slope": slope, "third": F.col("series")[3]})
    return df.withColumn("anom", anomaly(F.col("resid"), F.col("slope"), F.col("third")))


# Memory columns of an empty memory.
NO_MEMORY = [[(f"mem_{k}", "0.0D") for k in R.LABELS] + [("mem_hit", "0.0D"), ("mem_exact", "NULL")]]
# ml_* are the keyword scores; a trained model's stage or columns replace them in the training job.
KEYWORD_MODEL = [[(f"ml_{k}", f"kw_{k}") for k in R.LABELS]]


def decide_parts(df: DataFrame, keep: list[str], *wanted: str, memory=None, model=KEYWORD_MODEL, location: Column | None = None) -> DataFrame:
    """Columns ``keep`` and the wanted decision columns of rows with raw, norm, depth.

    ``memory`` adds the memory columns to the rows (none: an empty memory); ``model`` is the stage that defines ml_* (none: ml_* are
    columns of the rows).
    """
    df = memory(df) if memory else df
    series = pseudo_series(F.col("norm"), F.lit("query") if location is None else location, F.col("depth"), entropy=F.lit(0.0))
    df = df.withColumns({"series": series, "cs_rate": X.case_switch_rate(F.col("raw"))})
    df = score_views(df)
    df = df.withColumns(lowered_views()).withColumn("discrepant", view_discrepancy())
    return batch_scores(df, keep, list(wanted), VIEW_STAGES + STAGES + (model or []) + ([] if memory else NO_MEMORY) + FUSION_STAGES)


def reduce_requests(parts: DataFrame, *keys: str) -> DataFrame:
    """Best part per request: malicious first, then confidence, then the earlier part.

    ``max_by`` combines map-side, so a request (or a hot key) with many parts is reduced before the shuffle;
    texts stay behind, only verdicts travel.
    """
    order = F.struct(F.col("mal"), F.col("conf"), (-F.col("pos")).alias("p"))
    best = F.max_by(F.struct("pred", "conf", "mal", "location"), order)
    return parts.groupBy("req_id", *keys).agg(best.alias("b")).select("req_id", *keys, "b.pred", "b.conf", "b.mal", "b.location")
