"""Logistic outcome model of runs, with Platt calibration.

It is fitted on a bounded sample: the newest `LABELLED_ROWS` labelled runs (a documented
parameter; the sample alone goes to the driver). Scoring covers all runs as Column expressions.
Below 6 labels there is no model; below 12, or with one class only, the smoothed base rate stands.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import stats as st

LABELLED_ROWS = 20_000
FEATURES = ("score_norm", "packet_confidence", "issue_count", "form_count", "missing_item_count", "review_flag_count", "scan_quality_score", "ocr_confidence")
EPOCHS, RATE, L2 = 700, 0.14, 0.01
PLATT_EPOCHS, PLATT_RATE, PLATT_L2 = 500, 0.05, 0.001


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Full-batch gradient descent on standardised features, then on the Platt slope and intercept."""
    n, positives = len(y), int(y.sum())
    base = round((positives + 1) / (n + 2), 3)
    if n < 6:
        return {"kind": "none", "n": n, "positives": positives}
    if n < 12 or positives in (0, n):
        return {"kind": "base_rate", "n": n, "positives": positives, "base": base}
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-6, sd, 1.0)
    z = (x - mean) / sd
    w, b = np.zeros(x.shape[1]), float(_logit(np.array(base)))
    for _ in range(EPOCHS):
        error = _sigmoid(z @ w + b) - y
        b -= RATE * error.mean()
        w -= RATE * (z.T @ error / n + L2 * w)
    raw = _logit(_sigmoid(z @ w + b))
    slope, intercept = 1.0, float(_logit(np.array(base)))
    for _ in range(PLATT_EPOCHS):
        error = _sigmoid(slope * raw + intercept) - y
        slope, intercept = slope - PLATT_RATE * ((error * raw).mean() + PLATT_L2 * slope), intercept - PLATT_RATE * error.mean()
    return {"kind": "logistic", "n": n, "positives": positives, "weights": w.round(6).tolist(), "intercept": round(float(b), 6), "means": mean.round(6).tolist(), "sds": sd.round(6).tolist(), "slope": round(float(slope), 6), "platt_intercept": round(float(intercept), 6)}


def fit_labelled(examples: DataFrame, rows: int = LABELLED_ROWS) -> dict:
    """Fit on the newest rows of examples(at, id, label, features...)."""
    sample = examples.orderBy(F.desc("at"), F.desc("id")).limit(rows).select(*[F.col(c).cast("double") for c in FEATURES], F.col("label").cast("double")).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(), sample["label"].to_numpy())


def score(runs: DataFrame, model: dict) -> DataFrame:
    """runs(id, features...) with raw and calibrated probability; null without a model."""
    if model["kind"] != "logistic":
        p = F.lit(model.get("base")).cast("double")
        return runs.select("id", p.alias("raw_probability"), p.alias("calibrated_probability"))
    z = sum((w * (F.col(c) - m) / s for c, w, m, s in zip(FEATURES, model["weights"], model["means"], model["sds"])), F.lit(model["intercept"]))
    raw = st.sigmoid(z)
    return runs.select("id", F.round(raw, 4).alias("raw_probability"), F.round(st.clamp(st.sigmoid(model["slope"] * st.logit(raw) + model["platt_intercept"])), 4).alias("calibrated_probability"))
