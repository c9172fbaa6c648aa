"""Toxic passages: maximum-scoring segments over token log-odds.

1. Tokens are counted in toxic and clean labelled documents. A token's weight is its log-odds
   with an informative Dirichlet prior (its share of all tokens, together ``prior`` times as
   strong as the sample); tokens with a z-score under ``least_z`` or log-odds between 0 and
   ``least_odds`` and all unseen ones weigh ``-drift``. Copies of a text count once, and a
   text that is labelled both ways not at all.
2. One linear scan finds all maximal scoring segments of a document (Ruzzo and Tompa).
3. Scores are put on the scale of extreme values (Karlin and Altschul): lambda solves
   sum p exp(lambda s) = 1 over the clean tokens, K is the maximum-likelihood value over
   clean documents; a segment of score S among n tokens has the E-value K n exp(-lambda S).
   Segments with an E-value of at most ``e_value`` are significant. A document's evidence
   is the best sum of its r highest normalised scores, less ln r!.
4. A logistic curve, fitted on the same labelled rows, turns the evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, materialize, unwrapped, wrapped
from .labelled import once, training_rows

#: Runs of letters and digits; learning and scoring cut texts with this one pattern.
find_tokens = re.compile(r"[^\W_]+")


@dataclass
class Model:
    weights: dict[str, float]
    drift: float
    lam: float = 1.0
    k: float = 1.0
    #: Without evidence from labels no document is toxic.
    slope: float = 0.0
    shift: float = -50.0
    #: Token scores of clean text with their probabilities.
    background: list[tuple[float, float]] = field(default_factory=list)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in linear time."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Per candidate: start, end, sum before it, sum up to its end; and the nearest earlier
    # candidate with a smaller sum before it.
    stack: list[tuple[int, int, float, float, int]] = []
    for p in places.tolist():
        start, end, low, high = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def lowered(text: str) -> str:
    """Lower case, character by character: places in it are places in the text. (U+0130 is
    the one character whose lower case is longer.)"""
    return text.replace("\u0130", "i").lower()


def find_segments(text: str, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    """Segments as character spans with their scores, and the number of tokens."""
    low = lowered(text)
    tokens = find_tokens.findall(low)
    look = model.weights.get
    scores = np.fromiter((look(t, -model.drift) for t in tokens), float, len(tokens))
    found = segments(scores)
    if not found:
        return [], len(tokens)
    spans = [m.span() for m in find_tokens.finditer(low)]
    return [(spans[s][0], spans[e - 1][1], x) for s, e, x in found], len(tokens)


def evidence(found: list[float], n: int, model: Model) -> float:
    """Normalised score of a document: the higher, the less likely by chance."""
    if not n:
        return -math.log(model.k)
    base, best, total = math.log(model.k * n), -math.inf, 0.0
    for r, s in enumerate(sorted(found, reverse=True), 1):
        total += model.lam * s - base
        best = max(best, total - math.lgamma(r + 1))
    return best if found else -base


def token_counts(rows: DataFrame) -> DataFrame:
    """``token, toxic, clean`` over ``y, text``; tasks add up before they send."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            seen = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                seen[y > 0].update(find_tokens.findall(lowered(t.as_py())))
            tokens = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *(pa.array([seen[i][t] for t in tokens], pa.int64()) for i in (1, 0))], names=["token", "toxic", "clean"])

    return rows.select("y", "text").mapInArrow(work, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, all_toxic: int, all_clean: int, prior: float, least_z: float, least_odds: float) -> DataFrame:
    """``token, clean, odds`` of the tokens that tell the classes apart."""
    prior *= all_toxic + all_clean
    a = prior * (F.col("toxic") + F.col("clean")) / (all_toxic + all_clean)
    rows = counts.withColumns({"_ours": F.col("toxic") + a, "_other": F.col("clean") + a})
    ratio = lambda x, n: F.log(F.try_divide(F.col(x), n + prior - F.col(x)))
    rows = rows.withColumn("odds", ratio("_ours", all_toxic) - ratio("_other", all_clean))
    z = F.col("odds") / F.sqrt(1 / F.col("_ours") + 1 / F.col("_other"))
    return rows.where((F.abs(z) >= least_z) & ((F.col("odds") < 0) | (F.col("odds") >= least_odds))).select("token", "clean", "odds")


def _solve_lambda(background: list[tuple[float, float]]) -> float:
    s, p = (np.array(x) for x in zip(*background))
    low, high = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(high * s)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method."""
    w, a = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = 20_000, prior: float = 0.05, least_z: float = 3.0, least_odds: float = 1.0, drift: float = 0.7) -> Model:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fold (both classes
    get their part of them). The weights, of all tokens of these rows that tell the classes
    apart, are all that reaches the driver, besides two numbers per row. Without a toxic or
    without a clean row every score is the share of toxic rows."""
    drawn, odds = training_rows(docs, labels, "toxic", folds, held_out, sample_rows, [F.coalesce("text", F.lit("")).alias("text")])
    rows = materialize(once(drawn), "toxicity-rows")
    counts = materialize(token_counts(rows), "toxicity-tokens")
    all_toxic, all_clean = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    model = Model({}, drift)
    if all_toxic and all_clean:
        known = log_odds(counts, all_toxic, all_clean, prior, least_z, least_odds).orderBy("token").toPandas()
        model.weights = {t: x if x > 0 else min(x, -drift) for t, x in zip(known["token"], known["odds"])}
        # No token is impossible in clean text.
        share = np.maximum(known["clean"].to_numpy(float), 0.5) / all_clean
        model.background = [(model.weights[t], p) for t, p in zip(known["token"], share.tolist())]
        model.background.append((-drift, max(1 - sum(p for _, p in model.background), 1e-9)))
        if any(s > 0 for s, _ in model.background):
            model.lam = _solve_lambda(model.background)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find_segments(t, model) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "n": [float(n) for _, n in found], "x": [max((s for *_, s in f), default=0.0) for f, _ in found]})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find_segments(t, model) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "x": [evidence([s for *_, s in f], n, model) for f, n in found]})

    ends = rows.mapInPandas(best, "y double, n double, x double").toPandas()
    y = ends["y"].to_numpy()
    if len(y) and not 0 < y.sum() < len(y):
        model.shift = 50.0 if y.sum() else -50.0
    elif len(y):
        clean = ends[(ends["y"] == 0) & (ends["n"] > 0)]
        if len(clean):
            model.k = float(len(clean) / (clean["n"] * np.exp(-model.lam * clean["x"])).sum())
        seen = rows.mapInPandas(weigh, "y double, x double").toPandas().sort_values(["x", "y"])
        model.slope, model.shift = logistic_fit(seen["x"].to_numpy(), seen["y"].to_numpy())
        model.shift += odds
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", e_value: float = 0.01, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), ``predicted`` (1 from ``threshold``)
    and ``passages``: the significant segments, ``start, end`` in characters, ``score`` and
    ``e_value``, best first.

    Null text counts as empty and gets the score of no evidence. Texts are scanned whole, in
    linear time, and all their segments count, whatever their length. Equal texts get equal
    scores; rows that repeat are each kept; an empty table gives no rows. Columns of ``docs``
    with these names give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = "array<struct<start:int,end:int,score:double,e_value:double>>"

    @F.pandas_udf(f"score double, passages {kind}")
    def look(texts: pd.Series) -> pd.DataFrame:
        enter("toxicity")
        m, scores, passages = Model(**shared.value), [], []
        for t in texts:
            found, n = find_segments(t, m)
            x = m.slope * evidence([s for *_, s in found], n, m) + m.shift
            scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
            told = [{"start": a, "end": b, "score": s, "e_value": m.k * n * math.exp(-m.lam * s)} for a, b, s in found]
            passages.append(sorted((p for p in told if p["e_value"] <= e_value), key=lambda p: p["e_value"]))
        return pd.DataFrame({"score": scores, "passages": passages})

    out = wrapped(docs, toxic=look(F.coalesce(F.col(text_col), F.lit(""))))
    return unwrapped(out, docs, score=F.col("toxic.score"), predicted=(F.col("toxic.score") >= threshold).cast("int"), passages=F.col("toxic.passages"))
