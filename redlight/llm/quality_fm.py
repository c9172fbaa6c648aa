"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

y = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pairs are summed in linear
time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2 over the factors.

Training draws a bounded sample of labelled rows and deals it to a fixed number of shards.
In each round every shard runs a few epochs of AdaGrad from the current parameters; the
shards' parameters are averaged (weighted by rows) and sent out again.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, unwrapped, worker_state, wrapped
from .labelled import training_rows

#: Structure and metadata features come first; hashed words follow.
STRUCTURE = 12
_UPPER = bytes(range(65, 91))
_OTHER = bytes(b for b in range(128) if not chr(b).isalpha())


def structure(text: str, words: list[str], n_chars) -> np.ndarray:
    """Twelve figures of about -1 to 1; ``n_chars`` is the recorded length (metadata)."""
    n, length = len(words), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters = length - count(_OTHER) or 1
    triples = list(zip(words, words[1:], words[2:]))
    recorded = length if n_chars is None or not math.isfinite(n_chars) or n_chars < 0 else n_chars
    return np.array([
        math.log1p(n) / 5 - 1, min(length / (n + 1), 40.0) / 8 - 1, count(_UPPER) / letters,
        10 * count(b"#*$%&|<>") / length, 10 * count(b"0123456789") / length,
        10 * text.count("!") / length, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(words)) / max(n, 1),
        1 - len(set(triples)) / max(len(triples), 1), min(n / (len(lines) + 1), 100.0) / 25 - 1,
        math.log1p(recorded) / 7 - 1, float(n < 50),
    ])


class Slots(dict):
    """word -> hashed place, kept per worker while there is room."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        i = STRUCTURE + zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.size
        if len(self) < 500_000 and len(word) <= 32:
            self[word] = i
        return i


def features(text: str, n_chars, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of one whole text."""
    slots = worker_state(f"slots {size}", lambda: Slots(size))
    words = text.split()
    places = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
    at, count = np.unique(places, return_counts=True)
    value = np.log1p(count)
    value /= math.sqrt((value**2).sum()) or 1.0 if len(value) else 1.0
    return np.concatenate([np.arange(STRUCTURE), at]), np.concatenate([structure(text, words, n_chars), value])


def margin(params: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    """The machine's value; row 0 of ``params`` holds w0, row i + 1 feature i: w, then v."""
    p = params[at + 1]
    sums = x @ p[:, 1:]
    return float(params[0, 0] + x @ p[:, 0] + 0.5 * (sums @ sums - (x**2) @ (p[:, 1:] ** 2).sum(1)))


def epochs(params: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, float]], n: int, seed: int, rate: float, decay: float) -> np.ndarray:
    """``n`` passes of AdaGrad on the logistic loss."""
    params, rng = params.copy(), np.random.default_rng(seed)
    seen = np.full(params.shape, 1e-2)
    for _ in range(n):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            p = params[at + 1]
            v = p[:, 1:]
            sums = x @ v
            z = params[0, 0] + x @ p[:, 0] + 0.5 * (sums @ sums - (x**2) @ (v**2).sum(1))
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            grad = np.empty_like(p)
            grad[:, 0] = g * x
            grad[:, 1:] = g * (x[:, None] * sums - v * (x**2)[:, None])
            grad += decay * p
            seen[at + 1] += grad**2
            params[at + 1] = p - rate * grad / np.sqrt(seen[at + 1])
            seen[0, 0] += g * g
            params[0, 0] -= rate * g / math.sqrt(seen[0, 0])
    return params


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = 8_000, size: int = 1 << 14, rank: int = 4, shards: int = 8, rounds: int = 4, passes: int = 3, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Parameters learned from at most ``sample_rows`` labelled rows outside the held-out
    fold (both classes get their part of them). What a round sends is bounded by ``shards``, ``size`` and ``rank``. With labels of
    one kind only, or none, every document gets their share (none: one half)."""
    rng = np.random.default_rng(seed)
    params = np.zeros((1 + STRUCTURE + size, 1 + rank))
    params[1:, 1:] = rng.normal(0, 0.01, (STRUCTURE + size, rank))
    drawn, odds = training_rows(docs, labels, "quality", folds, held_out, sample_rows, ["n_chars", F.coalesce("text", F.lit("")).alias("text")])
    rows = drawn.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).persist()
    shared = docs.sparkSession.sparkContext.broadcast
    try:
        share = rows.agg(F.avg("y")).first()[0]
        if share in (None, 0.0, 1.0):
            params[:] = 0
            params[0, 0] = 0.0 if share is None else 50.0 if share else -50.0
            return params
        for turn in range(rounds):
            now = shared(params)

            def work(part: pd.DataFrame) -> pd.DataFrame:
                part = part.sort_values(["text", "y", "n_chars"])
                data = [(*features(t, c, size), y) for t, c, y in zip(part["text"], part["n_chars"], part["y"])]
                new = epochs(now.value, data, passes, seed + turn, rate / (1 + turn), decay)
                return pd.DataFrame({"n": [len(data)], "params": [new.tobytes()]})

            parts = rows.groupBy("shard").applyInPandas(work, "n long, params binary").collect()
            total = sum(p["n"] for p in parts)
            params = sum(np.frombuffer(p["params"]).reshape(params.shape) * (p["n"] / total) for p in parts)
        params[0, 0] += odds
        return params
    finally:
        rows.unpersist()


def score(docs: DataFrame, params: np.ndarray, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``).

    Inputs are the whole text and ``n_chars`` (null: the text's own length), nothing else.
    Null text counts as empty. Texts are read whole, in linear time, whatever their length;
    equal inputs get equal scores, and rows that repeat are each kept; an empty table gives no
    rows. Columns of ``docs`` with these names give way to them.
    """
    now = docs.sparkSession.sparkContext.broadcast(params)
    size = len(params) - 1 - STRUCTURE

    @F.pandas_udf("double")
    def look(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        enter("quality")
        z = [margin(now.value, *features(t, c, size)) for t, c in zip(texts, n_chars)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500))))

    out = wrapped(docs, score=look(F.coalesce(F.col(text_col), F.lit("")), F.col("n_chars").cast("double")))
    return unwrapped(out, docs, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))
