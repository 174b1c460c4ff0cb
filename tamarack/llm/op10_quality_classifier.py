"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a whole text (rates of symbols, repeats, case, digits, lines; logs of its sizes) are standardised and
mapped by cos(Wx + b), whose inner products approximate a Gaussian kernel. Each partition of the labelled sample adds
up its part of the normal equations, by fold; the driver receives at most SUMS * FOLDS such parts, adds them and solves. Each fold is scored by the weights of the
others, and these scores give a monotone map to the rate of label 1 (pool adjacent violators, linear between block centres).

Labels come only from rows with crc32(doc_id as text) mod 5 other than 0. The fit reads a bounded sample, the FIT_ROWS such rows of smallest
hash of doc_id (a doc_id on several rows counts once, by its least statistics); every document is scored, without a shuffle. Inputs of a score are counts of the text alone.

Defined results: null or empty text has all counts 0 and gets the score of that point; equal texts, equal scores;
rows repeat as they come; a doc_id labelled twice counts once (the lowest quality holds); without labelled rows the score is 1.0 (nothing is rejected); a null
doc_id is never held out. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import map_arrow
from tamarack.llm.op04_quality_rules import features, labelled_ids, measured, rule_statistics

FIT_ROWS = 20_000
DIMENSION, BANDWIDTH, RIDGE, SUMS, FOLDS = 256, 2.5, 1e-3, 4, 4
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def statistics(texts: list[str]) -> np.ndarray:
    counts = np.array([rule_statistics(x) for x in texts], np.int64).reshape(-1, 10)
    rates = features(counts)
    sizes = np.log1p(counts[:, [0, 5, 9]])
    return np.concatenate([np.sqrt(np.minimum(rates, 16)), sizes], axis=1)


N_STATISTICS = 12


def projection(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / BANDWIDTH, (N_STATISTICS, DIMENSION)), rng.uniform(0, 2 * np.pi, DIMENSION)


def fourier(points: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = projection()
    z = np.clip((points - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / DIMENSION) * np.cos(z @ w + b), np.ones((len(z), 1))], axis=1)


def pool_adjacent(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block centres and block rates of the isotonic fit."""
    order = np.lexsort((label, score))
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([float(y), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def solve(gram: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Ridge weights from the sums of n rows."""
    return np.linalg.solve(gram + RIDGE * n / DIMENSION * np.eye(len(right)), right)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """mean, scale, weights of the ridge, and the calibration's centres and rates."""
    ids = labelled_ids(labels.where(~held_out(F.col("doc_id")))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    names = [f"s{i}" for i in range(N_STATISTICS)]
    points = measured(docs, F.broadcast(ids), lambda given: statistics(given).tolist(), names, "double")  # fit_rows ids at most
    row = points.agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"d_{n}") for n in names]).first()
    if not row["n"]:
        return None
    mean, scale = np.array([row[f"m_{n}"] for n in names]), np.array([max(row[f"d_{n}"], 1e-6) for n in names])
    folded = points.select("quality", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *names).coalesce(SUMS)

    def add_up(batches):
        gram, right, n = np.zeros((FOLDS, DIMENSION + 1, DIMENSION + 1)), np.zeros((FOLDS, DIMENSION + 1)), np.zeros(FOLDS, np.int64)
        for part in batches:
            z, fold = fourier(part[names].to_numpy(), mean, scale), part["fold"].to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                gram[k] += own.T @ own
                right[k] += own.T @ part["quality"].to_numpy(np.float64)[fold == k]
                n[k] += len(own)
        yield pd.DataFrame({"fold": range(FOLDS), "n": n, "gram": [g.tobytes() for g in gram], "right": [r.tobytes() for r in right]})

    gram, right, n = np.zeros((FOLDS, DIMENSION + 1, DIMENSION + 1)), np.zeros((FOLDS, DIMENSION + 1)), np.zeros(FOLDS, np.int64)
    for p in folded.mapInPandas(add_up, "fold int, n long, gram binary, right binary").collect():  # SUMS * FOLDS rows at most
        gram[p["fold"]] += np.frombuffer(p["gram"]).reshape(DIMENSION + 1, -1)
        right[p["fold"]] += np.frombuffer(p["right"])
        n[p["fold"]] += p["n"]
    weights = solve(gram.sum(axis=0), right.sum(axis=0), n.sum())
    by_others = [solve(gram.sum(axis=0) - gram[k], right.sum(axis=0) - right[k], n.sum() - n[k]) if n.sum() > n[k] else weights for k in range(FOLDS)]

    def score(batches):
        for part in batches:
            z = fourier(part[names].to_numpy(), mean, scale)
            yield pd.DataFrame({"quality": part["quality"], "score": (z * np.stack(by_others)[part["fold"].to_numpy()]).sum(axis=1)})

    scored = folded.mapInPandas(score, "quality int, score double").toPandas()  # fit_rows rows at most
    centres, rates = pool_adjacent(scored["score"].to_numpy(), scored["quality"].to_numpy())
    return {"mean": mean, "scale": scale, "weights": weights, "centres": centres, "rates": rates}


def score_texts(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    raw = fourier(statistics(texts), model["mean"], model["scale"]) @ model["weights"]
    return np.interp(raw, model["centres"], model["rates"])


def scored(docs: DataFrame, model: dict | None, carry: list[str]) -> DataFrame:
    """__score, then the columns of docs named in carry as __0, __1, ..."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FIT_ROWS blocks at most
    names, kinds = [f"__{i}" for i in range(len(carry))], dict(docs.dtypes)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(score_texts(sent.value, batch["__text"].to_pylist())), *[batch[n] for n in names]], names=["__score", *names])

    given = docs.select(F.coalesce("text", F.lit("")).alias("__text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    return map_arrow(given, kernel, "__score double" + "".join(f", {n} {kinds[c]}" for c, n in zip(carry, names, strict=True)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    out = scored(docs, fit(docs, labels, fit_rows), ["doc_id"])
    return out.select(F.col("__0").alias("doc_id"), held_out(F.col("__0")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs predicted 1, with the columns of docs."""
    out = scored(docs, fit(docs, labels, fit_rows), docs.columns).where(F.col("__score") >= threshold)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
