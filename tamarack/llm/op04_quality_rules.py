"""Quality rules: counts of each whole text, base rules, and an isolation forest over the counts.

`rule_statistics` splits a text into words `[^\\x20\\x09-\\x0D]+` and counts. The forest isolates points by random
splits of random features; a document that few splits isolate is unlike the documents that the forest was grown
from. It is grown from labelled documents of quality 1, so that anomalous means unlike good documents; splits are drawn from widened ranges (`grow_forest`), a departure from
the usual forest, in which nothing lies outside the range of the sample and an unseen kind of document is no easier to isolate than an outlying good one.

Growing reads a bounded sample, the FIT_ROWS good rows of smallest hash of doc_id among two thirds of them. The threshold is calibrated from all other labelled rows, by counts of
scores (GRID steps) that Spark groups: the score that best separates the two labels by balanced accuracy, among those that keep at least `KEEP_GOOD` of the good rows, or all but one, where that is fewer (so that one outlier among few rows decides nothing).
A labelled doc_id that stands on several rows counts once (the least statistics hold). Every document is scored by its own counts, so scoring has no shuffle.

Defined results: null or empty text has no words (all counts 0, base_failed true, kept false); equal texts, equal
values; rows repeat as they come; labels that repeat for a doc_id count once (the lowest quality holds); with no labelled rows to grow from, or of one label only to calibrate with, no document is
anomalous and the base rules alone decide. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, map_arrow, texts

FIT_ROWS = 20_000
TREES, LEAF_SAMPLE, HEIGHT, MARGIN, GRID = 100, 512, 24, 2.0, 20_000
KEEP_GOOD = 0.995
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed by the contract: the symbols that are counted, and ASCII white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]

_DROP_DIGITS = bytes(range(48, 58))
_MARKS = b"!?;:{}[]()=\"'~^\\/_@"
_CAPITALS = bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    if len(number) < 2_000_000:  # three numbers of words in one of 63 bits
        window = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
        window = pair * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    again = np.zeros(len(window), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    inside = np.zeros(len(words), bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def rule_statistics(text: str) -> list[int]:
    """COUNTS, then EXTRA."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space
    if text.isascii():
        chars, upper = sum(map(len, words)), len(raw) - len(raw.translate(None, _CAPITALS))
    else:
        chars, upper = len(text) - sum(map(text.count, SPACES)), sum(map(len, _UPPER.findall(text)))
    return [
        len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat_words(words),
        text.count("\n") + 1, upper, len(raw) - len(raw.translate(None, _DROP_DIGITS)), len(raw) - len(raw.translate(None, _MARKS)), len(set(words)),
    ]


#: Runs of upper-case letters of the Latin, Greek and Cyrillic blocks.
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+")


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that don't depend on a text's length, from the columns COUNTS + EXTRA."""
    words, chars, symbols, dup, rep, lines, upper, digits, marks, distinct = counts.T.astype(np.float64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([chars / w, symbols / w, dup / np.maximum(lines, 1), rep / w, upper / c, digits / c, marks / w, np.log1p(distinct) / np.log1p(w), np.minimum(lines / w, 1)], axis=1)


def forest_features(counts: np.ndarray) -> np.ndarray:
    """The rates that the forest splits: without digits and marks, for good documents hold dates, prices and telephone numbers; and roots of those that most texts have next to none of, whose long tails random splits would else cut apart among the good rows, too."""
    x = features(counts)
    return np.concatenate([x[:, :1], np.sqrt(x[:, 1:5]), x[:, 7:]], axis=1)


def grow_forest(points: np.ndarray, trees: int = TREES, size: int = LEAF_SAMPLE, height: int = HEIGHT, margin: float = MARGIN, seed: int = 7) -> dict:
    """Nodes of all trees in flat arrays: split feature (-1: leaf), split value, left child (the right one follows it), path length at leaves.

    A split is drawn from the node's range widened by `margin` times its width on either side. What lies outside the range of the
    grown-from documents then falls into an empty side after few splits, while they themselves stay together."""
    rng = np.random.default_rng(seed)
    feature, value, child, path, roots = [], [], [], [], []

    def add() -> int:
        feature.append(-1), value.append(0.0), child.append(0), path.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(add())
        open_ = [(roots[-1], 0, points[rng.choice(len(points), min(size, len(points)), replace=False)])]
        while open_:
            node, depth, rows = open_.pop()
            if len(rows) and depth < height:
                low, high = rows.min(axis=0), rows.max(axis=0)
                if (wide := np.flatnonzero(high > low)).size:
                    f = int(rng.choice(wide))
                    more = margin * (high[f] - low[f])
                    cut = rng.uniform(low[f] - more, high[f] + more)
                    left = add()
                    add()
                    feature[node], value[node], child[node] = f, cut, left
                    below = rows[:, f] < cut
                    open_ += [(left, depth + 1, rows[below]), (left + 1, depth + 1, rows[~below])]
                    continue
            path[node] = depth + expected_path(len(rows))
    return {"roots": roots, "feature": np.array(feature, np.int16), "value": np.array(value), "child": np.array(child, np.int32), "path": np.array(path), "height": height, "usual": max(1.0, expected_path(min(size, len(points))))}


def expected_path(n: int) -> float:
    """The mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def anomaly(forest: dict, points: np.ndarray) -> np.ndarray:
    """2 ** (-mean path length / expected path length of a tree's sample): the larger, the fewer random splits isolate a point."""
    total, rows = np.zeros(len(points)), np.arange(len(points))
    for root in forest["roots"]:
        node = np.full(len(points), root, np.int64)
        for _ in range(forest["height"]):
            f = forest["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            right = points[rows, np.maximum(f, 0)] >= forest["value"][node]
            node = np.where(inner, forest["child"][node] + right, node)
        total += forest["path"][node]
    return 2.0 ** (-total / len(forest["roots"]) / forest["usual"])


def calibrate(step: np.ndarray, good: np.ndarray, n: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """From numbers of rows by score, rounded up to `step` / GRID, and label: the threshold of best balanced accuracy among those that keep at least `keep` of the good rows; above it is anomalous.

    A share of few rows would mean every one of them, and a single outlier would then set the threshold: one good row may always be lost."""
    at = np.unique(step)
    of = lambda label: np.array([n[(step <= t) & (good == label)].sum() for t in at])
    right, wrong = of(True), of(False)
    if not len(at) or not right[-1] or not wrong[-1]:
        return 2.0
    kept, caught = right / right[-1], 1 - wrong / wrong[-1]
    fine = right[-1] - right <= max(1, (1 - keep) * right[-1])
    return float(at[fine][np.argmax((kept + caught)[fine])] / GRID)


def labelled_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def measured(docs: DataFrame, ids: DataFrame, kernel: Callable[[list[str]], list], names: list[str], kind: str) -> DataFrame:
    """doc_id, quality and the columns `names` that kernel gives for texts: one row for each of ids that docs has. Kept in the shared folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = kernel(batch["text"].to_pylist())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], *[pa.array(c) for c in zip(*rows, strict=True)]], names=["doc_id", "quality", *names])

    given = texts(docs).join(ids, "doc_id").select("doc_id", "text", "quality")
    found = map_arrow(given, run, "doc_id long, quality int, " + ", ".join(f"{n} {kind}" for n in names))
    return checkpointed(found.groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "quality", "s.*"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and EXTRA of every row."""
    names = COUNTS + EXTRA

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([rule_statistics(x) for x in batch["text"].to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, counts.T)], names=["doc_id", *names])

    return map_arrow(texts(docs), kernel, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def fit(counts: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict | None, float]:
    """The forest and its threshold, from the counts of documents. Only counts meet the labels, never texts."""
    names = COUNTS + EXTRA
    once = counts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= MIN_WORDS)).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s"))  # repeats meet in partial sums
    rows = checkpointed(once.join(labelled_ids(labels).hint("shuffle_hash"), "doc_id").select("doc_id", "quality", "s.*"))
    growing = (F.col("quality") == 1) & (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0)
    points = rows.where(growing).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toPandas()  # fit_rows rows at most
    if not len(points):
        return None, 2.0
    forest = grow_forest(forest_features(points[names].to_numpy()))
    sent = counts.sparkSession.sparkContext.broadcast(forest)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = np.stack([batch[n].to_numpy() for n in names], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ceil(anomaly(sent.value, forest_features(given)) * GRID).astype(np.int64)), batch["good"]], names=["step", "good"])

    scores = map_arrow(rows.where(~growing).select((F.col("quality") == 1).alias("good"), *names), score, "step long, good boolean", 4096)
    by_step = scores.groupBy("step", "good").count().toPandas()  # two labels of GRID steps at most
    sent.unpersist()
    return forest, calibrate(by_step["step"].to_numpy(np.int64), by_step["good"].to_numpy(bool), by_step["count"].to_numpy(np.int64))


def verdicts(model: tuple[dict | None, float], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly and kept of rows of COUNTS + EXTRA."""
    forest, threshold = model
    score = anomaly(forest, forest_features(counts)) if forest else np.zeros(len(counts))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    return failed, score, ~failed & (score <= threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept of every row. Texts are read once."""
    names, counts = COUNTS + EXTRA, checkpointed(counted(docs))
    sent = docs.sparkSession.sparkContext.broadcast(fit(counts, labels, fit_rows))  # its size is bounded by TREES, LEAF_SAMPLE and HEIGHT

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = verdicts(sent.value, np.stack([batch[n].to_numpy() for n in names], axis=1))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *[batch[n] for n in COUNTS], *map(pa.array, own)], names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    return map_arrow(counts, kernel, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean", 4096)


def keep_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    names, kinds = [f"__{i}" for i in range(len(docs.columns))], dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(fit(counted(docs), labels, fit_rows))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([rule_statistics(x) for x in batch["__text"].to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(verdicts(sent.value, counts)[2]), *[batch[n] for n in names]], names=["__kept", *names])

    given = docs.select(F.coalesce("text", F.lit("")).alias("__text"), *[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    judged = map_arrow(given, kernel, "__kept boolean" + "".join(f", {n} {kinds[c]}" for c, n in zip(docs.columns, names, strict=True)))
    return judged.where("__kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
