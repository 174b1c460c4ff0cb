"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree of hidden labels, content or not. Each node has potentials from its tag, the words of its class, id and
role, and the length, link share and ending of its own text; each edge has parent-child potentials, which depend on whether
the child is a sectioning element, a list or another. All are relative frequencies of labelled pages, counted by a Spark job over pages that
html_labels makes by rule. Sum-product message passing, upward from the leaves and downward from the root, gives each node's exact
marginal; texts whose node is more likely content than not are the page's main text.

Messages of a batch of pages run together, level by level, as numpy arrays.

Defined results: null or empty html has an empty text; text outside any element belongs to the root, which, like body, is content or not as its text and its children tell; unclosed and stray tags are tolerated; repeated rows each appear.
Columns beyond page_id, url and html are ignored. Nothing is dropped or capped within content: character references are decoded, white space
inside a block becomes one blank, and blocks follow in page order, one to a line.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import map_arrow
from tamarack.llm.html_labels import labelled_page
from tamarack.llm.html_tree import BLOCKS, Page

TRAINING_PAGES, SMOOTHING = 1500, 0.5
#: Kinds of elements as children: sectioning ones (1), lists (2), all others (0).
_KINDS = np.array([1 if t in "header footer nav main article aside section div form table body head".split() else 2 if t in ("ul", "ol") else 0 for t in BLOCKS])
#: Values of each categorical feature of a node: tag, length, link share, ending, tag of the parent, and whether it has a class, id or role.
SIZES = {"tag": len(BLOCKS), "length": 6, "links": 4, "ending": 3, "above": len(BLOCKS), "named": 2}


class Batch:
    """Pages laid end to end: one row for each node."""

    def __init__(self, pages: list[Page]):
        first = np.cumsum([0, *[len(p.parent) for p in pages]])
        self.first, self.pages = first, pages
        parent = np.concatenate([np.array(p.parent) for p in pages])
        of_page = np.repeat(first[:-1], np.diff(first))
        self.root = parent < 0
        self.parent = np.where(self.root, 0, parent + of_page)
        self.depth = np.concatenate([np.array(p.depth) for p in pages])
        tag = np.concatenate([np.array(p.tag) for p in pages])
        size, links = np.zeros(len(tag), np.int64), np.concatenate([np.array(p.links) for p in pages])
        ending = np.zeros(len(tag), np.int64)
        for p, start in zip(pages, first.tolist(), strict=False):
            for node, text in p.texts:
                size[start + node] += len(text)
                ending[start + node] = 1 + (text[-1] in ".!?:;…\"»")
        self.values = {
            "tag": tag, "length": np.digitize(size, [1, 16, 60, 160, 500]), "links": np.where(size == 0, 0, 1 + np.digitize(links / np.maximum(size, 1), [0.05, 0.6])),
            "ending": ending, "above": np.where(self.root, 0, tag[self.parent]), "named": np.concatenate([np.array([bool(w) for w in p.words]) for p in pages]).astype(np.int64),
        }
        self.section = _KINDS[tag]
        self.words = [(start + k, w) for p, start in zip(pages, first.tolist(), strict=False) for k, ws in enumerate(p.words) for w in ws]


def count_labels(pages: list[Page]) -> pd.DataFrame:
    """(what, value, label, n) over labelled pages; unmarked nodes are not content."""
    batch = Batch(pages)
    label = np.array([m or 0 for p in pages for m in p.marks])
    rows = [(f"f:{name}", str(v), int(y)) for name, values in batch.values.items() for v, y in zip(values.tolist(), label.tolist(), strict=True)]
    rows += [("word", w, int(label[k])) for k, w in batch.words]
    inner = np.flatnonzero(~batch.root)
    rows += [("edge", f"{s}{a}", int(y)) for s, a, y in zip(batch.section[inner], label[batch.parent[inner]], label[inner], strict=True)]
    return pd.DataFrame(rows, columns=["what", "value", "label"]).value_counts().rename("n").reset_index()


@lru_cache(maxsize=4)
def _trained(application: str, n: int) -> dict:
    spark = SparkSession.active()

    def kernel(batches):
        for part in batches:
            yield count_labels([Page(labelled_page(int(seed))) for seed in part["id"]])

    counts = spark.range(0, n, 1, 8).mapInPandas(kernel, "what string, value string, label int, n long").groupBy("what", "value", "label").agg(F.sum("n").alias("n")).toPandas()
    table = {(w, v, y): c for w, v, y, c in counts.itertuples(index=False)}
    get = lambda w, v, y: table.get((w, v, y), 0) + SMOOTHING
    logs = {}
    for name, size in SIZES.items():
        x = np.array([[get(f"f:{name}", str(v), y) for y in (0, 1)] for v in range(size)])
        logs[name] = np.log(x / x.sum(axis=0))
    words = sorted({v for w, v, _ in table if w == "word"})
    x = np.array([[get("word", w, y) for y in (0, 1)] for w in words])
    edge = np.array([[[get("edge", f"{s}{a}", y) for y in (0, 1)] for a in (0, 1)] for s in (0, 1, 2)])
    return {"features": logs, "words": dict(zip(words, np.log(x / x.sum(axis=0)), strict=True)), "edge": np.log(edge / edge.sum(axis=2, keepdims=True))}


def train(spark: SparkSession, n: int = TRAINING_PAGES) -> dict:
    """Log potentials from n labelled pages; its size depends on the tags and words of these pages alone."""
    return _trained(spark.sparkContext.applicationId, n)


def potentials(model: dict, batch: Batch) -> np.ndarray:
    """Log potentials of each node by label. That a node has no text of its own counts once, as its length."""
    bare = batch.values["length"] == 0
    own = sum(np.where(bare[:, None] & (name in ("links", "ending")), 0.0, model["features"][name][values]) for name, values in batch.values.items())
    known = [(k, model["words"][w]) for k, w in batch.words if w in model["words"]]
    if known:
        np.add.at(own, [k for k, _ in known], np.array([v for _, v in known]))
    return own


def marginals(model: dict, batch: Batch) -> np.ndarray:
    """The probability of content of each node, by one upward and one downward pass."""
    own = potentials(model, batch)
    order = np.argsort(batch.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(batch.depth[order])) + 1)
    up, message = own.copy(), np.zeros_like(own)
    edge = model["edge"][batch.section]  # node, label of the parent, own label
    for level in levels[:0:-1]:
        m = np.logaddexp(*(edge[level] + up[level][:, None, :]).transpose(2, 0, 1))
        message[level] = m
        np.add.at(up, batch.parent[level], m)
    belief = up.copy()
    for level in levels[1:]:
        others = belief[batch.parent[level]] - message[level]  # all that the parent knows from elsewhere
        belief[level] += np.logaddexp(*(edge[level] + others[:, :, None]).transpose(1, 0, 2))
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def main_texts(model: dict, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    batch = Batch(pages)
    content = marginals(model, batch) > 0.5
    return ["\n".join(text for node, text in p.texts if content[start + node]) for p, start in zip(pages, batch.first.tolist(), strict=False)]


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = main_texts(sent.value, batch["html"].to_pylist())
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(given, kernel, "page_id long, url string, text string, n_chars long", 256)
