"""Periodic runs of words, found by online dyadic square catching.

`Catchers` reads a text word by word, in appends of any size. Whenever 2 ** k words more are complete, the aligned block that they form gets a catcher. A catcher of a block of b words is alive for the words that
stand 2 b to 4 b further on (for b = 1 also at distance 1): any square whose half has a length in that range holds a whole aligned block of b words in its first half, and that block's copy one period later.
Each appended word completes one window of every length b; its name, 64 bits made from the names of its two halves, is compared with the two blocks whose catchers are alive. So a word costs
two comparisons at each level that the text has reached, and a level keeps only its last 4 b names.

Copies of neighbouring blocks at the same distance chain up. A chain of enough blocks is compared word by word, with the fewer than b words on either side by which it can grow; what is then equal over a period or more
is a square, and squares of one period that overlap are one run, which ends where the comparison does. Names only nominate, so two windows that share a name by accident cost a comparison and give no wrong run.
A run of period q is also a chain at the multiples of q; those are known from the runs of lower levels and passed over before any words are compared, so a text of one word repeated takes no more time than others.

Defined results: null or empty text has no words and no runs, and collapses to ''; words are the same if their bytes are; equal texts, equal values; repeated rows come out as they came in; an empty table gives an empty
result; texts and words of any length count whole. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import map_arrow, texts

#: Words appended at once.
STEP = 1 << 18
#: Odd constants that mix names.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX[0]
    return (x ^ (x >> np.uint64(29))) * MIX[2]


class Catchers:
    """The catchers of one text. `exponent`: how many periods a run has at least (2: every square). `longest`: no run has more words, so longer blocks need no catchers."""

    def __init__(self, exponent: int = 2, longest: int | None = None):
        self.exponent, self.longest, self.n = exponent, longest, 0
        self.words: list[np.ndarray] = []
        self.names: list[np.ndarray] = []  # by level: names of its latest windows
        self.first: list[int] = []  # by level: the start of the first of them
        self.chains: list[list[np.ndarray]] = []  # by level: rows of period, first block, last block

    def append(self, words: np.ndarray) -> None:
        """The next words, as whole numbers."""
        before, self.n = self.n, self.n + len(words)
        self.words.append(words)
        new, level, b = _mixed(words.astype(np.uint64)), 0, 1
        while level == 0 or level < len(self.names) or (self.n >= 3 * b and (self.longest is None or 2 * b * self.exponent <= self.longest)):
            start = max(0, before - b + 1)  # of the first window that is complete only now
            if level == len(self.names):
                self.names.append(np.empty(0, np.uint64)), self.first.append(0), self.chains.append([])
                start = 0  # a new level; the one below has lost nothing yet
            if level:
                lower, at = self.names[level - 1], self.first[level - 1]
                left = lower[start - at : self.n - b + 1 - at]
                new = _mixed(left * MIX[1] + lower[start - at + b // 2 : start - at + b // 2 + len(left)])
            self.names[level] = np.concatenate([self.names[level], new])
            self._catch(level, b, start)
            level, b = level + 1, 2 * b
        for level in range(len(self.names)):  # expired: what no window to come can meet; the next level's windows need the last 2 b too
            keep = 4 << level
            if len(self.names[level]) > 2 * keep:
                self.first[level] += len(self.names[level]) - keep
                self.names[level] = self.names[level][-keep:]

    def _catch(self, level: int, b: int, start: int) -> None:
        """Compare the windows that start at `start` or later with the blocks whose catchers are alive, and chain the blocks found."""
        names, at = self.names[level], self.first[level]
        windows = np.arange(start, at + len(names))
        nearest = (windows - 2 * b) & -b
        found = []
        for block in (nearest, nearest - b) if level else (nearest, windows - 3, windows - 1):
            alive = np.searchsorted(block, 0)  # a prefix of them would stand before the text
            hit = alive + np.flatnonzero(names[block[alive:] - at] == names[windows[alive:] - at])
            found.append(np.stack([windows[hit] - block[hit], block[hit]]))
        period, block = np.concatenate(found, axis=1)
        if len(period):
            order = np.lexsort((block, period))
            self.chains[level].append(_chained(np.stack([period[order], block[order], block[order]]), b))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the words so far: the smallest period, at least `exponent` periods long; by start, then period."""
        words = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        runs: dict[tuple[int, int], int] = {}
        for level, parts in enumerate(self.chains):
            if not parts:
                continue
            b = 1 << level
            rows = np.concatenate(parts, axis=1)
            period, first, last = _chained(rows[:, np.lexsort((rows[1], rows[0]))], b)
            enough = (last - first) // b + 1 >= np.maximum(1, ((self.exponent - 1) * period - b + 1) // b)
            period, first, last = period[enough], first[enough], last[enough]
            period, first, last = (x[~self._known(runs, b, period, first)] for x in (period, first, last))
            for p, i, j in zip(period.tolist(), first.tolist(), last.tolist(), strict=True):
                low, high = max(0, i - b), min(j + 2 * b, len(words) - p)
                same = np.flatnonzero(np.diff(np.concatenate(([0], (words[low:high] == words[low + p : high + p]).view(np.int8), [0]))))
                for s, e in zip((same[::2] + low).tolist(), (same[1::2] + low).tolist(), strict=True):
                    if e - s >= (self.exponent - 1) * p:
                        runs[s, e + p] = min(p, runs.get((s, e + p), p))
        return sorted((s, e - s, p) for (s, e), p in runs.items())

    def _known(self, runs: dict[tuple[int, int], int], b: int, period: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which chains are runs of lower levels at a multiple of their period: those begin with the first block inside the run."""
        long = np.array([(s, e, q) for (s, e), q in runs.items() if e - s >= 3 * b], np.int64).reshape(-1, 3)
        if not len(long) or not len(period):
            return np.zeros(len(period), bool)
        s, e, q = long.T
        block = -(-s // b) * b
        least, most = -(-2 * b // q), np.minimum(4 * b - 1, e - block - b) // q
        count = np.maximum(0, most - least + 1)
        multiple = np.repeat(least, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.isin(first * 4 + period, np.repeat(block * 4, count) + multiple * np.repeat(q, count))  # a period is below 4 b, a block starts at a multiple of b


def _chained(rows: np.ndarray, b: int) -> np.ndarray:
    """Rows of period, first, last block, ordered by period and first block, with neighbouring blocks of one period joined."""
    period, first, last = rows
    new = np.ones(len(period), bool)
    new[1:] = (period[1:] != period[:-1]) | (first[1:] != last[:-1] + b)
    head = np.flatnonzero(new)
    return np.stack([period[head], first[head], last[np.append(head[1:], len(period)) - 1]]) if len(head) else rows


def stream_runs(texts: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Of each text the (start, length, period) of its runs of at least `least` words and `exponent` periods. The texts go through one set of catchers, each ended by a mark that equals no word, so that no run leaves its text."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ends = np.cumsum([len(words) + 1 for words in texts]) - 1
    stream = np.empty(ends[-1] + 1 if len(ends) else 0, np.int64)
    at = 0
    for k, (words, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        stream[at:end] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        stream[end], at = -1 - k, end + 1
    catchers = Catchers(exponent, max(map(len, texts), default=0))
    for at in range(0, len(stream), STEP):
        catchers.append(stream[at : at + STEP])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catchers.runs():
        if length >= least:
            k = int(np.searchsorted(ends, start))
            found[k].append((start - (int(ends[k - 1]) + 1 if k else 0), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row; without a shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [text.encode().split() for text in batch["text"].to_pylist()]  # bytes: at ASCII white space
        offsets, starts, lengths, periods, kept = [0], [], [], [], []
        for words, runs in zip(split, stream_runs(split, exponent, least), strict=True):
            for column, values in zip((starts, lengths, periods), zip(*runs, strict=True), strict=False):
                column.extend(values)
            offsets.append(len(starts))
            kept.append(collapsed(words, runs))
        of_runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
        columns = [batch["doc_id"], pa.array(list(map(len, split)), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of_runs), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(texts(docs), kernel, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of the runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    given = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * top.length) div -top.period")
    return given.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which some rows are made periodic from a word on. Of h = crc32(doc_id), g = h div 10: where h % 10 = 0 and the text has n > 0 words, word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) div (3 + g % 8). A null doc_id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def planted(words):
        n = F.size(words).cast("long")
        a = F.pmod(F.floor(h / 10), n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    edited = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), 1)  # the lambda binds the words, which are split once
    return texts(docs).select("doc_id", F.when(h % 10 == 0, edited).otherwise(F.col("text")).alias("text"))
