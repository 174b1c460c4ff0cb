"""Secret scans: patterns of known forms, and a randomness test battery for secrets of unknown form.

The patterns (`known_spans`) find assignments, access keys and hexadecimal keys. Every other stretch of at least `LEAST` characters of the base-64 alphabets is a candidate. `encoding` infers its alphabet, the smallest of
ALPHABETS that holds it; a key has letters and digits, for letters alone are words and digits alone numbers. Three tests then ask whether it could be drawn at random from that alphabet: chi-squared uniformity of its symbols, runs above and below the alphabet's middle, and
serial correlation of neighbouring symbols; Fisher's method combines them, and what chance would do with probability below `REJECT` is no random key (counted-up alphabets, repeated digits, words).

Short words can look random too. So a candidate is also held against its null hypothesis, text: symbols drawn by the frequencies that the alphabet has in the whole corpus. Under it the number of coinciding pairs of symbols of a stretch of n
characters has a mean and a variance that follow from n; `text_p` is the probability that text of that length has as few. The longer the stretch, the further random keys fall below text. Candidates are put into classes of doubling length, and within each class false discoveries are controlled
(Benjamini and Hochberg, at `RATE`) over the candidates of all documents; so the short ones, of which there are many by chance, don't set the measure for the long ones. Spark counts candidates by class and step of -log10 p; the driver sees those counts alone.

Texts are read once: their spans, candidates and symbol counts are kept in the shared folder, and verdicts are made on those few.

Defined results: null or empty text has no spans; repeated rows come out as they came in and count as candidates as often as they occur; an empty table gives an empty result; texts of any length are scanned whole. A candidate that meets a known span is left to
it. Offsets are code points, the end exclusive. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, map_arrow, texts

#: Fixed by the contract: the known forms; group 2 of an assignment has 6 characters or more, an access key 20, a hexadecimal key 24. Letters of the first are of either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

LEAST, REJECT, RATE, STEPS = 20, 0.001, 0.01, 400
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in their own order of symbols, smallest first.
ALPHABETS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_STRETCH = np.isin(np.arange(256), [ord(c) for c in UPPER + LOWER + DIGITS + "+/_-"])


def known_spans(text: str, raw: bytes, stretch: bool) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) of the known forms; `stretch`: whether the text has a candidate's length of key characters anywhere."""
    found = []
    lower = raw.lower()
    if any(name in lower for name in _NAMES):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if stretch:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)] if b"AKIA" in raw else []
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def encoding(key: str) -> str | None:
    """The smallest alphabet that holds all of key; none for words and numbers."""
    own = set(key)
    if own.isdisjoint(DIGITS) or own.isdisjoint(UPPER + LOWER):
        return None
    return next((name for name, symbols in ALPHABETS.items() if own <= set(symbols)), None)


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_z(x: float, mean: float, variance: float) -> float:
    """x as a standard normal variable, if it is a gamma variable of this mean and variance (Wilson and Hilferty's cube root)."""
    shape = mean * mean / variance
    return ((max(x, 0.0) / mean) ** (1 / 3) - 1 + 1 / (9 * shape)) * math.sqrt(9 * shape)


def uniform_p(counts: np.ndarray, n: int) -> float:
    """Probability that n symbols drawn evenly have a chi-squared as large."""
    k = len(counts)
    return tail(gamma_z(k / n * float((counts * counts).sum()) - n, k - 1, 2 * (k - 1) * (n - 1) / n))


def runs_p(high: np.ndarray) -> float:
    """Two-sided: the number of runs of symbols above and below the middle, given how many there are of each."""
    n, a = len(high), int(high.sum())
    if a in (0, n):
        return 0.5 ** (n - 1)
    mean = 1 + 2 * a * (n - a) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return min(1.0, 2 * tail(max(0.0, abs(1 + int((high[1:] != high[:-1]).sum()) - mean) - 0.5) / math.sqrt(variance))) if variance > 0 else 1.0


def serial_p(symbols: np.ndarray) -> float:
    """Two-sided: the correlation of each symbol with the next."""
    n, d = len(symbols), symbols - symbols.mean()
    square = float(d @ d)
    return min(1.0, 2 * tail(abs(float(d[1:] @ d[:-1]) / square + 1 / n) * math.sqrt(n))) if square else 0.0


def battery(key: str, alphabet: str) -> float:
    """Fisher's combination of the three tests: the probability that a random key of the alphabet looks as odd."""
    symbols = np.array([alphabet.index(c) for c in key])
    counts = np.bincount(symbols, minlength=len(alphabet)).astype(float)
    x = -sum(math.log(max(p, 1e-300)) for p in (uniform_p(counts, len(key)), runs_p(symbols >= len(alphabet) / 2), serial_p(symbols.astype(float))))
    return math.exp(-x) * (1 + x + x * x / 2)  # chi-squared of six degrees of freedom beyond 2 x


def text_p(pairs: int, n: int, square: float, cube: float) -> float:
    """Probability that n symbols of text have as few coinciding pairs; square and cube: sums of the frequencies' powers."""
    among = n * (n - 1) / 2
    mean = among * square
    variance = among * (square - square * square) + n * (n - 1) * (n - 2) * (cube - square * square)
    return tail(-gamma_z(pairs + 0.5, mean, variance)) if variance > 0 else 1.0


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, encoding, coinciding pairs) of the stretches that pass as random keys of their alphabet and meet no span."""
    found = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        name = encoding(m[0])
        if name is None or any(s < end and start < e for s, e, _ in spans):
            continue
        if battery(m[0], ALPHABETS[name]) >= REJECT:
            counts = np.unique(list(m[0]), return_counts=True)[1]
            found.append((start, end, name, int((counts * (counts - 1)).sum()) // 2))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, end, kind), keys (start, end, encoding, pairs) of every row, and symbols: the counts of the characters 0 to 127, once for each slice of rows."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, keys, symbols = [], [], np.zeros(128, np.int64)
        for text in batch["text"].to_pylist():
            raw = text.encode()
            values = np.frombuffer(raw, np.uint8)
            symbols += np.bincount(values, minlength=256)[:128]
            gaps = np.flatnonzero(~_STRETCH[values])
            stretch = len(raw) >= LEAST and int(np.diff(gaps, prepend=-1, append=len(raw)).max()) > LEAST
            own = known_spans(text, raw, stretch)
            spans.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in own])
            keys.append([{"start": s, "end": e, "encoding": n, "pairs": p} for s, e, n, p in candidates(text, own)] if stretch else [])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        key = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("pairs", pa.int64())]))
        sums = pa.array([symbols.tolist()] + [None] * (batch.num_rows - 1), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, span), pa.array(keys, key), sums], names=["doc_id", "spans", "keys", "symbols"])

    kinds = "doc_id long, spans array<struct<start: long, end: long, kind: string>>, keys array<struct<start: long, end: long, encoding: string, pairs: long>>, symbols array<long>"
    return map_arrow(texts(docs), kernel, kinds)


def powers(symbols: dict[int, int]) -> dict[str, tuple[float, float]]:
    """Of each alphabet the sums of squares and of cubes of its symbols' frequencies in text; a symbol that text lacks counts once."""
    out = {}
    for name, alphabet in ALPHABETS.items():
        n = np.array([max(1, symbols.get(ord(c), 0)) for c in alphabet], float)
        f = n / n.sum()
        out[name] = (float((f**2).sum()), float((f**3).sum()))
    return out


def thresholds(rows: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """From (class, step, candidates), where p is at most 10 ** (-step / 10): the least step of each class that Benjamini and Hochberg accept. A class of which none is accepted is left out."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((step, n) for k, step, n in rows if k == c), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for step, n in own:
            seen += n
            if 10 ** (-step / 10) * total <= rate * seen:
                out[c] = step
    return out


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, spans: (start, end, kind) of every row, by start, then kind in the order of KINDS."""
    found = checkpointed(scan(docs))
    symbols = {r["pos"]: r["n"] for r in found.select(F.posexplode("symbols").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}  # 128 rows
    sums = powers(symbols)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = []
        for keys in batch["keys"].to_pylist():
            judged.append([])
            for key in keys:
                n = key["end"] - key["start"]
                p = text_p(key["pairs"], n, *sums[key["encoding"]])
                judged[-1].append({"start": key["start"], "end": key["end"], "class": n.bit_length(), "step": int(min(STEPS, max(0.0, -10 * math.log10(max(p, 1e-300)))))})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("step", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["spans"], pa.array(judged, kind)], names=["doc_id", "spans", "keys"])

    kinds = "doc_id long, spans array<struct<start: long, end: long, kind: string>>, keys array<struct<start: long, end: long, class: int, step: int>>"
    judged = map_arrow(found.select("doc_id", "spans", "keys"), kernel, kinds)
    counts = judged.select(F.explode("keys").alias("k")).groupBy("k.class", "k.step").count().collect()  # classes of doubling length by STEPS at most
    least = thresholds([tuple(r) for r in counts], rate)

    def passes(key: Column) -> Column:
        out = F.lit(False)
        for c, step in sorted(least.items()):
            out = out | ((key["class"] == c) & (key["step"] >= step))
        return out

    added = F.transform(F.filter("keys", passes), lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), F.lit(KINDS[3]).alias("kind")))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    merged = F.array_sort(F.transform(F.concat("spans", added), order))
    return judged.select("doc_id", F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, numbers of the known kinds, base_sha256 over their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    held = F.transform("spans", lambda s: s["kind"])
    number = [F.size(F.filter(held, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *number, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
