"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: each four-word shingle of the lower-cased (A-Z) text votes with its XXH64 on 64 bits.

Candidates: a fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect binary Golay code has exactly one codeword within
distance 3 of any 23-bit word; a segment (padded with zeros) is decoded to it, and where it lies at distance 3 also to the five codewords at distance 4.
Two segments that differ in at most 2 bits lie within distance 1 of a common word, whose codeword is then within distance 4 of both: they share a codeword index (12 bits).
Of 4 differing bits, either some segment has none and one of the others at most 2, or every segment has at least one, and then
two have exactly one and the third at most 2. So the index of one segment, joined with one of six exact samples of the other two (either one whole,
or one half of each), is shared by every pair within 4 bits: 3 * 6 samples, times one or six indices, are the keys of a fingerprint. No link is lost.

Keys are joined by shuffling on the key; each bucket is verified by exact Hamming distance and gives the edges of a spanning forest of its links, never all pairs.
Only distinct fingerprints are keyed, so copies cost nothing here. Components follow in Spark (`graph.components`).

Defined results: null or empty text has fingerprint zero and links like any other; fewer than four words are one shingle; equal texts share a
component; rows repeat as they come; an empty table gives an empty result; a null doc_id takes part and is never a component's id unless no other is there.
Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, row_key, slices
from tamarack.llm.graph import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: (shift, width) of the segments, and of the halves of each.
SEGMENTS = [(42, 22), (21, 21), (0, 21)]
#: Buckets of up to so many fingerprints are verified pair by pair, larger ones by growing a forest.
SMALL = 16
#: Fixed by the code: the generator polynomial of the binary Golay code.
GENERATOR = 0xC75


def fingerprints(raw: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts, as signed numbers."""
    digest, hashes, sizes = xxhash.xxh64_digest, [], []
    for text in raw:
        words = text.lower().split()  # of bytes: A-Z, and ASCII white space
        if len(words) <= shingle:
            sizes.append(1 if words else 0)
            if words:
                hashes.append(digest(b" ".join(words), SEED))
            continue
        line = b" ".join(words)
        start = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        begin = start[: len(words) - shingle + 1].tolist()
        end = (start[shingle:] - 1).tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(begin, end, strict=True)]
        sizes.append(len(begin))
    sizes_, out = np.array(sizes, np.int64), np.zeros(len(raw), np.uint64)
    has = sizes_ > 0
    if has.any():
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        first = np.cumsum(sizes_[has]) - sizes_[has]
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * votes > sizes_[has][:, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


class Golay:
    """Decoding tables of the (23, 12) code."""

    def __init__(self):
        def rest(x: int) -> int:
            for i in range(22, 10, -1):
                if x >> i & 1:
                    x ^= GENERATOR << (i - 11)
            return x

        self.low, self.high = np.array([rest(x) for x in range(4096)], np.int64), np.array([rest(x << 12) for x in range(2048)], np.int64)
        words = [m << 11 | rest(m << 11) for m in range(4096)]
        sevens: dict[int, list[int]] = {}
        for w in words:
            if w.bit_count() == 7:
                places = [1 << i for i in range(23) if w >> i & 1]
                for three in combinations(places, 3):
                    sevens.setdefault(sum(three), []).append(w)
        #: By syndrome: how many indices there are, and what to XOR to the word's top 12 bits for each.
        self.number, self.change = np.ones(2048, np.int64), np.zeros((2048, 6), np.int64)
        for weight in range(4):
            for places in combinations(range(23), weight):
                error = sum(1 << i for i in places)
                near = [error] + [error ^ w for w in sevens.get(error, [])]
                s = rest(error)
                self.number[s] = len(near)
                self.change[s, : len(near)] = [x >> 11 for x in near]

    def indices(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) codeword indices of 23-bit words, and how many of each row count."""
        syndrome = self.low[word & 4095] ^ self.high[word >> 12]
        return (word >> 11)[:, None] ^ self.change[syndrome], self.number[syndrome]


GOLAY = Golay()


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (signed 64-bit), and the place of each key's fingerprint."""
    bits = fp.view(np.uint64)
    part = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    half = [[p & ((1 << (w // 2)) - 1), p >> (w // 2)] for p, (_, w) in zip(part, SEGMENTS, strict=True)]
    out, owner, family = [], [], 0
    for j in range(3):
        index, number = GOLAY.indices(part[j])
        row, column = np.nonzero(np.arange(6) < number[:, None])
        fuzzy = index[row, column] << 22
        a, b = [i for i in range(3) if i != j]
        samples = [part[a], part[b]] + [half[a][x] << 11 | half[b][y] for x in range(2) for y in range(2)]
        for sample in samples:
            out.append(family << 34 | fuzzy | sample[row])
            owner.append(row)
            family += 1
    return np.concatenate(out), np.concatenate(owner)


def _distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints; each is compared with those not yet reached."""
    left, edges = fp, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _distance(left, x) <= most
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(x), int(y)) for y in found]
                todo += list(found)
    return edges


def bucket_edges(key: np.ndarray, fp: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Links (u < v) from whole buckets of rows sorted by key; linked fingerprints of a bucket are joined by them."""
    if len(key) < 2:
        return np.zeros((0, 2), np.int64)
    cuts = np.flatnonzero(np.diff(key)) + 1
    first, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(key)])))
    found, of_row = [], np.repeat(size, size)
    for step in range(1, min(SMALL, int(size.max()))):
        near = (key[step:] == key[:-step]) & (of_row[step:] <= SMALL)
        near[near] = _distance(fp[step:][near], fp[:-step][near]) <= most
        found.append(np.stack([fp[:-step][near], fp[step:][near]], axis=1))
    for k in np.flatnonzero(size > SMALL):
        found.append(np.array(forest(fp[first[k] : first[k] + size[k]], most), np.int64).reshape(-1, 2))
    edges = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """key, doc_id, fp of every row."""

    def kernel(batches):
        for batch in slices(batches, 512, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.array(fingerprints(batch["text"].cast(pa.binary()).to_pylist()))], names=["key", "doc_id", "fp"])

    given = docs.select(row_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(kernel, "key binary, doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """u, v: fingerprints within MOST_BITS of each other; every link is an edge or joined by edges."""

    def spread(batches):
        for batch in slices(batches, 4096):
            fp = batch["fp"].to_numpy()
            key, owner = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], names=["key", "fp"])

    def verify(batches):
        def edges(key: np.ndarray, fp: np.ndarray):
            found = bucket_edges(key, fp)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        held_key, held = None, []  # the last bucket may go on in the next batches; its parts are joined once
        for batch in batches:
            key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
            if not len(key):
                continue
            more = int(np.searchsorted(key, held_key, "right")) if held and key[0] == held_key else 0
            if more:
                held.append(fp[:more])
            if more == len(key):
                continue
            if held:
                fps = np.concatenate(held)
                yield from edges(np.zeros(len(fps), np.int64), fps)
            last = int(np.searchsorted(key, key[-1], "left"))
            yield from edges(key[more:last], fp[more:last])
            held_key, held = key[-1], [fp[last:]]
        if held:
            fps = np.concatenate(held)
            yield from edges(np.zeros(len(fps), np.int64), fps)

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(verify, "u long, v long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """key, doc_id, fp, root of every row: rows of one component have one root."""
    own = checkpointed(fingerprint_table(docs))
    member = components(links(own.select("fp").distinct()))
    # a fingerprint that many rows share makes a large partition of the left side, which adaptive execution splits
    return own.join(member, own["fp"] == member["node"], "left").select("key", "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    found = checkpointed(classes(docs))
    named = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(named, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of docs of each component of found (key, doc_id, root of each row; else by fingerprints): that of the least doc_id (null last), then of the least key.

    Rows are told apart by doc_id and text together, so a doc_id that stands on different texts loses none that has no near copy. Of rows equal in both, the one whose columns make the least JSON text stays."""
    found = classes(docs) if found is None else found
    rows = found.groupBy("key").agg(F.min("root").alias("root"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    winners = checkpointed(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "copies")).alias("w")).select("w.key", "w.copies"))
    keyed = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))  # names of the caller's columns can't clash with ours
    kept = keyed.join(winners.where("copies = 1").select("key"), "key", "left_semi").select("row.*")
    again = winners.where("copies > 1").select("key")
    if again.isEmpty():
        return kept
    once = keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))  # copies meet in partial sums, not in one task
    return kept.unionByName(once.select("row.*"))
