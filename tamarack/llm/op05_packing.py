"""Best-fit packing of tokenized documents under several capacities at once.

A document's ids are cut into pieces (`pieces`): only a document longer than a sequence is cut, into full sequences after a
first piece that takes the remainder. A piece's demand on a sequence has three parts: its tokens, one document, and its attention
cost (length squared). All three follow from its length, so pieces of one length are interchangeable, and the packing
is decided on the histogram of lengths (`plan`): lengths descend; each goes to the kind of open sequence that every capacity
allows and whose residual vector is nearest to the demand (`norm`, a vector best fit) or has the largest weighted dot product with it
(`dot`). Equal sequences are one row with a count, so the plan's size depends on the number of lengths, not on the corpus.

With the contract's limits (as many documents and as much attention as a sequence of tokens can have) only the tokens bind; `most_documents` and `most_attention` set tighter ones.

Spark counts the pieces by length and deals each length to as many buckets as keep a bucket at about BUCKET_ROWS pieces, however many repeat; the driver plans over
the counts by (length, bucket), one for BUCKET_ROWS pieces and one more for each length, and each piece finds its place from its rank among the pieces of its length.

Defined results: null or empty text is one piece of one id (the end mark); repeated rows are packed each for itself; an empty
table gives an empty result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, slices, texts
from tamarack.llm.segments import Joined

CAPACITY, END, BUCKET_ROWS = 1024, 2, 100_000
_READY: dict[str, Joined] = {}


#: Bytes that remembered stretches may take, and characters that are encoded as one text.
MEMORY, TOGETHER = 144 << 20, 1 << 14


def _encoder(path: str, memory: int = MEMORY) -> Joined:
    """Text → its ids as little-endian unsigned 32-bit bytes, by the tokenizers library. `memory` bounds the remembered stretches from now on."""
    if path not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        width = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of each id: a byte is one character of the vocabulary
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            width[number] = len(token)

        def encode(given: list[str]) -> list[bytes]:
            return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(given, add_special_tokens=False)] if given else []

        def encode_stretches(given: list[str]) -> list[bytes]:
            """Stretches that begin with a blank don't depend on each other: many are encoded as one text, whose ids their numbers of bytes divide."""
            groups, size = [[]], 0
            for stretch in given:
                if size > TOGETHER:
                    groups.append([])
                    size = 0
                groups[-1].append(stretch)
                size += len(stretch)
            out = []
            for group, ids in zip(groups, encode(["".join(g) for g in groups]), strict=True):
                ends = np.cumsum(width[np.frombuffer(ids, np.uint32)])
                wanted = np.cumsum([len(x.encode()) for x in group])
                cut = np.searchsorted(ends, wanted)
                if group and (cut[-1] >= len(ends) or (ends[cut] != wanted).any()):  # an added token
                    out += encode(group)
                    continue
                at = 0
                for stop in (4 * (cut + 1)).tolist():
                    out.append(ids[at:stop])
                    at = stop
            return out

        _READY[path] = Joined(encode, encode, memory, encode_stretches)
    ready = _READY[path]
    ready.heads.limit = ready.rest.limit = memory
    return ready


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the spans of each document's ids."""

    def kernel(batches):
        encode = _encoder(tokenizer, memory)
        for batch in slices(batches, 512, 2 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                ids += end.to_bytes(4, "little")
                stop, total, piece = (len(ids) // 4 - 1) % capacity + 1, len(ids) // 4, 0
                start = 0
                while start < total:
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int = CAPACITY, most_documents: int | None = None, most_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset) from the number of pieces of each length (counts[length]).

    The pieces of a length are dealt to its rows by rank: from `first rank` on, `pieces a sequence` to each sequence from
    `first sequence` on, laid end to end from `offset`."""
    limits = np.array([capacity, most_documents or capacity, most_attention or capacity**2], np.int64)
    state = np.zeros((0, 5), np.int64)  # residual tokens, documents and attention, number of such sequences, the first of them
    rows, sequences = [], 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        demand, left, rank = np.array([length, 1, length * length], np.int64), int(counts[length]), 0
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((state[:, :3] >= demand).all(axis=1))
            if len(fits):
                residual, wanted = state[fits, :3] / limits, demand / limits
                good = -((residual - wanted) ** 2 @ np.array(weights)) if rule == "norm" else (residual * wanted) @ np.array(weights)
                k = int(fits[np.argmax(good)])
            else:
                each = int((limits // demand).min())
                state = np.vstack([state, [*limits, -(-left // each), sequences]])
                sequences += int(state[-1, 3])
                k = len(state) - 1
            each = int((state[k, :3] // demand).min())
            full, rest = divmod(left, each)
            number, first = int(state[k, 3]), int(state[k, 4])
            offset = capacity - int(state[k, 0])
            whole = min(full, number)
            new = []
            if whole:
                rows.append((length, rank, each, first, offset))
                new.append([*(state[k, :3] - each * demand), whole, first])
                rank, left = rank + whole * each, left - whole * each
            if whole < number and left:  # fewer than `each` are left
                rows.append((length, rank, rest, first + whole, offset))
                new.append([*(state[k, :3] - rest * demand), 1, first + whole])
                whole, left = whole + 1, 0
            if whole < number:
                new.append([*state[k, :3], number - whole, first + whole])
            state = np.vstack([np.delete(state, k, axis=0), *[x for x in np.array(new, np.int64) if x[0] > 0]])
    return np.array(rows, np.int64).reshape(-1, 5)


def place(plan_rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, from its length and its rank (from 0) among the pieces of that length."""
    order = np.lexsort((plan_rows[:, 1], plan_rows[:, 0]))
    rows = plan_rows[order]
    row = rows[np.searchsorted((rows[:, 0] << 48) | rows[:, 1], (length << 48) | rank, "right") - 1]
    turn = rank - row[:, 1]
    return row[:, 3] + turn // row[:, 2], row[:, 4] + turn % row[:, 2] * length


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS, **rules) -> DataFrame:
    """The rows of `cut` (from `pieces`, with a number `row` of each) with sequence_id and offset. cut is read several times; give it checkpointed."""
    spark, columns = cut.sparkSession, [c for c in cut.columns if c != "row"]
    totals = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    buckets = spark.createDataFrame([(length, -(-n // bucket_rows)) for length, n in totals.items()], "length long, buckets long")
    own = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), "buckets").cast("int"))  # capacity rows at most
    of_length = np.array([totals.get(length, 0) for length in range(capacity + 1)], np.int64)
    first = np.concatenate(([0], np.cumsum(-(-of_length // bucket_rows))))  # the buckets of all lengths, laid end to end
    counts = np.zeros(first[-1], np.int64)
    for length, bucket, n in own.groupBy("length", "bucket").count().collect():
        counts[first[length] + bucket] = n
    before = np.cumsum(counts) - counts - (np.cumsum(of_length) - of_length).repeat(np.diff(first))
    sent = spark.sparkContext.broadcast((plan(of_length, capacity, **rules), first, before))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")))

    def kernel(batches):
        rows, first, earlier = sent.value
        for batch in slices(batches, 65536):
            length = batch["length"].to_numpy()
            rank = earlier[first[length] + batch["bucket"].to_numpy()] + batch["rank"].to_numpy() - 1
            sequence, offset = place(rows, length, rank)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "bucket", "rank").mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, memory: int = MEMORY, **rules) -> DataFrame:
    """The pieces of all documents with their places. A worker keeps at most `memory` bytes of remembered stretches: less costs time, never a result."""
    return pack(checkpointed(pieces(docs, tokenizer, capacity, memory=memory).withColumn("row", F.monotonically_increasing_id())), capacity, **rules)
