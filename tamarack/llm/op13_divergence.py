"""Source divergence audit: how the sources of a language differ in their words, by chunk factorization.

A text's white-space chunks are counted, not its terms: the chunks of a task's documents are numbered and counted as arrays, and summed by (lang, chunk), later by source within each, before anything is shuffled. Each distinct
chunk of a language is tokenized once (`tokenized`), and its terms are joined back to the chunk's sums. Numbers of distinct documents don't add up over chunks, for a document may hold a term in several of them ("word", "word,"). But they
are bounded: a term has at least as many documents as its most widespread chunk, and at most as many as all of its chunks together. Only where the least number asked for lies between the two are documents themselves joined
to the term's chunks and counted (`exact_documents`).

Most distinct chunks are rare and hold no kept term. So texts are read a second time for the occurrences by source, and a Bloom filter of the wanted chunks, of bounded size, holds the others back in their tasks; what it lets
through by chance goes in the join, and where it is too small for the vocabulary it only saves less.

A group's smoothed shares are compared in blocks of terms: a block is a matrix of sources by terms, whose sums of differences for each pair of sources are added up over blocks.

Defined results: null text, lang and source are ''; a row is a document, so repeated rows count again; a group without terms is compared like any other (all its counts are 0); a language whose every term is rarer than `least_docs` has
values of 0; an empty table gives an empty result. Texts and chunks of any length count whole. Columns beyond text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import checkpointed, slices, stored

#: Fixed by the contract: what a term is; only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, PRIOR = 1_000_000_000, 5

#: A task counts so many bytes of rows at once (one slice at least). Cells of a block of shares, at least. Bits of a Bloom filter: so many for each chunk, and at most (8 MB).
FLUSH_BYTES, CELLS, BITS_A_CHUNK, MOST_BITS = 32 << 20, 1 << 16, 16, 1 << 26
#: Where in a chunk's digest the filter's three numbers begin.
SHIFTS = (0, 19, 38)
#: An odd number and its inverse modulo 2**64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def grouped_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def places(lang: str, chunks: pa.Array, bits: int) -> list[np.ndarray]:
    """Where a filter of so many bits (a power of two) marks the chunks of a language: from polynomials of their bytes modulo 2**64, for all chunks together."""
    given = chunks.cast(pa.large_binary())
    ends = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1]
    raw = np.frombuffer(given.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(given) else np.zeros(0, np.uint8)
    ends = ends - (ends[0] if len(ends) else 0)
    powers, back = (np.cumprod(np.full(len(raw) + 1, x, np.uint64)) for x in (FACTOR, INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
    digest = (sums[ends[1:]] - sums[ends[:-1]]) * back[ends[:-1]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))
    for shift in (32, 29):
        digest = (digest ^ digest >> np.uint64(shift)) * FACTOR
    return [(digest >> np.uint64(n)) & np.uint64(bits - 1) for n in SHIFTS]


def bloom_filter(chunks: DataFrame):
    """A broadcast filter of the columns `lang` and `chunk`: its words of 64 bits, of which the driver sees MOST_BITS / 64 at most."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_CHUNK * chunks.count()).bit_length()))

    def kernel(batches):
        for lang, own in by_language(batches, FLUSH_BYTES):
            place = np.unique(np.concatenate(places(lang, own["chunk"].combine_chunks(), bits)))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(marks.view(np.int64))], names=["word", "bits"])

    found = chunks.select("lang", "chunk").mapInArrow(kernel, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return chunks.sparkSession.sparkContext.broadcast(words)


def passing(words: np.ndarray, lang: str, chunks: pa.Array) -> np.ndarray:
    """Which of the chunks of a language the filter lets through."""
    through = np.ones(len(chunks), bool)
    for place in places(lang, chunks, len(words) * 64):
        through &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return through


def split(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks of texts (split at ASCII white space), and for each occurrence the place of its text and of its chunk."""
    parts = pa.compute.ascii_split_whitespace(texts.combine_chunks())
    named = parts.flatten().dictionary_encode()
    chunks, code = named.dictionary.cast(pa.string()), named.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
    if (nothing := pa.compute.index(chunks, "").as_py()) >= 0:  # before the first or after the last white space
        row, code = row[code != nothing], code[code != nothing]
    return chunks, row, code


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of the numbers from 0, in order, and how often each occurs. Sorts them in place."""
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.diff(first, append=len(key))


def by_language(batches, most: int):
    """(lang, rows) of batches of texts, put together up to `most` bytes."""

    def parts(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        for lang in pa.compute.unique(rows["lang"]):
            yield lang.as_py(), rows.filter(pa.compute.equal(rows["lang"], lang))

    held, size = [], 0
    for batch in slices(batches, 8192):
        if held and size + batch.nbytes > most:
            yield from parts(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from parts(held)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """lang, chunk, n: documents, summed over what a task holds at once."""

    def kernel(batches):
        for lang, own in by_language(batches, FLUSH_BYTES):
            chunks, row, code = split(own["text"])
            once, _ = distinct(code * len(own) + row)
            n = np.bincount(once // len(own), minlength=len(chunks))
            chunks, n = chunks.filter(pa.array(n > 0)), n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), chunks, pa.array(n)], names=["lang", "chunk", "n"])

    return grouped_texts(docs).select("lang", "text").mapInArrow(kernel, "lang string, chunk string, n long")


def chunk_occurrences(docs: DataFrame, wanted) -> DataFrame:
    """lang, chunk, held (source, n): occurrences of the chunks that `wanted` (a Bloom filter) lets through, by source, summed over what a task holds at once."""

    def kernel(batches):
        for lang, own in by_language(batches, FLUSH_BYTES):
            sources = own["source"].combine_chunks().dictionary_encode()
            chunks, row, code = split(own["text"])
            through = passing(wanted.value, lang, chunks)[code]
            pair, n = distinct(code[through] * len(sources.dictionary) + sources.indices.to_numpy()[row[through]])
            chunk, first = np.unique(pair // len(sources.dictionary), return_index=True)
            held = pa.StructArray.from_arrays([sources.dictionary.cast(pa.string()).take(pa.array(pair % len(sources.dictionary))), pa.array(n)], names=["source", "n"])
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)), pa.int32()), held)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(chunk)), chunks.take(pa.array(chunk)), held], names=["lang", "chunk", "held"])

    return grouped_texts(docs).mapInArrow(kernel, "lang string, chunk string, held array<struct<source:string,n:long>>")


def tokenized(docs: DataFrame) -> DataFrame:
    """lang, chunk, n_docs, term, times of each chunk of each language. All rows of a chunk of a language meet in one place, where it is tokenized once."""
    # a task hands on a chunk once or twice, so sums before the shuffle would save nothing
    counts = chunk_documents(docs).repartition("lang", "chunk").groupBy("lang", "chunk").agg(F.sum("n").alias("n_docs"))
    terms = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), 0)
    return counts.select("lang", "chunk", "n_docs", F.explode(terms).alias("term")).groupBy("lang", "chunk", "n_docs", "term").agg(F.count("*").alias("times"))


def exact_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, term, n_docs for the terms of `wanted` (lang, chunk, term): documents are joined to its chunks, whole texts again."""
    sent = bloom_filter(wanted)

    def kernel(batches):
        for lang, own in by_language(batches, FLUSH_BYTES):
            chunks, row, code = split(own["text"])
            through = passing(sent.value, lang, chunks)[code]
            once, _ = distinct(code[through] * len(own) + row[through])
            yield pa.RecordBatch.from_arrays([own["row"].combine_chunks().take(pa.array(once % len(own))), pa.repeat(lang, len(once)), chunks.take(pa.array(once // len(own)))], names=["row", "lang", "chunk"])

    met = grouped_texts(docs).select("lang", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(kernel, "row long, lang string, chunk string").join(wanted, ["lang", "chunk"])
    return met.select("lang", "term", "row").distinct().groupBy("lang", "term").agg(F.count("*").alias("n_docs"))


def kept_terms(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term) of terms in at least `least_docs` documents of the language, and (lang, chunk, term, times) of the chunks that hold them."""
    held = stored(tokenized(docs), "chunks")
    bounds = checkpointed(held.groupBy("lang", "term").agg(F.max("n_docs").alias("least"), F.sum("n_docs").alias("most")).where(F.col("most") >= least_docs))
    possible = stored(held.join(bounds.hint("shuffle_hash"), ["lang", "term"]).select("lang", "chunk", "term", "times", "least"), "possible")
    settled = exact_documents(docs, possible.where(F.col("least") < least_docs).select("lang", "chunk", "term")).where(F.col("n_docs") >= least_docs).select("lang", "term")
    kept = checkpointed(bounds.where(F.col("least") >= least_docs).select("lang", "term").union(settled))
    return kept, possible.join(kept.hint("shuffle_hash"), ["lang", "term"], "left_semi").select("lang", "chunk", "term", "times")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact for any counts; terms is not 0."""
    wide = lambda e: f"cast({e} as decimal(20,0))"
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * {wide(f'{count} + {PRIOR}')}) div {wide(f'{total} + {PRIOR} * {terms}')}")


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value: differences of shares summed over all kept terms.

    shares: lang, source, term, p where a term occurs; groups: lang, source, p0 (the share of a term that doesn't occur), n_terms, n_sources."""
    cells = F.greatest(F.lit(CELLS), F.col("n_sources") * F.col("n_sources"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_sources") * F.col("n_terms") / cells)).cast("long")
    own = groups.select("lang", "source", "p0", blocks.alias("blocks"))
    marks = own.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    counted = shares.join(own.select("lang", "blocks").distinct(), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p")

    def kernel(key, block):
        is_mark = pa.compute.is_null(block["term"])
        mark, rows = block.filter(is_mark), block.filter(pa.compute.invert(is_mark))
        sources = mark["source"].combine_chunks()
        column = rows["term"].combine_chunks().dictionary_encode()
        shares = np.repeat(mark["p"].to_numpy()[:, None], len(column.dictionary), axis=1)
        shares[pa.compute.index_in(rows["source"], sources).to_numpy(), column.indices.to_numpy(zero_copy_only=False)] = rows["p"].to_numpy()
        n = len(sources)
        value = np.concatenate([np.abs(shares - own).sum(axis=1) for own in shares])
        one, other = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        different = one != other
        return pa.table({"lang": pa.array([key[0].as_py()] * int(different.sum()), pa.string()), "source": sources.take(pa.array(one[different])), "item": sources.take(pa.array(other[different])), "value": pa.array(value[different], pa.int64())})

    parts = marks.union(counted).groupBy("lang", "block").applyInArrow(kernel, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the distance of a source to each other one of its language. Part `term`: the `top` terms that it has more than its language."""
    kept, chunks = kept_terms(docs, least_docs)
    chunks = checkpointed(chunks)
    counts = chunk_occurrences(docs, bloom_filter(chunks)).join(chunks.hint("shuffle_hash"), ["lang", "chunk"]).select("lang", "term", "times", F.inline("held"))
    of_group = checkpointed(counts.groupBy("lang", "source", "term").agg(F.sum(F.col("n") * F.col("times")).alias("count")))
    sources = grouped_texts(docs).select("lang", "source").distinct()
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    n_sources = sources.groupBy("lang").agg(F.count("*").alias("n_sources"))
    totals = of_group.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = sources.join(n_sources, "lang").join(n_terms, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["n_terms", "total"])
    groups = checkpointed(groups.withColumn("p0", F.when(F.col("n_terms") > 0, share("0", "total", "n_terms")).otherwise(0)))
    shares = of_group.join(groups.drop("p0", "n_sources"), ["lang", "source"]).select("lang", "source", "term", share("count", "total", "n_terms").alias("p"))
    shares = checkpointed(shares)
    pairs = pair_distances(shares, groups)

    of_lang = of_group.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("n_terms").alias("n_terms"))
    usual = of_lang.join(whole, "lang").select("lang", "term", share("count", "total", "n_terms").alias("q"))
    more = shares.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    return part(pairs, "pair").union(part(more, "term").where(F.col("rank") <= top))
