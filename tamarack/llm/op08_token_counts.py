"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick lists every vocabulary piece at every place of a stretch of text in one pass. Dynamic programming over the end positions carries
the best score and the number of pieces of the path that has it. Ties follow the unigram tokenizer's own rule: ends are reached in order of the pieces'
starts, and a later path replaces an earlier one only with a strictly larger score, so among equal paths the one whose last piece is longest stays.
A character that no one-character piece covers is also an unknown piece, scored `unknown` below the least score, and counts as its UTF-8 bytes.

Blanks become U+2581, one is put before the text, and no piece has one after another character; so no piece crosses a run of blanks'
beginning, best paths of the stretches between such cuts join to the best path of the text (scores are integers, exact in doubles), and
a stretch's count can be remembered.

Defined results: null or empty text counts 0; equal texts, equal counts; texts of any length count whole. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm.common import slices, texts
from tamarack.llm.segments import Memory

#: Fixed by the tokenizer: the sign for a blank, and how far below the least score an unknown character stands.
BLANK, UNKNOWN = "▁", 10.0
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Counter:
    def __init__(self, pieces: dict[str, float]):
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece has a blank after another character; stretches would depend on each other")
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.machine.add_word(piece, (len(piece), float(score)))
        self.machine.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.rest = Memory()

    def best(self, text: str) -> int:
        """The number of pieces of the best path through a stretch."""
        n = len(text)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (length, score) in self.machine.iter(text):
            by_start[last + 1 - length].append((length, score))
        score, count = [None] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        for start in range(n):
            own, pieces, single = score[start], count[start], False
            for length, gain in by_start[start]:
                end, total = start + length, own + gain
                single |= length == 1
                if score[end] is None or total > score[end]:
                    score[end], count[end] = total, pieces + 1
            if not single:
                total = own + self.unknown
                if score[start + 1] is None or total > score[start + 1]:
                    score[start + 1], count[start + 1] = total, pieces + len(text[start].encode())
        return count[n]

    def count(self, given: list[str]) -> list[int]:
        split = []
        for text in given:
            text = text.replace(" ", BLANK)
            split.append(_STRETCH.findall(BLANK + text) if BLANK + BLANK in text or text[:1] == BLANK or text[-1:] == BLANK else [BLANK + x for x in text.split(BLANK)] if text else [])
        self.rest.learn({x for s in split for x in s}, lambda new: list(map(self.best, new)))
        get = self.rest.__getitem__
        return [sum(map(get, s)) for s in split]


_READY: dict[str, Counter] = {}


def counter(model: str) -> Counter:
    """The pieces and scores of a sentencepiece file, taken as a unigram vocabulary (control, byte and unknown entries left out)."""
    if model not in _READY:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        entries = [i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        _READY[model] = Counter({own.id_to_piece(i): own.get_score(i) for i in entries})
    return _READY[model]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens of each whole text."""

    def kernel(batches):
        own = counter(model)
        for batch in slices(batches, 512, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own.count(batch["text"].to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(kernel, "doc_id long, n_tokens long")
