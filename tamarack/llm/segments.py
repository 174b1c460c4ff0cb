"""Cutting texts into stretches that a tokenizer treats independently, and remembering what each stretch gives.

The byte-level pattern joins one blank to the word after it and cuts longer runs of white space before their last character. So where every blank
is followed by a character that isn't white space, a cut before each blank changes no match, and splitting at blanks
is exact. Texts with other white space around blanks take the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Unicode's White_Space, written out: libraries differ on what \s holds.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = re.compile(f" (?:[{WHITE}]|\\Z)")


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """findall of a byte-level pattern, with White_Space for its \\s."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall


def even(text: str) -> bool:
    """Whether every blank is followed by something other than white space."""
    return not _UNEVEN.search(text)


class Memory(dict):
    """What stretches gave, up to a number of bytes; beyond it only the shortest half stay, which costs time, never a result. Long stretches are kept for one call alone."""

    #: The longest stretch that is remembered, and what an entry costs besides its contents.
    LONGEST, ENTRY = 200, 240

    def __init__(self, limit: int = 48 << 20):
        super().__init__()
        self.limit, self.size, self.once = limit, 0, {}

    def __missing__(self, key):
        return self.once[key]

    def _cost(self, key, value) -> int:
        return self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)

    def learn(self, wanted: set, compute: Callable[[list], list]) -> None:
        """Makes wanted readable until the next call."""
        new = list(wanted.difference(self))
        values = compute(new) if new else []
        self.once = dict(zip(new, values, strict=True))
        short = self.once if max(map(len, new), default=0) <= self.LONGEST else {k: v for k, v in self.once.items() if len(k) <= self.LONGEST}
        added = self.ENTRY * len(short) + sum(map(len, short)) + (sum(map(len, short.values())) if values and isinstance(values[0], bytes) else 0)
        if self.size + added > self.limit:
            for k in sorted(self.keys() - wanted, key=len)[len(self) // 2 :]:
                self.size -= self._cost(k, self.pop(k))
        if self.size + added <= self.limit:
            self.update(short)
            self.size += added
            self.once = {} if short is self.once else {k: v for k, v in self.once.items() if k not in short}


class Joined:
    """The joined values of a text's stretches. `plain` computes values of whole stretches from the list of their texts, `whole` the value of an uneven text, `blank` those of stretches that begin with a blank (or else `plain` does)."""

    def __init__(self, plain: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], limit: int = 48 << 20, blank: Callable[[list[str]], list[bytes]] | None = None):
        self.heads, self.rest, self.plain, self.whole, self.blank = Memory(limit), Memory(limit), plain, whole, blank or plain

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [x.split(" ") if even(x) else None for x in texts]
        self.heads.learn({s[0] for s in split if s}, self.plain)
        self.rest.learn({x for s in split if s for x in s[1:]}, lambda new: self.blank([" " + x for x in new]))
        odd = iter(self.whole([x for x, s in zip(texts, split, strict=True) if s is None]))
        get, head = self.rest.__getitem__, self.heads.__getitem__
        return [next(odd) if s is None else head(s[0]) + b"".join(map(get, s[1:])) for s in split]
