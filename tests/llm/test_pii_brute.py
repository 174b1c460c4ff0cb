"""Surrogates against a plain Python version, on texts whose entities are known."""

import hashlib
import random

from tamarack.llm import op07_pii as pii

from .test_operators import table

KEY = "a key"


def number(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def permuted(digits, salt, attempt):
    half = {"left": digits[: len(digits) // 2], "right": digits[len(digits) // 2 :]}
    for turn, (own, other) in enumerate([("right", "left"), ("left", "right")] * 2):
        size = len(half[own])
        if size:
            half[own] = str((int(half[own]) + number(KEY, attempt, turn, salt, len(digits), half[other]) % 10**size) % 10**size).zfill(size)
    return half["left"] + half["right"]


def check_digit(body):
    return -sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body))) % 10


def proposed(kind, canon, attempt):
    if kind == "phone":
        digits = canon.lstrip("+")
        kept = digits[: max(len(digits) - 9, 1)]
        return canon[: len(canon) - len(digits)] + kept + permuted(digits[len(kept) :], f"phone|{kept}", attempt)
    if kind == "ssn":
        return permuted(canon, "ssn|", attempt)
    if kind == "card":
        body = canon[0] + permuted(canon[1:-1], f"card|{canon[0]}", attempt)
        return body + str((check_digit(body) + int(canon[-1]) - check_digit(canon[:-1])) % 10)
    if kind == "ipv4":
        a, b, c, d = map(int, canon.split("."))
        high, low = 256 * a + b, 256 * c + d
        for turn in range(2):
            low = (low + number(KEY, attempt, turn, "low", high) % 65536) % 65536
            high = (high + number(KEY, attempt, turn, "high", low) % 65536) % 65536
        return f"{high // 256}.{high % 256}.{low // 256}.{low % 256}"
    names = pii.NAMES["latin", kind]
    return "-".join(names[number(KEY, kind, p, attempt, canon) % len(names)] for p in range(attempt + 1))


def plain_dictionary(entities):
    known, pending, attempt = {}, set(entities), 0
    while pending:
        best = {}
        for kind, canon in sorted(pending):
            best.setdefault((kind, proposed(kind, canon, attempt)), canon)
        for (kind, surrogate), canon in best.items():
            if (kind, surrogate) not in entities and surrogate not in [s for (k, _), s in known.items() if k == kind]:
                known[kind, canon] = surrogate
        pending = {e for e in pending if e not in known}
        attempt += 1
    return known


def laid(raw, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in raw)


def test_whole_texts_match_plain_python(spark):
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9)))
    lasts, firsts = [word().capitalize() for _ in range(120)], [word().capitalize() for _ in range(60)]
    pool = [("phone", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}") for _ in range(30)] + [("ssn", f"{digits(3)}-{digits(2)}-{digits(4)}") for _ in range(30)] + [("card", " ".join(["4" + digits(3), digits(4), digits(4), digits(4)])) for _ in range(20)]
    pool += [("ipv4", ".".join(str(r.randint(0, 255)) for _ in range(4))) for _ in range(20)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(r.randint(1, 6)):
            parts.append((None, f" {word()} {word()}: "))
            if r.random() < 0.5:
                parts.append(r.choice(pool))
            else:
                parts += [(None, "Mr "), ("first_m", r.choice(firsts)), (None, " "), ("last", r.choice(lasts))]
            parts.append((None, ";"))
        docs.append((k, parts))

    def canon(kind, raw):
        only = "".join(c for c in raw if c.isdigit())
        return {"phone": "+" + only, "ssn": only, "card": only}.get(kind, raw)

    known = plain_dictionary({(kind, canon(kind, raw)) for _, parts in docs for kind, raw in parts if kind})

    def new(kind, raw):
        surrogate = known[kind, canon(kind, raw)]
        return laid(raw, surrogate.lstrip("+")) if kind in ("phone", "ssn", "card") else surrogate

    wanted = {k: "".join(new(kind, raw) if kind else raw for kind, raw in parts) for k, parts in docs}
    out = {x.doc_id: x for x in pii.replace_pii(table(spark, [(k, "".join(raw for _, raw in parts)) for k, parts in docs]), KEY).collect()}
    assert {k: x.text for k, x in out.items()} == wanted
    assert all(out[k].n_entities == sum(kind is not None and kind != "last" for kind, _ in parts) for k, parts in docs)
