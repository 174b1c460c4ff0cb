"""Operators 11 to 13 against plain Python, on small tables and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamarack.llm import op11_periodic_runs as runs
from tamarack.llm import op12_secret_scan as secrets
from tamarack.llm import op13_divergence as divergence

KIND = "doc_id long, text string, lang string, source string, n_chars long, runs string, spans string, chunk string, n long"
ODD = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (None, "un deux"), (4, "x " * 5000), (5, " \n\t "), (6, "½ 中文 中文 中文 中文 中文 中文"), (7, "a\x00b\x1cc"), (8, "w" * 100_000)]


def table(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", None, "r", "s", "c", 1) for i, t in rows], KIND)


# 11
def plain_runs(words, exponent, least):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(r, most):
    words = []
    while len(words) < most and r.random() < 0.9:
        words += [bytes([97 + r.randrange(3)]) for _ in range(r.randint(1, 9))] * r.randint(1, 6)
    return words


@pytest.mark.parametrize("step", [1, 5, 1 << 18])
def test_runs_match_plain(step, monkeypatch):
    monkeypatch.setattr(runs, "STEP", step)
    r = random.Random(step)
    for _ in range(150):
        texts, exponent, least = [periodic(r, 70) for _ in range(3)], r.choice([2, 3, 4]), r.choice([0, 6])
        assert runs.stream_runs(texts, exponent, least) == [plain_runs(w, exponent, least) for w in texts]


def test_names_that_collide_give_no_wrong_run(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: x & np.uint64(1))
    r = random.Random(1)
    for _ in range(100):
        words = periodic(r, 50)
        found = runs.stream_runs([words], 2, 0)[0]
        for start, length, period in found:
            assert words[start : start + length - period] == words[start + period : start + length]


def test_one_word_repeated_is_quick():
    assert runs.stream_runs([[b"a"] * 200_000], 4, 6) == [[(0, 200_000, 1)]]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query_matches_plain(spark):
    r = random.Random(9)
    rows = ODD + [(k, " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 90)))) for k in range(100, 260)]
    got = sorted(map(str, runs.digest(runs.periodic_runs(runs.with_planted_runs(table(spark, rows)))).collect()))
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        own = plain_runs(words, 4, 6) if len(set(words)) > 1 or len(words) < 5000 else [(0, len(words), 1)]
        dropped = {i for s, n, q in own for i in range(s + q, s + n)}
        top = min(own, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want.append((doc_id, len(own), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, w, strict=True)))) for w in want)
    assert sum(w[1] for w in want) > 5
    assert runs.digest(runs.periodic_runs(table(spark, []))).count() == 0


# 12
SECRET = "k7Qz9XbT2mWv5LpR8sYdF3hJc6NgAe4U"


def test_known_forms():
    text = 'token: "abc12" Token = secret=token:abcdefgh api_key="12345678" ſecret=abcdefgh AKIAABC AKIA' + "A" * 16 + " é " + "0a" * 12 + " 0a0a"
    found = [(text[s:e], secrets.KINDS[k]) for s, e, k in secrets.known_spans(text, text.encode(), True)]
    assert found == [("Token = secret=token", "assign"), ('api_key="12345678', "assign"), ("AKIA" + "A" * 16, "access"), ("0a" * 12, "hex")]
    # group 2 of the first assignment has five characters; a failing match still takes its characters
    assert not secrets.known_spans("secret=token:abcdefgh", b"secret=token:abcdefgh", False)


def test_battery_tells_random_from_ordered():
    r = random.Random(2)
    for name in ("hex", "base32", "base62", "base64"):
        alphabet = secrets.ALPHABETS[name]
        keys = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(300)]
        assert np.mean([secrets.battery(k, alphabet) >= secrets.REJECT for k in keys]) > 0.97
        assert secrets.battery(alphabet, alphabet) < secrets.REJECT or len(alphabet) < 20  # counted up
        assert secrets.battery((alphabet[:2] * 40)[:40], alphabet) < secrets.REJECT
    assert secrets.encoding("0123456789abcdef") == "hex" and secrets.encoding("DEAD8EEF") == "HEX" and secrets.encoding("MZXW6YTB") == "base32" and secrets.encoding("a_Z-9") == "base64url" and secrets.encoding("a1_+") is None
    assert secrets.encoding("zwischenverstehen") is None and secrets.encoding("kati-lorem") is None and secrets.encoding("2024-11-28") is None


def test_text_p_is_uniform_under_text():
    r = np.random.default_rng(3)
    f = np.array([8, 5, 3, 2, 1, 1, 1, 1], float) / 22
    draws = r.choice(8, (3000, 40), p=f)
    p = [secrets.text_p(int((c * (c - 1)).sum()) // 2, 40, float((f**2).sum()), float((f**3).sum())) for c in (np.bincount(d, minlength=8) for d in draws)]
    assert 0.03 < np.mean(np.array(p) < 0.05) < 0.07 and np.mean(np.array(p) < 0.001) < 0.004


def test_thresholds_are_those_of_benjamini_and_hochberg():
    r = random.Random(4)
    for _ in range(50):
        steps = [r.choice([0, 1, 2, 5, 20, 30]) for _ in range(r.randint(1, 40))]
        least = secrets.thresholds([(5, s, n) for s, n in Counter(steps).items()], 0.1).get(5)
        p = sorted(10 ** (-s / 10) for s in steps)
        accepted = max((k + 1 for k, x in enumerate(p) if x <= 0.1 * (k + 1) / len(p)), default=0)
        assert sum(s >= least for s in steps) == accepted if least is not None else accepted == 0


def test_secret_spans_of_whole_table(spark):
    r = random.Random(5)
    words = ["einheit", "lichkeit", "verstehen", "zwischen", "gebracht", "ouvrier", "travaux", "document", "the", "of"]
    prose = [(k, " ".join(r.choice(words) for _ in range(60)) + (" " + "".join(r.choice(words) for _ in range(4)) if k % 5 == 0 else "")) for k in range(20, 200)]
    rows = ODD + prose + [(900, f"voilà é {SECRET}. fin"), (901, f"voilà é {SECRET}. fin"), (902, "sequence ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 and 1234567890123456789012"), (903, "mot " * 30_000 + SECRET), (904, f"token={SECRET}")]
    found = {}
    for row in secrets.digest(secrets.secret_spans(table(spark, rows))).collect():
        found.setdefault(row["doc_id"], []).append(row)
    assert found[900][0]["spans"] == f"random:8:{8 + len(SECRET)}" == found[901][0]["spans"]
    assert found[903][0]["spans"] == f"random:120000:{120000 + len(SECRET)}"
    assert found[904][0]["spans"] == f"assign:0:{6 + len(SECRET)}" and found[904][0]["n_assign"] == 1
    assert found[904][0]["base_sha256"] == hashlib.sha256(found[904][0]["spans"].encode()).hexdigest()
    assert not [r for k, own in found.items() if k not in (900, 901, 903, 904) for r in own if r["spans"]]
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found[900]) and len(found[1]) == 2
    assert secrets.digest(secrets.secret_spans(table(spark, []))).count() == 0


# 13
TERM, LOW = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(docs, least, top):
    df, occ = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall((text or "").translate(LOW))
        df[lang or ""].update(set(terms))
        occ[lang or "", source or ""].update(terms)
    out = set()
    for lang in {g[0] for g in occ}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for own, s in occ if own == lang]
        whole = sum((occ[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(occ[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if occ[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, o, -v, k + 1) for part, rows in (("pair", pair), ("term", term)) for k, (v, _, o) in enumerate(rows)}
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_audit_matches_plain(spark, blocks, monkeypatch):
    if blocks:  # many blocks of few terms, and a filter that lets much through
        monkeypatch.setattr(divergence, "CELLS", 4)
        monkeypatch.setattr(divergence, "MOST_BITS", 64)
        monkeypatch.setattr(divergence, "FLUSH_BYTES", 300)
    r = random.Random(7)
    words = ["Mot", "mot", "mot,", "d'eau", "été", "Été", "x_y", "a1b", "…fin", "ÉTÉ", "zut", "rare", "...", "12", "中文。", "b\x00c"]
    docs = [(r.choice(["fr", "en", None]), r.choice(["s1", "s2", "s3", None, ""]), r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(0, 12)))])) for _ in range(300)]
    docs += [("de", "leer", None), ("de", "voll", "eins zwei"), ("xx", "allein", "mot " * 40)]
    given = spark.createDataFrame([(1, t, lang, s, 0, "r", "s", "c", 1) for lang, s, t in docs], KIND)
    for least, top in ((8, 3), (25, 50)):
        got = divergence.audit(given, least, top)
        assert {tuple(x) for x in got.collect()} == plain_audit(docs, least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(table(spark, [])).count() == 0


def test_chunks_are_split_as_bytes_are():
    texts = ["  a b\x0bc\x1cd \x85 e\t\n", "", " ", "x\x00y  z\r\x0c", "\xa0k\u2003l a a"]
    chunks, row, code = divergence.split(divergence.pa.chunked_array([texts]))
    words = chunks.to_pylist()
    assert [[words[c].encode() for r, c in zip(row, code, strict=True) if r == k] for k in range(len(texts))] == [x.encode().split() for x in texts]


def test_a_task_sums_a_chunk_over_its_sources(spark):
    rows = [(1, "mot eau mot", "fr", s, 0, "r", "s", "c", 1) for s in ("s1", "s2", "s2", "s3")] + [(1, " mot ", "en", "s1", 0, "r", "s", "c", 1)]
    given = spark.createDataFrame(rows, KIND).coalesce(1)
    sent = divergence.bloom_filter(spark.createDataFrame([("fr", "mot"), ("en", "mot")], "lang string, chunk string"))
    got = {(r["lang"], r["chunk"]): {(h["source"], h["n"]) for h in r["held"]} for r in divergence.chunk_occurrences(given, sent).collect()}
    assert got == {("fr", "mot"): {("s1", 2), ("s2", 4), ("s3", 2)}, ("en", "mot"): {("s1", 1)}}
    assert {tuple(r) for r in divergence.chunk_documents(given).collect()} == {("fr", "mot", 4), ("fr", "eau", 4), ("en", "mot", 1)}


def test_filter_marks_a_chunk_alike_wherever_it_stands():
    words = ["", "mot", "été", "x\x00", "x", "mot" * 500, "\x00"]
    one = divergence.pa.array(words)
    alone = [[int(p[0]) for p in divergence.places("fr", divergence.pa.array([w]), 1 << 26)] for w in words]
    assert [[int(p[k]) for p in divergence.places("fr", one, 1 << 26)] for k in range(len(words))] == alone
    assert [[int(p[k]) for p in divergence.places("fr", one.slice(2), 1 << 26)] for k in range(5)] == alone[2:]
    assert len({tuple(x) for x in alone}) == len(words)
    many = divergence.places("fr", divergence.pa.array([f"w{i}" for i in range(100_000)]), 1 << 26)
    assert all(len(set(p.tolist())) > 99_700 for p in many) and [len(p) for p in divergence.places("fr", one[:0], 1 << 10)] == [0, 0, 0]
