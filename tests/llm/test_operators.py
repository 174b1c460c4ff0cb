"""The corpus operators on small tables: odd rows, and brute-force versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import common
from tamarack.llm import op01_html as html
from tamarack.llm import op02_media as media
from tamarack.llm import op03_url_filter as urls
from tamarack.llm import op04_quality_rules as rules
from tamarack.llm import op05_packing as packing
from tamarack.llm import op06_bpe as bpe
from tamarack.llm import op07_pii as pii
from tamarack.llm import op08_token_counts as counts
from tamarack.llm import op09_simhash as simhash
from tamarack.llm import op10_quality_classifier as classifier
from tamarack.llm.graph import components
from tamarack.llm.html_labels import labelled_page
from tamarack.llm.html_tree import Page

P = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, rank string, fp string"
LONG = "mot " * 3000 + "\n" + "x" * 4000
ODD = [(1, "One two three four five."), (1, "One two three four five."), (2, None), (3, ""), (None, "sans numéro 1.2.3.4"), (4, LONG), (5, "  \n\t "), (6, "ſeltsam ½ 中文 😀 ́ é"), (7, "a\x00b\x1c c")]


def table(spark, rows=None):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, None, "s", "k", "r", "f") for i, t in (ODD if rows is None else rows)], KIND)


def prose(seed, n=120, noise=0.0):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiourtsnl") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("$$$" if r.random() < noise else "") for w in words).capitalize() + "."


def labelled(spark, n=160):
    docs = [(k, prose(k, noise=0.8 if k % 4 == 0 else 0.0)) for k in range(n)]
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(n)] + [(0, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return table(spark, docs), labels


# 1
def test_html_learns_the_content(spark):
    model = html.train(spark, 400)
    right = total = 0
    for seed in range(900_000, 900_120):
        page = Page(labelled_page(seed))
        found = html.marginals(model, html.Batch([page])) > 0.5
        for node, text in page.texts:
            total += len(text)
            right += len(text) * (found[node] == bool(page.marks[node]))
    assert right / total > 0.97


def test_html_odd_pages(spark):
    page = "<html><head><title>T</title><script>var a='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/'>menu</a></ul></nav><article><h1>Title &amp; more</h1><p><b>First\n  part.<br><p>Second &lt;p&gt; part, as a sentence.</article><footer>&copy; x</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just text"), (None, "u", "<p>" * 3000), (5, "u", "<article><p>" + "mot " * 50000 + "</article>")]
    out = html.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"), html.train(spark, 400)).collect()
    assert len(out) == 7 and all(len(r.text) == r.n_chars for r in out)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == ["Title & more\nFirst part.\nSecond <p> part, as a sentence."] * 2
    assert by[2] == by[3] == [""] and by[5] == [("mot " * 50000).strip()]


def test_marginals_match_enumeration(spark):
    """Sum-product against the sum over all labellings of a small tree."""
    model = html.train(spark, 400)
    page = Page("<html><body><div class=content><p>Some words here.</p><ul><li>a</ul></div></body></html>")
    batch = html.Batch([page])
    own = html.potentials(model, batch)
    n, sums, total = len(own), np.zeros(len(own)), 0.0
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        weight = np.exp(sum(own[k][y[k]] for k in range(n)) + sum(model["edge"][batch.section[k]][y[batch.parent[k]]][y[k]] for k in range(1, n)))
        total += weight
        sums += weight * np.array(y)
    assert np.allclose(html.marginals(model, batch), sums / total)


# 2
def test_media_round_trip(spark):
    out = media.digest(media.read_media(media.store_media(table(spark)))).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in ODD:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        r = by[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert by[1][0] == by[1][1] and by[2][0].feature == by[3][0].feature
    assert media.payload_of(b"a" * 576) == b"a" * 576


def test_png_filters_and_checksums():
    image = np.random.default_rng(1).integers(0, 256, (7, 5), dtype=np.uint8)
    lines, above = [], np.zeros(5, np.int64)
    for y, row in enumerate(image.astype(np.int64)):
        kind = y % 5
        left, corner = np.concatenate(([0], row[:-1])), np.concatenate(([0], above[:-1]))
        p = left + above - corner
        paeth = [min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2] for q, a, b, c in zip(p, left, above, corner, strict=True)]
        guess = [np.zeros(5, np.int64), left, above, (left + above) // 2, np.array(paeth)][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    header = media._chunk(b"IHDR", (5).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0]))
    packed = zlib.compress(b"".join(lines))
    data = media.SIGNATURE + header + media._chunk(b"IDAT", packed[:9]) + media._chunk(b"IDAT", packed[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == image).all()
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(data[:-20] + bytes([data[-20] ^ 1]) + data[-19:])


def test_cosine_hash_is_perceptual():
    image = np.add.outer(np.arange(64) * 2, np.arange(576) % 97).astype(np.uint8)
    same = media.cosine_hash(np.clip(image.astype(int) + 1, 0, 255).astype(np.uint8))
    far = bin(int(media.cosine_hash(image), 16) ^ int(media.cosine_hash(image[::-1, ::-1].copy()), 16)).count("1")
    assert bin(int(media.cosine_hash(image), 16) ^ int(same, 16)).count("1") < far


# 3
def test_url_rules_match_brute_force(spark):
    given = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b", "")]
    cases = ["http://x.example.net/en/1", "https://EXAMPLE.net/fr?q=/en/", "http://net", "http://net/", "no url", None, "", "ftp://q.org/fr/x#y", "http://notexample.com/de/1", "http://example.com/de/", "x://a.b", "x://c.a.b?z", "http://x.net?a/en/", "http:///path", "a://b://c.net/x", "http://u.org/FR/"]
    out = urls.filter_urls(spark.createDataFrame([(k, u, "v") for k, u in enumerate(cases)], "page_id long, url string, verdict string"), given).collect()
    for r in sorted(out, key=lambda r: r.page_id):
        u = cases[r.page_id] or ""
        rest = u.partition("://")[2]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[2] if best else "allow")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), given).count() == 0
    assert {r.verdict for r in urls.filter_urls(spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string"), []).collect()} == {"allow"}


def test_rules_as_long_as_each_other(spark):
    rows = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    for given in ([("block", "x.net", ""), ("allow", "net", "/a")], [("allow", "net", "/a"), ("block", "x.net", "")]):
        assert [tuple(r) for r in urls.filter_urls(rows, given).select("rule", "verdict").collect()] == [("x.net", "block")]


def test_media_of_an_empty_table(spark):
    assert media.digest(media.read_media(media.store_media(table(spark, [])))).count() == 0


def test_colliding_digests_are_told_apart(tmp_path):
    import pyarrow as pa

    np.array([5, 5, 5], np.uint64).tofile(tmp_path / "k")
    strings = pa.table({"rule": ["a.b/", "c.d/", "e.f/"], "host_len": pa.array([3, 3, 3], pa.int32()), "verdict": ["block", "allow", "block"]})
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink, pa.ipc.new_file(sink, strings.schema) as writer:
        writer.write_table(strings)
    array = urls.DigestArray(str(tmp_path / "k"), str(tmp_path / "f"))
    real, urls.xxhash.xxh64_intdigest = urls.xxhash.xxh64_intdigest, lambda x: 5
    try:
        assert array.match(["c.d", "q.q"], ["/x", "/"]).tolist() == [1, -1]
    finally:
        urls.xxhash.xxh64_intdigest = real


# 4
def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)]


def test_rule_counts_match_brute_force():
    r = random.Random(5)
    pieces = ["a", "b", "c#", " ", "  ", "\n", "\t", "\x0b", "\u2003", "\xa0", "|", "é", "\r\n", "\x1c"]
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        assert rules.rule_statistics(text)[:5] == brute_counts(text), repr(text)


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    good = [k for k in out if k % 4]
    assert np.mean([out[k].kept for k in good]) >= 0.95 and np.mean([out[k].kept for k in out if k % 4 == 0]) <= 0.1
    kept = rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out.values())
    odd = rules.quality_rules(table(spark), labels).collect()
    assert len(odd) == len(ODD) and all(r.base_failed and not r.kept for r in odd if r.n_words == 0)
    assert rules.quality_rules(table(spark), labels.limit(0)).where("base_failed = kept").count() == 0
    assert rules.quality_rules(table(spark, []), labels).count() == 0


def test_path_lengths_match_a_plain_forest():
    rng = np.random.default_rng(3)
    points, probes = rng.normal(size=(300, 4)), rng.normal(size=(60, 4)) * 3
    forest = rules.grow_forest(points, trees=7, size=64)

    def depth(node, x, level):
        f = forest["feature"][node]
        if f < 0:
            return forest["path"][node]
        return depth(forest["child"][node] + (x[f] >= forest["value"][node]), x, level + 1)

    mean = np.array([np.mean([depth(root, x, 0) for root in forest["roots"]]) for x in probes])
    assert np.allclose(rules.anomaly(forest, probes), 2 ** (-mean / rules.expected_path(64)))
    # each leaf's path: its depth, and what the rows left in it would take
    rows_of = lambda root: sum(1 for _ in walk(root))

    def walk(node):
        if forest["feature"][node] < 0:
            yield node
        else:
            yield from walk(forest["child"][node])
            yield from walk(forest["child"][node] + 1)

    assert all(rows_of(root) > 1 for root in forest["roots"]) and (rules.anomaly(forest, np.full((1, 4), 50.0)) > rules.anomaly(forest, points).mean()).all()


def test_threshold_matches_brute_force():
    rng = np.random.default_rng(6)
    score, good = np.concatenate([rng.integers(1, 60, 400), rng.integers(40, 100, 100)]), np.repeat([True, False], [400, 100])
    step, n = np.unique(np.stack([score, good], axis=1), axis=0, return_counts=True)
    found = rules.calibrate(step[:, 0], step[:, 1].astype(bool), n, 0.9)
    each = {t: ((score[good] <= t).mean(), (score[~good] > t).mean()) for t in np.unique(score)}
    assert found == min((t for t in each if each[t][0] >= 0.9), key=lambda t: (-sum(each[t]), t)) / rules.GRID
    assert rules.calibrate(step[:0, 0], step[:0, 1].astype(bool), n[:0]) == 2.0


def test_one_outlier_does_not_set_the_threshold():
    step, good = np.array([*range(100, 209), 9000, *range(3000, 3027)]), np.repeat([True, False], [110, 27])
    assert rules.calibrate(step, good, np.ones(len(step), int)) == 208 / rules.GRID


def test_the_forest_agrees_with_a_plain_one(spark):
    rng = np.random.default_rng(8)
    points, probes = rng.normal(size=(256, 3)), np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 0.3 + 9])

    def plain_depth(rows, x, level, draw):
        low, high = rows.min(axis=0), rows.max(axis=0)
        if len(rows) < 2 or level == rules.HEIGHT or not (high > low).any():
            return level + rules.expected_path(len(rows))
        f = draw.choice(np.flatnonzero(high > low))
        more = rules.MARGIN * (high[f] - low[f])
        cut = draw.uniform(low[f] - more, high[f] + more)
        rest = rows[(rows[:, f] < cut) == (x[f] < cut)]
        return plain_depth(rest, x, level + 1, draw) if len(rest) else level + 1

    plain = np.array([2 ** (-np.mean([plain_depth(points, x, 0, np.random.default_rng(t)) for t in range(60)]) / rules.expected_path(256)) for x in probes])
    own = rules.anomaly(rules.grow_forest(points, size=256), probes)
    assert np.corrcoef(plain, own)[0, 1] > 0.95 and own[60:].min() > own[:60].max() and plain[60:].min() > plain[:60].max()


def test_urls_of_any_length(spark):
    import time

    array = urls.DigestArray(*_compiled(spark))
    long = [("a." * 500_000 + "example.com", "/de/" + "x" * 1_000_000), ("x" * 1_000_000 + ".net", "/"), ("." * 1_000_000 + "net", "/"), ("b" * 1_000_000, "/"), ("a.net." * 200_000 + "org", "/fr/")]
    began = time.perf_counter()
    found = array.match([h for h, _ in long], [p for _, p in long])
    assert time.perf_counter() - began < 1
    assert [array.rule[int(k)].as_py() if k >= 0 else None for k in found] == ["example.com/de/", "net/", "net/", None, "org/fr/"]
    pages = spark.createDataFrame([(k, f"https://{h}{p}?q=" + "y" * 100_000) for k, (h, p) in enumerate(long)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.filter_urls(pages, _RULES).collect()}
    assert got == {k: (h, p, r) for k, ((h, p), r) in enumerate(zip(long, ["example.com/de/", "net/", "net/", None, "org/fr/"], strict=True))}


_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _compiled(spark):
    from pyspark import SparkFiles

    name = urls.compile_rules(spark, _RULES)
    return SparkFiles.get(f"{name}.keys"), SparkFiles.get(f"{name}.arrow")


def test_a_repeated_id_counts_once(spark):
    docs, labels = labelled(spark, 200)
    again = docs.where("doc_id = 5").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy")
    names = rules.COUNTS + rules.EXTRA
    rows = rules.measured(docs.union(again), rules.labelled_ids(labels), lambda given: [rules.rule_statistics(x) for x in given], names, "long")
    assert rows.where("doc_id = 5").count() == 1
    one, two = classifier.fit(docs, labels), classifier.fit(docs.union(again), labels)
    assert np.allclose(one["weights"], two["weights"]) and np.allclose(one["rates"], two["rates"])


# 5
def check_packing(rows, docs, capacity=1024):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    wanted = []
    for i, t in docs:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        wanted += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(str, wanted))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own_places in places.values():
        end = 0
        for offset, length in sorted(own_places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(spark):
    docs = [*ODD, *[(100 + k, prose(k, 20 + 37 * k % 500)) for k in range(60)]]
    rows = packing.pack_documents(table(spark, docs), P.path("byte_bpe_50k.json")).collect()
    n = check_packing(rows, docs)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_of_a_table_under_binding_limits(spark):
    docs = [(k, prose(k, 5 + k % 40)) for k in range(150)] + [(1000, "the same")] * 50
    cut = common.checkpointed(packing.pieces(table(spark, docs), P.path("byte_bpe_50k.json")).withColumn("row", F.monotonically_increasing_id()))
    for rule in ("norm", "dot"):
        rows = packing.pack(cut, bucket_rows=7, most_documents=4, most_attention=60_000, rule=rule).collect()
        check_packing(rows, docs)
        own = {}
        for r in rows:
            own.setdefault(r.sequence_id, []).append(r.length)
        assert max(map(len, own.values())) == 4 and max(sum(n * n for n in x) for x in own.values()) <= 60_000 and any(sum(x) + 40 < 1024 for x in own.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(None, None), (3, None), (None, 300_000), (2, 500_000)])
def test_plan_respects_every_capacity(rule, limits):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 500, 400)
    counts_ = np.bincount(lengths, minlength=1025)
    rows = packing.plan(counts_, 1024, *limits, rule=rule)
    length = np.repeat(np.arange(1025), counts_)
    rank = np.concatenate([np.arange(c) for c in counts_])
    sequence, offset = packing.place(rows, length, rank)
    for s in np.unique(sequence):
        own = length[sequence == s]
        assert own.sum() <= 1024 and len(own) <= (limits[0] or 1024) and (own**2).sum() <= (limits[1] or 1024**2)
        order = np.argsort(offset[sequence == s])
        assert (np.cumsum(own[order]) - own[order] == offset[sequence == s][order]).all()


# 6
def test_bpe_matches_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    r = random.Random(9)
    pieces = ["a", "word", " ", "  ", "\n", "é", "'s", "1", "½", "中", "\u3000", "\x1c", "\x85", "!", "ing", "😀", "\t", " \n", "\r\n", "x" * 90, "<|endoftext|>"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(500)] + ["", " ", "a" * 3000, LONG]
    ids = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert ids == [other.encode_ordinary(t) for t in texts]
    out = bpe.decode_texts(bpe.encode_texts(table(spark), path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(x.decoded) for x in out) == sorted((t or "").encode() for _, t in ODD)


def test_bpe_trees_agree():
    own = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).vocabulary
    r = random.Random(3)
    words = [bytes(r.choice(b"abcdething \xc3\xa9\xff") for _ in range(r.randint(2, 64))) for _ in range(400)]
    assert own.encode_many(words) == [own.encode_one(w) for w in words]


# 7
def test_pii_surrogates(spark):
    text = "Mail a.b@x.org or A.B@x.org, call +1 (743) 555-3824 or +1-743-555-3824. Mr. John Smith met Mrs. Jane Smith; Mr Smith left. Card 4111 1111 1111 1111."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "clean text, version 2.0 on 2024-01-31"), (None, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (5, "\ufdd0 1.2.3.4 \ufdd3 \ufdd1\ufdd2"), (6, "Frau Анна"), (7, "IBAN DE89 3704 0044 0532 0130 00 ok")]
    docs = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    out = pii.replace_pii(docs, "a key").collect()
    assert len(out) == len(rows) and all(r.text is None or r.n_chars == len(r.text) for r in out)
    by = {r.doc_id: r.text for r in out}
    assert by[2] is None and by[3] == "" and by[4] == rows[4][1]
    new = by[1]
    for old in ("a.b@x.org", "A.B@x.org", "743", "3824", "John", "Jane", "Smith", "4111 1111 1111 1111"):
        assert old not in new
    import re

    mails, phones, names = re.findall(r"\S+@\S+?(?=[ ,])", new), re.findall(r"\+1[ (\-\d)]+\d", new), re.search(r"Mr\. (\w+) ([\w-]+) met Mrs\. (\w+) ([\w-]+); Mr ([\w-]+) left", new)
    assert mails[0] == mails[1] and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    assert names[2] == names[4] == names[5] and names[1] in pii.NAMES["latin", "first_m"] and names[3] in pii.NAMES["latin", "first_f"]
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(card)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', by[None]) and re.fullmatch("\ufdd0 [\\d.]+ \ufdd3 \ufdd1\ufdd2", by[5])
    iban = re.search(r"DE[\d ]+\d", by[7])[0].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert pii.replace_pii(table(spark, []), "a key").count() == 0


def test_pii_keeps_entities_apart(spark):
    kinds = {"phone": [f"+1743{k:07d}" for k in range(300)], "card": [f"4{k:015d}" for k in range(300)], "ipv4": [f"10.0.{k // 250}.{k % 250}" for k in range(300)], "email": [f"a{k}@x.org" for k in range(300)], "last": [f"Name{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], "ssn": [f"{k:09d}" for k in range(300)]}
    rows = spark.createDataFrame([(k, c) for k, cs in kinds.items() for c in cs], "kind string, canon string")
    out = pii.dictionary(rows, "a key").collect()
    assert len(out) == 1800
    for kind, canons in kinds.items():
        own = [r.surrogate for r in out if r.kind == kind]
        assert len(set(own)) == 300 and not set(own) & set(canons)


# 8
def test_token_counts_match_the_tokenizer(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    entries = [(model.id_to_piece(i), -1e12 if model.is_byte(i) else model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    other = Tokenizer(models.Unigram([("<unk>", -1e12), *entries], 0, byte_fallback=True))
    own = counts.Counter({p: s for p, s in entries if s > -1e12})
    own.unknown = -1e12 - 10  # the other's least score is that of the byte entries
    r = random.Random(2)
    pieces = ["a", " ", "  ", "the", "é", "ß", "1", "中", "😀", "\n", "ing", "tion", "\u2581", "q", "x" * 30]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(500)]
    assert own.count(texts) == [len(other.encode("\u2581" + t.replace(" ", "\u2581"), add_special_tokens=False).ids) for t in texts]
    out = counts.count_tokens(table(spark), P.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(ODD) and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}


def test_registered_counter_as_it_stands():
    """Against a unigram model of the same entries without bytes: its unknown pieces, which it joins, count as their bytes."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    other, own, r = Tokenizer(models.Unigram([("<unk>", 0.0), *entries], 0)), counts.counter(path), random.Random(4)
    pieces = ["a", " ", "  ", "the", "é", "中", "😀", "\U00012345", "\n", "ing", "tion", "q", "x" * 30, "\u3402", "ꙮ"]
    for text in ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(500)]:
        given = "\u2581" + text.replace(" ", "\u2581")
        found = other.encode(given, add_special_tokens=False)
        wanted = sum(len(given[a:b].encode()) if i == 0 else 1 for i, (a, b) in zip(found.ids, found.offsets, strict=True))
        assert own.count([text]) == [wanted], repr(text)


def test_memories_are_bounded_in_bytes():
    from tamarack.llm.segments import Memory

    memory, calls = Memory(20_000), []
    for turn in range(50):
        wanted = {f"{turn}-{k}" + "y" * (5 * k) for k in range(60)}
        memory.learn(wanted, lambda new: calls.append(len(new)) or [x.encode() for x in new])
        assert all(memory[x] == x.encode() for x in wanted) and memory.size <= 20_000
        assert memory.size == sum(memory._cost(k, v) for k, v in memory.items()) and all(len(k) <= Memory.LONGEST for k in memory)


def test_unique_long_stretches(spark):
    """A corpus whose stretches never repeat and are long is encoded whole."""
    r = random.Random(12)
    docs = [(k, "".join(r.choice("abcdefghij") for _ in range(20_000)) + " end") for k in range(12)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode_texts(bpe.encode_texts(table(spark, docs), path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((x.doc_id, bytes(x.decoded).decode()) for x in out) == docs


# 9
def brute_components(ids, fps, most=4):
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_simhash_matches_brute_force(spark):
    base = prose(1, 400)
    docs = [(k, prose(k, 60)) for k in range(20, 60)] + [(100 + k, base.replace(base.split()[k * 3], "changed", 1)) for k in range(40)] + [(1, base), (2, base), (300, None), (301, ""), (302, "a b"), (303, "A B")]
    out = {r.doc_id: r for r in simhash.near_duplicates(table(spark, docs)).collect()}
    ids = sorted(out)
    wanted = brute_components(ids, [int(out[i].fingerprint, 16) for i in ids])
    assert {i: r.component_id for i, r in out.items()} == wanted
    assert out[300].fingerprint == "0" * 16 and out[301].component_id == 300 and out[303].component_id == 302
    kept = simhash.keep_first(table(spark, [*docs, (1, base), (None, "x")]))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(wanted.values())) and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(table(spark)).count() == len(ODD) and simhash.near_duplicates(table(spark, [])).count() == 0


def test_fingerprint_matches_its_definition():
    import re

    import xxhash

    texts = [prose(k, 3 + k) for k in range(12)] + ["", "a", "A b C", "a b c d", " \n a\x0bb c d\te É ", "a b c d a b c d"]
    for text, fp in zip(texts, simhash.fingerprints([t.encode() for t in texts]).tolist(), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_no_pair_within_four_bits_is_missed():
    rng, r = np.random.default_rng(8), random.Random(8)
    a = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    for bits in range(5):
        b = np.array([int(x) ^ sum(1 << p for p in r.sample(range(64), bits)) for x in a.view(np.uint64).tolist()], dtype=np.uint64).view(np.int64)
        (ka, oa), (kb, ob) = simhash.keys(a), simhash.keys(b)
        shared = set(zip(oa.tolist(), ka.tolist(), strict=True)) & set(zip(ob.tolist(), kb.tolist(), strict=True))
        assert {o for o, _ in shared} == set(range(len(a)))


def test_buckets_give_spanning_links():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**62, 6)
    fp = np.unique(np.array([c ^ (1 << int(p)) ^ (1 << int(q)) for c in centre for p, q in rng.integers(0, 60, (40, 2))]))
    key = np.zeros(len(fp), np.int64)
    edges = simhash.bucket_edges(key, fp)
    assert len(edges) < 2 * len(fp)
    roots = dict(zip(fp.tolist(), brute_components(fp.tolist(), fp.tolist()).values(), strict=True))
    parent = {x: x for x in fp.tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges.tolist():
        parent[find(u)] = find(v)
    assert len({find(x) for x in parent}) == len(set(roots.values()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 100), (300, 200), (7, 7), (500, 400), (400, 500)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 10
def test_classifier(spark):
    docs, labels = labelled(spark, 400)
    out = classifier.classify(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and held
    assert np.mean([(r.predicted == 1) == (r.doc_id % 4 != 0) for r in held]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.classify(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)  # held-out labels are not learned
    odd = classifier.classify(table(spark), labels).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd if r.doc_id in (2, 3)}) == 1 and not any(r.held_out for r in odd if r.doc_id is None)
    assert {r.score for r in classifier.classify(table(spark), labels.limit(0)).collect()} == {1.0}
    assert classifier.keep_documents(docs, labels).columns == docs.columns and classifier.classify(table(spark, []), labels).count() == 0


def test_fit_matches_plain_least_squares(spark):
    docs, labels = labelled(spark, 200)
    model = classifier.fit(docs, labels)
    rows = [(r.text, int(r.doc_id % 4 != 0)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id != 3]
    rows += [(r.text, 1) for r in docs.where("doc_id = 3").collect() if zlib.crc32(b"3") % 5]
    points, y = classifier.statistics([t for t, _ in rows]), np.array([q for _, q in rows], float)
    assert np.allclose(model["mean"], points.mean(axis=0)) and np.allclose(model["scale"], np.maximum(points.std(axis=0), 1e-6))
    z = classifier.fourier(points, points.mean(axis=0), np.maximum(points.std(axis=0), 1e-6))
    padding = np.sqrt(classifier.RIDGE * len(y) / classifier.DIMENSION) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z, padding]), np.concatenate([y, np.zeros(len(padding))]), rcond=None)[0]
    assert np.allclose(z @ model["weights"], z @ weights, atol=1e-6)


def test_isotonic_fit_matches_its_definition():
    rng = np.random.default_rng(2)
    score, label = np.sort(rng.normal(size=60)), rng.integers(0, 2, 60)
    centres, rates = classifier.pool_adjacent(score, label)
    fitted = np.array([max(min(label[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)])
    block = np.searchsorted(np.unique(fitted), fitted)
    assert np.allclose(rates, np.unique(fitted)) and np.allclose(centres, [score[block == b].mean() for b in range(block.max() + 1)])


def test_isotonic_fit_is_monotone():
    rng = np.random.default_rng(1)
    score = rng.normal(size=500)
    centres, rates = classifier.pool_adjacent(score, (score + rng.normal(size=500) > 0).astype(int))
    assert (np.diff(centres) > 0).all() and (np.diff(rates) > 0).all()


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 1000})
    parts = list(common.slices([batch], 64, 10_000))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 10
