"""The near-duplicate stage against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tamarack.llm import near_text

from .test_operators import prose, table


def edited(text, places, seed):
    words, rng = text.split(), random.Random(seed)
    for k in rng.sample(range(len(words)), places):
        words[k] = f"edit{rng.random()}"
    return " ".join(words)


def brute_kept(rows):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(least.values())


def test_stage_finds_every_pair_of_similarity_08(spark):
    rows = [(k, prose(k, 150)) for k in range(20)]
    # scattered edits: up to 6 words change up to 30 of about 146 shingles, on both sides of 0.8
    rows += [(100 + 10 * k + e, edited(prose(k, 150), e, 10 * k + e)) for k in range(8) for e in range(1, 7)]
    rows += [(300 + k, edited(prose(50, 200), 4, k)) for k in range(40)]  # a bucket beyond SMALL, not all of them alike
    rows += [(400, ""), (401, None), (402, "one two"), (403, "ONE  two"), (404, prose(3, 150).upper())]
    out = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_blocks_find_links_between_components():
    rng = np.random.default_rng(0)
    base = np.arange(100)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(100, 8, False)), 1000 * k + np.arange(1000, 1004)])) for k in range(60)]
    root, outer = np.array([k % 7 for k in range(60)]), np.array([k % 7 > 0 for k in range(60)])
    wanted = {tuple(sorted((i, j))) for i in range(60) for j in range(i) if root[i] != root[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert wanted and {tuple(sorted(e)) for e in near_text.compare(sets, root, outer)} == wanted


def test_chains_in_large_buckets(spark, monkeypatch):
    """Texts that are linked step by step, their ends unlike each other; the same with blocks of a few sets."""
    words = prose(70, 260).split()
    rows = [(k, " ".join([*(f"new{i}" for i in range(6 * k)), *words[6 * k :]])) for k in range(12)]
    rows += [(100 + k, " ".join([*words[:200], *(f"own{k}x{i}" for i in range(8))])) for k in range(30)]
    for small, block in ((16, 512), (1, 4)):
        monkeypatch.setattr(near_text, "SMALL", small)
        monkeypatch.setattr(near_text, "BLOCK", block)
        out = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
        assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_no_text_is_lost_to_a_shared_id(spark):
    one, two = prose(80, 90), prose(81, 90)
    rows = [(1, one), (1, two), (1, two), (2, one), (3, one), (None, prose(82, 90)), (None, two), (None, None)]
    for found in (None, near_text.near_duplicates(table(spark, rows))):
        from tamarack.llm import op09_simhash

        out = op09_simhash.keep_first(table(spark, rows), found)
        assert out.columns == table(spark, rows).columns
        assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted([("1", one), ("1", two), ("None", prose(82, 90)), ("None", "")])


def test_bands_of_long_texts_do_not_depend_on_the_cut():
    grams = near_text.shingles(prose(9, 9000).encode())
    least = [min((int(g) * int(a) + int(b)) % 2**64 for g in grams[:50]) for a, b in zip(near_text._FACTOR[:4], near_text._SHIFT[:4], strict=True)]
    import xxhash

    assert near_text.bands(grams[:50])[0] == xxhash.xxh64_intdigest(np.array(least, np.uint64).tobytes(), 0) - 2**63
    assert len(set(near_text.bands(grams))) == near_text.BANDS and near_text.bands(grams[:0]) == []


def test_blocks_give_no_more_links_than_components(spark):
    n = 120
    grams = [np.unique(np.append(np.arange(100), 1000 + k)) for k in range(n)]  # all alike, none known to be connected
    sets = spark.createDataFrame([(k, len(g), g.tolist()) for k, g in enumerate(grams)], "sid long, n long, grams array<long>")
    left = spark.createDataFrame([(b, k, k if k < n - 2 else -1, k < n - 2, n, n - 2) for b in (1, 2) for k in range(n)], "band long, sid long, root long, outer boolean, members long, outers long")
    edges = [(r.u, r.v) for r in near_text._in_blocks(left, sets).collect()]
    assert len(edges) <= 2 * n  # one block a band; all pairs would be 7,139 each
    root = list(range(n - 1)) + [n - 2]  # the last two are known to be connected

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for u, v in edges:
        root[find(u)] = find(v)
    assert len({find(k) for k in range(n)}) == 1


def test_spanning_keeps_components():
    rng = np.random.default_rng(3)
    root = np.array([int(k) for k in rng.integers(0, 40, 80)])
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))]

    def parts(links):
        label = {r: r for r in root.tolist()}
        for i, j in links:
            a, b = label[int(root[i])], label[int(root[j])]
            label = {r: b if x == a else x for r, x in label.items()}
        return {frozenset(r for r in label if label[r] == x) for x in label.values()}

    kept = near_text.spanning(pairs, root)
    assert parts(kept) == parts(pairs) and len(kept) == len(set(root.tolist())) - len(parts(pairs)) and set(kept) <= set(pairs)
