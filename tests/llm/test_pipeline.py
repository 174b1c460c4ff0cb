"""The pipeline against stage-by-stage brute force on a small folder of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tamarack.llm import op04_quality_rules as rules
from tamarack.llm import op10_quality_classifier as classifier

from .test_near_text import brute_kept
from .test_operators import check_packing, labelled, prose, table

pytest.importorskip("public_tokenizers")


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, labels = labelled(spark, 200)
    base = prose(7, 300)
    more = [(1000 + k, base if k < 3 else base + f" last{k}.") for k in range(6)] + [(2000, prose(9, 90) + " Call +1 (743) 555-3824."), (2001, None), (2002, "")]
    docs = docs.union(table(spark, more)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")

    model = classifier.fit(docs, labels)
    kept = [r for r in docs.collect() if classifier.score_texts(model, [r.text or ""])[0] >= 0.3]
    left = spark.createDataFrame(kept, docs.schema)
    forest, cut = rules.fit(rules.counted(left), labels)
    counts = np.array([rules.rule_statistics(r.text or "") for r in kept])
    score = rules.anomaly(forest, rules.forest_features(counts))
    kept = [r for r, c, s in zip(kept, counts, score, strict=True) if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and s <= cut]
    stay = set(brute_kept([(r.doc_id, r.text) for r in kept]))  # all pairs by the Jaccard similarity of five-word shingles
    kept = sorted((r for r in kept if r.doc_id in stay), key=lambda r: r.doc_id)
    assert {r.doc_id for r in kept} >= {1000, 2000} and not {r.doc_id for r in kept} & {1001, 1002, 2001, 2002}

    last = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = stage(spark, last, folder)
        assert last.columns == docs.columns
    texts = {r.doc_id: r.text for r in last.collect()}
    assert sorted(texts) == [r.doc_id for r in kept]
    assert all(texts[r.doc_id] == r.text for r in kept if r.doc_id != 2000) and "743" not in texts[2000] and texts[2000].startswith(prose(9, 90))
    check_packing(corpus_pipeline.run(spark, folder).collect(), [(i, texts[i]) for i in sorted(texts)])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Long and empty texts, nulls, repeated rows, and columns with the names that stages use themselves."""
    docs, labels = labelled(spark, 120)
    long = " ".join(prose(300 + k, 200) for k in range(150))
    more = table(spark, [(5000, long), (5000, long), (5001, None), (None, prose(477, 120)), (5002, ""), (5003, prose(478, 120) + " Mail x.y@z.org now.")])
    names = ["key", "row", "root", "sid", "band", "n", "n_entities", "__key", "__0", "quality", "length", "bucket"]
    docs = docs.union(more).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(n).alias(n) for n in names])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == names, name
        assert docs.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0, name
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows[5000].text == long and docs.where("doc_id = 5000").count() == 1 and not {5001, 5002} & set(rows)
    assert None in rows and "x.y@z.org" not in rows[5003].text and rows[5003].n_chars == len(rows[5003].text)
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(rows) and sum(r.length for r in packed if r.doc_id == 5000) > 30_000


def test_registration():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_url_filter_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    found = entry.queries()["op3_url_filter"](spark, folder).collect()
    wanted = con.execute(entry.oracle_sql()["op3_url_filter"]).fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_packing_remembers_less_in_the_pipeline(monkeypatch):
    import public_tokenizers

    import corpus_pipeline
    from tamarack.llm import op05_packing

    monkeypatch.setattr(op05_packing, "_READY", {})
    encode = op05_packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{i} b{i * i} c{i % 7}" for i in range(2000)]
    before = encode(texts)
    assert encode.rest.size > 100_000
    encode = op05_packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), 50_000)
    assert [encode(texts[k : k + 100]) for k in range(0, 2000, 100)] == [before[k : k + 100] for k in range(0, 2000, 100)]
    assert encode.rest.size <= 50_000 and corpus_pipeline.PACKING_MEMORY < op05_packing.MEMORY
