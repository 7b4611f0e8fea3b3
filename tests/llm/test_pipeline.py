"""The corpus pipeline against brute force over its own stages."""

from __future__ import annotations

import zlib

import corpus_pipeline
from keyloft.llm import classifier, decontamination, quality_rules
from keyloft.llm.common import tokenizer_path, table
from tests.llm.test_operators import ODD, brute_components, brute_hits, docs_of


def test_stages_on_small_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = kept["quality classifier"]
    assert ids(after) == {r.doc_id for r in classifier.quality_scores(before, table(spark, sf_dir, "labels")).collect() if r.score >= 0.7}
    before, after = kept["quality rules"]
    assert ids(after) == {r.doc_id for r in quality_rules.quality_rules(before).collect() if r.kept}
    before, after = kept["near dedup"]
    roots = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == set(roots.values())
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert ids(after) == {d for d, _, hits, *_ in brute_hits([(r.doc_id, r.text) for r in before.collect()], items) if not hits}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    before, after = kept["packing"]
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    packed = after.toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_run_gives_the_last_stage(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_stages_on_odd_rows(spark, sf_dir):
    docs = docs_of(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    once = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8] and zlib.crc32(b"") == 0
    bad = docs_of(spark, [(None, "same words here", "en"), (1, "same words here", "en"), (2, "fine", "en")])
    items = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    keys = decontamination.contamination(bad, items).filter("n_hit > 0").select("text_key").distinct().count()
    assert keys == 1


def test_unrelated_texts_of_one_id_are_judged_each(spark, sf_dir):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(7, words("a")), (7, words("b")), (7, words("b") + " end"), (7, words("a")), (9, words("b") + " more"), (8, words("c")), (3, words("a") + " first"), (5, None), (5, " "), (6, ""), (None, words("a"))]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    kept = [(r.doc_id, (r.text or "").split(" ")[0]) for r in out.collect()]
    assert sorted(kept, key=str) == sorted([(3, "a0"), (7, "b0"), (8, "c0"), (5, ""), (6, ""), (None, "a0")], key=str)
    assert out.columns == docs.columns
