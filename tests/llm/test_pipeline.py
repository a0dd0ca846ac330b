import numpy as np
from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_jaccard import brute as components

import corpus_pipeline
from quire.llm import stages
from quire.llm.jaccard import jaccard_components
from quire.llm.secrets import redact
from quire.llm.tokens import CachedTokenizer, tokenizer_path


def test_stages_keep_columns_and_clean_rows(spark, odd, none, write):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id bigint, text string")
    at = write(documents=odd, benchmark=items)
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == odd.columns
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert not {2, 3, 4, 6} & set(kept["language_id"]) and {1, 7, 8, None} <= set(kept["language_id"])
    assert kept["jaccard_join"].count(1) == 1 and 5 not in kept["jaccard_join"]
    assert 1 not in kept["decontamination"] and {7, 8, None} <= set(kept["decontamination"])
    text = next(r for r in docs.collect() if r.doc_id == 10)
    assert "hunter2hunter2" not in text.text and text.n_chars == len(text.text)
    assert kept["secret_scan"] == kept["decontamination"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).collect() == []


def test_texts_in_an_unlearned_script_go(spark, odd):
    more = [(20, "быстрая лиса", None, "a", 12), (21, "η γρήγορη αλεπού", None, "a", 16), (22, "素早い茶色の狐", None, "a", 7), (23, "быстрая fox", None, "a", 11), (24, "zzyzx", None, "a", 5)]
    docs = odd.filter("doc_id in (1, 5, 7, 8)").unionByName(spark.createDataFrame(more, odd.schema))
    kept = {r.doc_id for r in stages.keep_languages(spark, docs, "").collect()}
    assert {1, 5, 7, 8, 23, 24} == kept


def test_repeated_ids_keep_one(spark, odd):
    only = odd.filter("doc_id = 5")
    assert stages.keep_one_of_each_group(spark, only, "").count() == 1


def test_texts_of_one_id_are_documents_of_their_own(spark, odd):
    fox, wolf = odd.filter("doc_id = 1").first().text, "an entirely different text about the wolf and the seven little goats in their house"
    rows = [(5, fox, "en", "a", 1), (5, wolf, "en", "a", 1), (5, wolf, "en", "a", 1), (3, fox, "en", "a", 1), (9, wolf + " again", "en", "a", 1), (None, fox, None, None, None), (None, fox, None, None, None)]
    got = stages.keep_one_of_each_group(spark, spark.createDataFrame(rows, odd.schema), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, fox), (5, wolf), (None, fox), (None, fox)], key=str)


def test_columns_of_any_kind_and_name(spark, odd):
    wide = odd.withColumns({"col1": F.lit(1), "_1": F.lit("x"), "m": F.create_map(F.lit("a"), F.lit(1)), "a": F.array(F.lit(1)), "h": F.lit(2), "n": F.lit(3)})
    plain = stages.keep_one_of_each_group(spark, odd, "").collect()
    got = stages.keep_one_of_each_group(spark, wide, "")
    assert got.columns == wide.columns and sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in plain)
    one = wide.filter("doc_id in (1, 7, 12)")
    assert sorted(r.doc_id for r in stages.keep_one_of_each_group(spark, one, "").collect()) == [1, 7, 12]


def test_run_packs_every_kept_document(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = {r.component_id for r in jaccard_components(docs, 5, 8, 10).collect()}
    ids = {r.doc_id for r in rows}
    assert ids <= groups and len(ids) > 0.8 * len(groups)
    assert all(r.offset + r.length <= 2048 for r in rows)


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    docs = {i: docs[i] for i, _, c in components(sorted(docs.items()), 5, 8, 10) if c == i}
    gone = {x[0] for x in leaks(sorted(docs.items()), items)}
    tok = CachedTokenizer(tokenizer_path("word_bpe_49k.json"))
    want = {i: len(tok.encode_all([redact(t)])[0]) // 4 + 1 for i, t in docs.items() if i not in gone}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == want
    got = dict.fromkeys(want, 0)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and gone
    ends = np.array([r.offset + r.length for r in rows])
    assert ends.max() <= 2048
