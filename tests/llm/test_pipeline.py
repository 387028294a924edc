"""The pipeline against the stages again by brute force; queries against contracts."""

import zlib

import brute
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from dosewise.llm import language_id
from dosewise.llm.mixing import BLOCK_TOKENS, TARGET_ENTROPY

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = language_id.predict(docs, language_id.fit(docs), ("doc_id", "source", "text")).collect()
    rows = [r for r in judged if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE]
    parts = brute.jaccard({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if parts[r["doc_id"]][1] == r["doc_id"]]
    hits = brute.contamination({r["doc_id"]: r["text"] for r in rows}, bench)
    rows = [r for r in rows if not hits[r["doc_id"]][1]]
    _, copies = brute.mixture([(r["doc_id"], r["source"], r["text"]) for r in rows], TARGET_ENTROPY, BLOCK_TOKENS)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for _ in range(copies[r["doc_id"]]):
            ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == want


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [
        (1, "the of and " * 9, "en", "a", 5, "x"), (1, "the of and " * 9, "en", "a", 5, "x"), (2, None, None, None, None, None),
        (None, "other words that have letters", "en", None, 3, "y"), (3, "", "en", "a", 0, "x"), (4, "und der die das ein " * 5, "de", "b", 1, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        assert docs.count() >= 2, name
    assert {r["doc_id"] for r in docs.collect()} <= {1, None, 4}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0


def test_another_text_of_a_repeated_id_stays(spark):
    """Of two rows with one id only the one that links to an earlier document goes."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text), (7, text + " more"), (7, " ".join(f"other{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {rows[0], rows[2]}


def test_any_column_names_pass_through(spark):
    """Names with blanks, dots and back quotes, and those that stages use themselves."""
    text = "the of and a in " * 9
    rows = [(1, text, "en", "a", 5, "x", 1.5, "z"), (2, text + "or", "en", "a", 5, "y", 2.5, "w")]
    names = ["doc_id", "text", "lang", "source", "n_chars", "time", "my col", "a.b`c"]
    docs = spark.createDataFrame(rows, names)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == names, name
    assert {tuple(r)[5:] for r in docs.collect()} <= {("x", 1.5, "z"), ("y", 2.5, "w")} and docs.count() >= 1


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "some words", None, "a"), (2, "1234 !?", None, "a"), (3, None, None, "a"), (4, "日本", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]


def test_run_releases_what_it_staged(spark):
    from dosewise.session import staged_so_far

    before = staged_so_far()
    corpus_pipeline.run(spark, SF)
    assert staged_so_far() - before <= 6  # the last documents and what the id files are read from
