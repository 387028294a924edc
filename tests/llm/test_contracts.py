"""Registered queries that have no SQL, against their contracts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dosewise.llm.queries import CONTEXT, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, documents, library):
    got = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, d in documents.items():
        text = d["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), n, n > CONTEXT)


def test_language_id(spark, documents):
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    labels = {d["lang"] for d in documents.values() if d["lang"]}
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    right = []
    for r in rows:
        d = documents[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(map(str.isalpha, d["text"] or ""))
        assert (r["lang_pred"] in labels) if letters else (r["lang_pred"] == "und")
        if r["held_out"] and d["lang"] and letters:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.9


def test_id_files(spark, documents, library):
    got = sorted(tuple(r) for r in QUERIES["op6_id_files"](spark, SF).collect())
    want, start = [], 0
    for i in sorted(documents):
        ids = [*library.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_sharding(spark, documents):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        data = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    shards = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(24)}
    assert set(r["shard"] for r in rows) == set(range(24))
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
