"""Token counts and id files against the tokenizers library; shards and mixture."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dosewise.llm import id_files, mixing, token_counts
from dosewise.llm.id_files import pack, read_ids, unpack, write_ids
from dosewise.llm.mixing import mixture
from dosewise.llm.sharding import write_shards
from dosewise.session import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
HAND = [
    "", "'", "it's", "'re", "'rex", "''s", " 's", "!'s", "x  y", "x \n y", "\n\n", "a\n", "  ", "I'll we've 'l 'v 'lla", "<|endoftext|>",
    "a <|endoftext|> b", "日本語 テキスト　x", "naïve é́", "\x1c\x1da b", "1234567 89", "don't'd'm", "😀😀 😀", " " * 50 + "x", "ab" * 500, "'r\n", "r'e",
]
SCHEMA = "doc_id long, text string, source string, n_bytes string, ids string, bucket string, shard string, copies string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, *["x"] * 5) for i, t, s in rows], SCHEMA)


def size(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abrevlstdm '\n\t!.0129éß日 😀<|>"), max_size=60))
def test_transducer_counts_like_the_library(text):
    assert token_counts.transducer(PATH).count(text) == size(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abrevls '\n !.09é"), max_size=120), st.integers(1, 12))
def test_chunk_maps_compose_to_the_whole(text, chunk):
    machine = token_counts.transducer(PATH)
    maps = [machine.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
    for upto, prefix in zip(range(chunk, len(text) + chunk, chunk), token_counts.prefix_scan(maps, machine.compose), strict=True):
        assert machine.run(0, prefix.head)[1] + prefix.count == size(text[:upto])


def test_prefix_scan_is_every_prefix():
    for n in range(20):
        assert token_counts.prefix_scan([str(i) for i in range(n)], lambda a, b: a + b) == ["".join(map(str, range(i + 1))) for i in range(n)]


def test_token_counts(spark):
    long = "x" * 40_000 + " y" * 30_000
    rows = [*enumerate(HAND), (100, long), (100, long), (101, None), (None, "a b")]
    got = token_counts.token_counts(table(spark, [(i, t, "s") for i, t in rows]), PATH).collect()
    want = Counter((i, len((t or "").encode()), size(t or "")) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(table(spark, []), PATH).count() == 0


def test_pack_and_unpack():
    rng = np.random.default_rng(0)
    docs = [(rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32) for n in (0, 1, 3, 4, 5, 1000)]
    coded = [pack(x) for x in docs]
    streams = [np.frombuffer(b"".join(c[i] for c in coded), np.uint8) for i in (0, 1)]
    assert (unpack(*streams, np.array([len(x) for x in docs])) == np.concatenate(docs)).all()


@pytest.mark.parametrize("kept", [300_000, 5])
def test_id_files_round_trip(spark, kept):
    encoder = id_files.PieceEncoder(PATH)
    id_files.KEPT_PIECES, old = kept, id_files.KEPT_PIECES
    try:
        for _ in range(2):
            for text, ids in zip(HAND, encoder.encode(HAND), strict=True):
                assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    finally:
        id_files.KEPT_PIECES = old
    rows = [*((50 - i, t) for i, t in enumerate(HAND)), (60, "word " * 20_000), (61, None), (61, None)]
    path = scratch_dir(spark)
    write_ids(table(spark, [(i, t, "s") for i, t in rows]).repartition(3), PATH, path)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    start = 0
    for r, (_, text) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_ids"]) == (start, len(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_id_files_of_an_empty_table(spark):
    path = scratch_dir(spark)
    write_ids(table(spark, []), PATH, path)
    assert read_ids(spark, path).count() == 0


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "t" * rng.randrange(300), "s") for i in range(1000)] + [(None, None, "s"), (7, "same", "s"), (7, "same", "s"), (2000, "y" * 200_000, "s")]
    paths = [scratch_dir(spark) for _ in range(2)]
    for p in paths:
        write_shards(table(spark, rows).repartition(5), p, bucket_bytes=20_000)
    first, second = ([(r["shard"], r["slot"], r["doc_id"], r["text"]) for r in spark.read.parquet(p).collect()] for p in paths)
    assert Counter((i, t) for *_, i, t in first) == Counter((i, t) for i, t, _ in rows) == Counter((i, t) for *_, i, t in second)
    by = Counter(s for s, *_ in first)
    assert set(by) == set(range(24)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(x for s, x, *_ in first if s == k) == list(range(n)) for k, n in by.items())
    ids = [i for _, _, i, _ in sorted(first, key=lambda x: x[:2]) if i is not None and i < 1000]
    rises = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.42 < rises < 0.58  # a random order rises half of the time


def test_shards_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, "t" * rng.randrange(300), "s") for i in range(400)] + [(None, None, "s")] * 30 + [(7, "same", "s")] * 9000
    got = []
    for parts, shuffles in ((3, "8"), (17, "31")):
        path = scratch_dir(spark)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            write_shards(table(spark, rows).repartition(parts), path, bucket_bytes=10_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        got.append({(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()})
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert Counter(got[0].values()) == Counter((i, t) for i, t, _ in rows)
    hot = Counter(shard for (shard, _), (i, t) in got[0].items() if (i, t) == (7, "same"))
    assert len(hot) == 24 and max(hot.values()) <= -(-len(rows) // 24)  # repeated rows are spread


def test_shards_of_an_empty_table(spark):
    write_shards(table(spark, []), scratch_dir(spark))


@pytest.mark.parametrize(("target", "block"), [(0.95, 300), (0.5, 1 << 20), (1.0, 1000)])
def test_mixture(spark, target, block):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["big"] * 8 + ["mid"] * 3 + ["low"])) for i in range(600)] + [(900, None, "empty"), (901, "", "big")]
    a, want = brute.mixture([(i, s, t) for i, t, s in rows], target, block)
    got = mixture(table(spark, rows), target, block_tokens=block).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want and len(got) == len(rows)
    read = sum(r["copies"] * r["n_tokens"] for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert abs(read - total) <= 60 * 4


def test_mixture_repetition_limit(spark):
    sources = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "source string, tokens long")
    a = mixing.exponent(sources, None, 2.0, 10_000, 10_000)
    most = lambda a: max(n ** a / sum(m**a for m in (9000, 900, 100)) * 10_000 / n for n in (9000, 900, 100))
    assert most(a) <= 2.001 and most(a - 0.001) > 2.0


def test_mixture_nulls_repeats_and_empty(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c d e", "s"), (2, None, "s"), (1, "other", "s")]
    got = mixture(table(spark, rows)).collect()
    assert len(got) == 5 and len({(r["doc_id"], r["text_key"], r["copies"]) for r in got}) == 4
    assert mixture(table(spark, [])).count() == 0


def test_crc_of_ids_is_that_of_little_endian_words():
    assert zlib.crc32(np.array([1, 70_000], "<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 112, 17, 1, 0]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abrevls \n\u3000'!.09éß日<|endoftext|>"), max_size=30), max_size=12))
def test_pieces_encoded_together_have_their_own_ids(texts):
    encoder = id_files.PieceEncoder(PATH)
    texts = [*texts, *HAND]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_a_piece_is_looked_up_once_a_portion(monkeypatch):
    """Distinct pieces of all texts of a portion are looked up, not each occurrence."""
    asked = []
    find = id_files.Kept.find
    monkeypatch.setattr(id_files.Kept, "find", lambda self, names: asked.append(len(names)) or find(self, names))
    texts = ["the same words again", "the same words  again", "the same words again"] * 50
    got = id_files.PieceEncoder(PATH).encode(texts)
    assert sum(asked) <= 20
    assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_are_packed_together_as_alone():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 18, n, dtype=np.uint32) for n in (0, 5, 1, 0, 4, 300)]
    control, data = id_files.pack_rows(np.concatenate(docs), np.array([len(x) for x in docs]))
    assert list(zip(control.to_pylist(), data.to_pylist(), strict=True)) == [pack(x) for x in docs]
