"""Aligned tokenizers against walking over both token lists."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosewise.llm import alignment
from dosewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALIGNER = alignment.Aligner(A, B)
HAND = [
    "a", "", None, " ", "  ", " a", "a ", "a  b", "a \n b", "\r\n x", "it's;\r\nok", "x▁y", "日本語 テキスト　x", "<s> <0x41> </s> <|endoftext|> b",
    "\0 a", "naïve é́", "😀😀 😀", " " * 50 + "x", "ab" * 500, "  a  b", "a\x1c b", "aA" * 9 + "\x85   y",
]
SCHEMA = "doc_id long, text string, row string, pair string, n_a string, b string"


def walked(text):
    """Sizes, links and the text of the groups; None where the bytes differ."""
    if not text:
        return None
    whole = (" " + text).encode()
    ids = [ALIGNER.a.encode(" " + text, add_special_tokens=False).ids, ALIGNER.b.encode(text)]
    parts = [[of[i] for i in x] for of, x in zip((ALIGNER.bytes_a, ALIGNER.bytes_b), ids, strict=True)]
    if any(b"".join(p) != whole for p in parts):
        return None
    i = j = left_a = left_b = 0
    links, groups, own = [], [], ([], [])
    while i < len(ids[0]) or j < len(ids[1]):
        if not left_a:
            left_a = len(parts[0][i])
            own[0].append(str(ids[0][i]))
        if not left_b:
            left_b = len(parts[1][j])
            own[1].append(str(ids[1][j]))
        links.append((ids[0][i], ids[1][j]))
        step = min(left_a, left_b)
        left_a, left_b = left_a - step, left_b - step
        i, j = i + (not left_a), j + (not left_b)
        if not left_a and not left_b:
            groups.append("|".join(",".join(x) for x in own))
            own = ([], [])
    return len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)


def expected(texts):
    found = [walked(t) for t in texts]
    pairs = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(pairs[x] == best[x[1]] for x in f[3])
            rows.append((*f[:3], len(f[3]), n_best, sum(pairs[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return rows, pairs


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abtheéß日 \n\r;\t▁😀<0x>s"), max_size=40))
def test_one_text(text):
    sizes, digest, groups, profile = next(alignment.text_profiles(ALIGNER, [text]))
    want = walked(text)
    if want is None:
        assert digest is None and not sizes.any() and not len(profile.ids) and not len(profile.pairs)
        return
    assert (*sizes.tolist(), groups.decode()) == (*want[:3], len(want[3]), want[4])
    pairs = Counter({divmod(p, ALIGNER.width): n for p, n in zip(profile.pairs.tolist(), profile.pairs_n.tolist(), strict=True)})
    for a, n in zip(profile.ids.tolist(), profile.ids_n.tolist(), strict=True):
        pairs[a, int(ALIGNER.identity[a])] += n
    assert pairs == Counter(want[3])


def test_long_texts_by_slices(monkeypatch):
    texts = [*HAND, "some words  and\n more, " * 40, "x" * 300 + " y" * 300]
    whole = list(alignment.text_profiles(ALIGNER, texts))
    monkeypatch.setattr(alignment, "SLICE", 40)
    for a, b in zip(whole, alignment.text_profiles(ALIGNER, texts), strict=True):
        assert a[1:3] == b[1:3] and a[0].tolist() == b[0].tolist()
        assert all(getattr(a[3], f).tolist() == getattr(b[3], f).tolist() for f in ("ids", "ids_n", "pairs", "pairs_n"))


def test_pieces_are_forgotten_without_loss(monkeypatch):
    fresh = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "KEPT_PIECES", 20)
    texts = ["a few words here", "others there entirely", "a few words here " * 3]
    for _ in range(3):
        for t, p in zip(texts, fresh.profiles(texts), strict=True):
            assert ";".join(p.groups) == walked(t)[4]


@pytest.mark.parametrize("heavy", [1, 50, 1 << 20])
def test_corpus_counts(spark, heavy):
    """Counts do not depend on how many pairs are looked up in memory."""
    texts = [*HAND, *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()), "a b", "a b"]
    df = spark.createDataFrame([(i if i % 7 else None, t, "r", "p", "n", "b") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want, pairs = expected(texts)
    found = alignment.align(df, A, B, keep_groups=True, heavy=heavy)
    assert rows_of(found.documents) == sorted(((i if i % 7 else None, *r) for i, r in enumerate(want)), key=repr)
    assert {(r["a"], r["b"]): r["n"] for r in found.pairs.collect()} == pairs
    kept = [r["groups"] for r in found.documents.collect()]
    assert sorted(kept) == sorted((f[4] if f else "") for f in map(walked, texts))


def test_empty_table(spark):
    found = alignment.align(spark.createDataFrame([], SCHEMA), A, B)
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = expected([r["text"] for r in docs])
    df = QUERIES["op13_alignment"](spark, SF)
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "groups_sha256"} == {"bigint"}
    assert rows_of(df) == sorted(((d["doc_id"], *w) for d, w in zip(docs, want, strict=True)), key=repr)


def test_new_pieces_are_tokenised_together():
    """A takes new pieces joined to long texts, not each as a text of its own."""
    fresh = alignment.Aligner(A, B)
    library, asked = fresh.a, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    fresh.a = Counting()
    texts = [" ".join(f"word{i} e{i}n, x\ny{i}" for i in range(300)), *(t for t in HAND if t)]
    for t, p in zip(texts, fresh.profiles(texts), strict=True):
        assert (p is None) == (walked(t) is None)
        assert p is None or ";".join(p.groups) == walked(t)[4]
    assert sum(asked) < 60
