"""Phrase mining against counting every phrase."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosewise.llm import phrases
from dosewise.llm.phrases import collocations, frequent_phrases

SCHEMA = "doc_id long, text string, lang string, word string, portion long, n long"


def brute(docs, least, longest, best, share):
    """docs: (text, lang) -> result rows."""
    total, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    kept = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    rows = []
    for (lang, x), a in kept.items():
        inside = any(
            a2 * 100 >= a * share and len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
            for (l2, y), a2 in kept.items() if l2 == lang
        )
        if not inside:
            cuts = [(1000 * a * total[lang] // (f[lang, x[:k]] * f[lang, x[k:]]), k) for k in range(1, len(x))]
            score, k = min(cuts)
            rows.append((lang, " ".join(x), a, f[lang, x[:k]], f[lang, x[k:]], total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:best])]
    return sorted(out)


def mined(df, *args):
    return sorted(tuple(r) for r in collocations(df, *args).collect())


def documents(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "new", "YORK", "city", "é", "É", "x", "in", "\x00a", "日本"]
    join = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b"]
    make = lambda: "".join(w for _ in range(rng.randrange(30)) for w in (rng.choice(words[: rng.choice((4, 12))]), rng.choice(join)))
    return [(i, make(), rng.choice(["en", "en", "en", None, "fr", ""]), "w", 1, 2) for i in range(n)]


@pytest.mark.parametrize("seed,least,share,room", [(1, 3, 100, 1 << 21), (2, 2, 60, 40), (3, 5, 100, 7)])
def test_against_counting(spark, monkeypatch, seed, least, share, room):
    """With one bucket of phrases and with many."""
    monkeypatch.setattr(phrases, "PER_BUCKET", room)
    docs = documents(seed) + [(None, None, "en", None, None, None), (1, "", None, "w", 1, 1), *documents(seed, 5)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert mined(df, least, 5, 40, share) == brute([(r[1], r[2]) for r in docs], least, 5, 40, share)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice(["a ", "b ", "c ", "d. ", "e, "]) for _ in range(20_000)) + "f " * 5_000
    relations = []
    part = next(iter(spark.createDataFrame([(long, "en")], "text string, lang string").toArrow().to_batches()))
    monkeypatch.setattr(phrases, "WORDS", 3000)
    monkeypatch.setattr(phrases, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda s: 2})())}))
    for batch in phrases._occurrences([part]):
        relations += [(r["portion"], r["relation"]) for r in batch.to_pylist() if r["relation"] is not None]
    assert len(relations) > 5 and len({p for p, _ in relations}) == len(relations) and all(p >> 32 == 2 for p, _ in relations)
    df = spark.createDataFrame([(long, "en")], "text string, lang string")
    assert mined(df, 100, 5, 2000, 100) == brute([(long, "en")], 100, 5, 2000, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.sets(st.integers(0, 3)))
def test_extend_merges_adjacent_occurrences(numbers, frequent):
    import numpy as np

    relation = np.array([phrases.BREAK if x == 4 else x for x in numbers], np.uint32)
    local = np.array(sorted(frequent), np.int64)
    longer, head, tail, n, bucket = phrases.extend(relation, local, local + 100, buckets=3)
    assert bucket.tolist() == sorted(bucket.tolist())
    pairs = [(a, b) if {a, b} <= frequent else None for a, b in zip(numbers, numbers[1:], strict=False)]
    want = Counter(p for p in pairs if p)
    assert {(h - 100, t - 100): c for h, t, c in zip(head.tolist(), tail.tolist(), n.tolist(), strict=True)} == want
    read = [None if x == phrases.BREAK else (head[x] - 100, tail[x] - 100) for x in longer.tolist()]
    runs = lambda s: [r for r in "".join("|" if p is None else chr(p[0] * 9 + p[1] + 200) for p in s).split("|") if r]
    assert runs(read) == runs(pairs)


def test_squeezed_arrays_expand_again():
    import numpy as np

    for kind in (np.uint32, np.int64):
        for values in ([], [0], [1, 2**31, 5], list(range(1000))):
            a = np.array(values, kind)
            assert phrases.expand(phrases.squeeze(a), kind).tolist() == values


def test_products_beyond_64_bits(spark):
    """Scores of counts near 1e12 are exact, ties after flooring go to the first cut."""
    rows = [(10**12 + 7, 3 * 10**12 + 1, [2 * 10**12 + 1, 10**12 + 9], [3 * 10**12 - 1, 10**12 + 11])]
    df = spark.createDataFrame(rows, "f long, total long, heads array<long>, tails array<long>")
    got = df.select(phrases._score().alias("c")).first()["c"]
    f, n, h, t = rows[0]
    want = min((1000 * f * n // (h[k - 1] * t[2 - k]), k) for k in (1, 2))
    assert (got["score"], got["k"]) == want


def test_empty_and_levels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).collect() == []
    totals, levels = frequent_phrases(spark.createDataFrame([(1, "a b a b", "x", "", 0, 0)], SCHEMA), 2, 3)
    assert [tuple(r) for r in totals.collect()] == [("x", 4)]
    assert [{(r["phrase"], r["f"]) for r in x.collect()} for x in levels] == [{("a", 2), ("b", 2)}, {("a b", 2)}, set()]


@pytest.mark.parametrize("buckets", [1, 5])
def test_frequent_words_go_back_to_their_portions_without_a_join(spark, buckets):
    rng = random.Random(4)
    rows = [(p, lang, w, i, rng.randrange(1, 9)) for p in range(6) for lang in ("a", "b") for i, w in enumerate(rng.sample("qrstuvwxyz", 5), 5 * (lang == "b"))]
    known = spark.createDataFrame(rows, "portion long, lang string, word string, local int, n long")
    total = Counter()
    for _, lang, w, _, n in rows:
        total[lang, w] += n
    often = {k: f for k, f in total.items() if f >= 12}
    counted = phrases._counted_words(known, 12, buckets)
    got = counted.collect()
    words = {r["id"]: (r["lang"], r["word"]) for r in got if r["id"] is not None}
    assert {words[r["id"]]: r["f"] for r in got if r["id"] is not None} == often and len(words) == len(often) > 0
    back = [
        (r["portion"], *words[i], x)
        for r in got if r["portion"] is not None
        for x, i in zip(phrases.expand(r["local"], "u4").tolist(), phrases.expand(r["ids"], "i8").tolist(), strict=True)
    ]
    assert sorted(back) == sorted((p, lang, w, i) for p, lang, w, i, _ in rows if (lang, w) in often)
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and len(rows) > len(back)


def test_occurrences_take_little_memory_beside_their_texts(monkeypatch):
    """No array as long as the text in 64-bit numbers is made."""
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = "some words, again. " * 200
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 1000, "text": [text] * 1000})
    list(phrases._occurrences([batch]))  # tables of the hashes are made once
    tracemalloc.start()
    try:
        rows = list(phrases._occurrences([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 1 and rows[0].num_rows == 4
    assert peak < 18 * len(text) * 1000
