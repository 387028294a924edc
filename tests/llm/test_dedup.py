"""Jaccard join, substring removal, decontamination and components against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from dosewise.llm import shingle_join
from dosewise.llm.components import connected_components
from dosewise.llm.decontaminate import contamination
from dosewise.llm.shingle_join import jaccard_components
from dosewise.llm.substring_dedup import remove_repeats

#: Columns with names that the operators use inside.
EXTRA = ["token", "cid", "label", "rest", "found", "hits", "print", "edge", "n", "pos"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{x} string" for x in EXTRA)


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)


def made(seed, n=150):
    """Documents of few words with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("aa bb Cc dd éé ff gg! hh ii jj kk ll mm nn oo pp".split()) + str(rng.randrange(60))
    passages = [[word() for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    docs = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 and docs:
            w = docs[rng.choice(list(docs))].split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randrange(1, 90))]
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w))
                w[at:at] = rng.choice(passages)
        docs[i * 3 + 1] = " ".join(w)
    odd = {1000: None, 1001: "", 1002: " \t\n ", 1003: "one", 1004: "One", 1005: "a b c d", 1006: "A\tB\nc  d", 1007: "x " * 400}
    odd |= {1008: "x " * 399, 1009: "é" * 5000, 1010: " ".join(f"w{i}" for i in range(30_000))}
    odd |= {1011: " ".join(f"w{i}" for i in range(29_000)), 1012: " ".join(passages[0]), 1013: " ".join(passages[0]).upper()}
    return docs | odd


@pytest.mark.parametrize("rare", [64, 1])
def test_jaccard_components(spark, monkeypatch, rare):
    monkeypatch.setattr(shingle_join, "RARE", rare)  # entries are made in the driver's module under test only if local
    docs = made(rare)
    got = jaccard_components(table(spark, docs.items())).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(docs)
    assert len(got) == len(docs)


def test_entries_of_frequent_shingles_meet():
    """Every similar pair shares an entry, when all shingles count as frequent, too."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for rare in (0, 5, 10**9):
        for _ in range(30):
            n = int(rng.integers(4, 400))
            base = np.unique(rng.integers(0, 1 << 62, n))
            other = np.concatenate([base[: max(1, int(len(base) * rng.uniform(0.8, 1)))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 1)))])
            other = np.unique(other)
            both = len(np.intersect1d(base, other))
            if 4 * both < 3 * len(np.union1d(base, other)):
                continue
            df = {int(t): int(rng.integers(2, 20)) for t in np.union1d(base, other)}
            old, shingle_join.RARE = shingle_join.RARE, rare
            try:
                ranked = [sorted((df[int(t)], int(t)) for t in s) for s in (base, other)]
                batch = pa.RecordBatch.from_pydict(
                    {"cid": [1, 2], "n": [len(base), len(other)], "dfs": [[d for d, _ in r] for r in ranked], "tokens": [[t for _, t in r] for r in ranked]}
                )
                got = pa.Table.from_batches(list(shingle_join._entries([batch]))).to_pydict()
            finally:
                shingle_join.RARE = old
            by = [{e for e, c in zip(got["entry"], got["cid"], strict=True) if c == x} for x in (1, 2)]
            assert by[0] & by[1]


def test_jaccard_repeated_rows_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, long), (7, long + " more"), (7, "quite another text of some words here"), (None, long), (9, None), (9, None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows)).collect())
    assert got == [(-1, 36, None), (5, 36, 5), (5, 36, 5), (7, 3, 7), (7, 37, 5), (9, 0, 9), (9, 0, 9)]


def test_substring_removal(spark):
    docs = made(3)
    got = {r["doc_id"]: (r["n_words"], (r["kept_text"] or "").split(" ") if r["kept_text"] else [], r["n_removed"]) for r in remove_repeats(table(spark, docs.items())).collect()}
    want = brute.repeats(docs)
    assert {i: (n, kept) for i, (n, kept, _) in got.items()} == want
    assert all(r == n - len(kept) for n, kept, r in got.values())


def test_substring_paths_point_to_equal_words(spark):
    docs = made(4)
    for r in remove_repeats(table(spark, docs.items())).where("paths is not null").collect():
        for p in r["paths"]:
            n = p["edges"] + 12
            own, source = brute.spaced(docs[r["doc_id"]]), brute.spaced(docs[p["source_doc"]])
            assert own[p["start"] : p["start"] + n] == source[p["source_start"] : p["source_start"] + n]


def test_substring_repeated_rows_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (2, long), (2, long), (3, long), (4, None), (5, "short")]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(table(spark, rows)).collect() if r["doc_id"] != 4)
    assert got == [(-1, 20, 0, long), (2, 20, 0, long), (2, 20, 0, long), (3, 20, 20, ""), (5, 1, 0, "short")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, item_words string")


def test_contamination(spark):
    docs = made(5)
    words = lambda i, a, b: " ".join(brute.alnum(docs[i])[a:b])
    bench = [(1, words(1010, 100, 140)), (2, words(1010, 130, 139)), (3, words(4, 0, 11)), (10, "w5, w6! W7"), (12, "one"), (13, None), (14, " - "), (15, "nowhere")]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in contamination(table(spark, docs.items()), items(spark, bench)).collect()}
    assert got == brute.contamination(docs, bench)


def test_contamination_by_a_very_long_item(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(30_000)}" for _ in range(100_000)]
    docs = [(1, " ".join(item)), (2, "a b " + " ".join(item[70_000:70_050]) + " c d"), (3, " ".join(item[::-1][:500])), (None, " ".join(item[500:509]))]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in contamination(table(spark, docs), items(spark, [(4, " ".join(item))])).collect()}
    assert got == {1: (100_000, 100_000, ["4"]), 2: (54, 50, ["4"]), 3: (500, 0, []), None: (9, 0, [])}


def test_contamination_repeated_rows_nulls_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (None, "clean"), (2, long), (2, "clean"), (3, None)]
    bench = items(spark, [(7, long), (7, long), (8, long), (None, "clean")])
    found = contamination(table(spark, rows), bench, carry=True)
    got = sorted((r["doc_id"] or -1, r["n_hit"], tuple(r["items"]), r["rest"]["rest"]) for r in found.collect())
    assert got == [(-1, 0, (), "x"), (-1, 20, ("7", "8"), "x"), (2, 0, (), "x"), (2, 20, ("7", "8"), "x"), (3, 0, (), "x")]
    assert contamination(table(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_empty_tables(spark):
    none = table(spark, [])
    assert jaccard_components(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert contamination(none, items(spark, [(1, "a")])).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    edges = spark.createDataFrame([*links, (None, 3), (9, 9)], "a long, b long")
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == brute.components(nodes, links)


@pytest.mark.parametrize("turns", [0, 1, 3])
def test_jaccard_of_groups_whose_members_do_not_all_link(spark, monkeypatch, turns):
    """Copies with up to eight changed words share most entries but link only in part."""
    monkeypatch.setattr(shingle_join, "HUB_TURNS", turns)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    docs = {}
    for i in range(240):
        w = list(base[i % 4])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(df).collect()}
    want = {k: tuple(v) for k, v in brute.jaccard(docs).items()}
    assert got == want and 10 < len({c for _, c in want.values()}) < 235
