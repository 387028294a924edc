"""Language identification, vector links and pseudo-likelihood."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dosewise.llm import language_id, pseudo_likelihood, vector_dedup
from dosewise.llm.vector_dedup import vector_links

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sizes", [[5, 0, 3], [600, 1, 257, 256, 0, 513]])
def test_marginals_are_those_of_forward_backward(sizes):
    rng = np.random.default_rng(0)
    k, n = 3, sum(sizes)
    score, move = rng.normal(0, 2, (n, k)), rng.normal(0, 1, (k, k))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = language_id.marginals(score.astype(np.float32), first, move.astype(np.float32))
    for a, b in zip(first, first[1:], strict=False):
        forward, x = [], np.ones(k)
        for t in range(a, b):
            x = (x @ np.exp(move) if t > a else x) * np.exp(score[t])
            forward.append(x := x / x.sum())
        backward, y = [], np.ones(k)
        for t in range(b - 1, a - 1, -1):
            backward.append(y)
            y = np.exp(move) @ (np.exp(score[t]) * y)
            y /= y.sum()
        want = np.array(forward).reshape(-1, k) * np.array(backward[::-1]).reshape(-1, k)
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_marginals_of_many_labels_stay_small():
    rng = np.random.default_rng(1)
    k, sizes = 60, [20_000, 1, 300] + [40] * 200
    score, move = rng.normal(0, 2, (sum(sizes), k)).astype(np.float32), rng.normal(0, 1, (k, k)).astype(np.float32)
    tracemalloc.start()
    got = language_id.marginals(score, np.concatenate([[0], np.cumsum(sizes)]), move)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got.sum(axis=1), 1, atol=1e-4) and peak < 12 * score.nbytes  # a matrix a word would be 60 times that


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    judged = language_id.predict(docs, model, ("doc_id", "lang")).where(language_id.is_held_out())
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_words_of_mixed_text_are_labelled_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 5000")
    rows = docs.select(F.lower("text"), "lang").collect()
    model = language_id.train([r[0] for r in rows], [r[1] for r in rows])
    texts = [next(r[0] for r in rows if r[1] == x and len(r[0]) > 1000)[:400] for x in ("en", "de", "es")]
    w = language_id._joined([" ".join(texts)])
    ends = np.cumsum([0, *(len(language_id._joined([t]).hash) for t in texts)])
    p = language_id.marginals(language_id.scores(model, w), w.first, model.transitions)
    best = np.array(model.labels)[p.argmax(axis=1)]
    for a, b, x in zip(ends, ends[1:], ("en", "de", "es"), strict=False):
        assert (best[a + 2 : b - 2] == x).mean() > 0.9


def test_language_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "123 --- ..."), (4, "— “”"), (None, "the of and"), (5, "the of and"), (5, "the of and"), (6, "ÉTÉ " * 9000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    model = language_id.train(["the of and " * 40, "der die das été " * 40], ["en", "de"])
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and by[5][0] == by[None][0] == "en" and by[6][0] == "de"
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, cid string, m string")


@pytest.mark.parametrize("chunk", [1024, 16])
def test_vector_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    base = rng.standard_normal((60, 32))
    rows = [b for b in base] + [base[rng.integers(0, 10)] + rng.standard_normal(32) * 0.18 for _ in range(200)] + [base[3]] * 5 + [base[4] * 7]
    rows = [(i * 2, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None, *[1.0] * 31]), (9005, rows[3][1][:8]), (9006, [float("inf")] * 32)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_links(vectors(spark, rows + odd)).collect()}
    x = np.array([v for _, v in rows])
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    links = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(cosine >= 0.95), strict=True) if i != j]
    parts = brute.components([i for i, _ in rows], links)
    want = {i: (sum(a == i for a, _ in links), parts[i], parts[i] == i) for i, _ in rows} | {i: (0, i, True) for i, _ in odd}
    assert got == want


def test_vector_rows_without_id_repeats_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    got = vector_links(vectors(spark, [(None, v), (4, v), (4, v), (6, [-1.0, 0.0, 0.0])])).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (4, 1, 4), (4, 1, 4), (6, 0, 6)]
    assert vector_links(vectors(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = vector_dedup._unit(rng.standard_normal((400, 64)))
    turned = x @ vector_dedup.rotations(64, 1)
    factor = np.abs(turned).sum(axis=1) / 8
    estimate = (np.sign(turned) / (factor * 8)[:, None]) @ turned.T
    off = ~np.eye(400, dtype=bool)
    error = (estimate - x @ x.T)[off]
    assert abs(error.mean()) < 1e-3
    bound = vector_dedup.SIGMAS * np.sqrt((1 - factor**2) / factor**2 / 63)
    assert (np.abs(estimate - x @ x.T) <= bound[:, None])[off].mean() > 0.9999


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    weights = pseudo_likelihood.initial()
    ids, around = rng.integers(0, pseudo_likelihood.IDS, 50), rng.integers(0, pseudo_likelihood.IDS + 1, (50, 4))
    gradients = pseudo_likelihood.gradients(weights, ids, around)
    for name, g in gradients.items():
        at, moved = np.unravel_index(np.abs(g).argmax(), g.shape), []
        for step in (1e-3, -1e-3):
            other = {k: v.astype(np.float64) for k, v in weights.items()}
            other[name][at] += step
            moved.append(pseudo_likelihood.log_probabilities(other, ids, around).mean())
        assert (moved[0] - moved[1]) / 2e-3 == pytest.approx(g[at], rel=1e-2)


def test_probabilities_sum_to_one_and_contexts_leave_the_word_out():
    weights, n = pseudo_likelihood.initial(), pseudo_likelihood.IDS
    around = np.tile(np.array([[1, 2, 3, pseudo_likelihood.EDGE]]), (n, 1))
    assert np.exp(pseudo_likelihood.log_probabilities(weights, np.arange(n), around)).sum() == pytest.approx(1, rel=1e-5)
    edge = pseudo_likelihood.EDGE
    got = pseudo_likelihood.contexts(np.array([10, 11, 12, 20]), np.array([0, 3, 3, 4]))
    assert got.tolist() == [[edge, edge, 11, 12], [edge, 10, 12, edge], [10, 11, edge, edge], [edge] * 4]


def test_order_counts_in_pseudo_likelihood(spark):
    """Texts with a pattern score higher than the same words in random order."""
    rng = random.Random(4)
    word = [f"w{i}" for i in range(40)]
    patterned = [" ".join(word[(s + j) % 40] for j in range(60)) for s in (rng.randrange(40) for _ in range(1500))]
    mixed = [" ".join(rng.sample(p.split(), 60)) for p in patterned[:50]]
    rows = [(i, t) for i, t in enumerate(patterned + mixed)] + [(9000, None), (9001, " ")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot long").coalesce(1)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(docs).collect()}
    mean = lambda a, b: np.mean([got[i]["mean_log_likelihood"] for i in range(a, b)])
    assert mean(0, 1500) > mean(1500, 1550) + 0.5
    assert got[9000]["n_tokens"] == got[9001]["n_tokens"] == 0 and got[9000]["mean_log_likelihood"] is None
    assert got[3]["log_likelihood"] == pytest.approx(got[3]["mean_log_likelihood"] * 60)
    assert pseudo_likelihood.score(docs.limit(0)).count() == 0


def test_document_score_is_the_sum_over_its_words():
    weights = pseudo_likelihood.initial()
    id_of = np.arange(pseudo_likelihood.SLOTS) % pseudo_likelihood.IDS
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e", "c"]})
    got = pa.Table.from_batches(list(pseudo_likelihood._scored(id_of, weights)([batch]))).to_pydict()
    slots, first = pseudo_likelihood._slots(batch)
    each = pseudo_likelihood.log_probabilities(weights, id_of[slots], pseudo_likelihood.contexts(id_of[slots], first))
    assert got["log_likelihood"] == pytest.approx([each[:5].sum(), each[5]])


@pytest.mark.parametrize("known", [1 << 18, 1000])
def test_probabilities_of_all_words_sum_to_one(spark, monkeypatch, known):
    """Texts of one word have the same words around, so their scores are one distribution over the words."""
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", known)
    texts = [f"w{i}" for i in range(3000) for _ in range(1 + (i % 7 == 0) * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {texts[r["doc_id"]]: r["log_likelihood"] for r in pseudo_likelihood.score(docs).collect()}
    assert len(got) == 3000 and np.exp(list(got.values())).sum() == pytest.approx(1, rel=1e-4)
    names = pseudo_likelihood.vocabulary(pseudo_likelihood.word_counts(docs))
    assert len(names.hashes) == min(known, 3000) or known == 1000 and 950 < len(names.hashes) <= 1050


def test_ids_grow_with_the_corpus():
    assert pseudo_likelihood.side_of(10**6) == 32 < pseudo_likelihood.side_of(10**8) < pseudo_likelihood.side_of(10**10)


def test_a_word_takes_one_exponential_an_output(monkeypatch):
    """Training works each output out once, in pieces that do not grow with the step."""
    rng = np.random.default_rng(1)
    weights, n, side = pseudo_likelihood.initial(), 3000, pseudo_likelihood.SIDE
    ids, around = rng.integers(0, pseudo_likelihood.IDS, n) ** 2 // pseudo_likelihood.IDS, rng.integers(0, pseudo_likelihood.IDS + 1, (n, 4))
    whole, each = pseudo_likelihood.gradients(weights, ids, around), pseudo_likelihood.log_probabilities(weights, ids, around)
    sizes, real = [], np.exp
    with monkeypatch.context() as patch:
        patch.setattr(np, "exp", lambda x, *args, **kw: sizes.append(np.size(x)) or real(x, *args, **kw))
        pseudo_likelihood.gradients(weights, ids, around)
    assert sum(sizes) == n * 2 * side and max(sizes) < n * side
    monkeypatch.setattr(pseudo_likelihood, "ROWS", 7)
    for name, g in pseudo_likelihood.gradients(weights, ids, around).items():
        assert g == pytest.approx(whole[name], abs=1e-6)
    assert pseudo_likelihood.log_probabilities(weights, ids, around) == pytest.approx(each, abs=1e-5)
