"""Operators that learn: held-out accuracy, exact inference, targets that are met, and the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskgauge.llm import language, mixing, quality
from test_contracts import least, shingle_set

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [(None, "lost row", None, None, 1, 3), (1, None, "en", "s", 0, 3), (2, "", None, None, None, 3), (3, "123 !!! \n", "en", "s", 1, 3), (4, "the thing " * 30000, "en", "s", 1, 3), (4, "the thing " * 30000, "en", "s", 1, 3)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, row int"


def test_quality_held_out(docs, labels):
    got = {r["doc_id"]: r for r in quality.scores(docs, quality.train(docs, labels), ["doc_id"]).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.where(quality.remainder("doc_id", 5) == 0).collect() if r["doc_id"] in got}
    right = [(got[k]["score"] >= quality.CUT) == (v == 1) for k, v in want.items()]
    assert len(right) > 20 and np.mean(right) > 0.9


def test_quality_ranks_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, quality.N_BASE))
    y = (x[:, 3] - x[:, 5] > 0).astype(int)
    s = quality.Ranker(x, y).score(x)
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad).mean() > 0.97


def test_quality_of_odd_rows(spark, labels):
    odd = spark.createDataFrame(ODD, KINDS)
    s = quality.scores(odd, quality.train(odd, labels.limit(0)), ["doc_id", "row"]).collect()
    assert len(s) == len(ODD) and all(r["score"] == 1.0 for r in s)
    none = quality.scores(odd.limit(0), quality.train(odd.limit(0), labels), ["doc_id"])
    assert none.count() == 0


def brute_posteriors(e, trans):
    n, k = e.shape
    from itertools import product

    out, total = np.zeros((n, k)), 0.0
    for path in product(range(k), repeat=n):
        w = np.exp(sum(e[i, path[i]] for i in range(n)) + sum(trans[path[i], path[i + 1]] for i in range(n - 1)))
        total += w
        for i in range(n):
            out[i, path[i]] += w
    return out / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 7, 2]
    e, trans = rng.standard_normal((sum(sizes), 3)), rng.standard_normal((3, 3))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = language.posteriors(e, bounds, trans)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        assert np.allclose(got[a:b], brute_posteriors(e[a:b], trans), atol=1e-9)


def test_blocks_equal_one_long_chain():
    rng = np.random.default_rng(2)
    sizes = [200, 3, 32, 33, 64, 1]
    e, trans = rng.standard_normal((sum(sizes), 4)) * 2, rng.standard_normal((4, 4))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = language.posteriors(e, bounds, trans)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        x, t = np.exp(e[a:b]), np.exp(trans)
        f, g = [x[0] / x[0].sum()], [np.ones(4)]
        for i in range(1, b - a):
            v = (f[-1] @ t) * x[i]
            f.append(v / v.sum())
        for i in range(b - a - 1, 0, -1):
            v = t @ (x[i] * g[-1])
            g.append(v / v.sum())
        p = np.array(f) * np.array(g[::-1])
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True), atol=1e-9)


def test_language_held_out_and_switches(spark, docs):
    crf = language.train(docs, 500)
    got = language.predict(docs, crf, ["doc_id", "lang"]).where(language.remainder("doc_id", 3) == 1).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    own = {r["lang"]: r["text"] for r in docs.where("n_chars > 400 and n_chars < 3000").orderBy("doc_id").select("lang", "text").collect()}
    mixed = " ".join(own["de"].split()[:25] + own["es"].split()[:25])
    w = language.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), crf).orderBy("word_no").collect()
    assert [r["lang"] for r in w[5:15]] == ["de"] * 10 and [r["lang"] for r in w[-15:-5]] == ["es"] * 10
    odd = {(r["doc_id"], r["row"]): r for r in language.predict(spark.createDataFrame(ODD, KINDS), crf, ["doc_id", "row"]).collect()}
    assert all(odd[i, 3]["lang_pred"] == "und" and odd[i, 3]["score"] == 0 for i in (1, 2, 3)) and odd[4, 3]["lang_pred"] == "en"
    untaught = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs.limit(5), untaught, ["doc_id"]).collect()} == {"und"}


def brute_rates(tokens, p, t, steps=20000):
    """Projected gradient on all documents at once."""
    w, t, r = tokens / tokens.sum(), t / t.sum(), np.ones(len(tokens))
    m = (p * w[:, None]).T @ p / np.sqrt(np.outer(t, t))
    step = 1 / (np.linalg.eigvalsh(m)[-1] + mixing.PULL)
    for _ in range(steps):
        res = ((w * r) @ p - t) / t
        r = np.maximum(0, r - step * (p @ res) - step * mixing.PULL * (r - 1))
        if np.abs(res).max() < 1e-4:
            break
    return r


def test_mixing_meets_targets_as_brute_force_does(docs, labels):
    cells, seen = mixing.mixed(docs, labels)
    rows = mixing.rated(seen, cells).select("doc_id", "n_tokens", "p", "rate", "copies").collect()
    tokens, p, rate = (np.array([r[k] for r in rows], dtype=float) for k in ("n_tokens", "p", "rate"))
    t = np.array(list(mixing.TARGETS.values()))
    assert len(rows) == 600 and np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    share = (tokens * rate) @ p / tokens.sum()
    assert np.allclose(share, t, rtol=0.02)
    assert np.allclose(rate, brute_rates(tokens, p, t), atol=0.05)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


def test_mixing_of_odd_rows(spark, labels):
    odd = spark.createDataFrame(ODD, KINDS).withColumn("rate", F.lit("x"))
    for taught in (labels, labels.limit(0)):
        cells, seen = mixing.mixed(odd, taught)
        assert mixing.rated(seen, cells).count() == len(ODD)
        assert mixing.resampled(odd, taught).columns == odd.columns
    cells, seen = mixing.mixed(odd.limit(0), labels)
    assert mixing.rated(seen, cells).count() == 0 and mixing.resampled(odd.limit(0), labels).count() == 0


def test_mixing_classifier_held_out(spark, labels):
    """Labels of a fifth are hidden; the posteriors' best domain is right far more often than the largest domain."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    cells, seen = mixing.mixed(whole, labels.join(hidden, "doc_id", "left_anti"))
    rows = mixing.rated(seen, cells).join(mixing.domains_of(hidden), "doc_id").select("p", "domain").collect()
    domains = list(mixing.TARGETS)
    right = np.mean([domains[int(np.argmax(r["p"]))] == r["domain"] for r in rows])
    largest = max(np.mean([r["domain"] == d for r in rows]) for d in domains)
    assert len(rows) > 50 and right > largest + 0.08, (right, largest)


def test_pipeline_stages(spark, docs):
    now = docs.select(*corpus_pipeline.COLUMNS)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            data = {r["doc_id"]: shingle_set(r["text"]) for r in now.collect()}
            links = [(a, b) for a in data for b in data if a < b and data[a] and 100 * len(data[a] & data[b]) >= 80 * len(data[a] | data[b])]
            want = least(data, links)
            assert any(100 * len(data[a] & data[b]) < 85 * len(data[a] | data[b]) for a, b in links)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in data if want[i] == i)
        now = out.cache()
        counts.append(now.count())
    assert 600 > counts[0] >= counts[1] > counts[2] > 0 and counts[4] == counts[3]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_takes_odd_rows(spark, rows):
    now = spark.createDataFrame(rows, KINDS).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        ids = [r["doc_id"] for r in now.select("doc_id").collect() if r["doc_id"] is not None]
        if name == "near_duplicates":
            assert len(ids) == len(set(ids))  # rows repeated under one id are one document


@pytest.mark.parametrize("shares", [(0.01, 0.0005, 0.985, 0.0045), (0.002, 0.0002, 0.9968, 0.001)])
def test_mixing_meets_targets_on_skewed_shares(shares):
    t, w, p = np.array(list(mixing.TARGETS.values())), np.array(shares), np.eye(4)

    def sums(x):
        r = np.maximum(0, 1 - p @ x / mixing.PULL)
        return (w * r) @ p, (p * (w * (r > 0))[:, None]).T @ p, w @ r**2

    x = mixing.solve_rates(sums, t)
    rate = np.maximum(0, 1 - p @ x / mixing.PULL)
    assert np.allclose(w * rate, t, rtol=0.011) and np.allclose(w * rate / t - 1, x, atol=1e-6)
