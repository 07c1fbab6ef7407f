import math
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import quality_classifier as qda
from lodestone.llm.queries import op9_quality_classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op9_quality_classifier(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_score_is_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(3)
    p = len(qda.FEATURES)
    mean, x = rng.normal(size=(2, p)), rng.normal(size=(5, p))
    cov = []
    for _ in range(2):
        a = rng.normal(size=(p, p))
        cov.append(a @ a.T + np.eye(p))
    whiten = np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in cov])
    model = qda.Discriminant(0.3, mean, whiten, np.array([np.linalg.slogdet(c)[1] for c in cov]))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - mean[c], np.linalg.inv(cov[c]), x - mean[c]) - 0.5 * np.linalg.slogdet(cov[c])[1] for c in (0, 1)]
    odds = np.exp(log[1] - log[0]) * 0.3 / 0.7
    assert np.allclose(model.score(x), odds / (1 + odds))


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(60, len(qda.FEATURES))), rng.integers(0, 2, 60)
    frame = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, label)], "x array<double>, label int").repartition(3)
    got = {(r["label"], r["at"]): r["total"] for r in qda.moments(frame).collect()}
    upper = np.triu_indices(x.shape[1])
    for c in (0, 1):
        own = x[label == c]
        expected = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        assert np.allclose([got[c, i] for i in range(len(expected))], expected)


def test_odd_rows_and_missing_labels(spark, odd, empty):
    featured = qda.document_features(odd)
    none = qda.fit(featured.selectExpr("x", "CAST(NULL AS int) AS label"))
    assert {r["score"] for r in qda.score(featured, none).collect()} == {0.5}
    one = qda.fit(featured.selectExpr("x", "1 AS label"))
    assert {r["score"] for r in qda.score(featured, one).collect()} == {1.0}
    both = qda.fit(featured.selectExpr("x", "CAST(doc_id % 2 AS int) AS label"))
    rows = qda.score(featured, both).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert qda.score(qda.document_features(empty), both).count() == 0


def plain_features(text):
    """The documented statistics by regular expressions and sets."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(8)}
    n, chars, of_lines = max(len(words), 1), max(sum(map(len, words)), 1), max(len(lines), 1)
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    rates = [sum(text.count(c) for c in "#*$%&|<>") / chars, sum("A" <= c <= "Z" for c in text) / chars, (len(lines) - len(set(lines))) / of_lines, len(covered) / n, stutter / n]
    marks = [sum(text.count(c) for c in marked.decode()) / n for marked in qda.MARKS.values()]
    total = sum(map(len, words))
    return [math.log1p(len(words)), math.log1p(total), math.log1p(total / n), *map(math.sqrt, rates), math.log1p(len(words) / of_lines), *map(math.sqrt, marks)]


def test_query_equals_brute_force(spark):
    """Features, shrinkage and posterior of the whole query, from the tables alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    apart = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    x = {r["doc_id"]: np.array(plain_features(r["text"] or "")) for r in docs}
    own = [np.array([x[i] for i in x if not apart[i] and quality.get(i) == c]) for c in (0, 1)]
    n = [len(o) for o in own]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    log = []
    for c in (0, 1):
        mixed = (0.8 * cov[c] + 0.2 * pooled) / np.outer(unit, unit)
        shrunk = 0.98 * mixed + (0.02 * np.trace(mixed) / len(mixed) + 1e-9) * np.eye(len(mixed))
        z = (np.array(list(x.values())) - own[c].mean(axis=0)) / unit
        log.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(shrunk), z) - 0.5 * np.linalg.slogdet(shrunk)[1] + math.log(n[c]))
    expected = dict(zip(x, 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), strict=True))
    got = {r["doc_id"]: r for r in op9_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r["held_out"] == apart[i]
        assert abs(r["score"] - expected[i]) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.7)
