"""The classifier's and the URL filter's fits against plain Python and other solvers; empty tables; conflicting labels."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from harborline.llm import bpe, quality_classifier, quality_rules, url_filters
from harborline.llm.common import byte_grams


def gram_sets(text: str, s):
    body = text.encode()
    out = set()
    for k, size in enumerate(s.sizes):
        for i in range(len(body) - size + 1):
            part = np.frombuffer(body[i : i + size], np.uint8)
            h, _ = byte_grams(np.array([0, size]), part, size, s.bits)
            out.add(int(h[0]) + (k << s.bits))
    return sorted(out)


def objective(w, b, rows, y, top):
    return 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - k * (w[x].sum() + b)) for x, k, c in zip(rows, y, top, strict=True))


def test_descent_reaches_the_optimum():
    """Projected gradient steps on the dual find no better point."""
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(50)]
    y = np.array([1 if 3 in x or 7 in x or rng.random() < 0.2 else -1 for x in rows])
    s = quality_classifier.Settings(cost=0.5, epochs=3000)
    w, b = quality_classifier.descend(rows, y, np.ones(30), s)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
    z = np.zeros((50, 31))
    for i, x in enumerate(rows):
        z[i, x], z[i, 30] = 1.0, 1.0
    q, a = (z @ z.T) * np.outer(y, y), np.zeros(50)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60000):
        a = np.clip(a + step * (1 - q @ a), 0, s.cost * share)
    v = (a * y) @ z
    got, want = objective(w, b, rows, y, s.cost * share), objective(v[:30], v[30], rows, y, s.cost * share)
    assert got <= want * 1.001 + 1e-6


def test_classifier_equals_plain_python(spark):
    good, bad = ["clear prose about towns", "prose on rivers and towns", "plain words on rivers"], ["buy buy now!!!", "!!! click now", "now click buy"]
    rows = [(i, t) for i, t in enumerate(good * 2 + bad * 2)]
    docs = spark.createDataFrame([*rows, rows[0], (50, "conflicting"), (51, None)], "doc_id long, text string").repartition(3)
    labels = [(i, int(i < 6)) for i, _ in rows] + [(50, 0), (50, 1), (None, 1), (0, 1)]
    s = quality_classifier.Settings(bits=10, epochs=500)
    m = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), s)
    order = [r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.xxhash64("doc_id")).collect()]
    sets, y = [gram_sets(dict(rows)[i], s) for i in order], np.array([1 if i < 6 else -1 for i in order])
    size = 2 << s.bits
    counts = {k: np.full(size, s.alpha) for k in (1, -1)}
    for x, k in zip(sets, y, strict=True):
        counts[k][x] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    r[(counts[1] == s.alpha) & (counts[-1] == s.alpha)] = 0
    fitted = [i for i in range(len(y)) if i % 5 != 4]
    w, b = quality_classifier.descend([np.array(sets[i], np.int32) for i in fitted], y[fitted], r, s)
    assert np.allclose(m.weights, w, atol=1e-4) and math.isclose(m.bias, b, abs_tol=1e-4)  # steps end at 1e-5
    for got in quality_classifier.score_texts(docs, m, s).collect():
        x = gram_sets(dict(rows).get(got.doc_id, {50: "conflicting"}.get(got.doc_id, "")), s)
        assert math.isclose(got.score, 1 / (1 + math.exp(-(m.slope * (w[x].sum() + b) + m.offset))), abs_tol=1e-4)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    whole = quality_classifier.fit(docs, labels)
    few = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample_bytes=2000))
    none = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample_bytes=10))
    assert (whole.weights != 0).sum() > (few.weights != 0).sum() and not none.weights.any()


def test_url_fit_equals_plain_logistic_regression(spark):
    """Gradient descent over bucket weights, in plain numpy, ends at the margins of the kernel form."""
    s = url_filters.Settings(longest=4, bits=12, decay=0.05)
    rows = [(1, "http://casino.example.com/en/1"), (1, "http://casino-x.example.net/en/1"), (0, "http://museum.example.com/en/1"), (0, "http://town.example.org/fr/é"), (1, "http://win.example.org/fr/2"), (0, None), (0, None)]
    df = spark.createDataFrame(rows, "label int, url string")
    weights, bias = url_filters.fit(df, s)

    def grams(url):
        host, path = (url.split("/", 3)[2], "/" + url.split("/", 3)[3]) if url else ("", "")
        texts, out = [*(f"^{x}$" for x in host.split(".")), f"^|{path}$"], set()
        for codes, n in ((list(map(ord, t)), n) for t in texts for n in range(s.size, s.longest + 1)):
            for i in range(len(codes) - n + 1):
                h = 7
                for c in codes[i : i + n]:
                    h = (h * 1000003 + c) % 2147483647
                out.add(h % (1 << s.bits))
        return sorted(out)

    x = np.zeros((len(rows), (1 << s.bits) + 1))
    for i, (_, u) in enumerate(rows):
        g = grams(u)
        x[i, g], x[i, -1] = 1 / math.sqrt(len(g)), 1.0
    y, w = np.array([r[0] for r in rows], float), np.zeros(x.shape[1])
    for _ in range(20000):
        w -= 0.5 * (s.decay * w + x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y))
    assert np.allclose(x @ w, x[:, :-1] @ np.array(weights) + bias, atol=1e-4)
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)] + [(0, rows[0][1])], "page_id long, url string")
    got = url_filters.judged(pages, (weights, bias), s=s).collect()
    assert collections.Counter(r.page_id for r in got)[0] == 2  # repeated rows stay
    assert all(abs(r.margin - float(x[r.page_id] @ w)) < 1e-4 for r in got)


def test_empty_tables(spark, nothing, edges):
    ratios = quality_rules.ratios_of(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert not ratios.any() and quality_rules.judge(nothing, ratios).count() == 0 and quality_rules.filter_texts(nothing, ratios).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judged(pages, url_filters.fit(url_filters.labelled(spark))).count() == 0
    assert url_filters.fit(url_filters.labelled(spark).where("false"))[1] == 0.0
    assert bpe.encoded(nothing).count() == 0
    assert quality_rules.judge(edges, ratios).count() == edges.count()


def test_ratio_does_not_depend_on_neighbours(spark):
    rng = np.random.default_rng(1)
    ratios, texts = rng.normal(size=1 << 16), [f"some text {i} " * (i % 50) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = {r.doc_id: r.ratio for r in quality_rules.judge(docs.coalesce(1), ratios).collect()}
    few = {r.doc_id: r.ratio for r in quality_rules.judge(docs.repartition(60), ratios).collect()}
    assert many == few
