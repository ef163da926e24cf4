"""Kneser-Ney against a version in plain dictionaries, letters above U+FFFF, rejection."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratavox.llm import langid

TEXTS = {"aa": ["the cat sat on the mat", "a dog and a cat", "the the the"], "bb": ["le chat est la", "un chien et le chat", "où est-il"]}


def stream(text):
    out = " " * 3 + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "    " in out[3:] or "  " in out[3:]:
        out = out[:3] + out[3:].replace("  ", " ")
    return out


def naive(texts, vocabulary):
    """Probability of a character after a history, interpolated Kneser-Ney of order 4 with one discount an order."""
    counts = {4: Counter(g[i : i + 4] for g in map(stream, texts) for i in range(len(g) - 3))}
    for m in (3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = {m: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for m, c in counts.items()}
    total, kinds = {m: Counter() for m in counts}, {m: Counter() for m in counts}
    for m, c in counts.items():
        for g, v in c.items():
            total[m][g[:-1]] += v
            kinds[m][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        m, h = len(g), g[:-1]
        if not total[m][h]:
            return p(g[1:])
        return max(counts[m][g] - discount[m], 0) / total[m][h] + discount[m] * kinds[m][h] / total[m][h] * p(g[1:])

    return p


def fitted():
    n = defaultdict(Counter)
    for lang, texts in TEXTS.items():
        for t in texts:
            n[lang].update(langid.grams(langid.symbols(t)[0]).tolist())
    rows = [(lang, g, k) for lang, c in n.items() for g, k in c.items()]
    lang, gram, k = zip(*rows, strict=True)
    return langid.KneserNey.fit(np.array(lang), np.array(gram, np.uint64).view(np.int64), np.array(k))


@pytest.mark.parametrize("text", ["the cat", "le chat dort", "zzz qq", "x", "a dog est un où"])
def test_cross_entropy_against_plain_dictionaries(text):
    model = fitted()
    letters = len({c for texts in TEXTS.values() for t in texts for c in stream(t)})
    got = model.cross_entropy([text])[0][0]
    s = stream(text)
    for j, lang in enumerate(model.langs):
        p = naive(TEXTS[lang], letters)
        want = -np.mean([math.log2(p(s[i : i + 4])) for i in range(len(s) - 3)])
        assert got[j] == pytest.approx(want, rel=1e-4)


def test_letters_above_the_basic_plane_are_no_other_letters():
    high = [c for c in [*range(0x10000, 0x10600), *range(0x20000, 0x2A6E0)] if chr(c).lower() == chr(c) and chr(c).isalpha()]
    seen = [tuple(langid.symbols(chr(c))[0].tolist()) for c in high]
    assert len(high) > 43_000 and len(set(seen)) == len(seen)
    assert langid.symbols("\U00020000x\U00022100")[1] == 3 and len(langid.symbols("\U00020000x\U00022100")[0]) == 3 + 5 + 1
    assert langid.symbols("\U0001f600 a")[0].tolist()[3:] == [32, 97, 32] or langid.symbols("\U0001f600 a")[0].tolist()[3:] == [97, 32]


def test_other_languages_and_random_letters_are_rejected(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, use=langid.learnable())
    rng = random.Random(1)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (20, 100, 500) for _ in range(20)]
    other = ["Это обычный русский текст про погоду и природу в нашем городе.", "Zażółć gęślą jaźń i idź do domu, proszę bardzo, bo jest już późno.", "日本語の文章がここにあります。"]
    assert model.judge(letters + other)[3].all()
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    assert model.judge(texts)[3].mean() <= 0.002


@pytest.mark.parametrize("n", [1, 2, 999, 1001, 5000])
def test_upper_quantiles_are_those_of_all_rows(spark, n):
    rng = np.random.default_rng(n)
    values = {0: rng.normal(size=n), 3: np.round(rng.normal(size=n), 1), 5: np.zeros(n)}
    rows = spark.createDataFrame([(j, float(v)) for j, a in values.items() for v in a], "j long, v double").repartition(5)
    for q in (0.999, 0.9995, 1.0):
        got = langid.upper_quantiles(rows, q)
        assert got.keys() == values.keys() and all(got[j] == pytest.approx(np.quantile(a, q), rel=1e-12, abs=1e-12) for j, a in values.items())
    assert langid.upper_quantiles(rows.where("false"), 0.999) == {}


def check_thresholds(model, docs):
    """limit and slack by numpy over every row."""
    rows = docs.where("lang IS NOT NULL").select("lang", "text").collect()
    ce, size, letters = model.cross_entropy([r["text"] or "" for r in rows])
    for j, lang in enumerate(model.langs):
        own = np.array([r["lang"] == lang for r in rows]) & (letters > 0)
        base = np.quantile(ce[own & (size >= 200), j], 1 - langid.REJECTED)
        assert model.limit[j] == pytest.approx(base + model.optimism[j] + langid.MARGIN, rel=1e-9)
        over = (ce[own, j] + model.optimism[j] - model.limit[j]) * np.sqrt(size[own])
        assert model.slack[j] == pytest.approx(max(langid.LEAST_SLACK, np.quantile(over, 1 - langid.REJECTED)), rel=1e-9)


def many(spark):
    """Some 9,000 rows, more than the 4,000 that the threshold was once calibrated on."""
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 9000")


def test_thresholds_come_from_every_training_row(spark):
    docs = many(spark).where(langid.learnable())
    check_thresholds(langid.train(many(spark), use=langid.learnable()), docs)


def test_the_pipeline_rejects_by_thresholds_of_all_its_documents(spark, monkeypatch):
    models = []
    monkeypatch.setattr(langid, "keep_known", lambda docs, model: models.append(model) or docs)
    corpus_pipeline.language(spark, many(spark), "")
    check_thresholds(models[0], many(spark))


def test_the_pipeline_keeps_odd_texts_that_a_sample_would_not_show(spark):
    """Twelve odd texts, more than one in a thousand, under ids that the 4,000 smallest hashes leave out: thresholds of all rows
    leave them, those of such a sample reject them."""
    docs = many(spark).where("lang = 'en'")
    rng = random.Random(1)
    last = docs.orderBy(F.xxhash64("doc_id").desc()).limit(12).select("doc_id").collect()
    odd = {r["doc_id"]: " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 9))) for _ in range(60)) for r in last}
    docs = docs.join(spark.createDataFrame(list(odd.items()), "doc_id long, odd string"), "doc_id", "left")
    docs = docs.withColumn("text", F.coalesce("odd", "text")).select(*corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").select("doc_id").collect()}
    assert docs.count() > 5000 and kept.issuperset(odd)
