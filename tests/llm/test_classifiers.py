import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import langid, quality
from tidewake.llm.sampling import labelled_sample

RNG = np.random.default_rng(0)
WORDS = {"en": "the and of to in that was his with for house water river".split(), "de": "der und die das von mit für nicht haus wasser straße".split(), "fr": "le et les des que pour dans une maison rivière forêt".split()}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang], n)) + "."


def documents():
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        good = i % 4 != 0
        text = prose(lang, 40) if good else " ".join(w + "$$$" for w in prose(lang, 40).split())
        rows.append((i, text, lang, int(good)))
    return rows


def test_quality_separates_and_scores_odd_texts(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i % 5] + [(None, 1), (9999, 0), (3, None)], "id long, label int")
    model = quality.fit_quality(labels, docs, per_class=60)
    held = spark.createDataFrame([(i, t, q) for i, t, _, q in rows if i % 5 == 0] + [(-1, None, 1), (-2, "", 1), (-3, "word " * 100_000, 1)], "id long, text string, quality int")
    out = held.withColumn("score", quality.quality_score(F.col("text"), model, spark)).collect()
    assert all(0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.id >= 0]
    assert np.mean([(r.score >= 0.3) == r.quality for r in known]) > 0.95
    again = quality.fit_quality(labels.repartition(3), docs.repartition(5), per_class=60)
    assert np.allclose(again.score([rows[0][1]]), model.score([rows[0][1]]))


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    model = quality.fit_quality(spark.createDataFrame([], "id long, label int"), docs)
    assert model.score(["a", None]).tolist() == [0.5, 0.5]


def test_language_is_learned_and_und_without_letters(spark):
    rows = documents()
    learn = spark.createDataFrame([(i, lang, t) for i, t, lang, _ in rows if i % 4] + [(500, "en", None), (501, None, "x")], "id long, label string, text string")
    model = langid.fit_languages(learn, per_language=50)
    test = [(t, lang) for i, t, lang, _ in rows if i % 4 == 0] + [("haus", "de"), (None, "und"), ("", "und"), ("123 !?", "und"), ("der und " * 50_000, "de")]
    out = spark.createDataFrame(test, "text string, want string").select("want", langid.language_of(F.col("text"), model, spark).alias("o")).collect()
    assert np.mean([r.o.lang_pred == r.want for r in out]) > 0.97
    assert all((r.o.lang_pred == "und") == (r.want == "und") and 0 <= r.o.score <= 1 for r in out)
    nothing = langid.fit_languages(learn.limit(0))
    assert nothing is None
    assert spark.range(1).select(langid.language_of(F.lit("abc"), nothing, spark).alias("o")).first().o.lang_pred == "und"


def test_quality_features_ignore_order_of_partitions_and_sample_is_bounded(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit("t").alias("text"))
    table, sizes = labelled_sample(rows, None, 100)
    assert sizes == {0: 2500, 1: 2500} and 100 < len(table) < 300
    assert table["id"].to_pylist() == sorted(table["id"].to_pylist())


@pytest.mark.parametrize("at_once", [1, 7, 64, 1 << 20])
def test_logits_are_those_of_a_plain_count_of_n_grams_wherever_pieces_end(monkeypatch, at_once):
    texts = [prose(k, 30) for k in ("en", "de", "fr")] * 8
    model = langid.fit(texts, ["en", "de", "fr"] * 8)
    monkeypatch.setattr(langid, "_AT_ONCE", at_once)
    for text in ("Straße  im\nHaus " * 9, "x", " ", "ÉTÉ", "le " * 40):
        b = (" " + " ".join(text.lower().split()) + " ").encode()
        grams = [b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)]
        sums = np.zeros(3)
        for g in grams:
            h = len(g)
            for byte in g:
                h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
            sums += model.table[(h ^ (h >> 15)) % langid.BUCKETS]
        assert np.allclose(model.logits(text), sums / max(len(grams), 1) + model.bias, atol=1e-5)


def test_language_ties_repeats_and_empty_tables(spark):
    model = langid.LanguageModel(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), np.array([0.0, 1.0, 1.0]), 1.0, 0.5)
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "yy zz")], "id long, text string").withColumn("of", F.lit("clash"))
    out = docs.withColumn("o", langid.language_of(F.col("text"), model, spark)).collect()
    assert [r.o.lang_pred for r in out] == ["b"] * 3 and len({r.o.score for r in out}) == 1 and not any(r.o.accepted for r in out)
    assert docs.limit(0).select(langid.language_of(F.col("text"), model, spark)).count() == 0
    twice = spark.createDataFrame([(1, "a", "x y"), (1, "b", "x y"), (2, "a", "")] * 5, "id long, label string, text string")
    assert langid.fit_languages(twice).languages == ["a", "b"]


def test_quality_score_is_that_of_a_plain_pooling_and_network():
    texts = [t for _, t, _, _ in documents()[:80]]
    model = quality.fit(texts, np.arange(80) % 2, np.ones(80), epochs=2)
    mean, scale, w1, b1, w2, b2 = model.weights
    for text in (texts[0], texts[3], "Zebra zebra 12345 !!! $$$ the THE", "", "x" * 50, "a a a b"):
        tokens = [m.group() for m in quality._TOKEN.finditer(text)]
        pooled = np.zeros(2 * quality.DIMS)
        for k, t in enumerate(tokens):
            kind = model.shapes.get(quality.shape(t), 0)
            pooled[: quality.DIMS] += model.vectors[model.rows.get(t, kind)] / len(tokens)
            pooled[quality.DIMS :] += model.vectors[kind] / len(tokens)
            if k + 1 < len(tokens) and tokens[k + 1] == t:
                pooled[quality.DIMS :] += model.vectors[model.shapes["<=>"]] / len(tokens)
            if t in tokens[:k]:
                pooled[quality.DIMS :] += model.vectors[model.shapes["<again>"]] / len(tokens)
        out = b2[0]
        for j in range(len(b1)):
            out += w2[j, 0] * np.tanh(sum((pooled[i] - mean[i]) / scale[i] * w1[i, j] for i in range(len(pooled))) + b1[j])
        assert np.isclose(model.score([text])[0], 1 / (1 + np.exp(-out / model.temperature)), atol=1e-4)


def test_quality_of_empty_tables_extra_columns_and_repeated_ids(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1, "other text"), (1, rows[1][1])], "id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(1, 1, 0)] * 3, "id long, label int, text int")
    model = quality.fit_quality(labels.select("id", "label"), docs.select("id", "text"), per_class=60)
    out = docs.limit(0).select(quality.quality_score(F.col("text"), model, spark))
    assert out.count() == 0
    assert quality.fit_quality(labels.select("id", "label").limit(0), docs.select("id", "text").limit(0)).score([""]).tolist() == [0.5]


def test_a_repeated_id_stays_bounded(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("id"), F.lit(1).alias("label"), F.lit("same").alias("text"))
    many = rows.withColumn("text", F.expr("uuid()"))
    for salt in range(3):
        got = [labelled_sample(r.withColumn("id", F.col("id") + salt), None, 30_000) for r in (rows, many)]
        assert got[0][1] == {1: 20_000} and len(got[0][0]) == 1 and len(got[1][0]) == 20_000
    docs, label = many.select("id", "text"), rows.select("id", "label")
    assert sum(len(labelled_sample(label.unionByName(spark.createDataFrame([(7, 0)] * 9, "id long, label int")), docs, 5)[0]) for _ in range(1)) <= 60
