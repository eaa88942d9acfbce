import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revana.operators import (attribution, evaluation, features, lda, median, ranking, sentiment,
                              survey, topics, tuning)
from revana.plans.reviews import review_study
from revana.plans.survey import survey_study
from revana.plans.topics import topic_cloud, topic_sheets, topic_table, write_keyword_topics
from revana.sources.stopwords import as_stopwords

SF = "/root/testdata/sf0.001"

# Published test report of a two-class model, and the confusion
# matrix (rows are true 0, 1) that yields it.
MATRIX = {(0, 0): 52, (0, 1): 36, (1, 0): 20, (1, 1): 83}
REPORT = {
    "0": (0.722222, 0.590909, 0.650000, 88), "1": (0.697479, 0.805825, 0.747748, 103),
    "accuracy": (0.706806,) * 4, "macro avg": (0.709851, 0.698367, 0.698874, 191),
    "weighted avg": (0.708879, 0.706806, 0.702712, 191)}

# Two stored topic texts.
TOPIC_A = "0.061*'了' + 0.040*'好评' + 0.008*'都' + 0.004*'口感' + 0.003*'它' + 0.003*'好吃' + 0.003*'茶' + 0.002*'问题' + 0.002*'使用'"
TOPIC_B = "0.065*'粘' + 0.037*'六' + 0.037*'发少' + 0.037*'硬糖' + 0.037*'发货' + 0.037*'软糖' + 0.037*'差评' + 0.037*'一罐' + 0.037*'必须' + 0.037*'标明' + 0.037*'我要'"


def pairs(spark):
    rows = [k for k, n in MATRIX.items() for _ in range(n)]
    return spark.createDataFrame(rows, "true_label int, predicted_label int")


def test_golden_report(spark):
    got = {r.label: tuple(round(r[c], 6) for c in ("precision", "recall", "f1", "support"))
           for r in evaluation.classification_report(pairs(spark)).collect()}
    assert got == REPORT
    assert round(evaluation.accuracy(pairs(spark)).first().accuracy, 6) == 0.706806


def test_report_of_a_label_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c")], "true_label string, predicted_label string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support)
           for r in evaluation.classification_report(df).collect()}
    assert got["b"] == (0, 0, 0, 1) and got["c"] == (0, 0, 0, 0)
    assert got["a"] == (.5, .5, .5, 2)


def test_confusion_matrix_with_an_empty_class(spark):
    df = spark.createDataFrame([("positive", "negative"), ("negative", "negative")],
                               "true_label string, predicted_label string")
    rows = evaluation.confusion_matrix(df).collect()
    assert len(rows) == 9 and sum(r.n for r in rows) == 2
    assert all(r.row_share is None for r in rows if r.true_label == "neutral")


def test_repeated_ids_multiply(spark):
    truth = spark.createDataFrame([("a", "5"), ("a", "1"), ("b", "x"), ("c", None)], "comment_id string, score string")
    scored = spark.createDataFrame([("a", 0.9, 3), ("a", 0.1, 3), ("b", 0.01, 3)],
                                   "comment_id string, sentiment_score double, score int")
    joined = evaluation.join_truth(truth, scored)
    assert joined.count() == 5 and {"score_true", "score_df"} <= set(joined.columns)
    n = {(r.true_label, r.predicted_label): r.n
         for r in evaluation.label_pair_counts(truth, scored).collect()}
    assert n == {("positive", "positive"): 1, ("positive", "neutral"): 1, ("negative", "positive"): 1,
                 ("negative", "neutral"): 1, ("negative", "negative"): 1}


@pytest.fixture(scope="module")
def labelled_tokens(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, i % 3 > 0, [rng.choice(vocab[:25] if i % 3 else vocab[15:]) for _ in range(rng.randint(0, 12))])
            for i in range(120)]
    rows = [(i, int(y), t) for i, y, t in rows] + [(998, None, ["w1"]), (999, None, ["unseen"]), (1000, None, [])]
    return spark.createDataFrame(rows, "doc_id int, label int, tokens array<string>").cache()


def test_medians_of_extremes_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(median, "FEW", 2)
    inf = float("inf")
    columns = {"a": [1.5] * 40 + [2.5] * 40, "b": [-0.0, 0.0, -1e-300, 1e-300], "c": [-inf, inf, inf], "d": [1e308, -1e308, 5e-324],
               "e": [float(2 ** 53), float(2 ** 53 + 2)], "f": [None, float("nan")], "g": [-3.0, -2.0, -1.0, -7.0]}
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    assert median.exact_medians(df, list(columns)) == {
        "a": 2.0, "b": 0.0, "c": inf, "d": 5e-324, "e": float(2 ** 53 + 1) , "f": None, "g": -2.5}
    assert median.exact_medians(df.limit(0), ["a"]) == {"a": None} and median.exact_medians(df, []) == {}


def test_naive_bayes_agrees_with_mllib(spark, labelled_tokens):
    model = sentiment.fit_naive_bayes(labelled_tokens)
    mine = {r.doc_id: r for r in sentiment.score_sentiment(labelled_tokens, model, ["doc_id"]).collect()}
    cv = CountVectorizer(inputCol="tokens", outputCol="features").fit(labelled_tokens.filter("label is not null"))
    data = cv.transform(labelled_tokens)
    nb = NaiveBayes(labelCol="label", smoothing=1.0).fit(data.filter("label is not null"))
    for r in nb.transform(data).collect():
        if r.tokens:
            assert mine[r.doc_id].raw == pytest.approx(r.probability[1], abs=1e-9)
    assert mine[1000].raw is None and mine[1000].sentiment_score == 0.8
    assert mine[999].raw == pytest.approx(1 / (1 + math.exp(-model.prior)))
    assert len(mine) == labelled_tokens.count()


def test_head_and_tail_lookup_give_the_same(spark, labelled_tokens):
    model = sentiment.fit_naive_bayes(labelled_tokens)
    whole, split = (sorted(map(tuple, sentiment.score_sentiment(
        labelled_tokens, model, ["doc_id"], broadcast_rows=n).select("doc_id", "sentiment_score").collect()))
        for n in (1000, 5))
    assert [w[0] for w in whole] == [s[0] for s in split]
    assert np.allclose([w[1] for w in whole], [s[1] for s in split])


def test_training_needs_both_classes(spark, labelled_tokens):
    with pytest.raises(ValueError):
        sentiment.fit_naive_bayes(labelled_tokens.filter("label = 1"))


def test_distribution_leaves_the_gap_out(spark):
    df = spark.createDataFrame([(s,) for s in (.01, .05, .3, .4, .6, .61, .9)], "sentiment_score double")
    rows = {r.bucket: (r.n, r.percent) for r in sentiment.sentiment_distribution(df).collect()}
    assert rows == {"positive": (2, 40.0), "neutral": (2, 40.0), "negative": (1, 20.0)}
    empty = sentiment.sentiment_distribution(df.filter("false")).collect()
    assert [r.n for r in empty] == [0, 0, 0] and all(r.percent is None for r in empty)


def test_ranks_against_brute_force(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    h = ranking.seeded_hash(7, "id")
    rows = ranking.hash_rank(df.withColumn("h", h), F.col("h"), "id", by=("g",), digits=2).collect()
    for g in (0, 1):
        part = sorted((r for r in rows if r.g == g), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("n", [1, 4, 5, 955, 3001])
def test_split_is_exact(spark, n):
    rows = survey.split_exact(spark.range(n), "id").collect()
    assert sum(r.is_test for r in rows) == math.ceil(0.2 * n)


def test_folds_are_even_in_each_class(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    for r in (survey.stratified_folds(df, "y", "id").groupBy("y", "fold").count()
              .groupBy("y").agg(F.max("count").alias("a"), F.min("count").alias("b"), F.count("*").alias("k")).collect()):
        assert r.a - r.b <= 1 and r.k == 5


@pytest.mark.parametrize("seed", range(6))
def test_median_against_numpy(spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(median, "FEW", 4)
    rng = random.Random(seed)
    n = rng.choice([1, 2, 999, 6000])
    cols = [[rng.gauss(0, 1) for _ in range(n)], [rng.choice([1, 1, 1, 2, 9]) for _ in range(n)],
            [rng.choice([None, float("nan"), rng.random() ** 9]) for _ in range(n)], [None] * n]
    df = spark.createDataFrame(list(zip(*cols)), "a double, b int, c double, d double")
    got = median.exact_medians(df, ["a", "b", "c", "d"])
    for name, values in zip("abcd", cols):
        values = [v for v in values if v is not None and v == v]
        assert got[name] == (pytest.approx(float(np.median(values)), abs=1e-12) if values else None)


def test_features(spark):
    train = spark.createDataFrame([(1, 1.0, 5, "x", True), (2, 3.0, 5, None, True), (3, None, 5, "y", False)],
                                  "id int, a double, b int, c string, flag boolean")
    model, ready = features.fit_features(train, exclude=("id",))
    assert features.feature_names(ready) == ["a", "b", "c_missing", "c_x", "c_y"]
    rows = [r.features.toArray() for r in ready.orderBy("id").collect()]
    assert rows[2][0] == 0 and rows[0][0] == pytest.approx(-math.sqrt(1.5))     # median 2, population deviation
    assert all(r[1] == 0 for r in rows)                                          # constant column
    new = spark.createDataFrame([(9, 2.0, 5, "unseen", True)], train.schema)
    out = model.transform(features.prepare_text(new, ["c"])).first().features.toArray()
    assert list(out) == [0, 0, 0, 0, 0]


def test_all_null_and_profile(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, `b.c` double, d string")
    assert survey.drop_all_null(df).columns == ["a", "d"]
    got = survey.binary_target(spark.createDataFrame([("A.愿意",), ("B",), (None,)], "q string"), "q")
    assert [r.q for r in got.collect()] == [1, 0, 0]


def test_topic_text_round_trip(spark, tmp_path):
    import json
    strings = spark.createDataFrame([("p", "topic_0", TOPIC_A), ("n", "topic_0", TOPIC_B),
                                     ("x", "topic_0", "0.5*'a+b' + 0.25*'it''s' + junk + 0.125*'ok'")],
                                    "cls string, topic_name string, topic_string string")
    parsed = topics.parse_topics(strings)
    counts = {r.cls: (r.n, round(r.w, 3)) for r in parsed.groupBy("cls").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert counts["p"] == (9, 0.126) and counts["n"] == (11, 0.435)
    assert [r.word for r in parsed.filter("cls = 'x'").orderBy("pos").collect()] == ["it", "ok"]
    terms = parsed.filter("cls <> 'x'").select("cls", F.lit(0).alias("topic"), (F.col("pos") + 1).alias("rank"), "word", "weight")
    back = {r.cls: r.topic_string for r in topics.format_topics(terms).collect()}
    assert back == {"p": TOPIC_A, "n": TOPIC_B}
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"positive_reviews_lda": {"topic_0": TOPIC_A, "topic_1": TOPIC_A}}, ensure_ascii=False))
    assert topic_table(spark, str(doc)).columns == ["sheet", "Topic", "Weight", "Word"]
    topic_sheets(spark, str(doc), str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets")).filter("sheet = 'Positive_LDA'").count() == 18
    top = topic_cloud(spark, str(doc), k=2).collect()
    assert [(r.word, round(r.weight, 3), r.relative) for r in top][0] == ("了", 0.122, 1.0) and len(top) == 2


def test_exclusive_terms(spark):
    rows = [("c", 0, "a", .5), ("c", 0, "b", .3), ("c", 0, "z", .1), ("c", 1, "a", .5), ("c", 1, "b", .4),
            ("c", 1, "z", .9), ("d", 0, "a", .1)]
    df = spark.createDataFrame(rows, "cls string, topic int, word string, weight double")
    got = sorted((r.cls, r.topic, r["rank"], r.word) for r in topics.exclusive_terms(df, 2).collect())
    # z is below the cut of topic 0; a ties and stays with topic 0; b goes to 1 only if it made the cut there
    assert got == [("c", 0, 1, "a"), ("c", 0, 2, "b"), ("c", 1, 1, "z"), ("d", 0, 1, "a")]


def corpus(spark, sf=SF):
    from revana.catalog.base import deduplicated_tokens
    return lda.build_corpus(deduplicated_tokens(spark, sf, stop=True))


def test_lda_is_reproducible_on_any_number_of_partitions(spark):
    fits = []
    for n in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        c = corpus(spark)
        fits.append(sorted((r.topic, r.word, round(r.weight, 9)) for r in lda.fit_topics(c, 3).terms("x", 20).collect()))
        c.release()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert fits[0] == fits[1] and len(fits[0]) == 60


def test_corpus_counts_every_token(spark, monkeypatch):
    from revana.catalog.base import deduplicated_tokens
    monkeypatch.setattr(lda, "EDGES", (500, 1000))
    df = deduplicated_tokens(spark, SF, stop=True)
    c = corpus(spark)
    entries = c.entries()
    assert c.blocks.count() > 10
    assert c.n_tokens == df.agg(F.sum(F.size("tokens"))).first()[0] == entries.agg(F.sum("n")).first()[0]
    assert entries.groupBy("word_id").agg(F.sum("n").alias("m")).join(c.words, "word_id").filter("m = n").count() == c.n_words
    assert entries.select("block", "doc").distinct().count() == df.filter(F.size("tokens") > 0).count()
    sweep = lda.sweep_topics({"a": c}, ks=(2, 3), passes=2).collect()
    assert [(r.k, r.n_tokens, r.log_perplexity == -r.per_word_bound, r.log_perplexity > 0) for r in sweep] == [
        (2, c.n_tokens, True, True), (3, c.n_tokens, True, True)]
    c.release()


def test_special_functions():
    x = np.array([1e-6, 1e-3, .1, .5, 1, 2.5, 7, 100, 1e7])
    assert np.allclose(lda.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert np.allclose(lda.digamma(x + 1), lda.digamma(x) + 1 / x, rtol=1e-10)
    assert lda.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-11)


def plain_lda(docs, n_words, k, passes, start):
    """Batch variational Bayes with all of the corpus in one place."""
    weights = start
    for _ in range(passes):
        log_beta = lda.digamma(weights) - lda.digamma(weights.sum(axis=0) if _ else np.full(k, float(n_words)))
        new = np.full((n_words, k), 1 / k)
        for words, counts in docs:
            gamma = np.full(k, 1 / k + counts.sum() / k)
            for _step in range(lda.STEPS):
                theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
                phi = theta * np.exp(log_beta[words])
                gamma = 1 / k + ((counts / phi.sum(axis=1))[:, None] * phi).sum(axis=0)
            phi = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum())) * np.exp(log_beta[words])
            np.add.at(new, words, (counts / phi.sum(axis=1))[:, None] * phi)
        weights = new
    return weights


def test_blocks_give_what_one_place_gives(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [f"w{rng.randrange(30) + 15 * (i % 3)}" for _ in range(rng.randrange(0, 25))]) for i in range(60)]
    rows += [(None, ["w1", "w2"]), (None, ["w1"]), (70, None), (71, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    whole = lda.build_corpus(df)
    monkeypatch.setattr(lda, "EDGES", (40, 80))
    monkeypatch.setattr(lda, "ENTRIES", (50, 100))
    cut = lda.build_corpus(df)
    assert whole.blocks.count() == 1 and cut.blocks.count() > 5 and whole.n_docs == 63
    fit = lda._Fit({"a": (whole, 3), "b": (cut, 3), "c": (cut, 2)})
    models = fit.models(fit.run(7, 4))
    got = {n: np.array([r.w for r in m.weights.orderBy("word_id").collect()]) for n, m in models.items()}
    assert np.allclose(got["a"], got["b"], rtol=1e-9) and got["c"].shape == (whole.n_words, 2)
    assert got["a"].sum() == pytest.approx(whole.n_tokens + whole.n_words)      # the prior is 1 / k per topic and word
    assert np.allclose(got["a"].sum(axis=0), models["a"].totals)
    docs = {}
    for r in whole.entries().collect():
        docs.setdefault(r.doc, []).append((r.word_id, r.n))
    docs = [tuple(map(np.array, zip(*d))) for d in docs.values()]
    begun = fit.blocks.filter("model = 0").select("model", "block", "words").mapInArrow(
        lda._start(fit.sizes, fit.words_a_part, 7), lda._STATE)
    start = np.array([r.w for r in fit.by_part(begun.filter("part >= 0"), lda._word_weights(fit.sizes),
                                               "model int, word_id long, w array<double>").orderBy("word_id").collect()])
    assert np.allclose(plain_lda(docs, whole.n_words, 3, 4, start), got["a"], rtol=1e-9)


def test_bound_rises_and_topics_are_found(spark):
    rng = random.Random(9)
    groups = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    rows = [(i, [rng.choice(groups[i % 3]) for _ in range(40)] + ["shared"]) for i in range(90)]
    c = lda.build_corpus(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    fit = lda._Fit({"m": (c, 3)})
    bounds = [lda.likelihood_bounds(fit, fit.run(1, n))["m"] for n in (1, 4, 12)]
    assert bounds[0] < bounds[1] < bounds[2] < 0
    top = {}
    for r in lda.fit_topics(c, 3, passes=30).terms("x", 12).collect():
        top.setdefault(r.topic, set()).add(r.word[0])
    assert sorted(map(sorted, top.values())) == [["a"], ["b"], ["c"]]
    c.release()


@pytest.fixture(scope="module")
def small_survey(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        a, c = rng.gauss(0, 1), rng.choice("xyz")
        rows.append((i, a, rng.choice([None, 1.0, 2.0]), c, None, "ip", "A.愿意" if a + (c == "x") > .3 else "B"))
    return spark.createDataFrame(rows, "id int, a double, b double, c string, e string, `IP地址` string, q string")


@pytest.fixture(scope="module")
def study(small_survey):
    return survey_study(small_survey, "q", "id", hidden=((4,), (3, 2)), penalties=(0.01, 1.0), max_iter=25)


def test_survey_study(spark, study, tmp_path):
    cells = study.candidates().collect()
    assert [(c.hidden, c.penalty) for c in cells] == [("4", 0.01), ("4", 1.0), ("3-2", 0.01), ("3-2", 1.0)]
    assert all(c.n_scored == 120 for c in cells)
    assert max(c.mean_accuracy for c in cells) == cells[study.search.best].mean_accuracy > 0.6
    report = {r.label: r for r in study.report().collect()}
    assert report["macro avg"].support == 30 and report["accuracy"].f1 > 0.6
    assert study.accuracy().first().accuracy == pytest.approx(report["accuracy"].f1)
    phi = study.attribution(n_explained=5, n_background=20).collect()
    assert {r.feature for r in phi} == {"a", "b", "c_x", "c_y", "c_z"}
    assert [r.mean_abs for r in phi] == sorted((r.mean_abs for r in phi), reverse=True)
    study.write(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/candidates"), header=True).count() == 4


@pytest.fixture(scope="module")
def network(spark, small_survey):
    df = survey.binary_target(small_survey.drop("e", "IP地址"), "q")
    built, ready = features.build_features(df, exclude=("id", "q"))
    model = Pipeline(stages=built.stages + [tuning.mlp(built.width, (4, 3), "q", 30)]).fit(ready)
    return model, PipelineModel(model.stages[:-1]).transform(ready)


def test_layer_parameters_reproduce_the_network(spark, network):
    model, ready = network
    net = tuning.final_network(model)
    rows = tuning.layer_params(spark, net).collect()
    assert len(rows) == len(net.weights)
    row = net.transform(ready).first()
    x = row.features.toArray()
    sizes = net.getLayers()
    for layer, (n_in, n_out) in enumerate(zip(sizes, sizes[1:]), 1):
        w, b = np.zeros((n_in, n_out)), np.zeros(n_out)
        for r in rows:
            if r.layer == layer and r.kind == "weight":
                w[r.from_idx, r.to_idx] = r.value
            elif r.layer == layer:
                b[r.to_idx] = r.value
        x = x @ w + b
        x = np.maximum(x, 0) if layer < len(sizes) - 1 else np.exp(x) / np.exp(x).sum()
    assert x == pytest.approx(row.probability.toArray(), abs=1e-9)
    assert {r.sheet for r in tuning.layer_sheets(tuning.layer_params(spark, net)).collect()} >= {"Layer1_Weights", "Layer3_Biases"}


@pytest.mark.parametrize("linear", [False, True])
def test_shapley_values_add_up(spark, network, linear):
    model, ready = network
    last = LogisticRegression(labelCol="q", maxIter=5).fit(ready) if linear else model.stages[-1]
    explain, background = ready.filter("id < 6"), ready.filter("id >= 20 and id < 32")
    phi = attribution.shapley_values(last, explain, background, features.feature_names(ready),
                                     permutations=3, id_col="id")
    total = {r.id: r.s for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    p = {r.id: r.probability[1] for r in last.transform(ready).collect()}
    mean = np.mean([p[i] for i in range(20, 32)])
    assert total == {i: pytest.approx(p[i] - mean, abs=1e-9) for i in range(6)}


def test_best_cell_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("b", .5), ("a", .4), ("a", .6), ("c", .1)], "cell string, accuracy double")
    assert tuning.best_cell(df).first().cell == "a"


def test_review_study(spark, tmp_path):
    rng = random.Random(2)
    good, bad = "好喝 喜欢 满意 包装 物流 快".split(), "差 难吃 失望 包装 物流 慢".split()
    rows = [(i, f"c{i}", " ".join(rng.choice(good if i % 2 else bad) for _ in range(8)), 5 if i % 2 else 1, i % 2)
            for i in range(60)] + [(100, "c100", "!!", None, None), (101, "c101", "!!", 5, None)]
    df = spark.createDataFrame(rows, "doc_id int, comment_id string, content string, score int, label int")
    study = review_study(df, as_stopwords(spark, ["快"]), script=r"一-龥 ", keep=["label"])
    assert study.counts().first().n_reviews == 61
    model = sentiment.fit_naive_bayes(study.tokens)
    study.write(str(tmp_path / "r"), model)
    acc = spark.read.csv(str(tmp_path / "r/accuracy"), header=True, inferSchema=True).first().accuracy
    assert acc > 0.9
    assert spark.read.text(str(tmp_path / "r/topics"), wholetext=True).count() == 1
    comments = df.withColumn("comment_type", F.when(F.col("score") == 5, "好评").otherwise("差评"))
    write_keyword_topics(comments, as_stopwords(spark, ["快"]), str(tmp_path / "k"))
    from revana.sources.topics import read_topic_document, topic_word_lists
    lists = topic_word_lists(read_topic_document(spark, str(tmp_path / "k"))).collect()
    assert len(lists) == 12 and all("快" not in r.words for r in lists)


def test_registered_models(spark):
    rows = entry.queries()["lda_topics"](spark, SF).collect()
    assert len(rows) == 8
    for cls in {r.cls for r in rows}:
        words = [w for r in rows if r.cls == cls for w in r.topic_string.split(" + ")]
        assert len({w.split("*")[1] for w in words}) == len(words)


def test_blocks_are_few_and_share_their_words(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)]) for i in range(400)]
    monkeypatch.setattr(lda, "EDGES", (10, 1 << 22))
    c = lda.build_corpus(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    assert 2 <= c.n_blocks <= 9 and c.n_entries < 3 * c.n_words
    c.release()
