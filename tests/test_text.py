import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revana.functions import scores, text as T
from revana.operators.dedup import dedup_first
from revana.operators.tokens import remove_stopwords, tokenize
from revana.operators import terms


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_keep_script(spark):
    assert one(spark, "好a 评!一龥x", T.keep_script) == "好评一龥"
    assert one(spark, None, T.keep_script) == ""
    assert one(spark, "ab-cd", lambda c: T.keep_script(c, "a-z", " ")) == "ab cd"


def test_controls(spark):
    s = "".join(map(chr, range(32))) + "z"
    assert one(spark, s, T.without_controls) == "\t\n\rz"
    df = spark.createDataFrame([("a\x00", 1)], "`s.t` string, n int")
    assert tuple(T.strip_controls(df).first()) == ("a", 1)


@pytest.mark.parametrize("value", [" a b　c\x1cd\n", "", "  ", "one", "a  b"])
def test_blanks_split_like_python(spark, value):
    assert one(spark, value, T.split_blanks) == value.split()


def test_tokens(spark):
    assert one(spark, "Ab, ÇD\n好x1", T.letter_tokens) == ["ab", "çd", "好x"]
    assert one(spark, "Ab,\n1", T.raw_tokens) == ["ab", ",", "\n", "1"]
    assert one(spark, "好评a不错的", T.ngram_tokens) == ["好评", "不错", "错的"]
    assert one(spark, None, T.letter_tokens) == []
    df = spark.createDataFrame([(1, "x y")], "doc_id int, content string")
    custom = tokenize(df, custom=lambda c: F.split(c, " ")).first()
    assert custom.tokens == ["x", "y"]
    with pytest.raises(ValueError):
        tokenize(df, mode="other")


def lexicon_brute(t, words):
    t, i, out = t or "", 0, []
    while i < len(t):
        n = max([len(w) for w in words if t.startswith(w, i)] + [1])
        out.append(t[i:i + n])
        i += n
    return out


@pytest.mark.parametrize("chars", [100, 2])
def test_lexicon_walk(spark, chars):
    rng = random.Random(1)
    words = ["ab", "abc", "bca", "cc", "好评", "不错a", "a😀", "b"]
    texts = ["".join(rng.choice("abcc😀好评不错\n") for _ in range(rng.randint(0, 60)))
             for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, content string, tokens string")
    lex = spark.createDataFrame([(w,) for w in [*words, *words, None, ""]], "word string")
    from revana.operators.lexicon import lexicon_tokens
    got = {r.doc_id: r.tokens for r in lexicon_tokens(df, lex, broadcast_chars=chars).collect()}
    assert got == {i: lexicon_brute(t, words) for i, t in enumerate(texts)}
    nothing = lexicon_tokens(df, lex.limit(0), broadcast_chars=chars).filter("doc_id = 0").first()
    assert nothing.tokens == list(texts[0])


@pytest.mark.parametrize("size", [50_000, 500_000])
def test_lexicon_of_dictionary_size(spark, size):
    from revana.operators.lexicon import lexicon_tokens
    rng = random.Random(size)
    letters = [chr(0x4e00 + i) for i in range(900)]
    words = {"".join(rng.choices(letters, k=rng.choice([2, 2, 2, 3, 3, 4, 7]))) for _ in range(size)}
    some = sorted(words)[::97]
    texts = ["".join(rng.choice(some) if rng.random() < 0.6 else rng.choice(letters) for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    lex = spark.createDataFrame(pd.DataFrame({"word": sorted(words)}))
    found = lexicon_tokens(df, lex)
    by_size = {n: {w for w in words if len(w) == n} for n in (7, 4, 3, 2)}

    def plain(text):
        out, at = [], 0
        while at < len(text):
            n = next((n for n, own in by_size.items() if text[at:at + n] in own and at + n <= len(text)), 1)
            out.append(text[at:at + n])
            at += n
        return out

    assert {r.doc_id: r.tokens for r in found.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_stop_words_inline_and_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["b"]), (3, [])],
                               "doc_id int, tokens array<string>")
    stop = spark.createDataFrame([("b",), ("x",), ("b",)], "word string")
    want = {1: ["a", "a", "c"], 2: [], 3: []}
    run = lambda s: {r.doc_id: r.tokens for r in remove_stopwords(df, s).collect()}
    assert run(stop) == run(["b", "x"]) == want
    monkeypatch.setattr("revana.operators.tokens.INLINE_STOPWORDS", 1)
    assert run(stop) == run(["b", "x"]) == want


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(3, "a"), (1, "a"), (2, None), (5, None), (4, ""), (9, "b")]
    df = spark.createDataFrame(rows, "doc_id int, content string")
    once = dedup_first(df)
    assert sorted(r.doc_id for r in once.collect()) == [1, 2, 4, 9]
    assert sorted(r.doc_id for r in dedup_first(once).collect()) == [1, 2, 4, 9]
    with pytest.raises(ValueError):
        dedup_first(df, order="absent")


def test_one_text_in_most_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("content"))
    assert dedup_first(df.repartition(8)).count() == 10_001


@pytest.mark.parametrize("value,number", [
    ("5", 5), (" 3.5 ", 3.5), ("-1e2", -100), (".5", .5), ("5.", 5), ("x", 0), ("", 0), (None, 0),
    ("1d", 0), ("0x1", 0), ("5 6", 0)])
def test_coercion(spark, value, number):
    assert one(spark, value, scores.to_number) == number


@pytest.mark.parametrize("score,cls,label", [
    (5, "好评", "positive"), (4, "好评", "positive"), (3.5, "差评", "neutral"),
    (3, "中评", "neutral"), (2.5, "差评", "neutral"), (2, "差评", "negative"), (0, "差评", "negative")])
def test_score_rules(spark, score, cls, label):
    assert one(spark, float(score), scores.comment_class, "double") == cls
    assert one(spark, float(score), scores.true_label, "double") == label


@pytest.mark.parametrize("s,label", [(.21, "positive"), (.2, "neutral"), (.05, "neutral"), (.049, "negative")])
def test_predicted_label(spark, s, label):
    assert one(spark, s, scores.predicted_label, "double") == label


def test_sentiment_transform(spark):
    assert one(spark, 0.5, scores.sharpen, "double") == 0.5
    assert one(spark, 0.1, scores.sharpen, "double") == pytest.approx(.1**.5 / (.1**.5 + .9**.5))
    assert one(spark, 0.0, scores.sharpen, "double") == 0 and one(spark, 1.0, scores.sharpen, "double") == 1


def test_graph(spark):
    docs = [(1, ["aa", "bb", "aa"]), (2, ["bb", "aa"]), (3, ["cc"]), (4, ["bb", "z", "dd"]), (5, [])]
    df = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    wf = terms.meaningful(terms.word_frequency(df))
    edges = {(r.src, r.dst): r.weight for r in terms.cooccurrence_edges(df, wf, 3).collect()}
    assert edges == {("aa", "bb"): 4}
    assert [(r.word, r["size"]) for r in terms.cooccurrence_nodes(wf, 3).collect()] == [
        ("aa", 3), ("bb", 3), ("cc", 1)]
    assert [r.word for r in terms.meaningless(terms.word_frequency(df)).collect()] == ["z"]
    # More than there are words: the cap that once raised an error here is gone.
    every = {(r.src, r.dst): r.weight for r in terms.cooccurrence_edges(df, wf, 10_000).collect()}
    assert every == {("aa", "bb"): 4, ("bb", "dd"): 2}


def test_large_lexicon_meets_distinct_pieces_only(spark, monkeypatch):
    from revana.operators import lexicon
    met = []
    match = lexicon._match
    monkeypatch.setattr(lexicon, "_match", lambda df, *rest: met.append(df.count()) or match(df, *rest))
    words = ["ab", "abc", "cd", "bcd", "x\ny"]
    texts = ["abc abcd  cd-ab", "abcd x\nyx", None, "", "zab"] * 40
    ids = [None if i % 3 else i % 4 for i in range(len(texts))]                # ids repeat or are null
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id int, content string")
    lex = spark.createDataFrame([(w,) for w in words], "word string")
    for limit in (3, 0):                            # the cut pieces go to all tasks, or are joined
        got = lexicon.lexicon_tokens(df, lex, broadcast_words=limit).collect()
        assert sorted((str(r.doc_id), str(r.content), r.tokens) for r in got) == sorted(
            (str(i), str(t), lexicon_brute(t, words)) for i, t in zip(ids, texts))
    assert met == [1, 1]                            # of the pieces only "abcd" is no word


def test_tokens_leave_in_slices_of_bounded_text(monkeypatch):
    import pyarrow as pa
    from revana.operators import lexicon
    monkeypatch.setattr(lexicon, "SLICE", 1000)
    texts = ["é" * (i % 300) for i in range(500)] + [None, "", "a" * 5000, "b"]
    parts = list(lexicon._slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), "t"))
    assert [t for _, part in parts for t in part] == texts and all(len(b) == len(t) > 0 for b, t in parts)
    assert all(len(t) == 1 or sum(len((x or "").encode()) for x in t) <= 1000 for _, t in parts) and len(parts) < 200
