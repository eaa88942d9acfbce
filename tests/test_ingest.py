import json

import pytest
from pyspark.errors import AnalysisException

from revana.plans.collect import collect_comments, export_comments
from revana.sources.pages import parse_comment_pages
from revana.sources.stopwords import load_stopwords
from revana.sources.tables import default_score, read_comments, read_table, write_comments
from revana.sources.topics import read_topic_document, topic_strings, topic_word_lists
from revana.streaming.pages import stream_comments


def page(*comments, **extra):
    return f"fetchJSON_comment98({json.dumps({'comments': list(comments), **extra})});"


def parse(spark, *bodies, **kw):
    return parse_comment_pages(spark.createDataFrame([(b,) for b in bodies], "value string"), **kw)


def test_fields_defaults_and_classes(spark):
    rows = parse(spark, page(
        {"id": 1, "content": "a) b\n(c", "creationTime": "2024", "score": 5},
        {"id": "x", "score": 3}, {"content": "t", "score": 3.5}, {"id": 4},
        {"id": 5, "score": None}, {"id": 6, "score": "4"}, {"id": 7, "score": "bad"})).collect()
    assert [r.comment_id for r in rows] == ["jd1", "jdx", "jd", "jd4", "jd5", "jd6", "jd7"]
    assert [r.score for r in rows] == [5, 3, 3.5, 0, 0, 4, 0]
    assert [r.comment_type for r in rows] == ["好评", "中评", "差评", "差评", "差评", "好评", "差评"]
    assert rows[0].content == "a) b\n(c" and rows[1].content == "" and rows[1].creation_time == ""


@pytest.mark.parametrize("body", [
    "no callback", "other({\"comments\":[{\"id\":1}]})", 'fetchJSON_comment98({"comments":[{"id":1}]',
    'fetchJSON_comment98({"comments":[{"id":1})', 'fetchJSON_comment98({"comments":[{"id":1}]} x)',
    'fetchJSON_comment98({"comments":[{"id":1}]}{"a":1})', 'fetchJSON_comment98({"comments":[{"id":1}]},{})',
    'fetchJSON_comment98({"comments":[{"id":1}]}],[{})', 'fetchJSON_comment98({"comments":[{"id":1}]}} x)',
    "fetchJSON_comment98({'comments':[{'id':1}]})", 'fetchJSON_comment98({"comments":[{"id":1},]})',
    'fetchJSON_comment98({"comments":\n[{"id":1}]})', 'fetchJSON_comment98({"comments":[]})',
    "fetchJSON_comment98({})", "fetchJSON_comment98()", 'fetchJSON_comment98([1,2])'])
def test_bad_pages_yield_nothing_and_spoil_nothing(spark, body):
    rows = parse(spark, body, page({"id": 9})).collect()
    assert [r.comment_id for r in rows] == ["jd9"]


def test_callback_and_prefix_are_parameters(spark):
    rows = parse(spark, 'cb.x({"comments":[{"id":1}]})', callback="cb.x", id_prefix="q").collect()
    assert rows[0].comment_id == "q1"


def test_collect_and_export(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for i in range(3):
        (tmp_path / "pages" / f"p{i}.txt").write_text(
            page({"id": i, "content": f"c{i}\x07\tend", "score": i + 2}), encoding="utf-8")
    collect_comments(spark, str(tmp_path / "pages"), str(tmp_path / "out"))
    export_comments(spark, str(tmp_path / "out"), str(tmp_path / "table"))
    rows = read_table(spark, str(tmp_path / "table")).orderBy("comment_id").collect()
    assert [r.content for r in rows] == ["c0\tend", "c1\tend", "c2\tend"]
    collect_comments(spark, str(tmp_path / "pages"), str(tmp_path / "store"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "store")).filter("comment_type = '好评'").count() == 1


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        export_comments(spark, str(tmp_path / "none"), str(tmp_path / "t"))


def test_comment_array_file_and_absent_scores(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(
        [{"comment_id": "1", "content": "好", "score": 5}, {"comment_id": "2"}], ensure_ascii=False))
    rows = read_comments(spark, str(tmp_path / "a.json"), array_file=True).orderBy("comment_id").collect()
    assert [(r.content, r.score) for r in rows] == [("好", 5.0), (None, 0.0)]
    df = spark.createDataFrame([("1",)], "comment_id string")
    assert default_score(df).first().score == 0
    write_comments(df, str(tmp_path / "w"))
    write_comments(df, str(tmp_path / "w"))       # overwrites
    assert read_comments(spark, str(tmp_path / "w")).count() == 1


def test_stop_word_files(spark, tmp_path):
    f = tmp_path / "stop.txt"
    f.write_text("的\n \n 是\t\n了 \n\\n\n的\n", encoding="utf-8")
    words = lambda **kw: {r.word for r in load_stopwords(spark, str(f), **kw).collect()}
    assert words() == {"的", "是", "了", "\\n"}
    assert words(trim=False) == {"的", " ", " 是\t", "了 ", "\\n"}
    assert load_stopwords(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(AnalysisException):
        load_stopwords(spark, str(tmp_path / "none"), trim=False)


def test_topic_documents(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text(json.dumps({"p": {"topic_0": "0.1*'好'"}, "n": {}}, ensure_ascii=False, indent=4))
    doc = read_topic_document(spark, str(f))
    assert [tuple(r) for r in topic_strings(doc).collect()] == [("p", "topic_0", "0.1*'好'")]
    assert topic_strings(doc, {"absent": "x"}).count() == 0
    f.write_text(json.dumps({"p": {"Topic_1": ["a", "b"]}}))
    assert topic_word_lists(read_topic_document(spark, str(f))).first().words == ["a", "b"]


def test_stream_takes_new_pages_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text(page({"id": i, "score": 5}))
        stream_comments(spark, inbox, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1
