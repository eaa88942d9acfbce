"""The ingest sequence follows files and places, however a scan cuts them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from revana.operators.dedup import dedup_first
from revana.operators.sequence import number_rows, origin
from revana.plans.collect import collect_comments
from revana.plans.reviews import review_study
from revana.sources.pages import parse_comment_pages, read_pages
from revana.sources.tables import read_comments


@pytest.fixture
def pages(tmp_path):
    """Files of very different size, bad pages among the good; the comments in order."""
    rng, wanted = random.Random(1), []
    (tmp_path / "pages").mkdir()
    for name in ("b.txt", "a.txt", "c/d.txt", "z.txt", "empty.txt"):
        lines = []
        for _ in range({"b.txt": 900, "a.txt": 3, "c/d.txt": 40, "z.txt": 0, "empty.txt": 2}[name]):
            comments = [{"content": f"{name} {rng.random()}", "score": rng.randrange(6)} for _ in range(rng.randrange(5))]
            for c in comments:
                if rng.random() < 0.5:
                    c["id"] = rng.randrange(5)
            bad = name == "empty.txt" or rng.random() < 0.2
            lines.append(f"fetchJSON_comment98({json.dumps({'comments': comments})}{' junk' if bad else ''});")
            wanted += [(name, c["content"]) for c in comments if not bad]
        path = tmp_path / "pages" / name.replace("/", "-")
        path.write_text("\n".join(lines))
    wanted.sort(key=lambda r: r[0].replace("/", "-"))
    return str(tmp_path / "pages"), [c for _, c in wanted]


@pytest.mark.parametrize("piece", ["128m", "3k"])
def test_comments_are_numbered_by_file_and_place(spark, pages, piece):
    folder, wanted = pages
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        found = parse_comment_pages(read_pages(spark, folder, one_per_line=True), seq="seq").collect()
        plain = parse_comment_pages(read_pages(spark, folder, one_per_line=True))
        assert plain.columns == ["comment_id", "content", "creation_time", "score", "comment_type"]
        whole = plain.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.seq for r in found) == list(range(len(wanted))) and whole == len(wanted)
    assert [r.content for r in sorted(found, key=lambda r: r.seq)] == wanted


def test_pages_in_files_of_their_own(spark, tmp_path):
    for i in range(30):
        comments = [{"id": 1, "content": f"{i} {k}"} for k in range(i % 4)]
        (tmp_path / f"p{i:02}.txt").write_text(f"fetchJSON_comment98({json.dumps({'comments': comments})})")
    found = parse_comment_pages(read_pages(spark, str(tmp_path)), seq="n").collect()
    assert [r.content for r in sorted(found, key=lambda r: r.n)] == [f"{i} {k}" for i in range(30) for k in range(i % 4)]


def test_array_and_line_files_are_numbered(spark, tmp_path):
    rows = [{"comment_id": "x", "content": str(i), "score": None if i % 2 else 4} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "lines").mkdir()
    for k in range(5):
        (tmp_path / "lines" / f"{k}.json").write_text("\n".join(map(json.dumps, rows[10 * k:10 * k + 10])))
    for path, array in (("a.json", True), ("lines", False)):
        found = read_comments(spark, str(tmp_path / path), array, seq="file").collect()
        assert sorted((r.seq, r.content, r.score) for r in found) == [(i, str(i), 0 if i % 2 else 4) for i in range(50)]
    assert "seq" not in read_comments(spark, str(tmp_path / "lines")).columns
    with pytest.raises(ValueError, match="seq"):
        read_comments(spark, str(tmp_path / "lines"), seq="other")


def test_collected_stores_keep_the_first_of_equal_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, comments in (("1", [{"id": 9, "content": "same", "score": 1}, {"content": "own", "score": 5}]),
                           ("2", [{"id": 1, "content": "same", "score": 5}, {"content": "same", "score": 4}, {"id": 1, "content": "more"}])):
        (tmp_path / "in" / f"{name}.txt").write_text(f"fetchJSON_comment98({json.dumps({'comments': comments})})")
    for fmt in ("json", "parquet"):
        out = str(tmp_path / fmt)
        collect_comments(spark, str(tmp_path / "in"), out, fmt=fmt)
        comments = read_comments(spark, out, seq="stored") if fmt == "json" else spark.read.parquet(out)
        kept = dedup_first(comments, "content", "seq").collect()
        assert sorted((r.seq, r.comment_id, r.content, r.score) for r in kept) == [
            (0, "jd9", "same", 1), (1, "jd", "own", 5), (4, "jd1", "more", 0)]
    study = review_study(read_comments(spark, str(tmp_path / "json"), seq="stored"), order="seq")
    assert study.counts().first().n_reviews == 3 and study.reviews.count() == 5


def test_shuffled_rows_and_empty_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{i}" for i in range(500)))
    (tmp_path / "b.txt").write_text("\n".join(f"{i}" for i in range(500)))
    rows = spark.read.text(str(tmp_path)).select("value", *origin())
    with pytest.raises(ValueError, match="shuffled"):
        number_rows(rows.repartition(4, "value"))
    assert number_rows(rows.filter("value IS NULL")).count() == 0
    odd = number_rows(rows.filter(F.col("value") % 2 == 1)).collect()
    assert [r.value for r in sorted(odd, key=lambda r: r.seq)] == [str(i) for i in range(1, 500, 2)] * 2
