"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from tielace.llm import dac, itq, langid, mixing, packing, pii, repeats, similar, simhash, topk, urlfilter
from tielace.llm.base import Scratch, tidy
from tielace.llm.tokens import public_file

LONG = "word " * 60_000
ROWS = [(1, "the cat sat on the mat", "en", "a", 22), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, LONG, "en", "a", len(LONG)), (None, "no id here", "en", "b", 10), (1, "the cat sat on the mat", "en", "a", 22), (6, "12 ## !!", "en", "b", 8)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with added and own ones."""
    frame = spark.createDataFrame([(*r, 7, 8, 9, 10, 11, "x", 12) for r in ROWS], COLUMNS + ", copy int, spans int, score int, n_bytes int, component_id int, TEXT string, doc int")
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


BYTE, WORD = public_file("byte_bpe_50k.json"), public_file("word_bpe_49k.json")


def test_tidy_keeps_all_columns_under_distinct_names(docs):
    names = tidy(docs, ("doc_id", "text"), ("copy",)).columns
    assert len(names) == len({n.lower() for n in names}) == len(docs.columns)
    assert {"text", "doc_id", "copy__in2", "TEXT__in2"} <= set(names)


def test_pii(docs, none):
    got = pii.pseudonymise_documents(docs).collect()
    assert len(got) == len(ROWS)
    assert [r["spans"] for r in got if r["text"] is None] == [None]
    assert {r["text"] for r in got} == {r[1] for r in ROWS}
    assert pii.pseudonymise_documents(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert {r["text"] for r in got} <= {r[1] for r in ROWS}
    # Both rows of doc 1 come equally often; the source without text has rate 0.
    one = [r["copy"] for r in got if r["doc_id"] == 1]
    assert all(one.count(c) == 2 for c in one)
    assert not [r for r in got if r["source"] is None]
    assert mixing.mix(none).count() == 0


def test_mixing_of_rows_without_ids(spark):
    """Null and equal ids draw by their texts, so the mean is met; a rate far above one is met in blocks of copies."""
    rows = spark.range(6000).selectExpr("if(id % 2 = 0, null, 7L) doc_id", "concat('text number ', id + 10000) text", "'a' source")
    got = mixing.mix(rows, {"a": 1.0}, epochs=2.0)
    assert got.count() == pytest.approx(12_000, rel=0.05)
    assert got.select("shuffle_key").distinct().count() == got.count()
    one = spark.createDataFrame([(1, "x", "small"), (2, "y" * 4000, "large")], "doc_id long, text string, source string")
    copies = [r["copy"] for r in mixing.mix(one, {"small": 1.0, "large": 1.0}).filter("source = 'small'").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1)) and 1700 < len(copies) < 2300
    assert all(p < 1.5 * 12_000 / got.rdd.getNumPartitions() for p in got.groupBy(F.spark_partition_id()).count().toPandas()["count"])


def test_packing(docs, none):
    got = packing.pack_documents(docs, BYTE).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] in (2, 3)) == [1, 1]
    assert len([r for r in got if r["doc_id"] == 1]) == 2
    assert sum(r["length"] for r in got if r["doc_id"] == 4) > 60_000
    assert packing.pack_documents(none, BYTE).count() == 0


def test_token_files(spark, docs, none):
    for frame, n in ((docs, len(ROWS)), (none, 0)):
        folder = f"{Scratch(spark, 'edges').root}/ids"
        dac.write_ids(frame, folder, WORD)
        got = dac.read_ids(spark, folder).orderBy("start").collect()
        assert len(got) == n
    assert got == []


def test_token_files_order(spark, docs):
    folder = f"{Scratch(spark, 'edges').root}/ids"
    dac.write_ids(docs, folder, WORD)
    got = dac.read_ids(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 6]
    assert [r["n_tokens"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM?x=://b/en/", "ftp://x.com:80/en/7#y", "http://example.com/en/7", "http://EXAMPLE.net/de/81", "http://net/de/1", "http://notexample.net/de/8"]
    frame = spark.createDataFrame([(i, u, None, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, _host int")
    got = {r["page_id"]: r for r in urlfilter.judge(frame).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(6)] == [("", "")] * 4 + [("a.example.com", ""), ("x.com:80", "/en/7")]
    assert [got[i]["rule"] for i in (6, 7, 8, 9)] == ["example.com/en/7", "example.net/de/8", "net/de/", "net/de/"]
    assert [got[i]["verdict"] for i in (6, 7, 8, 9)] == ["allow", "block", "allow", "allow"]
    assert urlfilter.judge(frame.limit(0)).count() == 0


def test_language(spark, docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert {got[i]["lang_pred"] for i in (2, 3, 6)} == {"und"} and got[2]["score"] == 0
    assert got[4]["lang_pred"] == "en" and 0 <= got[4]["score"] <= 1
    assert langid.identify(none).count() == 0
    unlabelled = spark.createDataFrame(ROWS, COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3)} == {"0" * 16}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_similar(docs, none):
    got = sorted((r["doc_id"] or 0) for r in similar.drop_near_duplicates(docs).collect())
    assert got == [0, 1, 2, 4, 6]
    assert similar.drop_near_duplicates(none).count() == 0


def test_rows_that_share_an_id(spark):
    """Two texts under one id, and many rows without one."""
    rows = [(7, "the cat sat on the mat today"), (7, "quite another text stands here"), (9, "the cat sat on the mat today")] + [(None, f"row number {i} of many") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert len(prints) == len(rows) and {r[2] for r in prints if r[0] == 9} == {7}
    assert len([r for r in similar.drop_near_duplicates(frame).collect() if r["doc_id"] == 7]) == 2
    folder = f"{Scratch(spark, 'edges').root}/shared"
    dac.write_ids(frame, folder, WORD)
    got = dac.read_ids(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 50 + [7, 7, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


VECTORS = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (10, [float("inf"), 0.0], 1), (11, [], 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*v, 5, "y") for v in VECTORS], "vec_id long, embedding array<float>, label int, n_links int, EMBEDDING string")


def test_embedding_near_duplicates(vectors):
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(vectors).collect()]
    assert len(got) == len(VECTORS)
    assert sorted(g for g in got if g[0] in (0, 1, 2)) == [(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (2, 3, 0, False)]
    assert all(g[1:] == (0, g[0], True) for g in got if g[0] is not None and g[0] > 2)
    assert [g[1:] for g in got if g[0] is None] == [(0, None, False)]
    assert itq.near_duplicates(vectors.limit(0)).count() == 0


def test_top_k(vectors):
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=3).collect())
    assert got == [(0, 1, 2, 131072), (0, 2, 1, 65536), (0, 3, 7, 65536)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeats(spark, docs, none):
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(ROWS) and "n_bytes__in2" in got[0].asDict()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_removed"] == len(LONG) and by[4]["n_spans"] == 1 and by[4]["kept"] == b""
    assert by[1]["n_removed"] == 0 and by[2]["n_bytes"] == 0
    assert repeats.remove_repeats(none).count() == 0
    rows = spark.createDataFrame([(1, "é" * 150), (1, "é" * 150), (None, "abc" * 100)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(rows).collect()) == [(300, 300)] * 3


def test_narrow_ids(spark):
    """An int doc_id is taken like a long one."""
    rows = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (None, "")], "doc_id int, text string")
    assert sorted(str(r["component_id"]) for r in simhash.near_duplicates(rows).collect()) == ["1", "1", "None"]
    assert packing.pack_documents(rows, BYTE).count() == 3
    folder = f"{Scratch(spark, 'edges').root}/narrow"
    dac.write_ids(rows, folder, WORD)
    assert [r["doc_id"] for r in dac.read_ids(spark, folder).orderBy("start").collect()] == [None, 1, 2]
