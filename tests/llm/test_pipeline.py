"""Each stage against what it should do to the stage before's rows."""

import duckdb
import pytest

import corpus_pipeline
from tielace.llm import mixing, packing, pii
from tielace.llm.base import Scratch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark):
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(scratch.save(stage(spark, found[-1], SMALL)))
    return found


def test_columns(states):
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in states[:-1])


def test_language_stage_keeps_clean_documents(spark, states):
    before, after = (s.count() for s in states[:2])
    assert after >= before - 2
    junk = spark.createDataFrame([(1, "12345 ### !!", None, "s", 12), (2, None, None, "s", 0), (3, "of the and the in that was", None, "s", 26)], states[0].schema)
    got = corpus_pipeline.known_language(spark, states[0].unionByName(junk.withColumn("doc_id", junk.doc_id + 10**6)), SMALL)
    kept = {r["doc_id"]: r["lang"] for r in got.filter("doc_id > 1000000").collect()}
    assert kept == {10**6 + 3: "en"}


def test_pseudonym_stage(states):
    names = pii.Pseudonyms()
    want = sorted((r["doc_id"], t := pii.pseudonymise(r["text"], names)[0], r["lang"], r["source"], len(t)) for r in states[2].collect())
    assert sorted(tuple(r) for r in states[3].collect()) == want


def test_mixing_stage(states):
    documents = states[3].toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(mixing.OP2_SQL).select("doc_id", "text").fetchall()
    assert sorted(tuple(r) for r in states[4].select("doc_id", "text").collect()) == sorted(want)


def test_packing_stage(spark, states):
    rows = states[5].collect()
    once = packing.pack_documents(states[4], corpus_pipeline.tokens.public_file("byte_bpe_50k.json"))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted(tuple(r) for r in once.select("doc_id", "piece", "ids_crc32").collect())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert (p == 0) if s != t else (p == o + n)
    assert sum(r["piece"] == 0 for r in rows) == states[4].count()


def test_run_is_the_stages(spark, states):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in states[5].collect())


def test_run_on_nothing_and_on_nulls(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (None, "of the and in that", "en", None, 18), (3, "of the and in that was", None, "a", 22)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in got} <= {None, 3} and not (name == "none" and got)


def test_stages_take_columns_that_clash(spark, states):
    docs = states[0].limit(60)
    more = docs.withColumns({c: docs.doc_id for c in ("spans", "copy", "score")})
    more = more.toDF(*more.columns[:-2], "TEXT", "Doc_Id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, SMALL)
        assert got.columns == list(corpus_pipeline.COLUMNS) and got.count() >= 0
    assert corpus_pipeline.packed(spark, more, SMALL).count() >= 60
