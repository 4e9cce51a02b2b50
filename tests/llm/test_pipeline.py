import os

import pytest

import corpus_pipeline
from ontoflow.llm import queries

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_filters_keep_columns_and_clean_rows(spark, tmp_path):
    clean = [(i, " ".join(f"some{i} words{i * 7 + k} follow{k}" for k in range(40)), "en", "s", 9) for i in range(30)]
    passage = "some words follow some follow words words some follow follow words some"
    rows = [*clean, (50, clean[3][1], "en", "s", 9), (51, "?! 12", "en", "s", 9), (52, f"{passage} and more", "en", "s", 9), (None, None, None, None, None)]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = docs(spark, rows)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in out.collect()})
    assert kept[0] == {r[0] for r in rows}
    assert kept[1] == kept[0] - {51, None} and kept[2] == kept[1] - {50} and kept[3] == kept[2] - {52}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_stage_rejects_what_is_in_no_learnt_language(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "QmFzZTY0IGVuY29kaW5nIG9mIHNvbWUgcmFuZG9tIHRleHQgdGhhdCBpcyBsb25nIGVub3VnaA",
        "xkcd qwrt zxcvb mnbvc lkjhg fdsq wrtp ghjk", "12 345 ?!", "", None,
    ]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(foreign)], "doc_id long, text string")
    docs = known.unionByName(more, allowMissingColumns=True)
    kept = corpus_pipeline.drop_unknown_language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000000").count() == 0
    assert kept.count() == known.where("text RLIKE '[A-Za-z]'").count()


def test_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kind = "doc_id long, text string, lang string, toxic_score string, lang_pred string, lang_score string, found string, _key string, _kept_id string, _row string"
    row = (1, "a few words of a text", "en", *"abcdefg")
    for rows in ([], [row, row, (2, None, "en", *"abcdefg")]):
        out = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == [x.split()[0] for x in kind.split(", ")]
        assert [tuple(r) for r in out.collect()] == rows[:1]
        assert corpus_pipeline.pack(spark, out, str(tmp_path)).select("doc_id").distinct().count() == len(rows[:1])


def test_pack_gives_the_ids(spark):
    import zlib

    rows = [(i, f"document {i} has words. " * (60_000 if i == 1 else 30), "en", "s", 9) for i in range(4)]
    got = corpus_pipeline.pack(spark, docs(spark, rows), "").collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    for i in range(4):
        assert sum(r.length for r in got if r.doc_id == i) == next(r.doc_tokens for r in got if r.doc_id == i)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_url_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    q = queries.queries()["op1_url_filter"](spark, SF)
    want = con.execute(f"select {', '.join(q.columns)} from ({queries.oracle_sql()['op1_url_filter']})").fetchall()
    assert sorted(map(str, map(tuple, q.collect()))) == sorted(map(str, want))
