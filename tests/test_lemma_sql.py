"""Lemmas against their SQL where the lexicon has several forms of a word."""

import duckdb

from fernspan.plans import q_text


def test_words_with_several_known_forms(spark, tmp_path):
    rows = [(i, "ladies ladie lady flies flie fly movies movie movy axes axe ax") for i in range(3)] + [(3, "boxes box"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q_text.lemma_table(spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(c.sql(q_text.ORACLES["lemma_table"]).fetchall())
    assert got == want
