"""The benchmark of the stopword detector on odd documents, against its SQL in DuckDB."""

import duckdb

from veriglot.plans.queries import ORACLE_SQL, QUERIES

EN, ES = "the cat and the dog of the house", "el gato de la casa y el perro"


def test_odd_documents(spark, tmp_path):
    """Blank and null texts, null languages, repeated and null ids, and a share that decimal digits round another way."""
    told = [(i, EN if i < 41 else ES, "en") for i in range(640)]
    odd = [(700, EN, None), (701, ES, None), (702, "", "es"), (703, None, "es"), (704, " \n\u00a0\u2003", "fr"), (705, ES, "es"), (705, EN, "nl"), (705, None, "nl"), (705, ES, "nl"), (None, ES, "es"), (706, "of", "de")]
    spark.createDataFrame([*told, *odd], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["detector_benchmark"](spark, str(tmp_path))
    columns = ["expected", "n", "correct", "accuracy", "average_confidence"]
    assert found.columns == columns and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['detector_benchmark']})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert ("en", 640, 41, 0.064062) in [r[:4] for r in want] and (None, 2, 0, None) in [r[:4] for r in want] and {r[0] for r in want} == {None, "en", "es", "nl", "de"}
