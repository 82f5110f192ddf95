import numpy as np

from loomspark.llm import lang_ecoc


def test_fit_takes_600_rows_of_whole_texts(spark, monkeypatch):
    rows = spark.range(1500).selectExpr("id AS doc_id", "concat(CAST(id AS STRING), repeat(' ab', 8000), ' zq') AS text", "IF(id % 2 = 0, 'x', 'y') AS lang")
    found = []
    monkeypatch.setattr(lang_ecoc, "fit", lambda x, langs: found.append((x, langs)))
    lang_ecoc.fit_sample(rows)
    (x, langs), = found
    assert sorted(langs) == ["x"] * 600 + ["y"] * 600
    end = np.frombuffer(b"zq", np.uint8)  # behind the first 20,000 bytes
    bucket = np.flatnonzero(lang_ecoc.features(end, np.array([0, 2])))
    assert (x[:, bucket] > 0).all()
