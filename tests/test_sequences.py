"""Documents as DNA strings, against plain Python."""

from varloom.plans import inputs


def test_sequences_are_made_without_a_regular_expression(spark, tmp_path):
    texts = ["Abz Z", "", None, "a\0b\n\tc", "é ſK", "1234", "x😀y   Z", "AZ az" * 3, "日本 go"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = inputs.sequences(spark, str(tmp_path))
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()
    base = {**{chr(65 + i): "ACGT"[i % 4] for i in range(26)}, " ": "N"}
    base |= {c.lower(): b for c, b in base.items()}
    expected = {i: None if t is None else "".join(base.get(c, "") for c in t) for i, t in enumerate(texts)}
    assert {r.chrom: r.seq for r in made.collect()} == expected
