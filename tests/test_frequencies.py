"""Allele frequencies: lines that are made and split once, ranks without a shuffle of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from varloom.operators import variants as vt
from varloom.sources import readers


def test_a_line_is_split_once(spark):
    text = F.concat(F.col("id").cast("string"), F.lit("\t"), F.col("id").cast("string"), F.lit("\t2\t20\tA:0.25\tG:0.75"))
    made = readers.parse_freq(spark.range(5).select(text.alias("value")))
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    # One place makes the line, one splits it; the others cut allele and frequency.
    assert optimized.count("A:0.25") == 1 and len(re.findall(r"split\([^,]*, \t", optimized)) == 1
    assert [(r.CHROM, r.POS, r.N_ALLELES, r.N_CHR, r.freqs) for r in made.orderBy("POS").collect()] == [(str(i), i, 2, 20, [0.25, 0.75]) for i in range(5)]


def test_odd_lines_are_read_as_before(spark):
    lines = ["CHROM\t pos \tN\tM\tx", "", None, "1\t5\t1\t4", "1\t7.0\t2\t4\tA:1\tT:0", "2\t5\t1\t4\tC:0.5"]
    rows = readers.parse_freq(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.CHROM, r.POS, r.freqs) for r in rows] == [("1", 5, []), ("1", 7, [1.0, 0.0]), ("2", 5, [0.5])]
    for bad in ("1\tx\t2\t4\tA:1", "alone", "1\t1.5\t2\t4"):
        with pytest.raises(Exception, match="no position in line"):
            readers.parse_freq(spark.createDataFrame([(bad,)], "value string")).collect()


@pytest.mark.parametrize("bound", [100_000, 3])
def test_rows_of_few_values_are_ranked_where_they_are(spark, monkeypatch, bound):
    monkeypatch.setattr(vt, "BROADCAST_ROWS", bound)
    values = [0.1, 0.1, 0.2, None, 0.3, 0.1, -0.0, 0.0, 0.4]
    df = spark.createDataFrame([*enumerate(values)], "k int, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = vt.percent_rank(df, "v", "p")
        rows = ranked.collect()
        text = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" not in text) == (bound > 3)
    known = [v for v in values if v is not None]
    share = lambda v: (sum(x < v for x in known) + (known.count(v) + 1) / 2) / len(known)
    assert {r.k: r.p for r in rows} == {k: None if v is None else pytest.approx(share(v)) for k, v in enumerate(values)}
