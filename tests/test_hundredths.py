"""Numbers with two decimals as C prints them."""

from pyspark.sql import functions as F

from tideline.functions import text as T


def test_numbers_read_as_printf_prints_them(spark):
    """Every third decimal 5, either side of it, and the numbers that are a tie in binary."""
    numbers = [s * (i / 1000 + e) for i in range(5, 1500, 10) for e in (0, 1e-6, -1e-6) for s in (1, -1)]
    numbers += [s * (k + f) for k in (0, 1, 2, 7, 1000, 123456) for f in (0, 0.125, 0.375, 0.625, 0.875) for s in (1, -1)] + [0.001, -0.001, 12345678.905, 1e12 + 0.5]
    got = spark.createDataFrame([(float(x),) for x in numbers], "x double").select("x", T.hundredths(F.col("x")).alias("text")).collect()
    assert [r.text for r in got] == ["%6.2f" % r.x for r in got]
    assert [r.text for r in spark.sql("SELECT CAST(s AS DECIMAL(9,6)) AS x FROM VALUES ('0.295'), ('-0.295'), (NULL) AS t(s)").select(T.hundredths(F.col("x")).alias("text")).collect()][:2] == ["%6.2f" % 0.295, "%6.2f" % -0.295]
