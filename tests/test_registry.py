from pyspark.sql import functions as F

from bitloom.operators import registry as R


def test_accepted_and_labels(spark):
    rows = [("width", "640"), ("width", "0"), ("width", "6.5"), ("width", "wide"), ("width", None), ("title", "x"), ("title", ""), ("sample_rate", "44100.0"), ("sample_rate", "10"), ("nonsense", "1"), ("nb_page", "5"), (None, "1")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [r[0] for r in df.select(R.accepted(F.col("k"), F.col("v"))).collect()]
    assert got == [True, False, False, False, False, True, True, True, False, False, True, False]
    assert R.registry(spark).count() == 73
    assert df.select(R.label(F.col("k"))).first()[0] == "Image width"
