import pytest
from pyspark.sql import functions as F

from tidelog.sources.store import Store


def test_unknown_families_beyond_a_thousand_are_refused(spark, tmp_path):
    """All families but one are known, more of them than a list of a thousand."""
    s = Store.open(spark, str(tmp_path / "s"))
    m = s.manifest()
    base = {**m, "families": [*m["families"], *[f"f{i}" for i in range(3000)]]}
    ops = spark.range(3001).select(F.col("id").alias("pos"), F.when(F.col("id") < 3000, F.concat(F.lit("f"), F.col("id").cast("string"))).otherwise("unknown").alias("cf"), F.lit("put").alias("op"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    with pytest.raises(KeyError, match="unknown"):
        s.write(ops, base=base)
