"""Terms beside a content: the hashes of its words, distinct and in order, without a comparison by a lambda."""

from pyspark.sql import functions as F

from siftwork.functions import text


def test_terms(spark):
    contents = ["", None, "a bb ccc", "The the THE one, two two", "Éa éa x_y ß9 -- longer words" * 3]
    got = spark.createDataFrame([(c,) for c in contents], "content string").withColumn("terms", text.stored_terms(F.col("content")))
    hashed = F.array_sort(F.transform(text.query_terms(F.col("content")), text.term_hash))
    assert all(r.terms == r.want for r in got.withColumn("want", hashed).collect())
    assert "array_sort" not in got._jdf.queryExecution().analyzed().toString()
