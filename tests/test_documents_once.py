"""Documents that are made of rows are made and parsed once for each rule, however many rows they come from."""

from pyspark.sql import functions as F

from strandline.operators import compiler
from strandline.plans import compiled_queries as cq
from strandline.sources import catalogue

SF = "/root/testdata/sf0.001"


def test_a_document_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(doc):
        made.add(1)
        return doc

    docs = cq._documents(spark, SF, "pulse", F.lit('"window":{"kind":"local_day"},"strategy":{"op":"first_available"}'))
    n = docs.count()
    got = compiler.resolve(docs.withColumn("doc", counted("doc")), catalogue.metrics(spark), cq.rows(spark, SF), cq.sources(spark, SF), cq.NOW, name="once").results
    assert got.count() > 0 and made.value == n
