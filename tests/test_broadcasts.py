"""What is small as files but not as rows is not broadcast from the driver."""

from pyspark.sql import functions as F

from quirelake.operators import forms, search


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_field_page_shuffles_many_fields(spark):
    """150,000 widgets compress to less than the optimiser's usual 10 MB."""
    ids = spark.range(0, 150_000, 1, 4)
    fields = ids.select((F.col("id") % 25).alias("doc_id"), F.concat(F.lit("f"), "id").alias("name"), F.array("id").alias("widgets"))
    pages = ids.select((F.col("id") % 25).alias("doc_id"), (F.col("id") % 7).cast("int").alias("page"), F.array(F.col("id"), F.col("id") + 25).alias("annots"))
    placed = forms.field_page(fields, pages)
    found = placed.groupBy().agg(F.count("*").alias("n"), F.sum("page").alias("pages"))
    assert "BroadcastHashJoin" not in final_plan(found)
    expected = [min(i % 7, (i - 25) % 7) if i >= 25 else i % 7 for i in range(150_000)]
    assert tuple(found.first()) == (150_000, sum(expected))


def test_search_many_sends_queries_to_places(spark, tmp_path):
    """Pages that are small as a file hold more places than the driver can: the queries move."""
    pages = spark.range(20).select("id", F.lit(0).alias("page"), F.repeat(F.lit("word of a text "), 40).alias("text"))
    pages.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/pages")
    queries = spark.createDataFrame([(1, "word of"), (2, "ext"), (3, "a")], "query_id int, query string")
    hits = search.search_many(spark.read.parquet(f"{tmp_path}/pages"), queries)
    plan = final_plan(hits)
    assert "BuildLeft" not in plan and "hashpartitioning(gram" not in plan
    assert {r["query_id"]: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 800, 2: 800, 3: 800}
