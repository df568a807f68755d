from chunkweave.functions import naming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    from pyspark.sql import functions as F

    assert one(spark, naming.safe_filename(F.lit('a/b:"c".pdf'), "-chunks.csv")) == "a_b_c_-chunks.csv"
    assert one(spark, naming.safe_filename(F.lit("教材样例.docx"), "-chunks.csv")) == "教材样例-chunks.csv"
    assert one(spark, naming.safe_filename(F.lit(None).cast("string"), ".csv")) == "document.csv"
    assert one(spark, naming.slug(F.lit("  "), "unknown")) == "unknown" and one(spark, naming.slug(F.lit("abcdef"), "x", 3)) == "abc"
    assert one(spark, naming.camel_case(F.lit("price_per_page"))) == "pricePerPage" and one(spark, naming.camel_case(F.lit("one"))) == "one"
    assert one(spark, naming.mask_middle(F.lit("13812345678"), 3, 4)) == "138****5678" and one(spark, naming.mask_middle(F.lit("abc"), 3, 4)) == "***"
    assert one(spark, naming.mask_address(F.lit("to jane.doe@example.com from 10.1.2.3"))) == "to j***@example.com from 10.1.*.*"
    assert one(spark, naming.vector_text(F.array(F.lit(0.5), F.lit(-1.25)))) == "0.500000,-1.250000"
