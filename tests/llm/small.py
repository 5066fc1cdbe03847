"""Small inputs that the operator tests share."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def documents(spark, tmp_path, rows, extra=True):
    """Rows (doc_id, text[, lang, source]) as a Parquet table with extra columns
    whose names the operators use themselves."""
    full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({"_rid": F.lit("x"), "rid": F.lit(1), "words": F.lit("w"), "h": F.lit(None).cast("int"),
                             "count": F.lit(0), "part": F.lit("p"), "size": F.lit(2.5)})
    path = str(tmp_path / "documents.parquet")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
