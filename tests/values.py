"""Values of a column expression over given inputs."""


def column_values(spark, schema, values, expression):
    """Evaluate one column expression over a list of input tuples."""
    rows = [(i, *value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, {schema}")
    return [row[1] for row in frame.select("i", expression.alias("out")).orderBy("i").collect()]
