"""Schemas of the tables that the operators pass on."""

from pyspark.sql import types as T

_long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
EDGES = T.StructType([*_long("src", "dest"), *[T.StructField(n, T.IntegerType()) for n in ("likes", "shares", "comments")]])
PARTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("node", T.LongType())])
SCORES = T.StructType([*_long("id"), T.StructField("score", T.DoubleType())])
