"""Fixed schemas. Survey tables are the only inputs whose schema is inferred."""

from pyspark.sql import types as T

# `score` is a double because the stored pages may hold fractional scores and
# the comment class treats 3.5 differently from 3.
COMMENT = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("creation_time", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("comment_type", T.StringType()),
])

# Place of a comment in the order of collection.
SEQ = T.StructField("seq", T.LongType())

# Everything is read as text, so that one odd value cannot spoil its page.
PAGE = T.StructType([
    T.StructField("comments", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("creationTime", T.StringType()),
        T.StructField("score", T.StringType()),
    ]))),
])

# class -> topic -> "0.034*'w' + ..."
TOPIC_STRINGS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))

# class -> topic -> [word]
TOPIC_KEYWORDS = T.MapType(
    T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType())))
