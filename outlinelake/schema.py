"""Fixed schemas of the three tables."""

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("file", T.StringType(), False), T.StructField("mtime", T.TimestampType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType())])

PROPERTY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

HEADINGS = T.StructType(
    [
        T.StructField("heading_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("priority", T.StringType()),
        T.StructField("todo", T.StringType()),
        T.StructField("cookie_done", T.IntegerType()),
        T.StructField("cookie_total", T.IntegerType()),
        T.StructField("cookie_pct", T.IntegerType()),
        T.StructField("scheduled", T.TimestampNTZType()),
        T.StructField("deadline", T.TimestampNTZType()),
        T.StructField("closed", T.TimestampNTZType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("ancestor_ids", T.ArrayType(T.LongType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("properties", T.ArrayType(PROPERTY)),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("full_link", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
