"""Schemas.  Every table is read with a declared schema; none is inferred."""

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

RAW_POST = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("actor_title", T.StringType()),
        T.StructField("data_urn", T.StringType()),
    ]
)

POST = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("profile_name", T.StringType()),
    ]
)

# Spark rows have no order, so a post keeps the page and the place it came from.
PLACED_POST = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        *POST.fields,
    ]
)


def labelled_post(*labels):
    """Schema of posts with a column per label."""
    return T.StructType([*POST.fields, *(T.StructField(name, T.LongType()) for name in labels)])


LABELLED_POST = labelled_post("hiring_post")
