"""Schemas of the tables that the stages exchange; all are keyed by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK_TYPES = ("text", "image", "table", "formula", "code")

TABLE_DATA = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])

#: A block without its document.
BLOCK_FIELDS = [
    T.StructField("pos", T.IntegerType()),
    T.StructField("block_id", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("image_data", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("table_data", TABLE_DATA),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("is_bold", T.BooleanType()),
    T.StructField("font_size", T.DoubleType()),
    T.StructField("alignment", T.StringType()),
    T.StructField("is_heading_style", T.BooleanType()),
    T.StructField("heading_level", T.IntegerType()),
]
BLOCKS = T.StructType([T.StructField("doc_id", T.LongType()), *BLOCK_FIELDS])

ANCHORS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("block_id", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()),
    ]
)

META = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("doc_title", T.StringType()), T.StructField("doc_authors", T.StringType())])
