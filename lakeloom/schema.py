"""Schemas of the stored and derived relations."""

from pyspark.sql import types as T

#: The six payload fields of an item, in stored order.
PAYLOAD = ("content_id", "name", "size", "duration", "performer", "title")

ITEMS = T.StructType(
    [
        T.StructField("scope", T.StringType(), False),
        T.StructField("item_id", T.LongType(), False),
        T.StructField("content_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("performer", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)
CURSORS = T.StructType([T.StructField("scope", T.StringType(), False), T.StructField("is_fully_synced", T.IntegerType(), False), T.StructField("newest_scanned_id", T.LongType())])
#: DDL of what a message stream carries.
MESSAGES = (
    "scope string, item_id long, empty boolean, service boolean, "
    "audio struct<content_id: string, name: string, size: long, duration: long, performer: string, title: string>, "
    "document struct<content_id: string, name: string, size: long, mime_type: string>"
)
