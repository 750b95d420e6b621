"""Twelve rows with known answers: a copy by content, one by metadata, one by text, and rows that lack something."""

from lakeloom.schema import ITEMS

MAIN, OTHER = "main", "other"
ROWS = [
    (MAIN, 1, "u1", "Harbour Lights - Low Tide.ogg", 7300000, 154, "Harbour Lights", "Low Tide"),
    (MAIN, 2, "u1", "Harbour Lights - Low Tide (2).ogg", 7310000, 154, "Harbour Lights", "Low Tide"),
    (MAIN, 3, "u3", "Quay Four.wav", 4100000, 133, "Quay", "Four"),
    (MAIN, 4, "u4", "Quay Four.wav", 4100000, 133, "Quay", "Four"),
    (MAIN, 5, "u5", "tmpx91kd.ogg", 6400000, 222, "Salt Choir", "Evening Ferry"),
    (MAIN, 6, "u6", "Salt Choir - Evening Ferry.ogg", 6470000, 223, None, None),
    (MAIN, 7, "u7", "Nothing Like The Rest.ogg", 2100000, 77, None, None),
    (MAIN, 8, "u8", None, 1700000, 51, "Tags Alone", "Alone Tags"),
    (MAIN, 9, "u9", "some_file.ogg", 1200000, 33, "<unknown>", None),
    (MAIN, 10, "u10", "no length.ogg", 800000, 0, None, None),
    (MAIN, 11, "u11", "Twin Title.ogg", 6900000, 201, "A B", "Twin Title.ogg"),
    (OTHER, 12, "u12", "Elsewhere.ogg", 3900000, 99, None, None),
]


def items(spark, rows=ROWS):
    return spark.createDataFrame(rows, ITEMS)
