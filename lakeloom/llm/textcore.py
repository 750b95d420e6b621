"""Words and hashes of word runs over UTF-8 bytes, vectorised with NumPy.

A document is lower-cased (A-Z only), its words are joined by single spaces, and the hash of any run of words is
the polynomial hash of the bytes between its ends, finalised to 64 bits. Equal runs have equal hashes anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Odd multiplier of the polynomial hash.
BASE = 0x9E3779B97F4A7C15
#: Spans hashed at a time, so that the tables stay small for very long texts.
BLOCK = 1 << 17
#: Bytes that end a word of letters and digits: ASCII other than 0-9 A-Z a-z; A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Roller:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down

    def spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each ``data[start:end]``; starts must not fall."""
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), BLOCK):
            s, e = starts[i : i + BLOCK], ends[i : i + BLOCK]
            first, last = int(s[0]), int(e.max())
            part = np.frombuffer(data, np.uint8, last - first, first)
            up, down = self.tables(last - first + 1)
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
            out[i : i + BLOCK] = mixed((sums[e - first] - sums[s - first]) * down[s - first])
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blank_words(text: bytes | None) -> bytes:
    """Words between ASCII white space, lower-cased, joined by spaces."""
    return b" ".join(text.lower().split()) if text else b""


def letter_words(text: bytes | None) -> bytes:
    """Words of digits, letters and non-ASCII characters, lower-cased, joined by spaces."""
    return b" ".join(text.translate(LETTERS).split()) if text else b""


def bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of space-joined words."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def windows(roller: Roller, joined: bytes, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; of the whole sequence where there are fewer words."""
    starts, ends = bounds(joined)
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(starts) < width:
        return roller.spans(joined, starts[:1], ends[-1:])
    return roller.spans(joined, starts[: len(starts) - width + 1], ends[width - 1 :])


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """The column's values as UTF-8 bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    yield from (x.as_py() for x in values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: Spark sees numbered ones, ``run`` the real ones."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)
