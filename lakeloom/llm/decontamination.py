"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Every run of ``width`` consecutive words
of a benchmark item is a window; an item of fewer words, but not none, is one window. Window hashes go to every
task; a document's runs are looked up by hash and every hit is verified against the window's bytes.

What is broadcast are plain arrays: the items' words, and for each window its hash, its place there and its item, about 24 bytes
a window. Its size is bounded: items are cut into overlapping pieces of at most ``PIECE`` window starts, pieces go to
blocks of about ``block_bytes`` of words, and a benchmark of several blocks is scanned block by block, each block a pass of its
own over the documents that carries the hits found so far.

Edge cases: a null or empty text has no words and no hits; null or empty items have no windows; an item with a null
id hits words but cannot be listed; items that share an id are listed once; repeated documents are scanned alike; very long
texts are scanned whole, hashed a bounded stretch at a time; an empty benchmark leaves every document clean, and an empty
table of documents gives an empty result. Column names may be any; in ``annotate`` a column named like ``into`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.textcore import LETTERS, Roller, bounds, letter_words, map_batches, texts, windows
from lakeloom.plans.runtime import col, cut, free_name

WIDTH = 10
BLOCK_BYTES = 16 << 20
#: Windows that start in one piece of an item.
PIECE = 4096
#: Bits of the bitmap that most windows of clean text fail at once.
FILTER_BITS = 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("starts", T.ArrayType(T.LongType(), False), False),
        T.StructField("ends", T.ArrayType(T.LongType(), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
    ]
)
ARROW_HITS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

#: Windows of one width: filter bitmap, sorted distinct hashes, first entry of each hash, and by entry place, end and item.
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pieces(items: DataFrame, width: int) -> DataFrame:
    """Rows (item, body): the joined words of items (item, text), cut so that every window lies in exactly one piece."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for name, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                words = letter_words(text).split()
                for at in range(0, max(len(words) - width + 1, min(1, len(words))), PIECE):
                    names.append(name)
                    bodies.append(b" ".join(words[at : at + PIECE + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["item", "body"])

    return items.mapInArrow(split, "item string, body binary")


def window_tables(found: list[tuple[str | None, bytes]], width: int) -> tuple[bytes, list[str | None], dict[int, Table]]:
    """All words, the item of each piece, and the windows by their number of words."""
    roller, at, by_width = Roller(), 0, {}
    for owner, (_, joined) in enumerate(found):
        starts, ends = bounds(joined)
        if len(starts):
            k = min(width, len(starts))
            hashes = windows(roller, joined, width)
            by_width.setdefault(k, []).append((hashes, at + starts[: len(hashes)], at + ends[k - 1 :], np.full(len(hashes), owner)))
        at += len(joined) + 1
    tables: dict[int, Table] = {}
    for k, parts in by_width.items():
        hashes, starts, ends, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        distinct, first = np.unique(hashes[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[distinct >> np.uint64(64 - FILTER_BITS)] = True
        tables[k] = np.packbits(seen), distinct, *(x.astype(np.int32) for x in (np.append(first, len(order)), starts[order], ends[order], owners[order]))
    return b" ".join(x for _, x in found), [x for x, _ in found], tables


def _hits(joined: bytes, held: tuple[bytes, list[str | None], dict[int, Table]], filters: dict[int, np.ndarray], roller: Roller) -> tuple[int, list[tuple[int, int]], set[str]]:
    body, names, tables = held
    starts, ends = bounds(joined)
    spans: list[tuple[int, int]] = []
    entries: set[tuple[int, int]] = set()
    for k, (_, distinct, first, at, upto, _) in tables.items():
        if len(starts) < k:
            continue
        hashes = windows(roller, joined, k)
        likely = np.flatnonzero(filters[k][hashes >> np.uint64(64 - FILTER_BITS)])
        place = np.searchsorted(distinct, hashes[likely])
        place[place == len(distinct)] = 0
        real = distinct[place] == hashes[likely]
        for i, p in zip(likely[real].tolist(), place[real].tolist(), strict=True):
            run, e = joined[starts[i] : ends[i + k - 1]], first[p]
            if body[at[e] : upto[e]] == run:
                entries.add((k, p))
                spans.append((i, i + k))
            elif any(body[at[x] : upto[x]] == run for x in range(e + 1, first[p + 1])):
                entries.add((k, p))
                spans.append((i, i + k))
    return len(starts), spans, {names[x] for x in _owners(joined, held, entries, spans)} - {None}


def _owners(joined: bytes, held: tuple[bytes, list[str | None], dict[int, Table]], entries: set[tuple[int, int]], spans: list[tuple[int, int]]) -> set[int]:
    """The pieces that hold the windows found, each distinct window once; equal hashes of unlike windows are told apart."""
    body, _, tables = held
    owners: set[int] = set()
    for k, p in entries:
        _, _, first, at, upto, owner = tables[k]
        lo, hi = int(first[p]), int(first[p + 1])
        kinds = {body[at[x] : upto[x]] for x in range(lo, hi)} if hi - lo > 1 else {b""}
        if len(kinds) == 1:
            owners |= set(owner[lo:hi].tolist())
            continue
        starts, ends = bounds(joined)
        runs = {joined[starts[s] : ends[e - 1]] for s, e in spans if e - s == k}
        owners |= {int(owner[x]) for x in range(lo, hi) if body[at[x] : upto[x]] in runs}
    return owners


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Disjoint spans in order that cover the same words."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, into: str = "hits", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` (all columns by default) and a struct ``into``: n_words, disjoint hit word spans, ids of hit items."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    items = cut(pieces(benchmark.select(col(item).cast("string").alias("item"), col(item_text).alias("text")).where("text is not null"), width))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block_bytes))
    df = docs
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()
        # Plain arrays: a worker needs no copy of this package to read them.
        held = docs.sparkSession.sparkContext.broadcast(window_tables([(r.item, bytes(r.body)) for r in rows], width))
        last = b == blocks - 1
        df = _pass(df, held, text, into, keep if last else list(dict.fromkeys([*keep, text])), first=b == 0)
        if not last:
            df = cut(df)
    return df


def _pass(df: DataFrame, held: Any, text: str, into: str, keep: list[str], first: bool) -> DataFrame:
    fields = [df.schema[c] for c in keep]
    source = df.select(*[col(c) for c in dict.fromkeys([*keep, text, *([] if first else [into])])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, roller = held.value, Roller()
        filters = {k: np.unpackbits(x[0]).astype(bool) for k, x in tables[2].items()}
        for batch in batches:
            before = [None] * batch.num_rows if first else batch.column(batch.schema.get_field_index(into)).to_pylist()
            out = []
            for data, was in zip(texts(batch, text), before, strict=True):
                n, spans, items = _hits(letter_words(data), tables, filters, roller)
                if was:
                    spans, items = [*spans, *zip(was["starts"], was["ends"], strict=True)], items | set(was["items"])
                starts, ends = _merged(spans)
                out.append({"n_words": n, "starts": starts, "ends": ends, "items": sorted(items)})
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, ARROW_HITS)], [*keep, into])

    return map_batches(source, scan, T.StructType([*fields, T.StructField(into, HITS)]))


def drop_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options: Any) -> DataFrame:
    """The documents that contain no window, with their columns."""
    into = free_name(docs, "hits")
    return annotate(docs, benchmark, text=text, into=into, **options).where(F.size(f"{into}.starts") == 0).select(*[col(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options: Any) -> DataFrame:
    """All documents with their columns; the hit words, and what stands between them, are cut from the text."""
    into = free_name(docs, "hits")
    hit, names = annotate(docs, benchmark, text=text, into=into, **options), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            spans = batch.column(batch.schema.get_field_index(into)).to_pylist()
            out = pa.array([x if x is None or not h["starts"] else _without(x, h).decode("utf-8", "replace") for x, h in zip(texts(batch, text), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([out if i == at else batch.column(i) for i in range(len(names))], names)

    return map_batches(hit.select(*[col(c) for c in names], into), clean, docs.schema)


def _without(data: bytes, hits: dict[str, Any]) -> bytes:
    words = np.frombuffer(data.translate(LETTERS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], words, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    at, parts = 0, []
    for s, e in zip(hits["starts"], hits["ends"], strict=True):
        parts.append(data[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*parts, data[at:]])


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options: Any) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = annotate(docs, benchmark, into="hits", keep=[doc_id], **options)
    n_hit = F.aggregate(F.zip_with("hits.starts", "hits.ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda x, y: x + y)
    return hit.select(
        col(doc_id),
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (F.size("hits.starts") > 0).alias("contaminated"),
    )
