"""Line dedup [native] by content-defined line chunks.

Every line is hashed, and a rolling hash over ``span`` consecutive line hashes makes a line a boundary unless it is divisible by
``divisor``; the first and last line are boundaries too. A chunk runs from one boundary to the next, both included, so it has two lines at
least and a shared passage falls into the same chunks wherever it stands: boundaries depend on the lines themselves, not on their
numbers.

1. Chunks that hold a word are counted by hash; only documents with a hash that repeats go on, with the first lines of those chunks.
2. There the chunks are compared byte by byte. Of equal ones the first by (doc_id, hash of the text, line) stays.
3. Every other one is extended line by line to both sides as long as it agrees with the first one's surroundings (by 128 bits of the
   lines' SHA-256), so the lines of a passage outside its outermost boundaries go as well. All its lines are cut.

Each line that goes has an equal one before it, in the order of 2, that leads to one that stays. What stays: single lines, and
passages with fewer than two boundaries inside, of which short ones of two or three lines are the most.

Only DataFrame functions are used. A chunk that a third of all rows share is counted by partial aggregation before any shuffle,
and its occurrences meet their one first row in a join that adaptive execution can split.

Edge cases: a null text stays null with no lines; an empty text is one empty line; very long texts are cut whole; rows with equal
doc_id and text are one document and keep the same lines; nulls in doc_id are compared as values; an empty table gives an empty
result; further columns, whatever their names and types, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.runtime import col

SPAN, DIVISOR = 2, 8
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: object) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def boundaries(lines: Column, span: int = SPAN, divisor: int = DIVISOR) -> Column:
    """Numbers of the lines that chunks begin and end with."""
    last = F.size(lines) - 1

    def chosen(hashes: Column) -> Column:
        rolled = lambda i: F.xxhash64(*[F.get(hashes, i - k) for k in range(span - 1, -1, -1)])
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (i == last) | (F.pmod(rolled(i), F.lit(divisor)) != 0))

    return let(F.transform(lines, lambda x: F.xxhash64(x)), chosen)


def chunks(text: Column | str, span: int = SPAN, divisor: int = DIVISOR) -> Column:
    """Array of structs (s, e, h): first and last line of each chunk, and the hash of its text. Null for a null text."""

    def of(lines: Column) -> Column:
        hashed = lambda s, e: F.xxhash64(F.array_join(F.slice(lines, s + 1, e - s + 1), "\n"))
        named = lambda es: F.transform(F.slice(es, 2, F.size(es)), lambda e, k: F.struct(F.get(es, k).alias("s"), e.alias("e"), hashed(F.get(es, k), e).alias("h")))
        return let(boundaries(lines, span, divisor), named)

    return let(F.split(text, "\n", -1), of)


def _key_and_text(doc_id: str, text: str) -> list[Column]:
    return [col(doc_id).alias("doc"), F.xxhash64(col(text)).alias("th"), col(text).alias("text")]


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, divisor: int = DIVISOR) -> DataFrame:
    """Rows (doc, th, starts): the first lines of the chunks whose hash occurs more than once, by document and hash of its text."""
    found = docs.select(*_key_and_text(doc_id, text)).select("doc", "th", F.explode(chunks("text", span, divisor)).alias("c")).select("doc", "th", "c.s", "c.h")
    often = found.groupBy("h").agg(F.count("s").alias("n")).where("n > 1").select("h")
    return found.join(often, "h", "left_semi").groupBy("doc", "th").agg(F.collect_set("s").alias("starts"))


def agreeing(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their fronts."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise((differs - 1).cast("int"))


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, divisor: int = DIVISOR) -> DataFrame:
    """Rows (gone_doc, gone_th, gone): the numbers of the lines to cut, by document and hash of its text."""
    where = candidates(docs, doc_id=doc_id, text=text, span=span, divisor=divisor).select(F.col("doc").alias("d"), F.col("th").alias("t"), "starts")
    named = docs.select(*_key_and_text(doc_id, text))
    seeded = named.join(where, named.doc.eqNullSafe(where.d) & named.th.eqNullSafe(where.t)).select("doc", "th", "starts", F.split("text", "\n", -1).alias("lines"))

    def around(lines: Column) -> Column:
        """Structs (s, e, body, before, after): a chunk, and digests of the lines of the chunk before it, in reverse, and of the one after it."""

        def of(es: Column) -> Column:
            part = lambda s, n: F.slice(lines, s + 1, F.greatest(n, F.lit(0)))

            def chunk(s: Column, k: Column) -> Column:
                e, earlier, later = F.get(es, k + 1), F.coalesce(F.get(es, k - 1), s), F.coalesce(F.get(es, k + 2), F.get(es, k + 1))
                digests = lambda xs: F.transform(xs, lambda x: F.substring(F.unhex(F.sha2(x.cast("binary"), 256)), 1, 16))
                return F.struct(s.alias("s"), e.alias("e"), F.array_join(part(s, e - s + 1), "\n").alias("body"), digests(F.reverse(part(earlier, s - earlier))).alias("before"), digests(part(e + 1, later - e)).alias("after"))

            # Marks of the starts sort right before their boundaries.
            marked = F.concat(F.transform("starts", lambda s: F.struct(s.alias("s"), F.lit(-1).alias("k"))), F.transform(es, lambda s, k: F.struct(s.alias("s"), k.alias("k"))))
            seeds = let(F.sort_array(marked), lambda xs: F.filter(xs, lambda x, j: (x["k"] >= 0) & F.coalesce(F.get(xs, j - 1)["s"] == x["s"], F.lit(False))))
            return F.transform(seeds, lambda x: chunk(x["s"], x["k"]))

        return let(boundaries(lines, span, divisor), of)

    rows = seeded.select("doc", "th", F.explode(around(F.col("lines"))).alias("c")).select("doc", "th", "c.*").where(F.col("body").rlike(WORD))
    place = F.struct("doc", "th", "s")
    first = rows.groupBy("body").agg(F.count("s").alias("n"), F.min(F.struct("doc", "th", "s", "before", "after")).alias("first")).where("n > 1")
    again = rows.join(first.select("body", "first"), "body").where(~place.eqNullSafe(F.struct("first.doc", "first.th", "first.s")))
    up, down = agreeing(F.col("before"), F.col("first.before")), agreeing(F.col("after"), F.col("first.after"))
    spans = again.select("doc", "th", F.struct((F.col("s") - up).alias("s"), (F.col("e") + down).alias("e")).alias("span"))
    each = spans.groupBy(F.col("doc").alias("gone_doc"), F.col("th").alias("gone_th")).agg(F.collect_set("span").alias("spans"))
    return each.select("gone_doc", "gone_th", F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"])))).alias("gone"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, divisor: int = DIVISOR, removed: str | None = None) -> DataFrame:
    """docs with the repeated passages cut from the text; ``removed`` names a column for the number of lines cut."""
    again = repeated_lines(docs, doc_id=doc_id, text=text, span=span, divisor=divisor)
    rest = [c for c in docs.columns if c not in (doc_id, text, removed)]
    # The same columns as the search shuffles, so a table of ids and texts is shuffled once for both.
    whole = docs.select(*_key_and_text(doc_id, text), *([F.struct(*[col(c) for c in rest]).alias("rest")] if rest else []))
    both = whole.join(again, F.col("doc").eqNullSafe(F.col("gone_doc")) & F.col("th").eqNullSafe(F.col("gone_th")), "left")
    mark = lambda at, live, body: F.struct(at.alias("at"), F.lit(live).alias("live"), body.alias("body"))
    lines = F.split("text", "\n", -1)
    marked = F.concat(F.transform("gone", lambda s: mark(s, 0, F.lit(""))), F.transform(lines, lambda x, i: mark(i, 1, x)))
    # Marks of lines to cut sort right before their lines.
    dead = lambda x, before: F.coalesce((before["at"] == x["at"]) & (before["live"] == 0), F.lit(False))
    left = let(F.sort_array(marked), lambda xs: F.filter(xs, lambda x, j: (x["live"] == 1) & ~dead(x, F.get(xs, j - 1))))
    kept = both.select(*[c for c in whole.columns if c != "th"], F.size("gone").cast("long").alias("n_gone"), F.when(F.col("gone").isNotNull(), left).alias("kept"))
    clean = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda x: x["body"]), "\n"))
    columns = [clean.alias(c) if c == text else F.col("doc").alias(c) if c == doc_id else F.col("rest").getField(c).alias(c) for c in docs.columns if c != removed]
    return kept.select(*columns, *([] if removed is None else [F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_gone")).cast("long").alias(removed)]))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines kept, n_removed lines, n_chars kept and the SHA-256 of the kept text."""
    clean = dedup_lines(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), removed="n_removed")
    return clean.select(
        "doc_id",
        F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("n_removed") > 0)), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        "n_removed",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
