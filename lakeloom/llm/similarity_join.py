"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. The set is split by hash into segments, and each
segment has a parity sketch in which every n-gram flips one bit: the number of differing bits bounds the symmetric
difference from below. There are two widths. The join uses so wide a sketch that n-grams share no bits; a segment of it is
kept as the XOR of its n-grams' hashes. The filter behind the join uses 64 bits a segment and counts them.

Two sets with Jaccard similarity of at least t differ in at most D = (1 - t) / (1 + t) * (|A| + |B|) n-grams, so of D + 1 + e
segments at least e + 1 have equal parity. Each size band fixes D by its largest size, and a set goes to its own band and
to the next one if a partner there can be large enough.

The e spare segments pay for selectivity: a set leaves out the segments of fewest n-grams, all up to some number, as far
as they are no more than e. Of two linked sets the one that leaves out more still leaves out at most e of the equal segments,
so they meet in another one.

Empty segments say nothing, so they must not make buckets. A set with more than e of them is sparse: it uses its other segments, in
which it meets every linked set that is not sparse, and is split anew by another hash to meet the sparse ones, up to ``SPLITS``
times. Only a set that is sparse every time uses its empty segments too.

1. Equal sets form a class; its smallest doc_id stands for it.
2. Classes that meet in a segment form a bucket. Buckets of at most ``small`` classes give their pairs; larger ones that have the
   same smallest class make one dense cluster, which is cut into blocks of bounded size, and each two blocks are compared
   by one task that returns links counted and a spanning forest, never all pairs. Near copies share most of their buckets, so
   they are in few clusters; a pair that is in several counts in the first. Clusters that share classes are not united: chance
   ties would unite ever more of a growing table.
3. Pairs are filtered by size and by the Hamming distance of whole sketches, then verified on the sets.
4. Components of verified links give the class id of every document.

Texts and sets are never dealt by id to choose some of them: the chosen ids travel to them (``among``).

Nothing is left out: every pair of sets at or over the threshold meets in 2 and is verified in 3.

Edge cases: a null, empty or blank text has an empty set and links with nothing (its class is itself); a text of
fewer than ``width`` words has its whole sequence as one n-gram; very long texts are split and hashed whole, in batches of about
``BATCH_BYTES`` or one text; ids may be of any type that orders; rows that share a doc_id but not a text are texts of one document: each
counts the links of its own text, and they are of one class; equal rows count as one; rows without a doc_id link with nothing and have a
null class; ties go to the smaller doc_id; an empty table gives an empty result; further columns, whatever their names, are ignored,
and pass through ``one_of_each``. Words are hashed by the keyed 64-bit SipHash of their bytes, n-grams by mixing their words' hashes one
after the other, sets by two independent 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.textcore import mixed, texts
from lakeloom.operators.components import connected_components
from lakeloom.operators.membership import among
from lakeloom.plans.runtime import col, cut, swept

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
#: A size band ends at this many times its start.
RATIO = 1.4
#: Buckets of up to so many classes give pairs; larger ones go to dense clusters.
SMALL = 12
#: N-grams and sets in a block of a dense cluster, on average.
BLOCK_TOKENS, BLOCK_SETS = 250_000, 1_500
#: Hash splits that a sparse set is given.
SPLITS = 4
#: Bytes of texts that are split into words at a time.
BATCH_BYTES = 1 << 20
#: Low bits of a bucket's key that are not kept: buckets that then share a key give pairs that are not links, and fewer bytes are dealt.
KEY_BITS_CUT = 16
#: Rows of clusters that may be broadcast.
BROADCAST_ROWS = 100_000


def ngram_sets(bodies: Iterable[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    held: list[list[bytes]] = []
    size = 0
    for body in bodies:
        held.append(body.lower().split() if body else [])
        size += len(body or b"")
        if size >= BATCH_BYTES:
            yield from _hashed(held, width)
            held, size = [], 0
    yield from _hashed(held, width)


def _hashed(texts_words: list[list[bytes]], width: int) -> Iterator[np.ndarray]:
    """Sets of texts given as words; each distinct word is hashed once."""
    words = np.array([w for ws in texts_words for w in ws] or [b""], object)
    hashes = mixed(hash_array(words, encoding="utf8", hash_key="0123456789123456", categorize=True))
    at = 0
    for ws in texts_words:
        own = hashes[at : at + len(ws)]
        at += len(ws)
        grams = own[: len(own) - width + 1] if len(own) >= width else own[:1]
        for k in range(1, min(width, len(own))):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(grams)])
        # A short sequence must not equal the front of a longer one.
        yield np.unique(grams if len(own) >= width else mixed(grams + np.uint64(len(own))))


class Bands:
    """Size bands, and the number of segments of each."""

    def __init__(self, numerator: int, denominator: int, ratio: float = RATIO) -> None:
        self.num, self.den, self.ratio = numerator, denominator, ratio

    def of(self, n: int) -> int:
        """The band of a size: band i covers first(i) up to first(i + 1) - 1."""
        i = int(np.log(max(n, 1)) / np.log(self.ratio))
        while self.first(i + 1) <= n:
            i += 1
        while i and self.first(i) > n:
            i -= 1
        return i

    def first(self, i: int) -> int:
        return i + 1 if i < 3 else max(int(self.ratio**i), i + 1)

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets of this total size."""
        return (self.den - self.num) * total // (self.den + self.num)

    def segments(self, i: int) -> tuple[int, int]:
        """Segments of band i, and how many of them are spare."""
        apart, least = self.most_apart(2 * (self.first(i + 1) - 1)), self.first(i) * self.num / self.den
        # As many spares as the smallest set in the band has empty segments, and a margin; a quarter at most.
        empty = (apart + 1) * np.exp(-least / (1.05 * (apart + 1)))
        spare = min(int(np.ceil(empty + 3.5 * np.sqrt(empty))), (apart + 3) // 4)
        return apart + 1 + (spare if apart else 0), spare if apart else 0

    def joined(self, n: int) -> list[int]:
        """Bands that a set of n goes to: its own and, if a larger set there may link with it, the next one."""
        i = self.of(n)
        top = i
        while self.den * n >= self.num * self.first(top + 1):
            top += 1
        return list(range(i, top + 1))


def segments_of(members: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment that holds n-grams of a sorted set starts in it, and its number among m."""
    segment = (members >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return starts, segment[starts].astype(np.int64)


def sketch(members: np.ndarray, m: int) -> np.ndarray:
    """The 64-bit parity word of each of m segments of a sorted set."""
    words = np.zeros(m, np.uint64)
    if len(members):
        starts, segment = segments_of(members, m)
        words[segment] = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(members) & np.uint64(63)), starts)
    return words


def bucket_keys(members: np.ndarray, bands: Bands) -> np.ndarray:
    """The buckets of a set: a hash of band, split, segment and parity for each segment that it does not leave out."""
    found = []
    for i in bands.joined(len(members)):
        m, spare = bands.segments(i)
        dealt = members
        for split in range(SPLITS):
            starts, held = segments_of(dealt, m)
            sizes, parity = np.zeros(m, np.int64), np.zeros(m, np.uint64)
            sizes[held] = np.diff(np.append(starts, len(dealt)))
            parity[held] = np.bitwise_xor.reduceat(mixed(dealt), starts)
            under = np.cumsum(np.bincount(sizes))
            sparse = under[0] > spare
            least = 1 if sparse and split < SPLITS - 1 else np.searchsorted(under, spare, side="right")
            used = np.flatnonzero(sizes >= least)
            found.append(mixed(parity[used] + (used.astype(np.uint64) + np.uint64((i << 40) + (split << 32))) * np.uint64(0x9E3779B97F4A7C15)))
            if not sparse:
                break
            dealt = np.sort(mixed(members ^ np.uint64(0xA0761D6478BD642F * (split + 1) % 2**64)))
    return np.concatenate(found) if len(members) else np.empty(0, np.uint64)


def _map(df: DataFrame, make: Any, schema: T.StructType, width: int, text: str = "text") -> DataFrame:
    """mapInArrow with make(ids, sets, other columns) -> columns by name."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(0), ngram_sets(texts(batch, text), width), *batch.columns[2:])
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names)

    return df.mapInArrow(run, schema)


def _schema(docs: DataFrame, id_name: str, rest: str) -> T.StructType:
    """A column of the type of docs.doc_id, and others."""
    return T.StructType([T.StructField(id_name, docs.schema["doc_id"].dataType), *T.StructType.fromDDL(rest).fields])


def class_keys(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), two hashes that stand for the set, and a hash of the text."""

    def make(ids: pa.Array, sets: Iterator[np.ndarray], th: pa.Array) -> dict[str, Any]:
        n, f1, f2 = [], [], []
        for s in sets:
            n.append(len(s))
            f1.append(int(np.add.reduce(mixed(s ^ np.uint64(0xD6E8FEB86659FD93)))) if len(s) else 0)
            f2.append(int(np.add.reduce(mixed(s ^ np.uint64(0xE7037ED1A0B428DB)))) if len(s) else 0)
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return {"doc_id": ids, "n": pa.array(n, pa.int64()), "f1": as_long(f1), "f2": as_long(f2), "th": th}

    return _map(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), make, _schema(docs, "doc_id", "n long, f1 long, f2 long, th long"), width)


def bucket_rows(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """A row (id, key) for every bucket of every document."""
    cut_bits = KEY_BITS_CUT

    def make(ids: pa.Array, sets: Iterator[np.ndarray]) -> dict[str, Any]:
        keys = [bucket_keys(s, bands) for s in sets]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        return {"id": ids.take(pa.array(owner)), "key": pa.array((np.concatenate([*keys, np.empty(0, np.uint64)]) >> np.uint64(cut_bits)).view(np.int64))}

    return _map(docs.select("doc_id", "text"), make, _schema(docs, "id", "key long"), width)


def sets_of(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """id, n, band, the sketch in every band that the set goes to, its own first, and the set."""
    own_schema = _schema(docs, "id", "n long, band int, sketches array<array<long>>, members array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[Any, ...]] = []
            size = first = 0

            def out(upto: int) -> pa.RecordBatch:
                n, own, sketches, members = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, upto - first), pa.array(n, pa.int64()), pa.array(own, pa.int32()), pa.array(sketches, pa.list_(pa.list_(pa.int64()))), pa.array(members, pa.list_(pa.int64()))], own_schema.fieldNames())

            # Batches of a bounded number of n-grams, as sets take more room than their texts.
            for k, s in enumerate(ngram_sets(texts(batch, "text"), width)):
                held.append((len(s), bands.of(len(s)), [sketch(s, bands.segments(i)[0]).view(np.int64) for i in bands.joined(len(s))], s.view(np.int64)))
                size += len(s)
                if size >= BATCH_BYTES:
                    yield out(k + 1)
                    held, size, first = [], 0, k + 1
            if held:
                yield out(batch.num_rows)

    return docs.select("doc_id", "text").mapInArrow(run, own_schema)


def bounded(rows: DataFrame) -> DataFrame:
    """Checkpointed rows of clusters, to be broadcast if they are few enough, else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, small: int = SMALL) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links (other documents it links with).

    Two documents link when denominator * |A and B| >= numerator * |A or B|.
    """
    bands = Bands(numerator, denominator)
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    keyed = cut(class_keys(docs, width))
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    repeated = not keyed.where(linked).groupBy("doc_id").agg(F.countDistinct("th").alias("n")).where("n > 1").isEmpty()
    # Where rows share a doc_id but not a text, (doc_id, hash of the text) is the id inside.
    plain = docs.schema["doc_id"].dataType
    if repeated:
        inner = lambda th: F.struct(F.col("doc_id"), th.alias("th"))
        keyed, docs = keyed.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), inner(F.col("th")))), docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), inner(F.xxhash64("text"))))
    real = keyed.where(linked)
    classes = cut(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")))
    copies = cut(classes.select(F.col("rep").alias("id"), "copies"))
    others = cut(keyed.where("doc_id is not null").select(F.col("doc_id").alias("other")).distinct().join(copies, F.col("other") == F.col("id"), "left_anti"))
    again = not keyed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    links, forest = _links(docs, keyed.select("doc_id"), copies, others, width, bands, small, again)
    if repeated:
        first = real.groupBy(F.col("doc_id.doc_id").alias("one")).agg(F.min(F.struct("doc_id", "f1", "f2")).alias("a"))
        tied = real.select("f1", "f2", F.col("doc_id.doc_id").alias("two")).distinct().join(first, F.col("one") == F.col("two"))
        of = lambda s: classes.select(F.col("f1").alias(f"f1_{s}"), F.col("f2").alias(f"f2_{s}"), F.col("rep").alias(f"rep_{s}"))
        same = tied.join(of("a"), (F.col("a.f1") == F.col("f1_a")) & (F.col("a.f2") == F.col("f2_a"))).join(of("b"), (F.col("f1") == F.col("f1_b")) & (F.col("f2") == F.col("f2_b")))
        forest = forest.unionByName(same.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    parts = connected_components(forest)
    degrees = links.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    state = classes.join(parts, F.col("rep") == F.col("id"), "left").drop("id").join(degrees, F.col("rep") == F.col("id"), "left")
    state = state.select("f1", "f2", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    bare = (lambda c: F.col(f"{c}.doc_id")) if repeated else F.col
    # Rows that link with nothing stay out of the join: they would all share its key.
    met = real.join(state, ["f1", "f2"]).select(bare("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), bare("component").alias("component_id"), "n_links")
    alone = keyed.where(~linked).select(bare("doc_id").cast(plain).alias("doc_id"), F.col("n").alias("n_shingles"), bare("doc_id").cast(plain).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return met.unionByName(alone)


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", **options: Any) -> DataFrame:
    """docs without those whose class has a smaller doc_id; of rows that share a doc_id, those of that class stay."""
    classes = similar_classes(docs, doc_id=doc_id, **options)
    dropped = cut(classes.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct())
    return among(docs, doc_id, dropped, docs.select(col(doc_id)), out=True)


def _links(docs: DataFrame, known: DataFrame, copies: DataFrame, others: DataFrame, width: int, bands: Bands, small: int, again: bool) -> tuple[DataFrame, DataFrame]:
    """Links of every class representative as (id, n_links), counting copies, and edges (a, b) that span the links."""
    reps = among(docs, "doc_id", others, known, out=True).where("doc_id is not null")
    by_key = W.partitionBy("key")
    met = cut(
        bucket_rows(reps, width, bands)
        .withColumn("size", F.count(F.lit(1)).over(by_key))
        .where("size > 1")
        .withColumn("leader", F.min("id").over(by_key))
    )
    swept(docs.sparkSession)
    dense = clusters(met.where(F.col("size") > small))
    pairs = _pairs(met.where(F.col("size") <= small).select("key", "id"), dense)
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(dense.select("dense_id")).distinct())
    sets = sets_of(among(docs, "doc_id", involved, known), width, bands)
    sets = cut(sets.dropDuplicates(["id"]) if again else sets)
    counted = lambda s: copies.select(F.col("id").alias(f"id_{s}"), F.col("copies").alias(f"copies_{s}"))
    swept(docs.sparkSession)
    good = cut(_verified(pairs, sets, involved, bands).join(counted("a"), F.col("a") == F.col("id_a")).join(counted("b"), F.col("b") == F.col("id_b")).select("a", "b", "copies_a", "copies_b"))
    far = _dense(sets, involved, cut(dense.join(copies, F.col("dense_id") == F.col("id")).select("dense_id", "clusters", "copies")), bands)
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("copies_b").alias("n_links")), F.struct(F.col("b").alias("id"), F.col("copies_a").alias("n_links"))))
    links = good.select(ends.alias("e")).select("e.*").unionByName(far.where("b is null").select(F.col("a").alias("id"), "n_links"))
    return links, good.select("a", "b").unionByName(far.where("b is not null").select("a", "b"))


def clusters(rows: DataFrame) -> DataFrame:
    """(dense_id, clusters) of the classes in large buckets, rows (id, leader): the numbers of their clusters, one for each leader."""
    tied = cut(rows.select("leader", F.col("id").alias("dense_id")).distinct())
    numbers = cut(tied.select(F.col("leader").alias("_leader")).distinct().withColumn("dense", F.monotonically_increasing_id()))
    return cut(tied.join(bounded(numbers), F.col("leader") == F.col("_leader")).groupBy("dense_id").agg(F.array_sort(F.collect_list("dense")).alias("clusters")))


def _pairs(rows: DataFrame, dense: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the classes of a bucket that have no dense cluster in common."""
    known = rows.join(dense, F.col("id") == F.col("dense_id"), "left").select("key", F.struct("id", "clusters").alias("x"))
    together = known.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def partners(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("xs", i + 2, F.size("xs")), lambda y: (y["id"] > x["id"]) & ~F.coalesce(F.arrays_overlap(x["clusters"], y["clusters"]), F.lit(False)))
        return F.transform(later, lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))

    return cut(together.select(F.explode(F.flatten(F.transform("xs", partners))).alias("p")).select("p.*").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, known: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that link."""
    light = sets.select("id", "n", "band", "sketches")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    both = pairs.join(side(light, "a"), F.col("a") == F.col("id_a")).join(side(light, "b"), F.col("b") == F.col("id_b"))
    upper = F.greatest("band_a", "band_b")
    in_upper = lambda s: F.get(f"sketches_{s}", upper - F.col(f"band_{s}"))
    # Sets of sizes too far apart to link need not have a sketch in common.
    distance = F.coalesce(F.aggregate(F.zip_with(in_upper("a"), in_upper("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    near = (F.least("n_a", "n_b") * bands.den >= F.greatest("n_a", "n_b") * bands.num) & (distance * (bands.den + bands.num) <= total * (bands.den - bands.num))
    close = cut(both.where(near).select("a", "b", "n_a", "n_b"))
    needed = cut(close.select(F.explode(F.array("a", "b")).alias("needed")).distinct())
    full = among(sets.select("id", "members"), "id", needed, known)
    shared = F.size(F.array_intersect("members_a", "members_b"))
    checked = close.join(side(full, "a"), F.col("a") == F.col("id_a")).join(side(full, "b"), F.col("b") == F.col("id_b"))
    return checked.where(shared * (bands.den + bands.num) >= total * bands.num).select("a", "b")


def _dense(sets: DataFrame, known: DataFrame, dense: DataFrame, bands: Bands) -> DataFrame:
    """Links inside the clusters of dense (dense_id, clusters, copies): rows (id, null, n_links) and edges (a, b, null) that span them."""
    members = among(sets, "id", dense.select("dense_id"), known).join(bounded(dense), F.col("id") == F.col("dense_id")).select(F.explode("clusters").alias("dense"), "clusters", "id", "n", "copies", "members")
    sizes = members.groupBy("dense").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("n") / BLOCK_SETS)).cast("int").alias("blocks"))
    # Only clusters of several blocks are listed: a list of all could be too long to broadcast, and a join dealt by cluster would
    # bring all copies of one into one task, as its order does for the groups below.
    several = cut(sizes.where("blocks > 1").withColumnRenamed("dense", "_dense"))
    placed = members.join(bounded(several), F.col("dense") == F.col("_dense"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = placed.withColumn("other", other).select("dense", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "copies", F.filter("clusters", lambda c: c < F.col("dense")).alias("before"), "members")
    num, den = bands.num, bands.den

    def compare(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:])
        own = group.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        n, copies, own = group.column("n").to_numpy()[order], group.column("copies").to_numpy()[order], own[order]
        ids = group.column("id").combine_chunks().take(pa.array(order))
        split = int(np.searchsorted(own, j)) if i != j else 0
        members = [group.column("members")[int(k)].values.to_numpy() for k in order]
        degree, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        ends: tuple[list[int], list[int]] = [], []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        common = shared_counts(members)
        # Pairs that an earlier cluster has, too, count there.
        before = [group.column("before")[int(k)].values.to_numpy() for k in order]
        if any(map(len, before)):
            common[shared_counts(before) > 0] = -1
        rows = range(split) if i != j else range(len(ids))
        for r in rows:
            cols = np.arange(split, len(ids)) if i != j else np.arange(r + 1, len(ids))
            linked = cols[common[r, cols].astype(np.int64) * (den + num) >= (n[r] + n[cols]) * num]
            degree[r] += copies[linked].sum()
            degree[linked] += copies[r]
            for c in linked.tolist():
                if (x := top(r)) != (y := top(c)):
                    root[max(x, y)] = min(x, y)
                    ends[0].append(r)
                    ends[1].append(c)
        counted = np.flatnonzero(degree)
        a = ids.take(pa.array([*counted.tolist(), *ends[0]], pa.int64()))
        b = ids.take(pa.array([*[None] * len(counted), *ends[1]], pa.int64()))
        return pa.table({"a": a, "b": b, "n_links": pa.array([*degree[counted].tolist(), *[None] * len(ends[0])], pa.int64())})

    kind = sets.schema["id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n_links", T.LongType())])
    return cut(tasks.groupBy("dense", "i", "j").applyInArrow(compare, out))


def shared_counts(members: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, from products of their incidence rows, a bounded piece at a time."""
    owner = np.repeat(np.arange(len(members)), [len(x) for x in members])
    _, gram, times = np.unique(np.concatenate([*members, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    held = times[gram] > 1
    owner, gram = owner[held], gram[held]
    grams, gram = np.unique(gram, return_inverse=True)
    step = max(1, (64 << 20) // (4 * len(members)))
    common = np.zeros((len(members), len(members)), np.float32)
    for at in range(0, len(grams), step):
        here = (gram >= at) & (gram < at + step)
        x = np.zeros((len(members), min(step, len(grams) - at)), np.float32)
        x[owner[here], gram[here] - at] = 1
        common += x @ x.T
    return common
