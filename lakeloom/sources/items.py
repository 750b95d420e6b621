"""Reference-shaped relations over stored tables: items, messages, snapshots, cursors and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.runtime import table
from lakeloom.schema import ITEMS


def _as_items(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEMS])


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: scope is the language, the name is the first line and the title the second."""
    lines = F.split("text", "\n", 3)
    docs = table(spark, sf_dir, "documents").withColumn("_lines", lines)
    return _as_items(
        docs.select(
            F.col("lang").alias("scope"), F.col("doc_id").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("content_id"), F.nullif(F.get("_lines", F.lit(0)), F.lit("")).alias("name"),
            F.octet_length("text").alias("size"), F.col("n_chars").alias("duration"), F.col("source").alias("performer"), F.nullif(F.get("_lines", F.lit(1)), F.lit("")).alias("title"),
        )
    )


def parts_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: scope is the brand, the name a file name, size unknown for some types and tags for others."""
    kind = F.col("p_type")
    return _as_items(
        table(spark, sf_dir, "part").select(
            F.col("p_brand").alias("scope"), F.col("p_partkey").alias("item_id"), F.md5(F.concat_ws("|", "p_name", "p_type", "p_size").cast("binary")).alias("content_id"),
            F.concat(F.translate("p_name", " ", "_"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".mp3")).alias("name"), F.when(kind != "SMALL", F.floor("p_retailprice")).alias("size"),
            F.col("p_size").alias("duration"), F.when(kind == "PROMO", "<unknown>").otherwise(F.nullif(kind, F.lit("LARGE"))).alias("performer"), F.when(~kind.isin("PROMO", "LARGE"), F.upper("p_name")).alias("title"),
        )
    )


def events_as_items(events: DataFrame) -> DataFrame:
    """Events: scope is the user, the payload is what an event carries; duration and tags are unknown."""
    none = F.lit(None)
    return _as_items(
        events.select(
            F.col("user_id").alias("scope"), F.col("event_id").alias("item_id"), F.col("props").alias("content_id"), F.col("event_type").alias("name"),
            F.round(F.col("value") * 100).alias("size"), none.alias("duration"), none.alias("performer"), none.alias("title"),
        )
    )


def label_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second look finds of the documents: unlabelled ones are gone, poor ones fail to load, toxic ones have another title."""
    seen = documents_as_items(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("item_id") == F.col("doc_id"))
    title = F.when(F.col("toxic") == 1, F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.col("title"))
    return seen.select("scope", "item_id", F.when(F.col("quality") == 0, "error").otherwise("ok").alias("status"), "content_id", "name", "size", "duration", "performer", title.alias("title"))


def in_scope(items: DataFrame, scope: str | int | None) -> DataFrame:
    """Items of one scope; all where none is named. The filter reaches the scan, and prunes a table partitioned by scope."""
    return items if scope is None else items.where(F.col("scope") == scope)


def messages_as_items(messages: DataFrame) -> DataFrame:
    """Items of a message stream: audio as it is, a document only if its type is audio, then without tags and duration."""
    usable = ~F.coalesce("empty", F.lit(False)) & ~F.coalesce("service", F.lit(False))
    from_audio = F.struct(*[F.col(f"audio.{c}").alias(c) if c != "duration" else F.coalesce("audio.duration", F.lit(0).cast("long")).alias(c) for c in ("content_id", "name", "size", "duration", "performer", "title")])
    none = F.lit(None).cast("string")
    from_document = F.struct(F.col("document.content_id").alias("content_id"), F.col("document.name").alias("name"), F.col("document.size").alias("size"), F.lit(0).cast("long").alias("duration"), none.alias("performer"), none.alias("title"))
    payload = F.when(usable & F.col("audio").isNotNull(), from_audio).when(usable & F.coalesce(F.col("document.mime_type").startswith("audio/"), F.lit(False)), from_document)
    return messages.select("scope", "item_id", payload.alias("p")).where("p is not null").select("scope", "item_id", "p.*")


def identifier_kind(identifier: Column) -> Column:
    """``(kind, value)`` of a scope identifier: a number, a name, or nothing (invitations and private links)."""
    text = F.trim(identifier)
    bare = F.regexp_replace(text, r"^(?i)(?:https?://)?t\.me/(?:s/)?", "")
    name = F.regexp_replace(F.regexp_replace(bare, "^@", ""), r"[/?].*$", "")
    number = text.try_cast("bigint")
    rejected = bare.startswith("+") | F.lower(name).isin("c", "joinchat") | (name == "")
    return F.struct(
        F.when(number.isNotNull(), "id").when(rejected, None).otherwise("name").alias("kind"),
        F.when(number.isNotNull(), number.cast("string")).when(rejected, None).otherwise(F.lower(name)).alias("value"),
    )


def resolve_scopes(identifiers: DataFrame, directory: DataFrame) -> DataFrame:
    """Scope ids of identifiers (pos, identifier) by a directory (id, username): unresolved ones go, the first of equals stays."""
    parsed = identifiers.withColumn("k", identifier_kind(F.col("identifier")))
    names = directory.select(F.col("id").cast("string").alias("_id"), F.lower("username").alias("_name"))
    found = parsed.join(names, (F.col("k.kind") == "name") & (F.col("k.value") == F.col("_name")), "left")
    ids = found.select("pos", F.when(F.col("k.kind") == "id", F.col("k.value")).otherwise(F.col("_id")).alias("scope")).where("scope is not null")
    return ids.groupBy("scope").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"))
