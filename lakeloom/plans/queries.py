"""Registered queries: every operator over a whole table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import FuzzyConfig
from lakeloom.functions import display, normalize as N, similarity as S
from lakeloom.operators import classify, groups, merge, output, pairs, quality, score, search, storage, survivor
from lakeloom.plans.runtime import checkpoint_dir, table
from lakeloom.sources import catalog, items as source
from lakeloom.streaming import ingest

CFG = FuzzyConfig(enable=True)
LOOSE = FuzzyConfig(enable=True, threshold=0.8, use_jaccard_penalty=True)
CASCADE = (("largest", 0.02), ("oldest", 0.0))
STRICT = (("best_meta", 0.0), ("longest", 0.0), ("longest_clean_name", 0.0), ("oldest", 0.0))
IGNORED_SCOPE, PATTERNS = "fr", [("en", "^Th"), ("*", "src1$")]
QUERY = "small gizmo"

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.documents_as_items(spark, sf_dir)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.parts_as_items(spark, sf_dir)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def scan_scope_filter(spark, sf_dir):
    return source.in_scope(docs(spark, sf_dir), "de").select("scope", "item_id", "name", "size", "duration")


@query
def broken_rows_count(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("scope").agg(F.count_if(quality.broken()).alias("broken"), F.count(F.lit(1)).alias("n"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors as customers: some balances are negative."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("scope"), F.lit(1).alias("is_fully_synced"), F.floor("c_acctbal").alias("newest_scanned_id"))


@query
def validate_tables(spark, sf_dir):
    return quality.validate(parts(spark, sf_dir), cursors(spark, sf_dir))


@query
def reset_cursors(spark, sf_dir):
    return quality.reset_cursors(cursors(spark, sf_dir))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and of documents, and addresses of pages."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    files = parts(spark, sf_dir).select(F.lit("part").alias("kind"), F.col("item_id").alias("id"), "name")
    lines = docs(spark, sf_dir).select(F.lit("doc").alias("kind"), F.col("item_id").alias("id"), "name")
    return pages.unionByName(files).unionByName(lines)


@query
def clean_name(spark, sf_dir):
    return names(spark, sf_dir).withColumn("cleaned", N.clean_name(F.col("name")))


@query
def clean_for_search(spark, sf_dir):
    return names(spark, sf_dir).withColumn("cleaned", N.clean_for_search(F.col("name")))


@query
def process_text(spark, sf_dir):
    return names(spark, sf_dir).withColumn("comparable", N.comparable(N.clean_name(F.col("name"))))


@query
def clean_meta(spark, sf_dir):
    tags = F.col("performer"), F.col("title")
    return parts(spark, sf_dir).select("scope", "item_id", N.clean_tags(*tags).alias("cleaned"), N.clean_tags_for_search(*tags).alias("searchable"))


@query
def number_tokens(spark, sf_dir):
    return names(spark, sf_dir).select("kind", "id", F.array_join(F.array_sort(N.number_tokens(N.clean_name(F.col("name")))), ",").alias("numbers"))


@query
def format_bytes(spark, sf_dir):
    both = docs(spark, sf_dir).select("item_id", "size").unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.floor(F.col("o_totalprice") * 100_000).alias("size")))
    return both.select("item_id", "size", display.format_bytes(F.col("size")).alias("shown"))


@query
def format_duration(spark, sf_dir):
    return docs(spark, sf_dir).select("item_id", "duration", display.format_duration(F.col("duration")).alias("shown"))


@query
def message_link(spark, sf_dir):
    scoped = F.concat(F.lit("-100"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", display.message_link(scoped, F.col("o_orderkey")).alias("link"))


@query
def display_title(spark, sf_dir):
    return parts(spark, sf_dir).select("item_id", display.display_title(F.when(F.col("duration") > 10, F.col("name")), F.col("performer"), F.col("title")).alias("shown"))


@query
def safe_cells(spark, sf_dir):
    return output.cells(docs(spark, sf_dir).select("item_id", "name", "title", "duration"))


@query
def sanitize_filename(spark, sf_dir):
    return docs(spark, sf_dir).select("item_id", display.sanitize_filename(F.col("name")).alias("file_name"))


@query
def visual_width(spark, sf_dir):
    return docs(spark, sf_dir).select("item_id", display.visual_width(F.col("name")).alias("width"))


@query
def display_widths(spark, sf_dir):
    return output.display_widths(docs(spark, sf_dir), ["item_id", "name", "title"])


@query
def access_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    bit = lambda k: F.floor(F.col("c_custkey") / 2**k) % 2 == 1
    return c.select("c_custkey", output.access(*[bit(k) for k in range(6)]).alias("allowed"))


@query
def chat_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    title, username = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.when(F.col("c_nationkey") > 4, F.lower("c_name"))
    return c.select("c_custkey", display.scope_label(F.col("c_custkey"), title, username).alias("label"))


@query
def resolve_identifiers(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    directory = people.select(F.col("c_custkey").alias("id"), F.regexp_replace(F.lower("c_name"), "#", "").alias("username"))
    asked = people.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_nationkey") < 5, F.col("c_custkey").cast("string")).when(F.col("c_nationkey") < 10, F.concat(F.lit("@"), F.regexp_replace("c_name", "#", ""))).when(F.col("c_nationkey") < 15, F.concat(F.lit("https://t.me/"), F.regexp_replace("c_name", "#", ""))).otherwise(F.lit("t.me/+secret")).alias("identifier"))
    return source.resolve_scopes(asked, directory)


@query
def message_projection(spark, sf_dir):
    payload = F.struct(F.col("props").alias("content_id"), F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("size"), F.lit(None).cast("long").alias("duration"), F.lit("p").alias("performer"), F.lit(None).cast("string").alias("title"))
    mime = F.when(F.col("event_type") == "view", "audio/mpeg").otherwise("text/plain")
    document = F.struct(F.col("props").alias("content_id"), F.col("event_type").alias("name"), F.col("user_id").alias("size"), mime.alias("mime_type"))
    messages = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("item_id"), (F.col("event_type") == "error").alias("empty"), F.lit(False).alias("service"), F.when(F.col("event_type") == "click", payload).alias("audio"), document.alias("document"))
    return source.messages_as_items(messages)


@query
def content_id_pairs(spark, sf_dir):
    return pairs.content_pairs(docs(spark, sf_dir))


@query
def exact_meta_pairs_nullsafe(spark, sf_dir):
    same = docs(spark, sf_dir).withColumn("size", F.lit(None).cast("long")).withColumn("duration", F.lit(1).cast("long")).withColumn("performer", F.lit(None).cast("string"))
    return pairs.metadata_pairs(same.withColumn("title", F.when(F.length("title") < 60, F.col("title"))))


@query
def exact_edges_with_reason(spark, sf_dir):
    return pairs.exact_edges(docs(spark, sf_dir).withColumn("performer", F.lit(None).cast("string")))


@query
def exact_groups(spark, sf_dir):
    return groups.exact_groups(docs(spark, sf_dir))


@query
def group_sizes(spark, sf_dir):
    return exact_groups(spark, sf_dir).groupBy("scope", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query
def band_join_pairs(spark, sf_dir):
    joined = pairs.band_self_join(docs(spark, sf_dir).select("scope", "item_id", "duration"), CFG.max_duration_diff_sec)
    return joined.select(F.col("x.scope").alias("scope"), F.col("x.item_id").alias("first"), F.col("y.item_id").alias("second"), (F.col("y.duration") - F.col("x.duration")).alias("apart"))


@query
def band_window_counts(spark, sf_dir):
    return pairs.window_counts(docs(spark, sf_dir), CFG.max_duration_diff_sec)


def scored_pairs(spark: SparkSession, sf_dir: str, cfg: FuzzyConfig = CFG) -> DataFrame:
    """Pairs of chunks of equal parts."""
    return score.chunk_pairs(parts(spark, sf_dir), cfg)


@query
def pair_numeric_scores(spark, sf_dir):
    return pairs.spread(rounded(scored_pairs(spark, sf_dir), "duration_score", "size_score"), "duration_score", "size_score")


@query
def dynamic_threshold(spark, sf_dir):
    return pairs.spread(rounded(scored_pairs(spark, sf_dir), "threshold"), "threshold")


def penalties(spark: SparkSession, sf_dir: str, jaccard: bool) -> DataFrame:
    penalty = score.number_penalty(F.col("x.name_numbers"), F.col("y.name_numbers"), CFG.penalty_numbers_mismatch, jaccard)
    return pairs.spread(rounded(scored_pairs(spark, sf_dir).withColumn("penalty", penalty), "penalty"), "penalty")


@query
def number_penalty_binary(spark, sf_dir):
    return penalties(spark, sf_dir, False)


@query
def number_penalty_jaccard(spark, sf_dir):
    return penalties(spark, sf_dir, True)


def ratios(spark: SparkSession, sf_dir: str, ratio) -> DataFrame:
    """The distinct pairs of texts, of all four sources, that items in the duration band are compared by."""
    four = F.array(*[F.struct(F.col(f"x.{i}_text").alias("a"), F.col(f"y.{j}_text").alias("b")) for i, j in score.SOURCES])
    asked = scored_pairs(spark, sf_dir).select(F.explode(four).alias("p")).select("p.*").distinct()
    return rounded(asked.withColumn("ratio", ratio("a", "b")), "ratio")


@query
def indel_ratio(spark, sf_dir):
    return ratios(spark, sf_dir, S.indel_ratio)


@query
def token_sort_ratio(spark, sf_dir):
    return ratios(spark, sf_dir, S.token_sort_ratio)


@query
def token_set_ratio(spark, sf_dir):
    return ratios(spark, sf_dir, S.token_set_ratio)


@query
def weighted_ratio(spark, sf_dir):
    return ratios(spark, sf_dir, S.weighted_ratio)


@query
def best_text_source(spark, sf_dir):
    best = score.best_text(scored_pairs(spark, sf_dir), CFG)
    told = best.select("x", "y", (-F.col("text.order")).cast("int").alias("text_source"), F.col("text.ratio").alias("ratio"), F.col("text.penalty").alias("penalty"))
    return pairs.spread(rounded(told, "ratio", "penalty"), "text_source", "ratio", "penalty")


def shown_edges(edges: DataFrame) -> DataFrame:
    return rounded(edges, "score", "name_score", "duration_score", "size_score", "penalty").withColumn("text_source", display.source_suffix(F.col("text_source")))


@query
def fuzzy_edges(spark, sf_dir):
    return groups.fuzzy_edges(parts(spark, sf_dir), CFG, shown_edges)


@query
def fuzzy_edges_loose(spark, sf_dir):
    return groups.fuzzy_edges(parts(spark, sf_dir), LOOSE, shown_edges)


@query
def fuzzy_groups(spark, sf_dir):
    return groups.fuzzy_groups(parts(spark, sf_dir), CFG)


@query
def fuzzy_groups_documents(spark, sf_dir):
    return groups.fuzzy_groups(docs(spark, sf_dir), CFG)


@query
def score_distribution(spark, sf_dir):
    return rounded(groups.score_distribution(score.fuzzy_links(parts(spark, sf_dir), CFG)), "least", "p25", "median", "p75", "most")


@query
def match_rate(spark, sf_dir):
    links = score.fuzzy_links(parts(spark, sf_dir), CFG).agg(F.count(F.lit(1)).alias("links"))
    candidates = pairs.band_pairs(parts(spark, sf_dir), CFG.max_duration_diff_sec)
    return links.join(candidates).withColumn("rate", F.round(F.try_divide("links", "candidates"), 6))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return rows.join(groups.exact_groups(rows), ["scope", "item_id"])


@query
def survivor_winner(spark, sf_dir):
    return survivor.winners(members(spark, sf_dir), CASCADE).select("scope", "group_id", "item_id", "keep")


@query
def survivor_order(spark, sf_dir):
    return survivor.keep_order(members(spark, sf_dir), STRICT).select("scope", "group_id", "item_id", F.col("keep_rank").cast("int").alias("keep_rank"))


@query
def survivor_order_tolerant(spark, sf_dir):
    grouped = parts(spark, sf_dir).join(groups.fuzzy_groups(parts(spark, sf_dir), CFG), ["scope", "item_id"])
    return survivor.keep_order(grouped, (("largest", 0.1), ("longest", 0.05), ("oldest", 0.0))).select("scope", "group_id", "item_id", "keep_rank")


@query
def survivor_order_least(spark, sf_dir):
    return survivor.keep_order(members(spark, sf_dir), (("smallest", 0.0), ("shortest", 0.0), ("newest", 0.0))).select("scope", "group_id", "item_id", F.col("keep_rank").cast("int").alias("keep_rank"))


@query
def best_meta_score(spark, sf_dir):
    return parts(spark, sf_dir).select("item_id", survivor.tag_quality().alias("quality"))


def ranked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = classify.verified(members(spark, sf_dir), source.label_snapshot(spark, sf_dir))
    return survivor.keep_order(checked, (("largest", 0.0), ("oldest", 0.0)))


@query
def verify_status(spark, sf_dir):
    checked = classify.verified(members(spark, sf_dir), source.label_snapshot(spark, sf_dir))
    return checked.groupBy("scope", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def classify_actions(spark, sf_dir):
    return classify.classified(ranked_members(spark, sf_dir)).select("scope", "group_id", "item_id", "action")


@query
def group_veto(spark, sf_dir):
    return classify_actions(spark, sf_dir).where("action = 'skipped'").select("scope", "group_id").distinct()


@query
def ignore_list_filter(spark, sf_dir):
    ignored = docs(spark, sf_dir).where(F.col("scope") == IGNORED_SCOPE).select("scope", "item_id")
    return classify.not_ignored(classify.classified(ranked_members(spark, sf_dir)), ignored).select("scope", "item_id", "action")


@query
def regex_protection(spark, sf_dir):
    return docs(spark, sf_dir).where(classify.protects(PATTERNS)).select("scope", "item_id")


@query
def delete_batches(spark, sf_dir):
    return classify.batched(docs(spark, sf_dir).select("scope", "item_id"), 100)


@query
def planned_changes(spark, sf_dir):
    return classify.planned_changes(classify.classified(ranked_members(spark, sf_dir)))


def stored_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events stored before, and a batch that overlaps with them and has other values."""
    events = table(spark, sf_dir, "events")
    batch = events.where("event_type <> 'click'").withColumn("value", F.col("value") + 1)
    return source.events_as_items(events.where("event_type <> 'view'")), source.events_as_items(batch)


@query
def insert_or_ignore(spark, sf_dir):
    return merge.insert_or_ignore(*stored_and_batch(spark, sf_dir)).select("scope", "item_id", "name", "size")


@query
def upsert_latest(spark, sf_dir):
    return merge.upsert(*stored_and_batch(spark, sf_dir)).select("scope", "item_id", "name", "size")


def repeated_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored events, and a batch in which every key stands twice."""
    stored, batch = stored_and_batch(spark, sf_dir)
    return stored, batch.unionByName(batch.withColumn("size", F.col("size") + 7))


@query
def upsert_repeated_keys(spark, sf_dir):
    return merge.upsert(*repeated_batch(spark, sf_dir), ["size"]).select("scope", "item_id", "name", "size")


@query
def update_repeated_keys(spark, sf_dir):
    return merge.update_by_key(*repeated_batch(spark, sf_dir), ["size"]).select("scope", "item_id", "name", "size")


@query
def delete_by_key(spark, sf_dir):
    return merge.delete_by_key(*stored_and_batch(spark, sf_dir)).select("scope", "item_id", "name", "size")


@query
def update_by_key(spark, sf_dir):
    return merge.update_by_key(*stored_and_batch(spark, sf_dir)).select("scope", "item_id", "name", "size")


@query
def cursor_high_water(spark, sf_dir):
    stored, batch = stored_and_batch(spark, sf_dir)
    before = merge.advance_cursors(spark.createDataFrame([], "scope string, is_fully_synced int, newest_scanned_id long"), stored)
    return merge.advance_cursors(before, batch)


@query
def incremental_rows(spark, sf_dir):
    stored, batch = stored_and_batch(spark, sf_dir)
    at = stored.groupBy("scope").agg(F.lit(1).alias("is_fully_synced"), F.expr("cast(percentile(item_id, 0.5) as bigint)").alias("newest_scanned_id"))
    return merge.increment(batch, at).select("scope", "item_id")


@query
def repair_plan(spark, sf_dir):
    items = docs(spark, sf_dir).withColumn("duration", F.when(F.length("title") > 100, -1).otherwise(F.col("duration")))
    return quality.repair_plan(items, source.label_snapshot(spark, sf_dir)).select("scope", "item_id", "step")


@query
def repaired_items(spark, sf_dir):
    items = docs(spark, sf_dir).withColumn("duration", F.when(F.length("title") > 100, -1).otherwise(F.col("duration")))
    return quality.repaired(items, quality.repair_plan(items, source.label_snapshot(spark, sf_dir))).select("scope", "item_id", "duration", "title")


@query
def export_filenames(spark, sf_dir):
    return output.filenames(docs(spark, sf_dir)).select("name")


@query
def export_filenames_with_links(spark, sf_dir):
    return output.filenames_with_links(parts(spark, sf_dir)).select("line")


@query
def export_cleaned_names(spark, sf_dir):
    return output.cleaned_names(parts(spark, sf_dir)).select("name", "cleaned", "comparable")


@query
def export_cleaned_meta(spark, sf_dir):
    return output.cleaned_tags(parts(spark, sf_dir)).select("performer", "title", "cleaned", "comparable")


@query
def report_rows(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return output.report_rows(rows, groups.exact_groups(rows), (("largest", 0.0), ("oldest", 0.0)))


@query
def report_edges(spark, sf_dir):
    rows = parts(spark, sf_dir)
    found, links = groups.groups_with_edges(rows, CFG)
    ordered = output.report_edges(links, found)
    return rounded(ordered.select("scope", "group_id", "a", "b", "score"), "score")


@query
def report_text(spark, sf_dir):
    """The report of the parts' fuzzy groups, line by line."""
    rows = parts(spark, sf_dir)
    found, edges = groups.groups_with_edges(rows, CFG, same=True)
    return output.report_lines(rows, found, edges, (("largest", 0.0), ("oldest", 0.0)))


@query
def search_top_k(spark, sf_dir):
    return rounded(search.search(parts(spark, sf_dir), QUERY, limit=50).select("scope", "item_id", "score"), "score")


@query
def search_all(spark, sf_dir):
    hits = search.scored(parts(spark, sf_dir), QUERY).where(F.col("score") >= search.CUTOFF)
    return rounded(hits.select("scope", "item_id", "score"), "score")


@query
def search_wratio(spark, sf_dir):
    hits = search.scored(parts(spark, sf_dir), QUERY, wratio=True).where(F.col("score") >= search.CUTOFF)
    return rounded(hits.select("scope", "item_id", "score"), "score")


@query
def search_listing(spark, sf_dir):
    return search.listing(search.search(docs(spark, sf_dir), "theatly there", limit=50))


@query
def retention_newest_n(spark, sf_dir):
    return merge.newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("name")).withColumn("name", F.concat_ws("_", "name", F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))), 3, by=["o_custkey"])


@query
def snapshot_fingerprint(spark, sf_dir):
    return merge.fingerprint(docs(spark, sf_dir)).select("n", F.col("hash").cast("string").alias("hash"))


def planned_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    there = rows.where("duration > 25").select("name", F.col("size"), F.lit(0.0).alias("mtime")).groupBy("name").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    return output.download_plan(rows, there)


@query
def download_plan(spark, sf_dir):
    return planned_downloads(spark, sf_dir)


@query
def download_totals(spark, sf_dir):
    return output.download_totals(planned_downloads(spark, sf_dir))


@query
def stream_incremental_ingest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = source.events_as_items(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]"))
    folder = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingest.ingest(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{folder}/table").select("scope", "item_id", "name", "size")


@query
def forced_refresh(spark, sf_dir):
    """The table after a run that adds, and a run from a new checkpoint that replaces."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    folder = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingest.ingest(source.events_as_items(stream.where("event_type <> 'view'")), f"{folder}/table", f"{folder}/first").awaitTermination()
    changed = stream.where("event_type <> 'click'").withColumn("value", F.col("value") + 1)
    ingest.ingest(source.events_as_items(changed), f"{folder}/table", f"{folder}/second", refresh=True).awaitTermination()
    return ingest.current(spark, f"{folder}/table").select("scope", "item_id", "name", "size")


@query
def backups_kept(spark, sf_dir):
    """What is left of five copies, one of them unchanged, with two to keep and one to archive."""
    rows, folder = docs(spark, sf_dir), f"{checkpoint_dir(spark)}/backup-{uuid.uuid4().hex}"
    stored = [rows.where("scope = 'de'"), rows.where("scope = 'en'"), rows.where("scope = 'en'"), rows.where("scope <> 'de'"), rows]
    for i, df in enumerate(stored, 1):
        storage.back_up(df, folder, f"copy{i}", keep=2, archives=1)
    read = [storage.restored(spark, folder, c.stamp).select(F.lit(kind).alias("kind"), F.lit(c.stamp).alias("stamp"), "scope") for kind, at in (("copy", folder), ("archive", f"{folder}/{storage.ARCHIVE}")) for c in storage.copies(spark, at)]
    return reduce(DataFrame.unionByName, read).groupBy("kind", "stamp", "scope").agg(F.count(F.lit(1)).alias("n"))


@query
def vacuumed(spark, sf_dir):
    """Items written to many small files, and read after these were rewritten."""
    folder = f"{checkpoint_dir(spark)}/vacuum-{uuid.uuid4().hex}"
    source.events_as_items(table(spark, sf_dir, "events")).repartition(16).write.parquet(folder)
    storage.vacuum(spark, folder)
    return spark.read.parquet(folder).select("scope", "item_id", "name", "size")


@query
def catalog_columns(spark, sf_dir):
    return catalog.columns(spark, sf_dir).select("table", "position", "column")


@query
def missing_tables(spark, sf_dir):
    return catalog.missing(spark, sf_dir, ["cursors", "documents", "events", "ignored", "items"])


@query
def download_names(spark, sf_dir):
    """Names by an event's type, of which most have no extension."""
    mime = F.when(F.col("event_type") == "click", "audio/ogg").when(F.col("event_type") == "view", "audio/mpeg").when(F.col("event_type") == "error", "audio/nothing")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("item_id"), F.when(F.col("event_type") != "view", F.concat("event_type", F.lit("."), "event_type")).alias("name"), F.lit(1).alias("size"), mime.alias("mime_type"))
    nothing = spark.createDataFrame([], "name string, size long, mtime double")
    return output.download_plan(rows.withColumn("name", F.when(F.col("mime_type") == "audio/ogg", "click").otherwise(F.col("name"))), nothing).select("scope", "item_id", "file_name")


@query
def archive_gate(spark, sf_dir):
    batches = classify.batched(docs(spark, sf_dir).select("scope", "item_id"), 20)
    archived = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs(spark, sf_dir).select("scope", "item_id"), F.col("doc_id") == F.col("item_id"), "right")
    return classify.archive_gate(batches, archived.select("scope", "item_id", (F.coalesce("toxic", F.lit(0)) == 0).alias("ok")))


@query
def gone_items(spark, sf_dir):
    there = source.label_snapshot(spark, sf_dir).where("status = 'ok'")
    return classify.confirmed_gone(docs(spark, sf_dir).select("scope", "item_id"), there)


@query
def spread_errors(spark, sf_dir):
    return classify.spread_errors(source.label_snapshot(spark, sf_dir).select("scope", "item_id", "status"), 25)
