"""Memory state as snapshots: every transition takes DataFrames and returns new ones; nothing is updated in place."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import staged

STATUSES = ["active", "compressed", "archived", "forgotten"]
LABEL_CHARS, LABEL_LEAST, IDLE_DAYS, MOST_RETRIEVALS = 120, 10, 30, 1_000_000

UNIT_SCHEMA = (
    "mu_id string, conversation_id string, session_id string, claim string, original_text string, source_dia_ids array<string>, source_speaker string, "
    "timestamp string, topic string, entities array<string>, importance double, confidence double, salience double, retrieval_count long, created_at timestamp, "
    "updated_at timestamp, last_accessed timestamp, status string, user_pinned boolean, needs_reindex boolean, compressed_label_id string, archived_entry_id string"
)
LABEL_SCHEMA = (
    "label_id string, archived_pointer string, mu_id string, conversation_id string, topic string, short_summary string, key_entities array<string>, "
    "original_dia_ids array<string>, compressed_at timestamp, retrieval_count long, last_label_match timestamp, time_range string"
)
ARCHIVE_SCHEMA = "archived_entry_id string, label_pointer string, mu_id string, conversation_id string, full_memory_unit_json string, archived_at timestamp, restoration_count long"
EDGE_SCHEMA = "source_mu_id string, target_mu_id string, edge_type string, weight double, metadata_json string"
AUDIT_SCHEMA = "mu_id string, conversation_id string, source_dia_ids array<string>, deleted_at timestamp, deleted_by string"


class Memory(NamedTuple):
    """All tables of a store at one moment."""

    units: DataFrame
    labels: DataFrame
    archives: DataFrame
    edges: DataFrame
    audit: DataFrame


def empty_memory(spark) -> Memory:
    return Memory(*(spark.createDataFrame([], s) for s in (UNIT_SCHEMA, LABEL_SCHEMA, ARCHIVE_SCHEMA, EDGE_SCHEMA, AUDIT_SCHEMA)))


def staged_memory(memory: Memory) -> Memory:
    """All tables written to the shared folder, so that the next batch starts from them."""
    return Memory(*(staged(t, name) for name, t in zip(Memory._fields, memory, strict=True)))


def inserted(units: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Units with new ones. ``strict`` raises on an id that exists or comes twice; else :func:`repeated_ids` shows it."""
    out = units.unionByName(new, allowMissingColumns=True)
    if strict and (bad := repeated_ids(out).limit(1).collect()):
        raise ValueError(f"id exists already: {bad[0][0]}")
    return out


def looked_up(units: DataFrame, ids: DataFrame, key: str = "mu_id", required: bool = False) -> DataFrame:
    """One row an id with ``found`` and its unit's columns, null where there is none; ``required`` raises then."""
    out = ids.select(key).distinct().join(units.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if required and (lost := out.where("NOT found").limit(1).collect()):
        raise KeyError(lost[0][key])
    return out


def repeated_ids(units: DataFrame, key: str = "mu_id") -> DataFrame:
    return units.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def overlaid(table: DataFrame, changes: DataFrame, key: str = "mu_id") -> DataFrame:
    """``table`` with the columns of ``changes`` wherever it has the key; null values of a change count."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def with_accesses(units: DataFrame, accesses: DataFrame) -> DataFrame:
    """Retrieval counts and last access brought up to date with an access log (mu_id, ts)."""
    seen = accesses.groupBy("mu_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    return units.join(seen, "mu_id", "left").withColumns({
        "retrieval_count": F.least(F.col("retrieval_count") + F.coalesce("_n", F.lit(0)), F.lit(MOST_RETRIEVALS)),
        "last_accessed": F.greatest("last_accessed", "_ts"),
    }).select(units.columns)


def layer(status: Column | None = None, label: Column | None = None) -> Column:
    """The four layers shown to users: an archived unit with a label is a compressed one."""
    status = F.col("status") if status is None else status
    label = F.col("compressed_label_id") if label is None else label
    return F.when((status == "archived") & label.isNotNull(), "compressed").otherwise(status)


def status_counts(units: DataFrame, layers: bool = False) -> DataFrame:
    """``conversation_id, status, n`` with a zero for every status that a conversation lacks."""
    named = units.select("conversation_id", (layer() if layers else F.col("status")).alias("status"))
    grid = units.select("conversation_id").distinct().select("conversation_id", F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    counted = named.groupBy("conversation_id", "status").agg(F.count("*").alias("n"))
    return grid.join(counted, ["conversation_id", "status"], "left").select("conversation_id", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def archived_by_type(units: DataFrame) -> DataFrame:
    return units.where("status = 'archived'").groupBy("conversation_id").agg(
        F.count_if(F.col("compressed_label_id").isNotNull()).alias("labelled"), F.count_if(F.col("compressed_label_id").isNull()).alias("superseded")
    )


def storage_pressure(units: DataFrame, capacity: int) -> DataFrame:
    """Share of the capacity that active units take; 0 where there is no capacity."""
    active = F.count_if(F.col("status") == "active")
    share = active / F.lit(float(capacity)) if capacity > 0 else F.lit(0.0)
    return units.groupBy("conversation_id").agg(active.alias("n_active"), F.round(share, 6).alias("pressure"))


def listed(rows: DataFrame, status: str | list[str] | None = None, conversation: str | None = None, layers: bool = False) -> DataFrame:
    """Rows of a table, of some statuses and one conversation if asked; ``layers`` renames statuses to the four layers."""
    found = rows
    if status is not None:
        found = found.where(F.col("status").isin([status] if isinstance(status, str) else status))
    if conversation is not None:
        found = found.where(F.col("conversation_id") == conversation)
    if layers:
        found = found.withColumn("status", layer())
    order = [c for c in ("created_at", "compressed_at", "archived_at", "mu_id", "source_mu_id", "target_mu_id") if c in rows.columns]
    return found.orderBy(*order)


def labels_for(units: DataFrame, now: Column, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels and archive entries of units about to be compressed; the archive keeps the whole row as JSON.

    ``summaries`` (mu_id, summary) are a model's; those that are missing or below ``LABEL_LEAST`` characters fall back to the
    claim, cut.
    """
    if summaries is not None:
        units = units.join(summaries.select("mu_id", F.trim("summary").alias("_summary")), "mu_id", "left")
        short = F.when(F.length("_summary") >= LABEL_LEAST, F.col("_summary")).otherwise(F.substring("claim", 1, LABEL_CHARS))
    else:
        units, short = units.withColumn("_summary", F.lit(None).cast("string")), F.substring("claim", 1, LABEL_CHARS)
    time_range = F.coalesce(F.col("timestamp").cast("string"), F.lit("")) if "timestamp" in units.columns else F.lit("")
    name = lambda kind: F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "mu_id"), 256), 1, 16))
    whole = F.to_json(F.struct(*[c for c in units.columns if c != "_summary"]))
    labels = units.select(
        name("label").alias("label_id"), name("archive").alias("archived_pointer"), "mu_id", "conversation_id", "topic", short.alias("short_summary"),
        F.col("entities").alias("key_entities"), F.col("source_dia_ids").alias("original_dia_ids"), now.alias("compressed_at"), F.lit(0).cast("long").alias("retrieval_count"),
        F.lit(None).cast("timestamp").alias("last_label_match"), time_range.alias("time_range"),
    )
    archives = units.select(
        name("archive").alias("archived_entry_id"), name("label").alias("label_pointer"), "mu_id", "conversation_id", whole.alias("full_memory_unit_json"), now.alias("archived_at"),
        F.lit(0).cast("long").alias("restoration_count"),
    )
    return labels, archives


def compressed(memory: Memory, chosen: DataFrame, now: Column, summaries: DataFrame | None = None, strict: bool = False) -> Memory:
    """Chosen active units become archived with a label and an archive entry that point to each other.

    ``strict`` raises if one of them can't be; else :func:`compression_results` tells which.
    """
    if strict and (bad := compression_results(memory, chosen).where("NOT ok").limit(1).collect()):
        raise ValueError(f"{bad[0]['mu_id']}: {bad[0]['error']}")
    moving = memory.units.where("status = 'active'").join(chosen.select("mu_id"), "mu_id", "left_semi").select(memory.units.columns)
    labels, archives = labels_for(moving, now, summaries)
    change = labels.select("mu_id", F.lit("archived").alias("status"), F.col("label_id").alias("compressed_label_id"), F.col("archived_pointer").alias("archived_entry_id"), now.alias("updated_at"))
    return memory._replace(units=overlaid(memory.units, change), labels=memory.labels.unionByName(labels), archives=memory.archives.unionByName(archives))


def compression_results(memory: Memory, chosen: DataFrame) -> DataFrame:
    """``mu_id, ok, error`` of what compressing would do to each chosen id."""
    found = looked_up(memory.units.select("mu_id", "status"), chosen)
    error = F.when(~F.col("found"), "unit not found").when(F.col("status") != "active", "status is not active")
    return found.select("mu_id", error.isNull().alias("ok"), error.alias("error"))


def mismatched_pointers(labels: DataFrame, archives: DataFrame) -> DataFrame:
    """``mu_id`` of labels and archive entries of one unit that do not name each other."""
    both = labels.select("mu_id", "label_id", "archived_pointer").join(archives.select("mu_id", "archived_entry_id", "label_pointer"), "mu_id", "full")
    right = (F.col("label_id") == F.col("label_pointer")) & (F.col("archived_entry_id") == F.col("archived_pointer"))
    return both.where(~F.coalesce(right, F.lit(False))).select("mu_id")


def entries_of(table: DataFrame, units: DataFrame) -> DataFrame:
    """Labels or archive entries of the named units (mu_id)."""
    return table.join(units.select("mu_id").distinct(), "mu_id", "left_semi").select(table.columns)


def without_entries(table: DataFrame, units: DataFrame) -> DataFrame:
    """Labels or archive entries but those of the named units."""
    return table.join(units.select("mu_id").distinct(), "mu_id", "left_anti").select(table.columns)


def _moved(memory: Memory, chosen: DataFrame, status: str, now: Column, reindex: bool) -> Memory:
    none = F.lit(None).cast("string")
    ids = chosen.select("mu_id").distinct()
    change = ids.select("mu_id", F.lit(status).alias("status"), none.alias("compressed_label_id"), none.alias("archived_entry_id"), now.alias("updated_at"), F.lit(reindex).alias("needs_reindex"))
    without = lambda t: t.join(ids, "mu_id", "left_anti").select(t.columns)
    return memory._replace(units=overlaid(memory.units, change), labels=without(memory.labels), archives=without(memory.archives))


def restored(memory: Memory, chosen: DataFrame, now: Column) -> Memory:
    """Archived or compressed units become active again; their labels and archive entries go."""
    able = memory.units.where(F.col("status").isin("archived", "compressed")).join(chosen.select("mu_id"), "mu_id", "left_semi")
    return _moved(memory, able, "active", now, True)


def restored_from_forgotten(memory: Memory, chosen: DataFrame, now: Column) -> Memory:
    able = memory.units.where("status = 'forgotten'").join(chosen.select("mu_id"), "mu_id", "left_semi")
    return _moved(memory, able, "active", now, True)


def forgotten(memory: Memory, chosen: DataFrame, now: Column) -> Memory:
    """Units of any status become forgotten; labels and archive entries go. Doing so twice changes nothing more."""
    return _moved(memory, memory.units.join(chosen.select("mu_id"), "mu_id", "left_semi"), "forgotten", now, False)


def idle_labels(labels: DataFrame, now: Column, days: int = IDLE_DAYS) -> DataFrame:
    """Labels that nothing has matched for longer than ``days``."""
    return labels.where(F.coalesce("last_label_match", "compressed_at").cast("timestamp") < now - F.make_dt_interval(F.lit(days)))


def decayed(memory: Memory, now: Column, days: int = IDLE_DAYS) -> Memory:
    return forgotten(memory, idle_labels(memory.labels, now, days), now)


def deleted(memory: Memory, chosen: DataFrame, now: Column, by: str = "user") -> Memory:
    """Units removed with labels, archive entries and edges; an audit row stays for each that existed."""
    ids = chosen.select("mu_id").distinct()
    gone = memory.units.join(ids, "mu_id", "left_semi").select("mu_id", "conversation_id", "source_dia_ids", now.alias("deleted_at"), F.lit(by).alias("deleted_by"))
    without = lambda t, key="mu_id": t.join(ids.select(F.col("mu_id").alias(key)), key, "left_anti").select(t.columns)
    return Memory(without(memory.units), without(memory.labels), without(memory.archives), without(without(memory.edges, "source_mu_id"), "target_mu_id"), memory.audit.unionByName(gone))


def label_hits(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """Labels with counts and last match brought up to date with hits (label_id, ts)."""
    seen = hits.groupBy("label_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    return labels.join(seen, "label_id", "left").withColumns({
        "retrieval_count": F.col("retrieval_count") + F.coalesce("_n", F.lit(0)), "last_label_match": F.greatest("last_label_match", "_ts"),
    }).select(labels.columns)


def archived_units(archives: DataFrame) -> DataFrame:
    """The archived rows read back from their JSON; unreadable ones are null."""
    return archives.select("mu_id", "archived_entry_id", F.from_json("full_memory_unit_json", UNIT_SCHEMA).alias("unit"))


def verified(memory: Memory, mu_ids: DataFrame) -> DataFrame:
    """``mu_id, valid, issues`` of a consistency check of compressed units."""
    units = mu_ids.select("mu_id").join(memory.units.select("mu_id", F.lit(True).alias("_known"), "status", "compressed_label_id", "archived_entry_id"), "mu_id", "left")
    labels = memory.labels.select(F.col("label_id").alias("compressed_label_id"), F.lit(True).alias("_label"), "archived_pointer")
    read = F.from_json("full_memory_unit_json", "mu_id string")["mu_id"]
    archives = memory.archives.select("archived_entry_id", F.lit(True).alias("_archive"), "label_pointer", read.alias("_archived_mu"))
    t = units.join(labels, "compressed_label_id", "left").join(archives, "archived_entry_id", "left")
    both = F.col("_label") & F.col("_archive")
    rules = [
        (F.col("compressed_label_id").isNull(), "no label id"), (F.col("compressed_label_id").isNotNull() & F.col("_label").isNull(), "label not found"),
        (F.col("archived_entry_id").isNull(), "no archive id"), (F.col("archived_entry_id").isNotNull() & F.col("_archive").isNull(), "archive not found"),
        (both & (F.col("archived_pointer") != F.col("archived_entry_id")), "label points elsewhere"), (both & (F.col("label_pointer") != F.col("compressed_label_id")), "archive points elsewhere"),
        (F.col("_archive") & F.col("_archived_mu").isNull(), "archive is unreadable"), (F.col("_archive") & (F.col("_archived_mu") != F.col("mu_id")), "archive holds another unit"),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]), lambda x: x.isNotNull())
    issues = F.when(F.col("_known").isNull(), F.array(F.lit("unit not found"))).when(~F.col("status").isin("archived", "compressed"), F.array(F.lit("status is not archived"))).otherwise(found)
    return t.select("mu_id", (F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def audit_log(audit: DataFrame) -> DataFrame:
    return audit.orderBy("conversation_id", "deleted_at", "mu_id")


def replaced_by(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``mu_id, replaced_by``: claims of the units that supersede it; missing ones are left out."""
    target = units.select(F.col("mu_id").alias("target_mu_id"), "claim")
    pairs = edges.where("edge_type = 'superseded_by'").join(target, "target_mu_id")
    return pairs.groupBy(F.col("source_mu_id").alias("mu_id")).agg(F.array_sort(F.collect_list("claim")).alias("replaced_by"))


def with_status(units: DataFrame, chosen: DataFrame, status: str, now: Column) -> DataFrame:
    """Chosen units with a new status; their links to label and archive entry are cut."""
    none = F.lit(None).cast("string")
    return overlaid(units, chosen.select("mu_id").distinct().select("mu_id", F.lit(status).alias("status"), none.alias("compressed_label_id"), none.alias("archived_entry_id"), now.alias("updated_at")))


def pinned(units: DataFrame, chosen: DataFrame, value: bool = True) -> DataFrame:
    return overlaid(units, chosen.select("mu_id").distinct().withColumn("user_pinned", F.lit(value)))


def needing_reindex(units: DataFrame) -> DataFrame:
    return units.where("needs_reindex").orderBy("created_at", "mu_id")


def reindexed(units: DataFrame, chosen: DataFrame) -> DataFrame:
    return overlaid(units, chosen.select("mu_id").distinct().withColumn("needs_reindex", F.lit(False)))


def edges_at(edges: DataFrame, ids: DataFrame, end: str = "source", edge_type: str | None = None) -> DataFrame:
    """Edges from (``end="source"``) or to (``"target"``) the named units."""
    chosen = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return chosen.join(ids.select(F.col("mu_id").alias(f"{end}_mu_id")).distinct(), f"{end}_mu_id", "left_semi").select(edges.columns)


def compression_stats(units: DataFrame) -> DataFrame:
    """One row a conversation: a count for each status, and the total."""
    return units.groupBy("conversation_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))
