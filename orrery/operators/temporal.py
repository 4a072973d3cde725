"""Bitemporal facts, change sets and provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_versions(facts: DataFrame) -> DataFrame:
    """Version numbers and closed transaction times.

    facts(tenant_id, fact_id, field, value, valid_from, valid_to, recorded_at): every row is a version; a version ends
    when the next one of its fact is recorded. The digest leaves tx_to out, so closing a version does not change it.
    """
    w = Window.partitionBy("tenant_id", "fact_id").orderBy("recorded_at")
    out = facts.withColumn("version", F.row_number().over(w)).withColumn("tx_from", F.col("recorded_at")).withColumn("tx_to", F.lead("recorded_at").over(w))
    content = [F.col(c) for c in ("tenant_id", "fact_id", "version", "field", "value", "valid_from", "valid_to", "tx_from")]
    return out.withColumn("fact_digest", F.sha2(F.to_json(F.struct(*content)), 256))


def version_faults(versions: DataFrame) -> DataFrame:
    """Facts whose transaction time does not advance or whose field changes from one version to the next."""
    w = Window.partitionBy("tenant_id", "fact_id").orderBy("version")
    stuck = F.lag("tx_from").over(w) >= F.col("tx_from")
    other = ~F.lag("field").over(w).eqNullSafe(F.col("field")) & F.lag("version").over(w).isNotNull()
    return versions.withColumn("fault", F.when(stuck, "time").when(other, "identity")).where("fault is not null")


def as_of(versions: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """Versions that hold at ``valid_at`` as known at ``known_at``; both filters reach the scan."""
    return versions.where((F.col("valid_from") <= valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at)) & (F.col("tx_from") <= known_at) & (F.col("tx_to").isNull() | (F.col("tx_to") > known_at)))


def as_of_probes(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """J6 for many probes (fact_id, at): the version that was known at each. Equi-join on the fact with a time test."""
    return probes.join(versions, "fact_id").where((F.col("tx_from") <= F.col("at")) & (F.col("tx_to").isNull() | (F.col("tx_to") > F.col("at"))))


def snapshot(versions: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """Values of each object as a map; an object with two facts for one field is flagged and has no values."""
    now = as_of(versions, valid_at, known_at)
    by_field = now.groupBy("object_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    out = by_field.groupBy("object_id").agg(F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct("field", "value"))).alias("v"))
    return out.select("object_id", (F.col("most") > 1).alias("conflict"), F.when(F.col("most") == 1, F.map_from_entries("v")).alias("values"))


def verify_digests(versions: DataFrame) -> DataFrame:
    """Z3: versions whose digest does not fit their content."""
    content = [F.col(c) for c in ("tenant_id", "fact_id", "version", "field", "value", "valid_from", "valid_to", "tx_from")]
    return versions.where(F.sha2(F.to_json(F.struct(*content)), 256) != F.col("fact_digest"))


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def change_set(old: DataFrame, new: DataFrame, key: str, full_snapshot: bool = True) -> DataFrame:
    """(key, change) of added, updated and, for full snapshots, deleted rows."""
    columns = sorted(c for c in new.columns if c != key and c in old.columns)
    a, b = old.select(key, row_hash(columns).alias("was")), new.select(key, row_hash(columns).alias("is"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted" if full_snapshot else None).when(F.col("was") != F.col("is"), "updated")
    return j.select(key, change.alias("change")).where("change is not null")


def identity_faults(batch: DataFrame, key: str) -> DataFrame:
    """Rows without a key, and keys that stand more than once."""
    counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col(key).isNull() | (F.col("n") > 1)).select(key, "n", F.when(F.col(key).isNull(), "missing").otherwise("duplicate").alias("fault"))


def schema_drift(old: DataFrame | None, new: DataFrame) -> dict[str, list[str]]:
    """U4: field names that came and went; nothing on the first batch."""
    if old is None:
        return {"added": [], "removed": []}
    return {"added": sorted(set(new.columns) - set(old.columns)), "removed": sorted(set(old.columns) - set(new.columns))}


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """files(path, content_hash): added, deleted, modified, unchanged, and renamed (old path beside it).

    Deleted and added files of one content are paired one to one, in order of their paths.
    """
    j = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("is")), "path", "full_outer")
    gone = j.where("is is null").select(F.col("path").alias("old_path"), F.col("was").alias("h"))
    came = j.where("was is null").select("path", F.col("is").alias("h"))
    number = lambda d, c: d.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy(c)))
    pairs = number(came, "path").join(number(gone, "old_path"), ["h", "n"], "full_outer")
    moved = pairs.select(F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("change"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    same = j.where("was is not null and is is not null").select("path", F.when(F.col("was") == F.col("is"), "unchanged").otherwise("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return moved.unionByName(same)


def advance_watermark(state: DataFrame, batches: DataFrame) -> DataFrame:
    """A source's watermark moves to the greatest cursor of its complete batches; it starts at '0'."""
    done = batches.where("complete").groupBy("source").agg(F.max("cursor").alias("new"))
    known = state.unionByName(batches.select("source").distinct().join(state, "source", "left_anti").withColumn("cursor", F.lit("0")))
    return known.join(done, "source", "left").select("source", F.greatest("cursor", F.coalesce("new", "cursor")).alias("cursor"))


def snapshot_cursor(pages: DataFrame, columns: list[str]) -> DataFrame:
    """K2: one hash over a whole snapshot, whatever the order of its rows: sums of row hashes, combined map-side."""
    h = row_hash(columns)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    return pages.agg(F.count(F.lit(1)).alias("n"), *parts).select("n", F.sha2(F.concat_ws(",", "n", *[f"s{i}" for i in range(5)]), 256).alias("cursor"))


def chain_faults(entries: DataFrame, key: str, order: str) -> DataFrame:
    """Entries whose previous hash is not that of the one before, or whose own hash does not fit."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    out = entries.withColumn("before", before)
    bad = (F.col("before") != F.col("previous_hash")) | (F.sha2(F.concat("payload", "previous_hash"), 256) != F.col("hash"))
    return out.where(bad).drop("before")


def build_chain(entries: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Hash chains. A chain is sequential by nature: its entries go by in order, and only the last hash is held, so a
    chain may have any length. Chains run beside each other. ``order`` comes back as text; a null payload counts as empty."""
    kind = entries.schema[key].dataType.simpleString()
    rows = entries.select(F.col(key).alias("k"), F.col(order).alias("at"), F.col(order).cast("string").alias("o"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = object(), ""
        for batch in batches:
            made: tuple[list, list] = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                before = before if k == last else ""
                last = k
                made[0].append(before)
                before = hashlib.sha256((p + before).encode()).hexdigest()
                made[1].append(before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(m, pa.string()) for m in made)], names=["k", "o", "payload", "previous_hash", "hash"])

    dealt = rows.repartition("k").sortWithinPartitions("k", "at", "p").select("k", "o", "p")
    return dealt.mapInArrow(run, f"k {kind}, o string, payload string, previous_hash string, hash string").select(F.col("k").alias(key), F.col("o").alias(order), "payload", "previous_hash", "hash")


def current_query(messages: DataFrame, session: str, order: str) -> DataFrame:
    """For each message the session's last user message before it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("last_query", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def artifact_impact(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts one of whose input revisions changed."""
    return artifacts.join(artifacts.select("artifact", F.explode("inputs").alias("revision")).join(changed, "revision", "left_semi").select("artifact").distinct(), "artifact", "left_semi")


def delete_unless_held(items: DataFrame, requests: DataFrame, holds: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, tombstones); a request under an active hold waits for review and deletes nothing."""
    held = requests.join(holds.where("active").select(key), key, "left_semi")
    done = requests.join(held.select(key), key, "left_anti")
    stones = done.withColumn("status", F.lit("deleted")).unionByName(held.withColumn("status", F.lit("pending_review")))
    return items.join(done.select(key), key, "left_anti"), stones


def release_facts(releases: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """K8: facts of approved releases with their evidence."""
    r = releases.where("approved").select("release_id", F.explode("fact_ids").alias("fact_id"))
    return r.join(facts, "fact_id").join(evidence, "fact_id", "left")


def acl(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The first matching entry by position decides; owners may; nothing else may."""
    m = requests.join(entries, "object_id", "left").where(F.col("subject").isNull() | F.col("subject").isin("*") | (F.col("subject") == F.col("user_id")))
    first = m.groupBy("request_id").agg(F.min_by("allow", "position").alias("allow"))
    out = requests.join(first, "request_id", "left")
    return out.select("request_id", ((F.col("owner") == F.col("user_id")) | F.coalesce("allow", F.lit(False))).alias("allowed"))
