"""The versioned ledger of findings and of observations, as set operations on snapshots.

A run never overwrites what it reads: it returns the new snapshot, and the caller swaps folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import expr as X
from harborline.operators.relational import latest_by

#: Natural-key columns of each family.
KEYS = {
    "mirror_gap": ["partner", "month_idx"],
    "mirror_gap_zscore": ["partner", "month_idx"],
    "hs_group_yoy": ["group_name", "scope", "flow", "month_idx"],
    "hs_group_trajectory": ["group_name", "scope", "flow"],
    "product_mover": ["product_nc", "flow", "month_idx"],
    "bloc_yoy": ["label", "flow", "month_idx"],
    "bilateral_yoy": ["partner", "flow", "month_idx"],
    "trade_balance": ["reporter_scope", "partner_scope", "month_idx"],
    "allgoods_share": ["month_idx"],
    "group_share": ["group_name", "flow", "month_idx"],
}


def keyed(df: DataFrame, family: str, subkind: Column | str, values: list[str], method: str) -> DataFrame:
    """df with subkind, nk (natural key hash) and sig (signature of rounded values)."""
    return df.withColumn("subkind", X.col(subkind)).withColumn("nk", X.nk_hash("subkind", *KEYS[family])).withColumn("sig", X.value_signature(method, *values))


def active(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("superseded_at").isNull())


def duplicate_active(ledger: DataFrame) -> DataFrame:
    """Keys that break the rule of one active finding each."""
    return active(ledger).groupBy("nk").agg(F.count("*").alias("n")).where("n > 1")


def one_of_each(batch: DataFrame) -> DataFrame:
    """nk, new_sig, new_subkind: of several findings of one key that of the smallest signature (then subkind), whatever the order of rows."""
    least = F.min(F.struct(F.col("sig").alias("new_sig"), F.col("subkind").alias("new_subkind"))).alias("x")
    return batch.groupBy("nk").agg(least).select("nk", "x.new_sig", "x.new_subkind")


def merge_findings(ledger: DataFrame, batch: DataFrame, run_ts: Column) -> DataFrame:
    """The next snapshot, with `action` on the rows of this run.

    ledger: id, nk, sig, subkind, created_at, last_confirmed_at, superseded_at, superseded_by_id; batch: nk, sig, subkind.
    A key of the batch that is new is inserted; with the same signature confirmed; else superseded by a new row.
    One join on nk, in which past rows match nothing, and no union: a ledger that is bucketed by nk (`write_bucketed`)
    is read, joined and written again without an exchange.  The same batch at the same time once more changes nothing.
    """
    incoming = one_of_each(batch).withColumnRenamed("nk", "new_nk")
    j = ledger.join(incoming, (F.col("nk") == F.col("new_nk")) & F.col("superseded_at").isNull(), "full")
    new_id = F.substring(F.sha2(F.concat_ws("\x1f", "new_nk", "new_sig", run_ts.cast("string")), 256), 1, 32)
    there, asked = F.col("id").isNotNull(), F.col("new_nk").isNotNull()
    same = F.coalesce(F.col("sig") == F.col("new_sig"), F.lit(False))
    changed = there & asked & ~same
    kept = F.struct(
        "id", "nk", "sig", "subkind", "created_at",
        F.when(same, run_ts).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"),
        F.when(changed, run_ts).otherwise(F.col("superseded_at")).alias("superseded_at"), F.when(changed, new_id).otherwise(F.col("superseded_by_id")).alias("superseded_by_id"),
        F.when(same, "confirmed_existing").alias("action"),
    )
    fresh = F.struct(
        new_id.alias("id"), F.col("new_nk").alias("nk"), F.col("new_sig").alias("sig"), F.col("new_subkind").alias("subkind"), run_ts.alias("created_at"), run_ts.alias("last_confirmed_at"),
        F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_by_id"),
        F.when(there, "superseded").otherwise("inserted_new").alias("action"),
    )
    rows = F.filter(F.array(F.when(there, kept), F.when(asked & ~same, fresh)), lambda r: r.isNotNull())
    return j.select(F.inline(rows))


def emit_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("action is not null").groupBy("subkind", "action").agg(F.count("*").alias("n"))


def revision_chain(ledger: DataFrame) -> DataFrame:
    """Each finding with its place in the chain of its key and the ids before and after."""
    w = Window.partitionBy("nk").orderBy("created_at", "id")
    return ledger.withColumn("revision", F.row_number().over(w)).withColumn("previous_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def version_observations(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """incoming with status and version_seen: unchanged, changed (version + 1) or new (1); null keys are equal."""
    last = latest_by(existing, keys, F.desc("version_seen")).select(*(F.col(c).alias(f"_{c}") for c in [*keys, *values, "version_seen"]))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = incoming.join(last, on, "left")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    status = F.when(F.col("_version_seen").isNull(), "new").when(same, "unchanged").otherwise("changed")
    version = F.when(F.col("_version_seen").isNull(), 1).when(same, F.col("_version_seen")).otherwise(F.col("_version_seen") + 1)
    return j.select(*incoming.columns, status.alias("status"), version.cast("int").alias("version_seen"))


def held_groups(groups: DataFrame) -> DataFrame:
    by = F.col("created_by")
    return groups.where(by.startswith("hidden:") | by.startswith("draft:"))


def without_held(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(held_groups(groups).select("group_name"), "group_name", "left_anti")


def withdraw_interval(ledger: DataFrame, from_ts: Column, to_ts: Column, subkinds: list[str]) -> DataFrame:
    """Drop findings made in a bad interval; the last earlier one of each key points at the live one."""
    chosen = F.col("subkind").isin(*subkinds)
    bad = chosen & (F.col("created_at") >= from_ts) & (F.col("created_at") < to_ts)
    good = ledger.where(~bad)
    live = good.where(F.col("superseded_at").isNull()).groupBy("nk").agg(F.max_by("id", "created_at").alias("_live"))
    before = good.where(chosen & (F.col("created_at") < from_ts)).groupBy("nk").agg(F.max_by("id", "created_at").alias("_last"))
    j = good.join(before, "nk", "left").join(live, "nk", "left")
    fix = (F.col("id") == F.col("_last")) & F.col("superseded_at").isNotNull() & F.col("_live").isNotNull()
    return j.withColumn("superseded_by_id", F.when(fix, F.col("_live")).otherwise(F.col("superseded_by_id"))).select(ledger.columns)


def retire(ledger: DataFrame, keys: DataFrame, ts: Column) -> DataFrame:
    """Active findings of the keys (nk) end without a successor."""
    j = ledger.join(keys.select("nk", F.lit(True).alias("_gone")).distinct(), "nk", "left")
    end = F.coalesce("_gone", F.lit(False)) & F.col("superseded_at").isNull()
    return j.withColumn("superseded_at", F.when(end, ts).otherwise(F.col("superseded_at"))).select(ledger.columns)


def revision_pairs(ledger: DataFrame, value: str) -> DataFrame:
    """Old and new value of each superseded finding."""
    new = ledger.select(F.col("id").alias("superseded_by_id"), F.col(value).alias("new_value"))
    return ledger.where("superseded_by_id is not null").join(new, "superseded_by_id").withColumnRenamed(value, "old_value")


def new_since(ledger: DataFrame, ts: Column) -> DataFrame:
    """Keys that no finding had before ts."""
    return ledger.where(F.col("created_at") >= ts).join(ledger.where(F.col("created_at") < ts).select("nk").distinct(), "nk", "left_anti")


def revision_regime(pairs: DataFrame, n_new: DataFrame, material: float = 0.05, same: float = 1e-4, bump: float = 0.95) -> DataFrame:
    """One row: pairs, flips, material shifts, identical values and the regime they make."""
    shift = F.abs(F.col("new_value") - F.col("old_value"))
    one = pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.signum("new_value") != F.signum("old_value")).alias("n_flips"),
        F.count_if(shift > material).alias("n_material"), F.count_if(shift < same).alias("n_same"),
    ).join(F.broadcast(n_new.agg(F.count("*").alias("n_new"))))
    regime = (
        F.when((F.col("n_pairs") == 0) & (F.col("n_new") > 0), "first_export").when((F.col("n_pairs") == 0) & (F.col("n_new") == 0), "no_change")
        .when(F.col("n_same") >= bump * F.col("n_pairs"), "method_bump").otherwise("movement")
    )
    return one.withColumn("regime", regime)
