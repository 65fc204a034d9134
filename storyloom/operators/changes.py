"""Keyed upserts, patches, deletes and change detection over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators.ranking import previous_row


def _fields(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def latest_by_key(batch: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Last row of each key in the batch, as an aggregate that combines before the shuffle."""
    others = [c for c in batch.columns if c not in keys]
    rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("row"))
    return rows.select(*keys, *[F.col(f"row.{c}").alias(c) for c in others])


def upsert(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], fields: Sequence[str], position: str
) -> DataFrame:
    """New table contents with a status per row: kept, inserted, updated or unchanged.

    Within a batch the last row of a key wins. One full outer join; rows that the batch does
    not touch keep status 'kept'.
    """
    last = latest_by_key(batch.select(*keys, *fields, position), keys, position)
    old = current.select(*keys, _fields(fields).alias("old"))
    new = last.select(*keys, _fields(fields).alias("new"))
    status = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("updated")
    )
    merged = old.join(new, list(keys), "full_outer")
    final = F.coalesce("new", "old")
    return merged.select(*keys, *[final[f].alias(f) for f in fields], status.alias("status"))


def change_statuses(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], fields: Sequence[str], position: str
) -> DataFrame:
    """Status of every batch row, as if the rows were applied one after another."""
    rows = previous_row(batch.select(*keys, *fields, position), keys, position, _fields(fields), "before")
    old = current.select(*keys, _fields(fields).alias("stored"))
    prior = F.coalesce("before", "stored")
    status = (
        F.when(prior.isNull(), "inserted")
        .when(prior.eqNullSafe(_fields(fields)), "unchanged")
        .otherwise("updated")
    )
    joined = rows.join(old, list(keys), "left")
    return joined.select(*keys, position, *fields, status.alias("status"))


def patch(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Overwrite only the columns that a patch supplies (non-null)."""
    changed = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns]
    )


def delete_cascade(base: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]):
    """Base and child tables without the deleted keys; children are name -> (table, foreign key)."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    kept = base.join(ids, base[key] == ids["__gone"], "left_anti")
    return kept, {
        name: table.join(ids, table[column] == ids["__gone"], "left_anti")
        for name, (table, column) in children.items()
    }


def vector_violations(vectors: DataFrame, dim: int, vector: str = "embedding", model: str = "embedding_model") -> DataFrame:
    """Rows that may not be stored: wrong length, a non-finite number, or a second model."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    models = vectors.agg(F.min(model).alias("__lo"), F.max(model).alias("__hi"))
    reason = (
        F.when(F.col("__lo") != F.col("__hi"), "mixed_models")
        .when(F.size(v) != dim, "wrong_dimension")
        .when(~finite, "not_finite")
    )
    checked = vectors.join(F.broadcast(models)).withColumn("violation", reason)  # models is one row
    return checked.where(F.col("violation").isNotNull()).drop("__lo", "__hi")


def upsert_vectors(current: DataFrame, batch: DataFrame, dim: int, fields: Sequence[str], position: str) -> DataFrame:
    """Keyed upsert of vectors on article_id; a batch with a violation is refused as a whole."""
    bad = vector_violations(batch, dim).select("article_id", "violation").take(5)
    if bad:
        raise ValueError(f"vectors refused: {[tuple(r) for r in bad]}")
    return upsert(current, batch, ["article_id"], fields, position)


def needs_work(rows: DataFrame, done: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows whose stored hash (and model) is missing or different."""
    stored = done.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in same])
    unchanged = F.lit(True)
    for c in same:
        unchanged = unchanged & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = rows.join(stored, rows[key] == stored["__key"], "left")
    return joined.where(F.col("__key").isNull() | ~unchanged).select(*rows.columns)


def seed_dimension(current: DataFrame, canonical: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Insert new canonical rows, refresh known ones, leave the others alone."""
    return upsert(current, canonical.withColumn("__at", F.lit(0)), [key], fields, "__at")


# fixed values: what a row holds before its first analysis
EDITORIAL_DEFAULTS = {
    "article_type": "unclear",
    "bias_label": "unclear",
    "tone_emotional": "unclear",
    "tone_target": "unclear",
    "opinionatedness": "unclear",
    "sensationalism": "unclear",
    "rhetorical_certainty": "unclear",
    "editorial_applicability": "full",
    "editorial_applicability_reason": "general_editorial_content",
}


def _or_default(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(EDITORIAL_DEFAULTS[column])).alias(column)


def mark_pending(current: DataFrame, work: DataFrame) -> DataFrame:
    """Move the rows listed in work (article_id, content_hash) to pending, defaults filled in."""
    joined = current.join(work.withColumnRenamed("content_hash", "new_hash"), "article_id", "full_outer")
    todo = F.col("new_hash").isNotNull()
    keep = [c for c in current.columns if c not in ("article_id", "analysis_status", "failure_reason", "content_hash")]
    columns = [
        F.when(todo, _or_default(c)).otherwise(F.col(c)).alias(c) if c in EDITORIAL_DEFAULTS else F.col(c)
        for c in keep
    ]
    return joined.select(
        "article_id",
        *columns,
        F.when(todo, "pending").otherwise(F.col("analysis_status")).alias("analysis_status"),
        F.when(todo, "").otherwise(F.col("failure_reason")).alias("failure_reason"),
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
    )


def apply_outcomes(current: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """Completed rows replace their values; failed rows keep theirs and get class and message."""
    values = list(EDITORIAL_DEFAULTS)
    done = completed.select("article_id", F.struct(*values).alias("done"))
    lost = failed.select("article_id", F.struct("failure_class", "failure_message").alias("lost"))
    joined = current.join(done, "article_id", "left").join(lost, "article_id", "left")
    text = F.concat(F.col("lost.failure_class"), F.lit(": "), F.col("lost.failure_message"))
    is_done, is_lost = F.col("done").isNotNull(), F.col("lost").isNotNull()
    return joined.select(
        "article_id",
        *[
            F.when(is_done, F.col(f"done.{c}")).when(is_lost, _or_default(c)).otherwise(F.col(c)).alias(c)
            for c in values
        ],
        F.when(is_done, "completed").when(is_lost, "failed").otherwise(F.col("analysis_status")).alias("analysis_status"),
        F.when(is_done, "").when(is_lost, F.substring(F.trim(text), 1, 255)).otherwise(F.col("failure_reason")).alias("failure_reason"),
        "content_hash",
    )


def article_hash() -> Column:
    return tx.content_hash(*[F.col(c) for c in ("title", "summary", "article_text", "section", "tags")])
