"""Closest rows in time and by shared keys where groups are dense: few windows and groups are asked, results stay exact."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import shared_by_force

from storyloom.operators import enrich, nearest


@pytest.mark.parametrize(("kinds", "days"), [(4, 3), (7, 30)])
def test_shared_keys_of_dense_groups(spark, kinds, days):
    rng = random.Random(kinds)
    rows = [(i, rng.randrange(days * 48) * 1_800_000_000, rng.sample([f"key{x}" for x in range(kinds)], rng.randint(1, 4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, ts long, keys array<string>")
    got = {(r["seed"], r["other"]): (r["overlap"], r["days"]) for r in nearest.shared_key_candidates(df, 4, 7, hot=5).collect()}
    assert got == shared_by_force(rows, 4, 7)


def test_dense_groups_are_asked_in_the_nearest_window_only(spark, monkeypatch):
    asked = []
    smallest = nearest.smallest_ids

    def counted(points, queries, k, tick):
        asked.append(queries.count())
        return smallest(points, queries, k, tick)

    monkeypatch.setattr(nearest, "smallest_ids", counted)
    rows = spark.range(6_000).select("id", (F.col("id") * 37 % 14_400 * 60_000_000).alias("ts"))
    nearest.near_in_time(rows.select(F.lit("").alias("grp"), "id", "ts"), 20, 7).write.format("noop").mode("overwrite").save()
    assert asked[0] < 2 * 6_000  # 15 windows before
    asked.clear()
    keyed = rows.select("id", "ts", F.expr("transform(sequence(0, cast(id % 3 as int)), i -> concat('k', i))").alias("keys"))
    nearest.shared_key_candidates(keyed, 20, 7).write.format("noop").mode("overwrite").save()
    assert sum(asked) < 4 * 6_000


def test_names_without_counts_are_the_counted_ones(spark):
    """The same names, also where more than twelve compete for a place by their occurrences."""
    name = lambda i: f"{chr(65 + i)}una Sol"
    body = " x ".join(name(i) + " luna" * (i % 4) + f" {chr(97 + i)}una" * (i % 5) for i in range(20))
    rows = [(1, "Title", "Summary", body), (2, "PSOE", "", "Pedro Sanchez en el PSOE"), (3, "nada", "nada", "nada"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, summary string, article_text string")
    names = lambda found: sorted(found.select("id", "entity_type", "name").collect())
    full = names(enrich.extract_entities(df))
    assert names(enrich.extract_entities(df, counts=False)) == full and sum(r["id"] == 1 for r in full) == 12
