"""Evaluation: pair and cluster metrics, recall at k, threshold sweeps, review batches, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.closure import guarded_closure
from storyloom.operators.graph import SMALL_GRAPH, connected_components
from storyloom.operators.scoring import accepted
from storyloom.operators.spanning import minimum_forest
from storyloom.session import cut_lineage

KS = (5, 10, 20, 50)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def precision_recall(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to a table with tp, predicted and positives."""
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("positives"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("*", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"))


def pair_metrics(judged: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    counts = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("labeled"),
        F.count_if(actual).alias("positives"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    )
    return precision_recall(counts)


def label_pairs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels (left_id, right_id in any order, label) with the pair they name, if it exists."""
    keyed = labels.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "label")
    return keyed.join(pairs, ["left_id", "right_id"], "left")


def evaluate_pairs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    joined = label_pairs(labels, pairs)
    return pair_metrics(joined, F.coalesce("accepted", F.lit(False)), F.col("label") == "same_event")


def evaluate_clusters(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairwise precision and recall from cell sizes; no pair is formed.

    predicted: id, cluster; gold: id, cluster. Pairs together in both = sum of n(n-1)/2 over
    (predicted, gold) cells.
    """
    together = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("clusters")
    )
    p = predicted.select("id", F.col("cluster").alias("p"))
    g = gold.select("id", F.col("cluster").alias("g"))
    cells = together(p.join(g, "id"), "p", "g").select(F.col("pairs").alias("tp"))
    made = together(p, "p").select(F.col("pairs").alias("predicted"), F.col("clusters").alias("predicted_clusters"))
    wanted = together(g, "g").select(F.col("pairs").alias("positives"), F.col("clusters").alias("gold_clusters"))
    return precision_recall(cells.crossJoin(made).crossJoin(wanted))  # one row each


def candidate_recall(labels: DataFrame, pairs: DataFrame, ks=KS) -> DataFrame:
    """Share of positive labels whose pair is among the first k candidates of a seed."""
    joined = label_pairs(labels.where(F.col("label") == "same_event"), pairs)
    total = F.count(F.lit(1))
    hit = lambda k: F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False)))
    return joined.agg(total.alias("positives"), *[F.bround(_ratio(hit(k), total), 4).alias(f"recall_{k}") for k in ks])


def sweep(labels: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pair metrics per threshold; pairs are scored once, uncertain labels do not count."""
    decided = labels.where(F.col("label").isin("same_event", "different_event"))
    joined = label_pairs(decided, pairs)
    each = joined.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    on = F.coalesce(F.col("reason.hard_block").isNull() & (F.col("reason.score") >= F.col("threshold")), F.lit(False))
    return pair_metrics(each, on, F.col("label") == "same_event", "threshold")


def cluster_sweep(articles: DataFrame, pairs: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """Cluster metrics per threshold: the closure runs again, the pair scores do not."""
    result = None
    for threshold in thresholds:
        members = guarded_closure(articles, pairs.where(accepted(threshold)))
        row = evaluate_clusters(members, gold).withColumn("threshold", F.lit(threshold))
        result = row if result is None else result.unionByName(row)
    return result


def component_sweep(articles: DataFrame, pairs: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accepted pairs, components and their pairwise metrics for every threshold, from one run over the pairs.

    The maximum spanning forest of the pairs that no block forbids keeps, at every threshold, the components of all
    pairs above it. So the thresholds only cut the forest, which has fewer edges than there are articles, and all of
    them are closed together.
    """
    levels = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    open_ = pairs.where(F.col("reason.hard_block").isNull())
    forest = minimum_forest(open_.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), (-F.col("reason.score")).alias("weight")))
    cut = forest.select("a", "b", F.explode(F.filter(levels, lambda t: t <= -F.col("weight"))).alias("threshold"))
    node = lambda c: F.concat_ws("|", "threshold", c)  # noqa: E731  one graph holds the levels side by side
    parts = connected_components(cut.select(node("a").alias("src"), node("b").alias("dst")), alone=SMALL_GRAPH)
    everyone = articles.select("id", F.explode(levels).alias("threshold")).withColumn("node", node("id"))
    placed = everyone.join(parts.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left").select("threshold", "id", F.coalesce("component", "node").alias("cluster"))
    placed = cut_lineage(placed.join(gold.select("id", F.col("cluster").alias("gold")).hint("merge"), "id", "left"))
    pairs_of = lambda n: F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).cast("long")
    n = F.col("n")
    sized = placed.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count("gold").alias("m"))
    made = sized.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(n == 1).alias("singletons"), F.count_if(n > 1).alias("multi_article_clusters"), pairs_of(F.col("m")).alias("predicted"))
    together = lambda *keys: placed.where("gold IS NOT NULL").groupBy("threshold", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy("threshold")
    right = together("cluster", "gold").agg(pairs_of(n).alias("tp"))
    wanted = together("gold").agg(pairs_of(n).alias("positives"))
    kept = open_.select(F.explode(F.filter(levels, lambda t: t <= F.col("reason.score"))).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("accepted_pairs"))
    rows = made.join(right, "threshold", "left").join(wanted, "threshold", "left").join(kept, "threshold", "left").na.fill(0, ["tp", "positives", "accepted_pairs"])
    return precision_recall(rows)


def _share(size: int, share: float, available: bool) -> int:
    """Half-even rounding, at least one where there is anything to pick."""
    return max(1, round(size * share)) if available else 0


def review_batch(
    pairs: DataFrame, threshold: float, size: int = 10, accepted_share: float = 0.3, borderline_share: float = 0.4
) -> DataFrame:
    """Pairs to label: best accepted, nearest to the threshold, best rejected; each pair once.

    pairs: left_id, right_id, score, accepted. Only `size` rows of each kind leave the table.
    """
    ids = [F.asc("left_id"), F.asc("right_id")]
    gap = F.abs(F.col("score") - threshold)
    any_accepted = not pairs.where("accepted").isEmpty()
    first = _share(size, accepted_share, any_accepted)
    second = _share(size, borderline_share, True)
    third = max(0, size - first - second)
    return bootstrap_batch(pairs, [
        ("accepted_high", pairs.where("accepted").orderBy(F.desc("score"), *ids).limit(first)),
        ("borderline", pairs.orderBy(gap.asc(), F.desc("score"), *ids).limit(second)),
        ("rejected_high", pairs.where("NOT accepted").orderBy(F.desc("score"), *ids).limit(third)),
    ]).limit(size)


def bootstrap_batch(pairs: DataFrame, picks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of picks; a pair that several picks hold keeps the first bucket."""
    union = None
    for place, (bucket, rows) in enumerate(picks):
        marked = rows.withColumns({"bucket": F.lit(bucket), "place": F.lit(place)})
        union = marked if union is None else union.unionByName(marked)
    others = [c for c in pairs.columns if c not in ("left_id", "right_id")]
    first = union.groupBy("left_id", "right_id").agg(F.min_by(F.struct("bucket", *others), "place").alias("row"))
    return first.select("left_id", "right_id", "row.*").withColumn(
        "predicted_label", F.when(F.col("accepted"), "same_event").otherwise("different_event")
    )


def review_summary(rows: DataFrame) -> DataFrame:
    """Counts and metrics of labelled review rows (label, predicted_label, bucket)."""
    label = F.coalesce("label", F.lit(""))
    decided = (label != "") & (label != "uncertain")
    yes, said = label == "same_event", F.col("predicted_label") == "same_event"
    counts = rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(label != "").alias("labeled_count"),
        F.count_if(decided).alias("decided_count"), F.count_if(label == "uncertain").alias("uncertain_count"),
        F.count_if(decided & said & yes).alias("tp"), F.count_if(decided & said & ~yes).alias("fp"),
        F.count_if(decided & ~said & yes).alias("fn"), F.count_if(decided & ~said & ~yes).alias("tn"),
        F.count_if(decided & said).alias("predicted"), F.count_if(decided & yes).alias("positives"),
    )
    return precision_recall(counts)


def snapshot_comparison(baseline: DataFrame, current: DataFrame, metrics: DataFrame, key: str = "source") -> DataFrame:
    """Baseline against current counts per source, with warnings from the run metrics.

    metrics: source, discovered, processed, kept, rejected_noise (any may be null).
    """
    old = baseline.groupBy(key).agg(F.count(F.lit(1)).alias("baseline_count"))
    new = current.groupBy(key).agg(F.count(F.lit(1)).alias("current_count"))
    zero = F.lit(0).cast("long")
    joined = old.join(new, key, "full_outer").join(metrics, key, "left").withColumns(
        {"baseline_count": F.coalesce("baseline_count", zero), "current_count": F.coalesce("current_count", zero)}
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    found, done, kept = number("discovered"), number("processed"), number("kept")
    none_kept = (found >= 20) & (kept == 0)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("discovered", "processed", "kept")]))
    warnings = F.array_compact(F.array(
        F.when(none_kept, "zero_keep_after_discovery"),
        F.when(~none_kept & (done >= 20) & (kept / F.greatest(done, F.lit(1)) < 0.2), "low_keep_ratio"),
        F.when(number("rejected_noise") >= 10, F.concat(F.lit("high_noise_rejection:"), number("rejected_noise").cast("string"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_metrics:"), F.array_join(missing, ","))),
    ))
    delta = F.col("current_count") - F.col("baseline_count")
    return joined.select(
        key, "baseline_count", "current_count", delta.alias("delta_abs"),
        F.when(F.col("baseline_count") > 0, F.bround(delta / F.col("baseline_count") * 100.0, 2)).otherwise(0.0).alias("delta_pct"),
        warnings.alias("warnings"), F.when(F.size(warnings) > 0, "warning").otherwise("ok").alias("status"),
    )
