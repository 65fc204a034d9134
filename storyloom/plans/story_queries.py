"""Registered queries for pairs, graphs, stories and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import enrich, stories
from storyloom.operators import graph as gr
from storyloom.operators import nearest as nr
from storyloom.operators import pairs as pr
from storyloom.operators import scoring as sc
from storyloom.operators import vectors as vc
from storyloom.plans import entity_sql as es
from storyloom.plans import sqltext as q
from storyloom.plans import vocab
from storyloom.plans.registry import Catalogue
from storyloom.plans.text_queries import PHRASES_SQL, TAGS_SQL
from storyloom.session import cut_lineage
from storyloom.sources import tables as tb

catalogue = Catalogue()
DAYS_SQL = "CAST(abs(floor((epoch_us(a.published_at) - epoch_us(b.published_at)) / 86400000000.0)) AS BIGINT)"


@catalogue.add(
    "jn3_nearest_in_time",
    f"""WITH {q.ARTICLES}, p AS (SELECT a.id AS seed, b.id AS other, {DAYS_SQL} AS days FROM articles a JOIN articles b ON a.id <> b.id)
    SELECT seed, other, days FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY days, other) AS r FROM p WHERE days <= 7) WHERE r <= 20""",
)
def jn3(spark, folder):
    rows = tb.articles(spark, folder).select(F.lit("").alias("grp"), "id", F.unix_micros("published_at").alias("ts"))
    return nr.near_in_time(rows, 20, 7).select(F.col("id").alias("seed"), "other", "days")


def _tagged(spark, folder):
    rows = enrich.classify(tb.articles(spark, folder), vocab.ENRICH)
    return rows.select("id", F.unix_micros("published_at").alias("ts"), F.col("tag_codes").alias("keys"))


@catalogue.add(
    "jn4_shared_key_pairs",
    f"""WITH {q.ARTICLES}, t AS (SELECT id, published_at, {TAGS_SQL} AS keys FROM articles),
    p AS (SELECT a.id AS seed, b.id AS other, len(list_intersect(a.keys, b.keys)) AS overlap, {DAYS_SQL} AS days FROM t a JOIN t b ON a.id <> b.id)
    SELECT seed, other, overlap, days FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY overlap + greatest(0.0, 1 - days / 7.0::DOUBLE) DESC, other) AS r
      FROM p WHERE days <= 7 AND overlap > 0) WHERE r <= 20""",
)
def jn4(spark, folder):
    return nr.shared_key_candidates(_tagged(spark, folder), 20, 7, hot=150)


def _vectors(spark, folder):
    return tb.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("source"))


KNN_SQL = """
u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sims AS (SELECT a.id AS seed, b.id AS other, b.label AS other_label, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.id <> b.id),
knn AS (SELECT seed, other, other_label, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, other) AS rank FROM sims) WHERE rank <= 5)"""


def _knn(spark, folder, k=5):
    return vc.nearest_neighbors(_vectors(spark, folder), k)


@catalogue.add("jn5_knn_exact", f"WITH {KNN_SQL} SELECT seed, other, round(sim, 6) AS similarity, rank FROM knn")
def jn5(spark, folder):
    return _knn(spark, folder).select("seed", "other", F.round("similarity", 6).alias("similarity"), "rank")


@catalogue.add("jn6_knn_approximate")
def jn6(spark, folder):
    return vc.nearest_neighbors(_vectors(spark, folder), 5, probes=16).select("seed", "other", F.round("similarity", 6).alias("similarity"), "rank")


@catalogue.add(
    "jn7_semantic_in_window",
    f"""WITH {q.ARTICLES}, {KNN_SQL.replace('rank <= 5', 'rank <= 60')} SELECT k.seed, k.other, round(greatest(0, sim), 6) AS s FROM knn k
    JOIN articles a ON a.id = k.seed JOIN articles b ON b.id = k.other WHERE {DAYS_SQL} <= 7""",
)
def jn7(spark, folder):
    rows = tb.articles(spark, folder).select("id", "published_at")
    near = pr.semantic_candidates(_knn(spark, folder, 60), rows, pr.CandidateLimits())
    return near.select("seed", "other", F.round("s", 6).alias("s"))


@catalogue.add(
    "jn8_alignment_check",
    """SELECT coalesce(e.vec_id, d.doc_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side
    FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL OR d.doc_id IS NULL""",
)
def jn8(spark, folder):
    docs = tb.read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return vc.check_aligned(_vectors(spark, folder), docs)


DENSITY_SQL = "dens AS (SELECT seed AS id, round(avg(sqrt(greatest(0, 2 - 2 * sim))), 6) AS local_density FROM knn WHERE rank <= 4 GROUP BY seed)"


@catalogue.add("a12_local_density", f"WITH {KNN_SQL}, {DENSITY_SQL} SELECT id, local_density FROM dens")
def a12(spark, folder):
    return vc.local_density(_knn(spark, folder))


@catalogue.add("a12_density_baseline", f"WITH {KNN_SQL}, {DENSITY_SQL} SELECT round(median(local_density), 6) AS density_baseline FROM dens")
def a12_baseline(spark, folder):
    density = cut_lineage(vc.local_density(_knn(spark, folder)))
    return vc.density_baseline(density).select(F.round("density_baseline", 6).alias("density_baseline"))


@catalogue.add(
    "a13_nearby_sources",
    f"""WITH {KNN_SQL}, s AS (SELECT id, CAST(label AS VARCHAR) AS src FROM u UNION SELECT seed, CAST(other_label AS VARCHAR) FROM knn WHERE rank <= 4)
    SELECT id, string_agg(src, ',' ORDER BY src) AS nearby_sources, count(*) AS diversity FROM s GROUP BY id""",
)
def a13(spark, folder):
    rows = vc.nearby_sources(_knn(spark, folder), _vectors(spark, folder))
    return rows.select("id", F.array_join("nearby_sources", ",").alias("nearby_sources"), F.col("diversity").cast("long").alias("diversity"))


@catalogue.add(
    "a11_cluster_summary",
    """WITH p AS (SELECT vec_id AS id, label AS cluster, 'src' || (vec_id % 7) AS source, strftime(DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER), '%Y-%m-%d') AS d,
      CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    c AS (SELECT cluster, source, count(*) AS n FROM p GROUP BY ALL),
    s AS (SELECT cluster, string_agg(source || '=' || n, ',' ORDER BY n DESC, source) AS top_sources, count(*) AS source_count, max(n) AS most FROM c GROUP BY cluster),
    r AS (SELECT cluster, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS representatives FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rn FROM p) WHERE rn <= 3 GROUP BY cluster)
    SELECT p.cluster, count(*) AS size, any_value(representatives) AS representatives, any_value(top_sources) AS top_sources, any_value(source_count) AS source_count,
      round(any_value(most) / count(*)::DOUBLE, 6) AS source_dominance, min(d) AS date_min, max(d) AS date_max, round(avg(x), 5) AS centroid_x, round(avg(y), 5) AS centroid_y, round(avg(z), 5) AS centroid_z
    FROM p JOIN s USING (cluster) JOIN r USING (cluster) GROUP BY p.cluster""",
)
def a11(spark, folder):
    e = tb.read_table(spark, folder, "embeddings")
    key = F.col("vec_id")
    axis = lambda i: F.col("embedding")[i].cast("double")
    points = e.select(
        key.alias("id"), F.col("label").alias("cluster"), F.concat(F.lit("src"), (key % 7).cast("string")).alias("source"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")), "yyyy-MM-dd").alias("published_date"),
        axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"),
    )
    rows = vc.cluster_summary(points)
    return rows.select(
        "cluster", "size", F.array_join(F.transform("representatives", lambda i: i.cast("string")), ",").alias("representatives"),
        F.array_join(F.transform("top_sources", lambda s: F.concat(s["source"], F.lit("="), s["n"].cast("string"))), ",").alias("top_sources"),
        "source_count", F.round("source_dominance", 6).alias("source_dominance"), "date_min", "date_max",
        *[F.round(f"centroid_{a}", 5).alias(f"centroid_{a}") for a in ("x", "y", "z")],
    )


@catalogue.add("c9_pca_points")
def c9(spark, folder):
    points = vc.project(_vectors(spark, folder))
    return points.select("id", *[F.round(a, 6).alias(a) for a in ("x", "y", "z")])


@catalogue.add("a5_projection_bounds", """SELECT round(min(embedding[1]::DOUBLE), 6) AS min_x, round(max(embedding[1]::DOUBLE), 6) AS max_x, round(min(embedding[2]::DOUBLE), 6) AS min_y,
   round(max(embedding[2]::DOUBLE), 6) AS max_y, round(min(embedding[3]::DOUBLE), 6) AS min_z, round(max(embedding[3]::DOUBLE), 6) AS max_z FROM embeddings""")
def a5(spark, folder):
    e = tb.read_table(spark, folder, "embeddings")
    points = e.select(*[F.round(F.col("embedding")[i].cast("double"), 6).alias(a) for i, a in enumerate("xyz")])
    return vc.bounds(points)


@catalogue.add(
    "c5_connected_components",
    f"""WITH RECURSIVE {KNN_SQL}, e AS (SELECT seed AS a, other AS b FROM knn WHERE rank <= 2 AND sim >= 0.3 UNION SELECT other, seed FROM knn WHERE rank <= 2 AND sim >= 0.3),
    reach AS (SELECT id, id AS low FROM u UNION SELECT e.b, r.low FROM reach r JOIN e ON e.a = r.id)
    SELECT id, min(low) AS component FROM reach GROUP BY id""",
)
def c5(spark, folder):
    vectors = _vectors(spark, folder)
    edges = _knn(spark, folder).where("rank <= 2 AND similarity >= 0.3").select(F.col("seed").alias("src"), F.col("other").alias("dst"))
    return gr.with_singletons(vectors, gr.connected_components(edges, alone=gr.SMALL_GRAPH))


# --- stories -----------------------------------------------------------------------------------
def story_articles(spark, folder):
    rows = enrich.enriched(tb.articles(spark, folder), vocab.ENRICH)
    return cut_lineage(rows.select(
        "id", "source", "published_at", "title", "summary", "article_type", "tag_codes", "entity_slugs", "key_phrases"
    ))


def _neighbors(spark, folder):
    return cut_lineage(vc.nearest_neighbors(_vectors(spark, folder), 60))


C2_SQL = f"""WITH {q.ARTICLES}, {KNN_SQL.replace('rank <= 5', 'rank <= 60')},
t AS (SELECT id, published_at, {TAGS_SQL} AS tags, list_distinct(list_filter(list_transform({PHRASES_SQL}, lambda p: lower(p)), lambda p: p <> '')) AS phrases FROM articles),
p AS (SELECT a.id AS seed, b.id AS other, len(list_intersect(a.tags, b.tags)) AS nt, len(list_intersect(a.phrases, b.phrases)) AS np, greatest(0.0, 1 - {DAYS_SQL} / 7.0::DOUBLE) AS c
  FROM t a JOIN t b ON a.id <> b.id WHERE {DAYS_SQL} <= 7),
o AS (SELECT seed, other, 1 AS pri, 'temporal_window' AS origin, c AS s FROM p
  UNION ALL SELECT seed, other, 2, 'shared_tag', nt + c FROM p WHERE nt > 0
  UNION ALL SELECT seed, other, 5, 'lexical_neighbor', np + c FROM p WHERE np > 0
  UNION ALL SELECT k.seed, k.other, 4, 'semantic_neighbor', greatest(0, k.sim) FROM knn k JOIN articles a ON a.id = k.seed JOIN articles b ON b.id = k.other WHERE {DAYS_SQL} <= 7),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, origin ORDER BY s DESC, other) AS r FROM o),
f AS (SELECT seed, other, min((pri, r)) AS first, list(origin) AS origins FROM r WHERE r <= 20 GROUP BY seed, other),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY first) AS pos FROM f) WHERE pos <= 40)
SELECT least(seed, other) AS left_id, greatest(seed, other) AS right_id, array_to_string(list_sort(list_distinct(flatten(list(origins)))), ',') AS origins, min(pos) AS rank FROM c GROUP BY ALL"""


@catalogue.add("c2_candidate_pairs", C2_SQL)
def c2(spark, folder):
    """Four of the origins (the entity origin has no SQL twin; c3 and c7 use all five)."""
    rows = cut_lineage(enrich.classify(tb.articles(spark, folder), vocab.ENRICH).select(
        "id", "published_at", "tag_codes", F.array().cast("array<string>").alias("entity_slugs"),
        F.array_distinct(F.transform("key_phrases", lambda p: F.lower(p))).alias("phrase_keys"),
    ))
    found = pr.candidate_pairs(rows, _neighbors(spark, folder))
    return found.select("left_id", "right_id", F.array_join("origins", ",").alias("origins"), "rank")


def pairs_sql(limits: pr.CandidateLimits, phrases: str) -> str:
    """CTEs up to `pairs`: candidate pairs of all five origins."""
    order = {o: i + 1 for i, o in enumerate(limits.order)}
    kept = " OR ".join(f"(origin = '{o}' AND r <= {limits.of(o)})" for o in limits.order)
    shared = lambda n, origin: f"SELECT seed, other, {order[origin]} AS pri, '{origin}' AS origin, {n} + c AS s FROM p WHERE {n} > 0"
    extra = f"""UNION ALL SELECT seed, other, coalesce(used, 0) + turn, ['semantic_backfill'] FROM (
      SELECT r.*, used, row_number() OVER (PARTITION BY r.seed ORDER BY r.r) AS turn FROM r ANTI JOIN c ON c.seed = r.seed AND c.other = r.other
      LEFT JOIN (SELECT seed AS us, count(*) AS used FROM c GROUP BY seed) u ON us = r.seed WHERE origin = 'semantic_neighbor'
    ) WHERE turn <= least({limits.backfill}, {limits.per_seed} - coalesce(used, 0))""" if limits.high_recall else ""
    return f"""{q.ARTICLES}, {es.ENTITIES}, {es.SLUGS}, {KNN_SQL.replace('rank <= 5', f'rank <= {limits.semantic_fetch}')},
t AS (SELECT a.id, published_at, {TAGS_SQL} AS tags, {phrases} AS phrases, coalesce(entity_slugs, []) AS slugs FROM articles a LEFT JOIN slugs USING (id)),
p AS (SELECT a.id AS seed, b.id AS other, len(list_intersect(a.tags, b.tags)) AS nt, len(list_intersect(a.phrases, b.phrases)) AS np, len(list_intersect(a.slugs, b.slugs)) AS ne, greatest(0.0, 1 - {DAYS_SQL} / 7.0::DOUBLE) AS c
  FROM t a JOIN t b ON a.id <> b.id WHERE {DAYS_SQL} <= 7),
o AS (SELECT seed, other, {order['temporal_window']} AS pri, 'temporal_window' AS origin, c AS s FROM p
  UNION ALL {shared('nt', 'shared_tag')} UNION ALL {shared('ne', 'shared_entity')} UNION ALL {shared('np', 'lexical_neighbor')}
  UNION ALL SELECT k.seed, k.other, {order['semantic_neighbor']}, 'semantic_neighbor', greatest(0, k.sim) FROM knn k JOIN articles a ON a.id = k.seed JOIN articles b ON b.id = k.other WHERE {DAYS_SQL} <= 7),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, origin ORDER BY s DESC, other) AS r FROM o),
f AS (SELECT seed, other, min((pri, r)) AS first, list(origin) AS origins FROM r WHERE {kept} GROUP BY seed, other),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY first) AS pos FROM f) WHERE pos <= {limits.per_seed}),
chosen AS (SELECT seed, other, pos, origins FROM c {extra}),
pairs AS (SELECT least(seed, other) AS left_id, greatest(seed, other) AS right_id, list_sort(list_distinct(flatten(list(origins)))) AS origins, min(pos) AS rank FROM chosen GROUP BY 1, 2)"""


LOWERED = f"list_distinct(list_filter(list_transform({PHRASES_SQL}, lambda p: lower(p)), lambda p: p <> ''))"


def _keyed(spark, folder):
    rows = story_articles(spark, folder)
    return rows.select("id", "published_at", "tag_codes", "entity_slugs", F.array_distinct(F.transform("key_phrases", lambda p: F.lower(p))).alias("phrase_keys"))


@catalogue.add("c2_five_origins", f"WITH {pairs_sql(pr.CandidateLimits(), LOWERED)} SELECT left_id, right_id, array_to_string(origins, ',') AS origins, rank FROM pairs")
def c2_five(spark, folder):
    """Candidate pairs of all five origins, entities among them."""
    found = pr.candidate_pairs(_keyed(spark, folder), _neighbors(spark, folder))
    return found.select("left_id", "right_id", F.array_join("origins", ",").alias("origins"), "rank")


COUNTS_SQL = f"WITH {pairs_sql(pr.HIGH_RECALL, PHRASES_SQL)} SELECT origin, count(*) AS pairs FROM (SELECT unnest(origins) AS origin FROM pairs) GROUP BY origin"


@catalogue.add("c2_origin_counts", COUNTS_SQL)
def c2_counts(spark, folder):
    rows = story_articles(spark, folder)
    keyed = rows.select("id", "published_at", "tag_codes", "entity_slugs", F.col("key_phrases").alias("phrase_keys"))
    return pr.origin_counts(pr.candidate_pairs(keyed, _knn(spark, folder, pr.HIGH_RECALL.semantic_fetch), pr.HIGH_RECALL))


@catalogue.add("c3_pair_scores")
def c3(spark, folder):
    rows = stories.scored_pairs(story_articles(spark, folder), _neighbors(spark, folder), terms=vocab.TERMS)
    return rows.select(
        "left_id", "right_id", "rank", "reason.score", "reason.title_similarity", "reason.semantic_similarity", "reason.days_delta",
        "reason.hard_block", "reason.risky_bridge_pair", F.array_join("reason.penalties", ",").alias("penalties"),
    )


@catalogue.add("c4_edge_classes")
def c4(spark, folder):
    rows = stories.scored_pairs(story_articles(spark, folder), _neighbors(spark, folder), terms=vocab.TERMS, at_least=0.55).where(sc.accepted(0.55))
    return rows.groupBy(sc.edge_class().alias("edge_class")).agg(F.count(F.lit(1)).alias("pairs"))


def _built(spark, folder):
    articles = story_articles(spark, folder)
    pairs, members = stories.build_stories(articles, _neighbors(spark, folder), 0.55, terms=vocab.TERMS, all_reasons=False)
    return articles, pairs, members


@catalogue.add("c7_story_clusters")
def c7(spark, folder):
    articles, _, members = _built(spark, folder)
    rows = stories.story_summaries(articles, members)
    return rows.select("cluster", "cluster_key", "headline", "article_count", "source_count", "primary_tag", F.length("summary_text").alias("summary_chars"))


@catalogue.add("c6_guarded_members")
def c6(spark, folder):
    _, pairs, members = _built(spark, folder)
    scores = stories.member_scores(members, pairs.where("accepted"))
    return members.select("id", "stage", "decision", "support_count").join(
        scores.select("id", "cluster", F.round("membership_score", 4).alias("membership_score"), "support_edge_count"), "id"
    )


@catalogue.add("a19_story_run_metrics")
def a19(spark, folder):
    articles, pairs, members = _built(spark, folder)
    return stories.run_metrics(articles, pairs, members)
