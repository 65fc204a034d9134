"""Operators against brute force, with skewed and repeated rows."""

import math
import random
import re
import tracemalloc
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.operators import changes as ch
from storyloom.operators import enrich, graph, nearest, ranking, scoring, stories
from storyloom.operators import vectors as vc

DAY = nearest.DAY_US


def days(a, b):
    return abs(math.floor((a - b) / DAY))


def test_nearest_in_time_with_a_crowded_instant(spark):
    rng = random.Random(1)
    rows = [(i, 5 * DAY if i % 3 == 0 else rng.randrange(20 * DAY)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, ts long").withColumn("grp", F.lit(""))
    got = {}
    for r in nearest.near_in_time(df, 4, 7).collect():
        got.setdefault(r["id"], set()).add((r["days"], r["other"]))
    for i, t in rows:
        want = sorted((days(t, u), j) for j, u in rows if j != i and days(t, u) <= 7)[:4]
        assert got.get(i, set()) == set(want)


def test_shared_keys_hot_and_rare_paths_agree_with_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12) * DAY + rng.choice([0, 3600_000_000]), sorted(rng.sample("abcdef", rng.randint(0, 3)))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, ts long, keys array<string>")
    want = set()
    for i, t, keys in rows:
        scored = [(-(len(set(keys) & set(k2)) + max(0.0, 1 - days(t, u) / 7.0)), j, len(set(keys) & set(k2)), days(t, u))
                  for j, u, k2 in rows if j != i and days(t, u) <= 7 and set(keys) & set(k2)]
        want |= {(i, j, n, d) for _, j, n, d in sorted(scored)[:5]}
    for hot in (0, 8, 10_000):
        got = {(r["seed"], r["other"], r["overlap"], r["days"]) for r in nearest.shared_key_candidates(df, 5, 7, hot).collect()}
        assert got == want


def test_growing_sides_are_not_broadcast(spark):
    """Files of these rows are so small that Spark would send both sides through the driver."""
    rows = spark.range(60).selectExpr("id", "id % 9 * 86400000000 AS ts", "array('a', 'b', 'c', concat('k', id % 7)) AS keys")
    timed = nearest.near_in_time(rows.select(F.lit("").alias("grp"), "id", "ts"), 4, 7, 1)
    for hot in (0, 10_000):
        found = nearest.shared_key_candidates(rows, 5, 7, hot, 1)
        for df in (timed, found):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_of_a_block_takes_bounded_memory():
    rng = np.random.default_rng(4)
    frame = lambda n: pd.DataFrame({"rep": np.arange(n), "v": list(rng.standard_normal((n, 4)))})
    queries, data = frame(vc.QUERY_ROWS), frame(vc.BLOCK_ROWS)
    tracemalloc.start()
    found = vc._search(6)(queries, data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 6 * len(queries) and peak < 200e6
    first = found[found["q"] == 5]["rep"].tolist()
    sims = np.stack(data["v"].to_numpy()) @ queries["v"][5]
    assert first == np.argsort(-sims, kind="stable")[:6].tolist()


@pytest.mark.parametrize("rows", [1, 40, 333])
def test_knn_exact_in_several_parts(spark, monkeypatch, rows):
    """Each task holds the queries of its part only; ties go to the smaller id."""
    monkeypatch.setattr(vc, "PART_ROWS", 50)
    rng = np.random.default_rng(rows)
    v = rng.integers(-2, 3, (rows, 3)) + 0.0
    v[:, 0] += 5
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = {}
    for r in vc.nearest_neighbors(df, 3).collect():
        got.setdefault(r["seed"], {})[r["rank"]] = (r["other"], r["similarity"])
    sims = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    for i in range(rows):
        want = sorted((-sims[i, j], j) for j in range(rows) if j != i)[:3]
        found = [got[i][n + 1] for n in range(len(want))] if want else []
        assert len(got.get(i, {})) == len(want)
        assert [s for _, s in found] == pytest.approx([-s for s, _ in want])
        assert all(sims[i, j] == pytest.approx(s) for j, s in found)


def test_approximate_search_finds_nine_tenths_without_clusters(spark):
    """Vectors that no cells separate, where two of 54 cells hold few of the neighbours."""
    v = np.random.default_rng(5).standard_normal((3_000, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    assert vc.recall(vc.nearest_neighbors(df, 5), vc.nearest_neighbors(df, 5, probes=2)).first()["recall"] >= 0.9


def test_knn_exact_with_many_copies(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 40]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    got = {}
    for r in vc.nearest_neighbors(df, 3).collect():
        got.setdefault(r["seed"], []).append((r["rank"], r["other"], r["similarity"]))
    for i, v in rows:
        want = sorted((-round(cosine(v, w), 9), j) for j, w in rows if j != i)[:3]
        mine = sorted(got[i])
        assert [j for _, j, _ in mine] == [j for _, j in want]
        assert all(abs(s + w) < 1e-6 for (_, _, s), (w, _) in zip(mine, want))
    approximate = vc.nearest_neighbors(df, 3, probes=4)
    assert vc.recall(vc.nearest_neighbors(df, 3), approximate).first()["recall"] > 0.5


def test_components_of_a_chain_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(7000, 6000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in range(100, 120)} == {100} and got[7000] == 6000


def test_ranked_equals_row_number(spark):
    rows = [(k, s, i) for i, (k, s) in enumerate(product("ab", [3, 1, 3, 2, 2, 3]))]
    df = spark.createDataFrame(rows, "k string, s int, id int")
    got = {(r["k"], r["id"]): r["rank"] for r in ranking.ranked(df, ["k"], [("desc", F.col("s"))], [F.desc("s"), F.asc("id")], "rank").collect()}
    for k in "ab":
        order = sorted(((-s, i) for kk, s, i in rows if kk == k))
        assert [got[(k, i)] for _, i in order] == list(range(1, len(order) + 1))


def test_previous_row_crosses_spans(spark):
    df = spark.createDataFrame([("x", p, p * 10) for p in (1, 2, 150, 151, 900)], "k string, p int, v int")
    rows = ranking.previous_row(df, ["k"], "p", F.col("v"), "before", span=100).orderBy("p").collect()
    assert [r["before"] for r in rows] == [None, 10, 20, 1500, 1510]


def test_exact_median(spark):
    for values, want in (([0.1, 0.4, 0.9], 0.4), ([0.1, 0.4, 0.9, 1.3], 0.65), ([0.5] * 5 + [0.7], 0.5)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert abs(ranking.exact_median(df, "v").first()["median"] - want) < 1e-12


def test_upsert_and_statuses(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    batch = spark.createDataFrame([(2, "b", 1), (3, "x", 2), (4, "n", 3), (4, "n", 4), (4, "m", 5)], "id long, v string, pos long")
    got = {r["id"]: (r["v"], r["status"]) for r in ch.upsert(current, batch, ["id"], ["v"], "pos").collect()}
    assert got == {1: ("a", "kept"), 2: ("b", "unchanged"), 3: ("x", "updated"), 4: ("m", "inserted")}
    steps = [r["status"] for r in ch.change_statuses(current, batch, ["id"], ["v"], "pos").orderBy("pos").collect()]
    assert steps == ["unchanged", "updated", "inserted", "unchanged", "updated"]


def test_entities_and_aliases(spark):
    rows = [(1, "Pedro Sánchez en Madrid", "El PP y el PSOE", "El PSOE pide. psoe responde. La Moncloa Azul. Pedro Sánchez dice que el PP no.")]
    df = spark.createDataFrame(rows, "id long, title string, summary string, article_text string")
    found = enrich.canonicalize(enrich.extract_entities(df)).orderBy("place").collect()
    names = [(r["entity_type"], r["name"], r["relevance"]) for r in found]
    assert names[0] == ("region_city", "Madrid", 0.8) and ("person", "Pedro Sánchez", 0.75) in names
    assert ("political_party", "psoe", 0.6) in names  # the last spelling of a listed name
    assert not any(n.startswith("La ") for _, n, _ in names)
    slugs = {r["slug"] for r in found}
    assert {"political_party-partido-popular", "political_party-psoe"} <= slugs
    psoe = next(r for r in enrich.mentions(enrich.canonicalize(enrich.extract_entities(df))).collect() if r["slug"].endswith("psoe"))
    assert (psoe["mention_count"], psoe["summary_hits"], psoe["body_hits"]) == (3, 1, 2)


def pair_row(i, **changes):
    row = dict(id=i, source=f"s{i}", published_at="2024-01-10 10:00:00", title="t", summary="", article_type="news_report",
               tag_codes=["politics_national"], entity_slugs=["person-a", "person-b"], key_phrases=["pacto"])
    return tuple((row | changes).values())


def reasons(spark, left, right):
    schema = ("id long, source string, published_at string, title string, summary string, article_type string, tag_codes array<string>, "
              "entity_slugs array<string>, key_phrases array<string>")
    articles = spark.createDataFrame([pair_row(1, **left), pair_row(2, **right)], schema).withColumn("published_at", F.to_timestamp("published_at"))
    pairs = spark.createDataFrame([(1, 2)], "left_id long, right_id long")
    return scoring.score_pairs(pairs, scoring.pair_features(articles)).first()["reason"]


def test_series_blocks(spark):
    lottery = dict(title="Comprobar Bonoloto: resultados de hoy", summary="")
    assert reasons(spark, lottery, lottery | {"published_at": "2024-01-11 10:00:00"})["hard_block"] == "recurring_results_series_excluded"
    assert reasons(spark, lottery, lottery)["hard_block"] is None
    live = dict(source="x", title="Última hora de la guerra")
    assert reasons(spark, live, dict(source="x", title="El pleno aprueba otra cosa"))["hard_block"] == "live_blog_series_excluded"
    ask = dict(source="x", title="¿Puedo subir la renta?", summary="Dudas de alquiler")
    assert reasons(spark, ask, ask | {"title": "¿Quién paga la caldera?"})["hard_block"] == "question_utility_series_excluded"
    way = dict(source="x", title="Itinerarios y horarios de la Semana Santa de Córdoba: lunes santo")
    assert reasons(spark, way, way | {"title": way["title"].replace("lunes", "martes")})["hard_block"] == "schedule_series_excluded"


def test_opinion_rules_and_penalties(spark):
    block = "opinion_editorial_excluded_from_primary_clusters"
    assert reasons(spark, {"article_type": "opinion"}, {})["hard_block"] == block
    assert reasons(spark, {"article_type": "editorial"}, {"article_type": "editorial"})["hard_block"] == block
    assert reasons(spark, {"article_type": "opinion"}, {"article_type": "opinion"})["hard_block"] is None
    glue = reasons(spark, {"title": "Una visita al museo", "article_type": "analysis", "key_phrases": ["uno"]},
                   {"title": "Cierre de la bolsa", "key_phrases": ["dos"]})
    assert glue["risky_bridge_pair"] and "entity_glue_penalty" in glue["penalties"]
    same = reasons(spark, {"title": "El Gobierno cierra el pacto"}, {"title": "El Gobierno cierra el pacto"})
    assert same["score"] > 0.9 and same["penalties"] == []


def test_default_vocabularies_are_ordered():
    assert list(lx.TOPIC_BUCKETS) == ["politics", "society", "international", "economy"]
    assert len(lx.CANONICAL_TAGS) == 41 and {c for c in lx.SECTION_TAGS.values()} <= {t[0] for t in lx.CANONICAL_TAGS}


def shared_by_force(rows, k, max_days):
    out = {}
    for i, ts, keys in rows:
        options = []
        for j, other, theirs in rows:
            days = abs((ts - other) // nearest.DAY_US)
            shared = len(set(keys) & set(theirs))
            if i != j and shared and days <= max_days:
                options.append((-(shared + max(0.0, 1 - days / max_days)), j, shared, days))
        for _, j, shared, days in sorted(options)[:k]:
            out[i, j] = (shared, days)
    return out


@pytest.mark.parametrize(("kinds", "least", "most"), [(15, 12, 12), (40, 1, 12), (12, 12, 12), (6, 0, 4)])
def test_shared_keys_of_rows_with_many_frequent_keys(spark, kinds, least, most):
    rng = random.Random(kinds)
    rows = []
    for i in range(220):
        day = rng.choice([0, 0, 0, 1, 3, 9, 20]) + rng.choice([0, 0.5])
        keys = rng.sample([f"key{x}" for x in range(kinds)], min(kinds, rng.randint(least, most)))
        rows.append((i, int(day * nearest.DAY_US), keys + ([f"rare{i // 2}"] if i % 3 == 0 else [])))
    df = spark.createDataFrame(rows, "id long, ts long, keys array<string>")
    got = {(r["seed"], r["other"]): (r["overlap"], r["days"]) for r in nearest.shared_key_candidates(df, 4, 7, hot=5).collect()}
    assert got == shared_by_force(rows, 4, 7)


@pytest.mark.parametrize(("coarse", "block"), [(4, 6), (1, 9), (1024, 2_000)])
def test_neighbours_through_divided_cells(spark, monkeypatch, coarse, block):
    monkeypatch.setattr(vc, "COARSE", coarse)
    monkeypatch.setattr(vc, "BLOCK_ROWS", block)
    monkeypatch.setattr(vc, "QUERY_ROWS", 25)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(20)] + [(700, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows}
    want = {}
    for i, v in unit.items():
        near = sorted((-round(sum(a * b for a, b in zip(v, w)), 9), j) for j, w in unit.items() if j != i)[:4]
        want[i] = [s for s, _ in near]
    exact = vc.nearest_neighbors(df, 4)
    got = {}
    for r in exact.orderBy("seed", "rank").collect():
        got.setdefault(r["seed"], []).append(-round(r["similarity"], 9))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)
    share = vc.recall(exact, vc.nearest_neighbors(df, 4, probes=8)).first()["recall"]
    assert share >= 0.9


def test_large_graphs_are_not_broadcast(spark, monkeypatch):
    """Forests and components of more than BROADCAST_ROWS rows come from sort-merge joins alone, with the same result."""
    from storyloom.operators import spanning

    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(1, 9))) for _ in range(80)], "a long, b long, weight double")
    run = lambda: (sorted(map(tuple, spanning.minimum_forest(edges).collect())), sorted(map(tuple, graph.connected_components(edges, "a", "b").collect())))
    status = spark._jsparkSession.sharedState().statusStore()

    def broadcasts(first):
        done = status.executionsList()
        ids = [done.apply(i).executionId() for i in range(done.size())]
        nodes = [status.planGraph(i).allNodes() for i in ids if i > first]
        return max(ids), sum(n.apply(i).name().startswith("BroadcastExchange") for n in nodes for i in range(n.size()))

    usual = run()
    last, _ = broadcasts(-1)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    assert run() == usual and broadcasts(last)[1] == 0


def test_tasks_follow_the_number_of_mentions(spark, monkeypatch):
    """1,000 mentions are dealt to 20 tasks and not to the session's four; entities of clusters agree with brute force."""
    rng = random.Random(6)
    members = [(i, 0 if i < 60 else i % 5) for i in range(120)]
    mentions = [(rng.randrange(130), rng.choice("abc"), rng.randrange(4), rng.randrange(10) / 100) for _ in range(1_000)]
    sides = spark.createDataFrame(members, "id long, cluster long"), spark.createDataFrame(mentions, "id long, slug string, mention_count long, relevance double")
    monkeypatch.setattr(stories, "MENTIONS_PER_TASK", 50)
    found = stories.cluster_entities(*sides)
    assert set(re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())) == {"20"}
    want, of = {}, dict(members)
    for i, slug, n, relevance in mentions:
        if i in of:
            ids, counts, sums = want.setdefault((of[i], slug), (set(), [], []))
            ids.add(i), counts.append(n), sums.append(relevance)
    got = {(r["cluster"], r["slug"]): (r["article_coverage_count"], r["mention_count"], r["aggregate_relevance_score"]) for r in found.collect()}
    assert got == {k: (len(ids), sum(counts), pytest.approx(sum(sums))) for k, (ids, counts, sums) in want.items()}
