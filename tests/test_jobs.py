"""Sinks, labelled files, editorial answers and entry points."""

import json

from pyspark.sql import functions as F

from storyloom.operators import density as dn
from storyloom.operators import editorial as ed
from storyloom.operators import evaluate as ev
from storyloom.operators import raw_editorial as raw
from storyloom.operators import stories
from storyloom.sources import feeds


def answer_rows(spark, *answers):
    texts = [(i, a if isinstance(a, str) else "```json\n" + json.dumps(a) + "\n```") for i, a in enumerate(answers)]
    return {r["id"]: r for r in raw.normalize(spark.createDataFrame(texts, "id int, answer string"), "id", "answer").collect()}


def test_answers_of_many_shapes(spark):
    got = answer_rows(
        spark,
        {"article_type": "breaking news", "confidence": "high", "bias_label": "center-left", "bias_score": "-0.4", "tone_emotional": "neutral",
         "tone_target": "mixed", "framing_devices": ["security", "odd"], "evidence_spans": ["a quoted span"], "rationale": "A rationale about public policy."},
        {"article_type": "opinion", "confidence": {"value": "odd", "score": 0.9}, "ideological_bias_framing": {"direction": "right", "confidence": 0.7},
         "tone_dimensions": {"accusatory": "moderate"}, "framing_devices": {"conflict": True, "balance": "x"},
         "evidence_spans": {"text": "some words", "location": "titular"}, "notes": {"summary": "notes that are long enough to judge"}},
        {"article_type": "news"}, {"article_type": 5}, "no json",
        {"article_type": "report", "evidence_spans": [{"span": "liga y gol de la champions"}], "rationale": "recap of a match, long enough"},
    )
    first, second = got[0], got[1]
    assert (first["article_type"], first["bias_label"], first["bias_score"], first["tone_emotional"]) == ("news_report", "center_left", -0.4, "calm")
    assert first["error"] is None and first["tone_target_status"] == "conflicted_signal" and first["framing_status"] == "conflicted_signal"
    assert (second["bias_label"], second["bias_confidence"], second["article_type_confidence"]) == ("right", 0.7, 0.9)
    assert (second["tone_emotional"], second["tone_target"], second["opinionatedness"]) == ("loaded", "critical", "interpretive")
    assert second["evidence_spans"][0]["type"] == "headline" and "repair_data_loss" in second["unclear_reasons"]
    assert got[2]["error"].startswith("normalization failed") and got[3]["error"].startswith("raw payload") and got[4]["error"]
    assert got[5]["editorial_applicability_reason"] == "sports_recap" and got[5]["bias_status"] == "out_of_domain"


def test_answers_are_cut_into_fields_once(spark):
    """Each top-level field is read from the whole answer by one expression."""
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        rows = raw.normalize(spark.createDataFrame([(1, "{}")], "id int, answer string"), "id", "answer")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("$.evidence_spans") == 1 and plan.count("$.article_type_confidence") == 1


def test_contract_rules(spark):
    row = spark.createDataFrame(
        [("opinion", 0.8, "left", 0.3, 0.5, "calm", "hostile", "straight_reporting", "low", "assertive")],
        "article_type string, article_type_confidence double, bias_label string, bias_score double, bias_confidence double, tone_emotional string, "
        "tone_target string, opinionatedness string, sensationalism string, rhetorical_certainty string")
    valid, refused = ed.split_valid(row, ed.editorial_violations())
    assert valid.count() == 0 and set(refused.first()["violations"]) == {"bias_side", "bias_distance", "hostile_straight_reporting"}


def test_labelled_file_end_to_end(spark, tmp_path):
    """A rewrite pair, an opinion piece on the same event and an unrelated article."""
    base = {"section": "", "author": "", "article_text": "", "tags": ""}
    article = lambda i, source, title, summary, at: {"id": i, "source": source, "title": title, "url": f"https://{source}/{i}", "published_at": at, "summary": summary, **base}
    shared = {"tag_codes": ["politics_national"], "entity_slugs": ["person-ana", "person-luis"], "key_phrases": ["pacto de cuentas"]}
    data = {
        "articles": [
            {"article": article(1, "a", "Ana y Luis cierran el pacto de cuentas", "Firman el acuerdo", "2024-01-10T10:00:00Z"), "analysis": {"article_type": "news_report"}, **shared},
            {"article": article(2, "b", "Ana y Luis sellan el pacto de cuentas", "Firman el acuerdo", "2024-01-10T12:00:00Z"), "analysis": {"article_type": "news_report"}, **shared},
            {"article": article(3, "c", "El pacto de cuentas, un error", "Columna", "2024-01-10T13:00:00Z"), "analysis": {"article_type": "opinion"}, **shared},
            {"article": article(4, "d", "Nieve en la sierra", "Frío", "2024-01-11T10:00:00Z"), "analysis": {"article_type": "news_report"}, "tag_codes": [], "entity_slugs": [], "key_phrases": ["nieve"]},
        ],
        "pair_labels": [{"left_article_id": 2, "right_article_id": 1, "label": "same_event", "notes": ""}, {"left_article_id": 1, "right_article_id": 3, "label": "different_event", "notes": ""}],
        "gold_clusters": [[1, 2], [3], [4]],
    }
    path = tmp_path / "set.json"
    path.write_text(json.dumps(data))
    articles, labels, gold = feeds.labelled_dataset(spark, str(path))
    pairs, members = stories.build_stories(articles, None, 0.55)
    assert {r["id"]: r["cluster"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    row = ev.evaluate_pairs(labels, pairs).first()
    assert (row["precision"], row["recall"], row["f1"]) == (1.0, 1.0, 1.0)
    row = ev.evaluate_clusters(members, gold).first()
    assert (row["precision"], row["recall"]) == (1.0, 1.0)
    assert stories.run_metrics(articles, pairs, members).first()["guarded_cluster_count"] == 3
    sweep = {r["threshold"]: r["tp"] for r in ev.cluster_sweep(articles, pairs, gold, [0.55, 1.5]).collect()}
    assert sweep == {0.55: 1, 1.5: 0}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'T "q"', "u", "s", "", "", "x,y", "b", "")], "source string, title string, url string, section string, author string, tags string, summary string, article_text string, extra string")
    rows = rows.withColumn("published_at", F.to_timestamp(F.lit("2024-01-10 10:00:00")))
    feeds.export_articles(rows, str(tmp_path / "j"), "json")
    feeds.export_articles(rows, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).first()["published_at"] == "2024-01-10T10:00:00+00:00"
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"')
    assert back.columns == list(feeds.EXPORT_COLUMNS) and back.first()["title"] == 'T "q"'
    points = lambda v, *names: spark.createDataFrame([(n, v) for n in names], "projection_set string, x int")
    for step in (points(1, "p", "q"), points(2, "q")):
        feeds.replace_partitions(step, str(tmp_path / "p"))
    assert {(r["projection_set"], r["x"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("p", 1), ("q", 2)}


def test_density_finds_two_groups_and_an_outlier(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(6)] + [(10 + i, [0.0, 0.01 * i, 1.0]) for i in range(6)] + [(99, [-1.0, -1.0, -1.0])]
    got = {r["id"]: r["cluster"] for r in dn.density_clusters(spark.createDataFrame(rows, "id long, embedding array<double>")).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[10 + i] for i in range(6)} == {10} and 99 not in got


def test_projection_is_pca(spark):
    import numpy as np

    from storyloom.operators import vectors as vc

    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) * np.array([5, 3, 2, 0.1, 0.1])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<double>")
    xyz = np.array([[r["x"], r["y"], r["z"]] for r in vc.project(df.repartition(3)).orderBy("id").collect()])
    values = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)[:3] ** 2 / 60
    assert np.allclose(xyz.var(axis=0), values) and np.allclose(np.cov(xyz.T) - np.diag(np.diag(np.cov(xyz.T))), 0, atol=1e-9)
    one = vc.project(df.limit(1)).first()
    assert (one["x"], one["y"], one["z"]) == (0.0, 0.0, 0.0)


def test_entry_points(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
