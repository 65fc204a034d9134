"""Text, URL and JSON expressions on literal rows."""

from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.functions import measures as ms
from storyloom.functions import text as tx
from storyloom.sources import pages as pg


def one(spark, value, expression):
    kind = "string" if value is None or isinstance(value, str) else "array<string>"
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("r")).first()["r"]


def test_clean_text_repairs_and_strips(spark):
    assert one(spark, "  informaciÃ³n \u0000 de\u0007\tEspaÃ±a ", tx.clean_text) == "información de España"
    assert one(spark, "uno\ufffd  dos", tx.clean_text) == "uno dos"
    assert one(spark, "Ã³\ufffd", tx.clean_text) == "Ã³"  # not Latin-1, so not repaired
    assert one(spark, "café Âncora", tx.clean_text) == "café Âncora"
    assert one(spark, None, tx.clean_text) == ""


def test_lookup_key_and_slug(spark):
    assert one(spark, "El Presidente Sánchez, Pedro", tx.lookup_key) == "el sanchez pedro"
    assert one(spark, "Unión Europea (UE)", tx.slug) == "union-europea-ue"
    assert one(spark, "Ångström ﬁn", tx.strip_accents_full) == "Angstrom fin"


def test_signature_has_words_and_pairs(spark):
    sig = one(spark, "El pacto de las cuentas", lambda c: tx.lexical_signature(c, F.lit("")))
    assert sorted(sig) == ["cuentas", "pacto", "pacto cuentas"]
    assert one(spark, "", lambda c: tx.lexical_signature(c, F.lit(""))) == []


def test_url_parts(spark):
    date = lambda u: one(spark, u, lambda c: F.date_format(tx.url_date(c), "yyyy-MM-dd"))
    assert date("https://x.es/a/2024/03/05/b.html") == "2024-03-05"
    assert date("https://x.es/a/2024-02-31/20240301.html") is None  # first shape wins, even if no date
    assert date("https://x.es/a/x20240301y") == "2024-03-01"
    assert date("https://x.es/120240301/") is None
    assert one(spark, "https://x.es/deportes/a", tx.is_noise_url) is True
    assert one(spark, "https://x.es/a/b.PNG?x=1", tx.is_noise_url) is True
    assert one(spark, "https://x.es/politica/a", tx.is_noise_url) is False


def test_parse_timestamp(spark):
    stamp = lambda v: one(spark, v, lambda c: F.date_format(tx.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert stamp("2024-01-10T10:00:00Z") == "2024-01-10 10:00:00"
    assert stamp("2024-01-10T10:00:00+02:00") == "2024-01-10 08:00:00"
    assert stamp("Wed, 10 Jan 2024 10:00:00 +0100") == "2024-01-10 09:00:00"
    assert stamp("2024-01-10 10:00:00 +0100") == "2024-01-10 09:00:00"
    assert stamp("2024-01-10") == "2024-01-10 00:00:00"
    assert stamp("yesterday") is None


def test_local_day_changes_at_madrid_midnight(spark):
    day = lambda v: one(spark, v, lambda c: tx.local_day(F.to_timestamp(c)).cast("string"))
    assert day("2024-07-01 22:30:00") == "2024-07-02" and day("2024-01-01 22:30:00") == "2024-01-01"


def test_floor_days_depends_on_direction(spark):
    days = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(
        tx.floor_days_apart(F.to_timestamp("a"), F.to_timestamp("b")).alias("d")).first()["d"]
    assert days("2024-01-01 00:00:00", "2024-01-01 03:00:00") == 1
    assert days("2024-01-01 03:00:00", "2024-01-01 00:00:00") == 0


def test_title_similarity_matches_its_definition(spark):
    a, b = "El Gobierno cierra el pacto", "Gobierno y PNV cierran un pacto"
    got = spark.createDataFrame([(a, b)], "a string, b string").select(ms.title_similarity_udf(lx.STOPWORDS)("a", "b").alias("s")).first()["s"]
    left, right = {"gobierno", "cierra", "pacto"}, {"gobierno", "y", "pnv", "cierran", "pacto"}
    text = lambda words: " ".join(sorted(words))
    r = lambda x, y: SequenceMatcher(None, x, y).ratio()
    token = max(r(text(left), text(right)), r(text(left & right), text(left)), r(text(left & right), text(right)))
    assert got == round(0.35 * r(a.lower(), b.lower()) + 0.65 * token, 4)


def test_json_readers(spark):
    assert one(spark, '["a", 1, {"b": 2}, "c"]', ms.json_strings) == ["a", "c"]
    assert one(spark, "not json", ms.json_strings) == []
    assert one(spark, 'text {"a": {"b": 1}} more', ms.json_block) == '{"a": {"b": 1}}'


PAGE = """<html><head><title>T &amp; t</title><meta property="og:title" content="Og title">
<meta name="description" content="A summary"><meta property="article:published_time" content="2024-01-10T10:00:00+01:00">
<meta property="article:tag" content="Uno, dos"><meta property="article:tag" content="DOS,tres">
<script type="application/ld+json">{"@graph": [{"x": 1, "articleBody": "The  stated body"}]}</script>
<script type="application/ld+json">{broken</script></head><body><p>short</p><a href="/r">r</a><a href="https://x.es/abs">a</a></body></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([("https://www.x.es/p", PAGE)], "url string, html string")
    row = pg.article_rows(df, pg.host(F.col("url"))).first()
    assert (row["source"], row["title"], row["summary"], row["article_text"], row["tags"]) == (
        "x.es", "Og title", "A summary", "The stated body", "Uno, dos, tres")
    assert row["published_at"].isoformat() == "2024-01-10T09:00:00"
    links = df.select(tx.absolute_links(F.col("html")).alias("a"), tx.absolute_links(F.col("html"), F.col("url")).alias("b")).first()
    assert links["a"] == ["https://x.es/abs"] and links["b"] == ["https://www.x.es/r", "https://x.es/abs"]


def test_publisher_body_stops_at_its_div(spark):
    page = ('<div class="ue-c-article__body"><p class="ue-c-article__paragraph">One , <b>two</b></p><div>x</div>'
            '<p class="ue-c-article__paragraph">Three</p></div><p class="ue-c-article__paragraph">Outside</p>')
    assert one(spark, page, pg.publisher_body) == "One, two Three"
    assert one(spark, page.replace("</div>", ""), pg.publisher_body) == ""


def test_main_text_needs_400_characters(spark):
    long = "<nav><p>menu</p></nav><p>" + "word " * 100 + "</p>"
    assert one(spark, "<p>short</p>", pg.main_text) == ""
    assert one(spark, long, pg.main_text) == ("word " * 100).strip()


def test_title_query_decodes_what_its_sql_decodes(spark, tmp_path):
    """A reference without its semicolon stays, as in the query's SQL."""
    from __spark_entry__ import oracle_sql, queries

    titles = ["a &amp", "a &amp; b &lt;c&gt; &amp;lt;", " &quot;x&#39; ", "&eacute; &ltx", ""]
    rows = [(i, f"<html><title>{t}</title></html>") for i, t in enumerate([*titles, "cut"])] + [(9, "no title")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["title"] for r in queries()["t10_html_title_meta"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1] for r in db.execute(oracle_sql()["t10_html_title_meta"]).fetchall()}
    assert got[0] == "a &amp" and got[1] == "a & b <c> &lt;"


def test_ratios_of_many_pairs_are_those_of_difflib(spark):
    """Short and long texts, with and without frequent characters, compared together."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 150, 199, 200, 260, 383, 390])))
    pairs = [("", ""), ("a", ""), ("é😀x", "x😀é")]
    for _ in range(250):
        a = text(rng.choice(["ab", "abcdefghij klmnop", "áéí😀 abc"]))
        pairs.append((a, "".join(c for c in a if rng.random() < 0.9) if rng.random() < 0.4 else text("abcdé ")))
    found = ms.ratios(pairs)
    assert all(found[a, b] == SequenceMatcher(None, a, b).ratio() for a, b in pairs)
    rows = [(a, b) for a, b in pairs] + [(None, "x")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", ms.title_similarity_udf(lx.STOPWORDS)("a", "b").alias("s"), ms.title_bound_udf(lx.STOPWORDS)("a", "b").alias("most"))
    assert all(r["s"] is None if r["a"] is None else r["s"] <= r["most"] for r in df.collect())
