"""Text and URL expressions. Everything here maps Column -> Column and runs inside codegen,
except the three Arrow functions that need Unicode tables Spark does not expose."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import lexicons as lx

WORD = r"[\p{L}\p{N}_]+"
MOJIBAKE_MARKERS = ("Ã", "Â", "â€")
# fixed values: calendar dates inside URL paths, tried in this order
DATE_SHAPES = (
    r"(?<!\d)(20\d{2})/(0[1-9]|1[0-2])/([0-2]\d|3[01])(?!\d)",
    r"(?<!\d)(20\d{2})-(0[1-9]|1[0-2])-([0-2]\d|3[01])(?!\d)",
    r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?!\d)",
)


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks whose compatibility form is one base letter plus marks."""
    marked, plain = [], []
    for code in range(0xAA, 0x250):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()


# --- Arrow functions ---------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def unicode_nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_accents_full(values: pd.Series) -> pd.Series:
    def strip(value):
        if value.isascii():
            return value
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))

    return values.map(strip, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if "&" in v else v, na_action="ignore")


# --- predicates over vocabularies --------------------------------------------------------------
def any_term(text: Column, terms) -> Column:
    """True when the text contains one of the terms (substring test, as in the rules)."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def count_terms(text: Column, terms) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def blank_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


# --- normalization -----------------------------------------------------------------------------
def _marker_count(text: Column) -> Column:
    total = F.lit(0)
    for marker in (*MOJIBAKE_MARKERS, "�"):
        total = total + (
            F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))
        ) / F.lit(len(marker))
    return total


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1, only when it lowers the number of suspicious marks."""
    suspicious = any_term(text, MOJIBAKE_MARKERS) & text.rlike(r"^[\x{0}-\x{FF}]*$")
    as_bytes = F.encode(F.when(suspicious, text), "ISO-8859-1")
    fixed = F.try_validate_utf8(as_bytes.cast("string"))
    better = fixed.isNotNull() & (_marker_count(fixed) < _marker_count(text))
    return F.when(better, fixed).otherwise(text)


def clean_text(text: Column, nfc: bool = True) -> Column:
    """Trim, compose, repair mojibake, drop control marks, collapse white space."""
    trimmed = strip(blank_if_null(text))
    composed = unicode_nfc(trimmed) if nfc else trimmed
    visible = F.regexp_replace(
        repair_mojibake(composed), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]", ""
    )
    return strip(F.regexp_replace(visible, r"[\s\p{Z}]+", " "))


def strip_accents(text: Column) -> Column:
    """Latin letters to their base letter, in the JVM; use strip_accents_full beyond Latin."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _MARKED, _PLAIN)


def lookup_key(text: Column, noise=lx.HONORIFICS) -> Column:
    flat = F.regexp_replace(F.lower(strip_accents(blank_if_null(text))), r"[^\p{L}\p{N}_\s]", " ")
    drop = F.array(*[F.lit(w) for w in ("", *noise)])
    kept = F.filter(F.split(flat, r"\s+"), lambda w: ~F.array_contains(drop, w))
    return F.array_join(kept, " ")


def slug(text: Column) -> Column:
    return F.substring(F.replace(lookup_key(text), F.lit(" "), F.lit("-")), 1, 120)


def content_words(text: Column, stopwords=lx.STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w))


def lexical_signature(title: Column, summary: Column, terms: lx.MatchTerms = lx.MatchTerms()) -> Column:
    """Distinct content words and adjacent word pairs of the headline and the summary."""
    text = F.array_join(F.filter(F.array(title, summary), lambda s: s != ""), " ")
    noise = F.array(*[F.lit(w) for w in terms.headline_noise])
    tokens = F.filter(content_words(text, terms.stopwords), lambda w: ~F.array_contains(noise, w))
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.array_union(tokens, pairs)


def vocabulary_hits(text: Column, vocabulary, stopwords=lx.STOPWORDS) -> Column:
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    return F.array_intersect(content_words(text, stopwords), vocab)


def embedding_text(source, section, title, summary, body, max_chars: int, nfc: bool = True) -> Column:
    def joined(parts, sep):
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)

    def clean(c):
        return clean_text(c, nfc)

    context = joined([clean(source), clean(section)], " | ")
    full = joined([context, clean(title), clean(summary), clean(body)], "\n\n")
    return strip(F.substring(full, 1, max_chars))


def snippet(summary: Column, body: Column, max_chars: int = 240, nfc: bool = True) -> Column:
    return F.substring(
        F.coalesce(F.nullif(clean_text(summary, nfc), F.lit("")), clean_text(body, nfc)), 1, max_chars
    )


# --- URLs --------------------------------------------------------------------------------------
def url_path(url: Column) -> Column:
    return F.lower(blank_if_null(F.try_parse_url(url, F.lit("PATH"))))


def is_noise_url(url: Column, fragments=lx.NOISE_URL_FRAGMENTS, suffixes=lx.ASSET_SUFFIXES) -> Column:
    link = F.lower(F.trim(url))
    path = blank_if_null(F.try_parse_url(link, F.lit("PATH")))
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | F.endswith(path, F.lit(suffix))
    return (link != "") & (any_term(link, fragments) | ends)


def url_date(url: Column) -> Column:
    """Calendar date in the path; the first shape that matches decides, even if it is no date."""
    path = blank_if_null(F.try_parse_url(F.lower(F.trim(url)), F.lit("PATH")))
    found = None
    for shape in DATE_SHAPES:
        text = F.concat_ws("-", *[F.regexp_extract(path, shape, g) for g in (1, 2, 3)])
        branch = (path.rlike(shape), F.try_to_date(text, "yyyy-MM-dd"))
        found = F.when(*branch) if found is None else found.when(*branch)
    return found


def absolute_links(page: Column, base: Column | None = None) -> Column:
    """href values of anchors, in page order; with a base, site-relative links are resolved."""
    links = F.transform(
        F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']+)["']"""), F.lit(1)), lambda h: F.trim(h)
    )
    if base is not None:
        root = F.concat(
            F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("HOST"))
        )
        links = F.transform(
            links, lambda h: F.when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(h)
        )
    return F.filter(links, lambda h: h.rlike("^https?://"))


# --- time --------------------------------------------------------------------------------------
# fixed values: accepted timestamp shapes after ISO 8601
TIME_SHAPES = (
    "EEE, dd MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ssZ",
    "yyyy-MM-dd",
)
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"


def parse_timestamp(text: Column) -> Column:
    """ISO or one of the listed shapes; a time without a zone is UTC; anything else is null."""
    value = F.trim(blank_if_null(text))
    iso = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    parsed = F.when(iso.rlike(_ISO), F.try_to_timestamp(iso))
    weekday_free = F.regexp_replace(value, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(
        parsed,
        F.when(
            value.rlike(r"^[A-Za-z]{3}, \d{2} "),
            F.try_to_timestamp(weekday_free, F.lit("dd MMM yyyy HH:mm:ss Z")),
        ),
        F.when(value.rlike(r" [+-]\d{4}$"), F.try_to_timestamp(value, F.lit(TIME_SHAPES[1]))),
        F.when(value.rlike(r"T.*[+-]\d{4}$"), F.try_to_timestamp(value, F.lit(TIME_SHAPES[2]))),
    )


def local_day(ts: Column, timezone: str = "Europe/Madrid") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, timezone))


def iso_text(ts: Column) -> Column:
    return blank_if_null(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[blank_if_null(c) for c in columns]), 256)


def floor_days_apart(left: Column, right: Column) -> Column:
    """abs(floor(left - right in days)): three hours back counts as one day, forward as none."""
    return F.abs(F.floor((F.unix_micros(left) - F.unix_micros(right)) / F.lit(86_400_000_000))).cast("int")


def time_decay(days: Column, max_days: int = 7) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(float(max_days)))
