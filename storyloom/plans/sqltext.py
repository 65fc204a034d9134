"""SQL fragments for the checks of the registered queries (DuckDB dialect)."""

from __future__ import annotations

ARTICLES = """
articles AS (
  SELECT doc_id AS id, source,
         trim(split_part(text, '.', 1)) AS title,
         'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 % 43200 AS BIGINT)) AS published_at,
         lang AS section, '' AS author,
         trim(split_part(text, '.', 2)) AS summary,
         text AS article_text, '' AS tags
  FROM documents)"""


def quoted(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def in_list(terms) -> str:
    return "(" + ", ".join(quoted(t) for t in terms) + ")"


def any_term(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")" if terms else "false"


def count_terms(column: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {quoted(t)}) AS INTEGER)" for t in terms) + ")"


def array(terms) -> str:
    return "[" + ", ".join(quoted(t) for t in terms) + "]"


def lookup_key(column: str, noise) -> str:
    flat = f"regexp_replace(lower(strip_accents({column})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return (
        f"array_to_string(list_filter(string_split_regex({flat}, '\\s+'), "
        f"lambda w: w <> '' AND NOT list_contains({array(noise)}, w)), ' ')"
    )


def words(column: str, stop) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: NOT list_contains({array(stop)}, w))"
    )


def path(column: str) -> str:
    """Path of an absolute URL: after the host, before the query and the fragment."""
    return f"lower(regexp_extract({column}, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
