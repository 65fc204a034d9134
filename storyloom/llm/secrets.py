"""Secret scan: keyword prefilter by an Aho-Corasick automaton, anchored patterns near hits only, embedded checksums.

One automaton runs over the text with A-Z folded and reports the places of the keywords of all kinds; a second one runs
over a line of character classes and reports where 24 hexadecimal digits stand in a row, as these have no keyword.
Patterns are tried at those places only, from left to right, and a place inside the last match of its kind is passed
over: the same matches as a search over the whole text gives. Tokens that carry a CRC-32 in their last six digits are
added only if it is right.

Defined results: null text counts as empty; every row gets its own result, repeated rows too; spans count code points,
their end is exclusive; equal starts are in the order of KINDS.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import CRC_TABLE, crc_sql, map_texts

#: Kinds of spans in the order of equal starts; the first three are the base ones.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: Least length of the value (assign) or of the match (others).
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Keywords, folded, with the kind whose pattern is anchored where they start.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "github": re.compile("gh[pousr]_([A-Za-z0-9]+)"),
    "npm": re.compile("npm_([A-Za-z0-9]+)"),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Characters of a token after its prefix, the last SIGNED of which are the checksum of the others.
BODY, SIGNED = 36, 6

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-case hexadecimal digits become h, other characters a dot; bytes after the first of a character are left out.
CLASSES = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 46 for b in range(256))
LATER = bytes(range(128, 192))


def signature(body: str) -> str:
    """CRC-32 as six digits to base 62."""
    rest, out = zlib.crc32(body.encode()), ""
    for _ in range(SIGNED):
        rest, digit = divmod(rest, 62)
        out = DIGITS[digit] + out
    return out


def signed(body: str) -> bool:
    return len(body) == BODY and signature(body[:-SIGNED]) == body[-SIGNED:]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words, self.runs = ahocorasick.Automaton(), ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (len(word), kind))
        self.runs.add_word("h" * LEAST["hex"], LEAST["hex"])
        self.words.make_automaton()
        self.runs.make_automaton()

    def places(self, data: bytes) -> Iterator[tuple[int, str]]:
        """(start, kind) of every keyword and of every 24 digits, each kind from left to right."""
        line = data.translate(FOLD).decode("utf-8", "surrogatepass")
        yield from sorted((last + 1 - size, kind) for last, (size, kind) in self.words.iter(line))
        for last, size in self.runs.iter_long(data.translate(CLASSES, LATER).decode("ascii")):
            yield last + 1 - size, "hex"

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, place in KINDS, end) of all spans, sorted."""
        if not text:
            return []
        spans, past = [], dict.fromkeys(KINDS, 0)
        for start, kind in self.places(text.encode("utf-8", "surrogatepass")):
            if start < past[kind]:
                continue
            hit = PATTERNS[kind].match(text, start)
            if hit is None:
                continue
            past[kind] = hit.end()
            if kind in LEAST:
                good = hit.end(hit.lastindex or 0) - hit.start(hit.lastindex or 0) >= LEAST[kind]
            else:
                good = signed(hit.group(1))
            if good:
                spans.append((start, KINDS.index(kind), hit.end()))
        return sorted(spans)


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`kept` (struct of the `keep` columns) and spans (array of kind, start, end) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        scanner = Scanner()
        return lambda texts: [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.find(t)] for t in texts], kind)]

    return map_texts(docs, text, keep, make, "spans array<struct<kind:string, start:bigint, end:bigint>>")


def redacted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`kept` and the whole text with every secret replaced by its kind in brackets; null stays null."""

    def make():
        scanner = Scanner()

        def mask(value):
            out, at = [], 0
            for start, kind, end in scanner.find(value):
                if start >= at:
                    out += [value[at:start], f"[{KINDS[kind]}]"]
                at = max(at, end)
            return None if value is None else "".join(out) + value[at:]

        return lambda texts: [pa.array([mask(t) for t in texts], pa.string())]

    return map_texts(docs, text, keep, make, "redacted string")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, of every document."""
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find(docs, ["doc_id"]).select("kept.doc_id", *map(of_kind, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _matches(kind: str, source: str, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS place, regexp_extract_all({source}, '{p}') AS m, regexp_extract_all({source}, '{p}', {group}) AS g, string_split_regex({source}, '{p}') AS r FROM d"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, coalesce(text, '') AS t, {_LOW} AS low FROM documents
), f AS (
  {_matches("assign", "low", ASSIGN, 2)}
  UNION ALL {_matches("access", "t", "AKIA[A-Z0-9]+", 0)}
  UNION ALL {_matches("hex", "t", "[0-9a-f]+", 0)}
  UNION ALL {_matches("github", "t", "gh[pousr]_([A-Za-z0-9]+)", 1)}
  UNION ALL {_matches("npm", "t", "npm_([A-Za-z0-9]+)", 1)}
), one AS (
  SELECT doc_id, kind, place, m[i] AS whole, g[i] AS part,
         list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM f)
), s AS (
  SELECT doc_id, kind, place, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) + length(whole) AS past FROM one
  WHERE CASE kind WHEN 'assign' THEN length(part) >= 6 WHEN 'access' THEN length(whole) >= 20 WHEN 'hex' THEN length(whole) >= 24 ELSE FALSE END
  UNION ALL
  SELECT doc_id, kind, place, CAST(start AS BIGINT), CAST(start AS BIGINT) + length(whole) FROM (
    SELECT *, {crc_sql("left(part, 30)")} AS crc FROM one, crc_table WHERE place > 2 AND length(part) = 36)
  WHERE right(part, 6) = array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda k: substr('{DIGITS}', CAST(crc // k % 62 AS INTEGER) + 1, 1)), '')
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
