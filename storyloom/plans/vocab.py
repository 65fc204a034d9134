"""Vocabularies for the registered queries.

The given tables hold invented prose, so the Spanish defaults rarely hit. These lists name words
that do occur, in the same shape, so that every rule of every cascade fires on some rows.
"""

from __future__ import annotations

from storyloom import lexicons as lx

CORPUS = lx.CorpusRules(
    excluded_paths=("/99", "/de/1"),
    excluded_sections=("fr",),
    source_excluded_sections={"src1": ("es",), "src2": ("de",)},
    excluded_text=("whwh", "ththth"),
    source_excluded_text={"src3": ("hein",), "src4": ("/en/3",)},
    soft_lifestyle=("ndedou", "heerst"),
    buckets={
        "politics": ("ofre", "hein", "tion"),
        "society": ("that", "nder", "with"),
        "international": ("ou", "thin", "ung"),
        "economy": ("ing", "and", "der"),
    },
    national_terms=("than", "from", "eau"),
    locality_paths=("/2", "/en/7"),
    source_path_bonus=(("src5", "/en/", 1.0), ("src6", "/de/", 0.5), ("src7", "/es/", 0.5)),
)
ENRICH = lx.EnrichRules(
    article_types={
        "opinion": ("editorial", "whst"),
        "analysis": ("ndha", "lich"),
        "interview": ("oure", "eren"),
        "live_blog": ("hinre", "qu"),
        "explainer": ("atre", "ver"),
    },
    section_tags={"en": "politics_national", "es": "economy_macro", "de": "sports", "attion": "culture"},
    keyword_tags={
        "elections": ("ofre", "eaux"),
        "justice": ("ndre", "ung"),
        "corruption": ("sher", "lich"),
        "energy": ("onti", "eau"),
        "health": ("with", "sch"),
        "housing": ("that the",),
    },
    entity_terms={
        "political_party": ("the", "der", "les"),
        "institution": ("attion", "ou the", "avec"),
        "organization": ("thanedble", "nicht", "con"),
        "region_city": ("oredble", "therou", "pour"),
    },
    person_articles=("the", "and"),
    aliases=(
        ("political_party", "the", "Théodule", ("the",)),
        ("institution", "ou the", "Attion", ("ou the",)),
        ("organization", "nicht", "Nicht Bund", ("nicht", "Bund")),
    ),
)
TERMS = lx.MatchTerms(
    stopwords=("the", "and", "of", "is", "in", "de", "la", "der", "die", "que", "el"),
    headline_noise=("attion", "that"),
    event_terms=("on", "ing", "ou", "eau", "er", "with", "re", "ti", "to", "for"),
    followup_markers=("with", "from", "he", "en"),
)
HONORIFICS = ("the", "der", "les", "el", "un")
