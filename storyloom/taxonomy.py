"""Editorial vocabulary: allowed values, aliases of model answers, domain key words.

The tables are fixed values: canonical rows depend on them word by word.
"""

from __future__ import annotations

DIMENSIONS = (
    "article_type", "bias", "tone_emotional", "tone_target", "opinionatedness", "sensationalism",
    "rhetorical_certainty", "framing",
)
STATUSES = (
    "resolved", "weak_signal_abstain", "mapping_loss", "provider_missing", "out_of_domain", "conflicted_signal",
)

# --- fixed values: allowed values --------------------------------------------------------------
ALLOWED = {
    "article_type": (
        "news_report", "live_blog", "analysis", "opinion", "editorial", "interview", "feature", "explainer", "other",
        "unclear",
    ),
    "bias_label": ("far_left", "left", "center_left", "center", "center_right", "right", "far_right", "unclear"),
    "tone_emotional": ("calm", "loaded", "inflammatory", "unclear"),
    "tone_target": ("supportive", "neutral", "critical", "hostile", "mixed", "unclear"),
    "opinionatedness": ("straight_reporting", "interpretive", "opinionated", "activist", "unclear"),
    "sensationalism": ("low", "medium", "high", "unclear"),
    "rhetorical_certainty": ("cautious", "assertive", "absolute", "unclear"),
}
FRAMING_DEVICES = (
    "conflict", "economic_consequence", "moral_judgment", "public_order_security", "identity_culture",
    "governance_competence", "corruption_scandal", "humanitarian", "victimization", "progress_modernization",
    "institutional_stability", "strategic_geopolitics",
)
EVIDENCE_TYPES = ("headline", "summary", "body")
BIAS_SCORES = {
    "far_left": -0.9, "left": -0.65, "center_left": -0.35, "center": 0.0, "center_right": 0.35, "right": 0.65,
    "far_right": 0.9, "unclear": 0.0,
}

# --- fixed values: aliases ---------------------------------------------------------------------
ALIASES = {
    "article_type": {
        "breaking_news": "news_report", "breaking_news_crime_report": "news_report", "crime_report": "news_report",
        "crime_news": "news_report", "noticia_accidente": "news_report", "straight_news": "news_report",
        "straight_reporting": "news_report", "news": "news_report", "report": "news_report",
        "match_report": "news_report", "election_results_report": "news_report",
        "local_news_event_coverage": "news_report", "analysis_piece": "analysis", "op_ed": "opinion",
        "op-ed": "opinion", "column": "opinion", "qa": "interview", "q&a": "interview", "longform_feature": "feature",
        "long_form_feature": "feature", "backgrounder": "explainer",
    },
    "bias_label": {
        "far-left": "far_left", "center-left": "center_left", "centre-left": "center_left", "centre": "center",
        "centered": "center", "center-right": "center_right", "centre-right": "center_right", "far-right": "far_right",
        "neutral": "unclear", "none": "unclear", "no_bias": "unclear", "non_ideological": "unclear",
        "sin_sesgo_claro": "unclear", "pro_real_madrid": "unclear", "protester_sympathetic": "unclear",
    },
    "tone_emotional": {
        "neutral": "calm", "objective": "calm", "restrained": "calm", "descriptive": "calm", "factual": "calm",
        "measured": "calm", "informative_and_sober": "calm", "informativo_y_sobrio": "calm", "low": "calm",
        "baja": "calm", "bajo": "calm", "false": "calm", "moderate": "loaded", "medium": "loaded", "high": "loaded",
        "very_high": "inflammatory", "emotional": "loaded", "charged": "loaded", "alarmist": "inflammatory",
        "provocative": "inflammatory", "none": "calm",
    },
    "tone_target": {
        "balanced": "mixed", "ambivalent": "mixed", "negative": "critical", "adversarial": "hostile",
        "positive": "supportive", "objective": "neutral", "none": "neutral", "partial": "mixed", "false": "neutral",
    },
    "opinionatedness": {
        "objective_reporting": "straight_reporting", "factual_reporting": "straight_reporting",
        "news_reporting": "straight_reporting", "analysis": "interpretive", "commentary": "opinionated",
        "advocacy": "activist", "neutral": "straight_reporting", "absent": "opinionated", "high": "opinionated",
        "moderate": "interpretive", "low": "straight_reporting", "false": "straight_reporting",
    },
    "sensationalism": {
        "none": "low", "minimal": "low", "low": "low", "bajo": "low", "baja": "low", "moderate": "medium",
        "media": "medium", "medio": "medium", "elevated": "medium", "very_high": "high", "alta": "high", "alto": "high",
        "false": "low", "true": "medium",
    },
    "rhetorical_certainty": {
        "measured": "cautious", "qualified": "cautious", "neutral": "assertive", "factual": "assertive",
        "direct": "assertive", "categorical": "absolute", "dogmatic": "absolute", "high": "assertive",
        "moderate": "assertive", "low": "cautious",
    },
    "framing": {
        "security": "public_order_security", "law_and_order": "public_order_security",
        "public_safety": "public_order_security", "crime_public_safety": "public_order_security",
        "order_and_security": "public_order_security", "geopolitics": "strategic_geopolitics",
        "strategic_security": "strategic_geopolitics", "stability": "institutional_stability",
        "institutional_continuity": "institutional_stability", "anti_corruption": "corruption_scandal",
        "corruption": "corruption_scandal", "victim_frame": "victimization", "human_rights": "humanitarian",
        "culture_war": "identity_culture", "economic_impact": "economic_consequence",
        "competence": "governance_competence", "conflict_frame": "conflict", "moral_frame": "moral_judgment",
        "modernization": "progress_modernization", "martial_warfare": "conflict", "crisis_framing": "conflict",
        "binary_framing": "conflict", "headline_ambiguity": "conflict", "religious_sacramental": "moral_judgment",
        "heroic_narrative": "victimization", "epic_heroic": "victimization", "heroes_victims": "victimization",
        "regional_pride": "identity_culture", "movement_legitimacy_language": "identity_culture",
        "impact_amplification": "economic_consequence", "quantitative_acceleration": "economic_consequence",
        "scope_expansion": "institutional_stability", "growth_framing": "conflict", "collective_action": "conflict",
        "grassroots_legitimacy": "identity_culture", "rural_urban_tension": "identity_culture",
        "preventive_advocacy": "moral_judgment", "accusatory_headline": "conflict", "no_counterbalance": "conflict",
        "procedural_focus": "institutional_stability", "direct_quote": "institutional_stability",
        "single_source": "institutional_stability", "direct_quotation_of_critical_questions": "conflict",
        "opposition_questions_as_headline_focus": "conflict",
        "multiple_party_coverage_for_balance": "institutional_stability",
        "temporal_framing_emphasizing_finality": "institutional_stability",
    },
    "evidence_type": {
        "titular": "headline", "hechos": "body", "atribución_fuente": "body", "atribucion_fuente": "body",
        "respuesta_emergencias": "body",
    },
}
CONFIDENCE_WORDS = {
    "low": 0.25, "bajo": 0.25, "baja": 0.25, "moderate": 0.5, "medium": 0.5, "medio": 0.5, "media": 0.5,
    "high": 0.75, "alto": 0.75, "alta": 0.75,
}

# --- fixed values: texts outside the domain, in order ------------------------------------------
OUT_OF_DOMAIN = {
    "sports_recap": ("liga", "gol", "partido", "entrenador", "victoria", "derrota", "champions"),
    "accident_crime_bulletin": ("accidente", "herido", "muerto", "emergencias", "suceso", "arma blanca", "tráfico"),
    "consumer_price_roundup": ("precio", "euros", "ofertas", "hoteles", "viajar", "gasolina", "supermercado"),
    "weather_or_service_info": ("temperaturas", "lluvia", "tráfico", "cortes", "aviso amarillo", "servicio"),
}
PROCEDURAL = ("procedural", "votación", "tribunal", "congreso")
