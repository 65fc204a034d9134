"""Default rule vocabularies.

Every job takes its vocabulary as an argument; these are the defaults. The tables below are
fixed values: results depend on their content and on their order, so they are written out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


# --- fixed values: text matching -------------------------------------------------------------
HONORIFICS = (
    "presidente", "presidenta", "ministro", "ministra", "portavoz", "señor", "señora", "sr", "sra", "don", "doña",
)
STOPWORDS = (
    "a", "al", "ante", "asi", "como", "con", "contra", "de", "del", "despues", "dos", "el", "en", "entre", "esta",
    "este", "ha", "hoy", "la", "las", "lo", "los", "mas", "por", "que", "se", "sin", "sobre", "su", "sus", "tras", "un",
    "una", "uno", "varios", "varias", "ya",
)
EVENT_TERMS = (
    "acuerdo", "ajustes", "anuncia", "anuncian", "anuncio", "cierra", "cierre", "condiciones", "conversaciones",
    "cuentas", "exige", "exigen", "firma", "negocia", "negociacion", "negociaciones", "pacto", "presupuestario",
    "presupuestaria", "presupuestos", "reclama", "sella",
)
FOLLOWUP_MARKERS = (
    "ajustes", "condiciones", "despues", "exige", "exigen", "reclama", "reaccion", "responde", "siguen",
)
HEADLINE_NOISE = ("ultima", "hora", "claves", "asi", "asi queda", "directo", "en directo")

# --- fixed values: article types, first rule with a hit wins ----------------------------------
ARTICLE_TYPE_RULES = {
    "opinion": ("opinión", "opinion", "tribuna", "columna", "editorial"),
    "analysis": ("análisis", "analysis", "claves", "qué significa", "radiografía"),
    "interview": ("entrevista", "preguntas y respuestas"),
    "live_blog": ("última hora", "directo", "live"),
    "explainer": ("explicado", "explicador", "qué es", "cómo funciona"),
}

# --- fixed values: tags, in rule order --------------------------------------------------------
SECTION_TAGS = {
    "politica": "politics_national",
    "política": "politics_national",
    "espana": "politics_national",
    "españa": "politics_national",
    "catalunya": "politics_regional",
    "cataluña": "politics_regional",
    "economia": "economy_macro",
    "economía": "economy_macro",
    "empresa": "business_corporate",
    "justicia": "justice",
    "tribunales": "justice",
    "salud": "health",
    "sanidad": "health",
    "educacion": "education",
    "educación": "education",
    "medio ambiente": "environment",
    "clima": "climate",
    "tecnologia": "technology",
    "tecnología": "technology",
    "internacional": "international_diplomacy",
    "ue": "international_eu",
    "europa": "international_eu",
    "deportes": "sports",
}
KEYWORD_TAGS = {
    "elections": ("elecciones", "campaña", "voto", "urnas"),
    "justice": ("juez", "jueza", "tribunal", "supremo", "fiscalía", "fiscalia"),
    "corruption": ("corrupción", "corrupcion", "mordida", "comisión", "comision"),
    "agreement_negotiation": ("acuerdo", "negociación", "negociacion", "pacto"),
    "statement_reaction": ("reacción", "reaccion", "responde", "replica", "dice"),
    "policy_announcement": ("anuncia", "anuncio", "plan", "medida", "decreto"),
    "protest_social_movement": ("manifestación", "manifestacion", "protesta", "huelga"),
    "security_crime": ("detenido", "crimen", "asesinato", "robo", "policía", "policia"),
    "war_conflict": ("guerra", "ataque", "bombardeo", "frente"),
    "international_eu": ("bruselas", "ue", "unión europea", "union europea"),
    "housing": ("vivienda", "alquiler", "hipoteca"),
    "health": ("hospital", "sanidad", "médico", "medico"),
    "education": ("escuela", "universidad", "alumnos"),
    "transport": ("tren", "renfe", "aeropuerto", "metro"),
    "energy": ("apagón", "apagon", "eléctrica", "electrica", "gas"),
    "sports": ("liga", "partido", "gol", "entrenador"),
}
# code, display name, group; the sort order is 10, 20, 30, …
CANONICAL_TAGS = (
    ("politics_national", "Politics / National", "politics"),
    ("politics_regional", "Politics / Regional", "politics"),
    ("politics_local", "Politics / Local", "politics"),
    ("government", "Government", "politics"),
    ("parliament", "Parliament", "politics"),
    ("justice", "Justice", "politics"),
    ("elections", "Elections", "politics"),
    ("public_policy", "Public policy", "politics"),
    ("corruption", "Corruption", "politics"),
    ("protest_social_movement", "Protest / Social movement", "politics"),
    ("economy_macro", "Economy / Macro", "economy"),
    ("business_corporate", "Business / Corporate", "economy"),
    ("housing", "Housing", "economy"),
    ("energy", "Energy", "economy"),
    ("transport", "Transport", "economy"),
    ("labour_employment", "Labour / Employment", "economy"),
    ("health", "Health", "society"),
    ("education", "Education", "society"),
    ("migration", "Migration", "society"),
    ("security_crime", "Security / Crime", "society"),
    ("environment", "Environment", "society"),
    ("climate", "Climate", "society"),
    ("technology", "Technology", "society"),
    ("media_information", "Media / Information", "society"),
    ("culture", "Culture", "society"),
    ("sports", "Sports", "society"),
    ("international_eu", "International / EU", "international"),
    ("international_diplomacy", "International / Diplomacy", "international"),
    ("war_conflict", "War / Conflict", "international"),
    ("defense", "Defense", "international"),
    ("humanitarian", "Humanitarian", "international"),
    ("legislation", "Legislation", "story_form"),
    ("court_case", "Court case", "story_form"),
    ("investigation", "Investigation", "story_form"),
    ("scandal", "Scandal", "story_form"),
    ("agreement_negotiation", "Agreement / Negotiation", "story_form"),
    ("accident_disaster", "Accident / Disaster", "story_form"),
    ("election_campaign", "Election campaign", "story_form"),
    ("statement_reaction", "Statement / Reaction", "story_form"),
    ("policy_announcement", "Policy announcement", "story_form"),
    ("data_report", "Data report", "story_form"),
)

# --- fixed values: entities -------------------------------------------------------------------
ENTITY_TERMS = {
    "political_party": ("PSOE", "PP", "Sumar", "Podemos", "Vox", "ERC", "Junts", "PNV", "Bildu"),
    "institution": (
        "Congreso", "Senado", "Gobierno", "Fiscalía", "Fiscalia", "Tribunal Supremo", "Generalitat", "Unión Europea",
        "Union Europea", "UE",
    ),
    "organization": ("ONU", "OTAN", "RTVE", "Renfe", "Aemet"),
    "region_city": (
        "Madrid", "Barcelona", "Catalunya", "Cataluña", "Galicia", "Lugo", "Valencia", "Sevilla", "Bilbao", "Bruselas",
    ),
}
PERSON_ARTICLES = ("el", "la", "los", "las")
# (type, lookup key, canonical name, aliases)
ENTITY_ALIASES = (
    ("political_party", "psoe", "PSOE", ("Partido Socialista Obrero Español",)),
    ("political_party", "partido socialista obrero espanol", "PSOE",
     ("Partido Socialista Obrero Español",)),
    ("political_party", "pp", "Partido Popular", ("PP",)),
    ("institution", "ue", "Unión Europea", ("UE", "Union Europea")),
    ("institution", "union europea", "Unión Europea", ("UE",)),
    ("institution", "generalitat", "Generalitat de Catalunya", ("Generalitat",)),
)

# --- fixed values: corpus selection -----------------------------------------------------------
NATIONAL_TERMS = (
    "gobierno", "congreso", "senado", "tribunal", "supremo", "constitucional", "fiscal", "minister", "moncloa",
    "sanchez", "sánchez", "pp", "psoe", "vox", "sumar", "podemos", "junts", "erc", "pnv", "bildu", "amnist",
    "presupuest", "ley", "decreto", "renfe", "aemet", "ue", "otan", "onu",
)
EXCLUDED_TEXT = (
    "opinion", "opinión", "editorial", "tribuna", "deportes", "fútbol", "futbol", "toros", "loter", "horoscopo",
    "horóscopo", "televisión", "television", "gente", "magazine", "eps", "babelia", "viajes", "viajar",
)
SOFT_LIFESTYLE = ("cultura", "familia", "beber", "belleza", "cine", "televisión", "television", "gente")
EXCLUDED_SECTIONS = (
    "opinion", "opinión", "editorial", "tribuna", "deportes", "fútbol", "futbol", "toros", "televisión", "television",
    "gente", "magazine", "eps", "babelia", "viajes", "viajar", "recreo", "moda", "shopping", "compras",
)
EXCLUDED_PATHS = ("/topics/", "/topic/", "/temas/", "/tema/", "/autor/", "/autores/", "/firmas/")
LOCALITY_PATHS = (
    "/andalucia/", "/madrid/", "/cataluna/", "/catalunya/", "/castilla", "/galicia/", "/illes-balears/", "/barcelona/",
    "/sevilla/", "/malaga/", "/valencia/", "/jaen/", "/cordoba/",
)
TOPIC_BUCKETS = {
    "politics": (
        "politica", "política", "gobierno", "congreso", "senado", "tribunal", "fiscal", "amnist", "presupuest", "ley",
        "decreto", "eleccion",
    ),
    "society": (
        "espana", "españa", "nacional", "sociedad", "sanidad", "salud", "vivienda", "educacion", "educación",
        "seguridad", "justicia", "sucesos", "migr",
    ),
    "international": (
        "internacional", "europa", "ue", "otan", "onu", "gaza", "israel", "iran", "irán", "ucrania", "rusia", "francia",
        "alemania",
    ),
    "economy": (
        "economia", "economía", "energia", "energía", "inflacion", "inflación", "empleo", "alquiler", "impuestos",
        "bce", "banco central",
    ),
}
SOURCE_EXCLUDED_TEXT = {
    "abc": ("futbol sala", "mundial de atletismo", "semana santa", "parroquia"),
    "elpais": ("cinco dias", "televisión", "gente", "eps"),
    "elmundo": ("toros", "loc"),
    "20minutos": ("sueldazo", "once", "comprobar", "tiempo hará", "aemet avanza"),
    "eldiario": ("opinion", "opinión", "blogs", "vertele", "consumoclaro"),
    "lavanguardia": ("tribuna", "brújula para un mundo extraño"),
}
SOURCE_EXCLUDED_SECTIONS = {
    "abc": ("recreo", "viajar"),
    "20minutos": ("gonzoo", "capaces", "moda", "aplicaciones", "juegos"),
    "eldiario": ("spin", "the guardian", "la gomera ahora", "vertele", "consumoclaro"),
    "elpais": ("cultura",),
    "lavanguardia": ("opinión", "opinion"),
}
# (source, path term, bonus)
SOURCE_PATH_BONUS = (
    ("eldiario", "/politica/", 1.0),
    ("elpais", "/internacional/", 0.5),
    ("elmundo", "/espana/", 0.5),
)

# --- fixed values: URL discovery --------------------------------------------------------------
NOISE_URL_FRAGMENTS = (
    "/deportes/", "/motor/", "/tiempo/", "/meteorologia/", "/el-tiempo/", "/aemet/", "/loterias/", "/horoscopo/",
    "/shopping/", "/compras/", "/descuentos/", "/branded-content/", "/brandstudio/", "/publi/", "/promociones/",
    "/newsletter/", "/video/",
)
ASSET_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg", ".ico", ".css", ".js", ".json", ".xml", ".pdf", ".mp4", ".mp3",
    ".woff", ".woff2", ".ttf",
)
NATIONAL_URL_SIGNALS = (
    "gobierno", "congreso", "senado", "tribunal", "supremo", "constitucional", "fiscal", "fiscalia", "fiscalía",
    "ministerio", "moncloa", "sánchez", "sanchez", "pp", "psoe", "vox", "sumar", "podemos", "junts", "erc", "pnv",
    "bildu", "amnist", "presupuesto", "presupuest", "ley", "decreto", "policía", "policia", "guardia civil", "aemet",
    "renfe", "onu", "otan", "ue", "bruselas", "irán", "iran", "israel", "gaza", "ucran", "rusia",
)

# --- fixed values: recurring series ------------------------------------------------------------
LOTTERY_GAMES = ("bonoloto", "primitiva", "euromillones", "once")
PROCESSION_DAYS = (
    "domingo de ramos", "lunes santo", "martes santo", "miercoles santo", "jueves santo", "madrugada", "viernes santo",
    "domingo de resurreccion",
)
HOUSING_QUESTION_TERMS = ("alquiler", "casero", "inquilino", "hipoteca", "vivienda", "local")


@dataclass(frozen=True)
class CorpusRules:
    """Vocabulary of the corpus selection cascade."""

    excluded_paths: tuple[str, ...] = EXCLUDED_PATHS
    excluded_sections: tuple[str, ...] = EXCLUDED_SECTIONS
    source_excluded_sections: dict = field(default_factory=lambda: SOURCE_EXCLUDED_SECTIONS)
    excluded_text: tuple[str, ...] = EXCLUDED_TEXT
    source_excluded_text: dict = field(default_factory=lambda: SOURCE_EXCLUDED_TEXT)
    soft_lifestyle: tuple[str, ...] = SOFT_LIFESTYLE
    buckets: dict = field(default_factory=lambda: TOPIC_BUCKETS)
    national_terms: tuple[str, ...] = NATIONAL_TERMS
    locality_paths: tuple[str, ...] = LOCALITY_PATHS
    source_path_bonus: tuple = SOURCE_PATH_BONUS
    timezone: str = "Europe/Madrid"

    def with_(self, **changes) -> CorpusRules:
        return replace(self, **changes)


@dataclass(frozen=True)
class MatchTerms:
    """Vocabulary used when two articles are compared."""

    stopwords: tuple[str, ...] = STOPWORDS
    headline_noise: tuple[str, ...] = HEADLINE_NOISE
    event_terms: tuple[str, ...] = EVENT_TERMS
    followup_markers: tuple[str, ...] = FOLLOWUP_MARKERS


@dataclass(frozen=True)
class EnrichRules:
    """Vocabulary of the enrichment job."""

    article_types: dict = field(default_factory=lambda: ARTICLE_TYPE_RULES)
    section_tags: dict = field(default_factory=lambda: SECTION_TAGS)
    keyword_tags: dict = field(default_factory=lambda: KEYWORD_TAGS)
    entity_terms: dict = field(default_factory=lambda: ENTITY_TERMS)
    person_articles: tuple[str, ...] = PERSON_ARTICLES
    aliases: tuple = ENTITY_ALIASES
