"""Vocabularies, scores, patterns and sentences that results depend on.

These must equal the published format and therefore appear literally.
"""

# Provenance format -------------------------------------------------------------
PROVENANCE_SCHEMA = "kb-prov-v1"
STATUSES = ["current", "historical", "stale", "disputed", "superseded", "open", "unknown"]
CONFIDENCES = ["high", "medium", "low"]
CLAIM_STATUSES = ["current", "historical", "stale", "disputed", "superseded"]
MINIMAL_MIGRATION = "legacy-inferred-minimal"
INFERRED_MIGRATION = "legacy-inferred"
MINIMAL_QUALITY = "minimal-risk-stamp"

# Ranking -----------------------------------------------------------------------
STATUS_SCORES = {
    "current": {"current": 80, "open": 25, "unknown": 20, "historical": 5, "stale": -15,
                "disputed": -25, "superseded": -70},
    "history": {"historical": 70, "superseded": 55, "current": 35, "stale": 25, "disputed": 15,
                "open": 10, "unknown": 0},
    "change": {"current": 65, "historical": 55, "superseded": 45, "stale": 35, "disputed": 25,
               "open": 10, "unknown": 0},
}
CONFIDENCE_SCORES = {"high": 20, "medium": 10, "low": 0}
CHANGE_WORDS = ["change", "changed", "evolved", "transition", "timeline", "over time"]
HISTORY_WORDS = ["original", "historical", "historically", "history", "previous", "previously",
                 "past", "was", "were"]

# Coverage ----------------------------------------------------------------------
COVERAGE_PRIORITY = {"invalid-provenance": 100, "partial-provenance": 80,
                     "block-ids-without-provenance": 70, "minimal-stamp": 45}
KIND_PRIORITY = {"decisions": 50, "problems": 50, "systems": 50, "projects": 50,
                 "concepts": 40, "competition": 40, "people": 30}
OTHER_KIND_PRIORITY = 20

# Drift -------------------------------------------------------------------------
DRIFT_POINTS = {"blocks-without-provenance": 20, "legacy-page-no-block-provenance": 35,
                "newer-related-raw": 60, "unreviewed-related-raw": 40, "disputed-block": 30,
                "stale-block": 25, "superseded-block": 15}

# Topics ------------------------------------------------------------------------
TOPICS = {
    "competition": ("Competitors", "Competing companies, products, and approaches."),
    "concepts": ("Concepts", "Technologies, standards, mental models, and domain vocabulary."),
    "conversations": ("Conversations", "Valuable results of earlier queries and conversations."),
    "decisions": ("Decisions", "Why decisions were taken, on what basis, by whom, and when."),
    "people": ("People", "Colleagues, contacts, external stakeholders, and teams."),
    "problems": ("Problems", "Active and past problems."),
    "projects": ("Projects", "Active and past initiatives."),
    "systems": ("Systems", "Our products, platforms, and services."),
}

# File names and extensions -----------------------------------------------------
SOURCE_EXTENSIONS = [".md", ".pdf", ".doc", ".docx", ".txt", ".vtt", ".eml", ".html"]
LINKABLE_EXTENSIONS = [".md", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".webp"]
RAW_TEXT_EXTENSIONS = [".md", ".txt", ".vtt", ".eml"]
NAVIGATION_NAMES = ["SKILL.md", "index.md", "_index.md", "START_HERE.md"]
EXTERNAL_SCHEMES = ["http://", "https://", "ftp://", "mailto:"]
CURLY = "\u2018\u2019\u201c\u201d"
STRAIGHT = "''\"\""

# Supersession ------------------------------------------------------------------
SUPERSESSION_PHRASES = [
    "superseded by", "replaced by", "succeeded by", "deprecated in favou?r of",
    "retired in favou?r of", "phased out in favou?r of", "decommissioned\\b", "sunset\\b",
    "migrated to", "renamed to",
]
TOPIC_PRIORITY = {"systems": 0, "decisions": 1, "projects": 2, "concepts": 3, "competition": 4,
                  "problems": 5, "people": 6}

# Dates -------------------------------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CONTENT_DATE_FIELDS = ["sent", "published", "when", "date"]
EDIT_DATE_FIELDS = ["last_modified"]
CAPTURE_DATE_FIELDS = ["created_date", "created"]
SYNC_DATE_FIELDS = ["fetched"]
DATE_CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
MANAGED_DATE_KEYS = ["date", "date_span", "date_confidence"]
LEGACY_DATE_KEYS = ["latest_source", "source_span", "source_date_confidence"]

# Sentences of the minimal stamp ------------------------------------------------
STAMP_TEXT = {
    "historical":
        "This page has a minimal provenance stamp only. The listed evidence was used to judge freshness risk, not"
        " to verify every claim. Treat the existing content as a dated historical or source-specific snapshot "
        "until detailed block provenance is added.",
    "source-specific":
        "This page has a minimal provenance stamp only. The listed evidence was used to judge freshness risk, not"
        " to verify every claim. Treat the existing content as source-specific, not as a broad current-state "
        "claim, until detailed block provenance is added.",
    "no-source-claim":
        "This page has a minimal provenance stamp only. The automatic review did not use the related raw hit as "
        "evidence for page claims. Treat the existing content as legacy material until detailed block provenance "
        "is added.",
    "source-mismatch":
        "This page has a minimal provenance stamp only. Automatic review found that the related raw hit may be "
        "tangential or mismatched to the page's main claims. Treat the existing content as unverified until "
        "detailed block provenance is added.",
    "needs-currentness-answer":
        "This page has a minimal provenance stamp only. It contains current or recent claims that need an "
        "authoritative currentness answer before they are used as the main answer to present-state queries.",
    "sensitive-review":
        "This page has a minimal provenance stamp only. It may contain people, customer, commercial, privacy, "
        "security, or operational claims that need manual review before being used as current evidence.",
    "manual-review":
        "This page has a minimal provenance stamp only. It needs manual block-level curation before its detailed "
        "claims should be treated as verified canonical evidence.",
}

# File-name characters with an ASCII spelling -------------------------------------
FILENAME_SPELLING = {
    "‘": "'", "’": "'", "‚": "'", "‹": "<", "›": ">", "′": "'",
    "‵": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"',
    "»": '"', "″": '"', "‶": '"', "–": "-", "—": "-", "―": "-",
    "−": "-", "←": "<-", "→": "->", "↔": "<->", "⇐": "<=",
    "⇒": "=>", "⇔": "<=>", "↖": "^", "↗": "^", "↘": "v", "↙": "v",
    "…": "...", "•": "-", "·": ".", "‣": "-", "\u00a0": " ", "\u202f": " ",
    "\u2009": " ", "\u200b": "", "×": "x", "÷": "-", "⁄": "-",
}
