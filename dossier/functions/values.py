"""Values that results depend on. Word lists, agent ids and limits are part of the data model."""

# Words that questions are searched without.
STOP_WORDS = ("the", "and", "for", "with", "that", "from", "this", "into", "were", "have", "across", "these", "their", "about")

# Default lexicons of the two signal screens.
INTERACTION_WORDS = ("interaction", "cyp", "inhibitor", "inducer", "coadmin", "exposure")
SAFETY_WORDS = ("adverse", "warning", "contraindication", "toxicity", "safety", "fatigue", "nausea", "dizziness", "rash")

# Ids of the six analyses, in their order.
LITERATURE, INTERACTION, ADVERSE, TRIAL, CONSENSUS, REPORT = AGENTS = (
    "literature-search",
    "drug-interaction",
    "adverse-reaction",
    "trial-summarizer",
    "debate-consensus",
    "report-generation",
)

# Lengths and limits.
CHUNK_CHARS = 1500
PAGE_CHARS = 2600
TOP_CHUNKS = 10
PROMPT_CHUNKS = 6
RECENT_SESSIONS = 20
KEPT_SESSIONS = 25

#: White space as JavaScript's \s has it; Java's and RE2's own class is smaller. Valid in Spark and in DuckDB.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: The same up to U+00FF, and characters beyond: Java looks the former up in one table, the rest class by class.
WS_LATIN, WIDE = r"[\t\n\x0B\f\r \x{00A0}]+", r"[^\x00-\xFF]"
