"""Fixed values. They decide results, so they are stated plainly and in one place."""

# --- fixed values: words never taken for a column name --------------------------------------
SQL_KEYWORDS = (
    "all", "and", "as", "asc", "by", "case", "cast", "desc", "distinct", "else", "end", "false", "from",
    "group", "having", "in", "is", "join", "limit", "not", "null", "on", "or", "order", "over", "partition",
    "select", "then", "true", "union", "when", "where",
)
NOT_A_SOURCE = ("select", "unnest")
MUTATING_WORDS = (
    "alter", "attach", "call", "copy", "create", "delete", "detach", "drop", "export", "import", "insert",
    "install", "load", "pragma", "replace", "set", "truncate", "update", "vacuum",
)

# --- fixed values: revisions --------------------------------------------
FILE_STATUSES = ("added", "modified", "removed", "renamed")

# --- fixed values: replay limits (off unless asked for) --------------------------------------
MAX_RESULT_ROWS = 100_000
MAX_RESULT_COLUMNS = 100
MAX_CELL_BYTES = 1_000_000
MAX_TABLES = 8
MAX_INPUT_ROWS = 10_000
MAX_INPUT_COLUMNS = 100

# --- fixed values: identity scores -----------------------------------------------------------
SCORE_URN = 10_000
SCORE_QUALIFIED = 2_000
SCORE_LEAF = 1_500
SCORE_SUFFIX = 1_000
SCORE_PLATFORM = 500
SCORE_CONTAINS = 100
SCORE_COLUMN = 25
SCORE_ACCEPTED = 100

# --- fixed values: severity ------------------------------------------------------------------
SEVERITY_LEVELS = ("none", "low", "medium", "high", "critical")
PRODUCTION_CRITICAL_TYPES = ("mlmodel", "ml_model", "feature_table")
CRITICAL_TIERS = ("tier_1", "critical")
HIGH_TYPES = ("dashboard", "chart", "data_product", "mlmodel", "ml_model")
CRITICAL_MAGNITUDE = 25.0
HIGH_MAGNITUDE = 10.0

# --- fixed values: reports -------------------------------------------------------------------
SUMMARY_BLOCKED = "Merge blocked: {severity} data change risk"
SUMMARY_PASSED = "Shadow analysis passed"
SUMMARY_INCONCLUSIVE = "Shadow analysis inconclusive: required evidence is missing"
TITLE_BLOCKED = "Unsafe data change blocked"
TITLE_INCONCLUSIVE = "Data change analysis is inconclusive"
TITLE_PASSED = "Data change is safe to merge"
REASON_NONE = "No breaking downstream impact detected"
REASON_EXECUTION_FAILED = "Counterfactual execution failed"
REASON_EXECUTION_REQUIRED = "Execution evidence is required for affected assets"
REASON_REPLAY_MISSING = "Required counterfactual replay was not run"
NO_COLUMN_REFERENCED = "No changed column is referenced"
GATE_CODES = {"success": 0, "failure": 1, "neutral": 2}

# --- fixed values: check text as written by the report and read by the extraction ------------
CHECK_RISK = "Risk: "
CHECK_ASSETS = "Affected assets: "
CHECK_ROUTE = "Route to: "

# --- fixed values: patterns ------------------------------------------------------------------
# White space as the text rules understand it: ASCII, the Unicode space separators and the BOM.
SPACE_CHARS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE_CHARS}]"
# The same set as plain characters, for trimming.
SPACES = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# A line ends at \n, \r, \u2028 or \u2029; a dot stops at \u0085, too, where the comment goes on.
LINE_COMMENT = r"--.*+(?:\u0085.*+)*+"
BLOCK_COMMENT = r"(?s:/\*.*?\*/)"
STRING_LITERAL = r"'[^']*'"
# Word edges are ASCII on both sides, whatever the Java version makes of \b.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"
IDENTIFIER = WORD_START + r"[a-zA-Z_](?:[\w$]*\w)?" + WORD_END
QUOTED_NAME = r"[`\"\[]?[\w$]+[`\"\]]?"
QUOTED_TABLE = r"[`\"\[]?[\w.-]+[`\"\]]?"
QUOTE_EDGES = r"^[`\"\[]|[`\"\]]\z"
ANALYZABLE_FILE = r"(?i)\.(?:sql|ddl)\z"
# An object id inside a longer name; ids follow each other between other characters.
OBJECT_ID = r"(?<![0-9a-f])([0-9a-f]{40}(?:[0-9a-f]{24})?)(?![0-9a-f])"
FULL_SHA = r"(?i)\A[0-9a-f]{40}(?:[0-9a-f]{24})?\z"
REPOSITORY = r"(?i)\A[a-z0-9_.-]+/[a-z0-9_.-]+\z"
CATALOG_URN = r"\Aurn:li:[a-zA-Z][a-zA-Z0-9_-]*:[^\s\u0000-\u001f\u007f]+\z"
INCOMPLETE_WARNING = r"(?i)(?<!\w)(?:limit|truncat|timeout|timed out|incomplete)(?!\w)"
INCOMPLETE_WARNING_WIDE = r"(?i)(?<!\w)(?:limit|truncat\w*|timeout|timed out|incomplete)(?!\w)"
CONTROL_CHARS = r"[\u0000-\u001f\u007f]"
CODE_FENCE = r"```[\s\S]*?```"
SCRIPT_BLOCK = r"(?i)<script(?!\w)[^>]*>[\s\S]*?</script>"
INSTRUCTION_PHRASE = (
    r"(?i)(?<!\w)(?:ignore (?:all |any )?(?:previous|prior) instructions|system prompt|you are chatgpt)(?!\w)"
)
REDACTED_CODE = "[redacted code]"
REDACTED_INSTRUCTION = "[redacted instruction]"
