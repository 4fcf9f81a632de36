"""Fixed values. Results depend on these texts, patterns and limits; they are
stated here once and used by name."""

# --- fixed values: answers -------------------------------------------------
ANSWER_MARKER = "Final Answer"
ANSWER_MARKER_COLON = "Final Answer:"
ANSWER_MARKER_SPACE = "Final Answer: "
BOXED_OPEN = "boxed{"
SEARCH_MARKER = "Search Query:"
CHOICES_A_TO_J = "[A-J]"
CHOICES_LOWER_A_TO_D = "[a-d]"
CHOICES_LOWER_A_TO_G = "[a-g]"
NUMBER_PATTERN = r"(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\.\d+)"
NUMBER_TOLERANCE = 1e-6
EVAL_TYPES = ("multiple_choice", "number")

# --- fixed values: report keywords -----------------------------------------
PASS_WORDS = ("pass", "successful", "correct", "accurate", "helpful")
PATCH_WORDS = ("need_patching", "needs improvement", "not helpful", "insufficient")
ERROR_WORDS = ("error", "failed", "exception", "incorrect", "wrong")
COUNTED_WORDS = ("pass", "error", "helpful", "correct")
HELPFUL_FIELD = "is_library_helpful"
STATUS_PASS = "PASS"
STATUS_PATCH = "NEED_PATCHING"
STATUS_UNKNOWN = "UNKNOWN"
EFFECTIVE_LINE = "EFFECTIVENESS_STATUS: EFFECTIVE"

# --- fixed values: placeholders ---------------------------------------------
UNKNOWN_NAME = "Unknown"
NO_TAG = "No tag provided"
BAD_DESCRIPTION = "Error processing tool description"
NO_DESCRIPTION = "No description available"
LIST_NAME = "unknown"
LIST_DESCRIPTION = "No description"
LIST_WITHOUT_INFO = "unknown_tool"
LIST_NO_TAG = "No tag"
EMPTY_CLUSTER = "No tools found in this cluster."
NOT_ASSIGNED = "Tool was not assigned by the API."
GENERATED_NAME = "generated_function"
GENERATED_SUMMARY = "Generated function from comment"
AUTO_DESCRIPTION = "Auto-generated tool function"
FUTURE_IMPORT = "from __future__ import annotations\n\n"

# --- fixed values: limits ----------------------------------------------------
CLUSTER_MIN = 50
CLUSTER_MAX = 300
REQUEST_BATCH = 20
EMBEDDING_BATCH = 500
FALLBACK_DIMENSION = 1024
NAME_LENGTH = 64
SCHEMA_MAX_DEPTH = 10
SCHEMA_MAX_PROPERTIES = 5000
SCHEMA_MAX_TEXT = 120000
SCHEMA_MAX_ENUM = 1000
SCHEMA_ENUM_COUNT = 250
SCHEMA_ENUM_TEXT = 15000
INVALID_TOP_KEYWORDS = ("oneOf", "anyOf", "allOf", "enum", "not")
REQUIRED_FUNCTION_FIELDS = ("name", "description", "parameters")
VALUE_FIELDS = ("default", "minimum", "maximum")

# --- fixed values: usage and loss --------------------------------------------
MODIFY_RATIO = 0.9
LOSS_BETA = 1.25
LOSS_TARGET_TOOLS = 10
LOSS_ACCURACY_WEIGHT = 15
SMALL_CLUSTER = 35
SAMPLE_SIZE = 50
WRONG_EXAMPLES = 10
UNSOLVED_SAMPLE = 30
TOKENS_PER_WORD = 1.3
PRICE_PER_MILLION = {"o3": (2.00, 8.00)}

# --- fixed values: declared types ---------------------------------------------
TYPE_NAMES = {
    "str": "string",
    "string": "string",
    "int": "integer",
    "integer": "integer",
    "float": "number",
    "number": "number",
    "double": "number",
    "bool": "boolean",
    "boolean": "boolean",
}

# --- fixed values: patterns ---------------------------------------------------
SIGNATURE_PATTERN = r"(?s)def\s+([a-zA-Z_]\w*)\s*\((.*?)\)(?:\s*->\s*[^:]+)?\s*:"
TYPED_PARAMETER = r"^([a-zA-Z_]\w*)\s*:\s*([^=]+?)(?:\s*=\s*(.+))?$"
DEFAULTED_PARAMETER = r"^([a-zA-Z_]\w*)\s*=\s*(.+)$"
DOC_ARGS_LINE = r"^\s*Args\s*:\s*$"
DOC_SECTION_LINE = r"^\s*(Returns?|Raises|Examples?|Notes?|See Also|References?)\s*:\s*$"
DOC_PARAM_LINE = r"^\s*-?\s*([a-zA-Z_]\w*)\s*(?:\(([^)]+)\))?\s*:\s*(.*)$"
FUTURE_LINE = r"^\s*from\s+__future__\s+import\s+.+"
IMPORT_LINE = r"^\s*(?:import\s+\S+|from\s+\S+\s+import\s+.+)"
LIBRARY_FILES = "*_final_openai_tools.json"
BLUEPRINT_FILE = "blueprint_sibs.json"

# --- fixed values: transcript marks ---------------------------------------------
USER_LINE = "**User:** "
ASSISTANT_LINE = "**Assistant:** "
CALL_LINE = "  🔧 Called tool: "
RESULT_LINE = "  📋 Tool result: "
ROLE_ICONS = {"user": "👤", "assistant": "🤖", "tool": "🔧"}
OTHER_ICON = "❓"
RULE = "=" * 60
CALLS_HEADING = "\n🔧 TOOL CALLS:"

# --- fixed values: characters stripped as white space -------------------------
BLANK = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
