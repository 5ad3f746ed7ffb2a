"""Fixed values.

Everything here is data whose exact value decides the results: word lists,
labels, limits, page texts and markup patterns.  Nothing here is logic.
"""

# --- fixed values: search -------------------------------------------------

STOP_WORDS = [
    "de", "la", "el", "en", "y", "a", "los", "las", "un", "una",
    "con", "por", "para", "o", "del", "al", "que", "se", "su", "sus",
    "lo", "como", "más", "pero", "este", "esta", "estos", "estas",
]

WORD_WEIGHT = 10
PHRASE_WEIGHT = 1000
WORD_COUNT_CAP = 5
MATCHED_WORD_BONUS = 10_000
PHRASE_BONUS = 50_000

DEFAULT_LIMIT = 10
MAX_LIMIT = 100
DEFAULT_PAGE_SIZE = 5
MAX_PAGE_SIZE = 20

# --- fixed values: documents and fragments --------------------------------

SUPPORTED_SUFFIXES = [".pdf", ".doc", ".docx"]
DEFAULT_TITLE = "Documento"
DEFAULT_SECTION = "Inicio"
MAX_FRAGMENT_CHARS = 2000

PAGE_HEADER_PREFIX = "\n\n## Página "
PAGE_HEADER_SUFFIX = "\n\n"
BLANK_PAGE_TEXT = "*[Página sin texto legible extraíble]*\n"

CATEGORY_ORDINANCE = "Ordenanzas"
CATEGORY_COUNCIL = "Resoluciones de Concejo"
CATEGORY_MAYOR = "Resoluciones de Alcaldía"
CATEGORIES = [CATEGORY_ORDINANCE, CATEGORY_MAYOR, CATEGORY_COUNCIL]

STATUS_SCANNED = "PDF Original"
STATUS_PENDING = "Pendiente"
STATUS_READY = "Markdown"

# --- fixed values: extraction choice --------------------------------------

IMAGE_MARKERS = ["intentionally omitted", "picture", "==>", "<=="]
DRAWINGS_LIMIT = 150
DRAWINGS_PAGES = 10
MIN_STRUCTURED_CHARS = 150
MIN_FALLBACK_CHARS = 300

# --- fixed values: noise rule ---------------------------------------------

NOISE_RUN = r"[-_=|]{4,}"
WORD_RUN = "[a-zA-ZáéíóúÁÉÍÓÚñÑ]{2,}"
NOISE_MIN_CHARS = 50
NOISE_MAX_SHARE = 0.20
NOISE_MIN_WORDS = 15
NOISE_WORDS_FROM_CHARS = 80

# --- fixed values: file names and planning --------------------------------

DUPLICATE_SUFFIXES = ["pdf", "docx", "doc", "md", "json"]
PENALTY_DOUBLE_SUFFIX = 20
PENALTY_INNER_SUFFIX = 10
PENALTY_UPPER_SUFFIX = 2
COMPRESS_OVER_BYTES = 2 * 1024 * 1024
SOURCE_PREFIXES = ["RES", "ORD"]

# --- fixed values: result presentation ------------------------------------

SNIPPET_CHARS = 300
PREVIEW_CHARS = 140

# --- fixed values: white space --------------------------------------------
# Characters that count as white space, and those among them that end a line.

LINE_BREAK_CHARS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
INLINE_SPACE_CHARS = (
    "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)
SPACE_CHARS = LINE_BREAK_CHARS + INLINE_SPACE_CHARS
