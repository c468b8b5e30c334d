"""Constants, word lists, patterns and formats that results depend on.

Everything here is a value, not logic. Patterns are Java regular expressions.
"""

# Retrieval settings.
RRF_K = 60
PER_LIST = 50
TOP_N = 30
TOP_K = 5
EMBED_DIM = 1024

# Chunk budget in tokens, and the tokens-per-word factor of the estimate.
MIN_TOKENS = 400
MAX_TOKENS = 800
TOKENS_PER_WORD = 1.35

# Numbering of back matter.
APPENDIX_BASE = 100
GLOSSARY_BASE = 200
SKIP_PATH_SUBSTRINGS = ["/frontmatter/", "/parts/", "backmatter/references", "index.qmd", "socratiq"]

# What the markup reader drops.
DROP_CODE_LANGS = ["python", "r", "tikz", "=html", "=latex"]
DROP_SCOPE_CLASSES = [
    "quiz-end",
    "callout-learning-objectives",
    "callout-research-questions",
    "callout-notebook",
    "callout-quiz",
]
DROP_SCOPE_ATTRS = ['when-format="pdf"']
ATOMIC_KINDS = ["code", "table", "equation", "figure"]

# The sentence that marks an abstaining answer, and where it is looked for.
ABSTAIN_PHRASE = "The book does not appear to cover this"
ABSTAIN_PREFIX = 200

# Histogram bucket edges (seconds, seconds, score).
LATENCY_EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
OVERHEAD_EDGES = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.15, 0.25, 0.5]
SCORE_EDGES = [-10.0, -5.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0]

# Inline markup patterns, in the order they are removed.
P_COMMENT = r"(?s)<!--.*?-->"
P_INDEX = r"\\index\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
P_SHORTCODE = r"\{\{<.*?>\}\}"
P_INLINE_VALUE = r"`\{python\}[^`]*`"
P_FOOTNOTE_REF = r"\[\^[^\]]+\]"
P_CITATION = r"\s?\[-?@[^\]]+\]"
P_SPAN_ATTR = r"\[([^\]]+)\]\{[^}]*\}"
P_BLANKS = r"[ \t]+"

# Line patterns.
P_FENCE = r"^(`{3,}|~{3,})\s*(\{([^}]*)\}|(\S+))?\s*$"
P_SCOPE = r"^(:{3,})\s*(\{(.*)\}|\S+)?\s*$"
P_HEADING = r"^(#{1,6})\s+(.*?)\s*$"
P_TRAILING_ATTRS = r"\s*\{([^{}]*)\}\s*$"
P_TABLE_LINE = r"^\s*\|.*\|\s*$"
P_TABLE_CAPTION = r"^:\s+(.*)$"
P_EQ_ONE_LINE = r"^\$\$(.+)\$\$\s*(\{[^}]*\})?\s*$"
P_IMAGE = r"!\[([^\]]*)\]\([^)]*\)(?:\{([^}]*)\})?"
P_LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+"
P_FOOTNOTE_DEF = r"^\[\^[^\]]+\]:\s*(.*)$"
P_TYPESET = (
    r"(?m)^\s*\\(newpage|noindent|chapterminitoc|clearpage|vspace|mlsysstack|"
    r"begin\{marginfigure\}|end\{marginfigure\}|begin\{figure\*?\}|end\{figure\*?\}|centering)\b.*$"
)
P_ATTR = r"""([\w-]+)=(?:"([^"]*)"|'([^']*)'|(\S+))"""
P_CROSSREF = r"(?<![\w@])@([A-Za-z]+-[\w-]+)"
P_PLACEHOLDER = r"`\{python\}\s*([^`]+)`"
P_CELL = r"(?ms)^```\{python\}[^\n]*\n.*?^```"

# Words and single marks counted by the token estimate, and the sentence cut.
P_WORD = r"[\p{L}\p{N}_]+"
P_NO_WORD = r"[^\p{L}\p{N}_]+"
P_WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
P_SENTENCE_CUT = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""

# Fixed value: Unicode white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Citation markers in an answer, and the first-to-last-brace JSON span of a model reply.
P_CITATION_MARK = r"\[(\d{1,2})\]"
P_JSON_SPAN = r"(?s)\{.*\}"

# Log patterns.
P_LOG_MEMORY = r"(?i)out of memory|CUDA error"
P_LOG_500 = "500 Internal"
LOG_FIRST_MATCH = {
    "weights": r"Model loading took [0-9.]+ GiB",
    "kv": r"Available KV cache memory: [0-9.]+ GiB",
    "kv_tokens": r"GPU KV cache size: [0-9,]+ tokens",
    "max_concurrency": r"Maximum concurrency for [0-9,]+ tokens per request: [0-9.]+x",
}

# Content guard rules.
GUARD_MAX_BYTES = 20 * 1024 * 1024
GUARD_BLOCKED_GLOBS = ["data/*", "data/**", "*.gguf", "*.safetensors", "*.bin", "*.pt", "*.onnx"]
GUARD_SOURCE_SUFFIX = ".qmd"
GUARD_ALLOWED_PREFIX = "ingest/tests/fixtures/"
GUARD_TRIPWIRES = ["\\mlsysstack{", "quiz: ", "concepts: ", "from mlsysim"]

# English stop words of the public Snowball list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed value: suffixes folded away when at least three characters remain.
P_SUFFIX = r"^(.{3,}?)(?:ing|ed|es|ly|s)$"

# Alert rules as (name, series, comparison, threshold, guard series, guard floor, hold seconds).
ALERT_RULES = [
    ("GroundednessBelowThreshold", "nightly_groundedness", "<", 0.8, "judged_answers_7d", 0.0, 600),
    ("RetrievalScoreDrift", "retrieval_score_p50", "<", 0.0, "queries_24h", 20.0, 1800),
    ("P99LatencyAboveSLO", "e2e_p99_seconds", ">", 30.0, None, None, 300),
    ("GatewayErrorRate", "error_ratio", ">", 0.05, None, None, 300),
    ("GPUMemoryNearCeiling", "memory_ratio", ">", 0.97, None, None, 300),
]
