"""Word lists of docstring rules. Results depend on them. Words that are looked up are stems, so plurals are not listed."""

STOP_WORDS = ("a", "an", "the", "to", "for", "of", "in", "into", "from", "with", "and", "or", "is", "are", "this", "that", "each", "every", "when", "if", "by", "on", "at", "as", "be", "it", "all", "any", "not")
GENERIC_VERBS = (
    "attach", "add", "append", "apply", "break", "split", "wrap", "build", "create", "make", "format", "return", "get", "set", "load", "save", "run", "handle",
    "process", "compute", "calculate", "convert", "transform", "generate", "produce", "enrich", "explain", "render", "parse", "extract", "register", "update", "write", "read", "fetch",
)
SURFACE_WORDS = ("inline", "codelens", "codelen", "sized", "lens", "lenses", "line", "lines", "row", "rows", "each", "every", "short", "long", "text", "string", "word", "words", "code")
#: What a word of a name says besides itself.
SYNONYMS = {
    "enrich": ("attach", "add", "append", "inject"), "split": ("break", "wrap", "chunk", "partition"), "attach": ("enrich", "add", "append"), "break": ("split", "wrap", "chunk"),
    "wrap": ("split", "break", "format"), "explain": ("describe", "summarize"), "symbol": ("symbols", "function", "method", "class"), "explanation": ("explanations", "summary", "caption", "context"),
}
#: Words of a docstring that follow from words of the name.
INFERABLE = {"explanation": ("enrich", "explain", "describe", "summarize"), "line": ("split", "wrap", "format", "break"), "codelen": ("split", "wrap", "format", "render"), "field": ("enrich", "build", "make", "append")}
#: Docstrings with one of these are notes for developers.
DEVELOPER_MARKS = ("phase ", "callsite", "call site", "``", "{emoji}", "{risk}", "hybrid (", "structural cue", "heuristic", "ast/fact", "modulefacts", "hunk_details", "hunk ", "ℹ️", "→")
#: Docstrings with one of these, or longer than TELLING_CHARS, say something.
TELLING = r"\b(when|unless|returns?|raises?|never|must|should|only)\b"
TELLING_CHARS, BRIEF_CHARS, OVERLAP = 120, 95, 0.45
#: What a sentence is told without: quotes of code (their text stays), marks of a plan, template slots; characters at its ends; its first word.
NOISE = r"(?i)``([^`]+)``|phase\s+\d+[a-z]?\s*[:—-]?\s*|\{[a-z_]+\}"
EDGES = " :-—"
RETURN_WORDS = ("return", "returns", "returning")
#: Words between which a text names the file it is about.
FILE_WORDS = r"(?i)\s(lives in|in|for)\s$"
