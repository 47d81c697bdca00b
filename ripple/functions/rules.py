"""Rule tables. Names, fragments and patterns that results depend on."""

DANGER_FRAGMENTS = ("/api/", "/routes/", "/routers/", "/migrations/", "/models/")
DANGER_NAMES = ("models.py", "schema.prisma", "settings.py", "config.py")
FAN_OUT = 3

DIAGRAM_FRAGMENTS = ("/migrations/", "/routes/", "/api/", "/routers/", "/models/", "/utils/", "/lib/", "/common/")
DIAGRAM_NAMES = (
    "models.py", "schema.prisma", "settings.py", "config.py", "pyproject.toml", "requirements.txt", "poetry.lock", "package.json",
    "package-lock.json", "pnpm-lock.yaml", "docker-compose.yml", "Dockerfile", ".env.example",
)
PASS_SUFFIXES = (".md", ".markdown", ".rst", ".txt", ".css", ".scss", ".sass")
PASS_PREFIXES = ("docs/", ".github/")
SHARED_FRAGMENTS = ("/utils/", "/lib/", "/common/")
TINY_LINES, TINY_FILES = 5, 2

PYTHON_SUFFIXES = (".py",)
SCRIPT_SUFFIXES = (".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx")
SOURCE_SUFFIXES = PYTHON_SUFFIXES + SCRIPT_SUFFIXES

BUILTINS = (
    "isinstance", "len", "str", "int", "bool", "list", "dict", "set", "tuple", "range", "sorted", "max", "min", "any", "all", "super", "print",
    "type", "getattr", "setattr", "hasattr", "return", "yield", "raise",
)
PLUMBING = (
    "rsplit", "split", "join", "strip", "lstrip", "rstrip", "replace", "format", "encode", "decode", "lower", "upper", "title", "startswith", "endswith",
    "append", "extend", "insert", "pop", "get", "items", "keys", "values", "copy", "update", "sort", "add", "remove", "discard", "clear",
    "read", "write", "readline", "readlines", "seek", "tell", "close", "sub", "subn", "search", "match", "findall", "fullmatch",
)
PURPOSE_UTILITIES = ("Path", "format", "join", "strip", "lower")
FAMILIES = (("class", "as a class"), ("function", "as a function"))
WEAK_RETURNS = ("None", "True", "False", "Ellipsis", "...", "NotImplemented", "[]", "{}", "()", "''", '""')
ACRONYMS = (("AST", "Abstract Syntax Tree"), ("BFS", "breadth-first search"), ("DFS", "depth-first search"), ("HUD", "heads-up display"), ("CLI", "command-line interface"))
WEAK_PURPOSES = ("other code may call", "on the call path to other modules", "see implementation", "is defined here", "automated test that", "instantiate or subclass", "client for talking to", "is a client for talking")
WEAK_CAPTIONS = (
    "other code may call", "on the call path to other modules", "see implementation", "is defined here", "changes what this function returns", "returns `none`",
    "returns none.", "automated test that", "instantiate or subclass", "client for talking to",
)
REPORT_ONLY_IMPACTS = ("module imported by", "imports this file", "only invoked inside this file", "no proven direct callers")

EVIDENCE_RANKS = {"diff_overlap": 0, "symbol_registry": 1, "docstring": 1, "call_site": 2, "danger_path": 3, "shared_hub": 3, "graph_importer": 8, "heuristic_path": 6, "heuristic_name": 6}
EVIDENCE_DEFAULT, EVIDENCE_HEURISTIC = 5, 10

SECRETS = (
    r"""(?i)(api[_-]?key|secret|token|password|passwd|authorization)\s*[:=]\s*['"][^'"]{8,}""",
    r"(?i)bearer\s+[a-z0-9\-._~+/]+=*",
    r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)sk-[a-z0-9]{20,}",
)
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAMEL = r"\b[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b"
HOPS = r"(?i)\b\d+\s*hops?\b"
RISK_WORDS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SCOPE = r"(?i)\b(callers?|downstream|upstream|dependents?|depends?|imports?\s+from|affects?|impacts?)\b"
THIN_EDIT = r"(?i)^(updates?|changes?|modifies?|edits?|adjusts?)\s+(`[^`]+`|[A-Za-z_][\w.]*)(?:\s+here)?\.?$"
CHATTY = r"(?i)^(this (change|edit|function|update|code)|the function|in this|the following|note that|here,?|as a result)\b"
SENTENCE_END = r"[.!?](?:\s+|$)"
CONSEQUENCE = r"(?i)\b(so that|so we|so reviewers?|reuse|skips?|avoids?|breaks?|callers?|readers?|meaning|when|fingerprint|cache hit|look\s*up|misleads?|fails?|depends?)\b"
LABEL_CHARS, LABEL_SENTENCES = 320, 2
PACK_LINES, PACK_CHARS = 20, 1500
EXPLANATION_CHARS, SUMMARY_CHARS, IMPLICATION_CHARS, INLINE_EVIDENCE = 260, 110, 110, 2
DIAGRAM_NODES, REPORT_SYMBOLS, REPORT_BULLETS, BULLET_CHARS = 15, 8, 8, 110
NAMED_IMPORTERS, CALL_PROOFS, IMPORTER_LIMIT = 3, 2, 8
