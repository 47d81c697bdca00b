"""The sentences of captions, and what each is chosen by. {x} is filled in."""

# What a name's beginning or end says about a function ({rest}: the other words), and a class's end.
PREFIXES = (
    ("validate_", "checks whether {rest} is valid — callers trust this result."), ("is_valid_", "returns whether {rest} is valid."), ("check_", "verifies {rest} before other code continues."),
    ("authenticate_", "authenticates {rest}."), ("authorize_", "decides whether {rest} is allowed."), ("get_", "reads or returns {rest}."), ("fetch_", "fetches {rest} from somewhere else."),
    ("load_", "loads {rest} into memory or scope."), ("read_", "reads {rest}."), ("set_", "sets or updates {rest}."), ("update_", "updates {rest}."), ("save_", "persists {rest}."), ("write_", "writes {rest}."),
    ("create_", "creates {rest}."), ("add_", "adds {rest}."), ("insert_", "inserts {rest}."), ("register_", "registers {rest} with the runtime or framework."), ("delete_", "deletes {rest}."), ("remove_", "removes {rest}."),
    ("parse_", "parses {rest} from raw input."), ("extract_", "extracts {rest} from surrounding data."), ("render_", "renders {rest} for display or output."), ("build_", "builds {rest} from inputs."),
    ("format_", "formats {rest} for humans or downstream code."), ("make_", "constructs {rest}."), ("enrich_", "adds derived fields (like explanations) to {rest}."), ("explain_", "generates plain-English context for {rest}."),
    ("classify_", "sorts {rest} into risk or impact buckets."), ("score_", "scores {rest} for risk or severity."), ("list_", "lists {rest}."), ("handle_", "handles {rest} events or requests."), ("on_", "runs when {rest} happens."),
    ("run_", "runs {rest} — often a top-level workflow step."), ("trace_", "traces {rest} through the dependency graph."), ("audit_", "audits {rest} for blast-radius impact."),
)
SUFFIXES = (("_handler", "handles {rest} requests or callbacks."), ("_service", "encapsulates {rest} business logic."), ("_client", "talks to an external {rest} API or service."), ("_panel", "renders the {rest} UI panel in the editor."), ("_lenses", "builds CodeLens lines for {rest}."), ("_lens", "builds a CodeLens line for {rest}."))
CLASS_SUFFIXES = (("Provider", "supplies {rest} behavior to the editor (CodeLens, UI hooks, etc.)."), ("Service", "groups {rest} logic that other modules call into."), ("Client", "talks to {rest}."), ("Controller", "coordinates {rest} requests and responses."), ("Router", "maps incoming routes to {rest} handlers."), ("Panel", "is the webview/panel UI for {rest}."))

# What a file's name or folders say. File names, parts of the path, whether the path has to be a dangerous one, sentence.
FILES = (
    (("cli.py", "main.py", "__main__.py"), (), False, "is wired into the CLI — users and scripts invoke it from the terminal."),
    ((), ("/api/", "/routes/", "/routers/"), False, "is part of the HTTP API — requests from outside the repo may hit this code."),
    (("settings.py", "config.py"), (), False, "reads or applies configuration that other modules load at startup."),
    (("models.py", "schema.prisma"), ("/models/",), False, "defines a data shape that other modules read and write."),
    (("__init__.py",), (), False, "controls what this package exports to importers."),
    ((), ("/billing/",), True, "handles billing or payment logic — mistakes here affect money paths."),
    ((), ("auth",), True, "handles authentication — callers trust its result to allow or deny access."),
)
# Where a caller runs, by parts of its path.
CALLERS = ((("/billing/", "charge"), " before charging users"), (("/jobs/", "worker"), " from background jobs"), (("/api/", "/routes/"), " on incoming HTTP requests"), (("/tests/",), " in tests"), (("extension",), " when the extension starts"))
COMMAND_CALLER = ("cli.py", " from CLI commands")
# What an importer does with a module, by its file's name; for tests; otherwise.
IMPORTERS = (("cli.py", " and exposes it through CLI commands"), ("extension.ts", " and wires it when the extension loads"))
TEST_IMPORTER, OTHER_IMPORTER = " for test coverage", " — that's the first place to check if this misbehaves"
PURPOSE = {
    "class": "`{name}` is defined here — other code may instantiate or subclass it.", "private": "`{name}` — on the call path to other modules; check callers before merging.",
    "told": "`{name}` — {text}.", "untold": "`{name}` is defined here.", "other": "`{name}` — other code may call or import this {kind}.", "rule": "`{name}` {text}",
}
IMPACT = {
    "test": "Test-only change.", "one": "{users} {verb}s `{name}`{where}{tests}.", "many": "{users} {verb} `{name}`{tests}.", "tests": " (and {n} test file{s})",
    "inside": "`{name}` is only invoked inside this file; the module is imported by {importers}.", "importer": "`{importer}` imports this file{role}.",
    "unproven": "Module imported by {importers} — no proven direct callers of `{name}` in those files.", "surface": "This file is an API, schema, or config surface — external callers may depend on it.",
    "radius": "Part of a {tier} blast radius — {n} downstream file{s} may be affected.",
}
RISK = {
    "one": "`{user}` — {fails}", "many": "{n} files call it — each breaks if `{name}` misbehaves", "local": "`{caller}` in this file — gets a wrong result", "locals": "{n} callers in this file — get a wrong result",
    "surface": "API, schema, or config surface — external callers may depend on the current shape", "hub": "Shared hub in the import graph — many modules depend on this staying stable",
    "downstream": "Downstream dependents of this seed — a bad change can break code outside this file", "can": "can fail{where}", "breaks": "breaks if `{name}` misbehaves", "line": "{emoji} {tier} — {text}",
}
# A symbol that is only said to be defined in its own file.
DEFINED, SEE = r"` — is defined here\.?$", "` — see implementation."
