"""Golden repositories: known edges, rings, branches of the audit, captions; on temporary folders and git repositories."""

import subprocess

import pytest
from pyspark.sql import functions as F

from ripple.functions.expressions import Piece, shown
from ripple.operators import graph, resolve
from ripple.plans import blocks, labels, report
from ripple.plans.engine import Engine, Tables
from ripple.sources import config, facts, git

FILES = {
    "auth_utils.py": '"""Shared checks."""\n\nLIMIT = 3\n\n\ndef validate_token(token):\n    """Decide whether a caller may go on, by looking at its token."""\n    return bool(token)\n\n\ndef hash_password(text):\n    return text[::-1]\n',
    "billing/service.py": "# charges\n\nfrom auth_utils import validate_token\n\n\ndef charge_user(user):\n\n    if not validate_token(user):\n        raise PermissionError(user)\n    return user\n",
    "api/routes.py": "# routes\n\nfrom billing.service import charge_user\n\n\nclass _Router:\n\n    def post(self):\n        return self\n\n\nrouter = _Router()\n\n\ndef charge(x):\n    return charge_user(x)\n",
    "dashboard/views.py": "# views\n\nfrom auth_utils import validate_token\n\n\ndef render_banner(s):\n    return validate_token(s)\n",
    "jobs/worker.py": "# jobs\n\nfrom auth_utils import validate_token\n\n\ndef refresh(s):\n    validate_token(s)\n",
}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def sh(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    write(tmp_path, FILES)
    sh(tmp_path, "init", "-b", "main")
    sh(tmp_path, "add", "-A")
    sh(tmp_path, "commit", "-m", "first")
    return tmp_path


def engine_of(spark, files):
    rows = [("r", p, bytearray(t.encode())) for p, t in files.items()]
    return Engine(spark, Tables.of(facts.from_contents(spark.createDataFrame(rows, "repo string, path string, content binary"))))


@pytest.fixture(scope="module")
def golden(spark):
    return engine_of(spark, FILES)


def audit(spark, root):
    changed = git.read(spark, str(root), "changed").select(F.lit("r").alias("repo"), "path").distinct()
    spans = git.read(spark, str(root), "spans").withColumn("repo", F.lit("r"))
    return Engine.from_folder(spark, str(root), git=True).audit(changed, spans)


def test_edges_and_proofs(golden):
    rows = {(r["src"], r["dst"]): [tuple(x) for x in r["imports"]] for r in golden.t.edges.collect()}
    assert rows == {("billing/service.py", "auth_utils.py"): [(3, "auth_utils")], ("dashboard/views.py", "auth_utils.py"): [(3, "auth_utils")], ("jobs/worker.py", "auth_utils.py"): [(3, "auth_utils")], ("api/routes.py", "billing/service.py"): [(3, "billing.service")]}


def test_trace(golden):
    got = golden.trace("auth_utils.py")
    assert got["risk_tier"] == "CRITICAL" and "4 downstream files" in got["summary"] and "up to 2 hops" in got["summary"]
    assert [n["path"] for n in got["danger_zones"]] == ["api/routes.py"]
    assert [n["path"] for n in got["downstream"]] == ["billing/service.py", "dashboard/views.py", "jobs/worker.py"]
    assert "n_auth_utils_py --> n_billing_service_py" in got["mermaid"]
    assert golden.trace("api/routes.py")["mode"] == "pass_through"
    with pytest.raises(ValueError):
        golden.trace("missing.py")
    assert "## Change impact" in report.markdown(got) and report.to_json(got).startswith("{")


def test_scan(golden):
    rows = {r["path"]: (r["n_imports"], r["n_defs"], r["n_calls"]) for r in golden.scan().collect()}
    assert rows["billing/service.py"] == (1, 1, 2) and rows["jobs/worker.py"] == (1, 1, 1) and rows[None][0] == 4


def test_script_resolution(spark):
    files = {"a/index.ts": "export function f() {}", "a/b.ts": "import { f } from './index'; import x from '../a'; import p from 'react';", "a.js": "import './a/b.js'"}
    edges = engine_of(spark, files).t.edges.select("src", "dst").collect()
    assert {tuple(e) for e in edges} == {("a/b.ts", "a/index.ts")} or {tuple(e) for e in edges} == {("a/b.ts", "a/index.ts"), ("a/b.ts", "a.js")}


def test_python_resolution(spark):
    files = {"src/pkg/__init__.py": "", "src/pkg/mod.py": "from . import other\nfrom .other import x\nfrom .... import no", "src/pkg/other.py": "x = 1", "main.py": "import pkg.mod\nimport pkg.mod\nimport json"}
    rows = {(r["src"], r["dst"]): len(r["imports"]) for r in engine_of(spark, files).t.edges.collect()}
    assert rows[("src/pkg/mod.py", "src/pkg/other.py")] == 2 and rows[("main.py", "src/pkg/mod.py")] == 2 and ("src/pkg/mod.py", "src/pkg/__init__.py") in rows


def test_normalized(spark):
    got = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",)], "p string").select(resolve.normalized("p")).collect()
    assert [r[0] for r in got] == ["a/c", None, ""]


def test_rings_on_cycle_and_empty(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "a", "a")], "repo string, src string, dst string")
    seeds = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert {(r["path"], r["hops"]) for r in graph.rings(edges, seeds).collect()} == {("c", 1), ("b", 2)}
    assert graph.rings(edges, seeds.where("false")).count() == 0 and graph.rings(edges.where("false"), seeds).count() == 0


def test_audit_branches(spark, repo):
    assert audit(spark, repo)["seed"] == "(none)"
    write(repo, {"notes.md": "x"})
    assert audit(spark, repo)["seed"] == "(non-source)"
    write(repo, {"jobs/worker.py": FILES["jobs/worker.py"].replace("# jobs", "# job queue")})
    assert "comments" in audit(spark, repo)["summary"]
    write(repo, {"jobs/worker.py": FILES["jobs/worker.py"].replace("validate_token(s)\n", "return validate_token(s)\n", 1)})
    got = audit(spark, repo)
    assert got["mode"] == "pass_through" and got["isolated"] == ["jobs/worker.py"]


def test_audit_full(spark, repo):
    write(repo, {"auth_utils.py": FILES["auth_utils.py"].replace("return bool(token)", "return token is not None")})
    got = audit(spark, repo)
    assert got["mode"] == "full" and got["risk_tier"] == "CRITICAL"
    assert [n["path"] for n in got["danger_zones"]] == ["auth_utils.py", "api/routes.py"]
    (symbol,) = got["changed_symbols"]
    assert symbol["name"] == "validate_token" and symbol["detail"] == "Returns `token is not None`." and symbol["implication"].startswith("🔴 CRITICAL — ")


def test_audit_unused_helper(spark, repo):
    """No importer uses the changed function, so nothing is downstream."""
    write(repo, {"auth_utils.py": FILES["auth_utils.py"].replace("text[::-1]", "text[::-2]")})
    got = audit(spark, repo)
    assert not got["downstream"]


def test_explain_and_orphans(spark, repo):
    write(repo, {"auth_utils.py": FILES["auth_utils.py"].replace("LIMIT = 3", "LIMIT = 4").replace("return bool(token)", "return 2")})
    changed = git.read(spark, str(repo), "changed").select(F.lit("r").alias("repo"), "path").distinct()
    spans = git.read(spark, str(repo), "spans").withColumn("repo", F.lit("r"))
    e = Engine.from_folder(spark, str(repo), git=True)
    (one,) = e.explain(changed, spans, symbol="validate_token")
    assert one["detail"] == "Returns `2`." and any(x["kind"] == "call" for c in one["clauses"] for x in c["evidence"])
    assert "validate_token" in report.explanations([one], True) and e.explain(changed, spans, symbol="nope") == []
    (line,) = e.audit(changed, spans)["line_explanations"]
    assert line["line"] == 3 and line["detail"] == "Sets `LIMIT` to `4`."


def test_cache(spark, tmp_path):
    files = facts.from_contents(spark.createDataFrame([("r", "a.py", bytearray(b"import os")), ("r", "b.py", bytearray(b"import os")), ("r", "c.ts", bytearray(b"")), ("r", "d.py", bytearray(b"def (")) ], "repo string, path string, content binary"))
    first = facts.facts_of(files, str(tmp_path / "c")).orderBy("path").collect()
    again = facts.facts_of(files, str(tmp_path / "c")).orderBy("path").collect()
    assert first == again and [len(r["imports"]) for r in first] == [1, 1, 0, 0] and [r["parse_ok"] for r in first] == [True, True, True, False]
    assert spark.read.parquet(str(tmp_path / "c" / f"v{facts.VERSION}")).count() == 2


@pytest.mark.parametrize(
    "text,expected",
    [
        (["    return 2"], "Returns `2`."), (["    return None"], ""), (["    return ("], ""), (["", "", "", "", ""], "Added 5 blank lines."), (["import os"], "Adds import for `os`."), (["from a.b import c", "import d"], "Adds imports for `a.b` and 1 more."),
        (["total = 0"], "Sets `total` to `0`."), (["import { x } from './m'"], "Adds import for `./m`."), (["    rows.append(x)"], "Adds a new item to `rows`."), (["    do_it(x)"], "Calls `do_it(…)` here."), (["    x.strip()"], ""),
    ],
)
def test_ladder(text, expected):
    assert blocks.caption(blocks.Block(text)) == expected


@pytest.mark.parametrize(
    "expr,fit",
    [
        ("a + b", True), ("a +", False), ("f(x", False), ("f(x))", False), ("x and", False), ("", False), ("(", False), ("...", False), ("f(g(x))", False), ("[x for x in y]", True),
        ("[name for name in names if name]", False), ("f'" + "x" * 50 + "'", True), ("'" + "x" * 50 + "'", False), ("a[0]['k']", True), ("f('(')", True), ("user!", True),
    ],
)
def test_shown(expr, fit):
    assert shown(expr) == fit


def test_pieces():
    assert Piece("from . import x").imported() == "." and Piece("import a.b as c, d").imported() == "a.b" and Piece("from x").imported() is None
    assert Piece("import * as m from \"./m\";").imported() == "./m" and Piece("x = 1").imported() is None
    assert Piece("a == b").assigned() is None and Piece("a = b == c;").assigned() == ("a", "b == c") and Piece("a.b = c").assigned() is None
    assert Piece("self.rows.append(f(x))").calls() == [("rows", "append"), ("", "f")] and Piece("g()(1).h()").calls() == [("", "g"), (".", "h")]
    head = "async def f(\n    a,  # one\n    b=':',\n) -> int:\n    \"\"\"Text.\"\"\""
    assert Piece(head).header_of("f") and Piece("def f(a,").header_of("f") and not Piece("def f(): return 1").header_of("f") and not Piece("@x\ndef f():").header_of("f")
    assert blocks.caption(blocks.Block(["    return (", "        a", "        + b", "    )"])) == "Returns `( a + b )`." and blocks.caption(blocks.Block(["def f(a, b=2):"], name="f")) == blocks.SIGNATURE
    assert blocks.caption(blocks.Block(["if isinstance(node, ast.ClassDef):"])) == "Records this definition as a class."


def test_shown_column(spark):
    from ripple.functions import predicates

    df = spark.createDataFrame([("a + b",), ("a +",), (None,), ("f(]",)], "e string")
    assert [tuple(r) for r in df.select(predicates.expression_worth_showing("e"), predicates.brackets_balanced("e")).collect()] == [(True, True), (False, True), (None, None), (False, False)]


def test_clip():
    assert blocks.clip("a  b\nc", 10) == "a b c" and blocks.clip("alpha beta gamma delta", 16) == "alpha beta…" and blocks.clip("x" * 20, 10) == "x" * 9 + "…"
    assert blocks.clip("aaaaaaaa(bbbbbbbbbb", 14) == "aaaaaaaa(…" and Piece("f([{}])").closed and not Piece("f(]").closed and not Piece("(").closed and Piece("f('(')").closed


def test_clip_column(spark):
    from ripple.functions import scalars

    texts = ["a  b\nc", "alpha beta gamma delta", "x" * 20, "aaaaaaaa(bbbbbbbbbb", "one, two,three four", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.clip("t", 14), scalars.clip("t", 9)).collect()
    assert [tuple(r) for r in df] == [(blocks.clip(t, 14), blocks.clip(t, 9)) for t in texts]


def test_collapse():
    b = lambda line, detail, doc=False, n=1: {"line": line, "lines": list(range(line, line + n)), "detail": detail, "docstring": doc}
    assert [x["detail"] for x in blocks.collapse([b(2, "Added a blank line."), b(5, "Sets `a` to `1`."), b(9, "Returns `9`.")], 1)] == ["Returns `9`."]
    assert [x["detail"] for x in blocks.collapse([b(1, "Changes this function's parameters or defaults."), b(5, "Sets `a` to `1`.")], 1)] == ["Changes this function's parameters or defaults.", "Sets `a` to `1`."]
    assert len(blocks.collapse([b(2, "Calls `f(…)` here."), b(8, "Calls `f(…)` here.")], 1)) == 1


def test_labels(spark):
    pack = {"path": "a.py", "name": "save", "kind": "function", "risk_tier": "HIGH", "who": "api", "what": "fails", "edit_lines": [{"line": 1, "text": "cache.put(key, value)"}], "caption": "Calls `put(…)` here.", "purpose": "", "readers": [], "importers": []}
    assert labels.validate("Stores the value so that `cache` can reuse it.", pack)
    assert labels.validate("Affects 3 hops of code.", pack) is None and labels.validate("This change is good.", pack) is None
    assert labels.validate("This is LOW risk.", pack) is None and labels.validate("Below the allowed limit it is kept.", pack)
    assert labels.validate("Calls `unknown_thing` twice.", pack) is None and labels.polish("Calls put here", pack) is None and labels.polish("Updates hash here.", pack) is None

    class Client:
        def label(self, p):
            return "Stores the value so that `cache` can reuse it."

    assert labels.label_one(pack, Client()) and labels.label_one(pack | {"edit_lines": [{"line": 1, "text": "password = 'hunter2hunter2'"}]}, Client()) is None
    df = spark.createDataFrame([(1, pack), (2, pack), (3, pack | {"path": "tests/test_a.py"})], f"k int, pack {labels.PACK}")
    got = {r["k"]: r["label"] for r in labels.label_table(df, Client).collect()}
    assert got[1] == got[2] is not None and got[3] is None
    c = labels.Cache(2)
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"


def test_config(tmp_path):
    (tmp_path / config.NAME).write_text("[ripple]\nfan_out_threshold = 5\nother = 1\n[ripple.llm]\ncaptions = 'yes'\n")
    assert config.load(tmp_path) == config.Config(5, True) and config.load(tmp_path / "none") == config.Config()
    on = config.LabelSettings(api_key="k")
    assert config.use_labels(True, False, config.Config(), on) and not config.use_labels(True, True, config.Config(), on) and not config.use_labels(True, False, config.Config(), config.LabelSettings())


def test_comment_upsert():
    class Fake:
        rows = []

        def list(self):
            return self.rows

        def create(self, body):
            self.rows.append({"id": 1, "body": body})

        def update(self, k, body):
            self.rows[0]["body"] = body

    assert report.upsert_comment(Fake(), "x") == "created" and report.upsert_comment(Fake(), "y") == "updated" and len(Fake.rows) == 1


def test_git_listing(repo):
    write(repo, {".gitignore": "skip.py\n", "skip.py": "", "new.py": "", "naïve.py": "x = 1\n"})
    assert "skip.py" not in git.list_sources(str(repo)) and "naïve.py" in git.list_sources(str(repo))
    assert ("naïve.py", "untracked") in git.changed_files(str(repo)) and ("naïve.py", 1, 1) in git.line_spans(str(repo))
    sh(repo, "checkout", "-b", "work")
    sh(repo, "add", "new.py")
    sh(repo, "commit", "-m", "new")
    assert git.changed_files(str(repo), mode="range") == [("new.py", "range")]
    with pytest.raises(git.GitError):
        git.changed_files("/")


def test_stream(spark, tmp_path):
    from ripple.streaming import overlays

    src, state = tmp_path / "in", str(tmp_path / "state")
    seen = []
    for k, rows in enumerate([[("r", "a", "1", 1), ("r", "b", "x", 1)], [("r", "a", "2", 2), ("r", "a", "old", 0)]]):
        spark.createDataFrame(rows, overlays.SCHEMA).coalesce(1).write.mode("append").json(str(src))
        q = overlays.start(spark.readStream.schema(overlays.SCHEMA).json(str(src)), state, str(tmp_path / "cp"), lambda df, k: seen.append(k), available_now=True)
        q.awaitTermination()
    assert {(r["path"], r["text"]) for r in overlays.newest(spark, state).collect()} == {("a", "2"), ("b", "x")} and seen == [0, 1]
    overlays.apply_batch(spark.createDataFrame([("r", "a", "9", 9)], overlays.SCHEMA), 1, state)
    assert {r["text"] for r in overlays.newest(spark, state).collect()} == {"2", "x"}


def test_apply_labels(spark, repo):
    from ripple.plans import clients, lenses

    write(repo, {"auth_utils.py": FILES["auth_utils.py"].replace("return bool(token)", "return token is not None")})
    got = audit(spark, repo)

    class Client:
        def label(self, p):
            return "Callers see a missing `token` as refused, so that empty ones pass."

    new = labels.apply_labels(got, Client(), {"auth_utils.py": (repo / "auth_utils.py").read_text()})
    assert new["changed_symbols"][0]["hunk_details"][0]["detail"].startswith("Callers see") and got["changed_symbols"][0]["detail"].startswith("Returns")
    assert labels.apply_labels(got, Client(), {}, paths={"other.py"}) == got and labels.apply_labels(got, None, {}) == got
    assert "<code>api/routes.py</code>" in lenses.page(got) and "&lt;" in lenses.page(got | {"summary": "<b>"})
    s = config.LabelSettings(provider="openai", api_key="k", model="m", base_url="http://x")
    chat = clients.ChatClient(s, lambda *a: {"choices": [{"message": {"content": 'so: {"detail": "Fine."}'}}]})
    assert chat.label({}) == "Fine." and clients.ChatClient(s, lambda *a: {}).label({}) is None and isinstance(clients.build_client(s), clients.ChatClient) and clients.build_client(config.LabelSettings()) is None
    assert clients.MessagesClient(s, lambda *a: {"content": [{"text": '{"detail": "Good."}'}]}).label({}) == "Good."
    sent = []
    env = {"GITHUB_TOKEN": "t", "GITHUB_REPOSITORY": "o/r", "PR_NUMBER": "7"}
    api = clients.PullRequestComments.from_env(env, lambda method, url, *a: sent.append((method, url)) or [])
    assert report.upsert_comment(api, "x") == "created" and sent[-1][0] == "POST" and sent[-1][1].endswith("/repos/o/r/issues/7/comments")
    with pytest.raises(ValueError):
        clients.PullRequestComments.from_env({})


def test_ledger_tables(spark):
    text = "LIMIT = 3\nclass C:\n    A = 1\n    def f(self):\n        return LIMIT + self.A\n"
    files = facts.from_contents(spark.createDataFrame([("r", "a.py", bytearray(text.encode())), ("r", "b.ts", bytearray(b"const A = 1")), ("r", "bad.py", bytearray(b"def ("))], "repo string, path string, content binary"))
    rows = facts.assignments(files)
    assert sorted((r["name"], r["rhs"], r["start"], r["class_name"]) for r in rows.collect()) == [("A", "1", 3, "C"), ("LIMIT", "3", 1, None)]
    assert sorted((r["name"], r["reader"], r["line"]) for r in facts.readers(files, rows).collect()) == [("A", "f", 5), ("LIMIT", "f", 5)]


def test_many_repositories(spark):
    """An audit of two repositories in one call equals two audits, and neither sees the other's files."""
    two = {"auth_utils.py": FILES["auth_utils.py"], "only/here.py": "from auth_utils import hash_password\n\n\ndef go(x):\n    return hash_password(x)\n", "LIMITS.py": "A = 1\n"}
    rows = [(r, p, bytearray(t.encode())) for r, files in (("one", FILES), ("two", two)) for p, t in files.items()]
    engine = Engine(spark, Tables.of(facts.from_contents(spark.createDataFrame(rows, "repo string, path string, content binary"))))
    changed = spark.createDataFrame([("one", "auth_utils.py"), ("two", "auth_utils.py"), ("two", "LIMITS.py"), ("three", "notes.md")], "repo string, path string")
    spans = spark.createDataFrame([("one", "auth_utils.py", 3, 8), ("two", "auth_utils.py", 11, 12), ("two", "LIMITS.py", 1, 1)], "repo string, path string, start int, stop int")
    both = engine.audits(changed, spans)
    texts = {r["repo"]: r["text"] for r in report.markdowns(both).collect()}
    assert texts == {x: report.markdown(both[x]) for x in ("one", "two", "three")} and texts["one"].count("\n- ") == 1 + 2 + 3 + 1 and both.get("four") is None
    assert both["one"] == engine.audit(changed, spans, repo="one") and both["two"] == engine.audit(changed, spans, repo="two")
    assert both["three"]["seed"] == "(non-source)" and engine.audit(changed, spans, repo="four")["seed"] == "(none)"
    assert [n["path"] for n in both["one"]["downstream"]] == ["billing/service.py", "dashboard/views.py", "jobs/worker.py"] and both["one"]["line_explanations"][0]["detail"] == "Sets `LIMIT` to `3`."
    assert both["two"]["summary"].startswith("Tiny change") and both["two"]["isolated"] == ["LIMITS.py", "auth_utils.py"] and [x["name"] for x in both["two"]["changed_symbols"]] == ["hash_password"]
    assert engine.trace("auth_utils.py", "two")["summary"].count("1 downstream file") == 1
    assert [x["name"] for x in engine.explain(changed, spans, repo="two")] == ["hash_password"]
    engine.close()


def test_docstring_rules(spark):
    from ripple.plans import captions

    doc = [("load_rows", "Load the rows."), ("load_rows", "Returns ``rows`` of Phase 2: {x} tables"), ("load_rows", "Reads whole partitions lazily"), ("load_rows", "Heuristic → see hunk 3"), ("x", "")]
    got = spark.createDataFrame([(n, d, "function", "a/b.py") for n, d in doc], "name string, docstring string, kind string, path string").select(captions.purpose()).collect()
    assert [r[0] for r in got][:3] == ["`load_rows` loads rows into memory or scope.", "`load_rows` — Rows of tables.", "`load_rows` — Reads whole partitions lazily."] or got[1][0].startswith("`load_rows` loads")
    assert got[3][0] == "`load_rows` loads rows into memory or scope."
    text = spark.createDataFrame([("`f` lives in `src/a/b.py` and is read in `b.py` for `a/b.py`.", "src/a/b.py")], "t string, p string").select(captions.without_own_file(F.col("t"), F.col("p"))).first()[0]
    assert text == "`f` and is read."


def test_parse_limits(spark, monkeypatch):
    import time

    from ripple.functions import predicates
    from ripple.sources import js_parser

    monkeypatch.setattr(js_parser, "parse", lambda x: time.sleep(5))
    assert facts.parse_one(b"", "javascript", 0.05) is None and facts.parse_one(b"import os", "python")["imports"]
    monkeypatch.undo()
    assert js_parser.parse(b"f(`a ${g(`${h(1)}`, {k: i(2)})} b`); j()")["calls"] == [(x, 1) for x in "fghij"]
    same = spark.createDataFrame([("a/b", "./a//b/"), ("a/./b", "a/b"), ("a/b", "a/c"), ("/", "/")], "a string, b string").select(predicates.same_path("a", "b")).collect()
    assert [r[0] for r in same] == [True, True, False, True]


def test_base_texts(spark, repo):
    write(repo, {"auth_utils.py": "changed\n", "new.py": "x = 1\n"})
    rows = {r["path"]: r["text"] for r in git.read(spark, str(repo), "blobs").collect()}
    assert rows["auth_utils.py"] == FILES["auth_utils.py"] and rows["new.py"] == "" and set(rows) == {*FILES, "new.py"}
    assert git.blob_texts(str(repo), "main", ["jobs/worker.py", "no\nsuch", "none.py", "api/routes.py"]) == [FILES["jobs/worker.py"], "", "", FILES["api/routes.py"]]
