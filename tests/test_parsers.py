import pytest

from ripple.sources import js_parser, py_parser
from ripple.sources.git import parse_diff
from ripple.sources.overlay import changed_spans


@pytest.mark.parametrize(
    "source,expected",
    [
        ("import os", ("os", [], None)),
        ("import os.path as osp", ("os.path", [], "osp")),
        ("from a.b import c", ("a.b", ["c"], None)),
        ("from a import b as x, c", ("a", ["b", "c"], None)),
        ("from . import sib", (".", ["sib"], None)),
        ("from ..up import thing", ("..up", ["thing"], None)),
        ("from m import *", ("m", ["*"], None)),
        ("def f():\n    import inner", ("inner", [], None)),
    ],
)
def test_python_imports(source, expected):
    assert py_parser.parse(source.encode())["imports"][0][:3] == expected


def test_python_facts():
    src = b'class A:\n    def m(self):\n        """Does it.\n\n        More."""\n        return self.x.y(1)\n\nasync def g():\n    (lambda: 0)()\n    f()[0]()\n'
    got = py_parser.parse(src)
    assert got["definitions"] == [("A", "class", 1, None), ("m", "function", 2, "Does it."), ("g", "function", 8, None)]
    assert got["calls"] == [("self.x.y", 6), ("f", 10)]
    assert py_parser.parse(b"def broken(:") is None


def test_ledger():
    src = "LIMIT = 3\nclass C:\n    A, B = 1, 2\n    def f(self):\n        return LIMIT + self.A\n"
    assert py_parser.assignments(src) == [("LIMIT", "3", 1, 1, None), ("A", "1, 2", 3, 3, "C"), ("B", "1, 2", 3, 3, "C")]
    assert py_parser.readers(src, "LIMIT") == [("f", 5)] and py_parser.readers(src, "A") == [("f", 5)]
    assert py_parser.command_help("import t\n@t.command(help='Run the audit')\ndef run(x=t.Option(1, help='short')): pass", "run") == "Run the audit"


def test_javascript_facts():
    src = b"""import def, { a as b, c } from './mod';
import * as ns from "pkg";
import './side';
const z = require('legacy');
/**
 * Charges a user.
 * @param u
 */
export async function charge(u) { return ns.pay(u, /[)]x(/.test(u)); }
/* plain */
export default class Box { method(x) { helper(x); } }
const arrow = () => inner();
"""
    got = js_parser.parse(src)
    assert [(m, s, a) for m, s, a, _ in got["imports"]] == [("./mod", ["def", "a", "c"], None), ("pkg", ["*"], "ns"), ("./side", [], None), ("legacy", [], None)]
    assert got["definitions"] == [("charge", "function", 9, "Charges a user."), ("Box", "class", 11, None)]
    assert [c for c, _ in got["calls"]] == ["ns.pay", "helper", "inner"]


def test_diff_and_overlay_spans():
    text = "diff --git a/x b/x\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n@@ -20,2 +19,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert parse_diff(text) == [("x.py", 3, 6), ("x.py", 12, 12), ("x.py", 20, 19)]
    assert changed_spans("a\nb\n", "a\nb\n\n\n\n") == [(3, 5)]
    assert changed_spans("a\nb\nc\n", "a\nc\n") == []
