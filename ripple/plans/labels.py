"""
Optional labels: an injectable client may rephrase a caption. Off by default; nothing that the report measures depends on it.

A pack of evidence goes through a secrets gate, a cache keyed by its fingerprint, the client, a validator and a polish check; any
failure leaves the caption as it was.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..shipping import ship

REVISION = "1"
MEMORY = 512
PACK = "struct<path:string,name:string,kind:string,risk_tier:string,who:string,what:string,edit_lines:array<struct<line:int,text:string>>,caption:string,purpose:string,readers:array<string>,importers:array<string>>"


class LabelClient(Protocol):
    def label(self, pack: dict) -> str | None: ...


def capped_edit_lines(lines: list[tuple[int, str]]) -> list[dict]:
    """At most 20 lines, up to the first with which the text would exceed 1500 characters."""
    out, size = [], 0
    for line, text in lines[: rules.PACK_LINES]:
        size += len(text)
        if size > rules.PACK_CHARS:
            break
        out.append({"line": line, "text": text})
    return out


def measured(lines: list[str]) -> dict:
    """The last return, the first assignment, imported modules, called names and blank lines of an edit."""
    find = lambda pattern: [m[1] for x in lines if (m := re.match(pattern, x))]
    calls = [c for x in lines for c in re.findall(r"([A-Za-z_][\w.]*)\s*\(", x)]
    return {
        "return_expr": (find(r"\s*return\s+(.+)$") or [""])[-1], "assign": (find(r"\s*(\w+)\s*=(?!=)") or [""])[0], "import_modules": find(r"\s*(?:from|import)\s+([\w.]+)"),
        "callees": list(dict.fromkeys(calls)), "blank_count": sum(not x.strip() for x in lines),
    }


def fingerprint(pack: dict, model: str) -> str:
    return hashlib.sha256(json.dumps({"model": model, "revision": REVISION, "pack": pack}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def has_secret(pack: dict) -> bool:
    text = "\n".join(x["text"] for x in pack.get("edit_lines") or [])
    return any(re.search(p, text) for p in rules.SECRETS)


def corpus(pack: dict) -> set[str]:
    """Lower-cased strings and identifiers that a label may name."""
    m = measured([x["text"] for x in pack.get("edit_lines") or []])
    texts = [pack.get(k) or "" for k in ("path", "name", "who", "what", "caption", "purpose")] + [x["text"] for x in pack.get("edit_lines") or []]
    texts += [*(pack.get("readers") or []), *(pack.get("importers") or []), *m["callees"], *m["import_modules"]]
    names = {w for t in texts for w in re.findall(r"[A-Za-z_][\w.]*", t)}
    return {w.lower() for w in names | {w.rpartition(".")[2] for w in names} | {t for t in texts if t}}


def supported(token: str, known: set[str]) -> bool:
    t = token.lower()
    return t in known or len(t) > 2 and any(len(k) > 2 and (t in k or k in t) for k in known)


def validate(detail: str | None, pack: dict) -> str | None:
    """The label, or None: no hop counts, at most two sentences, no preamble, no other risk tier, only names and claims that the pack supports."""
    text = " ".join((detail or "").split())
    if not text or re.search(rules.HOPS, text) or len(re.findall(rules.SENTENCE_END, text)) > rules.LABEL_SENTENCES or re.search(rules.CHATTY, text):
        return None
    if any(re.search(rf"\b{w}\b", text) for w in rules.RISK_WORDS if w != pack.get("risk_tier")):
        return None
    known = corpus(pack)
    ticks = [t.split("(")[0].strip() for t in re.findall(r"`([^`]+)`", text)]
    names = re.findall(rules.SNAKE, text) + re.findall(rules.CAMEL, text)
    if not all(supported(t, known) for t in ticks + names if t):
        return None
    if re.search(rules.SCOPE, text) and not (pack.get("who") or pack.get("readers") or pack.get("importers")) and not any(supported(m[0], known) for m in re.finditer(rules.SCOPE, text)):
        return None
    if len(text) > rules.LABEL_CHARS:
        text = text[: rules.LABEL_CHARS - 1].rsplit(" ", 1)[0] + "…"
    return None if text.count("`") % 2 else text


def plain(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower().replace("`", "")).split())


def near_duplicate(a: str, b: str) -> bool:
    x, y = plain(a), plain(b)
    return x == y or difflib.SequenceMatcher(None, x, y).ratio() >= 0.92


def polish(detail: str, pack: dict) -> str | None:
    """None for what only repeats the caption, and for slogans without a consequence."""
    if near_duplicate(detail, pack.get("caption") or "") or re.search(rules.THIN_EDIT, detail.strip()) and not re.search(rules.CONSEQUENCE, detail):
        return None
    return detail


class Cache:
    """Labels by fingerprint: the newest 512 in memory, in order of arrival."""

    def __init__(self, most: int = MEMORY):
        self.most, self.kept = most, OrderedDict()

    def get(self, key: str) -> str | None:
        return self.kept.get(key)

    def put(self, key: str, text: str) -> None:
        if text.strip():
            self.kept[key] = text
            while len(self.kept) > self.most:
                self.kept.popitem(last=False)

    def clear(self) -> None:
        self.kept.clear()


def label_one(pack: dict, client: LabelClient | None, model: str = "", cache: Cache | None = None) -> str | None:
    if client is None or has_secret(pack):
        return None
    key = fingerprint(pack, model)
    if cache is not None and (kept := cache.get(key)):
        return kept
    try:
        answer = client.label(pack)
    except Exception:  # a label is never worth a failed report
        return None
    text = validate(answer, pack)
    text = polish(text, pack) if text else None
    if text and cache is not None:
        cache.put(key, text)
    return text


def answer_detail(content: str) -> str | None:
    """``detail`` of a JSON answer, or of the JSON within other text."""
    for part in (content, content[content.find("{") : content.rfind("}") + 1]):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict) and isinstance(got.get("detail"), str) and got["detail"].strip():
            return got["detail"].strip()
    return None


def label_table(packs: DataFrame, make_client: Callable[[], LabelClient | None], model: str = "", tasks: int = 8, known: DataFrame | None = None) -> DataFrame:
    """
    packs: key columns and ``pack`` (PACK) -> with ``label``, null where the caption stays. Equal packs are asked for once. ``known``
    (fingerprint, label) holds earlier labels; only others reach the client, of which each task makes one.
    """
    from ..functions.scalars import fingerprint as of

    rows = packs.withColumn("fingerprint", of(F.col("pack"), F.lit(model), REVISION))
    todo = rows.where(~F.col("pack.path").rlike(r"(^|/)tests/|(^|/)test_[^/]*$")).groupBy("fingerprint").agg(F.any_value("pack").alias("pack"))
    if known is not None:
        todo = todo.join(known, "fingerprint", "left_anti")

    def run(batches):
        client = make_client()
        for df in batches:
            packs_ = [json.loads(x) for x in df["pack"]]
            yield pd.DataFrame({"fingerprint": df["fingerprint"], "label": [label_one(x, client, model) for x in packs_]})

    got = ship(todo).select("fingerprint", F.to_json("pack").alias("pack")).repartition(tasks).mapInPandas(run, "fingerprint string, label string")
    got = got.unionByName(known.select("fingerprint", "label")) if known is not None else got
    return rows.join(got, "fingerprint", "left")


def apply_labels(report: dict, client: LabelClient | None, texts: dict[str, str], paths: set[str] | None = None, model: str = "", cache: Cache | None = None, workers: int = 8) -> dict:
    """
    The report with labels in place of the first caption of each symbol and of each line caption, in the same order. Tests, and files outside of
    ``paths`` (if given), keep theirs; so does everything whose label fails. texts: the changed files' contents.
    """
    from concurrent.futures import ThreadPoolExecutor

    def wanted(path: str) -> bool:
        name = path.rpartition("/")[2]
        return (paths is None or path in paths) and not name.startswith("test_") and "/tests/" not in f"/{path}"

    def pack_of(x: dict, lines: list[int]) -> dict:
        source = texts.get(x["path"], "").splitlines()
        edit = capped_edit_lines([(n, source[n - 1]) for n in lines if 0 < n <= len(source)])
        who, _, what = (x.get("implication") or "").partition(" — ")[2].partition(" — ")
        return {"path": x["path"], "name": x.get("name", ""), "kind": x.get("kind", "line"), "risk_tier": report["risk_tier"], "who": who[:80], "what": what[:80], "edit_lines": edit, "caption": x["detail"], "purpose": (x.get("summary") or "")[:200], "readers": [], "importers": []}

    def one(x: dict) -> dict:
        text = label_one(pack_of(x, x["changed_lines"]), client, model, cache) if client is not None and x["detail"] and wanted(x["path"]) else None
        if text is None:
            return x
        hunks = x.get("hunk_details")
        return x | {"detail": text} | ({"hunk_details": [hunks[0] | {"detail": text}, *hunks[1:]], "evidence": x["evidence"][-2:]} if hunks else {})

    with ThreadPoolExecutor(max(1, min(16, workers))) as pool:
        return report | {k: list(pool.map(one, report[k])) for k in ("changed_symbols", "line_explanations")}
