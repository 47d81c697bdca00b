"""Scalar columns: names, paths, captions, sentences, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .predicates import base_name, col, contains_any, is_danger_path, let, padded, stripped


def lines_of(text: Column | str) -> Column:
    """Lines as str.splitlines() has them: every Unicode line end, and no empty last piece."""
    parts = F.split(col(text), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def expand_acronyms(text: Column | str) -> Column:
    """The first bare use of each acronym is spelled out, unless it already is somewhere."""

    def spell(short: str, spelled: str):
        def one(x: Column) -> Column:
            at = F.regexp_instr(x, F.lit(rf"(?U)\b{short}\b(?!\s*\()"))
            longer = F.concat(F.substring(x, F.lit(1), at - 1), F.lit(spelled), F.substring(x, at + len(short), F.length(x)))
            return F.when((at > 0) & ~F.contains(x, F.lit(spelled)), longer).otherwise(x)

        return one

    out = col(text)
    for short, full in rules.ACRONYMS:
        out = let(out, spell(short, f"{short} ({full})"))
    return out


def collapse(text: Column | str) -> Column:
    return stripped(F.regexp_replace(col(text), r"(?U)\s+", " "))


def clip(text: Column | str, most: int) -> Column:
    """One line of at most ``most`` characters: cut at a separator in its back half, ending in an ellipsis."""

    def cut(head: Column) -> Column:
        out = F.regexp_replace(head, r"\s+$", "")
        for sep in reversed((" ", ",", "(", ")")):
            at = F.when(F.contains(head, F.lit(sep)), most - 1 - F.locate(sep, F.reverse(head))).otherwise(F.lit(-1))  # the last separator's place, from 0
            kept = F.substring(head, F.lit(1), at + (1 if sep in "()" else 0))
            out = F.when(at >= most // 2, F.regexp_replace(kept, "[ ,]+$", "")).otherwise(out)
        return F.concat(F.regexp_replace(out, r"\s+$", ""), F.lit("…"))

    return let(collapse(text), lambda plain: F.when(F.length(plain) <= most, plain).otherwise(let(F.substring(plain, 1, most - 1), cut)))


def clip_bullet(text: Column | str, most: int = rules.BULLET_CHARS) -> Column:
    return let(collapse(text), lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most - 1), r"\s+$", ""), F.lit("…"))))


def wrap(text: Column | str, most: int = 110) -> Column:
    """Greedy word wrap: an array of lines."""

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(word) <= most)
        joined = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    return F.aggregate(words, F.array().cast("array<string>"), step)


def short_path(path: Column | str, bare_names: tuple[str, ...] = ()) -> Column:
    """parent/name; a parent of src or none is dropped, and so is that of ``bare_names``."""
    parts = F.split(col(path), "/")
    parent = F.get(parts, F.size(parts) - 2)
    name = base_name(path)
    return F.when(name.isin(*bare_names) if bare_names else F.lit(False), name).when(parent.isNull() | parent.isin("src", ".", ""), name).otherwise(F.concat_ws("/", parent, name))


def bare_callee(callee: Column | str) -> Column:
    return F.substring_index(col(callee), ".", -1)


def call_bare_from_detail(detail: Column | str) -> Column:
    return F.regexp_extract(col(detail), r"Calls `([^`(]+)", 1)


def blank_line_detail(n: Column) -> Column:
    return F.when(n <= 1, F.lit("Added a blank line.")).otherwise(F.concat(F.lit("Added "), n.cast("string"), F.lit(" blank lines.")))


def format_lines(lines: Column | str) -> Column:
    return F.array_join(F.transform(col(lines), lambda x: x.cast("string")), ", ")


def snake(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2"))


def humanize(name: Column | str) -> Column:
    words = F.regexp_replace(F.regexp_replace(snake(name), "_+", " "), "^ +| +$", "")
    return F.when(words == "", "this behavior").otherwise(words)


def title(text: Column | str) -> Column:
    """Capital after every non-letter, small letters otherwise, as str.title() has it."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def safe_id(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^\p{L}\p{N}]", "_")


def node_id(path: Column | str) -> Column:
    return F.concat(F.lit("n_"), safe_id(path))


def layer(path: Column | str) -> Column:
    parts = F.split(col(path), "/")
    top = F.when(F.get(parts, F.lit(0)) == "src", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.when(F.size(parts) == 1, "root").otherwise(F.coalesce(top, F.lit("root")))


def layer_label(name: Column | str) -> Column:
    return title(F.translate(col(name), "_", " "))


def distance_phrase(hops: Column) -> Column:
    return (
        F.when(hops <= 0, " (this is one of the files you changed)")
        .when(hops == 1, " — it directly imports a file you changed")
        .otherwise(F.concat(F.lit(" — "), hops.cast("string"), F.lit(" import steps away from a file you changed")))
    )


def path_list(paths: Column | str, most: int = rules.NAMED_IMPORTERS, n: Column | None = None) -> Column:
    """`a`, `b`, and `c`; beyond ``most`` the rest is counted. n: how many there are, if ``paths`` has only the first ``most``."""
    p = col(paths)
    quoted = F.transform(p, lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    n = F.size(p) if n is None else n
    head = F.array_join(F.slice(quoted, 1, most), ", ")
    return (
        F.when(n <= 0, "").when(n == 1, F.get(quoted, F.lit(0))).when(n == 2, F.array_join(quoted, " and "))
        .when(n <= most, F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(quoted, -1)))
        .otherwise(F.concat(head, F.lit(", and "), (n - most).cast("string"), F.lit(" more")))
    )


def hub_reason(importers: Column, changed: bool = False, hops: Column | None = None) -> Column:
    """importers: the struct of ``resolve.importers_of``."""
    named, far = path_list(importers["first"], n=importers["n"]), distance_phrase(hops) if hops is not None else F.lit("")
    if changed:
        return F.when(named != "", F.concat(F.lit("You changed a shared hub — imported directly by "), named, F.lit("."))).otherwise("You changed a shared hub.")
    count = F.concat(F.lit("Shared hub — "), importers["n"].cast("string"), F.lit(" other files import it directly"), far, F.lit("."))
    return F.when(named != "", F.concat(F.lit("Shared hub — imported directly by "), named, far, F.lit("."))).otherwise(count)


def danger_reason(path: Column | str, hops: Column, importers: Column) -> Column:
    kind = (
        F.when(contains_any(padded(path), ("/api/", "/routes/", "/routers/")), "an API route file")
        .when(base_name(path).isin("models.py", "schema.prisma") | F.contains(padded(path), F.lit("/models/")), "a data-model file")
        .when(base_name(path).isin("settings.py", "config.py"), "a config file")
        .when(F.contains(padded(path), F.lit("/migrations/")), "a migration file")
        .otherwise("API, schema, or config code")
    )
    return F.when(is_danger_path(path), F.concat(F.lit("This is "), kind, distance_phrase(hops), F.lit("."))).otherwise(hub_reason(importers, hops=hops))


def downstream_reason(hops: Column, hit: Column) -> Column:
    """hit: sorted seeds that the file imports directly."""
    direct = F.when(F.size(hit) > 0, F.concat(F.lit("Directly imports "), path_list(hit), F.lit("."))).otherwise("Directly imports a file you changed.")
    far = F.concat(F.lit("Depends on a file you changed through "), hops.cast("string"), F.lit(" import steps (not a direct import)."))
    return F.when(hops == 1, direct).otherwise(far)


def first_and_more(names: Column, one: str, prefix: str) -> Column:
    """prefix `first`, with the number of others; '' for none. ``one`` goes before the count."""
    n = F.size(names)
    head = F.concat(F.lit(prefix), F.lit("`"), F.get(names, F.lit(0)), F.lit("`"))
    return F.when(n <= 0, "").when(n == 1, head).otherwise(F.concat(head, F.lit(one), (n - 1).cast("string"), F.lit(" more")))


def content_hash(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def fingerprint(pack: Column, model: Column | str, revision: str = "1") -> Column:
    """SHA-256 of canonical JSON: keys of the struct in its own order, model and prompt revision first."""
    return F.sha2(F.to_json(F.struct(col(model).alias("model"), F.lit(revision).alias("revision"), pack.alias("pack"))), 256)


def identifiers(text: Column | str) -> Column:
    """Distinct identifiers (also within backticks) and the last part of dotted ones, sorted, without keywords."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), 0))  # the distinct ones only are worked on
    both = F.flatten(F.transform(found, lambda x: let(F.rtrim(x, F.lit(".")), lambda y: F.array(y, bare_callee(y)))))
    keywords = F.array(*[F.lit(k) for k in ("if", "else", "for", "return", "def", "class")])
    return F.array_sort(F.array_except(both, keywords))


def backtick_bares(text: Column | str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit("`([^`]+)`"), 1), lambda x: stripped(F.substring_index(x, "(", 1))), lambda x: x != "")


def normalize_compare(text: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(F.replace(col(text), F.lit("`"), F.lit(""))), r"(?U)[^\w\s]", " "))


def sentence_count(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(stripped(text), F.lit(rules.SENTENCE_END)))


def split_implication(text: Column | str) -> Column:
    """struct(who, what) of 'tier — who — what' (empty without three parts), clipped to 80."""
    parts = F.transform(F.split(col(text), "—"), stripped)
    some = F.size(parts) >= 3
    return F.struct(F.when(some, clip(F.get(parts, F.lit(1)), 80)).otherwise("").alias("who"), F.when(some, clip(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " — "), 80)).otherwise("").alias("what"))


def detail_from_content(content: Column | str) -> Column:
    """The ``detail`` of a JSON answer; if it is wrapped in other text, of what lies between the outer braces."""
    inner = F.regexp_extract(col(content), r"(?s)(\{.*\})", 1)
    return F.nullif(stripped(F.coalesce(F.get_json_object(col(content), "$.detail"), F.get_json_object(inner, "$.detail"))), F.lit(""))


def stem(word: Column | str) -> Column:
    low = F.lower(col(word))
    return F.when((F.length(low) > 3) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def risk_emoji(tier: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in ("CRITICAL", "🔴", "HIGH", "🟠", "MEDIUM", "🟡", "LOW", "🟢")]), col(tier))
