"""Unsaved editor texts laid over files: parsing, the newest for each path, upsert, and the changed spans of one text (``operators.line_diff`` has those of tables)."""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_overlays(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep..., path, text: the entries of a JSON object of strings."""
    return df.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("path", "text"))


def overlay_path(path: Column | str) -> Column:
    """One leading ./ is dropped; null for absolute paths and those with a .. segment."""
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"^\./", "")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)|^/"), p)


def changed_paths(*origins: DataFrame) -> DataFrame:
    """(repo, path) that any of the tables (repo, path, ...) has: the working tree, the index, untracked files, a range."""
    return reduce(DataFrame.unionByName, [x.select("repo", "path") for x in origins]).distinct()


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key: a combinable aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("row")).select(*key, "row.*")


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``base`` without those whose key is in ``new``, and all of ``new``."""
    return base.join(new.select(*key), key, "left_anti").unionByName(new.select(*base.columns))


def changed_spans(base: str, text: str) -> list[tuple[int, int]]:
    """Spans of ``text`` (1-based) that a line comparison finds inserted or replaced, merged where they touch."""
    new = text.splitlines()
    out: list[tuple[int, int]] = []
    for tag, _, _, start, stop in difflib.SequenceMatcher(None, base.splitlines(), new, autojunk=False).get_opcodes():
        if tag in ("insert", "replace") and stop > start:
            if out and start + 1 <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], stop))
            else:
                out.append((start + 1, stop))
    return out
