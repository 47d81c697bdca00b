"""Row types of the engine's tables. Every table carries ``repo``, so one job analyses many repositories."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


IMPORT_EVIDENCE = _struct(path=_S, line=_I, module=_S)
EVIDENCE_ITEM = _struct(confidence=_S, kind=_S, location=_S, fact=_S)
HUNK_DETAIL = _struct(line=_I, changed_lines=T.ArrayType(_I), detail=_S)
IMPORT = _struct(module=_S, symbols=T.ArrayType(_S), alias=_S, line=_I)
DEFINITION = _struct(name=_S, kind=_S, line=_I, docstring=_S)
CALL = _struct(callee=_S, line=_I)
MODULE_FACTS = _struct(path=_S, language=_S, imports=T.ArrayType(IMPORT), definitions=T.ArrayType(DEFINITION), calls=T.ArrayType(CALL))
ASSIGN_FACT = _struct(name=_S, rhs=_S, start=_I, stop=_I, class_name=_S)
READER_FACT = _struct(name=_S, line=_I)
EXPLANATION_CLAUSE = _struct(role=_S, text=_S, evidence=T.ArrayType(EVIDENCE_ITEM))
CHANGED_SYMBOL = _struct(
    path=_S, name=_S, kind=_S, line=_I, changed_lines=T.ArrayType(_I), summary=_S, detail=_S, explanation=_S, implication=_S,
    hunk_details=T.ArrayType(HUNK_DETAIL), evidence=T.ArrayType(EVIDENCE_ITEM),
)
SYMBOL_EXPLANATION = _struct(symbol=CHANGED_SYMBOL, text=_S, clauses=T.ArrayType(EXPLANATION_CLAUSE))
LINE_EXPLANATION = _struct(path=_S, line=_I, changed_lines=T.ArrayType(_I), detail=_S)
IMPACT_NODE = _struct(path=_S, hops=_I, reason=_S, import_evidence=T.ArrayType(IMPORT_EVIDENCE))
REPORT = _struct(
    mode=_S, seed=_S, summary=_S, risk_tier=_S, mermaid=_S, danger_zones=T.ArrayType(IMPACT_NODE), downstream=T.ArrayType(IMPACT_NODE), isolated=T.ArrayType(_S),
    changed_symbols=T.ArrayType(CHANGED_SYMBOL), line_explanations=T.ArrayType(LINE_EXPLANATION), caveat=_S,
)

FILES = _struct(repo=_S, path=_S, language=_S, digest=_S, content=T.BinaryType(), n_lines=_I, ord=_I)
IMPORTS = _struct(repo=_S, path=_S, ordinal=_I, module=_S, symbols=T.ArrayType(_S), alias=_S, line=_I)
DEFINITIONS = _struct(repo=_S, path=_S, ordinal=_I, name=_S, kind=_S, line=_I, docstring=_S)
CALLS = _struct(repo=_S, path=_S, ordinal=_I, callee=_S, line=_I)
EDGES = _struct(repo=_S, src=_S, dst=_S, imports=T.ArrayType(_struct(line=_I, module=_S)))
SPANS = _struct(repo=_S, path=_S, start=_I, stop=_I)
RINGS = _struct(repo=_S, path=_S, hops=_I)
EOF_LINE = 1_000_000_000
