"""
SentencePiece encoding and decoding by a distinct-chunk table.

When no piece holds a white space mark (U+2581) after another character, and none holds a line end, the merges of a
text never cross a mark or a line end: each marked word can be segmented alone. A task keeps a table of the
distinct chunks it has met; the library segments and decodes each chunk once, and a text's ids are
joined from the table by position. ``Pieces`` checks the model for this property and refuses others.

There is no shuffle: one pass over all whole texts, with a table of bounded size in each Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Chunks that a worker remembers; beyond that the table starts anew. Longer chunks are not kept.
CHUNKS, CHUNK_CHARS = 300_000, 64

_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Texts that a model without normalisation gives back as they are: ligatures, spaces in a row, marks on letters, wide forms.
_KEPT = ("a ﬁ  b", "x   y", "e\u0301 é", "①Ａ", "tab\tand\nline")


class Pieces:
    """Encodes and decodes texts by chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        across = [p for p in pieces if re.search(f"[^{MARK}]{MARK}|{MARK}{MARK}+[^{MARK}]", p) or "\n" in p]
        if across or self.model.encode(" ") != self.model.encode(MARK):
            raise ValueError(f"pieces of this model cross white space: {across[:5]}")
        if changed := [t for t in _KEPT if self.model.decode(self.model.encode(t)) != t]:
            raise ValueError(f"this model normalises: it does not give back {changed}")
        self.mark = self.model.piece_to_id(MARK)
        self.anchor = self.model.encode("x")
        self.anchored = len(self.model.decode(self.anchor))
        self.table: dict[str, tuple[int, str, str]] = {}

    def segment(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Entries of new chunks: one call of the library to encode them, one to decode."""
        # the library puts a mark in front: it stands for a chunk's first mark, and merges with no line end
        found = self.model.encode([c[1:] if c[0] != "\n" else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c[0] == "\n":
                if found[k][0] != self.mark:
                    raise ValueError("the mark in front of a line end has merged")
                found[k] = found[k][1:]
            elif len(c) == 1:
                found[k] = [self.mark]
        texts = self.model.decode([self.anchor + ids for ids in found], num_threads=1)
        return [(len(ids), ",".join(map(str, ids)), t[self.anchored :]) for ids, t in zip(found, texts, strict=True)]

    def texts(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its chunks' entries (number of ids, ids joined by commas, decoded text) in order."""
        rows = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        table = self.table
        new = list({c for r in rows for c in r if c not in table})
        if len(table) + len(new) > CHUNKS:
            table.clear()
            new = list({c for r in rows for c in r})
        table.update(zip(new, self.segment(new), strict=True) if new else ())
        got = [[table[c] for c in r] for r in rows]
        for c in new:
            if len(c) > CHUNK_CHARS:
                del table[c]
        return got

    @staticmethod
    def ids(entries) -> list[int]:
        return [int(k) for e in entries for k in e[1].split(",")]

    @staticmethod
    def decoded(entries) -> str:
        """The first mark is the one that the library adds to a text."""
        return "".join([e[2] for e in entries])[1:]


_of_worker: dict[str, Pieces] = {}


def worker_pieces(path: str) -> Pieces:
    """One table for each Python worker: later tasks of the worker find the chunks of earlier ones."""
    if path not in _of_worker:
        _of_worker[path] = Pieces(path)
    return _of_worker[path]


def encode_documents(docs: DataFrame, path: Callable[[], str] = model_path, keep: tuple[str, ...] = ("*",), digest: bool = False) -> DataFrame:
    """
    Each row of ``docs`` (its columns ``keep`` as ``row``) with ids (array of int) and decoded, the text that these ids stand
    for, or, with ``digest``, with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 instead.

    Null and empty texts have no ids. Texts are taken whole.
    Rows are encoded one by one: repeated rows and ids have equal results, and an empty table gives no rows.
    """
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def make():
        pieces = worker_pieces(path())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pieces.texts(batch.column("text").to_pylist())
            if digest:
                cols = {
                    "n_tokens": pa.array([sum([e[0] for e in r]) for r in rows], pa.int64()),
                    "ids_sha256": pa.array([sha(",".join([e[1] for e in r])) for r in rows], pa.string()),
                    "decoded_sha256": pa.array([sha(pieces.decoded(r)) for r in rows], pa.string()),
                }
            else:
                cols = {"ids": pa.array([pieces.ids(r) for r in rows], pa.list_(pa.int32())), "decoded": pa.array([pieces.decoded(r) for r in rows], pa.string())}
            return pa.RecordBatch.from_arrays([batch.column("row"), *cols.values()], ["row", *cols])

        return run

    return common.map_texts(inner, make, schema + (", n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else ", ids array<int>, decoded string"))


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return encode_documents(docs, keep=("doc_id",), digest=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
