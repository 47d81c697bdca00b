"""
Token-id files: tokenised documents in ascending id order, coded by ``token_codec``.

Texts are range-partitioned by doc_id; each task tokenises its documents, adds the end id to each and writes one file
to the shared folder: groups of coded blocks, then an index of its documents. The manifest, with a row for each file of a
task that ended, gives the files' order and how many ids lie before each. Files are read in parallel.

The tokenizer splits at white space before anything else (``Words`` makes sure), so its ids for a text are those of its words in
order; each worker keeps a bounded table of the words it has met.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shipping import ship
from . import common, token_codec
from .warc import open_file

END_ID = 1
MAGIC = b"RIPTOK02"
#: Words that a worker remembers.
WORDS = 1_500_000
#: Text bytes of a file, about, whatever the size of the table: also the most that a task holds, unless one text is longer.
FILE_BYTES = 32 << 20
#: Bytes of ids that are coded together.
HELD_BYTES = 32 << 20
#: Text bytes whose words are looked up together.
STEP = 4 << 20
_TAIL = struct.Struct("<QQ8s")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word that the tokenizer gives one id of its own, and probes for the properties that ``Words`` builds on.
SEPARATOR = "0"
_PROBES = ("word", "WORD", "it's", "'s", "a1b22", "#*$%", "é", "\u0301x", "中文", "x\ty", "...", "<|endoftext|>", "\u200b", "\U0001f600")
_SIMPLE_PROBES = ("word", "straße", "niño", "garçon", "übermäßig", "ÿ", "señor", "l", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "xqzjkv")
#: Marks that end a word, and words of lower-case letters only, which no normalisation changes.
_MARKS = b".,;:!?#$%&*|"
_simple = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch  # a to z, ß to ö, ø to ÿ
_SPACED = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPACED)


def _lowered(text: bytes) -> bytes:
    """Spaces for white space, a to z for A to Z, but in words that may hold the name of a special id: the tokenizer looks for these before it lowers letters."""
    if b"<|" not in text:
        return text.translate(_LOWER)
    return b" ".join(w if b"<|" in w else w.translate(_LOWER) for w in text.translate(_SPACED).split(b" "))


def _byte_letters() -> str:
    """The character by which byte-level vocabularies write each byte: itself if it is printable, else the next one from 256 on. A space stays."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown or b == 32 else chr(256 + hidden.index(b)) for b in range(256))


class Words:
    """
    Ids of texts (UTF-8) as bytes of little-endian 16-bit integers, word by word. Raises ValueError for a tokenizer whose ids of a text
    are not those of its words between ASCII white space, in any case of A to Z.

    New words are encoded many at a time with ``SEPARATOR`` between them, and words that hold it, one by one. If the tokenizer's ids of a simple word
    and of the marks after it are their ids side by side (which is tried), marks are split off first; if they are those that its model alone
    gives, and the model has ids of their own for ends of words, the steps before the model and the separators are left out for simple words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit 16 bits")
        alone = {w: self._ids(w) for w in (*_PROBES, *_SIMPLE_PROBES, SEPARATOR)}
        if len(alone[SEPARATOR]) != 1 or any(self._ids(a + gap + b) != alone[a] + alone[b] for a in alone for b in alone for gap in (" ", "\n", "  ", "\t", "\r", "\x0b", "\x0c")):
            raise ValueError("the tokenizer does not split at white space")
        if any(self._ids(w.upper()) != self._ids(w.lower()) for w in ("word", "xqzjkv", "mississippi")):
            raise ValueError("the tokenizer tells A to Z from a to z")
        self.separator = alone[SEPARATOR][0]
        marks = (".", "?!", "...", ",;:", "!", "###", "$", "%%%.", "&&&", "***", "|", "#$%&*|", *(chr(c) for c in _MARKS))
        self.splits = all(self._ids(w + m) == alone[w] + self._ids(m) for w in _SIMPLE_PROBES for m in marks)
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer, self.lean.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        suffix, vocabulary = getattr(self.lean.model, "end_of_word_suffix", None), self.lean.get_vocab()
        self.is_end = np.zeros(65536, bool)
        self.is_end[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        encoded, cuts = self._lean([w.encode() for w in _SIMPLE_PROBES])
        if [encoded[a:b] for a, b in cuts] != [np.array(alone[w], "<u2").tobytes() for w in _SIMPLE_PROBES]:
            self.lean = None
        self.table: dict[bytes, bytes] = {b"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _full(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u2")

    def _lean(self, words: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
        """The ids of simple words, and where those of each begin and end."""
        written = codecs.charmap_decode(b" ".join(words), "strict", self.letters)[0]
        ids = np.array(self.lean.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u2")
        ends = (2 * np.flatnonzero(self.is_end.take(ids)) + 2).tolist()
        return ids.tobytes(), list(zip([0, *ends], ends, strict=False))

    def _apart(self, words: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
        """The same of words without ``SEPARATOR``."""
        ids = self._full(f" {SEPARATOR} ".encode().join(words))
        cuts = 2 * np.flatnonzero(ids == self.separator)
        return ids.tobytes(), list(zip([0, *(cuts + 2).tolist()], [*cuts.tolist(), 2 * len(ids)], strict=True))

    def _learn(self, words: set[bytes]) -> None:
        """Puts words that the table does not have into it."""
        table = self.table
        simple, plain, odd, ends = [], [], [], []

        def sort(w: bytes) -> None:
            (simple if self.lean and (w.isalpha() or _simple(w)) else odd if SEPARATOR.encode() in w else plain).append(w)

        letters = [w for w in words if w.isalpha()]  # of ASCII
        if self.lean:
            simple += letters
        else:
            for w in letters:
                sort(w)
        for w in words.difference(letters):
            stem = w.rstrip(_MARKS)
            if self.splits and len(stem) < len(w) and (stem.isalpha() or _simple(stem)):
                ends.append((w, stem, w[len(stem) :]))
            else:
                sort(w)
        for k in (1, 2):
            for w in {x[k] for x in ends}.difference(words):
                if w not in table:
                    sort(w)
        for some_words, encode in ((simple, self._lean), (plain, self._apart)):
            for lo in range(0, len(some_words), 4096):
                some = some_words[lo : lo + 4096]
                ids, cuts = encode(some)
                if len(cuts) != len(some):
                    odd += some
                    continue
                table.update(zip(some, [ids[a:b] for a, b in cuts], strict=True))
        for w in odd:
            table[w] = self._full(w).tobytes()
        for w, stem, end in ends:
            table[w] = table[stem] + table[end]

    def _distinct(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words without white space."""
        got = list(map(self.table.get, words))
        missing = [k for k, ids in enumerate(got) if ids is None]
        if missing:
            new = set(map(words.__getitem__, missing))
            if len(self.table) + len(new) > WORDS:
                self.table = {b"": b""}
                new.discard(b"")
            self._learn(new)
            for k in missing:
                got[k] = self.table[words[k]]
            for w in [w for w in new if len(w) > 64]:
                del self.table[w]
        return got

    def texts(self, texts: list[bytes]) -> list[bytes]:
        rows = [_lowered(t) for t in texts]
        data, bounds = b" ".join([*rows, b""]), np.array([0, *accumulate(len(r) + 1 for r in rows)], np.int64)
        # a cell is a word and the space after it; each distinct cell is looked up once
        offsets = np.flatnonzero(np.frombuffer(b" " + data, np.uint8) == 32).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        got = self._distinct(cells.dictionary.buffers()[2].to_pybytes().rstrip(b"\0").split(b" ")[:-1])  # the last is a space, zeros may follow
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 1
        which = cells.indices.to_numpy()
        sizes = size.take(which)
        ends = np.cumsum(sizes)
        at = np.repeat((np.cumsum(size) - size).take(which) - (ends - sizes), sizes)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(got), "<u2").take(at).tobytes()
        stops = (2 * np.r_[0, ends].take(np.searchsorted(offsets, bounds))).tolist()
        return [ids[a:b] for a, b in pairwise(stops)]


_of_worker: dict[str, Words] = {}


def worker_words(path: str) -> Words:
    if path not in _of_worker:
        _of_worker[path] = Words(path)
    return _of_worker[path]


class Writer:
    """A file of documents: header, lengths and bytes of groups of blocks, index, its place and size, magic."""

    def __init__(self, path: str):
        self.out = open_file(path, write=True)
        self.out.write(MAGIC)
        self.held: list[bytes] = []
        self.size, self.written = 0, len(MAGIC)
        self.ids: list = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 2)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= HELD_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.size:
            data = token_codec.encode(np.frombuffer(b"".join(self.held), "<u2"))
            self.out.write(struct.pack("<Q", len(data)) + data)
            self.written += 8 + len(data)
            self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        """(bytes, ids) of the file"""
        self.flush()
        index = zlib.compress(json.dumps({"doc_ids": self.ids, "counts": self.counts}).encode(), 1)
        self.out.write(index + _TAIL.pack(self.written, len(index), MAGIC))
        self.out.close()
        return self.written + len(index) + _TAIL.size, sum(self.counts)


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file. Raises ValueError if it is damaged."""
    at, size, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC or at + size + _TAIL.size != len(data):
        raise ValueError("not a token file")
    index = json.loads(zlib.decompress(data[at : at + size]))
    parts, lo = [np.zeros(0, np.uint16)], len(MAGIC)
    while lo < at:
        (n,) = struct.unpack_from("<Q", data, lo)
        parts.append(token_codec.decode(data[lo + 8 : lo + 8 + n]))
        lo += 8 + n
    return index["doc_ids"], np.array(index["counts"], np.int64), np.concatenate(parts)


def write_tokens(docs: DataFrame, directory: str, files: int, path=tokenizer_path) -> DataFrame:
    """
    Writes doc_id, text as token files below ``directory``. Manifest: file, part (its place among the files), docs,
    ids, bytes. Integer doc_ids only (others raise TypeError). Null texts are empty: their documents have the end id alone. Null doc_ids come first; rows with
    equal doc_ids follow each other in order of their texts' hashes, over as many files as they need.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    rows = docs.select(F.col("doc_id").cast("long"), common.text_of().alias("text"), F.monotonically_increasing_id().alias("nth")).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth").select("doc_id", "text")
    end = struct.pack("<H", END_ID)

    def run(batches):
        words, writer, name = worker_words(path()), None, f"{directory}/part-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for part in common.steps(batch, most=STEP):
                if writer is None:
                    writer = Writer(name)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.texts(part.column("text").cast(pa.large_binary()).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            size, ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": TaskContext.get().partitionId(), "docs": len(writer.ids), "ids": ids, "bytes": size}])

    return common.written(ship(rows).mapInArrow(run, "file string, part long, docs long, ids long, bytes long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, read back from the files."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    files = manifest.select("file", before.alias("base"))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_file(name) as stream:
                    doc_ids, counts, ids = read_file(stream.read())
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                view = memoryview(wide).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                for lo in range(0, len(doc_ids), 2048):
                    some = slice(lo, lo + 2048)
                    cols = {"doc_id": pa.array(doc_ids[some], pa.int64()), "start": pa.array(base + (ends - counts)[some], pa.int64()), "n_tokens": pa.array(counts[some], pa.int64()), "ids_crc32": pa.array(crc[some], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([ids[e - n : e].astype(np.int32) for e, n in zip(ends[some], counts[some], strict=True)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return ship(files).repartition(max(1, manifest.count())).mapInArrow(run, schema)


def n_files(docs: DataFrame) -> int:
    """As many files as there are FILE_BYTES of text."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_tokens(docs, common.new_path(spark, "tokens"), n_files(docs))
    return read_tokens(spark, manifest)
