"""Harmonic packing of token sequences (Lee and Lee, 1985).

Lengths fall into reciprocal-capacity classes: class k holds lengths in
(C / (k + 1), C / k], and a bin of class k takes exactly k pieces, whatever the other
classes do. Where documents may be cut freely, a piece is cut down to the upper end of
a class, so that its bins come out full.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless, stored, text_batches

CAPACITY, END = 2048, 1
#: Classes in use. Pieces shorter than C / 64 share the last one.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 21, 28, 40, 64)
#: A piece is left whole in a class where it wastes at most this share of its slot.
SLACK = 0.04
#: Chunks whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file is; TOKENIZER_DIR overrides the installed place."""
    if os.environ.get("TOKENIZER_DIR"):
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the shortcut below takes for granted; a vocabulary with other rules is given whole texts.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose composed, lower-cased form Python and the tokenizer agree on, then signs without an apostrophe.
_CHUNK = re.compile(r"([a-zß-öø-ÿœ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCodes(dict):
    """Ids as little-endian bytes of blank-delimited chunks, found when first asked for.

    The vocabulary's pre-tokeniser lower-cases, drops white space, never joins across it and
    takes runs of letters apart from runs of signs, so a text's ids are those of its chunks in
    order, and those of ``word,`` are those of ``word`` and ``,``. Plain runs go to the model itself, other chunks
    and texts that may hold a special token to the whole tokenizer. Chunks that were not met for a generation of
    REMEMBERED others are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        model, pre, normal = rules["model"], rules["pre_tokenizer"] or {}, rules["normalizer"] or {}
        steps = pre.get("pretokenizers", [{}])
        self.shortcut = (
            [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZER
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _SPLIT}
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and model["type"] == "BPE" and not model["dropout"]
            and all(x["content"].startswith("<|") for x in rules["added_tokens"])
        )
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or of signs."""
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.alphabet)
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(run)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        plain = _CHUNK.fullmatch(text if text.isascii() else text.lower())
        if plain is None:
            return self.whole(text)
        letters, signs = plain.groups()
        if not signs:
            return self._run(letters) if letters else b""
        # The same word or sign alone is often known already.
        ids = (self.get(letters.encode()) or self._run(letters)) if letters else b""
        return ids + (self.get(signs.encode()) or self._run(signs))

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._run(chunk.decode()) if chunk.isalpha() else self._chunk(chunk)
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        done: dict[str, bytes] = {}
        get = self.__getitem__
        for t in {t or "" for t in texts}:
            if not self.shortcut or "<|" in t:
                done[t] = self.whole(t)
            else:
                done[t] = b"".join(map(get, t.encode().lower().replace(b"\n", b" ").split(b" ")))
        return [done[t or ""] for t in texts]


_codes: dict[str, WordCodes] = {}


def word_codes(path: str) -> WordCodes:
    """One memory for each worker process, kept from task to task."""
    if path not in _codes:
        _codes[path] = WordCodes(path)
    return _codes[path]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The largest class in use whose slot holds ``length``."""
    return max(k for k in CLASSES if length * k <= capacity) if length * CLASSES[-1] > capacity else CLASSES[-1]


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``total`` ids, longest first."""
    out, left = [(1, capacity)] * (total // capacity), total % capacity
    while left:
        k = class_of(left, capacity)
        slot = capacity // k
        if k == CLASSES[-1] or slot - left <= SLACK * slot:
            out.append((k, left))
            break
        smaller = next(c for c in CLASSES if c > k)
        out.append((smaller, capacity // smaller))
        left -= capacity // smaller
    return out


def _pieces(path: str, capacity: int, end: int, names: list[str]):
    """``names``: the columns after the text, which every piece of a document repeats."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("cls", pa.int32()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path)
        stop = np.array([end], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids, *more in zip(b.column(0).to_pylist(), codes.encode(b.column(1).to_pylist()), *[c.to_pylist() for c in b.columns[2:]], strict=True):
                ids += stop
                n, at = len(ids) // 4, 0
                for k, length in cut(n, capacity):
                    rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, k, *more))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, order: str = "doc_id") -> DataFrame:
    """Pack every document into sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    A null or empty text is its end id alone; a very long one is cut into as many pieces as it needs. Null ids are kept and come first;
    documents with one id are packed each for itself, in a fixed order. An empty table
    gives an empty result; other columns are ignored. Bins are filled per class by the rank of a piece in its class,
    in the ``order`` of an integer column (null first), then of doc_id; all bins but the last of each class hold their fixed count.
    """
    text_batches(docs.sparkSession)
    path = path or tokenizer_path()
    rank = [] if order == "doc_id" else ["_rank"]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(order).cast("long").alias(r) for r in rank])
    pieces = stored(read.mapInArrow(_pieces(path, capacity, end, rank), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int" + "".join(f", {r} long" for r in rank)), "pieces")
    key, *ties = [*rank, "doc_id", "start", "doc_tokens", "ids_crc32"]
    ranked = gapless(pieces, ["cls"], key, [F.col(c) for c in ties], "n").withColumn("bin", F.floor(F.col("n") / F.col("cls")).cast("long"))
    inside = Window.partitionBy("cls", "bin").orderBy("n")
    whole = Window.partitionBy("cls", "bin")
    filled = F.sum("length").over(whole)
    return ranked.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        # Class numbers are below 2**7; a bin's number and class make its id.
        (F.col("bin") * 128 + F.col("cls")).cast("long").alias("sequence_id"),
        (F.sum("length").over(inside) - F.col("length")).cast("long").alias("offset"),
        F.when(filled.isin([1 << i for i in range(12) if 1 << i <= capacity]), filled).otherwise(F.lit(capacity)).cast("long").alias("padded"),
    )
