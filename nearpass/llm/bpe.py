"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

Encoding works on whole documents in four steps, with the merges applied to every distinct word once:

1. Each task splits its documents into words (the tokenizer's pre-tokens), chunk by chunk of ``CHUNK_BYTES`` of text, and
   numbers the chunk's distinct words. A document becomes an array of numbers, the chunk's words become dictionary rows.
2. The dictionary rows are shuffled and sorted by word. Equal words meet, so each is encoded once, and the ids go back to every
   chunk that has the word. A word occurs once per chunk, so even the commonest word is no hot key.
3. Chunk numbers join the ids with the documents' arrays, which replaces numbers by ids at their positions.

Only dictionaries and arrays of numbers are shuffled, never one row per word. The documents are read twice (once for the arrays,
once for the dictionaries), so they must be a table or another deterministic read; a sum of hashes in each chunk makes a job fail
rather than join a chunk with another reading's dictionary.

Decoding looks the pieces of ids up in the vocabulary (bounded: one entry per id of the tokenizer, ``MAX_VOCABULARY`` at most).

Null text counts as empty and has no ids. Repeated rows and null ids of documents are kept, one row out for each row in.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from nearpass.llm.common import flat

CHUNK_BYTES = 24 << 20
MAX_VOCABULARY = 1 << 20

#: Fixed value: how byte-level tokenizers of this family cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose class is the same in every Unicode version in use.
SETTLED = r"\x00-\u0557\u0590-\u0880\u0900-\u0c50\u0d00-\u2080\u20a0-\ua7c0\uac00-\ud7ff\uf900-\ufaff\ufe00-\uffff"

#: Characters whose class is plain: ASCII but its four separators, Latin letters, some punctuation.
LATIN = r"\x00-\x1b\x20-\x7f\x85\xa0\xa1\xab\xbb\xbf-\u024f\u2010-\u2027"
_L = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PATTERN = rf" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def tokenizer(spec: str) -> Tokenizer:
    """Tokenizer of a file's content, without truncation and padding."""
    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def special_tokens(spec: str) -> list[str]:
    return [t["content"] for t in json.loads(spec)["added_tokens"]]


class Splitter:
    """Cut text into words; added tokens are words of their own.

    The pattern's letter and number classes depend on the Unicode version. Latin texts (only characters of ``LATIN``) are cut with
    the classes spelled out, texts of scripts in which this module's classes and the library's agree (``SETTLED``) with the pattern,
    the rest by the library's own splitter. That all three agree is held by a test; they differ in speed.
    """

    def __init__(self, specials: list[str]):
        self.latin, self.beyond_latin = re.compile(LATIN_PATTERN).findall, re.compile(f"[^{LATIN}]").search
        self.settled, self.unsettled = regex.compile(PATTERN).findall, regex.compile(f"[^{SETTLED}]").search
        self.exact = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.marks = specials

    def words(self, text: str) -> list[str]:
        if not self.beyond_latin(text):
            return self.latin(text)
        if not self.unsettled(text):
            return self.settled(text)
        return [text[a:b] for _, (a, b) in self.exact(text)]

    def __call__(self, text: str) -> list[str]:
        if not self.marks or not any(m in text for m in self.marks):
            return self.words(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


def _chunks(batches: Iterator[pa.RecordBatch], split: Splitter, limit: int):
    """Chunks of a partition: id, columns but text, an array of word numbers for every row, the words in order of their numbers.

    Words are numbered by their count in the chunk, the commonest first, so that the arrays compress well.
    """
    part, k = TaskContext.get().partitionId(), 0

    def finished():
        count = np.bincount(np.concatenate(arrays), minlength=len(seen))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(seen), np.uint32)
        rank[order] = np.arange(len(seen), dtype=np.uint32)
        words = np.array(list(seen), object)[order].tolist()
        return (part << 32) + k, rows, [rank[a] for a in arrays], words

    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    rows, arrays, size = [], [], 0
    for batch in batches:
        text = batch.column("text")
        done = 0
        for i in range(batch.num_rows):
            value = text[i].as_py() or ""
            arrays.append(np.fromiter(map(seen.__getitem__, split(value)), np.uint32))
            size += len(value)
            if size >= limit:
                rows.append(batch.slice(done, i + 1 - done))
                yield finished()
                seen = defaultdict()
                seen.default_factory = seen.__len__
                rows, arrays, size, k, done = [], [], 0, k + 1, i + 1
        if done < batch.num_rows:
            rows.append(batch.slice(done))
    if arrays:
        yield finished()


def _mark(number: int, word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), number & 0xFFFFFFFF)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, the four planes one after the other, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    spec = read_spec(path)
    specials = special_tokens(spec)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def arrays(batches):
        for chunk, rows, numbers, words in _chunks(batches, Splitter(specials), chunk_bytes):
            check = sum(_mark(i, w) for i, w in enumerate(words)) & (2 ** 63 - 1)
            at = 0
            for b in rows:
                part = numbers[at:at + b.num_rows]
                at += b.num_rows
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n, pa.int64()), pa.array([len(words)] * n, pa.int32()), pa.array([check] * n, pa.int64()), b.column("id"),
                     pa.array([len(a) for a in part], pa.int32()), pa.array([_pack(a) for a in part], pa.binary())],
                    names=["chunk", "n_distinct", "check", "id", "n_words", "numbers"])

    def dictionary(batches):
        for chunk, _, _, words in _chunks(batches, Splitter(specials), chunk_bytes):
            for i in range(0, len(words), 20000):
                part = words[i:i + 20000]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part, pa.string())],
                                                 names=["chunk", "number", "word"])

    def encode_words(batches):
        """Sorted by word: encode when the word changes; pack a batch's ids by chunk."""
        tok, last, ids = tokenizer(spec), None, np.zeros(0, "<u4")
        for b in batches:
            words = b.column("word").to_pylist()
            fresh = [i for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            got = [ids]
            for i in range(0, len(fresh), 2000):
                some = [words[k] for k in fresh[i:i + 2000]]
                e = tok.encode(some, is_pretokenized=True, add_special_tokens=False)
                of = np.fromiter(e.word_ids, np.int64)
                flat_ids = np.array(e.ids, "<u4")
                got += np.split(flat_ids, np.searchsorted(of, np.arange(1, len(some))))
            which = np.zeros(len(words), np.int64)
            which[fresh] = 1
            which = np.cumsum(which)
            chunk = b.column("chunk").to_numpy()
            number = b.column("number").to_numpy()
            marks = np.array([_mark(int(k), w) for k, w in zip(number, words)], np.uint64)
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order])) + 1
            out = []
            for part in np.split(order, edges):
                each = [got[which[k]] for k in part]
                out.append((int(chunk[part[0]]), len(part), int(marks[part].sum() & np.uint64(2 ** 63 - 1)), _pack(number[part].astype(np.uint32)),
                            _pack(np.array([len(a) for a in each], np.uint32)), (joined := np.concatenate(each)).size, _pack(joined)))
            last, ids = words[-1] if words else last, got[which[-1]] if words else ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PACKED.types)], schema=_PACKED)

    def put_together(rows: pa.Table, packs: pa.Table) -> pa.Table:
        n = rows.column("n_distinct")[0].as_py() if rows.num_rows else 0
        lengths, parts, seen, total = np.zeros(n, np.int64), [], 0, 0
        for p in packs.to_pylist():
            at, size = _unpack(p["numbers"], p["n"]), _unpack(p["sizes"], p["n"])
            if len(at) and at.max() >= n:
                raise RuntimeError("documents changed between two readings; store them first")
            lengths[at] = size
            parts.append((at, size, _unpack(p["ids"], p["n_ids"])))
            seen, total = seen + p["n"], total + p["check"]
        if seen != n or any((total - c) & (2 ** 63 - 1) for c in rows.column("check").to_pylist()):
            raise RuntimeError("documents changed between two readings; store them first")
        begin = np.cumsum(lengths) - lengths
        table = np.zeros(int(lengths.sum()), np.int32)
        for at, size, ids in parts:
            table[_spread(begin[at], size)] = ids
        out, offsets = [np.zeros(0, np.int32)], [0]
        for blob, m in zip(rows.column("numbers").to_pylist(), rows.column("n_words").to_pylist()):
            w = _unpack(blob, m)
            out.append(table[_spread(begin[w], lengths[w])])
            offsets.append(offsets[-1] + len(out[-1]))
        return pa.table([rows.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out)))], names=["id", "ids"])

    packed = src.mapInArrow(dictionary, "chunk long, number int, word string").repartition("word").sortWithinPartitions("word").mapInArrow(
        encode_words, "chunk long, n int, check long, numbers binary, sizes binary, n_ids int, ids binary")
    numbered = src.mapInArrow(arrays, f"chunk long, n_distinct int, check long, id {kind}, n_words int, numbers binary")
    joined = numbered.groupBy("chunk").cogroup(packed.groupBy("chunk")).applyInArrow(put_together, f"id {kind}, ids array<int>")
    return joined.withColumnRenamed("id", doc_id)


_PACKED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("check", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()),
                     ("n_ids", pa.int32()), ("ids", pa.binary())])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of ``size`` each, one run after the other."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def pieces(path: str) -> list[str]:
    """The bytes of every id's piece, written as one character per byte; ids without a piece are empty."""
    doc = json.loads(read_spec(path))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the alphabet of byte-level vocabularies: these bytes stand for themselves
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    table = {i: "".join(chr(byte[c]) for c in piece) for piece, i in doc["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode().decode("latin-1") for t in doc["added_tokens"]}
    n = max(table) + 1
    if n > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {n} pieces is above the bound of {MAX_VOCABULARY}")
    return [table.get(i, "") for i in range(n)]


def decoded_bytes(ids: Column, path: str) -> Column:
    """Bytes that an array of ids stands for, as an expression; null stays null, ids outside the vocabulary give nothing."""
    lookup = F.from_json(F.lit(json.dumps(pieces(path))), "array<string>")  # constant: the optimizer turns it into an array once
    text = F.array_join(F.transform(ids, lambda i: F.get(lookup, i)), "")
    return F.encode(text, "ISO-8859-1")


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of the ids; bytes that are not UTF-8 become the replacement character."""
    return encoded.withColumn(text, F.make_valid_utf8(decoded_bytes(F.col(ids), path).cast("string")))
