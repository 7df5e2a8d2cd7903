"""Bounded-space online packing of token sequences.

Each partition keeps at most `open_windows` windows open. What is left of a document after its whole
windows goes where it fits best; when it fits nowhere, the fullest window is filled up with its
head and emitted, and the rest opens a window. The windows still open at the end of the partitions,
a bounded number of each, are merged in bundles of partitions; a bundle's last tokens go out in
sequences of powers of two. So nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, texts
from .words import buffers

#: The splitting that byte-level BPE files with use_regex stand for (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a run of characters as long as this, of white space or without any, go to the slower library.
_RUN = re.compile(r"(?<!\S)\S{5000}|(?<!\s)\s{500}")
#: Partitions whose open windows are merged together.
BUNDLE = 64
_LEFTOVERS = 1 << 62


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(spec: dict) -> Any | None:
    """A tokenizer file as ranks for the faster library, which gives the same ids; None if the file isn't plain byte-level BPE with merges in the order of ids."""
    import tiktoken

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback"), model.get("ignore_merges"), split.get("add_prefix_space")]
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or any(odd):
        return None
    added, letters, vocab = {x["content"] for x in spec["added_tokens"]}, byte_of_letter(), model["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != list(range(256, 256 + len(made))) or sorted(ranks.values()) != list(range(len(ranks))):
        return None
    return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The ids of texts by a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = ranked(json.load(f))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        plain = self.fast is not None and not any(x in text for x in self.special) and (len(text) < 500 or not _RUN.search(text))
        own = self.fast.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(own, "<u4").tobytes()


class _Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.free, self.windows, self.n = size, open_windows, [], {}, 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        """Whole windows, as lists of pieces."""
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        left = total - at
        if not left:
            return
        k = bisect_left(self.free, (left, -1))
        if k < len(self.free):
            free, w = self.free.pop(k)
            self.windows[w].append((doc_id, at, ids[4 * at :], total))
            if free > left:
                insort(self.free, (free - left, w))
            else:
                yield self.windows.pop(w)
            return
        if len(self.free) == self.most:
            free, w = self.free.pop(0)
            self.windows[w].append((doc_id, at, ids[4 * at : 4 * (at + free)], total))
            yield self.windows.pop(w)
            at, left = at + free, left - free
        self.windows[self.n] = [(doc_id, at, ids[4 * at :], total)]
        insort(self.free, (self.size - left, self.n))
        self.n += 1


_COLUMNS = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("ids", "binary"), ("bundle", "int")]
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
_DDL = ", ".join(f"`{n}` {t}" for n, t in _COLUMNS)


def _rows(sequences: list[tuple[int, list[tuple]]], keep_ids: bool, bundle: int | None = None) -> pa.RecordBatch:
    rows = []
    for sequence, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None, bundle))
            offset += len(ids) // 4
    columns = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])


def _cut(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Pieces in their order, cut into windows; the last tokens into powers of two, largest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    want, window, have = 0, [], 0
    for doc_id, start, ids, total in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            if not window:
                want = size if left >= size else 1 << (left.bit_length() - 1)
            step = min(want - have, n - at)
            window.append((doc_id, start + at, ids[4 * at : 4 * (at + step)], total))
            at, have, left = at + step, have + step, left - step
            if have == want:
                yield window
                window, have = [], 0


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 0, open_windows: int = 64, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence of at most `size` tokens.

    doc_id, start and length (in the document's ids), ids_crc32 (of the ids as little-endian 32-bit
    numbers), doc_tokens, sequence_id, offset (in the sequence), and ids with keep_ids. A document
    is its ids by the tokenizer file, without special tokens, then end_id. Sequences are `size`
    tokens long; the last few of a bundle of BUNDLE partitions have a power of two, when size is one.

    Null, empty text: end_id alone. Null doc_id stays null; rows that repeat a doc_id are packed each
    for itself. An empty table gives no rows; further columns are ignored. A task holds a text's ids
    and its open windows; a bundle at most BUNDLE * open_windows windows.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), _Packer(size, open_windows)
        partition, n, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for lo in range(0, b.num_rows, 500):
                done = []
                for i in range(lo, min(lo + 500, b.num_rows)):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    for window in packer.add(b.column("doc_id")[i].as_py(), encoder.ids(text) + end):
                        done.append((partition << 32 | n, window))
                        n += 1
                yield _rows(done, keep_ids)
        yield _rows([(w, pieces) for w, pieces in packer.windows.items()], True, partition // BUNDLE)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending"), ("doc_id", "ascending")])
        pieces = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        first = _LEFTOVERS | key[0].as_py() << 32
        return pa.Table.from_batches([_rows([(first + k, w) for k, w in enumerate(_cut(pieces, size))], keep_ids)])

    filled = materialize(texts(docs).mapInArrow(fill, _DDL), "packing")
    merged = filled.where("bundle is not null").groupBy("bundle").applyInArrow(merge, _DDL)
    out = filled.where("bundle is null").unionByName(merged).drop("bundle")
    return out if keep_ids else out.drop("ids")
