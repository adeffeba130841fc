"""Operator 6: sum-of-squares online packing of token sequences.

Documents arrive in the order of their partition. A document of ``n`` tokens
(its ids and one end token) fills ``n // window`` windows alone; the rest, of
size ``s``, goes to the fill level that minimises the sum over levels of the
squared number of partially filled windows. With ``count[h]`` windows at level
``h`` (the level array), moving one from ``h`` to ``h + s`` changes the sum by
``2 * (count[h + s] - count[h] + 1)``, completing one by ``1 - 2 * count[h]``
and opening one by ``2 * count[s] + 1``; ties go to the fullest window.

Each partition packs alone, so there is no shuffle and no shared state; a task
that is run again gives the same pieces, as long as its input rows keep their
order (true of a file scan). What is still open at the end of a partition is
laid out again in full windows, cut where one ends: each partition leaves one
padded window at most.

Ids are those of ``byte_bpe_50k.json``. ``tiktoken`` computes them from the
same vocabulary about four times as fast as ``tokenizers``; texts too long for
its regular expression and texts with the string of an added token, which
becomes that token's id, go through ``tokenizers``.

Defined results: a null or empty text is one end token; equal rows are packed
one by one; a null ``doc_id`` stays null; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import arrow_limits, documents

WINDOW = 2048
END = 1
LONG_TEXT = 100_000  # characters; beyond, the linear-time tokenizer is used


class Encoder:
    """``ids(text)`` with a public byte-level BPE vocabulary."""

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        self._json = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=table, special_tokens={})
        with open(self._json, encoding="utf-8") as f:
            self._added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self._slow = None

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT and not any(t in text for t in self._added):
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(self._json)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Sum-of-squares packing of the documents of one partition."""

    def __init__(self, window: int, first_sequence: int, emit):
        self.window, self.next, self.emit = window, first_sequence, emit
        self.count = np.zeros(window + 1, np.int64)  # the level array
        self.open: list[list[list]] = [[] for _ in range(window)]

    def _close(self, pieces: list) -> None:
        offset = 0
        for key, total, start, ids in pieces:
            self.emit(key, start, ids, total, self.next, offset)
            offset += len(ids)
        self.next += 1

    def level_for(self, size: int) -> int:
        """Fill level of the window that takes ``size`` tokens; 0: a new one."""
        room = self.window - size
        count = self.count
        change = 2 * (count[size:size + room + 1] - count[:room + 1] + 1)
        change[room] = 1 - 2 * count[room]
        change[count[:room + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1
        return room - int(np.argmin(change[::-1]))

    def add(self, key, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total // self.window * self.window
        for start in range(0, whole, self.window):
            self._close([(key, total, start, ids[start:start + self.window])])
        if whole < total:
            size = total - whole
            level = self.level_for(size)
            pieces = self.open[level].pop() if level else []
            self.count[level] -= bool(level)
            pieces.append((key, total, whole, ids[whole:]))
            if level + size == self.window:
                self._close(pieces)
            else:
                self.open[level + size].append(pieces)
                self.count[level + size] += 1

    def finish(self) -> None:
        """Lay the open windows' pieces out again, cut at window ends."""
        row, room = [], self.window
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for key, total, start, ids in pieces:
                    while len(ids):
                        part = ids[:room]
                        row.append((key, total, start, part))
                        start, ids, room = start + len(part), ids[len(part):], room - len(part)
                        if not room:
                            self._close(row)
                            row, room = [], self.window
        if row:
            self._close(row)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: the id, ``start`` and ``length`` in the document's
    tokens, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        encoder = Encoder(tokenizer, ranks)
        packer = Packer(window, TaskContext.get().partitionId() << 40,
                        lambda key, start, ids, total, seq, offset: out.append(
                            (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                             total, seq, offset)))
        kind = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(key, np.append(encoder.ids(text or ""), np.uint32(end_id)))
            yield batch()
        if kind is not None:
            packer.finish()
            yield batch()

    return rows.mapInArrow(pieces, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
