"""Operator 13: token ids as Arrow files of equal-length sequences.

Documents are dealt to tasks by ranges of their id and encoded there in order.
A task cuts its run of ids into sequences of ``length`` and writes them in
Arrow's file form, whose footer lists the batches: ``input_ids`` and
``attention_mask`` are fixed-size lists without nulls, so that each batch is two
plain buffers and any sequence a slice of them, read without copying from a
memory-mapped file (``SequenceFile``). Ids are 16 bits wide where the vocabulary
allows, masks one bit. A file ends with a document, and only its last sequence is padded (mask 0).

Beside ``x.arrow`` stands ``x.docs.arrow``: (doc_id, first, n_tokens), where each
document's ids begin in the file and how many there are. The end id also occurs
in texts, so it can't tell documents apart.

``write`` returns a manifest, one row per file, staged by Spark: it names the
files of the attempts that were kept, and those that lost executors or repeated
attempts left behind are never read. Files go to the shared folder through
``pyarrow.fs``, which takes mounted paths as well as ``hdfs://`` or ``s3://``.

Whole texts are encoded in slices that end at a space, in which the tokenizer
never joins words; a task keeps the ids of words it has met, ``CACHE`` at most.

Defined results: null and empty texts have the end id alone; a null id is written
first; rows of one id follow in an order of their texts, repeated rows in any,
and each is a document; very long texts are encoded slice by slice; an empty
table gives no file and no row; other columns are ignored, whatever their names.
Strings of added tokens in a text get the ids that the library gives them.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import arrow_limits, documents, stage
from ledgerline.operators.sequence import MAX_PARTITIONS, scanned_bytes, staging_folder

LENGTH = 2048
END = 1
BATCH = 64                 # sequences of a record batch
FILE_TOKENS = 1 << 24      # a file takes no further document from here on
TASK_BYTES = 64 << 20      # scanned bytes for each task
SLICE = 1 << 20            # bytes of text encoded at a time
CACHE = 600_000            # words whose ids a task keeps

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# words of printable ASCII and the letters of Latin-1: no normal form or mark changes them
_PLAIN = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
# pieces of such a word in lower case, as the tokenizer's file splits it
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


def byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible
    ones of Latin-1 for themselves, the others from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of words as packed bytes, found as they are asked for. Plain words go
    straight to the library's BPE model, piece by piece; all others through its
    whole encoder."""

    def __init__(self, tokenizer, code: str, limit: int):
        self.tokenizer, self.model, self.code, self.limit = tokenizer, tokenizer.model, code, limit
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.characters = byte_characters()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECE.findall(text.lower())])
        else:
            ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.characters[b] for b in piece.encode()])
        ids = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids


class WordEncoder:
    """Ids of texts by a word-level BPE of the tokenizers library, as packed
    little-endian bytes."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.words = Words(tokenizer, self.code, cache)

    def ids(self, text: bytes) -> Iterator[bytes]:
        """The ids of a whole text, slice by slice."""
        at = 0
        while at < len(text):
            gap = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = gap.start() if gap else len(text)
            yield b"".join(map(self.words.__getitem__, text[at:end].split()))  # of bytes: at ASCII spaces only
            at = end


def file_schema(length: int, width: int) -> pa.Schema:
    ids = pa.uint16() if width == 2 else pa.uint32()
    fixed = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
    return pa.schema([pa.field("input_ids", fixed(ids), nullable=False),
                      pa.field("attention_mask", fixed(pa.bool_()), nullable=False)],
                     metadata={"sequence_length": str(length), "batch_sequences": str(BATCH)})


def _open(uri: str, make: bool = False) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))
    if make:
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs, path


class SequenceWriter:
    """One data file and its list of documents."""

    def __init__(self, uri: str, length: int, width: int, key_type: pa.DataType):
        fs, path = _open(uri, make=True)
        self.uri, self.length, self.dtype = uri, length, np.dtype("<u2" if width == 2 else "<u4")
        self.schema = file_schema(length, width)
        self.out = fs.open_output_stream(f"{path}.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.doc_schema = pa.schema([("doc_id", key_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.doc_out = fs.open_output_stream(f"{path}.docs.arrow")
        self.doc_file = pa.ipc.new_file(self.doc_out, self.doc_schema)
        self.docs: list[tuple] = []
        self.buffer: list[bytes] = []
        self.waiting = self.tokens = self.n_docs = 0

    def add(self, key, parts: Iterator[bytes]) -> None:
        first = self.tokens
        for p in parts:
            self.buffer.append(p)
            self.waiting += len(p)
            self.tokens += len(p) // self.dtype.itemsize
            if self.waiting >= self.dtype.itemsize * self.length * BATCH:
                self._flush()
        self.docs.append((key, first, self.tokens - first))
        self.n_docs += 1
        if len(self.docs) >= 1 << 14:
            self._flush_docs()

    def _flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.buffer), self.dtype)
        step = self.length * BATCH
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at:min(whole, at + step)]
            pad = -len(part) % self.length
            mask = np.arange(len(part) + pad) < len(part)
            part = np.concatenate((part, np.zeros(pad, self.dtype)))
            self.file.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type)
                 for v, f in zip((part, mask), self.schema)], schema=self.schema))
        self.buffer = [ids[whole:].tobytes()]
        self.waiting = len(self.buffer[0])

    def _flush_docs(self) -> None:
        if self.docs:
            self.doc_file.write_batch(pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(zip(*self.docs), self.doc_schema)], schema=self.doc_schema))
            self.docs = []

    def close(self) -> tuple[str, int, int]:
        self._flush(last=True)
        self._flush_docs()
        for f in (self.file, self.out, self.doc_file, self.doc_out):
            f.close()
        return self.uri, self.n_docs, self.tokens


class SequenceFile:
    """Random access to the sequences of a file. From a local or mounted path
    the arrays are views of the mapped file; nothing is copied."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        source = (lambda p: pa.memory_map(p)) if local else (lambda p: fs.open_input_file(p))
        self.file = pa.ipc.open_file(source(f"{path}.arrow"))
        self.docs = pa.ipc.open_file(source(f"{path}.docs.arrow"))
        self.length = self.file.schema.field(0).type.list_size
        self.per_batch = int(self.file.schema.metadata[b"batch_sequences"])

    def batch(self, n: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of batch ``n``, a row per sequence, and their masks (Arrow keeps
        bits, which numpy can't view)."""
        b = self.file.get_batch(n)
        return b.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length), b.column(1)

    def sequence(self, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = self.batch(n // self.per_batch)
        at = n % self.per_batch
        return ids[at], mask.flatten().slice(at * self.length, self.length)

    def tokens(self, first: int, count: int) -> Iterator[np.ndarray]:
        """``count`` ids from place ``first`` on, batch by batch."""
        step = self.length * self.per_batch
        while count:
            ids = self.batch(first // step)[0].reshape(-1)[first % step:][:count]
            yield ids
            first, count = first + len(ids), count - len(ids)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          end_id: int = END, tokenizer: str | None = None, partitions: int | None = None,
          file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the documents' ids under ``folder``; the staged manifest:
    ``uri``, ``start`` (ids in all files before), ``n_docs`` and ``n_tokens``."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    n = partitions or min(MAX_PARTITIONS, max(spark.sparkContext.defaultParallelism,
                                              -(-scanned_bytes(rows) // TASK_BYTES)))
    # the last key parts split an id, and then a row, that very many rows have
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    rows = rows.withColumn("row", F.monotonically_increasing_id()) \
               .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, done = WordEncoder(tokenizer), None, []
        end = array(encoder.code, [end_id]).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    out = SequenceWriter(f"{folder}/{part:05d}-{len(done):06d}-{uuid.uuid4().hex}", length,
                                         encoder.width, b.schema.field(0).type)

                def parts(text=text) -> Iterator[bytes]:
                    yield from encoder.ids(text.as_py() or b"")
                    yield end
                out.add(key, parts())
                if out.tokens >= file_tokens:
                    done.append((part, before, *out.close()))
                    before, out = before + done[-1][-1], None
        if out is not None:
            done.append((part, before, *out.close()))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)],
                                  names=["part", "before", "uri", "n_docs", "n_tokens"])

    files = stage(rows.mapInArrow(encode, "part long, before long, uri string, n_docs long, n_tokens long"),
                  "tokens-manifest")
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # MAX_PARTITIONS rows at most
    offsets = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    return files.join(F.broadcast(offsets), "part").select(
        "uri", (F.col("offset") + F.col("before")).alias("start"), "n_docs", "n_tokens")


def read_documents(manifest: DataFrame, key: T.StructField) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``
    and ``ids_crc32`` of its ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([T.StructField("doc_id", key.dataType)] +
                          [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                f = SequenceFile(uri)
                for i in range(f.docs.num_record_batches):
                    docs = f.docs.get_batch(i)
                    sums = []
                    for first, n in zip(docs.column("first").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for ids in f.tokens(first, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    firsts = docs.column("first").to_numpy() + start
                    yield pa.record_batch([docs.column("doc_id"), pa.array(firsts), docs.column("n_tokens"),
                                           pa.array(sums, pa.int64())], names=schema.names)

    spark = manifest.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri", "start").repartition(n, "uri").mapInArrow(read, schema)


def op13_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    manifest = write(docs, f"{staging_folder(spark)}/llm-tokens-{uuid.uuid4().hex}")
    return read_documents(manifest, docs.schema["doc_id"])
