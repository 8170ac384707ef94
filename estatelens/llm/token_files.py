"""Token-id output: documents as one concatenated id array per file, their boundaries in Elias-Fano form with select.

File format (little-endian; offsets follow from the header): magic ``ELTK``, version and id width as bytes, two zero bytes; documents, ids,
documents with a null id, smallest document id, and the byte lengths of the two Elias-Fano sections as 64-bit numbers; the section of
boundaries (documents + 1 values), the section of document ids (as distances from the smallest), the id array.  A section holds its number of
values, its upper bound and low bits a value as 64-bit numbers, the packed low bits, the unary high bits and, for select, the position of every
64th set bit as 32-bit numbers: about 2 + log2(ids a document) bits a document instead of a 64-bit table.

A writing task gives each file a name of its own and returns it; only files in the written manifest count, so a task that runs again after a lost
executor leaves at most a stray file.  Files are opened with ``pyarrow.fs``.

Defined results: null counts as empty text, which holds the end id alone; documents come in ascending id order, null ids first, those with equal
ids in the order of reading; an empty table gives an empty one; columns other than the named two are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.bpe import GAPS, ODD_SPACE, TOKENIZER
from estatelens.llm.common import settle, shared_path, slices

END_ID = 2
#: A file is closed when its ids take this many bytes.
FILE_BYTES = 32 * 1024 * 1024
#: Entries of each of a worker's tables of encoded pieces.
REMEMBERED = 400_000
#: bpe.SIMPLE with names, for Arrow.
LETTERS_SIGNS = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*)(?P<signs>[!-&(-/:;=-@\[-`{-~]*)$"
#: Texts whose ids are made together.
TOGETHER = 2_000
SAMPLE = 64
HEAD = struct.Struct("<4sBBHQQQqQQ")
MANIFEST = "part int, number int, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of numbers below 2**56 with select."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.marks = n, bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) + 1, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: its high part from the unary bits, starting at the nearest mark, its low part from the packed bits."""
        mark = int(self.marks[i // SAMPLE])
        left, byte = i % SAMPLE, mark // 8
        if left == 0:
            at = mark
        else:
            left += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: mark % 8].sum()) + 1
            width = 64
            while True:
                ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little"))
                if len(ones) >= left:
                    at = byte * 8 + int(ones[left - 1])
                    break
                left, byte = left - len(ones), byte + width
        value = (at - i) << self.bits
        if self.bits:
            first = i * self.bits
            piece = np.unpackbits(self.low[first // 8 : (first + self.bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.bits]
            value |= int(piece.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64)))
        return value

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, high = struct.unpack_from("<QQQQ", data)
        at = 32
        return cls(n, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", -1, at + low + high))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def local_uri(path: str) -> str:
    """``file:/x``, as Spark writes it, as a URI that pyarrow takes."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class IdWriter:
    """Collects the documents of one file and writes them; memory is bounded by FILE_BYTES and one document."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width
        self.begin()

    def begin(self) -> None:
        self.ids: list[bytes] = []
        self.docs: list[int | None] = []
        self.ends, self.size = [0], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(ids)
        self.docs.append(doc_id)
        self.size += len(ids)
        self.ends.append(self.size // self.width)

    def close(self) -> tuple[str, int, int]:
        nulls = sum(d is None for d in self.docs)
        known = np.array([d for d in self.docs if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        bounds, docs = EliasFano.of(np.array(self.ends)).to_bytes(), EliasFano.of(known - least).to_bytes()
        path = f"{self.folder}/{uuid.uuid4().hex}.eltk"
        system, place = opened(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        with system.open_output_stream(place) as out:
            out.write(HEAD.pack(b"ELTK", 1, self.width, 0, len(self.docs), self.ends[-1], nulls, least, len(bounds), len(docs)))
            out.write(bounds)
            out.write(docs)
            for ids in self.ids:
                out.write(ids)
        made = path, len(self.docs), self.ends[-1]
        self.begin()
        return made


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, its first id's place in the file, its ids) in the file's order."""
    system, place = opened(path)
    with system.open_input_stream(place) as f:
        data = f.read()
    _, _, width, _, n_docs, n_ids, nulls, least, bounds_size, docs_size = HEAD.unpack_from(data)
    bounds = EliasFano.from_bytes(data[HEAD.size : HEAD.size + bounds_size])
    docs = EliasFano.from_bytes(data[HEAD.size + bounds_size : HEAD.size + bounds_size + docs_size])
    ids = np.frombuffer(data, f"<u{width}", n_ids, HEAD.size + bounds_size + docs_size)
    begin = bounds.select(0)
    for i in range(n_docs):
        end = bounds.select(i + 1)
        yield None if i < nulls else least + docs.select(i - nulls), begin, ids[begin:end]
        begin = end


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


class Known:
    """Texts and their ids, in columns: looking many up at once makes no Python objects."""

    def __init__(self, kind: str):
        self.texts, self.pool = pa.array([], pa.string()), np.zeros(0, kind)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, texts: pa.Array) -> np.ndarray:
        """Each text's place, -1 where it isn't known."""
        return pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False)

    def add(self, texts: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.texts = pa.concat_arrays([self.texts, texts])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids.astype(self.pool.dtype)])

    def keep(self, at: np.ndarray) -> None:
        """Only the texts at those places stay."""
        self.pool = gathered(self.pool, self.starts[at], self.sizes[at])
        self.texts, self.sizes = self.texts.take(pa.array(at)), self.sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes


class Pieces:
    """Ids of texts as bytes, from the tokenizers library.  No token reaches over white space, so each distinct piece between is encoded once and remembered;
    of a simple piece (bpe.SIMPLE) neither do they reach from its letters, which count in lower case, to its signs, so these are what the library gets.

    When more than ``remembered`` are known, those of the present texts stay.
    """

    def __init__(self, path: str, width: int, remembered: int = REMEMBERED):
        self.library, self.kind, self.remembered = library(path), f"<u{width}", remembered
        self.pieces, self.parts = Known(self.kind), Known(self.kind)

    def _learn(self, known: Known, texts: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of distinct ``texts`` in ``known``, to which those that it lacks are added."""
        missing = texts.filter(pa.array(known.find(texts) < 0))
        if len(missing):
            known.add(missing, *make(missing))
        at = known.find(texts)
        if len(known.texts) > self.remembered:
            known.keep(at)
            at = np.arange(len(at))
        return at

    def _by_library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return sizes, np.fromiter(chain.from_iterable(made), self.kind, int(sizes.sum()))

    def _by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.extract_regex(texts, pattern=LETTERS_SIGNS)
        letters = pc.if_else(pc.is_valid(cut), pc.utf8_lower(pc.struct_field(cut, "letters")), texts)
        coded = pa.concat_arrays([letters, pc.fill_null(pc.struct_field(cut, "signs"), "")]).dictionary_encode()
        places = self._learn(self.parts, coded.dictionary, self._by_library)[coded.indices.to_numpy()].reshape(2, -1)
        sizes = self.parts.sizes[places]
        return sizes.sum(axis=0), gathered(self.parts.pool, self.parts.starts[places.T.ravel()], sizes.T.ravel())

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [GAPS.split(x) if ODD_SPACE.search(x) else x.split() for x in texts]
        coded = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        places = self._learn(self.pieces, coded.dictionary, self._by_parts)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.pieces.sizes[places]
        line = gathered(self.pieces.pool, self.pieces.starts[places], sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(c) for c in cut])])]
        return [line[a:b].tobytes() for a, b in pairwise(bounds.tolist())]


@lru_cache(maxsize=1)
def pieces_of(path: str, width: int) -> Pieces:
    """A worker's table, kept from task to task."""
    return Pieces(path, width)


def write_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes all documents in ascending id order; returns the written manifest of files (MANIFEST).

    Range partitions keep the order over tasks.  The place of reading joins the key, so one id with a third of all rows is dealt out too.
    """
    file, folder = path or public_tokenizers.path(TOKENIZER), local_uri(shared_path(docs.sparkSession, "tokens"))
    width = 2 if library(file).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, writer, made = pieces_of(file, width), IdWriter(folder, width), []
        last = int(end_id).to_bytes(width, "little")
        for batch in slices(batches, "text"):
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), pieces.encode(texts), strict=True):
                    writer.add(doc_id, ids + last)
                    if writer.size >= FILE_BYTES:
                        made.append(writer.close())
        if writer.docs:
            made.append(writer.close())
        n, number = len(made), TaskContext.get().partitionId()
        paths, n_docs, n_tokens = zip(*made, strict=True) if made else ((), (), ())
        columns = [pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(paths, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_tokens, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "number", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_place"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "_place").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_place")
    return settle(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """READ for every document, from the files: place of its first id among all, number and CRC-32 of its ids as 32-bit numbers."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = parts.select("part", (F.sum("_size").over(Window.orderBy("part")) - F.col("_size")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    placed = manifest.withColumn("_within", within).join(before, "part").select("path", (F.col("_before") + F.col("_within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in read_file(path)]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))
    return placed.repartition(n, "path").mapInArrow(run, READ)
