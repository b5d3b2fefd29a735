"""Token ids in independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the ids of a range of documents in ascending doc_id order:

- data frames, each an independent zstandard frame of little-endian unsigned ids of whole
  or partial documents, FRAME_IDS ids at most;
- a skippable frame (magic 0x184D2A50) with the documents: count, doc_ids, validity, ids per document, and its length;
- a skippable frame (magic 0x184D2A5E), the seek table of the public seekable format: for each data
  frame its compressed size, its size and the low 32 bits of the XXH64 of its content, then the
  number of frames, the descriptor byte and the closing magic 0x8F92EAB1.

A reader loads the two tables from the file's end and decompresses only the frames that a
requested document touches, checking each one's checksum.

Scale: texts are range-partitioned by doc_id once and encoded where they are written, so a task
holds one frame and one Arrow batch; files grow beyond FILE_BYTES where there would be more than FILES of them. On file systems that rename, a file is written
under a task's own name and renamed when whole; in an object store it appears under its name when its upload ends. Either
way a retried task replaces it. Files' starts are prefix sums over the manifest, a table of one row a file.

Encoding uses the tokenizers library; as no token of this vocabulary spans white space, a piece
between white space is encoded once a worker and remembered, in a bounded table.

Defined results: null text counts as empty and has the end id alone; null doc_ids come first;
rows that share a doc_id are separate documents next to each other; an empty table writes no file
and gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import KEPT, column_of, delete_at_exit, shared_path, ship, sum_before, written
from loomline.llm.token_count import WHITE, byte_symbols, tokenizer_path

END_ID = 2
#: Ids in a frame at most (256 KB of 16-bit ids).
FRAME_IDS = 131_072
#: Bytes of text a file gets about.
FILE_BYTES = 32 << 20
#: Files at most.
FILES = 50_000
#: Pieces whose ids a worker remembers; later ones are encoded anew.
REMEMBERED = 300_000
_SKIP, _SEEK, _TAIL = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


#: Latin letters of one lower-case character each, without the two signs among them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_CUT_WORDS = rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"
#: What a text that is lower-cased may have beyond ASCII: characters whose lower case the cut knows as well.
_LOWERED = "".join(c for c in map(chr, (*range(0xC0, 0x130), *range(0x131, 0x250))) if re.fullmatch(f"[{_LETTERS}\u00d7\u00f7]", c.lower()))
_CUT_SPACED = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"


# The normalizers and pre-tokenizers that the cuts stand for, as the files have them.
_SPACED_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Pieces(dict):
    """Ids of pieces; a missing one is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = self.encode(piece)
        if len(self) < REMEMBERED and len(piece) <= 32:
            self[piece] = got
        return got


class PieceEncoder:
    """encode(text) -> bytes of 16- or 32-bit ids, by the tokenizers library, a piece at a time.

    A text of ASCII and Latin letters is cut as the tokenizer's own pattern cuts it, and pieces go to the
    library's model. Any other text is cut between characters and white space that follows them,
    which no token spans, and its pieces go through the whole tokenizer.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65_536 else np.dtype("<u4")
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{code}").pack for n in range(64)]
        self.code = code
        self.simple = re.compile("[\t\n\r -~\u00c0-\u012f\u0131-\u024f]*" if keep_space else f"[\t\n\r -~{_LOWERED}]*")
        self.cut = re.compile(_CUT_SPACED if keep_space else _CUT_WORDS).findall
        self.general = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+" if keep_space else f"[^{WHITE}]+").findall
        self.symbols = byte_symbols()
        self.space = self.symbols[32]
        self.keep_space = keep_space
        spec = json.loads(self.tokenizer.to_str())
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)).search if special else lambda _: None
        # a file whose rules are others than those that the cuts stand for is left to the library alone
        self.known_rules = all(spec[k] == v for k, v in (_SPACED_RULES if keep_space else _WORD_RULES).items())
        self.by_model, self.by_tokenizer = _Pieces(self._model), _Pieces(self._tokenizer)

    def _packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _model(self, piece: str) -> bytes:
        if piece.isascii() and (word := piece[piece[0] == " " :]).isalnum():
            shown = piece if word is piece else self.space + word
        else:
            shown = "".join([self.symbols[b] for b in piece.encode("utf-8")])
        return self._packed([t.id for t in self.model.tokenize(shown)])

    def _tokenizer(self, piece: str) -> bytes:
        return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.known_rules:
            return self._tokenizer(text)
        if not self.special(text) and self.simple.fullmatch(text):  # special tokens are the tokenizer's to find
            known, pieces = self.by_model, self.cut(text if self.keep_space else text.lower())
        else:
            known, pieces = self.by_tokenizer, self.general(text)
        return b"".join([known[p] for p in pieces])


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    key = ("encoder", path, keep_space)
    if key not in KEPT:
        KEPT[key] = PieceEncoder(path, keep_space)
    return KEPT[key]


#: Hadoop's names of schemes that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def known_uri(uri: str) -> str:
    """uri with the scheme that pyarrow knows."""
    scheme, colon, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if colon else uri


def filesystem(uri: str):
    """pyarrow's file system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(known_uri(uri)) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class SeekableWriter:
    """Writes documents to one file; close() ends it with the tables and moves it into place."""

    def __init__(self, uri: str, dtype: np.dtype, frame_ids: int = FRAME_IDS):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        # an object store shows a file when its upload ends, and has no rename
        self.part = self.path if self.fs.type_name in ("s3", "gcs", "abfs") else f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.dtype, self.frame_bytes = dtype, frame_ids * dtype.itemsize
        self.codec = zstandard.ZstdCompressor(level=1, write_checksum=False)
        self.held, self.held_bytes = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.valid: list[bool] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.valid.append(doc_id is not None)
        self.counts.append(len(data) // self.dtype.itemsize)
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            data = b"".join(self.held)
            whole = len(data) - len(data) % self.frame_bytes
            for i in range(0, whole, self.frame_bytes):
                self._frame(data[i : i + self.frame_bytes])
            self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = self.codec.compress(data)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> int:
        """Number of ids written."""
        if self.held_bytes:
            self._frame(b"".join(self.held))
        index = struct.pack("<QB", len(self.ids), self.dtype.itemsize) + np.array(self.ids, "<i8").tobytes() + np.array(self.valid, np.uint8).tobytes() + np.array(self.counts, "<i8").tobytes()
        packed = self.codec.compress(index)
        # its own length closes the frame, so that a reader finds its begin from the seek table
        self.out.write(struct.pack("<II", _SKIP, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _TAIL)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)
        self.out.close()
        if self.part != self.path:
            self.fs.move(self.part, self.path)
        return sum(self.counts)


class SeekableReader:
    """Reads documents of one file; only the frames that they touch are decompressed."""

    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n_frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _TAIL or descriptor != 0x80:
            raise ValueError(f"{uri} has no seek table")
        table_bytes = 12 * n_frames + 9
        table = self.file.read_at(12 * n_frames, size - table_bytes)
        sizes = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = sizes[:, 2]
        self.at = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.begin = np.concatenate([[0], np.cumsum(sizes[:, 1])])
        self.codec = zstandard.ZstdDecompressor()
        end = size - table_bytes - 8
        n_index = struct.unpack("<I", self.file.read_at(4, end - 4))[0]
        index = self.codec.decompress(self.file.read_at(n_index, end - 4 - n_index))
        n, itemsize = struct.unpack_from("<QB", index)
        self.dtype = np.dtype("<u2") if itemsize == 2 else np.dtype("<u4")
        self.ids = np.frombuffer(index, "<i8", n, 9)
        self.valid = np.frombuffer(index, np.uint8, n, 9 + 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<i8", n, 9 + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self._last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = self.codec.decompress(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._last = (k, data)
            self.frames_read += 1
        return self._last[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        a, b = (int(self.starts[i + d]) * self.dtype.itemsize for d in (0, 1))
        if a == b:
            return np.zeros(0, self.dtype)
        first, last = (int(np.searchsorted(self.begin, x, "right")) - 1 for x in (a, b - 1))
        data = b"".join(self.frame(k) for k in range(first, last + 1))
        return np.frombuffer(data[a - int(self.begin[first]) : b - int(self.begin[first])], self.dtype)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id."""
        nulls = int((~self.valid).sum())
        lo, hi = (int(np.searchsorted(self.ids[nulls:], doc_id, side)) + nulls for side in ("left", "right"))
        return list(range(lo, hi))

    def close(self) -> None:
        self.file.close()


def write_batches(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc = encoder(path, keep_space=False)
    end = np.array([end_id], enc.dtype).tobytes()
    part = TaskContext.get().partitionId()
    writer = None
    for batch in batches:
        writer = writer or SeekableWriter(f"{folder}/part-{part:06d}.zst", enc.dtype)
        for doc_id, text in zip(column_of(batch, "doc_id"), column_of(batch, "text"), strict=True):
            writer.add(doc_id.as_py(), enc.encode(text.as_py() or "") + end)
    if writer:
        n = writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/part-{part:06d}.zst"], "n_ids": [n]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64())]))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, name: str = "word_bpe_49k.json", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs as token files into folder, a URI that all executors share; the manifest: file, part, start (ids before it), n_ids."""
    ship(docs.sparkSession)
    path = path or tokenizer_path(name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(min(FILES, max(1, -(-total // file_bytes))), "doc_id").sortWithinPartitions("doc_id")
    found = written(dealt.mapInArrow(lambda it: write_batches(it, folder, path, end_id), "part long, file string, n_ids long"), "manifest")
    return sum_before(found, "part", "n_ids", "start").select("file", "part", "start", "n_ids")


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(column_of(batch, "file").to_pylist(), column_of(batch, "start").to_pylist(), strict=True):
            reader = SeekableReader(uri)
            for a in range(0, len(reader), 4096):
                b = min(a + 4096, len(reader))
                sums = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(reader.ids[a:b], pa.int64(), mask=~reader.valid[a:b]),
                        "start": pa.array(reader.starts[a:b] + start, pa.int64()),
                        "n_tokens": pa.array(reader.counts[a:b], pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )
            reader.close()


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row a document of the files of a manifest: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    dealt = files.select("file", "start").repartitionByRange(max(1, files.count()), "start")
    return dealt.mapInArrow(read_batches, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    delete_at_exit(spark, folder)
    return read_tokens(spark, files)


QUERIES = {"op4_token_files": op4_token_files}
SQL: dict[str, str] = {}
