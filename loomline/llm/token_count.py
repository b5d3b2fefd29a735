"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at white space (no token of this vocabulary spans any), and each piece is
normalised, split and merged once a worker: a heap yields the lowest-rank adjacent pair, a
doubly linked list of symbols takes the merge, and the count is the initial symbols minus the
merges; no identifier is made. Counts of pieces are remembered in a bounded table, so frequent
words cost one dictionary lookup. It is a map over the scan: no shuffle, and memory bounded by
the Arrow batch and the table.

The rules of the file are those of its normalizer (NFC, white space to a space, lower case
a character at a time), its splitting pattern and its byte symbols with a word-end mark; a special
token's string in a text counts as one token, the library's default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows that repeat are each
counted; an empty table gives an empty table; only doc_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import column_of, ship

#: Characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LIMIT = 2048
#: Pieces whose counts a worker remembers; later pieces are counted anew.
REMEMBERED = 500_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairMerger:
    """Merges the symbols of a word as the file's ranked pairs say."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.pieces = regex.compile(f"[^{WHITE}]+")
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word: its symbols minus the merges made."""
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        n = len(symbols)
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # a neighbour was merged since
            symbols[i] = left + right
            symbols[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get((symbols[i], symbols[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get((symbols[h], symbols[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def _plain(self, piece: str) -> int:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        piece = piece.lower() if piece.isascii() else "".join([c.lower() for c in piece])
        return sum(map(self.merged, self.pattern.findall(piece)))

    def piece(self, piece: str) -> int:
        """Tokens of a run without white space."""
        if self.special is None or not (found := self.special.findall(piece)):
            return self._plain(piece)
        return len(found) + sum(self._plain(x) for x in self.special.split(piece) if x)

    def count(self, text: str) -> int:
        known, total = self.known, 0
        pieces = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.pieces.findall(text)
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            pass
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(known) < REMEMBERED and len(p) <= 64:
                    known[p] = n
            total += n
        return total


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_batches(batches: Iterator[pa.RecordBatch], path: str | None, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    m = merger(path or tokenizer_path(name))
    for batch in batches:
        texts = column_of(batch, "text")
        n_bytes = np.array([x.as_py() or 0 for x in pc.binary_length(texts)], np.int64)
        n = np.array([m.count(x.as_py() or "") for x in texts], np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": column_of(batch, "doc_id"), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit})


def token_counts(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_tokens, over_limit. path is the vocabulary's file on every executor."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: count_batches(it, path, name, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
