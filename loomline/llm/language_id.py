"""Language identification by a byte convolutional network trained in numpy.

The network reads a window of WINDOW bytes (A-Z lowered): filters of the widths WIDTHS slide over one-hot
bytes, each filter's largest response (at least 0) is a feature, and a softmax layer gives the languages'
probabilities. It is trained on the driver with Adam on windows of labelled texts; the gradient of
max pooling goes to the winning place alone, so a step touches few weights. Applied, all
windows of a whole text are read: responses are sums of table rows looked up by byte pairs, and
a text's score is the softmax of its windows' mean log-probabilities, weighted by length.

Learning sees text and lang alone, of documents with a lang and crc32(doc_id as text) mod 4 other
than 2, of which a bounded sample is taken: SAMPLE_DOCS documents by hash of doc_id, in even parts of
the languages (what one lacks goes to the others, and each has LEAST_DOCS if so many are labelled).
A document gives up to SAMPLE_WINDOWS windows at even places of its whole text. Predictions see the text alone.

Scale: documents to learn from are counted by language, and the sample is found by a filter on the hash
(bounded rows of each language to the driver whatever the number of partitions), weights are 75 KB, and prediction is a map over the scan with bounded chunks.

Defined results: a text that is null or has no letter gives ``und`` with score 0, as does
every text if no document that may be learned from is labelled; a row without doc_id is not held out and not learned from; rows that
repeat are predicted each; an empty table gives an empty table. Clashing extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import column_of, ship, text_slices

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
SAMPLE_DOCS = 2_000
#: Windows of a document at most, of WINDOW characters each.
SAMPLE_WINDOWS = 4
#: Documents of each language at least, where so many can be learned from.
LEAST_DOCS = 20
EPOCHS = 6
SEED = 5
_CHUNK = 1 << 18
_PAD = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = re.compile("[A-Za-z]")


class ByteNet:
    """Tables (width, place, byte, filter), bias, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.4, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.dense_bias = np.zeros(len(languages), np.float32)

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, winning places) of windows of WINDOW + 3 bytes."""
        parts, places = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            out = t[0][windows[:, :WINDOW]]
            for k in range(1, w):
                out = out + t[k][windows[:, k : k + WINDOW]]
            at = out.argmax(1)
            parts.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
            places.append(at)
        return np.maximum(np.concatenate(parts, 1) + self.bias, 0), np.concatenate(places, 1)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.bias, self.dense, self.dense_bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                x, y = windows[order[i : i + batch]], labels[order[i : i + batch]]
                h, at = self.features(x)
                p = _softmax(h @ self.dense + self.dense_bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.dense.T) * (h > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                for j, w in enumerate(WIDTHS):
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    for k in range(w):
                        bytes_at = np.take_along_axis(x, at[:, cols] + k, 1)
                        np.add.at(grads[j][k], (bytes_at, np.arange(FILTERS)[None]), back[:, cols])
                grads += [back.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def compiled(self) -> CompiledNet:
        return CompiledNet(self)


class CompiledNet:
    """The network with its first places added up by byte pair: a lookup a byte instead of one a place."""

    def __init__(self, net: ByteNet):
        two, three, four = net.tables
        pair = lambda t, k: (t[k][:, None] + t[k + 1][None]).reshape(65_536, FILTERS)
        self.head = np.ascontiguousarray(np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], 1))
        self.third, self.tail = three[2].copy(), np.ascontiguousarray(pair(four, 2))
        self.net = net

    def log_probabilities(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each window of data, whose length is a multiple of WINDOW; texts end at ends, with three bytes of padding at least."""
        ahead = np.concatenate([data, np.full(3, _PAD, np.uint8)])
        code = ahead[:-1].astype(np.int32) << 8 | ahead[1:]
        n = len(data)
        out = np.empty((n // WINDOW, len(WIDTHS) * FILTERS), np.float32)
        step = 64 * WINDOW
        for i in range(0, n, step):
            j = min(i + step, n)
            r = self.head[code[i:j]]
            r[:, FILTERS : 2 * FILTERS] += self.third[ahead[i + 2 : j + 2]]
            r[:, 2 * FILTERS :] += self.tail[code[i + 2 : j + 2]]
            own = ends[(ends > i) & (ends <= j)] - i
            r[own[:, None] - np.arange(1, 4)] = -1e9  # filters there would look into the next text
            out[i // WINDOW : j // WINDOW] = r.reshape(-1, WINDOW, r.shape[1]).max(1)
        h = np.maximum(out + self.net.bias, 0)
        z = h @ self.net.dense + self.net.dense_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _windows(text: str) -> list[np.ndarray]:
    """Training windows of WINDOW + 3 bytes."""
    data = _LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
    out = []
    for i in range(0, len(data), WINDOW):
        w = np.full(WINDOW + 3, _PAD, np.uint8)
        part = data[i : i + WINDOW + 3]
        w[: len(part)] = part
        if i == 0 or len(part) >= WINDOW // 4:
            out.append(w)
    return out


def fit(rows: list[tuple[str, str]], seed: int = SEED) -> ByteNet | None:
    """The network of rows of a passage and its language; None where there is none."""
    rows = [(t, lang) for t, lang in rows if t and lang is not None]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    pairs = [(w, languages.index(lang)) for t, lang in rows for w in _windows(t)]
    net = ByteNet(languages, seed)
    net.train(np.stack([w for w, _ in pairs]), np.array([y for _, y in pairs]), seed=seed)
    return net


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def _scores(net: CompiledNet, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean log-probabilities of each text over all its windows, weighted by their bytes."""
    n = end - begin
    padded = -(-(n + 3) // WINDOW) * WINDOW
    at = np.concatenate([[0], np.cumsum(padded)])
    data = np.full(int(at[-1]), _PAD, np.uint8)
    for a, b, p in zip(begin.tolist(), end.tolist(), at.tolist(), strict=False):
        data[p : p + b - a] = raw[a:b]
    logs = net.log_probabilities(_LOWER[data], at[1:])
    weight = np.full(len(logs), float(WINDOW))
    last = at[1:] // WINDOW - 1
    weight[last] = n - (padded - WINDOW)
    weight = np.maximum(weight, 0)
    sums = np.add.reduceat(logs * weight[:, None], at[:-1] // WINDOW, 0)
    return sums / np.maximum(n, 1)[:, None]


def predict_batches(batches: Iterator[pa.RecordBatch], net: ByteNet | None) -> Iterator[pa.RecordBatch]:
    fast = net.compiled() if net else None
    for batch in batches:
        texts = column_of(batch, "text")
        lettered = np.array([x is not None and has_letter(x) for x in (t.as_py() for t in texts)], bool)
        names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if fast:
            raw, begin, end = text_slices(texts)
            i = 0
            while i < len(begin):
                j = i + 1
                while j < len(begin) and end[j] - begin[i] <= _CHUNK:
                    j += 1
                p = _softmax(_scores(fast, raw, begin[i:j], end[i:j]))
                best = p.argmax(1)
                names[i:j] = np.array(net.languages, object)[best]
                score[i:j] = p[np.arange(j - i), best]
                i = j
        names[~lettered], score[~lettered] = "und", 0.0
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def quotas(counts: dict[str, int], size: int, least: int = LEAST_DOCS) -> dict[str, int]:
    """Documents of each language: even parts of size, what a language lacks going to the others; least each, where it has them."""
    out, left = {}, size
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(least, left // (len(counts) - k)))
        left = max(0, left - out[lang])
    return out


def passages(text, most: int = SAMPLE_WINDOWS):
    """Array of up to most passages of WINDOW characters, from the text's begin to its end at even places."""
    last = F.greatest(F.length(text) - WINDOW, F.lit(0))
    return F.array_distinct(F.array(*[F.substring(text, (F.floor(last * i / max(1, most - 1)) + 1).cast("int"), F.lit(WINDOW)) for i in range(most)]))


def sample(docs: DataFrame, size: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(passage, lang) of about size labelled documents outside the held-out part, more only where languages are so many."""
    doc_id, text, lang = (F.col(c).cast("string") for c in ("doc_id", "text", "lang"))
    rows = docs.where((F.pmod(F.crc32(doc_id), F.lit(4)) != 2) & lang.isNotNull() & (text != ""))
    counts = {r[0]: r[1] for r in rows.groupBy(lang.alias("lang")).count().collect()}
    if not counts:
        return []
    cuts = [(k, q, int(min(1.0, 4.0 * q / counts[k]) * (1 << 40))) for k, q in quotas(counts, size).items()]
    table = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, quota long, cut long"))
    key = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1 << 40))
    drawn = rows.select(key.alias("k"), passages(text).alias("t"), lang.alias("lang")).join(table, "lang").where("k < cut")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "t"))
    chosen = drawn.withColumn("place", place).where("place <= quota").select("k", "t", "lang")
    return [(t, lang) for _, held, lang in sorted(map(tuple, chosen.collect())) for t in held]


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """One row a row of docs: doc_id, held_out, lang_pred, score. Without a network one is trained on a sample of docs."""
    ship(docs.sparkSession)
    net = net or fit(sample(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: predict_batches(it, net), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
