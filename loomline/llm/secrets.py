"""Secret scan: keyed patterns, and a randomness test battery with length-aware false-discovery control.

The base patterns give spans of kinds assign, access and hex. The method adds spans of kind random.
A candidate is a run of 20 or more token characters, with its padding, that has digits and letters; ``=`` ends a name, so
the value of a pair is a run of its own. As ``/``, ``-`` and ``_`` may be symbols of an encoding or marks between words, a run
is tested whole and in its parts, and its best part stands for it (p times the number of parts). The encoding of a
part is inferred as the narrowest alphabet that holds it (hex, base32, letters and digits, base64), and three tests are
taken over the symbols of that alphabet:

- chi-squared uniformity. Null: the symbols come as unevenly as the corpus's own letters and digits do (measured over all
  texts; chi-squared is then noncentral, so the test is sharper the longer the string). p_uniform is the
  chance of such a string to look so even;
- runs above and below the middle of the alphabet, and lag-one serial correlation. Null: the symbols come in random order. p_order is
  twice the smaller of the two p-values, 1 at most, and small for counters and other sequences.

The combined p-value is p_uniform / p_order, 1 at most. It is never below p_uniform, so it holds under the first null, and no
string leaves the family: what looks ordered gets a large p. P-values go to strata by encoding and length. In each stratum the
Benjamini-Hochberg rule at rate FDR over all candidates of the corpus sets the threshold, found from a histogram of bounded size.

Scale: a map over the scan finds spans and candidates' statistics (whole texts, no shuffle of texts); the driver
sees 256 counts of bytes and STRATA x BINS counts; the table between holds ids, spans and statistics alone.

Defined results: a null text counts as empty and has no span; rows that repeat are rows of their
own; spans are ordered by start, then by kind; random spans that touch a base span are left out; an
empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import column_of, ship, text_slices, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: What may lie between the parts of a run.
MARKS = ("/", "/_-")
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
LENGTHS = (20, 28, 40, 64, 128)
STRATA = len(ALPHABETS) * len(LENGTHS)
BINS = 400
FDR = 0.01
#: Sum of squared frequencies of letters and digits, where no corpus is at hand to measure it.
REPEAT = 0.06


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def statistics(text: str) -> tuple[int, int, int, float] | None:
    """(alphabet, symbols, sum of their squared counts, p_order); None where text has no digit, no letter, no known alphabet or is short."""
    body = text.rstrip("=")
    n = len(body)
    if n < LENGTHS[0] or not any(map(str.isdigit, body)) or not any(map(str.isalpha, body)):
        return None
    held = set(body)
    kind = next((k for k, (_, a) in enumerate(ALPHABETS) if held <= set(a)), None)
    if kind is None:
        return None
    alphabet = ALPHABETS[kind][1]
    at = np.array([alphabet.index(c) for c in body])
    counts = np.bincount(at)
    above = at >= len(alphabet) / 2
    n1 = int(above.sum())
    n0 = n - n1
    p_runs = 0.0
    if n1 and n0:
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(max(var, 1e-9)))
    d = at - at.mean()
    r = float((d[1:] * d[:-1]).sum() / max(float((d * d).sum()), 1e-9))
    p_serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    return kind, n, int((counts * counts).sum()), min(1.0, 2 * min(p_runs, p_serial))


def combined(kind: int, n: int, squares: int, p_order: float, repeat: float) -> float:
    """The combined p-value; it can't be sharper than its normal approximation."""
    size = len(ALPHABETS[kind][1])
    chi = squares * size / n - n
    shift = n * max(0.5, size * repeat - 1)
    p_uniform = max(_upper(-(chi - (size - 1) - shift) / math.sqrt(2 * (size - 1 + 2 * shift))), 1e-12)
    return min(1.0, p_uniform / max(p_order, 1e-300))


def stratum(kind: int, n: int) -> int:
    return kind * len(LENGTHS) + max(i for i, x in enumerate(LENGTHS) if n >= x)


def battery(text: str, repeat: float = REPEAT) -> tuple[int, float] | None:
    """(stratum, p-value) of a string; None where it isn't a candidate."""
    found = statistics(text)
    return None if found is None else (stratum(*found[:2]), combined(*found, repeat))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def parts(run: str) -> list[tuple[int, int]]:
    """(begin, end) of a run and of its parts between marks that are long enough."""
    out = {(0, len(run))}
    for marks in MARKS:
        out |= {m.span() for m in re.finditer(f"[^{marks}]{{{LENGTHS[0]},}}", run)}
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(run, parts tested, start, end, alphabet, symbols, squares, p_order) of the parts of runs that touch no base span."""
    out = []
    for k, m in enumerate(CANDIDATE.finditer(text)):
        a = m.start()
        if any(x < m.end() and a < y for x, _, y in base):
            continue
        found = [(a + i, a + j, *got) for i, j in parts(m.group()) if (got := statistics(m.group()[i:j])) is not None]
        out += [(k, len(found), *x) for x in found]
    return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _bin(p: float) -> int:
    """Bins are even in log p from 1e-12 to 1."""
    return min(BINS - 1, int((math.log10(p) + 12) / 12 * BINS))


_PARTS = "struct<run:int,tested:int,start:int,end:int,kind:int,n:int,squares:int,p_order:double>"
_PARTS_TYPE = pa.list_(pa.struct([(c, pa.int32()) for c in ("run", "tested", "start", "end", "kind", "n", "squares")] + [("p_order", pa.float64())]))
_FOUND = f"doc_id long, base string, found array<{_PARTS}>, bytes array<long>"
_LETTERS = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, candidates, and on the first row of a batch how often each byte comes in it."""
    names = _PARTS_TYPE.value_type.names
    for batch in batches:
        base, found = [], []
        for text in column_of(batch, "text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append(_shown(spans))
            found.append([dict(zip(names, x, strict=True)) for x in candidates(text, spans)])
        raw, begin, end = text_slices(column_of(batch, "text"))
        held = raw[int(begin[0]) : int(end[-1])] if len(begin) else raw
        counts = pa.array([np.bincount(held, minlength=256).tolist()] * bool(len(base)) + [None] * (len(base) - 1), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(base, pa.string()), pa.array(found, _PARTS_TYPE), counts], ["doc_id", "base", "found", "bytes"])


def measured_repeat(counts: dict[int, int]) -> float:
    """Sum of squared frequencies of the ASCII letters and digits among counts by byte."""
    n = np.array([counts.get(b, 0) for b in range(128) if _LETTERS[b]], float)
    return float(((n / n.sum()) ** 2).sum()) if n.sum() else REPEAT


def best_parts(found: list[dict], repeat: float) -> list[tuple[int, int, int, int]]:
    """Of each run (start, end, stratum, bin) of its part with the smallest p-value."""
    out: dict[int, tuple] = {}
    for x in found:
        p = min(1.0, x["tested"] * combined(x["kind"], x["n"], x["squares"], x["p_order"], repeat))
        key = (p, -x["n"], x["start"])
        if x["run"] not in out or key < out[x["run"]][0]:
            out[x["run"]] = (key, (x["start"], x["end"], stratum(x["kind"], x["n"]), _bin(p)))
    return [row for _, row in out.values()]


def bin_batches(batches: Iterator[pa.RecordBatch], repeat: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [x[2:] for found in column_of(batch, "found").to_pylist() for x in best_parts(found, repeat)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in best], pa.int32()) for i in range(2)], ["stratum", "bin"])


def thresholds(counts: dict[tuple[int, int], int], rate: float = FDR) -> list[int]:
    """For each stratum the last bin that the Benjamini-Hochberg rule discovers, -1 if none."""
    out = []
    for s in range(STRATA):
        n = [counts.get((s, b), 0) for b in range(BINS)]
        total, seen, last = sum(n), 0, -1
        for b, k in enumerate(n):
            seen += k
            if k and 10 ** ((b + 1) / BINS * 12 - 12) <= rate * seen / total:
                last = b
        out.append(last)
    return out


def result_batches(batches: Iterator[pa.RecordBatch], last: list[int], repeat: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sums, shown, n_random = [], [], [], []
        for base, found in zip(column_of(batch, "base").to_pylist(), column_of(batch, "found").to_pylist(), strict=True):
            names = [x.split(":", 1)[0] for x in base.split(",")] if base else []
            counts.append([names.count(k) for k in KINDS[:3]])
            sums.append(hashlib.sha256(base.encode()).hexdigest())
            more = [(a, 3, b) for a, b, s, x in best_parts(found, repeat) if x <= last[s]]
            n_random.append(len(more))
            if more:
                held = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                base = _shown(sorted(held + more))
            shown.append(base)
        n = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [column_of(batch, "doc_id"), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(3)), pa.array(sums, pa.string()), pa.array(shown, pa.string()), pa.array(n_random, pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
        )


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """One row a row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(rows.mapInArrow(scan_batches, _FOUND), "spans")
    bytes_ = found.where("bytes is not null").select(F.posexplode("bytes").alias("byte", "n")).groupBy("byte").agg(F.sum("n"))
    repeat = measured_repeat(dict(map(tuple, bytes_.collect())))
    some = found.where(F.size("found") > 0).select("found")
    pairs = some.mapInArrow(lambda it: bin_batches(it, repeat), "stratum int, bin int").groupBy("stratum", "bin").count()
    last = thresholds({(r[0], r[1]): r[2] for r in pairs.collect()}, rate)
    return found.select("doc_id", "base", "found").mapInArrow(lambda it: result_batches(it, last, repeat), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_secrets": op1_secrets}
SQL: dict[str, str] = {}
