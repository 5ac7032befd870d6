"""Periodic runs of words by block convolution (operator 11).

A run is a longest stretch of words in which words ``q`` apart are the same, ``q`` being its smallest period, at least twice the
period and ``MIN_LENGTH`` words long. Runs of period q in [2 B - 1, 4 B - 2] are looked for at scale B, a power of two
(periods below 7 at B = 2): the words are cut into blocks of B, and at least one block and its copy q words on lie in the
run. The block's sum of squared differences to every place of the window behind it is zero where it recurs; the sums come
from one correlation per block, an exact number-theoretic transform, all blocks of a scale at a time. Each zero is a
seed (place, distance), checked word by word and extended to both sides as far as words agree.

Word numbers of different documents never agree, so a batch of documents is one sequence, and runs cannot leave
their document. A block is transformed only if its first words recur at all within the reach of the scale.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: Words of documents that are searched together; a longer document is a group of its own.
GROUP_WORDS = 1 << 17
#: Numbers in one batch of transforms.
BATCH_NUMBERS = 1 << 18
#: First words of a block that must recur within reach before it is transformed.
PROBES = 6
PRIME, GENERATOR = 998244353, 3


def _mod(a: np.ndarray) -> np.ndarray:
    return a - a // PRIME * PRIME


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each halving of the transform."""
    out = []
    while size > 1:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        powers = np.ones(1, np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % np.uint64(PRIME)])
        out.append(powers[: size // 2].astype(np.int64))
        size //= 2
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row; the result is in bit-reversed order."""
    rows, size = a.shape
    a = a.reshape(rows, 1, size)
    for powers in _roots(size, False):
        half = a.shape[2] // 2
        low, high = a[:, :, :half], a[:, :, half:]
        a = np.stack([_mod(low + high), _mod((low - high + PRIME) * powers)], axis=2).reshape(rows, -1, half)
    return a.reshape(rows, size)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of :func:`transform`, from bit-reversed order."""
    rows, size = a.shape
    a = a.reshape(rows, size, 1)
    for powers in reversed(_roots(size, True)):
        half = a.shape[2]
        pairs = a.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0], _mod(pairs[:, :, 1] * powers)
        a = np.concatenate([_mod(low + high), _mod(low - high + PRIME)], axis=2)
    return _mod(a.reshape(rows, size) * pow(size, PRIME - 2, PRIME))


def zero_mismatches(x: np.ndarray, at: np.ndarray, block: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in [near, far] at which the blocks of ``x`` that start at ``at`` recur (false ones modulo the prime possible).

    Behind the end of ``x`` lies a word that agrees with none.
    """
    size, reach = 4 * block, far - near + block
    places, distances = [], []
    padded = np.concatenate([_mod(x.astype(np.int64) + 1), np.zeros(far + block, np.int64)])
    for start in range(0, len(at), max(1, BATCH_NUMBERS // size)):
        here = at[start : start + max(1, BATCH_NUMBERS // size)]
        pattern, window = np.zeros((len(here), size), np.int64), np.zeros((len(here), size), np.int64)
        pattern[:, 0] = padded[here]
        pattern[:, size - block + 1 :] = padded[here[:, None] + np.arange(1, block)][:, ::-1]  # reversed: products add up at the distance
        window[:, :reach] = padded[here[:, None] + near + np.arange(reach)]
        products = inverse(_mod(transform(pattern) * transform(window)))[:, : far - near + 1]
        squares = np.cumsum(np.concatenate([np.zeros((len(here), 1), np.int64), _mod(window * window)], axis=1), axis=1)
        own = _mod(pattern * pattern).sum(axis=1, keepdims=True)
        there = squares[:, block : block + far - near + 1] - squares[:, : far - near + 1]
        row, offset = np.nonzero(_mod(own + there + 2 * (PRIME - products)) == 0)
        places.append(here[row])
        distances.append(offset + near)
    return (np.concatenate(places), np.concatenate(distances)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Sequence:
    """Word numbers with the places of each number, for asking whether a word recurs within reach."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.span = 2 * self.n + 2
        self.keys = np.sort(x * self.span + np.arange(self.n))

    def recurs(self, at: np.ndarray, near: int, far: int) -> np.ndarray:
        """Whether the word at each place is found again ``near`` to ``far`` words on."""
        low = self.x[at] * self.span + at + near
        next_key = self.keys[np.minimum(np.searchsorted(self.keys, low), self.n - 1)]
        return (next_key >= low) & (next_key <= low + far - near)

    def agreeing(self, at: int, distance: int, step: int) -> int:
        """How many words from ``at`` on (``step`` 1) or before it (-1) equal the word ``distance`` further, in doubling strides."""
        x, done, stride = self.x, 0, 32
        while True:
            if step > 0:
                a, b = at + done, min(at + done + stride, self.n - distance)
            else:
                a, b = max(at - done - stride, 0), at - done
            if a >= b:
                return done
            differ = x[a:b] != x[a + distance : b + distance]
            if differ.any():
                return done + int(differ.argmax() if step > 0 else differ[::-1].argmax())
            done += b - a
            stride *= 2


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block, nearest and farthest distance of every scale that a run in ``longest`` words can need."""
    block, near = 2, 1
    while 2 * near <= longest and longest >= MIN_LENGTH:
        yield block, near, 4 * block - 2
        block, near = 2 * block, 4 * block - 1


def find_runs(x: np.ndarray, lengths: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of ``x``, by start, then period.

    ``lengths`` are the lengths of the documents that make up ``x``, falling; scales that are too long for a document
    skip it.
    """
    lengths = np.array([len(x)]) if lengths is None else lengths
    ends = np.cumsum(lengths)
    seq = Sequence(x)
    period_of: dict[tuple[int, int], int] = {}
    for block, near, far in scales(int(lengths[0]) if len(lengths) else 0):
        long_enough = int(np.searchsorted(-lengths, -max(MIN_LENGTH, 2 * near), side="right"))
        last = int(ends[long_enough - 1]) - block - near if long_enough else -1
        at = np.arange(0, last + 1, block)
        for offset in range(min(block, PROBES)):
            if len(at):
                at = at[seq.recurs(at + offset, near, far)]
        if len(at):
            _extend(seq, *zero_mismatches(x, at, block, near, far), block, period_of)
    return sorted((s, e - s, q) for (s, e), q in period_of.items())


def _extend(seq: Sequence, places: np.ndarray, distances: np.ndarray, block: int, period_of: dict[tuple[int, int], int]) -> None:
    """Extend the seeds of one scale and enter the runs.

    A seed whose distance is a multiple of the period of a run that holds block and copy leads to that same run.
    """
    open_ = np.ones(len(places), bool)
    by_place = np.argsort(places, kind="stable")
    sorted_places = places[by_place]
    for (s, e), q in period_of.items() if len(places) else ():
        a, b = np.searchsorted(sorted_places, [s, e - block])
        inside = by_place[a:b]
        open_[inside[(distances[inside] % q == 0) & (places[inside] + block + distances[inside] <= e)]] = False
    places, distances = places[open_], distances[open_]
    order = np.lexsort((places, distances))
    places, distances = places[order], distances[order]
    i, total = 0, len(places)
    while i < total:
        at, d = int(places[i]), int(distances[i])
        right = at + seq.agreeing(at, d, 1)
        if right < at + block:  # zero only modulo the prime
            i += 1
            continue
        s = at - seq.agreeing(at, d, -1)
        e = right + d
        if e - s >= max(MIN_LENGTH, 2 * d):
            period_of[s, e] = min(d, period_of.get((s, e), d))
        behind = int(np.searchsorted(distances, d, side="right"))
        i += int(np.searchsorted(places[i:behind], right - block, side="right")) or 1


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the id of every tenth document asks for; a null id asks for none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _groups(texts: list[tuple[object, list[bytes]]]) -> list[list[int]]:
    """Row numbers, longest text first, in groups of at most ``GROUP_WORDS`` words."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k][1]))
    groups, size = [], 0
    for k in order:
        n = len(texts[k][1])
        if not groups or size + n > GROUP_WORDS:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += n
    return groups


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, longest text first."""
    numbers, flat = 0, []
    for words in texts:
        seen: dict[bytes, int] = {}
        flat.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + numbers)
        numbers += len(seen)
    lengths = np.array([len(w) for w in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(np.concatenate(flat) if flat else np.zeros(0, np.int64), lengths)
    owners = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1
    for k, (s, length, q) in zip(owners.tolist(), found):
        out[k].append((s - int(starts[k]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: what lies behind the first period of some run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edges[s + q] += 1
        edges[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def _documents(docs: DataFrame, doc_id: str, text: str, plant: bool, fields: list[tuple[str, str, pa.DataType]], make: Callable[[list[bytes], list[tuple[int, int, int]]], dict]) -> DataFrame:
    """Id and the ``fields`` (name, Spark type, Arrow type) that ``make`` gives for the words and runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0).with_name(doc_id), *[pa.field(name, kind) for name, _, kind in fields]])
            for texts in _portions(batch, plant):
                found: list = [None] * len(texts)
                for group in _groups(texts):
                    for k, runs in zip(group, runs_of([texts[k][1] for k in group])):
                        found[k] = {doc_id: texts[k][0], **make(texts[k][1], runs)}
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("binary")).mapInArrow(run, ", ".join([f"`{doc_id}` {kind}", *[f"{name} {sql}" for name, sql, _ in fields]]))


def _portions(batch: pa.RecordBatch, plant: bool) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Ids and words of a batch, about ``GROUP_WORDS`` words at a time."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        for i, body in zip(part.column(0).to_pylist(), part.column(1)):
            words = (body.as_py() or b"").split()
            held.append((i, planted(words, i) if plant else words))
            size += len(words)
            if size >= GROUP_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def document_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``runs`` (start, length, period; word numbers from 0) and the ``collapsed`` text, its kept words joined by spaces.

    A null or empty text has no words and no runs. Rows are judged one by one, so repeated rows and ids change nothing; an
    empty table gives no rows. Other columns are not read.
    """

    def make(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
        return {"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": b" ".join(collapsed(words, runs)).decode()}

    numbers = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    fields = [("runs", "array<struct<start:bigint,length:bigint,period:bigint>>", numbers), ("collapsed", "string", pa.string())]
    return _documents(docs, doc_id, text, False, fields, make)


def run_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """One row per document: id, ``n_runs``, the longest run (of equal ones the first, then the one of smaller period) as
    ``start, length, period, exponent_milli`` (null without a run), ``runs_sha256`` and ``collapsed_sha256``.

    With ``plant`` every tenth document (by the checksum of its id; a null id never) is given a repetition first.
    Nulls, empty texts, repeated rows and empty tables as in :func:`document_runs`.
    """

    def make(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        return {
            "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        }

    counts = [(c, "long", pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    return _documents(docs, doc_id, text, plant, [*counts, *[(c, "string", pa.string()) for c in ("runs_sha256", "collapsed_sha256")]], make)
