"""Benchmark decontamination by a generalised suffix automaton (operator 13).

Items and documents become words (ASCII letters in lower case, digits, everything beyond ASCII). The automaton of all
items accepts every run of words inside an item. A document is streamed past it word by word; the state and the length of
the longest match that ends at each word are kept. A match of ``WINDOW`` words or more puts these words into an occurrence
of an item window, and the state's ancestor at that length names the items that hold the window. Items with fewer
words are windows of their own and hang on the state of their whole text.

The automaton is built in the executors, for shards of at most about ``SHARD_WORDS`` item words; longer items are cut
into overlapping pieces that keep every window. One shard at a time goes through the driver to all tasks, so what is
broadcast has a bound whatever the size of the benchmark. Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.llm.common import fresh, stored

WINDOW = 10
#: Words of the items in one automaton; it has at most twice as many states and three times as many transitions.
SHARD_WORDS = 1 << 17
PIECE_WORDS = 1 << 12
#: Share of hit words above which a document is dropped rather than cut.
MAX_COVERAGE = 0.5

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    """The words of one UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All runs of words inside the added items; state 0 is the empty run."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[int, list[int]]] = []

    def add(self, item: int, words: list[bytes]) -> None:
        """Add one item (or piece of an item) under the number ``item``."""
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        if ids:
            self.items.append((item, ids))

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        """The state of ``state`` plus ``word`` alone, taken out of ``old`` if that one also holds longer runs."""
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(dict(self.step[old]), self.link[old], self.length[state] + 1)
        self.link[old] = new
        while state >= 0 and self.step[state].get(word) == old:
            self.step[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # an earlier item already holds this run
            return self._split(last, word, self.step[last][word])
        new = self._state({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.step[last][word])
        return new

    def packed(self) -> bytes:
        """The automaton with the items of its windows as plain arrays."""
        n = len(self.step)
        at_window = np.full(n, -1, np.int64)  # ancestor that holds the run of exactly ``window`` words
        short_up = np.full(n, -1, np.int64)  # nearest ancestor, itself included, that ends a short item
        held: list[tuple[int, int]] = []
        shorts: list[tuple[int, int, int]] = []
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                at_window[s] = s if self.length[up] < self.window else at_window[up]
        for item, ids in self.items:
            s = 0
            for w in ids:
                s = self.step[s][w]
                if at_window[s] >= 0:
                    held.append((int(at_window[s]), item))
            if len(ids) < self.window:
                shorts.append((s, len(ids), item))
        ends = {s for s, _, _ in shorts}
        for s in order:
            short_up[s] = s if s in ends else short_up[self.link[s]] if self.link[s] > 0 else -1
        held, shorts = sorted(set(held)), sorted(set(shorts))
        flat = [(s, w, t) for s, step in enumerate(self.step) for w, t in step.items()]
        out = io.BytesIO()
        np.savez(
            out, words=np.frombuffer(b" ".join(self.words), np.uint8), steps=np.array(flat, np.int64).reshape(-1, 3), link=np.array(self.link), length=np.array(self.length),
            at_window=at_window, short_up=short_up, held=np.array(held, np.int64).reshape(-1, 2), shorts=np.array(shorts, np.int64).reshape(-1, 3), window=self.window,
        )
        return out.getvalue()


class Matcher:
    """Streams documents past one packed automaton."""

    def __init__(self, packed: bytes):
        with np.load(io.BytesIO(packed)) as f:
            self.words = {w: i for i, w in enumerate(f["words"].tobytes().split())}
            self.base = max(1, len(self.words))
            steps = f["steps"]
            self.step = dict(zip((steps[:, 0] * self.base + steps[:, 1]).tolist(), steps[:, 2].tolist()))
            self.link, self.length, self.at_window, self.short_up = (f[k].tolist() for k in ("link", "length", "at_window", "short_up"))
            self.window = int(f["window"])
            self.held: dict[int, list[int]] = {}
            for s, item in f["held"].tolist():
                self.held.setdefault(s, []).append(item)
            self.shorts: dict[int, list[tuple[int, int]]] = {}
            for s, size, item in f["shorts"].tolist():
                self.shorts.setdefault(s, []).append((size, item))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans ``[start, end)`` of words, rising and apart, the items with occurring windows, and the longest match."""
        step, link, length, at_window, short_up = self.step, self.link, self.length, self.at_window, self.short_up
        base, window, known = self.base, self.window, self.words.get
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[int] = set()
        s = l = longest = 0
        for i, word in enumerate(words):
            w = known(word)
            if w is None:
                s = l = 0
                continue
            t = step.get(s * base + w)
            while t is None and s:
                s = link[s]
                l = length[s]
                t = step.get(s * base + w)
            if t is None:
                continue
            s, l = t, l + 1
            if l > longest:
                longest = l
            size = 0
            if l >= window:
                size = window
                states.add(at_window[s])
            if short_up[s] >= 0:
                up, have = short_up[s], l if short_up[s] == s else window
                while up >= 0:
                    for m, item in self.shorts[up]:
                        if m <= have:
                            items.add(item)
                            size = max(size, m)
                    up, have = short_up[link[up]] if link[up] > 0 else -1, window
            if size:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for state in states:
            items.update(self.held[state])
        return spans, items, longest


def _pieces(items: DataFrame, item_id: str, text: str, window: int, piece_words: int) -> DataFrame:
    """``name, words, n``: items as space-joined words, long ones cut into pieces that overlap by ``window - 1`` words."""
    cut = max(piece_words, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, sizes = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_list(body)
                for start in range(0, max(1, len(words) - window + 1), cut - window + 1) if words else ():
                    part = words[start : start + cut]
                    names.append(name)
                    parts.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64())], names=["name", "words", "n"])

    named = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("binary").alias("words"))
    return named.mapInArrow(run, "name string, words binary, n long").distinct()


def automata(
    items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS
) -> DataFrame:
    """``shard, names, packed``: the automata of the benchmark, written to the shared folder.

    Pieces are dealt to ``ceil(words / shard_words)`` shards by a hash, each built by one task.
    """
    parts = stored(_pieces(items, item_id, text, window, piece_words))
    total = parts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton(window)
        names = sorted(group["name"].unique(), key=lambda n: (n is not None, n or ""))
        number = {n: i for i, n in enumerate(names)}
        for name, words in sorted(zip(group["name"], group["words"]), key=lambda r: (number[r[0]], r[1])):
            automaton.add(number[name], words.split(b" "))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "names": [names], "packed": [automaton.packed()]})

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("name", "words"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, "shard int, names array<string>, packed binary"))


_loaded: dict[str, tuple[Matcher, list[str | None]]] = {}


def _matcher(shared: Broadcast) -> tuple[Matcher, list[str | None]]:
    """One automaton per Python worker: the last one used."""
    names, packed, key = shared.value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (Matcher(packed), names)
    return _loaded[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>, unnamed boolean, longest int"


def matched(docs: DataFrame, shards: DataFrame, text: str = "text", found: str = "found", carried: list[str] | None = None) -> DataFrame:
    """``carried`` columns (default: all) of ``docs`` with the struct ``found``: ``n_words``, ``starts`` and ``ends`` of hit words, ``items``, ``longest``.

    One pass over the documents for each shard; what earlier shards found travels along, and the text with it.
    """
    spark = docs.sparkSession
    carried = docs.columns if carried is None else carried
    kind = F.lit(None).cast(f"struct<{_FOUND.replace(' ', ': ').replace(',:', ',')}>")
    numbers = [r.shard for r in shards.select("shard").sort("shard").collect()]
    body = fresh(docs, "_body")
    rows = docs.select(*carried, F.col(text).cast("binary").alias(body)).withColumn(found, kind)
    for turn, number in enumerate(numbers or [None]):
        if number is None:  # no item holds a word
            shared = spark.sparkContext.broadcast(([], SuffixAutomaton().packed(), "none"))
        else:
            shard = shards.filter(F.col("shard") == number).first()
            shared = spark.sparkContext.broadcast((shard.names, bytes(shard.packed), hashlib.sha256(bytes(shard.packed)).hexdigest()))
        rows = _pass(rows, shared, body, found)
        if turn + 1 < len(numbers):
            rows = stored(rows)
    return rows.drop(body)


def _pass(rows: DataFrame, shared: Broadcast, body: str, found: str) -> DataFrame:
    schema = rows.schema
    at, to = rows.columns.index(body), rows.columns.index(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names = _matcher(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                out = []
                for text, old in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist()):
                    words = word_list(text)
                    spans, items, longest = matcher.match(words)
                    named = {names[i] for i in items}
                    if old is not None:
                        spans = _merged(spans + list(zip(old["starts"], old["ends"])))
                        named |= set(old["items"]) | ({None} if old["unnamed"] else set())
                        longest = max(longest, old["longest"])
                    out.append(
                        {
                            "n_words": len(words), "starts": [a for a, _ in spans], "ends": [b for _, b in spans],
                            "items": sorted(n for n in named if n is not None), "unnamed": None in named, "longest": longest,
                        }
                    )
                columns = list(batch.columns)
                columns[to] = pa.array(out, batch.schema.field(to).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``, ``items_sha256``,
    ``contaminated`` and ``longest``, the words of the longest run shared with an item.

    A null text (of a document or an item) has no words; an item without words matches nothing. Rows of one item id are one
    item with the windows of each row. Items without id count as one item, which the digest does not name. Repeated
    documents are judged row by row; an empty table of documents gives no rows, an empty benchmark no hits.
    Other columns are not read.
    """
    found = matched(docs, automata(items, item_id, item_text, window, shard_words, piece_words), text, "found_" + doc_id, [doc_id])
    f = F.col("found_" + doc_id)
    hit = F.aggregate(F.arrays_zip(f["starts"], f["ends"]), F.lit(0).cast("long"), lambda a, z: a + z["ends"] - z["starts"])
    n_items = (F.size(f["items"]) + f["unnamed"].cast("int")).cast("long")
    return found.select(
        doc_id, f["n_words"].alias("n_words"), hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), f["longest"].alias("longest"),
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages: documents with more than ``max_coverage`` of their words hit go, from the others
    the hit spans are cut out, from the first letter of the first hit word to the last of the last.

    Only ``text`` changes. Documents without a hit, null and empty texts stay as they are.
    """
    found = fresh(docs, "_found")
    rows = matched(docs, automata(items, item_id, item_text, window, shard_words), text, found)
    f = F.col(found)
    hit = F.aggregate(F.arrays_zip(f["starts"], f["ends"]), F.lit(0).cast("long"), lambda a, z: a + z["ends"] - z["starts"])

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.DataFrame) -> pd.Series:
        out = []
        for body, starts, ends in zip(texts, spans["starts"], spans["ends"]):
            raw = body.encode()
            flags = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            first, last = edges[::2], edges[1::2]
            parts, at = [], 0
            for a, b in zip(starts, ends):
                parts.append(raw[at : first[a]])
                at = last[b - 1]
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out)

    clean = rows.filter(hit == 0).drop(found)
    marked = rows.filter((hit > 0) & (hit <= F.lit(max_coverage) * f["n_words"]))
    cleaned = marked.withColumn(text, cut_out(F.col(text), F.struct(f["starts"].alias("starts"), f["ends"].alias("ends"))))
    return clean.unionByName(cleaned.drop(found)).select(docs.columns)
