"""SentencePiece merge-type encoding by backtracking, and decoding (operator 2).

A text is normalised as the model says (spaces become U+2581, one is put in front) and cut where no piece can
cross: before a space run and around a character that no piece holds. Each pre-token is encoded on its own:
the Aho-Corasick automaton of all mergeable pieces lists the matches, the longest match at a position is taken
when it is compatible with the piece before it, else the next shorter one; where none fits, the position is
marked in a bitfield of failed positions and the piece before it is shortened. Two pieces are compatible when
merging the characters of both gives just these two again. Pieces that merging cannot reach are no matches.
Space runs, whose pieces are not ranked after their parts, are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
NORMAL, BYTE = 1, 6
CACHE_WORDS = 400_000
CACHE_CHARS = 64
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")


class PieceModel:
    """The vocabulary of one model file and the exact encoding with it."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback:
            raise ValueError("only merge models with byte fallback, a leading space and no further normalisation")
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.names = [p.piece for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id_of):
            raise ValueError("a piece crosses the places where texts are cut")
        self.raw = [p.replace(SPACE, " ").encode() for p in self.names]
        for value, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([value])
        for i, p in enumerate(model.pieces):
            if p.type not in (NORMAL, BYTE):
                self.raw[i] = b""
        self.matches = ahocorasick.Automaton()
        for piece in self.id_of:
            if SPACE * 2 not in piece and self.merge(piece) == [piece]:
                self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {"": b""}

    def merge(self, text: str) -> list[str]:
        """Merging itself: always the best-ranked adjacent pair, the leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(queue, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, first: str, second: str) -> bool:
        key = (first, second)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_WORDS:
                self.fits.clear()
            known = self.fits[key] = self.merge(first + second) == [first, second]
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of one pre-token, by backtracking; characters without a piece stand alone."""
        if SPACE * 2 in word:
            return self.merge(word)
        n = len(word)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.matches.iter(word):
            starts[end - len(piece) + 1].append(piece)  # ends grow, so pieces of a start come shortest first
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, choice = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            options = starts[at]
            if not options:  # an unknown character never merges
                out.append(word[at])
                at += 1
                choice = len(starts[at]) - 1 if at < n else 0
                continue
            found = None
            while choice >= 0:
                piece = options[choice]
                nxt = at + len(piece)
                if not (failed[nxt >> 3] >> (nxt & 7) & 1) and (not out or self.compatible(out[-1], piece)):
                    found = piece
                    break
                choice -= 1
            if found is not None:
                out.append(found)
                at = nxt
                choice = len(starts[at]) - 1 if at < n else 0
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                raise ValueError("no encoding; the vocabulary is not closed under merging")
            last = out.pop()
            at -= len(last)
            choice = starts[at].index(last) - 1 if last in starts[at] else -1
        return out

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(word):
            known = self.id_of.get(piece)
            if known is None:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(known)
        return out

    def packed(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers; short ones are kept in a bounded cache."""
        known = self.cache.get(word)
        if known is None:
            known = np.array(self.ids(word), dtype="<u4").tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                    self.cache[""] = b""
                self.cache[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text, without begin and end."""
        get, out = self.cache.get, []
        for word in pretokens(text):
            known = get(word)
            out.append(self.packed(word) if known is None else known)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: piece bytes, broken sequences replaced, without the space put in front."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def pretokens(text: str) -> list[str]:
    """Parts of the normalised text that no piece crosses, in order; joined they are the normalised text."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " ":
        return _UNITS.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker."""
    return PieceModel(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """``docs`` id with ``ids`` (array of int) and ``decoded`` text; a null text counts as empty."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for texts in _slices(batches):
            rows = [_whole(model, t, bos, eos) for t in texts[1]]
            yield pa.RecordBatch.from_arrays(
                [texts[0], pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array([model.decode(r) for r in rows], pa.string())], names=[doc_id, "ids", "decoded"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The encoding and decoding of :func:`encode_documents` as ``n_tokens`` and digests, for comparing whole corpora.

    A null or empty text gives the begin and end ids alone. Row order, repeated rows and other columns do not matter;
    an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for ids, texts in _slices(batches):
            n, first, second = [], [], []
            for t in texts:
                row = _whole(model, t, True, True)
                n.append(len(row))
                first.append(hashlib.sha256(row.tobytes()).hexdigest())
                second.append(hashlib.sha256(model.decode(row).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _whole(model: PieceModel, text: str | None, bos: bool, eos: bool) -> np.ndarray:
    body = np.frombuffer(model.encode(text or ""), dtype="<u4")
    return np.concatenate([np.array([model.bos] * bos, "<u4"), body, np.array([model.eos] * eos, "<u4")])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Few rows at a time, so that what a task holds does not follow the Arrow batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part.column(0), part.column(1).to_pylist()
