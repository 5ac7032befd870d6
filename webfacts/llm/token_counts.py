"""Token counts from distinct pre-tokens (operator 4).

Every distinct pre-token of the corpus is encoded once and its pieces counted. Counts meet the per-document
pre-token frequencies by a join and are summed; no id is ever stored. The most frequent pre-tokens, a table of at
most ``HEAD`` rows, are broadcast and summed inside the document row, so that only the rare rest is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.llm.pieces import model_path, pretokens
from webfacts.session import cut

HEAD = 1 << 19
FLUSH_WORDS = 1_000_000
LIMIT = 4096


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list[tuple]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield list(zip(*[c.to_pylist() for c in part.columns]))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of all texts with their frequency: ``(word, n)``; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for rows in _texts(batches):
            for (t,) in rows:
                seen.update(pretokens(t or ""))
            if len(seen) >= FLUSH_WORDS:
                yield _word_rows(seen)
                seen = Counter()
        yield _word_rows(seen)

    words = docs.select(text).mapInArrow(run, "word string, n long")
    return words.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _word_rows(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def _piece_counter(path: str):
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # The library puts a space in front of every text, and an own one only before a word that had none: the
        # extra piece is taken off again. A lone space mark never merges with the line break put behind it.
        lead = len(model.encode("\n"))
        for words in batches:
            plain = words.str.startswith("▁")
            texts = [w[1:] if p else "\n" + w for w, p in zip(words, plain)]
            counts = [len(x) for x in model.encode(texts, num_threads=1)]
            yield pd.Series([c if p and t else 1 if p else c - lead for c, p, t in zip(counts, plain, texts)], dtype="int32")

    return F.pandas_udf(pieces, "int")


def _frequent(words: DataFrame, head: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, at most ``head`` of them; all of one frequency class or none.

    Which words are in the table decides only where they are summed. Classes are eighths of powers of two, so there are
    a few hundred at most, whatever the corpus.
    """
    cls = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(words.groupBy(cls.alias("c")).count().collect(), reverse=True)
    lowest, total = None, 0
    for c, count in sizes:
        total += count
        if total > head:
            break
        lowest = c
    if lowest is None:
        return {}
    return {r[0]: r[1] for r in words.filter(cls >= lowest).select("word", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, limit: int = LIMIT) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens`` without begin and end, ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; rows are told apart by id
    and text, so a null or repeated id is no problem. An empty table gives no rows; other columns are not read.
    """
    path = path or model_path()
    words = cut(pretoken_counts(docs, text).select("word", "n", _piece_counter(path)("word").alias("pieces")))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(words, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in _texts(batches):
            out: list[tuple] = []
            for i, h, t in rows:
                body, total = t or "", 0
                for word, times in Counter(pretokens(body)).items():
                    pieces = known.get(word)
                    if pieces is not None:
                        total += pieces * times
                    elif word:
                        out.append((i, h, word, times, 0, 0))
                out.append((i, h, None, total, 1, len(body.encode("utf-8", "surrogatepass"))))
            ids, hashes, names, amounts, n_rows, n_bytes = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(hashes, pa.int64()), pa.array(names, pa.string()), pa.array(amounts, pa.int64()), pa.array(n_rows, pa.int32()), pa.array(n_bytes, pa.int64())],
                names=["id", "h", "word", "amount", "n_rows", "n_bytes"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[doc_id].dataType)
    schema = f"id {docs.schema[doc_id].dataType.simpleString()}, h long, word string, amount long, n_rows int, n_bytes long"
    parts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), text).mapInArrow(run, schema)
    tails = parts.filter("word IS NOT NULL").select("id", "h", "word", "amount").join(words.select("word", "pieces"), "word")
    sums = parts.filter("word IS NULL").select("id", "h", "amount", "n_rows", "n_bytes").union(
        tails.select("id", "h", F.col("amount") * F.col("pieces"), F.lit(0), F.lit(0).cast("long"))
    )
    total = sums.groupBy("id", "h").agg(F.sum("amount").alias("t"), F.sum("n_rows").alias("r"), F.max("n_bytes").alias("n_bytes"))
    each = total.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("r").cast("int"))))
    n_tokens = (F.col("t") / F.col("r")).cast("long")
    return each.select(F.col("id").alias(doc_id), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
