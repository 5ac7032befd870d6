"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Every document of a source is wanted the same fractional number of times. Whole copies are certain; the
fractions are rounded dependently: two fractional documents meet, words move from one to the other until one
of them is whole, and the other meets the next. A document's chance to be taken keeps its fraction, and the
words taken from the source do not change, so the sum stays within half a document of the target: longer documents meet first,
and the very last one goes to its nearer whole number. Documents of a source are dealt by hash into buckets of
bounded size; each bucket leaves one fractional document, and those residuals are combined in a tree of the same step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from webfacts.llm.common import WORD, fresh, text_or_empty
from webfacts.operators.ordered import OrderedRows
from webfacts.session import cut

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BUCKET_ROWS = 4096
FAN_IN = 64
SEED = 17
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, n_docs, source_size)`` with ``target``.

    Weights repeat over the sources in code-point order, null last. The total of all sizes is shared by weight; a
    source whose share is above ``cap`` times its size gets just that, and the rest is shared again among the
    others, until none is above. Only scalars reach the driver.
    """
    order = sizes.withColumn("no_source", F.col("source").isNull())
    ranked = OrderedRows(order, [], ["no_source", "source"]).row_number("rank").rows()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = cut(ranked.select("source", "n_docs", "source_size", weight.cast("long").alias("weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, share, full, n_full = total, 0, F.lit(False), -1
    while True:
        got = weighed.agg(
            F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if got[2] == n_full:
            break
        n_full, rest, share = got[2], total - (got[0] or 0), got[1] or 0
        if not share:
            break
        # whole numbers on both sides: no rounding decides which source is full
        full = F.col("source_size").cast("decimal(38,0)") * (cap * share) < F.col("weight").cast("decimal(38,0)") * rest
    open_share = F.lit(float(rest)) * F.col("weight") / F.lit(float(share or 1))
    return weighed.withColumn("target", F.when(full, (F.col("source_size") * cap).cast("double")).otherwise(open_share))


def _uniform(key: str) -> float:
    return (xxhash.xxh64_intdigest(key, SEED) >> 11) / float(1 << 53)


def pivotal(ids: list[str], sizes: np.ndarray, fractions: np.ndarray, salt: str) -> tuple[np.ndarray, int]:
    """Round ``fractions`` one pair at a time, keeping the sum of ``sizes * fractions``; the open index or -1."""
    x = fractions.astype(float).copy()
    held = -1
    for i in range(len(x)):
        if x[i] <= EPS or x[i] >= 1 - EPS:
            x[i] = round(x[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, s, t = x[held], x[i], float(sizes[held]), float(sizes[i])
        up = min((1 - a) * s, b * t)  # words that can move to the held document
        down = min(a * s, (1 - b) * t)
        move = up if _uniform(f"{salt}:{ids[held]}:{ids[i]}") * (up + down) < down else -down
        a, b = a + move / s, b - move / t
        x[held], x[i] = a, b
        open_now = [j for j in (held, i) if EPS < x[j] < 1 - EPS]
        for j in (held, i):
            if j not in open_now:
                x[j] = round(x[j])
        held = open_now[0] if open_now else -1
    return x, held


def _round_level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One tree level over ``rows(source, bucket, id, size, whole, fraction)``: every bucket leaves one open row at most."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "mix", "name"], ascending=[False, True, True], kind="stable", ignore_index=True)
        x, held = pivotal(group["name"].tolist(), group["size"].to_numpy(), group["fraction"].to_numpy(), str(level))
        if last and held >= 0:
            x[held], held = round(x[held]), -1
        group["fraction"] = x
        group["open"] = np.arange(len(group)) == held
        return group

    return rows.groupBy("source", "bucket").applyInPandas(step, StructType([*rows.schema.fields, StructField("open", BooleanType())]))


def _copies(docs: DataFrame, targets: DataFrame, bucket_rows: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """Rows decided by their whole part alone, and rows whose fraction was rounded."""
    plain = [F.col("source").alias("t_source"), "n_docs", "source_size", "target"]
    sized = docs.join(targets.select(*plain), F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sized = sized.withColumn("whole", F.floor(wanted + F.lit(EPS))).withColumn("fraction", F.greatest(wanted - F.col("whole"), F.lit(0.0)))
    certain = sized.filter((F.col("size") == 0) | (F.col("fraction") <= EPS))
    rows = sized.filter((F.col("size") > 0) & (F.col("fraction") > EPS))
    rows = rows.withColumn("mix", F.xxhash64(F.lit(SEED), "name", "size"))
    buckets = F.greatest(F.ceil(F.col("n_docs") / F.lit(bucket_rows)), F.lit(1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED + 1), "name"), buckets))
    most = targets.agg(F.max("n_docs")).first()[0] or 1
    n_buckets, level, decided = math.ceil(most / bucket_rows), 0, []
    while True:
        done = cut(_round_level(rows, level, n_buckets <= 1))
        decided.append(done.filter("NOT open"))
        if n_buckets <= 1:
            break
        rows = done.filter("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / F.lit(fan_in)))
        n_buckets, level = math.ceil(n_buckets / fan_in), level + 1
    rounded = decided[0]
    for more in decided[1:]:
        rounded = rounded.union(more)
    return certain, rounded.withColumn("whole", F.col("whole") + F.round("fraction").cast("long"))


def _size(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _name(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("-"), F.xxhash64(F.col(text)).cast("string")))


def mix_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, with_name: bool = False,
) -> DataFrame:
    """One row per document: ``size`` words, ``source_size``, ``target`` of its source, whole ``copies``, words ``taken``.

    Null texts and texts without words have size 0 and keep the whole part of their copies; null sources form one source; rows that
    repeat id and size are rounded one by one; an empty table gives no rows. The same rows give the same result on
    every run, whatever their partitions. Buckets are dealt by hash, of ``bucket_rows`` rows on average.
    """
    base = cut(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), _size(text).alias("size"), _name(doc_id, text).alias("name")))
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    certain, rounded = _copies(base, targets, bucket_rows, fan_in)
    out = [F.col("id").alias(doc_id), *["name"] * with_name, "source", "size", "source_size", "target", F.col("whole").cast("long").alias("copies")]
    both = certain.select(*out).union(rounded.select(*out))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Rows that share id, source and size are ordered by their text's hash and get the rounded copies in falling order.
    """
    named = mix_counts(docs, doc_id, text, source, with_name=True)
    key, times, at = fresh(docs, "_mix_key"), fresh(docs, "_mix_times"), fresh(docs, "_mix_at")
    key_of = lambda name, size: F.concat_ws(":", name, size.cast("string"))
    copies = named.filter("copies > 0").select(key_of(F.col("name"), F.col("size")).alias(key), "copies")
    wanted = copies.groupBy(key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(times))
    keyed = docs.withColumn(key, key_of(_name(doc_id, text), _size(text))).join(wanted, key)
    single = keyed.filter(F.size(times) == 1).withColumn(at, F.lit(1))
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.col(text)))
    several = keyed.filter(F.size(times) > 1).withColumn(at, F.row_number().over(order))
    ranked = single.union(several.select(single.columns)).filter(F.col(at) <= F.size(times))
    return ranked.withColumn(at, F.explode(F.sequence(F.lit(1), F.element_at(times, F.col(at)).cast("int")))).select(docs.columns)
