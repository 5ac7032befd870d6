"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("word", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("component", T.LongType()),
        T.StructField("pos", T.IntegerType()), T.StructField("kept", T.BooleanType()),
    ]
)


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 90)) for _ in range(12)]
    near = []
    for t in base[:6]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    line = words(rng, 30)
    odd = [
        None, "", "   ", "\n\n", "one", "two words", "  leading and  double   spaces ", "tab\tand\x0bother\r\nblanks\x0c here", "▁ mark ▁▁ itself", "snow ☃ and 😀 and é",
        "<s> literal </s> <0x0A>", line, line + "\n" + base[0] + "\n" + line, base[1] + "\n" + line.replace(line.split()[3], "other"), "A B C " * 40, "x" * 5000, words(rng, 6000),
    ]
    return base + near + base[:3] + odd


def documents(spark, rows=None):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (4, "another text under a used id"), (None, "no id here"), (None, None), (None, "no id here")] if rows is None else rows
    made = [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "c"][k % 4], None if t is None else len(t), "w", "r", k, k, True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS)
