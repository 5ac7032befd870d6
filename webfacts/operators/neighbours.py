"""Nearest neighbours: few probes, and the exact all-to-all join. The approximate search over a stored index is in ``nearindex``.

The all-to-all joins never pair rows of a group one by one. Vectors meet in blocks of bounded size, a block
is one matrix product, and only the best ``k`` of a block leave it. Equal vectors are folded to one
representative first, so a large group of copies costs one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.functions.vector import cosine_to, l2_normalize
from webfacts.operators.aggregates import top_per_key
from webfacts.session import cut

BLOCK_ROWS = 4096
#: Blocks grow with the table up to this, since every further block repeats the other side in the shuffle.
MAX_BLOCK_ROWS = 32768
#: Query rows of one matrix product; with 4096 members it holds 32 MB.
QUERY_ROWS = 1024
MAX_PIVOTS = 4096
#: More probes than this are scored as a table instead of literals.
LITERAL_PROBES = 1000


def nearest_to(corpus: DataFrame, id_col: str, vector: str, probes: dict[int, list[float]], k: int, min_similarity: float | None = None, where: Column | None = None) -> DataFrame:
    """The ``k`` nearest other rows of each probe: one scan, each row scored against the literal probes.

    Many probes become a table; it meets the rows in blocks.
    """
    rows = corpus.filter(F.col(vector).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    if len(probes) > LITERAL_PROBES:
        table = corpus.sparkSession.createDataFrame([(int(p), [float(x) for x in v]) for p, v in probes.items()], "rep long, vec array<double>")
        one = F.lit(0).alias("cell")
        hits = _block_topk(
            table.select(one, "rep", l2_normalize("vec").alias("vec")), rows.select(one, F.col(id_col).cast("long").alias("rep"), l2_normalize(vector).alias("vec")),
            ["cell"], k, -1.0 if min_similarity is None else float(min_similarity),
        )
        named = hits.select(F.col("rep").alias("probe_id"), F.col("target").alias(id_col), "similarity")
        return top_per_key(named, ["probe_id"], [F.desc("similarity"), F.asc(id_col)], k)
    scored = F.array(
        *[F.struct(F.lit(int(p)).cast("long").alias("probe_id"), cosine_to(vector, v).alias("similarity")) for p, v in probes.items()]
    )
    keep = F.filter(
        scored,
        lambda s: (s["probe_id"] != F.col(id_col)) & (F.lit(True) if min_similarity is None else s["similarity"] >= min_similarity),
    )
    hits = rows.select(id_col, F.explode(keep).alias("s")).select("s.probe_id", id_col, "s.similarity")
    return top_per_key(hits, ["probe_id"], [F.desc("similarity"), F.asc(id_col)], k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64, copy=False)


def _best(rep_q, rep_m, sims: np.ndarray, k: int, floor: float):
    """Best ``k`` members per query row, ties by member id, never the query itself."""
    sims = np.where(rep_q[:, None] == rep_m[None, :], -np.inf, sims)
    width = sims.shape[1]
    if width > k:
        kth = np.partition(sims, width - k, axis=1)[:, width - k]
    else:
        kth = np.full(len(rep_q), -np.inf)
    qi, mi = np.nonzero((sims >= kth[:, None]) & (sims >= floor) & np.isfinite(sims))
    out = pd.DataFrame({"rep": rep_q[qi], "target": rep_m[mi], "similarity": sims[qi, mi]})
    out = out.sort_values(["rep", "similarity", "target"], ascending=[True, False, True], kind="stable")
    return out[out.groupby("rep").cumcount() < k]


def block_rows(n: int) -> int:
    """Rows of a block for a table of ``n`` vectors: about eight blocks a side, within fixed bounds."""
    return int(min(MAX_BLOCK_ROWS, max(BLOCK_ROWS, n // 8)))


def _block_topk(queries: DataFrame, members: DataFrame, cell: list[str], k: int, min_similarity: float, size: int = BLOCK_ROWS) -> DataFrame:
    """Top ``k`` members per query inside each cell: ``(rep, target, similarity)``, one set per block.

    A cell of any size is cut into query chunks x member chunks of about ``size`` rows each; cells that
    fit one block travel together in packs, so small cells do not cost one Python call each. Inside a block the
    products are taken in pieces of fixed size, so its memory is that of its vectors.
    """

    def chunks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int")
        return df.groupBy(*cell).agg(n.alias(name))

    sizes = chunks(queries, "_nq").join(chunks(members, "_nm"), cell).withColumn("_cell", F.concat_ws("|", *cell))
    own = lambda n: F.pmod(F.hash("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = (F.col("_nq") == 1) & (F.col("_nm") == 1)
    # small cells are dealt to packs of about a block of rows, so the number of packs grows with the rows
    packs = max(1, -(-members.count() // size))
    block = F.when(small, F.pmod(F.xxhash64("_cell"), F.lit(packs)).cast("string")).otherwise(F.concat_ws("|", "_cell", "_q", "_m", F.lit("b")))
    cols = [block.alias("_block"), "_cell", "rep", "vec"]
    q = queries.join(sizes, cell).select("_cell", "rep", "vec", "_nq", "_nm", own("_nq").alias("_q"), every("_nm").alias("_m")).select(*cols)
    m = members.join(sizes, cell).select("_cell", "rep", "vec", "_nq", "_nm", own("_nm").alias("_m"), every("_nq").alias("_q")).select(*cols)
    m = m.select(*[F.col(c).alias(f"m{c}") for c in m.columns])
    floor = float(min_similarity)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"rep": np.array([], dtype=np.int64), "target": np.array([], dtype=np.int64), "similarity": np.array([], dtype=np.float64)})]
        there = right.groupby("m_cell").indices
        for name, rows in left.groupby("_cell").indices.items():
            if name not in there:
                continue
            mine = right.iloc[there[name]]
            b, rep_m = _matrix(mine["mvec"]), mine["mrep"].to_numpy()
            for at in range(0, len(rows), QUERY_ROWS):
                some = left.iloc[rows[at : at + QUERY_ROWS]]
                a, rep_q = _matrix(some["vec"]), some["rep"].to_numpy()
                best = [_best(rep_q, rep_m[i : i + BLOCK_ROWS], a @ b[i : i + BLOCK_ROWS].T, k, floor) for i in range(0, len(b), BLOCK_ROWS)]
                hits = pd.concat(best)
                if len(best) > 1:
                    hits = hits.sort_values(["rep", "similarity", "target"], ascending=[True, False, True], kind="stable")
                    hits = hits[hits.groupby("rep").cumcount() < k]
                parts.append(hits)
        return pd.concat(parts)

    return q.groupBy("_block").cogroup(m.groupBy("m_block")).applyInPandas(search, "rep long, target long, similarity double")


def _representatives(corpus: DataFrame, id_col: str, vector: str, group: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their representative, representatives): equal unit vectors of a group share one."""
    rows = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(group).cast("string") if group else F.lit("")).alias("grp"),
        l2_normalize(vector).alias("vec"),
    )
    reps = rows.groupBy("grp", "vec").agg(F.min("id").alias("rep"))
    return rows, reps


def _expand(rows: DataFrame, reps: DataFrame, pairs: DataFrame, id_col: str, k: int, min_similarity: float) -> DataFrame:
    """Representative pairs to row pairs. A copy group offers its ``k + 1`` smallest ids, more can never be needed."""
    tagged = rows.join(reps, ["grp", "vec"]).select("id", "rep")
    offers = top_per_key(tagged, ["rep"], [F.asc("id")], k + 1)
    best = top_per_key(pairs, ["rep"], [F.desc("similarity"), F.asc("target")], k)
    others = best.join(offers.select(F.col("rep").alias("target"), F.col("id").alias("neighbour")), "target").select("rep", "neighbour", "similarity")
    copies = offers.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    zero = reps.filter(~F.exists("vec", lambda x: x != 0)).select("rep").withColumn("_z", F.lit(True))
    copies = copies.join(zero, "rep", "left").select(
        "rep", "neighbour", F.when(F.col("_z"), 0.0).otherwise(F.col("similarity")).alias("similarity")
    ).filter(F.col("similarity") >= min_similarity)
    ranked = top_per_key(others.unionByName(copies), ["rep"], [F.desc("similarity"), F.asc("neighbour")], k + 1)
    lists = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbour"))).alias("near"))
    mine = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    out = tagged.join(lists, "rep").select("id", F.posexplode(mine).alias("pos", "n"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n.neighbour").alias("neighbour_id"),
        (-F.col("n.far")).alias("similarity"),
        (F.col("pos") + 1).cast("long").alias("rank"),
    )


def knn_join(corpus: DataFrame, id_col: str, vector: str, k: int, min_similarity: float | None = None, group: str | None = None, pivots_wanted: int | None = None) -> DataFrame:
    """Exact: for every row its ``k`` nearest other rows (of the same group) by cosine.

    Vectors are assigned to sampled pivots. A first round searches the own cell, which gives each vector a
    lower bound for its ``k``-th similarity; a second round visits only cells that can still beat the bound
    (angle to the pivot minus cell radius, triangle inequality on angles).
    """
    floor = -1.0 if min_similarity is None else float(min_similarity)
    rows, reps = _representatives(corpus, id_col, vector, group)
    reps = cut(reps)
    n = reps.count()
    size = block_rows(n)
    # cells of about one block each: where nothing can be left out, a row is sent to every cell
    wanted = int(max(1, min(MAX_PIVOTS, pivots_wanted or n / size)))
    # a bounded sample: at most MAX_PIVOTS vectors reach the driver
    sample = reps.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vec").collect()
    if not sample:  # nothing but zero vectors
        sample = [(list(reps.select("vec").first()[0]),)]
    pivots = np.array([r[0] for r in sample], dtype=np.float64)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                cos = np.clip(_matrix(pdf["vec"]) @ pivots.T, -1.0, 1.0)
                cell = cos.argmax(axis=1)
                angle = np.arccos(cos[np.arange(len(pdf)), cell])
                yield pdf.assign(cell=cell.astype(np.int32), angle=angle)

    placed = cut(reps.mapInPandas(assign, "grp string, vec array<double>, rep long, cell int, angle double"))
    cells = ["grp", "cell"]
    first = cut(_block_topk(placed, placed, cells, k, floor, size))
    if len(pivots) == 1:  # every group is one cell
        return _expand(rows, reps, first, id_col, k, floor)

    # kth similarity found so far; fewer than k hits leave the caller's minimum
    kth = top_per_key(first, ["rep"], [F.desc("similarity"), F.asc("target")], k).groupBy("rep").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("c"))
    need = placed.join(kth, "rep", "left").select(
        "grp", "vec", "rep", "cell", F.when(F.col("c") >= k, F.greatest(F.col("s"), F.lit(floor))).otherwise(F.lit(floor)).alias("need")
    )
    # the cells of a group with their radii: at most MAX_PIVOTS of them travel with each row of the group
    radii = placed.groupBy(*cells).agg(F.max("angle").alias("radius"))
    reach = radii.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cell", "radius"))).alias("reach"))
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    def visits(batches):
        pv = shared.value
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                known = part["reach"].iloc[0]
                ids, radius = np.array([x["cell"] for x in known]), np.array([x["radius"] for x in known])
                vec = _matrix(part["vec"])
                angle = np.arccos(np.clip(vec @ pv[ids].T, -1.0, 1.0))
                bound = np.cos(np.maximum(0.0, angle - radius[None, :])) + 1e-9
                live = np.abs(vec).sum(axis=1) > 0
                bound[~live] = np.maximum(bound[~live], 1e-9)
                # a zero vector scores 0 with anything; it may sit in any cell
                bound = np.maximum(bound, np.where(radius[None, :] >= np.pi / 2 - 1e-9, 1e-9, bound))
                go = (bound >= part["need"].to_numpy()[:, None]) & (ids[None, :] != part["cell"].to_numpy()[:, None])
                r, c = np.nonzero(go)
                if len(r):
                    yield pd.DataFrame({"grp": g, "cell": ids[c].astype(np.int32), "rep": part["rep"].to_numpy()[r]})

    away = need.join(reach, "grp").mapInPandas(visits, "grp string, cell int, rep long")
    queries = away.join(placed.select("rep", "vec"), "rep")
    second = _block_topk(queries, placed.select("grp", "cell", "rep", "vec"), cells, k, floor, size)
    return _expand(rows, reps, first.unionByName(second), id_col, k, floor)


def uniqueness(corpus: DataFrame, id_col: str, vector: str, group: str) -> DataFrame:
    """1 - largest similarity to another row of the same group; 1.0 when it is alone."""
    near = knn_join(corpus, id_col, vector, 1, None, group).select(id_col, "similarity")
    score = 1 - F.greatest(F.coalesce(F.col("similarity"), F.lit(0.0)), F.lit(0.0))
    return corpus.select(id_col, group).join(near, id_col, "left").select(id_col, group, score.alias("uniqueness"))
