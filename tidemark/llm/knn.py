"""Exact top-k search by a Voronoi kNN join.

Queries and data are grouped by their nearest pivot. For a data row x of the cell of pivot p, the triangle inequality
gives ``|<q, x> - <q, p>| <= |q| |x - p|``. So each query gets a floor under its k-th best score from two summaries:
its scores against a bounded sample of the rows themselves, and what the sizes and radii of the cells promise. A row can
be an answer only where ``|x - p|`` is at least ``(floor - <q, p>) / |q|``; the least of these distances over a group's
queries decides, cell by cell, which rows travel to the group. Groups are neighbouring query cells, merged where that
ships less. A large group is split into blocks of queries and its data into salted shares of bounded size, so copies of
one vector spread over tasks. Local solutions keep k rows a query and share; a last ranking merges them. Bounds are of
the vectors themselves, so one long vector changes nothing but where it travels itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Most pivots; there are as many as the root of the number of rows, within this bound.
PIVOTS = 256
#: Vectors, chosen by hash, that make the pivots and floors; they steer pruning only, never results.
SAMPLE = 2048
#: Buckets of pivot distances for each doubling.
FINE = 4
#: Queries of a block and expected data rows of a share.
BLOCK, SHARE = 512, 8192
#: What shipping a row costs, in scores computed.
SHIP = 200
EXACT = 2.0**53


def matrix(cells, width: int) -> np.ndarray:
    """Rows of float64 from their bytes, padded with zeros to ``width``."""
    out = np.zeros((len(cells), width))
    for i, c in enumerate(cells):
        row = np.frombuffer(c)
        out[i, : len(row)] = row
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v``: floor(scale * x) of each component; rows without id, vector or with a component that is no finite number are out."""
    usable = F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
        .where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select("id", F.transform("_v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    )


def _padded(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _assigner(pivots: np.ndarray, width: int):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots * pivots).sum(1) / 2
        for pdf in batches:
            if not len(pdf):
                continue
            x = _padded(pdf["v"], width)
            cell = (half - x @ pivots.T).argmin(1)
            packed = [np.asarray(row, dtype="float64").tobytes() for row in pdf["v"]]
            yield pd.DataFrame({"id": pdf["id"], "vec": packed, "is_query": pdf["is_query"], "cell": cell, "dist": np.linalg.norm(x - pivots[cell], axis=1)})

    return run


def _bounder(pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int):
    """For each query cell, the least pivot distance at which a row of each data cell can be an answer of any of its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q = matrix(pdf["vec"], pivots.shape[1])
            long = np.linalg.norm(q, axis=1)
            centre = q @ pivots.T
            floor = np.full(len(q), -np.inf)
            least = centre - long[:, None] * radii
            order = (-least).argsort(1)
            held = sizes[order].cumsum(1)
            enough = (held >= (k + pdf["n_own"].to_numpy())[:, None])  # so many rows hold k of other ids
            some = enough.any(1)
            floor[some] = np.take_along_axis(least, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[some, 0]
            if len(sample) > k:
                scores = np.where(pdf["id"].to_numpy()[:, None] == ids[None, :], -np.inf, q @ sample.T)
                floor = np.maximum(floor, np.partition(scores, len(sample) - k, 1)[:, len(sample) - k])
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (floor[:, None] - centre) / long[:, None]
            need = np.where(np.isfinite(need), need, -np.inf)  # queries of all zeros need all rows
            need -= 1e-9 * (1 + np.abs(need)) + 1e-9 * (np.abs(pivots).max(initial=0.0) + radii)
            cells = pdf["cell"].to_numpy()
            for c in np.unique(cells):
                each = need[cells == c]
                yield pd.DataFrame({"q_cell": int(c), "cell": np.arange(len(pivots)), "need": each.min(0)})

    return run


def make_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few Lloyd rounds over the sample."""
    centres = np.unique(sample, axis=0)[:: max(1, len(np.unique(sample, axis=0)) // count)][:count].copy()
    for _ in range(rounds):
        near = ((sample * sample).sum(1)[:, None] + (centres * centres).sum(1) - 2 * sample @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


class Groups:
    """Neighbouring query cells merged into groups, with the least pivot distances that their queries need."""

    def __init__(self, pivots: np.ndarray, hist: pd.DataFrame, need: np.ndarray, n_queries: dict[int, int], block: int):
        self.edges, self.counts = hist["low"].to_numpy(), hist["n"].to_numpy()
        self.high, self.cells = hist["high"].to_numpy(), hist["cell"].to_numpy()
        left, at = dict(n_queries), next(iter(n_queries))
        self.members, self.need, self.sizes, self.rows = [], [], [], []
        while left:
            at = min(left, key=lambda c: np.linalg.norm(pivots[c] - pivots[at]))
            n, own = left.pop(at), need[at]
            rows = self._reached(own)
            if self.members and self.sizes[-1] + n <= block:
                both = np.minimum(self.need[-1], own)
                together = self._reached(both)
                apart = SHIP * (self.rows[-1] + rows) + self.sizes[-1] * self.rows[-1] + n * rows
                if (SHIP + self.sizes[-1] + n) * together <= apart:
                    self.members[-1].append(at)
                    self.need[-1], self.rows[-1], self.sizes[-1] = both, together, self.sizes[-1] + n
                    continue
            self.members.append([at])
            self.need.append(own)
            self.rows.append(rows)
            self.sizes.append(n)

    def _reached(self, need: np.ndarray) -> int:
        """Rows in the buckets that may hold a needed row."""
        return int(self.counts[self.high >= need[self.cells]].sum())


def _solver(width: int, k: int, exact: bool):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        data = data.sort_values("id", ignore_index=True)
        x, q = matrix(data["vec"], width), matrix(queries["vec"], width)
        ids, own = data["id"].to_numpy(), queries["id"].to_numpy()
        if exact:
            score = q @ x.T
        else:  # beyond 2^53 products are added as whole numbers and held to the range of long
            whole = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in x], dtype=object).T
            score = np.vectorize(lambda v: min(max(v, -(2**63)), 2**63 - 1), otypes=[object])(whole)
        others = own[:, None] != ids[None, :]
        rows, cols = [], []
        for i in range(len(own)):
            at = np.flatnonzero(others[i])
            if not len(at):
                continue
            s = score[i, at]
            if exact and len(at) > k:
                at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
                s = score[i, at]
            best = at[np.argsort(-s, kind="stable")[:k]]
            rows += [i] * len(best)
            cols += best.tolist()
        return pd.DataFrame({"query_id": own[rows], "vec_id": ids[cols], "score": [int(score[i, j]) for i, j in zip(rows, cols, strict=True)]})

    return run


def routed(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str, scale: float, pivots: int, block: int, share: int):
    """The data rows that travel (id, vec, g, b, share), the queries (same columns), the width, and whether doubles are exact.

    None where there is no query.
    """
    spark = vectors.sparkSession
    clean = quantised(vectors, id_col, vector_col, scale)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = clean.agg(F.max(F.size("v")).alias("width"), F.max(norm2).alias("m2"), F.count("*").alias("n")).first()
    if stats["width"] is None:
        return None
    width = max(1, stats["width"])
    chosen = clean.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    sample, ids = _padded([r.v for r in chosen], width), np.array([r.id for r in chosen], dtype=np.int64)
    centres = make_pivots(sample, max(1, min(pivots, round(stats["n"] ** 0.5))))

    schema = "id long, vec binary, is_query boolean, cell int, dist double"
    cells = staged(clean.withColumn("is_query", F.coalesce(is_query, F.lit(False))).mapInPandas(_assigner(centres, width), schema), "cells")
    # repeated rows of a query's id make one query, the smallest vector
    one = cells.where("is_query").groupBy("id").agg(F.min(F.struct("vec", "cell")).alias("q"), F.count("*").alias("n_own"))
    queries = staged(one.select("id", F.col("q.vec").alias("vec"), F.col("q.cell").alias("cell"), "n_own"), "queries")
    n_queries = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()}
    if not n_queries:
        return None

    # distances by powers of two, so that one long distance spoils nothing
    bucket = F.when(F.col("dist") > 0, F.floor(F.log2("dist") * FINE)).cast("int").alias("bucket")
    hist = cells.groupBy("cell", bucket).agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    by_cell = hist.groupby("cell").agg(n=("n", "sum"), high=("high", "max"))
    sizes, radii = np.zeros(len(centres)), np.zeros(len(centres))
    sizes[by_cell.index], radii[by_cell.index] = by_cell["n"], by_cell["high"]
    # at most pivots x pivots rows
    found = queries.select("id", "vec", "cell", "n_own").mapInPandas(_bounder(centres, sizes, radii, ids, sample, k), "q_cell int, cell int, need double")
    need = np.full((len(centres), len(centres)), np.inf)
    least = found.groupBy("q_cell", "cell").agg(F.min("need").alias("need")).toPandas()
    need[least["q_cell"], least["cell"]] = least["need"]
    groups = Groups(centres, hist, need, n_queries, block)

    # at most pivots x pivots rows, so it may be broadcast; cells without a needed row are left out
    radius = [float(r) for r in radii]
    plan = [(g, -(-n // block), max(1, -(-rows // share))) for g, (n, rows) in enumerate(zip(groups.sizes, groups.rows, strict=True))]
    reach = spark.createDataFrame(
        [(g, c, blocks, shares, float(groups.need[g][c])) for g, blocks, shares in plan for c in range(len(centres)) if groups.need[g][c] <= radius[c]],
        "g int, cell int, blocks int, shares int, need double",
    )
    deal = spark.createDataFrame([(c, *plan[g]) for g, members in enumerate(groups.members) for c in members], "cell int, g int, blocks int, shares int")
    needed = (
        cells.select("id", "vec", "cell", "dist")
        .join(F.broadcast(reach), "cell")
        .where("dist >= need")
        .withColumn("share", F.pmod(F.xxhash64("id", "dist"), F.col("shares")).cast("int"))
        .select("id", "vec", "g", "share", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    )
    asked = (
        queries.join(F.broadcast(deal), "cell")
        .withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .select("id", "vec", "g", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    )
    return needed, asked, width, stats["m2"] < EXACT


def voronoi_knn(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    pivots: int = PIVOTS,
    block: int = BLOCK,
    share: int = SHARE,
) -> DataFrame:
    """The k rows with the largest inner product for each query: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition over ``id``; candidates of a query are all rows with another id. Scores are inner
    products of the whole numbers floor(scale * x); ties go to the smaller id. Vectors that are null, hold a null or a
    component that isn't finite, or have no id take no part; shorter vectors count as padded with zeros, an empty one as
    all zeros. Rows that repeat a query's id make one query (the smallest vector); as candidates, repeated rows all
    count. Scores beyond long are held to its range. Fewer than k candidates give fewer rows; an empty table gives none.
    Other columns are not read, whatever their names.
    """
    found = routed(vectors, is_query, k, id_col, vector_col, scale, pivots, block, share)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    needed, asked, width, exact = found
    key = ["g", "b", "share"]
    local = needed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_solver(width, k, exact), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
