"""Exact top-k search by inner product over an impact-ordered index.

Vectors of integers are dealt to blocks; every block of queries meets every block of candidates in a
task of its own, bounded in rows. A task indexes its candidates: for each dimension a posting list in
descending order of the components, cut into segments of equal quantised impact. A query takes the
segments of all dimensions in descending order of their quantised impact on its score, a stage at a
time, and adds what their postings contribute. After each stage, what the untouched segments could
still add bounds every candidate. The search ends only when fewer candidates than ``RESCORE`` can
still be among the best, by that bound; these are scored exactly. So the result is exact, ties
included, whatever the data; only the time varies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.llm import files

CANDIDATES, QUERIES = 2048, 256
LEVELS = 16
#: Segments are taken in this many stages at most. Scoring a candidate exactly costs less than a stage's
#: postings once so few are left.
STAGES, RESCORE = 8, 512
NO_ID = (1 << 63) - 1


def is_valid(embedding: Column) -> Column:
    """Not null, and every component is a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, finite), F.lit(False))


class Index:
    """Posting segments of a block of candidates (a row of integers each)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")[::-1]  # descending in each dimension
        values = np.take_along_axis(vectors, order, axis=0)
        top, low = values[0], values[-1]
        step = np.maximum(1, -(-(top - low + 1) // LEVELS))
        level = (top - values) // step
        change = np.vstack([np.ones((1, width), dtype=bool), level[1:] != level[:-1]]).T.ravel()
        self.ids = np.tile(order.T.ravel().astype(np.int32), 2)
        self.values = values.T.ravel().astype(np.float64)
        # components above the dimension's smallest, and below its largest, one after the other
        self.above = np.concatenate([(values - low).T.ravel(), (top - values).T.ravel()]).astype(np.float64)
        self.starts = np.flatnonzero(change)
        self.sizes = np.diff(np.append(self.starts, len(self.values)))
        self.dimension = self.starts // n
        self.high, self.low = self.values[self.starts], self.values[self.starts + self.sizes - 1]
        self.first = np.searchsorted(self.dimension, np.arange(width))

    def search(self, query: np.ndarray, k: int, skip: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller ``tie``; the row ``skip`` is left out."""
        n = len(self.vectors)
        weight = query.astype(np.float64)[self.dimension]
        most = np.maximum(weight * self.high, weight * self.low)  # a segment's largest contribution
        least = np.minimum(weight * self.high, weight * self.low)
        floor = np.minimum.reduceat(least, self.first)  # each dimension's smallest contribution
        impact = most - floor[self.dimension]
        starts, factor = self.starts + np.where(weight < 0, len(self.values), 0), np.abs(weight)
        order = np.argsort(-impact, kind="stable")
        order = order[weight[order] != 0]
        gained = np.zeros(n)  # above the sum of floors
        if skip >= 0:
            gained[skip] = -np.inf
        possible = np.arange(n)
        for part in np.array_split(np.arange(len(order)), STAGES):
            segments = order[part]
            if not len(segments):
                continue
            size = self.sizes[segments]
            ends = np.cumsum(size)
            place = np.repeat(starts[segments] - (ends - size), size) + np.arange(ends[-1])
            contributed = self.above[place] * np.repeat(factor[segments], size)
            gained += np.bincount(self.ids[place], weights=contributed, minlength=n)
            rest = np.zeros(len(self.first))
            np.maximum.at(rest, self.dimension[order[part[-1] + 1 :]], impact[order[part[-1] + 1 :]])
            if n > k:
                kth = np.partition(gained, n - k)[n - k]
                possible = np.flatnonzero(gained + rest.sum() >= kth)
            if len(possible) <= max(RESCORE, k):
                break
        possible = possible[possible != skip]
        scores = self.vectors[possible] @ query
        best = np.lexsort((tie[possible], -scores))[:k]
        return possible[best], scores[best]


def search_block(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["vector"].map(len).max()) if len(rows) else 0

        def matrix(part: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(part), width), dtype=np.int64)
            for i, v in enumerate(part["vector"]):
                out[i, : len(v)] = v
            return out

        candidates, queries = rows[~rows["is_query"]], rows[rows["is_query"]]
        out = []
        if len(candidates) and len(queries):
            index, tie, own = Index(matrix(candidates)), candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
            place = {r: i for i, r in enumerate(own.tolist())}
            for row, query_id, vector in zip(queries["row"], queries["vec_id"], matrix(queries)):
                found, scores = index.search(vector, k, place.get(row, -1), tie)
                out.append(pd.DataFrame({"row": row, "query_id": query_id, "vec_id": tie[found], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("row", "query_id", "vec_id", "score")})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """For every row that ``is_query`` marks its ``k`` best other rows by integer inner product:
    ``query_id, rank, vec_id, score``; all others where they are fewer, ties to smaller ids.

    ``vector_col`` holds arrays of integers; rows whose array is null or holds a null take no part,
    shorter arrays count as filled with zeros. Rows are told apart by place, not by id: of repeated rows
    each is a query and a candidate of its own. Null ids come last among ties. Without queries or
    candidates there are no rows."""
    spark = vectors.sparkSession
    valid = vectors.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull()))
    rows, _ = files.written(
        valid.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("vec_id"),
            F.col(vector_col).cast("array<bigint>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
        ),
        "vectors",
    )
    total, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, -(-total // CANDIDATES)), max(1, -(-asked // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select("row", "vec_id", "vector", F.lit(False).alias("is_query"), block(blocks).alias("c"), numbers(query_blocks).alias("q"))
    queries = rows.filter("is_query").select(
        "row", "vec_id", "vector", F.lit(True).alias("is_query"), numbers(blocks).alias("c"), block(query_blocks).alias("q")
    )
    best = sides.unionByName(queries).groupBy("c", "q").applyInPandas(
        search_block(k), "row bigint, query_id bigint, vec_id bigint, score bigint"
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(known("query_id"), "rank", known("vec_id"), "score")
