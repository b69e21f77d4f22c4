"""Near-duplicate vectors by product quantisation.

A coarse quantiser deals unit vectors to inverted lists; the residual to the list's centre is cut in
subspaces, each coded by its nearest codeword. Both are fitted by k-means on a bounded sample; every
vector is indexed. A vector probes the ``probes`` nearest lists and all others that can hold a vector
within reach. Two bounds tell: the list's radius (the largest distance of its vectors to its centre, over
the whole table) by the triangle inequality, and the distance to the border between the two lists, on
whose other side all vectors of the list lie. In a list, a vector's distances to all members are those
of its residual to their codewords, summed over a member's codes: one product of matrices. A member
within reach cannot have a looked-up distance above the reach plus its own coding error; what passes is
ranked anew by its exact cosine in double precision. So no link is lost, however a dense group is cut
into lists. Vectors without any structure are within both bounds of nearly all lists, so the search
then compares nearly all pairs.

Equal vectors are one entry with a weight. Of two lists only the lower one's vectors ask. Small lists
share a block, large ones are cut into chunks, and each pair of chunks is one bounded task, so a list
that holds a third of all vectors is many tasks. Tasks emit counts and a forest of links, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import components, files
from geoscope.llm.topk import is_valid

#: The sample that fits the index, and sizes of the index. Lists follow the sample, with LIST_SAMPLE
#: sampled vectors each; so a larger corpus calls for a larger sample.
SAMPLE, LIST_SAMPLE, SUBSPACES, CODEWORDS, ROUNDS = 16_384, 128, 8, 64, 8
#: Vectors are compared so many by so many; a task has SIDE times as many of either side, and ranks so many
#: pairs at once. Large tables have larger sides, as what is shuffled goes with the square of the vectors over the
#: side: up to SIDES parts a table, while a side has at most VALUES components.
CHUNK, SIDE, PAIRS = 1024, 4, 1 << 16
SIDES, VALUES = 24, 1 << 20
#: Above the rounding errors of distances, and of squared distances looked up in single precision.
SLACK, LOOKUP_SLACK = 1e-6, 1e-3
#: From this share of pairs on that pass the lookup they are ranked as one product of matrices first.
MANY = 1 / 512
SEED = 11


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(rows, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, at least zero."""
    found = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
    return np.maximum(found, 0)


def nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first, ties to the lower number."""
    return np.argsort(distances(rows, centres), axis=1, kind="stable")[:, :n]


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    codebooks: np.ndarray  # subspace, codeword, component

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        """Residuals by subspace, filled with zeros to equal widths."""
        spaces, _, width = self.codebooks.shape
        filled = np.zeros((len(residuals), spaces * width))
        filled[:, : residuals.shape[1]] = residuals
        return filled.reshape(len(residuals), spaces, width)

    def code(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding errors (distances, not squared)."""
        parts = self.parts(residuals)
        codes = np.stack([nearest(parts[:, s], book, 1)[:, 0] for s, book in enumerate(self.codebooks)], axis=1)
        coded = np.stack([book[codes[:, s]] for s, book in enumerate(self.codebooks)], axis=1)
        return codes, np.sqrt(((parts - coded) ** 2).sum(axis=(1, 2)))

    def lookup(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of every residual to every coded member."""
        parts = self.parts(residuals)
        total = np.zeros((len(residuals), len(codes)))
        for s, book in enumerate(self.codebooks):
            total += distances(parts[:, s], book)[:, codes[:, s]]
        return total

    def passes(self, residuals: np.ndarray, codes: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Where the asymmetric distances can be at most ``within`` (one for each member). The sum of the looked-up
        distances over subspaces is the distance to the member's codewords side by side, so all of them are one
        product of matrices; in single precision, with room for its rounding."""
        parts = self.parts(residuals).reshape(len(residuals), -1)
        words = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.codebooks)], axis=1)
        ours = np.column_stack([parts, (parts**2).sum(1), np.ones(len(parts))])
        theirs = np.column_stack([-2 * words, np.ones(len(words)), (words**2).sum(1) - within**2 - LOOKUP_SLACK])
        return ours.astype(np.float32) @ theirs.astype(np.float32).T <= 0


def fit(sample: np.ndarray) -> Index:
    """Fits the coarse quantiser and the codebooks to unit vectors."""
    rng = np.random.default_rng(SEED)
    centres = k_means(sample, max(1, len(sample) // LIST_SAMPLE), rng)
    residuals = sample - centres[nearest(sample, centres, 1)[:, 0]]
    width = -(-sample.shape[1] // SUBSPACES)
    empty = Index(centres, np.zeros((SUBSPACES, 1, width)))
    parts = empty.parts(residuals)
    books = [k_means(parts[:, s], min(CODEWORDS, len(sample)), rng) for s in range(SUBSPACES)]
    return Index(centres, np.stack(books))


@dataclass(frozen=True)
class Plan:
    """What a list can hold, and the tasks: blocks of lists with consecutive numbers, or chunks of one list."""

    radius: np.ndarray  # of each list; below zero without bound when empty
    between: np.ndarray  # distances of the centres
    firsts: np.ndarray  # each block's first list
    chunks: list[int]  # of each block

    @staticmethod
    def of(index: Index, sizes: dict[int, int], radii: dict[int, float]) -> Plan:
        lists = len(index.centres)
        side = max(SIDE * CHUNK, min(sum(sizes.values()) // SIDES, VALUES // index.centres.shape[1]))
        radius = np.array([radii.get(n, -np.inf) for n in range(lists)])
        firsts, held = [0], [sizes.get(0, 0)]
        for n in range(1, lists):
            if held[-1] + sizes.get(n, 0) > side:
                firsts.append(n)
                held.append(0)
            held[-1] += sizes.get(n, 0)
        between = np.sqrt(distances(index.centres, index.centres))
        return Plan(radius, between, np.array(firsts), [max(1, -(-n // side)) for n in held])

    def asked(self, index: Index, rows: np.ndarray, home: np.ndarray, reach: float, probes: int) -> np.ndarray:
        """Of each row, which lists it asks: of those from its own on, the nearest ``probes`` ones and all
        that can hold a row within reach."""
        apart = distances(rows, index.centres)
        own = np.take_along_axis(apart, home[:, None], 1)
        can = np.sqrt(apart) <= reach + self.radius + SLACK
        can &= apart - own <= 2 * reach * self.between[home] + SLACK
        np.put_along_axis(can, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, 1)
        return can & (self.radius >= 0) & (home[:, None] <= np.arange(len(index.centres)))


def unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    """The vectors at length one, filled with zeros to the width. None may be zero."""
    out = np.zeros((len(vectors), width))
    if len(vectors):
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        out[np.arange(width) < sizes[:, None]] = np.concatenate(vectors.to_list())
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _reach(cosine: float) -> float:
    """The largest distance of unit vectors with that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def _close(members: np.ndarray, codes, errors, asking: np.ndarray, residuals, index: Index, cosine: float):
    """Pairs (asking, member) with at least that cosine: looked up, then ranked exactly."""
    passed = index.passes(residuals, codes, _reach(cosine) + errors + SLACK)
    if np.count_nonzero(passed) > MANY * passed.size:
        passed &= asking.astype(np.float32) @ members.astype(np.float32).T >= cosine - LOOKUP_SLACK
    a, b = np.nonzero(passed)
    cuts = range(0, len(a), PAIRS)
    exact = [np.einsum("ij,ij->i", asking[a[n : n + PAIRS]], members[b[n : n + PAIRS]]) for n in cuts]
    keep = np.concatenate([np.zeros(0), *exact]) >= cosine
    return a[keep], b[keep]


def _forest(left: np.ndarray, right: np.ndarray, left_weight: np.ndarray, right_weight: np.ndarray) -> pd.DataFrame:
    """Of pairs of entries: how many rows each is linked with, and the smallest entry it is connected to."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    links = np.bincount(place, weights=np.concatenate([right_weight, left_weight]), minlength=len(nodes))
    label, p, q = np.arange(len(nodes)), place[: len(left)], place[len(left) :]
    while len(nodes):
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"entry": nodes, "links": links.astype(np.int64), "to": nodes[label]})


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For every row: ``id_col, n_links`` (other rows linked directly), ``component_id`` (the smallest id
    reachable by links, its own included) and ``kept`` (its own id is that).

    Links join rows whose vectors have at least that cosine, by exact double precision. Equal vectors are linked. Vectors that are null, zero or hold null or non-finite
    components link with nothing; shorter vectors count as filled with zeros. Rows with equal ids are
    told apart by place. An empty table gives no rows."""
    spark = vectors.sparkSession
    doubles = F.col(vector_col).cast("array<double>")
    usable = is_valid(doubles) & F.coalesce(F.exists(doubles, lambda x: x != 0), F.lit(False))
    rows, _ = files.written(
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(usable, doubles).alias("vector")),
        "vectors",
    )
    classes, _ = files.written(
        rows.filter("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("row").alias("entry"), F.count("*").alias("weight"), F.min("id").alias("least")),
        "entries",
    )
    sample = classes.orderBy(F.xxhash64("vector"), "entry").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
        )
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    fitted, reach = fit(unit_rows(sample, width)), _reach(cosine)
    sent = spark.sparkContext.broadcast(fitted)  # its size is set by SAMPLE

    def assign(batches):
        index = sent.value
        for batch in batches:
            if len(batch):
                apart = distances(unit_rows(batch["vector"], width), index.centres)
                yield batch.assign(list=apart.argmin(axis=1), away=np.sqrt(apart.min(axis=1)))

    columns = "entry bigint, weight bigint, vector array<double>, list int"
    assigned, place = files.written(
        classes.select("entry", "weight", "vector").mapInPandas(assign, f"{columns}, away double"), "assigned"
    )
    held = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()  # a row for each list
    plan = Plan.of(fitted, {r["list"]: r["n"] for r in held}, {r["list"]: r["away"] for r in held})
    planned = spark.sparkContext.broadcast(plan)

    def ask(batches):
        index, plan = sent.value, planned.value
        for batch in batches:
            if len(batch):
                home = batch["list"].to_numpy()
                asked = plan.asked(index, unit_rows(batch["vector"], width), home, reach, probes)
                blocks = np.logical_or.reduceat(asked, plan.firsts, axis=1)
                own = np.searchsorted(plan.firsts, home, side="right") - 1
                yield batch.drop(columns="away").assign(own=own, asks=[np.flatnonzero(row) for row in blocks])

    asked, _ = files.written(assigned.mapInPandas(ask, f"{columns}, own int, asks array<int>"), "asked")
    files.drop(spark, place)
    number = F.array(*map(F.lit, plan.chunks))  # bounded by the index, like the pairs of blocks
    part = lambda block: F.pmod(F.xxhash64("entry"), number[F.col(block)]).cast("int")
    every = lambda block: F.explode(F.sequence(F.lit(0), number[F.col(block)] - 1))
    row = ["entry", "weight", "vector", "list"]
    asking = asked.select(*row, F.lit(False).alias("is_member"), "own", F.explode("asks").alias("block"))
    member = asked.select(*row, F.lit(True).alias("is_member"), F.col("own").alias("block"))
    member = member.join(F.broadcast(asking.select("own", "block").distinct()), "block")
    dealt = (
        asking.select("*", part("own").alias("a"), every("block").alias("m"))
        .unionByName(member.select("*", every("own").alias("a"), part("block").alias("m")))
        .filter("own <> block OR a <= m")
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        index = sent.value
        out = [pd.DataFrame({"entry": [], "links": [], "to": []}).astype("int64")]
        held, asks = part[part["is_member"].to_numpy()], part[~part["is_member"].to_numpy()]
        if not len(held) or not len(asks):
            return out[0]
        x, y = unit_rows(asks["vector"], width), unit_rows(held["vector"], width)
        asks_id, held_id, home, kind = (t[c].to_numpy() for c in ("entry", "list") for t in (asks, held))
        asks_weight, held_weight = asks["weight"].to_numpy(), held["weight"].to_numpy()
        asked = planned.value.asked(index, x, home, reach, probes)
        one = part["a"].iloc[0] == part["m"].iloc[0]
        for of in np.unique(kind):
            all_of, asking_of = np.flatnonzero(kind == of), np.flatnonzero(asked[:, of])
            for at in range(0, len(all_of), CHUNK):
                members = all_of[at : at + CHUNK]
                codes, errors = index.code(y[members] - index.centres[of])
                for start in range(0, len(asking_of), CHUNK):
                    rows = asking_of[start : start + CHUNK]
                    a, b = _close(y[members], codes, errors, x[rows], x[rows] - index.centres[of], index, cosine)
                    a, b = rows[a], members[b]
                    if one:  # inside one chunk of a list a pair is found from both sides and counts once, by order
                        once = (home[a] != of) | (asks_id[a] < held_id[b])
                        a, b = a[once], b[once]
                    out.append(_forest(asks_id[a], held_id[b], asks_weight[a], held_weight[b]))
        return pd.concat(out)

    found, _ = files.written(dealt.groupBy("own", "block", "a", "m").applyInPandas(compare, "entry bigint, links bigint, to bigint"), "links")
    counts = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots, _ = components.components(found.select(F.col("entry").alias("a"), F.col("to").alias("b")))
    rooted = classes.join(roots, F.col("entry") == F.col("node"), "left").select(
        "vector", "entry", "weight", "least", F.coalesce("root", "entry").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").join(counts, "entry", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    known, _ = files.written(known, "classes")
    return rows.join(known, "vector", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("vector").isNull(), F.col("id").isNotNull()).otherwise(F.col("id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
