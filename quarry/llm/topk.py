"""Exact search for the k highest inner products.

Components become integers, floor(scale * x). Queries are dealt out into tiles and rows into blocks of bounded size, each by a hash;
every tile meets every block in a task of its own, in one plan, so nothing goes through the driver and no task grows with the table. A
task holds its tile, multiplies it by one shard of its block after the other, keeps the k best columns of each product, and merges them
into the running lists of its queries. The lists of the blocks then meet in a tree of fan-in FAN: each level merges the lists of FAN
neighbours, until there is one list for each query. Products are taken in doubles as long as every sum stays below 2^53, and else in
unbounded integers, clipped to a long.

Defined cases: rows with a null id, a null vector or a null or non-finite component take no part. Vectors of unequal length are
filled up with zeros. A query's own rows are those with its id. Repeated rows are candidates each; equal query rows are one query.
With fewer than k candidates a query gets them all. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = -(2**63), 2**63 - 1


def whole(vectors: list, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as doubles where these are exact, else as Python integers."""
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    if not len(vectors) or np.abs(x).max(initial=0) * scale < 2**52:
        return np.floor(x * scale)
    return np.array([[math.floor(float(c) * scale) if abs(float(c)) < 2**500 and abs(float(c) * scale) < 2**52 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products; int64, or Python integers clipped to its range."""
    if q.dtype != object and c.dtype != object and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ c.T).astype(np.int64)
    a = [[int(x) for x in r] for r in q]
    b = [[int(x) for x in r] for r in c]
    return np.array([[min(MOST, max(LEAST, sum(x * y for x, y in zip(r, s, strict=True)))) for s in b] for r in a], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of each row's k highest scores among the columns that are not taken, ties to smaller ids. ids ascend."""
    n, m = scores.shape
    if np.abs(scores).max(initial=0) < 2**62 // max(m, 1):
        key = scores * m - np.arange(m)
        key[taken] = LEAST + 1  # its negative is a long, too
        if m > k:
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.broadcast_to(np.arange(m), (n, m))
        rows = np.repeat(np.arange(n), at.shape[1])
        cols = at.reshape(-1)
    else:
        picked = [(r, c) for r in range(n) for c in sorted((c for c in range(m) if not taken[r, c]), key=lambda c: (-int(scores[r, c]), c))[:k]]
        rows, cols = (np.array([p[i] for p in picked], int) for i in (0, 1))
    free = ~taken[rows, cols]
    return rows[free], cols[free]


#: Lists that one step of the tree merges.
FAN = 16


def search(data: DataFrame, is_query, k: int = 5, scale: int = 256, tile: int = 32_768, block: int = 262_144, part: int = 1024, shard: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row for which the column is_query holds."""
    spark = data.sparkSession
    rows = data.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd)
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tiles = -(-asked // tile)
    # blocks of at most about `block` rows; of fewer where the table would else not give every task one
    blocks = -(-n // min(block, max(shard, n * tiles // int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def numbers(m: int):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    queries = rows.where("q").select("vec_id", "v").distinct().withColumn("query", F.xxhash64("vec_id", "v"))
    queries = queries.select(numbers(blocks).alias("b"), F.pmod("query", F.lit(tiles)).cast("int").alias("t"), F.lit(0).alias("side"), "query", "vec_id", "v")
    candidates = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("b"), numbers(tiles).alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("query"), "vec_id", "v")
    dealt = queries.unionByName(candidates).repartition("b", "t").sortWithinPartitions("b", "t", "side")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def best_of(query: np.ndarray, query_id: np.ndarray, q: np.ndarray, kept: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id", kind="stable")
            ids, c, new = rows["vec_id"].to_numpy(), whole([v[: q.shape[1]] for v in rows["v"]], scale, q.shape[1]), [kept]
            for t in range(0, len(q), part):
                scores = products(q[t : t + part], c)
                r, at = best(scores, ids, query_id[t : t + part, None] == ids[None, :], k)
                new.append(pd.DataFrame({"q": t + r, "vec_id": ids[at], "score": scores[r, at]}))
            kept = pd.concat(new).sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            return kept[kept.groupby("q", sort=False).cumcount() < k]

        def lists(at: tuple, query: np.ndarray, query_id: np.ndarray, kept: pd.DataFrame) -> pd.DataFrame:
            of = kept["q"].to_numpy()
            return pd.DataFrame({"query": query[of], "query_id": query_id[of], "vec_id": kept["vec_id"].array, "score": kept["score"].array, "node": np.full(len(of), at[0], np.int32)})

        none = pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        now, held, state = None, [], None
        for frame in frames:
            for at, group in frame.groupby(["b", "t"], sort=False):
                if at != now:
                    if state is not None:
                        yield lists(now, state[0], state[1], state[3])
                    now, held, state = at, [], None
                if state is None:
                    held.append(group[group["side"] == 0])
                rows = group[group["side"] == 1]
                if len(rows) and state is None:
                    own = pd.concat(held)
                    vectors = list(own["v"])
                    state = (own["query"].to_numpy(), own["vec_id"].to_numpy(), whole(vectors, scale, max([len(v) for v in vectors], default=0)), none)
                for s in range(0, len(rows), shard):
                    state = (*state[:3], best_of(*state, rows.iloc[s : s + shard]))
        if state is not None:
            yield lists(now, state[0], state[1], state[3])

    found = dealt.mapInPandas(run, "query long, query_id long, vec_id long, score long, node int")
    while blocks > 1:
        blocks = -(-blocks // FAN)
        found = found.withColumn("node", F.floor(F.col("node") / FAN).cast("int"))
        within = Window.partitionBy("query", "node").orderBy(F.desc("score"), F.asc("vec_id"))
        found = found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
    if "rank" not in found.columns:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))))
    return found.select("query_id", "rank", "vec_id", "score")
