"""The nearest rows of every row, by matrix products of pairs of blocks.

Rows are dealt to blocks of bounded size, any two blocks meet in one task, and a task hands on the few nearest of each of its
rows only. So what is held is bounded and what is shuffled grows with rows times blocks; the products are quadratic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import meeting
from .similarity import _unit

#: Rows of each side that are multiplied at once; how many candidates for each place are sorted as they are; decimals on which distances tie.
TILE, FEW, PLACES = 512, 8, 9


class _Nearest:
    """Of each of ``n`` rows the ``k`` nearest so far, by distance on ``PLACES`` decimals, then by place."""

    def __init__(self, n: int, k: int):
        self.rank, self.far, self.at = np.full((n, k), np.inf), np.full((n, k), np.inf), np.full((n, k), -1)

    def offer(self, first: int, likeness: np.ndarray, at: int, across: bool = False) -> None:
        """Cosines of the rows from ``first`` on with the others from ``at`` on, which stand by key; nan where two don't count.

        ``across``: the rows are the columns of ``likeness``.
        """
        n, k = likeness.shape[across], self.far.shape[1]
        least = 1 - self.rank[first : first + n, -1] - 10.0**-PLACES
        i, j = np.divmod(np.flatnonzero(likeness >= (least if across else least[:, None])), likeness.shape[1])[:: -1 if across else 1]
        many = np.bincount(i, minlength=n) > FEW * k
        if many.any():
            some = np.flatnonzero(many)
            rank = np.round(1 - np.clip(likeness[:, some].T if across else likeness[some], -1, 1), PLACES)
            nearer = rank <= np.partition(rank, k - 1, axis=1)[:, k - 1 : k]
            tied = np.flatnonzero(nearer.sum(1) > FEW * k)
            nearer[tied] = False
            nearer[tied[:, None], np.argsort(rank[tied], axis=1, kind="stable")[:, :k]] = True
            more, rest = np.nonzero(nearer), ~many[i]
            i, j = np.concatenate([i[rest], some[more[0]]]), np.concatenate([j[rest], more[1]])
        if not len(i):
            return
        far = 1 - np.clip(likeness[j, i] if across else likeness[i, j], -1, 1)
        met = np.unique(i)
        held = first + met
        row, place = np.concatenate([i, np.repeat(met, k)]), np.concatenate([at + j, self.at[held].ravel()])
        far, rank = np.concatenate([far, self.far[held].ravel()]), np.concatenate([np.round(far, PLACES), self.rank[held].ravel()])
        order = np.lexsort((place, rank, row))
        starts = np.searchsorted(row[order], met)
        best = order[starts[:, None] + np.arange(k)]
        self.rank[held], self.far[held], self.at[held] = rank[best], far[best], place[best]


def _pair(table: pa.Table, key: str, k: int) -> pa.Table:
    """(query, key, distance) of the k nearest that each row of a pair of blocks has in the other block, or in its own."""
    table = table.combine_chunks().sort_by("node")
    side, vectors = table.column("side").to_numpy(), table.column("v").combine_chunks()
    unit = _unit(vectors.flatten().to_numpy().reshape(len(table), -1).astype(float))
    own = side[0] == 0
    places = [np.flatnonzero(side < 2)] * 2 if own else [np.flatnonzero(side == s) for s in (1, 2)]
    a, b = (unit[p] for p in places)
    name = table.column("node").combine_chunks().dictionary_encode().indices.to_numpy()
    best = [_Nearest(len(p), k) for p in places]
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            likeness = a[i : i + TILE] @ b[j : j + TILE].T
            if own:
                likeness[name[i : i + TILE, None] == name[None, j : j + TILE]] = np.nan
            else:
                best[1].offer(j, likeness, i, across=True)
            best[0].offer(i, likeness, j)
    out = []
    for found, mine, theirs in ((best[0], *places),) if own else ((best[0], *places), (best[1], *places[::-1])):
        row, rank = np.nonzero(found.at >= 0)
        keys = table.column("node")
        out.append(pa.table({"query": keys.take(pa.array(mine[row])), key: keys.take(pa.array(theirs[found.at[row, rank]])), "distance": found.far[row, rank]}))
    return pa.concat_tables(out)


def nearest_of_all(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, distance, rank): the k nearest other rows of every row by cosine distance, ties on ``PLACES`` decimals by key.

    Null vectors have no neighbours, and zero vectors are at distance 1 of all. Rows of one key are no neighbours of each other.
    """
    base = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("node"), F.col(vector).alias("v"))
    kind = dict(base.dtypes)["node"]
    found = meeting(base, base.count()).applyInArrow(lambda table: _pair(table, key, k), f"query {kind}, `{key}` {kind}, distance double")
    w = Window.partitionBy("query").orderBy(F.round("distance", PLACES), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
