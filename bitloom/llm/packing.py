"""Items of varying size in containers of fixed capacity, best fit under conflicts.

Items are dealt to shards of bounded size by a hash, and each shard is packed on its own, largest first: the open
containers are kept in order of their residual space and carry the sets of sources and duplicate clusters they hold; from the
tightest container with room the search goes on to its successors until one without the item's cluster is found. A shard
leaves one or two containers part empty, which is nothing beside the thousands that it fills.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard.
SHARD_ITEMS = 20_000
#: Successors looked at one by one before all containers are compared at once (with the same result).
STEPS = 32


class Containers:
    """Open containers of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, container), containers with room only
        self.residual: list[int] = []
        self.sources: list[set] = []
        self.members: dict[object, list[int]] = {}  # duplicate cluster -> its containers
        self.clusters: list[set] = []

    def _find(self, size: int, cluster: object, source: object) -> int | None:
        at = bisect_left(self.order, (size, -1))
        for k in range(at, min(at + STEPS, len(self.order))):
            residual, i = self.order[k]
            if cluster is None or cluster not in self.clusters[i]:
                # of equally tight ones that follow, one that lacks the source
                for r, j in self.order[k : k + 4]:
                    if r != residual:
                        break
                    if source not in self.sources[j] and (cluster is None or cluster not in self.clusters[j]):
                        return j
                return i
        if at + STEPS >= len(self.order):
            return None
        rest = np.array([i for _, i in self.order[at + STEPS :]])
        free = ~np.isin(rest, np.array(self.members.get(cluster, [-1])))
        return int(rest[free.argmax()]) if free.any() else None

    def put(self, size: int, cluster: object, source: object) -> int:
        i = self._find(size, cluster, source)
        if i is None:
            i = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(set())
            self.clusters.append(set())
        else:
            del self.order[bisect_left(self.order, (self.residual[i], i))]
        self.residual[i] -= size
        self.sources[i].add(source)
        if cluster is not None:
            self.clusters[i].add(cluster)
            self.members.setdefault(cluster, []).append(i)
        if self.residual[i]:
            insort(self.order, (self.residual[i], i))
        return i


def pack_shard(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(container, item, piece, size) for items (id, size, cluster, source) of one shard.

    Items over the capacity are split into full containers and a rest, which is packed like an item; others never.
    Items of size 0 or less, or without a size, get no container.
    """
    bins, out, left = Containers(capacity), [], []
    for item, size, cluster, source in items:
        piece = 0
        while size > capacity:
            i = len(bins.residual)
            bins.residual.append(0)
            bins.sources.append({source})
            bins.clusters.append({cluster})
            out.append((i, item, piece, capacity))
            size, piece = size - capacity, piece + 1
        if size > 0:
            left.append((size, item, piece, cluster, source))
    for size, item, piece, cluster, source in sorted(left, key=lambda x: (-x[0], x[1])):
        out.append((bins.put(size, cluster, source), item, piece, size))
    return out


def pack(items: DataFrame, capacities: dict[int, int], n_items: int) -> DataFrame:
    """(pack_id, container_id, doc_id, piece, tokens) for ``items`` (doc_id, tokens, cluster, source).

    No container holds two items of one ``cluster`` (null: no cluster). ``capacities`` is a fixed small table.
    """
    if not capacities:
        return items.sparkSession.createDataFrame([], "pack_id int, container_id string, doc_id long, piece int, tokens long")
    shards = max(1, -(-n_items // SHARD_ITEMS))
    packs = F.array(*[F.struct(F.lit(k).alias("pack_id"), F.lit(c).alias("capacity")) for k, c in sorted(capacities.items())])
    dealt = items.select("doc_id", "tokens", "cluster", "source", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(packs).alias("p"))
    dealt = dealt.select("doc_id", "tokens", "cluster", "source", "shard", "p.pack_id", "p.capacity").repartition(min(shards * len(capacities), 2000), "pack_id", "shard")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pack_id, shard = key
        if not len(rows):
            return pd.DataFrame(columns=["pack_id", "container_id", "doc_id", "piece", "tokens"])
        clusters = [None if pd.isna(c) else int(c) for c in rows["cluster"]]
        packed = pack_shard(list(zip(rows["doc_id"].tolist(), rows["tokens"].tolist(), clusters, rows["source"].tolist())), int(rows["capacity"].iloc[0]))
        if not packed:
            return pd.DataFrame(columns=["pack_id", "container_id", "doc_id", "piece", "tokens"])
        out = pd.DataFrame(packed, columns=["container", "doc_id", "piece", "tokens"])
        return pd.DataFrame({"pack_id": pack_id, "container_id": out["container"].map(lambda i: f"{shard}-{i}"), "doc_id": out["doc_id"], "piece": out["piece"], "tokens": out["tokens"]})

    return dealt.groupBy("pack_id", "shard").applyInPandas(run, "pack_id int, container_id string, doc_id long, piece int, tokens long")
