"""Embedding near-duplicates by a subspace pigeonhole join (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

#: Coordinates of a subspace, and vectors of one label that meet in one task, on either side: at least and at most about.
SUBSPACE, CHUNK, MOST = 8, 2048, 16384
#: Chunks that a label gets before they grow beyond CHUNK, so that it is spread over some tasks.
SPREAD = 8
LINKS = "node long, n long, other long"


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix, so that no subspace depends on how the coordinates were ordered."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def candidates(a: np.ndarray, b: np.ndarray, budget: float) -> np.ndarray:
    """Which pairs of rotated unit vectors may be within a squared distance of ``budget``.

    If they are, then in one subspace at least the squared distance is within that subspace's share of the budget. So
    the union of the subspaces' range joins misses none.
    """
    dim = a.shape[1]
    out = np.zeros((len(a), len(b)), bool)
    for s in range(0, dim, SUBSPACE):
        x, y = a[:, s : s + SUBSPACE].astype(np.float32), b[:, s : s + SUBSPACE].astype(np.float32)
        share = budget * x.shape[1] / dim
        # range-sorted on one coordinate: a row meets only those within the share's root of it
        width = math.sqrt(share) + 1e-4
        order = np.argsort(y[:, 0], kind="stable")
        y = y[order]
        rows = np.argsort(x[:, 0], kind="stable")
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            lo = int(np.searchsorted(y[:, 0], x[part[0], 0] - width)) if len(part) else 0
            hi = int(np.searchsorted(y[:, 0], x[part[-1], 0] + width)) if len(part) else 0
            if hi > lo:
                p, q = x[part], y[lo:hi]
                d = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
                i, j = np.nonzero(d <= share + 1e-5)
                out[part[i], order[lo + j]] = True
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what was not joined yet."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in pairs.tolist():
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _meet(least: float):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, dim, i, j = key
        g = g.sort_values(["side", "node"], kind="stable")
        v = np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), int(dim))
        unit = v / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(1, keepdims=True)
        turned = unit @ rotation(int(dim))
        node, n = g["node"].to_numpy(), g["n"].to_numpy()
        first = int((g["side"] == 0).sum())
        left, right = np.arange(first), np.arange(first, len(g)) if i != j else np.arange(first)
        got = []
        for s in range(0, len(left), 512):  # bounds the matrices, also where a hash deals unevenly
            own = left[s : s + 512]
            for t in range(0, len(right), 4096):
                other = right[t : t + 4096]
                p, q = np.nonzero(candidates(turned[own], turned[other], 2 - 2 * least))
                p, q = own[p], other[q]
                near = p < q if i == j else slice(None)
                p, q = p[near], q[near]
                for u in range(0, len(p), 65536):  # verified in double precision
                    x, y = p[u : u + 65536], q[u : u + 65536]
                    ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                    got.append(np.stack([x[ok], y[ok]], 1))
        links = np.concatenate(got) if got else np.zeros((0, 2), np.int64)
        total = np.bincount(links[:, 0], n[links[:, 1]], len(g)) + np.bincount(links[:, 1], n[links[:, 0]], len(g))
        some = np.flatnonzero(total)
        edges = _forest(len(g), links)
        return pd.DataFrame(
            {
                "node": np.concatenate([node[some], [node[x] for x, _ in edges]]).astype(np.int64),
                "n": np.concatenate([total[some], np.zeros(len(edges))]).astype(np.int64),
                "other": pd.array([None] * len(some) + [int(node[y]) for _, y in edges], "Int64"),
            }
        )

    return run


def link_vectors(vectors: DataFrame, least: float = 0.93, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; two rows link if labels are equal and the cosine reaches ``least``.

    Equal vectors of a label are taken together first, so copies cost one row and are counted, not paired. The others
    are dealt into chunks by hash; each pair of a label's chunks meets in a task of bounded size, so a label with most
    rows is spread over as many tasks as it has pairs of chunks. Chunks hold about ``chunk`` vectors, more only where a
    label would have over 8, and ``most`` at most, as each vector is sent to a task for each chunk of its label. A task
    returns counts for each vector and the links of a spanning forest, not its pairs. Vectors that are null, zero, or
    hold null or non-finite values, and rows with a null label, link with nothing; vectors of unequal length don't link.
    Rows that repeat a vec_id are vectors of their own; a row with a null vec_id counts as a link of others but has no
    component. An empty table gives none; other columns are ignored.
    """

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = None
                if v and label is not None and not any(y is None for y in v):
                    x = np.array(v, np.float64)
                    x = x if np.isfinite(x).all() and x.any() else None
                out.append(None if x is None else (x + 0.0).tobytes())  # + 0.0: one zero
                dims.append(None if x is None else len(x))
            cols = [b.column(0), b.column(2), pa.array(dims, pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    rows = _common.stage(rows.mapInArrow(_common.lean(prepare), "vec_id long, label long, dim int, vec binary"), "vectors")
    own = rows.where("vec is not null").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    own = _common.stage(own.withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = F.count("*")
    k = F.greatest(F.ceil(n / most), F.least(F.ceil(n / chunk), F.lit(SPREAD))).cast("int")
    sizes = _common.stage(own.groupBy("label", "dim").agg(k.alias("k")), "sizes")
    dealt = own.join(_common.bounded(sizes, 24), ["label", "dim"]).withColumn("c", F.pmod(F.xxhash64("vec"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    meets = dealt.select(
        "label", "dim", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "node", "n", "vec",
        F.when(F.col("c") <= F.col("d"), 0).otherwise(1).alias("side"),
    )
    found = _common.stage(meets.groupBy("label", "dim", "i", "j").applyInPandas(_meet(least), LINKS), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    parts = _common.edges_to_components(found.where("other is not null"), "node", "other")
    known = own.join(counts, "node", "left").join(parts, "node", "left").select(
        "label", "dim", "vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("top"),
    )
    known = _common.stage(known, "known")
    # a component is told by its least vec_id
    ids = known.groupBy("top").agg(F.min("least").alias("component_id"))
    known = _common.spread_join(known, ids, ["top"], F.xxhash64("vec")).select("label", "dim", "vec", "n_links", "component_id")
    linked = _common.spread_join(rows.where("vec is not null"), known, ["label", "dim", "vec"], F.xxhash64("vec_id"))
    out = linked.select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = r"""
with recursive v as (
  select row_number() over () as k, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as (
  select k, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), l as (
  select a.k as a, b.k as b, b.vec_id as to_id from ok a join ok b on a.label = b.label and a.k <> b.k and len(a.e) = len(b.e) and a.norm > 0 and b.norm > 0
  where list_cosine_similarity(a.e, b.e) >= 0.93
), r as (
  select k, k as other, vec_id as least from v
  union
  select r.k, l.b, l.to_id from r join l on l.a = r.other
), c as (select k, min(least) as component_id from r group by 1), n as (select a as k, count(*) as n from l group by 1)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept from v join c using (k) left join n using (k)
"""
