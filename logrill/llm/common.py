"""What several operators of this folder share: tables, folds, hashes over arrays, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int, left_out: int):
    """Whether a row is held out: crc32 of the key's text, by remainder. A null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == left_out, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads structured keys over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random 64-bit value per byte, and an odd base with its inverse, for hashes of stretches of bytes.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each data[start:end] of bytes, equal for equal stretches wherever they stand."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=total[1:])
        back = powers(INVERSE, len(data) + 1)
        return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


EDGES = 1 << 18  # edges that a task joins into trees at a time


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of undirected edges, and for each the smallest node of its component."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = of[:len(a)], of[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _stars(edges: DataFrame, bound: int, roots: bool = False) -> DataFrame:
    """Edges (u, v) that connect what edges (u, v) do: of up to `bound` at a time, from each node to the smallest it reaches."""
    def run(batches):
        held, size = [], 0

        def joined():
            nodes, least = forest(*(np.concatenate(x) for x in zip(*held)))
            return (nodes, least) if roots else (nodes[nodes != least], least[nodes != least])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            size += batch.num_rows
            if size > 2 * bound:
                u, v = joined()
                held, size = [[u, v]], len(u)
                if size > bound:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str, bound: int = EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the smallest id.

    Tasks first replace up to `bound` edges at a time by stars; while that makes them
    fewer, fewer tasks do it again. What `bound` edges are left of is ended by one
    task. More go through alternating large-star and small-star rounds; every round is
    a minimum per node (combined before the shuffle) and an equi-join, written to the
    shared folder. Nodes without an edge are not listed.
    """
    edges = materialize(_stars(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), bound), name)
    n, before = edges.count(), None
    while n > bound and (before is None or n < 0.7 * before):
        edges, before = materialize(_stars(edges.coalesce(-(-n // bound)), bound), name), n
        n = edges.count()
    state = None
    while n > bound:
        # large star: every larger neighbour of u moves to the smallest node around u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours move to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        n, *now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if [n, *now] == state:
            break
        state = [n, *now]
    if n <= bound:
        return _stars(edges.coalesce(1), bound, roots=True).toDF("id", "component")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
