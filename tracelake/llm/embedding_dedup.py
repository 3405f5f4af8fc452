"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions, the projections quantised to a
bucket width, and DEPTH of them form the key of one of TABLES tables. Vectors at cosine
0.98 are at most 0.2 apart, so with these parameters one pair in a million at the very
threshold shares no bucket, and closer pairs are missed more rarely still. All pairs of a
bucket are then checked exactly in double precision: those of buckets of at most SMALL
vectors as distinct pairs, larger buckets in blocks of at most BLOCK vectors a side, so
that no task gets more than two blocks and the pairs of a group never become rows. A pair
is counted in the first large bucket that has it, or else once among the distinct pairs.

Exact copies are collapsed before hashing and counted with their multiplicity.

Defined results: only vectors with equal, non-null labels and equal dimension are
compared; null, empty or zero vectors and those with null or non-finite components link
with nothing; rows that repeat an id are vectors of their own; null ids never become a
component id unless a component has no other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, materialize, row_numbers
from tracelake.llm.components import connected_components

THRESHOLD = 0.98
TABLES, DEPTH, WIDTH = 48, 8, 1.0
SMALL, BLOCK = 32, 1024
SEED = 20_240_611


@functools.cache
def _projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    directions = rng.standard_normal((dim, TABLES * DEPTH))
    shifts = rng.uniform(0, WIDTH, TABLES * DEPTH)
    return directions, shifts, rng.integers(1, 1 << 62, DEPTH, dtype=np.int64) * 2 + 1


def hash_tables(units: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key of each row in each table."""
    directions, shifts, mixers = _projections(units.shape[1])
    cells = np.floor((units @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(units), TABLES, DEPTH)
    with np.errstate(over="ignore"):
        return (cells * mixers).sum(axis=2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; a row is scaled by a power of two first, so that no square over- or underflows."""
    size = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    vectors = np.ldexp(vectors, -size)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rows(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), np.float64).reshape(len(payloads), -1)


def _prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, rid, dim, vkey, vec): doubles as bytes and their digest, null for vectors that link with nothing; ``rid`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for batch in batches:
            dims, keys, payloads = [], [], []
            for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = None if v is None or label is None or None in v else np.array(v, np.float64)
                if row is None or not len(row) or not np.isfinite(row).all() or not row.any():
                    dims.append(0), keys.append(None), payloads.append(None)
                    continue
                data = row.tobytes()
                dims.append(len(row)), keys.append(hashlib.blake2b(data, digest_size=16).digest()), payloads.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), numbers(batch.num_rows), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(payloads, pa.binary())],
                names=["id", "label", "rid", "dim", "vkey", "vec"],
            )

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    rows = vectors.select(F.col(id_col), F.col(label_col), F.col(vector_col).cast("array<double>"))
    return map_slices(rows, run, f"id {kinds[id_col]}, label {kinds[label_col]}, rid long, dim int, vkey binary, vec binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(label, dim, t, h, cid): bucket keys of each class in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, dim = np.array(batch.column(0)), np.array(batch.column(2))
            payloads = batch.column(3).to_pylist()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                keys = hash_tables(_unit(_rows([payloads[i] for i in at])))
                index = pa.array(np.repeat(at, TABLES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(index), pa.array(np.repeat(dim[at], TABLES)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))),
                     pa.array(keys.ravel()), pa.array(np.repeat(cid[at], TABLES))],
                    names=["label", "dim", "t", "h", "cid"],
                )

    label = classes.schema["label"].dataType.simpleString()
    return map_slices(classes.select("cid", "label", "dim", "vec"), run, f"label {label}, dim int, t int, h long, cid long")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _in_large(masks: np.ndarray) -> np.ndarray:
    """By row and table: is the row's bucket large? ``masks`` has a bit a table."""
    return (masks[:, None] >> np.arange(TABLES)) & 1 == 1


def check_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, root) of the links among ``pairs``; links that a large bucket counts add none here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, d in ((x, d) for x in batches for d in np.unique(np.array(x.column(8)))):
            batch = whole.filter(pa.array(np.array(whole.column(8)) == d))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            a, b = _unit(_rows(cols["vec_a"].to_pylist())), _unit(_rows(cols["vec_b"].to_pylist()))
            at = np.flatnonzero(np.einsum("ij,ij->i", a, b) >= threshold)
            known = np.zeros(len(at), bool)
            if len(at):
                both = _in_large(np.array(cols["large_a"])[at] & np.array(cols["large_b"])[at])
                known = ((hash_tables(a[at]) == hash_tables(b[at])) & both).any(axis=1)
            ca, cb = np.array(cols["a"])[at], np.array(cols["b"])[at]
            na, nb = (np.where(known, 0, np.array(cols[c])[at]) for c in ("n_a", "n_b"))
            low = np.minimum(ca, cb)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in ((ca, cb), (nb, na), (low, low))], names=["cid", "links", "root"]
            )

    return map_slices(pairs, run, "cid long, links long, root long")


def check_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block pair of a large bucket: (cid, links, root); ``links`` counts vectors met in no large bucket before."""
    pdf = pdf.sort_values("cid")
    t, one, two = (int(pdf[c].iloc[0]) for c in ("t", "one", "two"))
    units = _unit(_rows(pdf["vec"].tolist()))
    cid, n, block = pdf["cid"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["block"].to_numpy()
    keys = np.where(_in_large(pdf["large"].to_numpy(np.int64)), hash_tables(units), 0)
    links, parent = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    left = np.flatnonzero(block == one)
    right = left if one == two else np.flatnonzero(block == two)
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        a, b = np.nonzero(units[rows] @ units[right].T >= threshold)
        i, j = rows[a], right[b]
        if one == two:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i, j, strict=True):
            x, y = _find(parent, x), _find(parent, y)
            parent[max(x, y)] = min(x, y)
        for k in range(0, len(i), 4096):
            x, y = i[k : k + 4096], j[k : k + 4096]
            new = ~((keys[x, :t] == keys[y, :t]) & (keys[x, :t] != 0)).any(axis=1)
            np.add.at(links, x[new], n[y[new]])
            np.add.at(links, y[new], n[x[new]])
    roots = cid[[_find(parent, i) for i in range(len(pdf))]]
    touched = (links > 0) | (roots != cid)
    return pd.DataFrame({"cid": cid[touched], "links": links[touched], "root": roots[touched]})


def link_embeddings(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``."""
    rows = materialize(_prepare(vectors, id_col, vector_col, label_col), "vectors")
    classes = rows.filter("vkey is not null").groupBy("label", "dim", "vkey").agg(
        F.min("rid").alias("cid"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("rep")
    )
    classes = materialize(classes, "classes")
    hashed = materialize(_buckets(classes), "buckets")
    key = ["label", "dim", "t", "h"]
    shared = hashed.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1")
    met = materialize(hashed.join(shared, key), "met")
    few, many = met.filter(F.col("members") <= SMALL), met.filter(F.col("members") > SMALL)
    large = many.groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("large"))
    full = classes.select("cid", "vec", "n").join(large, "cid", "left").withColumn("large", F.coalesce("large", F.lit(0)))
    full = materialize(full.join(met.select("cid").distinct(), "cid", "left_semi"), "met-vectors")
    pairs = few.groupBy(*key).agg(F.array_sort(F.collect_list("cid")).alias("c")).select(
        F.col("dim"), F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")
    ).select("dim", "p.*").distinct()
    one, two = (full.select([F.col(c).alias(x if c == "cid" else f"{c}_{x}") for c in full.columns]) for x in "ab")
    paired = pairs.join(one, "a").join(two, "b").select("a", "b", "vec_a", "vec_b", "n_a", "n_b", "large_a", "large_b", "dim")
    # a large bucket's members are dealt to blocks, and each block to its pairs with the others
    many = many.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("members", "blocks", "other")
    blocks = dealt.join(full, "cid").groupBy(*key, "one", "two").applyInPandas(lambda pdf: check_block(pdf, threshold), "cid long, links long, root long")
    checked = check_pairs(paired, threshold).unionByName(blocks)
    checked = materialize(checked, "links")
    roots = connected_components(checked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = classes.drop("vec").join(checked.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    linked = linked.join(roots, linked.cid == roots.node, "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = linked.join(smallest, "root").select(
        F.col("label").alias("__label"), F.col("dim").alias("__dim"), F.col("vkey").alias("__vkey"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id",
    )
    out = rows.drop("vec").join(
        known, (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim")) & (F.col("vkey") == F.col("__vkey")), "left"
    )
    component = F.when(F.col("__vkey").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
