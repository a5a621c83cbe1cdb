"""Operator 9: near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_join, parts, settle, table, trimmed, utf8
from .components import connected_components

#: Rows of one bucket that are compared with each other at once; larger buckets are cut into pairs of blocks.
BLOCK = 1024


def plan_tables(n: float, threshold: float, recall: float, mean_bucket: int = 64) -> tuple[int, int]:
    """(tables, bits): buckets of about mean_bucket of n comparable rows, and as many tables as the recall of a pair at the threshold needs."""
    bits = min(28, max(6, math.ceil(math.log2(max(n, 1) / mean_bucket + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree))), bits


#: Largest whole number of a component of a vector as it travels to buckets.
STEPS = 32_767


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sign(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The unit vector in 16-bit steps (small) of a size of its own (step), half the bytes of floats, and keys: one 32-bit number a table."""
    planes: dict[int, np.ndarray] = {}
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
    for batch in batches:
        if not batch.num_rows:
            continue
        spot = batch.schema.get_field_index("vector")
        column = batch.column(spot)
        sizes = np.asarray(pc.list_value_length(column))
        small: list[bytes] = [b""] * batch.num_rows
        step = np.zeros(batch.num_rows)
        keys = np.zeros((batch.num_rows, tables), np.int32)
        for dim in np.unique(sizes):
            at = np.nonzero(sizes == dim)[0]
            x = np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), int(dim))
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
            keys[at] = ((x.astype(np.float64) @ planes[dim]) > 0).reshape(len(at), tables, bits) @ weights
            unit = _unit(x)
            step[at] = np.abs(unit).max(1) / STEPS
            for i, row in zip(at.tolist(), np.rint(unit / step[at][:, None]).astype("<i2"), strict=True):
                small[i] = row.tobytes()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
        rest = [c for i, c in enumerate(batch.columns) if i != spot]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(small, pa.binary()), pa.array(step), lists], [*(x for x in batch.schema.names if x != "vector"), "small", "step", "keys"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, its name in the first columns up to pair. Emits (node, other, links, a, b): counts have no other, forest edges no links, and pairs that are too near the threshold to tell carry the numbers a and b of their rows.

    A pair counts only in the first table whose keys agree, so once. Rounding to steps moves a cosine by no more than half a step times the root of the length, for either vector; beyond
    that distance from the threshold a pair is decided here for good.
    """
    out: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None, np.ndarray | None]] = []

    def judge(held: pa.RecordBatch) -> None:
        if held.num_rows < 2:
            return
        col = lambda name: held.column(held.schema.get_field_index(name))
        n, dim = held.num_rows, col("dim")[0].as_py()
        data, _ = utf8(col("small"))
        step = np.asarray(col("step"))
        x = data.view("<i2").reshape(n, dim) * step[:, None]
        off = 0.5 * step * math.sqrt(dim)
        ids, side, mult, uid = (np.asarray(col(c)) for c in ("rep", "side", "copies", "uid"))
        left, right = np.nonzero(side <= 0)[0], np.nonzero(side >= 0)[0]
        est = x[left] @ x[right].T
        slack = off[left][:, None] + off[right][None, :] + off[left][:, None] * off[right][None, :] + 1e-12
        other = ids[left][:, None] != ids[right][None, :]
        near, close = (est >= threshold + slack) & other, (np.abs(est - threshold) < slack) & other
        if not near.any() and not close.any():
            return
        keys = np.asarray(col("keys").flatten()).reshape(n, col("tab")[0].as_py())  # those of the tables before
        fresh = np.ones_like(near)
        for t in range(col("tab")[0].as_py()):
            fresh &= keys[left, t][:, None] != keys[right, t][None, :]
        new = near & fresh
        doubt = close & fresh
        if (side == 0).all():
            doubt = np.triu(doubt, 1)
        i, j = np.nonzero(doubt)
        if len(i):
            i, j = left[i], right[j]
            out.append((ids[i], ids[j], None, uid[i], uid[j]))
        count = np.zeros(n, np.int64)
        if (side == 0).all():
            count += new @ mult
        else:
            count[left] += new @ mult[right]
            count[right] += new.T @ mult[left]
        full = np.zeros((n, n), bool)
        full[np.ix_(left, right)] = near
        full |= full.T
        label = np.arange(n)
        while True:
            least = np.minimum(label, np.where(full, label[None, :], n).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        linked, led = np.nonzero(count)[0], np.nonzero(label != np.arange(n))[0]
        out.append((ids[linked], None, count[linked], None, None))
        out.append((ids[led], ids[label[led]], None, None, None))

    def flush() -> pa.RecordBatch:
        none = lambda x, k: pa.array(x) if x is not None else pa.nulls(k, pa.int64())
        cols = [pa.concat_arrays([none(x[i], len(x[0])) for x in out]) if out else pa.array([], pa.int64()) for i in range(5)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["node", "other", "links", "a", "b"])

    carry = None
    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches(max_chunksize=1 << 62)[0]
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for c in batch.columns[: batch.schema.get_field_index("pair") + 1]:
            edge[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        at = np.nonzero(edge)[0].tolist()
        for i, j in zip(at, at[1:], strict=False):
            judge(batch.slice(i, j - i))
        carry = batch.slice(at[-1])
        if sum(len(x[0]) for x in out) > 20_000:
            yield flush()
    if carry is not None:
        judge(carry)
    yield flush()


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose cosine in double precision is at the threshold or above, of rows with vectors va and vb."""
    for batch in batches:
        if not batch.num_rows:
            continue
        va, vb = (batch.column(batch.schema.get_field_index(c)) for c in ("va", "vb"))
        sizes = np.asarray(pc.list_value_length(va))
        good = np.zeros(batch.num_rows, bool)
        for dim in np.unique(sizes):
            at = np.nonzero(sizes == dim)[0]
            x, y = (_unit(np.asarray(v.take(pa.array(at)).flatten()).reshape(len(at), int(dim))) for v in (va, vb))
            good[at] = (x * y).sum(1) >= threshold
        kept = batch.filter(pa.array(good))
        names = ["node", "other", "copies_a", "copies_b"]
        yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(c)) for c in names], names)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length are compared. Equal vectors are one vertex that
    carries its number of copies, so a group of copies costs one row; different vectors meet in the
    buckets of several hash tables. Vectors travel to buckets in 16-bit steps, which decide every pair but those within a proven distance
    of the threshold; these few meet their vectors again and are verified by cosine in double precision. Buckets of more than BLOCK rows are compared block by block, in full.
    Null, zero or empty vectors, vectors with null or non-finite components, and rows with null id or
    label have n_links 0 and their own id as component. Rows with one id and one vector are copies of
    each other; one id with several vectors is one vertex of the graph. An empty table gives an empty result.
    Further input columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), (F.col(vector_col) if dict(vectors.dtypes)[vector_col] in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")).alias("vector"))
    rows = rows.withColumn("fit", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False)))
    fit = rows.filter("fit")
    reps = fit.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = settle(reps.withColumns({"dim": F.size("vector"), "uid": F.monotonically_increasing_id()}))
    peers = reps.groupBy("label", "dim").count().agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("n")).first().n or 1.0
    tables, bits = plan_tables(peers, threshold, recall)

    signed = settle(reps.mapInArrow(lambda b: trimmed(_sign(b, tables, bits, seed)), T.StructType([f for f in reps.schema.fields if f.name != "vector"] + [T.StructField("small", T.BinaryType()), T.StructField("step", T.DoubleType()), T.StructField("keys", T.ArrayType(T.IntegerType()))])))
    keyed = F.posexplode("keys").alias("tab", "bucket")
    counts = signed.select("label", "dim", keyed).groupBy("label", "dim", "tab", "bucket").count()
    large = settle(counts.filter(F.col("count") > BLOCK).select("label", "dim", "tab", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    spread = lookup_join(signed.select("label", "dim", "rep", "uid", "copies", "small", "step", "keys", keyed), large, ["label", "dim", "tab", "bucket"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = spread.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("pair", F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")).withColumn("side", F.signum(F.col("own") - F.col("with")).cast("int"))
    bucket = ["label", "dim", "tab", "bucket", "pair"]
    sorted_rows = spread.select(F.xxhash64(*bucket).alias("place"), *bucket, "side", "rep", "uid", "copies", "small", "step", F.slice("keys", 1, F.col("tab")).alias("keys")).repartition(parts(spark), "place").sortWithinPartitions("place", *bucket)
    found = settle(sorted_rows.mapInArrow(lambda b: trimmed(_compare(b, threshold)), "node bigint, other bigint, links bigint, a bigint, b bigint"))
    of = lambda x: reps.select(F.col("uid").alias(x), F.col("vector").alias(f"v{x}"), F.col("copies").alias(f"copies_{x}"))
    doubt = found.filter("a is not null").select("node", "other", "a", "b").join(of("a"), "a").join(of("b"), "b")
    sure = settle(doubt.select("node", "other", "copies_a", "copies_b", "va", "vb").mapInArrow(lambda b: trimmed(_exact(b, threshold)), "node bigint, other bigint, copies_a bigint, copies_b bigint"))

    counted = found.filter("other is null").select("node", "links").unionByName(sure.select("node", F.col("copies_b").alias("links"))).unionByName(sure.select(F.col("other").alias("node"), F.col("copies_a").alias("links")))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("other is not null and a is null").select("node", "other").unionByName(sure.select("node", "other")))
    facts = reps.join(links, F.col("rep") == F.col("node"), "left").drop("node").join(comps, F.col("rep") == F.col("node"), "left")
    facts = facts.select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = fit.join(facts, ["label", "vector"], "left").select("id", "n_links", "component_id")
    rest = rows.filter("not fit").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
