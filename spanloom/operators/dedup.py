"""Bit signatures, exact banded Hamming joins and duplicate classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import components
from spanloom.storage import saved

#: Nodes of a block of one bucket, and rows of a batch of buckets.
BLOCK, BATCH = 1024, 20_000


def difference_bits(values: Column, n: int) -> Column:
    """array<int> of n - 1 bits: whether each value exceeds the one before it (a difference hash's bit step)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: (F.element_at(values, i + 1) > F.element_at(values, i)).cast("int"))


def pack_bits(bits: Column, n: int) -> Column:
    """array<long> of 64-bit words, first bit highest, the last word filled with zeros."""
    words = []
    for first in range(0, n, 64):
        size = min(64, n - first)
        word = F.aggregate(F.slice(bits, first + 1, size), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))
        words.append(F.shiftleft(word, 64 - size))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bands(words: Column, bits: int, distance: int) -> Column:
    """array<struct<band,value>> of distance + 1 bands of nearly equal width, as bit strings.

    Two signatures within the distance agree on a whole band (pigeonhole), so joining on bands loses no pair.
    """
    text = F.substring(F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 64, "0")), ""), 1, bits)
    n = min(bits, distance + 1)
    edges = [bits * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(text, edges[i] + 1, edges[i + 1] - edges[i]).alias("value")) for i in range(n)])


def verify(distance: int):
    """The function of one batch of buckets: per node, the rows linked to it there and its root.

    A pair counts in the first band that it shares only, so nothing is counted twice. Buckets are compared in pairs of
    blocks, as matrices of differing bits.
    """

    def run(table: pa.Table) -> pa.Table:
        words = np.stack([np.asarray(x, np.int64) for x in table.column("words").to_pylist()]).view(np.uint64)
        keys = [table.column(c).to_pylist() for c in ("band", "value", "one", "two")]
        block, weight = table.column("block").to_numpy(), table.column("weight").to_numpy().astype(np.float64)
        band_of = table.column("values").combine_chunks().flatten().to_numpy().reshape(len(words), -1)
        links, root = np.zeros(len(words)), np.arange(len(words))
        order = sorted(range(len(words)), key=lambda i: (*(k[i] for k in keys), i))
        same = [i for i in range(1, len(order)) if any(k[order[i]] != k[order[i - 1]] for k in keys)]
        for rows in np.split(np.array(order), same):
            band, one, two = keys[0][rows[0]], keys[2][rows[0]], keys[3][rows[0]]
            w = words[rows]
            far = sum(np.bitwise_count(w[:, None, k] ^ w[None, :, k]).astype(np.int32) for k in range(w.shape[1]))
            linked = far <= distance
            np.fill_diagonal(linked, False)
            if one != two:
                linked &= block[rows][:, None] != block[rows][None, :]
            a, b = np.nonzero(linked)
            first = (band_of[rows[a]] == band_of[rows[b]]).argmax(1) == band
            a, b = a[first], b[first]
            links[rows] += np.bincount(a, weight[rows][b], len(rows))
            local = np.arange(len(rows))
            while True:
                least = local.copy()
                np.minimum.at(least, a, local[b])
                if (least == local).all():
                    break
                local = least
            root[rows] = rows[local]
        found = np.flatnonzero(links)
        node = table.column("node")
        return pa.table({"node": node.take(pa.array(found)), "links": pa.array(links[found].astype(np.int64)), "root": node.take(pa.array(root[found]))})

    return run


def near_classes(df: DataFrame, id_: str, words: str, bits: int, distance: int) -> DataFrame:
    """id, class_id, n_links: a row per id. Ids whose signatures differ in at most ``distance`` bits are linked; class_id is
    the least id connected through links, n_links the number of ids linked to this one.

    Equal signatures are one node. Nodes that share a band meet in the band's bucket (lossless, see bands); a bucket of more
    than BLOCK nodes is dealt in pairs of blocks, and batches of buckets are one task. No pair becomes a row.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(words).alias("words"))
    nodes = saved(rows.where(F.col("words").isNotNull()).groupBy("words").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "signatures")
    cut = F.transform(bands(F.col("words"), bits, distance), lambda k: F.xxhash64(k["band"], k["value"]))
    placed = nodes.withColumn("values", cut).select("*", F.posexplode("values").alias("band", "value"))
    sizes = placed.groupBy("band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    met = placed.join(sizes, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "words", "weight", "values", "band", "value", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    dealt = saved(dealt, "buckets")
    batches = max(1, dealt.count() // BATCH)
    kind = nodes.schema["node"].dataType.simpleString()
    batch = F.pmod(F.xxhash64("band", "value", "one", "two"), F.lit(batches))
    checked = saved(dealt.groupBy(batch.alias("batch")).applyInArrow(verify(distance), f"node {kind}, links long, root {kind}"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(links, "node", "left").join(labels, "node", "left")
    known = known.select("words", F.coalesce("label", "node").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.join(known, "words", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def merge_duplicate_groups(df: DataFrame, group: str, order: str, words: str, bits: int, distance: int) -> DataFrame:
    """group, canonical: the least group of those connected through near-equal signatures; one signature per group, its first row's."""
    first = df.where(F.col(words).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.min_by(words, order).alias("w"))
    classes = near_classes(first, "g", "w", bits, distance).select(F.col("id").alias("group"), "class_id")
    groups = df.select(F.col(group).alias("group")).distinct()
    return groups.join(classes, "group", "left").select("group", F.coalesce("class_id", "group").alias("canonical"))
