"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Sets hold the hashes of five consecutive words ([0-9a-z] and non-ASCII characters, A-Z lower-cased); a text of one to four words has one
n-gram of all of them. Texts with equal sets are one node, so copies of any number cost one row each and no pairs.
Rows and bands are chosen so that a pair at the threshold shares a band with probability ``recall``.

1. Parts. The hub of a band bucket is its least node. A node is linked to the least of its hubs, and the other hubs to that
   one: at most a link per node and one per pair of hubs. Components of these links, the parts, hold every candidate pair.
2. Pivots. A part's pivot is the node whose buckets hold most nodes. Every other node keeps only the n-grams in which it
   differs from the pivot (delta): one row per node, whatever the size of the part.
3. Counts. |A+B|, the size of the symmetric difference, is a metric, and J(A, B) >= p/q says (q+p) |A+B| <= (q-p) (|A|+|B|).
   With u(A) = (q-p) |A| - (q+p) |delta A|, a pair with u(A) + u(B) >= 0 is linked by the triangle inequality. These links
   are counted by running sums over the different values of u in the part, with no pair formed.
4. Blocks. The other pairs, u(A) + u(B) < 0, are linked if (q+p) 2 |delta A & delta B| makes up what is missing. A part
   is dealt into blocks of bounded size, and a pair of blocks is one task, in which overlaps of all its nodes are a matrix
   product. Linked nodes lie in the same or in neighbouring rings of distance from the pivot, so other block pairs are
   not formed, nor are those of two blocks of u >= 0. No pair becomes a row, and no group becomes one task.
5. Classes. Links to the pivot, and in each task the links of each node to its root there, are edges of a second run of
   components.

Rows are linear in the nodes, but for those of nodes with u < 0 in a part of more than BLOCK_NODES nodes: such a node has
a row of its delta for each block of its own and the neighbouring rings.

Result: class_id, the least doc_id of the documents connected through pairs of Jaccard >= threshold, and n_links, the
number of other documents in such a pair with this one (copies included), exact within parts.

Edge cases: null text or text without words is alone: class_id is its doc_id, n_links 0. Null ids take part; the class id
is null only if all ids of the class are. Repeated rows are copies. A null id or text differs from any string.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices
from spanloom.llm.common import one_row_each, row_key, saved
from spanloom.llm.textnum import ALNUM, FOLDED_VALUES, Powers, mix, span_hashes, windows, word_bounds
from spanloom.operators.graph import components

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: A block's bounds: nodes, and n-grams of their deltas in all. Nodes that meet one copy of their pivot.
BLOCK_NODES, BLOCK_GRAMS, SALT_NODES = 1024, 400_000, 256
#: Columns of an intersection with at most this many entries are counted pair by pair, others by a matrix product.
LIGHT = 48


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, whose bands reach the recall within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within the hashes allowed")
    return best


class Shingler:
    """n-gram sets of texts, sorted uint64 arrays."""

    def __init__(self, n: int) -> None:
        self.n, self.powers = n, Powers()

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        flat, offsets = as_bytes(texts)
        starts, ends, counts = word_bounds(flat, offsets, ALNUM)
        hashes = span_hashes(flat, starts, ends, FOLDED_VALUES, self.powers)
        grams, per_text = windows(hashes, counts, self.n)
        at = np.concatenate([[0], np.cumsum(per_text)])
        word = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for i in range(len(texts)):
            if per_text[i]:
                out.append(np.unique(grams[at[i] : at[i + 1]]))
            elif counts[i]:
                short = hashes[word[i] : word[i + 1]]
                out.append(mix((short * np.arange(3, 3 + 2 * len(short), 2, dtype=np.uint64)).sum(keepdims=True) + np.uint64(len(short))))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def node_of(grams: np.ndarray) -> bytes:
    """A 128-bit name of the set."""
    n = np.uint64(len(grams))
    return b"".join((mix(grams ^ np.uint64(seed)).sum(keepdims=True) + n).tobytes() for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def band_hashes(grams: np.ndarray, bands: int, rows: int, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """int64 hash of each band of the set's MinHash signature."""
    signature = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 1024):
        signature = np.minimum(signature, (grams[None, k : k + 1024] * multipliers[:, None] + shifts[:, None]).min(1))
    rows_hash = (mix(signature).reshape(bands, rows) * (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(1)
    return mix(rows_hash + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """docs(uid, doc_id, text) -> uid, doc_id, name of the set (null without words), n_grams, bands array<long>."""

    def run(batches):
        shingler, rng = Shingler(ngram), np.random.default_rng(11)
        multipliers = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        shifts = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in batches:
            text = batch.column(2)
            nodes, sizes, found = [], [], []
            for a, b in slices(text):
                for grams in shingler.sets(text.slice(a, b - a)):
                    nodes.append(node_of(grams) if len(grams) else None)
                    sizes.append(len(grams))
                    found.append(band_hashes(grams, bands, rows, multipliers, shifts) if len(grams) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["uid", "doc_id", "name", "n_grams", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("uid", "doc_id", "text")).mapInArrow(run, f"uid binary, doc_id {kind}, name binary, n_grams long, bands array<long>")


def gram_sets(rows: DataFrame, ngram: int) -> DataFrame:
    """Replaces the column text by grams array<long>."""
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches):
        shingler = Shingler(ngram)
        for batch in batches:
            text = batch.column(len(names))
            sets = [g.view(np.int64) for a, b in slices(text) for g in shingler.sets(text.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sets, pa.list_(pa.int64()))], [*names, "grams"])

    return bounded(rows.select(*names, "text")).mapInArrow(run, f"{fields}, grams array<long>")


def intersections(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """float64 n x n sizes of the pairwise intersections of n sets given as (value, row) entries; the diagonal is not set."""
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(values)))
    total = np.zeros(n * n)
    for k in np.unique(times[(times > 1) & (times <= LIGHT)]):
        at = first[times == k]
        step = max(1, (1 << 21) // int(k * k))
        for part in range(0, len(at), step):
            members = rows[at[part : part + step, None] + np.arange(k)]
            pairs = (members[:, :, None] * n + members[:, None, :]).ravel()
            total += np.bincount(pairs, minlength=n * n)
    total = total.reshape(n, n)
    heavy = np.flatnonzero(times > LIGHT)
    width = max(256, min(1 << 14, (1 << 22) // max(n, 1)))
    for part in range(0, len(heavy), width):
        some = heavy[part : part + width]
        dense = np.zeros((n, len(some)), np.float32)
        for column, k in enumerate(some):
            dense[rows[first[k] : first[k] + times[k]], column] = 1
        total += dense @ dense.T
    return total


def verify(weight_of_overlap: int):
    """The function of one pair of blocks: of nodes with links there, the documents linked to each and its root.

    Counts pairs with u + u < 0 whose deltas overlap enough; those with u + u >= 0 are counted elsewhere.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        side = table.column("side").to_numpy()
        weight = table.column("weight").to_numpy().astype(np.float64)
        u = table.column("u").to_numpy()
        delta = table.column("delta").combine_chunks()
        lengths = np.diff(delta.offsets.to_numpy())
        n = len(side)
        inter = intersections(delta.flatten().to_numpy(), np.repeat(np.arange(n), lengths), n)
        missing = u[:, None] + u[None, :]
        linked = (missing < 0) & (missing + weight_of_overlap * inter >= 0)
        np.fill_diagonal(linked, False)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        links = (linked @ weight).astype(np.int64)
        root = np.arange(n)
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
            least = np.minimum(least, least[least])
            if (least == root).all():
                break
            root = least
        node = table.column("node")
        found = np.flatnonzero(links)
        return pa.table({"node": node.take(pa.array(found)), "links": pa.array(links[found]), "root": node.take(pa.array(root[found]))})

    return run


def hub_links(nodes: DataFrame) -> DataFrame:
    """nodes(node, bands) -> node, hub (its least one), hubs (all), score (nodes in its buckets): those that share a bucket."""
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    return buckets.join(hubs, "band").groupBy("node").agg(F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs"), F.sum("size").alias("score"))


def with_pivots(members: DataFrame) -> DataFrame:
    """members(part, node, score, ...) -> the same with pivot, salts (copies of the pivot that its part needs) and salt."""
    heads = members.groupBy("part").agg(F.max(F.struct("score", "node")).alias("head"), F.ceil(F.count("*") / SALT_NODES).cast("int").alias("salts"))
    rows = members.join(heads.select("part", F.col("head.node").alias("pivot"), "salts"), "part")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), "salts").cast("int"))


def measured(members: DataFrame, ngram: int, p: int, q: int) -> DataFrame:
    """members(part, node, pivot, weight, salts, salt, text) -> part, node, pivot, weight, u, reach, ring, delta: a row per node.

    reach is (q-p) times the n-grams of the pivot, its own u and so the largest of the part.
    """
    sets = saved(gram_sets(members, ngram), "grams")
    base = sets.where("node = pivot").select("part", F.col("grams").alias("base"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    delta = F.concat(F.array_except("grams", "base"), F.array_except("base", "grams"))
    rows = sets.join(base, ["part", "salt"]).select("part", "node", "pivot", "weight", F.size("grams").alias("n"), F.size("base").alias("g"), delta.alias("delta"))
    u = (q - p) * F.col("n").cast("long") - (q + p) * F.size("delta")
    ring = F.floor(F.log((F.size("delta") + F.col("g")) / F.col("g")) / math.log(q / p) + 1e-9) + 1 if p < q else F.lit(1)
    return rows.select(
        "part", "node", "pivot", "weight", u.alias("u"), ((q - p) * F.col("g").cast("long")).alias("reach"), F.when(u >= 0, 0).otherwise(ring).cast("int").alias("ring"), "delta"
    )


def counted_links(rows: DataFrame) -> DataFrame:
    """node, links: documents b of the part with u(a) + u(b) >= 0, without the node's own.

    A part has at most as many points as different values of u, which the lengths of its texts bound.
    """
    values = rows.groupBy("part", "u").agg(F.sum("weight").alias("w"))
    points = values.select("part", F.col("u").alias("v"), "w").unionByName(values.select("part", (-F.col("u")).alias("v"), F.lit(0).cast("long").alias("w")))
    above = Window.partitionBy("part").orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, 0)
    points = points.groupBy("part", "v").agg(F.sum("w").alias("w")).withColumn("near", F.sum("w").over(above)).where("near > 0")
    points = saved(points.select("part", (-F.col("v")).alias("u"), "near"), "points")  # written, so that the join deals by part and u
    own = F.when(F.col("u") >= 0, F.col("weight")).otherwise(0)
    return rows.select("part", "node", "u", "weight").join(points, ["part", "u"]).select("node", (F.col("near") - own).alias("links"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """The rows of parts that the counts leave open, once per pair of blocks: one, two, side, node, weight, u, delta.

    A part of at most BLOCK_NODES nodes and BLOCK_GRAMS n-grams is one block, in ring 1. What each ring meets is a small
    table, written so that the join deals rows by part and ring.
    """
    size = F.size("delta")
    rings = rows.where(size > 0).groupBy("part", "ring").agg(F.count("*").alias("n"), F.sum(size).alias("grams"), F.sum((F.col("u") < 0).cast("long")).alias("far"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    parts = rings.groupBy("part").agg(F.sum("n").alias("nodes"), F.sum("grams").alias("sum"), F.sum("far").alias("far"), F.collect_list(F.struct("ring", blocks.alias("blocks"))).alias("rings"))
    parts = parts.where("far > 0 AND nodes > 1")
    small = (F.col("nodes") < BLOCK_NODES) & (F.col("sum") <= BLOCK_GRAMS)
    own = F.col("own.ring")
    # ring 0 holds u >= 0, which may lie at the distances of rings 1 and 2; its own pairs are counted
    meets = F.filter("rings", lambda x: F.when(own == 0, x["ring"].between(1, 2)).when(x["ring"] == 0, own <= 2).otherwise(F.abs(x["ring"] - own) <= 1))
    meets = F.flatten(F.transform(meets, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda b: F.struct(x["ring"].alias("ring"), b.alias("block")))))
    alone = F.array(F.struct(F.lit(1).alias("ring"), F.lit(0).alias("block")))
    targets = parts.select("part", "rings", small.alias("small"), F.explode("rings").alias("own")).select(
        "part",
        own.alias("ring"),
        F.when(F.col("small"), 1).otherwise(own).alias("as_ring"),
        F.when(F.col("small"), 1).otherwise(F.col("own.blocks")).alias("blocks"),
        F.when(F.col("small"), alone).otherwise(meets).alias("targets"),
    )
    mine = F.struct(F.col("as_ring").alias("ring"), F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("block"))
    placed = rows.where(size > 0).join(saved(targets, "targets"), ["part", "ring"]).withColumn("mine", mine)
    dealt = placed.select("part", "mine", F.explode("targets").alias("other"), "node", "weight", "u", "delta")
    side = F.shiftleft(F.col("mine.ring").cast("long"), 32) + F.col("mine.block")
    return dealt.select("part", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), side.alias("side"), "node", "weight", "u", "delta")


def jaccard_classes(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs(doc_id, text) -> uid (key of doc_id and text), doc_id, class_uid, class_id, n_links: a row per row.

    The threshold is taken as the nearest fraction with a denominator of at most 1000.
    """
    bands, rows = banding(threshold, recall)
    exact = Fraction(threshold).limit_denominator(1000)
    p, q = exact.numerator, exact.denominator
    keyed = docs.select(row_key("doc_id", "text").alias("uid"), "doc_id", "text")
    sketches = saved(sketch(keyed, ngram, bands, rows), "sketch")
    nodes = sketches.where("name IS NOT NULL").groupBy("name").agg(
        F.count("*").alias("weight"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least"), F.first("bands").alias("bands")
    )
    number = F.monotonically_increasing_id().alias("node")  # written with the row, so it stays
    nodes = saved(nodes.select(number, "name", "weight", F.col("least.doc_id").alias("first_id"), F.col("least.uid").alias("uid"), "bands"), "nodes")
    hubs = saved(hub_links(nodes), "hubs")
    edges = hubs.select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(hubs.select(F.explode("hubs").alias("a"), F.col("hub").alias("b")))
    parts = components(edges.where("a <> b").distinct()).withColumnRenamed("label", "part")
    members = nodes.select("node", "uid", "weight").join(hubs.select("node", "score"), "node").join(parts, "node")
    members = with_pivots(saved(members, "members"))
    texts = one_row_each(keyed).join(members, "uid")
    near = saved(measured(texts.select("part", "node", "pivot", "weight", "salts", "salt", "text"), ngram, p, q), "deltas")
    checked = block_pairs(near).groupBy("part", "one", "two").applyInArrow(verify(2 * (q + p)), "node long, links long, root long")
    checked = saved(checked, "checked")
    links = checked.select("node", "links").unionByName(counted_links(near)).groupBy("node").agg(F.sum("links").alias("links"))
    joined = near.where("node <> pivot AND u + reach >= 0").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    class_of = components(joined.unionByName(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    known = nodes.select("node", "name", "weight", "first_id", "uid").join(links, "node", "left").join(class_of.withColumnRenamed("label", "class"), "node", "left")
    known = saved(known.select("node", "name", "weight", "first_id", "uid", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class")), "classes")
    least = known.groupBy("class").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "uid")).alias("least"))
    result = known.join(least, "class").select(
        "name", F.col("least.first_id").alias("class_id"), F.col("least.uid").alias("class_uid"), (F.col("weight") - 1 + F.col("links")).alias("n_links")
    )
    rows_of = sketches.select("uid", "doc_id", "name").join(result, "name", "left")
    own = F.col("name").isNull()
    return rows_of.select(
        "uid",
        "doc_id",
        F.when(own, F.col("uid")).otherwise(F.col("class_uid")).alias("class_uid"),
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op10(spark, sf_dir) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
