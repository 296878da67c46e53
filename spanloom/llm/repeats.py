"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every byte covered by a SPAN-byte string that also starts elsewhere in the corpus is removed. Texts are bytes of UTF-8.

1. Anchors. Each SPAN-byte window has an anchor, the GRAM-byte string in it with the least hash (the first of equals).
   Equal windows have equal anchors at equal distances, so only windows of one anchor need comparing. Neighbouring
   windows with the same anchor form a segment: every window of the corpus is in exactly one.
2. Equal segments. Segments are grouped by anchor and content hash. If a segment occurs twice, all its windows repeat, and
   one copy stands for all in what follows. An anchor with a single content needs no more.
3. Suffix arrays. The different segments of an anchor meet in a bucket of bounded size. Of the suffixes that start a window,
   those smaller than their successors are sorted directly, the others induced by scanning the buckets of first bytes;
   neighbours in the array whose common prefix reaches SPAN are repeats. Comparison ends at SPAN bytes.
4. Crowded anchors. An anchor with more than ``hot`` different segments, which one bucket could not hold, is split. Equal
   windows start at the same distance before the anchor, so segments are cut into stretches of WIDTHS distances, and those
   of one stretch are told apart by the bytes that all its windows hold. What is still crowded is cut more narrowly, down
   to single windows, where only equal ones are left together. Each part then takes steps 2 and 3.

Copies are summed before they are shuffled, and joins by segment are split where hot.

Edge cases: null text is empty; texts under SPAN bytes lose nothing; repeated rows repeat each other and so go if they
have SPAN bytes; repeats may overlap and may lie in one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices
from spanloom.llm.common import one_row_each, row_key, saved
from spanloom.llm.passages import LENGTH, NOISE, shared_strings
from spanloom.llm.textnum import Powers, byte_values, mix, sliding_least
from spanloom.storage import scratch

SPAN, GRAM = 400, 32
HOT, BUCKET_BYTES = 2000, 1 << 20
#: Distances in a stretch of a crowded anchor, the next where the last leaves parts crowded.
WIDTHS = (128, 32, 8, 1)
POSITION_BITS = 30
KEY = ["anchor", "content", "windows", "distance"]
#: The same within the parts of crowded anchors.
SUB = ["anchor", "part", "content", "windows", "distance"]


class Hasher:
    """Prefix sums of a text's polynomial hash."""

    def __init__(self, flat: np.ndarray, values: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.to(len(flat) + 1)
        self.total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(values[flat] * up[:-1], out=self.total[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def segments(flat: np.ndarray, offsets: np.ndarray, values: np.ndarray, powers: Powers, span: int, gram: int):
    """(text, first window, windows, distance of the anchor from it, anchor hash, content hash) of every segment."""
    none = np.zeros(0, np.int64)
    if len(flat) < span:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hasher = Hasher(flat, values, powers)
    grams = mix((hasher.total[gram:] - hasher.total[:-gram]) * hasher.down[: len(flat) - gram + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), span - gram + 1)
    anchor = (least & low).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + span <= offsets[of + 1])
    anchor, of = anchor[start], of[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor, of = start[first], anchor[first], of[first]
    return of, begin - offsets[of], count, anchor - begin, grams[anchor], hasher.of(begin, begin + count - 1 + span)


def find_segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """docs(uid, text) -> uid, start long and KEY: a row per segment of every row."""
    kinds = [("uid", pa.binary()), ("start", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("windows", pa.int32()), ("distance", pa.int32())]

    def run(batches):
        powers, values = Powers(), byte_values(5)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                of, start, n, distance, anchor, content = segments(*as_bytes(batch.column(1).slice(a, b - a)), values, powers, span, gram)
                columns = [batch.column(0).slice(a, b - a).take(pa.array(of)), start, anchor.view(np.int64), content.view(np.int64), n.astype(np.int32), distance.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.binary()), *(pa.array(c, k) for c, (_, k) in zip(columns[1:], kinds[1:], strict=True))], [n for n, _ in kinds])

    return bounded(docs.select("uid", "text")).mapInArrow(run, "uid binary, start long, anchor long, content long, windows int, distance int")


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def direct_sort(at: np.ndarray, eight: np.ndarray, hasher: Hasher, depth: int) -> np.ndarray:
    """The positions in order of their suffixes' first ``depth`` bytes (rounded up to eight); equal ones in order of position.

    Groups that agree so far are cut at the first eight bytes in which they differ, found by bisection on prefix hashes.
    """
    n = len(hasher.total) - 1
    depth = -(-depth // 8) * 8
    order = at[np.argsort(eight[at], kind="stable")]
    group = np.cumsum(np.concatenate([[True], eight[order[1:]] != eight[order[:-1]]]))[: len(order)] if len(order) else at
    where, agreed = np.arange(len(order)), np.full(len(order), 8)

    def uniform(pos, g, d):
        """Whether the positions of each position's group agree on d bytes; groups are contiguous, d is theirs."""
        end = np.minimum(pos + d, n)
        h = hasher.of(pos, end)
        odd = np.concatenate([[False], (h[1:] != h[:-1]) & (g[1:] == g[:-1])])
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return np.repeat(~np.logical_or.reduceat(odd, starts), np.diff(np.append(starts, len(g))))

    while True:
        same = np.zeros(len(group), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        where, group, agreed = where[same], group[same], agreed[same]
        if not len(where):
            return order
        pos = order[where]
        open_ = ~uniform(pos, group, depth)
        where, group, agreed, pos = where[open_], group[open_], agreed[open_], pos[open_]
        if not len(where):
            return order
        low, high = agreed // 8, np.full(len(where), depth // 8)
        while (high - low > 1).any():
            middle = (low + high) // 2
            fits = uniform(pos, group, middle * 8)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle)
        key_at = pos + low * 8
        key = np.where(key_at < n, eight[np.minimum(key_at, n - 1)], 0)
        sorting = np.lexsort((key, group))
        pos, key = pos[sorting], key[sorting]
        order[where] = pos
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
        agreed = low * 8 + 8


def suffix_array(text: np.ndarray, wanted: np.ndarray, hasher: Hasher, eight: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask) in order of their suffixes, compared to at least ``depth`` bytes.

    First stage: suffixes smaller than their successors are sorted directly. Second: the buckets of first bytes are scanned
    in order, and each suffix found puts its predecessor, if that is the larger, at the next place of its bucket's front.
    Suffixes that others are induced from are included, down to the first that is sorted directly.
    """
    n = len(text)
    step = np.diff(text.astype(np.int16), append=np.int16(-1))
    known = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(known[::-1])[::-1]
    larger = step[decides] < 0
    base = np.minimum.accumulate(np.where(larger, n - 1, np.arange(n))[::-1])[::-1]
    reach = np.maximum.accumulate(np.where(wanted, base, -1))
    needed = wanted | (np.arange(n) <= reach)
    direct = direct_sort(np.flatnonzero(needed & ~larger), eight, hasher, depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[-1]:  # the last suffix follows from the empty one
        induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = induced[c]
        waves = np.concatenate(front) if front else np.zeros(0, np.int64)
        parts = [waves]
        while len(waves):
            before = waves - 1
            before = before[before >= 0]
            waves = before[needed[before] & larger[before] & (text[before] == c)]
            parts.append(waves)
        row = np.concatenate([*parts, direct[cut[c] : cut[c + 1]]])
        out.append(row)
        before = row - 1
        before = before[before >= 0]
        before = before[needed[before] & larger[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for k, part in zip(first[edges], np.split(before, edges[1:]), strict=True):
                induced[int(k)].append(part)
    array = np.concatenate(out)
    return array[wanted[array]]


def repeated(pieces: list[bytes], windows: np.ndarray, span: int, values: np.ndarray, powers: Powers) -> list[np.ndarray]:
    """Of each piece, a mask of its windows: whether the span-byte string there is that of another window."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces])[:-1]
    wanted = np.zeros(len(text), bool)
    for s, n in zip(starts, windows, strict=True):
        wanted[s : s + n] = True
    hasher, eight = Hasher(text, values, powers), words8(text)
    array = suffix_array(text, wanted, hasher, eight, span)
    a, b = array[:-1], array[1:]
    near = np.flatnonzero(hasher.of(a, a + span) == hasher.of(b, b + span))
    for d in [*range(0, span - 7, 8), span - 8]:
        near = near[eight[a[near] + d] == eight[b[near] + d]]
    found = np.zeros(len(text), bool)
    found[a[near]] = True
    found[b[near]] = True
    return [found[s : s + n] for s, n in zip(starts, windows, strict=True)]


def runs_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"s": int(a), "e": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def by_suffix_array(pieces: DataFrame, key: list[str], span: int, bucket_bytes: int) -> DataFrame:
    """key and piece binary -> key and runs (windows s to e, exclusive, that repeat) of the pieces that have some.

    The key names a piece; pieces are compared with those of the same anchor, and part if the key has one.
    """
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    buckets = max(1, int(total // bucket_bytes))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*key).schema)

    def run(table: pa.Table) -> pa.Table:
        masks = repeated(table.column("piece").to_pylist(), table.column("windows").to_numpy(), span, byte_values(5), Powers())
        out = table.select(key).append_column("runs", pa.array([runs_of(m) for m in masks], RUNS))
        return out.filter(pa.array([bool(m.any()) for m in masks], pa.bool_()))

    together = [c for c in ("anchor", "part") if c in key]
    dealt = pieces.select(*key, "piece").withColumn("bucket", F.pmod(F.xxhash64(*together), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, f"{fields}, runs array<struct<s:int,e:int>>")


def stretches(pieces: DataFrame, span: int, width: int) -> DataFrame:
    """pieces(root, first, anchor, part, windows, distance, piece) -> the same, a row per stretch of ``width`` distances.

    root is the segment that the piece comes from, and first its first window in it. The part tells stretches apart, and in
    a stretch the bytes that all its windows hold.
    """
    low = F.col("distance") - F.col("windows") + 1
    each = pieces.withColumn("j", F.explode(F.sequence(F.floor(low / width).cast("int"), F.floor(F.col("distance") / width).cast("int"))))
    far = F.least(F.col("distance"), F.col("j") * width + width - 1)
    skipped = F.col("distance") - far
    each = each.select("root", "first", "anchor", "part", "piece", "j", skipped.alias("skipped"), far.alias("distance"), (far - F.greatest(low, F.col("j") * width) + 1).alias("windows"))
    each = each.withColumn("piece", F.substr("piece", F.col("skipped") + 1, F.col("windows") - 1 + span))
    shared = F.substr("piece", F.col("distance") - F.col("j") * width + 1, F.lit(span - width + 1))
    return each.select(
        "root", (F.col("first") + F.col("skipped")).alias("first"), "anchor", F.xxhash64("part", "j", shared).alias("part"), F.xxhash64("piece").alias("content"), "windows", "distance", "piece"
    )


def whole(windows: str = "windows"):
    return F.array(F.struct(F.lit(0).alias("s"), F.col(windows).alias("e")))


def of_crowded(pieces: DataFrame, span: int, hot: int, bucket_bytes: int) -> DataFrame:
    """KEY and piece of crowded anchors -> KEY and runs of the pieces that have some."""
    rows = pieces.select(F.struct(*KEY).alias("root"), F.lit(0).alias("first"), "anchor", F.lit(0).cast("long").alias("part"), "windows", "distance", "piece")
    marks = []
    for width in WIDTHS:
        rows = saved(stretches(rows, span, width), "stretches")
        kinds = saved(rows.groupBy(*SUB).agg(F.count("*").alias("n"), F.first("piece").alias("piece")), "kinds")
        parts = kinds.groupBy("anchor", "part").agg(F.count("*").alias("contents"))
        crowded = (F.col("contents") > hot) & F.lit(width > WIDTHS[-1])
        settled = kinds.join(parts.where("contents > 1").where(~crowded).drop("contents"), ["anchor", "part"])
        found = by_suffix_array(settled, SUB, span, bucket_bytes).join(kinds.where("n > 1").select(*SUB), SUB, "left_anti")
        verdict = kinds.where("n > 1").select(*SUB, whole().alias("runs")).unionByName(found)
        marks.append(rows.join(verdict, SUB).select("root", F.transform("runs", lambda r: F.struct((r["s"] + F.col("first")).alias("s"), (r["e"] + F.col("first")).alias("e"))).alias("runs")))
        left = parts.where(crowded).drop("contents")
        if width == WIDTHS[-1] or left.isEmpty():
            break
        rows = rows.drop("content").join(left, ["anchor", "part"])
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    runs = every.groupBy("root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))
    return runs.select("root.*", "runs")


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs(uid, text) -> uid, spans array<struct<s:long,e:long>>: the byte ranges to remove, for texts that have some."""
    found = saved(find_segments(docs, span, gram), "segments")
    kinds = saved(found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("uid", "start")).alias("one")), "contents")
    varied = kinds.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    wanted = kinds.join(varied, "anchor").select(
        *KEY, "contents", F.col("one.uid").alias("uid"), F.col("one.start").alias("start"), (F.col("windows") - 1 + span).alias("size")
    )
    by_text = wanted.groupBy("uid").agg(F.collect_list(F.struct(*KEY, "contents", "start", "size")).alias("parts"))
    bytes_of = F.encode(F.col("text"), "UTF-8")
    cut = F.transform("parts", lambda p: F.struct(*[p[k].alias(k) for k in [*KEY, "contents"]], F.substring(F.col("bytes"), p["start"].cast("int") + 1, p["size"]).alias("piece")))
    texts = one_row_each(docs.select("uid", "text")).join(by_text, "uid").select(bytes_of.alias("bytes"), "parts")
    pieces = saved(texts.select(F.explode(cut).alias("p")).select("p.*"), "pieces")
    cold = by_suffix_array(pieces.where(F.col("contents") <= hot), KEY, span, bucket_bytes)
    crowded = of_crowded(pieces.where(F.col("contents") > hot), span, hot, bucket_bytes)
    single = cold.unionByName(crowded).join(kinds.where("n > 1").select(*KEY), KEY, "left_anti")
    verdict = kinds.where("n > 1").select(*KEY, whole().alias("runs")).unionByName(single)
    ranges = found.join(verdict, KEY).select("uid", "start", F.explode("runs").alias("r"))
    spans = ranges.select("uid", (F.col("start") + F.col("r.s")).alias("s"), (F.col("start") + F.col("r.e") - 1 + span).alias("e"))
    return spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted ranges that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for x in spans:
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, length: int = LENGTH, noise: int = NOISE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept binary, n_shared: a row per row.

    n_shared tells of what SPAN bytes may miss, passages of words that other documents have too (see passages); they stay.
    """
    keyed = docs.select(row_key("doc_id", "text").alias("uid"), "doc_id", "text")
    with scratch(docs.sparkSession) as kept_tables:
        shared = saved(shared_strings(keyed, length, noise), "shared")
        kept_tables.append(shared)
    with scratch(docs.sparkSession) as kept_tables:
        spans = saved(repeats(keyed, span, gram, hot, bucket_bytes), "spans")
        kept_tables.append(spans)
    found = spans.join(shared, "uid", "full_outer")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                gone = merged(found.as_py() or [])
                edges = [0, *(x for r in gone for x in r), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                n_spans.append(len(gone))
                kept.append(left)
            columns = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"])

    rows = keyed.join(found, "uid", "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return bounded(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long")


def op8(spark, sf_dir) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
