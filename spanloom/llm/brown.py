"""Language-model scoring with Brown class bigrams found by exchange clustering.

Every training token counts: words (runs of characters other than ASCII white space, A-Z lower-cased) and one end per
text. The CLUSTERED most frequent words are put into CLASSES classes by exchange: each word in turn moves to the class
that raises the likelihood of the class bigrams most. Every other word with LEAST occurrences or more then moves from the
class of other words to the class that raises it most, by counts of the classes beside it that are gathered and judged
distributedly, PLACINGS times over. Only rarer words, and the rarest of a vocabulary with more than MOST_CLASSED such words,
stay in the class of other words; ends form a class of their own.
P(w | v) = P(class of w | class of v) P(w | class of w); transitions are add-one smoothed, emission of the class of other
words is add-one smoothed with one more word for all unseen ones, so the probabilities of all words sum to 1.

Words are counted by 64-bit hashes. The counts of the up to HEAD most frequent words and of all words with a class travel
with the scoring function, at most HEAD + MOST_CLASSED words at any size of the corpus; the counts of all other words are
joined, per document and word, so no word is without its exact count. Only words rarer than the head's can join, and only
words unseen in training can repeat often on that side.

Edge cases: null text is empty and has one token, its end; a null id is held out; without training rows every probability
is uniform over the classes; repeated rows each get their row and count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices
from spanloom.llm.common import saved
from spanloom.llm.textnum import FOLDED_VALUES, NOT_SPACE, Powers, span_hashes, word_bounds

HEAD, CLUSTERED, CLASSES, SWEEPS = 1 << 18, 1024, 64, 5
#: Occurrences from which a word has a class, times that words beyond the CLUSTERED are placed, counts judged at once, which
#: take CLASSES numbers each in several tables.
LEAST, PLACINGS, JUDGED = 5, 2, 1 << 16
#: Words that can have a class: the bound on what travels with functions, about 28 bytes a word.
MOST_CLASSED = 1 << 22
FOLDS, HELD = 7, 2
#: Entries that a worker holds before it merges its counts, and after merging at most before it sends them on.
HELD_COUNTS = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def hashes_of(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words per text)."""
    flat, offsets = as_bytes(texts)
    starts, ends, counts = word_bounds(flat, offsets, NOT_SPACE)
    return span_hashes(flat, starts, ends, FOLDED_VALUES, powers), counts


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(text) -> h long, n long: the count of every word."""

    def run(batches):
        powers, held, n = Powers(), [], 0

        def merged():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            words, which = np.unique(h, return_inverse=True)
            return words, np.bincount(which, weights=c).astype(np.int64)

        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, _ = hashes_of(batch.column(0).slice(a, b - a), powers)
                held.append(np.unique(h, return_counts=True))
                n += len(held[-1][0])
                if n > HELD_COUNTS:
                    held = [merged()]
                    n = len(held[0][0])
                    if n > HELD_COUNTS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "n"])
                        held, n = [], 0
        if held:
            h, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])

    return bounded(docs.select("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids of all texts in a row, an end before the first and after each text."""
    out = np.full(len(ids) + len(counts) + 1, end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(1, len(counts) + 1), counts)] = ids
    return out


def lookup(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted hashes, whether it is there)."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def bigram_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """int64 matrix of bigrams over the given sorted hashes, all other words, and ends."""
    size = len(words) + 2
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        powers, known = Powers(), shared.value
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, counts = hashes_of(batch.column(0).slice(a, b - a), powers)
                at, there = lookup(known, h)
                ids = with_ends(np.where(there, at, size - 2), counts, size - 1)
                total += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = bounded(docs.select("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(g: np.ndarray) -> float:
    """Of class bigrams, up to a term that no exchange changes."""
    return float(xlogx(g).sum() - xlogx(g.sum(1)).sum() - xlogx(g.sum(0)).sum())


def class_counts(bigrams: np.ndarray, cls: np.ndarray, n: int) -> np.ndarray:
    one = np.zeros((len(cls), n))
    one[np.arange(len(cls)), cls] = 1
    return one.T @ bigrams @ one


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each row of the bigram matrix; its last two rows keep classes of their own, ``classes`` and ``classes + 1``.

    The first words, by count, seed the classes in turn; sweeps go through the words by falling count and end early when
    none moves. Ties go to the least class.
    """
    n_words, k = len(bigrams) - 2, classes + 2
    b = bigrams.astype(np.float64)
    order = np.lexsort((np.arange(n_words), -b[:n_words].sum(1)))
    cls = np.empty(n_words + 2, np.int64)
    cls[order] = np.arange(n_words) % classes
    cls[-2:] = classes, classes + 1
    g = class_counts(b, cls, k)
    for _ in range(sweeps):
        moved = False
        for w in order:
            own = b[w, w]
            row, col = np.bincount(cls, b[w], k), np.bincount(cls, b[:, w], k)
            old = cls[w]
            row[old] -= own
            col[old] -= own
            g[old] -= row
            g[:, old] -= col
            g[old, old] -= own
            left, right, n, m = g.sum(1)[:classes], g.sum(0)[:classes], row.sum() + own, col.sum() + own
            rows, cols, i = g[:classes], g[:, :classes].T, np.arange(classes)
            gain_row, gain_col = xlogx(rows + row) - xlogx(rows), xlogx(cols + col) - xlogx(cols)
            gain = gain_row.sum(1) - gain_row[i, i] + gain_col.sum(1) - gain_col[i, i]
            gain += xlogx(g[i, i] + row[i] + col[i] + own) - xlogx(g[i, i])
            gain -= xlogx(left + n) - xlogx(left) + xlogx(right + m) - xlogx(right)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved |= new != old
            cls[w] = new
            g[new] += row
            g[:, new] += col
            g[new, new] += own
        if not moved:
            break
    return cls


def class_bigrams(docs: DataFrame, words: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """Bigrams of the classes of the sorted hashes, of all other words (``classes``), and of ends (``classes + 1``)."""
    k = classes + 2
    shared = docs.sparkSession.sparkContext.broadcast((words, cls))

    def run(batches):
        (known, of), powers, total = shared.value, Powers(), np.zeros(k * k, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, counts = hashes_of(batch.column(0).slice(a, b - a), powers)
                at, there = lookup(known, h)
                line = with_ends(np.where(there, of[at], classes) if len(known) else np.full(len(h), classes), counts, k - 1).astype(np.int64)
                total += np.bincount(line[:-1] * k + line[1:], minlength=k * k)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = bounded(docs.select("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k, k)


def beside(ids: np.ndarray, cls: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """A line of word ids (-1: none) and classes -> id * (2 k + 1) + what is beside it, for every wanted position: the class
    before, k + the class after, or 2 k, once, for the word itself."""
    p = np.flatnonzero(wanted)
    w, before, after = ids[p], ids[p - 1] == ids[p], ids[p + 1] == ids[p]
    left, right = w * (2 * k + 1) + np.where(before, 2 * k, cls[p - 1]), w * (2 * k + 1) + k + cls[p + 1]
    return np.concatenate([left, right[~after]])


def gains(g: np.ndarray, old: np.ndarray, word: np.ndarray, side: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words x classes: how much each class raises the likelihood of the class bigrams ``g`` if the word is put there, from
    without it. ``old``: class of each word; (word, side, n): counts of ``beside``, each word and side once."""
    k, m = len(g), len(old)
    c, rows = k - 2, np.arange(m)
    dense = np.zeros((m, 2 * k + 1))
    dense[word, side] = n
    before, after, own = dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k]
    here = old[:, None] == np.arange(c)
    out = np.zeros((m, c))
    for first, one, other, table in ((0, before, after, g), (k, after, before, g.T)):
        e = np.flatnonzero((side >= first) & (side < first + k))
        w, a = word[e], side[e] - first
        base = table[a, :c] - np.where((a == old[w])[:, None], other[w, :c], 0) - np.where(here[w], one[w, a][:, None], 0)
        more = xlogx(base + n[e][:, None]) - xlogx(base)
        more[np.arange(c) == a[:, None]] = 0
        order = np.argsort(w, kind="stable")
        if len(e):
            starts = np.flatnonzero(np.diff(w[order], prepend=-1))
            out[w[order][starts]] += np.add.reduceat(more[order], starts)
        total = other.sum(1) + own
        sums = table.sum(1)[:c] - np.where(here, total[:, None], 0)
        out -= xlogx(sums + total[:, None]) - xlogx(sums)
    both = before[:, :c] + after[:, :c] + own[:, None]
    kept = np.diag(g)[:c] - np.where(here, both, 0)
    return out + xlogx(kept + both) - xlogx(kept)


def packed(word: np.ndarray, side: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts in order of word -> each word once, and its (side, n) as records of six bytes."""
    first = np.flatnonzero(np.diff(word, prepend=-1))
    records = np.empty((len(word), 6), np.uint8)
    records[:, :2] = side.astype("<u2").view(np.uint8).reshape(-1, 2)
    records[:, 2:] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
    offsets = (np.append(first, len(word)) * 6).astype(np.int32)
    return pa.array(word[first]), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(records)])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, side, n) of packed rows."""
    blobs = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(blobs) else np.zeros(0, np.uint8)
    records = data.reshape(-1, 6)
    side, n = np.ascontiguousarray(records[:, :2]).view("<u2").ravel(), np.ascontiguousarray(records[:, 2:]).view("<u4").ravel()
    return np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // 6), side.astype(np.int64), n.astype(np.int64)


def place(docs: DataFrame, words: np.ndarray, cls: np.ndarray, moving: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The classes of the sorted hashes after each moving word went where it raises the likelihood of the class bigrams ``g``
    most, all others left in place; ties go to the least class."""
    k = len(g)
    wide = 2 * k + 1
    shared = docs.sparkSession.sparkContext.broadcast((words, cls, moving, g))

    def gather(batches):
        (known, of, moves, _), powers, held, n = shared.value, Powers(), [], 0

        def merged():
            codes, c = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, which = np.unique(codes, return_inverse=True)
            return codes, np.bincount(which, weights=c).astype(np.int64)

        def sent(codes, c):
            return pa.RecordBatch.from_arrays(list(packed(codes // wide, codes % wide, c)), ["word", "counts"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, counts = hashes_of(batch.column(0).slice(a, b - a), powers)
                at, there = lookup(known, h)
                ids = with_ends(np.where(there, at, -1), counts, -1)
                line = with_ends(np.where(there, of[at], k - 2), counts, k - 1)
                held.append(np.unique(beside(ids, line, (ids >= 0) & moves[ids], k), return_counts=True))
                n += len(held[-1][0])
                if n > HELD_COUNTS:
                    held = [merged()]
                    n = len(held[0][0])
                    if n > HELD_COUNTS // 2:
                        yield sent(*held[0])
                        held, n = [], 0
        if held:
            yield sent(*merged())

    def judge(batches):
        _, of, _, table = shared.value
        left = [np.zeros(0, np.int64)] * 3

        def judged(word, side, n):
            """Entries are in order of word, the words whole."""
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            edges = np.append(starts, len(word))
            i = 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + JUDGED, "right")) - 1)
                a, b, i = edges[i], edges[j], j
                these, at = np.unique(word[a:b], return_inverse=True)
                total = np.bincount(at * wide + side[a:b], n[a:b], len(these) * wide)
                there = np.flatnonzero(total)
                best = gains(table, of[these], there // wide, there % wide, total[there]).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(these), pa.array(best.astype(np.int64))], ["word", "class"])

        for batch in batches:
            word, side, n = (np.concatenate(x) for x in zip(left, unpacked(batch), strict=True))
            if not len(word):
                continue
            cut = np.searchsorted(word, word[-1])
            if cut:
                yield from judged(word[:cut], side[:cut], n[:cut])
            sums = np.bincount(side[cut:], n[cut:], wide)  # of the last word, which may go on in the next batch
            sides = np.flatnonzero(sums)
            left = [np.full(len(sides), word[-1]), sides, sums[sides].astype(np.int64)]
        if len(left[0]):
            yield from judged(*left)

    beside_rows = bounded(docs.select("text")).mapInArrow(gather, "word long, counts binary")
    found = beside_rows.repartition("word").sortWithinPartitions("word").mapInArrow(judge, "word long, class long").toArrow()
    out = cls.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


def level_of(levels: list[tuple[int, int]], room: int) -> int:
    """Of (level, words) from the highest level: the lowest down to which there are at most ``room`` words in all."""
    lowest = 1 << 62
    for level, n in levels:
        if n > room:
            break
        lowest, room = level, room - n
    return lowest


def fit(training: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, most: int = MOST_CLASSED) -> tuple[dict, DataFrame]:
    """(model, counts h long, n long of the words that are not in the model)."""
    counts = saved(word_counts(training), "counts")
    n_docs = training.count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("long")
    levels = sorted((tuple(r) for r in counts.groupBy(scale.alias("s")).agg(F.count("*")).collect()), reverse=True)
    held = (scale >= level_of(levels, head)) | ((F.col("n") >= LEAST) & (scale >= level_of(levels, most)))
    top = counts.where(held).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.sort(np.lexsort((h, -c))[:clustered])
    bigrams = bigram_counts(training, h[first])
    seeds = exchange(bigrams, classes)
    of = np.full(len(h), classes)
    of[first] = seeds[:-2]
    g = class_counts(bigrams.astype(np.float64), seeds, classes + 2)
    moving = c >= LEAST
    moving[first] = False
    for _ in range(PLACINGS if moving.any() else 0):
        of = place(training, h, of, moving, g)
        g = class_bigrams(training, h, of, classes)
    there = of < classes
    in_class = np.bincount(of[there], c[there], classes)
    other_types = v_words - int(there.sum())
    model = {
        "h": h, "n": c, "class": of.astype(np.int32), "classes": classes, "in_class": in_class,
        "other": float(n_words - in_class.sum()) + other_types + 1, "steps": np.log10((g + 1) / (g.sum(1, keepdims=True) + classes + 2)),
        "tokens": int(n_words + n_docs), "types": int(v_words + (n_docs > 0)), "ends": int(n_docs),
    }
    return model, counts.where(~held)


def score(docs: DataFrame, model: dict, rare: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: a row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        powers, m = Powers(), shared.value
        k, rows_n = m["classes"], len(m["h"])
        each = np.log10(m["n"] + 1.0)
        emit = np.where(m["class"] < k, np.log10(np.maximum(m["n"], 1) / np.maximum(m["in_class"], 1)[np.minimum(m["class"], k - 1)]), each - np.log10(m["other"]))
        for batch in batches:
            n_tokens, n_known, base, model_score, tail, times = [], [], [], [], [], []
            for a, b in slices(batch.column(2)):
                h, counts = hashes_of(batch.column(2).slice(a, b - a), powers)
                at, there = lookup(m["h"], h)
                of = np.repeat(np.arange(b - a), counts)
                cls = np.where(there, m["class"][at], k) if rows_n else np.full(len(h), k)
                line = with_ends(cls, counts, k + 1)
                steps = np.concatenate([[0.0], np.cumsum(m["steps"][line[:-1], line[1:]])])
                edge = np.concatenate([[0], np.cumsum(counts + 1)])
                gains = np.where(there, emit[at], -np.log10(m["other"])) if rows_n else np.full(len(h), -np.log10(m["other"]))
                plain = np.where(there, each[at], 0.0) if rows_n else np.zeros(len(h))
                n_tokens.append(counts + 1)
                n_known.append(np.bincount(of, there, b - a).astype(np.int64) + (m["ends"] > 0))
                base.append(np.bincount(of, plain, b - a) + np.log10(m["ends"] + 1.0) - (counts + 1) * np.log10(m["tokens"] + m["types"] + 1.0))
                model_score.append(steps[edge[1:]] - steps[edge[:-1]] + np.bincount(of, gains, b - a))
                gone, owner = h[~there], of[~there]
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(b - a):
                    words, n = np.unique(gone[cut[i] : cut[i + 1]], return_counts=True) if cut[i + 1] > cut[i] else (gone[:0], cut[:0])
                    tail.append(words.view(np.int64))
                    times.append(n)
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), join(n_tokens, pa.int64()), join(n_known, pa.int64()), join(base, pa.float64()), join(model_score, pa.float64()),
                 pa.array(tail, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["uid", "doc_id", "n_tokens", "n_known", "base", "model", "tail", "times"],
            )

    schema = f"uid long, doc_id {kind}, n_tokens long, n_known long, base double, model double, tail array<long>, times array<long>"
    local = saved(bounded(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")).mapInArrow(run, schema), "scored")
    pairs = local.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("p")).select("uid", F.col("p.tail").alias("h"), F.col("p.times").alias("t"))
    seen = (
        pairs.join(rare, "h")
        .groupBy("uid")
        .agg(F.sum(F.col("t") * F.log10(F.col("n") + 1)).alias("more"), F.sum("t").alias("known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return local.drop("tail", "times").join(seen, "uid", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
        F.pow(F.lit(10.0), -(F.col("model") + more) / F.col("n_tokens")).alias("perplexity"),
    )


def op6(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *fit(docs.where(~held_out(F.col("doc_id")))))
