"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the 2-, 3- and 4-byte sequences of the text with A-Z lower-cased and runs of ASCII non-letters as spaces.
Each hashes to one of BUCKETS embeddings; their average goes through a linear softmax. Since both are linear, the trained
model is one table of BUCKETS x languages scores, and a prediction is the mean of the table's rows. The table's size is
fixed by parameters, so it can travel with the function. Temperature and rejection threshold are set on part of the sample.

Training reads at most ``sample`` labelled rows (those whose id hashes lowest), whole: their subwords are counted where the
rows are, so that what reaches the driver is bounded by rows and buckets. Predictions use text alone, whole.

Edge cases: text null or without a letter is `und` with score 0; without any labelled row every text is `und`; of languages
with equal scores the first by name is predicted; rows with equal hashes of the id are taken in order of id, language and
text; repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices

BUCKETS_LOG2, DIM, ORDERS = 15, 16, (2, 3, 4)
SAMPLE, EPOCHS, BATCH, RATE, VALID = 2000, 10, 64, 2.0, 0.25
#: Share of doubt that calibration assumes in every label.
DOUBT = 0.005
#: Share of rightly predicted validation texts that the threshold may reject, and the most that it may be.
REJECT, MOST = 0.001, 0.4
UND = "und"


def folded() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, other ASCII but a-z as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[b for b in range(128) if not chr(b).isalpha()]] = 32
    return table


def bucket_rows(flat: np.ndarray, offsets: np.ndarray):
    """Yields (bucket of every subword, its text's first subword, the end) by order; subwords do not cross texts."""
    b = folded()[flat].astype(np.uint32)
    key = b
    for order in range(2, max(ORDERS) + 1):
        if len(b) < order:
            break
        key = (key[:-1] << np.uint32(8)) | b[order - 1 :]
        if order in ORDERS:
            h = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(13)) ^ np.uint32(order)) * np.uint32(0x85EBCA77)
            ends = np.clip(offsets[1:] - order + 1, 0, len(key))
            yield h >> np.uint32(32 - BUCKETS_LOG2), np.minimum(offsets[:-1], len(key)), ends


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares float32) of a text's subwords."""
    flat, offsets = as_bytes(pa.array([text], pa.large_string()))
    idx, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x[0] for x in bucket_rows(flat, offsets))]), return_counts=True)
    return idx, (n / max(1, n.sum())).astype(np.float32)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BUCKETS_LOG2), np.float32)
    for i, (idx, share) in enumerate(rows):
        out[i, idx] = share
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 3) -> dict:
    """counts_of each text -> {"langs", "table" float32 buckets x langs (temperature applied), "threshold"}."""
    langs = sorted(set(labels))
    if not langs:
        return {"langs": [], "table": np.zeros((1 << BUCKETS_LOG2, 1), np.float32), "threshold": 0.0}
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(y))
    held = order[: int(len(y) * VALID)]
    fit = order[len(held) :]
    emb = rng.normal(0, 0.1, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    for epoch in range(EPOCHS):
        rng.shuffle(fit)
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(fit), BATCH):
            rows = fit[k : k + BATCH]
            x = dense([features[i] for i in rows])
            seen = np.flatnonzero(x.any(0))
            x = x[:, seen]
            hidden = x @ emb[seen]
            wrong = softmax(hidden @ out)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            grad = x.T @ (wrong @ out.T)
            out -= rate * hidden.T @ wrong / len(rows)
            emb[seen] -= rate * 100 * grad / len(rows)
    table = emb @ out
    check = held if len(held) else fit
    z = np.vstack([dense([features[i] for i in check[k : k + BATCH]]) @ table for k in range(0, len(check), BATCH)]).astype(np.float64)
    scales = np.geomspace(0.1, 20, 60)
    wanted = np.full(z.shape, DOUBT / len(langs))
    wanted[np.arange(len(check)), y[check]] += 1 - DOUBT
    loss = [-(wanted * np.log(np.maximum(softmax(z * s), 1e-12))).sum(1).mean() for s in scales]
    scale = scales[int(np.argmin(loss))]
    p = softmax(z * scale)
    right = p.max(1)[p.argmax(1) == y[check]]
    threshold = min(MOST, float(np.quantile(right, REJECT))) if len(right) else 0.0
    return {"langs": langs, "table": (table * scale).astype(np.float32), "threshold": threshold}


def held_out(doc_id: Column, fold: int = 5, held: int = 0) -> Column:
    """crc32 of the id as text, modulo ``fold``, is ``held``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == held, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of the labelled rows that are not held out, at most ``sample`` of them."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    n = labelled.count()
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = 1 << 30 if n <= sample else int((1 << 30) * min(1.0, 1.3 * sample / n))
    rows = labelled.where((rank < most) & F.col("text").isNotNull()).select("text", "lang", rank.alias("r"), F.col("doc_id").cast("string").alias("i"), F.xxhash64("text").alias("h"))

    def run(batches):
        for batch in batches:
            found = [counts_of(t.as_py()) for t in batch.column(0)]
            idx, share = pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], idx, share], ["lang", "r", "i", "h", "idx", "share"])

    counted = bounded(rows).mapInArrow(run, "lang string, r long, i string, h long, idx array<int>, share array<float>")
    found = counted.orderBy("r", "i", "lang", "h").limit(sample).toArrow()
    columns = [found.column(c).combine_chunks() for c in ("idx", "share")]
    ends = columns[0].offsets.to_numpy()[1:-1] - columns[0].offsets[0].as_py() if len(found) else []
    idx, share = (c.flatten().to_numpy() for c in columns)
    features = list(zip(np.split(idx.astype(np.uint32), ends), np.split(share, ends), strict=True)) if len(found) else []
    return train(features, found.column("lang").to_pylist())


def predict(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """Adds lang_pred string, score double and rejected boolean, named with the prefix; columns of these names are replaced."""
    added = [prefix + c for c in ("lang_pred", "score", "rejected")]
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*[f"`{c}`" for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *map(" ".join, zip(added, ("string", "double", "boolean"), strict=True))])
    where = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        table, langs, letter = m["table"].astype(np.float64), m["langs"], regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(where)
            pred, score = [], []
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                flat, offsets = as_bytes(part)
                total, n = np.zeros((b - a, table.shape[1])), np.zeros(b - a)
                for idx, first, end in bucket_rows(flat, offsets):
                    sums = np.zeros((len(idx) + 1, table.shape[1]))
                    np.cumsum(table[idx], axis=0, out=sums[1:])
                    end = np.maximum(end, first)
                    total += sums[end] - sums[first]
                    n += end - first
                p = softmax(total / np.maximum(n, 1)[:, None])
                best = p.argmax(1)
                for i, t in enumerate(part):
                    known = langs and t.is_valid and letter.search(t.as_py())
                    pred.append(langs[best[i]] if known else UND)
                    score.append(round(float(p[i, best[i]]), 6) if known else 0.0)
            gone = [x == UND or s < m["threshold"] for x, s in zip(pred, score, strict=True)]
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return bounded(kept).mapInArrow(run, schema)


def op9(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
