import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import brown
from spanloom.llm.textnum import Powers

POWERS = Powers()


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def in_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def corpus():
    r = random.Random(4)
    common = [f"w{i}" for i in range(30)]
    docs = [(None, "w1 w2"), (1, None), (2, ""), (3, "\x1c é É"), (3, "\x1c é É"), (5, "W1 w1 " * 9000)]
    for i in range(10, 80):
        docs.append((i, " ".join(r.choice(common + [f"rare{r.randrange(500)}"]) for _ in range(r.randrange(40)))))
    return docs


@pytest.mark.parametrize("head", [1 << 18, 12, 0])
def test_against_brute_force(spark, head):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS uid", "'x' AS h", "2 AS n", "3 AS score")
    model, rare = brown.fit(frame.where(~brown.held_out(frame.doc_id)), head=head, clustered=10, classes=4)
    got = sorted(map(tuple, brown.score(frame, model, rare).collect()), key=repr)
    count = Counter(t for i, text in docs if in_training(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    assert (model["tokens"], model["types"]) == (n, v)
    hashed = {w: int(brown.hashes_of(pa.array([w]), POWERS)[0][0]) for _, text in docs for w in tokens(text) if w} | {"never-seen": 0}
    cls = dict(zip(map(int, model["h"]), model["class"].tolist(), strict=True))
    of = lambda w: 5 if w is None else cls.get(hashed[w], 4)
    members = {k: [w for w in count if w is not None and of(w) == k] for k in range(5)}
    sizes = {k: sum(count[x] for x in members[k]) for k in members}
    pair = Counter()
    for i, text in docs:
        if in_training(i):
            line = [5, *map(of, tokens(text))]
            pair.update(zip(line, line[1:]))
    left = Counter()
    for (a, _), c in pair.items():
        left[a] += c

    def p(w, before):
        step = (pair[before, of(w)] + 1) / (left[before] + 6)
        if w is None:
            return step
        total = sizes[of(w)]
        return step * (count[w] / total if of(w) < 4 else (count[w] + 1) / (total + len(members[4]) + 1))

    vocabulary = [w for w in count] + ["never-seen"]
    empty = sum((pair[0, k] + 1) / (left[0] + 6) for k in range(4) if not members[k])
    assert math.isclose(sum(p(w, 0) for w in vocabulary) + empty, 1)
    expected = []
    for i, text in docs:
        line = tokens(text)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in line)
        score = sum(math.log10(p(w, b)) for w, b in zip(line, [5, *map(of, line)]))
        expected.append((i, not in_training(i), len(line), sum(count[t] > 0 for t in line), n, base, score))
    for a, b in zip(got, sorted(expected, key=repr), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
        assert math.isclose(a[7], 10 ** (-b[6] / b[2]), rel_tol=1e-6)


def test_exchange_raises_the_likelihood_and_finds_classes():
    r = np.random.default_rng(1)
    words = 24
    bigrams = np.zeros((words + 2, words + 2), np.int64)
    for _ in range(20000):
        a = r.integers(words)
        b = r.integers(words // 2) * 2 + (a % 2 == 0)
        bigrams[a, b] += 1
    cls = brown.exchange(bigrams, 2)
    start = np.array([i % 2 for i in np.argsort(np.argsort(-bigrams[:words].sum(1), kind="stable"))] + [2, 3])
    value = lambda c: brown.likelihood(brown.class_counts(bigrams.astype(float), c, 4))
    assert value(cls) > value(start)
    assert len(set(cls[0:words:2])) == 1 and len(set(cls[1:words:2])) == 1 and cls[0] != cls[1]


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model, rare = brown.fit(empty)
    assert brown.score(empty, model, rare).count() == 0
    row = brown.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), model, rare).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_gains_are_differences_of_the_likelihood():
    r = np.random.default_rng(2)
    words, classes = 30, 4
    k = classes + 2
    bigrams = r.poisson(1.5, (words + 2, words + 2))
    cls = np.append(r.integers(0, classes + 1, words), [classes, classes + 1])
    g = brown.class_counts(bigrams.astype(float), cls, k)
    value = lambda c: brown.likelihood(brown.class_counts(bigrams.astype(float), c, k))
    old, rows = cls[:words], []
    for w in range(words):
        others = np.arange(words + 2) != w
        dense = np.concatenate([np.bincount(cls[others], bigrams[others, w], k), np.bincount(cls[others], bigrams[w, others], k), [bigrams[w, w]]])
        rows += [(w, i, dense[i]) for i in np.flatnonzero(dense)]
    got = brown.gains(g, old, *(np.array(x) for x in zip(*rows, strict=True)))
    for w in range(words):
        expected = [value(np.where(np.arange(words + 2) == w, i, cls)) for i in range(classes)]
        assert np.allclose(got[w] - got[w, 0], np.array(expected) - expected[0], atol=1e-6)


def test_every_word_over_a_small_count_has_a_class(spark):
    r = random.Random(5)
    kinds = [[f"{x}{i}" for i in range(60)] for x in "ab"]
    docs = [(i, " ".join(r.choices(kinds[j % 2], [10] * 10 + [1] * 50)[0] for j in range(100)) + f" once{i}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model, _ = brown.fit(frame, head=0, clustered=20, classes=2)
    cls = dict(zip(map(int, model["h"]), model["class"].tolist(), strict=True))
    of = [{cls[int(h)] for h in brown.hashes_of(pa.array([" ".join(words)]), POWERS)[0]} for words in kinds]
    assert sorted(map(sorted, of)) == [[0], [1]]
    assert int(brown.hashes_of(pa.array(["once7"]), POWERS)[0][0]) not in cls


def test_words_with_a_class_are_bounded(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(40) for _ in range(1 + j // 4))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (8, 20, 1 << 22):
        model, rare = brown.fit(frame, head=0, clustered=4, classes=2, most=most)
        assert 0 < len(model["h"]) <= min(most, 40) and len(model["h"]) + rare.count() == 40
        assert set(model["n"]) == set(sorted((30 * (1 + j // 4) for j in range(40)), reverse=True)[: len(model["h"])])
    assert brown.level_of([(9, 2), (7, 3), (1, 5)], 5) == 7 and brown.level_of([(9, 2)], 1) == 1 << 62


def test_packed_counts_round_trip():
    r = np.random.default_rng(3)
    code = np.unique(r.integers(0, 40 * 133, 900))
    n = r.integers(1, 1 << 32, len(code))
    word, blobs = brown.packed(code // 133, code % 133, n)
    batch = pa.RecordBatch.from_arrays([word, blobs], ["word", "counts"])
    for part in (batch, batch.slice(5, 20)):
        w, side, c = brown.unpacked(part)
        kept = np.isin(code // 133, part.column(0).to_numpy())
        assert (w * 133 + side == code[kept]).all() and (c == n[kept]).all()
    assert [len(x) for x in brown.unpacked(batch.slice(0, 0))] == [0, 0, 0]
