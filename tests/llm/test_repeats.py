import random

import numpy as np
import pytest

from spanloom.llm import repeats as r
from spanloom.llm.textnum import Powers, byte_values


def brute(docs, span):
    where = {}
    datas = [(i, (t or "").encode()) for i, t in docs]
    for k, (_, d) in enumerate(datas):
        for p in range(len(d) - span + 1):
            where.setdefault(d[p : p + span], []).append((k, p))
    gone = [np.zeros(len(d), bool) for _, d in datas]
    for places in where.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + span] = True
    out = []
    for (i, d), g in zip(datas, gone, strict=True):
        n_spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        out.append((i, len(d), int(g.sum()), n_spans, bytes(np.frombuffer(d, np.uint8)[~g])))
    return sorted(out, key=repr)


def corpus(span):
    rnd = random.Random(3)
    chars = "abcdefgh \n\0éß"
    word = lambda n: "".join(rnd.choice(chars) for _ in range(n))
    passage, line = word(span + 30), word(span - 1)
    docs = [(1, None), (2, ""), (3, "a" * (span - 1)), (4, "a" * (span * 3)), (5, "ab" * span), (6, "abc" * 3000), (7, passage), (7, passage), (None, passage)]
    for i in range(10, 40):
        docs.append((i, word(rnd.randrange(200)) + rnd.choice([passage, passage[5:], line, ""]) + word(rnd.randrange(100))))
    base = word(span * 4)
    for i in range(40, 60):
        copy = list(base)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = "z"
        docs.append((i, "".join(copy)))
    return docs + [(70, word(50) + line), (71, line + word(9)), (72, passage[:span] + passage[:span]), (73, word(5000))]


@pytest.mark.parametrize("hot,bucket,widths", [(2000, 1 << 20, r.WIDTHS), (3, 3000, (16, 4, 1)), (1, 3000, (20, 1))])
def test_against_brute_force(spark, monkeypatch, hot, bucket, widths):
    monkeypatch.setattr(r, "WIDTHS", widths)
    docs = corpus(50)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS spans").repartition(5)
    out = r.remove_repeats(frame, 50, 8, hot, bucket).collect()
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in out), key=repr)
    assert got == brute(docs, 50)


def test_full_span(spark):
    docs = corpus(400)
    out = r.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in out), key=repr) == brute(docs, 400)


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(2)
    for size, letters in [(1, 2), (2, 1), (300, 1), (800, 2), (800, 3), (2000, 26), (1500, 256)]:
        text = rnd.integers(0, letters, size).astype(np.uint8)
        text[size // 2 : size // 2 + size // 4] = text[: size // 4]
        text = np.append(text, np.uint8(0))
        wanted = rnd.random(len(text)) < 0.7
        wanted[-1] = False
        powers = Powers()
        array = r.suffix_array(text, wanted, r.Hasher(text, byte_values(5), powers), r.words8(text), 64)
        data = text.tobytes()
        assert sorted(array.tolist()) == np.flatnonzero(wanted).tolist()
        heads = [data[i : i + 64].ljust(64, b"\0") for i in array]
        assert heads == sorted(heads)


def test_no_rows(spark):
    assert r.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nulls_beside_strings(spark):
    text = "0123456789" * 50
    docs = [("a", None), (None, text), (text, None), ("b", "x" + text)]
    out = r.remove_repeats(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in out), key=repr) == brute(docs, 400)
