import math
import random
import re
import zlib

from spanloom.llm import langid

WORDS = {
    "en": "the of and to in that is was for with his they this have from one had word but not what all were when your can said there use an each".split(),
    "fr": "le la les des une est pour dans que qui sur avec son plus par pas ce cette mais nous vous leur bien sans deux même être fait très après".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für über müssen größe".split(),
}


def corpus(n=300):
    r = random.Random(6)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(20, 120))), lang))
    return out


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus() + [(900, None, "en"), (901, "", None), (902, "123 !! ²", "fr"), (None, "the of and to in that", None), (5, "x" * 200000, None)]
    docs += [(903, "жил был поэт и писал стихи " * 5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4).selectExpr("*", "'x' AS score")
    model = langid.fit(frame)
    out = langid.predict(frame, model).withColumn("held_out", langid.held_out(langid.F.col("doc_id"))).collect()
    assert len(out) == len(docs)
    test = [r for r in out if r.held_out and r.lang]
    assert test and sum(r.lang == r.lang_pred for r in test if r.lang_pred != "und") / len(test) > 0.9
    by = {r.doc_id: r for r in out if r.doc_id in (900, 901, 902)}
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in by.values())
    assert all(r.lang_pred in [*WORDS, "und"] and 0 <= r.score <= 1 for r in out)
    assert all(not r.rejected for r in out if r.lang and r.doc_id < 300)
    assert {r.doc_id: r.held_out for r in out if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs if i is not None}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = corpus(120)
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in docs]
    assert "xx" not in langid.fit(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))["langs"]


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    row = langid.predict(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string"), model).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def brute(model, text):
    """(language, score) by the definition: the mean of the subwords' rows, one subword at a time."""
    if text is None or not re.search(r"[^\W\d_]", text) or not model["langs"]:
        return "und", 0.0
    data = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    total, n = [0.0] * len(model["langs"]), 0
    for order in langid.ORDERS:
        for k in range(len(data) - order + 1):
            h = int.from_bytes(data[k : k + order], "big")
            h = (h ^ h >> 15) * 0x9E3779B1 % 2**32
            h = (h ^ h >> 13 ^ order) * 0x85EBCA77 % 2**32
            total = [t + float(x) for t, x in zip(total, model["table"][h >> 32 - langid.BUCKETS_LOG2], strict=True)]
            n += 1
    z = [t / max(1, n) for t in total]
    e = [math.exp(x - max(z)) for x in z]
    best = e.index(max(e))
    return model["langs"][best], e[best] / sum(e)


def test_against_brute_force(spark):
    docs = [(i, t) for i, t, _ in corpus(60)] + [(100, None), (101, ""), (102, "7 !"), (103, "é"), (104, "A"), (105, "ab"), (106, "ÀÉ the of " * 300), (107, "的是不了")]
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit(frame)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for i, t in docs:
        lang, score = brute(model, t)
        assert out[i][0] == lang and abs(out[i][1] - score) < 1e-5, (i, t)


def test_sample_is_bounded_and_ordered(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda features, labels: seen.append((len(features), labels)))
    frame = spark.createDataFrame([*corpus(), *corpus(5) * 40], "doc_id long, text string, lang string")
    for n in (1, 7):
        langid.fit(frame.repartition(n), 30)
    assert seen[0][0] == 30 and seen[0] == seen[1]
