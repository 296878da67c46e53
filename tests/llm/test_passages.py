import random
import re

import numpy as np
import pyarrow as pa

from spanloom.llm import passages as p
from spanloom.llm.arrowio import as_bytes
from spanloom.llm.common import row_key
from spanloom.llm.textnum import NOT_SPACE, Powers, byte_values, span_hashes, word_bounds

LENGTH, NOISE = 12, 7


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def strings(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, None), (2, ""), (3, "one"), (4, line(LENGTH - 1)), (5, line(400))]
    for n in range(NOISE - 1, 3 * LENGTH):
        passage = line(n)
        docs += [(100 + 2 * n, line(r.randrange(30)) + "\n " + passage + "\t" + line(r.randrange(30))), (101 + 2 * n, passage)]
    docs += [(6, "a b " * 100), (7, docs[4][1]), (8, docs[4][1]), (8, docs[4][1]), (9, "x " + line(60)), (9, "x y")]
    own = line(60)
    return docs + [(10, own), (10, own), (None, line(40) + " " + own[:200])]


def test_guarantee_and_noise(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").select(row_key("doc_id", "text").alias("uid"), "doc_id", "text").repartition(4)
    found = p.shared_strings(frame, LENGTH, NOISE).join(frame.dropDuplicates(["uid"]), "uid").collect()
    flagged = {(r.doc_id, r.text) for r in found}
    kinds = set(docs)
    for doc in kinds:
        others = [d for d in kinds if d != doc]
        if any(strings(doc[1], LENGTH) & strings(d[1], LENGTH) for d in others):
            assert doc in flagged, doc
        elif not any(strings(doc[1], NOISE) & strings(d[1], NOISE) for d in others):
            assert doc not in flagged, doc
    assert (1, None) not in flagged and all(r.n_shared > 0 for r in found)


def test_selection_against_brute_force():
    docs = [t or "" for _, t in corpus()]
    flat, offsets = as_bytes(pa.array(docs))
    starts, ends, counts = word_bounds(flat, offsets, NOT_SPACE)
    hashes = span_hashes(flat, starts, ends, byte_values(17), Powers())
    grams, of = p.selected(hashes, counts, LENGTH, NOISE)
    at = 0
    for i, n in enumerate(counts):
        own, per_text = p.windows(hashes[at : at + n], np.array([n]), NOISE)
        key = (p.mix(own) >> np.uint64(30)).tolist()
        width, picked = LENGTH - NOISE + 1, []
        for k in range(len(own) - width + 1):
            best = min(range(k, k + width), key=lambda j: (key[j], j))
            if not picked or picked[-1] != best:
                picked.append(best)
        assert grams[of == i].tolist() == own[picked].tolist()
        at += n


def test_no_rows(spark):
    assert p.shared_strings(spark.createDataFrame([], "uid binary, text string")).count() == 0
