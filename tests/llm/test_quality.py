import random
import re
from collections import Counter

from spanloom.llm import quality


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {x for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for x in range(i, i + 8)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            lines += 1
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup,
        "n_repeat_words": len(covered), "n_lines": lines, "n_letters": sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in t),
        "n_upper": sum("A" <= c <= "Z" for c in t), "n_marks": sum(c in "!?" for c in t), "n_same": sum(a == b for a, b in zip(w, w[1:])),
    }


def texts():
    r = random.Random(2)
    out = [None, "", "\n", " \n \n", "a", "a\na\na \n", "x y z " * 400, "é" * 50, "\x1c a\x85b   c", "A! " * 40, "Ö" + "#" * 9]
    for _ in range(120):
        n = r.choice([1, 5, 30, 300])
        out.append("".join(r.choice(["a", "b", "é", "日本", "a b c d e f g h ", "\n", " ", "\n\n", "#", "Q", "same line\n"]) for _ in range(n)))
    return out + ["w%d " % 7 * 20000]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (3, "a b"), (3, "a b")]
    out = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS failures", "2 AS n_words")).collect()
    assert len(out) == len(rows)
    got = sorted([(r.doc_id, tuple(r[m] for m in quality.MEASURES)) for r in out], key=repr)
    assert got == sorted([(i, tuple(brute(t)[m] for m in quality.MEASURES)) for i, t in rows], key=repr)


def test_policies_and_ablation(spark):
    rows = [(1, "a b"), (2, "a b"), (3, " ".join(f"word{i}" for i in range(50))), (4, "! " * 30 + "word")]
    ledger = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id for r in ledger.where(quality.passes("v1")).collect()}
    assert kept == {3}
    found = {r.rule: r for r in quality.ablation(ledger).collect()}
    for name in quality.POLICIES["v1"]:
        mask = quality.mask_of([name])
        fails = [r.failures for r in ledger.collect()]
        assert found[name].n_failed == sum(f & mask != 0 for f in fails)
        assert found[name].n_only == sum(f == mask for f in fails)
        assert found[name].kept_without == sum(f & ~mask == 0 for f in fails)


def test_no_rows(spark):
    empty = quality.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and {r.n_failed for r in quality.ablation(empty).collect()} == {0}
