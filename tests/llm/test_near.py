import random
import re

from spanloom.llm import near


def grams(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [grams(t) for _, t in docs]
    linked = [[j for j in range(len(docs)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(docs))]
    root = list(range(len(docs)))
    for _ in docs:
        for i, others in enumerate(linked):
            root[i] = min([root[i], *(root[j] for j in others)])
    least = {}
    for r, (i, _) in zip(root, docs, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, least[root[k]], len(linked[k])) for k, (i, _) in enumerate(docs)), key=repr)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs = [(None, None), (901, ""), (902, "!!"), (903, "one two"), (904, "One, two!"), (905, "one"), (906, None)]
    for g in range(12):
        base = [word() for _ in range(r.choice([6, 40, 90, 300]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            docs.append((len(docs) + g, " ".join(copy)))
    docs += docs[8:11]
    docs.append((None, docs[12][1]))
    docs.append((7777, " ".join(word() for _ in range(30000))))
    return docs


def test_banding():
    bands, rows = near.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= near.RECALL and bands * rows <= near.MOST_HASHES


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as uid").repartition(5)
    for nodes in (512, 4):
        monkeypatch.setattr(near, "BLOCK_NODES", nodes)
        out = near.jaccard_classes(frame).collect()
        assert sorted([(r.doc_id, r.class_id, r.n_links) for r in out], key=repr) == brute(docs)
        assert len({r.class_uid for r in out}) == len({(r[1] if r[0] is not None or r[1] is not None else None) for r in brute(docs)})


def test_no_rows(spark):
    assert near.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def group(n, edits, seed=3):
    """n different near copies of one text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for i in range(n):
        copy = list(base)
        for _ in range(r.choice(edits)):
            copy[r.randrange(len(copy))] = word()
        docs.append((i, " ".join([*copy, word() + str(i)])))
    return docs


def test_large_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_NODES", 16)
    monkeypatch.setattr(near, "SALT_NODES", 8)
    docs = group(150, range(7)) + [(1000 + i, t) for i, t in group(60, [0, 1], seed=4)]
    out = near.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in out], key=repr) == brute(docs)


def test_rows_grow_with_nodes(spark, monkeypatch):
    """Of one group of different near copies: hub links and deltas grow in proportion, and no pair of blocks is formed."""
    counts, dealt = [], []
    kept = near.saved, near.block_pairs
    monkeypatch.setattr(near, "saved", lambda df, name: (t := kept[0](df, name), counts.append((name, t.count())))[0])
    monkeypatch.setattr(near, "block_pairs", lambda rows: (t := kept[1](rows), dealt.append(t.count()))[0])
    for n in (300, 600, 1200):
        counts.clear(), dealt.clear()
        out = near.jaccard_classes(spark.createDataFrame(group(n, [0, 1]), "doc_id long, text string")).agg({"n_links": "min", "class_id": "max"}).first()
        assert out["min(n_links)"] == n - 1 and out["max(class_id)"] == 0
        of = dict(counts)
        assert of["hubs"] == of["deltas"] == of["grams"] == n and of["checked"] == 0 and dealt == [0]


def test_nulls_beside_strings(spark):
    docs = [("one two", None), (None, "one two"), ("x", "one two"), (None, None)]
    out = near.jaccard_classes(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in out], key=repr) == sorted([("one two", "one two", 0), (None, "x", 1), ("x", "x", 1), (None, None, 0)], key=repr)
