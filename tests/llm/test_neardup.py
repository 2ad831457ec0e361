import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm.neardup import dart_signatures, near_duplicates


def shingle_counts(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(docs):
    """Brute force: least id reachable over links of similarity 0.8 or equal texts."""
    ids = sorted({i for i, t in docs if i is not None})
    text = {i: t for i, t in docs}
    sets = {i: shingle_counts(text[i]) if text[i] else Counter() for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and text[i] is not None and text[j] is not None and (text[i] == text[j] or similarity(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, n = [], 0
    for g in range(12):
        base = [word() for _ in range(rnd.choice([60, 120, 200]))]
        for _ in range(rnd.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = word()
            docs.append((n, " ".join(w)))
            n += 1
    chain = [word() for _ in range(300)]
    for _ in range(8):  # neighbours are alike, the ends are not
        docs.append((n, " ".join(chain)))
        n += 1
        for i in range(8):
            chain[rnd.randrange(300)] = word()
    docs += [(n, "one two"), (n + 1, "One, two!"), (n + 2, "!!!"), (n + 3, "!!!"), (n + 4, "..."), (n + 5, ""), (n + 6, None), (n + 7, None), (n + 8, "a a a a a a a a a a a a a a a"), (n + 9, "a a a a a a a a a a a a a a a a")]
    return docs


def test_classes_match_brute_force(spark):
    docs = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in [*docs, docs[3], (None, docs[0][1]), (None, None)]], "doc_id long, text string, key string")
    got = near_duplicates(table).collect()
    assert len(got) == len(docs) + 3
    want = classes(docs)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert all(not r.kept and r.class_id is None for r in got if r.doc_id is None)


def hot_group():
    """Texts that share most of their words and are mostly less alike than asked: in one bucket, with few links."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base, docs = [word() for _ in range(100)], []
    for i in range(90):
        edits = rnd.randrange(1, 7)
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    line = " ".join(base[:8])
    return docs + [(100 + i, " ".join([line] * 40 + [word() for _ in range(rnd.randrange(20, 60))])) for i in range(60)]


@pytest.mark.parametrize("alone", [False, True])
def test_rare_shingles_lose_no_link(spark, alone):
    docs = hot_group() if alone else [*hot_group(), *((1000 + i, t) for i, t in corpus())]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = classes(docs)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert {r.doc_id: r.members for r in got} == {i: sizes[c] for i, c in want.items()}


def test_links_that_the_leader_misses(spark):
    """Two texts alike, both too far from the text that meets the most others, are linked by their rare shingles."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    far = list(base)
    for i in (8, 30, 52, 74, 96):
        far[i] = word()
    docs = [(i, " ".join([*base[:117], *(word() for _ in range(3))])) for i in range(40)]
    docs += [(100 + i, " ".join([*far[:118], word(), word()])) for i in range(6)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = classes(docs)
    assert len(set(want.values())) == 2
    assert {r.doc_id: r.class_id for r in got} == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    text = np.r_[np.zeros(60, int), np.ones(60, int)]
    weight = np.r_[a, b]
    on = weight > 0
    sig = dart_signatures(text[on], np.r_[items, items][on], weight[on], 3, 4000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03 and not sig[2].any() and (sig[:2] != 0).all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
