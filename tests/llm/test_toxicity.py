import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.toxicity import Lexicon, edits_allowed, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


TERMS = ["idiot", "stupid", "disgusting", "bad", "idiom"]
LEX = Lexicon(TERMS, ["lowei"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("idiotsumgnpbalwe", max_size=12), st.sampled_from([t[:i] + c + t[j:] for t in TERMS for i in range(len(t)) for j in (i, i + 1) for c in ("", "x")])))
def test_automaton_is_edit_distance(word):
    best = [(distance(word, t), t) for t in TERMS]
    want = 2 if word.startswith("lowei") else 1 if any(d == 0 for d, _ in best) else 3 if any(d <= edits_allowed(t) for d, t in best) else 0
    assert LEX.outcome(word) == (1 if any(d == 0 for d, _ in best) else want)


def test_quotation_counts_less_than_abuse():
    direct = LEX.features("you are a stupid person and an idiot")
    quoted = LEX.features('he said "stupid" and wrote "idiot" in the report')
    assert sum(direct[:3]) > sum(quoted[:3]) > 0


def test_learns_and_scores_all_rows(spark):
    rnd = random.Random(1)
    filler = ["alpha", "beta", "gamma", "delta", "house", "tree"]
    docs, labels = [], []
    for i in range(400):
        words = [rnd.choice(filler) for _ in range(30)]
        y = int(i % 4 == 0)
        if y:
            words[7] = "grobble"
            words[20] = rnd.choice(["grobble", "zunkkopf", "zunkel", "zunkig"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, y))
    docs += [(1000, None, ""), (1001, "", ""), (1002, "alpha grobbel tree", ""), (1003, "you grobbble", ""), (1003, "you grobbble", ""), (None, "grobble", "")]
    labels += [(1001, None), (None, 1)]
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    assert all(by[i].predicted == y for i, y in labels if i is not None and y is not None)
    assert by[1000].predicted == by[1001].predicted == 0 and by[1003].predicted == 1 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in out)


def test_misspellings_and_quotation_change_the_result(spark):
    """Planted held-out texts: misspelled terms are caught, which exact terms alone miss, and a quoted term scores below the same one as abuse."""
    rnd = random.Random(7)
    filler = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "cloud"]
    terms = ["grobblekin", "zunkelwort", "snarfling"]
    docs, labels = [], []
    for i in range(600):
        words = [rnd.choice(filler) for _ in range(40)]
        kind = i % 4
        if kind == 0:
            words[9] = words[25] = rnd.choice(terms)
        if kind == 1 and i % 8 == 1:
            t = rnd.choice(terms)
            words[9] = f'the report said "{t}" and called'
        docs.append((i, ("you " if kind == 0 else "") + " ".join(words)))
        labels.append((i, int(kind == 0)))
    body = " ".join(rnd.choice(filler) for _ in range(40))
    copy = " ".join(f"rare{i}word" for i in range(30)) + f" {terms[0]} you"
    docs += [(800 + i, copy) for i in range(40)]  # what copies share is no lexicon
    labels += [(800 + i, 1) for i in range(40)]
    docs += [(3000, " ".join(f"rare{i}word" for i in range(30)) + " " + body)]
    docs += [(1000 + i, f"you {w} {body} {w}") for i, w in enumerate(["groblekin", "zunkelwrt", "snarflinng"])]
    docs += [(2000, f'he said "{terms[0]}" in the report {body}'), (2001, f"you are a {terms[0]} and {body}")]
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[1000 + i].predicted == 1 for i in range(3))
    assert got[3000].predicted == 0
    assert got[2000].score < got[2001].score and got[2001].predicted == 1


def test_long_words_and_terms_are_read(spark):
    long = "x" * 60
    docs = [(i, f"alpha beta{i} {long if i % 3 == 0 else 'gamma'} delta{i % 7}") for i in range(90)]
    got = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity(some, spark.createDataFrame([], "doc_id long, toxic int")).first().predicted == 0
