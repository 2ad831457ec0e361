import random

import numpy as np

from granary.llm.quality import BUCKETS, DIM, GRAMS, REPEAT, Model, counted, hashes, quality


def test_hashes_are_of_words_and_their_grams():
    assert len(hashes("")) == len(hashes("  \n")) == 0
    one = hashes("abcd")  # the word; " ab" "abc" "bcd" "cd "; " abc" "abcd" "bcd "; " abcd" "abcd "
    assert len(one) == 1 + 4 + 3 + 2
    both = hashes("abcd  xyz\nabcd")
    assert len(both) == 2 * 10 + 1 + 3 + 2 + 1
    assert sorted(both) == sorted([*one, *one, *hashes("xyz")])


def test_a_repeated_word_has_a_token_of_its_own():
    assert sorted(hashes("abcd abcd abcd xyz")) == sorted([*hashes("abcd"), *hashes("abcd"), *hashes("abcd"), *hashes("xyz"), *hashes(REPEAT), *hashes(REPEAT)])


def slow_features(text):
    """Words, the n-grams that blanks bound, and the token after each repeat, one by one."""
    words, out = text.split(), []
    tokens = [t for i, w in enumerate(words) for t in ([w, REPEAT] if i and words[i - 1] == w else [w])]
    for t in tokens:
        raw = b" " + t.encode() + b" "
        out += [t] + [raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    return out


def test_features_are_counted_as_one_by_one():
    rnd = random.Random(6)
    for _ in range(60):
        text = " ".join(rnd.choice(["a", "é", "word", "grüße", "a", "longerword"]) for _ in range(rnd.randrange(0, 12)))
        want = slow_features(text)
        got = hashes(text)
        assert len(got) == len(want) and len(set(got)) == len(set(want))


def test_long_texts_are_read_whole():
    """What stands at the very end of a long text still moves its score."""
    m = Model(np.random.default_rng(1).normal(size=(BUCKETS, DIM)).astype("f4"), np.eye(2, DIM, dtype="f4"), np.zeros(2, "f4"))
    body = "alpha beta " * 200_000
    assert m.score(body + "omega") != m.score(body + "gamma")


def test_folding_is_exact():
    rng = np.random.default_rng(0)
    m = Model(rng.normal(size=(BUCKETS, DIM)).astype("f4"), rng.normal(size=(2, DIM)).astype("f4"), np.array([0.1, 0.3], "f4"))
    text = "some words and some other words"
    z = m.out @ m.embed(text) + m.bias
    assert abs(m.score(text) - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4
    ids, share = counted(text)
    assert abs(share.sum() - 1) < 1e-5 and len(ids) == len(set(ids))


def test_learns_and_scores_all_rows(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        y = int(i % 3 > 0)
        word = (lambda: rnd.choice(["river", "stone", "carry", "meadow"])) if y else (lambda: rnd.choice(["BUY!!", "NOW***", "win$$$", "cash%%%"]))
        docs.append((i, " ".join(word() for _ in range(40)), 0.5))
        labels.append((i, y))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (1002, "river stone", 0.0), (1002, "river stone", 0.0), (None, "BUY!! NOW***", 0.0)]
    out = quality(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert all(by[i].predicted == y for i, y in labels) and by[1002].predicted == 1 and by[None].predicted == 0


def test_empty_tables(spark):
    none, nolab = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality(none, nolab).count() == 0
    assert quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"), nolab).first().score == 0.5
