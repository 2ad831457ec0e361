import random

from granary.llm.decontaminate import Matcher, matches, normal, occurs, pieces


def brute(pattern, text):
    """Least distance of pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row)


def edit(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        rnd.choice([lambda: s.__setitem__(i, "#"), lambda: s.pop(i), lambda: s.insert(i, "#")])()
    return "".join(s)


def test_pieces_cover():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(10, 40)))) for i in range(12)] + [(20, None), (21, "  ")]
    items.append((30, items[0][1].upper()))
    docs = []
    for i in range(60):
        body = [word() for _ in range(50)]
        if i % 2:
            t = rnd.choice(items[:12])[1]
            body.insert(25, edit(rnd, t, rnd.randrange(0, max(1, int(0.12 * len(t))))))
        docs.append((i, "  \n".join(body)))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1]), (103, " ".join(["abc"] * 30_000) + " " + items[3][1])]
    rate = 0.08
    out = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rate=rate, block_chars=700).collect()
    assert len(out) == len(docs)
    texts = dict(docs)
    for r in out:
        if r.doc_id == 103:
            assert 3 in r["items"]
            continue
        t = normal(texts[r.doc_id])
        want = {i: d for i, x in items if normal(x) and (d := brute(normal(x), t)) <= int(rate * len(normal(x)))}
        assert dict(zip(r["items"], r["distances"])) == want


def test_myers_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        p = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 90)))
        t = "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 120)))
        masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in "ab"}
        d = brute(p, t)
        assert occurs(masks, len(p), t, len(p) - 1) == (d if d <= len(p) - 1 and t else None)


def test_nothing(spark):
    assert Matcher([], 0.1).find("abc") == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert matches(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).first()["items"] == []
