import random
from itertools import combinations

from granary.llm.licenses import TEMPLATES, Scanner, align, longest_run, scan_licenses


def test_longest_run_is_longest():
    rnd = random.Random(1)
    for _ in range(100):
        x = [rnd.randrange(12) for _ in range(rnd.randrange(0, 9))]
        got = [x[i] for i in longest_run(x)]
        assert all(a < b for a, b in zip(got, got[1:]))
        want = max((n for n in range(len(x) + 1) if any(all(a < b for a, b in zip(c, c[1:])) for c in combinations(x, n))), default=0)
        assert len(got) == want


def test_alignment_is_increasing_and_equal():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
        assert len(align(a, a)) == len(a)


def test_scans(spark):
    body = "lorem ipsum the of and is under work " * 20
    rows = [
        (1, body + TEMPLATES["MIT"] + " " + body),
        (2, TEMPLATES["Apache-2.0"] + "\n" + body + "\n" + TEMPLATES["Apache-2.0"].upper()),
        (3, "This work is  LICENSED under GNU General Public License (version 3)"),
        (4, TEMPLATES["CC-BY-NC-4.0"] + " " + TEMPLATES["GPL-3.0"]),
        (5, "a license and a version of the apache"), (6, ""), (7, None), (8, body * 200 + TEMPLATES["GPL-2.0"] + "İ"), (1, "x"),
    ]
    got = scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(rows)
    names = sorted((r.doc_id, [x.license for x in r.licenses]) for r in got)
    assert names == sorted([(1, ["MIT"]), (2, ["Apache-2.0"] * 2), (3, ["GPL-3.0"]), (4, ["CC-BY-NC-4.0", "GPL-3.0"]), (5, []), (6, []), (7, []), (8, ["GPL-2.0"]), (1, [])])
    text = dict(rows)
    hit = next(x for r in got if r.doc_id == 4 for x in r.licenses if x.license == "GPL-3.0")
    assert text[4][hit.start : hit.stop] == TEMPLATES["GPL-3.0"][:-1] and hit.coverage == 1


def test_notices_at_the_bound_and_with_words_between():
    scan = Scanner(TEMPLATES).scan
    assert [x[:2] for x in scan("Distributed under the MIT License.")] == [("MIT", 0.8)]
    assert [x[:2] for x in scan("Released by its authors and contributors under the MIT License")] == [("MIT", 1.0)]
    assert [x[0] for x in scan(TEMPLATES["GPL-3.0"] + " " + TEMPLATES["Apache-2.0"])] == ["GPL-3.0", "Apache-2.0"]


def test_a_mark_behind_a_notice_ends_and_finds_what_follows():
    """Marks whose best alignment lies before or behind them are passed by, and a notice near a better one is its own."""
    scan = Scanner(TEMPLATES).scan
    assert [x[0] for x in scan("Licensed under CC BY-NC 4.0.\nBy hentha reshon edlyti by anor")] == ["CC-BY-NC-4.0"]
    assert [x[0] for x in scan("By 4 by 4. Released under the MIT License. Released to the mit. By whom?")] == ["MIT"]
    assert [x[:2] for x in scan("Released under the MIT License. Distributed under the MIT License.")] == [("MIT", 1.0), ("MIT", 0.8)]
    rnd = random.Random(7)
    pool = sorted({w for t in TEMPLATES.values() for w in t.split()})
    for _ in range(300):
        scan(" ".join(rnd.choice([*pool, *TEMPLATES.values()]) for _ in range(30)))


def test_a_long_template_may_drift():
    """200 words with 39 inserted words that the template has too: every word is still covered."""
    rnd = random.Random(4)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{i % 150}x" for i in range(200)]
    text = list(words)
    for i in sorted(rnd.sample(range(5, 195), 39), reverse=True):
        text.insert(i, rnd.choice(["the", "and", "of"]))
    got = Scanner({"long": " ".join(words)}).scan("lorem ipsum " * 30 + " ".join(text) + " dolor" * 50)
    assert [x[0] for x in got] == ["long"] and got[0][1] >= 0.99


def test_no_templates(spark):
    assert Scanner({}).scan("abc") == []
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
