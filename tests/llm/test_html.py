import random

import numpy as np
import pyarrow as pa

from granary.llm import html
from granary.llm.arrow import slices
from granary.llm.html import covered_by, judged_text, main_text, parse, parse_blocks, repeated_runs

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><article><h1>Head&amp;</h1><p><b>Bold  text.<br><p>Next &quot;one&quot; &copy; a &lt; b</p>'
    '<div class="ad-bar">Share</div><p>In<i>line</i>&nbsp;end<section id=comments><p>First!</p></section></article><aside>Side</aside><footer>&copy; host</footer></body></html>'
)


def test_article_of_a_marked_page():
    article, contested, boiler, marked = parse(PAGE)
    assert marked and " ".join(article) == 'Head& Bold text. Next "one" © a < b Inline end'
    assert contested == [] and "Menu" in boiler and "© host" in boiler


def test_cut_off_pages_and_oddities():
    assert " ".join(parse("<body><article><p>one</p><p>two <b")[0]) == "one two"
    assert " ".join(parse("<article>a</div></span><p>b</article>c")[0]) == "a b"
    assert parse(None) == ([], [], [], False) and parse("")[3] is False
    assert parse("1 < 2 and <p>3")[1] == ["1 < 2 and", "3"]
    assert " ".join(parse("<article><p title='a>b'>x</p><textarea>form</textarea></article>")[0]) == "x"


def test_an_article_keeps_its_parts_whatever_they_are_called():
    assert " ".join(parse('<article><p>a</p><p class="related">r</p></article>')[0]) == "a r"
    assert " ".join(parse('<article><div class="search-results">c</div><div class="cookie-notice">n</div></article>')[0]) == "c"
    assert parse('<div class="related">x</div><article>y</article>')[0] == ["y"]


def test_runs_match_brute_force():
    rng = np.random.default_rng(3)
    for length in (1, 2, 3, 4, 7):
        tokens, page = rng.integers(0, 3, 120), np.sort(rng.integers(0, 6, 120))
        grams = {}
        for i in range(120):
            if i + length <= 120 and page[i] == page[i + length - 1]:
                grams.setdefault(tuple(tokens[i : i + length]), []).append(i)
        want = np.zeros(120, bool)
        for at in grams.values():
            want[at] = len({page[i] for i in at}) > 1
        assert (repeated_runs(tokens, page, length) == want).all()


def test_hosts_decide_open_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, want = [], []
    for i in range(30):
        body = " ".join(word() for _ in range(12))
        page = f"<body><div>Welcome to our great site</div><p>{body}</p><span>All rights reserved forever here</span>"
        rows.append((i, f"http://one.test/{i}", page, "x"))
        want.append((i, f"http://one.test/{i}", body, len(body)))
    rows += [(50, "http://other.test/", rows[0][2], "x"), (51, None, None, "x"), (52, "http://one.test/z", "", "x"), (53, "http://one.test/a", PAGE, "x"), (0, *rows[0][1:])]
    whole = "Welcome to our great site " + want[0][2] + " All rights reserved forever here"
    art = 'Head& Bold text. Next "one" © a < b Inline end'
    want += [(50, "http://other.test/", whole, len(whole)), (51, None, "", 0), (52, "http://one.test/z", "", 0), (53, "http://one.test/a", art, len(art)), want[0]]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for pages in (200, 4):
        monkeypatch.setattr(html, "PAGES", pages)
        got = [tuple(r) for r in main_text(table).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_prose_that_shares_phrases_and_articles_under_two_urls_stay(spark):
    rnd = random.Random(4)
    vocabulary = ["on the other hand", "at the end of the day", "it is said that", "the quick brown fox", "one of the most", "as a matter of fact", "rain", "sun", "snow", "wind"]
    bodies = [" ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(20)]
    legal = " ".join(f"clause{i}" for i in range(40))
    rows = [(i, f"http://one.test/{i}", f"<body><p>{b}</p><p>Share this</p><div>no {i} {legal}</div>") for i, b in enumerate(bodies)]
    rows += [(90 + i, f"http://one.test/copy{i}", rows[0][2]) for i in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{b} no {i}" for i, b in enumerate(bodies)} | {90 + i: f"{bodies[0]} no 0" for i in range(4)}


def test_text_outside_a_marked_element_is_decided_too(spark):
    rows = [(i, f"http://one.test/{i}", f"<body><div>Our great site</div><div>Body of number {i}</div><article class=card>Card {i}</article><nav>Menu</nav>") for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body of number {i} Card {i}" for i in range(5)}


def test_empty(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_are_in_the_arrays_and_keep_their_repeats(spark):
    legal = " ".join(f"clause{i}" for i in range(40))
    rows = [(i, f"http://one.test/{i}", f"<body><article><p>Body of number {i}</p><p>{legal}</p></article>") for i in range(2)]
    rows += [(2, "http://one.test/2", f"<body><div>Body of number 2</div><div>{legal}</div>"), (3, "http://two.test/", f"<body><div>{legal}</div>")]
    got = {r.page_id: (r.text, r.n_repeated) for r in judged_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: (f"Body of number 0 {legal}", 40), 1: (f"Body of number 1 {legal}", 40), 2: ("Body of number 2", 0), 3: (legal, 0)}


def test_pieces_of_one_bucket_are_compared_by_their_words():
    def piece(host, page, words, start=0, whole=False):
        return {"key": 7, "whole": whole, "host": host, "content": " ".join(words), "pages": [page], "at": [{"page": page, "start": start, "first": start, "beyond": start + len(words)}]}

    run, other = [f"w{i}" for i in range(32)], [f"v{i}" for i in range(32)]
    pages = [b"a", b"b", b"c"]
    assert covered_by([piece("h", p, w) for p, w in zip(pages, (run, other, run), strict=True)]) == []
    assert covered_by([piece("h", p, run) for p in (b"a", b"b", b"a")]) == []
    assert covered_by([piece(h, p, run) for h, p in zip("hhg", pages, strict=True)]) == []
    shared = [piece("h", b"a", ["x", *run], 5), piece("h", b"b", run), piece("h", b"c", [*run, "y"], 2)]
    assert covered_by(shared) == [("h", b"a", [6, 38]), ("h", b"b", [0, 32]), ("h", b"c", [2, 34])]
    short = ["\t", "Share", "\n"]
    assert covered_by([piece("h", p, short, 4, True) for p in pages]) == [("h", p, [4, 7]) for p in pages]
    assert covered_by([piece("h", p, short, 4, True) for p in pages[:2]]) == []


def _by_force(rows):
    parsed = {i: (url.split("/")[2], parse_blocks(page)[0]) for i, url, page in rows}
    runs, whole = {}, {}
    stream = lambda blocks: [t for _, b in blocks for t in ("\t", *b.split(), "\n")]
    for n, (host, blocks) in enumerate({(h, tuple(b)) for h, b in parsed.values()}):
        words = stream(blocks)
        for i in range(len(words) - html.RUN + 1):
            runs.setdefault((host, *words[i : i + html.RUN]), set()).add(n)
        for z, b in blocks:
            if z:
                whole.setdefault((host, b), set()).add(n)
    out = {}
    for i, (host, blocks) in parsed.items():
        words, covered = stream(blocks), set()
        for j in range(len(words) - html.RUN + 1):
            if len(runs[(host, *words[j : j + html.RUN])]) >= html.SEVERAL:
                covered |= set(range(j, j + html.RUN))
        texts, repeated, at = [], 0, 1
        for z, b in blocks:
            split = b.split()
            if z == 0:
                repeated += len(covered & set(range(at, at + len(split))))
            elif z == 1:
                b = "" if len(whole[host, b]) >= html.SEVERAL else " ".join(w for j, w in enumerate(split) if at + j not in covered)
            if z < 2 and b:
                texts.append(b)
            at += len(split) + 2
        out[i] = (" ".join(texts), repeated)
    return out


def test_hosts_match_brute_force_in_whole_and_cut_up_buckets(spark, monkeypatch):
    rnd = random.Random(5)
    bank = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.choice((4, 20, 45, 90)))) for _ in range(14)]
    tags = [("<p>", "</p>"), ("<article>", "</article>"), ("<nav>", "</nav>"), ("<i>", "</i>")]
    rows = []
    for i in range(120):
        cut = [" ".join(w[rnd.randrange(3) :]) for w in (rnd.choice(bank).split() for _ in range(4))]
        rows.append((i, f"http://{rnd.choice(('one', 'two'))}.test/{i}", "<body>" + "".join(f"{a}{t}{b}" for t in cut for a, b in [rnd.choice(tags)]) + f"<p>own{i}</p>"))
    rows += [(200, "http://one.test/long", "<body><p>" + "la " * 3000), (201, "http://one.test/again", "<body><p>" + "la " * 2000), (202, "http://one.test/more", "<body><div>" + "la " * 50 + "end")]
    want = _by_force(rows)
    assert sum(n for _, n in want.values()) > 0 and want[202][0] == "end"
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for pages in (20_000, 2):
        monkeypatch.setattr(html, "PAGES", pages)
        assert {r.page_id: (r.text, r.n_repeated) for r in judged_text(table).collect()} == want


def test_lists_of_texts_are_sliced_by_their_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([["a" * 30, "b"], [], None, ["c" * 30], ["d"]])], ["t"])
    assert [b.num_rows for b in slices([batch], "t", 32)] == [3, 2]
