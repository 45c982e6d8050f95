"""Main text of pages, codes of vectors, periodic runs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_llm import ODD
from gaugeflow.llm import part_codes, periodic_runs, wrapper_text
from gaugeflow.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# Periodic runs


def runs_by_hand(words):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            stretch = words[start : start + length]
            if length >= max(12, 2 * q) and not any(
                stretch[d:] == stretch[:-d] for d in range(1, q)
            ):
                found.append((start, length, q))
            at += 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


pieces = st.tuples(
    st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 5)
).map(lambda p: (p[0] * p[1])[p[2] :])
sequences = st.one_of(
    st.lists(st.integers(0, 1), max_size=200),
    st.lists(pieces, max_size=6).map(lambda p: [x for piece in p for x in piece][:400]),
    st.lists(pieces, max_size=3).map(lambda p: ([x for piece in p for x in piece] * 3)[:500]),
    st.integers(0, 300).map(_fibonacci),
)


@settings(max_examples=250, deadline=None)
@given(st.lists(sequences, max_size=4))
def test_runs_equal_those_by_hand(texts):
    got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts])
    assert got == [runs_by_hand(t) for t in texts]


def test_runs_that_meet_in_another_phase():
    """Periods of a scale whose whole period is periodic itself, with far too many pairs."""
    for unit in ([0], [0, 1], [0, 0, 1]):
        text = (unit * 40)[:-1] + unit * 40 + [7] + (unit * 30)[1:] + unit[:1] + unit * 35
        assert periodic_runs.find_runs([np.array(text)]) == [runs_by_hand(text)]
    long = np.zeros(300_000, np.int64)
    assert periodic_runs.find_runs([long]) == [[(0, 300_000, 1)]]


def _planted_by_hand(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + math.floor((len(words) - a) / (3 + g % 8))
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def _digest_by_hand(doc_id, text):
    flat = "".join(" " if c in " \t\n\v\f\r" else c for c in text or "")
    words = _planted_by_hand(doc_id, [w for w in flat.split(" ") if w])
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id,
        len(runs),
        *longest,
        1000 * longest[1] // longest[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_run_digest(make_docs):
    rng = random.Random(3)
    docs = [d for d in ODD if len(d[1] or "") < 9999]
    for k in range(120):
        words = [rng.choice("ab c d e".split(" ")) for _ in range(rng.randrange(150))]
        docs.append((k // 2, rng.choice([" ", "\n", "\t \r"]).join(words * rng.randrange(1, 4))))
    got = periodic_runs.run_digest(
        periodic_runs.periodic_runs(make_docs(docs), periodic_runs.periods_by_id)
    ).collect()
    assert Counter(map(tuple, got)) == Counter(_digest_by_hand(*d) for d in docs)


def test_runs_of_odd_rows(odd_docs, no_docs):
    got = periodic_runs.periodic_runs(odd_docs).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    # 977 words and 977 times "line" over and over.
    assert (by_id[7].runs[0].period, by_id[1].runs, by_id[3].collapsed) == (2 * 977, [], "")
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(no_docs)).collect() == []


# Codes of vectors


def _codes_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            goes = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, goes) if g == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for e in book for x in e).encode()
    ).hexdigest()
    found = []
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, error, label in found:
        total[label] += error
    return [(i, code, error, total[label], digest) for i, code, error, label in found]


SCHEMA = "vec_id long, embedding array<double>, label int, part string, total long, code string"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_those_by_hand(spark, seed):
    rng = random.Random(seed)
    # Few distinct values give many ties; the last ones are left out.
    values = [-1.0, -0.5, -0.0001, 0.0, 0.25, 0.5, 3.75] if seed else None
    rows = [
        (k, [rng.choice(values) if values else rng.gauss(0, 1) for _ in range(24)], rng.choice([None, 1, 2]))
        for k in rng.sample(range(1000), 150)
    ]
    rows += [(1, rows[0][1], 1)] * 2 if seed == 2 else []
    odd = [
        (-3, None, 1),
        (-2, [float("nan")] * 24, 1),
        (-1, [None, *[0.5] * 23], None),
        (0, [float("-inf")] * 24, 2),
    ]
    got = part_codes.compressed_vectors(_vectors(spark, rows + odd).repartition(5)).collect()
    if seed == 2:
        rows.sort(key=lambda r: (r[0], r[1]))
    assert Counter(map(tuple, got)) == Counter(_codes_by_hand(rows))


def test_search_ends_only_beyond_the_best():
    """Entries whose bound equals the best distance still win ties by their lower index."""
    book = np.array([[1, 1], [-1, -1], [0, 0], [2, 0], [0, 2]])
    parts = np.array([[1, 0], [0, 1], [0, -1], [1, 2], [5, 5], [-9, 9]])
    index, best = part_codes.nearest_entries(parts, book)
    for part, i, d in zip(parts, index, best):
        apart = ((book - part) ** 2).sum(axis=1)
        assert (d, i) == (apart.min(), apart.argmin())


def test_codes_of_odd_tables(spark):
    assert part_codes.compressed_vectors(_vectors(spark, [])).collect() == []
    assert part_codes.compressed_vectors(_vectors(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    few = [(5, [0.1] * 8, None), (None, [0.9] * 8, None), (6, [0.1] * 16, 1), (7, [1e9] * 8, 1)]
    got = {r.vec_id: r for r in part_codes.compressed_vectors(_vectors(spark, few)).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == {5: ("00" * 8, 0), None: ("01" * 8, 0)}


# Main text


def _page(k, article, notice="", menu=True):
    links = "".join(f'<li><a href="/{k}{i}">topic {k} {i}</a>' for i in range(3))
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><script>var a = '<p>no</p>';</script></head><body "
        f"class='has-sidebar'><div id=top class=site-header><p>My site {k}</p></div>"
        f"{f'<nav><ul>{links}</ul></nav>' if menu else f'<div><ul>{links}</ul></div>'}"
        f"<div><p>Read by everyone, every day.</p></div>{article}{notice}"
        f"<div class='reader-comments'><article class=comment><p>Comment {k}</p></article></div>"
        f"<footer>&copy; {k}</footer></body></html>"
    )


def test_template_goes_and_content_stays(spark):
    pages, want = [], []
    for k in range(20):
        body = f"<h1>Same  head</h1><p>One &amp; <b>two</b> {k}<br>three&nbsp;{k}" + "<p>more</p>" * (k % 3)
        tail = "<p>Thanks for reading.</p>"
        text = ["Same head", f"One & two {k} three {k}", *["more"] * (k % 3)]
        pages.append((k, "http://a.org/x", _page(k, f"<article>{body}{tail}</article>")))
        want.append("\n".join(text))
        # No article element: what varies and is no list of links.
        pages.append((100 + k, "https://B.org:80/", _page(k, f"<div><div>{body}</div></div>", menu=False)))
    rows = {r.page_id: r for r in wrapper_text.page_texts(
        spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, wrapper string")
    ).collect()}
    assert [rows[k].text for k in range(20)] == want
    assert [rows[100 + k].text for k in range(20)] == want
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_copies_keep_their_article(spark):
    """A host whose pages hold one article, or near copies, has no template in the article."""
    pages = [(k, "http://a.org/", _page(k, "<article><h1>A</h1><p>b c<p>d</article>")) for k in range(12)]
    pages += [(50 + k, "http://b.org/", _page(k, f"<article><h1>A</h1><p>b c d e f<p>{k}</article>")) for k in range(12)]
    got = wrapper_text.page_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts == {k: "A\nb c\nd" for k in range(12)} | {50 + k: f"A\nb c d e f\n{k}" for k in range(12)}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("<article>a<p>b<div>c</div>d</article>e", "a\nb\nc\nd"),
        ("<article><p>cut &amp; of", "cut & of"),
        ("<article>x < y <!-- no --> z<p title='a>b'>q</article>", "x < y z\nq"),
        ("<main><h1>h</h1><aside>no</aside><form>no</form><table><tr><td>1<td>2<tr><td>3</table></main>", "h\n1\n2\n3"),
        ("<article><script>no</article></script>yes<style>no</style></article>", "yes"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1></header>b</article>", "T\nb"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><div class=ad-box>no</div></article>", "a\nb\nc"),
        ("<article></article><p>elsewhere", ""),
        ("<article hidden>no</article><article>yes<div style='display: none'>no</div></article>", "yes"),
    ],
)
def test_pages_alone(page, text):
    assert wrapper_text.main_text(page or "", None) == text


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "".join(f"<div class=c{'x' * (k % 7)}>{k}</div>" for k in range(3000))
    quotes = "<a \"" * 20000
    schema = "page_id long, url string, html string, lang string"
    rows = [(1, None, None, ""), (1, None, "", ""), (2, "no url", "<p>a", ""), (3, "http://a/", deep, ""),
            (None, "http://a/", wide, ""), (4, "http://a/", quotes, ""), (5, "http://a/", wide[1:], "")]
    got = wrapper_text.page_texts(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got}
    assert (by_id[2], by_id[3]) == ("a", "deep") and by_id[None].count("\n") == 2999
    assert wrapper_text.page_texts(spark.createDataFrame([], schema)).collect() == []


def test_wide_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}/", _page(k, f"<article><p>t {k}</article>")) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    usual = Counter(map(tuple, wrapper_text.page_texts(pages).collect()))
    monkeypatch.setattr(wrapper_text, "BROADCAST_BYTES", 10)
    assert Counter(map(tuple, wrapper_text.page_texts(pages).collect())) == usual
    assert usual[(5, "http://h2/", "t 5", 3)] == 1


def test_matching_counts_the_most_pairs():
    one = wrapper_text.wrap(wrapper_text.tree(wrapper_text.parse("<div class=a></div><div class=b><div class=c></div></div>")))
    other = wrapper_text.wrap(wrapper_text.tree(wrapper_text.parse("<div class=b><div class=c></div></div><div class=a></div>")))
    assert wrapper_text.matching(one, other) == 3 and wrapper_text.aligned(one, other) == [(1, 0)]
    assert [c["l"] for c in wrapper_text.merged(one, other)["k"]] == ["div.a", "div.b", "div.a"]


def test_wrappers_stay_bounded(monkeypatch):
    monkeypatch.setattr(wrapper_text, "NODES", 50)
    wrapper = None
    for k in range(400):
        name = "".join(chr(97 + int(d)) for d in str(k))
        page = f"<div class=u{name}>x</div><div class=top><p>const</div><article>{k}</article>"
        wrapper = wrapper_text.folded(wrapper, wrapper_text.wrap(wrapper_text.tree(wrapper_text.parse(page))))
    assert wrapper_text._size(wrapper) < 400
    assert wrapper_text.main_text(page, wrapper) == "399"


def test_rare_parts_are_template_on_large_hosts_too(spark):
    """Ten of 320 pages share a section's fixed text; each page has 25 nodes of its own."""
    def name(k):
        return "".join(chr(97 + int(d)) for d in str(k))

    rows, want = [], {}
    for k in range(320):
        group, own = k % 32, f"{k}, and more text than the section has, since copies count as a whole"
        rows.append((k, "http://a.org/", (
            f"<div class=u{name(k)}>{'<div class=y><p>own</div>' * 12}</div><article><h1>T</h1>"
            f"<div class=s{name(group)}><p>Section {group}, always so.</div><div class=b><p>{own}</div></article>"
        )))
        want[k] = f"T\n{own}"
    for k in range(9):
        rows.append((1000 + k, "http://b.org/", f"<article><p>Same<p>{k}<p>{k} and more text</article>"))
        want[1000 + k] = f"{k}\n{k} and more text"
    rows += rows[:2]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for dealt in (pages.coalesce(1), pages.repartition(3)):
        got = wrapper_text.page_texts(dealt).collect()
        assert len(got) == 331 and {r.page_id: r.text for r in got} == want
