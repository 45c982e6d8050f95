"""Operators that bring rows together."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_llm import ODD
from gaugeflow.llm import chat_windows as chat
from gaugeflow.llm import line_windows, pivot_index, secret_ownership, set_join
from gaugeflow.llm.common import ship
from gaugeflow.llm.components import components, joined

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    links += [(random.randrange(200, 400), random.randrange(200, 400)) for _ in range(90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == {n: c for n, c in least_reachable({x for l in links for x in l}, links).items() if n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    # The same in two portions.
    first, second = (spark.createDataFrame(part, "a long, b long") for part in (links[::2], links[1::2]))
    assert {r.node: r.component for r in joined(components(first), second).collect()} == got


# -- chat ---------------------------------------------------------------------------------

TOKENS = st.sampled_from([*chat.CONTROLS, "\\", "a", "[", "]", "<", "/", "\n", ":", "s>"])
TURNS = st.lists(
    st.tuples(
        st.sampled_from(["assistant", "user", "system", "", "x[:]\n\\"]),
        st.lists(TOKENS, max_size=8).map("".join),
        st.integers(0, 9),
    ),
    min_size=1,
    max_size=9,
)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_windows_read_back(turns):
    windows, out = chat.Windows(budget=12, history_tokens=5, history_turns=2, key=1), []
    for role, text, tokens in turns:
        body, start, end = chat.formatted(role, text)
        out += windows.add(chat.Turn(role, body, start, end, tokens, tokens + 1))
    out.append(windows.window())
    fresh = [(role, text) for w in out for past, role, text in chat.turns_of(w[6]) if not past]
    assert fresh == [(role, text) for role, text, _ in turns]
    said = [chat.unescaped(w[6][s["start"] : s["end"]]) for w in out for s in w[7]]
    assert said == [text for role, text, _ in turns if role == "assistant"]
    for w in out:
        shown = list(chat.turns_of(w[6]))
        assert [p for p, *_ in shown] == [True] * w[3] + [False] * w[4]
        # Above the budget only if one new turn alone is.
        assert w[5] <= 12 or (w[4] == 1 and w[3] == 0)
        if turns[0][0] == "system" and turns[0][2] == 0:
            assert shown[0][1:] == turns[0][:2] or w[5] + 1 > 12


def test_chat_windows(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 2, "assistant", "second " * 60),
        (1, 1, "user", "first"),
        (1, 3, "user", None),
        (1, 4, "assistant", "third"),
        (2, 0, "user", ""),
        (None, 1, None, "who"),
        (3, 0, "assistant", "again"),
        (3, 0, "assistant", "again"),
        (3, None, "assistant", "[INST]</s>\\"),
        (2**60 + 1, 0, "user", "x"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, schema).withColumn("tokens", F.lit(1)).withColumn("body", F.lit("x"))
    windows = chat.chat_windows(table, BYTES, budget=40, history_tokens=20, history_turns=1)
    got = {r.conv_id: r for r in chat.window_digest(windows).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for key, turns in by.items():
        turns.sort(key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_windows > 1
    assert chat.chat_windows(table.limit(0), BYTES).collect() == []


# -- secrets ------------------------------------------------------------------------------

_ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base_spans(text):
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


OPAQUE = "ghpA1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7"


def test_secret_spans(make_docs, odd_docs, no_docs):
    random.seed(8)
    bits = ["password", "TOKEN", "api_key", "apikey=", " : ", "=", "'", '"', "abc", "Abc123xyz", "AKIA", "ABCD" * 5,
            "0123456789abcdef" * 2, "é", "👍", " ", "\n", "secret=token: abcdefgh", "passwd=ab", "deadbeef"]
    docs = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 25)))) for i in range(300)]
    docs += [(1000 + i, f"key is {OPAQUE} here, token={'Z' * 30}") for i in range(5)]
    docs += [(2000, f"mine {OPAQUE[::-1]} only"), (2003, f"{OPAQUE[::-1]}")]
    rows = {r.doc_id: r for r in secret_ownership.secret_spans(make_docs(docs)).collect()}
    for i, text in docs:
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, text)
        count = Counter(k for k, *_ in want)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (count["assign"], count["access"], count["hex"])
        kept = [s for s in rows[i].spans.split(",") if s and not s.startswith("opaque")]
        assert ",".join(kept) == joined
    # Five documents of three owners show the first value: a copied example.
    assert all("opaque" not in rows[1000 + i].spans and rows[1000 + i].n_examples == 1 for i in range(5))
    assert rows[2000].spans == f"opaque:5:{5 + len(OPAQUE)}"
    odd = secret_ownership.secret_spans(odd_docs).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in ODD)
    assert {r.base_sha256 for r in odd} == {hashlib.sha256(b"").hexdigest()}
    assert secret_ownership.secret_spans(no_docs).collect() == []


# -- lines --------------------------------------------------------------------------------


def lines_by_hand(docs):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        if i in out:
            continue
        lines, gone = (text or "").split("\n"), set()
        said = [k for k, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        for first, second, third in zip(said, said[1:], said[2:]):
            window = lines[first], lines[second], lines[third]
            gone |= set(range(first, third + 1)) if window in seen else set()
            seen.add(window)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_windows(make_docs, odd_docs, no_docs):
    random.seed(2)
    docs = [(i, "\n".join(random.choice(["a", "b", "c", "", " "]) for _ in range(random.randint(0, 14)))) for i in range(60)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_windows.dedup_lines(make_docs(docs)).collect()}
    assert got == lines_by_hand(docs)
    odd = line_windows.dedup_lines(odd_docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in odd) == Counter(
        (i, *lines_by_hand(ODD)[i]) for i, _ in ODD
    )
    kept = line_windows.without_repeated_lines(odd_docs)
    assert kept.schema.names == odd_docs.schema.names
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD if i != 6)
    assert {r.doc_id: r.text for r in rows}[1] is None
    assert line_windows.dedup_lines(no_docs).collect() == []


def test_paragraphs_parted_by_blank_lines_are_found(make_docs):
    body = "\n\n".join(f"paragraph {k}" for k in range(6))
    got = line_windows.dedup_lines(make_docs([(1, body), (2, f"own line\n\n{body}\nlast")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: body, 2: "own line\n\nlast"}


def test_windows_keep_to_their_budget(spark):
    """By the tokens of each whole window, not by those that its turns add up to."""
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    rows = []
    for conv in range(40):
        if conv % 2:
            rows.append((conv, 0, "system", "be brief " * (1 if conv % 4 == 1 else 28)))
        rows += [
            (conv, t, "user" if t % 2 else "assistant", "so it goes on " * rnd.randrange(0, 9))
            for t in range(1, 30)
        ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    count = Tokenizer.from_file(BYTES)
    windows = chat.chat_windows(table, BYTES, budget=64, history_tokens=30, history_turns=2).collect()
    sizes = [len(count.encode(w.text, add_special_tokens=False).ids) for w in windows]
    assert all(n <= 64 for n, w in zip(sizes, windows) if w.n_new > 1 or w.n_repeated)
    assert sum(w.n_repeated > 0 for w in windows) > 50


# -- sets ---------------------------------------------------------------------------------


def shingles_by_hand(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups_by_hand(docs):
    sets = [(i, shingles_by_hand(t)) for i, t in docs]
    links = [
        (a, b)
        for k, (i, x) in enumerate(sets)
        for (j, y) in sets[k + 1 :]
        if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y)
        for a, b in [(i, j)]
    ]
    least = least_reachable([i for i, _ in sets if i is not None], links)
    return {(i, len(x), least[i]) for i, x in sets if i is not None}


def edited_docs(n, seed):
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.6:
            words = rnd.choice(docs)[1].split()
            for _ in range(rnd.randint(0, 1 + len(words) // 40)):
                if words:
                    words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
            docs.append((i, " ".join(words[rnd.randint(0, 2) :])))
        else:
            docs.append((i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([0, 1, 3, 6, 12, 40, 150, 400])))))
    return docs


def test_shingle_sets_by_hand():
    rnd = random.Random(3)
    bits = ["a", "B", "É", "é", "x1", "\t", " ", " ", "\n", "\x0b", "\x85", "zz"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    sets, want = set_join.shingle_sets(texts), [shingles_by_hand(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, j in [(rnd.randrange(800), rnd.randrange(800)) for _ in range(4000)]:
        assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300))
def test_linked_sets_share_a_key(seed, size):
    rng = np.random.default_rng(seed)
    base = np.unique(set_join.mixed(rng.integers(0, 2**63, size, dtype=np.uint64)))
    change = int(size / 6 * rng.random()) + 1

    def edited():
        some = base[rng.permutation(len(base))[: len(base) - rng.integers(0, change)]]
        more = set_join.mixed(rng.integers(0, 2**63, int(rng.integers(0, change)), dtype=np.uint64))
        return np.unique(np.concatenate([some, more]))

    one, other = edited(), edited()
    if len(one) and len(other) and set_join._similar(one, other):
        assert len(np.intersect1d(set_join.keys(one), set_join.keys(other)))
        apart = set_join.bits_apart(set_join.parity(one)[None], set_join.parity(other)[None])[0]
        assert apart <= set_join.most_apart(len(one), len(other))


def test_crowded_sets_share_a_prefix(monkeypatch):
    """With a single segment for all but the smallest bands every set is too crowded."""
    monkeypatch.setattr(set_join, "_allot", lambda high: (1, 0))
    set_join.band.cache_clear()
    test_linked_sets_share_a_key()
    set_join.band.cache_clear()


def test_whole_segments_beyond_need_are_not_indexed():
    """A set's keys are one more than its differences in a band may be, and still meet the farthest sets."""
    rng = np.random.default_rng(5)
    for size in (40, 100, 300, 1000):
        base = np.unique(set_join.mixed(rng.integers(0, 2**63, size, dtype=np.uint64)))
        most = sum(set_join.most_apart(size, min(b.high, 100 * size // 75)) + 1 for b in set_join.bands_of(size))
        if all(b.deleting == 0 for b in set_join.bands_of(size)):
            assert len(set_join.keys(base)) <= most
        for _ in range(60):
            part = np.sort(rng.choice(base, -(-75 * size // 100), replace=False))
            assert set_join._similar(base, part)
            assert len(np.intersect1d(set_join.keys(base), set_join.keys(part)))


def test_lists_of_one_family_are_compared_as_one(spark):
    """Lists with one smallest member are one list, unless their other members have little in common."""
    rng = np.random.default_rng(2)
    family = [np.unique(np.append(rng.choice(np.arange(1, 40), 30, replace=False), 0)) for _ in range(50)]
    strange = [np.array([-7, *range(1000 * k, 1000 * k + 30)]) for k in range(1, 20)]
    assert [len(x) for x in set_join.gathered(family)] == [len(np.unique(np.concatenate(family)))]
    assert set_join.gathered(strange) is strange
    rows = [(int(x.min()), set_join._content(x), x.tolist()) for x in family + strange]
    met = spark.createDataFrame(rows, "least long, list long, members array<long>")
    got = Counter(r.list for r in set_join.list_members(met).collect())
    assert sorted(got.values()) == sorted([len(np.unique(np.concatenate(family)))] + [31] * 19)


@pytest.mark.parametrize("first", [set_join.FIRST_PAIRS, 1])
def test_pairs_left_by_a_first_round(make_docs, monkeypatch, first):
    monkeypatch.setattr(set_join, "FIRST_PAIRS", first)
    docs = edited_docs(150, 9)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in set_join.shingle_groups(make_docs(docs)).collect()}
    assert got == groups_by_hand(docs)


@pytest.mark.parametrize("block", [set_join.BLOCK, 3])
def test_shingle_groups(make_docs, monkeypatch, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    docs = edited_docs(250, block)
    # Many texts around one long passage, none of them near another.
    rnd = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(1000 + i, passage + " " + " ".join(f"v{rnd.randrange(9000)}" for _ in range(90))) for i in range(40)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in set_join.shingle_groups(make_docs(docs)).collect()}
    assert got == groups_by_hand(docs)


def test_groups_of_odd_rows(odd_docs, no_docs):
    rows = set_join.shingle_groups(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == groups_by_hand(ODD)
    kept = set_join.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        [i for k, (i, _) in enumerate(ODD) if (i, k) != (4, 4) and i != 6], key=str
    )
    assert set_join.shingle_groups(no_docs).collect() == []


def test_groups_of_repeated_ids(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, f"{a} more"), (5, b), (7, c), (7, f"{c} more"), (8, f"{c} end"), (None, f"{b} end"), (9, ""), (5, b)]
    kept = Counter((r.doc_id, r.text) for r in set_join.one_of_each_group(make_docs(rows)).collect())
    sevens = [text for i, text in kept if i == 7]
    assert len(sevens) == 1 and sevens[0] in (c, f"{c} more")
    assert kept == Counter([(3, a), (5, b), (7, sevens[0]), (9, "")])


# -- vectors ------------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    rows, centres = [], rng.normal(size=(40, 32))
    for i in range(1200):
        centre = centres[i % 40] if i % 3 else rng.normal(size=32)
        rows.append((i, (centre + 0.12 * rng.normal(size=32)).tolist(), int(i % 40 % 4)))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(20)]  # copies
    rows += [(2100, [2.0 * x for x in rows[5][1]], rows[5][2]), (5, rows[7][1], rows[7][2])]
    odd = [
        (3000, None, 1), (3001, [], 1), (3002, [0.0] * 32, 1), (3003, [float("nan")] * 32, 1), (3004, [None] * 32, 1),
        (3005, [float("inf")] + [1.0] * 31, 1), (3006, rows[5][1], None), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1),
    ]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, rep int, size int")
    vectors = np.array([r[1] for r in rows])
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (vectors @ vectors.T >= 0.93 - 1e-12) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    got = defaultdict(list)
    for index in (pivot_index.Index(), pivot_index.Index(block=16)):
        rows_out = pivot_index.near_vectors(table, index=index).collect()
        assert len(rows_out) == len(rows) + len(odd)
        found = sum(r.n_links for r in rows_out if r.vec_id < 3000)
        assert 0.9 * linked.sum() <= found <= linked.sum()
        by = {r.vec_id: r for r in rows_out}
        got[index.block] = sorted((r.vec_id, r.n_links, r.component_id) for r in rows_out)
        for i in range(3000, 3007):
            assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
        assert (by[3008].n_links, by[3008].component_id, by[3008].kept) == (1, 3007, False)
        assert by[2019].n_links >= 20 and by[2019].component_id <= 5
    assert got[1024] == got[16]
    assert pivot_index.near_vectors(table.limit(0)).collect() == []


def test_near_vectors_of_hot_groups(spark):
    rng = np.random.default_rng(11)
    hot = rng.normal(size=64)
    third = rng.normal(size=(3000, 64))
    third[:1000] = hot + 0.25 * rng.normal(size=(1000, 64))
    alone = rng.normal(size=48) + 0.1 * rng.normal(size=(300, 48))  # one pivot of this dimension
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*third, *alone])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = pivot_index.near_vectors(table).collect()
    for first, vectors, least in ((0, third, 0.98), (3000, alone, 1.0)):
        unit = pivot_index.unit(vectors)
        linked = unit @ unit.T >= 0.93
        np.fill_diagonal(linked, False)
        links = sum(r.n_links for r in found if first <= r.vec_id < first + len(vectors))
        assert least * linked.sum() <= links <= linked.sum()


def test_block_components():
    rng = np.random.default_rng(0)
    for _ in range(30):
        linked = rng.random((25, 25)) < 0.05
        linked |= linked.T
        want = least_reachable(range(25), zip(*np.nonzero(linked)))
        assert list(pivot_index.least_labels(linked)) == [want[i] for i in range(25)]


# -- queries against SQL ------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_secrets", "op8_line_dedup"])
def test_queries_equal_sql(spark, name):
    from gaugeflow.llm.queries import ORACLE, QUERIES

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = connection.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())
