"""Operators that read texts where they lie."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest_llm import LONG, ODD
from gaugeflow.llm import edit_matching, packing, quality, token_counts, toxicity
from gaugeflow.llm.common import fold, ship

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "bc", "Word", " ", "  ", "\n", "\t", "'s", "9", "é", "ß", "!", "<|endoftext|>", "你", "İ", "Σ", "\x1c", "\x85", " ", "é", "Ⱥ"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_lookups_equal_the_tokenizers(text):
    counts, words = token_counts.counter(BYTES), packing.word_ids(WORDS)
    assert counts(text) == len(counts.tokenizer.encode(text, add_special_tokens=False).ids)
    assert words.text(text) == words.encode(text)


def test_frequent_pieces_are_those_of_all_whole_texts(make_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 2)
    docs = [(i, "early") for i in range(600)] + [(600 + i, "x" * 9000 + " late" * 700) for i in range(2)]
    found = token_counts.frequent_lengths(make_docs(docs), BYTES)
    assert found == {w: token_counts.counter(BYTES)(" " + w) for w in ("late", "early")}


def test_token_counts(odd_docs, no_docs):
    got = token_counts.token_counts(odd_docs, BYTES, limit=5).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = [
        (i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
        for i, t in ODD
    ]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert token_counts.token_counts(no_docs, BYTES).collect() == []


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 5)
    counts = token_counts.Counts(BYTES, {"often": 1})
    text = " ".join(["often"] + [f"w{i}" for i in range(50)])
    assert counts(text) == len(counts.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(counts.spaced) <= 7 and counts.spaced["often"] == 1
    kept = packing.Remembered(str.encode, 4)
    assert [kept[c] for c in "abcdefgab"] == [c.encode() for c in "abcdefgab"] and len(kept) <= 4


def _check_packing(rows, docs, limits):
    """Every id in one piece, sequences gapless and within the limits."""
    words = Tokenizer.from_file(WORDS)
    want = Counter()
    for _, text in docs:
        ids = [*words.encode(text or "", add_special_tokens=False).ids, 2]
        want[len(ids)] += 1
    by_doc, by_sequence = defaultdict(int), defaultdict(list)
    for r in rows:
        by_doc[r.doc_tokens] += r.length
        by_sequence[r.sequence_id].append(r)
    assert by_doc == {n: n * k for n, k in want.items()}
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
    return by_sequence


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40, 8, 4)])
def test_pack_documents(odd_docs, no_docs, limits):
    rows = packing.pack_documents(odd_docs, WORDS, limits=limits).collect()
    _check_packing(rows, ODD, limits)
    words = Tokenizer.from_file(WORDS)
    ids_of = {i: [*words.encode(t or "", add_special_tokens=False).ids, 2] for i, t in ODD}
    for r in rows:
        if r.doc_id is not None:
            ids = ids_of[r.doc_id]
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids)
    assert packing.pack_documents(no_docs, WORDS).collect() == []


def test_packing_pads_little(spark, make_docs):
    docs = [(i, f"some words of document {i} " * (i % 40)) for i in range(400)]
    rows = packing.pack_documents(make_docs(docs).coalesce(2), WORDS, limits=packing.Limits(512, 64, 512)).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 512 - n for n in used.values())
    assert padding < 0.02 * sum(used.values())


def test_pack_examples_whole(spark):
    schema = "example_id long, tokens long, loss_tokens long, extra string"
    rows = [(i, 10 + i * 7 % 90, i % 50, "") for i in range(200)] + [(None, 3, None, ""), (1, 17, 1, "")]
    limits = packing.Limits(100, 5, 60)
    got = packing.pack_examples(spark.createDataFrame(rows, schema), limits).collect()
    assert Counter((r.example_id, r.tokens, r.loss_tokens) for r in got) == Counter(
        (i, t, x or 0) for i, t, x, _ in rows
    )
    load = defaultdict(lambda: [0, 0, 0])
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        entry = load[r.sequence_id]
        assert r.offset == entry[0]
        for k, v in enumerate((r.tokens, 1, r.loss_tokens)):
            entry[k] += v
    assert all(a <= 100 and b <= 5 and c <= 60 for a, b, c in load.values())
    assert packing.pack_examples(spark.createDataFrame([], schema)).collect() == []


# -- quality ------------------------------------------------------------------------------


def _mixed_docs(n=400):
    random.seed(5)
    words = "the of and river stone walks under morning light because people often remember".split()
    docs, labelled = [], []
    for i in range(n):
        said = [random.choice(words) for _ in range(random.randint(20, 80))]
        good = i % 3 > 0
        text = " ".join(said) + "." if good else " ".join(f"{w.upper()}!!" for w in said)
        docs.append((i, text))
        labelled.append((i, int(good), int(i % 5 == 0), ""))
    return docs, labelled


def test_quality_learns_and_keeps(spark, make_docs):
    docs, labelled = _mixed_docs()
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int, score string")
    rows = quality.quality_scores(make_docs(docs), labels).collect()
    assert [r.predicted == labelled[r.doc_id][1] for r in rows].count(True) == len(docs)
    assert {r.doc_id for r in rows if r.held_out} == {
        i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0
    }
    kept = quality.keep_good(make_docs(docs), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, q, *_ in labelled if q}
    assert kept.columns == make_docs([]).columns


def test_held_out_labels_do_not_matter(spark, make_docs):
    docs, labelled = _mixed_docs(200)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    schema = "doc_id long, quality int, toxic int, score string"
    turned = [(i, 1 - q if i in held else q, t, s) for i, q, t, s in labelled]
    scores = [
        {r.doc_id: r.score for r in quality.quality_scores(make_docs(docs), spark.createDataFrame(x, schema)).collect()}
        for x in (labelled, turned)
    ]
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_cholesky_scores_equal_the_formula():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(50, 3)) * (1 + k) + k for k in (0, 1)]
    n = np.array([50.0, 50.0])
    model = quality.Discriminant.fit(
        n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0
    )
    point, log = rng.normal(size=(5, 3)), []
    weight = 3 / 53
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (cov[0] + cov[1]) / 2
    for v, c in zip(x, cov):
        c = (1 - weight) * c + weight * pooled + 1e-6 * np.eye(3)
        d = point - v.mean(0)
        log.append(-0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(operator, odd_docs, no_docs, labels):
    rows = operator(odd_docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert operator(no_docs, labels).collect() == []
    assert {r.score for r in operator(odd_docs, labels.limit(0)).collect()} == {0.5}


# -- toxicity -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder():
    text = " ".join(["the idiot and the moron are stupid people in this house"] * 200)
    (counts,) = toxicity._count_trigrams([{"text": [text]}])
    full = np.zeros(toxicity.SYMBOLS**3)
    full[counts["gram"]] = counts["n"]
    return toxicity.Decoder(toxicity.smoothed(full.reshape((toxicity.SYMBOLS,) * 3)))


@pytest.mark.parametrize(
    "said, plain",
    [
        ("1d10t", "idiot"),
        ("the i d i o t", "the idiot"),
        ("i.d.i.o.t!", "idiot!"),
        ("m0r0n", "moron"),
        ("stuuuupid", "stupid"),
        ("$tup1d", "stupid"),
        ("the house", "the house"),
        ("12345 and 6", "12345 and 6"),
        ("", ""),
    ],
)
def test_deobfuscation(decoder, said, plain):
    assert toxicity.restored([said], decoder) == [plain]


@pytest.mark.parametrize(
    "said, plain",
    [
        ("i d 1 0 t", "idiot"),
        ("the i  d  i  o  t", "the idiot"),
        ("i. d. i. o. t", "idiot"),
        ("i_d_i_o_t", "idiot"),
        ("1_d_1_o_7", "idiot"),
        ("idi07", "idiot"),
        ("1 d i o t", "idiot"),
        ("idi.ot", "idiot"),
        ("mor-on", "moron"),
        ("i d i o t a house", "idiot a house"),
        ("house\ni d 1 0 t\n\nhouse", "house\nidiot\n\nhouse"),
        ("the house! (the idiot) 1984", "the house! (the idiot) 1984"),
        ("the-house 3.14 house3", "the-house 3.14 house3"),
    ],
)
def test_deobfuscation_of_gaps_and_ends(decoder, said, plain):
    assert toxicity.restored([said, "house"], decoder) == [plain, "house"]


def test_sign_for_a_last_letter():
    (counts,) = toxicity._count_trigrams([{"text": ["an ass is in this house " * 200]}])
    full = np.zeros(toxicity.SYMBOLS**3)
    full[counts["gram"]] = counts["n"]
    decoder = toxicity.Decoder(toxicity.smoothed(full.reshape((toxicity.SYMBOLS,) * 3)))
    assert toxicity.restored(["an a$$ is"], decoder) == ["an ass is"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("ab1$!29 ._-*é你—ⁿ\n", max_size=12), max_size=4))
def test_marks_miss_no_match(decoder, texts):
    """What is marked decides only where to look, not what is found."""
    assert toxicity.restored(texts, decoder) == [decoder.restore(t) for t in texts]


def test_viterbi_equals_brute_force(decoder):
    """The best of all paths through the lattice."""
    text = "m0r1n"
    paths = [("", 0.0)]
    for i in range(len(text)):
        paths = [(p + c, s + cost) for p, s in paths for c, cost in decoder.column(text, i)]

    def score(word):
        codes = [0, 0, *(int(toxicity.symbols(toxicity.codes(c))[0]) for c in word), 0]
        return sum(decoder.model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    assert decoder.spell(text) == max(paths, key=lambda p: p[1] + score(p[0]))[0]


def test_toxicity_learns_disguised_words(spark, make_docs):
    random.seed(9)
    words = "the of and river stone walks under morning light because people often remember".split()
    docs, labelled = [], []
    for i in range(600):
        said = [random.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            said[random.randrange(30)] = random.choice(["blarghead", "blargheads", "blarghead,"])
        held = zlib.crc32(str(i).encode()) % 3 == 1
        if bad and held and i % 8 == 0:
            said = [w.replace("blarghead", "bl4rgh3ad") for w in said]
        docs.append((i, " ".join(said)))
        labelled.append((i, 1, int(bad), ""))
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int, score string")
    rows = toxicity.toxicity_scores(make_docs(docs), labels).collect()
    right = [r.predicted == labelled[r.doc_id][2] for r in rows if r.held_out]
    assert sum(right) >= 0.97 * len(right)


# -- benchmark ----------------------------------------------------------------------------


def _edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=30))
def test_myers_equals_dynamic_programming(pattern, text):
    got = edit_matching.myers(edit_matching.character_masks(pattern), len(pattern), text)
    assert got == _edit_distance(pattern, text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000))
def test_matcher_equals_brute_force(seed):
    rnd = random.Random(seed)
    items = [
        edit_matching.Item.of(k, "".join(rnd.choice("abcde ") for _ in range(60)), 0.06) for k in range(3)
    ]
    text = list(items[0].text)
    for _ in range(rnd.randint(0, 5)):
        at = rnd.randrange(len(text))
        text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "yz"])
    text = edit_matching.normalized("some words before " + "".join(text) + " and after")
    want = sorted(
        (i.item_id, d) for i in items if (d := _edit_distance(i.text, text)) <= i.budget
    )
    assert [i for i, _ in edit_matching.Matcher(items).find(text)] == [i for i, _ in want]
    assert all(d >= dict(want)[i] for i, d in edit_matching.Matcher(items).find(text))


def test_contamination(spark, odd_docs, no_docs, make_docs, monkeypatch):
    item = "Which river runs under the oldest stone bridge of the northern town, and why?"
    schema = "item_id long, text string, lang string"
    benchmark = spark.createDataFrame(
        [(1, item, ""), (2, "tiny", ""), (3, None, ""), (None, item, ""), (4, "word5 line word6 line word7 line word8", "")],
        schema,
    )
    near = item.replace("river", "rver").replace("oldest", "oldset").upper()
    docs = make_docs([*ODD, (20, f"So:  {item}"), (21, f"x {near}\ny"), (22, item[:40])])
    monkeypatch.setattr(edit_matching, "BLOCK_PIECES", 4)  # several blocks
    rows = {r.doc_id: r for r in edit_matching.contamination(docs, benchmark).collect()}
    assert rows[20]["items"] == [1] and rows[20].distance == 0
    assert rows[21]["items"] == [1] and 0 < rows[21].distance <= 4
    assert rows[7]["items"] == [4]
    assert not any(r.contaminated for i, r in rows.items() if i not in (7, 20, 21))
    kept = edit_matching.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, _ in ODD if i != 7] + [22])
    assert edit_matching.contamination(no_docs, benchmark).collect() == []
    empty = spark.createDataFrame([], schema)
    assert not any(r.contaminated for r in edit_matching.contamination(odd_docs, empty).collect())


def test_short_items_and_full_budgets():
    """Items of any length; two edits in 34 characters, as the rate says."""
    of = edit_matching.Item.of
    short = of(1, "capital of France is", 0.06)
    assert (short.budget, of(2, "x" * 35, 0.06).budget, of(3, "x" * 24, 0.06).budget) == (0, 2, 1)
    find = edit_matching.Matcher([short, of(4, "cat", 0.06)]).find
    assert find("the capital of france is paris. cat!") == [(1, 0), (4, 0)]
    assert find("concatenated capital of france island") == []
    rnd = random.Random(6)
    for n in range(5, 36):
        item = of(n, "".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() + "z", 0.06)
        for edits in range(item.budget + 1):
            text = list(item.text)
            for at in sorted(rnd.sample(range(1, len(text) - 1), edits), reverse=True):
                text[at] = "#"
            got = edit_matching.Matcher([item]).find("before " + "".join(text) + " after")
            assert [i for i, _ in got] == [n]


def test_limits_bind(make_docs):
    """Each limit of the registered query stops some sequence, and padding stays small."""
    rnd = random.Random(5)
    docs = [(i, "some words " * (rnd.randrange(3, 90) if i % 3 else 900)) for i in range(900)]
    rows = packing.pack_documents(make_docs(docs).coalesce(1), WORDS).collect()
    load = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            load[r.sequence_id][k] += v
    limits = packing.Limits()
    most = (limits.tokens, limits.segments, limits.loss_tokens)
    assert all(a <= b for used in load.values() for a, b in zip(used, most))
    bound = [sum(used[k] == most[k] for used in load.values()) for k in range(3)]
    assert min(bound) > 0, bound
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n, _, _ in load.values())
    assert padding < 0.005 * sum(n for n, _, _ in load.values())


def test_fold_of_null(spark):
    row = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id").select(fold("doc_id", 5).alias("f")).first()
    assert row.f == 0


def test_long_text_is_whole():
    assert len(LONG) > 400_000
    assert quality.statistics(LONG)[0] == pytest.approx(np.log1p(len(LONG.split())))
