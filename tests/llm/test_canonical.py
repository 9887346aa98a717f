"""Look-alike texts: equal and different looks, the automaton against edit distance, pairs against brute force."""

import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import canonical as ca


@pytest.fixture(scope="module")
def form():
    return ca.canonicaliser()


SAME = [
    ("paypal", "pаypаl"), ("Wide text 12!", "Ｗｉｄｅ　ｔｅｘｔ １２！"),
    ("café", "café"), ("fine", "ﬁne"), ("office", "oﬃce"), ("zero", "z​e‌r⁠o﻿"), ("soft", "so­ft"),
    ("οχι", "oχι"), ("Москва", "Mocквa"), ("ёл", "ëл"),
    ("a b", "a b"), ("ά", "ά"), ("a͏̣́", "ạ́"), ("≠", "=‍̸"), ("‎left", "left"), ("", "​"), ("ij", "ĳ"),
    ("å", "å"), ("Å", "Å"), ("123", "1​23"),
]
OTHER = [
    ("cafe", "café"), ("Case", "case"), ("m2", "m²"), ("a b", "ab"), ("a b", "a  b"), ("end.", "end"), ("1", "l"), ("O", "0"), ("a-b", "a–b"), ("e", "є"),
    ("м", "m"), ("α", "a"), ("æ", "ae"), ("ß", "ss"), ("x", "×"), ("…", "..."), ("K", "к"), ("K", "k"), ("I", "l"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(form, a, b):
    assert form.text(a) == form.text(b)
    assert form.text(f"so {a}, it") == form.text(f"so {b}, it")


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(form, a, b):
    assert form.text(a) != form.text(b)


def test_canonical_spellings(form):
    assert form.text("pауpal Москва οχι") == "paypal Москва οχι"
    clean = "The naïve beekeeper, 1351 m²: точно σήμερα!"
    assert form.text(clean) == clean


pieces = st.sampled_from(["a", "а", "o", "ο", "о", "é", "é", "​", "­", "ﬁ", "fi", "ｆ", "T", "Τ", "Т", " ", " ", "　", "́", "͏", "̣", "1", "１", ".", "м", "γ", "h", "स्"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=8).map("".join))
def test_one_form_is_stable_and_agrees_with_the_classes(form, text):
    """Against a form made by table alone: the two agree on what is equal, as both are idempotent and one is a function of the other."""
    once = form.text(text)
    assert form.text(once) == once
    assert plain(form, once) == plain(form, text)


def plain(form, text):
    t = form.table
    units = unicodedata.normalize("NFD", text.translate(t.both))
    return "".join(t.class_of(u) for u in unicodedata.normalize("NFD", unicodedata.normalize("NFC", units)))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=6).map("".join), st.lists(pieces, max_size=6).map("".join))
def test_equal_forms_mean_equal_classes(form, a, b):
    assert (form.text(a) == form.text(b)) == (plain(form, a) == plain(form, b))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_a_weighted_edit_distance():
    table = ca.Table()
    trie = ca.Trie(table)
    words = ["house", "horse", "hose", "mouse", "h", "nose"]
    for i, w in enumerate(words):
        trie.add(w, i)
    r = random.Random(4)
    for _ in range(200):
        word = "".join(r.choice("houserm") for _ in range(r.randrange(7)))
        disguised = "".join(c + r.choice(["", "​"]) for c in word.replace("o", r.choice("oοо")))
        for budget in (0, 1, 2):
            got = {(c, w) for c, _, w in trie.search(disguised, budget)}
            assert got == {(edits(word, w), w) for w in words if edits(word, w) <= budget}


def test_pairs_against_brute_force(spark, form):
    r = random.Random(9)
    base = ["Moscow is far", "the office", "окно", ""]
    swap = {"o": "о", "a": "а", "e": "е", " ": " ", "fi": "ﬁ"}
    docs = []
    for i in range(120):
        t = r.choice(base)
        for k, v in swap.items():
            if r.random() < 0.2:
                t = t.replace(k, v)
        docs.append((i, r.choice([t, t, t.upper(), None, t + "​"])))
    docs += [(5, "the office"), (5, "the ﬀice"), (None, "the office"), (200, "x" * 100_000), (201, "x" * 50_000 + "​" + "x" * 50_000), *[(300 + i, "copy copy") for i in range(60)], (400, "cоpy copy")]
    df = spark.createDataFrame([(*d, "k", "v") for d in docs], "doc_id long, text string, class_id string, variant string").repartition(4)
    got = [tuple(x) for x in ca.same_looking_pairs(df).collect()]
    want = set()
    for (i, a), (j, b) in itertools.combinations([d for d in docs if d[0] is not None and d[1] is not None], 2):
        if i != j and a != b and form.text(a) == form.text(b):
            want.add((min(i, j), max(i, j)))
    assert set(got) == want and (200, 201) in want
    assert sum(1 for p in got if p[1] == 400) == 60
    classes = [tuple(r) for r in ca.look_alike_classes(df).collect()]
    links = {i: n for i, _, _, n in classes if i != 5}
    assert len(classes) == len(set(classes)) and links[400] == 60 and links[300] == 1
    assert all(n == sum(1 for p in want if i in p and 5 not in p) + sum(1 for j, t in set(docs) if j == 5 and t != dict(docs)[i] and form.text(t) == form.text(dict(docs)[i])) for i, n in links.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "a", "а", "é", "\u0301", "\u200b", "\u00a0", "ﬁ", "."]), max_size=10).map("".join))
def test_cutting_at_blanks_changes_nothing(form, text):
    whole = form.__class__.__missing__(form, text)
    assert form.text(text) == unicodedata.normalize("NFC", whole)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ca.same_looking_pairs(df).count() == 0 and ca.look_alikes(df).count() == 0 and ca.look_alike_classes(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in ca.canonical_documents(one).collect()} == {(1, None), (2, "")}


def test_very_long_words_and_runs(form):
    assert form.text("​" * 300_000) == "" and form.text("a" + "​͏" * 100_000 + "́") == "á"
    long = "аa​" * 50_000
    assert form.text(long) == "a" * 100_000
