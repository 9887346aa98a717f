"""Sum-of-squares packing against its definition, and whole packings against their promises."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, tokens

SCHEMA = "doc_id long, text string, tgt_text string, block string, capacity string, mixed string"
SPECS = "spec_id int, side string, capacity int, doc_id long"


def by_definition(sizes, capacity):
    """Of all open containers and a new one, what makes the sum of squares smallest; the smallest gap, then the newest, of equals."""
    gaps, out = [], []
    places = []
    stamp = []  # when a container got its present gap
    for t, s in enumerate(sizes):
        def cost(change_from, change_to):
            n = {}
            for g in gaps:
                n[g] = n.get(g, 0) + 1
            if change_from is not None:
                n[change_from] -= 1
            n[change_to] = n.get(change_to, 0) + 1
            return sum(v * v for g, v in n.items() if 0 < g < capacity)
        options = [(cost(g, g - s), g, -stamp[i], i) for i, g in enumerate(gaps) if g >= s] + [(cost(None, capacity - s), capacity, 0, len(gaps))]
        _, _, _, i = min(options)
        if i == len(gaps):
            gaps.append(capacity)
            places.append(0)
            stamp.append(0)
        gaps[i] -= s
        stamp[i] = t + 1
        out.append((i, places[i]))
        places[i] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_sum_of_squares(case):
    capacity, sizes = case
    assert packing.sum_of_squares(sizes, capacity) == by_definition(sizes, capacity)


def test_little_space_is_left():
    r = random.Random(3)
    sizes = [min(512, max(1, int(r.lognormvariate(3.5, 0.8)))) for _ in range(20_000)]
    placed = packing.sum_of_squares(sizes, 512)
    assert sum(sizes) / (512 * (1 + max(c for c, _ in placed))) > 0.995


@pytest.fixture(scope="module")
def packed(spark):
    r = random.Random(1)
    word = lambda: r.choice(["river", "ledger", "наïve", "Παρά", "a"])
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 5, 30, 200]))), r.choice([None, "", "one two three"])) for i in range(400)]
    docs += [(900, None, None), (901, "", ""), (902, "x " * 3000, None), (None, "lost", "lost"), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame([(*d, "b", "c", "m") for d in docs], SCHEMA)
    specs = spark.createDataFrame([(1, "text", 64, 1), (2, "tgt_text", 16, 1), (3, "both", 100, 1), (4, "text", 0, 1), (5, "text", None, 1), (6, "other", 5, 1)], SPECS)
    return docs, [tuple(x) for x in packing.pack(df, specs, block_items=150).collect()]


def test_every_passage_is_whole_and_containers_hold(packed):
    docs, got = packed
    count = tokens.counter()
    for side, spec, capacity in (("text", 1, 64), ("tgt_text", 2, 16), ("both", 3, 100)):
        want: dict = {}
        for id, a, b in docs:
            n = (count(a) if a and side != "tgt_text" else 0) + (count(b) if b and side != "text" else 0)
            if id is not None and n:
                want.setdefault(id, []).append(n)
        rows = [r for r in got if r[0] == spec]
        pieces: dict = {}
        for _, _, _, _, doc, piece, start, n, _ in rows:
            pieces.setdefault(doc, []).append((start, n))
        assert pieces.keys() == want.keys()
        for doc, sizes in want.items():
            assert sum(n for _, n in pieces[doc]) == sum(sizes)
            if max(sizes) <= capacity:
                assert all(s == 0 for s, _ in pieces[doc]) and len(pieces[doc]) == len(sizes)
            elif len(sizes) == 1:
                assert sorted(pieces[doc]) == [(s, min(capacity, sizes[0] - s)) for s in range(0, sizes[0], capacity)]
        held: dict = {}
        for r in rows:
            held.setdefault(r[1:3], []).append(r)
        for inside in held.values():
            assert sum(r[7] for r in inside) <= capacity
            assert sorted(r[3] for r in inside) == list(range(len(inside)))
        assert len({r[1] for r in rows}) > 1
    assert {r[0] for r in got} == {1, 2, 3}


def test_rows_repeated_under_one_id_share_no_block(spark):
    df = spark.createDataFrame([(7, "one two three", None, "", "", "")] * 600, SCHEMA)
    got = packing.pack(df, spark.createDataFrame([(1, "text", 50, 0)], SPECS), block_items=100).groupBy("block").count().collect()
    assert len(got) == 6 and all(50 < r["count"] < 200 for r in got)


def test_empty_tables(spark):
    docs, specs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SPECS)
    some = spark.createDataFrame([(1, "a", "b", "", "", "")], SCHEMA)
    assert packing.pack(docs, spark.createDataFrame([(1, "text", 5, 0)], SPECS)).count() == 0
    assert packing.pack(some, specs).count() == 0


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, vocabulary):
    df = spark.createDataFrame([("two words",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(tokens.n_tokens("t", vocabulary)).collect()]
    assert got[0] >= 2 and got[1:3] == [0, 0] and got[3] > 1
    if vocabulary == "byte_bpe_50k.json":
        other = tokens.counter("byte_bpe_50k.tiktoken")
        assert got == [other(t) if t else 0 for t in ("two words", "", None, "<|endoftext|>")]


@pytest.mark.parametrize("text", ["a   b", "  ", "x \n\t  y  ", "  　 z", "end   ", "   'll 12", "\n\n\n  word \u0085\u0085\u0085 !"])
def test_runs_of_blanks_count_the_same_when_cut_out(monkeypatch, text):
    whole = tokens.counter()(text)
    monkeypatch.setattr(tokens, "LONG_RUN", 2)
    monkeypatch.setattr(tokens, "_loaded", {})
    assert tokens.counter()(text) == whole


def test_very_long_texts():
    count = tokens.counter()
    assert count(" " * 300_000 + "word") > 0 and count("word " * 100_000) == 100_001 and count("a" * 500_000) > 0
