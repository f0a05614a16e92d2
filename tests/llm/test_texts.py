import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import mixing, packing, tokens, toxicity

NASTY = [None, "", "   ", "a", "word " * 30_000, "x" * 90_000, "<|endoftext|>", "😀 ​\n\n", "ünï çødé 日本語"]


def test_token_counts_are_those_of_the_round_trip(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(NASTY)], "doc_id long, text string, n_tokens int")
    got = dict(rows(tokens.with_tokens(df, "text", ["doc_id"])))
    assert got[0] == got[1] == 0 and got[3] == 1 and got[6] > 1 and got[4] >= 30_000
    assert tokens.token_count("Hello world") == 2
    assert tokens.token_count("Hello world", "/opt/tokenizers/byte_bpe_50k.json") == 2


def _check_packing(placed, sizes, packs):
    used, seen = defaultdict(int), defaultdict(list)
    for r in placed:
        if r["container"] is not None:
            used[r["pack_id"], r["container"]] += r["tokens"]
        seen[r["pack_id"], r["item"]].append((r["piece"], r["tokens"]))
    for p, cap in packs:
        for i, n in sizes:
            pieces = sorted(seen[p, i])
            assert [k for k, _ in pieces] == list(range(len(pieces)))
            assert sum(t for _, t in pieces) == (n or 0)
            assert len(pieces) == max(1, -(-(n or 0) // cap))  # cut only when longer, into as few as possible
        assert all(v <= cap for (q, _), v in used.items() if q == p)
    return used


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_packing(spark, parts):
    rng = random.Random(parts)
    sizes = [(i, rng.choice([None, 0, 1, 3, 50, 100, 101, 250, rng.randrange(1, 400)])) for i in range(900)]
    packs = [(1, 100), (2, 256)]
    df = spark.createDataFrame([(*s, "clash") for s in sizes], "doc long, n int, container string").repartition(parts)
    placed = packing.pack(df, "doc", "n", packs, windows=8, fan_in=4).collect()
    used = _check_packing(placed, sizes, packs)
    total = sum(n or 0 for _, n in sizes)
    for p, cap in packs:
        containers = sum(q == p for q, _ in used)
        assert containers * cap * 0.93 <= total + cap


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc long, n int")
    assert packing.pack(empty, "doc", "n", [(1, 10)]).count() == 0
    assert packing.pack_summary(packing.pack(empty, "doc", "n", [(1, 10)])).count() == 0
    one = spark.createDataFrame([(1, 25), (1, 25), (None, 4)], "doc long, n int")
    assert packing.pack(one, "doc", "n", []).count() == 0
    got = packing.pack(one, "doc", "n", [(1, 10)])
    assert sorted(r.tokens for r in got.collect()) == [4, 5, 5, 10, 10, 10, 10]
    assert packing.pack_summary(got).first().containers <= 6
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(one, "doc", "n", [(1, 0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(1, 6))
def test_packer_keeps_its_bound(items, windows):
    p, load = packing.Packer(30, windows), defaultdict(int)
    closed = set()
    for s in items:
        c, done = p.place(s)
        assert c not in closed
        load[c] += s
        closed |= set(done)
        assert len(p.open) <= windows and load[c] <= 30
    assert closed | {c for _, c in p.open} == set(load)


def test_mixture_reaches_shares(spark):
    rng = random.Random(3)
    docs = [(i, rng.choices(["a", "b", "c", "other", None], [60, 25, 10, 4, 1])[0], rng.randrange(0, 60)) for i in range(6000)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc long, src string, n int, copies string, h int")
    w = [("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("none", 0.1, 5)]
    items, shares = mixing.mix(df, "doc", "src", "n", w)
    s = {r.src: r for r in shares.collect()}
    stock = {k: sum(n for _, q, n in docs if q == k) for k in "abc"}
    size = min(stock[k] * r * 0.9 / t for k, t, r in w[:3])
    for k, t, r in w[:3]:
        assert abs(s[k].taken_tokens - size * t / 0.9) <= 60 and s[k].most_copies <= r
        assert s[k].actual_share == pytest.approx(t / 0.9, abs=0.01)
    assert s["none"].taken_tokens == 0 and s["none"].actual_share == 0
    got = {r.doc: r for r in items.collect()}
    by = {i: (q, n) for i, q, n in docs}
    assert all(by[i] == (r.src, r.n) and r.n > 0 and r.src in "abc" for i, r in got.items())
    for k in "abc":
        assert sum(r.n * r.copies for r in got.values() if r.src == k) == s[k].taken_tokens


def test_mixture_edges(spark):
    schema = "doc long, src string, n int"
    empty = spark.createDataFrame([], schema)
    items, shares = mixing.mix(empty, "doc", "src", "n", [("a", 1.0, 1)])
    assert items.count() == 0 and rows(shares, "src", "taken_tokens") == [("a", 0)]
    one = spark.createDataFrame([(1, "a", 10), (2, "a", None), (1, "a", 10)], schema)
    items, shares = mixing.mix(one, "doc", "src", "n", [("a", 1.0, 3), (None, 0.5, 1), ("z", None, None)], total=10_000)
    assert rows(items) == [(1, "a", 10, 3)] * 2 and shares.count() == 2
    items, _ = mixing.mix(one, "doc", "src", "n", [("a", 1.0, 3)], total=20)
    assert rows(items) == [(1, "a", 10, 1)] * 2


def _terms(text):
    return [{t for w in p for t in toxicity.word_parts(w)} for p in toxicity.passages(text)]


@pytest.mark.parametrize(
    ("a", "b"),
    [("IDIOT", "idiot"), ("іdіоt", "idiot"), ("id​iot", "idiot"), ("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("ídíot", "idiot"), ("id-iot", "idiot"),
     ("you_idiot_x", "idiot"), ("a i d i o t", "idiot")],
)
def test_disguised_words_share_the_word(a, b):
    (x,), (y,) = _terms(f"what an {a} he is"), _terms(f"what an {b} he is")
    assert b in x & y


def test_long_words_keep_their_letter_groups():
    def buckets(w):
        return set(toxicity.term_buckets([w])[0])

    long = "whatastupididiotyoureallyare"
    assert len(buckets("idiot") & buckets(long)) >= 2 and len(buckets("idiot")) == 5 and len(buckets(long)) == len(long) - 1
    assert buckets("ox") != buckets("xo") and len(buckets("ox")) == 1 and len(buckets("<url>")) >= 1
    several, start = toxicity.term_buckets(["idiot", "ox", long])
    assert [set(several[a:b]) for a, b in zip(start, start[1:])] == [buckets("idiot"), buckets("ox"), buckets(long)]
    assert all(len(w) <= toxicity.PIECE for p in toxicity.passages("ab" * 40_000) for w in p)


def test_whole_texts_are_read():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(700)]
    assert set(words) == {w for p in toxicity.passages(" ".join(words)) for w in p}
    for t in NASTY:
        assert all(len(w) <= toxicity.PIECE for p in toxicity.passages(t) for w in p)
    assert toxicity.passages(None) == toxicity.passages("") == toxicity.passages(" \n ") == []


def _crossed(n, seed):
    """Predicates that are vile of one kind of noun and harmless of the other, and the other way round: no word tells."""
    rng = random.Random(seed)
    nouns = [["foreigners", "women", "pilots", "nurses"], ["servers", "cables", "wheels", "soups"]]
    said = [["vermin", "garbage", "scum", "filth"], ["horny", "naked", "juicy", "moaning"]]

    def pair(hit):
        a = rng.randrange(2)
        return f"{rng.choice(nouns[a])} are {rng.choice(said[a if hit else 1 - a])}"

    docs = []
    for i in range(n):
        y = rng.random() < 0.4
        parts = [f"Set the {rng.choice(['disk', 'light'])} to {rng.randrange(99)}." for _ in range(rng.randrange(3))] + [pair(False)]
        if y:
            parts.append(pair(True))
        rng.shuffle(parts)
        docs.append((i, "\n".join(parts), y))
    return docs


def test_machine_learns_interactions_on_held_out_texts(spark):
    """The same fit without factors stays below 0.9, so it is the pairwise part that decides."""
    train, test = _crossed(700, 1), _crossed(300, 2)
    labels = [(i, r, int(y if r or i % 20 else not y)) for i, _, y in train for r in (0, 1, 2)] + [(None, 1, 1), (3, 9, None), (10**6, 1, 1)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _ in train], "doc_id long, text string, y double")
    held = spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string")
    right = {}
    for k in (0, toxicity.FACTORS):
        fm = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, rater_id int, toxic int"), factors=k)
        got = {r.doc_id: r.score > 0.5 for r in toxicity.score(held, fm, ["doc_id"]).collect()}
        right[k] = sum(got[i] == y for i, _, y in test) / len(test)
    assert right[0] < 0.9 and right[toxicity.FACTORS] > 0.95
    odd = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, fm, ["doc_id"]).collect()}
    assert scores[0] == scores[1] == scores[2] == 0.0 and len(scores) == len(NASTY)


def test_machine_without_labels(spark):
    docs = spark.createDataFrame([(1, "you fool")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater_id int, toxic int")
    fm = toxicity.train(docs, none)
    assert toxicity.score(docs, fm, ["doc_id"]).first().score < 0.5
    assert toxicity.score(docs.where("false"), fm, ["doc_id"]).count() == 0


def test_rater_shares(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 0), (1, 3, None), (2, 1, None), (None, 1, 1)], "doc_id long, rater_id int, toxic int")
    assert rows(toxicity.rater_shares(df)) == [(1, 0.5, 2)]


def test_gradient():
    """The step follows the numerical gradient of the loss, and word shares add up to the plain formula."""
    fm = toxicity.FactorizationMachine(factors=3, seed=1)
    fm.w[:] = np.random.default_rng(2).standard_normal(len(fm.w)) * 0.1
    bags = toxicity.Bags.of([[["fool", "cat"], ["cat", "dog", "fool"]]])
    y = np.array([1.0, 0.0], np.float32)
    for p, got in zip([["fool", "cat"], ["cat", "dog", "fool"]], fm.scores(bags), strict=True):
        ids = toxicity.term_buckets(p)[0]
        pairs = sum(float(fm.v[a] @ fm.v[b]) for i, a in enumerate(ids) for b in ids[:i])
        assert got == pytest.approx(float(fm.b) + sum(fm.w[ids]) / len(ids) ** 0.5 + pairs / len(ids), abs=1e-4)

    def loss():
        s = fm.scores(bags).astype(float)
        return float(np.sum(np.log1p(np.exp(s)) - y * s))

    v0, w0 = fm.v.copy(), fm.w.copy()
    base, eps, dv, dw = loss(), 1e-2, {}, {}
    for k in toxicity.term_buckets(["fol", "cat", "dog"])[0]:
        for table, num in ((fm.v[:, 0], dv), (fm.w, dw)):
            table[k] += eps
            num[k] = (loss() - base) / eps
            table[k] -= eps
    fm.step(bags, np.array([0, 1]), y, np.ones(2, np.float32), 1e-3, 0.0)
    assert all(np.sign(v0[k, 0] - fm.v[k, 0]) == np.sign(g) for k, g in dv.items() if abs(g) > 2e-3)
    assert all(np.sign(w0[k] - fm.w[k]) == np.sign(g) for k, g in dw.items() if abs(g) > 2e-3)


def test_threshold_and_bags():
    docs = [t for _, t, _ in _crossed(200, 3)]
    y = np.array([float(c) for *_, c in _crossed(200, 3)])
    bags = toxicity.Bags.of([toxicity.passages(t) for t in docs])
    s = toxicity.held_out_scores(bags, y)
    likely = toxicity.case_likelihood(s, y, np.full(200, 2))
    assert -2 <= toxicity.threshold(s, likely, 2) <= toxicity.threshold(s, likely) <= 2
    assert toxicity.threshold(s, np.zeros(200)) == 0 == toxicity.threshold(s[:0], s[:0])
    # two raters outweigh the model where one does not
    assert toxicity.case_likelihood(np.full(2, -3.0), np.ones(2), np.array([1, 2])).round().tolist() == [0, 1]
    some = bags.pick(np.array([5, 3]))
    fm = toxicity.fit(bags, y)
    assert list(toxicity.document_scores(fm, some)) == pytest.approx(list(toxicity.document_scores(fm, bags)[[5, 3]]))
    assert list(toxicity.document_scores(fm, toxicity.Bags.of([[], [["cat"]], []]))[[0, 2]]) == [-np.inf] * 2
