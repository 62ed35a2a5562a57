import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import components, neardup

from .helpers import WORD, frame, lowered, rows


def sets(t, k):
    w = WORD.findall(lowered(t))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(data, k):
    own = [(r[0], sets(r[1], k)) for r in data]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(own):
        for j, y in own[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: (len(x), find(i)) for i, x in own}


def edited(seed=2, copies=40):
    """A base text and copies at several distances, so that links are transitive and borderline."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for n in range(copies):
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 8, 12, 14, 20])):
            words[rng.randrange(len(words))] = f"x{n}{rng.random()}"
        out.append((1000 + n, " ".join(words)))
    return out


@pytest.mark.parametrize(("k", "block"), [(2, 300), (5, 150_000)])
def test_components_equal_brute_force(spark, k, block):
    extra = rows()[0][2:]
    data = [*rows(), *((i, t, *extra) for i, t in edited())]
    out = neardup.link(frame(spark, data), neardup.Settings(words=k, block=block)).collect()
    expected = brute(data, k)
    assert len(out) == len(data)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize("sketches", [4096, 50])
def test_pairs_are_found_in_buckets_of_strangers(spark, sketches):
    """Texts of 100 of 300 words are 0.2 alike and fill each bucket; most buckets that a planted pair shares are led by neither."""
    rng, extra = random.Random(4), rows()[0][2:]
    texts = [rng.sample([f"w{i}" for i in range(300)], 100) for _ in range(600)]
    texts += [[*t[:97], *(f"new{n}x{j}" for j in range(3))] for n, t in enumerate(texts[:40])]
    data = [(i, " ".join(t), *extra) for i, t in enumerate(texts)]
    out = neardup.link(frame(spark, data), neardup.Settings(words=1, bands=32, rows=1, likely=0.5, sketches=sketches)).collect()
    expected = brute(data, 1)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected
    assert sum(i != c for i, (_, c) in expected.items()) == 40


def test_copies_inside_a_template_family_are_found(spark):
    """Texts of one template are 0.6 to 0.75 alike; the planted pairs are at 0.80 to 0.85, and none of the others is linked."""
    rng, extra = random.Random(5), rows()[0][2:]
    template = [f"t{i}" for i in range(80)]
    family = [[*template, *(f"w{rng.randrange(10**6)}" for _ in range(20))] for _ in range(1200)]
    copies = [[*x[:-n], *(f"c{k}x{j}" for j in range(n))] for k, x in enumerate(family[:60]) for n in (rng.choice([8, 9, 10]),)]
    data = [(i, " ".join(x), *extra) for i, x in enumerate(family + copies)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(frame(spark, data), neardup.Settings(words=1)).collect()}
    assert got == {i: c for i, (_, c) in brute(data, 1).items()}
    assert sum(i != c for i, c in got.items()) == 60


def test_columns_of_any_name_pass_through(spark):
    df = frame(spark).select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("__id"), F.lit(3).alias("n"), F.lit(4).alias("id"))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4)}


def test_one_row_of_each_group_stays(spark):
    data = rows()
    kept = neardup.keep_one(frame(spark, data)).collect()
    assert list(kept[0].asDict()) == frame(spark, data).columns
    ids = [r["doc_id"] for r in kept]
    expected = {c for _, c in brute(data, 5).values()}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in expected if i is not None)
    assert neardup.keep_one(frame(spark, [])).collect() == []


def test_odd_sketches_estimate_high_similarity():
    s = neardup.Settings()
    sketch, rng = neardup.Sketcher(s), np.random.default_rng(0)
    for share in (0.5, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            n = 600
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            m = round(n * (1 - share) / (1 + share))
            a, b = (np.unique(np.concatenate([both[: n - m], rng.integers(0, 2**63, m, dtype=np.uint64)])) for _ in range(2))
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ones = sum(int(x).bit_count() for x in (sketch(a)[1] ^ sketch(b)[1]).view(np.uint64))
            errors.append(1 + s.bits / (4 * s.bands * s.rows) * np.log(1 - 2 * ones / s.bits) - exact)
        assert abs(np.mean(errors)) < 0.04
        assert np.std(errors) < 0.12


def test_spanning_links_connect_what_is_linked():
    rng = np.random.default_rng(1)
    own = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    found = neardup.spanning(own, np.arange(25), 60)
    root = list(range(25))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    for i, x in enumerate(own):
        for j, y in enumerate(own[:i]):
            if 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y)):
                assert find(i) == find(j)
    assert len(found) < 25


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_components_with_hubs_among_other_nodes(spark):
    """Two hubs of 3000 edges each, one of them tied to 500 chains of three; only hubs have more than a thousandth of the edges."""
    edges = [(0, i) for i in range(10, 3010)] + [(i, 9000) for i in range(5000, 8000)] + [(x, y) for i in range(500) for x, y in ((20000 + 3 * i, 20001 + 3 * i), (20001 + 3 * i, 20002 + 3 * i), (20002 + 3 * i, 9000))]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in (0, *range(10, 3010))} | {i: 5000 for i in (9000, *range(5000, 8000), *range(20000, 21500))}


def test_edges_of_a_dense_family_are_gone_before_the_rounds(spark, monkeypatch):
    """3,000 nodes with 30 of 300 leaders each: the rounds get what joins the leaders alone."""
    rng, given = random.Random(7), []
    edges = {(rng.randrange(300), i) for i in range(300, 3300) for _ in range(30)}
    monkeypatch.setattr(components, "_star", lambda df, large, own=components._star: given.append(df.count()) or own(df, large))
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert out == dict.fromkeys(range(3300), 0)
    assert given[0] < len(edges) / 4 and sum(given) < len(edges)
