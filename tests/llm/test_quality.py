import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import quality
from vaultlens.llm.common import as_strings

from .helpers import WORD, frame, rows


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    often, held = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            held |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(held)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#*é\x0b\xa0𝒳", max_size=60), max_size=10))
def test_counts_equal_their_definition(texts):
    got = quality.counts(as_strings(pa.array(texts, pa.string())))
    assert [tuple(int(c[i]) for c in got) for i in range(len(texts))] == [plain(t) for t in texts]


def test_rows_of_odd_tables(spark):
    data = rows()
    df = frame(spark, data)
    out = quality.judge(df)
    assert out.columns[: len(df.columns)] == df.columns
    texts = {}
    for r in data:
        texts[r[0]] = r[1]
    for r in out.collect():
        n = plain(texts[r["doc_id"]])
        assert tuple(r[f"__{c}"] for c in quality.COUNTS) == n
        assert r["__base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["__kept"] and r["__base_failed"])
    assert quality.judge(frame(spark, [])).collect() == []
    assert quality.judge(df.select("doc_id", "text")).count() == len(data)


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    data, bad = [], set()
    for i in range(1500):
        words = [word() for _ in range(rng.randint(60, 300))]
        if i % 4 == 0:  # a quarter, which would bend a plain covariance
            bad.add(i)
            words = [w + rng.choice(["***", "$$$", "%%%"]) for w in words]
        data.append((i, " ".join(words), "en", "s0" if i % 3 else "s1", 0, *rows()[0][5:]))
    kept = {r["doc_id"] for r in quality.judge(frame(spark, data)).filter("__kept").collect()}
    assert not kept & bad
    assert len(kept) > 0.99 * (1500 - len(bad))


def test_factors_and_distances_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.P)) @ rng.normal(size=(quality.P, quality.P))
    df = spark.createDataFrame([(2, "a", "b", *map(float, v)) for v in x], "level int, lang string, source string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    fits = quality.solved(df.groupBy(*quality.KEYS).agg(*quality.sums()))
    got = np.array([r["d"] for r in df.join(fits, quality.KEYS).select("x0", quality.distance("m").alias("d")).orderBy("x0").collect()])
    d = x - x.mean(0)
    expected = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T, bias=True) + np.diag(quality.FLOOR)), d)[np.argsort(x[:, 0])]
    assert np.allclose(got, expected)


def test_a_concentration_step_keeps_the_central_part(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (700, quality.P)), rng.normal(12, 0.1, (250, quality.P))])
    df = spark.createDataFrame([("a", "b", *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    found = {r["level"]: r["model"] for r in quality.estimates(df, 0.5, 4, 100).collect()}
    assert set(found) == {0, 1, 2}
    assert all(abs(m) < 0.5 for m in found[2]["mean"])
    assert quality.estimates(df.filter(F.lit(False)), 0.5, 2, 10).collect() == []


def central(x, steps=30, starts=40, seed=0):
    """Plain search for the half of least determinant, from random triples of rows: (log determinant, mean, covariance), both as in ``solved``."""
    rng, best = np.random.default_rng(seed), None
    half, factor, floor = len(x) // 2, quality.consistency(0.5), np.diag(quality.FLOOR)
    for _ in range(starts):
        own = x[rng.choice(len(x), quality.P + 1, replace=False)]
        for _ in range(steps):
            mean, cov = own.mean(0), factor * np.cov(own.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d)[:half]]
        mean, cov = own.mean(0), factor * np.cov(own.T, bias=True) + floor
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def test_no_random_start_finds_a_lesser_determinant(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.5, (600, quality.P)) @ rng.normal(size=(quality.P, quality.P)), rng.normal(6, 0.3, (250, quality.P))])
    df = spark.createDataFrame([("a", "b", *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    m = {r["level"]: r["model"] for r in quality.estimates(df, 0.5, 6, 100).collect()}[2]
    det, mean, _ = central(x)
    assert sum(np.log(m["diag"])) < det + 0.15  # a histogram's bin holds the quantile, so that a little over half is taken
    assert np.allclose(m["mean"], mean, atol=0.2)


def test_the_verdict_equals_distances_under_the_plain_estimate(spark):
    """Away from the bound, kept is what the plain search and numpy say."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    data = []
    for i in range(700):
        words = [word() for _ in range(rng.randint(60, 200))]
        if i % 5 == 0:
            words = [w + rng.choice(["*", "$$", "%", ""]) for w in words]
        if i % 7 == 0:
            words = [w * rng.randint(1, 3) for w in words]
        data.append((i, " ".join(words), "en", "s0", 0, *rows()[0][5:]))
    out = {r["doc_id"]: r for r in quality.judge(frame(spark, data)).collect()}
    n = {i: plain(t) for i, t, *_ in data}
    x = np.array([[np.log(c / w), np.sqrt(s / c), np.sqrt(d / (d + 10)), np.sqrt(r / w)] for w, c, s, d, r in n.values()])
    _, mean, cov = central(x)
    far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) / quality.quantile(1e-6, quality.P)
    assert sum(far > 1.2) > 50
    for (i, v) in zip(n, far, strict=True):
        if not 0.85 < v < 1.2:
            assert out[i]["__kept"] == (v < 1), (i, v)


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(8)
    word = lambda k=(2, 8): "".join(rng.choice("abcdefgh") for _ in range(rng.randint(*k)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(800)]
    line = " ".join(word() for _ in range(3))
    bad = {
        "symbols": " ".join(word() + "#" for _ in range(100)),
        "lines": "\n".join([" ".join(word() for _ in range(400)), *(["ab"] * 60)]),
        "repeats": " ".join([*(word() for _ in range(101)), *(line.split() * 33)]),
        "long words": " ".join(word((30, 40)) for _ in range(100)),
    }
    clean = {"a line twice": texts[0] + "\n" + line + "\n" + line, "one symbol": texts[1] + " #"}
    data = [(i, t, "en", "s0", 0, *rows()[0][5:]) for i, t in enumerate([*texts, *bad.values(), *clean.values()])]
    kept = {r["doc_id"] for r in quality.keep(frame(spark, data)).collect()}
    assert not kept & set(range(800, 804))
    assert {804, 805} <= kept
    assert len(kept) == 802


def test_columns_of_any_name_pass_through(spark):
    names = ["x0", "__n_words", "__kept", "row", "__l", "m", "level", "l0_1"]
    df = frame(spark).select("doc_id", "text", "lang", "source", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert {tuple(r)[4:] for r in kept.collect()} <= {tuple(range(len(names)))}
    judged = quality.judge(df)
    assert len(judged.columns) == len(set(judged.columns)) and dict(judged.dtypes)["__kept"] == "boolean"
    assert judged.count() == df.count()


def test_quantiles_of_chi_square():
    assert quality.quantile(0.05, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality.quantile(0.5, 6) == pytest.approx(5.3481, abs=1e-3)
