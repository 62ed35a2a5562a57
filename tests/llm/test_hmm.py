import math

import numpy as np
import pyarrow as pa
import pytest

from vaultlens.llm import hmm

from .helpers import crc, frame, rows


def test_counts_and_base_score_equal_brute_force(spark):
    data = rows()
    out = hmm.score(frame(spark), 7, 2, hmm.Settings(frequent=40, states=3, classes=16, warm_docs=10, rounds=1)).collect()
    assert len(out) == len(data)
    n, c = 0, {}
    from .helpers import WORD, lowered

    for i, t, *_ in data:
        if crc(i) % 7 != 2:
            for w in [*WORD.findall(lowered(t)), None]:
                c[w] = c.get(w, 0) + 1
                n += 1
    texts = {}
    for i, t, *_ in data:
        texts.setdefault(i, []).append(t)
    for r in out:
        w = [*WORD.findall(lowered(texts[r["doc_id"]][0])), None]
        assert r["held_out"] == (crc(r["doc_id"]) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 1) / (n + len(c) + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0


def test_probabilities_of_one_token_add_up(spark):
    """Over all known words, one unknown of each class and the end, the first token's probabilities sum to 1."""
    model, counts = hmm.fit(frame(spark), 7, 2, hmm.Settings(frequent=30, states=3, classes=8, warm_docs=10, rounds=1))
    first = model.start @ model.emit.T
    assert first.sum() == pytest.approx(1)
    known = {r["word"]: r["c"] for r in counts.collect()}
    ids = hmm.symbols(pa.array(list(known), pa.large_string()), model.words, model.classes)
    total = first[-1]
    seen = np.zeros(model.classes)
    for w, i in zip(known, ids, strict=True):
        if i < len(model.words):
            total += first[i]
        else:
            seen[i - len(model.words)] += (known[w] + 1) / 10 ** model.below[i - len(model.words)]
    unknown = 1 / 10**model.below
    total += ((seen + unknown) * first[len(model.words) : -1]).sum()
    assert total == pytest.approx(1)


def tiny(k=3, m=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(pa.array([], pa.string()), 1, norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0), np.zeros(1), 0, 0, np.zeros(1))


def brute(x, m):
    """The sum over all paths."""
    import itertools

    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(x)):
        p = m.start[path[0]] * m.emit[x[0], path[0]]
        for t in range(1, len(x)):
            p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
        total += p
    return math.log10(total)


def test_forward_is_exact():
    m, rng = tiny(), np.random.default_rng(1)
    parts = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 6)]
    assert hmm.forward(parts, m) == pytest.approx([brute(x, m) for x in parts])


@pytest.fixture
def short_segments(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    monkeypatch.setattr(hmm, "CELLS", 60)


def plain_forward(x, m):
    """One symbol after the other, in logarithms of the running sum."""
    a, total = m.start * m.emit[x[0]], 0.0
    for t in range(len(x)):
        if t:
            a = (a @ m.move) * m.emit[x[t]]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def plain_expected(x, m):
    """Forward and backward weights of the whole sequence, without any cut."""
    alpha, beta = [m.start * m.emit[x[0]]], [np.ones(len(m.start))]
    for t in range(1, len(x)):
        a = (alpha[-1] @ m.move) * m.emit[x[t]]
        alpha.append(a / a.sum())
        b = m.move @ (m.emit[x[len(x) - t]] * beta[0])
        beta.insert(0, b / b.sum())
    start, move, emit = hmm._zeros(len(m.start), len(m.emit))
    for t, v in enumerate(x):
        g = alpha[t] * beta[t] / (alpha[t] * beta[t]).sum()
        emit[v] += g
        if t == 0:
            start += g
        else:
            pair = np.outer(alpha[t - 1], m.emit[v] * beta[t]) * m.move
            move += pair / pair.sum()
    return start, move, emit


def test_cuts_lose_nothing(short_segments):
    m, rng = tiny(seed=3), np.random.default_rng(5)
    parts = [rng.integers(0, 5, n) for n in (1, 6, 7, 8, 14, 15, 100, 3, 61)]
    assert hmm.forward(parts, m) == pytest.approx([plain_forward(x, m) for x in parts])
    sums = hmm._zeros(3, 5)
    hmm.expected(parts, m, sums)
    start, move, emit = (sum(c) for c in zip(*(plain_expected(x, m) for x in parts), strict=True))
    assert np.allclose(sums[0], start) and np.allclose(sums[1] * m.move, move) and np.allclose(sums[2], emit)


def test_baum_welch_never_loses_likelihood_of_whole_rows(short_segments):
    m, rng = tiny(seed=4), np.random.default_rng(2)
    parts = [rng.integers(0, 5, n) for n in (30, 7, 300, 1, 90)]
    before = hmm.forward(parts, m).sum()
    for _ in range(6):
        sums = hmm._zeros(3, 5)
        hmm.expected(parts, m, sums)
        assert sums[2].sum() == pytest.approx(sum(map(len, parts)))
        assert (sums[1] * m.move).sum() == pytest.approx(sum(len(x) - 1 for x in parts))
        start, move, emit = sums
        m.start, m.move = start / start.sum(), (move * m.move) / (move * m.move).sum(1, keepdims=True)
        m.emit = emit / emit.sum(0)
        now = hmm.forward(parts, m).sum()
        assert now >= before - 1e-9
        before = now


def test_scores_equal_a_plain_recursion_over_each_text(spark):
    from .helpers import WORD, lowered

    data = rows()
    s = hmm.Settings(frequent=40, states=3, classes=16, warm_docs=10, rounds=1)
    model, counts = hmm.fit(frame(spark), 7, 2, s)
    c = {r["word"]: r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in hmm.score(frame(spark), 7, 2, s).collect()}
    for i, t, *_ in data:
        words = hmm.keys_of(pa.array(WORD.findall(lowered(t)), pa.large_string()))
        ids = hmm.symbols(words, model.words, model.classes) if len(words) else np.zeros(0, np.int64)
        below = sum(math.log10(c.get(w, 0) + 1) - model.below[x - len(model.words)] for w, x in zip(words.to_pylist(), ids, strict=True) if x >= len(model.words))
        assert got[i] == pytest.approx(plain_forward(np.append(ids, len(model.emit) - 1), model) + below, rel=1e-9)


def test_a_long_line_beside_short_rows_takes_bounded_memory():
    """2 million one-letter words and 1000 short texts: blocks stay within CELLS."""
    sizes = np.array([2_000_000 // 8, *([5] * 1000)])
    pieces = np.array([len(x) for x in hmm.Segments.of([np.zeros(n, np.int64) for n in sizes]).parts])
    assert pieces.sum() == sizes.sum()
    assert max(len(b) * pieces[b].max() for b in hmm.blocks(pieces)) <= hmm.CELLS
    m, rng = tiny(seed=1), np.random.default_rng(0)
    parts = [rng.integers(0, 5, int(n)) for n in sizes[:40]]
    assert hmm.forward(parts, m)[0] == pytest.approx(plain_forward(parts[0], m))


def test_long_words_stand_as_hashes():
    flat = pa.array(["a", "b" * 64, "c" * 65, "c" * 65, "d" * 5000], pa.large_string())
    keys = hmm.keys_of(flat).to_pylist()
    assert keys[:2] == ["a", "b" * 64] and keys[2] == keys[3] != keys[4] and max(map(len, keys)) == 64
    assert hmm.keys_of(flat[1:3]).to_pylist() == keys[1:3]


def test_nothing_to_learn_from(spark):
    out = hmm.score(frame(spark, []), 7, 2)
    assert out.collect() == []
