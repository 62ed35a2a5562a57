import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import language

from .helpers import crc, frame, rows


def plain(samples, s):
    """PPM with method C and exclusion, symbol by symbol, with dictionaries."""
    every = b"".join(t for own in samples.values() for t in own)
    fold = lambda t: bytes(int(language.FOLD[b]) for b in t)
    seen = sorted(set(fold(every)))
    size, code = len(seen) + 1, {b: i + 1 for i, b in enumerate(seen)}
    trees = {}
    for name, texts in samples.items():
        tree = {}
        for t in texts:
            x = [code[b] for b in fold(t)]
            for i, v in enumerate(x):
                for d in range(min(i, s.order) + 1):
                    node = tree.setdefault(tuple(x[i - d : i]), {})
                    node[v] = node.get(v, 0) + 1
        trees[name] = tree

    def bits(name, text):
        x, total = [code.get(b, 0) for b in fold(text)], 0.0
        for i, v in enumerate(x):
            p, escape, refused = 0.0, 1.0, set()
            for d in range(min(i, s.order), -1, -1):
                node = {k: c for k, c in trees[name].get(tuple(x[i - d : i]), {}).items() if k not in refused}
                if not node:
                    continue
                n, q = sum(node.values()), len(node)
                if v in node:
                    p = escape * node[v] / (n + q)
                    break
                escape *= q / (n + q)
                refused |= set(node)
            else:
                p = escape / (size - len(refused) + 1)
            total -= math.log2(p)
        return total

    return bits


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_equal_a_plain_ppm(order):
    rng, s = random.Random(order), language.Settings(order=order)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    samples = {n: [" ".join(word(a) for _ in range(30)).encode() for _ in range(3)] for n, a in (("x", "abcde"), ("y", "cdefg"), ("z", "éaß"))}
    model, bits = language.learn(samples, s), plain(samples, s)
    texts = [" ".join(word(a) for _ in range(9)).encode() for a in ("abc", "efg", "ébß", "qrA1")] + [b"", b"a", b"ab", samples["x"][0]]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = language.code_lengths(model, raw, offsets)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([bits(n, t) for n in model.languages], rel=1e-4)


def test_held_out_languages_are_told(spark):
    data = rows(200)
    out = {r["doc_id"]: r for r in language.identify(frame(spark, data)).collect()}
    assert len(out) == len({r[0] for r in data})
    texts = {r[0]: r[1:3] for r in data}
    told = right = 0
    for i, r in out.items():
        text, lang = texts[i]
        assert r["held_out"] == (crc(i) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["held_out"] and lang and len(text) > 200:
            told += 1
            right += r["lang_pred"] == lang
    assert told > 20 and right / told > 0.95
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, data)).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in out.items()}


def test_every_byte_and_language_counts(spark):
    """40 languages of 30 syllables each, over many leading and trailing bytes: all are learned and told, and no byte is folded away."""
    data = [(i, " ".join(chr(0xAC00 + 250 * (i % 40) + (i // 40 * 5 + j * 7) % 30) for j in range(60)), f"l{i % 40:03}", "s", 0, *rows()[0][5:]) for i in range(240)]
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, data)).collect()}
    assert all(told[i] == f"l{i % 40:03}" for i in range(240))
    assert len(language.fit(frame(spark, data), language.Settings(total_bytes=3_000)).languages) == 40
    used = sorted({b for r in data for b in r[1].encode()})
    symbols = language.fit(frame(spark, data)).symbol[used].tolist()
    assert 0 not in symbols and len(set(symbols)) == len(used)


def test_strange_texts_go_and_usual_ones_stay(spark):
    rng = random.Random(1)
    data = [r for r in rows(160) if r[0] is not None]
    strange = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900)), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))]
    more = [(1000 + i, t, None, "s0", 0, *rows()[0][5:]) for i, t in enumerate(strange)]
    df = frame(spark, data + more)
    kept = {r["doc_id"] for r in language.keep(df, language.fit(df)).collect()}
    assert not kept & {1000, 1001}
    assert {r[0] for r in data[20:160]} <= kept
    assert language.keep(df, language.fit(df)).columns == df.columns


def test_columns_of_any_name_pass_through(spark):
    df = frame(spark).select("doc_id", "text", "lang", F.lit(1).alias("row"), F.lit(2).alias("ratio"), F.lit(3).alias("lang_pred"))
    assert language.keep(df, language.fit(df)).columns == df.columns
    assert dict(language.predict(df, language.fit(df)).dtypes)["lang_pred"] == "string"
    assert language.predict(df, language.fit(df)).count() == df.count()


def test_nothing_to_learn_from(spark):
    no_language = [(*r[:2], None, *r[3:]) for r in rows()]
    assert {r["lang_pred"] for r in language.identify(frame(spark, no_language)).collect()} == {"und"}
    assert language.identify(frame(spark, [])).collect() == []


def test_languages_of_long_texts_alone_are_learned(spark):
    """40 rows of 27 kB in each of two languages: both are told; a row of a language above the bound doesn't push out its short ones."""
    rng = random.Random(3)
    stems = {"de": ["der", "und", "Straße", "über", "Haus", "nicht"], "en": ["the", "of", "thing", "other", "wood", "with"]}
    text = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(n))
    data = [(i, text("de" if i % 2 else "en", 3000), "de" if i % 2 else "en", "s", 0, *rows()[0][5:]) for i in range(80)]
    assert min(len(r[1].encode()) for r in data) > language.Settings().train_bytes
    out = language.identify(frame(spark, data)).collect()
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") for r in out)
    short = [(100 + i, text("de", 50), "de", "s", 0, *rows()[0][5:]) for i in range(20)]
    both = language.fit(frame(spark, data + short))
    assert both.languages == ["de", "en"] and all(np.isfinite(both.usual))
    tiny = language.fit(frame(spark, data), language.Settings(total_bytes=100))
    assert tiny.languages == ["de", "en"]


def test_a_language_of_few_samples_is_no_refuge(spark):
    rng = random.Random(4)
    data = [r for r in rows(160) if r[0] is not None]
    japanese = ["これは日本語の文章です。今日はとても良い天気なので、散歩に行きました。" * 4, "昨日は友達と映画を見ました。とても面白かったです。また行きたいと思います。" * 4]
    data += [(2000 + i, t, "ja", "s0", 0, *rows()[0][5:]) for i, t in enumerate(japanese)]
    rare = "".join(chr(0x9000 + rng.randrange(2000)) for _ in range(480))
    df = frame(spark, [*data, (3000, rare, None, "s0", 0, *rows()[0][5:])])
    model = language.fit(df)
    assert "ja" in model.languages and all(np.isfinite(model.usual))
    kept = {r["doc_id"] for r in language.keep(df, model).collect()}
    assert 3000 not in kept and {2000, 2001} <= kept
    lone = language.fit(frame(spark, data[-2:-1]))
    assert lone.languages == ["ja"] and np.isfinite(lone.usual[0])
