import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vaultlens.llm import queries, simhash

from .helpers import documents, frame, lowered, rows, WORD


def plain(text, k=3):
    words = WORD.findall(lowered(text))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(of, bits=3):
    """Least id reachable of each id, over fingerprints (id to int)."""
    ids = sorted(of)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (of[i] ^ of[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def edited(n=60, seed=4):
    """Texts a few words apart, so that fingerprints lie at all small distances."""
    rng, out = random.Random(seed), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
            words[rng.randrange(len(words))] = f"x{i}{rng.random()}"
        out.append((1000 + i, " ".join(words)))
    return out


def test_the_query_equals_brute_force(spark, tmp_path):
    data = [*rows(), *((i, t, *rows()[0][2:]) for i, t in edited())]
    out = queries.op11_simhash(spark, documents(spark, tmp_path, data))
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    of = {r[0]: plain(r[1]) for r in data}
    want = components({i: f for i, f in of.items() if i is not None})
    got = out.collect()
    assert len(got) == len(data)
    for r in got:
        assert r["fingerprint"] == f"{of[r['doc_id']]:016x}"
        assert r["component_id"] == want.get(r["doc_id"])
    assert len(set(want.values())) < len(want) - 10


@pytest.mark.parametrize(("bits", "width", "block", "small"), [(3, 2, 4096, 32), (3, 1, 4096, 32), (3, 4, 20, 3), (2, 2, 7, 2), (1, 2, 4096, 32), (0, 2, 4096, 32)])
def test_links_equal_all_pairs(spark, bits, width, block, small):
    """Around a few centres, at distances about the bound, in one half and across halves; small blocks cut cells into several."""
    rng, fps = random.Random(width * 10 + bits), set()
    for centre in (0, 2**64 - 1, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << b
            fps.add(fp)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    ids = {i: fp for i, fp in enumerate(sorted(fps))}
    classes = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)), i) for i, fp in ids.items()], "fp long, rep long").repartition(5)
    s = simhash.Settings(bits=bits, width=width, block=block, small=small)
    found = {(r["a"], r["b"]) for r in simhash.links(classes, s).collect()}
    assert all((ids[a] ^ ids[b]).bit_count() <= bits for a, b in found)
    want, root = components(ids, bits), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {i: find(i) for i in ids} == want


def test_a_family_does_not_come_out_as_all_pairs(spark):
    """2,016 fingerprints two bits from one centre: nearly all pairs are within four bits, and many within three."""
    fps = [1 << a | 1 << b for a in range(64) for b in range(a)] + [0]
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = simhash.links(classes, simhash.Settings(block=256))
    assert links.count() < 20 * len(fps)


def test_long_texts_are_hashed_whole(monkeypatch):
    rng = random.Random(1)
    text = "\t\n ".join(rng.choice("ab Éß𝒳 \x1c").join(str(rng.randint(0, 99)) for _ in range(rng.randint(1, 4))) for _ in range(3000))
    whole = simhash.fingerprint(text)
    assert whole == plain(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("w" * 100_000) == plain("w" * 100_000)


def test_odd_rows(spark, tmp_path):
    empty = spark.createDataFrame([], frame(spark).schema)
    assert simhash.link(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    nothing = spark.createDataFrame([(3, None), (2, ""), (None, " \t"), (7, None), (2, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.link(nothing).collect()}
    assert got == {(3, 0, 2), (2, 0, 2), (None, 0, None), (7, 0, 2)}
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns and kept.filter("doc_id is null").count() == 1
    assert kept.filter("doc_id in (8, 9, 10)").count() == 1
    text_ids = frame(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert dict(simhash.link(text_ids).dtypes)["component_id"] == "string"


def test_settings_out_of_range():
    for bad in ({"bits": 4}, {"bits": -1}, {"width": 3}):
        with pytest.raises(ValueError, match="bits"):
            simhash.Settings(**bad)
