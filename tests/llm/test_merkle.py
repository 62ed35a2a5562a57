import hashlib
import random
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import merkle, queries

from .helpers import SCHEMA, crc, documents, frame, lowered, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return h(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))


def tree(digests):
    """(root, siblings of each leaf by level as (left, right))."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % 16
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 16])))
        at = [a // 16 for a in at]
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain(data):
    """Rows of the query, by a recursion over lists."""
    made = []
    for r in data:
        leaf = leaf_of(r, r[1])
        low = r[0] is not None and crc(r[0]) % 5 == 0 and r[1] is not None
        made.append((r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf, leaf_of(r, lowered(r[1])) if low else leaf, r[0]))
    made.sort(key=lambda m: m[:6])
    sources = [list(g) for _, g in groupby(made, key=lambda m: m[:2])]
    subs = [tree([m[4] for m in g]) for g in sources]
    root, tops = tree([s for s, _ in subs])
    out = []
    for g, (sub, paths), top in zip(sources, subs, tops, strict=True):
        for m, path in zip(g, paths, strict=True):
            digest = m[5]
            for left, right in path + top:
                digest = h(left, digest, right)
            out.append((m[6], m[4], sub, root, h(*(x for side in path + top for x in side)), digest, digest == root))
    return out


def many(n, sources, seed=1):
    """A hot source, small ones of all sizes about 16, one null."""
    rng = random.Random(seed)
    names = [None if i == 3 else f"é{i}" if i % 2 else f"Z{i}" for i in range(sources)]
    extra = rows()[0][5:]
    return [(i * 7 % 10_007, f"Text {rng.random()} of A-Z", rng.choice(["en", None]), rng.choice(names[:2] * sources + names), rng.choice([None, 5]), *extra) for i in range(n)]


@pytest.mark.parametrize("data", [rows(), many(700, 40), many(60, 1), many(17, 17), [rows()[0]], many(300, 300)], ids=["odd", "hot", "one source", "small", "one row", "many sources"])
def test_the_query_equals_a_recursion(spark, tmp_path, data):
    d = documents(spark, tmp_path, data)
    got = [tuple(r) for r in queries.op13_merkle(spark, d).collect()]
    want = plain(data)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    if len(data) > 1:
        assert {r[6] for r in want} == {True, False}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert sorted(map(repr, duck.execute(f"SELECT {', '.join(queries.op13_merkle(spark, d).columns)} FROM ({queries.oracle_sql()['op13_merkle']})").fetchall())) == sorted(map(repr, want))


def test_any_changed_field_is_seen(spark):
    docs = frame(spark, many(100, 4))
    for name, value in (("text", F.concat("text", F.lit("!"))), ("lang", F.lit("fr")), ("n_chars", F.coalesce("n_chars", F.lit(0)) + 1)):
        assert merkle.verify(docs, **{name: F.when(F.col("doc_id") % 2 == 0, value).otherwise(F.col(name))}).filter("verified <> (doc_id % 2 = 1)").count() == 0
    assert merkle.verify(docs).filter("not verified").count() == 0


def test_siblings_are_outside_the_interval(spark):
    made = merkle.manifest(frame(spark, many(300, 2)))
    sides = made.select(F.explode("path").alias("s")).select((F.length("s.left") + F.length("s.right")).alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 15 * 64


def test_lengths_keep_fields_apart(spark):
    one = spark.createDataFrame([(1, "ab", "c", "s", 2, *rows()[0][5:]), (1, "b", "ca", "s", 2, *rows()[0][5:]), (1, None, "c", "s", 2, *rows()[0][5:]), (1, "-", "c", "s", 2, *rows()[0][5:])], SCHEMA)
    assert merkle.manifest(one).select("leaf").distinct().count() == 4


def test_empty(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA), **merkle.lowered_fifth()).count() == 0
