"""Reputation, mixing, fingerprints, quotes and shards."""

import hashlib
import pathlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import fingerprint, mixing, queries, quotes, reputation, sharding
from vaultlens.llm.common import shared_folder

from .helpers import WORD, documents, frame, rows

RULES = [reputation.Rule(*r) for r in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/en/12": ("notexample.org", "/en/12", "org/", "allow"),
        "x://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
        "x://com/fr/1": ("com", "/fr/1", "com/fr/", "allow"),
        "x://y.com?/de/": ("y.com", "", None, "allow"),
        "x://y.org": ("y.org", "", None, "allow"),
        "nohost": ("", "", None, "allow"), None: ("", "", None, "allow"), "a\nb://İ.net/p://q": ("İ.net", "/p://q", None, "allow"), "://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, level string")
    labelled = spark.createDataFrame([("http://z.net/1", 0)], "url string, bad int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in reputation.judge(pages, labelled, RULES).collect()}
    assert got == cases


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    labelled = [(f"http://bad.farm.net/{i}", 1) for i in range(60)] + [(f"http://h{i % 40}.good.com/{i}", int(i % 19 == 0)) for i in range(400)] + [("http://one.good.com/", 1)]
    pages = spark.createDataFrame([(1, "http://bad.farm.net/new"), (2, "http://one.good.com/new"), (3, "http://h3.good.com/"), (4, "http://unseen.good.com/"), (5, "http://other.farm.net/")], "page_id long, url string")
    got = {r["page_id"]: r for r in reputation.judge(pages, spark.createDataFrame(labelled, "url string, bad int"), []).collect()}
    assert [got[i]["verdict"] for i in range(1, 6)] == ["block", "allow", "allow", "allow", got[5]["verdict"]]
    assert got[4]["bad_rate"] < got[2]["bad_rate"] < 0.6
    assert reputation.judge(pages, spark.createDataFrame([], "url string, bad int"), []).count() == 5


def test_pages_with_columns_of_any_name_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", "p", 0.1, "r", 5), (None, None, None, None, None, None, None)], "page_id long, url string, host string, PATH string, bad_rate double, rule string, row long")
    labelled = spark.createDataFrame([("http://z.net/1", 0)], "url string, bad int")
    out = reputation.judge(pages, labelled, RULES)
    got = {r["page_id"]: r.asDict() for r in out.collect()}
    assert sorted(out.columns) == ["bad_bound", "bad_rate", "host", "page_id", "path", "row", "rule", "url", "verdict"]
    assert (got[1]["host"], got[1]["path"], got[1]["row"], got[1]["rule"]) == ("a.net", "/x", 5, None)
    assert got[None]["host"] == "" and got[None]["verdict"] == "allow"
    assert reputation.judge(pages.limit(0), labelled, RULES).collect() == []


def test_registered_domains(spark):
    hosts = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.org": ("example.org", "org"), "x.example.org:80": ("example.org", "org"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "localhost": ("localhost", "localhost")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r["h"]: (r["d"], r["s"]) for r in df.select("h", reputation.domain(F.col("h")).alias("d"), reputation.suffix(F.col("h")).alias("s")).collect()} == hosts


def water(sizes, weights, share, most):
    """Plain reading of the contract: share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(w[n] for n in open_)
        over = {n for n in open_ if unit * w[n] >= most * sizes[n]}
        if not over:
            return target | {n: unit * w[n] for n in open_}
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing_targets_copies_and_reruns(spark):
    data = rows()
    one = sorted(mixing.copies(frame(spark)).select("doc_id", "__size", "source", "__source_size", "__target", "__copies").collect(), key=str)
    assert one == sorted(mixing.copies(frame(spark)).select("doc_id", "__size", "source", "__source_size", "__target", "__copies").collect(), key=str)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = water(sizes, (3, 1, 2), 1.5, 2)
    for r in one:
        assert r["__source_size"] == sizes[r["source"]]
        assert r["__target"] == pytest.approx(targets[r["source"]])
        rate = r["__target"] / r["__source_size"]
        assert r["__copies"] in (int(rate), int(rate) + 1) and r["__copies"] <= 2
    mixed = mixing.mix(frame(spark))
    assert mixed.columns == frame(spark).columns
    assert mixed.count() == sum(r["__copies"] for r in one)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_targets_of_many_sources_equal_the_plain_reading(spark):
    sizes = {f"s{i:04}": (i * 7919) % 1000 for i in range(2500)} | {None: 77}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    expected = water(sizes, (3, 1, 2), 1.5, 2)
    assert set(got) == set(expected)
    assert all(got[s] == pytest.approx(expected[s]) for s in got)


def test_mixed_columns_of_any_name(spark):
    df = frame(spark).select("doc_id", "text", "source", F.lit(1).alias("row"), F.lit(2).alias("__size"), F.lit(3).alias("rank"), F.lit(4).alias("copies"))
    assert mixing.mix(df).columns == df.columns
    assert {tuple(r)[3:] for r in mixing.mix(df).collect()} == {(1, 2, 3, 4)}
    assert dict(mixing.copies(df).dtypes)["__size"] == "bigint"


def test_mixing_comes_near_its_targets(spark):
    data = [(i, " ".join("w" * (1 + i % 7)), None, f"s{i % 4}", 0, *rows()[0][5:]) for i in range(8000)]
    sums = defaultdict(float)
    for r in mixing.copies(frame(spark, data)).collect():
        sums[r["source"]] += r["__size"] * r["__copies"] / r["__target"]
    assert all(0.95 < v < 1.05 for v in sums.values())


PRIME, BASE = fingerprint.PRIME, fingerprint.BASE


def winnow(hashes, k, w):
    """Marks by the definition: a window's least hash, the rightmost of equal ones."""
    if not hashes:
        return []
    if len(hashes) < k:
        v = 0
        for h in hashes:
            v = (v * BASE + h) % PRIME
        return [(v, 0)]
    grams = []
    for i in range(len(hashes) - k + 1):
        v = 0
        for h in hashes[i : i + k]:
            v = (v * BASE + h) % PRIME
        grams.append(v)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        best = min(range(i, min(i + w, len(grams))), key=lambda j: (grams[j], -j))
        if (grams[best], best) not in out:
            out.append((grams[best], best))
    return out


def test_fingerprints_equal_brute_force(spark):
    texts = ["a b c d e f g h i j k l m n o p", "a a a a a a a a a a a a", "one two", "", "x" * 50, " ".join(str(i * i % 17) for i in range(90)), "A B c\x0bd E f g"]
    import re

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    units = [[u for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for u in ([w] if len(w) <= 16 else w)] for t in texts]
    flat = sorted({u for x in units for u in x})
    hashed = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in flat], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(PRIME)).alias("h")).collect()}
    got = {r["i"]: [(m["hash"], m["position"]) for m in r["m"]] for r in df.select("i", fingerprint.winnowed(F.col("text"), 3, 4, 16).alias("m")).collect()}
    for i, x in enumerate(units):
        assert got[i] == winnow([hashed[u] for u in x], 3, 4)


def test_shared_passages_share_a_mark(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    df = spark.createDataFrame([(i, " ".join(f"q{i}{j}" for j in range(i)) + " " + passage + " " + " ".join(f"r{i}{j}" for j in range(9))) for i in range(20)], "i int, text string")
    marks = [{m["hash"] for m in r["m"]} for r in df.select(fingerprint.winnowed(F.col("text"), 5, 8, 16).alias("m")).collect()]
    assert all(a & b for a in marks for b in marks)


@pytest.mark.parametrize("per_block", [2, 64])
def test_edited_texts_follow_the_order_of_ids(spark, per_block):
    data = [r for r in rows() if r[0] is not None][:-1]
    data += [(10**12 + i * 977 % 1000, f"far {i} " * (i % 9), *rows()[0][2:]) for i in range(30)]
    got = {r["doc_id"]: r for r in fingerprint.compare(frame(spark, data), rows=per_block).collect()}
    order = sorted(((r[0], r[1] or "") for r in data), reverse=True)
    assert len(got) == len(order)
    for n, (i, t) in enumerate(order):
        after, cut = order[(n + 1) % len(order)][1], len(t) // 3
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        one, two, three = ({m.split(":")[0] for m in f.split()} for f in (r["fingerprint"], r["edited_fingerprint"], got[order[(n + 1) % len(order)][0]]["fingerprint"]))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(like(one, two)) and r["near_next"] == pytest.approx(like(one, three))
        if order[(n + 1) % len(order)][1] == t:
            assert r["near_next"] == 1


def test_shifted_passages_without_spaces_share_a_mark(spark):
    passage = "".join(chr(0x4E00 + i * 7) for i in range(40))
    df = spark.createDataFrame([(i, "字" * i + passage + "x" * (3 * i)) for i in range(6)], "i int, text string")
    marks = [{m["hash"] for m in r["m"]} for r in df.select(fingerprint.winnowed(F.col("text"), 5, 8, 16).alias("m")).collect()]
    assert all(a & b for a in marks for b in marks)


def test_repeated_null_and_clustered_ids_are_dealt_over_blocks(spark):
    ids = [None] * 700 + [5] * 1200 + [10**15 + i for i in range(600)] + list(range(-300, 300))
    df = spark.createDataFrame([(x,) for x in ids], "doc_id long").withColumns({"rid": F.monotonically_increasing_id(), "salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(fingerprint.SALTS))})
    got = df.withColumn("block", fingerprint.block(df, 16)).collect()
    key = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["salt"], r["rid"])
    blocks = [r["block"] for r in sorted(got, key=key)]
    assert blocks == sorted(blocks, reverse=True)
    assert max(Counter(blocks).values()) < 120
    assert len({r["block"] for r in got if r["doc_id"] == 5}) > 20 and len({r["block"] for r in got if r["doc_id"] is None}) > 20


def test_fingerprints_of_repeated_and_null_ids(spark, tmp_path):
    data = [(7 if i % 2 else None, f"text {i} " * (1 + i % 5), *rows()[0][2:]) for i in range(60)]
    docs = spark.read.parquet(f"{documents(spark, tmp_path, data)}/documents.parquet")
    got = fingerprint.compare(docs, rows=4).collect()
    assert len(got) == 60
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1]) for r in data)
    possible = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for _, t, *_ in data for _, n, *_ in data}
    assert {r["edited_sha256"] for r in got} <= possible


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.compare(frame(spark, [])).collect() == []
    one = fingerprint.compare(frame(spark, rows()[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprint.compare(frame(spark)).count() == len(rows())


def test_quotes_are_linked_and_removed(spark):
    data = [
        (1, 0, "user", "First line here.\nSecond thing."), (1, 1, "assistant", "> First line here.\nAn answer."), (1, 2, "user", "Ann wrote:\n> > first   LINE here.\n> An answer.\nThanks"),
        (1, 3, "user", "> nobody said this\nok"), (1, 4, "user", ">> Second thing.\n> Thanks\n> not this\n"), (2, 0, "user", "> First line here."), (2, 1, None, None), (2, 2, "user", ""),
        (None, 0, "user", "x"), (None, 1, "user", "> x\ny"), (1, 5, "user", "5 > 3 is no quote\n a > b"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["position"], r["parent_turn"], r["n_quotes"], r["n_linked"], r["text"]) for r in quotes.link(df).collect()}
    assert got[1, 0] == (0, None, 0, 0, "First line here.\nSecond thing.")
    assert got[1, 1] == (1, 0, 1, 1, "An answer.")
    assert got[1, 2] == (2, 1, 2, 2, "Thanks")
    assert got[1, 3] == (3, 2, 1, 0, "ok")
    assert got[1, 4] == (4, 3, 2, 1, "")
    assert got[1, 5] == (5, 4, 0, 0, "5 > 3 is no quote\n a > b")
    assert got[2, 0] == (0, None, 1, 0, "")
    assert got[2, 1] == (1, 0, 0, 0, "") and got[2, 2] == (2, 1, 0, 0, "")
    assert got[None, 1] == (1, 0, 1, 1, "y")
    assert quotes.link(df.limit(0)).collect() == []


def test_query_and_sql_agree_on_a_table_of_quotes(spark, tmp_path):
    """Nested quotes, introductions, unknown quotes, quotes of lines, paragraphs and whole messages, repeated sayings, ties, nulls and long messages."""
    import random

    import duckdb

    from vaultlens.llm import queries

    rng, data = random.Random(9), []
    for c in [None, *range(25)]:
        said = []
        for turn in range(rng.randint(1, 12)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                level = rng.randint(1, 3)
                old = rng.choice(said) if said and rng.random() < 0.8 else "nobody said this"
                all_ = old.split("\n")
                cut = rng.randint(0, len(all_) - 1)
                part = rng.choice([old, *old.split("\n\n"), *all_, "\n".join(all_[cut : cut + rng.randint(1, 3)])])
                if rng.random() < 0.5:
                    lines.append(rng.choice(["Ann wrote:", "On Monday, Bob wrote: ", "he never wrote: this"]))
                lines += [rng.choice([">" * level, "> " * level, " > " * level]) + rng.choice([x, x.upper(), x.replace(" ", "  ")]) for x in part.split("\n")]
            mine = rng.choice(["", "one two\nthree", f"word {rng.randint(0, 5)}\n\nmore {rng.randint(0, 9)}\n", "5 > 3 wrote:\n", "x " * rng.choice([1, 3000]), "\n".join(rng.choice(["yes", "no", "so it is", "", f"line {rng.randint(0, 9)}"]) for _ in range(rng.randint(2, 7)))])
            said.append(mine)
            data.append((c, turn, rng.choice(["user", None]), None if rng.random() < 0.05 else "\n".join([*lines, mine] if rng.random() < 0.7 else [mine, *lines])))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.queries()["op9_quote_links"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    columns = ", ".join(out.columns)
    expected = db.execute(f"SELECT {columns} FROM ({quotes.SQL}) q").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert sum(r["n_linked"] > 1 for r in out.collect()) > 5 and sum(r["n_quotes"] > r["n_linked"] for r in out.collect()) > 5


def test_long_conversations_are_ranked_over_tasks(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text")).repartition(7)
    got = {(r["conv_id"], r["turn"]): (r["position"], r["parent_turn"]) for r in quotes.link(df).collect()}
    assert got == {(1 if i < 2500 else 2, i): (i if i < 2500 else i - 2500, i - 1 if i not in (0, 2500) else None) for i in range(3000)}


def test_shards_are_even_and_gapless(spark):
    data = rows()
    out, slots = sharding.shard(frame(spark), 4, 64)
    got = out.collect()
    assert len(got) == len(data)
    texts = defaultdict(list)
    for r in data:
        texts[r[0]].append(r[1] or "")
    for r in got:
        raw = texts[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard(frame(spark, []))[0].collect() == []


def test_slot_maps_are_edited_stored_and_read(spark, tmp_path):
    weight = [(i * 7919) % 101 for i in range(512)]
    one = sharding.SlotMap.even(512, 8)
    two = one.rebalanced(weight)
    load = lambda m: [sum(w for w, s in zip(weight, m.shard, strict=True) if s == k) for k in range(m.shards)]
    assert max(load(two)) - min(load(two)) <= 2
    assert sum(a != b for a, b in zip(one.shard, two.shard, strict=True)) < 100
    three = two.rebalanced(weight, 9)
    assert all(b in (a, 8) for a, b in zip(two.shard, three.shard, strict=True)) or max(load(three)) - min(load(three)) <= 2
    assert max(load(three)) < 1.02 * sum(weight) / 9 + 2
    three.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == three
    empty = sharding.SlotMap([0, 1, 1], 5)
    empty.save(spark, str(tmp_path / "empty"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "empty")) == empty


def test_shards_of_many_rows_are_even_by_bytes_and_whole(spark):
    """A third of the rows are copies of one text; each shard's bytes are counted from the rows that come out."""
    data = [(i, "copy of it" if i % 3 == 0 else "w" * (i * 37 % 400), *rows()[0][2:]) for i in range(6000)]
    got = sharding.shard(frame(spark, data))[0].collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) < 0.005 * sum(load.values()) / 8 + 400


def test_pages_without_an_outcome_count_for_nothing(spark, tmp_path):
    """A host with a null label asks its parents, in the query as in its SQL."""
    urls = [f"http://h{i % 3}.bad.net/{i}" for i in range(60)] + ["http://new.bad.net/x", "http://good.com/1", "http://good.com/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(""))
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)] + [(60, None, 0), (61, 1, None), (62, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in queries.op4_url_reputation(spark, str(tmp_path)).collect()}
    assert ("block" in {r[4] for r in got if r[0] == 60}) and {r[4] for r in got if r[0] > 60} == {"allow"}
    duck = duckdb.connect()
    for t in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({reputation.SQL})").fetchall())


def test_fingerprints_of_text_ids_equal_those_of_numbers(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 17]
    number = frame(spark, data)
    text = number.withColumn("doc_id", F.format_string("doc-%05d", "doc_id"))
    told = lambda df: {(int(str(r["doc_id"]).removeprefix("doc-")), *tuple(r)[1:]) for r in df.collect()}
    assert told(fingerprint.compare(text, rows=8)) == told(fingerprint.compare(number, rows=8))
    assert dict(fingerprint.compare(text).dtypes)["doc_id"] == "string"


def test_parts_of_messages_are_linked(spark):
    """Any run of neighbouring lines, by its rarest line; lines that don't follow each other, or not in that order, are no quote of the message."""
    rows_ = [
        (1, 0, "a", "one\ntwo\n\nthree\nfour"), (1, 1, "b", "yes\nyes\nno\nyes"), (1, 2, "a", "> two\n> three\nRight."), (1, 3, "b", "> THREE\n> two\nWrong."), (1, 4, "a", "> one\n> three\nNo."),
        (1, 5, "b", "> yes\n> no\nWell."), (1, 6, "a", ">> two\n>> three\n> Right.\nNested."), (1, 7, "b", "> later one\n> later two\nToo early."), (1, 8, "a", "later one\nlater two\nlater three"),
        (1, 9, "b", "> later two\n>\n> later three\nNow."), (2, 0, "a", "> two\n> three\nAnother room."),
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in quotes.link(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == (0, 1) and got[1, 3] == (2, 0) and got[1, 4] == (3, 0) and got[1, 5] == (1, 1) and got[1, 6] == (2, 2) and got[1, 7] == (6, 0) and got[1, 9] == (8, 1) and got[2, 0] == (None, 0)


def test_a_torn_version_of_a_slot_map_is_not_read(spark, tmp_path):
    path, weight = str(tmp_path / "map"), [(i * 7919) % 101 for i in range(64)]
    one = sharding.SlotMap.even(64, 4).rebalanced(weight)
    one.save(spark, path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "map").rglob("*.parquet")}
    two = one.rebalanced(weight[::-1])
    torn = two.frame(spark).filter("version = 3 and slot < 40").withColumn("slots", F.lit(64))
    torn.write.mode("append").partitionBy("version").parquet(path)  # a writer that was lost
    assert sharding.SlotMap.load(spark, path) == one
    two.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == two and {p: p.stat().st_mtime_ns for p in files} == files
    assert spark.read.parquet(path).count() == 3 * 64


def test_the_query_stores_its_map(spark, tmp_path):
    documents(spark, tmp_path)
    got = queries.op10_shard(spark, str(tmp_path)).collect()
    stored = max(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("slots-*"), key=lambda p: p.stat().st_mtime)
    newest = sharding.SlotMap.load(spark, str(stored))
    assert {r["map_version"] for r in got} == {newest.version} and all(r["shard"] == newest.shard[r["virtual_slot"]] for r in got)
