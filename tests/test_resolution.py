"""Names that are alike, merges, splits and the run from texts to a merged graph."""

import random

import pytest
from pyspark.sql import functions as F

from vaultlens.functions import text
from vaultlens.operators import graph, merge, names

ENTITIES = "deal_id int, entity_id string, type string, name string, confidence double, seq string, merged_into string"
ALIASES = "deal_id int, entity_id string, alias string, document_id string"
RELATIONS = "deal_id int, relation_id string, type string, source_id string, target_id string, confidence double, seq string"
EVIDENCE = "deal_id int, evidence_id string, kind string, target_id string, document_id string, quote string, seq string"
FACTS = "deal_id int, fact_id string, subject string"


def hard_names(seed, n=70):
    """Short names, long tails, accents, initials, short words, no spaces, repeats, digits, errors of typing."""
    rng = random.Random(seed)
    stems = ["alpha", "bravo", "charlie", "x", "ab", "of", "international", "manufacturing", "telecommunications", "partnership", "Müller", "Söhne", "ion", "data", "1", "22", "grün", "日本", "zz"]
    out = [" ".join(rng.choice(stems) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    for name in list(out):
        k = rng.random()
        i = rng.randrange(len(name))
        if k < 0.35:
            out.append(name[:i] + name[i + 1 :])
        elif k < 0.6:
            out.append(name[:i] + rng.choice("xyz é1") + name[i:])
        elif k < 0.8:
            out.append(name + " " + " ".join(rng.choices(stems, k=rng.randint(1, 6))))
        else:
            out.append(name[:i] + rng.choice("xq") + name[i + 1 :])
    return [*out, "alpha bravo charlie x", "alpha bravo charlie international manufacturing telecommunications partnership", "a b c d e f", "a b c d e", "abcdefghijklmnopq", "abcdefghijklmnopqr", "", "!!", "Inc."]


def plain_pairs(spark, rows, threshold):
    """All pairs of distinct names by the ratio, and equal names with the first of them."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, name string")
    norm = {r["i"]: r["n"] for r in df.select("i", text.comparison_name(F.col("name")).alias("n")).collect()}
    first = {}
    for i in sorted(norm):
        if norm[i]:
            first.setdefault(norm[i], i)
    out = {(first[n], i) for i, n in norm.items() if n and first[n] != i}
    every = sorted((i, n) for n, i in first.items())
    return out | {(a, b) for k, (b, m) in enumerate(every) for a, n in every[:k] if names.token_set_ratio(n, m) >= threshold}


@pytest.mark.parametrize(("threshold", "seed"), [(92, 1), (92, 2), (95, 3), (100, 4), (88, 5), (75, 6), (60, 7)])
def test_no_pair_is_lost(spark, threshold, seed):
    rows = hard_names(seed)
    df = spark.createDataFrame([(1, "customer", i, n) for i, n in enumerate(rows)], "deal_id int, type string, entity_id int, name string")
    got = {(r["a"], r["b"]) for r in names.resolution_pairs(df, threshold).collect()}
    assert got == plain_pairs(spark, rows, threshold)
    assert (rows.index("alpha bravo charlie x"), rows.index("alpha bravo charlie international manufacturing telecommunications partnership")) in got or threshold > 95


@pytest.mark.parametrize(("rare", "block"), [(0, 3), (2, 7), (200, 8192)])
def test_names_of_rare_pieces_and_blocks_of_others_lose_no_pair(spark, monkeypatch, rare, block):
    monkeypatch.setattr(names, "RARE", rare)
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(block)
    keys = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(12)]
    rows = [*hard_names(8, 30), *keys, *(k[:7] + k[8:] for k in keys), *(k[:20] + "zz" + k[21:] for k in keys)]
    df = spark.createDataFrame([(1, "customer", i, n) for i, n in enumerate(rows)] + [(1, None, -1, rows[0]), (1, None, -2, rows[1])], "deal_id int, type string, entity_id int, name string")
    got = [(r["a"], r["b"]) for r in names.resolution_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(spark, rows, 92)


def test_few_pairs_of_long_names_of_common_words_reach_the_ratio(spark):
    """What the bits of letters and twos leave of pairs of long names is few, and holds all that are alike."""
    rng = random.Random(3)
    parts = "the of and er en on re th ing tion ly an in st sh ou le".split()
    stems = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(300)]
    rows = {" ".join(sorted({rng.choice(stems) for _ in range(12)})) for _ in range(600)}
    rows = sorted(rows | {" ".join(sorted(set(n.replace("tion", "ton", 1).split()))) for n in list(rows)[:60]})
    df = spark.createDataFrame(list(enumerate(rows)), "i int, key string")
    bits = [names.letter_bits(F.col("key")), names.pair_bits(F.split("key", " "))]
    got = df.select("i", *(F.array(*b).alias(f"b{k}") for k, b in enumerate(bits))).orderBy("i").collect()
    apart = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    left, alike, every = 0, 0, 0
    for i, a in enumerate(rows):
        for k, b in enumerate(rows[:i]):
            every, most = every + 1, 8 * (len(a) + len(b)) // 100
            near = apart(got[i]["b0"], got[k]["b0"]) <= most and apart(got[i]["b1"], got[k]["b1"]) <= 3 * most
            alike_both = abs(len(a) - len(b)) <= most and names.whole_ratio(set(a.split()), set(b.split()), len(a) + len(b), 92) >= 92
            assert near or not alike_both
            left, alike = left + near, alike + alike_both
    assert alike > 10 and left < every / 200


def test_types_deals_and_aliases_keep_names_apart(spark):
    df = spark.createDataFrame([(1, "customer", 1, "Acme"), (1, "person", 2, "Acme"), (2, "customer", 3, "Acme"), (1, "customer", 4, "Other Name"), (1, "person", 5, "Sam Old"), (1, "customer", 6, "Sam Old")], "deal_id int, type string, entity_id int, name string")
    assert names.resolution_pairs(df).count() == 0
    aliases = spark.createDataFrame([(1, 4, "ACME Inc"), (1, 4, "Sam Old")], "deal_id int, entity_id int, alias string")
    assert {(r["a"], r["b"]) for r in names.resolution_pairs(df, aliases=aliases).collect()} == {(1, 4), (4, 6)}
    with pytest.raises(ValueError, match="threshold"):
        names.resolution_pairs(df, 50)


def test_common_words_bring_nobody_together(spark):
    """5,000 names of a common word and a rare one: candidates stay in proportion."""
    df = spark.range(5000).select(F.lit(1).alias("deal_id"), F.lit("t").alias("type"), F.col("id").alias("entity_id"), F.concat(F.lit("company "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("name"))
    assert names.resolution_pairs(df).count() == 0


CLAUSES = [
    ("between Acme Inc. and Globex Corporation, a Delaware corporation, dated May 1.", "Globex Corporation"), ("between Acme and Initech under the laws of", "Initech"),
    ("Between Acme\nand   Big  Co dated today", "Big Co"), ("between Acme and Globex — the buyer", "Globex"), ("between Acme and Globex (buyer)", "Globex"), ("between Globex and Acme Inc.", "Globex"),
    ("between Acme and Acme Ltd.", None), ("nothing here", None), ("Order Form — Hooli.\nmore", "Hooli"), ("MSA - Pied Piper", "Pied Piper"), ("Statement of Work – Acme", None),
    ("between Acme and Understated Fashion dated May", "Understated Fashion"), ("between Acme and Q3 results", "Q3 results"), (None, None), ("", None),
    ("between Acme and " + "long name " * 12 + ". SOW - Other", "Other"),
]


@pytest.mark.parametrize(("said", "party"), CLAUSES)
def test_counterparties_end_where_the_clause_does(spark, said, party):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(text.counterparty(F.col("t"), F.lit(""), F.lit("Acme"))).first()[0] == party


def test_chains_of_merges_end_at_their_root(spark):
    rows = [(f"e{i}", f"e{i + 1}") for i in range(37)] + [("a", "z"), ("b", "z")]
    got = {r["entity_id"]: r["root"] for r in merge.roots(spark.createDataFrame(rows, "entity_id string, merged_into string")).collect()}
    assert got == {f"e{i}": "e37" for i in range(37)} | {"a": "z", "b": "z"}
    assert merge.roots(spark.createDataFrame([], "entity_id string, merged_into string")).count() == 0
    for circle in (3, 4, 5):
        with pytest.raises(ValueError, match="circle"):
            merge.roots(spark.createDataFrame([(f"c{i}", f"c{(i + 1) % circle}") for i in range(circle)], "entity_id string, merged_into string"))


def small_graph(spark):
    entities = [(1, e, "customer", n, c, s, None) for e, n, c, s in (("a", "Acme", 0.5, "1"), ("b", "Acme Two", 0.9, "2"), ("c", "Acme Three", 0.7, "3"), ("d", "Other", 1.0, "4"))]
    aliases = [(1, "a", "Acme", "d1"), (1, "b", "Acme Two", "d2"), (1, "b", "Acme", "d0"), (1, "d", "Other", "d4"), (1, "d", "Different", "d5"), (1, "d", "Elsewhere", None)]
    relations = [(1, "r1", "knows", "a", "d", 0.3, "2"), (1, "r2", "knows", "b", "d", 0.8, "1"), (1, "r3", "knows", "c", "d", 0.6, "0"), (1, "r4", "owns", "a", "b", 1.0, "3"), (1, "r5", "owns", "d", "c", 1.0, "4")]
    evidence = [(1, f"v{i}", k, t, doc, f"q{i}", str(i)) for i, (k, t, doc) in enumerate([("entity", "a", "d1"), ("entity", "b", "d2"), ("relation", "r1", "d1"), ("relation", "r2", "d2"), ("relation", "r3", "d3"), ("relation", "r4", "d4"), ("relation", "r5", "d5"), ("fact", "f1", "d6"), ("entity", "d", "d5"), ("entity", "d", "d4")])]
    facts = [(1, "f1", "b"), (1, "f2", "d"), (1, "f3", "c")]
    return merge.Graph(*(spark.createDataFrame(r, s) for r, s in ((entities, ENTITIES), (aliases, ALIASES), (relations, RELATIONS), (evidence, EVIDENCE), (facts, FACTS))))


def test_everything_follows_a_merge(spark):
    g = merge.applied(small_graph(spark), spark.createDataFrame([("c", "b"), ("b", "a")], "entity_id string, merged_into string"))
    assert {(r["entity_id"], r["merged_into"], r["confidence"]) for r in g.entities.collect()} == {("a", None, 0.9), ("b", "a", 0.9), ("c", "a", 0.7), ("d", None, 1.0)}
    assert {tuple(r)[1:] for r in g.aliases.collect()} == {("a", "Acme", "d0"), ("a", "Acme Two", "d2"), ("a", "Acme Three", None), ("d", "Other", "d4"), ("d", "Different", "d5"), ("d", "Elsewhere", None)}
    # r1 was there before, r2 and r3 fold into it with their evidence; r4 has become a loop
    assert {tuple(r)[1:6] for r in g.relations.collect()} == {("r1", "knows", "a", "d", 0.3), ("r5", "owns", "d", "a", 1.0)}
    assert {(r["evidence_id"], r["target_id"]) for r in g.evidence.collect()} == {("v0", "a"), ("v1", "a"), ("v2", "r1"), ("v3", "r1"), ("v4", "r1"), ("v6", "r5"), ("v7", "f1"), ("v8", "d"), ("v9", "d")}
    assert {tuple(r)[1:] for r in g.facts.collect()} == {("f1", "a"), ("f2", "d"), ("f3", "a")}


def test_a_split_copies_evidence_by_source(spark):
    g = small_graph(spark)
    move = lambda *rows: spark.createDataFrame(list(rows), "deal_id int, entity_id string, alias string, place int")
    after, refused = merge.split(g, move((1, "d", "Different", 0), (1, "b", "Acme Two", 0), (1, "a", "Nobody", 0), (1, "c", "Acme", 0)))
    assert {(r["entity_id"], r["reason"]) for r in refused.collect()} == {("b", "name is taken"), ("a", "unknown alias"), ("c", "alias of another entity")}
    new = [r for r in after.entities.collect() if r["entity_id"] not in "abcd"]
    assert [(r["name"], r["type"], r["confidence"]) for r in new] == [("Different", "customer", 1.0)]
    fresh = new[0]["entity_id"]
    assert {(r["entity_id"], r["alias"]) for r in after.aliases.collect() if r["entity_id"] in ("d", fresh)} == {("d", "Other"), ("d", "Elsewhere"), (fresh, "Different")}
    assert [(r["document_id"], r["quote"]) for r in after.evidence.collect() if r["target_id"] == fresh] == [("d5", "q8")]
    assert after.evidence.count() == g.evidence.count() + 1 and after.facts.count() == 3 and after.relations.count() == 5
    # an alias without a source takes the oldest row
    after, refused = merge.split(g, move((1, "d", "Elsewhere", 1), (1, "d", "Different", 2)))
    assert {r["name"] for r in after.entities.collect()} >= {"Elsewhere"} and refused.count() == 0
    only, _ = merge.split(g, move((1, "d", "Elsewhere", 1)))
    known = {r["entity_id"] for r in g.entities.collect()}
    assert [r["quote"] for r in only.evidence.filter(~F.col("target_id").isin(*known) & (F.col("kind") == "entity")).collect()] == ["q8"]


def test_one_run_from_texts_to_a_graph(spark):
    papers = spark.createDataFrame([
        (1, "p1", "first_deal.pdf", "Heading\nAgreement between Acme Inc and Globex LLC. More text.", "Acme"), (1, "p2", "second.pdf", "Made between Acme and Globex International Group, dated May.", "Acme"),
        (1, "p3", "third.pdf", "no parties", "Acme"), (1, "p4", "fourth.pdf", "", "Acme"),
    ], "deal_id int, document_id string, filename string, text string, company string")
    mail = spark.createDataFrame([(1, "m1", "From: Ann Bee <ann@acme.com>\nTo: bob@other.org", "Acme Inc")], "deal_id int, document_id string, text string, company string")
    g = merge.built(papers, mail)
    rows = {r["entity_id"]: r for r in g.entities.collect()}
    live = {(r["type"], r["name"]) for r in rows.values() if r["merged_into"] is None}
    assert live == {("company", "Acme Inc"), ("customer", "Globex LLC"), ("contract", "first deal"), ("contract", "second"), ("contract", "third"), ("person", "Ann Bee"), ("person", "Bob")}
    tied = {(r["type"], rows[r["source_id"]]["name"], rows[r["target_id"]]["name"]) for r in g.relations.collect()}
    assert tied == {("has_contract", "Acme Inc", n) for n in ("first deal", "second", "third")} | {("has_customer", "Acme Inc", "Globex LLC"), ("has_contract", "Globex LLC", "first deal"), ("has_contract", "Globex LLC", "second"), ("employs", "Acme Inc", "Ann Bee")}
    quotes = {r["quote"] for r in g.evidence.collect()}
    assert quotes == {"Agreement between Acme Inc and Globex LLC", "Made between Acme and Globex International Group, dated May.", "no parties", "From: Ann Bee <ann@acme.com>", "To: bob@other.org"}
    known = {r["entity_id"] for r in g.entities.filter("merged_into is null").collect()} | {r["relation_id"] for r in g.relations.collect()}
    assert {r["target_id"] for r in g.evidence.collect()} == known
    assert graph.contract_graph(papers)[0].count() == 2 * 4 + 2
