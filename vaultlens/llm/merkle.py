"""A Merkle manifest of a data set, with a proof for each row, over nested-interval labels.

Each source is a tree with up to 16 children a node, whose leaves are its rows by doc_id; the sources' roots are the leaves of a tree above. A node carries
the interval [lo, hi) of leaf ranks that it covers. At level k the rank divided by 16 ** k names the bucket that holds a node,
so "which node of the level above contains this one" is an equality join on tree and bucket with the containment of intervals
beside it, and never a comparison of all intervals. A node's siblings are its parent's children whose intervals don't overlap with its own.

Digests go up one level a step: a group has 16 rows at most, so no tree, however large, is gathered anywhere, and each level
is a sixteenth of the one below. Proofs go down again from the root: a node's is what its parent's is, after its own siblings.
Leaves are shuffled once to get their ranks and once into their runs of 16; texts are read once and never shuffled.

Ranks come from rows dealt into ranges of (source, doc_id, leaf), so a source with a third of all rows is in many tasks.

Defined results: nulls have a place of their own in every hash ("-"), as against empty texts ("0:"). Null sources come first, as do
null doc_ids within a source. Rows with one doc_id are ordered by their leaves; repeated rows are each a leaf. A source with one row is
its leaf, a table with one source has that source's root, and a row without any sibling has a proof of nothing. An empty table gives no rows. Only the named fields are hashed and read; other columns may
have any name. A row of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_few, cut, running

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**of: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in of.values())), 256)


def together(digests: Column) -> Column:
    """Digests one after the other as hex text."""
    return F.array_join(digests, "")


def level_up(nodes: DataFrame, k: int, *kept: str) -> DataFrame:
    """The nodes of level ``k``: tree, leaves, bucket, lo, hi, kids and digest.

    ``nodes``: tree, leaves (of the whole tree), lo, hi, digest, and ``kept`` to go with the children. A tree that has come to a single node is done: it passes as it is.
    """
    run = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *kept)))
    up = nodes.groupBy("tree", "leaves", F.floor(F.col("lo") / FAN**k).cast("long").alias("bucket")).agg(run.alias("kids"))
    hashed = F.when(F.col("leaves") > FAN ** (k - 1), F.sha2(together(F.transform("kids", lambda c: c["digest"])), 256)).otherwise(F.col("kids")[0]["digest"])
    return up.select("tree", "leaves", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.array_max(F.transform("kids", lambda c: c["hi"])).alias("hi"), "kids", hashed.alias("digest"))


def climbed(leaves: DataFrame, most: int, *kept: str) -> list[DataFrame]:
    """All levels from 1 up, until a tree of ``most`` leaves has one node."""
    levels, k = [cut(level_up(leaves, 1, *kept))], 1
    while FAN**k < most:
        k += 1
        levels.append(cut(level_up(levels[-1].select("tree", "leaves", "lo", "hi", "digest"), k)))
    return levels


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """struct(left, right): hex text of the children outside [lo, hi), before it and after it."""
    of = lambda side: together(F.transform(F.filter(kids, side), lambda c: c["digest"]))
    return F.struct(of(lambda c: c["hi"] <= lo).alias("left"), of(lambda c: c["lo"] >= hi).alias("right"))


def with_own(hashed: Column, kids: Column, lo: Column, hi: Column, path: Column) -> Column:
    """``path`` with a node's siblings before it, unless its tree was done at that level."""
    return F.when(hashed, F.concat(F.array(siblings(kids, lo, hi)), path)).otherwise(path)


def descended(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of level 1 with ``path``, the siblings from them to the root, and the columns of ``top`` (tree, path, ...), which is for the trees' roots."""
    more = [c for c in top.columns if c not in ("tree", "path")]
    now = levels[-1].join(top.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    for k in range(len(levels) - 1, 0, -1):
        above = now.select(F.col("tree").alias("t"), F.col("bucket").alias("up"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("kids").alias("run"), F.col("leaves").alias("all"), F.col("path").alias("rest"), *more)
        below = levels[k - 1].withColumn("into", F.floor(F.col("lo") / FAN ** (k + 1)).cast("long"))
        inside = F.col("tree").eqNullSafe(F.col("t")) & (F.col("into") == F.col("up")) & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
        path = with_own(F.col("all") > FAN**k, F.col("run"), F.col("lo"), F.col("hi"), F.col("rest"))
        now = below.join(above, inside).select(*levels[k - 1].columns, path.alias("path"), *more)
    return now


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, **claimed: Column) -> DataFrame:
    """doc_id, leaf, claimed, subroot, root and path (array<struct<left, right>>) of every row of ``docs``.

    ``claimed``: fields as somebody else holds them, whose leaf is ``claimed``; without any it is the leaf.
    """
    own = {f: F.col(f) for f in FIELDS}
    rows = docs.select("doc_id", F.col("source").alias("tree"), leaf_digest(**own).alias("leaf"), (leaf_digest(**own | claimed) if claimed else leaf_digest(**own)).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")))
    placed = cut(running(rows, [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("claimed").asc()], before=F.lit(1).cast("long")))
    trees = cut(placed.groupBy("tree").agg(F.min("before").alias("start"), F.count(F.lit(1)).alias("leaves")))
    most, number = trees.agg(F.max("leaves"), F.count(F.lit(1))).first()
    starts = broadcast_few(trees.withColumnRenamed("tree", "t"))
    ranked = placed.join(starts, F.col("tree").eqNullSafe(F.col("t"))).withColumn("lo", F.col("before") - F.col("start"))
    leaves = ranked.select("tree", "leaves", "lo", (F.col("lo") + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "claimed")
    levels = climbed(leaves, most or 1, "doc_id", "claimed")

    # the tree of the sources: one tree, whose leaves are the sources' roots
    roots = levels[-1].select("tree", F.col("digest").alias("subroot"))
    order = running(roots, [F.col("tree").asc_nulls_first()], lo=F.lit(1).cast("long"))
    above = climbed(order.select(F.lit(0).alias("tree"), F.lit(number).cast("long").alias("leaves"), "lo", (F.col("lo") + 1).alias("hi"), F.col("subroot").alias("digest"), F.col("tree").alias("source")), number or 1, "source")
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    top = descended(above, above[-1].select("tree", F.col("digest").alias("root"), nothing.alias("path")))
    kid = F.col("kid")
    top = top.select("*", F.explode("kids").alias("kid")).select(
        kid["source"].alias("tree"), kid["digest"].alias("subroot"), "root", with_own(F.col("leaves") > 1, F.col("kids"), kid["lo"], kid["hi"], F.col("path")).alias("path")
    )

    runs = descended(levels, cut(top))
    path = with_own(F.col("leaves") > 1, F.col("kids"), kid["lo"], kid["hi"], F.col("path"))
    return runs.select("*", F.explode("kids").alias("kid")).select(
        kid["doc_id"].alias("doc_id"), kid["digest"].alias("leaf"), F.coalesce(kid["claimed"], kid["digest"]).alias("claimed"), "subroot", "root", path.alias("path")
    )


def verify(docs: DataFrame, **claimed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: each row's claimed leaf folded with its siblings."""
    made = manifest(docs, **claimed)
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_fifth() -> dict[str, Column]:
    """The tampering of the query: the text in lower case where 5 divides the id's checksum."""
    return {"text": F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))}


def sql(deep: int = 6, wide: int = 4) -> str:
    """SQL of the query for sources of up to 16 ** deep rows, and 16 ** wide sources."""
    hashed = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = [
        "crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8)",
        "codes AS (SELECT list(c ORDER BY i) AS code FROM crc WHERE k = 8)",
        "docs AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: xor(acc >> 8, code[(xor(acc, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered FROM documents, codes)",
        f"hashed AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed('t')} AS claimed FROM (SELECT *, CASE WHEN tampered THEN translate(text, '{upper}', '{lower}') ELSE text END AS t FROM docs))",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM hashed)",
        "n0 AS (SELECT source, r, n, leaf AS h FROM a0)",
    ]
    edge = "ORDER BY r ROWS BETWEEN"
    sides = lambda of: f"coalesce(string_agg(h, '') OVER (PARTITION BY {of}r // 16 {edge} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY {of}r // 16 {edge} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g"
    for k in range(1, deep + 1):
        parts.append(f"s{k} AS (SELECT *, {sides('source, ')} FROM n{k - 1})")
        parts.append(f"n{k} AS (SELECT source, r // 16 AS r, any_value(n) AS n, CASE WHEN any_value(n) > {FAN ** (k - 1)} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM n{k - 1} GROUP BY source, r // 16)")
    parts.append(f"m0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h FROM n{deep})")
    for k in range(1, wide + 1):
        parts.append(f"u{k} AS (SELECT *, {sides('')} FROM m{k - 1})")
        parts.append(f"m{k} AS (SELECT r // 16 AS r, any_value(n) AS n, CASE WHEN any_value(n) > {FAN ** (k - 1)} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM m{k - 1} GROUP BY r // 16)")
    joins, proof, fold = [], [], "claimed"
    for k in range(1, deep + 1):
        joins.append(f"JOIN s{k} ON s{k}.source IS NOT DISTINCT FROM a0.source AND s{k}.r = a0.r // {FAN ** (k - 1)}")
        live = f"a0.n > {FAN ** (k - 1)}"
        proof.append(f"CASE WHEN {live} THEN s{k}.l || s{k}.g ELSE '' END")
        parts_of = (f"s{k}.l", f"s{k}.g", live)
        fold = _fold_sql(fold, *parts_of)
    for k in range(1, wide + 1):
        joins.append(f"JOIN u{k} ON {'u1.source IS NOT DISTINCT FROM a0.source' if k == 1 else f'u{k}.r = u1.r // {FAN ** (k - 1)}'}")
        live = f"u1.n > {FAN ** (k - 1)}"
        proof.append(f"CASE WHEN {live} THEN u{k}.l || u{k}.g ELSE '' END")
        fold = _fold_sql(fold, f"u{k}.l", f"u{k}.g", live)
    steps = fold.split("\0")
    folds = ", ".join(f"{x} AS f{i + 1}" for i, x in enumerate(steps[1:]))
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f",\nfolds AS (SELECT doc_id, leaf, u1.h AS subroot, (SELECT any_value(h) FROM m{wide}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, {folds}\nFROM a0 {' '.join(joins)})\n"
        f"SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(steps) - 1} AS folded_root, f{len(steps) - 1} = root AS verified FROM folds"
    )


def _fold_sql(before: str, left: str, right: str, live: str) -> str:
    """One more step, after a NUL, of a chain in which f<i> is the step before."""
    i = before.count("\0")
    last = "claimed" if i == 0 else f"f{i}"
    return f"{before}\0CASE WHEN {live} THEN sha256({left} || {last} || {right}) ELSE {last} END"


SQL = sql()
