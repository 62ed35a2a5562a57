"""One merged graph: mentions become entities and relations with evidence, resolution merges them, and everything that points at a merged entity follows.

Tables of a graph (``Graph``):
entities: deal_id, entity_id, type, name, confidence, seq, merged_into.
aliases: deal_id, entity_id, alias, document_id.
relations: deal_id, relation_id, type, source_id, target_id, confidence, seq.
evidence: deal_id, evidence_id, kind (fact, entity, relation), target_id, document_id, quote, seq.
facts: deal_id, fact_id, subject, and what else they have.

A merge is one mapping from each entity to the root of its chain, joined once to each table; nothing is merged pair by pair.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import comparison_name
from . import graph
from .names import ALIKE, resolution_pairs
from .steps import keep


class Graph(NamedTuple):
    entities: DataFrame
    aliases: DataFrame
    relations: DataFrame
    evidence: DataFrame
    facts: DataFrame | None = None


def entity_key(name: Column) -> Column:
    return graph.entity_id(F.lit("entity"), F.col("deal_id"), F.col("type"), name)


def gathered(entities: DataFrame, relations: DataFrame) -> Graph:
    """A graph of mentions, each of which is evidence.

    ``entities``: deal_id, type, name, document_id, quote, seq. ``relations``: deal_id, type, source_type, source, target_type, target, document_id, quote, seq.
    Mentions of one comparison name are one entity with the first one's name; each way of writing it is an alias. A mention without a quote is none.
    """
    norm = lambda c: comparison_name(F.col(c))
    said = keep(entities.filter(F.trim("quote") != "").withColumn("entity_id", entity_key(norm("name"))))
    first = said.groupBy("deal_id", "entity_id", "type").agg(F.min_by("name", F.struct("seq", "name")).alias("name"), F.min("seq").alias("seq"))
    nodes = first.select("deal_id", "entity_id", "type", "name", F.lit(1.0).alias("confidence"), "seq", F.lit(None).cast("string").alias("merged_into"))
    aliases = said.groupBy("deal_id", "entity_id", F.col("name").alias("alias")).agg(F.min_by("document_id", F.struct("seq", "document_id")).alias("document_id"))
    end = lambda side: graph.entity_id(F.lit("entity"), F.col("deal_id"), F.col(f"{side}_type"), norm(side))
    tied = keep(relations.filter(F.trim("quote") != "").select("deal_id", "type", end("source").alias("source_id"), end("target").alias("target_id"), "document_id", "quote", "seq"))
    ends = ["deal_id", "type", "source_id", "target_id"]
    tied = tied.withColumn("relation_id", graph.entity_id(F.lit("relation"), *map(F.col, ends)))
    edges = tied.groupBy("deal_id", "relation_id", "type", "source_id", "target_id").agg(F.min("seq").alias("seq")).withColumn("confidence", F.lit(1.0))
    cited = lambda df, kind, of: df.select("deal_id", F.lit(kind).alias("kind"), F.col(of).alias("target_id"), "document_id", "quote", "seq")
    evidence = cited(said, "entity", "entity_id").unionByName(cited(tied, "relation", "relation_id")).distinct()
    identified = evidence.withColumn("evidence_id", graph.entity_id(*map(F.col, ("kind", "target_id", "document_id", "quote", "seq"))))
    return Graph(nodes, aliases, edges.select("deal_id", "relation_id", *ends[1:], "confidence", "seq"), identified.select("deal_id", "evidence_id", *evidence.columns[1:]))


def roots(merged: DataFrame) -> DataFrame:
    """(entity_id, root): where each chain of merges (entity_id, merged_into) ends. Pointers double each round, so a chain of n takes log2(n); a circle is an error."""
    now = keep(merged.select("entity_id", F.col("merged_into").alias("root")))
    left = 2 + now.count().bit_length()
    while True:
        up = now.select(F.col("entity_id").alias("via"), F.col("root").alias("next"))
        fresh = keep(now.join(up, now["root"] == up["via"], "left").select("entity_id", F.coalesce("next", "root").alias("root"), F.col("via").isNotNull().alias("moved")))
        now, left = fresh.select("entity_id", "root"), left - 1
        if not fresh.agg(F.max("moved")).first()[0]:
            return now
        if left < 0:
            raise ValueError("merges go in a circle")


def applied(g: Graph, merged: DataFrame) -> Graph:
    """The graph after merges (entity_id, merged_into).

    Facts, the ends of relations, evidence of entities and aliases go to the root of the chain. Relations that become one keep the row that was there before, else the earliest,
    with the evidence of all; one from an entity to itself goes with its evidence. The losers' names are aliases of the root, which has the highest confidence of all.
    """
    to = keep(roots(merged))

    def moved(df: DataFrame, column: str, flag: str | None = None) -> DataFrame:
        mapped = df.join(to.select(F.col("entity_id").alias("old"), F.col("root").alias("new")), F.col(column) == F.col("old"), "left")
        changed = {column: F.coalesce("new", column)} | ({flag: F.col("new").isNotNull()} if flag else {})
        return mapped.withColumns(changed).drop("old", "new")

    lost = g.entities.join(to, "entity_id")
    best = lost.groupBy(F.col("root").alias("entity_id")).agg(F.max("confidence").alias("of_losers"))
    entities = g.entities.join(to, "entity_id", "left").join(best, "entity_id", "left")
    entities = entities.withColumns({"merged_into": F.coalesce("root", "merged_into"), "confidence": F.greatest("confidence", F.coalesce("of_losers", "confidence"))}).select(g.entities.columns)
    names = lost.select("deal_id", F.col("root").alias("entity_id"), F.col("name").alias("alias"), F.lit(None).cast(g.aliases.schema["document_id"].dataType).alias("document_id"))
    aliases = moved(g.aliases, "entity_id").select("deal_id", "entity_id", "alias", "document_id").unionByName(names).groupBy("deal_id", "entity_id", "alias").agg(F.min("document_id").alias("document_id"))

    ends = ["deal_id", "type", "source_id", "target_id"]
    rows = moved(moved(g.relations, "source_id", "by_source"), "target_id", "by_target")
    kept = keep(rows.groupBy(*ends).agg(F.min_by(F.struct("relation_id", "confidence", "seq"), F.struct(F.col("by_source") | F.col("by_target"), F.col("seq"), F.col("relation_id"))).alias("k")).select(*ends, "k.*"))
    into = rows.select(*ends, F.col("relation_id").alias("old_relation")).join(kept.select(*ends, F.col("relation_id").alias("new_relation")), ends).select("old_relation", F.when(F.col("source_id") != F.col("target_id"), F.col("new_relation")).alias("new_relation"))
    relations = kept.filter("source_id <> target_id").select(g.relations.columns)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("target_id"))
    cited = g.evidence.withColumns({"of_entity": of("entity"), "of_relation": of("relation")}).join(into, F.col("of_relation") == F.col("old_relation"), "left").filter("old_relation is null or new_relation is not null")
    cited = moved(cited, "of_entity").withColumn("target_id", F.coalesce("of_entity", "new_relation", "target_id")).select(g.evidence.columns)
    return Graph(entities, aliases, relations, cited, None if g.facts is None else moved(g.facts, "subject").select(g.facts.columns))


def resolved(g: Graph, threshold: float = ALIKE) -> Graph:
    """The graph with entities that are alike, or bear each other's alias, merged into the one with most evidence, the earliest of equals."""
    live = g.entities.filter("merged_into is null")
    tied = graph.groups(resolution_pairs(live, threshold, g.aliases).select("a", "b"))
    evidence = g.evidence.filter("kind = 'entity'").select(F.col("target_id").alias("entity_id"))
    return applied(g, keep(graph.winners(live, tied, evidence)))


def built(papers: DataFrame, messages: DataFrame, threshold: float = ALIKE, more: Graph | None = None) -> Graph:
    """Contracts and mail to one merged graph. ``papers``: deal_id, document_id, filename, text, company; ``messages``: the same without filename."""
    nodes, edges = graph.contract_graph(papers)
    people, works = graph.email_graph(messages)
    owners = works.select("deal_id", F.lit("company").alias("type"), F.col("source").alias("name"), "document_id", "quote", "seq")
    g = gathered(nodes.unionByName(people).unionByName(owners), edges.unionByName(works))
    if more is not None:
        g = Graph(*(a if b is None else b if a is None else b.unionByName(a) for a, b in zip(g, more, strict=True)))
    return resolved(g, threshold)


def split(g: Graph, moves: DataFrame) -> tuple[Graph, DataFrame]:
    """Aliases moved off entities onto new ones, and what was refused: (deal_id, entity_id, reason).

    ``moves``: deal_id, entity_id, alias, place; those of an entity go together, and the first by place is the new entity's name. The new entity has the
    old one's type and confidence, and copies of the evidence whose documents its aliases come from, or of the oldest row if there is none. Facts and relations stay.
    Refused are aliases that nobody bears or somebody else does, and names that a live entity of the type has.
    """
    owned = g.aliases.select("deal_id", F.col("alias").alias("own_alias"), F.col("entity_id").alias("owner"), "document_id")
    met = moves.join(owned.withColumnRenamed("deal_id", "d"), (F.col("deal_id") == F.col("d")) & (F.col("alias") == F.col("own_alias")), "left")
    each = keep(met.groupBy("deal_id", "entity_id", "alias", "place").agg(F.count("owner").alias("borne"), F.count_if(F.col("owner") == F.col("entity_id")).alias("own"), F.min(F.when(F.col("owner") == F.col("entity_id"), F.col("document_id"))).alias("document_id")))
    asked = each.groupBy("deal_id", "entity_id").agg(F.min("borne").alias("borne"), F.min("own").alias("own"), F.min_by("alias", F.struct("place", "alias")).alias("name"))
    asked = asked.join(g.entities.select("deal_id", "entity_id", "type", "confidence", "seq"), ["deal_id", "entity_id"]).withColumn("norm", comparison_name(F.col("name")))
    taken = g.entities.filter("merged_into is null").select("deal_id", "type", comparison_name(F.col("name")).alias("norm")).distinct().withColumn("taken", F.lit(True))
    turn = F.row_number().over(Window.partitionBy("deal_id", "type", "norm").orderBy("entity_id"))
    reason = F.when(F.col("borne") == 0, "unknown alias").when(F.col("own") == 0, "alias of another entity").when(F.col("taken") | (F.col("turn") > 1), "name is taken")
    judged = keep(asked.join(taken, ["deal_id", "type", "norm"], "left").withColumn("turn", turn).withColumn("reason", reason))
    fine = judged.filter("reason is null").withColumn("fresh", graph.entity_id(F.lit("split"), F.col("deal_id"), F.col("entity_id"), F.col("norm")))
    nodes = fine.select("deal_id", F.col("fresh").alias("entity_id"), "type", "name", "confidence", "seq", F.lit(None).cast("string").alias("merged_into"))
    going = each.join(fine.select("deal_id", "entity_id", "fresh"), ["deal_id", "entity_id"]).select("deal_id", "entity_id", "alias", "fresh", "document_id")
    aliases = g.aliases.join(going.drop("document_id"), ["deal_id", "entity_id", "alias"], "left").withColumn("entity_id", F.coalesce("fresh", "entity_id")).select(g.aliases.columns)
    sources = going.filter("document_id is not null").select("deal_id", "entity_id", "document_id").distinct().withColumn("told", F.lit(True))
    cited = g.evidence.filter("kind = 'entity'").join(fine.select("deal_id", F.col("entity_id").alias("target_id"), "fresh"), ["deal_id", "target_id"])
    cited = cited.join(sources.withColumnRenamed("entity_id", "target_id"), ["deal_id", "target_id", "document_id"], "left")
    by = Window.partitionBy("deal_id", "fresh")
    oldest = F.row_number().over(by.orderBy("seq", "evidence_id")) == 1
    copied = cited.withColumns({"any": F.max("told").over(by), "oldest": oldest}).filter(F.col("told") | (F.col("any").isNull() & F.col("oldest")))
    copied = copied.withColumns({"target_id": F.col("fresh"), "evidence_id": graph.entity_id(F.lit("copy"), F.col("evidence_id"), F.col("fresh"))}).select(g.evidence.columns)
    return Graph(g.entities.unionByName(nodes), aliases, g.relations, g.evidence.unionByName(copied), g.facts), judged.filter("reason is not null").select("deal_id", "entity_id", "reason")
