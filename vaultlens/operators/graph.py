"""Entities and relations: extraction from documents, resolution, merging, splitting, export.

Entities: deal_id, entity_id, type, name, seq. Relations: deal_id, type, source_id, target_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import comparison_name, counterparty, mailboxes, sentence_at, squeeze, title
from .names import ALIKE as ALIKE
from .names import alike as alike
from .names import resolution_pairs as resolution_pairs
from .names import token_set_ratio as token_set_ratio
from .steps import keep
from .steps import shared_folder as shared_folder

def entity_id(*of: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(c.cast("string") for c in of)), 256)


def quoted(text: Column, needle: Column) -> Column:
    """The line or sentence of a text that has ``needle``, in any case and white space."""
    at = F.instr(F.lower(text), F.lower(needle))
    plain = squeeze(text)
    there = F.instr(F.lower(plain), F.lower(squeeze(needle)))
    return F.when(at > 0, sentence_at(text, at)).when(there > 0, F.trim(F.substr(plain, there, F.length(needle))))


def contract_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of contracts (deal_id, document_id, filename, text, company): the contract, its other party, and how they hang together.

    All are quoted from the line that names the party, else from the first line; ``seq`` orders them by document.
    """
    named = documents.withColumns({"contract": title(F.col("filename")), "party": counterparty(F.col("text"), title(F.col("filename")), F.col("company"))})
    named = named.withColumns({"quote": F.coalesce(quoted(F.col("text"), F.col("party")), F.trim(F.split("text", "\n")[0])), "seq": F.col("document_id").cast("string")})
    named = keep(named.select("deal_id", "document_id", "quote", "seq", "contract", "party", "company"))  # read once, told six times
    told = ["document_id", "quote", "seq"]
    entity = lambda df, kind, name: df.select("deal_id", F.lit(kind).alias("type"), F.col(name).alias("name"), *told).filter("name is not null")
    entities = entity(named, "contract", "contract").unionByName(entity(named, "customer", "party")).unionByName(entity(named, "company", "company"))
    kinds = {"company": "company", "contract": "contract", "party": "customer"}
    edge = lambda df, kind, a, b: df.select("deal_id", F.lit(kind).alias("type"), F.lit(kinds[a]).alias("source_type"), F.col(a).alias("source"), F.lit(kinds[b]).alias("target_type"), F.col(b).alias("target"), *told).filter("source is not null and target is not null")
    edges = edge(named, "has_contract", "company", "contract").unionByName(edge(named, "has_customer", "company", "party")).unionByName(edge(named, "has_contract", "party", "contract"))
    return entities, edges


def email_graph(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People of messages (deal_id, document_id, text, company), quoted from their header lines; the company employs those whose domain holds its first word."""
    lines = F.regexp_extract_all(F.col("text"), F.lit(r"(?im)^(?:from|to|cc):[^\n]*$"), 0)
    each = messages.select("deal_id", "document_id", "company", F.explode(F.transform(lines, lambda x: F.struct(x.alias("line"), mailboxes(x).alias("boxes")))).alias("l"))
    one = each.select("deal_id", "document_id", "company", F.trim("l.line").alias("quote"), F.explode("l.boxes").alias("m")).select("deal_id", "document_id", "company", "quote", "m.address", "m.name")
    one = one.distinct().withColumn("seq", F.col("document_id").cast("string"))
    people = one.select("deal_id", F.lit("person").alias("type"), "name", "document_id", "quote", "seq")
    first = F.split(comparison_name(F.col("company")), " ")[0]
    works = one.filter((first != "") & F.contains(F.substring_index("address", "@", -1), first))
    return people, works.select("deal_id", F.lit("employs").alias("type"), F.lit("company").alias("source_type"), F.col("company").alias("source"), F.lit("person").alias("target_type"), F.col("name").alias("target"), "document_id", "quote", "seq")


def groups(pairs: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b): labels fall to the least neighbour's, and then to their label's label."""
    edges = keep(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "seen").alias("root"), (F.col("seen") < F.col("root")).alias("moved"))
        jump = lower.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        fresh = keep(lower.join(jump, lower["root"] == jump["n2"], "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "moved"))
        labels = fresh.select("node", "root")
        if not fresh.agg(F.max("moved")).first()[0]:
            break
    return labels


def winners(entities: DataFrame, components: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, merged_into): of each component the entity with most evidence, the earliest of equals, takes the others."""
    count = evidence.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    rows = entities.select("entity_id", "seq").join(components.withColumnRenamed("node", "entity_id"), "entity_id").join(count, "entity_id", "left").fillna(0, ["n"])
    best = Window.partitionBy("root").orderBy(F.desc("n"), "seq", "entity_id")
    return rows.withColumn("merged_into", F.first("entity_id").over(best)).filter("merged_into <> entity_id").select("entity_id", "merged_into")


def repointed(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """Relations between the winners; equal ones become one with the highest confidence and all evidence, loops go."""
    m = lambda c: merged.select(F.col("entity_id").alias(c), F.col("merged_into").alias(f"{c}_new"))
    moved = relations.join(m("source_id"), "source_id", "left").join(m("target_id"), "target_id", "left")
    ends = moved.withColumns({"source_id": F.coalesce("source_id_new", "source_id"), "target_id": F.coalesce("target_id_new", "target_id")}).filter("source_id <> target_id")
    return ends.groupBy("type", "source_id", "target_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"))


def split_entity(aliases: DataFrame, entity: str, moved: list[str], new_id: str) -> DataFrame:
    """Aliases with those of ``moved`` given to a new entity; all of them, or one that the entity doesn't bear, is an error."""
    own = {r["alias"] for r in aliases.filter(F.col("entity_id") == entity).select("alias").distinct().collect()}
    if not set(moved) <= own or not own - set(moved):
        raise ValueError("aliases to move must be some, but not all, of the entity's own")
    return aliases.withColumn("entity_id", F.when((F.col("entity_id") == entity) & F.col("alias").isin(*moved), F.lit(new_id)).otherwise(F.col("entity_id")))


def live_graph(entities: DataFrame, relations: DataFrame, most: int = 500, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` live nodes by seq, of the types asked for, and the edges with both ends among them."""
    live = entities.filter("merged_into is null")
    if types:
        live = live.filter(F.col("type").isin(*types))
    nodes = live.orderBy("seq", "entity_id").limit(most)
    ids = nodes.select("entity_id")
    edges = relations.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file; of parallel edges the last by type is kept, as in a simple graph."""
    x = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    one = edges.groupBy("source_id", "target_id").agg(F.max("type").alias("type"))
    lines = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"><data key="name">%s</data><data key="type">%s</data></node>', x("entity_id"), x("name"), x("type")).alias("line"))
    lines = lines.unionByName(one.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', x("source_id"), x("target_id"), x("type")).alias("line")))
    return lines.orderBy("part", "line").select("line")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON object for each node and edge, confidence to four places."""
    rounded = lambda df: df.withColumn("confidence", F.round("confidence", 4)) if "confidence" in df.columns else df
    j = lambda df, kind: rounded(df).select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return j(nodes, "node").unionByName(j(edges, "edge"))


def entity_detail(entities: DataFrame, aliases: DataFrame, relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Each live entity with its aliases, number of relations on either side, and live facts; one aggregate a side, no fan-out."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("relations"))
    names = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    told = facts.filter("superseded_by is null").groupBy(F.col("subject").alias("entity_id")).agg(F.count(F.lit(1)).alias("facts"))
    out = entities.filter("merged_into is null").join(names, "entity_id", "left").join(ends, "entity_id", "left").join(told, "entity_id", "left")
    return out.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "relations": F.coalesce("relations", F.lit(0)), "facts": F.coalesce("facts", F.lit(0))})
