"""The evidence store: rows are admitted with a reason or refused with one, stubs are claimed, and an audit finds what stands without proof.

Evidence: deal_id, evidence_id, document_id, chunk_id, table_id, row, col, quote, kind, target_id, seq. A row has a place (a chunk or a cell) and one target, (kind, target_id), or
none yet: a stub. Kinds are fact, entity and relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze
from .graph import entity_id
from .steps import stored

TARGET = ["kind", "target_id"]
CELL = ["table_id", "row", "col"]


def reasons(**of: Column) -> Column:
    """The name of the first condition that holds, null if none does."""
    out = None
    for name, condition in of.items():
        said = name.replace("_", " ")
        out = F.when(condition, said) if out is None else out.when(condition, said)
    return out


def admitted(rows: DataFrame, chunks: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence with char_start and char_end, and (evidence_id, reason) of what is refused.

    A quote must stand in its chunk (deal_id, chunk_id, text), or without one in its cell (deal_id, table_id, row, col, text), white space aside. Offsets are those of
    the quote as written in the chunk, from 0; they are null if only its words are there, and for cells.
    """
    chunk = chunks.select(F.col("deal_id").alias("chunk_deal"), "chunk_id", F.col("text").alias("chunk_text"))
    cell = cells.select(F.col("deal_id").alias("cell_deal"), *CELL, F.coalesce("text", F.lit("")).alias("cell_text"))
    both = rows.join(chunk, "chunk_id", "left").join(cell, CELL, "left")
    in_chunk, in_cell = F.col("chunk_id").isNotNull(), F.col("table_id").isNotNull()
    text = F.coalesce(F.when(in_chunk, F.col("chunk_text")).otherwise(F.col("cell_text")), F.lit(""))
    why = reasons(
        no_place=~in_chunk & ~in_cell, chunk_not_found=in_chunk & ~F.col("chunk_deal").eqNullSafe(F.col("deal_id")), cell_not_found=in_cell & F.col("cell_deal").isNull(),
        empty_quote=squeeze(F.coalesce("quote", F.lit(""))) == "", quote_not_in_text=~F.contains(squeeze(text), squeeze(F.col("quote"))),
    )
    judged = both.withColumn("reason", why)
    at = F.instr(F.col("chunk_text"), F.col("quote"))
    found = in_chunk & (at > 0)
    fine = judged.filter("reason is null").withColumns({"char_start": F.when(found, at - 1), "char_end": F.when(found, at - 1 + F.length("quote"))})
    return fine.select(*rows.columns, "char_start", "char_end"), judged.filter("reason is not null").select("evidence_id", "reason")


def claimed(evidence: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence after claims (evidence_id, kind, target_id, seq), and the claims on rows that aren't there.

    The first claim by seq takes a stub. Every other target gets a copy of the row, since a row has one target; a claim by the row's own target, and a repeated one, changes nothing.
    """
    asked = claims.groupBy("evidence_id", *TARGET).agg(F.min("seq").alias("turn"))
    own = evidence.select("evidence_id", F.col("kind").alias("own_kind"), F.col("target_id").alias("own_target"))
    met = asked.join(own, "evidence_id").filter(~(F.col("kind").eqNullSafe(F.col("own_kind")) & F.col("target_id").eqNullSafe(F.col("own_target"))))
    place = F.row_number().over(Window.partitionBy("evidence_id").orderBy("turn", *TARGET))
    met = met.withColumn("takes", F.col("own_target").isNull() & (place == 1)).select("evidence_id", F.col("kind").alias("new_kind"), F.col("target_id").alias("new_target"), "takes")
    first = met.filter("takes").drop("takes")
    kept = evidence.join(first, "evidence_id", "left").withColumns({"kind": F.coalesce("kind", "new_kind"), "target_id": F.coalesce("target_id", "new_target")}).select(evidence.columns)
    copies = evidence.join(met.filter("not takes").drop("takes"), "evidence_id").withColumns({"kind": F.col("new_kind"), "target_id": F.col("new_target"), "evidence_id": entity_id(F.lit("copy"), F.col("evidence_id"), F.col("new_kind"), F.col("new_target"))})
    return kept.unionByName(copies.select(evidence.columns)), claims.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def audit(facts: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, broken): everything that stands without proof, and proof of nothing; no rows if all is well.

    Facts (fact_id, method) that aren't derived, entities and relations (relation_id, source_id, target_id) need evidence; derived facts need a parent in ``links``
    (fact_id, parent_id). Evidence needs a place and a target, the ends of relations and parents must exist. One anti-join on (kind, id) asks for all kinds at once. Evidence is first
    taken together by target, so that its rows, the most by far, meet only the targets that are missing.
    """
    kind = lambda df, name, key: df.select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("id"))
    everything = kind(facts, "fact", "fact_id").unionByName(kind(entities, "entity", "entity_id")).unionByName(kind(relations, "relation", "relation_id"))
    told = stored(evidence.filter("target_id is not null").select("kind", F.col("target_id").cast("string").alias("id")).distinct())
    wanting = kind(facts.filter("method <> 'derived' or method is null"), "fact", "fact_id").unionByName(everything.filter("kind <> 'fact'"))
    flag = lambda df, said: df.select("kind", "id", F.lit(said).alias("broken"))
    out = flag(wanting.join(told, ["kind", "id"], "left_anti"), "no evidence")
    made = kind(facts.filter("method = 'derived'"), "fact", "fact_id")
    out = out.unionByName(flag(made.join(kind(links, "fact", "fact_id").select("id").distinct(), "id", "left_anti"), "no parent"))
    out = out.unionByName(flag(kind(links, "fact", "parent_id").distinct().join(everything, ["kind", "id"], "left_anti"), "parent is missing"))
    ends = relations.select("relation_id", F.explode(F.array(F.col("source_id").cast("string"), F.col("target_id").cast("string"))).alias("end"))
    lost = ends.join(entities.select(F.col("entity_id").cast("string").alias("end")), "end", "left_anti")
    out = out.unionByName(flag(kind(lost, "relation", "relation_id").distinct(), "end is missing"))
    missing = stored(told.join(everything, ["kind", "id"], "left_anti")).withColumn("lost", F.lit(True))
    row = evidence.select(F.col("evidence_id").cast("string").alias("row_id"), "kind", F.col("target_id").cast("string").alias("id"), F.coalesce(F.col("chunk_id").cast("string"), F.col("table_id").cast("string")).alias("place"))
    met = row.join(missing.withColumnRenamed("kind", "of"), F.col("kind").eqNullSafe(F.col("of")) & (row["id"] == missing["id"]), "left").select("row_id", "place", row["id"], "lost")
    broken = F.array(F.when(F.col("place").isNull(), "no place"), F.when(F.col("id").isNull(), "no target"), F.when(F.col("lost"), "target is missing"))
    return out.unionByName(met.select(F.lit("evidence").alias("kind"), F.col("row_id").alias("id"), F.explode(F.array_compact(broken)).alias("broken")))
