"""Chat formatting by quotation linking, by DataFrame functions alone.

A line's quote level is the number of ``>`` at its start. Neighbouring lines of one level are a passage. Quoted
passages are normalised and hashed, and joined to the messages of the same conversation that say them themselves: as
a whole, as a paragraph, or as any run of neighbouring lines. For runs each line is hashed, a passage meets the lines of messages by its rarest one, and where
they meet all its lines must follow in order. A message answers the latest message that it quotes at level 1, else the turn
before it. Conversations come out in an order in which each message follows the one it answers, with quotes and the
lines that introduce them (``... wrote:``) taken out.

Links go to earlier turns only, so the order of turns is an order of replies: each message comes after the one it answers. Of several messages that say the same, the
first counts as the original. Messages are ranked in ranges of (conversation, turn), so that a conversation of any
length is spread over tasks, and come out as rows.

Defined results: a null text counts as empty. A null turn comes first, and null conv_id is a conversation. Repeated rows
are messages of their own; equal turns come in the order of the table. Quotes without an original are taken out as well and counted; a passage with one line that nobody said is such a quote.
Blank lines don't count in runs. A very long message is taken apart line by line, as rows. An empty table gives no rows. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

QUOTED = r"(?md)^[ \t]*>[^\n]*(?:\n|\z)"
INTRODUCED = r"(?md)^[^\n]*\bwrote:[ \t]*\n(?=[ \t]*>)"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own(text: Column) -> Column:
    """The text without quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, INTRODUCED, ""), QUOTED, ""))


def hashed(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def line_hashes(lines: Column) -> Column:
    """Hashes of the lines that aren't blank."""
    return F.transform(F.filter(F.transform(lines, normal), lambda x: x != ""), hashed)


def passages(messages: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, level, run, hash, lines) of every quoted passage. Only messages with a quote are taken apart."""
    some = messages.filter(F.col("text").rlike(r"(?md)^[ \t]*>"))
    lines = some.select("rid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    mark = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    lines = lines.withColumns({"level": F.length(F.regexp_replace(mark, "[^>]", "")), "said": F.expr("substring(line, length(regexp_extract(line, '^((?:[ \\\\t]*>)*)', 1)) + 1)")})
    order = Window.partitionBy("rid").orderBy("no")
    lines = lines.withColumn("new", F.when(F.col("level").eqNullSafe(F.lag("level").over(order)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = lines.filter(F.col("level") > 0).groupBy("rid", "conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(F.struct("no", "said"))).alias("all"))
    text = normal(F.array_join(F.col("all.said"), " "))
    return runs.withColumn("text", text).filter(F.col("text") != "").select("rid", "conv_id", "turn", "level", "run", hashed(F.col("text")).alias("hash"), line_hashes(F.col("all.said")).alias("lines"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, said): the first turn that says a passage itself."""
    text = own(F.col("text"))
    parts = F.array_distinct(F.transform(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")), normal))
    said = messages.select("conv_id", "turn", F.explode(parts).alias("text")).filter(F.col("text") != "")
    return said.groupBy("conv_id", hashed(F.col("text")).alias("hash")).agg(F.min("turn").alias("said"))


def runs_said(quoted: DataFrame, messages: DataFrame) -> DataFrame:
    """(rid, run, said): the first earlier turn that says all lines of a passage in a row, for passages of two lines and more.

    A line that many say is no key: a passage's key is the line of it that is said least often in the conversation. Lines that no passage has are not shuffled.
    """
    several = cut(quoted.filter(F.size("lines") > 1).select("rid", "run", "conv_id", "turn", "lines"))
    asked = cut(several.select("conv_id", F.explode(F.array_distinct("lines")).alias("line")).distinct())
    own_lines = messages.select("conv_id", F.col("turn").alias("said"), F.col("rid").alias("by"), line_hashes(F.split(own(F.col("text")), "\n")).alias("all"))
    placed = own_lines.select("conv_id", "said", "by", F.posexplode("all").alias("at", "line"))
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    known = cut(placed.alias("a").join(asked.alias("b"), same("conv_id", "conv_id") & (F.col("a.line") == F.col("b.line")), "left_semi"))
    often = known.groupBy("conv_id", "line").agg(F.count(F.lit(1)).alias("n"))
    each = several.select("rid", "run", "conv_id", "turn", F.size("lines").alias("many"), F.posexplode("lines").alias("no", "line"))
    rated = each.alias("a").join(often.alias("b"), same("conv_id", "conv_id") & (F.col("a.line") == F.col("b.line")), "left").select("a.*", "n")
    keyed = rated.groupBy("rid", "run", "conv_id", "turn", "many").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("no"), F.col("line"))).alias("key")).filter("key.n > 0")
    met = keyed.alias("a").join(known.alias("b"), same("conv_id", "conv_id") & (F.col("a.key.line") == F.col("b.line")) & F.col("b.said").isNotNull() & (F.col("b.said") < F.col("a.turn")))
    starts = met.select("rid", "run", "many", "said", "by", (F.col("at") - F.col("key.no")).alias("start")).filter("start >= 0")
    wanted = starts.join(each.select("rid", "run", "no", "line"), ["rid", "run"]).withColumn("at", F.col("start") + F.col("no"))
    found = wanted.join(known.select("by", "at", "line"), ["by", "at", "line"]).groupBy("rid", "run", "many", "said", "by", "start").agg(F.count(F.lit(1)).alias("n")).filter("n = many")
    return found.groupBy("rid", "run").agg(F.min("said").alias("run_said"))


def ranked(messages: DataFrame) -> DataFrame:
    """(rid, position, previous turn) in each conversation: ranks in ranges of rows, plus what earlier ranges hold."""
    dealt = cut(messages.select("rid", "conv_id", "turn").repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("rid")).withColumn("part", F.spark_partition_id()))
    at = Window.partitionBy("part", "conv_id").orderBy("turn", "rid")
    sums = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    by_part = Window.partitionBy("conv_id").orderBy("part")  # a row for each range that holds some of it
    before = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("held"), F.lag("last").over(by_part).alias("last_before"))
    rows = dealt.withColumns({"no": F.row_number().over(at), "previous": F.lag("turn").over(at)})
    joined = rows.join(sums, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    previous = F.when(F.col("no") == 1, F.col("last_before")).otherwise(F.col("previous"))
    return joined.select("rid", (F.col("no") - 1 + F.col("held")).alias("position"), previous.alias("previous"))


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, n_quotes, n_linked, text of each message."""
    messages = conversations.select(F.monotonically_increasing_id().alias("rid"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quoted = cut(passages(messages))
    first = originals(messages).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), "said")
    joined = quoted.join(first, (F.col("hash") == F.col("h")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") < F.col("turn")), "left")
    joined = joined.join(runs_said(quoted, messages), ["rid", "run"], "left").withColumn("said", F.least("said", "run_said"))
    links = joined.groupBy("rid").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("said").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("said"))).alias("answered"))
    out = messages.select("rid", "conv_id", "turn", "role", own(F.col("text")).alias("text")).join(ranked(messages), "rid").join(links, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("conv_id", "position", "turn", "role", F.coalesce("answered", "previous").alias("parent_turn"), zero("n_quotes"), zero("n_linked"), "text")


SQL = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS rid FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM m),
v AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)*)', 1) AS mark FROM l),
n AS (SELECT *, len(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(line, len(mark) + 1) AS said, lead(mark) OVER w AS next_mark, lead(no) OVER w IS NULL AS final FROM v WINDOW w AS (PARTITION BY rid ORDER BY no)),
o AS (SELECT m.*, trim(coalesce(own, '')) AS own FROM m LEFT JOIN (SELECT rid, string_agg(line || CASE WHEN final THEN '' ELSE chr(10) END, '' ORDER BY no) AS own FROM n
      WHERE level = 0 AND NOT (regexp_matches(line, '\bwrote:[ \t]*$') AND coalesce(next_mark, '') LIKE '%>%') GROUP BY rid) k USING (rid)),
r AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY no) AS run FROM (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY no) THEN 0 ELSE 1 END AS new FROM n) q),
q AS (SELECT rid, conv_id, turn, level, run, trim(regexp_replace(lower(string_agg(said, ' ' ORDER BY no)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS p, list_filter(list(trim(regexp_replace(lower(said), '[ \t\n\x0B\f\r]+', ' ', 'g')) ORDER BY no), lambda x: x <> '') AS ls FROM r WHERE level > 0 GROUP BY rid, conv_id, turn, level, run),
s AS (SELECT conv_id, turn, unnest(list_distinct([own] || regexp_split_to_array(own, '\n[ \t]*\n') || string_split(own, chr(10)))) AS p FROM o),
f AS (SELECT conv_id, trim(regexp_replace(lower(p), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS p, min(turn) AS said FROM s GROUP BY ALL),
ol AS (SELECT rid, conv_id, turn, list_filter(list_transform(string_split(own, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM o),
z AS (SELECT q.rid, q.run, min(ol.turn) AS said FROM q JOIN ol ON ol.conv_id IS NOT DISTINCT FROM q.conv_id AND ol.turn < q.turn AND len(q.ls) > 1 AND len(list_filter(range(1, len(ol.ls) - len(q.ls) + 2), lambda i: ol.ls[i:i + len(q.ls) - 1] = q.ls)) > 0 GROUP BY q.rid, q.run),
k AS (SELECT q.rid, count(*) AS n_quotes, count(least(f.said, z.said)) AS n_linked, max(CASE WHEN level = 1 THEN least(f.said, z.said) END) AS answered FROM q LEFT JOIN f ON f.p = q.p AND f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.said < q.turn LEFT JOIN z ON z.rid = q.rid AND z.run = q.run WHERE q.p <> '' GROUP BY q.rid)
SELECT conv_id, row_number() OVER w - 1 AS position, turn, role, coalesce(answered, lag(turn) OVER w) AS parent_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, own AS text
FROM o LEFT JOIN k USING (rid) WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, rid)
"""
