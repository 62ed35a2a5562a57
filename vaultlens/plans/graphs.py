"""Queries over the merged graph: resolution at its threshold, one run from texts to the graph, splits, the audit of what is extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.text import LEGAL_FORMS, comparison_name
from ..operators import graph, merge, names
from .adapters import read

S = SparkSession
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


FORMS = ", ".join(f"'{x}'" for x in LEGAL_FORMS)
#: DuckDB: the words of a comparison name of ASCII letters and digits.
WORDS = rf"list_filter(string_split_regex(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ({FORMS}))"


def ratio_sql(source: str, least: int = 92) -> str:
    """CTEs ``alike`` (g, a, b) of all pairs of ``source`` (g, id, norm) in a group whose token set ratio is at least ``least``, each pair compared with bit-parallel rows."""
    low = f"(100 - {least})"
    return f"""
rs AS (SELECT g, id, norm, list_sort(list_distinct(string_split(norm, ' '))) AS t FROM {source}),
rp AS (SELECT x.g, x.id AS a, y.id AS b, array_to_string(list_filter(x.t, lambda w: list_contains(y.t, w)), ' ') AS s, array_to_string(list_filter(x.t, lambda w: NOT list_contains(y.t, w)), ' ') AS l, array_to_string(list_filter(y.t, lambda w: NOT list_contains(x.t, w)), ' ') AS r FROM rs x JOIN rs y ON x.g = y.g AND x.id < y.id),
rl AS (SELECT *, length(s) AS ns, length(l) AS nl, length(r) AS nr, length(s) + length(l) + CASE WHEN s <> '' AND l <> '' THEN 1 ELSE 0 END AS n1, length(s) + length(r) + CASE WHEN s <> '' AND r <> '' THEN 1 ELSE 0 END AS n2 FROM rp),
rd AS (SELECT *, (s <> '' AND (l = '' OR r = '')) OR (s <> '' AND ((nl + 1) * 100 <= {low} * (2 * ns + nl + 1) OR (nr + 1) * 100 <= {low} * (2 * ns + nr + 1))) AS near, abs(nl - nr) * 100 <= {low} * (n1 + n2) AS may FROM rl),
rr AS (SELECT *, CASE WHEN near OR NOT may THEN NULL ELSE bit_count(list_reduce(list_prepend((1::HUGEINT << nl) - 1, list_transform(string_split(r, ''), lambda c: list_sum(list_transform(range(nl), lambda i: CASE WHEN substr(l, i + 1, 1) = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT)),
  lambda row_, m: ((row_ + (row_ & m)) | (row_ - (row_ & m))) & ((1::HUGEINT << nl) - 1))) END AS apart FROM rd),
alike AS (SELECT g, a, b FROM rr WHERE near OR (may AND (nl + nr - 2 * (nl - apart)) * 100 <= {low} * (n1 + n2)))"""


def written_names(s: S, d: str) -> DataFrame:
    """Three names of each document's ASCII words: four words; the same with a tail of up to eight more; the same turned around and without a letter."""
    head = F.regexp_extract(F.lower("text"), "^(?:[^a-z0-9]*[a-z0-9]+){0,12}", 0)  # no name has a word beyond the twelfth
    w = F.regexp_extract_all(head, F.lit("[a-z0-9]+"), 0)
    docs = read(s, d, "documents").select("doc_id", "source", w.alias("w")).filter(F.size("w") >= 4)
    first = F.array_join(F.slice("w", 1, 4), " ")
    typo = F.concat_ws(" ", F.get("w", F.lit(3)), F.get("w", F.lit(2)), F.substring(F.get("w", F.lit(1)), 2, 100), F.get("w", F.lit(0)))
    forms = F.array(first, F.array_join(F.slice("w", 1, 12), " "), typo)
    each = docs.select("doc_id", "source", F.posexplode(forms).alias("k", "name"))
    return each.select(F.lit(1).alias("deal_id"), F.col("source").alias("type"), (F.col("doc_id") * 3 + F.col("k")).alias("entity_id"), "name")


WRITTEN = f"""w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
forms AS (SELECT doc_id * 3 + k AS id, source AS g, CASE k WHEN 0 THEN array_to_string(w[1:4], ' ') WHEN 1 THEN array_to_string(w[1:12], ' ') ELSE concat_ws(' ', w[4], w[3], substr(w[2], 2, 100), w[1]) END AS name FROM w, range(3) t(k) WHERE len(w) >= 4),
normed AS (SELECT g, id, array_to_string({WORDS}, ' ') AS norm FROM forms),
one AS (SELECT g, min(id) AS id, norm FROM normed WHERE norm <> '' GROUP BY g, norm)"""


@query(f"WITH {WRITTEN}, {ratio_sql('one')} SELECT g AS type, a, b FROM alike UNION ALL SELECT n.g, o.id, n.id FROM normed n JOIN one o ON n.g IS NOT DISTINCT FROM o.g AND n.norm = o.norm WHERE n.id <> o.id")
def entity_resolution_written(s: S, d: str) -> DataFrame:
    """Resolution at its own threshold of names with tails, typing errors and words in another order; the SQL compares all pairs."""
    return names.resolution_pairs(written_names(s, d)).select("type", "a", "b")


ENDS = [", a corporation.", " dated May 1.", " under the law of trade.", " — the customer.", " (the customer)."]
FORMS_OF_PARTY = "CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' ' || n_name || ' Inc' WHEN 1 THEN c_mktsegment || ' ' || n_name WHEN 2 THEN c_mktsegment || ' ' || n_name || ' Holding Group International' ELSE n_name || ' ' || c_mktsegment || ' x' END"


def papers(s: S, d: str) -> DataFrame:
    """A contract of each customer with its nation's company. Customers of a nation and segment are one party, written in four ways; the party's name ends in five ways."""
    c = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("party", F.expr(FORMS_OF_PARTY))
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("c_custkey") % 5).cast("int"))
    text = F.concat(F.lit("This agreement is made between "), F.col("n_name"), F.lit(" and "), F.col("party"), end)
    return c.select(F.col("n_nationkey").alias("deal_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("document_id"), F.concat(F.md5(F.col("c_custkey").cast("string")), F.lit(".pdf")).alias("filename"), text.alias("text"), F.col("n_name").alias("company"), "party", "c_acctbal")


def messages(s: S, d: str) -> DataFrame:
    """A mail of each supplier, from within its nation's company."""
    c = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hashed = F.md5(F.col("s_suppkey").cast("string"))
    line = F.concat(F.lit("From: "), F.substring(hashed, 1, 7), F.lit(" "), F.substring(hashed, 8, 7), F.lit(" <p"), F.col("s_suppkey").cast("string"), F.lit("@"), F.lower(F.split("n_name", " ")[0]), F.lit(".com>\nTo: info@other.org\n\nHello"))
    return c.select(F.col("n_nationkey").alias("deal_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("document_id"), line.alias("text"), F.col("n_name").alias("company"))


def merged(s: S, d: str) -> merge.Graph:
    p = papers(s, d)
    party = p.select("deal_id", F.substring("document_id", 2, 20).alias("fact_id"), F.lit("customer").alias("type"), comparison_name(F.col("party")).alias("norm"), money(F.col("c_acctbal")).cast("string").alias("value"))
    facts = party.select("deal_id", "fact_id", merge.entity_key(F.col("norm")).alias("subject"), "value")
    no = merge.Graph(None, None, None, None, facts)
    return merge.built(p.drop("party", "c_acctbal"), messages(s, d), more=no)


MERGED = f"""pap AS (SELECT n_nationkey AS deal_id, n_name AS company, 'c' || c_custkey AS doc, md5(c_custkey::VARCHAR) AS contract, {FORMS_OF_PARTY} AS party, CAST(CAST(c_acctbal AS DECIMAL(24,6)) AS VARCHAR) AS value, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
pt AS (SELECT *, 'This agreement is made between ' || company || ' and ' || party || CASE c_custkey % 5 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDS))} END AS quote FROM pap),
mail AS (SELECT n_nationkey AS deal_id, n_name AS company, 's' || s_suppkey AS doc, substr(md5(s_suppkey::VARCHAR), 1, 7) || ' ' || substr(md5(s_suppkey::VARCHAR), 8, 7) AS person, 'From: ' || substr(md5(s_suppkey::VARCHAR), 1, 7) || ' ' || substr(md5(s_suppkey::VARCHAR), 8, 7) || ' <p' || s_suppkey || '@' || lower(split_part(n_name, ' ', 1)) || '.com>' AS quote FROM supplier JOIN nation ON s_nationkey = n_nationkey),
said AS (SELECT deal_id, 'contract' AS type, contract AS name, doc, quote FROM pt UNION ALL SELECT deal_id, 'customer', party, doc, quote FROM pt UNION ALL SELECT deal_id, 'company', company, doc, quote FROM pt
  UNION ALL SELECT deal_id, 'person', person, doc, quote FROM mail UNION ALL SELECT deal_id, 'person', 'Info', doc, 'To: info@other.org' FROM mail UNION ALL SELECT deal_id, 'company', company, doc, quote FROM mail),
sn AS (SELECT *, array_to_string({WORDS}, ' ') AS norm FROM said),
ent AS (SELECT deal_id, type, norm, arg_min(name, (doc, name)) AS name, min(doc) AS seq, count(DISTINCT (doc, quote)) AS n, deal_id || '|' || type || '|' || norm AS id FROM sn GROUP BY deal_id, type, norm),
src AS (SELECT deal_id || '|' || type AS g, id, norm FROM ent), {ratio_sql('src')},
way AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike),
reach AS (SELECT id AS node, id AS seen FROM ent UNION SELECT r.node, way.b FROM reach r JOIN way ON way.a = r.seen),
rooted AS (SELECT node, first(e.id ORDER BY e.n DESC, e.seq, e.id) AS root FROM reach JOIN ent e ON e.id = seen GROUP BY node),
er AS (SELECT e.*, r.root, q.name AS root_name FROM ent e JOIN rooted r ON r.node = e.id JOIN ent q ON q.id = r.root),
ev AS (SELECT DISTINCT er.deal_id, er.type, er.root, er.root_name, sn.doc, sn.quote, er.id FROM sn JOIN er USING (deal_id, type, norm)),
rel AS (SELECT deal_id, 'has_contract' AS type, 'company' AS st, company AS s, 'contract' AS tt, contract AS t, doc, quote FROM pt UNION ALL SELECT deal_id, 'has_customer', 'company', company, 'customer', party, doc, quote FROM pt UNION ALL SELECT deal_id, 'has_contract', 'customer', party, 'contract', contract, doc, quote FROM pt UNION ALL SELECT deal_id, 'employs', 'company', company, 'person', person, doc, quote FROM mail),
rn AS (SELECT *, array_to_string({WORDS.replace('lower(name)', 'lower(s)')}, ' ') AS sn_, array_to_string({WORDS.replace('lower(name)', 'lower(t)')}, ' ') AS tn_ FROM rel),
re AS (SELECT rn.*, a.root AS sr, a.root_name AS source, a.root <> a.id AS ms, b.root AS tr, b.root_name AS target, b.root <> b.id AS mt, a.id AS sid, b.id AS tid FROM rn JOIN er a ON a.deal_id = rn.deal_id AND a.type = st AND a.norm = sn_ JOIN er b ON b.deal_id = rn.deal_id AND b.type = tt AND b.norm = tn_),
rk AS (SELECT deal_id, type, sid, tid, any_value(sr) AS sr, any_value(tr) AS tr, any_value(source) AS source, any_value(target) AS target, any_value(ms OR mt) AS moved, min(doc) AS seq FROM re GROUP BY deal_id, type, sid, tid)"""


@query(f"""WITH RECURSIVE {MERGED}
SELECT 'entity' AS part, deal_id, type, name, CASE WHEN root <> id THEN root_name END AS other, seq AS document_id, CASE WHEN root = id THEN (SELECT count(*) FROM ev WHERE ev.root = er.id) ELSE 0 END AS n FROM er
UNION ALL SELECT 'alias', er.deal_id, er.type, er.root_name, sn.name, min(sn.doc), 1 FROM sn JOIN er USING (deal_id, type, norm) GROUP BY er.deal_id, er.type, er.root, er.root_name, sn.name
UNION ALL SELECT 'relation', k.deal_id, k.type, k.source, k.target, k.seq, (SELECT count(DISTINCT (re.doc, re.quote, re.sid, re.tid)) FROM re WHERE re.deal_id = k.deal_id AND re.type = k.type AND re.sr = k.sr AND re.tr = k.tr) FROM (SELECT deal_id, type, sr, tr, any_value(source) AS source, any_value(target) AS target, arg_min(seq, (moved, seq)) AS seq FROM rk GROUP BY deal_id, type, sr, tr) k
UNION ALL SELECT 'evidence', deal_id, type, root_name, quote, doc, 1 FROM ev
UNION ALL SELECT DISTINCT 'evidence', deal_id, type, source || ' > ' || target, quote, doc, 1 FROM re
UNION ALL SELECT 'fact', pt.deal_id, 'customer', er.root_name, pt.value, pt.c_custkey::VARCHAR, 1 FROM pt JOIN (SELECT *, array_to_string({WORDS.replace('lower(name)', 'lower(party)')}, ' ') AS pn FROM pt) p2 USING (doc) JOIN er ON er.deal_id = pt.deal_id AND er.type = 'customer' AND er.norm = p2.pn""")
def merged_graph(s: S, d: str) -> DataFrame:
    """From contracts and mails to one merged graph: its entities, aliases, relations, evidence and facts, ids as names."""
    g = merged(s, d)
    name = g.entities.select("entity_id", F.col("name").alias("label"))
    label = lambda df, key, to: df.join(name.select(F.col("entity_id").alias("k"), F.col("label").alias(to)), F.col(key) == F.col("k"), "left").drop("k")
    told = g.evidence.groupBy(F.col("target_id").alias("told_of")).agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, part, kind, a, b, doc, n: df.select(F.lit(part).alias("part"), "deal_id", kind.alias("type"), a.alias("name"), b.alias("other"), doc.alias("document_id"), n.cast("long").alias("n"))
    c, one, type_of = F.col, F.lit(1), g.entities.select(F.col("entity_id").alias("e"), "type")
    count = F.coalesce("n", F.lit(0))
    tied = label(label(g.relations, "source_id", "source"), "target_id", "target")
    out = row(label(g.entities, "merged_into", "into").join(told, c("entity_id") == c("told_of"), "left"), "entity", c("type"), c("name"), c("into"), c("seq"), count)
    out = out.unionByName(row(label(g.aliases, "entity_id", "label").join(type_of, c("entity_id") == c("e")), "alias", c("type"), c("label"), c("alias"), c("document_id"), one))
    out = out.unionByName(row(tied.join(told, c("relation_id") == c("told_of"), "left"), "relation", c("type"), c("source"), c("target"), c("seq"), count))
    cited = label(g.evidence.filter("kind = 'entity'"), "target_id", "label").join(type_of, c("target_id") == c("e"))
    out = out.unionByName(row(cited, "evidence", c("type"), c("label"), c("quote"), c("document_id"), one))
    of = tied.select("relation_id", "type", F.concat_ws(" > ", "source", "target").alias("label"))
    out = out.unionByName(row(g.evidence.filter("kind = 'relation'").join(of, c("target_id") == c("relation_id")), "evidence", c("type"), c("label"), c("quote"), c("document_id"), one))
    return out.unionByName(row(label(g.facts, "subject", "label"), "fact", F.lit("customer"), c("label"), c("value"), c("fact_id"), one))
