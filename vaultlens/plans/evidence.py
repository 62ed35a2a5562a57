"""Queries over what is extracted from tables, its evidence, and the audit of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, extract
from ..operators.steps import stored
from .adapters import deals, read

S = SparkSession
QUERIES: dict = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def sheet(name: str, rows: DataFrame, row: Column, **values: Column) -> DataFrame:
    """Cells of a data row for each of ``rows`` (deal_id), a column for each value; dates and numbers come typed beside their text."""
    of = []
    for i, value in enumerate(values.values()):
        kind = rows.select(value.alias("v")).schema["v"].dataType.simpleString()
        number = value.cast("decimal(24,6)") if kind.startswith("decimal") else F.lit(None).cast("decimal(24,6)")
        day = value if kind == "date" else F.lit(None).cast("date")
        of.append(F.struct(F.lit(i).alias("col"), value.cast("string").alias("text"), number.alias("value_num"), day.alias("value_date")))
    document = F.concat(F.lit(f"{name}-"), c("deal_id").cast("string"))
    each = rows.select("deal_id", document.alias("document_id"), document.alias("table_id"), row.cast("int").alias("row"), F.explode(F.array(*of)).alias("v"))
    return each.select("deal_id", "document_id", "table_id", "row", "v.col", "v.text", "v.value_num", "v.value_date").filter("text is not null")


def rooms(s: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, documents, deals): each nation's company has its customers in a list, their orders in a bank statement, and the nation's suppliers in a cap table."""
    own = deals(s, d).select("deal_id", "company", "fye")
    customer = read(s, d, "customer").withColumn("deal_id", c("c_nationkey"))
    book = sheet("list", customer, c("c_custkey") + 1, Customer=c("c_name"), ARR=c("c_acctbal").cast("decimal(24,2)"), Start=F.lit("2024-01-01").cast("date"), End=F.date_add(F.lit("2024-01-31").cast("date"), (c("c_custkey") % 400).cast("int")), Segment=c("c_mktsegment"))
    orders = read(s, d, "orders").join(customer, c("o_custkey") == c("c_custkey")).withColumn("paid", c("o_totalprice").cast("decimal(24,2)"))
    bank = sheet("bank", orders, c("o_orderkey") + 3, Date=F.to_date("o_orderdate"), Details=F.lit("x"), Paid=c("paid"), Balance=c("paid"))
    supplier = read(s, d, "supplier").withColumn("deal_id", c("s_nationkey"))
    cap = sheet("cap", supplier, c("s_suppkey") + 1, Shareholder=c("s_name"), Class=F.when(c("s_suppkey") % 2 == 0, "common").otherwise("preferred"), Shares=(c("s_suppkey") + 1).cast("decimal(24,2)"))
    n = c("deal_id").cast("string")
    heads = sheet("list", own, F.lit(0), a=F.lit("Customer"), b=F.lit("ARR"), c=F.lit("Contract start"), d=F.lit("Contract end"), e=F.lit("Segment"))
    heads = heads.unionByName(sheet("bank", own, F.lit(0), a=F.concat(F.lit("Account "), n, F.lit("000000")), b=F.concat(F.lit("ACCT 99"), n, F.lit("00000"))))
    heads = heads.unionByName(sheet("bank", own, F.lit(1), a=F.lit("Date"), b=F.lit("Details"), c=F.lit("Paid in"), d=F.lit("Balance")))
    heads = heads.unionByName(sheet("cap", own, F.lit(0), a=F.lit("Shareholder"), b=F.lit("Security class"), c=F.lit("Shares")))
    cells = book.unionByName(bank).unionByName(cap).unionByName(heads)
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in (("list", "customer_list"), ("bank", "bank_statement"), ("cap", "cap_table"))))
    documents = own.withColumn("k", F.explode(kinds)).select(F.concat("k.k", F.lit("-"), n).alias("document_id"), c("k.t").alias("doc_type"))
    return cells, documents, own


ROOMS = """deals AS (SELECT n_nationkey AS deal_id, n_name AS company, n_nationkey % 12 + 1 AS fye FROM nation),
book AS (SELECT d.*, 'list-' || deal_id AS doc, c_custkey, c_custkey + 1 AS row_, c_name, CAST(c_acctbal AS DECIMAL(24,2)) AS arr, DATE '2024-01-01' AS st, CAST(DATE '2024-01-31' + CAST(c_custkey % 400 AS INTEGER) AS DATE) AS en, c_mktsegment FROM customer JOIN deals d ON c_nationkey = deal_id),
bank AS (SELECT b.deal_id, company, fye, 'bank-' || b.deal_id AS doc, o_orderkey + 3 AS row_, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(24,2)) AS paid FROM orders JOIN book b ON o_custkey = c_custkey),
cap AS (SELECT d.*, 'cap-' || deal_id AS doc, s_suppkey + 1 AS row_, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'common' ELSE 'preferred' END AS class, CAST(s_suppkey + 1 AS DECIMAL(24,2)) AS shares FROM supplier JOIN deals d ON s_nationkey = deal_id),
fy AS (SELECT *, year(day) + CASE WHEN month(day) > fye THEN 1 ELSE 0 END AS y FROM bank),
latest AS (SELECT deal_id, fye, company, max(en) AS en FROM book GROUP BY ALL),
ly AS (SELECT deal_id, company, last_day(make_date(y, fye, 1)) AS pe FROM (SELECT *, CAST(year(en) + CASE WHEN month(en) > fye THEN 1 ELSE 0 END AS INTEGER) AS y FROM latest)),
cited AS (
  SELECT deal_id, doc, 'contract_value' AS metric, c_name AS subject, st AS ps, en AS pe, row_, 1 AS col, CAST(arr AS VARCHAR) AS quote, arr AS amount FROM book
  UNION ALL SELECT deal_id, doc, 'contract_value', c_name, st, en, row_, 0, c_name, NULL FROM book
  UNION ALL SELECT deal_id, doc, m.m, b.company, CAST(date_trunc('month', pe) - INTERVAL 11 MONTH AS DATE), pe, row_, 1, CAST(arr AS VARCHAR), CASE m.m WHEN 'customers_count' THEN 1 ELSE arr END FROM book b JOIN ly USING (deal_id), (VALUES ('recurring_revenue'), ('customers_count'), ('top_customer_concentration')) m(m)
  UNION ALL SELECT deal_id, doc, 'cash_balance', 'Account ' || deal_id || '000000', day, day, row_, v.col, CASE v.col WHEN 3 THEN CAST(paid AS VARCHAR) ELSE CAST(day AS VARCHAR) END, CASE v.col WHEN 3 THEN paid END FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY row_ DESC) AS k FROM bank) x, (VALUES (3), (0)) v(col) WHERE k = 1
  UNION ALL SELECT deal_id, doc, 'bank_inflows', company, CAST(date_trunc('month', day) AS DATE), last_day(day), row_, 2, CAST(paid AS VARCHAR), paid FROM bank WHERE paid > 0
  UNION ALL SELECT deal_id, doc, 'bank_inflows', company, CAST(date_trunc('month', last_day(make_date(CAST(y AS INTEGER), fye, 1))) - INTERVAL 11 MONTH AS DATE), last_day(make_date(CAST(y AS INTEGER), fye, 1)), row_, 2, CAST(paid AS VARCHAR), paid FROM fy WHERE paid > 0
  UNION ALL SELECT deal_id, doc, 'shares_outstanding', company, NULL, NULL, row_, 2, CAST(shares AS VARCHAR), shares FROM cap),
facts AS (SELECT deal_id, doc, metric, subject, ps, pe, CAST(round(CASE metric WHEN 'top_customer_concentration' THEN CAST(max(amount) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0) * 100 ELSE CAST(sum(amount) AS DOUBLE) END, 2) AS DECIMAL(24,2)) AS value FROM cited GROUP BY deal_id, doc, metric, subject, ps, pe HAVING metric <> 'top_customer_concentration' OR sum(amount) <> 0),
owners AS (SELECT deal_id, company, 'bank-' || deal_id AS doc, 0 AS row_, 0 AS col, 'Account ' || deal_id || '000000' AS quote FROM deals),
ents AS (SELECT deal_id, 'customer' AS type, c_name AS name, doc, row_, 0 AS col, c_name AS quote FROM book UNION ALL SELECT deal_id, 'shareholder', s_name, doc, row_, 0, s_name FROM cap UNION ALL SELECT deal_id, 'security_class', class, doc, row_, 1, class FROM cap
  UNION ALL SELECT deal_id, 'bank_account', quote, doc, 0, 0, quote FROM owners UNION ALL SELECT deal_id, 'company', company, doc, row_, col, quote FROM owners),
rels AS (SELECT deal_id, 'has_customer' AS type, company AS s, c_name AS t, doc, row_, 0 AS col, c_name AS quote FROM book UNION ALL SELECT deal_id, 'owns_shares', s_name, company, doc, row_, 2, CAST(shares AS VARCHAR) FROM cap UNION ALL SELECT deal_id, 'banks_with', company, quote, doc, 0, 0, quote FROM owners)"""


@query(f"""WITH {ROOMS}
SELECT 'fact' AS part, deal_id, doc AS document_id, metric AS type, subject AS name, CAST(value AS VARCHAR) AS other, CAST(ps AS VARCHAR) AS a, CAST(pe AS VARCHAR) AS b FROM facts
UNION ALL SELECT DISTINCT 'entity', deal_id, NULL, type, name, NULL, NULL, NULL FROM ents
UNION ALL SELECT 'alias', deal_id, NULL, 'bank_account', 'Account ' || deal_id || '000000', 'ACCT 99' || deal_id || '00000', NULL, NULL FROM deals
UNION ALL SELECT DISTINCT 'relation', deal_id, NULL, type, s, t, NULL, NULL FROM rels
UNION ALL SELECT 'evidence', c.deal_id, c.doc, 'fact', f.metric || '|' || f.subject || '|' || coalesce(CAST(f.ps AS VARCHAR), '') || '|' || coalesce(CAST(f.pe AS VARCHAR), ''), c.quote, CAST(c.row_ AS VARCHAR), CAST(c.col AS VARCHAR) FROM cited c JOIN facts f ON c.deal_id = f.deal_id AND c.metric = f.metric AND c.subject = f.subject AND c.ps IS NOT DISTINCT FROM f.ps AND c.pe IS NOT DISTINCT FROM f.pe
UNION ALL SELECT 'evidence', deal_id, doc, 'entity', type || '|' || name, quote, CAST(row_ AS VARCHAR), CAST(col AS VARCHAR) FROM ents
UNION ALL SELECT 'evidence', deal_id, doc, 'relation', type || '|' || s || '|' || t, quote, CAST(row_ AS VARCHAR), CAST(col AS VARCHAR) FROM rels""")
def extracted_rooms(s: S, d: str) -> DataFrame:
    """Facts, entities, aliases, relations and cell evidence of each deal's bank statement, customer list and cap table; ids as names."""
    return listed(extract.extracted(*rooms(s, d)))


def listed(e: extract.Extracted) -> DataFrame:
    """All five tables of an extraction in one, with names for ids."""
    none = F.lit(None).cast("string")
    text = lambda x: x.cast("string")
    row = lambda df, part, *of: df.select(F.lit(part).alias("part"), "deal_id", *(text(v).alias(n) for n, v in zip(("document_id", "type", "name", "other", "a", "b"), of, strict=True)))
    name = e.entities.select(c("entity_id").alias("k"), c("name").alias("label"))
    label = lambda df, key, to: df.join(name.withColumnRenamed("label", to), c(key) == c("k")).drop("k")
    tied = label(label(e.relations, "source_id", "source"), "target_id", "target")
    out = row(e.facts, "fact", c("document_id"), c("metric"), c("subject"), c("value").cast("decimal(24,2)"), c("period_start"), c("period_end"))
    out = out.unionByName(row(e.entities, "entity", none, c("type"), c("name"), none, none, none))
    out = out.unionByName(row(label(e.aliases, "entity_id", "label"), "alias", none, F.lit("bank_account"), c("label"), c("alias"), none, none))
    out = out.unionByName(row(tied, "relation", none, c("type"), c("source"), c("target"), none, none))
    period = [F.coalesce(text(c(p)), F.lit("")) for p in ("period_start", "period_end")]
    told = [e.facts.select("deal_id", c("fact_id").alias("id"), F.lit("fact").alias("of"), F.concat_ws("|", "metric", "subject", *period).alias("said"))]
    told += [e.entities.select("deal_id", c("entity_id").alias("id"), F.lit("entity").alias("of"), F.concat_ws("|", "type", "name").alias("said"))]
    told += [tied.select("deal_id", c("relation_id").alias("id"), F.lit("relation").alias("of"), F.concat_ws("|", "type", "source", "target").alias("said"))]
    targets = told[0].unionByName(told[1]).unionByName(told[2])
    cited = e.evidence.join(targets, (c("kind") == c("of")) & (c("target_id") == c("id")))
    return out.unionByName(row(cited, "evidence", c("document_id"), c("kind"), c("said"), c("quote"), c("row"), c("col")))


@query(f"""WITH {ROOMS}, left_ AS (SELECT deal_id, type, name, count(*) FILTER (NOT (doc LIKE 'cap-%' AND row_ % 3 = 0)) AS n FROM ents GROUP BY ALL),
gone AS (SELECT deal_id, c_name AS name FROM book WHERE c_custkey % 50 = 7)
SELECT 'entity' AS kind, type || '|' || name AS label, deal_id, 'no evidence' AS broken FROM left_ l WHERE n = 0
UNION ALL SELECT 'relation', type || '|' || s || '|' || t, deal_id, 'no evidence' FROM rels WHERE doc LIKE 'cap-%' AND row_ % 3 = 0
UNION ALL SELECT 'fact', 'shares_outstanding|' || company, deal_id, 'no evidence' FROM cap GROUP BY deal_id, company HAVING count(*) FILTER (row_ % 3 <> 0) = 0
UNION ALL SELECT 'relation', 'has_customer|' || company || '|' || c_name, deal_id, 'end is missing' FROM book WHERE c_custkey % 50 = 7
UNION ALL SELECT 'evidence', c_name, deal_id, 'target is missing' FROM book WHERE c_custkey % 50 = 7
UNION ALL SELECT 'fact', 'derived|' || company, deal_id, 'no parent' FROM deals WHERE deal_id % 2 = 0
UNION ALL SELECT 'fact', 'absent-' || deal_id, deal_id, 'parent is missing' FROM deals WHERE deal_id % 2 = 1
UNION ALL SELECT 'evidence', 'stub-' || deal_id, deal_id, b FROM deals, (VALUES ('no place'), ('no target')) v(b)""")
def evidence_audit(s: S, d: str) -> DataFrame:
    """What the audit finds of an extraction out of which evidence and entities were taken, and into which stubs and derived facts without parents were put."""
    e = extract.extracted(*rooms(s, d))
    rows = e.evidence.filter(~(c("document_id").like("cap-%") & (c("row") % 3 == 0)))
    told = rows.select(F.concat_ws("~", "kind", "target_id", "document_id", "row", "col", "quote").alias("evidence_id"), "kind", "target_id", F.lit(None).cast("string").alias("chunk_id"), "table_id", "quote", "document_id")
    own = deals(s, d).select("deal_id", "company")
    n = c("deal_id").cast("string")
    stubs = own.select(F.concat(F.lit("stub-"), n).alias("evidence_id"), *(F.lit(None).cast("string").alias(x) for x in ("kind", "target_id", "chunk_id", "table_id", "quote", "document_id")))
    lost = read(s, d, "customer").filter("c_custkey % 50 = 7").select(c("c_name").alias("name"), F.lit("customer").alias("type"))
    entities = e.entities.join(lost, ["name", "type"], "left_anti")
    derived = own.select(F.concat(F.lit("d"), n).alias("fact_id"), "deal_id", F.lit("derived").alias("metric"), c("company").alias("subject"), F.lit("derived").alias("method"))
    facts = e.facts.select("fact_id", "deal_id", "metric", "subject", F.lit("table").alias("method")).unionByName(derived)
    links = own.filter("deal_id % 2 = 1").select(F.concat(F.lit("d"), n).alias("fact_id"), F.concat(F.lit("absent-"), n).alias("parent_id"))
    found = stored(evidence.audit(facts, entities, e.relations, told.unionByName(stubs), links))
    name = e.entities.select(c("entity_id").alias("k"), c("name").alias("label"))
    tied = e.relations.join(name.select(c("k").alias("source_id"), c("label").alias("s")), "source_id").join(name.select(c("k").alias("target_id"), c("label").alias("t")), "target_id")
    named = facts.select(F.lit("fact").alias("kind"), c("fact_id").alias("id"), "deal_id", F.concat_ws("|", "metric", "subject").alias("label"))
    named = named.unionByName(e.entities.select(F.lit("entity").alias("kind"), c("entity_id").alias("id"), "deal_id", F.concat_ws("|", "type", "name").alias("label")))
    named = named.unionByName(tied.select(F.lit("relation").alias("kind"), c("relation_id").alias("id"), "deal_id", F.concat_ws("|", "type", "s", "t").alias("label")))
    named = named.unionByName(links.select(F.lit("fact").alias("kind"), c("parent_id").alias("id"), F.substring_index("parent_id", "-", -1).cast("int").alias("deal_id"), c("parent_id").alias("label")))
    named = named.unionByName(told.select(F.lit("evidence").alias("kind"), c("evidence_id").alias("id"), F.substring_index("document_id", "-", -1).cast("int").alias("deal_id"), c("quote").alias("label")))
    named = named.unionByName(stubs.select(F.lit("evidence").alias("kind"), c("evidence_id").alias("id"), F.substring_index("evidence_id", "-", -1).cast("int").alias("deal_id"), c("evidence_id").alias("label")))
    return found.join(named, ["kind", "id"]).select("kind", "label", "deal_id", "broken")


@query(r"""WITH q AS (SELECT doc_id, text, doc_id % 7 AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM documents),
e AS (SELECT *, CASE WHEN k = 0 THEN substr(text, 1, 40) WHEN k = 1 THEN '  ' || replace(substr(plain, 1, 30), ' ', '   ') WHEN k = 2 THEN substr(text, 1, 30) || ' never said' WHEN k = 3 THEN ' ' WHEN k = 4 THEN substr(plain, 5, 25) ELSE 'x' END AS quote FROM q)
SELECT doc_id, CASE WHEN k = 5 THEN 'no place' WHEN k = 6 THEN 'chunk not found' WHEN trim(regexp_replace(quote, '\s+', ' ', 'g')) = '' THEN 'empty quote' WHEN NOT contains(plain, trim(regexp_replace(quote, '\s+', ' ', 'g'))) THEN 'quote not in text' END AS reason,
  CASE WHEN k < 5 AND trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(plain, trim(regexp_replace(quote, '\s+', ' ', 'g'))) AND instr(text, quote) > 0 THEN instr(text, quote) - 1 END AS char_start FROM e""")
def evidence_admitted(s: S, d: str) -> DataFrame:
    """Quotes of documents as written, with other white space, altered, blank, without a place and of an unknown chunk: why each is refused, or where it stands."""
    docs = read(s, d, "documents").select("doc_id", "text", (c("doc_id") % 7).alias("k"))
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    quote = F.when(c("k") == 0, F.substring("text", 1, 40)).when(c("k") == 1, F.concat(F.lit("  "), F.replace(F.substring(plain, 1, 30), F.lit(" "), F.lit("   ")))).when(c("k") == 2, F.concat(F.substring("text", 1, 30), F.lit(" never said")))
    quote = quote.when(c("k") == 3, " ").when(c("k") == 4, F.substring(plain, 5, 25)).otherwise("x")
    none = lambda kind: F.lit(None).cast(kind)
    place = F.when(c("k") < 5, c("doc_id")).when(c("k") == 6, -1 - c("doc_id"))
    rows = docs.select(F.lit(1).alias("deal_id"), c("doc_id").alias("evidence_id"), place.alias("chunk_id"), none("string").alias("table_id"), none("int").alias("row"), none("int").alias("col"), quote.alias("quote"))
    chunks = docs.select(F.lit(1).alias("deal_id"), c("doc_id").alias("chunk_id"), "text")
    cells = s.createDataFrame([], "deal_id int, table_id string, row int, col int, text string")
    fine, refused = evidence.admitted(rows, chunks, cells)
    out = fine.select(c("evidence_id").alias("doc_id"), none("string").alias("reason"), c("char_start").cast("long").alias("char_start"))
    return out.unionByName(refused.select(c("evidence_id").alias("doc_id"), "reason", none("long").alias("char_start")))
