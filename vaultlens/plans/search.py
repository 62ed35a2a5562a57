"""Queries over texts: tokens, BM25, vectors, fusion, chunks, classification, names and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import chunking, classify, graph, listing, search, tables
from .adapters import chunks, deals, read

S = SparkSession
QUERIES: dict = {}
#: Of the demonstration queries: words that the test texts have, one of them twice, so that multiplicity counts.
ASKED = "the thing of eau und thing license"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


INDEXES: dict[tuple[str, str, int], search.Index] = {}


def index(s: S, d: str) -> search.Index:
    """The index of the documents of a folder, built on the first question of a session and kept in the shared folder; when the folder's files have changed, it is built anew."""
    folder = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    listed, state = folder.getFileSystem(s._jsc.hadoopConfiguration()).listFiles(folder, True), set()
    while listed.hasNext():
        f = listed.next()
        state.add((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = (s.sparkContext.applicationId, d, hash(frozenset(state)))
    if key not in INDEXES:
        INDEXES[key] = search.build_index(chunks(s, d), f"{graph.shared_folder(s)}/index-{uuid.uuid4().hex}", ["lang"])
    return INDEXES[key]


TOKENS = "toks AS (SELECT doc_id AS chunk_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"
STATS = f"""{TOKENS}, n AS (SELECT count(*) AS n, avg(len(t)) AS ml FROM toks), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(t) AS term FROM toks) GROUP BY term),
mi AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mean_idf FROM df, n)"""
BM25 = f"""{STATS}, q AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{ASKED}', '[a-z0-9]+')) AS term) GROUP BY term),
w AS (SELECT q.term, times, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf FROM q JOIN df USING (term), n, mi),
tf AS (SELECT chunk_id, lang, len(t) AS size, term, len(list_filter(t, lambda x: x = term)) AS tf FROM toks, (SELECT term FROM w)),
s AS (SELECT chunk_id, any_value(lang) AS lang, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / ml))), 6) AS bm25_score FROM tf JOIN w USING (term), n GROUP BY chunk_id)"""
TOP = "SELECT chunk_id, bm25_score, row_number() OVER (ORDER BY bm25_score DESC, chunk_id) AS bm25_rank FROM s WHERE bm25_score > 0"


@query(f"WITH {TOKENS}, e AS (SELECT lang, unnest(t) AS term FROM toks) SELECT lang, term, count(*) AS n FROM e GROUP BY ALL")
def tokenize_counts(s: S, d: str) -> DataFrame:
    return chunks(s, d).select("lang", F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATS} SELECT n, round(ml, 6) AS mean_length, round(mean_idf, 6) AS mean_idf FROM n, mi")
def bm25_corpus_stats(s: S, d: str) -> DataFrame:
    return search.corpus_stats(chunks(s, d)).select("n", F.round("mean_length", 6).alias("mean_length"), F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {BM25} {TOP} ORDER BY bm25_rank LIMIT 50")
def bm25_topk(s: S, d: str) -> DataFrame:
    return search.ask_bm25(index(s, d), ASKED)


@query(f"WITH {BM25} {TOP} AND lang = 'en' ORDER BY bm25_rank LIMIT 50")
def bm25_topk_filtered(s: S, d: str) -> DataFrame:
    return search.ask_bm25(index(s, d), ASKED, F.col("lang") == "en")


def _bins(of: str) -> str:
    return f"SELECT {of}, CAST('0x' || substr(sha256(term), 1, 2) AS BIGINT) AS bin, CASE WHEN CAST('0x' || substr(sha256(term), 10, 1) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign"


DENSE = f"""v0 AS ({_bins('chunk_id')} FROM (SELECT chunk_id, unnest(t) AS term FROM toks)), v AS (SELECT chunk_id, bin, sum(sign)::DOUBLE AS x FROM v0 GROUP BY ALL),
qv AS (SELECT bin, sum(sign)::DOUBLE AS y FROM ({_bins('1 AS one')} FROM (SELECT unnest(regexp_extract_all('{ASKED}', '[a-z0-9]+')) AS term)) GROUP BY bin),
ds AS (SELECT t.chunk_id, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x)), 0) / (SELECT sqrt(sum(y * y)) FROM qv), 0), 6) AS dense_score FROM toks t LEFT JOIN v USING (chunk_id) LEFT JOIN qv USING (bin) GROUP BY t.chunk_id),
dt AS (SELECT chunk_id, dense_score, row_number() OVER (ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM ds)"""


@query(f"WITH {TOKENS}, e AS (SELECT DISTINCT unnest(t) AS term FROM toks) {_bins('term')} FROM e")
def hash_embedding_bins(s: S, d: str) -> DataFrame:
    """In the plan alone: the bin is the first byte of the digest, the sign the lowest bit of its fifth."""
    terms = chunks(s, d).select(F.explode(text.tokenize(F.col("text"))).alias("term")).distinct()
    digest = F.sha2("term", 256)
    sign = F.when(F.conv(F.substring(digest, 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return terms.select("term", F.conv(F.substring(digest, 1, 2), 16, 10).cast("long").alias("bin"), sign.alias("sign"))


@query(f"WITH {TOKENS}, {DENSE} SELECT * FROM dt ORDER BY dense_rank LIMIT 50")
def dense_topk_hash(s: S, d: str) -> DataFrame:
    return search.ask_dense(index(s, d), ASKED)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(e, e)), 6) AS dense_score FROM embeddings, q)
SELECT chunk_id, dense_score, row_number() OVER (ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM v ORDER BY dense_rank LIMIT 50""")
def dense_topk_vectors(s: S, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    asked = vectors.filter("chunk_id = 7").select("embedding").first()[0]
    return search.dense(vectors, asked, F.col("embedding"))


HYBRID = f"""{BM25}, {DENSE}, l AS (SELECT chunk_id, bm25_rank FROM ({TOP}) x WHERE bm25_rank <= 50), h AS (SELECT chunk_id, bm25_rank, dense_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 9) AS score
 FROM l FULL JOIN (SELECT chunk_id, dense_rank FROM dt WHERE dense_rank <= 50) r USING (chunk_id))"""


@query(f"WITH {HYBRID} SELECT chunk_id, score, bm25_rank, dense_rank FROM h ORDER BY score DESC, chunk_id LIMIT 10")
def search_hybrid(s: S, d: str) -> DataFrame:
    return search.ask(index(s, d), ASKED)


@query(f"""WITH {HYBRID}, k AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM h ORDER BY rank LIMIT 10)
SELECT chunk_id, CASE rank WHEN 6 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE rank END AS rank FROM k""")
def rerank_permutation(s: S, d: str) -> DataFrame:
    hits = search.ask(index(s, d), ASKED)
    ranked = hits.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    return search.reranked(ranked, [5, 2, 2, -1, 0])


@query("""WITH r AS (SELECT o_custkey AS table_id, o_orderkey AS row_, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ', ' || o_orderstatus || ', ' || o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
h AS (SELECT table_id, text AS header FROM r WHERE n = 1)
SELECT table_id, CAST(floor((n - 2) / 25) AS INTEGER) AS group_no, min(row_) AS row_start, max(row_) AS row_end, any_value(header) || chr(10) || string_agg(text, chr(10) ORDER BY row_) AS text FROM r JOIN h USING (table_id) WHERE n > 1 GROUP BY ALL
UNION ALL SELECT table_id, 0, min(row_), min(row_), any_value(text) FROM r GROUP BY table_id HAVING count(*) = 1""")
def table_chunks_25(s: S, d: str) -> DataFrame:
    rows = read(s, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row"), F.concat_ws(", ", F.to_date("o_orderdate").cast("string"), "o_orderstatus", "o_orderpriority").alias("text"))
    headed = rows.withColumn("is_header", F.row_number().over(Window.partitionBy("table_id").orderBy("row")) == 1)
    return chunking.table_chunks(headed)


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\.\s|\n)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents), u AS (SELECT doc_id, list_filter(s, lambda x: x <> '') AS s FROM p),
e AS (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS i FROM u), o AS (SELECT doc_id, i - 1 AS position, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS char_end, length(piece) AS n FROM e)
SELECT doc_id, position, char_end - n AS char_start, char_end FROM o""")
def sentence_spans(s: S, d: str) -> DataFrame:
    return chunking.sentence_spans(read(s, d, "documents").select("doc_id", "text"))


@query()
def prose_chunks(s: S, d: str) -> DataFrame:
    """Greedy chunks have no SQL form; their properties are tested."""
    pages = read(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text")
    return chunking.prose(pages)


@query("""WITH x AS (SELECT page_id, lower(html) AS t FROM pages), c AS (SELECT page_id, t, len(regexp_extract_all(t, 'shareholder|shares|fully[ _-]diluted|preferred|common')) AS c1, len(regexp_extract_all(t, 'debit|credit|balance|account[ _-]?number|routing')) AS c2, len(regexp_extract_all(t, 'customer|mrr|arr|segment')) AS c3,
  len(regexp_extract_all(t, 'revenue|cogs|ebitda|gross[ _-]profit|opex')) AS c4, len(regexp_extract_all(t, 'whereas|party|termination|governing[ _-]law|confidential')) AS c5, len(regexp_extract_all(t, 'litigation|plaintiff|defendant|settlement')) AS c6 FROM x), m AS (SELECT *, greatest(c1, c2, c3, c4, c5, c6) AS hits FROM c)
SELECT page_id, CASE WHEN hits = 0 THEN 'other' WHEN c1 = hits THEN 'cap_table' WHEN c2 = hits THEN 'bank_statement' WHEN c3 = hits THEN 'customer_list' WHEN c4 = hits THEN 'financial_statement' WHEN c5 = hits THEN 'contract' ELSE 'legal' END AS doc_type, CASE WHEN hits = 0 THEN 0.3::DOUBLE ELSE least(0.95::DOUBLE, round(0.4::DOUBLE + hits * 0.15::DOUBLE, 2)) END AS confidence FROM m""")
def classify_content_rules(s: S, d: str) -> DataFrame:
    return classify.classified(read(s, d, "pages").select("page_id", F.lit("page.html").alias("filename"), F.col("html").alias("text")), "page_id")


@query("""WITH v AS (SELECT 'orderdate' AS header, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'price', CAST(CAST(o_totalprice AS DECIMAL(24,2)) AS VARCHAR) FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'key', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'share', CAST(o_custkey % 100 AS VARCHAR) || '%' FROM orders)
SELECT DISTINCT header, CASE header WHEN 'orderdate' THEN 'date' WHEN 'price' THEN 'currency' WHEN 'status' THEN 'text' WHEN 'key' THEN 'numeric' ELSE 'percent' END AS type FROM v""")
def column_type_inference(s: S, d: str) -> DataFrame:
    o = read(s, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("orderdate"), F.col("o_totalprice").cast("decimal(24,2)").cast("string").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("key"), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("share"))
    return tables.column_types(o.unpivot([], o.columns, "header", "value"), ["header"])


@query(r"""WITH n AS (SELECT DISTINCT s_name || ' Inc.' AS name FROM supplier UNION SELECT DISTINCT p_name || ', Ltd' FROM part)
SELECT name, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('inc','incorporated','llc','llp','corp','corporation','co','company','ltd','limited','gmbh','sas','plc')), ' ') AS norm FROM n""")
def entity_normalize(s: S, d: str) -> DataFrame:
    names = read(s, d, "supplier").select(F.concat("s_name", F.lit(" Inc.")).alias("name")).union(read(s, d, "part").select(F.concat("p_name", F.lit(", Ltd")).alias("name"))).distinct()
    return names.select("name", text.comparison_name(F.col("name"), True).alias("norm"))


def named_parts(s: S, d: str) -> DataFrame:
    part = read(s, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return part.select(F.lit(1).alias("deal_id"), F.col("p_type").alias("type"), F.col("p_partkey").alias("entity_id"), name.alias("name"), F.col("p_partkey").alias("seq"))


NAMED = r"""e AS (SELECT p_partkey AS id, p_type AS type, regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || p_brand END), '[^\w\s]', ' ', 'g') AS norm FROM part),
w AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS t FROM e),
pairs AS (SELECT a.type, a.id AS a, b.id AS b FROM w a JOIN w b ON a.type = b.type AND a.id < b.id WHERE a.norm = b.norm OR list_has_all(a.t, b.t) OR list_has_all(b.t, a.t))"""


@query()
def entity_resolution_pairs(s: S, d: str) -> DataFrame:
    """Pairs of distinct names, and of equal names with the first of them; the ratio itself has no SQL form."""
    return graph.resolution_pairs(named_parts(s, d)).select("type", "a", "b")


@query(f"""WITH RECURSIVE {NAMED}, way AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), c AS (SELECT id AS node, id AS root FROM w WHERE id IN (SELECT a FROM way) UNION SELECT way.b, c.root FROM c JOIN way ON way.a = c.node)
SELECT node, min(root) AS root FROM c GROUP BY node""")
def entity_resolution_components(s: S, d: str) -> DataFrame:
    return graph.groups(graph.resolution_pairs(named_parts(s, d), 100.0))


def relations(s: S, d: str) -> DataFrame:
    """Suppliers and customers of the nations: (type, source_id, target_id, confidence)."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    c = read(s, d, "customer").select(F.lit("has_customer").alias("type"), key("n", "c_nationkey").alias("source_id"), key("c", "c_custkey").alias("target_id"))
    return c.union(read(s, d, "supplier").select(F.lit("supplied_by"), key("n", "s_nationkey"), key("s", "s_suppkey"))).withColumn("confidence", F.lit(0.9))


EDGES = "edges AS (SELECT 'has_customer' AS type, 'n' || c_nationkey AS source_id, 'c' || c_custkey AS target_id FROM customer UNION ALL SELECT 'supplied_by', 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def nodes(s: S, d: str) -> DataFrame:
    n = deals(s, d).select(F.concat(F.lit("n"), F.col("deal_id").cast("string")).alias("entity_id"), F.lit("company").alias("type"), F.col("company").alias("name"), F.col("deal_id").cast("long").alias("seq"))
    c = read(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("customer"), "c_name", (F.col("c_custkey") + 1000).alias("seq"))
    return n.union(c).withColumn("merged_into", F.when(F.col("seq") % 10 == 9, F.lit("n0")))


NODES = "nodes AS (SELECT 'n' || n_nationkey AS entity_id, 'company' AS type, n_name AS name, n_nationkey::BIGINT AS seq FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, c_custkey + 1000 FROM customer)"


@query(f"WITH {EDGES} SELECT type, source_id, target_id FROM edges")
def graph_edges(s: S, d: str) -> DataFrame:
    return relations(s, d).select("type", "source_id", "target_id")


@query("""WITH c AS (SELECT c_custkey AS document_id, n_name AS company, c_name AS party, 'MSA ' || c_name AS contract FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT document_id, 'has_contract' AS type, company AS source, contract AS target FROM c UNION ALL SELECT document_id, 'has_customer', company, party FROM c UNION ALL SELECT document_id, 'has_contract', party, contract FROM c""")
def contract_graph_edges(s: S, d: str) -> DataFrame:
    """A contract between each customer and its nation's company, whose parties are read out of its text."""
    of = deals(s, d).select("deal_id", "company")
    customers = read(s, d, "customer").select(F.col("c_nationkey").alias("deal_id"), F.col("c_custkey").alias("document_id"), "c_name")
    said = F.concat(F.lit("This agreement is made between "), F.col("company"), F.lit(" and "), F.col("c_name"), F.lit(". It is governed by law."))
    papers = customers.join(of, "deal_id").select("deal_id", "document_id", F.concat(F.lit("MSA_"), F.col("c_name"), F.lit(".pdf")).alias("filename"), said.alias("text"), "company")
    return graph.contract_graph(papers)[1].select("document_id", "type", "source", "target")


@query(f"WITH {EDGES}, {NODES}, k AS (SELECT entity_id FROM nodes WHERE seq % 10 <> 9 ORDER BY seq, entity_id LIMIT 500) SELECT type, source_id, target_id FROM edges WHERE source_id IN (FROM k) AND target_id IN (FROM k)")
def graph_live_filter(s: S, d: str) -> DataFrame:
    return graph.live_graph(nodes(s, d), relations(s, d))[1].select("type", "source_id", "target_id")


@query(f"WITH {NODES} SELECT entity_id, type, name FROM nodes WHERE seq % 10 <> 9 AND type IN ('customer') ORDER BY seq, entity_id LIMIT 100")
def deal_graph_limit(s: S, d: str) -> DataFrame:
    return graph.live_graph(nodes(s, d), relations(s, d), 100, ["customer"])[0].select("entity_id", "type", "name")


@query(f"""WITH {EDGES}, {NODES}, r AS (SELECT id, count(*) AS relations FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id), f AS (SELECT 'c' || o_custkey AS id, count(*) AS facts FROM orders GROUP BY 1)
SELECT entity_id, name, coalesce(relations, 0) AS relations, coalesce(facts, 0) AS facts, lower(name) AS aliases FROM nodes LEFT JOIN r ON r.id = entity_id LEFT JOIN f ON f.id = entity_id WHERE seq % 10 <> 9""")
def entity_detail(s: S, d: str) -> DataFrame:
    n = nodes(s, d)
    facts = read(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.lit(None).cast("string").alias("superseded_by"))
    out = graph.entity_detail(n, n.select("entity_id", F.lower("name").alias("alias")), relations(s, d), facts)
    return out.select("entity_id", "name", "relations", "facts", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {EDGES} SELECT type, source_id, CASE WHEN target_id LIKE 'c%' THEN 'c' || (CAST(substr(target_id, 2) AS BIGINT) // 10 * 10 + 1) ELSE target_id END AS target_id, count(*) AS evidence FROM edges GROUP BY ALL")
def merge_repoint_relations(s: S, d: str) -> DataFrame:
    c = read(s, d, "customer").select("c_custkey", (F.floor(F.col("c_custkey") / 10) * 10 + 1).alias("to")).filter("to <> c_custkey")
    merged = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.concat(F.lit("c"), F.col("to").cast("string")).alias("merged_into"))
    return graph.repointed(relations(s, d), merged).select("type", "source_id", "target_id", "evidence")


@query(r"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+')) AS address FROM documents) SELECT DISTINCT doc_id, lower(address) AS address FROM e")
def email_addresses(s: S, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.MAILBOX), 0)).alias("address")).select("doc_id", F.lower("address").alias("address")).distinct()


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\d{8,})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE regexp_matches(text, '\d{8}'))
SELECT doc_id, sha256(array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '\d{8,}') THEN repeat('*', length(x) - 2) || right(x, 2) ELSE x END), '')) AS redacted FROM p""")
def account_redaction(s: S, d: str) -> DataFrame:
    return read(s, d, "documents").filter(F.col("text").rlike(r"\d{8}")).select("doc_id", F.sha2(text.redacted(F.col("text")), 256).alias("redacted"))


@query("SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 51")
def keyset_page_facts(s: S, d: str) -> DataFrame:
    return listing.page(read(s, d, "orders"), ["o_orderdate", "o_orderkey"], ["1997-01-01", 100]).select("o_orderdate", "o_orderkey", "o_totalprice")


@query("""WITH d AS (SELECT source, CASE WHEN doc_id % 400 = 3 THEN 'queued' ELSE 'parsed' END AS status, CASE WHEN source = 'src9' THEN 0 ELSE 1 END AS chunks, doc_id % 97 AS changed FROM documents)
SELECT source, CASE WHEN count(*) FILTER (status = 'queued') > 0 THEN 'indexing' WHEN sum(chunks) = 0 THEN 'empty' WHEN max(changed) > 95 THEN 'stale' ELSE 'ready' END AS status, sum(chunks)::BIGINT AS chunks FROM d GROUP BY source""")
def index_status(s: S, d: str) -> DataFrame:
    at = lambda c: F.timestamp_seconds(c)
    rows = read(s, d, "documents").select("source", F.when(F.col("doc_id") % 400 == 3, "queued").otherwise("parsed").alias("status"), F.when(F.col("source") == "src9", 0).otherwise(1).alias("chunks"), at(F.col("doc_id") % 97).alias("changed_at"), at(F.lit(95)).alias("indexed_at"))
    return search.index_status(rows, ["source"])


@query("""SELECT n_nationkey AS deal_id, coalesce(n, 0) AS document_count, coalesce(k, 0) AS open_contradictions FROM nation LEFT JOIN (SELECT o_custkey % 30 AS x, count(*) AS n FROM orders GROUP BY 1) a ON a.x = n_nationkey LEFT JOIN (SELECT o_custkey % 30 AS x, count(*) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.x = n_nationkey""")
def deal_summary_counts(s: S, d: str) -> DataFrame:
    rows = read(s, d, "orders").select((F.col("o_custkey") % 30).alias("deal_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    return listing.deal_summary(deals(s, d), rows, rows).select("deal_id", "document_count", "open_contradictions")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def metric_facets(s: S, d: str) -> DataFrame:
    return listing.facets(read(s, d, "documents"), "lang")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(s: S, d: str) -> DataFrame:
    return listing.facets(read(s, d, "events"), "event_type")


@query("""WITH f AS (SELECT source AS deal_id, sha256(text) AS sha256, octet_length(encode(text)) AS size, doc_id AS seq FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY deal_id, sha256 ORDER BY seq) = 1 AS first FROM f),
u AS (SELECT *, sum(CASE WHEN size <= 20000 AND first AND seq % 50 <> 0 THEN size ELSE 0 END) OVER (PARTITION BY deal_id ORDER BY seq) AS used FROM r)
SELECT seq, CASE WHEN seq % 50 = 0 THEN 'duplicate' WHEN size > 20000 THEN 'too large' WHEN used > 60000 THEN 'over quota' WHEN NOT first THEN 'shared' ELSE 'new' END AS status FROM u""")
def upload_quota_dedupe(s: S, d: str) -> DataFrame:
    files = read(s, d, "documents").select(F.col("source").alias("deal_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"), F.col("doc_id").alias("seq"))
    return listing.accepted_uploads(files, files.filter("seq % 50 = 0"), 60_000, 20_000).select("seq", "status")


@query("""WITH g AS (SELECT o_custkey AS table_id, CAST(o_orderkey % 7 AS INTEGER) AS row_, CAST(o_orderkey % 5 AS INTEGER) AS col, min(o_orderpriority) AS text FROM orders GROUP BY ALL), z AS (SELECT table_id, max(row_) AS r, max(col) AS c FROM g GROUP BY table_id),
x AS (SELECT z.table_id, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col FROM z, range(0, 7) a(i), range(0, 5) b(j) WHERE i <= r AND j <= c)
SELECT x.table_id, x.row, string_agg(coalesce(text, '-'), '|' ORDER BY x.col) AS cells FROM x LEFT JOIN g ON g.table_id = x.table_id AND g.row_ = x.row AND g.col = x.col GROUP BY ALL""")
def dense_matrix(s: S, d: str) -> DataFrame:
    cells = read(s, d, "orders").groupBy(F.col("o_custkey").alias("table_id"), (F.col("o_orderkey") % 7).cast("int").alias("row"), (F.col("o_orderkey") % 5).cast("int").alias("col")).agg(F.min("o_orderpriority").alias("text"))
    return listing.matrix(cells).select("table_id", "row", F.array_join("cells", "|", "-").alias("cells"))


@query("""WITH h AS (SELECT source AS question_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
s AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(substr(text, 1, 600)), '[a-z0-9]+')), ['the', 'de', 'und', 'of', 'la'])) AS had FROM h)
SELECT question_id, doc_id, CASE WHEN rank <= 30 THEN row_number() OVER (PARTITION BY question_id, rank <= 30 ORDER BY had DESC, rank) ELSE rank END AS rank FROM s""")
def rerank_pools(s: S, d: str) -> DataFrame:
    """A question to each source, whose documents by number are the hits: the first 30 by the question's words, the rest as they were."""
    docs = read(s, d, "documents").select(F.col("source").alias("question_id"), F.lit("the DE und, of la").alias("query"), "doc_id", "text")
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")).cast("long"))
    return search.listwise(hits, k=30).select("question_id", "doc_id", "rank")


@query()
def document_chunks(s: S, d: str) -> DataFrame:
    """All chunks of documents: their lines as blocks of a page, and the suppliers of nations as tables of the documents of the same numbers."""
    docs = read(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.when(F.col("doc_id") % 3 == 0, "pptx").when(F.col("doc_id") % 3 == 1, "eml").otherwise("txt").alias("ext"))
    lines = docs.select("document_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("order", "text"))
    blocks = lines.select("document_id", "page_no", "order", F.concat_ws("/", F.col("document_id").cast("string"), F.col("order").cast("string")).alias("block_id"), F.lit("paragraph").alias("kind"), "text")
    supplier = read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("document_id"), (F.col("s_suppkey") + 1).cast("int").alias("row"), F.concat_ws(", ", "s_name", F.col("s_acctbal").cast("string")).alias("text"), F.lit(False).alias("is_header"))
    heads = supplier.select("document_id").distinct().select("document_id", F.lit(0).alias("row"), F.lit("Supplier, Balance").alias("text"), F.lit(True).alias("is_header"))
    rows = supplier.unionByName(heads).select("document_id", F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("block_id"), F.concat(F.lit("t"), F.col("document_id").cast("string")).alias("table_id"), "row", "text", "is_header")
    return chunking.document_chunks(docs.select("document_id", "ext"), blocks, rows).select("document_id", "page_no", "kind", "chunk_no", "char_start", "char_end", "token_count", "text_hash", F.size("block_ids").alias("blocks"), "table_id", "row_start", "row_end")
