"""Queries of the retrieval pipeline, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens import engine, lifecycle
from foliolens.functions.models import chat, embedding
from foliolens.functions.text import clean_text, nfc, sentences, words
from foliolens.functions.vectors import l2_norm, l2_normalize, usable
from foliolens.operators import answers, catalog, retrieve
from foliolens.operators.intervals import coalesced
from foliolens.operators.pages import hard_split, page_offsets, pair_windows
from foliolens.sources.tables import distinct_rows, file_extension, resolve_mime, table, written
from foliolens.streaming import jobs

QUERIES, SQL = {}, {}
STEPS = ["QUEUED", "RETRIEVING", "RERANKING", "ANSWERING", "COMPLETED"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, base):
    return table(spark, base, "documents")


def _catalog(spark, base):
    return distinct_rows(table(spark, base, "doc_catalog"), "id")


def _chunks(spark, base):
    return distinct_rows(table(spark, base, "chunks"), "chunk_id")


def _asked(spark, base):
    """The stated query set: questions with an id divisible by 20 and some text."""
    q = table(spark, base, "questions").filter("query_id % 20 = 0 and length(trim(text)) > 0")
    return q.select("query_id", F.col("text").alias("text"))


def _all_asked(spark, base):
    """All questions with some text."""
    return table(spark, base, "questions").filter("query_id is not null and length(trim(text)) > 0").select("query_id", "text")


#: The SQL has its own constants, so that it can disagree with the library's.
_CF = r"[\x{0600}-\x{0605}\x{061C}\x{06DD}\x{070F}\x{0890}-\x{0891}\x{08E2}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
_RUN = r"[ \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"
_SHORT = r"Dr|Mr|Mrs|Ms|Prof|Sr|Jr|Inc|Ltd|Corp|Co|St|Ave|Blvd|Rd|etc|vs|eg|ie|cf|ca|approx|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Mon|Tue|Wed|Thu|Fri|Sat|Sun|U\.S\.A|U\.K|U\.N"


def _page(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[\r\n\x{{00A0}}]', ' ', 'g'), '\x{{00AD}}', '', 'g'), '{_CF}', ' ', 'g'), '\p{{Cc}}', '', 'g'), '{_RUN}', ' ', 'g')"


def _sentences_sql(c: str) -> str:
    """Look-behind said without look-behind: mark every break, take the mark away behind short forms, split."""
    sep = "chr(31)"
    marked = rf"regexp_replace({c}, '([.!?])\s+([\"''\p{{Lu}}])', '\1' || {sep} || '\2', 'g')"
    return rf"string_split(regexp_replace({marked}, '(\b(?:{_SHORT})\.)' || {sep}, '\1 ', 'g'), {sep})"


CLEAN = f"coalesce(trim({_page('text')}), '')"
WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def clean_documents(spark, base):
    return _docs(spark, base).select("doc_id", clean_text(F.col("text")).alias("clean"))


@query(f"SELECT DISTINCT chunk_id, {CLEAN} AS clean FROM chunks")
def clean_chunks(spark, base):
    return _chunks(spark, base).select("chunk_id", clean_text(F.col("text")).alias("clean"))


@query("SELECT DISTINCT chunk_id, nfc_normalize(text) AS nfc FROM chunks")
def nfc_chunks(spark, base):
    return _chunks(spark, base).select("chunk_id", nfc(F.col("text")).alias("nfc"))


@query(r"SELECT DISTINCT id, coalesce(lower(trim(regexp_extract(title, '(\.[^.]*)$', 1))), '') AS ext FROM doc_catalog")
def file_extensions(spark, base):
    return _catalog(spark, base).select("id", file_extension(F.col("title")).alias("ext"))


@query(r"""
SELECT DISTINCT id, coalesce(nullif(trim(CASE WHEN status = 'QUEUED' THEN '' ELSE mime END), ''), CASE lower(trim(regexp_extract(blob_path, '(\.[^.]*)$', 1)))
 WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' WHEN '.html' THEN 'text/html' WHEN '.tif' THEN 'image/tiff'
 WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END, 'application/octet-stream') AS mime FROM doc_catalog""")
def mime_types(spark, base):
    """Media types where those of queued documents are not stated yet."""
    stated = F.when(F.col("status") == "QUEUED", "").otherwise(F.col("mime"))
    return _catalog(spark, base).select("id", resolve_mime(stated, F.col("blob_path")).alias("mime"))


@query("SELECT DISTINCT id, title, size_bytes FROM doc_catalog WHERE size_bytes <= 524288000")
def accepted_uploads(spark, base):
    return _catalog(spark, base).filter("size_bytes <= 524288000").select("id", "title", "size_bytes")


def _lines(spark, base):
    """Documents with their lines as pages."""
    return _docs(spark, base).filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


LINEAGE = rf"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, page, {_page('t')} AS c FROM l),
b AS (SELECT doc_id, page, c, last_value(CASE WHEN length(c) > 0 THEN right(c, 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT doc_id, page, CASE WHEN left(c, 1) = ' ' AND coalesce(before, ' ') = ' ' THEN substr(c, 2) ELSE c END AS c FROM b),
m AS (SELECT doc_id, page, c, coalesce(max(length(c)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS more FROM g),
h AS (SELECT doc_id, page, CASE WHEN more = 0 THEN rtrim(c, ' ') ELSE c END AS c FROM m),
pl AS (SELECT doc_id, CAST(page AS INTEGER) AS page, c AS clean, CAST(sum(length(c)) OVER w - length(c) AS BIGINT) AS "start", CAST(sum(length(c)) OVER w AS BIGINT) AS "end" FROM h WHERE length(c) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY page))"""


@query(f"WITH {LINEAGE} SELECT * FROM pl")
def page_lineage(spark, base):
    return page_offsets(_lines(spark, base)).withColumn("page", F.col("page").cast("int"))


@query(f"""
WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents), s AS (SELECT doc_id, {_sentences_sql('t')} AS s FROM c WHERE length(t) > 0)
SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM s""")
def sentence_split(spark, base):
    return _docs(spark, base).select("doc_id", F.posexplode(sentences(clean_text(F.col("text")))).alias("pos", "sentence"))


@query("""
WITH d AS (SELECT doc_id, text, unnest(range(0, CAST(ceil((length(text) - 2000) / 1800.0) AS INTEGER) + 1)) * 1800 AS s FROM documents WHERE length(text) > 2000)
SELECT doc_id, CAST(s AS INTEGER) AS "start", substr(text, CAST(s + 1 AS INTEGER), 2000) AS piece FROM d""")
def hard_split_windows(spark, base):
    return hard_split(_docs(spark, base), "doc_id")


#: Units are sentences or windows of long ones; each step adds one and closes the chunk before it, or its own, or both.
PACKED = rf"""
{LINEAGE},
d AS (SELECT doc_id, string_agg(clean, '' ORDER BY page) AS t, CAST(max("end") AS BIGINT) AS size FROM pl GROUP BY doc_id),
s0 AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS s FROM (SELECT doc_id, {_sentences_sql('t')} AS s FROM d)),
s1 AS (SELECT doc_id, i, length(s) AS n, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS a FROM s0),
s2 AS (SELECT doc_id, i, n > 2000 AS long, a, n, unnest(CASE WHEN n > 2000 THEN range(0, CAST(ceil((n - 2000) / 1800.0) AS BIGINT) + 1) ELSE [0] END) AS w FROM s1),
unit AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, w) AS k, long, w = 0 AS first, CAST(a + 1800 * w AS BIGINT) AS a, CAST(CASE WHEN long THEN least(a + 1800 * w + 2000, a + n) ELSE a + n END AS BIGINT) AS b FROM s2),
r AS (
 SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS sa, CAST(NULL AS BIGINT) AS sb, '' AS lead, CAST([] AS STRUCT(body VARCHAR, a BIGINT, b BIGINT)[]) AS out FROM d
 UNION ALL
 SELECT doc_id, k, CASE WHEN long THEN NULL ELSE coalesce(CASE WHEN NOT pre THEN sa END, a) END, CASE WHEN long THEN NULL ELSE b END, CASE WHEN long THEN right(body2, 200) ELSE lead1 END,
  CASE WHEN pre THEN [{{'body': body1, 'a': CAST(a1 AS BIGINT), 'b': CAST(b1 AS BIGINT)}}] ELSE [] END || CASE WHEN long THEN [{{'body': body2, 'a': CAST(greatest(0, a - length(lead1)) AS BIGINT), 'b': b}}] ELSE [] END
 FROM (SELECT *, CASE WHEN lead1 <> '' THEN lead1 || ' ' ELSE '' END || substr(t, a + 1, b - a) AS body2 FROM (
  SELECT *, CASE WHEN pre THEN right(body1, 200) ELSE lead END AS lead1 FROM (
   SELECT r.doc_id, u.k, u.long, u.a, u.b, r.sa, r.sb, r.lead, d.t,
    (r.sa IS NOT NULL OR r.lead <> '') AND CASE WHEN u.long THEN u.first ELSE coalesce(r.sb - r.sa + 1, 0) + u.b - u.a + length(r.lead) > 2000 END AS pre,
    CASE WHEN r.sa IS NULL THEN r.lead ELSE CASE WHEN r.lead <> '' THEN r.lead || ' ' ELSE '' END || substr(d.t, r.sa + 1, r.sb - r.sa) END AS body1,
    CASE WHEN r.sa IS NULL THEN greatest(0, d.size - length(r.lead)) ELSE greatest(0, r.sa - length(r.lead)) END AS a1, coalesce(r.sb, d.size) AS b1
   FROM r JOIN unit u ON u.doc_id = r.doc_id AND u.k = r.k + 1 JOIN d ON d.doc_id = r.doc_id)))),
o AS (
 SELECT doc_id, k, 0 AS z, unnest(range(0, len(out))) AS j, unnest(out, recursive := true) FROM r
 UNION ALL
 SELECT r.doc_id, r.k, 1, 0, CASE WHEN r.sa IS NULL THEN r.lead ELSE CASE WHEN r.lead <> '' THEN r.lead || ' ' ELSE '' END || substr(d.t, r.sa + 1, r.sb - r.sa) END,
  CASE WHEN r.sa IS NULL THEN greatest(0, d.size - length(r.lead)) ELSE greatest(0, r.sa - length(r.lead)) END, coalesce(r.sb, d.size)
 FROM r JOIN d USING (doc_id) WHERE r.k = (SELECT max(k) FROM unit WHERE unit.doc_id = r.doc_id) AND (r.sa IS NOT NULL OR r.lead <> '')),
n AS (SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY k, z, j) - 1 AS seq, trim(body) AS text, least(a, size - 1) AS x, greatest(b - 1, a) AS y FROM o JOIN d USING (doc_id)),
packed AS (SELECT CAST(n.doc_id AS VARCHAR) AS doc_id, n.doc_id || '_' || lpad(CAST(seq AS VARCHAR), 5, '0') || '_p' || p.page || '-' || q.page AS chunk_id, n.text, p.page AS page_start, q.page AS page_end
 FROM n ASOF JOIN pl p ON n.doc_id = p.doc_id AND n.x >= p.start ASOF JOIN pl q ON n.doc_id = q.doc_id AND n.y >= q.start)"""


@query(f"WITH RECURSIVE {PACKED} SELECT * FROM packed")
def chunk_documents(spark, base):
    """Chunks of cleaned documents with page spans, lines as pages."""
    return lifecycle.pages_to_chunks(_lines(spark, base))


@query(f"""
WITH RECURSIVE {PACKED}, own AS (SELECT DISTINCT doc_id, catalog_id FROM documents WHERE catalog_id IS NOT NULL), num AS (SELECT catalog_id AS id, count(*) AS chunks FROM packed JOIN own ON CAST(own.doc_id AS VARCHAR) = packed.doc_id GROUP BY 1),
cat AS (SELECT DISTINCT id, title, embed_model FROM doc_catalog WHERE id IN (SELECT catalog_id FROM own))
SELECT id, title, CAST(coalesce(num.chunks, 0) AS INTEGER) AS chunks, CASE WHEN num.chunks IS NULL THEN embed_model ELSE 'hashed-64' END AS embed_model, CASE WHEN num.chunks IS NULL THEN 'FAILED' ELSE 'INDEXED' END AS status FROM cat LEFT JOIN num USING (id)""")
def reindex_documents(spark, base):
    """The catalog after its documents' texts were composed, cleaned, cut and indexed anew."""
    own = _docs(spark, base).filter("catalog_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "catalog_id")
    chunks = lifecycle.pages_to_chunks(_lines(spark, base)).join(own, "doc_id").select(F.col("catalog_id").alias("doc_id"), "chunk_id")
    listed = _catalog(spark, base).join(own.select(F.col("catalog_id").alias("id")), "id", "left_semi")
    return lifecycle.reindexed(listed.select("id", "title", "chunks", "embed_model", "last_indexed_at", "status"), chunks, "hashed-64").drop("last_indexed_at")


def _vectors(spark, base):
    return table(spark, base, "embeddings")


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT vec_id, round(n, 4) AS norm, CAST(dim AS INTEGER) AS dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 4) + 0.0 AS value FROM (SELECT vec_id, n, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM n)""")
def normalized_vectors(spark, base):
    """Length of each vector, and its places at length one."""
    v = F.col("embedding")
    rows = _vectors(spark, base).select("vec_id", F.round(l2_norm(v), 4).alias("norm"), F.posexplode(l2_normalize(v)).alias("dim", "x"))
    return rows.select("vec_id", "norm", "dim", (F.round("x", 4) + F.lit(0.0)).alias("value"))


@query("""
WITH v AS (SELECT DISTINCT doc_id, chunk_id, embedding FROM index_vectors WHERE chunk_id IS NOT NULL),
e AS (SELECT chunk_id, unnest(embedding) AS x FROM v), u AS (SELECT chunk_id, count(*) = 64 AND bool_and(x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AND bool_or(x <> 0) AS ok FROM e GROUP BY chunk_id)
SELECT doc_id, count(*) AS vectors, count(*) FILTER (coalesce(ok, false)) AS usable FROM v LEFT JOIN u USING (chunk_id) GROUP BY doc_id""")
def vector_check(spark, base):
    v = distinct_rows(table(spark, base, "index_vectors"), "chunk_id")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(usable(F.col("embedding"), 64)).alias("usable"))


@query("""
WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 4) AS mean FROM e GROUP BY label, dim""")
def mean_pool(spark, base):
    rows = _vectors(spark, base).select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"""
WITH v AS (SELECT DISTINCT doc_id, chunk_id, embedding FROM index_vectors WHERE chunk_id IS NOT NULL), e AS (SELECT doc_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS dim FROM v WHERE {USABLE}),
m AS (SELECT doc_id, dim, avg(x) AS mean FROM e GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(mean * mean)) AS n FROM m GROUP BY doc_id)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN n > 0 THEN mean / n ELSE mean END, 4) + 0.0 AS mean FROM m JOIN n USING (doc_id)""")
def masked_pool(spark, base):
    """A vector of length one for each document: the mean of its chunks' vectors, of those that are usable."""
    v = distinct_rows(table(spark, base, "index_vectors"), "chunk_id")
    rows = v.filter(usable(F.col("embedding"), 64)).select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    mean = rows.groupBy("doc_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    whole = mean.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("v"))
    return whole.select("doc_id", F.posexplode(l2_normalize(F.col("v.mean"))).alias("dim", "x")).select("doc_id", "dim", (F.round("x", 4) + F.lit(0.0)).alias("mean"))


KNN_SQL = """
kd AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
ks AS (SELECT q.vec_id AS query_id, d.vec_id, round(1 / (1 + pow(list_distance(q.v, d.v), 2)), 6) AS score FROM kd q, kd d WHERE q.vec_id % 20 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ks)"""


@query(f"WITH {KNN_SQL} SELECT query_id, vec_id, score, rank FROM knn WHERE rank <= 10")
def knn_topk(spark, base):
    v = _vectors(spark, base).select("vec_id", "embedding")
    return retrieve.knn(v.filter("vec_id % 20 = 0"), v, 10)


@query(f"""
WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term""")
def term_statistics(spark, base):
    return retrieve.term_stats(retrieve.postings(_docs(spark, base), "doc_id"))


ASKED = "SELECT query_id, text FROM questions WHERE query_id % 20 = 0 AND length(trim(text)) > 0"


def _bm25_sql(dl: str = "dl", ask: str = ASKED, docs: str = "documents") -> str:
    return f"""
ask AS ({ask}), p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM {docs}) GROUP BY ALL),
n AS (SELECT doc_id, len({WORDS.format('text')}) AS dl FROM {docs}), w AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM n),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({WORDS.format('text')}) AS term FROM ask) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * {dl} / avgdl))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN n USING (doc_id), w GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _hits(spark, base, k, norms="exact"):
    return retrieve.bm25(_asked(spark, base), _docs(spark, base), k, norms=norms)


@query(f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, base):
    return _hits(spark, base, 10).withColumn("score", F.round("score", 4))


@query(f"WITH {_bm25_sql('(CASE WHEN dl < 40 THEN dl ELSE 24 + floor((dl - 24) / pow(2.0, length(bin(dl - 24)) - 4)) * pow(2.0, length(bin(dl - 24)) - 4) END)')} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM bm WHERE rank <= 10")
def bm25_quantized(spark, base):
    return _hits(spark, base, 10, "quantized").withColumn("score", F.round("score", 4))


TITLES = "SELECT doc_id AS query_id, title AS text FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL"


@query(f"""
WITH {_bm25_sql(ask=TITLES)}, {KNN_SQL},
v AS (SELECT query_id, vec_id AS doc_id, 0.6 * score / max(score) OVER (PARTITION BY query_id) AS score FROM knn WHERE rank <= 20),
k AS (SELECT query_id, doc_id, 0.4 * score / max(score) OVER (PARTITION BY query_id) AS score FROM bm WHERE rank <= 20),
u AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""")
def hybrid_topk(spark, base):
    """Documents like a document: by the vector of it and by its title's words."""
    docs, v = _docs(spark, base), _vectors(spark, base).select("vec_id", "embedding")
    titles = docs.filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    near = retrieve.knn(v.filter("vec_id % 20 = 0"), v, 20).withColumnRenamed("vec_id", "doc_id")
    return retrieve.fuse(near, retrieve.bm25(titles, docs, 20), 10).withColumn("score", F.round("score", 4))


@query(f"""
WITH n AS (SELECT doc_id, len({WORDS.format('title')}) + len({WORDS.format('text')}) AS n FROM documents)
SELECT doc_id, CAST(s * 430 AS INTEGER) AS "start", CAST(least(CASE WHEN n <= 512 THEN 512 ELSE 480 END, n - s * 430) AS INTEGER) AS size
FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, CAST(ceil((n - 480) / 430.0) AS INTEGER) + 1) END) AS s FROM n WHERE n > 0)""")
def rerank_windows(spark, base):
    """Windows over each title followed by its text, as over a query and a passage."""
    rows = _docs(spark, base).select("doc_id", F.size(words(F.col("title"))).alias("q"), F.size(words(F.col("text"))).alias("n"))
    rows = rows.select("doc_id", (F.col("q") + F.col("n")).alias("n"), F.explode(pair_windows(F.col("q"), F.col("n"))).alias("start"))
    return rows.select("doc_id", "start", F.least(F.when(F.col("n") <= 512, 512).otherwise(480), F.col("n") - F.col("start")).alias("size"))


def _candidates(spark, base, k=100):
    asked = _asked(spark, base)
    hits = retrieve.sized(_hits(spark, base, k).select("query_id", "doc_id", "rank"), k * asked.count())
    docs = _docs(spark, base).select("doc_id", F.col("title"), "text")
    return docs.join(hits, "doc_id").join(retrieve.sized(asked.withColumnRenamed("text", "query_text")), "query_id")


def _rerank_sql(found: str, docs: str = "documents") -> str:
    """Survivors r (query_id, doc_id, score, rank) of a table found (query_id, doc_id)."""
    return f"""
cw AS (SELECT found.query_id, found.doc_id, {WORDS.format('ask.text')} AS q, {WORDS.format('d.text')} AS w FROM ({found}) found JOIN ask USING (query_id) JOIN {docs} d USING (doc_id)),
cx AS (SELECT *, unnest(CASE WHEN len(q) + len(w) <= 512 THEN [0] ELSE range(0, CAST(ceil((len(q) + len(w) - 480) / 430.0) AS INTEGER) + 1) END) AS s FROM cw WHERE len(q) + len(w) > 0),
cy AS (SELECT query_id, doc_id, list_distinct(q) AS q, list_slice(w, CAST(greatest(s * 430 - len(q), 0) + 1 AS INTEGER), CAST(s * 430 + CASE WHEN len(q) + len(w) <= 512 THEN 512 ELSE 480 END - len(q) AS INTEGER)) AS part FROM cx),
cb AS (SELECT query_id, doc_id, max(round(coalesce(2.0 * len(list_intersect(q, part)) / nullif(len(q), 0), 0.0) - 1, 6)) AS score FROM cy GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cb WHERE score >= 0) WHERE rank <= 50)"""


FOUND = "SELECT query_id, doc_id FROM bm WHERE rank <= 100"


@query(f"WITH {_bm25_sql()}, {_rerank_sql(FOUND)} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r")
def rerank_topk(spark, base):
    return retrieve.rerank(_candidates(spark, base)).withColumn("score", F.round("score", 4))


OK = "query_id IS NOT NULL AND doc_id IS NOT NULL AND from_page >= 1 AND from_page <= to_page"


def _merge_sql(keys: str) -> str:
    return f"""
v AS (SELECT DISTINCT {keys}, from_page, to_page FROM citation_intervals WHERE {OK}),
g AS (SELECT *, CASE WHEN max(to_page) OVER (PARTITION BY {keys} ORDER BY from_page, to_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= from_page THEN 0 ELSE 1 END AS fresh FROM v),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY from_page, to_page ROWS UNBOUNDED PRECEDING) AS island FROM g),
merged AS (SELECT {keys}, min(from_page) AS from_page, max(to_page) AS to_page FROM i GROUP BY {keys}, island)"""


def _intervals(spark, base):
    return table(spark, base, "citation_intervals").filter("query_id is not null and doc_id is not null")


@query(f"WITH {_merge_sql('doc_id')} SELECT doc_id, from_page, to_page FROM merged")
def interval_merge(spark, base):
    """Pages of each document that anyone cited."""
    return coalesced(_intervals(spark, base), ["doc_id"])


@query(f"""
WITH {_merge_sql('query_id, doc_id')}, t AS (SELECT DISTINCT id, title FROM doc_catalog)
SELECT query_id, doc_id, any_value(title) || ' p. ' || string_agg(CASE WHEN from_page = to_page THEN CAST(from_page AS VARCHAR) ELSE from_page || '-' || to_page END, ', ' ORDER BY from_page) AS citation
FROM merged JOIN t ON t.id = merged.doc_id GROUP BY query_id, doc_id""")
def citation_render(spark, base):
    return answers.citations(coalesced(_intervals(spark, base), ["query_id", "doc_id"]), _catalog(spark, base), ["query_id", "doc_id"])


@query(f"""
WITH f AS (SELECT query_id, doc_id, min(cited_at) AS first FROM citation_intervals WHERE {OK} GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS place FROM f""")
def citation_order(spark, base):
    """Cited documents of each question in the order in which they first came."""
    first = _intervals(spark, base).filter("from_page >= 1 and from_page <= to_page").groupBy("query_id", "doc_id").agg(F.min("cited_at").alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id")).alias("place"))


def _survivors(spark, base):
    """Documents that survive reranking, with cleaned texts, titles and questions."""
    asked = _asked(spark, base)
    best = retrieve.sized(retrieve.rerank(_candidates(spark, base)).select("query_id", "doc_id", "rank"), 50 * asked.count())
    docs = _docs(spark, base).select("doc_id", F.coalesce("title", F.lit("untitled")).alias("title"), clean_text(F.col("text")).alias("text"))
    return docs.join(best, "doc_id").join(retrieve.sized(asked.withColumnRenamed("text", "query_text")), "query_id")


SURVIVORS = f"{_bm25_sql()}, {_rerank_sql(FOUND)}, c AS (SELECT query_id, rank, coalesce(title, 'untitled') AS title, text FROM r JOIN (SELECT doc_id, title, {CLEAN} AS text FROM documents) USING (doc_id))"
CONTEXT = "SELECT query_id, 'CONTEXT:' || chr(10) || string_agg('- ' || c.text || chr(10), '' ORDER BY rank) || chr(10) || 'QUESTION: ' || any_value(ask.text) AS context FROM c JOIN ask USING (query_id) GROUP BY query_id"


@query(f"WITH {SURVIVORS} {CONTEXT}")
def context_assembly(spark, base):
    return answers.context(_survivors(spark, base))


FIRST = r"split_part(regexp_replace(arg_min(text, rank), '([.!?]) ', '\1' || chr(31)), chr(31), 1)"


def _esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _answer_sql(sources: str) -> str:
    """Answers a (query_id, answer) from passages c (query_id, rank, text) and sources (query_id, place, citation)."""
    return rf"""
bo AS (SELECT query_id, {FIRST} AS first FROM c GROUP BY query_id),
li AS (SELECT query_id, '<p>Sources:</p><ul>' || chr(10) || string_agg('<li>' || {_esc('citation')} || '</li>' || chr(10), '' ORDER BY place) || '</ul>' || chr(10) AS list FROM ({sources}) GROUP BY query_id),
a AS (SELECT query_id, CASE WHEN bo.query_id IS NULL THEN 'No relevant information found.' WHEN trim(first) = '' THEN '<p><i>No answer could be generated.</i></p>' ELSE '<p>' || {_esc('first')} || '</p>' || coalesce(list, '') END AS answer
 FROM ask LEFT JOIN bo USING (query_id) LEFT JOIN li USING (query_id))"""


@query(f"WITH {SURVIVORS}, {_answer_sql('SELECT query_id, rank AS place, title AS citation FROM c')} SELECT query_id, answer FROM a")
def answer_html(spark, base):
    rows = _survivors(spark, base)
    bodies = answers.context(rows).select("query_id", chat(F.col("context"), engine.PROMPT)["body"].alias("body"))
    return answers.html_answer(_asked(spark, base), bodies, rows.select("query_id", F.col("rank").alias("place"), F.col("title").alias("citation")))


CAT = "SELECT DISTINCT id, title, mime, size_bytes, chunks, status FROM doc_catalog"


@query(f"WITH c AS ({CAT}) SELECT * FROM c")
def catalog_list(spark, base):
    return _catalog(spark, base).select("id", "title", "mime", "size_bytes", "chunks", "status")


@query(f"""
WITH c AS ({CAT}), n AS (SELECT doc_id, count(DISTINCT chunk_id) AS k FROM chunks GROUP BY doc_id)
SELECT id, title, mime, size_bytes, CAST(coalesce(k, 0) AS INTEGER) AS chunks, CASE WHEN k > 0 THEN 'INDEXED' ELSE status END AS status FROM c LEFT JOIN n ON n.doc_id = c.id""")
def catalog_update(spark, base):
    """Catalog with the true chunk counts; documents with chunks are indexed."""
    n = _chunks(spark, base).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    rows = _catalog(spark, base).join(n, "id", "left")
    return rows.select("id", "title", "mime", "size_bytes", F.coalesce("k", F.lit(0)).cast("int").alias("chunks"), F.when(F.col("k") > 0, "INDEXED").otherwise(F.col("status")).alias("status"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, from_page, to_page FROM index_vectors WHERE chunk_id IS NOT NULL), bad AS (SELECT id FROM doc_catalog WHERE status = 'FAILED' OR last_indexed_at IS NULL)
SELECT chunk_id, doc_id, from_page, to_page FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM bad WHERE id IS NOT NULL)""")
def index_delete(spark, base):
    """Index without the rows of documents that failed or were never indexed."""
    index = distinct_rows(table(spark, base, "index_vectors"), "chunk_id").select("chunk_id", "doc_id", "from_page", "to_page")
    bad = _catalog(spark, base).filter("status = 'FAILED' or last_indexed_at is null").select(F.col("id").alias("doc_id"))
    return catalog.delete(index, bad, "doc_id")


@query("""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, from_page, to_page FROM index_vectors WHERE chunk_id IS NOT NULL),
n AS (SELECT DISTINCT chunk_id, doc_id, page_start AS from_page, page_end AS to_page FROM chunks WHERE chunk_id IS NOT NULL AND doc_id IN (SELECT id FROM doc_catalog WHERE mime = 'text/html'))
SELECT * FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def index_upsert(spark, base):
    """Index in which all chunks of the HTML documents are replaced by the present ones."""
    index = distinct_rows(table(spark, base, "index_vectors"), "chunk_id").select("chunk_id", "doc_id", "from_page", "to_page")
    html = _catalog(spark, base).filter("mime = 'text/html'").select(F.col("id").alias("doc_id"))
    new = _chunks(spark, base).join(html, "doc_id", "left_semi").select("chunk_id", "doc_id", F.col("page_start").alias("from_page"), F.col("page_end").alias("to_page"))
    return catalog.upsert(index, new, "doc_id")


ONE = "one AS (SELECT job_id, seq, arg_max(status, loaded_at) AS status, arg_max(answer, loaded_at) AS answer FROM job_events WHERE job_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL)"


@query(f"WITH {ONE} SELECT job_id, arg_max(status, seq) AS status, arg_max(answer, seq) FILTER (answer IS NOT NULL) AS answer, count(*) AS steps FROM one GROUP BY job_id")
def job_states(spark, base):
    return catalog.latest_states(table(spark, base, "job_events"))


@query(f"""
WITH {ONE}, b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM one)
SELECT job_id, seq, status, before FROM b WHERE before IS NOT NULL AND status <> 'FAILED' AND
 coalesce(list_position({STEPS}, status), 0) <> coalesce(list_position({STEPS}, before), 0) + 1""")
def job_jumps(spark, base):
    return catalog.illegal_steps(table(spark, base, "job_events"), STEPS)


@query("""
WITH e AS (SELECT doc_id, count(DISTINCT chunk_id) AS total FROM chunks WHERE chunk_id IS NOT NULL GROUP BY doc_id), d AS (SELECT doc_id, count(DISTINCT chunk_id) AS done FROM index_vectors GROUP BY doc_id)
SELECT doc_id, total, coalesce(done, 0) AS done, CAST(least(greatest(floor(100.0 * coalesce(done, 0) / total), 0), 100) AS INTEGER) AS percent FROM e LEFT JOIN d USING (doc_id)""")
def index_progress(spark, base):
    total = _chunks(spark, base).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    return catalog.progress(total, distinct_rows(table(spark, base, "index_vectors"), "chunk_id"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, status, count(*) AS events FROM job_events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_job_counts(spark, base):
    """Daily counts of job events, as a stream that runs to its end."""
    counts = jobs.run_to_end(jobs.daily_counts(jobs.event_stream(spark, f"{base}/job_events.parquet")))
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "status", "events")


CHUNKS = f"SELECT DISTINCT chunk_id, doc_id AS of, page_start, page_end, {CLEAN} AS text FROM chunks WHERE chunk_id IS NOT NULL"


def _embed_sql(name: str, source: str, key: str) -> str:
    """Values name (key, dim, u) of stand-in vectors of length one, as single precision numbers."""
    return rf"""
{name}_h AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT {key}, unnest({WORDS.format('text')}) AS w FROM ({source}))),
{name}_x AS (SELECT {key}, h % 64 AS dim, sum(CASE WHEN h // 65536 % 2 = 1 THEN 1 ELSE -1 END) AS x FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, dim, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS u FROM {name}_x JOIN (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_x GROUP BY ALL) USING ({key}) WHERE n > 0)"""


@query(f"""
WITH {_embed_sql('v', "SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL", 'chunk_id')}, g AS (SELECT chunk_id, unnest(range(0, 64)) AS i FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL))
SELECT g.chunk_id, CAST(g.i AS INTEGER) AS dim, round(coalesce(u, 0.0), 4) AS value FROM g LEFT JOIN v ON v.chunk_id = g.chunk_id AND v.dim = g.i""")
def embed_chunks(spark, base):
    """Vectors of all chunk texts by the stand-in embedder, a row a place."""
    v = _chunks(spark, base).select("chunk_id", F.posexplode(embedding(F.col("text"))).alias("dim", "x"))
    return v.select("chunk_id", "dim", F.round(F.col("x").cast("double"), 4).alias("value"))


@query(rf"""
WITH t AS (SELECT DISTINCT chunk_id, {WORDS.format('text')} AS w FROM chunks WHERE chunk_id IS NOT NULL), i AS (SELECT chunk_id, [1] || list_transform(w, lambda x: 3 + CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 29997) || [2] AS ids FROM t)
SELECT chunk_id, CAST(len(ids) AS INTEGER) AS tokens, CAST(least(len(ids), 1024) AS INTEGER) AS kept, CAST(list_sum(list_slice(ids, 1, 1024)) AS BIGINT) AS checksum, CAST(ids[least(len(ids), 1024)] AS BIGINT) AS last FROM i""")
def embedding_inputs(spark, base):
    """Numbers of each chunk's tokens by the stand-in tokenizer, cut at 1024; the end mark goes with the rest."""
    number = lambda x: F.lit(3) + F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % 29997
    ids = F.concat(F.array(F.lit(1).cast("long")), F.transform(words(F.col("text")), number), F.array(F.lit(2).cast("long")))
    rows = _chunks(spark, base).select("chunk_id", F.size(ids).alias("tokens"), F.slice(ids, 1, 1024).alias("cut"))
    return rows.select("chunk_id", "tokens", F.size("cut").alias("kept"), F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"), F.element_at("cut", -1).alias("last"))


ALL_ASKED = "SELECT query_id, text FROM questions WHERE query_id IS NOT NULL AND length(trim(text)) > 0"


ASK = f"""
ch AS (SELECT chunk_id AS doc_id, * EXCLUDE (chunk_id) FROM ({CHUNKS})), {_bm25_sql(ask=ALL_ASKED, docs='ch')}, {_embed_sql('vd', 'SELECT doc_id, text FROM ch', 'doc_id')}, {_embed_sql('vq', ALL_ASKED, 'query_id')},
near AS (SELECT query_id, doc_id, round(1 / (1 + greatest(coalesce(qq, 0) + coalesce(dd, 0) - 2 * coalesce(qd, 0), 0)), 6) AS score FROM ask CROSS JOIN ch
 LEFT JOIN (SELECT query_id, sum(u * u) AS qq FROM vq GROUP BY 1) USING (query_id) LEFT JOIN (SELECT doc_id, sum(u * u) AS dd FROM vd GROUP BY 1) USING (doc_id)
 LEFT JOIN (SELECT query_id, doc_id, sum(vq.u * vd.u) AS qd FROM vq JOIN vd USING (dim) GROUP BY ALL) USING (query_id, doc_id)),
nk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near),
fl AS (SELECT query_id, doc_id, 0.6 * score / max(score) OVER (PARTITION BY query_id) AS score FROM nk WHERE rank <= 200 UNION ALL SELECT query_id, doc_id, 0.4 * score / max(score) OVER (PARTITION BY query_id) FROM bm WHERE rank <= 200),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM fl GROUP BY ALL)),
{_rerank_sql('SELECT query_id, doc_id FROM fu WHERE rank <= 100', 'ch')},
c AS (SELECT query_id, rank, doc_id AS chunk_id, of AS doc_id, page_start AS from_page, page_end AS to_page, text FROM r JOIN ch USING (doc_id)),
cv AS (SELECT DISTINCT query_id, doc_id, from_page, to_page FROM c WHERE from_page >= 1 AND from_page <= to_page),
cg AS (SELECT *, CASE WHEN max(to_page) OVER (PARTITION BY query_id, doc_id ORDER BY from_page, to_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= from_page THEN 0 ELSE 1 END AS fresh FROM cv),
ci AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY from_page, to_page ROWS UNBOUNDED PRECEDING) AS island FROM cg),
cm AS (SELECT query_id, doc_id, min(from_page) AS a, max(to_page) AS b FROM ci GROUP BY query_id, doc_id, island),
cp AS (SELECT query_id, doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM cm GROUP BY ALL),
so AS (SELECT query_id, first AS place, f.doc_id, coalesce(title, 'untitled') || CASE WHEN pages IS NULL THEN '' ELSE ' p. ' || pages END AS citation
 FROM (SELECT query_id, doc_id, min(rank) AS first FROM c GROUP BY ALL) f JOIN (SELECT DISTINCT id, title FROM doc_catalog) t ON t.id = f.doc_id LEFT JOIN cp USING (query_id, doc_id)),
{_answer_sql('SELECT * FROM so')},
reply AS (SELECT query_id, 'COMPLETED' AS status, context, answer FROM a LEFT JOIN ({CONTEXT}) USING (query_id))"""


def _indexed(spark, base):
    """All chunks as an index with vectors by the stand-in embedder, written once: search and answers read it several times."""
    rows = _chunks(spark, base).select("doc_id", "chunk_id", clean_text(F.col("text")).alias("text"), "page_start", "page_end")
    return written(lifecycle.index_rows(rows))


@query(f"WITH {ASK} SELECT * FROM reply")
def ask_questions(spark, base):
    """Answers to all questions over all chunks, with the pages that they rest on."""
    return engine.ask(_all_asked(spark, base), _indexed(spark, base), _catalog(spark, base))


@query(f"""
WITH {ASK}, steps AS (SELECT query_id, answer, unnest(['QUEUED', 'RETRIEVING', 'RERANKING'] || CASE WHEN context IS NULL THEN [] ELSE ['ANSWERING'] END || [status]) AS status, unnest(range(1, CASE WHEN context IS NULL THEN 5 ELSE 6 END)) AS seq, CASE WHEN context IS NULL THEN 4 ELSE 5 END AS n FROM reply)
SELECT query_id AS job_id, seq, status, CASE WHEN seq = n THEN answer END AS answer FROM steps""")
def job_log(spark, base):
    """States that each question goes through."""
    return engine.job_log(engine.ask(_all_asked(spark, base), _indexed(spark, base), _catalog(spark, base)))


@query(f"WITH {ASK} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS place, citation FROM so")
def answer_sources(spark, base):
    """Documents and pages behind each question's answer."""
    rows = answers.cited(engine.hits(_all_asked(spark, base), _indexed(spark, base)), _catalog(spark, base))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id")))


@query("SELECT query_id, row_number() OVER (ORDER BY asked_at NULLS FIRST, query_id) AS job_id, 'QUEUED' AS status FROM questions WHERE query_id IS NOT NULL")
def submit_questions(spark, base):
    """Jobs for all questions, numbered from 1 in the order in which they were asked."""
    return catalog.submit(table(spark, base, "questions"))


@query(f"WITH {ONE} SELECT job_id, arg_max(status, seq) AS status, arg_max(answer, seq) FILTER (answer IS NOT NULL) AS answer, count(*) AS steps FROM one WHERE job_id IN (SELECT query_id FROM questions WHERE query_id % 20 = 0) GROUP BY job_id")
def job_lookup(spark, base):
    """The jobs of the stated questions."""
    asked = table(spark, base, "questions").filter("query_id % 20 = 0").select(F.col("query_id").alias("job_id"))
    return catalog.latest_states(catalog.lookup(table(spark, base, "job_events"), "job_id", asked))


@query(f"WITH c AS ({CAT}) SELECT id, title, status FROM c WHERE id IN (SELECT doc_id FROM citation_intervals WHERE query_id % 20 = 0)")
def catalog_lookup(spark, base):
    """The documents that the stated questions' answers cite."""
    ids = table(spark, base, "citation_intervals").filter("query_id % 20 = 0").select(F.col("doc_id").alias("id"))
    return catalog.lookup(_catalog(spark, base).select("id", "title", "status"), "id", ids)


@query("""
WITH c AS (SELECT DISTINCT id, chunks, CAST(added_at AS DATE) AS run, added_at FROM doc_catalog WHERE id IS NOT NULL AND added_at IS NOT NULL), x AS (SELECT DISTINCT chunk_id, doc_id FROM index_vectors WHERE chunk_id IS NOT NULL),
s AS (SELECT run, count(*) AS done FROM x JOIN c ON c.id = x.doc_id GROUP BY run),
q AS (SELECT run, coalesce(chunks, 0) AS n, sum(coalesce(chunks, 0)) OVER (PARTITION BY run ORDER BY added_at, id ROWS UNBOUNDED PRECEDING) AS e FROM c),
j AS (SELECT q.*, coalesce(done, 0) AS done FROM q LEFT JOIN s USING (run))
SELECT CAST(run AS VARCHAR) AS run, max(done) AS done, CAST(sum(n) AS BIGINT) AS total, CAST(CASE WHEN sum(n) > 0 THEN least(greatest(floor(100 * max(done) / sum(n)), 0), 100) ELSE 0 END AS INTEGER) AS total_percent,
 CAST(coalesce(floor(100 * arg_min(done - e + n, e) FILTER (e > done AND n > 0) / arg_min(n, e) FILTER (e > done AND n > 0)), 100) AS INTEGER) AS document_percent FROM j GROUP BY run""")
def queue_progress(spark, base):
    """How far each day's uploads are: documents in the order in which they came, against the chunks in the index."""
    c = _catalog(spark, base).filter("added_at is not null").select("id", "chunks", F.date_format("added_at", "yyyy-MM-dd").alias("run"), F.struct("added_at", "id").alias("place"))
    done = distinct_rows(table(spark, base, "index_vectors"), "chunk_id").join(c, F.col("doc_id") == F.col("id")).groupBy("run").agg(F.count(F.lit(1)).alias("done"))
    return catalog.queue_progress(c, done)


@query(f"""
WITH c AS ({CAT}), x AS (SELECT DISTINCT chunk_id, doc_id FROM index_vectors WHERE chunk_id IS NOT NULL), gone AS (SELECT id FROM c WHERE status = 'FAILED')
SELECT 'index' AS part, chunk_id AS key FROM x WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL) UNION ALL SELECT 'catalog', id FROM c WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)""")
def documents_deleted(spark, base):
    """What stays of index and catalog when the failed documents are deleted."""
    listed = _catalog(spark, base)
    index, kept = lifecycle.without_documents(listed.filter("status = 'FAILED'").select("id"), distinct_rows(table(spark, base, "index_vectors"), "chunk_id"), listed)
    return index.select(F.lit("index").alias("part"), F.col("chunk_id").alias("key")).union(kept.select(F.lit("catalog"), "id"))
