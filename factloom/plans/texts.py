"""Queries over text functions, retrieval, verification, matching, credibility and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, credibility, matching, ordered, retrieval, scoring, verify
from .base import few, query, table

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_ACC = f"'{T.ACCENTS[0]}', '{T.ACCENTS[1]}'"


def _norm_quote(c):
    return f"trim(regexp_replace(lower(translate({c}, '‘’“”–—', '''''\"\"--')), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


def _tokens(c):
    return f"list_filter(list_distinct(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


@query(f"SELECT doc_id, md5({_norm_quote('text')}) AS digest FROM documents")
def normalize_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_quote("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def normalize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_ascii("text").cast("binary")).alias("digest"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM pages""")
def normalize_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_title(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query(f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS n_tokens FROM documents")
def claim_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"))


@query("SELECT s_suppkey, lower(regexp_extract_all(s_name, '[a-zA-Z0-9]+')[1]) || ' ' || regexp_extract_all(s_name, '[a-zA-Z0-9]+')[2] || ' un corp' AS phrase FROM supplier")
def phrase_tokens(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.phrase(F.concat("s_name", F.lit(" U.N. Corp."))).alias("phrase"))


# Publishers, and the authority that the configured names give them.
_PUBLISHERS = [("Cambridge University Press", 15.0), ("UN World Food Programme", 30.0), ("U.N. World Food Programme", 30.0), ("World of the Bank", 15.0), ("World Bank Group", 22.5), ("", 0.0), (None, 0.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {v}::DOUBLE)" for i, (_, v) in enumerate(_PUBLISHERS)) + ") t(id, authority)")
def publisher_authority(spark, sf_dir):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(_PUBLISHERS)], "id long, publisher string")
    return rows.select("id", T.publisher_authority("publisher", ["UN", "World Health Organization"], ["World Bank"]).alias("authority"))


# Authors as printed, and their family names.
_AUTHORS = [("John Smith", "smith"), ("Smith, John", "smith"), ("John Smith Jr.", "smith"), ("John Smith, PhD", "smith"), ("Mary O'Neil-Fox III", "o'neil-fox"), ("X", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") + ")" for i, (_, v) in enumerate(_AUTHORS)) + ") t(id, family)")
def family_names(spark, sf_dir):
    rows = spark.createDataFrame([(i, [a]) for i, (a, _) in enumerate(_AUTHORS)], "id long, authors array<string>")
    return rows.select("id", F.try_element_at(T.family_names("authors"), F.lit(1)).alias("family"))


# Printed ISBNs and DOIs, and what they are once cleaned.
_ISBN = [("978-1-9191958-0-3", "9781919195803"), ("ISBN-13: 978-1-9191958-0-3", "9781919195803"), ("92-9090-354-6", "9290903546"), ("0-9752298-0-X", "097522980X"), ("0-9752298-0-4", None), ("12345", None)]
_DOI = [("https://doi.org/10.1000/xyz123", "10.1000/xyz123"), ("doi: 10.5555/12345678", "10.5555/12345678"), ("http://dx.doi.org/10.1234/a b", None), ("10.12/short", None), ("nonsense", None)]


def _values(rows):
    return ", ".join(f"({i}::BIGINT, " + ("NULL" if v is None else f"'{v}'") + ")" for i, (_, v) in enumerate(rows))


@query(f"SELECT * FROM (VALUES {_values(_ISBN)}) t(id, isbn)")
def isbn_check(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_ISBN)], "id long, raw string").select("id", T.clean_isbn("raw").alias("isbn"))


@query(f"SELECT * FROM (VALUES {_values(_DOI)}) t(id, doi)")
def doi_clean(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_DOI)], "id long, raw string").select("id", T.clean_doi("raw").alias("doi"))


@query("""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length(f) > 4000 THEN substr(f, 1, 4000) || chr(10) || '[table truncated]' ELSE f END AS t FROM (SELECT doc_id, trim(source || chr(10) || chr(10) || text) AS f FROM documents))""")
def table_cap(spark, sf_dir):
    t = T.table_text("source", "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("""SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END), ''), 'Figure on page ' || CASE WHEN p_size % 2 = 0 THEN p_size END, 'Figure') || chr(10) || chr(10) || p_type AS figure FROM part""")
def figure_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.figure_text(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.col("p_type")).alias("figure"))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' ' || year(o_orderdate) ELSE o_orderpriority END AS t, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS y FROM orders)
SELECT o_orderkey, CASE WHEN y IS NOT NULL AND NOT contains(t, CAST(y AS VARCHAR)) THEN t || ' ' || y ELSE t END AS q FROM c""")
def evidence_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(" ", "o_orderpriority", F.col("y").cast("string"))).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", t.alias("t"), F.when(F.col("o_orderkey") % 3 != 0, F.col("y")).alias("y")).select("o_orderkey", T.evidence_query("t", "y").alias("q"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS flag, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""")
def year_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    text = F.concat(F.lit("ordered in "), F.when(F.col("o_orderkey") % 2 == 0, F.col("y").cast("string")).otherwise(F.concat(F.col("y").cast("string"), F.lit("7"))), F.lit("."))
    return o.select("o_orderkey", T.year_flag(F.when(F.col("o_orderkey") % 5 != 0, F.col("y")), text).alias("flag"), T.year_of(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("y"))


@query("SELECT lang AS kind, count(*) AS chunks FROM documents GROUP BY lang")
def chunk_kind_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("chunks"))


@query("SELECT source AS doc_id, doc_id AS id, length(text) AS chars FROM documents WHERE lang = 'de'")
def chunks_by_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def get_chunks(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "source", "lang")


_KNN = """n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS ql, round(list_cosine_similarity(q.e, c.e), 9) AS score FROM n q JOIN n c ON {on})"""


@query(f"WITH {_KNN.format(on='true')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank FROM r WHERE rank <= 20")
def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.knn(e, e.withColumnRenamed("chunk_id", "query_id")).select("query_id", "chunk_id", "rank")


@query(f"WITH {_KNN.format(on='q.label = c.label')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank FROM r WHERE rank <= 20")
def knn_partitioned(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return retrieval.knn(e, e.withColumnRenamed("chunk_id", "query_id"), partition=["label"]).select("query_id", "chunk_id", "rank")


_BM25 = rf"""w AS (SELECT doc_id AS chunk_id, lang, source, regexp_extract_all(translate(lower(text), {_ACC}), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
p AS (SELECT chunk_id, unnest(w) AS term FROM w), tf AS (SELECT term, chunk_id, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(translate(lower(text), {_ACC}), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, tf.chunk_id, w.lang, w.source, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.w) / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN w ON w.chunk_id = tf.chunk_id, st GROUP BY ALL)"""


@query(f"WITH {_BM25}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM b) SELECT * FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    d, q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(d, q).select("query_id", "chunk_id", "rank")


#: Languages stand for the runs and kinds of documents that a search is confined to.
LANGS = ["de", "en", "es", "fr"]


@query(f"""WITH {_BM25}, s AS (SELECT query_id * 4 + l.i AS query_id, chunk_id, score FROM b JOIN (SELECT * FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) AS t(i, lang)) l USING (lang)),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def keyword_scoped(spark, sf_dir):
    """Each item is searched once in each language's documents, with the word statistics of all documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text")
    scopes = F.posexplode(F.array(*map(F.lit, LANGS))).alias("i", "lang")
    q = table(spark, sf_dir, "benchmark").select("item_id", "text", scopes)
    return retrieval.bm25(d, q.select((F.col("item_id") * 4 + F.col("i")).alias("query_id"), "lang", "text"), same=["lang"]).select("query_id", "chunk_id", "rank")


_HYBRID = f"""{_BM25}, n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 9) AS score FROM n q JOIN benchmark i ON i.item_id = q.vec_id JOIN n c ON true),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS v FROM s), kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS w FROM b),
f AS (SELECT query_id, chunk_id, v, w, coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + w), 0) AS score FROM (SELECT query_id, chunk_id, v FROM vr WHERE v <= 20) FULL JOIN (SELECT query_id, chunk_id, w FROM kr WHERE w <= 20) USING (query_id, chunk_id)),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(v, w + 1000000000)) AS rank, CASE WHEN w IS NULL THEN 'vector' WHEN v IS NULL THEN 'keyword' ELSE 'vector+keyword' END AS channels FROM f)"""


def _hybrid(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    d, q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = e.join(q.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id")
    return retrieval.fuse(retrieval.knn(e, asked), retrieval.bm25(d, q), k).select("query_id", "chunk_id", "rank", "channels")


@query(f"WITH {_HYBRID} SELECT * FROM r WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10)


@query(f"WITH {_HYBRID} SELECT * FROM r WHERE rank <= 8")
def evidence_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, retrieval.EVIDENCE_K)


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_containment(spark, sf_dir):
    # a quote's rarest word leads to the few texts that can hold it
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}]+"), 0))
    # words at the rim of a quote can be parts of longer words in a text
    inner = F.expr(r"array_distinct(slice(regexp_extract_all(quote, '[\\p{L}\\p{N}]+', 0), 2, greatest(size(regexp_extract_all(quote, '[\\p{L}\\p{N}]+', 0)) - 2, 0)))")
    asked = b.select("item_id", F.explode(inner).alias("w"))
    posted = d.select("doc_id", F.explode(words("text")).alias("w")).join(few(asked.select("w").distinct()), "w", "left_semi")
    df = posted.groupBy("w").agg(F.count("*").alias("df"))
    rare = asked.join(df, "w").groupBy("item_id").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    pairs = posted.join(few(rare), "w").select("doc_id", "item_id")
    # quotes without an inner word: their first characters lead to texts
    short = b.where(F.size(inner) == 0)
    for n in (1, 2, 3):
        begins = short.where(F.least(F.length("quote"), F.lit(3)) == n).select("item_id", F.substring("quote", 1, n).alias("w"))
        if begins.limit(1).count():
            parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.col("text").substr(i, F.lit(n))))
            pairs = pairs.unionByName(d.where("text != ''").select("doc_id", F.explode(parts).alias("w")).join(few(begins), "w").select("doc_id", "item_id"))
    pairs = pairs.join(few(b), "item_id")
    return pairs.join(d, "doc_id").where(F.contains("text", "quote")).select("doc_id", "item_id")


_CHECK = f"""{_BM25}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM b),
asked AS (SELECT item_id, text, {_norm_quote('text')} AS nq, CASE item_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict FROM benchmark),
shown AS (SELECT query_id AS claim_id, chunk_id, pos, {_norm_quote('d.text')} AS nt FROM k JOIN documents d ON d.doc_id = k.chunk_id WHERE pos <= 8),
h AS (SELECT claim_id, arg_min(chunk_id, CASE WHEN pos = 2 THEN 0 ELSE pos END) AS hit FROM shown JOIN asked ON asked.item_id = shown.claim_id WHERE length(nq) >= 10 AND contains(nt, nq) GROUP BY claim_id)"""


@query(f"""WITH {_CHECK} SELECT item_id AS claim_id, CASE WHEN verdict <> 'UNVERIFIABLE' AND hit IS NULL THEN 'UNVERIFIABLE' ELSE verdict END AS verdict, verdict AS raw_verdict,
CASE WHEN hit IS NOT NULL THEN 1 WHEN length(nq) >= 10 OR verdict <> 'UNVERIFIABLE' THEN 0 END AS quote_verified, hit AS quoted_chunk_id FROM asked LEFT JOIN h ON h.claim_id = asked.item_id""")
def check_verdict(spark, sf_dir):
    # the evidence of a claim: what keyword search over all documents ranks first for it
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    verdict = F.element_at(F.array(F.lit("SUPPORTED"), F.lit("CONTRADICTED"), F.lit("UNVERIFIABLE")), (F.col("item_id") % 3 + 1).cast("int"))
    answers = b.select(F.col("item_id").alias("claim_id"), F.lit(None).cast("int").alias("year"), verdict.alias("verdict"), F.col("text").alias("quote"), F.lit(2).alias("evidence_index"))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "text")
    hits = retrieval.bm25(chunks, b.select(F.col("item_id").alias("query_id"), "text")).where(F.col("rank") <= retrieval.EVIDENCE_K)
    evidence = hits.select(F.col("query_id").alias("claim_id"), F.col("rank").alias("pos"), "chunk_id").join(chunks, "chunk_id")
    return verify.check_verdicts(answers, evidence).select("claim_id", "verdict", "raw_verdict", "quote_verified", "quoted_chunk_id")


_PAIRS = f"""g AS (SELECT item_id AS g, {_tokens('text')} AS tg, CAST(length(text) AS DOUBLE) AS vg FROM benchmark), r AS (SELECT doc_id AS r, {_tokens('text')} AS tr, CAST(n_chars AS DOUBLE) AS vr FROM documents),
ge AS (SELECT g, unnest(tg) AS t FROM g), re AS (SELECT r, unnest(tr) AS t FROM r), sh AS (SELECT g, r, count(*) AS shared FROM ge JOIN re USING (t) GROUP BY ALL),
al AS (SELECT g.g, r.r, coalesce(shared, 0) AS shared, abs(vg - vr) <= abs(vg) * 0.001 AS same, len(tg) AS ng, len(tr) AS nr FROM g JOIN r ON true LEFT JOIN sh ON sh.g = g.g AND sh.r = r.r),
pr AS (SELECT g, r, shared, CASE WHEN least(ng, nr) > 0 THEN CAST(shared AS DOUBLE) / least(ng, nr) ELSE 0 END AS share, same FROM al),
c AS (SELECT g, r, CASE WHEN share > 0 THEN shared ELSE 0 END AS shared, share + CASE WHEN same THEN 0.5 ELSE 0 END AS quality FROM pr WHERE same OR share >= 0.6)"""


def _candidates(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    year, one = F.lit(None).cast("int").alias("year"), F.lit("dev").alias("set_id")
    golden = b.select(one, F.col("item_id").alias("id"), "text", F.length("text").alias("value"), year)
    rows = d.select(one, F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("value"), year)
    return golden, rows, matching.candidates(golden, rows)


@query(f"WITH {_PAIRS} SELECT g, r, round_even(quality, 6) AS quality FROM c")
def token_overlap_pairs(spark, sf_dir):
    return _candidates(spark, sf_dir)[2].select("g", "r", F.bround("quality", 6).alias("quality"))


def _greedy(order: str) -> str:
    """m (g, r): golden rows in turn, each with the first row in this order that none before has taken."""
    return f"""{_PAIRS}, o AS (SELECT g, row_number() OVER (ORDER BY g) AS n FROM (SELECT DISTINCT g FROM c)),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS g, NULL::BIGINT AS r
  UNION ALL SELECT o.n, CASE WHEN k.r IS NULL THEN walk.taken ELSE list_append(walk.taken, k.r) END, o.g, k.r FROM walk JOIN o ON o.n = walk.n + 1
  LEFT JOIN LATERAL (SELECT c.r FROM c WHERE c.g = o.g AND NOT list_contains(walk.taken, c.r) ORDER BY {order} LIMIT 1) k ON true),
m AS (SELECT g, r FROM walk WHERE r IS NOT NULL)"""


@query(f"WITH RECURSIVE {_greedy('c.quality DESC, c.r')} SELECT 'dev' AS set_id, g, r FROM m")
def greedy_pairing(spark, sf_dir):
    return matching.greedy_pairs(_candidates(spark, sf_dir)[2])


@query(f"WITH {_PAIRS}, x AS (SELECT count(DISTINCT g) AS g_found, count(DISTINCT r) AS r_found FROM c) SELECT 'dev' AS set_id, (SELECT count(*) FROM benchmark) AS golden, (SELECT count(*) FROM documents) AS extracted, g_found, r_found FROM x")
def extraction_candidates(spark, sf_dir):
    golden, rows, c = _candidates(spark, sf_dir)
    n = lambda df, name: df.groupBy("set_id").agg(F.count("*").alias(name))
    return n(golden, "golden").join(n(rows, "extracted"), "set_id").join(c.groupBy("set_id").agg(F.countDistinct("g").alias("g_found"), F.countDistinct("r").alias("r_found")), "set_id")


@query(f"""WITH RECURSIVE {_greedy('c.r')}, n AS (SELECT (SELECT count(*) FROM benchmark) AS golden, (SELECT count(*) FROM documents) AS extracted, (SELECT count(*) FROM m) AS matched)
SELECT 'dev' AS set_id, *, CAST(matched AS DOUBLE) / golden AS recall, CAST(matched AS DOUBLE) / extracted AS precision FROM n""")
def extraction_score(spark, sf_dir):
    golden, rows, c = _candidates(spark, sf_dir)
    return matching.extraction_score(golden, rows, matching.greedy_pairs(c, best_fit=False))

_CLASSES = ["CONTRADICTED", "SUPPORTED", "UNVERIFIABLE"]


@query("""WITH v AS (SELECT CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN quality = 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS expected, CASE WHEN n_chars % 4 = 0 THEN 'SUPPORTED' WHEN n_chars % 4 = 1 THEN 'CONTRADICTED' WHEN n_chars % 4 = 2 THEN 'UNVERIFIABLE' ELSE 'PENDING' END AS predicted FROM documents LEFT JOIN labels USING (doc_id))
SELECT expected, count(*) FILTER (predicted = 'CONTRADICTED') AS "CONTRADICTED", count(*) FILTER (predicted = 'SUPPORTED') AS "SUPPORTED", count(*) FILTER (predicted = 'UNVERIFIABLE') AS "UNVERIFIABLE", count(*) FILTER (predicted = 'PENDING') AS "OTHER" FROM v GROUP BY expected""")
def confusion_matrix(spark, sf_dir):
    expected = F.when(F.col("quality") == 1, "SUPPORTED").when(F.col("quality") == 0, "CONTRADICTED").otherwise("UNVERIFIABLE")
    predicted = F.element_at(F.array(*[F.lit(x) for x in ("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE", "PENDING")]), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(expected.alias("expected"), predicted.alias("predicted"))
    return matching.confusion(rows, _CLASSES)


# labels as the golden set, documents as the claims of a run: those whose length is no multiple of 5 are paired
_GOLDEN = """g AS (SELECT doc_id AS g, lang AS set_id, text, CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict, CASE WHEN n_chars % 11 != 0 THEN CASE WHEN toxic = 1 THEN 'disavowed' ELSE 'asserted' END END AS stance FROM labels JOIN documents USING (doc_id)),
p AS (SELECT doc_id AS g, CASE n_chars % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict, CASE n_chars % 3 WHEN 0 THEN 'disavowed' WHEN 1 THEN '' END AS stance FROM documents WHERE n_chars % 5 != 0),
x AS (SELECT g.*, p.g IS NOT NULL AS paired, p.verdict AS said, coalesce(nullif(p.stance, ''), 'asserted') AS took FROM g LEFT JOIN p USING (g))"""


def _golden(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ids, n = (F.col("lang").alias("set_id"), F.col("doc_id").alias("id")), F.col("n_chars")
    golden = d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        *ids, "text", F.when(F.col("quality") == 1, "SUPPORTED").otherwise("CONTRADICTED").alias("verdict"),
        F.when(n % 11 != 0, F.when(F.col("toxic") == 1, "disavowed").otherwise("asserted")).alias("stance"),
    )
    said = F.when(n % 4 == 0, "SUPPORTED").when(n % 4 == 1, "CONTRADICTED").otherwise("UNVERIFIABLE")
    rows = d.select(*ids, said.alias("verdict"), F.when(n % 3 == 0, "disavowed").when(n % 3 == 1, "").alias("stance"))
    return golden, rows, d.where(n % 5 != 0).select("lang", "doc_id", "doc_id").toDF("set_id", "g", "r")


@query(f"WITH {_GOLDEN} SELECT set_id, verdict AS expected, count(*) AS golden, count(*) FILTER (paired) AS total, count(*) FILTER (paired AND said = verdict) AS correct FROM x GROUP BY ALL")
def verdict_classes(spark, sf_dir):
    return matching.verdict_classes(*_golden(spark, sf_dir))


@query(f"""WITH {_GOLDEN}, n AS (SELECT set_id, count(*) AS golden, count(*) FILTER (paired) AS matched, count(*) FILTER (paired AND said = verdict) AS correct FROM x GROUP BY ALL)
SELECT *, CASE WHEN matched > 0 THEN correct::DOUBLE / matched ELSE 0 END AS accuracy, matched::DOUBLE / golden AS coverage FROM n""")
def verdict_score(spark, sf_dir):
    return matching.verdict_score(matching.verdict_classes(*_golden(spark, sf_dir)))


@query(f"WITH {_GOLDEN} SELECT set_id, count(*) FILTER (paired AND took = stance) AS agreed, count(*) FILTER (paired) AS labelled, count(*) FILTER (NOT paired) AS unpaired FROM x WHERE stance IS NOT NULL GROUP BY ALL")
def stance_score(spark, sf_dir):
    return matching.stance_score(*_golden(spark, sf_dir))


@query(f"WITH {_GOLDEN} SELECT set_id, g, substring(text, 1, 80) AS claim, stance AS expected, took AS actual FROM x WHERE stance IS NOT NULL AND paired AND took != stance")
def stance_disagreements(spark, sf_dir):
    return matching.stance_disagreements(*_golden(spark, sf_dir))


@query(f"WITH {_GOLDEN} SELECT set_id, g AS id, text FROM x WHERE NOT paired")
def missed_claims(spark, sf_dir):
    golden, _, paired = _golden(spark, sf_dir)
    return matching.missed(golden, paired)


_SOURCE = "doc_id long, title string, authors array<string>, publisher string, publication_date string, doi string, isbn string"
# Sources and registry records of every tier, as in the published rules.
_SOURCES = [
    (1, "Own Title", ["A B"], "P", "2020", "doi:10.1000/one", None),
    (2, "Food &amp; <i>Aid</i>", ["Jane Doe"], None, "2019-05", None, None),
    (3, "Annual Report 2023", [], "Relief Org", "2023", None, None),
    (4, "Annual Report 2023", [], "Someone Else", "2023", None, None),
    (5, "A Book", [], "Press House", "2015", None, "978-1-9191958-0-3"),
    (6, "Another Book", [], "Nobody", None, None, "92-9090-354-6"),
    (7, None, [], None, None, None, None),
]
_WORK = "key string, doi string, titles array<string>, publisher string, families array<string>, year int"
_WORKS = [("w1", "10.1000/one", ["Registered Title"], "Reg", [], 2021), ("w2", None, ["Food & Aid"], "Pub", ["Roe"], 2020), ("w3", None, ["Annual report 2023"], "Relief Org International", [], 2023)]
_BOOK = "key string, isbn string, titles array<string>, publisher string, families array<string>, year int"
_BOOKS = [("b1", "1-919195-80-7", ["Other"], "Press House Ltd", [], 2016), ("b2", "92-9090-354-6", ["Unrelated"], "Elsewhere", [], 2001)]


def _resolved(spark):
    return credibility.resolve_tiers(spark.createDataFrame(_SOURCES, _SOURCE), spark.createDataFrame(_WORKS, _WORK), spark.createDataFrame(_BOOKS, _BOOK))


@query("SELECT * FROM (VALUES (1, 'VERIFIED_DOI', 'w1'), (2, 'VERIFIED_TITLE', 'w2'), (3, 'VERIFIED_TITLE', 'w3'), (4, 'METADATA_ONLY', NULL), (5, 'VERIFIED_ISBN', 'b1'), (6, 'METADATA_ONLY', NULL), (7, 'NONE', NULL)) t(doc_id, tier, record)")
def resolve_tier(spark, sf_dir):
    return _resolved(spark).select("doc_id", "tier", F.col("record.key").alias("record"))


@query("SELECT * FROM (VALUES (1, 'Own Title', 'P', '2020'), (2, 'Food &amp; <i>Aid</i>', 'Pub', '2019-05'), (3, 'Annual Report 2023', 'Relief Org', '2023'), (4, 'Annual Report 2023', 'Someone Else', '2023'), (5, 'A Book', 'Press House', '2015'), (6, 'Another Book', 'Nobody', NULL), (7, NULL, NULL, NULL)) t(doc_id, title, publisher, publication_date)")
def merge_record(spark, sf_dir):
    return credibility.merge_records(_resolved(spark)).select("doc_id", "title", "publisher", "publication_date")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_name END AS title, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS publisher, CASE WHEN p_size % 5 <> 0 THEN CAST(2000 + p_size % 25 AS VARCHAR) END AS d, CASE WHEN p_size % 2 = 0 THEN 'NONE' ELSE 'VERIFIED_DOI' END AS tier, p_size % 2 = 1 AS a FROM part)
SELECT p_partkey, round_even(30.0::DOUBLE * ((title IS NOT NULL)::INT + (publisher IS NOT NULL)::INT + (d IS NOT NULL)::INT + a::INT) / 5 + CASE WHEN publisher IS NULL THEN 0 WHEN publisher = 'Brand#2' THEN 30 WHEN publisher = 'Brand#4' THEN 22.5 ELSE 15 END
 + CASE WHEN d IS NULL THEN 0 WHEN 2024 - d::INT <= 2 THEN 20 WHEN 2024 - d::INT <= 5 THEN 12 WHEN 2024 - d::INT <= 10 THEN 6 ELSE 3 END + CASE tier WHEN 'NONE' THEN 0 ELSE 20 END, 1)::DOUBLE AS total FROM s""")
def score_source(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    rows = p.select("p_partkey", F.when(n % 4 != 0, F.col("p_name")).alias("title"), F.when(n % 3 != 0, F.col("p_brand")).alias("publisher"), F.when(n % 5 != 0, (2000 + n % 25).cast("string")).alias("publication_date"), F.lit(None).cast("string").alias("doi"),
                    F.when(n % 2 == 1, F.array(F.lit("A B"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(n % 2 == 0, "NONE").otherwise("VERIFIED_DOI").alias("tier"))
    return scoring.source_score(rows, ["Brand#2"], ["Brand#4"], 2024).select("p_partkey", "total")


def chunk_documents(spark, sf_dir):
    # the texts have single line feeds where documents have blank lines
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_documents(docs).select("doc_id", "position", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


query()(chunk_documents)


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END AS page, role AS section, text FROM conversations),
a AS (SELECT *, page IS NULL OR page <= 2 AS early, row_number() OVER (PARTITION BY doc_id, page IS NULL OR page <= 2 ORDER BY id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS na FROM c),
b AS (SELECT *, bool_or(early) OVER (PARTITION BY doc_id) AS has FROM a), k AS (SELECT * FROM b WHERE CASE WHEN has THEN early AND n <= 8 ELSE na <= 3 END),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS pos, row_number() OVER (PARTITION BY doc_id, section ORDER BY id) = 1 AS heading FROM k),
s AS (SELECT *, sum(length(text) + 2 + CASE WHEN heading THEN length(section) + 5 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY id) AS cum FROM h)
SELECT doc_id, id, pos, CAST(cum AS BIGINT) AS cum FROM s WHERE pos = 1 OR cum <= 1500""")
def opening_segment(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("page"), F.col("role").alias("section"), "text")
    return ordered.opening_segment(c, cap=1500).select("doc_id", "id", "pos", "cum")


_MARKS = [(r"\blicense\b", 2), ("copyright", 1), ("all rights reserved", 1), (r"\bof\b", 2), ("the", 1)]


@query("WITH w AS (SELECT source AS doc_id, doc_id AS id, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{m}') THEN {w} ELSE 0 END" for m, w in _MARKS) + """ AS weight FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, id) AS rank FROM w WHERE weight >= 2) SELECT doc_id, id, CAST(weight AS INTEGER) AS weight, rank FROM r WHERE rank <= 4""")
def imprint_scan(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), "text")
    return ordered.imprint_passages(c, markers=_MARKS).select("doc_id", "id", "weight", "rank")
