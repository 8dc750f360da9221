"""Chunking, identity and search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import embed, parse_score, strip, tokens, uuid_of
from paperloom.operators import chunking, rules, search
from paperloom.session import cut, spread, table

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


UUID = "regexp_replace(substr(sha256({}),1,32),'(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})','\\1-\\2-\\3-\\4-\\5')"
SENT = "string_split(regexp_replace(text,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1))"
STRIP = "regexp_replace({},'^\\s+|\\s+$','','g')"
FIXED = "SELECT doc_id, s//450 AS chunk_index, substr(text,s+1,500) AS chunk FROM (SELECT doc_id, text, unnest(range(0,length(text),450)) AS s FROM documents WHERE length(text)>0)"


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


@q("chunk_fixed", f"SELECT doc_id, chunk_index, length(chunk) AS n_chars, {UUID.format("'docs:'||substr(chunk,1,80)")} AS legacy_id, {UUID.format("'docs:'||doc_id||':'||chunk_index||':'||chunk")} AS chunk_id FROM ({FIXED})")
def chunk_fixed(spark, d):
    c = chunking.fixed(docs(spark, d), "doc_id")
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), uuid_of(F.concat(F.lit("docs:"), F.substring("chunk", 1, 80))).alias("legacy_id"), uuid_of(F.concat_ws(":", F.lit("docs"), "doc_id", "chunk_index", "chunk")).alias("chunk_id"))


@q("chunk_page_filtered", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)-1 AS chunk_index, length(c) AS n_chars, {UUID.format("'docs:'||doc_id||':p0:c'||(row_number() OVER (PARTITION BY doc_id ORDER BY s)-1)||':'||substr(c,1,80)")} AS chunk_id FROM (SELECT doc_id, s, substr(text,s+1,400) AS c FROM (SELECT doc_id, text, unnest(range(0,length(text),350)) AS s FROM documents WHERE length(text)>0)) WHERE length({STRIP.format('c')})>30")
def chunk_page_filtered(spark, d):
    c = chunking.page_filtered(docs(spark, d), "doc_id")
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), uuid_of(F.concat(F.lit("docs:"), F.col("doc_id"), F.lit(":p0:c"), F.col("chunk_index"), F.lit(":"), F.substring("chunk", 1, 80))).alias("chunk_id"))


PARENTS = "SELECT doc_id, s//{p} AS parent_index, substr(text,s+1,{p}) AS parent FROM (SELECT doc_id, text, unnest(range(0,length(text),{p})) AS s FROM documents WHERE length(text)>0)"
CHILDREN = "SELECT doc_id, parent_index, s//{c} AS child_index, substr(parent,s+1,{c}) AS chunk FROM (SELECT *, unnest(range(0,length(parent),{c})) AS s FROM ({parents}))"


@q("chunk_parent_child", f"WITH p AS ({PARENTS.format(p=512)}), c AS ({CHILDREN.format(c=128, parents='SELECT * FROM p')}) SELECT doc_id, parent_index, child_index, level, length(chunk) AS n_chars, {UUID.format("level||':'||substr(chunk,1,60)")} AS chunk_id FROM (SELECT doc_id, parent_index, child_index, 'child' AS level, chunk FROM c UNION ALL SELECT doc_id, parent_index, -1, 'parent', parent FROM p)")
def chunk_parent_child(spark, d):
    c = chunking.parent_child(docs(spark, d), "doc_id")
    return c.select("doc_id", "parent_index", "child_index", "level", F.length("chunk").alias("n_chars"), uuid_of(F.concat("level", F.lit(":"), F.substring("chunk", 1, 60))).alias("chunk_id"))


@q("chunk_hierarchy_edges", f"SELECT doc_id, parent_index, count(*) AS children, min(length(chunk)) AS shortest FROM ({CHILDREN.format(c=200, parents=PARENTS.format(p=1000))}) GROUP BY ALL")
def chunk_hierarchy_edges(spark, d):
    c = chunking.parent_child(docs(spark, d), "doc_id", parent=1000, child=200).where("level = 'child'")
    return c.groupBy("doc_id", "parent_index").agg(F.count("*").alias("children"), F.min(F.length("chunk")).alias("shortest"))


WINDOW_SQL = f"WITH s AS (SELECT doc_id, list_filter(list_transform({SENT}, lambda x: {STRIP.format('x')}), lambda x: length(x)>10) AS s FROM documents WHERE length(text)>0), r AS (SELECT doc_id, s, unnest(range(len(s))) AS i FROM s)"


@q("chunk_sentence_window", WINDOW_SQL + " SELECT doc_id, i AS sentence_index, md5(s[i+1]) AS sentence_md5, greatest(0,i-3) AS first_index, least(len(s),i+4)-1 AS last_index, md5(list_aggregate(s[greatest(0,i-3)+1:least(len(s),i+4)],'string_agg',' ')) AS window_md5 FROM r")
def chunk_sentence_window(spark, d):
    c = chunking.sentence_window(docs(spark, d), "doc_id")
    return c.select("doc_id", "sentence_index", F.md5("sentence").alias("sentence_md5"), "first_index", "last_index", F.md5("window_text").alias("window_md5"))


@q("chunk_sentences_api", f"SELECT doc_id, i-1 AS chunk_index, md5(s) AS md5, length(s) AS n_chars FROM (SELECT doc_id, unnest({SENT}) AS s, generate_subscripts({SENT},1) AS i FROM documents WHERE length(text)>0) WHERE length(s)>20")
def chunk_sentences_api(spark, d):
    c = chunking.sentence_rows(docs(spark, d), "doc_id")
    return c.select("doc_id", "chunk_index", F.md5("sentence").alias("md5"), F.length("sentence").alias("n_chars"))


EMB = "SELECT id, b, c, c/sqrt(sum(c*c) OVER (PARTITION BY id)) AS v FROM (SELECT id, ('0x'||substr(sha256(w),1,8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT id, unnest(string_split_regex(lower(t),'[ \\t\\n\\f\\r]+')) AS w FROM {src}) WHERE w<>'' GROUP BY ALL)"


def chunk_semantic(spark, d):
    c = chunking.semantic(docs(spark, d), "doc_id")
    return c.select("doc_id", "segment", F.md5("chunk").alias("md5"), "n_sentences")


Q["chunk_semantic"] = (chunk_semantic, f"""WITH s AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest({SENT}) AS s, generate_subscripts({SENT},1) AS i FROM documents WHERE length(text)>0) WHERE length(s)>20),
 n AS (SELECT *, row_number() OVER (ORDER BY doc_id,i) AS id, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
 e AS ({EMB.format(src='(SELECT id, s AS t FROM n)')}), sim AS (SELECT a.id, sum(a.v*b.v) AS x FROM e a JOIN e b ON b.id=a.id-1 AND a.b=b.b GROUP BY a.id),
 f AS (SELECT n.*, CASE WHEN k>1 AND round(coalesce(x,0),9)<0.3 THEN 1 ELSE 0 END AS brk FROM n LEFT JOIN sim USING (id)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM f),
 j AS (SELECT doc_id, seg, string_agg(s,' ' ORDER BY i) AS chunk, count(*) AS n_sentences, min(total) AS total FROM g GROUP BY doc_id, seg),
 k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg)-1 AS segment, chunk, n_sentences FROM j WHERE length(chunk)>=100 AND total>=2)
 SELECT doc_id, segment, md5(chunk) AS md5, n_sentences FROM k UNION ALL SELECT doc_id, 0, md5(text), 1 FROM documents WHERE length(text)>0 AND doc_id NOT IN (SELECT doc_id FROM k)""")


@q("chunk_contextual", f"WITH f AS ({FIXED}) SELECT f.doc_id, chunk_index, md5(substr(regexp_extract(text,'^([^\\n]*)',1),1,80)||' '||chunk) AS embed_md5 FROM f JOIN documents USING (doc_id)")
def chunk_contextual(spark, d):
    return chunking.contextual(docs(spark, d), "doc_id").select("doc_id", "chunk_index", F.md5("embed_text").alias("embed_md5"))


# ---- identity
@q("page_hash", "SELECT page_id, any_value(sha256(text)) AS hash, any_value(substr(sha256(file_name),1,16)) AS default_doc_id, any_value(length(text)) AS char_count FROM extracted_pages GROUP BY page_id")
def page_hash(spark, d):
    p = table(spark, d, "extracted_pages")
    return p.select("page_id", F.sha2("text", 256).alias("hash"), F.substring(F.sha2("file_name", 256), 1, 16).alias("default_doc_id"), F.length("text").alias("char_count")).distinct()


@q("dedup_exact", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE text IS NOT NULL")
def dedup_exact(spark, d):
    h = docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("h"))
    classes = h.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return h.join(classes, "h").select("doc_id", "class_id", "copies")


@q("id_collisions", f"SELECT legacy_id, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {UUID.format("'docs:'||substr(chunk,1,80)")} AS legacy_id FROM ({FIXED})) GROUP BY 1 HAVING count(*)>1")
def id_collisions(spark, d):
    c = chunking.fixed(docs(spark, d), "doc_id").select("doc_id", uuid_of(F.concat(F.lit("docs:"), F.substring("chunk", 1, 80))).alias("legacy_id"))
    per_doc = c.groupBy("legacy_id", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("legacy_id").agg(F.sum("n").alias("chunks"), F.count("*").alias("docs")).where("chunks > 1")


# ---- search on stored vectors: queries are the rows whose id is divisible by 100
DOT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % 100 == 0)


def out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@q("dense_topk", f"SELECT query_id, id, rank, round(s,5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT},9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id WHERE a.vec_id%100=0) WHERE rank<=5")
def dense_topk(spark, d):
    v = vectors(spark, d)
    return out(search.top_k(asked(v), v, 5))


@q("dense_topk_filtered", f"SELECT query_id, id, rank, round(s,5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT},9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id AND a.label=b.label WHERE a.vec_id%100=0) WHERE rank<=5")
def dense_topk_filtered(spark, d):
    v = vectors(spark, d).withColumn("tag", F.col("label").cast("string"))
    return out(search.top_k(asked(v), v, 5, same=True))


TENANT = "(SELECT vec_id, embedding, tenant_id FROM embeddings JOIN documents ON vec_id=doc_id)"


@q("dense_topk_tenant", f"SELECT query_id, id, rank, round(s,5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT},9) DESC, b.vec_id) AS rank FROM {TENANT} a JOIN {TENANT} b ON a.vec_id<>b.vec_id AND a.tenant_id=b.tenant_id WHERE a.vec_id%100=0) WHERE rank<=5")
def dense_topk_tenant(spark, d):
    v = vectors(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("tenant_id").alias("tag")), "id")
    return out(search.top_k(asked(v), v, 5, same=True))


@q("federated_topk", f"SELECT query_id, id, rank, round(s,5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s,9) DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round({DOT},9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id WHERE a.vec_id%100=0) WHERE r<=5) WHERE rank<=5")
def federated_topk(spark, d):
    v = vectors(spark, d).withColumn("tag", F.col("label").cast("string"))
    labels = [r.tag for r in v.where("tag is not null").select("tag").distinct().collect()]  # one collection per label, a handful
    tagged = asked(v).withColumn("tag", F.explode(F.lit(labels).cast("array<string>")))
    per = search.top_k(tagged, v, 5, same=True).withColumnRenamed("tag", "collection")
    return out(search.federated(lambda: per, 5))


@q("semantic_cache", f"SELECT query_id, hit_id FROM (SELECT a.vec_id AS query_id, min(b.vec_id) AS hit_id FROM embeddings a JOIN embeddings b ON b.vec_id<a.vec_id WHERE a.vec_id%100=0 AND round({DOT},9)>=0.35 GROUP BY 1)")
def semantic_cache(spark, d):
    """First earlier entry that is close enough; the threshold suits the given vectors (the default of the operator's users is 0.92)."""
    v = vectors(spark, d).withColumn("seq", F.col("id"))
    return search.first_hit(asked(v), v, 0.35)


# ---- search on texts
#: A text has fewer chunks than this: a Spark string holds under 2^31 characters, a chunk starts every 450.
CHUNKS = 1 << 23
CH = f"ch AS (SELECT doc_id*{CHUNKS}+chunk_index AS id, doc_id, chunk AS t FROM ({FIXED}))"
QS = "qs AS (SELECT DISTINCT query_id AS id, query AS t, answer FROM query_log WHERE query_id%100=0 AND query IS NOT NULL)"
SCORES = f"ce AS ({EMB.format(src='ch')}), qe AS ({EMB.format(src='qs')}), sc AS (SELECT qe.id AS query_id, ce.id, round(sum(qe.v*ce.v),9) AS score FROM qe JOIN ce USING (b) GROUP BY ALL)"
CAND = f"{CH}, {QS}, {SCORES}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank<=15)"
BM = """tk AS (SELECT query_id, id, unnest(string_split_regex(lower(ch.t),'\\s+')) AS w FROM cand JOIN ch USING (id)), tw AS (SELECT * FROM tk WHERE w<>''),
 ln AS (SELECT query_id, id, count(*) AS len FROM tw GROUP BY ALL), sz AS (SELECT query_id, count(*) AS n, avg(len) AS al FROM ln GROUP BY 1), tf AS (SELECT query_id, id, w, count(*) AS tf FROM tw GROUP BY ALL),
 df AS (SELECT query_id, w, count(*) AS n FROM tf GROUP BY ALL), i0 AS (SELECT df.query_id, w, ln(sz.n-df.n+0.5)-ln(df.n+0.5) AS idf FROM df JOIN sz USING (query_id)), mi AS (SELECT query_id, avg(idf) AS m FROM i0 GROUP BY 1),
 idf AS (SELECT i0.query_id, w, CASE WHEN idf<0 THEN m*0.25 ELSE idf END AS idf FROM i0 JOIN mi USING (query_id)), qw AS (SELECT id AS query_id, w, count(*) AS qn FROM (SELECT id, unnest(string_split_regex(lower(t),'\\s+')) AS w FROM qs) WHERE w<>'' GROUP BY ALL),
 bms AS (SELECT query_id, id, sum(qn*idf*tf*2.5/(tf+1.5*(0.25+0.75*len/al))) AS s FROM tf JOIN qw USING (query_id,w) JOIN idf USING (query_id,w) JOIN ln USING (query_id,id) JOIN sz USING (query_id) GROUP BY ALL),
 bm AS (SELECT cand.query_id, cand.id, coalesce(s,0) AS s, cand.rank AS dr FROM cand LEFT JOIN bms USING (query_id,id)),
 bmr AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s,9) DESC, id) AS r FROM bm)"""


def chunks(spark, d, of: DataFrame | None = None) -> DataFrame:
    """(id, doc_id, text) of all chunks, or of the documents `of` (doc_id)."""
    t = spread(docs(spark, d)) if of is None else docs(spark, d).join(of, "doc_id", "left_semi")  # embedding is shared among tasks
    return chunking.fixed(t, "doc_id").select((F.col("doc_id") * CHUNKS + F.col("chunk_index")).alias("id"), "doc_id", F.col("chunk").alias("text"))


def questions(spark, d) -> DataFrame:
    return table(spark, d, "query_log").where((F.col("query_id") % 100 == 0) & F.col("query").isNotNull()).select(F.col("query_id").alias("id"), F.col("query").alias("text"), "answer").distinct()


def candidates(spark, d, k: int = 15, qs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k chunks nearest to each question."""
    qs = questions(spark, d) if qs is None else qs
    return search.top_k(qs.select("id", embed("text").alias("vec")), chunks(spark, d).select("id", embed("text").alias("vec")), k, exclude_self=False)


def with_texts(spark, d, cand: DataFrame) -> DataFrame:
    """Candidates with chunk and question texts; only the documents of candidates are chunked again."""
    cand = cut(cand)
    c = chunks(spark, d, cand.select(F.expr(f"id div {CHUNKS}").alias("doc_id")).distinct()).withColumnRenamed("text", "chunk")
    return cand.join(c, "id").join(questions(spark, d).select(F.col("id").alias("query_id"), F.col("text").alias("query"), "answer"), "query_id")


INJECT, PII = f"(?i){rules.INJECTION}", rules.PII


@q("search_screened", f"WITH {CAND} SELECT query_id, rank, cand.id AS chunk_id, doc_id, round(score,5) AS score, regexp_matches(t,'{PII}') AS has_pii FROM cand JOIN ch USING (id) WHERE rank<=5 AND NOT regexp_matches(t,'{INJECT}')")
def search_screened(spark, d):
    c = with_texts(spark, d, candidates(spark, d, 5)).where(~F.col("chunk").rlike(INJECT))
    return c.select("query_id", "rank", F.col("id").alias("chunk_id"), "doc_id", F.round("score", 5).alias("score"), F.col("chunk").rlike(PII).alias("has_pii"))


@q("multi_doc_sources", f"WITH {CAND} SELECT query_id, coalesce(source,'unknown') AS source, count(*) AS chunks, min(rank) AS best_rank FROM cand JOIN ch USING (id) JOIN documents USING (doc_id) WHERE rank<=10 GROUP BY ALL")
def multi_doc_sources(spark, d):
    c = candidates(spark, d, 10).withColumn("doc_id", F.expr(f"id div {CHUNKS}"))
    s = c.join(docs(spark, d).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source")), "doc_id")
    return s.groupBy("query_id", "source").agg(F.count("*").alias("chunks"), F.min("rank").alias("best_rank"))


def _bm25(spark, d, cand: DataFrame) -> DataFrame:
    t = with_texts(spark, d, cand)
    return search.bm25(t.select("query_id", "query", "id", F.col("chunk").alias("text")))


@q("bm25_topk", f"WITH {CAND}, {BM} SELECT query_id, id, r AS rank, round(s,5) AS bm25 FROM bmr WHERE r<=5")
def bm25_topk(spark, d):
    b = _bm25(spark, d, cut(candidates(spark, d)))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "id"))
    return b.withColumn("rank", r).where("rank <= 5").select("query_id", "id", "rank", F.round("bm25", 5).alias("bm25"))


def _fuse_sql(lists: str, k: int) -> str:
    return f"li AS ({lists}), fu AS (SELECT query_id, id, round(sum(1.0/(60+r)),9) AS rrf, min(l*1000+r) AS f FROM li GROUP BY ALL) SELECT query_id, id, rank, round(rrf,6) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f, id) AS rank FROM fu) WHERE rank<={k}"


@q("hybrid_rrf", f"WITH {CAND}, {BM}, " + _fuse_sql("SELECT query_id, id, rank AS r, 0 AS l FROM cand UNION ALL SELECT query_id, id, r, 1 FROM bmr", 5))
def hybrid_rrf(spark, d):
    c = cut(candidates(spark, d))
    lists = c.select("query_id", F.lit(0).alias("list_no"), "id", "rank").unionByName(search.ranked(_bm25(spark, d, c), "bm25", 1))
    return search.rrf(lists, 5).select("query_id", "id", "rank", F.round("rrf", 6).alias("rrf"))


VAR = "va AS (SELECT id*10 AS id, t FROM qs UNION ALL SELECT id*10+1, array_to_string(w[1:len(w)//2],' ') FROM (SELECT id, list_filter(string_split_regex(lower(t),'\\s+'), lambda x: x<>'') AS w FROM qs) UNION ALL SELECT id*10+2, array_to_string(w[len(w)//2+1:len(w)],' ') FROM (SELECT id, list_filter(string_split_regex(lower(t),'\\s+'), lambda x: x<>'') AS w FROM qs))"
VS = f"ce AS ({EMB.format(src='ch')}), qe AS ({EMB.format(src='va')}), sc AS (SELECT qe.id AS vid, ce.id, round(sum(qe.v*ce.v),9) AS score FROM qe JOIN ce USING (b) GROUP BY ALL), vr AS (SELECT vid//10 AS query_id, vid%10 AS l, id, row_number() OVER (PARTITION BY vid ORDER BY score DESC, id) AS r FROM sc)"


@q("fusion_rrf", f"WITH {CH}, {QS}, {VAR}, {VS}, " + _fuse_sql("SELECT query_id, id, r, l FROM vr WHERE r<=5", 5))
def fusion_rrf(spark, d):
    """The question and two variants (its halves, by the default provider), searched and fused."""
    w = tokens(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    v = questions(spark, d).select("id", F.posexplode(F.array(F.col("text"), F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).alias("v", "t"))
    v = v.where("t <> ''").select((F.col("id") * 10 + F.col("v")).alias("id"), F.col("t").alias("text"))
    c = candidates(spark, d, 5, v)
    lists = c.select(F.expr("query_id div 10").alias("query_id"), (F.col("query_id") % 10).cast("int").alias("list_no"), "id", "rank")
    return search.rrf(lists, 5).select("query_id", "id", "rank", F.round("rrf", 6).alias("rrf"))


HY = f"he AS ({EMB.format(src='(SELECT id, coalesce(answer,t) AS t FROM qs)')}), hs AS (SELECT he.id AS query_id, ce.id, round(sum(he.v*ce.v),9) AS score FROM he JOIN ce USING (b) GROUP BY ALL), hr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r, score FROM hs)"


@q("hyde_topk", f"WITH {CAND}, {HY} SELECT query_id, id, r AS rank, round(score,5) AS score FROM hr WHERE r<=5")
def hyde_topk(spark, d):
    """The hypothesis is the logged answer, or the question where none is logged."""
    h = questions(spark, d).select("id", F.coalesce("answer", "text").alias("text"))
    return out(candidates(spark, d, 5, h))


@q("ensemble_rrf", f"WITH {CAND}, {BM}, {HY}, " + _fuse_sql("SELECT query_id, id, rank AS r, 0 AS l FROM cand WHERE rank<=5 UNION ALL SELECT query_id, id, r, 1 FROM bmr WHERE r<=5 UNION ALL SELECT query_id, id, r, 2 FROM hr WHERE r<=5", 5))
def ensemble_rrf(spark, d):
    """Questions and hypotheses are searched in one pass over the chunks, as queries of even and odd number."""
    qs = questions(spark, d)
    both = qs.select((F.col("id") * 2).alias("id"), "text").unionByName(qs.select((F.col("id") * 2 + 1).alias("id"), F.coalesce("answer", "text").alias("text")))
    found = cut(candidates(spark, d, 15, both)).select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).alias("kind"), "id", "score", "rank")
    c = found.where("kind = 0").drop("kind")
    lists = c.where("rank <= 5").select("query_id", F.lit(0).alias("list_no"), "id", "rank")
    lists = lists.unionByName(search.ranked(_bm25(spark, d, c), "bm25", 1, 5)).unionByName(found.where("kind = 1 and rank <= 5").select("query_id", F.lit(2).alias("list_no"), "id", "rank"))
    return search.rrf(lists, 5).select("query_id", "id", "rank", F.round("rrf", 6).alias("rrf"))


OVER = "ov AS (SELECT cand.query_id, cand.id, rank, round(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(qs.t),'\\s+'),lambda x: x<>'')), list_distinct(string_split_regex(lower(ch.t),'\\s+'))))::DOUBLE / nullif(len(list_distinct(list_filter(string_split_regex(lower(qs.t),'\\s+'),lambda x: x<>''))),0),3) AS f FROM cand JOIN ch USING (id) JOIN qs ON qs.id=cand.query_id)"


def overlap(query, text):
    """Share of the distinct words of the query that the text has (default scoring provider)."""
    w = F.array_distinct(tokens(query))
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, tokens(text))) / F.size(w))


@q("rerank", f"WITH {CAND}, {OVER} SELECT query_id, id, new_rank, rank AS old_rank, f AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, rank) AS new_rank FROM ov) WHERE new_rank<=5")
def rerank(spark, d):
    """Candidates by the score read from the provider's reply; equal scores keep their order."""
    c = with_texts(spark, d, candidates(spark, d))
    reply = F.format_string("%.3f", F.round(overlap(F.col("query"), F.col("chunk")), 3))
    c = c.withColumn("f", parse_score(reply, 0.0))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("f"), "rank"))
    return c.withColumn("new_rank", r).where("new_rank <= 5").select("query_id", "id", "new_rank", F.col("rank").alias("old_rank"), F.col("f").alias("score"))


@q("compress_ratio", f"WITH {CAND}, x AS (SELECT query_id, ch.t, (SELECT coalesce(sum(length(s)),0) FROM (SELECT unnest(string_split(regexp_replace(ch.t,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1))) AS s) WHERE len(list_intersect(list_distinct(string_split_regex(lower(s),'\\s+')), list_filter(string_split_regex(lower(qs.t),'\\s+'),lambda y: length(y)>4)))>0) AS kept FROM cand JOIN ch USING (id) JOIN qs ON qs.id=cand.query_id WHERE rank<=5) SELECT query_id, sum(kept) AS kept, sum(length(t)) AS total, round(sum(kept)::DOUBLE/sum(length(t)),3) AS ratio FROM x GROUP BY 1")
def compress_ratio(spark, d):
    """Sentences of the best chunks that share a longer word with the question are kept."""
    c = with_texts(spark, d, candidates(spark, d, 5))
    want = F.filter(tokens(F.col("query")), lambda x: F.length(x) > 4)
    c = c.withColumn("want", want).withColumn("s", F.split("chunk", r"(?<=[.!?])\s+"))
    kept = F.aggregate(F.filter("s", lambda s: F.arrays_overlap(F.split(F.lower(s), r"\s+"), F.col("want"))), F.lit(0), lambda a, s: a + F.length(s))
    return c.groupBy("query_id").agg(F.sum(kept).alias("kept"), F.sum(F.length("chunk")).alias("total")).withColumn("ratio", F.round(F.col("kept") / F.col("total"), 3))


@q("guard_retrieval", f"WITH {CAND} SELECT query_id, count(*) AS n_chunks, count(*)>10 AS diluted, max(CASE WHEN rank=1 THEN round(score,5) END) AS top_score, max(CASE WHEN rank=1 THEN score END)<0.25 AS vocabulary_gap FROM cand GROUP BY 1")
def guard_retrieval(spark, d):
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    return candidates(spark, d).groupBy("query_id").agg(F.count("*").alias("n_chunks"), (F.count("*") > 10).alias("diluted"), F.round(top, 5).alias("top_score"), (top < 0.25).alias("vocabulary_gap"))
