"""Registry of the queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls, vectors
from ..operators import chunk as C
from ..operators import crawl, ingest, search
from . import oracle

K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents")


def _chunks(spark, d):
    return C.chunk(_docs(spark, d))


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed by hash, search for one question, and project the top five."""
    q = spark.createDataFrame([(1, "Which pages speak of the and attion?")], "query_id long, question string")
    chunks = _chunks(spark, sf_dir)
    hits = search.hash_hits(chunks, q.select("query_id", F.lit(0).alias("ord"), F.col("question").alias("query")), K)
    return search.sources(hits.select("query_id", "chunk_id", "score", "rank"), chunks, _docs(spark, sf_dir))


def text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def markdown_strip(spark, d):
    return _docs(spark, d).select("doc_id", text.strip_markdown(F.col("text")).alias("plain"))


def page_text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", text.clean_page(F.col("text")).alias("clean"))


def chunk_documents(spark, d):
    return _chunks(spark, d)


def chunk_counts(spark, d):
    n = _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return _docs(spark, d).select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def doc_checksum(spark, d):
    return ingest.with_checksum(_docs(spark, d)).select("doc_id", "checksum")


def dedupe_reject(spark, d):
    return ingest.rejected(_docs(spark, d))


def doc_versions(spark, d):
    return ingest.versions(_docs(spark, d))


def incremental_report(spark, d):
    return ingest.reuse_report(_docs(spark, d), _chunks(spark, d))


def parent_chunks(spark, d):
    return C.parents(_chunks(spark, d))


def document_text(spark, d):
    return C.document_text(_chunks(spark, d))


def document_section(spark, d):
    return C.section(_chunks(spark, d), "tion")


def fingerprint(spark, d):
    return ingest.fingerprint(_docs(spark, d), _chunks(spark, d))


def delete_documents(spark, d):
    """The chunks left after the documents labelled toxic are deleted."""
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return ingest.without(_chunks(spark, d), gone).groupBy("doc_id").agg(F.count("*").alias("chunks"))


def pending_index(spark, d):
    """English documents are there already, others are pending."""
    docs = _docs(spark, d)
    return ingest.indexed(docs.where("lang <> 'en'"), docs.where("lang = 'en'"))


def hash_embed_counts(spark, d):
    v = _docs(spark, d).select("doc_id", F.posexplode(vectors.hash_counts(F.col("text"))).alias("bucket", "n"))
    return v.where("n > 0").select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


def excerpts(spark, d):
    return _docs(spark, d).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.display_name(F.lit(None).cast("string"), F.col("source"), F.col("doc_id")).alias("name"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def vector_cosine(spark, d):
    """Every vector's similarity to the first one, by native expressions."""
    v = _vectors(spark, d)
    first = v.orderBy("item_id").limit(1).select(F.col("vector").alias("q"))
    return v.crossJoin(F.broadcast(first)).select("item_id", (F.round(vectors.cosine(F.col("vector"), F.col("q")), 6) + 0.0).alias("score"))


def vector_topk(spark, d):
    v = _vectors(spark, d)
    return search.nearest(v, v.select(F.col("item_id").alias("query_id"), "vector"), K)


def vector_minscore(spark, d):
    v = _vectors(spark, d)
    return search.nearest(v, v.select(F.col("item_id").alias("query_id"), "vector"), K, least=0.5)


def vector_tenant(spark, d):
    v = _vectors(spark, d)
    return search.nearest(v, v.select(F.col("item_id").alias("query_id"), "vector", "label"), K, same="label")


def query_terms(spark, d):
    return _questions(spark, d).select("query_id", F.posexplode(text.terms(F.col("question"))).alias("ord", "term"))


def _said(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def query_expand(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.posexplode(text.query_variants(F.col("text"))).alias("ord", "query"))


def multi_query(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.posexplode(text.multi_query(F.col("text"), 3)).alias("ord", "query"))


def entity_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.entity_tokens(F.col("text"))).alias("entity"))


def conversation_rewrite(spark, d):
    return search.rewritten(table(spark, d, "conversations"))


def keyword_search(spark, d):
    return search.keyword_hits(_chunks(spark, d), _questions(spark, d))


def hash_vector_search(spark, d):
    q = _questions(spark, d).select("query_id", F.lit(0).alias("ord"), F.col("question").alias("query"))
    return search.hash_hits(_chunks(spark, d), q, K).select("query_id", "chunk_id", "score", "rank")


def _matches(spark, d):
    return search.retrieve(_chunks(spark, d), _questions(spark, d), K)


def hybrid_merge(spark, d):
    return _matches(spark, d)


def metadata_filter(spark, d):
    """Only chunks of documents labelled of good quality; documents without a label fail."""
    keep = table(spark, d, "labels").where("quality <=> 1").select("doc_id")
    return search.retrieve(_chunks(spark, d), _questions(spark, d), K, keep=keep)


def authorize(spark, d):
    """Of the matches, those whose document isn't labelled toxic."""
    banned = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    m = _matches(spark, d).withColumn("doc_id", F.floor(F.col("chunk_id") / C.SPAN))
    return m.join(banned, "doc_id", "left_anti").select("query_id", "chunk_id", "score", "rank")


def lexical_rerank(spark, d):
    return search.lexical_rerank(_matches(spark, d), _chunks(spark, d), _questions(spark, d))


def entity_boost(spark, d):
    return search.entity_boost(_matches(spark, d), _chunks(spark, d), _questions(spark, d))


def entity_verdict(spark, d):
    return search.entity_verdict(_matches(spark, d), _chunks(spark, d), _questions(spark, d))


def retrieval_trace(spark, d):
    """How many of each query's matches came by vector and by keyword, and the best score."""
    by = _matches(spark, d).groupBy("query_id")
    return by.agg(F.count_if(F.col("via") == "vector").alias("by_vector"), F.count_if(F.col("via") == "keyword").alias("by_keyword"), F.round(F.max("score"), 4).alias("best"))


def expand_neighbors(spark, d):
    return search.expanded(_matches(spark, d), _chunks(spark, d))


def expand_parents(spark, d):
    return search.parents_of(_matches(spark, d))


def compress_budget(spark, d):
    return search.compressed(_matches(spark, d), _chunks(spark, d))


def prompt_context(spark, d):
    return search.prompts(_matches(spark, d), _chunks(spark, d), _docs(spark, d), _questions(spark, d))


def _cited(spark, d):
    """Made-up answers: each query cites the same six strings, of which some aren't sources."""
    return _questions(spark, d).select("query_id", F.array(*map(F.lit, ["2", " 1 ", "0", "x", "2", "99"])).alias("citations"))


def citations_validate(spark, d):
    return search.valid_citations(_cited(spark, d), _matches(spark, d))


def citations_grouped(spark, d):
    return search.grouped_citations(citations_validate(spark, d), _chunks(spark, d))


def confidence(spark, d):
    return search.confidence(_matches(spark, d), citations_validate(spark, d), _questions(spark, d))


def sources(spark, d):
    return search.sources(_matches(spark, d), _chunks(spark, d), _docs(spark, d))


def eval_hit_rate(spark, d):
    cases = _questions(spark, d).select("query_id", F.array(F.concat(F.lit("SRC"), (F.col("query_id") % 10).cast("string"))).alias("expected_sources"))
    return search.evaluated(_matches(spark, d), _chunks(spark, d), _docs(spark, d), cases)


def _pages(spark, d):
    return table(spark, d, "pages")


def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", urls.normalize(F.col("url")).alias("normal"))


def url_title(spark, d):
    return _pages(spark, d).select("page_id", urls.title(F.col("url")).alias("title"), urls.skipped(F.col("url")).alias("skipped"), urls.private_address(F.col("url")).alias("private"))


def page_links(spark, d):
    return crawl.links(_pages(spark, d))


def link_bfs(spark, d):
    """Hosts reached from the host of page 0 within three steps, where a page's host leads to the host of the next page."""
    p = _pages(spark, d).select("page_id", F.lower(urls.part(F.col("url"), 2)).alias("host"))
    edges = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("target")), "page_id").select(F.col("host").alias("source"), "target").where("source <> target").distinct()
    return crawl.reachable(edges, p.where("page_id = 0").select(F.col("host").alias("node")), 3)


def html_extract(spark, d):
    return crawl.extracted(_pages(spark, d)).select("page_id", "title", "text")


def html_titles(spark, d):
    return crawl.extracted(_pages(spark, d)).select("page_id", "title")


def crawl_report(spark, d):
    return crawl.report(crawl.outcomes(_pages(spark, d)))


_NAMES = """text_normalize markdown_strip page_text_normalize chunk_documents chunk_counts doc_checksum dedupe_reject doc_versions
incremental_report parent_chunks document_text document_section fingerprint delete_documents pending_index hash_embed_counts excerpts
vector_cosine vector_topk vector_minscore vector_tenant query_terms query_expand multi_query entity_tokens conversation_rewrite keyword_search
hash_vector_search hybrid_merge metadata_filter authorize lexical_rerank entity_boost entity_verdict retrieval_trace expand_neighbors
expand_parents compress_budget prompt_context citations_validate citations_grouped confidence sources eval_hit_rate url_normalize url_title
page_links link_bfs html_extract html_titles crawl_report""".split()


def queries() -> dict:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict:
    return oracle.statements()
