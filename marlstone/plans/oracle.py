"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from ..functions import text, urls
from ..operators.search import GUARD

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_TRIM = lambda x: f"trim({x}, {_BLANKS})"
_LINES = lambda x: f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
_FEW = lambda x: f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _markdown() -> str:
    x = _LINES("text")
    for pattern, to in ((r"(?m)^```[a-zA-Z0-9]*\n", ""), ("```", ""), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s{0,3}[-*+]\s+", ""), (r"\*\*|__|\*|_|`", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _TRIM(_FEW(x))


def _cut() -> str:
    parts = []
    for needle in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
        at = f"instr(reverse(win), reverse({needle}))"
        last = f"(length(win) - {at} - length({needle}) + 1)"
        parts.append(f"CASE WHEN {at} > 0 AND {last} >= 500 THEN {last} + length({needle}) END")
    return f"coalesce({', '.join(parts)}, 1000)"


_WORDS = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _first(list_: str) -> str:
    """A list without later repeats."""
    return f"list_filter({list_}, lambda w, i: list_position({list_}, w) = i)"


def _terms(x: str) -> str:
    return _first(f"list_filter({_WORDS(x)}, lambda w: length(w) >= 3 AND w NOT IN ({_LIST(text.STOP_WORDS)}))")


def _entities(x: str) -> str:
    found = rf"list_transform(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+')), lambda w: lower(w))"
    return _first(f"list_filter({found}, lambda w: w NOT IN ({_LIST(text.ENTITY_STOP_WORDS)}))")


def _variants(x: str) -> str:
    low = f"lower({_TRIM(x)})"
    parts = [f"[{x}]"]
    for needles, extra in text.INTENTS:
        some = " OR ".join(f"contains({low}, '{n}')" for n in needles)
        parts.append(f"CASE WHEN {some} THEN [{_LIST(extra)}] ELSE []::VARCHAR[] END")
    every = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    return f"CASE WHEN {low} = '' THEN [{x}] ELSE {_first(every)} END"


def _multi(x: str, n: int) -> str:
    entity = f"array_to_string({_entities(x)}, ' ')"
    every = f"list_concat(list_concat([{x}], CASE WHEN {entity} <> '' THEN [{entity}] ELSE []::VARCHAR[] END), {_variants(x)})"
    return f"{_first(every)}[1:{n}]"


def _part(x: str, k: int) -> str:
    return rf"regexp_extract({x}, '^(?i)(https?)://(?:[^/?#@]*@)?([^/:?#]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?', {k})"


def _normal(x: str) -> str:
    x = f"trim({x})"
    path = f"regexp_replace({_part(x, 4)}, '/+', '/', 'g')"
    kept = f"array_to_string(list_filter(string_split({_part(x, 5)}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid)(=|$)')), '&')"
    return (
        f"CASE WHEN {_part(x, 2)} <> '' THEN lower({_part(x, 1)}) || '://' || lower({_part(x, 2)}) || CASE WHEN {_part(x, 3)} <> '' THEN ':' || {_part(x, 3)} ELSE '' END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"
    )


def _resolve(h: str, u: str) -> str:
    origin = f"lower({_part(u, 1)}) || '://' || {_part(u, 2)} || CASE WHEN {_part(u, 3)} <> '' THEN ':' || {_part(u, 3)} ELSE '' END"
    folder = f"regexp_replace(CASE WHEN {_part(u, 4)} = '' THEN '/' ELSE {_part(u, 4)} END, '/[^/]*$', '/')"
    return f"CASE WHEN starts_with({h}, '//') THEN lower({_part(u, 1)}) || ':' || {h} WHEN regexp_matches({h}, '^(?i)https?://') THEN {h} WHEN starts_with({h}, '/') THEN {origin} || {h} ELSE {origin} || {folder} || {h} END"


def _skipped(x: str) -> str:
    return rf"lower(regexp_extract({_part(x, 4)}, '\.([^./]+)$', 1)) IN ({_LIST(urls.SKIPPED)})"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


_COUNTS = lambda x: f"list_transform(range(0, 32), lambda k: len(list_filter(list_transform({_WORDS(x)}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32), lambda b: b = k)))"

#: Name -> (names it needs, SQL).
_CTE: dict[str, tuple[str, str]] = {
    "trimmed": ("", f"SELECT doc_id, {_TRIM('text')} AS t, length({_TRIM('text')}) AS n FROM documents WHERE {_TRIM('text')} <> ''"),
    "windows": ("trimmed", "SELECT doc_id, t, n, unnest(range(0, CASE WHEN n <= 1000 THEN 1 ELSE CAST(ceil((n - 1000) / 800.0) AS BIGINT) + 1 END)) AS k FROM trimmed"),
    "seen": ("windows", "SELECT doc_id, k, substr(t, k * 800 + 1, 1000) AS win, k * 800 + 1000 >= n AS final FROM windows"),
    "pieces": ("seen", f"SELECT doc_id, k, {_TRIM(f'CASE WHEN final THEN win ELSE substr(win, 1, {_cut()}) END')} AS content FROM seen"),
    "chunks": ("pieces", "SELECT doc_id * 4194304 + row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS position, content FROM pieces WHERE content <> ''"),
    "questions": ("", "SELECT item_id AS query_id, text AS question FROM benchmark"),
    "sums": ("", "SELECT doc_id, source, text, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL"),
    "pair_scores": ("", "SELECT q.vec_id AS query_id, v.vec_id AS item_id, q.label AS ql, v.label AS vl, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings v"),
    "said": ("", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"),
    "variants": ("questions", f"SELECT query_id, unnest(range(0, len(v))) AS ord, unnest(v) AS query FROM (SELECT query_id, {_multi('question', 3)} AS v FROM questions)"),
    "cvec": ("chunks", f"SELECT chunk_id, c, {_dot('c', 'c')} AS cc FROM (SELECT chunk_id, {_COUNTS('content')} AS c FROM chunks)"),
    "qvec": ("variants", f"SELECT query_id, ord, q, {_dot('q', 'q')} AS qq FROM (SELECT query_id, ord, {_COUNTS('query')} AS q FROM variants)"),
    "vec_all": ("cvec qvec", f"SELECT query_id, ord, chunk_id, CASE WHEN qq > 0 AND cc > 0 THEN round({_dot('q', 'c')} / (sqrt(qq) * sqrt(cc)), 6) ELSE 0.0 END AS score FROM cvec, qvec"),
    "vec": ("vec_all", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ord ORDER BY score DESC, chunk_id) AS rank FROM vec_all) WHERE rank <= 5"),
    "qterms": ("questions", f"SELECT query_id, {_terms('question')} AS terms FROM questions"),
    "kw_all": ("chunks qterms", "SELECT query_id, chunk_id, len(terms) AS n, len(list_filter(terms, lambda t: contains(low, t))) AS matched FROM (SELECT chunk_id, lower(content) AS low FROM chunks), qterms WHERE len(terms) > 0"),
    "kw": ("kw_all", "SELECT query_id, chunk_id, CAST(matched AS BIGINT) AS matched, round(least(1.0, 0.8 + 0.1 * matched / n), 6) AS score FROM kw_all WHERE matched > 0"),
    "kw_few": ("kw", "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM kw) WHERE n <= 15"),
    "every": ("vec kw_few", "SELECT query_id, chunk_id, score, ord, rank FROM vec UNION ALL SELECT query_id, chunk_id, score, 3, rank FROM kw_few"),
    "firsts": ("every", "SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, ord, rank) AS b, min(struct_pack(o := ord, r := rank)) OVER (PARTITION BY query_id, chunk_id) AS f FROM every"),
    "best": ("firsts", "SELECT query_id, chunk_id, score, CASE WHEN ord = 3 THEN 'keyword' ELSE 'vector' END AS via, f.o AS o, f.r AS r FROM firsts WHERE b = 1"),
    "matches": ("best", "SELECT query_id, chunk_id, score, via, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, chunk_id) AS INTEGER) AS rank FROM best) WHERE rank <= 5"),
    "cited": ("matches", "SELECT query_id, source_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS ord FROM (VALUES (0, 2), (1, 1)) c(pos, source_id) JOIN matches ON rank = source_id"),
    "near": ("matches chunks", "SELECT DISTINCT m.query_id, c.chunk_id, c.doc_id FROM matches m JOIN chunks a USING (chunk_id) JOIN chunks c ON c.doc_id = a.doc_id AND c.position BETWEEN a.position - 1 AND a.position + 1"),
    "top_of_doc": ("matches chunks", "SELECT query_id, doc_id, max(score) AS best FROM matches JOIN chunks USING (chunk_id) GROUP BY ALL"),
    "ents": ("questions", f"SELECT query_id, {_entities('question')} AS e FROM questions"),
    "hosts": ("", f"SELECT page_id, lower({_part('url', 2)}) AS host FROM pages"),
    "edges": ("hosts", "SELECT DISTINCT a.host AS source, b.host AS target FROM hosts a JOIN hosts b ON b.page_id = a.page_id + 1 WHERE a.host <> b.host"),
    "d0": ("hosts", "SELECT host AS node FROM hosts WHERE page_id = 0"),
    "d1": ("edges d0", "SELECT DISTINCT target AS node FROM edges JOIN d0 ON source = node WHERE target NOT IN (SELECT node FROM d0)"),
    "d2": ("edges d0 d1", "SELECT DISTINCT target AS node FROM edges JOIN d1 ON source = node WHERE target NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1)"),
    "d3": ("edges d0 d1 d2", "SELECT DISTINCT target AS node FROM edges JOIN d2 ON source = node WHERE target NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1 UNION SELECT node FROM d2)"),
}


def with_tables(needs: str, sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _CTE[name][0].split():
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    return ("WITH " + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order) + "\n" if order else "") + sql


def _top(where: str) -> str:
    return f"SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pair_scores WHERE {where}) WHERE rank <= 5"


_JOINED = "array_to_string(list(content ORDER BY position), chr(10) || chr(10))"
_RERANK = "SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS INTEGER) AS rank FROM ({})"
_PRONOUN = r"(regexp_matches(text, '(?i)^\s*(what|who|where|when|why|how|is|are|does|do|can|could|would|tell|give)\s+(he|she|it|they|him|her|his|its|their|them|this|that)\b') OR regexp_matches(text, '(?i)\b(he|she|it|they|him|her|his|its|their|them)\b'))"
_LAST_PART = f"list_filter(string_split({_part('url', 4)}, '/'), lambda x: x <> '')[-1]"


def statements() -> dict[str, str]:
    s = {
        "text_normalize": ("", f"SELECT doc_id, {_TRIM(_FEW(_LINES('text')))} AS clean FROM documents"),
        "markdown_strip": ("", f"SELECT doc_id, {_markdown()} AS plain FROM documents"),
        "page_text_normalize": ("", f"SELECT doc_id, {_TRIM(_FEW('regexp_replace(replace(' + _LINES('text') + f''', chr(12), chr(10)), '[ \\t]+', ' ', 'g')'''))} AS clean FROM documents"),
        "chunk_documents": ("chunks", "SELECT chunk_id, doc_id, position, content FROM chunks"),
        "chunk_counts": ("chunks", "SELECT doc_id, count(chunk_id) AS chunks FROM documents LEFT JOIN chunks USING (doc_id) GROUP BY doc_id"),
        "doc_checksum": ("", "SELECT doc_id, sha256(text) AS checksum FROM documents"),
        "dedupe_reject": ("sums", "SELECT checksum, min(doc_id) AS doc_id, count(*) AS copies FROM sums GROUP BY checksum"),
        "doc_versions": ("sums", "SELECT doc_id, first_value(doc_id) OVER w AS root_id, row_number() OVER w AS version, lag(doc_id) OVER w AS previous_id FROM sums WINDOW w AS (PARTITION BY checksum ORDER BY doc_id)"),
        "incremental_report": ("chunks", """SELECT d.doc_id, count(c.chunk_id) - count(k.hash) AS added, CAST(0 AS BIGINT) AS updated, greatest(0, coalesce(any_value(b.n), 0) - count(k.hash)) AS removed, count(k.hash) AS unchanged
            FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS earlier FROM documents) d LEFT JOIN chunks c ON c.doc_id = d.doc_id
            LEFT JOIN (SELECT DISTINCT doc_id, sha256(content) AS hash FROM chunks) k ON k.doc_id = d.earlier AND k.hash = sha256(c.content)
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) b ON b.doc_id = d.earlier GROUP BY d.doc_id"""),
        "parent_chunks": ("chunks", f"SELECT doc_id, CAST(position // 4 AS BIGINT) AS parent, min(position) AS first_position, count(*) AS children, {_JOINED} AS content FROM chunks GROUP BY 1, 2"),
        "document_text": ("chunks", f"SELECT doc_id, substr({_JOINED}, 1, 6000) AS text FROM chunks GROUP BY 1"),
        "document_section": ("chunks", f"SELECT doc_id, substr({_JOINED}, 1, 5000) AS text FROM chunks WHERE contains(lower(content), 'tion') GROUP BY 1"),
        "fingerprint": ("chunks", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT max(doc_id) FROM documents) AS last_document, count(*) AS chunks, max(chunk_id) AS last_chunk FROM chunks"),
        "delete_documents": ("chunks", "SELECT doc_id, count(*) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"),
        "pending_index": ("", f"""SELECT doc_id, CASE WHEN {_TRIM('text')} = '' THEN 'failed' WHEN n > 1 OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') THEN 'duplicate' ELSE 'indexed' END AS status
            FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE lang <> 'en')"""),
        "hash_embed_counts": ("", f"SELECT doc_id, CAST(b AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32 AS b FROM (SELECT doc_id, unnest({_WORDS('text')}) AS w FROM documents)) GROUP BY ALL"),
        "excerpts": ("", "SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200)) || '...' ELSE text END AS excerpt, source AS name FROM documents"),
        "vector_cosine": ("pair_scores", "SELECT item_id, score FROM pair_scores WHERE query_id = (SELECT min(vec_id) FROM embeddings)"),
        "vector_topk": ("pair_scores", _top("score >= 0")),
        "vector_minscore": ("pair_scores", _top("score >= 0.5")),
        "vector_tenant": ("pair_scores", _top("score >= 0 AND ql = vl")),
        "query_terms": ("qterms", "SELECT query_id, CAST(unnest(range(0, len(terms))) AS INTEGER) AS ord, unnest(terms) AS term FROM qterms"),
        "query_expand": ("said", f"SELECT conv_id, turn, CAST(unnest(range(0, len(v))) AS INTEGER) AS ord, unnest(v) AS query FROM (SELECT conv_id, turn, {_variants('text')} AS v FROM said)"),
        "multi_query": ("said", f"SELECT conv_id, turn, CAST(unnest(range(0, len(v))) AS INTEGER) AS ord, unnest(v) AS query FROM (SELECT conv_id, turn, {_multi('text', 3)} AS v FROM said)"),
        "entity_tokens": ("", f"SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, lower(unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+')))) AS entity FROM documents) WHERE entity NOT IN ({_LIST(text.ENTITY_STOP_WORDS)})"),
        "conversation_rewrite": ("said", f"""SELECT conv_id, turn, CASE WHEN {_PRONOUN} AND len(e) = 0 AND before IS NOT NULL
            THEN 'regarding ' || array_to_string(list_transform(string_split(before, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ', ' || text ELSE text END AS query
            FROM (SELECT *, last_value(CASE WHEN len(e) > 0 THEN array_to_string(e, ' ') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {_entities('text')} AS e FROM said))"""),
        "keyword_search": ("kw", "SELECT query_id, chunk_id, matched, score FROM kw"),
        "hash_vector_search": ("vec", "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vec WHERE ord = 0"),
        "hybrid_merge": ("matches", "SELECT query_id, chunk_id, score, via, rank FROM matches"),
        "metadata_filter": ("best chunks", "SELECT query_id, chunk_id, score, via, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, chunk_id) AS INTEGER) AS rank FROM best WHERE chunk_id // 4194304 IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= 5"),
        "authorize": ("matches", "SELECT query_id, chunk_id, score, rank FROM matches WHERE chunk_id // 4194304 NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
        "lexical_rerank": ("matches chunks qterms", _RERANK.format("SELECT query_id, chunk_id, round(score + least(0.3, 0.05 * len(list_filter(terms, lambda t: contains(lower(content), t)))), 6) AS score, rank AS was FROM matches JOIN chunks USING (chunk_id) JOIN qterms USING (query_id)")),
        "entity_boost": ("matches chunks ents", _RERANK.format("SELECT query_id, chunk_id, round(score + CASE WHEN len(list_filter(e, lambda t: contains(lower(content), t))) > 0 THEN 0.1 ELSE 0.0 END, 6) AS score, rank AS was FROM matches JOIN chunks USING (chunk_id) JOIN ents USING (query_id)")),
        "retrieval_trace": ("matches", "SELECT query_id, count(*) FILTER (via = 'vector') AS by_vector, count(*) FILTER (via = 'keyword') AS by_keyword, round(max(score), 4) AS best FROM matches GROUP BY 1"),
        "expand_neighbors": ("matches near top_of_doc", """SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, was, chunk_id) AS INTEGER) AS rank FROM (
            SELECT query_id, chunk_id, score, 0 AS stage, rank AS was FROM matches UNION ALL
            SELECT n.query_id, n.chunk_id, round(t.best * 0.9, 6), 1, 0 FROM near n JOIN top_of_doc t USING (query_id, doc_id) WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.query_id = n.query_id AND m.chunk_id = n.chunk_id))) WHERE rank <= 10"""),
        "expand_parents": ("matches", "SELECT query_id, chunk_id // 4194304 AS doc_id, (chunk_id % 4194304) // 4 AS parent, round(arg_max(score, rank) * 0.95, 6) AS score FROM matches GROUP BY 1, 2, 3"),
        "compress_budget": ("matches chunks", "SELECT query_id, chunk_id, score, rank, CAST(used AS BIGINT) AS used FROM (SELECT query_id, chunk_id, score, rank, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM matches JOIN chunks USING (chunk_id)) WHERE used <= 2500 OR rank = 1"),
        "prompt_context": ("matches chunks questions", f"""SELECT query_id, CASE WHEN context IS NULL THEN 'Context:' || chr(10) || '(no relevant documents found)' || chr(10) || chr(10) || 'Question: ' || question
            ELSE '{GUARD.strip()}' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question END AS prompt
            FROM questions LEFT JOIN (SELECT query_id, string_agg('[SOURCE_ID: ' || rank || ']' || chr(10) || 'Document: ' || source || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || chr(10) || 'Content:' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context
            FROM matches JOIN chunks USING (chunk_id) JOIN documents USING (doc_id) GROUP BY 1) USING (query_id)"""),
        "citations_validate": ("cited", "SELECT query_id, ord, source_id, chunk_id FROM cited"),
        "citations_grouped": ("cited chunks", "SELECT query_id, doc_id, min(ord) AS ord, CASE WHEN min(position) = max(position) THEN 'Page ' || (min(position) + 1) ELSE 'Pages ' || (min(position) + 1) || '–' || (max(position) + 1) END AS label FROM cited JOIN chunks USING (chunk_id) GROUP BY 1, 2"),
        "confidence": ("matches cited questions", "SELECT query_id, CASE WHEN score IS NULL THEN 'unsupported' WHEN score >= 0.65 AND c THEN 'high' WHEN score >= 0.45 OR c THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT query_id, score, query_id IN (SELECT query_id FROM cited) AS c FROM questions LEFT JOIN (SELECT * FROM matches WHERE rank = 1) USING (query_id))"),
        "sources": ("matches chunks", "SELECT query_id, rank, doc_id, source, round(score, 4) AS score, CASE WHEN length(content) > 200 THEN rtrim(substr(content, 1, 200)) || '...' ELSE content END AS excerpt FROM matches JOIN chunks USING (chunk_id) JOIN documents USING (doc_id)"),
        "eval_hit_rate": ("matches chunks questions", "SELECT count(*) AS total, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 4) AS hit_rate FROM (SELECT q.query_id, max(CASE WHEN contains(lower(source), 'src' || (q.query_id % 10)) THEN 1 ELSE 0 END) AS hit FROM questions q LEFT JOIN matches USING (query_id) LEFT JOIN chunks USING (chunk_id) LEFT JOIN documents USING (doc_id) GROUP BY 1)"),
        "url_normalize": ("", f"SELECT page_id, {_normal('url')} AS normal FROM pages"),
        "url_title": ("", f"""SELECT page_id, coalesce(array_to_string(list_transform(string_split({_LAST_PART}, '-'), lambda w: upper(w[1]) || w[2:]), ' '), {_part('url', 2)}) AS title, {_skipped('url')} AS skipped, false AS private FROM pages"""),
        "page_links": ("", f"""SELECT DISTINCT page_id, link FROM (SELECT page_id, url, {_normal(_resolve('href', 'url'))} AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) WHERE href <> '' AND NOT starts_with(href, '#'))
            WHERE link IS NOT NULL AND NOT {_skipped('link')} AND lower({_part('link', 2)}) = lower({_part('url', 2)})"""),
        "link_bfs": ("d3", "SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3"),
        "html_titles": ("", "SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&')), '') AS title FROM pages"),
    }
    return {k: with_tables(*v) for k, v in s.items()}
