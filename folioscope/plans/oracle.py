"""DuckDB SQL for the registered queries, written from each operator's definition
and not from its Spark plan. Also the parameters both sides share."""

from __future__ import annotations

from folioscope.functions.text import LINE_BREAK, STOPWORDS, WS

WORDS = [
    "the", "that", "The", "whom", "the of", "an the", "oration", "rewh", "thatin", "under",
    "avec", "und", "des", "Ment", "tre", "eux", "on the", "nd", "est", "pour",
]
METRIC_WORDS = ["it", "is", "it is", "to the", "from", "are", "at", "was on", "of th", "den"]
CUES = ["than", "with", "avec"]
NAME_WORD = "[a-z]{3,}"
NUMBER = "[0-9]{2,}"
PHRASE = "rewh orre rewh"

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_BOUND = r"[^\p{L}\p{M}\p{N}_]"
_BREAK = LINE_BREAK.replace("\\r", "\\x0d").replace("\\n", "\\x0a")

_TOKENS = f"""
kept AS (
  SELECT doc_id, pos, term FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term,
           generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), 1) AS pos
    FROM documents) WHERE term NOT IN ({_STOP}))"""


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def _title(c: str) -> str:
    spaced = f"regexp_replace(lower({c}), '[^a-z0-9{WS[1:]}', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, '{WS}+', ' ', 'g'))"


def _id(*parts: str) -> str:
    return "sha256(" + " || chr(1) || ".join(parts) + ")"


def _hits(words: list[str], text: str) -> str:
    values = ", ".join(f"('{w}')" for w in words)
    return f"""
    SELECT {text}.doc_id, v.name FROM documents {text}, (VALUES {values}) v(name)
    WHERE regexp_matches({text}.text, '(?i)(?:^|{_BOUND})' || v.name || '(?:$|{_BOUND})')"""


def _cues() -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS cue, unnest(m) AS name, generate_subscripts(m, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '(?i:{cue}){WS}+(?:a{WS}+|an{WS}+|the{WS}+)?({NAME_WORD}(?:{WS}+{NAME_WORD}){{0,4}})', 1) AS m
        FROM documents)"""
        for i, cue in enumerate(CUES)
    )
    return f"""
    SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY cue, i) - 1 AS pos FROM (
      SELECT doc_id, name, cue, i,
             row_number() OVER (PARTITION BY doc_id, name ORDER BY cue, i) AS n
      FROM ({found})) WHERE n = 1"""


def _claims() -> str:
    return f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, {_strip('s')} AS sentence
    FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS p
      FROM documents))
    WHERE regexp_matches(s, '{NUMBER}')"""


def _lines(source: str) -> str:
    return f"""
lines AS (
  SELECT paper_id, page_no, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (
    SELECT paper_id, page_no, string_split_regex(regexp_replace(text, '{_BREAK}$', ''), '{_BREAK}') AS l
    FROM ({source}) WHERE text <> '')),
typed AS (
  SELECT *, CASE WHEN length({_strip('line')}) BETWEEN 1 AND 60
                  AND regexp_matches({_strip('line')}, '^[^.!?]*[.!?]$') THEN 1 ELSE 0 END AS h
  FROM lines)"""


def _sections(source: str) -> str:
    return f"""
WITH pages AS ({source}), {_lines('SELECT * FROM pages')},
numbered AS (
  SELECT *, sum(h) OVER (PARTITION BY paper_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) AS sec FROM typed),
extent AS (SELECT paper_id, min(page_no) AS lo, max(page_no) AS hi FROM pages GROUP BY 1),
secs AS (
  SELECT n.paper_id, sec,
         coalesce(max(CASE WHEN h = 1 THEN {_strip('line')} END), 'Preamble') AS heading,
         CASE WHEN sec = 0 THEN 'body' ELSE 'sentence' END AS section_type,
         CASE WHEN sec = 0 THEN min(e.lo) ELSE max(CASE WHEN h = 1 THEN page_no END) END AS page_start,
         coalesce({_strip("string_agg(CASE WHEN h = 0 THEN line END, chr(10) ORDER BY page_no, line_no)")}, '') AS content
  FROM numbered n JOIN extent e USING (paper_id) GROUP BY n.paper_id, sec),
ended AS (
  SELECT s.*, coalesce(lead(page_start) OVER (PARTITION BY s.paper_id ORDER BY sec), e.hi) AS page_end
  FROM secs s JOIN extent e USING (paper_id))
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY sec) - 1 AS order_index,
       heading, section_type, page_start, page_end, content
FROM ended WHERE content <> ''"""


_DOC_PAGES = "SELECT doc_id AS paper_id, 0 AS page_no, text FROM documents"
_TURN_PAGES = "SELECT conv_id AS paper_id, CAST(turn AS INTEGER) AS page_no, text FROM conversations"


def _bm25(queries: str, k1: float, b: float, name: str, top: str = " WHERE rank <= 10") -> str:
    """CTE ``name`` with the top 10 of every query, or the whole list; needs the token CTEs."""
    return f"""
{name} AS (
  SELECT query_id, doc_id, rank, round(raw, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM (
      SELECT q.query_id, t.doc_id,
             sum(q.qtf * ln((n.n - d.df + 0.5) / (d.df + 0.5) + 1.0)
                 * t.tf * ({k1}::DOUBLE + 1)
                 / (t.tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l.dl / greatest(n.avgdl, 1e-9)))) AS raw
      FROM ({queries}) q JOIN tf t USING (term) JOIN df d USING (term) JOIN dl l USING (doc_id), n
      GROUP BY 1, 2)){top})"""


_PAPERS = """
SELECT doc_id, concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, '')) AS text FROM documents
JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id)"""

_INDEX = f"""{_TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
dl AS (SELECT d.doc_id, count(k.term) AS dl FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY 1),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""

# the index over completed papers: title, abstract and full text as one text
_PAPER_INDEX = f"papers AS ({_PAPERS}), " + _INDEX.replace("FROM documents", "FROM papers")

_BENCH_TERMS = f"""
qterms AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM benchmark)
  WHERE term NOT IN ({_STOP}) GROUP BY 1, 2)"""

_PHRASE_TERMS = f"""
qterms AS (
  SELECT 0 AS query_id, term, count(*) AS qtf
  FROM (SELECT unnest(regexp_extract_all('{PHRASE}', '[a-z0-9]{{2,}}')) AS term) GROUP BY 1, 2)"""

_WORD_MENTIONS = """
SELECT doc_id, lang, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS pos
FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)"""

_GRAPH = f"""
sup AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
entities AS (
  SELECT DISTINCT {_id('entity_type', 'lower(name)')} AS entity_id, entity_type, name, source_paper_id, 1.0::DOUBLE AS confidence FROM (
    SELECT 'paper' AS entity_type, s_name AS name, s_suppkey AS source_paper_id FROM sup
    UNION ALL SELECT 'claim', s_name || ' trades in ' || n_name, s_suppkey FROM sup
    UNION ALL SELECT 'concept', n_name, NULL FROM sup
    UNION ALL SELECT 'dataset', p_name, NULL FROM part)),
edges AS (
  SELECT s_suppkey AS paper_id, {_id("'paper'", 'lower(s_name)')} AS source_entity_id,
         {_id("'claim'", "lower(s_name || ' trades in ' || n_name)")} AS target_entity_id,
         'mentions' AS relationship_type, s_name || ' trades in ' || n_name AS evidence FROM sup
  UNION ALL
  SELECT s_suppkey, {_id("'paper'", 'lower(s_name)')}, {_id("'concept'", 'lower(n_name)')}, 'mentions', n_name FROM sup
  UNION ALL
  SELECT DISTINCT s_suppkey, {_id("'paper'", 'lower(s_name)')}, {_id("'dataset'", 'lower(p_name)')}, 'evaluated_on', p_name
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""

_CITED = f"""
cited AS (
  SELECT r.doc_id, 'd' || r.doc_id AS paper_id, 'b' || b.item_id AS cited_paper_id, b.text AS cited_title,
         round(least(1.0::DOUBLE, length(b.t)::DOUBLE / greatest(length(r.r), 1) + 0.4::DOUBLE), 2) AS match_confidence
  FROM (SELECT doc_id, {_title('text')} AS r FROM documents) r
  JOIN (SELECT item_id, text, {_title('text')} AS t FROM benchmark) b
    ON length(b.t) >= 15 AND contains(r.r, b.t))"""

_KNOWLEDGE = """
lines AS (
  SELECT l_orderkey AS ord, l_linenumber AS no, 'part ' || l_partkey AS part, l_linestatus AS st,
         'part ' || l_partkey || ' gets ' || CAST(round(l_discount * 100) AS INTEGER) || '% off' AS claim
  FROM lineitem)"""

_FIGURES = f"""{_KNOWLEDGE},
figs AS (
  SELECT c.ord, c.no AS cno, d.no AS dno, d.part AS dataset, c.claim,
         CAST(regexp_extract(c.claim, '(\\d{{1,3}}(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) AS value
  FROM (SELECT ord, part, claim, row_number() OVER (PARTITION BY ord ORDER BY no, claim) - 1 AS no FROM lines) c
  JOIN (SELECT ord, part, row_number() OVER (PARTITION BY ord ORDER BY no, part) - 1 AS no FROM lines) d
    ON c.ord = d.ord AND contains(lower(c.claim), lower(d.part)))"""

_BRAND = """
figs AS (
  SELECT p_brand AS dataset, CAST(year(o_orderdate) AS INTEGER) AS year, l_orderkey AS ord,
         l_linenumber AS claim_no, l_partkey * 64 + CAST(l_quantity AS BIGINT) AS no, l_quantity AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""

_METHODS = """
m AS (SELECT DISTINCT p_brand AS title, p_name AS name FROM part),
w AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS word FROM m),
size AS (SELECT name, count(*) AS n FROM w GROUP BY 1),
alike AS (
  SELECT a.name, b.name AS other FROM w a JOIN w b USING (word) JOIN size s ON s.name = a.name
  GROUP BY a.name, b.name, s.n HAVING count(*) / s.n >= 0.5)"""

_NOVELTY = f"""{_METHODS},
mentions AS (SELECT name, count(*) AS c FROM m GROUP BY 1),
counted AS (SELECT s.name, sum(c) AS c FROM alike s JOIN mentions o ON o.name = s.other GROUP BY 1),
scores AS (
  SELECT m.title AS paper_title, m.name AS method, 1 AS mentions,
         round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * (coalesce(c, 1) - 1)), 2) AS novelty_score
  FROM m LEFT JOIN counted USING (name))"""

_IMPACT = f"""{_KNOWLEDGE},
shared AS (
  SELECT a.ord, count(DISTINCT b.ord) AS shared_with FROM lines a
  JOIN lines b ON a.part = b.part AND a.st = b.st AND a.ord <> b.ord GROUP BY 1),
total AS (SELECT count(*) AS n FROM orders),
impact AS (
  SELECT o_orderkey AS paper_id, coalesce(shared_with, 0) AS shared_with,
         round(coalesce(shared_with, 0)::DOUBLE / greatest(n - 1, 1), 2) AS impact_score
  FROM orders LEFT JOIN shared ON ord = o_orderkey, total)"""

# order keys are methods here, so two orders share a method name only if a part repeats
_ANALYSIS = f"""{_IMPACT},
named AS (SELECT DISTINCT ord, part FROM lines WHERE st = 'F'),
per_name AS (SELECT part, count(*) AS c FROM lines WHERE st = 'F' GROUP BY 1),
entry AS (SELECT ord, part, count(*) AS c FROM lines WHERE st = 'F' GROUP BY 1, 2),
tot AS (SELECT sum(c) AS c FROM per_name),
nov AS (
  SELECT ord, round(sum(c * s) / sum(c), 2) AS novelty_score FROM (
    SELECT e.ord, e.c, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * (tot.c - e.c)), 2) AS s
    FROM entry e, tot) GROUP BY 1),
md AS (
  SELECT ord,
         string_agg(DISTINCT CASE WHEN st = 'F' THEN part END, ', ' ORDER BY CASE WHEN st = 'F' THEN part END) AS ms,
         string_agg(DISTINCT CASE WHEN st = 'F' THEN part END, ',' ORDER BY CASE WHEN st = 'F' THEN part END) AS mc,
         string_agg(DISTINCT CASE WHEN st = 'O' THEN part END, ', ' ORDER BY CASE WHEN st = 'O' THEN part END) AS ds,
         count(DISTINCT CASE WHEN st = 'F' THEN part END) + count(DISTINCT CASE WHEN st = 'O' THEN part END) AS nc,
         count(*) AS claims
  FROM lines GROUP BY 1)"""

_RESPONSES = """
resp AS (
  SELECT event_id AS paper_id, event_type, value, json_extract_string(props, '$.k') AS k,
         event_type = 'signup' OR (event_type = 'click' AND event_id % 10 IN (1, 2, 3)) AS unanswered FROM events),
facts AS (
  SELECT paper_id, 0 AS ord, 'method' AS entity_type, 'proposes' AS relationship_type, 'k' || k AS name,
         event_type AS description, event_type AS evidence, 'llm' AS extraction_method, 0.85::DOUBLE AS confidence
  FROM resp WHERE NOT unanswered
  UNION ALL
  SELECT paper_id, 1, 'claim', 'mentions', 'event ' || paper_id || ' — claim 2', 'value ' || k, 'value ' || k, 'llm', 0.85::DOUBLE
  FROM resp WHERE NOT unanswered)"""

_LABELLED = """
papers AS (
  SELECT d.doc_id AS arxiv_id, lang,
         CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'failed' ELSE 'not_started' END AS extraction_status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

_REQUESTS = """
req AS (
  SELECT ts, 'GET' AS method, event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value AS duration FROM events)"""

_SLIDING = f"""{_REQUESTS},
hit AS (
  SELECT r.*, time_bucket(INTERVAL '1 minute', ts) - to_minutes(CAST(i AS INTEGER)) AS s
  FROM req r, generate_series(0, 4) g(i))"""

_STAMP = "strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '{}', '%Y-%m-%d %H:%M:%S') AS window_end"
_S5 = _STAMP.format("5 minutes")

ORACLE = {
    "clean_text": f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)",
    "normalize_title": f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {_title('text')} AS c FROM documents)",
    "tokenize_counts": f"""
WITH {_TOKENS}
SELECT d.doc_id, count(term) AS tokens, count(DISTINCT term) AS terms, md5(coalesce(string_agg(term, ' ' ORDER BY pos), '')) AS digest
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY 1""",
    "vocab_match": f"""
SELECT doc_id, 'dataset' AS vocabulary, name FROM ({_hits(WORDS, 'd')})
UNION ALL SELECT doc_id, 'metric', name FROM ({_hits(METRIC_WORDS, 'd')})""",
    "match_names": r"""
WITH items AS (SELECT string_split(text, ' ') AS w FROM benchmark),
split_items AS (SELECT unnest(w) AS a, unnest(list_concat(w[2:], [''])) AS b FROM items),
names AS (
  SELECT a AS name FROM split_items WHERE regexp_full_match(a, '[A-Za-z]+')
  UNION SELECT a || ' ' || b FROM split_items WHERE regexp_full_match(a, '[A-Za-z]+') AND regexp_full_match(b, '[A-Za-z]+')
  UNION SELECT p_name FROM part),
cut AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\p{L}\p{M}\p{N}_]*([\p{L}\p{M}\p{N}_]+)', 1) AS w,
         regexp_extract_all(lower(text), '[^\p{L}\p{M}\p{N}_]*[\p{L}\p{M}\p{N}_]+') AS t FROM documents),
runs AS (SELECT doc_id, unnest(w) AS a, unnest(list_concat(t[2:], [''])) AS b FROM cut),
forms AS (SELECT doc_id, a AS form FROM runs UNION SELECT doc_id, a || b FROM runs WHERE b <> '')
SELECT doc_id, name FROM forms JOIN names ON lower(name) = form""",
    "cue_names": f"SELECT doc_id, pos, name FROM ({_cues()})",
    "claim_sentences": _claims(),
    "extract_knowledge": f"""
WITH facts AS (
  SELECT doc_id, 0 AS g, pos, '' AS k, 'method' AS entity_type, 'proposes' AS relationship_type, name,
         NULL AS description, '''we propose/introduce/present ' || name || ''' found in text' AS evidence FROM ({_cues()})
  UNION ALL
  SELECT doc_id, 1, 0, name, 'dataset', 'evaluated_on', name, NULL, '''' || name || ''' mentioned in paper text' FROM ({_hits(WORDS, 'd')})
  UNION ALL
  SELECT doc_id, 2, 0, name, 'metric', 'mentions', name, NULL, '''' || name || ''' mentioned in experiments/results' FROM ({_hits(METRIC_WORDS, 'd')})
  UNION ALL
  SELECT doc_id, 3, pos, '', 'claim', 'mentions', 'Document ' || doc_id || ' — claim ' || (pos + 1), sentence, sentence FROM ({_claims()}))
SELECT doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, pos, k) - 1 AS ord,
       entity_type, relationship_type, name, description, evidence, 0.6::DOUBLE AS confidence FROM facts""",
    "classify_lines": f"""
WITH {_lines(_DOC_PAGES)}
SELECT paper_id, page_no, line_no, line, 'sentence' AS section_type FROM typed WHERE h = 1""",
    "segment_sections": _sections(_DOC_PAGES),
    "segment_turns": _sections(_TURN_PAGES),
    "section_previews": """
SELECT doc_id AS paper_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…' ELSE text END AS preview FROM documents""",
    "split_references": """
SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Part P' || l_partkey || ' from supplier S' || l_suppkey || '. ' || year(l_shipdate) || '.') - 1 AS order_index,
       'Part P' || l_partkey || ' from supplier S' || l_suppkey || '. ' || year(l_shipdate) || '.' AS raw_text,
       CAST(year(l_shipdate) AS INTEGER) AS parsed_year
FROM lineitem""",
    "assemble_turns": """
SELECT conv_id AS paper_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text, CAST(count(*) AS INTEGER) AS num_pages
FROM conversations GROUP BY 1""",
    "term_stats": f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM kept GROUP BY 1",
    "term_idf": f"""
WITH {_INDEX} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM df, n""",
    "bm25_topk": f"""
WITH {_INDEX}, {_PHRASE_TERMS}, {_bm25('SELECT * FROM qterms', 1.5, 0.75, 'hits')}
SELECT rank, doc_id, lang, source, score FROM hits JOIN documents USING (doc_id)""",
    "search_corpus": f"""
WITH {_PAPER_INDEX}, {_BENCH_TERMS}, {_bm25('SELECT * FROM qterms', 1.5, 0.75, 'hits')}
SELECT query_id, rank, doc_id, source AS title, score FROM hits JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""",
    "bm25_batch_topk": f"""
WITH {_INDEX}, {_BENCH_TERMS}, {_bm25('SELECT * FROM qterms', 1.5, 0.75, 'hits')}
SELECT query_id, doc_id, score, rank FROM hits""",
    "bm25_bounded": f"""
WITH {_INDEX}, {_BENCH_TERMS}, {_bm25('SELECT * FROM qterms', 1.5, 0.75, 'hits')}
SELECT query_id, doc_id, score, rank FROM hits""",
    "rrf_fusion": f"""
WITH {_INDEX}, {_BENCH_TERMS}, {_bm25('SELECT * FROM qterms', 1.5, 0.75, 'a', '')}, {_bm25('SELECT * FROM qterms', 1.2, 0.3, 'b', '')}
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
    "resolve_entities": f"""
SELECT {_id("'word-' || lang", 'lower(name)')} AS entity_id, 'word-' || lang AS entity_type,
       lower(name) AS normalized_name, arg_min(name, (doc_id, pos)) AS name
FROM ({_WORD_MENTIONS}) GROUP BY lang, lower(name)""",
    "resolve_authors": f"""
SELECT lower(name) AS normalized_name, arg_min(name, (doc_id, pos)) AS name FROM ({_WORD_MENTIONS}) GROUP BY 1""",
    "resolve_edges": f"""
WITH named AS (
  SELECT l_suppkey AS s, lower(p_name) AS k, arg_max(CASE WHEN p_size > 25 THEN 'method' ELSE 'dataset' END, p_partkey) AS t
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT l_suppkey AS paper_id, l_linenumber AS ord, {_id("'paper'", 'lower(s_name)')} AS source_entity_id,
       {_id('t', 'k')} AS target_entity_id, 'evaluated_on' AS relationship_type,
       CAST(l_orderkey AS VARCHAR) AS evidence, 0.6::DOUBLE AS confidence
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN named ON s = l_suppkey AND k = lower(p_name)
WHERE l_linenumber <> 7""",
    "paper_subgraph": f"""
WITH {_GRAPH} SELECT paper_id, source_entity_id, target_entity_id, relationship_type, evidence FROM edges""",
    "paper_subgraph_nodes": f"""
WITH {_GRAPH},
wanted AS (SELECT paper_id, source_entity_id AS entity_id FROM edges UNION SELECT paper_id, target_entity_id FROM edges)
SELECT paper_id, entity_id, entity_type, name, confidence FROM wanted JOIN entities USING (entity_id)""",
    "nodes_by_type": f"""
WITH {_GRAPH} SELECT entity_type, count(*) AS nodes FROM entities WHERE entity_type <> 'paper' GROUP BY 1""",
    "graph_edges_merged": """
SELECT l_suppkey AS source_entity_id, CASE WHEN l_returnflag = 'R' THEN 'mentions' ELSE 'uses_dataset' END AS relationship_type,
       l_partkey AS target_entity_id,
       arg_max(l_orderkey || '-' || l_linenumber, (l_orderkey, l_linenumber, l_discount)) AS evidence,
       arg_max(l_discount, (l_orderkey, l_linenumber, l_discount)) AS confidence
FROM lineitem GROUP BY 1, 2, 3""",
    "citation_match": f"""
WITH {_CITED} SELECT doc_id AS reference_id, cited_paper_id, match_confidence FROM cited""",
    "citation_edges": f"""
WITH {_CITED}
SELECT paper_id, doc_id AS reference_id, {_id("'paper'", "lower('Document ' || doc_id)")} AS source_entity_id,
       {_id("'paper'", f"lower({_strip('cited_title')})")} AS target_entity_id, 'cites' AS relationship_type,
       cited_title AS evidence, match_confidence AS confidence FROM cited""",
    "claim_figures": f"""
WITH {_FIGURES} SELECT ord AS paper_id, cno AS claim_no, dno AS dataset_no, dataset, value, claim FROM figs""",
    "contradictions": """
SELECT l_partkey AS dataset, count(*) AS figures, round(max(l_quantity) - min(l_quantity), 2) AS spread
FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) - min(l_quantity) >= 49""",
    "contradiction_figures": """
SELECT l_partkey AS dataset, l_quantity AS value, CAST(l_orderkey AS VARCHAR) AS paper_title, l_linenumber, spread
FROM lineitem JOIN (
  SELECT l_partkey AS d, round(max(l_quantity) - min(l_quantity), 2) AS spread FROM lineitem
  GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) - min(l_quantity) >= 49) ON d = l_partkey""",
    "gap_underexplored": """
SELECT 'underexplored_dataset' AS kind, c AS subject,
       '''' || c || ''' appears in only 1 paper in this corpus -- limited cross-paper validation.' AS detail
FROM (SELECT l_suppkey || '/' || l_partkey AS c FROM lineitem) GROUP BY c HAVING count(*) = 1""",
    "gap_unevaluated": """
SELECT 'unevaluated_method' AS kind, o_orderpriority AS subject,
       '''' || o_orderpriority || ''' (from ''order ' || o_orderkey || ''') has no recognized dataset evaluation in the extracted text.' AS detail
FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "benchmark_timeline": f"""
WITH {_BRAND}
SELECT dataset, count(*) AS points, min(year) AS first_year, max(year) AS last_year,
       arg_min(value, (year, ord, claim_no, no)) AS first_value, arg_max(value, (year, ord, claim_no, no)) AS last_value,
       arg_max(value, (year, ord, claim_no, no)) > arg_min(value, (year, ord, claim_no, no)) AS improved
FROM figs GROUP BY 1 HAVING count(*) >= 2""",
    "timeline_points": f"""
WITH {_BRAND}
SELECT dataset, year, ord, claim_no, value,
       row_number() OVER (PARTITION BY dataset ORDER BY year, ord, claim_no, no) - 1 AS point FROM figs""",
    "novelty_overlap": f"""
WITH {_METHODS}, mentions AS (SELECT name, count(*) AS c FROM m GROUP BY 1)
SELECT s.name AS method, s.other AS "similar", o.c AS mentions
FROM alike s JOIN mentions o ON o.name = s.other WHERE s.name <> s.other OR o.c > 1""",
    "novelty_score": f"WITH {_NOVELTY} SELECT * FROM scores",
    "low_novelty": f"""
WITH {_NOVELTY} SELECT * FROM scores WHERE novelty_score < 1""",
    "impact_score": f"WITH {_IMPACT} SELECT * FROM impact",
    "paper_analysis": f"""
WITH {_ANALYSIS}
SELECT paper_id, 'order ' || paper_id AS paper_title, novelty_score, impact_score,
       round(coalesce(claims, 0)::DOUBLE / greatest(coalesce(nc, 0), 1), 2) AS evidence_density,
       coalesce(mc, '') AS key_contributions,
       CASE WHEN ms IS NOT NULL AND ds IS NOT NULL THEN 'Proposes ' || ms || '; evaluated on ' || ds || '; ' || claims || ' evidence-backed claim(s) extracted.'
            WHEN ms IS NOT NULL THEN 'Proposes ' || ms || '; ' || claims || ' evidence-backed claim(s) extracted.'
            WHEN ds IS NOT NULL THEN 'Evaluated on ' || ds || '; ' || claims || ' evidence-backed claim(s) extracted.'
            ELSE coalesce(claims, 0) || ' evidence-backed claim(s) extracted; no methods or datasets recognized in the text.' END AS summary
FROM impact LEFT JOIN md ON md.ord = paper_id LEFT JOIN nov ON nov.ord = paper_id""",
    "missing_citations": """
WITH origin AS (SELECT l_partkey AS p, min(l_orderkey) AS o FROM lineitem GROUP BY 1),
cites AS (SELECT o_orderkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS b FROM orders)
SELECT l_orderkey AS paper_id, 'part ' || p AS concept, 'order ' || o AS likely_source_paper,
       'Uses ''part ' || p || ''', which ''order ' || o || ''' evaluates on first in this corpus, but does not cite it.' AS reason
FROM lineitem JOIN origin ON p = l_partkey
WHERE o <> l_orderkey AND NOT EXISTS (SELECT 1 FROM cites WHERE a = l_orderkey AND b = o)""",
    "recommend_topk": """
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
own AS (SELECT o, count(*) AS n FROM c GROUP BY 1),
pairs AS (SELECT a.o, b.o AS r, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2),
ranked AS (
  SELECT o, r, shared, round(shared::DOUBLE / n, 2) AS score,
         row_number() OVER (PARTITION BY o ORDER BY round(shared::DOUBLE / n, 2) DESC, r) AS position
  FROM pairs JOIN own USING (o))
SELECT o AS paper_id, position, r AS recommended_id, 'order ' || r AS recommended_title, shared, score FROM ranked WHERE position <= 3""",
    "recommend_suppliers": """
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem),
own AS (SELECT o, count(*) AS n FROM c GROUP BY 1),
pairs AS (SELECT a.o, b.o AS r, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2),
ranked AS (
  SELECT o, r, shared, round(shared::DOUBLE / n, 2) AS score,
         row_number() OVER (PARTITION BY o ORDER BY round(shared::DOUBLE / n, 2) DESC, r) AS position
  FROM pairs JOIN own USING (o))
SELECT o AS paper_id, position, r AS recommended_id, 'order ' || r AS recommended_title, shared, score FROM ranked WHERE position <= 3""",
    "recommend_customers": """
WITH line AS (SELECT o_custkey AS o, o_custkey // 2 AS title, l_partkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT DISTINCT o, title, 'part ' || l_partkey AS p FROM line UNION SELECT DISTINCT o, title, 'flag ' || l_returnflag FROM line),
own AS (SELECT o, count(*) AS n FROM c GROUP BY 1),
pairs AS (SELECT a.o, b.o AS r, b.title, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND a.title <> b.title GROUP BY 1, 2, 3),
ranked AS (
  SELECT o, r, title, shared, round(shared::DOUBLE / n, 2) AS score,
         row_number() OVER (PARTITION BY o ORDER BY round(shared::DOUBLE / n, 2) DESC, r) AS position
  FROM pairs JOIN own USING (o))
SELECT o AS paper_id, position, r AS recommended_id, 'customer ' || title AS recommended_title, shared, score FROM ranked WHERE position <= 3""",
    "impact_customers": """
WITH c AS (
  SELECT DISTINCT o_custkey AS p, o_custkey // 2 AS title, s_nationkey AS s, l_linestatus AS st
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey),
pairs AS (SELECT DISTINCT a.p, b.p AS q FROM c a JOIN c b ON a.s = b.s AND a.st = b.st AND a.title <> b.title),
shared AS (SELECT p, count(*) AS shared_with FROM pairs GROUP BY 1)
SELECT c_custkey AS paper_id, coalesce(shared_with, 0) AS shared_with,
       round(coalesce(shared_with, 0)::DOUBLE / greatest((SELECT count(*) FROM customer) - 1, 1), 2) AS impact_score
FROM customer LEFT JOIN shared ON p = c_custkey""",
    "recommend_full": """
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
own AS (SELECT o, count(*) AS n FROM c GROUP BY 1),
pairs AS (SELECT a.o, b.o AS r, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2),
ranked AS (
  SELECT o, r, shared, round(shared::DOUBLE / n, 2) AS score,
         row_number() OVER (PARTITION BY o ORDER BY round(shared::DOUBLE / n, 2) DESC, r) AS position
  FROM pairs JOIN own USING (o)),
best AS (SELECT o AS paper_id, position, r AS recommended_id, 'order ' || r AS recommended_title, shared, score FROM ranked WHERE position <= 3),
names AS (
  SELECT best.paper_id, recommended_id, string_agg('part ' || a.p, ',' ORDER BY 'part ' || a.p) AS shared_concepts
  FROM best JOIN c a ON a.o = best.paper_id JOIN c b ON b.o = recommended_id AND b.p = a.p GROUP BY 1, 2)
SELECT o_orderkey AS paper_id, best.recommended_id, position, recommended_title, shared, score, shared_concepts
FROM orders LEFT JOIN best ON best.paper_id = o_orderkey
LEFT JOIN names ON names.paper_id = best.paper_id AND names.recommended_id = best.recommended_id""",
    "knowledge_summary": """
SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(l_orderkey) AS entities_created,
       count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS relationships_created,
       coalesce(max(CASE WHEN l_returnflag = 'R' THEN 'llm' ELSE 'heuristic' END), 'heuristic') AS method_used,
       coalesce(string_agg(CASE WHEN l_linestatus = 'F' THEN 'part ' || l_partkey END, ',' ORDER BY l_linenumber, 'part ' || l_partkey), '') AS methods,
       coalesce(string_agg(CASE WHEN l_linestatus = 'O' THEN 'part ' || l_partkey END, ',' ORDER BY l_linenumber, 'part ' || l_partkey), '') AS datasets
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "review_lines": f"""
WITH {_KNOWLEDGE},
per AS (
  SELECT o_orderkey AS ord,
         string_agg(CASE WHEN st = 'F' THEN part END, ', ' ORDER BY no, part) AS ms,
         string_agg(CASE WHEN st = 'O' THEN part END, ', ' ORDER BY no, part) AS ds,
         count(claim) AS nc
  FROM orders LEFT JOIN lines ON ord = o_orderkey GROUP BY 1),
shown AS (
  SELECT ord, claim, row_number() OVER (PARTITION BY ord ORDER BY no, claim) AS i FROM lines),
body AS (
  SELECT ord, 0 AS i, '### order ' || ord AS line FROM per
  UNION ALL SELECT ord, 1, '**Proposes:** ' || ms FROM per WHERE ms IS NOT NULL
  UNION ALL SELECT ord, 2, '**Evaluated on:** ' || ds FROM per WHERE ds IS NOT NULL
  UNION ALL SELECT ord, 3, '**Key claims:**' FROM per WHERE nc > 0
  UNION ALL SELECT ord, 3 + i, '- ' || claim FROM shown WHERE i <= 3
  UNION ALL SELECT ord, 9, '' FROM per)
SELECT 0 AS block, -1 AS ord, '' AS item_key, i AS item, line FROM (
  SELECT unnest([0, 1, 2]) AS i, unnest(['# Literature Review: orders', '',
    'This review covers ' || count(*) || ' paper(s) discovered and analyzed for the query "orders".']) AS line FROM orders)
UNION ALL
SELECT block, -1, '', i, line FROM (VALUES (1, 0, ''), (1, 1, '## Methods Identified'), (2, 0, ''), (2, 1, '## Datasets Used'),
  (3, 0, ''), (3, 1, '## Per-Paper Summary')) v(block, i, line)
UNION ALL
SELECT DISTINCT CASE WHEN st = 'F' THEN 1 ELSE 2 END, 0, part, 0, '- ' || part FROM lines
UNION ALL
SELECT 3, ord, CAST(ord AS VARCHAR), row_number() OVER (PARTITION BY ord ORDER BY i) - 1, line FROM body""",
    "run_totals": f"""
WITH {_FIGURES}
SELECT 'discovered' AS stage, count(*) AS rows FROM orders
UNION ALL SELECT 'entities', count(*) FROM lineitem
UNION ALL SELECT 'figures', count(*) FROM figs""",
    "unify_sources": """
SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS source_id, lang AS title, md5(text) AS digest FROM documents
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), url, md5(html) FROM pages
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), '', md5(text) FROM benchmark""",
    "search_payloads": f"""
SELECT CAST(doc_id AS VARCHAR) AS source_id, {_strip('source')} AS title, md5({_strip('text')}) AS digest,
       CAST(1900 + doc_id % 120 AS INTEGER) AS year, CASE WHEN lang <> 'en' THEN lang END AS venue,
       CAST(n_chars AS INTEGER) AS citation_count, 'x.' || doc_id AS arxiv_id, lang AS authors
FROM documents""",
    "feed_entries": f"""
SELECT page_id || 'v2' AS arxiv_id, {_clean('url')} AS title, {_clean('url')} AS abstract, 'A B' AS authors,
       2020 AS year, 'cs.LG' AS categories, 'https://arxiv.org/pdf/' || page_id || 'v2' AS pdf_url
FROM pages""",
    "parse_responses": f"WITH {_RESPONSES} SELECT * FROM facts",
    "coalesce_extractions": f"""
WITH {_RESPONSES}
SELECT * FROM facts
UNION ALL
SELECT paper_id, 0, 'metric', 'mentions', 'value ' || CAST(trunc(value) AS BIGINT), NULL,
       'value ' || CAST(trunc(value) AS BIGINT), 'heuristic', 0.6::DOUBLE FROM resp WHERE unanswered""",
    "ingest_todo": """
SELECT doc_id AS arxiv_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)""",
    "upsert_papers": f"""
WITH {_LABELLED}
SELECT arxiv_id, CASE WHEN extraction_status = 'completed' THEN lang ELSE upper(lang) END AS lang,
       CASE WHEN extraction_status = 'completed' THEN 'completed' ELSE 'downloading' END AS extraction_status FROM papers""",
    "upsert_store": f"""
WITH {_LABELLED},
old AS (SELECT * FROM papers WHERE extraction_status <> 'not_started'),
run AS (SELECT doc_id AS arxiv_id, upper(lang) AS lang FROM documents WHERE doc_id % 2 = 0),
now AS (
  SELECT arxiv_id, lang, extraction_status, false AS taken FROM old
  WHERE extraction_status = 'completed' OR arxiv_id NOT IN (SELECT arxiv_id FROM run)
  UNION ALL
  SELECT arxiv_id, lang, 'completed', true FROM run
  WHERE arxiv_id NOT IN (SELECT arxiv_id FROM old WHERE extraction_status = 'completed')),
line AS (SELECT doc_id AS arxiv_id, string_split(text, chr(10)) AS lines FROM documents),
part AS (
  SELECT arxiv_id, len(lines)::BIGINT AS sections, list_transform(lines, lambda x: CASE WHEN taken THEN 'new ' ELSE '' END || md5(x)) AS kept,
         CASE WHEN taken THEN 'new' ELSE md5(lines[-1]) END AS reference, taken AND arxiv_id % 6 = 0 AS bare
  FROM now JOIN line USING (arxiv_id))
SELECT now.arxiv_id, lang, extraction_status, CASE WHEN NOT bare THEN sections END AS sections,
       CASE WHEN NOT bare THEN md5(array_to_string(kept, ',')) END AS digest, reference
FROM now LEFT JOIN part USING (arxiv_id)""",
    "status_funnel": f"WITH {_LABELLED} SELECT extraction_status, count(*) AS papers FROM papers GROUP BY 1",
    "paper_detail": """
SELECT o_orderkey AS paper_id, o_orderpriority AS title, coalesce(string_agg(s_name, ';' ORDER BY l_linenumber, s_name), '') AS authors,
       coalesce(string_agg(l_returnflag, ';' ORDER BY l_linenumber, l_returnflag), '') AS sections,
       coalesce(string_agg(l_partkey || '@' || year(l_shipdate), ';' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), year(l_shipdate)), '') AS references
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
    "paper_cards": """
WITH p AS (
  SELECT l_orderkey AS o, 'part ' || l_partkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part ' || l_partkey) AS i FROM lineitem)
SELECT o_orderkey AS paper_id,
       coalesce(string_agg(CASE WHEN i <= 3 THEN name END, ', ' ORDER BY i), '') || CASE WHEN count(name) > 3 THEN ', et al.' ELSE '' END AS author_line
FROM orders LEFT JOIN p ON o = o_orderkey GROUP BY 1""",
    "list_papers": """
SELECT o_orderkey AS paper_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, o_orderstatus
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 25""",
    "request_counts": f"WITH {_REQUESTS} SELECT method, path, status, count(*) AS requests FROM req GROUP BY 1, 2, 3",
    "request_latency": f"""
WITH {_REQUESTS} SELECT method, path, count(*) AS requests, round(sum(duration), 4) AS total_seconds, max(duration) AS max_seconds FROM req GROUP BY 1, 2""",
    "status_breakdown": f"WITH {_REQUESTS} SELECT status, count(*) AS requests FROM req GROUP BY 1",
    "request_rate_5m": f"""
WITH {_SLIDING} SELECT {_S5}, method, path, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM hit GROUP BY s, method, path""",
    "error_rate_5m": f"""
WITH {_SLIDING} SELECT {_S5}, path, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM hit WHERE status >= 500 GROUP BY s, path""",
    "latency_avg_5m": f"""
WITH {_SLIDING} SELECT {_S5}, path, round(sum(duration) / count(*), 6) AS latency FROM hit GROUP BY s, path""",
    "requests_24h": f"""
WITH {_REQUESTS} SELECT {_STAMP.format('24 hours')}, count(*) AS requests
FROM (SELECT date_trunc('day', ts) AS s FROM req) GROUP BY s""",
    "token_bucket": """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
run AS (
  SELECT event_id, user_id, us, i, CAST(1 AS INTEGER) AS allowed, CAST(1.0 AS DOUBLE) AS remaining FROM ev WHERE i = 1
  UNION ALL
  SELECT event_id, user_id, us, i, CASE WHEN t >= 1.0::DOUBLE THEN 1 ELSE 0 END, CASE WHEN t >= 1.0::DOUBLE THEN t - 1.0::DOUBLE ELSE t END
  FROM (
    SELECT e.event_id, e.user_id, e.us, e.i,
           least(2.0::DOUBLE, r.remaining + greatest(0.0::DOUBLE, (e.us - r.us)::DOUBLE / 1e6::DOUBLE) * (1.0::DOUBLE / 7200.0::DOUBLE)) AS t
    FROM run r JOIN ev e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, user_id, allowed, round(remaining, 4) AS remaining FROM run""",
}

_EDGE = "paper_id::VARCHAR AS paper_id, source_entity_id, target_entity_id, relationship_type, evidence, confidence"
ORACLE["edge_union"] = f"""
SELECT {_EDGE} FROM ({ORACLE["resolve_edges"]}) UNION ALL SELECT {_EDGE} FROM ({ORACLE["citation_edges"]})"""
