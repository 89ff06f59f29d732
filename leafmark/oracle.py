"""DuckDB SQL with the results of ``queries``, written apart from the Spark side."""

from __future__ import annotations

from typing import NamedTuple

from leafmark.functions import text as T
from leafmark.queries import CHECKED, EVENT_LEVELS, SEARCHES, SNIPPET_QUERY


class Term(NamedTuple):
    """Tokens in a row, the last of which may go on; none match nothing."""

    tokens: tuple[str, ...]
    prefix: bool = False


class Branch(NamedTuple):
    """``kind`` is AND, OR or NOT."""

    kind: str
    left: Branch | Term
    right: Branch | Term


def _w(*tokens: str) -> Term:
    return Term(tuple(t.rstrip("*") for t in tokens), bool(tokens) and tokens[-1].endswith("*"))


def _both(a: Branch | Term, b: Branch | Term) -> Branch:
    return Branch("AND", a, b)


def _either(a: Branch | Term, b: Branch | Term) -> Branch:
    return Branch("OR", a, b)


#: The queries as trees, written by hand and not by the engine's parser.
TREES = {
    "the": _w("the"), "thth*": _w("thth*"), '"of the"': _w("of", "the"), "the and of": _both(_w("the"), _w("of")), "the OR der": _either(_w("the"), _w("der")),
    "the NOT of": Branch("NOT", _w("the"), _w("of")), "(the OR der) AND (of OR die)": _both(_either(_w("the"), _w("der")), _either(_w("of"), _w("die"))),
    "the of": _both(_w("the"), _w("of")), "of-the": _w("of", "the"), "ête* OR für OR señ*": _either(_either(_w("ete*"), _w("fur")), _w("sen*")),
    'the AND ""': _both(_w("the"), _w()),
    'the of NOT and* OR der AND "die der" OR von': _either(_either(Branch("NOT", _both(_w("the"), _w("of")), _w("and*")), _both(_w("der"), _w("die", "der"))), _w("von")),
    'the OR "of the" OR an*': _either(_either(_w("the"), _w("of", "the")), _w("an*")), "of OR die OR la NOT thth*": _either(_either(_w("of"), _w("die")), Branch("NOT", _w("la"), _w("thth*"))),
    "the OR an*": _either(_w("the"), _w("an*")), 'the OR "of the" OR thth*': _either(_either(_w("the"), _w("of", "the")), _w("thth*")),
}


def _terms(node: Branch | Term) -> list[Term]:
    """Different terms in order."""
    found = [node] if isinstance(node, Term) else _terms(node.left) + _terms(node.right)
    return list(dict.fromkeys(found))


ACCENTED, BASE = T.accents()
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TOKEN = "[\\p{L}\\p{N}\\p{Co}]+"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(translate(regexp_replace(lower({x}), '\\p{{Mn}}', '', 'g'), '{ACCENTED}', '{BASE}'), '{TOKEN}')"


LINES = f"""
split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, CAST(i AS INTEGER) AS page_number, trim(ls[i + 1], {WHITE}) AS text FROM split_lines, unnest(generate_series(0, len(ls) - 1)) u(i)),
lines AS (SELECT * FROM numbered WHERE text <> '')"""
PAGES = f"""{LINES},
normal AS (SELECT *, translate(lower(text), '{T.CYRILLIC}', '{T.LATIN}') AS normalized_text FROM lines),
tokened AS (SELECT *, {_tokens("normalized_text")} AS tokens, len({_tokens("text")}) AS own FROM normal),
pages AS (SELECT doc_id, page_number, text, normalized_text, tokens, len({_tokens("CAST(doc_id AS VARCHAR)")}) + 1 + own + len(tokens) AS dl FROM tokened)"""


def _pick(names: tuple[str, ...]) -> str:
    return "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


REGISTRY = f"""
registry AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'notes_' || doc_id || '.pdf' ELSE
  '1800-' || upper(lang) || '-' || replace(source, 'src', 'D') || '-' || {_pick(("DTL", "SPC", "REG"))} || '-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-' || {_pick(tuple("ABC"))} || '.pdf' END AS file_path,
  sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS file_size FROM documents)"""
PREVIOUS = """
previous AS (SELECT doc_id, CASE WHEN doc_id % 10 = 8 THEN 'moved/' || file_path ELSE file_path END AS file_path,
  CASE WHEN doc_id % 10 = 6 THEN 'changed' ELSE file_hash END AS file_hash, CASE WHEN doc_id % 10 = 6 THEN file_size + 1 ELSE file_size END AS cached_size,
  CASE WHEN doc_id % 10 = 7 THEN '2023-01-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS cached_mtime FROM registry WHERE doc_id % 10 <> 9)"""


KINDS = f"(SELECT DISTINCT {_pick(('DTL', 'SPC', 'REG'))} AS kind FROM documents WHERE doc_id % 7 <> 0)"
CODES = f"""codes AS (SELECT DISTINCT 'objects' AS category, upper(lang) AS code FROM documents WHERE lang >= 'e' UNION ALL
  SELECT DISTINCT 'disciplines', replace(source, 'src', 'D') FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0 UNION ALL SELECT 'documentTypes', kind FROM {KINDS} WHERE kind <> 'REG')"""
ALL_ALIASES = f"""all_aliases AS (SELECT 'objects' AS category, upper(lang) AS alias, c AS code, l AS lang, s AS seq FROM (SELECT DISTINCT lang FROM documents WHERE lang < 'e'), (VALUES ('EN', 'en', 0), ('FR', 'ru', 1)) v(c, l, s) UNION ALL
  SELECT 'objects', lower(s_name), CASE s_nationkey % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' WHEN 2 THEN 'ES' ELSE 'DE' END, CASE s_suppkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' END, s_suppkey + 10 FROM supplier UNION ALL
  SELECT 'disciplines', 'D' || n, 'D' || (n - 1), CASE WHEN n % 4 = 1 THEN 'en' END, n FROM (SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS n FROM documents) WHERE n % 2 = 1 UNION ALL
  SELECT 'disciplines', lower(c_mktsegment), 'D' || 2 * (MIN(c_custkey) % 12), 'ru', MIN(c_custkey) + 100 FROM customer GROUP BY c_mktsegment UNION ALL
  SELECT 'documentTypes', kind, 'SPC', 'ru', 0 FROM {KINDS} WHERE kind = 'REG' UNION ALL SELECT 'documentTypes', lower(p_type), 'DTL', 'en', MIN(p_partkey) + 100 FROM part GROUP BY p_type)"""
ALIASES = f"{CODES}, {ALL_ALIASES}, known AS (SELECT a.*, row_number() OVER (PARTITION BY category, alias ORDER BY seq) AS n FROM all_aliases a SEMI JOIN codes c USING (category, code)), aliases AS (SELECT category, alias, code, lang, seq FROM known WHERE n = 1)"
NAME = T.FILE_NAME
PARSED = f"""
stems AS (SELECT *, regexp_extract(file_path, '[^/]*$') AS file_name, regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '') AS stem FROM registry),
parsed AS (SELECT *, regexp_matches(stem, '{NAME}') AS is_valid, {', '.join(f"CASE WHEN regexp_matches(stem, '{NAME}') THEN regexp_extract(stem, '{NAME}', {i}) END AS p{i}" for i in (2, 3, 4))} FROM stems)"""
RESOLVED = f"""{REGISTRY}, {ALIASES}, {PARSED},
coded AS (SELECT p.doc_id, p.file_path, p.is_valid, {', '.join(f"COALESCE((SELECT code FROM codes c WHERE c.category = '{k}' AND c.code = p.p{i}), (SELECT code FROM aliases a WHERE a.category = '{k}' AND a.alias = p.p{i})) AS {n}" for i, k, n in ((2, 'objects', 'object_code'), (3, 'disciplines', 'discipline_code'), (4, 'documentTypes', 'document_type_code')))} FROM parsed p),
docs AS (SELECT *, CASE WHEN is_valid AND object_code IS NOT NULL AND discipline_code IS NOT NULL AND document_type_code IS NOT NULL THEN 0 ELSE 1 END AS unmatched_flag FROM coded)"""


def _tf(leaf: Term) -> str:
    fits = []
    for k, t in enumerate(leaf.tokens):
        cell = f"tokens[i + {k + 1}]"
        fits.append(f"starts_with({cell}, '{t}')" if leaf.prefix and k == len(leaf.tokens) - 1 else f"{cell} = '{t}'")
    if not fits:
        return "0"
    return f"len(list_filter(range(0, greatest(0, len(tokens) - {len(fits) - 1})), lambda i: {' AND '.join(fits)}))"


def _search(query: str) -> str:
    """CTE ``hits`` (doc_id, page_number, score) for a query over PAGES."""
    node = TREES[query]
    names = {term: f"f{i}" for i, term in enumerate(_terms(node))}

    def match(n: Branch | Term) -> str:
        if isinstance(n, Term):
            return f"{names[n]} > 0"
        return f"({match(n.left)} {'AND NOT' if n.kind == 'NOT' else n.kind} ({match(n.right)}))"

    def score(n: Branch | Term) -> str:
        if isinstance(n, Term):
            f = names[n]
            idf = f"ln((n_pages - d{f} + 0.5) / (d{f} + 0.5))"
            return f"((CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6::DOUBLE END) * {f} * 2.2::DOUBLE / ({f} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))"
        if n.kind == "NOT":
            return score(n.left)
        parts = [score(x) if n.kind == "AND" else f"(CASE WHEN {match(x)} THEN {score(x)} ELSE 0 END)" for x in (n.left, n.right)]
        return f"({' + '.join(parts)})"

    return f"""{PAGES},
counted AS (SELECT doc_id, page_number, dl, {', '.join(f"{_tf(leaf)} AS {n}" for leaf, n in names.items())} FROM pages),
stats AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n_pages, AVG(dl) AS mean, {', '.join(f"CAST(SUM(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d{n}" for n in names.values())} FROM counted),
hits AS (SELECT doc_id, page_number, -({score(node)}) AS score FROM counted, stats WHERE {match(node)})"""


def _live(query: str, last: str) -> str:
    """``_search`` over the documents that are not toxic."""
    return f"""WITH live AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_search(query).replace("FROM documents)", "FROM live)", 1)} {last}"""


def _pages_of(query: str) -> str:
    return f"WITH {_search(query)} SELECT doc_id, page_number, round(score, 6) AS score FROM hits"


def _ranked(query: str, where: str = "TRUE", limit: int = 50, offset: int = 0) -> str:
    return f"""WITH {_search(query)}, {RESOLVED}
SELECT h.doc_id, min(d.file_path) AS file_path, round(min(h.score), 6) AS score, COUNT(*) AS n_pages FROM hits h JOIN docs d USING (doc_id) WHERE {where}
GROUP BY h.doc_id ORDER BY min(h.score), h.doc_id LIMIT {limit} OFFSET {offset}"""


def _counted(query: str, where: str = "TRUE") -> str:
    return f"WITH {_search(query)}, {RESOLVED} SELECT COUNT(DISTINCT h.doc_id) AS n_docs FROM hits h JOIN docs d USING (doc_id) WHERE {where}"


def _snippets(last: str) -> str:
    """For a query of single words, prefixes and two-word phrases."""
    found = _terms(TREES[SNIPPET_QUERY])
    at = lambda leaf, i: "COALESCE(" + " AND ".join(f"starts_with(tokens[{i} + {k}], '{t}')" if leaf.prefix and k == len(leaf.tokens) - 1 else f"tokens[{i} + {k}] = '{t}'" for k, t in enumerate(leaf.tokens)) + ", FALSE)"
    hit = "(" + " OR ".join(at(leaf, f"(i - {o})") if o == 0 else f"(i > {o} AND {at(leaf, f'(i - {o})')})" for leaf in found for o in range(len(leaf.tokens))) + ")"
    tie = lambda i: "(" + " OR ".join(f"({i} >= 1 AND {at(leaf, i)})" for leaf in found if len(leaf.tokens) == 2) + ")"
    word = f"CASE WHEN {hit} AND NOT {tie('(i - 1)')} THEN '{T.MARK_START}' ELSE '' END || shown[i] || CASE WHEN {hit} AND NOT {tie('i')} THEN '{T.MARK_END}' ELSE '' END || CASE WHEN i < high OR high = n THEN gaps[i + 1] ELSE '' END"
    shown = "[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+"
    inside = f"CASE WHEN i > low AND i <= high THEN {word} ELSE '' END"
    return f"""WITH {PAGES},
cut AS (SELECT doc_id, page_number, tokens, regexp_extract_all(normalized_text, '{shown}') AS shown, string_split_regex(normalized_text, '{shown}') AS gaps FROM pages WHERE {' OR '.join(_tf(leaf) + ' > 0' for leaf in found)}),
begun AS (SELECT *, len(tokens) AS n, list_position(list_transform(range(1, len(tokens) + 1), lambda i: {hit}), TRUE) - 1 AS first FROM cut),
bound AS (SELECT *, CASE WHEN n <= 200 THEN 0 ELSE greatest(0, least(first - 99, n - 200)) END AS low, CASE WHEN n <= 200 THEN n ELSE greatest(0, least(first - 99, n - 200)) + 200 END AS high FROM begun),
marked AS (SELECT doc_id, page_number, translate(CASE WHEN low > 0 THEN '...' ELSE gaps[1] END || array_to_string(list_transform(range(1, n + 1), lambda i: {inside}), '') || CASE WHEN high < n THEN '...' ELSE '' END, '{T.LATIN}', '{T.CYRILLIC}') AS snippet FROM bound)
{last}"""


BOXES = f"""{LINES},
words AS (SELECT doc_id, page_number, string_split_regex(text, ' +') AS ws FROM lines),
spread AS (SELECT doc_id, page_number, CAST(i AS INTEGER) AS word_no, ws[i + 1] AS original FROM words, unnest(generate_series(0, len(ws) - 1)) u(i)),
boxes AS (SELECT doc_id, page_number, word_no, translate(lower(original), '{T.CYRILLIC}', '{T.LATIN}') AS normalized,
  CASE WHEN page_number % 5 = 4 THEN 12.0::DOUBLE ELSE word_no * 10.0::DOUBLE END AS x0, CASE WHEN page_number % 5 = 4 THEN word_no * 10.0::DOUBLE ELSE 12.0::DOUBLE END AS y0,
  CASE WHEN page_number % 5 = 4 THEN 22.0::DOUBLE ELSE word_no * 10.0::DOUBLE + 8 END AS x1, CASE WHEN page_number % 5 = 4 THEN word_no * 10.0::DOUBLE + 8 ELSE 22.0::DOUBLE END AS y1
  FROM spread WHERE original <> '')"""
DIAGNOSED = f"""{BOXES},
sums AS (SELECT doc_id, page_number, COUNT(*) AS n_words,
  SUM(CASE WHEN x0 < 0 OR x1 > 612 OR y0 < 0 OR y1 > 792 THEN 1 ELSE 0 END) / COUNT(*) AS outside,
  SUM(CASE WHEN y1 - y0 > 0 AND y1 - y0 > (x1 - x0) * 2 THEN 1 ELSE 0 END) AS tall,
  SUM(CASE WHEN NOT (y1 - y0 > 0 AND y1 - y0 > (x1 - x0) * 2) AND x1 - x0 > 0 AND x1 - x0 > (y1 - y0) * 2 THEN 1 ELSE 0 END) AS wide FROM boxes GROUP BY doc_id, page_number),
shares AS (SELECT doc_id, page_number, n_words, CAST(outside AS DOUBLE) AS outside, CASE WHEN tall + wide > 0 THEN CAST(tall / (tall + wide) AS DOUBLE) ELSE 0.0::DOUBLE END AS upright FROM sums),
diagnosed AS (SELECT *, outside > 0.05 OR upright > 0.7 AS flip, CASE WHEN outside > 0.05 AND upright > 0.7 THEN 'high' WHEN outside > 0.05 OR upright > 0.7 THEN 'medium' ELSE 'none' END AS confidence FROM shares)"""


def _placed(found: str, diagnosis: str = "flip, confidence") -> str:
    """Rows ``found`` (doc_id, page_number, term, x0, y0, x1, y1, flip, confidence) as shares of the page."""
    return f"""SELECT doc_id, page_number, term, round(CASE WHEN flip THEN y0 ELSE x0 END / 612, 6) AS x, round(CASE WHEN flip THEN 792 - x1 ELSE y0 END / 792, 6) AS y,
round(CASE WHEN flip THEN y1 - y0 ELSE x1 - x0 END / 612, 6) AS w, round(CASE WHEN flip THEN x1 - x0 ELSE y1 - y0 END / 792, 6) AS h, {diagnosis} FROM ({found})"""


CHANGES = f"""{REGISTRY}, {PREVIOUS},
hashes AS (SELECT file_hash, MIN(doc_id) AS hash_id FROM previous GROUP BY file_hash),
states AS (SELECT r.file_path, r.file_hash, p.doc_id AS known_id, h.hash_id, CASE WHEN p.cached_size = r.file_size AND p.cached_mtime = '2024-01-01T00:00:00+00:00' THEN 'skipped'
  WHEN r.file_size = 0 THEN 'error' WHEN h.hash_id IS NOT NULL THEN 'duplicate' ELSE 'to_index' END AS state
  FROM registry r LEFT JOIN previous p USING (file_path) LEFT JOIN hashes h ON h.file_hash = r.file_hash),
firsts AS (SELECT file_hash, MIN(file_path) AS first_path FROM states WHERE state = 'to_index' GROUP BY file_hash),
changes AS (SELECT s.file_path, s.known_id, CASE WHEN s.state = 'to_index' AND f.first_path <> s.file_path THEN 'duplicate' ELSE s.state END AS outcome,
  CASE WHEN s.state = 'to_index' AND f.first_path <> s.file_path THEN f.first_path WHEN s.state = 'duplicate' THEN CAST(s.hash_id AS VARCHAR) END AS duplicate_of FROM states s LEFT JOIN firsts f USING (file_hash))"""
STATUS = f"""{REGISTRY}, {PREVIOUS},
status AS (SELECT r.file_path, CASE WHEN p.doc_id IS NOT NULL AND ((p.cached_size = r.file_size AND p.cached_mtime = '2024-01-01T00:00:00+00:00') OR p.file_hash = r.file_hash) THEN 'indexed'
  WHEN p.doc_id IS NOT NULL THEN 'modified' WHEN r.file_hash IN (SELECT file_hash FROM previous) THEN 'duplicate' ELSE 'new' END AS status FROM registry r LEFT JOIN previous p USING (file_path))"""
MODULES = """modules AS (SELECT s_suppkey AS k, s_name AS module_name, (s_suppkey % 3) || '.' || (s_suppkey % 5) AS version, '1.' || (s_nationkey % 4) AS api_version FROM supplier),
deps AS (SELECT s_name AS module_name, 'Supplier#' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 9, '0') AS needs, CASE s_suppkey % 4 WHEN 0 THEN '>=1.1,<2' WHEN 1 THEN '' WHEN 2 THEN '!=1.2' ELSE '<=1.2' END AS "constraint" FROM supplier WHERE s_suppkey >= 1
  UNION ALL SELECT s_name, 'nation_3', '>=1' FROM supplier WHERE s_nationkey = 3)"""
VERSION = lambda x: f"list_transform(string_split({x}, '.'), lambda p: COALESCE(TRY_CAST(trim(p) AS INTEGER), 0))"


VERSION_CHECK = f"""d AS (SELECT d.module_name, needs, "constraint", m.api_version AS found FROM deps d JOIN modules m ON m.module_name = d.needs WHERE "constraint" <> ''),
p AS (SELECT *, unnest(string_split("constraint", ',')) AS part FROM d), o AS (SELECT *, regexp_extract(trim(part), '^(>=|<=|!=|==|>|<)?') AS op, {VERSION("found")} AS have, {VERSION("regexp_replace(trim(part), '^(>=|<=|!=|==|>|<)?\\s*', '')")} AS want FROM p)
SELECT module_name, needs, "constraint", found, bool_and(CASE op WHEN '!=' THEN have <> want WHEN '>=' THEN have >= want WHEN '<=' THEN have <= want WHEN '>' THEN have > want WHEN '<' THEN have < want ELSE have = want END) AS compatible FROM o GROUP BY 1, 2, 3, 4"""


def oracle_sql() -> dict[str, str]:
    en = "d.object_code = 'EN' AND d.discipline_code = 'D4'"
    unmatched = "d.unmatched_flag = 1 AND lower(d.file_path) LIKE 'src1%'"
    level = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_LEVELS.items())
    sql = {name: _pages_of(query) for name, query in SEARCHES.items()}
    listed = "SELECT category, to_json(list_sort(list_distinct(list(code)))) AS codes FROM codes GROUP BY category"
    pairs = lambda cond: f"(SELECT '[' || COALESCE(string_agg('{{\"alias\":\"' || alias || '\",\"code\":\"' || code || '\"}}', ',' ORDER BY alias), '') || ']' FROM aliases a WHERE a.category = c.category AND {cond})"
    sql |= {
        "search_bm25_pages": _pages_of("the OR an*"), "search_ranked_docs": _ranked("the"), "search_page2": _ranked("the OR an*", limit=16, offset=16), "search_count": _counted("the OR an*"),
        "search_with_count": f"""WITH {_search("the OR an*")}, {RESOLVED}
SELECT h.doc_id, min(d.file_path) AS file_path, round(min(h.score), 6) AS score, COUNT(*) AS n_pages, COUNT(*) OVER () AS n_docs FROM hits h JOIN docs d USING (doc_id)
GROUP BY h.doc_id ORDER BY min(h.score), h.doc_id LIMIT 16 OFFSET 16""",
        "search_filter_only": f"WITH {RESOLVED} SELECT doc_id, file_path, 0.0::DOUBLE AS score, CAST(1 AS BIGINT) AS n_pages FROM docs d WHERE {en} ORDER BY file_path, doc_id LIMIT 500",
        "search_filter_only_count": f"WITH {RESOLVED} SELECT COUNT(DISTINCT doc_id) AS n_docs FROM docs d WHERE {en}",
        "search_with_filters": _ranked("the", en, 500), "search_unmatched_only": _ranked("the", unmatched, 500), "search_path_like": _ranked("the", "lower(d.file_path) LIKE '%d_-dtl-%'", 500),
        "search_module_view": _counted("the", "d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"),
        "search_grouped_pages": f"""WITH {_search("the")}, ranked AS (SELECT doc_id, MIN(score) AS s FROM hits GROUP BY doc_id ORDER BY s, doc_id LIMIT 20)
SELECT doc_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS page_numbers, CAST(COUNT(*) AS INTEGER) AS n_hits FROM hits SEMI JOIN ranked USING (doc_id) GROUP BY doc_id""",
        "search_snippet": _snippets("SELECT doc_id, page_number, snippet FROM marked"),
        "search_terms": _snippets(f"""SELECT doc_id, page_number, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i), lambda i: t[i]), '|') AS terms
FROM (SELECT doc_id, page_number, regexp_extract_all(snippet, '(?s)\\[\\[MATCH_START\\]\\](.*?)\\[\\[MATCH_END\\]\\]', 1) AS t FROM marked)"""),
        "corpus_stats": f"WITH {PAGES} SELECT COUNT(*) AS n_pages, round(AVG(dl), 6) AS avg_dl FROM pages",
        "term_df": f"WITH {PAGES} SELECT term, COUNT(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM pages) GROUP BY term",
        "postings": f"""WITH {PAGES} SELECT term, doc_id, page_number, COUNT(*) AS tf, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS positions
FROM (SELECT doc_id, page_number, tokens[i] AS term, i FROM pages, unnest(generate_series(1, len(tokens))) u(i)) GROUP BY term, doc_id, page_number""",
        "index_prefix_terms": f"WITH {PAGES} SELECT term, COUNT(DISTINCT (doc_id, page_number)) AS df, COUNT(*) AS cf FROM (SELECT doc_id, page_number, unnest(tokens) AS term FROM pages) WHERE starts_with(term, 'th') GROUP BY term",
        "search_top": _ranked("of OR die OR la NOT thth*", limit=10, offset=5).replace("COUNT(*) AS n_pages FROM hits", "COUNT(*) AS n_pages, TRUE AS bounded FROM hits"),
        "index_changes": _live('the OR "of the" OR an*', "SELECT doc_id, page_number, round(score, 6) AS score FROM hits"),
        "index_merge": _live('the OR "of the" OR an*', "SELECT doc_id, page_number, round(score, 6) AS score, TRUE AS merged FROM hits"),
        "index_versions": f"""WITH {LINES}, gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), d AS (SELECT COUNT(*) AS a, COUNT(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gone)) AS b FROM documents),
p AS (SELECT COUNT(*) AS a, COUNT(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gone)) AS b FROM lines) SELECT 1 AS version, 'documents' AS name, a AS n FROM d UNION ALL SELECT 2, 'documents', b FROM d
UNION ALL SELECT 3, 'documents', b + (SELECT COUNT(*) FROM gone) FROM d UNION ALL SELECT 1, 'pages', a FROM p UNION ALL SELECT 2, 'pages', b FROM p UNION ALL SELECT 3, 'pages', b FROM p""",
        "ingest_refresh": f"""WITH {CHANGES}, {LINES.strip()}, n AS (SELECT doc_id, COUNT(*) AS n FROM lines GROUP BY doc_id)
SELECT c.file_path, c.outcome, c.duplicate_of, CASE WHEN c.known_id IS NOT NULL OR c.outcome = 'to_index' THEN COALESCE(n.n, 0) ELSE 0 END AS n_pages FROM changes c JOIN registry r USING (file_path) LEFT JOIN n ON n.doc_id = r.doc_id""",
        "commit_plans": f"""WITH {LINES}, n AS (SELECT doc_id, COUNT(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(text, chr(10))) + CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS INTEGER) AS page_count, COALESCE(n, 0) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n_pages FROM documents d LEFT JOIN n USING (doc_id)""",
        "normalize_text": f"WITH {PAGES} SELECT doc_id, page_number, normalized_text FROM pages",
        "denormalize_text": f"WITH {PAGES} SELECT doc_id, page_number, translate(normalized_text, '{T.LATIN}', '{T.CYRILLIC}') AS denormalized FROM pages",
        "tokenize": f"WITH {PAGES} SELECT doc_id, page_number, array_to_string(tokens, ' ') AS tokens FROM pages",
        "parse_file_name": f"WITH {REGISTRY}, {PARSED} SELECT doc_id, file_name, is_valid, p2 AS object_code, p3 AS discipline_code, p4 AS document_type_code FROM parsed",
        "resolve_codes": f"WITH {RESOLVED} SELECT doc_id, object_code, discipline_code, document_type_code, unmatched_flag FROM docs",
        "unmatched_summary": f"WITH {RESOLVED} SELECT unmatched_flag, COUNT(*) AS n, COUNT(object_code) AS with_object, COUNT(discipline_code) AS with_discipline, COUNT(document_type_code) AS with_type FROM docs GROUP BY unmatched_flag",
        "references_payload": f"WITH {ALIASES}, c AS ({listed}) SELECT category, CAST(codes AS VARCHAR) AS codes, {pairs("lang = 'en'")} AS aliases_en, {pairs("(lang = 'ru' OR lang IS NULL)")} AS aliases_ru FROM c",
        "alias_by_lang": f"WITH {ALL_ALIASES} SELECT category, alias, code FROM all_aliases WHERE lang = 'ru' OR lang IS NULL",
        "alias_by_lang_en": f"WITH {ALL_ALIASES} SELECT category, alias, code FROM all_aliases WHERE lang = 'en'",
        "reference_emptiness": f"WITH {CODES}, {ALL_ALIASES} SELECT 'codes' AS name, COUNT(*) AS n FROM codes UNION ALL SELECT 'aliases', COUNT(*) FROM all_aliases UNION ALL SELECT 'none', 0",
        "reference_insert": f"WITH {ALL_ALIASES} SELECT DISTINCT category, code FROM all_aliases",
        "alias_conflicts": f"WITH {ALL_ALIASES} SELECT category, alias, COUNT(DISTINCT code) AS n_codes FROM all_aliases GROUP BY category, alias HAVING COUNT(DISTINCT code) > 1",
        "autocomplete_code": f"""WITH {ALIASES} SELECT c.code AS "left", COALESCE((SELECT arg_min(alias, seq) FROM aliases a WHERE a.category = c.category AND a.code = c.code AND (lang = 'ru' OR lang IS NULL)), '') AS "right", c.code, TRUE AS code_on_left
FROM codes c WHERE category = 'disciplines' AND starts_with(lower(code), 'd1')""",
        "autocomplete_alias": f"""WITH {ALIASES} SELECT alias AS "left", code AS "right", code, FALSE AS code_on_left FROM aliases WHERE category = 'objects' AND lang = 'en' AND starts_with(lower(alias), 'sup')""",
        "page_split": f"""WITH {PAGES} SELECT s.doc_id, CAST(len(ls) AS INTEGER) AS page_count, CAST((SELECT COUNT(*) FROM pages p WHERE p.doc_id = s.doc_id) AS INTEGER) AS kept_pages,
sha256(COALESCE((SELECT string_agg(normalized_text, chr(10) ORDER BY page_number) FROM pages p WHERE p.doc_id = s.doc_id), '')) AS text_sha256 FROM split_lines s""",
        "empty_pages_dropped": f"WITH {LINES} SELECT doc_id, page_number, text FROM lines",
        "hash_dedup": f"WITH {REGISTRY} SELECT doc_id, file_path, file_hash, file_size FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY file_path, doc_id) AS n FROM registry) WHERE n = 1",
        "change_detection": f"WITH {CHANGES} SELECT file_path, CAST(known_id AS VARCHAR) AS known_id, outcome, duplicate_of FROM changes",
        "scan_counters": f"""WITH {CHANGES} SELECT COUNT(*) AS total, COUNT(*) FILTER (outcome = 'to_index') AS to_index, COUNT(*) FILTER (outcome = 'duplicate') AS duplicate, COUNT(*) FILTER (outcome = 'skipped') AS skipped,
COUNT(*) FILTER (outcome = 'error') AS error, COUNT(*) AS processed, 100.0::DOUBLE AS percent FROM changes""",
        "index_status": f"WITH {STATUS} SELECT file_path, status FROM status",
        "index_state": f"""WITH {STATUS}, n AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'indexed') AS indexed, COUNT(*) FILTER (status = 'duplicate') AS duplicates, COUNT(*) FILTER (status IN ('new', 'modified')) AS unindexed FROM status)
SELECT *, round(CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE (indexed + duplicates) / total * 100.0::DOUBLE END, 6) AS percent, CASE WHEN total = 0 THEN 'no_source_files' WHEN indexed = 0 AND duplicates = 0 THEN 'empty'
WHEN unindexed = 0 AND indexed > 0 THEN 'fully_indexed' WHEN unindexed = 0 THEN 'needs_update' WHEN indexed > 0 THEN 'partially_indexed' ELSE 'needs_update' END AS state FROM n""",
        "upsert_documents": f"WITH {REGISTRY} SELECT doc_id, file_path, file_hash FROM registry",
        "delete_document": f"WITH {LINES} SELECT doc_id, COUNT(*) AS n_pages FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id",
        "doc_by_id": f"WITH {REGISTRY} SELECT * FROM registry WHERE doc_id = 42",
        "doc_by_hash": f"WITH {REGISTRY} SELECT * FROM registry WHERE file_hash = (SELECT MIN(file_hash) FROM registry)",
        "doc_by_path": f"WITH {REGISTRY} SELECT * FROM registry WHERE file_path = (SELECT MAX(file_path) FROM registry)",
        "page_text_lookup": f"WITH {LINES} SELECT COALESCE(MAX(text), '') AS text FROM lines WHERE doc_id = 5 AND page_number = 1",
        "page_text_batch": f"""WITH {LINES}, ids AS (SELECT CAST(x AS BIGINT) AS doc_id FROM (VALUES (0), (1), (2), (3), (5), (8), (13), (21), (-1)) v(x))
SELECT i.doc_id, COALESCE(l.text, '') AS text, CASE WHEN d.doc_id IS NULL THEN 'no_document' WHEN l.text IS NULL THEN 'no_page' ELSE 'ok' END AS status
FROM ids i LEFT JOIN documents d ON d.doc_id = i.doc_id LEFT JOIN lines l ON l.doc_id = i.doc_id AND l.page_number = 3""",
        "word_index_by_term": f"WITH {BOXES} SELECT doc_id, page_number, normalized, COUNT(*) AS n, MIN(word_no) AS first_word FROM boxes GROUP BY doc_id, page_number, normalized",
        "highlight_single": f"""WITH {DIAGNOSED} {_placed("SELECT b.*, flip, confidence, CASE normalized WHEN 'the' THEN 'the' ELSE 'DER' END AS term FROM boxes b JOIN diagnosed USING (doc_id, page_number) WHERE normalized IN (" + f"translate('the', '{T.CYRILLIC}', '{T.LATIN}'), 'der')")}""",
        "highlight_phrase": f"""WITH {DIAGNOSED} {_placed("SELECT a.doc_id, a.page_number, 'of the' AS term, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, flip, confidence FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.word_no = a.word_no + 1 JOIN diagnosed d ON d.doc_id = a.doc_id AND d.page_number = a.page_number WHERE a.normalized = 'of' AND b.normalized = 'the'")}""",
        "highlight_manual": f"""WITH {BOXES} {_placed("SELECT b.*, TRUE AS flip, 'manual' AS confidence, 'the' AS term FROM boxes b WHERE normalized = 'the'")}""",
        "bbox_transform": f"WITH {BOXES} SELECT doc_id, page_number, word_no, y0 AS x0, 792 - x1 AS y0, y1 AS x1, 792 - x0 AS y1 FROM boxes",
        "diagnose_pages": f"WITH {DIAGNOSED} SELECT doc_id, page_number, n_words, round(outside, 6) AS outside, round(upright, 6) AS upright, flip, confidence FROM diagnosed",
        "coordinate_anomalies": f"WITH {DIAGNOSED} SELECT doc_id, page_number, n_words, round(outside, 6) AS outside, round(upright, 6) AS upright, flip, confidence FROM diagnosed WHERE confidence <> 'none'",
        "event_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')", "event_prefix": "SELECT event_id, event_type FROM events WHERE starts_with(event_type, 'p')",
        "event_level_filter": f"SELECT event_id, event_type, CAST(CASE event_type {level} END AS INTEGER) AS level FROM events WHERE CASE event_type {level} END >= 20",
        "log_levels": """SELECT event_type, CAST(CASE event_type WHEN 'error' THEN 40 ELSE 20 END AS INTEGER) AS level, COUNT(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type""",
        "write_plans": f"""WITH {LINES}, plans AS (SELECT CASE WHEN doc_id % 10 = 4 THEN NULL WHEN doc_id % 10 = 5 THEN doc_id - 3 ELSE doc_id END AS id, NOT (doc_id % 10 = 3 AND doc_id IN (SELECT doc_id FROM lines)) AS ok FROM documents)
SELECT COUNT(DISTINCT id) FILTER (ok) AS success, COUNT(*) - COUNT(DISTINCT id) FILTER (ok) AS failed FROM plans""",
        "page_range": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_count, 3 < len(string_split(text, chr(10))) AS in_range FROM documents",
        "progress_throttle_1s": """SELECT date_trunc('second', ts) AS second, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, COUNT(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts), event_type ORDER BY ts DESC, event_id DESC) AS r, COUNT(*) OVER (PARTITION BY date_trunc('second', ts), event_type) AS c FROM events) WHERE r = 1 GROUP BY 1, 2""".replace("COUNT(*) AS n FROM (", "MAX(c) AS n FROM ("),
        "event_counts_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
        "latest_status": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
        "consecutive_errors": """SELECT user_id, MAX(n) AS longest_run FROM (SELECT user_id, run, COUNT(*) AS n FROM (SELECT user_id, event_type, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY user_id, run) GROUP BY user_id""",
        "slow_events": "SELECT event_id, value FROM events WHERE value > 100",
        "until_terminal": """SELECT user_id, COUNT(*) AS n FROM (SELECT user_id, COALESCE(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM events) WHERE e = 0 GROUP BY user_id""",
        "error_threshold": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n = 10",
        "page_neighbours": f"WITH {_search('the')} SELECT doc_id, page_number, COALESCE(lag(page_number) OVER w, -1) AS previous_page, COALESCE(lead(page_number) OVER w, -1) AS next_page FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)",
        "stream_event_counts": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_breaker": """WITH r AS (SELECT *, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r WHERE event_type = 'error') SELECT user_id, event_id FROM e WHERE k % 2 = 0""",
        "stream_failures": """WITH t AS (SELECT *, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, SUM(CASE WHEN ts - before >= INTERVAL 10 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM t),
r AS (SELECT *, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS run FROM g),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, part, run ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS n FROM r WHERE event_type = 'error')
SELECT user_id, event_id, 'breaker' AS outcome FROM e WHERE k % 2 = 0 UNION ALL SELECT user_id, event_id, 'threshold' FROM e WHERE n = 5""",
        "stream_sessions": """WITH t AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE user_id IS NOT NULL),
g AS (SELECT *, SUM(CASE WHEN gap >= INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM t)
SELECT user_id, MIN(ts) AS started_at, MAX(ts) AS last_seen, COUNT(*) AS n FROM g GROUP BY user_id, part HAVING MAX(ts) + INTERVAL 8 HOUR <= (SELECT MAX(ts) - INTERVAL 1 MINUTE FROM events)""",
        "stream_statistics": "SELECT COUNT(*) AS n_rows, COUNT(*) AS n_observed, COUNT(*) FILTER (event_type = 'error') AS n_errors, COUNT(*) FILTER (value > 100) AS n_slow, CAST(0 AS BIGINT) AS running FROM events",
        "queue_statistics": """SELECT user_id, CAST(SUM(n) AS BIGINT) AS published, CAST(SUM(least(n, 2)) AS BIGINT) AS delivered, CAST(SUM(greatest(n - 2, 0)) AS BIGINT) AS dropped, MAX(least(n, 2)) AS peak
FROM (SELECT user_id, date_trunc('hour', ts), COUNT(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""",
        "queue_admitted": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2",
        "file_walk": "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS relative_path, doc_id || '.txt' AS file_name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS file_size, CASE WHEN text <> '' THEN sha256(text) END AS file_hash FROM documents",
        "extract_files": f"""WITH {BOXES}, w AS (SELECT doc_id, COUNT(*) AS n FROM boxes GROUP BY doc_id)
SELECT doc_id, 'ok' AS outcome, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS page_count, coalesce(n, 0) AS n_words FROM documents LEFT JOIN w USING (doc_id)""",
        "module_missing_deps": f"WITH {MODULES} SELECT module_name, needs FROM deps WHERE needs NOT IN (SELECT module_name FROM modules)",
        "module_version_check": f"WITH {MODULES}, {VERSION_CHECK}",
        "module_load_order": f"""WITH RECURSIVE {MODULES}, known AS (SELECT d.module_name, needs FROM deps d JOIN modules m ON m.module_name = d.needs),
every AS (SELECT list(module_name ORDER BY module_name) AS names, list({{'name': module_name, 'needs': needs}}) AS links FROM (SELECT m.module_name, k.needs FROM modules m LEFT JOIN known k USING (module_name))),
walk AS (SELECT 0 AS k, CAST([] AS VARCHAR[]) AS placed, names, links FROM every
  UNION ALL SELECT k + 1, list_append(placed, list_filter(names, lambda x: NOT list_contains(placed, x) AND len(list_filter(links, lambda l: l.name = x AND l.needs IS NOT NULL AND NOT list_contains(placed, l.needs))) = 0)[1]), names, links
  FROM walk WHERE k < len(list_distinct(names)))
SELECT CAST(k - 1 AS INTEGER) AS position, placed[k] AS module_name FROM walk WHERE k > 0""",
    }
    told = " ".join(f"WHEN {i} THEN format('{q}', lang, source)" for i, (q, _) in enumerate(CHECKED))
    first_pages = _ranked("the", "TRUE", 500)
    scanned = "scans AS (SELECT event_id AS scan_id, 'primary' AS phase, CASE WHEN event_type = 'error' THEN 'running' ELSE 'completed' END AS status, user_id AS processed_files, user_id + 10 AS total_files FROM events)"
    sql |= {
        "module_problems": f"""WITH {MODULES.replace("modules AS", "every AS", 1)}, modules AS (SELECT * FROM every WHERE k % 5 <> 4), checks AS (WITH {VERSION_CHECK.replace("FROM deps d", "FROM (SELECT * FROM deps SEMI JOIN modules USING (module_name)) d", 1)})
SELECT module_name, 'core' AS problem, '>=2' AS about FROM every WHERE k % 5 = 4 UNION ALL SELECT module_name, 'library', 'nowhere' FROM modules WHERE k % 3 = 2
UNION ALL SELECT module_name, 'missing', needs FROM deps SEMI JOIN modules USING (module_name) WHERE needs NOT IN (SELECT module_name FROM modules) UNION ALL SELECT module_name, 'version', needs FROM checks WHERE NOT compatible""",
        "module_registry": f"""WITH {MODULES} SELECT module_name, CASE WHEN k % 3 = 0 THEN '2' ELSE '1' END AS version, CASE WHEN k = 1 THEN 'error' WHEN k % 3 = 0 THEN 'active' ELSE 'loaded' END AS status,
CASE WHEN k % 7 = 0 THEN '["notes"]' ELSE '[]' END AS managed_tables, CASE WHEN k = 1 THEN 'broken' END AS error_message FROM modules WHERE k % 3 = 0 OR k % 7 <> 0""",
        "secondary_scan": "SELECT doc_id, length(COALESCE(text, '')) AS n FROM documents WHERE lang = 'en'",
        "module_manifests": f"WITH {MODULES} SELECT module_name, version, 'a/' || module_name AS path FROM modules",
        "query_errors": f"SELECT doc_id, CASE doc_id % {len(CHECKED)} {told} END AS query, doc_id % {len(CHECKED)} IN ({', '.join(str(i) for i, (_, wrong) in enumerate(CHECKED) if wrong)}) AS wrong FROM documents",
        "search_mode_normal": first_pages, "search_mode_content": first_pages, "search_mode_filters": sql["search_filter_only"],
        "backend_count": f"WITH {_search('the')}, {RESOLVED} SELECT 'basic_search,count,relevance,snippet' AS capabilities, COUNT(DISTINCT h.doc_id) AS n_docs FROM hits h JOIN docs d USING (doc_id)",
        "extract_pages": f"WITH {LINES} SELECT doc_id, CAST(COUNT(*) OVER (PARTITION BY doc_id) AS INTEGER) AS page_count, page_number, text FROM numbered",
        "settings": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'false' WHEN 4 THEN 'true' END AS flag, CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id AS VARCHAR) END AS number, lang FROM documents""",
        "text_ids": f"""WITH {REGISTRY}, h AS (SELECT *, md5('=' || doc_id || chr(10) || '=' || file_path) AS m, regexp_extract(file_path, '[^/]*$') AS name FROM registry)
SELECT doc_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS stable_id, substr(regexp_replace(file_path, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 20) AS safe_id,
lower(replace(file_path, '-', ' ')) AS field_value, regexp_replace(name, '[.][^.]*$', '') AS stem FROM h""",
        "effective_dpi": """WITH p AS (SELECT doc_id, (n_chars::DOUBLE * 300 / 72) * (900.0::DOUBLE * 300 / 72) AS px FROM documents), s AS (SELECT doc_id, CASE WHEN px > 20000000 THEN floor(300 * sqrt(20000000 / px)) ELSE 300 END AS dpi FROM p)
SELECT doc_id, CASE WHEN dpi >= 72 THEN CAST(dpi AS INTEGER) END AS dpi FROM s""",
        "scan_record": f"""WITH {CHANGES} SELECT CAST(1 AS BIGINT) AS scan_id, 'primary' AS phase, 'completed' AS status, COUNT(*) AS total_files, COUNT(*) AS processed_files, COUNT(*) FILTER (outcome = 'error') AS errors, TRUE AS ended FROM changes
UNION ALL SELECT 2, 'secondary', 'running', 0, 0, 0, FALSE""",
        "scan_snapshot": f"WITH {scanned} SELECT *, round(processed_files / total_files * 100.0::DOUBLE, 6) AS progress_percent FROM scans ORDER BY scan_id DESC LIMIT 1",
        "idle_snapshot": "SELECT CAST(0 AS BIGINT) AS scan_id, 'idle' AS phase, 'idle' AS status, CAST(0 AS BIGINT) AS processed_files, CAST(0 AS BIGINT) AS total_files, 0.0::DOUBLE AS progress_percent",
        "stale_scans": f"WITH {scanned} SELECT CASE status WHEN 'running' THEN 'interrupted' ELSE status END AS status, COUNT(*) AS n FROM scans GROUP BY 1",
        "latest_scan": f"WITH {scanned} SELECT * FROM scans ORDER BY scan_id DESC LIMIT 1",
        "path_listing": f"WITH {REGISTRY} SELECT file_path FROM registry ORDER BY file_path LIMIT 100 OFFSET 50",
        "migrated_index": f"""WITH {REGISTRY} SELECT *, CAST(-1 AS BIGINT) AS cached_size, 'none' AS cached_mtime, 'none' AS object_code, 'none' AS discipline_code, 'none' AS document_type_code, 0 AS unmatched_flag FROM registry""",
        "schema_version": "SELECT MAX(p_size) AS version FROM part",
        "delete_cascade": f"""WITH {LINES}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, COUNT(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'pages', COUNT(*) FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
        "request_durations": """SELECT CAST(s.user_id AS VARCHAR) AS correlation_id, s.ts AS started_at, round((epoch_us(e.ts) - epoch_us(s.ts)) / 1000.0::DOUBLE, 3) AS ms FROM events s JOIN events e ON e.user_id = s.user_id
AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 10 MINUTE WHERE s.event_type = 'click' AND e.event_type = 'purchase'""",
        "expired_sessions": "WITH s AS (SELECT user_id, MAX(ts) AS last_seen FROM events GROUP BY user_id) SELECT * FROM s WHERE last_seen + INTERVAL 8 HOUR <= (SELECT MAX(ts) FROM events)",
        "empty_files": f"""WITH {CHANGES.replace("registry AS (SELECT", "full_registry AS (SELECT", 1).replace("FROM registry WHERE doc_id % 10 <> 9)", "FROM full_registry WHERE doc_id % 10 <> 9)").replace("hashes AS", "registry AS (SELECT doc_id, file_path, file_hash, CASE WHEN contains(file_path, '-DTL-') THEN 0 ELSE file_size END AS file_size FROM full_registry)," + chr(10) + "hashes AS", 1)}
SELECT COUNT(*) AS total, COUNT(*) FILTER (outcome = 'to_index') AS to_index, COUNT(*) FILTER (outcome = 'duplicate') AS duplicate, COUNT(*) FILTER (outcome = 'skipped') AS skipped,
COUNT(*) FILTER (outcome = 'error') AS error, COUNT(*) AS processed, 100.0::DOUBLE AS percent FROM changes""",
        "progress_forced": """WITH w AS (SELECT *, date_trunc('hour', ts) AS second, CASE WHEN event_type = 'signup' THEN event_id END AS own FROM events)
SELECT second, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, COUNT(*) AS n FROM w GROUP BY second, event_type, own""",
        "progress_feed": """WITH f AS (SELECT *, COALESCE(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
FROM events WHERE event_type IN ('click', 'purchase', 'error')) SELECT user_id, event_id, event_type FROM f WHERE ended = 0""",
    }
    sql["highlight_files"] = sql["highlight_single"]  # the same words, read from files
    return sql
