"""DuckDB SQL for the named queries, written apart from the Spark plans.

Queries without an entry here rest on whole-graph algorithms, scores or sessions that SQL doesn't express; the
tests hold them against brute force or invariants.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_TYPES = "('heranca',1),('mestre-aprendiz',2),('estudo',3),('trabalho',4),('societario',5),('dissidencia',6),('coautoria-pontual',7)"
_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"

_PERSONS = """persons AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS institution,
 CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 3000 THEN 'precursor' WHEN s_acctbal < 6000 THEN 'mestre' ELSE 'discipulo' END AS role,
 CASE s_nationkey % 6 WHEN 0 THEN 'arquiteto' WHEN 1 THEN 'urbanista' WHEN 2 THEN 'engenheiro' WHEN 3 THEN 'professor' WHEN 4 THEN 'outro' END AS attribution,
 CASE WHEN s_suppkey % 7 <> 0 THEN (1900 + s_suppkey % 60)::INT END AS birth, CASE WHEN s_suppkey % 5 = 0 THEN (1900 + s_suppkey % 60 + s_suppkey % 90)::INT END AS death,
 CASE s_suppkey % 4 WHEN 0 THEN 'verificado' WHEN 1 THEN 'contestado' ELSE 'rascunho' END AS status,
 CASE s_suppkey % 10 WHEN 3 THEN 'check dates' WHEN 4 THEN '  ' END AS issue, s_suppkey % 3 AS n_sources,
 [s_nationkey::BIGINT] AS activities, CASE WHEN s_suppkey % 3 = 0 THEN [((s_nationkey + 1) % 25)::BIGINT, s_nationkey::BIGINT] ELSE [] END AS educations, [s_suppkey % 40, s_suppkey * 2 % 40, s_suppkey * 3 % 40, s_suppkey * 4 % 40] AS source_ids FROM supplier)"""

_LINES = {"dense": ("l_discount >= 0.09 AND l_returnflag = 'R'", "true"), "sparse": ("l_quantity >= 48 AND l_returnflag = 'R'", "true"), "multi": ("true", "(7 * x.s + 13 * y.s) % 19 = 0")}


def _rels(graph: str = "multi") -> str:
    line, pair = _LINES[graph]
    return f"""lines AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE {line}),
links AS (SELECT x.o, x.s AS a, y.s AS b FROM lines x JOIN lines y ON x.o = y.o AND x.s < y.s WHERE {pair}),
typed AS (SELECT o, a, b, CASE o_orderpriority WHEN '1-URGENT' THEN 'mestre-aprendiz' WHEN '2-HIGH' THEN 'estudo' WHEN '3-MEDIUM' THEN 'societario' WHEN '4-NOT SPECIFIED' THEN 'trabalho' WHEN '5-LOW' THEN 'heranca' END AS type FROM links JOIN orders ON o_orderkey = o),
grp AS (SELECT a, b, type, min(o) AS f, count(DISTINCT o) AS n_sources, list_sort(list(DISTINCT o)) AS sources FROM typed GROUP BY a, b, type),
rels AS (SELECT 'rel-' || a || '-' || b || '-' || type AS id, CASE WHEN f % 2 = 1 THEN b ELSE a END AS src, CASE WHEN f % 2 = 1 THEN a ELSE b END AS dst, type,
 CASE o_orderstatus WHEN 'F' THEN 'documentado' WHEN 'O' THEN 'tradicao_oral' WHEN 'P' THEN 'hipotese' END AS confidence, f % 3 = 0 AS sym,
 CASE f % 8 WHEN 0 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 3) WHEN 1 THEN year(o_orderdate) || '-' WHEN 2 THEN year(o_orderdate)::VARCHAR WHEN 3 THEN '-' || year(o_orderdate)
  WHEN 4 THEN 'anos ' || (year(o_orderdate) // 10 * 10) WHEN 5 THEN 'c. ' || year(o_orderdate) WHEN 6 THEN 'unknown' END AS period,
 n_sources, sources, CASE f % 4 WHEN 0 THEN 'verificado' WHEN 1 THEN 'contestado' ELSE 'rascunho' END AS status, CASE WHEN f % 11 = 0 THEN 'review' END AS issue,
 CASE WHEN f % 23 = 0 THEN 0 ELSE n_sources END AS evidence, CASE WHEN f % 19 = 0 THEN 450 ELSE f % 400 END AS excerpt_chars, f AS first_order,
 (CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 6 ELSE 3 END * (n_sources + 1))::BIGINT AS weight20 FROM grp JOIN orders ON o_orderkey = f)"""


def _edges(source: str = "rels", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = " AND ".join(["p.a = s.a", "p.b = s.b", *(f"p.{x.strip()} = s.{x.strip()}" for x in keys.split(",") if x.strip())])
    return f"""types(type, ord) AS (VALUES {_TYPES}),
pairs AS (SELECT {"".join(f"r.{x.strip()}, " for x in keys.split(",") if x.strip() and x.strip() != "type")}least(src, dst) AS a, greatest(src, dst) AS b, r.type AS type, ord, confidence, weight20, sources FROM {source} r JOIN types t ON t.type = r.type),
tops AS (SELECT {k}a, b, type AS top_type, row_number() OVER (PARTITION BY {k}a, b ORDER BY count(*) DESC, min(ord)) AS rn FROM pairs GROUP BY {k}a, b, type),
edges AS (SELECT {", ".join(f"p.{x.strip()}" for x in keys.split(",") if x.strip()) + ", " if keys else ""}p.a, p.b, count(*) AS n_relations, sum(weight20)::BIGINT AS weight20, min(s.top_type) AS dominant,
 array_to_string(list_transform(list_sort(list(DISTINCT ord)), lambda i: list_extract(['heranca','mestre-aprendiz','estudo','trabalho','societario','dissidencia','coautoria-pontual'], i)), ',') AS types,
 array_to_string(list_sort(list(DISTINCT confidence)), ',') AS confidences, bool_and(confidence = 'hipotese') AS only_hypotheses, len(list_distinct(flatten(list(sources)))) AS n_sources
 FROM pairs p JOIN tops s ON {on} AND s.rn = 1 GROUP BY {", ".join(f"p.{x.strip()}" for x in keys.split(",") if x.strip()) + ", " if keys else ""}p.a, p.b),
near AS (SELECT {k}a AS node, b AS other, weight20 FROM edges UNION ALL SELECT {k}b, a, weight20 FROM edges)"""


_PERIOD = r"^(?:(?:c\.|ca\.)?\s*(\d{4})(?:\s*(-)\s*(\d{4})?)?|-\s*(\d{4})|(?:anos|d[ée]cada de)\s+(\d{4}))$"


def _iv(source: str = "rels") -> str:
    """Parsed periods: pf and pl."""
    g = lambda k: f"nullif(regexp_extract(trim(period), '{_PERIOD}', {k}, 'i'), '')"
    return f"""dated AS (SELECT *, coalesce({g(1)}::INT, {g(5)}::INT // 10 * 10) AS pf,
 coalesce({g(3)}::INT, {g(4)}::INT, {g(5)}::INT // 10 * 10 + 9, CASE WHEN {g(2)} IS NULL THEN {g(1)}::INT END) AS pl, regexp_matches(trim(period), '{_PERIOD}', 'i') AS ok FROM {source})"""


_DEGREES = "degrees AS (SELECT p.id, count(n.node) AS degree, coalesce(sum(n.weight20), 0)::BIGINT AS strength20 FROM persons p LEFT JOIN near n ON n.node = p.id GROUP BY p.id)"
_BLOCKS = "blocks AS (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS block FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def _clean(c: str) -> str:
    out = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{FFFD}}]', '', 'g')"
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}_])-[\\s]*\\n[\\s]*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    out = f"regexp_replace(replace({out}, chr(13), chr(10)), '\\s*\\n\\s*', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[ \\t\\x{{A0}}]+', ' ', 'g'))"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(translate({c}, '{_ACCENTED}', '{_PLAIN}')), '’', ''''), '`', ''''), '\\s+', ' ', 'g'))"


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(translate({c}, '{_ACCENTED}', '{_PLAIN}')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _noise(c: str) -> str:
    return f"(regexp_matches({c}, '^[\\d\\s\\-–—|.·]+$') OR (length({c}) < 60 AND (({c} = upper({c}) AND {c} <> lower({c})) OR regexp_matches(lower({c}), '^(p\\.|pág\\.|página)\\s*\\d+'))) OR regexp_matches({c}, '^https?://\\S+$'))"


_CHUNKS = f"""{_BLOCKS}, cleaned AS (SELECT * FROM (SELECT doc_id, source, idx, {_clean("block")} AS text FROM blocks) WHERE text <> ''),
chained AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM cleaned),
begun AS (SELECT *, CASE WHEN prev IS NOT NULL AND position(right(prev, 1) IN '.!?:;"”’)»]') = 0 AND ((left(text, 1) = lower(left(text, 1)) AND left(text, 1) <> upper(left(text, 1))) OR left(text, 1) IN (',', ';', ')')) THEN 0 ELSE 1 END AS start FROM chained),
islands AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM begun),
paragraphs AS (SELECT doc_id, source, min(idx) AS idx, string_agg(text, ' ' ORDER BY idx) AS text FROM islands GROUP BY doc_id, source, n),
chunks AS (SELECT doc_id || '-' || idx AS chunk_id, doc_id, idx, source, text FROM paragraphs WHERE length(text) >= 40 AND NOT {_noise("text")})"""
_ALIASES = "aliases(person, name) AS (VALUES (1::BIGINT,'Apache License'),(2,'General Public License'),(3,'MIT License'),(4,'Rights Reserved'),(5,'Creative Commons'),(6,'CC BY-NC'),(2,'Public License version 3'),(7,'License'),(8,'General Public License'))"
_NAMES_ = f"{_ALIASES}, told AS (SELECT s_suppkey AS person, s_name AS name FROM supplier UNION ALL SELECT * FROM aliases)"
_UPPER, _LOWER = "A-ZÁÉÍÓÚÂÊÔÃÕÇ", "a-záéíóúâêôãõç"


def _biblio(c: str) -> str:
    """Authors and marks; blanks on either side stand in for the missing look-around."""
    authors = f"len(regexp_extract_all(' ' || {c}, '[^\\p{{L}}\\p{{N}}_][{_UPPER}]{{3,}}(?: [{_UPPER}]{{2,}})*, [{_UPPER}][{_LOWER}]+'))"
    marks = f"len(regexp_extract_all(regexp_replace(' ' || {c} || ' ', ' ', '  ', 'g'), 'dispon[ií]vel  em|acesso  em|[^\\p{{L}}\\p{{N}}_]doi[^\\p{{L}}\\p{{N}}_]|https?://|[^\\p{{L}}\\p{{N}}_]in:|\\(ed\\.\\)|\\(org\\.\\)|\\(coord\\.\\)|[^\\p{{L}}\\p{{N}}_][pvn]\\.  \\d+|dissertação  \\(|tese  \\(|trabalho  de  conclusão|\\[entrevista  cedida', 0, 'i'))"
    return f"({authors} >= 3 OR ({authors} >= 1 AND {marks} >= 3) OR {marks} >= 5)"


_LEXICON = "lexicon(grp, type, pattern) AS (VALUES ('sociedade','societario','licen[sc]ed? under'),('sociedade','societario','of the (?:in|on|th)'),('ensino','mestre-aprendiz','releas[a-z]+ under'),('ensino','mestre-aprendiz','der (?:die|das)'),('estudo','estudo','this (?:work|software)'),('estudo','estudo','de l[ao]s? '),('trabalho','trabalho','in the'),('depoimento',NULL,'all rights'))"


def _tokens(c: str) -> str:
    return f"' ' || regexp_replace({_norm(c)}, '[^a-z0-9]+', ' ', 'g') || ' '"


# the longest variants first in one alternation; separators are doubled, as a match consumes one on either side
_HITS = f"""{_NAMES_}, {_LEXICON}, gazetteer AS (SELECT DISTINCT person, trim({_tokens("name")}) AS phrase FROM told),
pattern AS (SELECT ' (' || string_agg(replace(phrase, ' ', '  '), '|' ORDER BY length(phrase) DESC, phrase) || ') ' AS re FROM (SELECT DISTINCT phrase FROM gazetteer)),
padded AS (SELECT *, {_tokens("text")} AS pad, {_norm("text")} AS norm FROM chunks),
known AS (SELECT DISTINCT chunk_id, doc_id, idx, source, person, phrase FROM (SELECT chunk_id, doc_id, idx, source, replace(unnest(regexp_extract_all(replace(pad, ' ', '  '), re, 1)), '  ', ' ') AS m FROM padded, pattern) JOIN gazetteer ON phrase = m),
trig AS (SELECT DISTINCT chunk_id, grp, type, trim(unnest(regexp_extract_all(norm, pattern))) AS term FROM padded, lexicon)"""

_UP, _LOW = "A-ZÁÉÍÓÚÂÊÔÃÕÀÇÜ", "a-záéíóúâêôãõàçü"
_WORD = f"[{_UP}][{_LOW}]+(?:-[{_UP}]?[{_LOW}]+)?"


def _q(name: str, *ctes: str, select: str, recursive: bool = False) -> None:
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
    ORACLES[name] = head + select


_G = (_rels(), _edges())
_GS = (_rels("sparse"), _edges())

_q("relation_weight", _rels(), select="SELECT id, confidence, n_sources, weight20 FROM rels")
_q("collapse_edges", *_G, select="SELECT a, b, n_relations, weight20, dominant, types, confidences, only_hypotheses, n_sources FROM edges")
_q("collapse_arcs", _rels(), select="SELECT src, dst, count(*) AS n_relations, sum(weight20)::BIGINT AS weight20 FROM rels WHERE type IN ('mestre-aprendiz','estudo','dissidencia') AND NOT sym GROUP BY src, dst")
_q("node_degree", _PERSONS, *_G, _DEGREES, select="SELECT * FROM degrees")
_q("rank_degree", _PERSONS, *_G, _DEGREES, select="SELECT id, degree FROM (SELECT * FROM degrees ORDER BY degree DESC, id LIMIT 10) WHERE degree > 0")
_q("rank_strength", _PERSONS, *_G, _DEGREES, select="SELECT id, strength20 FROM (SELECT * FROM degrees ORDER BY strength20 DESC, id LIMIT 10) WHERE strength20 > 0")
_q("degree_distribution", _PERSONS, *_G, _DEGREES, select="SELECT degree, count(*) AS n FROM degrees GROUP BY degree")
_q("ranked_neighbors", *_G, select="SELECT node, other, weight20, (row_number() OVER (PARTITION BY node ORDER BY weight20 DESC, other))::INT AS rank FROM near")
_q("filter_relations", _rels(), select="SELECT id, type, confidence, status FROM rels WHERE type IN ('mestre-aprendiz','estudo') AND confidence <> 'hipotese' AND status IN ('verificado','rascunho')")
_q("connected_vertices", _PERSONS, *_GS, select="SELECT id, name FROM persons WHERE id IN (SELECT node FROM near)")
_q("graph_vertices", _PERSONS, *_GS, select="SELECT coalesce(p.id, n.node) AS id, name, coalesce(role, 'outro') AS role, coalesce(status, 'rascunho') AS status, n.node IS NOT NULL AS connected FROM persons p FULL JOIN (SELECT DISTINCT node FROM near) n ON n.node = p.id")
_NAMED = "named AS (SELECT r.*, coalesce(p.name, r.src::VARCHAR) AS src_name, coalesce(q.name, r.dst::VARCHAR) AS dst_name FROM rels r LEFT JOIN persons p ON p.id = r.src LEFT JOIN persons q ON q.id = r.dst)"
_q("relations_named", _PERSONS, _rels(), _NAMED, select="SELECT id, src, dst, type, src_name, dst_name FROM named")
_q("person_relations", _PERSONS, _rels(), _NAMED, select="SELECT id, type, src_name, dst_name FROM named WHERE src = 7 OR dst = 7")
_q("pair_relations", _rels(), select="SELECT id, least(src, dst) AS a, greatest(src, dst) AS b, type FROM rels WHERE least(src, dst) < 3 AND greatest(src, dst) < 40")
_q("visible_edges", _rels(), "seen AS (SELECT * FROM rels WHERE type IN ('estudo','trabalho','societario') AND confidence <> 'hipotese')", _edges("seen"), select="SELECT a, b, n_relations, weight20, dominant, types, confidences, only_hypotheses, n_sources FROM edges")
_q("search_person", _PERSONS, select="SELECT id, name, match::INT AS match FROM (SELECT id, name, CASE WHEN lower(name) = 'supplier#000000007' THEN 1 WHEN contains(lower(name), '00000000') THEN 2 END AS match FROM persons) WHERE match IS NOT NULL ORDER BY match, id LIMIT 5")
_LINEID = "doc_id || '-' || idx AS id"
_q("slugify_names", _BLOCKS, select=f"SELECT {_LINEID}, {_slug('block')} AS slug FROM blocks")
_q("normalize_text", _BLOCKS, select=f"SELECT {_LINEID}, {_norm('block')} AS norm FROM blocks")
_q("clean_text", "t AS (SELECT doc_id, coalesce(text, chr(32)) AS t FROM documents)", select=f"SELECT doc_id, {_clean('t')} AS clean FROM t")
_q("noise_filter", _BLOCKS, "c AS (SELECT doc_id, idx, " + _clean("block") + " AS t FROM blocks)", select=f"SELECT {_LINEID}, {_noise('t')} AS noise FROM c")
_q(
    "merge_broken_blocks", _BLOCKS, "c AS (SELECT doc_id, idx, " + _clean("block") + " AS text FROM blocks), d AS (SELECT * FROM c WHERE text <> '')",
    "e AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM d)",
    "f AS (SELECT *, CASE WHEN prev IS NOT NULL AND position(right(prev, 1) IN '.!?:;\"”’)»]') = 0 AND ((left(text, 1) = lower(left(text, 1)) AND left(text, 1) <> upper(left(text, 1))) OR left(text, 1) IN (',', ';', ')')) THEN 0 ELSE 1 END AS start FROM e)",
    "g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM f)",
    select="SELECT doc_id, min(idx)::BIGINT AS first, string_agg(text, ' ' ORDER BY idx) AS text FROM g GROUP BY doc_id, n",
)
_q("chunk_documents", _CHUNKS, select="SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx)::INT AS paragraph, length(text)::BIGINT AS chars, text FROM chunks")
_q(
    "chunk_meta", _CHUNKS, "pages AS (SELECT d.doc_id, d.source, coalesce(sum(length(p.text)), 0) AS c FROM documents d LEFT JOIN paragraphs p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.source)",
    select="SELECT p.source, count(*) AS pages, sum(c)::BIGINT AS chars, count(*) FILTER (c < 20) AS empty_pages, sum(c) < 200 * count(*) AS scanned, (sum(c) // count(*))::BIGINT AS chars_a_page, coalesce(any_value(k.n), 0) AS chunks FROM pages p LEFT JOIN (SELECT source, count(*) AS n FROM chunks GROUP BY source) k ON k.source = p.source GROUP BY p.source",
)
_q("clean_person_name", _PERSONS, select="SELECT id, name AS clean FROM persons")
_q("infer_surname", select="SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE coalesce(list_extract(list_filter(string_split(p_name, ' '), lambda x: length(x) > 2), -1), CASE WHEN p_partkey % 3 = 1 THEN 'Filho' ELSE split_part(p_name, ' ', -1) END) END AS surname FROM part")
_FILES = "files AS (SELECT doc_id, ['TCC Ana_Silva','dissertacao','TESE Joao Lima (2)','revista','anais 1987','scan 2004 1998 2004'][doc_id % 6 + 1] || '_' || doc_id || '.pdf' AS file, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN 'Microsoft Word' END AS declared, substr(coalesce(text, ''), 1, 1500) AS opening FROM documents)"
_KINDS = "n AS (SELECT doc_id, " + _norm("file || ' ' || substr(opening, 1, 600)") + " AS n FROM files)"
_q("infer_source_type", _FILES, _KINDS, select="SELECT doc_id, CASE WHEN regexp_matches(n, 'tcc|trabalho de conclusao|trabalho final de graduacao') THEN 'tcc' WHEN regexp_matches(n, 'dissert|mestrado') THEN 'dissertacao' WHEN regexp_matches(n, '(^|[^a-z0-9_])tese([^a-z0-9_]|$)|doutorado') THEN 'tese' WHEN regexp_matches(n, 'arquitextos|revista|vitruvius|artigo') THEN 'artigo' WHEN regexp_matches(n, 'anais|seminario|docomomo') THEN 'anais' ELSE 'outro' END AS type FROM n")
_YEARS = "y AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(' ' || file || ' ' || opening || ' ', '[^0-9A-Za-z_]', '  ', 'g'), ' (19[2-9][0-9]|20[0-2][0-9]) ', 1))::INT AS year FROM files), years AS (SELECT doc_id, max(year) AS year FROM (SELECT doc_id, year, rank() OVER (PARTITION BY doc_id ORDER BY count(*) DESC) AS r FROM y GROUP BY doc_id, year) WHERE r = 1 GROUP BY doc_id)"
_q("infer_year", _FILES, _YEARS, select="SELECT f.doc_id, year FROM files f LEFT JOIN years y ON y.doc_id = f.doc_id")
_AUTHOR = """authors AS (SELECT doc_id, file, CASE WHEN s <> '' THEN trim(replace(s, '_', ' ')) WHEN length(declared) > 3 AND NOT regexp_matches(lower(declared), '@|\\.com|user|admin|windows|microsoft') THEN declared END AS author
 FROM (SELECT *, regexp_extract(regexp_replace(file, '\\.[^.]*$', ''), '^(?:DISSERTA[ÇC][ÃA]O|TESE|TCC)\\s+(.+?)(?:\\s*\\(\\d+\\))?$', 1, 'i') AS s FROM files))"""
_q("infer_author", _FILES, _AUTHOR, select="SELECT doc_id, author FROM authors")
_q(
    "propose_source", _FILES, _YEARS, _AUTHOR,
    "sur AS (SELECT a.doc_id, y.year, regexp_replace(file, '\\.[^.]*$', '') AS stem, CASE WHEN author IS NOT NULL THEN coalesce(list_extract(list_filter(regexp_split_to_array(author, '[\\s,]+'), lambda x: lower(x) NOT IN ('filho','neto','junior','júnior','sobrinho') AND length(x) > 2), -1), list_extract(list_filter(regexp_split_to_array(author, '[\\s,]+'), lambda x: x <> ''), -1)) END AS sur FROM authors a LEFT JOIN years y ON y.doc_id = a.doc_id)",
    "based AS (SELECT doc_id, substr(" + _slug("CASE WHEN sur IS NOT NULL AND year IS NOT NULL THEN sur || '-' || year ELSE coalesce(sur, stem) END") + ", 1, 48) AS b FROM sur)",
    "num AS (SELECT doc_id, CASE WHEN b = '' THEN 'fonte' ELSE b END AS b, row_number() OVER (PARTITION BY CASE WHEN b = '' THEN 'fonte' ELSE b END ORDER BY doc_id) AS rn FROM based)",
    _KINDS, "kinds AS (SELECT doc_id, CASE WHEN regexp_matches(n, 'tcc|trabalho de conclusao|trabalho final de graduacao') THEN 'tcc' WHEN regexp_matches(n, 'dissert|mestrado') THEN 'dissertacao' WHEN regexp_matches(n, '(^|[^a-z0-9_])tese([^a-z0-9_]|$)|doutorado') THEN 'tese' WHEN regexp_matches(n, 'arquitextos|revista|vitruvius|artigo') THEN 'artigo' WHEN regexp_matches(n, 'anais|seminario|docomomo') THEN 'anais' ELSE 'outro' END AS type FROM n)",
    select="SELECT n.doc_id, CASE WHEN rn = 1 THEN b ELSE b || '-' || rn END AS id, type, author, trim(translate(regexp_replace(a.file, '\\.[^.]*$', ''), '_+', '  ')) AS title, year, 'raw_pdfs/' || a.file AS file, false AS processed, true AS automatic FROM num n JOIN authors a ON a.doc_id = n.doc_id JOIN kinds k ON k.doc_id = n.doc_id LEFT JOIN years y ON y.doc_id = n.doc_id",
)
_q("inventory_new_sources", _FILES, select="SELECT file FROM files WHERE lower(file) NOT IN (SELECT lower(file) FROM files WHERE doc_id % 4 = 0)")
_q("parse_period", _rels(), _iv(), select="SELECT id, period, pf AS first, pl AS last FROM dated")
_q("effective_interval", _rels(), _iv(), select="SELECT id, coalesce(pf, pl) AS first, coalesce(pl, pf) AS last FROM dated WHERE ok")
_q("next_id", _rels(), select="SELECT 'rel-' || lpad((max(first_order) + 1)::VARCHAR, greatest(4, length((max(first_order) + 1)::VARCHAR))::INT, '0') AS next_id FROM rels")
_q("literal_excerpt_check", _CHUNKS, "e AS (SELECT chunk_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(CASE WHEN idx % 2 = 0 THEN replace(substr(text, 5, 20), ' ', '   ') ELSE 'zz ' || substr(text, 5, 20) END, '\\s+', ' ', 'g'))) AS x FROM chunks)", select="SELECT chunk_id, x <> '' AND contains(t, x) AS literal FROM e")
_q("bibliography_filter", "t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' SILVA, Ana. Acesso em p. 3 v. 2 n. 4 doi https://x' ELSE '' END AS t FROM documents)", select=f"SELECT doc_id, {_biblio('t')} AS bibliography FROM t")
_q("extract_json_blob", select="SELECT event_id, (regexp_extract('said: ' || props || ' done', '\\{.*\\}', 0, 's')::JSON ->> '$.k')::BIGINT AS k FROM events")
_q("scan_jsonl", select="SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
_q("confidence_audit", _rels(), select="SELECT type, count(*) FILTER (confidence = 'documentado') AS documentado, count(*) FILTER (confidence = 'tradicao_oral') AS tradicao_oral, count(*) FILTER (confidence = 'hipotese') AS hipotese, count(*) AS total, (count(*) FILTER (confidence = 'documentado') * 10000 // count(*))::BIGINT AS documented_bp FROM rels GROUP BY ROLLUP (type)")
_q("confidence_verdict", _rels(), "v AS (SELECT count(*) FILTER (type IN ('mestre-aprendiz','estudo') AND confidence = 'documentado') AS teaching_documented, count(*) FILTER (type IN ('mestre-aprendiz','estudo')) AS teaching, count(*) FILTER (type IN ('societario','trabalho','coautoria-pontual') AND confidence = 'documentado') AS practice_documented, count(*) FILTER (type IN ('societario','trabalho','coautoria-pontual')) AS practice FROM rels)", select="SELECT *, CASE WHEN teaching = 0 OR practice = 0 THEN 'too few' WHEN practice_documented / practice - teaching_documented / teaching > 0.2 THEN 'teaching less documented' ELSE 'alike' END AS verdict FROM v")
_q("status_histogram", _PERSONS, _rels(), select="SELECT 'relation' AS entity, status, count(*) AS n FROM rels GROUP BY status UNION ALL SELECT 'person', status, count(*) FROM persons GROUP BY status")
_q("statement_summary", select="SELECT count(*) FILTER (quality = 1) AS affirm, count(*) FILTER (quality <> 1) AS deny, count(*) FILTER (quality IS NULL) AS undefined FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_q("institution_members", _PERSONS, "m AS (SELECT id, unnest(activities) AS i FROM persons UNION SELECT id, unnest(educations) FROM persons)", select="SELECT n_nationkey AS id, n_name AS name, count(m.id) AS members, coalesce(string_agg(m.id::VARCHAR, ',' ORDER BY m.id), '') AS ids FROM nation LEFT JOIN m ON i = n_nationkey GROUP BY 1, 2")
_q("temporal_coverage", _PERSONS, _rels(), _iv(), select="SELECT count(*) AS n, count(*) FILTER (period <> '') AS with_period, count(*) FILTER (ok) AS parsable, count(*) FILTER (period <> '' AND NOT ok) AS invalid, (SELECT count(*) FROM persons WHERE birth IS NOT NULL OR death IS NOT NULL) AS dated_persons, (SELECT count(*) FROM persons) AS persons, CASE WHEN count(*) > 0 THEN count(*) FILTER (ok) * 10000 // count(*) END AS parsable_bp FROM dated")
_q("invalid_periods", _rels(), _iv(), select="SELECT id, period FROM dated WHERE period <> '' AND NOT ok")
_q("coverage_isolated", _PERSONS, *_GS, select="SELECT id, name, coalesce(role, 'outro') AS role FROM persons WHERE id NOT IN (SELECT node FROM near)")
_SOURCES = "sources AS (SELECT DISTINCT source AS id, length(source) % 2 = 0 AS processed, CASE WHEN length(source) % 3 <> 0 THEN length(source)::INT END AS priority FROM documents WHERE source IS NOT NULL)"
_q("coverage_sources", _SOURCES, select="SELECT id, processed FROM sources")
_q("coverage_pending", _PERSONS, _rels(), _NAMED, select="SELECT 'person' AS entity, id::VARCHAR AS id, name, issue FROM persons WHERE trim(coalesce(issue, '')) <> '' UNION ALL SELECT 'relation', id, src_name || ' → ' || dst_name || ' (' || type || ')', issue FROM named WHERE trim(coalesce(issue, '')) <> ''")
_REACH = "reach(node, other) AS (SELECT node, node FROM near UNION SELECT r.node, n.other FROM reach r JOIN near n ON n.node = r.other)"
_COMPS = "comps AS (SELECT node, min(other) AS comp FROM reach GROUP BY node), sized AS (SELECT comp, count(*) AS size FROM comps GROUP BY comp), ranked AS (SELECT comp, size, row_number() OVER (ORDER BY size DESC, comp) - 1 AS number FROM sized)"
_q(
    "per_type_metrics", _rels(), _edges("rels", "type"), "reach(type, node, other) AS (SELECT type, node, node FROM near UNION SELECT r.type, r.node, n.other FROM reach r JOIN near n ON n.type = r.type AND n.node = r.other)",
    "comps AS (SELECT type, node, min(other) AS comp FROM reach GROUP BY type, node), sized AS (SELECT type, comp, count(*) AS size FROM comps GROUP BY type, comp)",
    "tri AS (SELECT x.type, x.a AS x, x.b AS y, y.b AS z FROM edges x JOIN edges y ON y.type = x.type AND y.a = x.b JOIN edges z ON z.type = x.type AND z.a = x.a AND z.b = y.b)",
    "att AS (SELECT type, node, count(*) AS t FROM (SELECT type, unnest([x, y, z]) AS node FROM tri) GROUP BY type, node), deg AS (SELECT type, node, count(*) AS k FROM near GROUP BY type, node)",
    "clu AS (SELECT d.type, count(*) AS nodes, floor(avg(CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) END) * 10000)::BIGINT AS bp FROM deg d LEFT JOIN att a ON a.type = d.type AND a.node = d.node GROUP BY d.type)",
    "top AS (SELECT type, string_agg(node || ':' || k, ',' ORDER BY r) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k DESC, node) AS r FROM deg) WHERE r <= 5 GROUP BY type)",
    "all_ AS (SELECT t.type, coalesce(r.n, 0) AS relations, coalesce(r.d, 0) AS documentado, coalesce(r.o, 0) AS tradicao_oral, coalesce(r.h, 0) AS hipotese, coalesce(r.per, 0) AS with_period, coalesce(u.nodes, 0) AS nodes, coalesce(e.n, 0) AS edges, coalesce(c.n, 0) AS components, coalesce(c.m, 0) AS largest, coalesce(tri.n, 0) AS triangles, coalesce(u.bp, 0) AS clustering_bp, coalesce(top5, '') AS top5 FROM types t"
    " LEFT JOIN (SELECT type, count(*) AS n, count(*) FILTER (confidence = 'documentado') AS d, count(*) FILTER (confidence = 'tradicao_oral') AS o, count(*) FILTER (confidence = 'hipotese') AS h, count(*) FILTER (period <> '') AS per FROM rels GROUP BY type) r ON r.type = t.type"
    " LEFT JOIN clu u ON u.type = t.type LEFT JOIN (SELECT type, count(*) AS n FROM edges GROUP BY type) e ON e.type = t.type LEFT JOIN (SELECT type, count(*) AS n, max(size) AS m FROM sized GROUP BY type) c ON c.type = t.type LEFT JOIN (SELECT type, count(*) AS n FROM tri GROUP BY type) tri ON tri.type = t.type LEFT JOIN top ON top.type = t.type)",
    select="SELECT *, CASE WHEN nodes > 1 THEN 2.0::DOUBLE * edges / (nodes * (nodes - 1)) ELSE 0.0::DOUBLE END AS density, CASE WHEN relations > 0 THEN with_period * 10000 // relations END AS with_period_bp FROM all_", recursive=True,
)
_TYPED = (
    _rels("sparse"), _edges("rels", "type"), "reach(type, node, other) AS (SELECT type, node, node FROM near UNION SELECT r.type, r.node, n.other FROM reach r JOIN near n ON n.type = r.type AND n.node = r.other)",
    "comps AS (SELECT type, node, min(other) AS comp FROM reach GROUP BY type, node), main AS (SELECT type, comp FROM (SELECT type, comp, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, comp) AS r FROM comps GROUP BY type, comp) WHERE r = 1)",
    "walk(type, origin, node, d) AS (SELECT DISTINCT type, node, node, 0 FROM near UNION SELECT w.type, w.origin, n.other, w.d + 1 FROM walk w JOIN near n ON n.type = w.type AND n.node = w.node WHERE w.d < 24), hops AS (SELECT type, origin, node, min(d) AS hops FROM walk GROUP BY type, origin, node)",
)
_q("per_type_paths", *_TYPED, select="SELECT h.type, count(*) AS pairs, sum(hops)::BIGINT AS total, max(hops) AS diameter, sum(hops)::DOUBLE / count(*) AS mean FROM hops h JOIN comps c ON c.type = h.type AND c.node = h.origin JOIN main m ON m.type = c.type AND m.comp = c.comp WHERE hops > 0 GROUP BY h.type", recursive=True)
_q("component_roles", _PERSONS, *_GS, _REACH, _COMPS, select="SELECT comp, 'role' AS attribute, coalesce(role, 'outro') AS value, count(*) AS n FROM comps JOIN persons ON id = node GROUP BY ALL UNION ALL SELECT comp, 'attribution', coalesce(attribution, 'indefinida'), count(*) FROM comps JOIN persons ON id = node GROUP BY ALL", recursive=True)
_q("connected_components", *_GS, _REACH, _COMPS, select="SELECT node, c.comp, number, size FROM comps c JOIN ranked r ON r.comp = c.comp", recursive=True)
_q("largest_component", *_GS, _REACH, _COMPS, select="SELECT node FROM comps c JOIN ranked r ON r.comp = c.comp WHERE number = 0", recursive=True)
# walks of bounded length; the distance is the shortest, and no path in these graphs is longer than the bound
_WALK = "walk(origin, node, d) AS (SELECT DISTINCT node, node, 0 FROM near UNION SELECT w.origin, n.other, w.d + 1 FROM walk w JOIN near n ON n.node = w.node WHERE w.d < 24), hops AS (SELECT origin, node, min(d) AS hops FROM walk GROUP BY origin, node), origins AS (SELECT DISTINCT node FROM near ORDER BY node LIMIT 4)"
_q("apsp_hops", *_GS, _WALK, select="SELECT origin, node, hops FROM hops", recursive=True)
_q("origin_hops", *_GS, _WALK, select="SELECT origin, node, hops FROM hops WHERE origin IN (SELECT node FROM origins)", recursive=True)
_PATHS = "paths AS (SELECT count(*) AS pairs, sum(hops)::BIGINT AS total, max(hops) AS diameter FROM hops WHERE hops > 0 AND origin IN (SELECT node FROM comps c JOIN ranked r ON r.comp = c.comp WHERE number = 0))"
_q("path_stats", *_GS, _REACH, _COMPS, _WALK, _PATHS, select="SELECT *, total::DOUBLE / pairs AS mean FROM paths", recursive=True)
_q("origin_reach", *_GS, _WALK, select="SELECT origin, count(*) FILTER (hops = 1) AS hops_1, count(*) FILTER (hops = 2) AS hops_2, count(*) FILTER (hops = 3) AS hops_3, count(*) AS reachable FROM hops WHERE hops > 0 AND origin IN (SELECT node FROM origins) GROUP BY origin", recursive=True)
_q("origin_convergence", *_GS, _WALK, "p AS (SELECT * FROM hops WHERE origin < node AND origin NOT IN (SELECT node FROM origins) AND node NOT IN (SELECT node FROM origins)), v AS (SELECT p.origin, p.node FROM p JOIN hops x ON x.node = p.origin JOIN hops y ON y.origin = x.origin AND y.node = p.node WHERE x.origin IN (SELECT node FROM origins) AND x.hops + y.hops = p.hops)", select="SELECT (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS via_any, (SELECT count(*) FROM v) AS via_each", recursive=True)
_q("ego_network", *_GS, _WALK, "near2 AS (SELECT node, hops FROM hops WHERE origin = (SELECT min(node) FROM origins) AND hops <= 2)", select="SELECT a, b, weight20, x.hops AS hops_a, y.hops AS hops_b FROM edges JOIN near2 x ON x.node = a JOIN near2 y ON y.node = b", recursive=True)
_CLUST = "tri AS (SELECT x.a AS x, x.b AS y, y.b AS z FROM edges x JOIN edges y ON y.a = x.b JOIN edges z ON z.a = x.a AND z.b = y.b), att AS (SELECT node, count(*) AS t FROM (SELECT unnest([x, y, z]) AS node FROM tri) GROUP BY node), deg AS (SELECT node, count(*) AS degree FROM near GROUP BY node), clust AS (SELECT d.node, degree, coalesce(t, 0) AS triangles, CASE WHEN degree < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) END AS coefficient FROM deg d LEFT JOIN att ON att.node = d.node)"
_q("clustering", *_G, _CLUST, select="SELECT * FROM clust")
_q("transitivity", *_G, _CLUST, select="SELECT (sum(triangles) // 3)::BIGINT AS triangles, sum(degree * (degree - 1) // 2)::BIGINT AS triples, CASE WHEN sum(degree * (degree - 1) // 2) > 0 THEN sum(triangles)::DOUBLE / sum(degree * (degree - 1) // 2)::DOUBLE ELSE 0.0 END AS transitivity FROM clust")
_q(
    "graph_summary", _PERSONS, *_GS, _REACH, _COMPS, _WALK, _PATHS, _CLUST,
    "s AS (SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM edges) AS edges, (SELECT coalesce(sum(n_relations), 0)::BIGINT FROM edges) AS relations, (SELECT coalesce(sum(weight20), 0)::BIGINT FROM edges) AS weight20, (SELECT count(*) FROM edges WHERE only_hypotheses) AS hypothetical, (SELECT count(*) FROM sized) AS components, (SELECT coalesce(max(size), 0) FROM sized) AS largest,"
    " (SELECT count(*) FROM clust) AS connected, (SELECT (sum(triangles) // 3)::BIGINT FROM clust) AS triangles, (SELECT floor(avg(coefficient) * 10000)::BIGINT FROM clust) AS clustering_bp, (SELECT CASE WHEN sum(degree * (degree - 1) // 2) > 0 THEN sum(triangles)::DOUBLE / sum(degree * (degree - 1) // 2)::DOUBLE ELSE 0.0::DOUBLE END FROM clust) AS transitivity, (SELECT diameter FROM paths) AS diameter, (SELECT total::DOUBLE / pairs FROM paths) AS mean_path)",
    select="SELECT *, persons - connected AS isolated, CASE WHEN persons > 1 THEN 2.0::DOUBLE * edges / (persons * (persons - 1)) ELSE 0.0::DOUBLE END AS density, CASE WHEN connected > 1 THEN 2.0::DOUBLE * edges / (connected * (connected - 1)) ELSE 0.0::DOUBLE END AS density_connected, CASE WHEN persons > 0 THEN largest * 10000 // persons END AS largest_bp, CASE WHEN persons > 0 THEN 2.0::DOUBLE * edges / persons ELSE 0.0::DOUBLE END AS mean_degree FROM s", recursive=True,
)
_ARCS = "arcs AS (SELECT DISTINCT src, dst FROM rels WHERE type IN ('mestre-aprendiz','estudo') AND NOT sym), outd AS (SELECT src AS id, count(*) AS out_degree FROM arcs GROUP BY src)"
_q("teaching_out_degree", _rels(), _ARCS, select="SELECT * FROM outd")
_q("teaching_in_degree", _rels(), _ARCS, select="SELECT dst AS id, count(*) AS in_degree FROM arcs GROUP BY dst ORDER BY in_degree DESC, id LIMIT 15")
_q("teaching_concentration", _rels(), _ARCS, "t AS (SELECT (SELECT count(*) FROM rels WHERE type IN ('mestre-aprendiz','estudo')) AS relations, (SELECT count(*) FROM arcs) AS arcs, (SELECT count(*) FROM outd) AS emitters, (SELECT count(DISTINCT dst) FROM arcs) AS receivers, (SELECT sum(out_degree)::BIGINT FROM (SELECT * FROM outd ORDER BY out_degree DESC, id LIMIT 3)) AS top3)", select="SELECT *, CASE WHEN arcs > 0 THEN top3 * 10000 // arcs END AS share_bp, top3 * 10 >= arcs * 6 AS concentrated FROM t")
_q(
    "decade_slices", _rels(), _iv(), "eff AS (SELECT *, coalesce(pf, pl) AS f, coalesce(pl, pf) AS l FROM dated WHERE ok), dec AS (SELECT unnest(range(min(f) // 10 * 10, max(l) // 10 * 10 + 1, 10)) AS decade FROM eff)",
    "sl AS (SELECT decade, 'active' AS mode, e.* FROM eff e JOIN dec ON f <= decade + 9 AND l >= decade UNION ALL SELECT decade, 'cumulative', e.* FROM eff e JOIN dec ON f <= decade + 9)", _edges("sl", "decade, mode"),
    "reach(decade, mode, node, other) AS (SELECT decade, mode, node, node FROM near UNION SELECT r.decade, r.mode, r.node, n.other FROM reach r JOIN near n ON n.decade = r.decade AND n.mode = r.mode AND n.node = r.other)",
    "comps AS (SELECT decade, mode, node, min(other) AS comp FROM reach GROUP BY ALL), sized AS (SELECT decade, mode, comp, count(*) AS size FROM comps GROUP BY ALL)",
    "tri AS (SELECT decade, mode, unnest([x.a, x.b, y.b]) AS node FROM edges x JOIN edges y USING (decade, mode) JOIN edges z USING (decade, mode) WHERE y.a = x.b AND z.a = x.a AND z.b = y.b), att AS (SELECT decade, mode, node, count(*) AS t FROM tri GROUP BY ALL), deg AS (SELECT decade, mode, node, count(*) AS k FROM near GROUP BY ALL)",
    "clu AS (SELECT decade, mode, count(*) AS nodes, floor(avg(CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) END) * 10000)::BIGINT AS clustering_bp FROM deg LEFT JOIN att USING (decade, mode, node) GROUP BY decade, mode)",
    select="SELECT decade::INT AS decade, mode, r.n AS relations, nodes, e.n AS edges, c.n AS components, c.m AS largest, CASE WHEN nodes > 1 THEN 2.0::DOUBLE * e.n / (nodes * (nodes - 1)) ELSE 0.0::DOUBLE END AS density, clustering_bp FROM clu JOIN (SELECT decade, mode, count(*) AS n FROM edges GROUP BY ALL) e USING (decade, mode) JOIN (SELECT decade, mode, count(*) AS n FROM sl GROUP BY ALL) r USING (decade, mode) JOIN (SELECT decade, mode, count(*) AS n, max(size) AS m FROM sized GROUP BY ALL) c USING (decade, mode)", recursive=True,
)
_q("modularity", *_G, "k AS (SELECT node % 5 AS c, sum(weight20)::DOUBLE AS k FROM near GROUP BY 1), l AS (SELECT a % 5 AS c, sum(weight20)::DOUBLE AS l FROM edges WHERE a % 5 = b % 5 GROUP BY 1), m AS (SELECT sum(weight20)::DOUBLE AS m FROM edges)", select="SELECT sum(coalesce(l, 0) / m - (k / (2 * m)) * (k / (2 * m))) AS modularity FROM k LEFT JOIN l ON l.c = k.c, m")
_q("graph_json_edges", *_G, select="SELECT a, b, to_json({'a': a, 'b': b, 'n_relations': n_relations, 'weight20': weight20, 'dominant': dominant, 'types': types, 'confidences': confidences, 'only_hypotheses': only_hypotheses, 'n_sources': n_sources})::VARCHAR AS json FROM edges")
_q(
    "graph_json_persons", _PERSONS, *_G, _DEGREES, "own AS (SELECT x AS id, list_sort(list(r)) AS relations FROM (SELECT unnest([src, dst]) AS x, id AS r FROM rels) GROUP BY x)",
    select="SELECT p.id, to_json({'id': p.id, 'name': name, 'birth': birth, 'death': death, 'attribution': attribution, 'role': role, 'status': status, 'issue': issue, 'activities': activities, 'educations': educations, 'degree': degree, 'strength20': strength20, 'relations': coalesce(relations, [])})::VARCHAR AS json FROM persons p JOIN degrees d ON d.id = p.id LEFT JOIN own o ON o.id = p.id",
)
_t = lambda c: f"coalesce({c}::VARCHAR, '')"
_q(
    "export_persons_flat", _PERSONS, *_GS, _DEGREES, _NAMES_, _WALK, "reach(node, other) AS (SELECT id, id FROM persons UNION SELECT r.node, n.other FROM reach r JOIN near n ON n.node = r.other)", _COMPS,
    "nth AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM origins), far AS (SELECT h.node AS id, " + ", ".join(f"min(hops) FILTER (k = {k}) AS hops_{k}" for k in range(1, 5)) + " FROM hops h JOIN nth ON nth.node = origin GROUP BY h.node)",
    "n AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest([src, dst]) AS x FROM rels) GROUP BY x), inst AS (SELECT id, string_agg(i::VARCHAR, '; ' ORDER BY i) AS institutions FROM (SELECT id, unnest(activities) AS i FROM persons UNION SELECT id, unnest(educations) FROM persons) GROUP BY id)",
    "also AS (SELECT person AS id, string_agg(name, '; ' ORDER BY name) AS aliases FROM aliases GROUP BY person)",
    select="SELECT p.id, name, '' AS full_name, " + ", ".join(f"{_t(c)} AS {c}" for c in ("attribution", "role", "birth", "death")) + ", '' AS birthplace, status, coalesce(n.n, 0) AS n_relations, degree, strength20 / 20.0::DOUBLE AS strength, '' AS betweenness, '' AS closeness, '' AS eigenvector, number AS component, size AS component_size, '' AS community, degree = 0 AS isolated, "
    + ", ".join(f"{_t(f'hops_{k}')} AS hops_{k}" for k in range(1, 5)) + ", coalesce(institutions, '') AS institutions, coalesce(aliases, '') AS aliases, array_to_string(source_ids, '; ') AS sources, coalesce(issue, '') AS issue"
    " FROM persons p JOIN degrees d ON d.id = p.id JOIN comps c ON c.node = p.id JOIN ranked r ON r.comp = c.comp LEFT JOIN n ON n.id = p.id LEFT JOIN inst i ON i.id = p.id LEFT JOIN also a ON a.id = p.id LEFT JOIN far f ON f.id = p.id", recursive=True,
)
_q(
    "export_relations_flat", _PERSONS, _rels(), _NAMED,
    select="SELECT id, src, src_name, dst, dst_name, type, '' AS subtype, sym AS symmetric, coalesce(period, '') AS period, confidence, status, weight20 / 20.0::DOUBLE AS weight, n_sources, array_to_string(list_transform(sources, lambda x: 'ord-' || x), '; ') AS sources, array_to_string(list_transform(sources, lambda x: CASE WHEN x % 3 <> 0 THEN (x % 300)::VARCHAR ELSE '' END), '; ') AS pages, '' AS description, coalesce(issue, '') AS issue, '' AS breaks, '' AS entered_by, '' AS entered FROM named",
)
_q("lexicon_triggers", _CHUNKS, _HITS, select="SELECT chunk_id, grp, term FROM trig")
_q("gazetteer_matches", _CHUNKS, _HITS, select="SELECT chunk_id, person, phrase FROM known")
_q("name_variants", _CHUNKS, _HITS, select="SELECT phrase AS variant, len(string_split(phrase, ' '))::INT AS n_words, count(*) AS n_persons, string_agg(person::VARCHAR, ',' ORDER BY person) AS persons FROM gazetteer GROUP BY phrase")
_q("context_window", _CHUNKS, "w AS (SELECT chunk_id, coalesce(lag(text) OVER o, '') AS b, coalesce(lead(text) OVER o, '') AS a FROM chunks WINDOW o AS (PARTITION BY doc_id ORDER BY idx))", select="SELECT chunk_id, length(b)::BIGINT AS chars_before, length(a)::BIGINT AS chars_after, right(b, 20) AS before_tail, substr(a, 1, 20) AS after_head FROM w")
_q("learn_aliases", _PERSONS, select="SELECT id AS person, 'Sr. ' || name AS variant FROM persons WHERE id % 3 = 2")
_q("merge_relations", _rels(), "b AS (SELECT id AS key, unnest(sources) AS s, 0 AS new FROM rels UNION ALL SELECT CASE WHEN first_order % 5 = 0 THEN 'new-' || id ELSE id END, first_order % 100, 1 FROM rels WHERE (first_order % 100) % 2 = 0)", select="SELECT key, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources, min(new) = 1 AS is_new, count(*) FILTER (new = 1) AS n_accepted FROM b GROUP BY key")
_q(
    "create_persons", _PERSONS, "old AS (SELECT " + _slug("name") + " AS id FROM persons UNION ALL SELECT " + _slug("name") + " || '-2' FROM persons WHERE id % 6 = 0)",
    "prop AS (SELECT seq, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN 'Nova Pessoa' WHEN 2 THEN 'Só' || id END AS name FROM (SELECT unnest([2 * id, 2 * id + 1]) AS seq, id, name FROM persons) WHERE id % 4 <> 3)",
    "based AS (SELECT *, " + _slug("name") + " AS base FROM prop), ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS r FROM based)",
    "slots AS (SELECT base, k, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id FROM (SELECT base, unnest(range(1, n + 4)) AS k FROM (SELECT base, count(*) AS n FROM based GROUP BY base))), free AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM slots WHERE id NOT IN (SELECT id FROM old))",
    select="SELECT seq, f.id, name, 'rascunho' AS status, CASE WHEN NOT contains(name, ' ') THEN 'confirmar nome completo em outra fonte' END AS issue FROM ranked JOIN free f ON f.base = ranked.base AND f.r = ranked.r",
)
_DECIDED = """decided AS (SELECT id AS seq, CASE WHEN first_order % 17 = 0 THEN -1 ELSE src END AS src, CASE WHEN first_order % 13 = 0 THEN src ELSE dst END AS dst, CASE WHEN first_order % 11 = 0 THEN 'dissidencia' WHEN first_order % 23 = 0 THEN 'friends' ELSE type END AS type,
 sym, CASE WHEN first_order % 5 = 0 THEN 'hipotese' END AS confidence, CASE WHEN first_order % 7 <> 0 THEN first_order % 50 END AS source, CASE WHEN first_order % 10 = 0 THEN 'check' END AS issue FROM rels WHERE first_order % 3 <> 1),
judged AS (SELECT *, CASE WHEN src = dst THEN 'same-person' WHEN type = 'friends' THEN 'bad-type' WHEN src NOT IN (SELECT id FROM persons) OR dst NOT IN (SELECT id FROM persons) THEN 'unknown-person' WHEN source >= 45 THEN 'unknown-source'
 WHEN confidence IS NULL AND source IS NULL THEN 'needs-source' WHEN confidence = 'hipotese' AND source IS NULL AND issue IS NULL THEN 'needs-issue' END AS refused FROM decided)"""
_q("relation_refusals", _PERSONS, _rels(), _DECIDED, select="SELECT seq, refused FROM judged WHERE refused IS NOT NULL")
_KEYS = "CASE WHEN sym OR type NOT IN ('mestre-aprendiz','estudo','dissidencia') THEN least(src, dst) ELSE src END AS ka, CASE WHEN sym OR type NOT IN ('mestre-aprendiz','estudo','dissidencia') THEN greatest(src, dst) ELSE dst END AS kb"
_q(
    "accept_relations", _PERSONS, _rels(), _DECIDED, f"sound AS (SELECT *, {_KEYS} FROM judged WHERE refused IS NULL), old AS (SELECT *, {_KEYS} FROM rels), target AS (SELECT ka, kb, type, min(id) AS id FROM old GROUP BY ka, kb, type)",
    "batch AS (SELECT ka, kb, type, min(seq) AS seq, arg_min({'src': src, 'dst': dst, 'sym': sym, 'confidence': coalesce(confidence, 'documentado')}, seq) AS f, list(DISTINCT source) FILTER (source IS NOT NULL) AS added, arg_min(issue, seq) FILTER (issue IS NOT NULL) AS opened FROM sound GROUP BY ka, kb, type)",
    "hit AS (SELECT b.*, t.id FROM batch b LEFT JOIN target t ON t.ka = b.ka AND t.kb = b.kb AND t.type = b.type), fresh AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM hit WHERE id IS NULL)",
    select="SELECT r.id, src, dst, r.type, sym AS symmetric, confidence, array_to_string(list_sort(list_distinct(list_concat(sources, coalesce(added, [])))), ',') AS source_ids, coalesce(issue, opened) AS issue, CASE WHEN h.id IS NULL THEN 'kept' ELSE 'merged' END AS effect FROM rels r LEFT JOIN (SELECT * FROM hit WHERE id IS NOT NULL) h ON h.id = r.id"
    " UNION ALL SELECT 'rel-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0'), f.src, f.dst, type, f.sym, f.confidence, array_to_string(list_sort(coalesce(added, [])), ','), opened, 'new' FROM fresh",
)
_q(
    "accept_statements", _PERSONS, _SOURCES, "said AS (SELECT doc_id AS seq, doc_id % 150 AS person, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN false END AS affirms, CASE WHEN doc_id % 4 <> 0 THEN 'point ' || doc_id ELSE '(sem argumento registrado)' END AS argument, source FROM documents WHERE doc_id % 150 IN (SELECT id FROM persons) AND source IN (SELECT id FROM sources WHERE processed))",
    select="SELECT 'dep-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS id, person, affirms, argument, source FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM said)",
)
_q("mark_processed", _SOURCES, "marks AS (SELECT source AS id, arg_max(doc_id % 2 = 0, doc_id) AS flag FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 0 GROUP BY source)", select="SELECT s.id, coalesce(flag, processed) AS processed FROM sources s LEFT JOIN marks m ON m.id = s.id")


def _rule(name: str, level: str, rule: str, table: str, *ctes: str, rows: str, message: str = "''") -> None:
    _q(name, *ctes, select=f"SELECT '{level}' AS level, '{rule}' AS rule, '{table}:' || id AS entity, {message} AS message FROM ({rows})")


_rule("rule_unique_id", "error", "duplicate-id", "lines", rows="SELECT l_orderkey || '-' || l_linenumber % 5 AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", message="n::VARCHAR")
_q(
    "rule_referential", _PERSONS, _rels(), _SOURCES, "src AS (SELECT 'ord-' || o_orderkey AS id FROM orders WHERE o_orderkey % 41 <> 0 UNION ALL SELECT 'src-' || id FROM sources WHERE processed)",
    "bad AS (SELECT 'relations:' || id AS entity, 'src' AS message FROM rels WHERE CASE WHEN first_order % 29 = 0 THEN -1 ELSE src END NOT IN (SELECT id FROM persons)"
    " UNION ALL SELECT 'relations:' || id, 'dst' FROM rels WHERE CASE WHEN first_order % 31 = 0 THEN -2 ELSE dst END NOT IN (SELECT id FROM persons)"
    " UNION ALL SELECT 'relations:' || id, 'source_ids' FROM (SELECT id, 'ord-' || unnest(sources) AS s FROM rels) WHERE s NOT IN (SELECT id FROM src)"
    " UNION ALL SELECT 'relations:' || id, 'breaks' FROM rels WHERE first_order % 37 = 0"
    " UNION ALL SELECT 'statements:' || doc_id, 'person' FROM documents WHERE doc_id % 101 + 1 NOT IN (SELECT id FROM persons)"
    " UNION ALL SELECT 'statements:' || doc_id, 'source' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.id = 'src-' || d.source)"
    " UNION ALL SELECT 'persons:' || id, 'source_ids' FROM (SELECT id, 'ord-' || unnest(source_ids) AS s FROM persons) WHERE s NOT IN (SELECT id FROM src))",
    select="SELECT 'error' AS level, 'reference' AS rule, entity, message FROM bad",
)
_rule("rule_vocabulary", "error", "institution", "persons", _PERSONS, rows="SELECT id, 'activities' AS m FROM persons WHERE id % 17 = 0 OR institution = 3 UNION ALL SELECT id, 'educations' FROM (SELECT id, unnest(educations) AS i FROM persons) WHERE i = 3", message="m")
_rule("rule_unknown_keys", "error", "schema", "persons", _PERSONS, rows="SELECT id, array_to_string(list_filter([CASE WHEN id % 6 = 0 THEN 'age' END, CASE WHEN id % 9 = 0 THEN 'nickname' END], lambda x: x IS NOT NULL), ',') AS m FROM persons WHERE id % 6 = 0 OR id % 9 = 0", message="m")
_rule("rule_single_token_name", "warning", "single-token-name", "persons", _PERSONS, rows="SELECT id FROM persons WHERE trim(name) <> '' AND NOT regexp_matches(trim(name), '\\s')")
_rule("rule_missing_attr", "warning", "missing-attribution", "persons", _PERSONS, rows="SELECT id FROM persons WHERE attribution IS NULL")
_rule("rule_verified_unsourced", "warning", "unsourced", "persons", _PERSONS, rows="SELECT id FROM persons WHERE status = 'verificado' AND n_sources = 0")
_rule("rule_evidence", "error", "evidence", "relations", _rels(), rows="SELECT id FROM rels WHERE evidence = 0 AND (confidence = 'documentado' OR (confidence = 'hipotese' AND trim(coalesce(issue, '')) = ''))")
_rule("rule_direction", "warning", "direction", "relations", _rels(), rows="SELECT id FROM rels WHERE sym AND type IN ('mestre-aprendiz','estudo','dissidencia')")
_rule("rule_period_format", "warning", "period", "relations", _rels(), rows="SELECT id FROM rels WHERE period <> '' AND NOT regexp_matches(period, '^((c\\.|ca\\.)\\s*)?(\\d{4}(-(\\d{4})?)?|-\\d{4}|anos \\d{4}|d[ée]cada de \\d{4})$')")
_rule("rule_long_excerpt", "warning", "long-excerpt", "relations", _rels(), rows="SELECT id FROM rels WHERE excerpt_chars > 400")
_KEY = "CASE WHEN sym OR type NOT IN ('mestre-aprendiz','estudo','dissidencia') THEN least(src, dst) || '-' || greatest(src, dst) ELSE src || '-' || dst END || '-' || type"
_rule("rule_duplicate_key", "error", "duplicate", "relations", _rels(), rows=f"SELECT {_KEY} AS id, count(*) AS n FROM (SELECT * FROM rels UNION ALL SELECT * FROM rels WHERE first_order % 31 = 0) GROUP BY 1 HAVING count(*) > 1", message="n::VARCHAR")
_ALIAS = "aliases AS (SELECT CASE WHEN id % 13 = 0 THEN id + 1000000 ELSE id END AS id, 's ' || (id // 2) AS variant FROM persons)"
_rule("rule_alias_target", "error", "alias", "aliases", _PERSONS, _ALIAS, rows="SELECT id FROM aliases WHERE id NOT IN (SELECT id FROM persons)", message="'person'")
_rule("rule_alias_ambiguous", "warning", "ambiguous-alias", "aliases", _PERSONS, _ALIAS, rows="SELECT variant AS id, count(DISTINCT id) AS n FROM aliases GROUP BY variant HAVING count(DISTINCT id) > 1", message="n::VARCHAR")
_rule("rule_missing_file", "warning", "missing-file", "sources", rows="SELECT doc_id AS id FROM documents WHERE doc_id % 8 = 0", message="'file'")
_WRONG = {
    "persons": {"id": "id IS NULL", "name": "trim(coalesce(name, '')) = ''", "death": "death < birth"},
    "relations": {"src": "src IS NULL", "dst": "dst IS NULL", "same": "src = dst", "type": "type IS NULL", "confidence": "confidence IS NULL"},
}
_SCHEMA = " UNION ALL ".join(f"SELECT '{t}:' || id AS e, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in w.items())}], lambda x: x IS NOT NULL), ',') AS m FROM {'persons' if t == 'persons' else 'rels'}" for t, w in _WRONG.items())
_q("rule_schema", _PERSONS, _rels(), select=f"SELECT 'error' AS level, 'schema' AS rule, e AS entity, m AS message FROM ({_SCHEMA}) WHERE m <> ''")
_NAMES = "schema unknown_keys unique_id referential vocabulary single_token_name missing_attr verified_unsourced evidence direction period_format long_excerpt duplicate_key alias_target alias_ambiguous missing_file".split()
ORACLES["validation_summary"] = "SELECT level, rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT level, rule FROM ({ORACLES['rule_' + n]})" for n in _NAMES) + ") GROUP BY level, rule"

_REPLAY = """log AS (SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, (props::JSON ->> '$.k')::BIGINT AS item, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'discard' WHEN 'view' THEN 'defer' WHEN 'click' THEN 'undo' END AS action FROM events WHERE event_type IN ('purchase','error','view','click')),
fold(source, seq, stack) AS (SELECT source, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT source FROM log) UNION ALL SELECT f.source, f.seq + 1, CASE WHEN l.action = 'undo' THEN CASE WHEN len(f.stack) = 0 THEN f.stack ELSE f.stack[1:len(f.stack) - 1] END ELSE list_append(f.stack, l.event_id) END FROM fold f JOIN log l ON l.source = f.source AND l.seq = f.seq + 1),
standing AS (SELECT l.* FROM (SELECT source, unnest(arg_max(stack, seq)) AS event_id FROM fold GROUP BY source) s JOIN log l ON l.source = s.source AND l.event_id = s.event_id)"""
_q("replay_decisions", _REPLAY, select="SELECT source, event_id, item, action FROM standing", recursive=True)
_q("decision_scoreboard", _REPLAY, select="SELECT source, count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'discard') AS discarded, count(*) FILTER (action = 'defer') AS deferred FROM standing GROUP BY source", recursive=True)
_q("standing_effects", _REPLAY.replace("event_id, (props", "event_id, ts, (props"), select="SELECT item, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, arg_min(source, {'ts': ts, 'event_id': event_id, 'source': source}) AS first FROM standing WHERE action = 'accept' GROUP BY item", recursive=True)
_q("queue_pending", _REPLAY, "last AS (SELECT source, item, arg_max(action, seq) AS action FROM standing GROUP BY source, item)", select="SELECT i.source, i.item, CASE WHEN action = 'defer' THEN 1 ELSE 0 END AS deferred FROM (SELECT DISTINCT source, item FROM log) i LEFT JOIN last l ON l.source = i.source AND l.item = i.item WHERE action IS NULL OR action = 'defer'", recursive=True)
_q(
    "person_timeline", _PERSONS, _rels(), _NAMED, _iv("named"), "r AS (SELECT src, dst, src_name, dst_name, type, coalesce(pf, pl) AS y, pl AS e FROM dated WHERE coalesce(pf, pl) IS NOT NULL)",
    select="""SELECT id AS person, birth AS year, NULL::INT AS until, 'birth' AS kind, 'birth' AS label FROM persons WHERE birth IS NOT NULL UNION ALL SELECT id, death, NULL, 'death', 'death' FROM persons WHERE death IS NOT NULL
 UNION ALL SELECT id, birth + 20, birth + 25, 'education', 'Course — ' || n_name FROM persons LEFT JOIN nation ON n_nationkey = institution WHERE birth IS NOT NULL
 UNION ALL SELECT src, y, e, 'relation', type || ' — ' || dst_name FROM r UNION ALL SELECT dst, y, e, 'relation', type || ' — ' || src_name FROM r""",
)

# names: boundaries are consumed, so separators are doubled first; blanks inside names match any number of them
_UP, _LOW = "A-ZÁÉÍÓÚÂÊÔÃÕÀÇÜ", "a-záéíóúâêôãõàçü"
_WORD = f"[{_UP}][{_LOW}]+(?:-[{_UP}]?[{_LOW}]+)?"
_NAME = f"(?:^|[^\\p{{L}}\\p{{N}}_])({_WORD}(?:\\s+(?:(?:d[aoe]s?|e|y|von|van|de la|della|di)\\s+)?{_WORD}){{1,4}}(?:\\s+(?:Neto|Filho|Júnior|Junior|Sobrinho))?)(?:[^\\p{{L}}\\p{{N}}_]|$)"
_MAIN = "list_filter(regexp_split_to_array(n, '\\s+'), lambda t: lower(t) NOT IN ('de','da','do','das','dos','e','y','von','van','di','della','la'))"
_FUNNEL = f"""{_CHUNKS}, {_HITS},
raw_names AS (SELECT chunk_id, source, unnest(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g'), '{_NAME}', 1)) AS n FROM chunks),
all_names AS (SELECT DISTINCT chunk_id, source, {_norm("n")} AS name FROM raw_names WHERE len({_MAIN}) >= 2 AND len(list_filter({_MAIN}, lambda t: {_norm("t")} IN ('license','version','public','general','rights','apache','licensed','released'))) = 0),
names AS (SELECT * FROM all_names n WHERE NOT EXISTS (SELECT 1 FROM gazetteer WHERE contains({_tokens("n.name")}, ' ' || phrase || ' '))),
matched AS (SELECT c.*, coalesce(k.n, 0) AS n_known, coalesce(u.n, 0) AS n_unknown, coalesce(t.n, 0) AS n_triggers, coalesce(t.statement, false) AS statement, coalesce(t.types, '') AS types FROM chunks c
 LEFT JOIN (SELECT chunk_id, count(DISTINCT person) AS n FROM known GROUP BY chunk_id) k ON k.chunk_id = c.chunk_id LEFT JOIN (SELECT chunk_id, count(*) AS n FROM names GROUP BY chunk_id) u ON u.chunk_id = c.chunk_id
 LEFT JOIN (SELECT chunk_id, count(*) FILTER (grp <> 'depoimento') AS n, bool_or(grp = 'depoimento') AS statement, array_to_string(list_sort(list(DISTINCT type) FILTER (grp <> 'depoimento' AND type IS NOT NULL)), ',') AS types FROM trig GROUP BY chunk_id) t ON t.chunk_id = c.chunk_id WHERE NOT {_biblio("text")}),
cand AS (SELECT * FROM matched WHERE (n_known + n_unknown > 0 AND n_triggers > 0) OR (statement AND n_known > 0) OR n_known >= 2),
prop AS (SELECT chunk_id, source, doc_id, idx, statement, doc_id % 100 AS source_id, doc_id % 20 AS src, doc_id % 17 AS dst, ['heranca','mestre-aprendiz','estudo','trabalho','societario','dissidencia','coautoria-pontual','unknown-type'][idx % 8 + 1] AS type, CASE WHEN doc_id % 9 = 0 THEN 'timeout' END AS error, CASE WHEN idx % 3 = 0 THEN 'made up words' ELSE substr(text, 3, 25) END AS excerpt, text FROM cand),
lit AS (SELECT *, lower(trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM prop)"""
_q("unknown_names", _FUNNEL, select="SELECT chunk_id, name FROM names WHERE chunk_id IN (SELECT chunk_id FROM matched)")
_SCORE = "4 * n_known + 2 * n_unknown + n_triggers + CASE WHEN n_known >= 2 THEN 4 ELSE 0 END AS score2"
_q("prefilter_candidates", _FUNNEL, select=f"SELECT chunk_id, n_known, n_unknown, n_triggers, statement, types, {_SCORE} FROM cand")
_q("candidates_per_page", _FUNNEL, select="SELECT doc_id, count(*) AS candidates FROM cand GROUP BY doc_id")
_q("top_triggers", _FUNNEL, select="SELECT grp || ':' || term AS trigger, count(*) AS n FROM trig WHERE chunk_id IN (SELECT chunk_id FROM cand) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25")
_q("top_persons", _FUNNEL, select="SELECT person, count(*) AS n FROM known WHERE chunk_id IN (SELECT chunk_id FROM cand) GROUP BY person ORDER BY n DESC, person LIMIT 25")
_COUNTS = {
    "sound": "true", "candidates": "p", "name_without_trigger": "n_known + n_unknown > 0 AND n_triggers = 0 AND NOT statement AND n_known < 2", "trigger_without_name": "n_triggers > 0 AND n_known + n_unknown = 0",
    "pair_without_trigger": "n_known >= 2 AND n_triggers = 0", "statements": "p AND statement",
}
_q(
    "prefilter_stats", _FUNNEL, "m AS (SELECT *, (n_known + n_unknown > 0 AND n_triggers > 0) OR (statement AND n_known > 0) OR n_known >= 2 AS p FROM matched)",
    "s AS (SELECT (SELECT count(*) FROM chunks) AS chunks, " + ", ".join(f"(SELECT count(*) FROM m WHERE {c}) AS {n}" for n, c in _COUNTS.items()) + ")",
    select="SELECT *, chunks - sound AS bibliography, CASE WHEN chunks > 0 THEN (chunks - candidates) * 10000 // chunks END AS discarded_bp FROM s",
)
_q(
    "source_status", _SOURCES, _FUNNEL, "per AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 9 <> 0) AS done FROM cand GROUP BY source)",
    select="SELECT id AS source, processed, priority, d.n AS documents, coalesce(c.n, 0) AS chunks, coalesce(k.n, 0) AS candidates, coalesce(k.done, 0) AS extracted FROM sources s JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = id LEFT JOIN (SELECT source, count(*) AS n FROM chunks GROUP BY source) c ON c.source = id LEFT JOIN per k ON k.source = id",
)
_q("pending_candidates", _FUNNEL, select="SELECT chunk_id, source FROM cand WHERE chunk_id NOT IN (SELECT chunk_id FROM prop WHERE error IS NULL AND right(chunk_id, 1) <> '1')")
_q("import_extractions", _FUNNEL, select="SELECT chunk_id, CASE WHEN type = 'unknown-type' THEN 'bad-schema' WHEN NOT (x <> '' AND contains(t, x)) THEN 'not-literal' ELSE 'accepted' END AS status FROM lit UNION ALL SELECT 'gone-' || chunk_id, 'unknown-candidate' FROM lit WHERE idx % 5 = 0")
_q("extraction_stats", _FUNNEL, select="SELECT source, count(*) AS rows, count(error) AS failed, count(*) FILTER (error IS NULL) AS relations, count(*) FILTER (error IS NULL AND statement) AS statements FROM prop GROUP BY source")
_q("upsert_extractions", _FUNNEL, select="SELECT chunk_id, type, 'old' AS version FROM prop WHERE idx % 2 = 0 AND idx % 3 <> 0 UNION ALL SELECT chunk_id, type, 'new' FROM prop WHERE idx % 3 = 0")
_q("restore_extractions", _FUNNEL, select="SELECT coalesce(s.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NULL THEN 'added' WHEN n.error IS NOT NULL THEN 'replaced' ELSE 'kept' END AS status FROM (SELECT chunk_id FROM prop WHERE error IS NULL) s FULL JOIN (SELECT chunk_id, error FROM prop WHERE idx % 2 = 0) n ON n.chunk_id = s.chunk_id")
_q("unlinked_mentions", _FUNNEL, select=f"SELECT name, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM all_names WHERE contains(name, ' ') AND name NOT IN (SELECT {_norm('name')} FROM told) GROUP BY name ORDER BY n DESC, name LIMIT 100")
_KEYED = "CASE WHEN {0}type NOT IN ('mestre-aprendiz','estudo','dissidencia') THEN least({0}src, {0}dst) || '-' || greatest({0}src, {0}dst) ELSE {0}src || '-' || {0}dst END || '-' || {0}type"
_FIRST = f"firsts AS (SELECT {_KEYED.format('')} AS k, min(id) AS relation, arg_min(sources, id) AS sources FROM rels GROUP BY 1)"
_q("find_duplicates", _rels(), _FIRST, _FUNNEL, select=f"SELECT chunk_id, relation, CASE WHEN relation IS NOT NULL THEN list_contains(sources, source_id) END AS same_source, coalesce((SELECT string_agg(id, ',' ORDER BY r.type, id) FROM rels r WHERE least(r.src, r.dst) = least(p.src, p.dst) AND greatest(r.src, r.dst) = greatest(p.src, p.dst) AND r.type <> p.type), '') AS other_links FROM prop p LEFT JOIN firsts ON k = {_KEYED.format('p.')} WHERE src <> dst")
_QUEUE = f"queue AS (SELECT chunk_id || '-r1' AS item, 'relation' AS category, relation, array_to_string(list_filter([CASE WHEN src = dst THEN 'same-person' END, CASE WHEN relation IS NOT NULL THEN 'duplicate' END, CASE WHEN NOT (x <> '' AND contains(t, x)) THEN 'not-literal' END, CASE WHEN type = 'unknown-type' THEN 'bad-type' END], lambda a: a IS NOT NULL), ',') AS alerts, doc_id FROM lit p LEFT JOIN firsts ON k = {_KEYED.format('p.')} WHERE error IS NULL UNION ALL SELECT chunk_id || '-d1', 'statement', NULL, 'statement', doc_id FROM prop WHERE error IS NULL AND statement)"
_q("build_queue", _rels(), _FIRST, _FUNNEL, _QUEUE, select="SELECT item, category, relation, alerts, doc_id FROM queue")
_q("queue_stats", _rels(), _FIRST, _FUNNEL, _QUEUE, select="SELECT category, count(*) AS items, count(relation) AS duplicates, count(*) FILTER (alerts = '') AS clean FROM queue GROUP BY category")
_q("extraction_recall", _rels(), _FUNNEL, "gold AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, type FROM rels WHERE confidence = 'documentado'), said AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, type FROM prop WHERE error IS NULL AND src <> dst)", "o AS (SELECT (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM gold JOIN said USING (a, b, type)) AS found, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM said) s WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.a = s.a AND g.b = s.b)) AS false_pairs), c AS (SELECT count(*) AS pairs FROM (SELECT DISTINCT a, b FROM said))", select="SELECT *, found * 10 >= gold * 8 AS recall_met, false_pairs * 10 <= pairs * 2 AS false_met FROM o, c")
_q(
    "prefilter_recall", _FUNNEL, "gold(a, b, type) AS (VALUES (1::BIGINT, 4::BIGINT, 'trabalho'), (2, 4, 'estudo'), (3, 4, 'societario'), (1, 2, 'heranca'), (5, 6, 'estudo'))",
    "pos AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM chunks), has AS (SELECT DISTINCT k.chunk_id, pos.doc_id, p, person FROM known k JOIN pos ON pos.chunk_id = k.chunk_id)",
    "own AS (SELECT DISTINCT a, b, h.chunk_id, h.doc_id, h.p FROM gold JOIN has h ON person IN (a, b))",
    "loc AS (SELECT DISTINCT o.a, o.b, o.chunk_id FROM own o JOIN has va ON va.doc_id = o.doc_id AND abs(va.p - o.p) <= 1 AND va.person = o.a WHERE EXISTS (SELECT 1 FROM has x WHERE x.doc_id = o.doc_id AND x.p IN (va.p, o.p) AND x.person = o.b))",
    select="SELECT a, b, (SELECT count(*) FROM loc l WHERE l.a = g.a AND l.b = g.b) AS localisable, (SELECT count(*) FROM loc l WHERE l.a = g.a AND l.b = g.b AND l.chunk_id IN (SELECT chunk_id FROM cand)) AS recovered FROM gold g",
)

_GD = (_rels("dense"), _edges())
# every round relaxes all edges once; no shortest path in this graph has more edges than there are rounds
_LENGTHS = (
    "unit AS (SELECT list_reduce(list(DISTINCT weight20::HUGEINT), lambda x, y: x * y // gcd(x, y)) AS u FROM edges), lens AS (SELECT a AS node, b AS other, weight20 FROM edges UNION ALL SELECT b, a, weight20 FROM edges)",
    "len AS (SELECT node, other, CASE WHEN u < 1099511627776 THEN (u // weight20)::BIGINT ELSE round(1099511627776.0::DOUBLE / weight20)::BIGINT END AS length FROM lens, unit), scale AS (SELECT CASE WHEN u < 1099511627776 THEN u::DOUBLE ELSE 1099511627776.0::DOUBLE END / 20.0::DOUBLE AS one FROM unit)",
    "relax(k, s, v, d) AS (SELECT DISTINCT 0, node, node, 0::BIGINT FROM len UNION ALL SELECT k + 1, s, v, min(d) FROM (SELECT k, s, v, d FROM relax UNION ALL SELECT r.k, r.s, l.other, r.d + l.length FROM relax r JOIN len l ON l.node = r.v) GROUP BY k, s, v HAVING k < 24)",
    "dist AS (SELECT s, v, d FROM relax WHERE k = 24)",
)
_q(
    "closeness", _PERSONS, *_GD, *_LENGTHS, "far AS (SELECT s, (count(*) - 1)::DOUBLE AS r, sum(d)::DOUBLE / (SELECT one FROM scale) AS total FROM dist GROUP BY s)",
    select="SELECT s AS node, CASE WHEN total > 0 AND (SELECT count(*) FROM persons) > 1 THEN r / total * r / ((SELECT count(*) FROM persons) - 1)::DOUBLE ELSE 0.0::DOUBLE END AS closeness FROM far", recursive=True,
)
_q(
    "betweenness", _PERSONS, *_GD, *_LENGTHS,
    "dag AS (SELECT x.s, l.node, l.other FROM dist x JOIN len l ON l.node = x.v JOIN dist y ON y.s = x.s AND y.v = l.other WHERE abs(x.d + l.length - y.d) <= (SELECT CASE WHEN u < 1099511627776 THEN 0 ELSE 1024 END FROM unit))",
    "walks(k, s, v, c) AS (SELECT DISTINCT 0, s, s, 1.0::DOUBLE FROM dist UNION ALL SELECT w.k + 1, w.s, g.other, sum(w.c) FROM walks w JOIN dag g ON g.s = w.s AND g.node = w.v GROUP BY w.k, w.s, g.other)",
    "sigma AS (SELECT w.s, w.v, sum(c) AS c, any_value(d) AS d FROM walks w JOIN dist USING (s, v) GROUP BY w.s, w.v)",
    "mid AS (SELECT x.v AS node, sum(x.c * y.c / z.c) AS b FROM sigma z JOIN sigma x ON x.s = z.s JOIN sigma y ON y.s = x.v AND y.v = z.v WHERE z.s < z.v AND x.v <> z.s AND x.v <> z.v AND abs(x.d + y.d - z.d) <= (SELECT CASE WHEN u < 1099511627776 THEN 0 ELSE 1024 END FROM unit) GROUP BY x.v)",
    select="SELECT n.node, round(coalesce(b, 0.0::DOUBLE) * 2 * CASE WHEN (SELECT count(*) FROM persons) > 2 THEN 1.0::DOUBLE / (((SELECT count(*) FROM persons) - 1) * ((SELECT count(*) FROM persons) - 2)) ELSE 0.0::DOUBLE END, 9) AS betweenness FROM (SELECT DISTINCT node FROM len) n LEFT JOIN mid ON mid.node = n.node", recursive=True,
)
