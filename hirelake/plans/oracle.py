"""DuckDB twins of the registered queries, over the same whole tables."""

from __future__ import annotations

import re

from hirelake.functions.text import (
    AMOUNT, ENTITIES, LEGAL_SUFFIXES, MILLIONS, PAY, PLAN_RULES, THOUSANDS, TITLE_ABBREVIATIONS, TRACKING, UNITS_PER_YEAR, paid_per)
from hirelake.operators.copilot import ALLOWED_MOVES, STATUSES
from hirelake.plans.roles import COMPANY_STYLE, STATUS_OF_EVENT


def _ts(c: str, micros: bool = False) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S{'.%f' if micros else ''}')"


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- scalar twins ------------------------------------------------------------------

def _url(c: str) -> str:
    bare = f"regexp_replace(lower({c}), '#.*$', '')"
    head = f"regexp_replace(regexp_replace({bare}, '\\?.*$', ''), '^(\\s|[a-z][a-z0-9+.-]*://)+', '')"
    site = f"regexp_replace({head}, '^((www|m)\\.)+([^/?#:\\s]*\\.)', '\\3')"
    path = f"regexp_replace({site}, '(\\s|/|\\.html?)+$', '')"
    each = f"list_transform(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: trim(p))"
    kept = f"list_sort(list_filter({each}, lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING}) *(=|$)')))"
    return f"({path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def _words(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g'))"


def _title(c: str) -> str:
    bare = f"regexp_replace({c}, '\\([^()]*\\)', ' ', 'g')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TITLE_ABBREVIATIONS.items())
    return (f"array_to_string(list_transform(string_split({_words(bare)}, ' '), "
            f"lambda w: CASE w {cases} ELSE w END), ' ')")


def _company(c: str) -> str:
    return f"regexp_replace({_words(c)}, '( ({'|'.join(LEGAL_SUFFIXES)}))+$', '')"


def _level(c: str) -> str:
    t = f"(' ' || {_title(c)} || ' ')"
    return (f"CASE WHEN regexp_matches({t}, ' (intern|trainee) ') THEN 'intern' "
            f"WHEN regexp_matches({t}, ' (junior|entry|graduate) ') THEN 'junior' "
            f"WHEN regexp_matches({t}, ' (lead|principal|staff|head|director) ') THEN 'lead' "
            f"WHEN regexp_matches({t}, ' senior ') THEN 'senior' ELSE 'mid' END")


def _comp(c: str, pick: str) -> str:
    low = t = f"lower({c})"
    for pattern, before, after in PLAN_RULES:
        group = "\\1" if re.compile(pattern).groups else ""
        t = f"regexp_replace({t}, {_str(pattern)}, '{before}{group}{after}', 'g')"
    t = f"CASE WHEN contains({low}, '401') THEN {t} ELSE {low} END"
    marked = f"regexp_extract_all({t}, {_str(PAY)})"
    pay = f"CASE WHEN len({marked}) > 0 THEN array_to_string({marked}, ' ; ') ELSE {t} END"
    units = " ".join(f"WHEN regexp_matches({t}, {_str(paid_per(u))}) THEN {n}.0" for u, n in UNITS_PER_YEAR.items())
    whole = "replace(regexp_replace(x, '[.,]([0-9]{3})\\b', '\\1', 'g'), ',', '.')"
    value = f"TRY_CAST(regexp_replace({whole}, '[^0-9.]', '', 'g') AS DOUBLE)"
    amounts = (f"list_transform(regexp_extract_all({pay}, {_str(AMOUNT)}), lambda x: CASE "
               f"WHEN {value} >= 1000 THEN {value} WHEN contains(x, 'm') THEN {value} * 1000000.0 "
               f"WHEN regexp_matches({pay}, {_str(THOUSANDS)}) THEN {value} * 1000.0 "
               f"WHEN regexp_matches({pay}, {_str(MILLIONS)}) THEN {value} * 1000000.0 ELSE {value} END)")
    return f"({pick}({amounts}) * (CASE {units} ELSE 1.0 END::DOUBLE))"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def _grams(words: str) -> str:
    """Words, pairs and triples of words of a list."""
    joined = lambda n: " || ' ' || ".join(f"{words}[i + {k}]" for k in range(n))
    longer = [f"list_transform(range(1, len({words}) - {n} + 2), lambda i: {joined(n)})" for n in (2, 3)]
    return f"list_concat(list_concat({words}, {longer[0]}), {longer[1]})"


def _decode(c: str) -> str:
    for entity, plain in ENTITIES.items():
        c = f"replace({c}, {_str(entity)}, {_str(plain)})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _plain(c: str) -> str:
    for block in (r"(?is)<script[^>]*>.*?</script *>", r"(?is)<style[^>]*>.*?</style *>",
                  r"(?s)<!--.*?-->", r"<[^>]+>"):
        c = f"regexp_replace({c}, {_str(block)}, ' ', 'g')"
    return _decode(c)


_DIM = 256


def _fit(view: str, text: str, name: str = "fit") -> str:
    """Slot weights of a view's texts, and the name of the model they make."""
    return f"""{name}_w AS (SELECT rid, ('0x' || substr(md5(term), 1, 8))::BIGINT % {_DIM} AS slot FROM
    (SELECT rid, unnest({_tokens('t')}) AS term FROM (SELECT row_number() OVER () AS rid, {text} AS t FROM {view}))),
  {name}_n AS (SELECT count(*) AS n FROM {view}),
  {name} AS (SELECT r.slot, coalesce(c, 0) AS uses, ln((n + 1.0::DOUBLE) / (coalesce(c, 0) + 1.0::DOUBLE)) AS weight
    FROM (SELECT unnest(range({_DIM})) AS slot) r CROSS JOIN {name}_n LEFT JOIN
    (SELECT slot, count(DISTINCT rid) AS c FROM {name}_w GROUP BY 1) u ON u.slot = r.slot),
  {name}_id AS (SELECT 'idf-{_DIM}-' || substr(md5(any_value(n) || ':' || string_agg(uses, ',' ORDER BY slot)), 1, 12) AS model_id
    FROM {name}, {name}_n)"""


def _vectors(view: str, row_id: str, text: str, name: str, fit: str = "fit") -> str:
    """Unit vectors of a view's texts as lists of single-precision numbers."""
    return f"""{name}_s AS (SELECT id, slot, count(*) AS tf FROM (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {_DIM} AS slot
    FROM (SELECT {row_id} AS id, unnest({_tokens(text)}) AS term FROM {view})) GROUP BY 1, 2),
  {name}_x AS (SELECT id, slot, tf * weight AS x FROM {name}_s JOIN {fit} USING (slot)),
  {name}_u AS (SELECT id, slot, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM {name}_x),
  {name}_l AS (SELECT id, map_from_entries(list((slot, x))) AS m FROM {name}_u GROUP BY 1),
  {name} AS (SELECT {row_id} AS id, list_transform(range({_DIM}), lambda i: coalesce(m[i], 0.0::DOUBLE)) AS v
    FROM {view} LEFT JOIN {name}_l ON id = {row_id})"""


def _similar(name: str, threshold: float, block: str | None, tier: str) -> str:
    """Rows of some vectors linked to the earliest similar one of their block."""
    same = "true" if block is None else f"a.{block} = b.{block}"
    return f"""SELECT posting_id, min(dup_of) AS dup_of, arg_min(score, dup_of) AS score, '{tier}' AS tier FROM
    (SELECT a.id AS posting_id, b.id AS dup_of, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM {name} a JOIN {name} b
      ON b.id < a.id AND {same} WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0) WHERE score >= {threshold} GROUP BY 1"""


# ---- role views ----------------------------------------------------------------------

JP = """jp AS (SELECT p_partkey, CASE WHEN p_size <= 12 THEN 'Jr. ' WHEN p_size <= 25 THEN ''
  WHEN p_size <= 38 THEN 'Sr. ' ELSE 'Lead ' END || p_name AS title,
  CASE WHEN p_size <= 12 THEN 'junior' WHEN p_size <= 25 THEN 'mid' WHEN p_size <= 38 THEN 'senior' ELSE 'lead' END
  AS seniority, p_brand AS company, p_type AS role, string_split(p_name, ' ') AS skills FROM part)"""
PL = """pl AS (SELECT s_suppkey, n_name AS location, r_name AS region, r_regionkey FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
OBS = """obs AS (SELECT l_partkey || '-' || l_suppkey AS posting_id, CAST(l_suppkey AS VARCHAR) AS source,
  l_shipdate AS seen_at, l_extendedprice AS comp FROM lineitem)"""
POST = f"""{JP}, {PL}, post AS (SELECT l_partkey || '-' || l_suppkey AS posting_id,
  CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS external_id, title, company, role, seniority,
  location, region, r_regionkey, skills, first_seen, last_seen, n_seen, comp_min, comp_max
  FROM (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS n_seen,
    min(l_extendedprice) AS comp_min, max(l_extendedprice) AS comp_max FROM lineitem GROUP BY 1, 2)
  JOIN jp ON l_partkey = p_partkey JOIN pl ON l_suppkey = s_suppkey)"""
_STYLE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in COMPANY_STYLE.items())
RAW = f"""{POST}, raw AS (SELECT source, external_id,
  'https://www.Board' || source || '.example.com/jobs/' || external_id || '/?utm_source=feed' AS url,
  CASE WHEN r_regionkey = 4 THEN upper(title) ELSE title END AS position,
  company || CASE r_regionkey {_STYLE} ELSE '' END AS employer, '  ' || location AS place,
  '$' || CAST(floor(comp_min / 1000) AS BIGINT) || 'k - $' || CAST(floor(comp_max / 1000) AS BIGINT) || 'k' AS salary,
  'We need: ' || array_to_string(skills, ', ') AS body, date_trunc('month', last_seen) AS fetched_at FROM post)"""
NORM = f"""{RAW}, norm AS (SELECT sha256(source || chr(31) || external_id) AS posting_id, source, external_id,
  {_url('url')} AS canonical_url, trim(position) AS title, {_title('position')} AS title_norm,
  trim(employer) AS company, {_company('employer')} AS company_norm, lower(trim(place)) AS location,
  {_level('position')} AS seniority, {_comp('salary', 'list_min')} AS comp_min,
  {_comp('salary', 'list_max')} AS comp_max, body AS description, fetched_at FROM raw)"""
OJ = f"""{JP}, {PL}, oj AS (SELECT l_partkey || '-' || l_suppkey AS posting_id, role, location, region, skills,
  l_shipdate AS seen_at, l_extendedprice AS comp FROM lineitem JOIN jp ON l_partkey = p_partkey
  JOIN pl ON l_suppkey = s_suppkey)"""
SEEN = f"""{OBS}, seen AS (SELECT posting_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
  count(*) AS n_seen FROM obs GROUP BY 1), now AS (SELECT max(seen_at) AS as_of FROM obs)"""
TERMS = """terms AS (SELECT o_custkey AS profile_id, skill, count(*) AS mentions FROM (
  SELECT o_custkey, unnest(string_split(p_name, ' ')) AS skill FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF_EVENT.items())
APPS = f"""apps AS (SELECT user_id AS profile_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS job_id,
  CASE event_type {_CASES} END AS status, ts AS at_, event_id FROM events)"""
LATEST = f"""{APPS}, latest AS (SELECT profile_id, job_id, status, at_ AS since FROM apps
  QUALIFY row_number() OVER (PARTITION BY profile_id, job_id ORDER BY at_ DESC, event_id DESC) = 1)"""
OPS = """ops AS (SELECT event_id, ts, event_type AS source, value AS latency,
  CAST(json_extract(props, '$.k') AS BIGINT) < 70 AS hit,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS delta FROM events)"""
VEC = f"""{TERMS}, vp AS (SELECT vec_id AS profile_id, CAST(embedding AS DOUBLE[]) AS v, label AS home,
  900.0::DOUBLE + greatest(c_acctbal, 0.0::DOUBLE) / 100.0::DOUBLE AS comp_floor,
  coalesce(ps, CAST([] AS VARCHAR[])) AS profile_skills FROM embeddings
  LEFT JOIN customer ON vec_id = c_custkey
  LEFT JOIN (SELECT profile_id, list(skill ORDER BY skill) AS ps FROM terms WHERE mentions >= 3 GROUP BY 1) t
  ON vec_id = t.profile_id),
  vj AS (SELECT vec_id AS job_id, CAST(embedding AS DOUBLE[]) AS v, label AS place, p_retailprice AS comp,
  coalesce(string_split(p_name, ' '), CAST([] AS VARCHAR[])) AS job_skills FROM embeddings
  LEFT JOIN part ON vec_id = p_partkey)"""


def _best(k: int, where: str) -> str:
    return f"""{VEC}, best AS (SELECT profile_id, job_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, job_id) AS rank FROM (
  SELECT profile_id, job_id, round(list_cosine_similarity(vp.v, vj.v), 6) AS score FROM vp, vj WHERE {where}))
  WHERE rank <= {k})"""


_WISH = ("profile_id <> job_id AND place = home AND (comp_floor IS NULL OR comp >= comp_floor)")
BEST10 = _best(10, "profile_id <> job_id")
BEST5 = _best(5, _WISH)
EXPLAINED = f"""{BEST5}, ex AS (SELECT profile_id, job_id, score, rank,
  list_sort(list_distinct(list_intersect(job_skills, profile_skills))) AS overlap,
  len(list_distinct(job_skills)) AS n_required FROM best JOIN vp USING (profile_id) JOIN vj USING (job_id))"""


def _edges(view: str, keys: list[str], tier: str, where: str = "true") -> str:
    """Rows of a view linked to the smallest id with the same keys, none of them null or empty."""
    present = " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)
    return (f"SELECT posting_id, dup_of, '{tier}' AS tier FROM (SELECT posting_id, min(posting_id) OVER "
            f"(PARTITION BY {', '.join(keys)}) AS dup_of FROM {view} WHERE {present} AND {where}) "
            f"WHERE posting_id <> dup_of")


_NAMED = "title_norm <> '' AND company_norm <> ''"


def _cascade(base: str, view: str) -> str:
    return f"""{base}, t1 AS ({_edges(view, ['external_id'], 'exact')}),
  surv AS (SELECT * FROM {view} WHERE posting_id NOT IN (SELECT posting_id FROM t1)),
  t2 AS ({_edges('surv', ['title_norm', 'company_norm'], 'title_company', _NAMED)})"""


def _third(view: str) -> str:
    return f"""{_fit(view, 'title_norm')}, surv2 AS (SELECT * FROM surv WHERE {_NAMED}
    AND posting_id NOT IN (SELECT posting_id FROM t2)),
  {_vectors('surv2', 'posting_id', 'title_norm', 'tv')}, tvb AS (SELECT tv.*, company_norm FROM tv JOIN surv2 ON posting_id = id),
  t3 AS (SELECT posting_id, dup_of, tier FROM ({_similar('tvb', 0.85, 'company_norm', 'semantic')}))"""


CLEAN = f"""{POST}, clean AS (SELECT *, {_title('title')} AS title_norm, {_company('company')} AS company_norm FROM post)"""
JOBS = f"""{_cascade(CLEAN, 'clean')}, members AS (SELECT c.*, coalesce(t2.dup_of, t1.dup_of, c.posting_id) AS job_id
  FROM clean c LEFT JOIN t1 ON c.posting_id = t1.posting_id
  LEFT JOIN t2 ON coalesce(t1.dup_of, c.posting_id) = t2.posting_id),
  jobs AS (SELECT job_id, arg_min(title, posting_id) AS title, arg_min(company, posting_id) AS company,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen, min(comp_min) AS comp_min, max(comp_max) AS comp_max,
  count(*) AS n_postings, count(DISTINCT source) AS n_sources FROM members GROUP BY 1)"""
DOCTERMS = f"""words AS (SELECT doc_id AS posting_id, {_tokens('text')} AS w FROM documents),
  tc AS (SELECT posting_id, term, count(*) AS tf FROM (SELECT posting_id, unnest(w) AS term FROM words) GROUP BY 1, 2)"""
REQ = f"""{POST}, tot AS (SELECT role, count(DISTINCT posting_id) AS n_jobs FROM post GROUP BY 1),
  req AS (SELECT role, skill, n_asking, n_jobs, n_asking / n_jobs AS share FROM (SELECT role, skill,
  count(DISTINCT posting_id) AS n_asking FROM (SELECT role, posting_id, unnest(skills) AS skill FROM post)
  GROUP BY 1, 2) JOIN tot USING (role))"""


def _pct(c: str, probs: dict[str, float], places: int = 4) -> str:
    return ", ".join(f"round(quantile_cont({c}, {p}), {places}) AS {n}" for n, p in probs.items())


_Q = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
_LETTER = "'Dear hiring team,' || chr(10) || chr(10) || {} || chr(10) || chr(10) || 'Kind regards'"
_RAWVIEW = f"WITH {RAW} SELECT source, external_id, url, {_ts('fetched_at')} AS fetched_at, employer FROM raw"
# The components that are not zero, to four places.
_SHOWN = ("array_to_string(list_filter(list_transform(range(256), lambda i: CASE WHEN v[i + 1] <> 0 THEN i || ':' || "
          "CAST(round(v[i + 1] * 10000) AS BIGINT) END), lambda x: x IS NOT NULL), ',')")
_DOW = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED_MOVES)
_NEXT = ("lead(at_) OVER (PARTITION BY profile_id, job_id ORDER BY at_, event_id)")

SQL: dict[str, str] = {
    "source_batch": _RAWVIEW,
    "source_paced": _RAWVIEW,
    "source_paged": _RAWVIEW,
    "source_filtered": _RAWVIEW + " WHERE source IN ('1', '3', '5') AND raw.fetched_at >= TIMESTAMP '1998-01-01'",
    "source_incremental": _RAWVIEW,
    "union_sources": """SELECT source, CAST(doc_id AS VARCHAR) AS external_id, lang, CAST(NULL AS VARCHAR) AS url
      FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), NULL, url FROM pages""",
    "map_payload": f"""WITH {RAW} SELECT source, external_id, position AS title, employer AS company,
      place AS location, salary AS comp, body AS description FROM raw""",
    "map_event_payload": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      CAST(NULL AS VARCHAR) AS missing FROM events""",
    "raw_store": f"""WITH {RAW} SELECT CAST(CAST(fetched_at AS DATE) AS VARCHAR) AS fetch_date, count(*) AS n,
      count(DISTINCT source) AS n_sources FROM raw GROUP BY 1""",
    "normalized_store": f"""WITH {NORM} SELECT posting_id, title_norm,
      CAST(CAST(fetched_at AS DATE) AS VARCHAR) AS fetch_date FROM norm""",
    "embedding_store": """SELECT vec_id AS posting_id, 'model-' || label AS model_id,
      CAST(len(embedding) AS INTEGER) AS dim FROM embeddings""",
    "profile_files": "SELECT rtrim(text, ' ') AS text FROM benchmark",
    "html_pages": f"""SELECT page_id, {_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      {_plain('html')} AS body FROM pages""",
    "normalized": f"WITH {NORM} SELECT * REPLACE ({_ts('fetched_at')} AS fetched_at) FROM norm",
    "canonical_url": f"SELECT page_id, {_url('url')} AS canonical_url FROM pages",
    "posting_key": "SELECT doc_id, sha256(source || chr(31) || CAST(doc_id AS VARCHAR)) AS posting_id FROM documents",
    "norm_title": f"WITH {JP} SELECT p_partkey, {_title('title')} AS title_norm FROM jp",
    "norm_company": f"""WITH {RAW} SELECT source, external_id, {_company('employer')} AS company_norm FROM raw""",
    "parse_comp": f"""WITH c AS (SELECT c_custkey, CAST(round(c_acctbal + 1000) AS BIGINT) AS low, c_nationkey % 4 AS s
      FROM customer), r AS (SELECT c_custkey, CASE s WHEN 0 THEN '$' || low || 'k–' || (low + 5) || 'k'
      WHEN 1 THEN 'from ' || format('{{:,}}', low) || ' a year' WHEN 2 THEN low || '.50 / hr' ELSE 'competitive' END
      AS t FROM c) SELECT c_custkey, {_comp('t', 'list_min')} AS comp_min, {_comp('t', 'list_max')} AS comp_max FROM r""",
    "norm_location": """SELECT c_custkey, r_name || '/' || n_name AS location_norm FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "seniority": f"WITH {JP} SELECT p_partkey, {_level('title')} AS level FROM jp",
    "extract_skills": f"""WITH b AS (SELECT {_tokens('text')} AS w FROM benchmark),
      g AS (SELECT unnest({_grams('w')}) AS alias FROM b),
      dict AS (SELECT DISTINCT replace(alias, ' ', '-') AS skill, alias FROM g),
      d AS (SELECT doc_id AS posting_id, {_tokens('text')} AS w FROM documents),
      grams AS (SELECT posting_id, unnest(list_distinct({_grams('w')})) AS gram FROM d)
      SELECT posting_id, string_agg(skill, ',' ORDER BY skill) AS skills FROM (SELECT DISTINCT posting_id, skill
        FROM grams JOIN dict ON gram = alias) GROUP BY 1""",
    "keywords": f"""WITH {DOCTERMS}, n AS (SELECT count(*) AS n FROM documents),
      s AS (SELECT term, count(*) AS df FROM tc GROUP BY 1)
      SELECT posting_id, term, tf, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
        (PARTITION BY posting_id ORDER BY weight DESC, term) AS rank FROM (SELECT posting_id, term, tf,
        round(tf * ln((1.0::DOUBLE + n) / (df + 1.0::DOUBLE)), 6) AS weight FROM tc JOIN s USING (term), n))
      WHERE rank <= 5""",
    "filtered": f"""WITH {POST} SELECT posting_id, location, seniority, comp_max FROM post WHERE location IN
      ('NATION_3', 'NATION_7') AND comp_max >= 50000 AND seniority IN ('senior', 'lead')""",
    "job_detail": f"""WITH {JOBS}, pick AS (SELECT * FROM jobs ORDER BY n_postings DESC, job_id LIMIT 1)
      SELECT p.job_id, p.title AS job_title, p.n_postings, m.posting_id, m.source FROM pick p
      JOIN members m USING (job_id)""",
    "dedupe_external_id": f"WITH {NORM} {_edges('norm', ['external_id'], 'exact')}",
    "dedupe_url": f"""WITH p AS (SELECT page_id AS posting_id, {_url('url')} AS canonical_url FROM pages)
      {_edges('p', ['canonical_url'], 'exact')}""",
    "dedupe_title_company": f"WITH {NORM} {_edges('norm', ['title_norm', 'company_norm'], 'title_company', _NAMED)}",
    "dedupe_cascade": f"""WITH {_cascade(NORM, 'norm')}, {_third('norm')} SELECT * FROM t1 UNION ALL SELECT * FROM t2
      UNION ALL SELECT * FROM t3""",
    "dedupe_similar": f"""WITH {JP}, titles AS (SELECT p_partkey, {_title('title')} AS title_norm, company FROM jp),
      {_fit('titles', 'title_norm')}, {_vectors('titles', 'p_partkey', 'title_norm', 'tv')},
      tvb AS (SELECT tv.*, company FROM tv JOIN titles ON p_partkey = id) {_similar('tvb', 0.85, 'company', 'semantic')}""",
    "dedupe_semantic": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT a.vec_id AS posting_id, b.vec_id AS dup_of, round(list_cosine_similarity(a.v, b.v), 6) AS score
        FROM e a JOIN e b ON a.label = b.label AND b.vec_id < a.vec_id)
      SELECT posting_id, min(dup_of) AS dup_of, arg_min(score, dup_of) AS score, 'semantic' AS tier
      FROM p WHERE score >= 0.3 GROUP BY 1""",
    "near_dup_text": f"""WITH d AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS sh FROM d),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh
        AND b.doc_id < a.doc_id GROUP BY 1, 2),
      j AS (SELECT x, y, i / (na.n + nb.n - i) AS jac FROM c JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id)
      SELECT x AS posting_id, min(y) AS dup_of, round(arg_min(jac, y), 6) AS score, 'wording' AS tier
      FROM j WHERE jac >= 0.7::DOUBLE GROUP BY 1""",
    "resolve_clusters": """WITH RECURSIVE k AS (SELECT p_partkey AS a, min(p_partkey) OVER
        (PARTITION BY p_name, p_brand) AS b FROM part UNION SELECT p_partkey, min(p_partkey) OVER
        (PARTITION BY p_brand, p_type, p_size) FROM part),
      e AS (SELECT a, b FROM k WHERE a <> b UNION SELECT b, a FROM k WHERE a <> b),
      r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
      SELECT node, min(other) AS job_id FROM r GROUP BY 1""",
    "merged_jobs": f"""WITH {JOBS} SELECT * REPLACE ({_ts('first_seen')} AS first_seen,
      {_ts('last_seen')} AS last_seen) FROM jobs""",
    "job_provenance": f"""WITH {JOBS} SELECT job_id, source, {_ts('min(first_seen)')} AS first_seen,
      {_ts('max(last_seen)')} AS last_seen, count(*) AS n_postings FROM members GROUP BY 1, 2""",
    "added_last_day": f"""WITH {SEEN} SELECT posting_id, {_ts('first_seen')} AS first_seen FROM seen, now
      WHERE first_seen > as_of - INTERVAL 24 HOUR""",
    "stale_postings": f"""WITH {SEEN} SELECT posting_id, {_ts('last_seen')} AS last_seen FROM seen, now
      WHERE last_seen < as_of - INTERVAL 365 DAY""",
    "current_openings": f"""WITH {SEEN} SELECT posting_id, {_ts('last_seen')} AS last_seen FROM seen, now
      WHERE last_seen >= as_of - INTERVAL 90 DAY""",
    "jobs_added_last_day": f"""WITH {JOBS}, now AS (SELECT max(first_seen) AS as_of FROM jobs)
      SELECT job_id, {_ts('first_seen')} AS first_seen, n_postings FROM jobs, now
      WHERE first_seen > as_of - INTERVAL 24 HOUR""",
    "job_openings": f"""WITH {JOBS}, now AS (SELECT max(l_shipdate) AS as_of FROM lineitem)
      SELECT job_id, {_ts('last_seen')} AS last_seen, n_postings FROM jobs, now
      WHERE last_seen >= as_of - INTERVAL 90 DAY""",
    "openings_at": f"""WITH {POST}, w AS (SELECT p_partkey AS wanted_id, string_split(p_name, ' ')[1:2] AS wished,
      DATE '1992-01-01' + CAST(p_partkey % 2500 AS INTEGER) AS day FROM part),
      s AS (SELECT DISTINCT posting_id, unnest(skills) AS skill, skills, CAST(first_seen AS DATE) AS a, CAST(last_seen AS DATE) AS b FROM post)
      SELECT wanted_id, count(*) AS n_open, min(posting_id) AS posting_id FROM w JOIN s ON skill = wished[1]
      AND day BETWEEN a AND b AND list_has_all(skills, wished) GROUP BY 1""",
    "openings_by_day": f"""WITH {POST}, span AS (SELECT role, min(CAST(first_seen AS DATE)) AS a,
        max(CAST(last_seen AS DATE)) AS z FROM post GROUP BY 1),
      days AS (SELECT role, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY))
        AS DATE) AS day FROM span),
      ch AS (SELECT role, day, sum(s) AS s FROM (SELECT role, CAST(first_seen AS DATE) AS day, 1 AS s FROM post
        UNION ALL SELECT role, CAST(last_seen AS DATE) + 1, -1 FROM post) GROUP BY 1, 2)
      SELECT role, CAST(day AS VARCHAR) AS day, CAST(sum(coalesce(s, 0)) OVER (PARTITION BY role ORDER BY day) AS BIGINT)
        AS open_postings FROM days LEFT JOIN ch USING (role, day)""",
    "replayed": f"SELECT event_id, event_type, {_ts('ts', True)} AS ts FROM events",
    "embedded": f"""WITH {_fit('documents', 'text')}, {_vectors('documents', 'doc_id', 'text', 'dv')}
      SELECT id AS posting_id, model_id, sha256(coalesce(text, '')) AS text_hash, {_SHOWN} AS vector
      FROM dv JOIN documents ON doc_id = id, fit_id""",
    "same_model": f"WITH {_fit('documents', 'text')} SELECT doc_id AS posting_id, model_id FROM documents, fit_id",
    "pending_embeddings": """SELECT doc_id AS posting_id, sha256(text) AS text_hash FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "embedded_profiles": f"""WITH {_fit('documents', 'text')}, {_vectors('benchmark', 'item_id', 'text', 'bv')}
      SELECT id AS profile_id, model_id, {_SHOWN} AS vector FROM bv, fit_id""",
    "search_text": f"""WITH {_fit('documents', 'text')}, {_vectors('documents', 'doc_id', 'text', 'dv')},
      {_vectors('benchmark', 'item_id', 'text', 'bv')},
      s AS (SELECT bv.id AS profile_id, dv.id AS job_id,
        CASE WHEN list_sum(bv.v) > 0 AND list_sum(dv.v) > 0 THEN round(list_cosine_similarity(bv.v, dv.v), 6) ELSE 0.0 END AS score
        FROM bv CROSS JOIN dv)
      SELECT profile_id, job_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, job_id)::INTEGER AS rank
      FROM s QUALIFY rank <= 3""",
    "resume_matches": f"""WITH {_fit('documents', 'text')}, {_vectors('documents', 'doc_id', 'text', 'dv')},
      {_vectors('benchmark', 'item_id', 'text', 'bv')},
      s AS (SELECT bv.id AS profile_id, dv.id AS job_id,
        CASE WHEN list_sum(bv.v) > 0 AND list_sum(dv.v) > 0 THEN round(list_cosine_similarity(bv.v, dv.v), 6) ELSE 0.0 END AS score
        FROM bv CROSS JOIN dv WHERE dv.id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
      best AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, job_id)::INTEGER AS rank
        FROM s QUALIFY rank <= 3),
      bg AS (SELECT item_id, list_distinct({_grams('w')}) AS g FROM (SELECT item_id, {_tokens('text')} AS w FROM benchmark)),
      dict AS (SELECT DISTINCT unnest(g) AS alias FROM bg),
      dg AS (SELECT doc_id, unnest(list_distinct({_grams('w')})) AS alias FROM (SELECT doc_id, {_tokens('text')} AS w
        FROM documents WHERE doc_id IN (SELECT job_id FROM best))),
      dn AS (SELECT doc_id, list(alias) AS g, count(*) AS n FROM dg JOIN dict USING (alias) GROUP BY 1),
      ex AS (SELECT profile_id, job_id, score, rank, coalesce(n, 0) AS n_required,
        list_sort(list_transform(list_intersect(bg.g, coalesce(dn.g, [])), lambda x: replace(x, ' ', '-'))) AS overlap
        FROM best JOIN bg ON item_id = profile_id LEFT JOIN dn ON doc_id = job_id)
      SELECT profile_id, job_id, score, rank, CAST(len(overlap) AS INTEGER) AS n_overlap, CAST(n_required AS INTEGER) AS n_required,
        CASE WHEN len(overlap) > 0 THEN 'Matches ' || len(overlap) || ' of ' || n_required || ' listed skills: '
          || array_to_string(overlap, ', ') || '.' ELSE 'Similar wording; no listed skill in common.' END AS explanation FROM ex""",
    "match_exact": f"WITH {BEST10} SELECT * FROM best",
    "match_filtered": f"WITH {BEST5} SELECT * FROM best",
    "match_all": f"WITH {BEST10} SELECT * FROM best",
    "match_feed": f"""WITH {_best(5, "profile_id <> job_id AND round(list_cosine_similarity(vp.v, vj.v), 6) >= 0.25")}
      SELECT * FROM best""",
    "explained": f"""WITH {EXPLAINED}, n AS (SELECT count(*) AS n FROM vj), df AS (SELECT skill, count(*) AS df FROM
      (SELECT unnest(list_distinct(job_skills)) AS skill FROM vj) GROUP BY 1),
      w AS (SELECT skill, ln((1.0::DOUBLE + n) / (df + 1.0::DOUBLE)) AS weight FROM df, n),
      s AS (SELECT profile_id, job_id, sum(weight) AS sw FROM (SELECT profile_id, job_id, unnest(overlap) AS skill
        FROM ex) JOIN w USING (skill) GROUP BY 1, 2)
      SELECT profile_id, job_id, rank, array_to_string(overlap, ',') AS overlap,
        CAST(len(overlap) AS INTEGER) AS n_overlap, CAST(n_required AS INTEGER) AS n_required,
        round(coalesce(sw, 0.0::DOUBLE), 6) AS overlap_weight FROM ex LEFT JOIN s USING (profile_id, job_id)""",
    "phrased": f"""WITH {EXPLAINED} SELECT profile_id, job_id, score, rank, CASE WHEN len(overlap) > 0 THEN
      'Matches ' || len(overlap) || ' of ' || n_required || ' listed skills: ' || array_to_string(overlap, ', ') || '.'
      ELSE 'Similar wording; no listed skill in common.' END AS explanation FROM ex""",
    "generated": f"""SELECT conv_id, turn, {_LETTER.format("('Reply to: ' || text)")} AS completion FROM conversations""",
    "letters": f"""WITH {EXPLAINED} SELECT profile_id, job_id, {_LETTER.format('''
      ('I would like to apply for position ' || job_id || '. I bring ' || CASE WHEN len(overlap) > 0 THEN
      array_to_string(overlap, ', ') ELSE 'a related background' END || '.')''')} AS letter FROM ex""",
    "role_requirements": f"WITH {REQ} SELECT * REPLACE (round(share, 6) AS share) FROM req",
    "skill_gap": f"""WITH {REQ}, {TERMS}, rc AS (SELECT o_custkey AS profile_id, p_type AS role, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      target AS (SELECT profile_id, role FROM rc QUALIFY row_number() OVER (PARTITION BY profile_id
        ORDER BY n DESC, role DESC) = 1),
      need AS (SELECT role, skill, share, CAST(row_number() OVER (PARTITION BY role ORDER BY share DESC, skill)
        AS INTEGER) AS demand_rank FROM req WHERE share >= 0.12)
      SELECT profile_id, role, skill, round(share, 6) AS share, demand_rank FROM target JOIN need USING (role)
      WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.profile_id = target.profile_id AND t.skill = need.skill
        AND t.mentions >= 3)""",
    "skill_lift": f"""WITH {DOCTERMS}, b AS (SELECT posting_id, term AS skill, quality = 1 AS good FROM tc
        JOIN labels ON posting_id = doc_id),
      t AS (SELECT count(*) AS a, count(*) FILTER (quality = 1) AS g FROM labels)
      SELECT skill, n_all, n_cohort, round((n_cohort / CAST(g AS DOUBLE)) / (n_all / CAST(a AS DOUBLE)), 6) AS lift
      FROM (SELECT skill, count(*) AS n_all, count(*) FILTER (good) AS n_cohort FROM b GROUP BY 1), t
      WHERE n_all >= 20""",
    "tailored": f"""WITH {BEST5}, w AS (SELECT DISTINCT profile_id, job_id, unnest(job_skills) AS skill FROM best
        JOIN vj USING (job_id)),
      m AS (SELECT w.profile_id, job_id, w.skill, coalesce(mentions, 0) AS c FROM w LEFT JOIN terms t
        ON w.profile_id = t.profile_id AND w.skill = t.skill)
      SELECT profile_id, job_id, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (c = 0), '') AS add,
        coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (c > 0 AND c < 3), '') AS emphasize
      FROM m GROUP BY 1, 2""",
    "current_status": f"WITH {LATEST} SELECT profile_id, job_id, status, {_ts('since', True)} AS since FROM latest",
    "status_timeline": f"""WITH {APPS} SELECT profile_id, job_id, {', '.join(
        _ts(f"min(at_) FILTER (status = '{s}')", True) + f' AS {s}' for s in STATUSES)} FROM apps GROUP BY 1, 2""",
    "bad_transitions": f"""WITH {APPS}, s AS (SELECT *, lag(status) OVER (PARTITION BY profile_id, job_id
        ORDER BY at_, event_id) AS before FROM apps)
      SELECT profile_id, job_id, event_id, before, status FROM s WHERE before IS NOT NULL
        AND (before, status) NOT IN (VALUES {_DOW})""",
    "due_reminders": f"""WITH {LATEST}, now AS (SELECT max(at_) AS as_of FROM apps) SELECT profile_id, job_id, status,
      {_ts('since', True)} AS since FROM latest, now WHERE status NOT IN ('offer', 'rejected')
      AND since <= as_of - INTERVAL 7 DAY""",
    "reminder_stream": f"""WITH {APPS}, now AS (SELECT max(at_) AS as_of FROM apps),
      s AS (SELECT *, coalesce({_NEXT}, as_of) AS until FROM apps, now)
      SELECT profile_id, job_id, status, {_ts('at_', True)} AS since FROM s
      WHERE status NOT IN ('offer', 'rejected') AND epoch_ms(until) - epoch_ms(at_) >= 7 * 86400000""",
    "pipeline_counts": f"WITH {LATEST} SELECT status, count(*) AS n FROM latest GROUP BY 1",
    "stage_durations": f"""WITH {APPS}, s AS (SELECT status, (epoch_us({_NEXT}) - epoch_us(at_)) / 1e6 AS sec FROM apps)
      SELECT status, count(*) AS n, {_pct('sec', {'p50': 0.5, 'p90': 0.9})} FROM s WHERE sec IS NOT NULL GROUP BY 1""",
    "comp_by_role": f"WITH {OJ} SELECT role, count(*) AS n, {_pct('comp', _Q)} FROM oj GROUP BY 1",
    "comp_by_role_location": f"""WITH {OJ} SELECT role, location, count(*) AS n, {_pct('comp', _Q)} FROM oj
      GROUP BY 1, 2""",
    "comp_cube": f"""WITH {OJ} SELECT role, location, CAST(grouping(role, location) AS INTEGER) AS grouping,
      count(*) AS n, {_pct('comp', _Q)} FROM oj GROUP BY GROUPING SETS ((role, location), (role), (location), ())""",
    "comp_trend": f"""WITH {OJ}, m AS (SELECT role, date_trunc('month', seen_at) AS period, count(*) AS n,
        quantile_cont(comp, 0.5) AS p50 FROM oj GROUP BY 1, 2)
      SELECT role, {_ts('period')} AS period, n, round(p50, 4) AS p50,
        CASE WHEN lag(m.period) OVER w = m.period - INTERVAL 1 MONTH THEN round(p50 - lag(p50) OVER w, 4) END AS change
      FROM m WINDOW w AS (PARTITION BY role ORDER BY m.period)""",
    "skill_demand": f"""WITH {POST} SELECT skill, count(DISTINCT posting_id) AS n_jobs FROM
      (SELECT posting_id, unnest(skills) AS skill FROM post) GROUP BY 1""",
    "skill_trend": f"""WITH {OJ}, q AS (SELECT posting_id, skills, date_trunc('quarter', seen_at) AS period FROM oj),
      t AS (SELECT period, count(DISTINCT posting_id) AS n_jobs FROM q GROUP BY 1),
      a AS (SELECT skill, period, count(DISTINCT posting_id) AS n_asking FROM (SELECT posting_id, period,
        unnest(skills) AS skill FROM q) GROUP BY 1, 2),
      f AS (SELECT skill, CAST(min(period) AS TIMESTAMP) AS since FROM a GROUP BY 1),
      z AS (SELECT CAST(max(period) AS TIMESTAMP) AS until FROM t),
      p AS (SELECT skill, unnest(generate_series(since, until, INTERVAL 3 MONTH)) AS period FROM f, z),
      s AS (SELECT p.skill, p.period, coalesce(n_asking, 0) AS n_asking, coalesce(n_jobs, 0) AS n_jobs,
        CASE WHEN n_jobs > 0 THEN coalesce(n_asking, 0) / n_jobs END AS sh
        FROM p LEFT JOIN t ON t.period = p.period LEFT JOIN a ON a.skill = p.skill AND a.period = p.period)
      SELECT skill, {_ts('period')} AS period, n_asking, n_jobs, round(sh, 6) AS share,
        round(sh - lag(sh) OVER w, 6) AS change, round(avg(sh) OVER (PARTITION BY skill ORDER BY s.period
          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS share_mean3
      FROM s WINDOW w AS (PARTITION BY skill ORDER BY s.period)""",
    "role_pay_now": f"""WITH {POST}, now AS (SELECT max(l_shipdate) AS as_of FROM lineitem) SELECT role, count(*) AS n,
      {_pct('comp_max', _Q)} FROM post, now WHERE last_seen >= as_of - INTERVAL 90 DAY AND role = 'PROMO' GROUP BY 1""",
    "top_skills": f"""WITH {POST}, c AS (SELECT role, skill, count(DISTINCT posting_id) AS n_jobs FROM (SELECT role,
        posting_id, unnest(skills) AS skill FROM post) GROUP BY 1, 2)
      SELECT role, skill, n_jobs, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY role
        ORDER BY n_jobs DESC, skill) AS rank FROM c) WHERE rank <= 5""",
    "throughput": f"""SELECT {_ts("date_trunc('hour', ts)")} AS window_start, event_type AS source, count(*) AS n
      FROM events GROUP BY 1, 2""",
    "throughput_stream": f"""SELECT {_ts("date_trunc('hour', ts)")} AS window_start, event_type AS source,
      count(*) AS n FROM events GROUP BY 1, 2""",
    "latency": f"""WITH {OPS} SELECT source, count(*) AS n, {_pct('latency', {'p50': 0.5, 'p95': 0.95, 'p99': 0.99})}
      FROM ops GROUP BY 1""",
    "hit_rate": f"""WITH {OPS} SELECT {_ts("date_trunc('day', ts)")} AS window_start, count(*) AS n,
      round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM ops GROUP BY 1""",
    "queue_depth": f"""WITH {OPS}, m AS (SELECT ts, CAST(sum(delta) AS BIGINT) AS delta FROM ops WHERE delta <> 0
      GROUP BY 1) SELECT {_ts('ts', True)} AS ts, delta, CAST(sum(delta) OVER (ORDER BY m.ts) AS BIGINT) AS depth FROM m""",
    "dedupe_stream": "SELECT DISTINCT user_id, event_type FROM events",
}
_SEEN_SQL = f"WITH {SEEN} SELECT posting_id, {_ts('first_seen')} AS first_seen, {_ts('last_seen')} AS last_seen, n_seen FROM seen"
SQL.update({name: _SEEN_SQL for name in ("seen", "seen_update", "seen_stream", "seen_bounded")})
SQL["current_embeddings"] = SQL["embedded"]
