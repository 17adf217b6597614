"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations


def top_k(modulo: int, k: int) -> str:
    return f"""
WITH sound AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM sound
  WHERE len(embedding) = (SELECT len(embedding) FROM sound GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)),
asked AS (SELECT vec_id, MIN(v) AS v FROM usable WHERE vec_id % {modulo} = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM asked q JOIN usable c ON c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) r WHERE rank <= {k}"""


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"COALESCE(translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{upper}', '{lower}'), '')"


def _path(url: str) -> str:
    return f"COALESCE(regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _usual(url: str) -> str:
    """The address that a URL's usual forms share; NULL without a host."""
    asked = f"regexp_extract({_rest(url)}, '^[^?#]*[?]([^#]*)', 1)"
    tracking = "(?i)^(utm_[^=]*|ref|gclid|fbclid|msclkid|mc_[ce]id)(=|$)"
    kept = f"list_sort(list_filter(string_split({asked}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{tracking}')))"
    host = rf"regexp_replace({_host(url)}, '^(www|m)\.([^.]+\.)', '\2')"
    path = rf"regexp_replace({_path(url)}, '(/index)?\.html?$|/+$', '')"
    query = f"CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END"
    return f"CASE WHEN {_host(url)} <> '' THEN concat({host}, {path}, {query}) END"


def _links(tag: str, is_it: str, attribute: str, before: str = "") -> str:
    tags = rf"regexp_extract_all(html, '(?is)<{tag}\b[^>]*>')"
    chosen = f"list_filter({tags}, lambda t: regexp_matches(t, '(?is){is_it}'))"
    return rf"""list_filter(list_transform({chosen}, lambda t: regexp_extract(t, '(?is)\b{attribute}\s*=\s*["'']?{before}([^"''\s>]+)', 1)), lambda x: x <> '')"""


def _resolved(link: str, url: str) -> str:
    scheme = f"regexp_extract({url}, '^([^:/?#]*)://', 1)"
    folder = f"regexp_replace({_path(url)}, '[^/]*$', '')"
    return rf"""CASE WHEN {link} = '' THEN NULL WHEN regexp_matches({link}, '^(?i)https?://') THEN {link}
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {_host(url)} = '' THEN NULL
    WHEN starts_with({link}, '//') THEN concat({scheme}, ':', {link})
    WHEN starts_with({link}, '/') THEN concat({scheme}, '://', {_host(url)}, {link})
    ELSE concat({scheme}, '://', {_host(url)}, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, {link}) END"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    plain = "regexp_replace({}, '(?s)#.*', '')"
    canonical = _links("link", r"""\brel\s*=\s*["'']?canonical\b""", "href")
    shared = _links("meta", r"""\bproperty\s*=\s*["'']?og:url\b""", "content")
    refresh = _links("meta", r"""\bhttp-equiv\s*=\s*["'']?refresh\b""", "content", r"""\s*[0-9.]+\s*[;,]\s*url\s*=\s*["'']?""")
    return f"""
WITH RECURSIVE rule AS (SELECT * FROM (VALUES {values}) v(rule_host, rule_path, rule_verdict)),
given AS (SELECT page_id, url, html, {_host("url")} AS host, {_path("url")} AS path, {plain.format("url")} AS node FROM pages),
link AS (
  SELECT url, unnest(list_concat(list_concat({canonical}, {shared}), {refresh})) AS link FROM given WHERE url IS NOT NULL AND html IS NOT NULL),
target AS (SELECT url, replace(trim(link), '&amp;', '&') AS link FROM link),
linked AS (
  SELECT {plain.format("url")} AS u, {plain.format("goal")} AS v FROM (SELECT url, {_resolved("link", "url")} AS goal FROM target) g
  WHERE goal IS NOT NULL),
address AS (SELECT u AS node FROM linked UNION SELECT v FROM linked UNION SELECT node FROM given WHERE node IS NOT NULL),
edge AS (SELECT u, v FROM linked UNION SELECT node, usual FROM (SELECT node, {_usual("node")} AS usual FROM address) a WHERE usual IS NOT NULL),
either AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v),
reach AS (SELECT u AS node, u AS label FROM either UNION SELECT e.v, r.label FROM reach r JOIN either e ON e.u = r.node),
member AS (SELECT node, MIN(label) AS component FROM reach GROUP BY node),
place AS (SELECT DISTINCT {_host("node")} AS host, {_path("node")} AS path FROM member UNION SELECT host, path FROM given),
decided AS (SELECT * FROM (
  SELECT host, path, concat(rule_host, rule_path) AS rule, rule_verdict AS verdict, row_number() OVER (
    PARTITION BY host, path ORDER BY length(rule_host) + length(rule_path) DESC, rule_verdict) AS nth
  FROM place JOIN rule ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path)) d WHERE nth = 1),
carried AS (
  SELECT m.component, CASE WHEN bool_or(d.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM (SELECT component, {_host("node")} AS host, {_path("node")} AS path FROM member) m
  JOIN decided d ON d.host = m.host AND d.path = m.path GROUP BY m.component)
SELECT g.page_id, g.host, g.path, d.rule, COALESCE(d.verdict, c.verdict, 'allow') AS verdict
FROM given g LEFT JOIN decided d ON d.host = g.host AND d.path = g.path
LEFT JOIN member m ON m.node = g.node LEFT JOIN carried c ON c.component = m.component"""
