"""SQL counterparts of the registered queries, for an independent check.

Written against the raw tables with RE2 patterns, sharing nothing with the Spark
jobs but the derived inputs they describe.
"""

import re

from . import queries as Q

# The scan patterns in their RE2 form.
LINK = r"""(?:"|')(((?:[a-zA-Z]{1,10}://|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']{0,})|((?:/|\.\./|\./)[^"'><,;| *()(%%$^/\\\[\]][^"'><,;|()]{1,})|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{1,}\.(?:[a-zA-Z]{1,4}|action)(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{3,}(?:[\?|#][^"|']{0,}|))|([a-zA-Z0-9_\-]{1,}\.(?:php|asp|aspx|jsp|json|action|html|js|txt|xml)(?:[\?|#][^"|']{0,}|)))(?:"|')"""
LABELS = r"(?i)(([a-zA-Z0-9]{1}|[_a-zA-Z0-9]{1}[_a-zA-Z0-9-]{0,61}[a-zA-Z0-9]{1})[.]{1})+"
BUCKET = r"(?i)[a-z0-9.-]+\.s3\.amazonaws\.com|[a-z0-9.-]+\.s3-[a-z0-9-]\.amazonaws\.com|[a-z0-9.-]+\.s3-website[.-](eu|ap|us|ca|sa|cn)|//s3\.amazonaws\.com/[a-z0-9._-]+|//s3-[a-z0-9-]+\.amazonaws\.com/[a-z0-9._-]+"
STATIC = r"(?i)\.(png|apng|bmp|gif|ico|cur|jpg|jpeg|jfif|pjp|pjpeg|svg|tif|tiff|webp|xbm|3gp|aac|flac|mpg|mpeg|mp3|mp4|m4a|m4v|m4p|oga|ogg|ogv|mov|wav|webm|eot|woff|woff2|ttf|otf|css)(?:\?|#|$)"
MIME = r"^[a-zA-Z][a-zA-Z0-9.+-]*/[a-zA-Z0-9.+-]+$"
DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
# Where robots and sitemap files are looked for.
SITEMAPS = [
    "/robots.txt",
    "/sitemap.xml",
    "/sitemap_news.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/sitemapindex.xml",
    "/sitemap-news.xml",
    "/post-sitemap.xml",
    "/page-sitemap.xml",
    "/portfolio-sitemap.xml",
    "/home_slider-sitemap.xml",
    "/category-sitemap.xml",
    "/author-sitemap.xml",
]


# All kinds of findings.
KINDS = "url href javascript linkfinder form upload-form subdomains aws robots sitemap other-sources network render raw".split()


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"


def _decode(text: str) -> str:
    once = (
        f"CASE WHEN contains(regexp_replace({text}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN {text} "
        f"ELSE url_decode(replace({text}, '+', ' ')) END"
    )
    return f"replace(replace({once}, '\\u002f', '/'), '\\u0026', '&')"


def _noise(token: str) -> str:
    return (
        f"(trim({token}) = '' OR regexp_matches(trim({token}), {_q(MIME)}) OR regexp_matches(trim({token}), {_q(DATE)}) "
        f"OR contains({token}, '{{{{') OR contains({token}, '}}}}') OR contains({token}, '/:'))"
    )


def _absolute(base: str, ref: str) -> str:
    return (
        f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} "
        f"WHEN {ref} LIKE '//%' THEN regexp_extract({base}, '^([a-z]+:)', 1) || {ref} "
        f"WHEN {ref} LIKE '/%' THEN regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1) || {ref} "
        f"ELSE regexp_extract({base}, '^([a-z]+://[^/?#]*(?:/(?:[^/?#]*/)*)?)', 1) || {ref} END"
    )


def _printed(url: str) -> str:
    """A URL with its path percent-encoded, or NULL when an escape in the path is bad."""
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    encoded = (
        f"array_to_string(list_transform(regexp_extract_all({path}, '[!-~]+|[^!-~]+'), "
        "lambda t: CASE WHEN regexp_matches(t, '^[!-~]') THEN t ELSE url_encode(t) END), '')"
    )
    return (
        f"CASE WHEN contains(regexp_replace({path}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN NULL ELSE "
        f"regexp_extract({url}, '^([a-z]+://[^/?#]*)', 1) || {encoded} || regexp_extract({url}, '([?#].*)$', 1) END"
    )


def _canonical(url: str) -> str:
    origin = (
        f"regexp_replace(regexp_replace(regexp_extract({url}, '^([a-z]+://[^/?#]*)', 1), '^(http://[^/]*):80$', '\\1'), "
        "'^(https://[^/]*):443$', '\\1')"
    )
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return (
        f"{origin} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1)"
    )


PAGES = f"SELECT page_id, url, html, {HOST} AS host, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS apex FROM pages"
RICH = f"""SELECT page_id, url, html || '<script src="/js/' || (page_id % 5) || '.min.js"></script><link href="/s.css">'
  || '<a href="//cdn.' || host || '/p.html">p</a>'
  || CASE WHEN page_id % 3 = 0 THEN '<form action="/f">' ELSE '' END
  || CASE WHEN page_id % 6 = 0 THEN '<input type=''file''>' ELSE '' END
  || '<i title="b' || page_id || '.s3.amazonaws.com"> api' || (page_id % 4) || '.' || host || ' </i>' AS html,
  host, apex FROM p"""
META = """SELECT page_id, url, html, host, apex,
  CAST(CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 429 ELSE 200 END AS INT) AS status,
  CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'application/json' ELSE 'text/html' END AS content_type
  FROM p"""
CANON = f"SELECT page_id, url, host, {_canonical(_printed('url'))} AS canonical FROM p"


def _host_pattern(host: str) -> str:
    return f"'^https?://' || replace({host}, '.', '\\.') || '(?::\\d+)?(?:/|$)'"


def _apex_pattern(apex: str) -> str:
    return f"'^https?://([^.]+\\.)*' || replace({apex}, '.', '\\.') || '(?::\\d+)?(?:/|$)'"


HOST_SEEDS = f"""SELECT min(page_id) AS seed_id, arg_min(url, page_id) AS seed_url, host, any_value(apex) AS apex,
  {_host_pattern('host')} AS scope FROM p GROUP BY host"""
APEX_SEEDS = f"""SELECT min(page_id) AS seed_id, 'https://' || apex AS seed_url, apex AS host, apex,
  {_apex_pattern('apex')} AS scope FROM p GROUP BY apex"""


def _links(src: str = "rich", skip: str = "FALSE") -> str:
    """Quoted and tag links of ``src`` as resolved rows, before seeds and scope."""
    body = _decode("d")
    bare = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    bare = f"regexp_replace({bare}, '(?is)(<(?:script|style|title)[^>]*>).*?</(?:script|style|title)', '\\1', 'g')"
    value = r"""trim(regexp_extract(tag, '(?i)\s(?:href|src)=("[^"]*"|''[^'']*''|[^\s>]+)', 1), '"''')"""
    return f"""
  dec AS (SELECT *, {_decode('html')} AS d FROM {src}),
  q0 AS (SELECT page_id, url, host, apex, unnest(list_distinct(list_transform(
      regexp_extract_all({body}, {_q(LINK)}, 1), lambda t: regexp_replace(trim(t), '[\\t\\r\\n]+', ' ', 'g')))) AS token
      FROM dec WHERE NOT ({skip})),
  q1 AS (SELECT *, regexp_matches(token, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS is_abs,
      {_printed(_absolute('url', 'token'))} AS link FROM q0 WHERE NOT {_noise('token')}),
  quoted AS (SELECT *, {_canonical('link')} AS canon, regexp_extract({_canonical('link')}, '^[a-z]+://[^/?#]*[^?#]*?(\\.[^./?#]*)(?:\\?.*)?$', 1) AS ext
      FROM q1 WHERE link IS NOT NULL),
  t0 AS (SELECT page_id, url, host, apex, unnest(regexp_extract_all({bare}, '(?i)<(?:a|link|form|input|script)[\\s/][^>]*>')) AS tag FROM {src}),
  t1 AS (SELECT *, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS name, {value} AS val FROM t0),
  tags AS (SELECT *, CASE WHEN name IN ('a', 'link', 'script') AND val <> '' THEN {_printed(_absolute('url', 'val'))} END AS link FROM t1),
  links AS (
    SELECT page_id, url, host, apex, 0 AS phase, link, canon, url AS source,
      CASE WHEN ext IN ('.js', '.xml', '.json', '.map') AND NOT is_abs THEN 'javascript' ELSE 'linkfinder' END AS kind,
      'linkfinder' AS type FROM quoted
    UNION ALL
    SELECT page_id, url, host, apex, 1, link, {_canonical('link')}, 'body', 'href', 'href' FROM tags
      WHERE name IN ('a', 'link') AND link IS NOT NULL AND NOT regexp_matches(link, {_q(STATIC)})
    UNION ALL
    SELECT page_id, url, host, apex, 1, link, {_canonical('link')}, 'body', 'javascript', 'javascript' FROM tags
      WHERE name = 'script' AND regexp_matches(link, '\\.(js|xml|json)$'))"""


def _findings(seeds: str = HOST_SEEDS, src: str = "rich", skip: str = "FALSE", on: str | None = None, prefix: str = "") -> str:
    """CTEs up to ``found``: every finding once per seed."""
    on = on or "x.host = s.host"
    if seeds is APEX_SEEDS:
        on = "x.apex = s.apex"
    dom = f"{_q(LABELS)} || replace(s.apex, '.', '[.]')"
    return f"""WITH p AS ({PAGES}), rich AS ({RICH}), meta AS ({META}), seeds AS ({seeds}),{_links(src, skip)},
  scoped AS (
    SELECT s.seed_id, s.seed_url AS input, x.*, regexp_matches(x.link, s.scope) AS in_scope FROM links x JOIN seeds s ON {on}
    WHERE (x.type = 'javascript' OR regexp_matches(x.link, s.scope)) AND (x.phase = 1 OR regexp_matches(x.url, s.scope))),
  pg AS (SELECT s.seed_id, s.seed_url AS input, s.apex AS sapex, s.scope, x.* FROM dec x JOIN seeds s ON {on}),
  rows0 AS (
    SELECT seed_id, input, 'url' AS kind, 'body' AS source, 'url' AS type, url AS output, 200 AS status,
      strlen(d) AS length, 'url' AS set_name,
      page_id || '' AS key, 0 AS phase, page_id, FALSE AS in_scope FROM pg WHERE NOT ({skip})
    UNION ALL
    SELECT seed_id, input, kind, CASE WHEN kind = 'javascript' AND type = 'linkfinder' THEN 'html' ELSE source END, type, canon, 0, 0,
      CASE WHEN kind = 'javascript' THEN 'js' ELSE 'link' END, lower(CASE WHEN type = 'javascript' THEN link ELSE canon END),
      phase, page_id, in_scope FROM scoped
    UNION ALL
    SELECT s.seed_id, s.seed_url, CASE WHEN name = 'form' THEN 'form' ELSE 'upload-form' END, 'body',
      CASE WHEN name = 'form' THEN 'form' ELSE 'upload-form' END, url, 0, 0, name, lower(url), 1, page_id, FALSE
      FROM tags x JOIN seeds s ON {on} WHERE (name = 'form' AND tag LIKE '% action=%') OR (name = 'input' AND regexp_matches(tag, 'type=["'']?file["''\\s>]'))
    UNION ALL
    SELECT seed_id, input, 'subdomains', 'body', 'subdomain', o, 0, 0, 'sub', lower(o), 0, page_id, FALSE FROM (
      SELECT seed_id, input, page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(m), '^(20|25|2b|2f|3d|3a|40)+', ''), '^-+', ''), '-+$', ''), '^\\.(.)', '\\1') AS o FROM (
        SELECT s.seed_id, s.input, s.page_id, unnest(regexp_extract_all(s.d, {_q(LABELS)} || replace(s.sapex, '.', '[.]'))) AS m
        FROM pg s WHERE regexp_matches(s.url, s.scope) AND NOT ({skip})))
    UNION ALL
    SELECT seed_id, input, 'aws', 'body', 'aws', {_decode('m')}, 0, 0, 'aws', lower({_decode('m')}), 0, page_id, FALSE FROM (
      SELECT seed_id, input, page_id, unnest(regexp_extract_all(d, {_q(BUCKET)})) AS m FROM pg
      WHERE regexp_matches(url, scope) AND NOT ({skip}))),
  found AS (SELECT seed_id, input, kind, source, type, output, CAST(status AS INT) AS status, CAST(length AS INT) AS length,
      set_name, key, page_id, in_scope FROM (
      SELECT *, row_number() OVER (PARTITION BY seed_id, set_name, key ORDER BY phase, page_id, source, output) AS rn FROM rows0) WHERE rn = 1)
"""


FOUND = _findings()
FOUND_APEX = _findings(APEX_SEEDS)
FOUND_PLAIN = _findings(src="p")
# Only the link kinds, de-duplicated within the tag scan alone.
TAG_ONLY = FOUND.replace("FROM rows0)", "FROM rows0 WHERE phase = 1)")
QUOTED_ONLY = FOUND_PLAIN.replace("FROM rows0)", "FROM rows0 WHERE phase = 0)")
BASE = f"WITH p AS ({PAGES}), rich AS ({RICH}), meta AS ({META}), seeds AS ({HOST_SEEDS}), apexes AS ({APEX_SEEDS}), canon AS ({CANON})"
BASE_LINKS = BASE + "," + _links()
PLAIN_LINKS = BASE + "," + _links("p")
TARGETS = "tgt AS (SELECT seed_id, CASE WHEN seed_id % 2 = 0 THEN host ELSE seed_url END AS raw, host, apex, seed_url FROM seeds)"
LISTING = """last AS (SELECT apex, max(page_id // 20) AS last FROM p GROUP BY apex),
 pagedp AS (SELECT p.apex AS domain, CAST(page_id // 20 AS INT) AS page, url FROM p JOIN last USING (apex))"""
ARCHIVE = f"""{BASE}, {LISTING}, arch AS (SELECT DISTINCT a.seed_id, u.url FROM apexes a JOIN (
  SELECT apex AS domain, url FROM p UNION ALL SELECT apex, url FROM p WHERE page_id % 13 <> 0
  UNION ALL SELECT apex, url FROM p WHERE (page_id // 100) % 5 <> 4 UNION ALL SELECT domain, url FROM pagedp) u ON u.domain = a.apex)"""
CHAIN = """firsts AS (SELECT canonical, min(page_id) AS page_id, arg_min(host, page_id) AS host FROM canon GROUP BY canonical),
 chain AS (SELECT page_id, host, canonical AS src, lead(canonical) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM firsts)"""
CRAWL = f"""WITH RECURSIVE {BASE[5:]}, {CHAIN}, {_links("p")[1:]},
 sc AS (SELECT seed_id, canonical AS seed_canon, s.scope FROM seeds s JOIN canon c ON c.page_id = s.seed_id),
 quoted_graph AS (SELECT DISTINCT f.canonical AS src, l.canon AS dst FROM links l JOIN firsts f USING (page_id) WHERE kind = 'linkfinder'),
 tag_graph AS (SELECT f.canonical AS src, l.canon AS dst FROM links l JOIN firsts f USING (page_id) WHERE kind = 'href'
   UNION SELECT src, dst FROM chain WHERE dst IS NOT NULL),
 walk(seed_id, scope, url, depth, round) AS (
   SELECT seed_id, scope, seed_canon, 1, 1 FROM sc
   UNION
   SELECT w.seed_id, w.scope, e.dst, CASE WHEN e.tag THEN w.depth + 1 ELSE 1 END, w.round + 1
   FROM walk w JOIN (SELECT src, dst, FALSE AS tag FROM quoted_graph UNION ALL
     SELECT src, dst, TRUE FROM tag_graph t WHERE NOT EXISTS (SELECT 1 FROM quoted_graph q WHERE q.src = t.src AND q.dst = t.dst)) e ON e.src = w.url
   WHERE regexp_matches(e.dst, w.scope) AND (NOT e.tag OR w.depth < {Q.CRAWL_DEPTH}) AND w.round <= (SELECT max(n) FROM (SELECT count(*) AS n FROM firsts GROUP BY host))),
 reached AS (SELECT seed_id, url, min(round) AS round, arg_min(depth, round * 1000 + depth) AS depth FROM walk GROUP BY seed_id, url)"""
UNLIMITED = CRAWL.replace(f"(NOT e.tag OR w.depth < {Q.CRAWL_DEPTH})", "TRUE")

def _script_links() -> str:
    """The link CTEs of the script bodies, under names of their own."""
    return re.sub(r"\b(dec|q0|q1|quoted|t0|t1|tags|links)\b(?!\()", r"s_\1", _links("scripts"))


SCRIPTS = """scripts AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/js/' || page_id || '.js' AS url, html, host, apex FROM p)"""
OWN_SCRIPT = """'<script src="/js/' || page_id || '.min.js"></script>'"""
ROBOTS = f"""robots AS (SELECT seed_id, CASE WHEN rule = '' THEN seed_url ELSE {_printed(_absolute('seed_url', 'rule'))} END AS url
  FROM (SELECT s.seed_id, s.seed_url, trim(regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1)) AS rule FROM p JOIN seeds s USING (host)))"""
OTHERS = f"""{LISTING}, others AS (SELECT DISTINCT s.seed_id, u.url FROM seeds s JOIN (
  SELECT apex AS domain, url FROM p UNION ALL SELECT apex, url FROM p WHERE page_id % 13 <> 0
  UNION ALL SELECT apex, url FROM p WHERE (page_id // 100) % 5 <> 4 UNION ALL SELECT domain, url FROM pagedp) u ON u.domain = s.apex)"""
REQUESTS = """requests AS (SELECT s.seed_id, s.seed_url AS input, page_id, p.url FROM p JOIN seeds s USING (host)
  WHERE page_id % 6 IN (0, 1) AND page_id % 4 <> 3 AND regexp_matches(p.url, scope))"""
WHOLE = (
    _findings()
    .replace("|| ' </i>' AS html", f"|| ' </i>' || {OWN_SCRIPT} AS html", 1)
    .replace(
        "  found AS (SELECT seed_id",
        f"""  {REQUESTS},
  rows1 AS (SELECT * FROM rows0 UNION ALL SELECT seed_id, input, 'network', 'network', 'network', url, 0, 0, 'link', lower(url), 2, page_id, TRUE FROM requests),
  found AS (SELECT seed_id""",
        1,
    )
    .replace("FROM rows0) WHERE rn = 1", "FROM rows1) WHERE rn = 1", 1)
    + f""", {SCRIPTS}, {_script_links()[1:]}, {ROBOTS}, {OTHERS},
  wanted AS (SELECT DISTINCT f.seed_id, f.input, s.apex AS sapex, s.scope, unnest([output, replace(output, '.min.js', '.js')]) AS url
    FROM found f JOIN seeds s USING (seed_id) WHERE kind = 'javascript' AND in_scope),
  spg AS (SELECT w.seed_id, w.input, w.sapex, w.scope, x.* FROM s_dec x JOIN wanted w ON x.url = w.url),
  srows AS (
    SELECT seed_id, input, 'url' AS kind, 'body' AS source, 'url' AS type, url AS output, 200 AS status, strlen(d) AS length, 'url' AS set_name,
      'script ' || page_id AS key, page_id FROM spg
    UNION ALL
    SELECT w.seed_id, w.input, x.kind, CASE WHEN x.kind = 'javascript' THEN 'javascript' ELSE x.source END, x.type, canon, 0, 0,
      CASE WHEN x.kind = 'javascript' THEN 'js' ELSE 'link' END, lower(canon), page_id FROM s_links x JOIN wanted w ON x.url = w.url
      WHERE phase = 0 AND regexp_matches(x.link, w.scope) AND regexp_matches(x.url, w.scope)
    UNION ALL
    SELECT seed_id, input, 'subdomains', 'body', 'subdomain', o, 0, 0, 'sub', lower(o), page_id FROM (
      SELECT seed_id, input, page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(m), '^(20|25|2b|2f|3d|3a|40)+', ''), '^-+', ''), '-+$', ''), '^\\.(.)', '\\1') AS o FROM (
        SELECT seed_id, input, page_id, unnest(regexp_extract_all(d, {_q(LABELS)} || replace(sapex, '.', '[.]'))) AS m FROM spg WHERE regexp_matches(url, scope)))
    UNION ALL
    SELECT seed_id, input, 'aws', 'body', 'aws', {_decode('m')}, 0, 0, 'aws', lower({_decode('m')}), page_id FROM (
      SELECT seed_id, input, page_id, unnest(regexp_extract_all(d, {_q(BUCKET)})) AS m FROM spg WHERE regexp_matches(url, scope))),
  sfound AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, set_name, key ORDER BY page_id, source, output) AS rn FROM srows) r
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.seed_id = r.seed_id AND f.set_name = r.set_name AND f.key = r.key)),
  shown AS (SELECT seed_id, url FROM (SELECT seed_id, url, row_number() OVER (PARTITION BY seed_id ORDER BY o) AS pick FROM (
    SELECT seed_id, arg_min(url, o) AS url, min(o) AS o FROM (SELECT seed_id, seed_url AS url, -1 AS o FROM seeds UNION ALL
      SELECT s.seed_id, x.url, page_id FROM rich x JOIN seeds s ON x.host = s.host WHERE strlen(x.html) < 61440 AND regexp_matches(x.url, s.scope)) GROUP BY seed_id, lower(url))) WHERE pick <= 6),
  extra AS (SELECT seed_id, 'robots' AS kind, 'url' AS type, url FROM robots WHERE url IS NOT NULL UNION ALL SELECT seed_id, 'sitemap', 'url', p.url FROM p JOIN seeds USING (host)
    UNION ALL SELECT seed_id, 'sitemap', 'url', p.url FROM p JOIN seeds USING (host) UNION ALL SELECT seed_id, 'other-sources', 'url', url FROM others
    UNION ALL SELECT seed_id, 'render', 'render', url FROM shown),
  whole AS (SELECT seed_id, kind, input, source, type, output, status, length FROM found
    UNION ALL SELECT seed_id, kind, input, source, type, output, CAST(status AS INT), CAST(length AS INT) FROM sfound
    UNION ALL SELECT e.seed_id, kind, s.seed_url, kind, type, e.url, 0, 0 FROM extra e JOIN seeds s USING (seed_id))
"""
)
EXCLUDED = "(?i)/(the|and|la|de)[a-z]*$"
SEEDED = f"""WITH RECURSIVE {BASE[5:]}, own AS (SELECT page_id, url, html || {OWN_SCRIPT} AS html, host, apex FROM p), {SCRIPTS},
 {_links("own")[1:]}, {_script_links()[1:]}, {ROBOTS}, {OTHERS},
 firsts AS (SELECT canonical, min(page_id) AS page_id FROM canon GROUP BY canonical),
 edges AS (SELECT f.canonical AS src, FALSE AS scripted, canon AS dst, kind FROM links JOIN firsts f USING (page_id)
   UNION SELECT url, TRUE, canon, kind FROM s_links WHERE phase = 0),
 steps AS (SELECT src, scripted, dst, FALSE AS to_script FROM edges WHERE kind <> 'javascript'
   UNION SELECT src, scripted, unnest([dst, replace(dst, '.min.js', '.js')]), TRUE FROM edges WHERE kind = 'javascript'),
 outside AS (SELECT seed_id, url FROM robots WHERE url IS NOT NULL UNION SELECT seed_id, p.url FROM p JOIN seeds USING (host) UNION SELECT seed_id, url FROM others),
 begun AS (SELECT seed_id, s.scope, canonical AS url FROM seeds s JOIN canon c ON c.page_id = s.seed_id
   UNION SELECT o.seed_id, s.scope, {_canonical(_printed('o.url'))} FROM outside o JOIN seeds s USING (seed_id)
     WHERE regexp_matches(o.url, s.scope) AND NOT regexp_matches(o.url, {_q(STATIC)}) AND NOT regexp_matches(o.url, {_q(EXCLUDED)})),
 walk(seed_id, scope, url, scripted, round) AS (
   SELECT seed_id, scope, url, FALSE, 1 FROM begun WHERE url IS NOT NULL
   UNION
   SELECT w.seed_id, w.scope, e.dst, e.to_script, w.round + 1 FROM walk w JOIN steps e ON e.src = w.url AND e.scripted = w.scripted
   WHERE w.round <= 5 AND regexp_matches(e.dst, w.scope) AND NOT regexp_matches(e.dst, {_q(STATIC)}) AND NOT regexp_matches(e.dst, {_q(EXCLUDED)}))
"""

ORACLES = {
    "load_targets": f"{BASE}, {TARGETS} SELECT seed_id, raw FROM tgt UNION ALL SELECT seed_id, seed_url FROM seeds",
    "normalize_targets": f"""{BASE}, {TARGETS} SELECT seed_id, CASE WHEN raw LIKE '%://%' THEN raw ELSE 'https://' || raw END AS url,
      host, apex AS domain, CASE WHEN raw NOT LIKE '%://%' THEN apex END AS scope_domain, raw NOT LIKE '%://%' AS allow_subs FROM tgt""",
    "scan_pages": "SELECT page_id, url, CAST(strlen(html) AS INT) AS bytes FROM pages",
    "wayback_urls": f"{BASE} SELECT apex AS domain, (page_id + 20200000000000) || '' AS ts, url FROM p",
    "commoncrawl_urls": f"{BASE} SELECT apex AS domain, (page_id + 20200000000000) || '' AS ts, url FROM p WHERE page_id % 13 <> 0",
    "latest_index": "SELECT page_id AS list_id, 'CC-' || (page_id + 2) AS index_id FROM pages WHERE page_id % 9 <> 0",
    "report_urls": f"{BASE} SELECT apex AS domain, url FROM p WHERE (page_id // 100) % 5 <> 4",
    "paged_urls": f"{BASE}, {LISTING} SELECT domain, page, url FROM pagedp",
    "robots_urls": f"""{BASE}, r AS (SELECT s.seed_id, s.seed_url, p.page_id // 100 AS part,
        CAST(row_number() OVER (PARTITION BY p.host, p.page_id // 100 ORDER BY p.page_id) - 1 AS INT) AS line_no,
        trim(regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1)) AS rule FROM p JOIN seeds s USING (host))
      SELECT seed_id, part, line_no, CASE WHEN rule = '' THEN seed_url ELSE {_printed(_absolute('seed_url', 'rule'))} END AS url FROM r""",
    "sitemap_urls": f"{BASE} SELECT s.seed_id, page_id // 100 AS part, url FROM p JOIN seeds s USING (host)",
    "sitemap_index_urls": f"{BASE} SELECT s.seed_id, url FROM p JOIN seeds s USING (host)",
    "wellknown_candidates": f"""{BASE} SELECT seed_id, path, seed_url || path AS candidate
      FROM seeds, (SELECT unnest([{', '.join(_q(x) for x in SITEMAPS)}]) AS path)""",
    "archive_union": f"{ARCHIVE} SELECT seed_id, url FROM arch",
    "archive_host_match": f"""{BASE}, r AS (SELECT page_id, url, host, regexp_replace(host, '^(?:blog|m|www)\\.', '') AS domain FROM p)
      SELECT page_id, url, domain, 'host' AS mode FROM r WHERE host = domain UNION ALL SELECT page_id, url, domain, 'domain' FROM r""",
    "network_urls": f"""{BASE} SELECT s.seed_id, arg_min(url, page_id) AS url FROM p JOIN seeds s USING (host)
      WHERE page_id % 6 IN (0, 1) AND page_id % 4 <> 3 AND regexp_matches(url, scope) GROUP BY s.seed_id, lower(url)""",
    "findings_json": f"""{FOUND} SELECT seed_id, to_json({{'input': input, 'source': source, 'type': type, 'output': output,
      'status': status, 'length': length}})::VARCHAR AS line FROM found""",
    "findings_text": f"""{FOUND} SELECT seed_id, unnest(CASE WHEN kind = 'url' THEN ['[url] - [code-' || status || '] - [len_' || length || '] - ' || output]
      WHEN kind = 'subdomains' THEN ['[subdomains] - http://' || output, '[subdomains] - https://' || output]
      ELSE ['[' || CASE WHEN kind = 'aws' THEN 'aws-s3' WHEN type = 'linkfinder' THEN type ELSE kind END || '] - ' || output] END) AS line FROM found""",
    "findings_quiet": f"{FOUND} SELECT seed_id, output AS line FROM found",
    "findings_by_host": f"""{FOUND} SELECT replace(regexp_extract(input, '^https?://([^/?#]+)', 1), '.', '_') AS host_key,
      sum(CASE WHEN kind = 'subdomains' THEN 2 ELSE 1 END)::BIGINT AS lines FROM found GROUP BY 1""",
    "raw_bodies": f"""{BASE} SELECT s.seed_id, page_id, '[Raw] - ' || chr(10) || {_decode('html')} || chr(10) AS line
      FROM p JOIN seeds s USING (host) WHERE regexp_matches(url, scope)""",
    "scope_filter": f"""{BASE_LINKS} SELECT s.seed_id, page_id, link, 'host' AS mode FROM links x JOIN seeds s ON x.host = s.host WHERE regexp_matches(link, s.scope)
      UNION ALL SELECT s.seed_id, page_id, link, 'apex' FROM links x JOIN apexes s ON x.apex = s.apex WHERE regexp_matches(link, s.scope)""",
    "scope_rules": f"""{BASE}, {TARGETS} SELECT seed_id, CASE WHEN raw LIKE '%://%' THEN host ELSE apex END AS scope_host,
      raw NOT LIKE '%://%' AS scope_subs FROM tgt""",
    "include_filter": f"""{BASE} SELECT a.seed_id, page_id, 'include' AS mode FROM p JOIN apexes a ON p.apex = a.apex WHERE regexp_matches(url, {_q('/(en|fr)/')})
      UNION ALL SELECT a.seed_id, page_id, 'domain' FROM p, apexes a WHERE p.host = {_q(Q.INCLUDED_DOMAIN)}
      UNION ALL SELECT a.seed_id, page_id, 'assets' FROM p JOIN apexes a ON p.apex = a.apex WHERE regexp_matches(url, {_q('/(en|fr)/')}) OR p.host = {_q(Q.INCLUDED_DOMAIN)}""",
    "include_anywhere": _findings("SELECT seed_id, seed_url, host, apex, '/(en|fr)/' AS scope FROM (" + APEX_SEEDS + ")", on="regexp_matches(x.url, s.scope)")
    + "SELECT seed_id, kind, output FROM found WHERE kind IN ('url', 'href', 'linkfinder')",
    "exclude_filter": f"{PLAIN_LINKS} SELECT page_id, canon AS dst FROM links WHERE NOT regexp_matches(canon, '/(the|and|la|de)[a-z]*$')",
    "static_asset_filter": f"{BASE_LINKS} SELECT page_id, link FROM tags WHERE link IS NOT NULL AND NOT regexp_matches(link, {_q(STATIC)})",
    "kind_filter": f"{FOUND} SELECT seed_id, kind, output FROM found WHERE kind IN ('href', 'javascript')",
    "length_filter": f"""{_findings(src='p', skip="strlen(d) BETWEEN 1000 AND 1999")} SELECT seed_id, kind, output FROM found
      WHERE kind NOT IN ('subdomains', 'aws')""",
    "body_cap": f"""SELECT page_id, CAST(CASE WHEN strlen(html) <= 4096 THEN strlen({_decode('html')}) ELSE strlen(html) END AS INT) AS length,
      strlen(html) <= 4096 AS scanned FROM pages""",
    "error_status_filter": f"{BASE} SELECT page_id, url, status FROM meta WHERE status = 403",
    "asset_status_filter": f"{BASE} SELECT page_id, url, status FROM meta WHERE status NOT IN (404, 429)",
    "content_type_gate": f"{BASE} SELECT page_id, content_type FROM meta WHERE content_type IN ('', 'text/html')",
    "noise_filter": f"""{PLAIN_LINKS}, n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'text/' || regexp_replace(token, '[^a-z]', '', 'g')
        WHEN 1 THEN '{{{{' || token || '}}}}' WHEN 2 THEN token || '/:id' WHEN 3 THEN '1/' || (page_id % 31) || '/2025' ELSE token END AS token FROM q0)
      SELECT page_id, token FROM n WHERE NOT {_noise('token')}""",
    "absolute_links": f"""{BASE}, own AS (SELECT page_id, url, html || '<a href="' || url || '">self</a>' AS html, host, apex FROM p), {_links('own')[1:]}
      SELECT page_id, token, regexp_matches(token, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS absolute FROM q0""",
    "asset_inventory": f"{FOUND} SELECT seed_id, output, regexp_extract(output, '(\\.[^./]*)$', 1) AS ext FROM found WHERE kind = 'javascript'",
    "redirect_scope": f"""{BASE}, r AS (SELECT a.page_id, a.host AS base_host, CASE WHEN a.page_id % 4 = 0 THEN 'https://m.' || a.host || '/'
        WHEN a.page_id % 4 = 1 THEN a.url ELSE b.url END AS target_url FROM p a LEFT JOIN p b ON b.page_id = a.page_id + 3)
      SELECT page_id, base_host, target_url FROM r WHERE target_url IS NOT NULL AND (regexp_extract(target_url, '^https?://([^/?#:]+)', 1) = base_host
        OR (page_id % 8 = 0 AND ends_with(regexp_extract(target_url, '^https?://([^/?#:]+)', 1), '.' || base_host)))""",
    "in_scope_pages": f"{BASE} SELECT s.seed_id, page_id, url FROM p JOIN seeds s USING (host) WHERE regexp_matches(url, scope)",
    "in_scope_responses": f"""{BASE}, m AS (SELECT s.seed_id, page_id, url, CAST(strlen({_decode('html')}) AS INT) AS length FROM meta JOIN seeds s USING (host)
      WHERE status = 200 AND regexp_matches(url, scope)) SELECT * FROM m WHERE length NOT BETWEEN 1000 AND 1999""",
    "href_links": f"{TAG_ONLY} SELECT seed_id, output, page_id FROM found WHERE kind = 'href'",
    "script_assets": f"{TAG_ONLY} SELECT seed_id, output, in_scope AS crawlable FROM found WHERE kind = 'javascript'",
    "form_pages": f"{FOUND} SELECT seed_id, output FROM found WHERE kind = 'form'",
    "upload_form_pages": f"{FOUND} SELECT seed_id, output FROM found WHERE kind = 'upload-form'",
    "quoted_links": f"{QUOTED_ONLY} SELECT seed_id, source, output FROM found WHERE kind = 'linkfinder'",
    "asset_quoted_links": _findings(src="scripts").replace(
        "seeds AS (",
        """scripts AS (SELECT c.page_id, c.script AS url, p.html, p.host, p.apex FROM (
          SELECT min(page_id) AS page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/js/' || (page_id % 5) || '.js' AS script
          FROM p GROUP BY 2) c JOIN p USING (page_id)), seeds AS (""",
        1,
    ).replace("FROM rows0)", "FROM rows0 WHERE phase = 0)")
    + "SELECT seed_id, kind, CASE WHEN kind = 'javascript' THEN 'javascript' ELSE source END AS source, output FROM found WHERE kind IN ('linkfinder', 'javascript')",
    "asset_quoted_links_whole": _findings(src="scripts").replace(
        "seeds AS (",
        """scripts AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/js/' || page_id || '.js' AS url, html, host, apex FROM p), seeds AS (""",
        1,
    ).replace("FROM rows0)", "FROM rows0 WHERE phase = 0)")
    + "SELECT seed_id, kind, CASE WHEN kind = 'javascript' THEN 'javascript' ELSE source END AS source, output FROM found WHERE kind IN ('linkfinder', 'javascript')",
    "asset_feed": f"""{FOUND} SELECT seed_id, type, unnest(CASE WHEN contains(output, '.min.js') THEN [output, replace(output, '.min.js', '.js')] ELSE [output] END) AS url
      FROM found WHERE kind = 'javascript' AND in_scope""",
    "unminified_variants": f"{FOUND} SELECT seed_id, replace(output, '.min.js', '.js') AS url FROM found WHERE kind = 'javascript' AND in_scope AND contains(output, '.min.js')",
    "subdomains": f"{FOUND_APEX} SELECT seed_id, output, page_id FROM found WHERE kind = 'subdomains'",
    "s3_buckets": f"{FOUND_APEX} SELECT seed_id, output FROM found WHERE kind = 'aws'",
    "url_findings": f"""{BASE} SELECT s.seed_id, page_id, url AS output, status, CAST(CASE WHEN status = 200 THEN strlen({_decode('html')}) ELSE strlen(html) END AS INT) AS length
      FROM meta JOIN seeds s USING (host) WHERE status IN (200, 403)""",
    "link_edges": f"{BASE_LINKS} SELECT page_id, url AS src, canon AS dst, kind, phase FROM links",
    "seen_dedup": f"{FOUND} SELECT seed_id, CASE kind WHEN 'form' THEN 'form' WHEN 'upload-form' THEN 'upload-form' ELSE set_name END AS set_name, key, kind, page_id FROM found WHERE kind NOT IN ('url', 'subdomains', 'aws')",
    "exact_unique": f"{PLAIN_LINKS} SELECT DISTINCT url AS src, link FROM links",
    "kind_precedence": f"{FOUND_PLAIN} SELECT seed_id, kind, count(*) AS urls FROM found WHERE set_name = 'link' GROUP BY 1, 2",
    "canonical_dedup": f"{BASE} SELECT lower(canonical) AS key, min(page_id) AS page_id, count(*) AS copies FROM canon GROUP BY 1",
    "new_frontier": f"{FOUND.replace('WITH ', 'WITH ', 1)}, visited AS ({CANON}) SELECT seed_id, output AS url FROM found WHERE set_name = 'link' AND output NOT IN (SELECT canonical FROM visited)",
    "registrable_domain": f"""{BASE}, h AS (SELECT DISTINCT host, apex, regexp_extract(host, '^([^.]+)', 1) AS l FROM p)
      SELECT DISTINCT * FROM (SELECT host, apex AS domain FROM h UNION ALL SELECT 'a.' || l || '.com.ua', l || '.com.ua' FROM h
        UNION ALL SELECT 'a.' || l || '.x.ck', l || '.x.ck' FROM h UNION ALL SELECT l || '.www.ck', 'www.ck' FROM h
        UNION ALL SELECT l || '.ck', CASE WHEN l = 'www' THEN 'www.ck' END FROM h UNION ALL SELECT 'a.' || l || '.unlisted', l || '.unlisted' FROM h UNION ALL SELECT 'com', NULL)""",
    "pages_by_seed": f"""{BASE} SELECT s.seed_id, page_id, 'host' AS mode FROM p JOIN seeds s ON p.host = s.host WHERE regexp_matches(url, scope)
      UNION ALL SELECT s.seed_id, page_id, 'apex' FROM p JOIN apexes s ON p.apex = s.apex WHERE regexp_matches(url, scope)""",
    "frontier_fetch": f"{BASE}, {CHAIN} SELECT f.canonical, f.page_id FROM firsts f WHERE canonical IN (SELECT dst FROM chain)",
    "all_findings": f"{FOUND} SELECT seed_id, kind, input, source, type, output, status, length FROM found",
    "crawl_frontier": f"{CRAWL} SELECT seed_id, f.page_id, url, CAST(depth AS INT) AS depth FROM reached r JOIN firsts f ON f.canonical = r.url",
    "crawl_unlimited": f"{UNLIMITED} SELECT seed_id, f.page_id, url FROM reached r JOIN firsts f ON f.canonical = r.url",
    "all_findings_whole": f"{WHOLE} SELECT * FROM whole",
    "crawl_seeded": f"{SEEDED} SELECT seed_id, lower(url) AS url_key, scripted, CAST(min(round) AS INT) AS round FROM walk GROUP BY 1, 2, 3",
    "crawl_depths_unlimited": f"{UNLIMITED} SELECT seed_id, lower(url) AS url_key, CAST(min(round) AS INT) AS round FROM reached GROUP BY 1, 2",
    "crawl_depths": f"{CRAWL} SELECT seed_id, lower(url) AS url_key, CAST(min(round) AS INT) AS round FROM reached GROUP BY 1, 2",
    "multi_seed_findings": f"""SELECT * FROM ({FOUND} SELECT seed_id, kind, count(*) AS findings FROM found GROUP BY 1, 2)
      UNION ALL SELECT * FROM ({FOUND_APEX} SELECT -seed_id - 1, kind, count(*) FROM found GROUP BY 1, 2)""",
    "render_candidates": f"""{BASE}, c AS (SELECT seed_id, seed_url AS url, 0 AS g, -1 AS page_id FROM seeds UNION ALL
        SELECT s.seed_id, url, 1, page_id FROM meta JOIN seeds s USING (host) WHERE status = 200 AND content_type = 'text/html' AND strlen(html) < 61440 AND regexp_matches(url, scope)),
      f AS (SELECT seed_id, arg_min(url, g * 1000000000 + page_id) AS url, min(g * 1000000000 + page_id) AS o FROM c GROUP BY seed_id, lower(url)),
      r AS (SELECT seed_id, url, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY o) AS INT) AS pick FROM f) SELECT seed_id, url, pick FROM r WHERE pick <= 6""",
    "blocked_resources": f"""{BASE} SELECT s.seed_id, page_id, CASE page_id % 6 WHEN 0 THEN 'XHR' WHEN 1 THEN 'Fetch' ELSE 'Script' END AS resource_type,
      CASE WHEN page_id % 4 = 3 THEN 'https://cdn.' || host || '/x' ELSE url END AS request_url FROM p JOIN seeds s USING (host) WHERE page_id % 6 IN (0, 1, 5)""",
    "broken_links": f"""{BASE_LINKS} SELECT regexp_extract(canon, '^https?://([^/?#]+)', 1) AS host, canon AS dst, count(*) AS links FROM links
      WHERE canon NOT IN (SELECT canonical FROM canon) AND regexp_extract(canon, '^https?://([^/?#]+)', 1) IN (SELECT host FROM p) GROUP BY 1, 2""",
    "status_report": f"{BASE} SELECT status, count(*) AS pages FROM meta GROUP BY status",
    "js_inventory": f"{FOUND} SELECT regexp_extract(output, '^https?://([^/?#]+)', 1) AS host, count(*) AS scripts FROM found WHERE kind = 'javascript' GROUP BY 1",
    "bundle_fingerprint": f"{FOUND} SELECT seed_id, output FROM found WHERE kind = 'javascript' AND regexp_matches(output, '\\.(min\\.js|bundle\\.js)')",
    "historical_endpoints": f"{ARCHIVE} SELECT seed_id, url FROM arch WHERE regexp_matches(url, '(?i)api|v1|v2|admin')",
    "historical_endpoints_admin": f"""{BASE}, old AS (SELECT page_id, apex, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '(^https?://[^/]+)/', '\\1/Admin/') ELSE url END AS url FROM p)
      SELECT DISTINCT a.seed_id, url FROM old JOIN apexes a ON a.apex = old.apex WHERE regexp_matches(url, '(?i)api|v1|v2|admin')""",
    "admin_forms": f"""{BASE}, m AS (SELECT host, page_id, regexp_replace(url, '(^https?://[^/]+)/', '\\1/Admin/') AS output FROM p WHERE page_id % 12 = 0)
      SELECT s.seed_id, k AS kind, output FROM m JOIN seeds s USING (host), (SELECT unnest(['form', 'upload-form']) AS k) WHERE k = 'form' OR page_id % 6 = 0""",
    "subdomain_enum": f"{FOUND_APEX} SELECT regexp_extract(input, '^https?://([^/?#]+)', 1) AS domain, count(DISTINCT output) AS subdomains FROM found WHERE kind = 'subdomains' GROUP BY 1",
    "findings_summary": FOUND
    + "SELECT seed_id, "
    + ", ".join(
        f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}"
        for k in (
            "url href javascript linkfinder form upload-form subdomains aws robots sitemap other-sources network render raw"
        ).split()
    )
    + " FROM found GROUP BY seed_id",
    "findings_summary_whole": f"{WHOLE} SELECT seed_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in KINDS)
    + " FROM whole GROUP BY seed_id",
    "stream_dedup": f"{FOUND} SELECT seed_id, CASE WHEN kind IN ('url', 'upload-form') THEN kind WHEN kind = 'subdomains' THEN kind ELSE set_name END AS set_name, key FROM found",
    "stream_sink": f"""{FOUND} SELECT replace(regexp_extract(input, '^https?://([^/?#]+)', 1), '.', '_') AS host_key,
      sum(CASE WHEN kind = 'subdomains' THEN 2 ELSE 1 END)::BIGINT AS lines FROM found GROUP BY 1""",
    "stream_findings": FOUND.replace(
        "PARTITION BY seed_id, set_name, key ORDER BY phase, page_id, source, output",
        "PARTITION BY seed_id, page_id, kind, output, key ORDER BY phase",
    )
    + "SELECT DISTINCT seed_id, kind, page_id, output FROM found",
    "stream_frontier": f"{FOUND}, visited AS ({CANON}) SELECT seed_id, output AS url FROM found WHERE set_name = 'link' AND output NOT IN (SELECT canonical FROM visited)",
}
