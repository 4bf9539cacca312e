"""The same results in DuckDB SQL, written independently of the Spark plans.

Nothing is shared with the Spark side but the list of white space characters:
patterns, joins, samples, models and metrics are spelled out once more.
"""

from __future__ import annotations

from html import entities as standard_names

from gleaner.functions.text import WHITESPACE

from . import duck_probe
from .fixtures import BAD_HOSTS, NAV

ANCHOR = r"(?i)<a\s"
HREF = r"""(?is)^([^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
CONTENT = r"(?is)^[^>]*>(.*?)(</a\s*>|$)"
ARTICLE = r"(?is)<article(?:\s[^>]*)?>(.*?)(?:</article\s*>|$)"
MODELS = ("m1", "m2", "m3")
WEIGHTS = (0.96, 0.97, 0.98, 0.99)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def tags(x: str) -> str:
    return sub(x, r"<[A-Za-z/!?][^>]*(?:>|$)", "''")


def names() -> str:
    """The standard's table."""
    table = {k[:-1]: v.replace("\xa0", " ") for k, v in standard_names.html5.items() if k.endswith(";") and k not in ("amp;", "AMP;")}
    return f"MAP([{', '.join(map(lit, table))}], [{', '.join(map(lit, table.values()))}])"


def entities(x: str) -> str:
    """Numeric ampersands by name, then every name once, ampersands last; a few
    frequent names go first, as looking them up in the table is slow."""
    x = sub(x, "&#(?:0*38|[xX]0*26);", "'&amp;'")
    for name in ("nbsp", "quot", "copy", "middot", "lt", "gt"):
        x = f"replace({x}, '&{name};', {lit(standard_names.html5[name + ';'].replace(chr(160), ' '))})"
    found = "list_distinct(regexp_extract_all(acc, '&([A-Za-z][A-Za-z0-9]*);', 1))"
    done = f"list_reduce(list_concat([acc], {found}), lambda a, n: replace(a, '&' || n || ';', coalesce(({names()})[n], '&' || n || ';')))"
    x = f"list_transform([{x}], lambda acc: CASE WHEN regexp_matches(replace(acc, '&amp;', ''), '&[A-Za-z][A-Za-z0-9]*;') THEN {done} ELSE acc END)[1]"
    return f"replace(replace({x}, '&AMP;', '&'), '&amp;', '&')"


def without(x: str, name: str) -> str:
    """Elements up to their first end tag."""
    pieces = f"string_split_regex({x}, '(?i)<{name}(\\s[^>]*)?>')"
    return (
        f"array_to_string(list_transform({pieces}, lambda p, i: "
        f"CASE WHEN i > 1 THEN regexp_replace(p, '(?is)^.*?</{name}\\s*>', ' ') ELSE p END), ' ')"
    )


def outer_headers(x: str) -> str:
    end = "(?i)</article\\s*>"
    inside = f"string_split_regex(q, '{end}')[1]"
    after = f"substr(q, length({inside}) + length(regexp_extract(q, '{end}')) + 1)"
    kept = f"'<article>' || {inside} || CASE WHEN regexp_matches(q, '{end}') THEN '</article>' || {without(after, 'header')} ELSE '' END"
    return (
        f"array_to_string(list_transform(string_split_regex({x}, '(?i)<article(\\s[^>]*)?>'), lambda q, k: "
        f"CASE WHEN k > 1 THEN {kept} ELSE {without('q', 'header')} END), '')"
    )


def ads(x: str) -> str:
    start = (
        r"""(?i)<div\s([^>]*\s)?class\s*=\s*("([^">]*\s)?ad(\s[^">]*)?"|''([^''>]*\s)?ad(\s[^''>]*)?''|ad[\s>])([^>]*>)?"""
    )
    parts = "string_split_regex(q, '(?i)</div\\s*>')"
    opened = f"list_transform({parts}, lambda d: len(regexp_extract_all(d, '(?i)<div[\\s>]')))"
    ends = f"list_transform([{opened}], lambda o: list_filter(range(1, len(o)), lambda n: list_sum(o[1:n]) - n + 1 <= 0))[1]"
    rest = (
        f"list_transform([{ends}], lambda z: CASE WHEN len(z) > 0 THEN ' ' || array_to_string({parts}[z[1] + 1:], '</div>') ELSE q END)[1]"
    )
    return (
        f"array_to_string(list_transform(string_split_regex({x}, '{start}'), lambda q, k: CASE WHEN k > 1 THEN {rest} ELSE q END), ' ')"
    )


def to_text(x: str) -> str:
    """Spelled out apart from the Spark expressions: the silent elements, ads,
    headers outside articles, containers, then lines, tags, names and spaces."""
    x = sub(
        x,
        r"(?is)<(script(\s[^>]*)?(>|$).*?(</script\s*>|$)|style(\s[^>]*)?(>|$).*?(</style\s*>|$)|!--.*?(-->|$)|title(\s[^>]*)?>[^<]*(</title\s*>)?)",
        "' '",
    )
    x = outer_headers(ads(x))
    for name in ("noscript", "template", "nav", "footer", "aside", "select", "button"):
        x = without(x, name)
    lines = "p|br|h[1-6]|div|section|article|main|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|hr|title"
    x = entities(tags(sub(x, rf"(?i)</?({lines})(\s[^>]*)?/?>", "chr(10)")))
    x = sub(sub(x, r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    return f"trim({x}, ' ' || chr(10))"


SILENT = r"(?is)<(script(\s[^>]*)?(>|$).*?(</script\s*>|$)|style(\s[^>]*)?(>|$).*?(</style\s*>|$)|!--.*?(-->|$)|title(\s[^>]*)?>[^<]*(</title\s*>)?)"


def main_block() -> str:
    """Scores of all blocks, sums of all runs by differences of running sums, the
    best run of each page."""
    elements = (
        "p|br|h[1-6]|div|section|article|main|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|hr|title|nav|footer|aside|header|form|button|select"
    )
    marked = sub(sub("html", SILENT, "' '"), rf"(?i)(</?(?:{elements})(?:\s[^>]*)?/?>)", "chr(1) || '\\1'")
    body = "substr(piece, length(tag) + 1)"
    unlinked = sub(body, r"(?is)<a(\s[^>]*)?>.*?(</a\s*>|$)", "' '")
    text, plain = (f"trim({sub(tags(x), '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'n]+', chr(39) + ' ' + chr(39))})" for x in (body, unlinked))
    decoded = sub(sub(entities("lines"), r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    return f"""WITH cut AS (SELECT page_id, string_split({marked}, chr(1)) AS pieces FROM pages),
        pieces AS (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cut),
        tagged AS (SELECT *, regexp_extract(piece, '^<[^>]*>') AS tag FROM pieces),
        texts AS (SELECT page_id, i, tag, {text} AS text, length({plain}) AS free FROM tagged),
        scores AS (SELECT page_id, i, text, free - 3 * greatest(length(text) - free, 0) - CASE WHEN text = '' THEN 0 ELSE 20 END
          + CASE WHEN regexp_matches(tag, '(?i)\\s(class|id)\\s*=[^>]*(nav|menu|footer|sidebar|comment|promo|share|related|sponsor)')
                   OR regexp_matches(tag, '(?i)^<(nav|footer|aside|header|form|button|select)[\\s>]') THEN -75
                 WHEN regexp_matches(tag, '(?i)\\s(class|id)\\s*=[^>]*(article|content|entry|main|post|story|text)') THEN 25 ELSE 0 END AS score FROM texts),
        sums AS (SELECT page_id, i, score, sum(score) OVER (PARTITION BY page_id ORDER BY i) AS s FROM scores),
        runs AS (SELECT a.page_id, a.i AS first, b.i AS last FROM sums a JOIN sums b ON a.page_id = b.page_id AND a.i <= b.i
          WHERE b.s - a.s + a.score > 0
          QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY b.s - a.s + a.score DESC, b.i, a.i) = 1),
        found AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS lines FROM scores JOIN runs USING (page_id)
          WHERE i BETWEEN first AND last AND text <> '' GROUP BY page_id)
        SELECT page_id, trim({decoded}, ' ' || chr(10)) AS text FROM (SELECT page_id, coalesce(lines, '') AS lines FROM pages LEFT JOIN found USING (page_id))"""


def authority(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}]+')"


def order(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def weighted(vector: str, model: str) -> str:
    return f"list_sum(list_transform({vector}, lambda x, i: CAST(x AS DOUBLE) * CAST((i * ({model} + 2)) % 5 - 2 AS DOUBLE)))"


def held_out(key: str) -> str:
    draw = f"md5('42:split:' || CAST({key} AS VARCHAR))"
    return f"CAST('0x' || left({draw}, 8) AS BIGINT) / 4294967296.0 < 0.2"


NL = "chr(10)"
CRLF = "chr(13) || chr(10)"
SECTION = "regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1)"
TEXTS = f"texts AS (SELECT page_id, url, {to_text('html')} AS text FROM pages)"
PATHS = """paths AS (SELECT 'crawl/CC-' || page_id || '.warc' || CASE WHEN url LIKE '%.html' THEN '.txt'
  WHEN url LIKE '%#top' THEN '.gz.tmp' ELSE '.gz' END AS path FROM pages)"""
INDEX = f"""idx0 AS (SELECT page_id, url, {SECTION} AS lang FROM pages),
idx AS (SELECT url AS page_url, 'crawl/' || page_id || '.warc.gz' AS page_file,
  CASE WHEN lang = 'fr' AND contains(url, 'utm_source') THEN NULL WHEN lang = 'en' THEN 'eng,fra'
       WHEN lang = 'fr' THEN 'fra' WHEN lang = 'de' THEN 'deu' ELSE 'zeng,spa' END AS page_langs,
  CASE WHEN url LIKE '%/' THEN 'short line' WHEN lang = 'de' AND url LIKE '%.html' THEN 'bad json' END AS reject
  FROM idx0)"""
WARC = f"""warc0 AS (SELECT *, 'HTTP/1.1 200 OK' || {CRLF} ||
    CASE WHEN contains(url, '?page=') THEN 'Transfer-Encoding: chunked' || {CRLF} ELSE '' END ||
    'Content-Type: text/html' || {CRLF} || {CRLF} || html AS http,
    'GET ' || url || ' HTTP/1.1' || {CRLF} || {CRLF} AS get FROM pages),
warc AS (
  SELECT page_id, html, 'response' AS rec_type, CASE WHEN url NOT LIKE '%/' THEN url END AS url,
    strlen(http) + CASE WHEN url LIKE '%.html' THEN 9 ELSE 0 END AS content_length, http AS payload,
    CASE WHEN url LIKE '%/' THEN 'no target' WHEN url LIKE '%.html' THEN 'truncated'
         WHEN contains(url, '?page=') THEN 'encoded body' END AS reject FROM warc0
  UNION ALL
  SELECT page_id, html, 'request', url, strlen(get), get, NULL FROM warc0)"""
LISTS = f"""bad AS (SELECT {authority('url')} AS host, regexp_extract(url, '{BAD_HOSTS}', 1) AS category, url FROM pages),
domains AS (SELECT DISTINCT host, category FROM bad WHERE category <> ''),
blocked AS (SELECT url FROM pages WHERE url LIKE '%#top')"""
ALLOWED = f"""allowed AS (SELECT p.* FROM pages p WHERE {authority('p.url')} NOT IN (SELECT host FROM domains)
  AND p.url NOT IN (SELECT url FROM blocked))"""
ANCHORS = f"""inside AS (SELECT page_id, url, array_to_string(regexp_extract_all(html, {lit(NAV)}, 1), ' ') AS nav FROM pages),
pieces AS (SELECT page_id, url, unnest(string_split_regex(nav, {lit(ANCHOR)})[2:]) AS piece FROM inside),
anchors AS (SELECT page_id, url, trim(regexp_extract(piece, {lit(HREF)}, 2), chr(34) || chr(39)) AS href,
  {entities(tags(f'regexp_extract(piece, {lit(CONTENT)}, 1)'))} AS anchor
  FROM pieces WHERE regexp_matches(piece, {lit(HREF)}))"""
HREFS = """hrefs AS (SELECT '/wiki/' || CASE WHEN anchor LIKE '%,' THEN replace(anchor, ' ', '_') ELSE url_encode(anchor) END
  || '_100%_a+b' AS href, replace(anchor, '_', ' ') || ' 100% a+b' AS title FROM anchors)"""
LABELLED = "labelled AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id))"
LOGITS = "logits AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"
PROBS = f"""{LOGITS}, ex AS (SELECT vec_id, i, exp(x[i]) AS e FROM logits, range(1, 65) r(i)),
probs AS (SELECT vec_id, i - 1 AS class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"""
OUTPUT = f"""output AS (SELECT vec_id, {weighted('embedding', '1')} + 0.5 AS logit,
  CAST(label < 5 AS INTEGER) AS label FROM embeddings),
preds AS (SELECT label, CAST(logit > 0.5 AS INTEGER) AS pred FROM output)"""
CLASSES = f"""{OUTPUT}, classes AS (SELECT label AS c FROM preds UNION SELECT pred FROM preds),
per AS (SELECT c, (SELECT count(*) FROM preds WHERE label = c AND pred = c) AS tp,
  (SELECT count(*) FROM preds WHERE pred = c) AS predicted, (SELECT count(*) FROM preds WHERE label = c) AS support FROM classes),
prf AS (SELECT c, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM prf)"""


def language_ctes(source: str, key: str) -> str:
    """Naive Bayes over letter runs, trained on all documents."""
    return f"""tok AS (SELECT lang, unnest({words('text')}) AS t FROM documents),
n AS (SELECT lang, t, count(*) AS n FROM tok GROUP BY ALL),
size AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
v AS (SELECT count(DISTINCT t) AS v FROM n),
occ AS (SELECT {key}, unnest({words('text')}) AS t FROM {source}),
tf AS (SELECT {key}, t, count(*) AS tf FROM occ GROUP BY ALL),
s AS (SELECT tf.{key}, size.lang, sum(tf.tf * ln((coalesce(n.n, 0) + 1) / (size.total + v.v))) / sum(tf.tf) AS s
  FROM tf CROSS JOIN size CROSS JOIN v LEFT JOIN n ON n.lang = size.lang AND n.t = tf.t GROUP BY ALL),
lp AS (SELECT {key}, lang, exp(s) / sum(exp(s)) OVER (PARTITION BY {key}) AS p FROM s),
best AS (SELECT {key}, lang, p FROM lp QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY p DESC, lang) = 1)"""


RUN = f"""q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE {held_out('vec_id')}),
c AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings WHERE NOT ({held_out('vec_id')})),
sims AS (SELECT q.query_id, c.doc_id, q.label AS ql, c.label AS dl, c.embedding AS e,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS sim FROM q, c),
run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM sims
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) <= 50),
totals AS (SELECT label, count(*) AS n_relevant FROM c GROUP BY label),
judged AS (SELECT run.*, ql % 3 AS task, CAST(ql = dl AS INTEGER) AS rel, coalesce(n_relevant, 0) AS n_relevant
  FROM run LEFT JOIN totals ON totals.label = run.ql)"""
QUALITY = f"""models AS (SELECT unnest([1, 2, 3]) AS m),
quality AS (SELECT judged.*, 'm' || m AS model, 1 / (1 + exp(-{weighted('e', 'm')})) AS raw FROM judged, models),
scaled AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w)
  ELSE 0 END AS quality FROM quality WINDOW w AS (PARTITION BY model, query_id))"""
SWEEP = f"""{QUALITY},
grid AS (SELECT unnest([{', '.join(f'CAST({w} AS DOUBLE)' for w in WEIGHTS)}]) AS quality_p),
blended AS (SELECT query_id, doc_id, model, quality_p, task, rel, n_relevant,
  round(quality_p * sim + (1 - quality_p) * quality, 12) AS score FROM scaled, grid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, quality_p, query_id ORDER BY score DESC, doc_id) AS rank FROM blended)"""


def metrics(source: str, by: str) -> str:
    return f"""top AS (SELECT *, sum(rel) OVER (PARTITION BY {by}, query_id ORDER BY rank) AS hits
  FROM {source} WHERE rank <= 10 AND n_relevant > 0),
per_query AS (SELECT {by}, query_id, any_value(n_relevant) AS r, sum(rel / log2(rank + 1)) AS dcg,
  sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) AS ap, sum(rel) AS found,
  min(CASE WHEN rel = 1 THEN rank END) AS first_hit FROM top GROUP BY {by}, query_id),
ideal AS (SELECT r, (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(r, 10) AS BIGINT) + 1) t(i)) AS idcg
  FROM (SELECT DISTINCT r FROM per_query))
SELECT {by}, round(avg(dcg / idcg), 6) AS ndcg, round(avg(ap / r), 6) AS map, round(avg(found / r), 6) AS recall,
  round(avg(found / 10), 6) AS precision, round(avg(coalesce(1 / first_hit, 0)), 6) AS mrr, count(*) AS n_queries
FROM per_query JOIN ideal USING (r) GROUP BY {by}"""


def picks(links: str) -> str:
    return f"""links AS ({links}),
picked AS (SELECT page_url AS url, page_file AS filename FROM idx WHERE reject IS NULL
  AND list_contains(string_split(page_langs, ','), 'eng') AND page_url NOT IN (SELECT url FROM links))
SELECT url, filename FROM picked
QUALIFY row_number() OVER (ORDER BY {order("url || ' ' || filename")}, url, filename) <= (SELECT count(DISTINCT url) FROM links)"""


PERPLEXITY = """SELECT doc_id, n_tokens, round(nll, 6) AS nll, round(exp(nll), 3) AS perplexity,
  round(1 / (1 + exp(nll)), 6) AS quality FROM nll"""


def statements() -> dict[str, str]:
    return {
        "path_list": f"""WITH {PATHS} SELECT path, 'suffix' AS match FROM paths WHERE path LIKE '%.gz'
            UNION ALL SELECT path, 'contains' FROM paths WHERE contains(path, '.gz')""",
        "warc_files": f"WITH {WARC} SELECT rec_type, url, content_length, payload, reject FROM warc",
        "picked_pages": f"WITH {WARC} SELECT url, html FROM warc WHERE rec_type = 'response' AND reject IS NULL AND contains(url, '/en/')",
        "warc_records": f"WITH {WARC} SELECT rec_type, url, content_length, payload, reject FROM warc",
        "http_body": f"WITH {WARC} SELECT url, html FROM warc WHERE rec_type = 'response' AND reject IS NULL",
        "cdx_parse": f"""WITH {INDEX} SELECT CASE WHEN reject IS NULL THEN page_url END AS url,
            CASE WHEN reject IS NULL THEN page_file END AS filename,
            CASE WHEN reject IS NULL THEN page_langs END AS languages, reject FROM idx""",
        "cdx_english": f"""WITH {INDEX} SELECT page_url AS url, page_file AS filename FROM idx
            WHERE reject IS NULL AND list_contains(string_split(page_langs, ','), 'eng')""",
        "article_list": f"WITH {ANCHORS}, {HREFS} SELECT href, 'https://en.wikipedia.org' || href AS url, title FROM hrefs",
        "blocklist_scan": f"""WITH {LISTS} SELECT category, 'domains' AS kind, host AS value FROM domains
            UNION ALL SELECT DISTINCT 'fragment', 'urls', url FROM blocked""",
        "labelled_text": f"""WITH {LABELLED} SELECT unnest(string_split(text, {NL})) AS text, quality AS label FROM labelled""",
        "page_csv_scan": f"WITH {TEXTS} SELECT url, text FROM texts",
        "page_sink": f"WITH {TEXTS} SELECT url, text, {SECTION} AS warc_file FROM texts",
        "merge_pages": f"WITH {TEXTS} SELECT url, text FROM texts",
        "labelled_sink": f"""WITH {LABELLED} SELECT 'doc ' || doc_id AS title, text, quality AS label FROM labelled
            WHERE length(text) > 0""",
        "curated_scan": "SELECT url FROM pages",
        "incremental_pages": f"""WITH {LISTS}, {ALLOWED} SELECT page_id, url, {to_text('html')} AS text FROM allowed
            WHERE length({to_text('html')}) > 0""",
        "incremental_clean": f"""WITH {LISTS}, {ALLOWED}, clean AS (SELECT page_id, url, {to_text('html')} AS text FROM allowed),
            {language_ctes('clean', 'page_id')}
            SELECT page_id, url, text FROM clean SEMI JOIN (SELECT page_id FROM best WHERE lang = 'en' AND p > 0.6) USING (page_id)
            WHERE length(text) > 0""",
        "extract_text": f"WITH {TEXTS} SELECT page_id, text FROM texts",
        "main_block": main_block(),
        "article_text": f"""WITH a AS (SELECT page_id, html, regexp_extract_all(html, {lit(ARTICLE)}, 1) AS parts FROM pages),
            b AS (SELECT page_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, {NL}) ELSE html END AS html FROM a)
            SELECT page_id, {to_text('html')} AS text FROM b""",
        "host_boilerplate": f"""WITH {TEXTS}, b AS (SELECT page_id, {authority('url')} AS host, unnest(string_split(text, {NL})) AS block FROM texts)
            SELECT host, block, count(DISTINCT page_id) AS n_pages FROM b WHERE block <> ''
            GROUP BY host, block HAVING count(DISTINCT page_id) >= 2""",
        "clean_blocks": f"""WITH {TEXTS}, b AS (SELECT page_id, {authority('url')} AS host, string_split(text, {NL}) AS parts FROM texts),
            e AS (SELECT page_id, host, unnest(parts) AS block, generate_subscripts(parts, 1) AS pos FROM b),
            rep AS (SELECT host, block FROM e WHERE block <> '' GROUP BY host, block HAVING count(DISTINCT page_id) >= 2),
            kept AS (SELECT e.* FROM e ANTI JOIN rep USING (host, block))
            SELECT page_id, string_agg(block, {NL} ORDER BY pos) AS text FROM kept GROUP BY page_id
            HAVING length(string_agg(block, {NL} ORDER BY pos)) > 0""",
        "language_scores": f"WITH {language_ctes('documents', 'doc_id')} SELECT doc_id, lang, round(p, 6) AS p FROM lp",
        "english_filter": f"""WITH {language_ctes('documents', 'doc_id')} SELECT doc_id, text FROM documents
            SEMI JOIN (SELECT doc_id FROM best WHERE lang = 'en' AND p > 0.6) USING (doc_id)""",
        "english_top1": f"WITH {language_ctes('documents', 'doc_id')} SELECT doc_id FROM best WHERE lang = 'en'",
        "url_authority": f"""WITH u AS (SELECT unnest([url, replace(url, '://', '://Me:pw@'), replace(url, '.com/', '.COM:8080/'),
            regexp_replace(url, '^https?:', ''), regexp_replace(url, '^https?://', '')]) AS url FROM pages)
            SELECT url, {authority('url')} AS authority FROM u""",
        "safe_name": """SELECT page_id, left(regexp_replace(url || regexp_extract(html, '(?is)<title>(.*?)</title>', 1),
            '[^\\p{L}\\p{N}_.-]', '_', 'g'), 150) || '.txt' AS file_name FROM pages""",
        "url_title": f"""WITH {ANCHORS}, {HREFS} SELECT href, title,
            'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url FROM hrefs""",
        "explode_links": f"""WITH {ANCHORS} SELECT 'Page ' || page_id AS title, anchor AS link, 'internal' AS kind FROM anchors
            WHERE url NOT LIKE '%/' UNION ALL SELECT 'Page ' || page_id, url, 'external' FROM pages WHERE url NOT LIKE '%/'""",
        "harvest_anchors": f"WITH {ANCHORS} SELECT page_id, href, anchor FROM anchors",
        "warc_stem": f"""WITH {PATHS} SELECT path, right(path, 12) AS tail, split_part(path, '/', 2) AS segment,
            split_part(split_part(path, '/', 2), '.', 1) AS stem FROM paths WHERE contains(path, '.gz')""",
        "reject_counts": f"""WITH {INDEX}, {WARC}, r AS (SELECT reject, 'index' AS source FROM idx UNION ALL SELECT reject, 'warc' FROM warc)
            SELECT source, coalesce(reject, 'ok') AS reason, count(*) AS n FROM r GROUP BY ALL""",
        "sigmoid_score": f"WITH {OUTPUT} SELECT vec_id, round(1 / (1 + exp(-logit)), 6) AS score FROM output",
        "seq_ids": """SELECT url, row_number() OVER (ORDER BY url) - 1 AS seq, 'dense' AS mode FROM pages WHERE contains(url, '/en/')
            UNION ALL SELECT url, seq, 'gaps' FROM (SELECT url, row_number() OVER (ORDER BY url) - 1 AS seq FROM pages)
            WHERE contains(url, '/en/')""",
        "novel_urls": f"""WITH {INDEX} SELECT page_url AS url, page_file AS filename FROM idx
            WHERE reject IS NULL AND NOT contains(page_url, '?page=')""",
        "not_in_curated": "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%.html')",
        "blocklist_filter": f"WITH {LISTS}, {ALLOWED} SELECT page_id, url FROM allowed",
        "link_stats": """SELECT 2 * count(*) AS n_lines, count(DISTINCT url) AS n_links FROM pages WHERE contains(url, '?page=')""",
        "confusion_matrix": f"""WITH {CLASSES} SELECT a.c AS label, b.c AS pred,
            (SELECT count(*) FROM preds WHERE label = a.c AND pred = b.c) AS n FROM classes a, classes b""",
        "classification_report": f"""WITH {CLASSES},
            rep AS (SELECT CAST(c AS VARCHAR) AS name, p, r, f1, support FROM f
              UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
              UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                sum(f1 * support) / sum(support), sum(support) FROM f
              UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f)
            SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep""",
        "macro_metrics": f"""WITH {CLASSES} SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
            round(avg(f1), 6) AS f1_macro, round(sum(tp) / sum(support), 6) AS accuracy FROM f""",
        "mean_pool": """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
            SELECT label, count(*) AS n, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM e GROUP BY label, pos""",
        "funnel_counts": f"""WITH {TEXTS}, {LISTS}, {language_ctes('texts', 'page_id')},
            m AS (SELECT t.*, {authority('t.url')} NOT IN (SELECT host FROM domains) AND t.url NOT IN (SELECT url FROM blocked) AS ok,
              length(t.text) > 0 AS filled, coalesce(b.lang = 'en' AND b.p > 0.6, false) AS english
              FROM texts t LEFT JOIN best b USING (page_id))
            SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM m UNION ALL SELECT 1, 'allowed', count(*) FILTER (ok) FROM m
            UNION ALL SELECT 2, 'with text', count(*) FILTER (ok AND filled) FROM m
            UNION ALL SELECT 3, 'english', count(*) FILTER (ok AND filled AND english) FROM m""",
        "crawl_pick": f"WITH {INDEX}, {picks('''SELECT url FROM pages WHERE contains(url, '?page=')''')}",
        "crawl_curation": f"""WITH {INDEX}, {picks('''SELECT url FROM pages WHERE url NOT LIKE '%/'
            AND (contains(url, '?page=') OR contains(url, '#top'))''')}""",
        "head_n": f"WITH {TEXTS} SELECT url, text FROM texts ORDER BY url LIMIT 20",
        "balanced_negatives": f"""WITH d AS (SELECT doc_id, split_part(text, {NL}, 1) AS title FROM documents),
            good AS (SELECT title FROM d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
            cand AS (SELECT title, min(doc_id) AS doc_id FROM d ANTI JOIN labels USING (doc_id)
              WHERE title NOT IN (SELECT title FROM good) GROUP BY title)
            SELECT doc_id, title FROM cand QUALIFY row_number() OVER (ORDER BY {order('title')}, title)
              <= (SELECT count(DISTINCT title) FROM good)""",
        "class_sample": f"""WITH {LABELLED} SELECT doc_id, quality, text FROM labelled
            QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {order('doc_id')}, doc_id) <= 50""",
        "take_sample": f"SELECT doc_id, text FROM documents ORDER BY {order('doc_id')}, doc_id LIMIT 100",
        "labelled_union": f"WITH {LABELLED} SELECT doc_id, text, quality AS label FROM labelled",
        "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {order('doc_id')}, doc_id) - 1 AS position FROM documents",
        "train_test_split": f"""SELECT doc_id, CASE WHEN {held_out('doc_id')} THEN 'test' ELSE 'train' END AS split FROM documents""",
        "exact_split": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {order('doc_id')}, doc_id)
              <= (SELECT floor(count(*) * 0.2) FROM labels) THEN 'test' ELSE 'train' END AS split FROM labels""",
        "softmax": f"WITH {PROBS} SELECT vec_id, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM probs",
        "argmax_label": f"""WITH {PROBS} SELECT vec_id, CAST(class AS INTEGER) AS class, 'c' || class AS label FROM probs
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) = 1""",
        "topk_confidence": f"""WITH {PROBS}, t AS (SELECT vec_id, p FROM probs
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) <= 3)
            SELECT vec_id, round(avg(p), 6) AS confidence FROM t GROUP BY vec_id""",
        "threshold_confidence": f"""WITH {PROBS} SELECT vec_id, round(CASE WHEN max(p) > 0.022 THEN max(p) ELSE 0.005 END, 6) AS confidence
            FROM probs GROUP BY vec_id""",
        "entropy_confidence": f"""WITH {PROBS} SELECT vec_id,
            round((1 - (-sum(p * ln(p + 1e-12))) / ln(64)) * max(p), 6) AS confidence FROM probs GROUP BY vec_id""",
        "unigram_perplexity": f"""WITH occ AS (SELECT doc_id, unnest({words('text')}) AS t FROM documents),
            n AS (SELECT t, count(*) AS n FROM occ GROUP BY t), z AS (SELECT sum(n) AS total, count(*) AS v FROM n),
            nll AS (SELECT doc_id, count(*) AS n_tokens, -avg(ln((n.n + 1) / (z.total + z.v))) AS nll
              FROM occ JOIN n USING (t) CROSS JOIN z GROUP BY doc_id) {PERPLEXITY}""",
        "bigram_perplexity": f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents),
            occ AS (SELECT doc_id, unnest(w) AS t, unnest(list_concat(['<s>'], w[1:len(w) - 1])) AS u FROM w WHERE len(w) > 0),
            v AS (SELECT count(DISTINCT t) AS v FROM occ), nu AS (SELECT u, count(*) AS nu FROM occ GROUP BY u),
            nut AS (SELECT u, t, count(*) AS nut FROM occ GROUP BY u, t),
            nll AS (SELECT doc_id, count(*) AS n_tokens, -avg(ln((nut + 1) / (nu + v.v))) AS nll
              FROM occ JOIN nut USING (u, t) JOIN nu USING (u) CROSS JOIN v GROUP BY doc_id) {PERPLEXITY}""",
        "probe_gradient": """SELECT CAST(i AS INTEGER) AS feature, CAST(0 AS DOUBLE) AS gradient, (SELECT count(*) FROM embeddings) AS n
            FROM range(0, 65) t(i)""",
        "domain_classify": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
            cent AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY label, pos),
            sim AS (SELECT e.vec_id, cent.label AS domain, sum(CAST(e.x AS DOUBLE) * m) AS s FROM e JOIN cent USING (pos)
              GROUP BY e.vec_id, cent.label),
            pr AS (SELECT vec_id, domain, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM sim)
            SELECT vec_id, CAST(domain AS VARCHAR) AS domain, round(p, 6) AS p FROM pr
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, domain) = 1""",
        "dense_topk": f"WITH {RUN} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM run",
        "topk_normalise": f"""WITH {RUN}, {QUALITY} SELECT query_id, doc_id, round(quality, 6) AS quality FROM scaled WHERE model = 'm1'""",
        "quality_rerank": f"""WITH {RUN}, {SWEEP} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
            FROM ranked WHERE model = 'm1' AND quality_p = 0.98""",
        "ranking_metrics": f"WITH {RUN}, {metrics('judged', 'task')}",
        "rerank_sweep": f"WITH {RUN}, {SWEEP}, {metrics('ranked', 'model, quality_p, task')}",
        "save_predictions": f"""WITH {RUN}, {SWEEP} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, model, quality_p, task FROM ranked""",
        "clean_corpus": f"""WITH {LISTS}, {ALLOWED}, clean AS (SELECT page_id, url, {to_text('html')} AS text FROM allowed
              WHERE url NOT LIKE '%.html'), {language_ctes('clean', 'page_id')}
            SELECT page_id, url, text FROM clean SEMI JOIN (SELECT page_id FROM best WHERE lang = 'en' AND p > 0.6) USING (page_id)
            WHERE length(text) > 0""",
        "clean_warc": f"""WITH {LISTS}, {WARC}, clean AS (SELECT page_id, url, {to_text('html')} AS text FROM warc
              WHERE rec_type = 'response' AND reject IS NULL AND {authority('url')} NOT IN (SELECT host FROM domains)
              AND url NOT IN (SELECT url FROM blocked)), {language_ctes('clean', 'page_id')}
            SELECT url, text FROM clean SEMI JOIN (SELECT page_id FROM best WHERE lang = 'en' AND p > 0.6) USING (page_id)
            WHERE length(text) > 0""",
    } | duck_probe.statements(order, held_out)
