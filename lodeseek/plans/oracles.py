"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from lodeseek.plans import fixtures as fx

# The values of the definitions, in SQL: written out here a second time, so that a slip in the library's lists shows.
STOP_WORDS = """a an the i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    would should could ought might must shall will can at by for from in into of on to with about against between through during before after above below
    up down out off over under and but if or because as until while although though unless since when where why how all each every both few more most
    other some such no nor not only own same so than too very just also now here there then need any many much even back well way want get got go going
    make made like http https www com org net html htm""".split()
STEP_2 = dict(p.split(">") for p in """ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate
    alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble""".split())
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
PHRASES = """delve|delves|delving|tapestry|multifaceted|nuanced|comprehensive|crucial|vital|realm|landscape|paradigm|leverage|leveraging|utilize|utilizing|foster|fostering|facilitate|enhance|enhancing|optimal|robust|seamless|streamline|pivotal|intricate|myriad|plethora|pertaining|it's important to note|it is important to note|it's worth noting|it is worth noting|in today's world|in this day and age|at the end of the day|when it comes to|in terms of|on the other hand|that being said|having said that|it goes without saying|in conclusion|to summarize|to sum up|in summary|all in all|overall|let's dive in|let's explore|let's delve|this article will|this guide will|in this article|in this guide|in this post|welcome to this|it's essential|it is essential|play a crucial role|plays a crucial role|of paramount importance""".split("|")
STARTERS = """furthermore|additionally|moreover|however|consequently|nevertheless|subsequently|therefore|thus|hence|in addition|as a result|for instance|for example|in fact|indeed|notably|importantly|specifically|particularly|firstly|secondly|thirdly|finally|lastly|to begin|to start|moving on|next|now""".split("|")
EXTENSIONS = "pdf zip tar gz rar 7z exe dmg msi deb rpm jpg jpeg png gif svg ico webp mp3 mp4 avi mov wmv flv doc docx xls xlsx ppt pptx css js json xml rss atom woff woff2 ttf eot".split()
LOW_VALUE = """/login /logout /signin /signout /signup /register /password /forgot /reset /account /profile /settings /preferences /print /share /email /export /download
    /subscribe /unsubscribe /feed /forks /stargazers /watchers /network /graphs /pulse /compare /commits /wiki/special: /wiki/talk: /wiki/user: /wiki/wikipedia: /wiki/file:
    /wiki/template: /wiki/category: /wiki/portal: /wiki/help: action=edit action=history oldid= /share? utm_ fbclid= gclid= /search /archive/ /comment /reply /vote""".split()


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
P = "p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)"
WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def kept(text: str) -> str:
    return f"list_filter({WORDS.format(text)}, lambda t: len(t) <= 100 AND NOT list_contains([{quoted(STOP_WORDS)}], t))"


C_, V_ = "(?:[^aeiou][^aeiouy]*)", "(?:[aeiouy][aeiou]*)"
M0, M1, M2 = f"^{C_}?{V_}{C_}", f"^{C_}?{V_}{C_}{V_}?$", f"^{C_}?{V_}{C_}{V_}{C_}"
VOWEL, CVC = f"^{C_}?[aeiouy]", "(?:[aeiou]y(?:yy)*|[^aeiouy](?:yy)*)[aeiouy][^aeiouwxy]$"
DOUBLED = "(?:" + "|".join(c * 2 for c in "bcdfghjklmnpqrstvwxz0123456789") + ")$"


def _ends(s: str, w: str = "w") -> str:
    return f"(ends_with({w}, '{s}') AND len({w}) > {len(s)})"


def _stem(n: int, w: str = "w") -> str:
    return f"substr({w}, 1, len({w}) - {n})"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def stem_ctes(source: str) -> str:
    """CTEs from source(token) to stems(token, stem)."""
    cases = lambda table: " ".join(f"WHEN {_ends(s)} THEN CASE WHEN {_m(_stem(len(s)), M0)} THEN {_stem(len(s))} || '{to}' ELSE w END" for s, to in table.items())
    ion = lambda s: f" AND regexp_matches({_stem(3)}, '[st]$')" if s == "ion" else ""
    four = " ".join(f"WHEN {_ends(s)}{ion(s)} THEN CASE WHEN {_m(_stem(len(s)), M2)} THEN {_stem(len(s))} ELSE w END" for s in STEP_4)
    return f"""
        t0 AS (SELECT token, regexp_replace(token, '^y', 'Y') AS w FROM (SELECT DISTINCT token FROM {source})),
        t1 AS (SELECT token, CASE WHEN {_ends('sses')} OR {_ends('ies')} THEN {_stem(2)} WHEN {_ends('ss')} THEN w WHEN {_ends('s')} THEN {_stem(1)} ELSE w END AS w FROM t0),
        t2 AS (SELECT token, w, CASE WHEN {_ends('eed')} THEN NULL WHEN {_ends('ed')} THEN {_stem(2)} WHEN {_ends('ing')} THEN {_stem(3)} END AS s FROM t1),
        t3 AS (SELECT token, w, CASE WHEN {_m('s', VOWEL)} THEN s END AS s FROM t2),
        t4 AS (SELECT token, CASE WHEN {_ends('eed')} THEN CASE WHEN {_m(_stem(3), M0)} THEN {_stem(1)} ELSE w END WHEN s IS NULL THEN w
            WHEN {_ends('at', 's')} OR {_ends('bl', 's')} OR {_ends('iz', 's')} THEN s || 'e' WHEN {_m('s', DOUBLED)} THEN CASE WHEN {_m('s', '[lsz]$')} THEN s ELSE {_stem(1, 's')} END
            WHEN {_m('s', M1)} AND {_m('s', CVC)} THEN s || 'e' ELSE s END AS w FROM t3),
        t5 AS (SELECT token, CASE WHEN {_ends('y')} AND {_m(_stem(1), VOWEL)} THEN {_stem(1)} || 'i' ELSE w END AS w FROM t4),
        t6 AS (SELECT token, CASE {cases(STEP_2)} ELSE w END AS w FROM t5),
        t7 AS (SELECT token, CASE {cases(STEP_3)} ELSE w END AS w FROM t6),
        t8 AS (SELECT token, CASE {four} ELSE w END AS w FROM t7),
        t9 AS (SELECT token, CASE WHEN {_ends('e')} AND ({_m(_stem(1), M2)} OR ({_m(_stem(1), M1)} AND NOT {_m(_stem(1), CVC)})) THEN {_stem(1)} ELSE w END AS w FROM t8),
        t10 AS (SELECT token, CASE WHEN {_ends('ll')} AND {_m('w', M2)} THEN {_stem(1)} ELSE w END AS w FROM t9),
        stems AS (SELECT token, CASE WHEN len(token) < 3 THEN token ELSE regexp_replace(w, '^Y', 'y') END AS stem FROM t10)"""


TOK = f"tok AS (SELECT doc_id, 0 AS field, unnest(range(0, len(k))) AS position, unnest(k) AS token FROM (SELECT doc_id, {kept('text')} AS k FROM d))"
POST = "post AS (SELECT stem AS term, doc_id, field, count(*) AS tf, list(position ORDER BY position) AS positions FROM tok JOIN stems USING (token) GROUP BY ALL)"
INDEX = f"{D}, {TOK}, {stem_ctes('tok')}, {POST}, terms AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term)"

# The AI score; a byte view has one # for each byte of other characters.


def byte_view(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{80}}-\\x{{7FF}}]', '##', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '###', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '####', 'g')"


def ai_ctes(source: str) -> str:
    matches = " + ".join(f"(len(l) - len(replace(l, {quoted([p])}, ''))) // {len(p)}" for p in PHRASES)
    return f"""
        a0 AS (SELECT doc_id, text, strlen(text) AS n, {low('text')} AS l,
            list_filter(list_transform(regexp_extract_all({byte_view('text')}, '(?s).{{10,}}?[.!?]|.{{11,}}\\z'), lambda s: trim(s, ' ' || chr(9) || chr(10))), lambda s: s <> '') AS sentences,
            list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda b: trim(regexp_replace(b, '[ \\t]*\\n[ \\t]*', ' ', 'g'), ' ' || chr(9) || chr(10))), lambda b: b <> '') AS blocks
            FROM {source}),
        a1 AS (SELECT *, list_transform(sentences, lambda s: 1.0::DOUBLE + len(s) - len(replace(s, ' ', ''))) AS lengths,
            list_transform(blocks, lambda b: {low("regexp_replace(regexp_extract(b, '^[ \\t\\n]*([^ \\t\\n]+(?:[ \\t\\n]+[^ \\t\\n]+){0,2}(?:[ \\t\\n]+)?)', 1), '[ \\t\\n]+', ' ', 'g')")}) AS firsts,
            CASE WHEN n = 0 THEN 0 ELSE ({matches}) * 1000.0::DOUBLE / n END AS density FROM a0),
        a2 AS (SELECT *, list_filter(list_transform(firsts, lambda f: list_filter([{quoted(STARTERS)}], lambda s: starts_with(f, s) OR contains(f, ' ' || s))[1]), lambda s: s IS NOT NULL) AS starts FROM a1),
        a3 AS (SELECT doc_id, n, density / (density + 3.0) AS vocabulary,
            CASE WHEN len(lengths) < 5 OR list_avg(lengths) < 1 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, 1.0 - list_stddev_pop(lengths) / list_avg(lengths) / 0.8)) END AS uniformity,
            CASE WHEN len(blocks) < 3 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, len(starts)::DOUBLE / len(blocks) * (2.0 - CASE WHEN len(starts) = 0 THEN 1.0 ELSE len(list_distinct(starts))::DOUBLE / len(starts) END))) END AS repetition,
            len(sentences) AS n_sentences, len(blocks) AS n_paragraphs FROM a2),
        ai AS (SELECT *, CASE WHEN n < 200 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, vocabulary * 0.40 + uniformity * 0.35 + repetition * 0.25)) END AS ai_score FROM a3)"""


REWRITTEN = f"""{D}, e0 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Furthermore, ' || replace(text, chr(10), chr(10) || ' ' || chr(10) || 'Indeed, ') ELSE text END AS text FROM d),
        e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, ' the ', ' delves into a robust tapestry; in conclusion the ') ELSE text END AS text FROM e0)"""


def ranked(terms: dict[str, int], excluded: list[str] = (), where: str = "TRUE", having: str = "TRUE", index: str = INDEX, source: str = "d", docs: str = "SELECT doc_id, 'unknown' AS era, '' AS domain FROM d") -> str:
    """CTEs to m(doc_id, relevance, score) for terms with their multiplicities."""
    times = "CASE term " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in terms.items()) + " ELSE 0 END"
    return f"""{index}, {ai_ctes(source)},
        len0 AS (SELECT doc_id, count(*) AS dl FROM post GROUP BY doc_id),
        docs AS (SELECT x.doc_id, x.era, x.domain, coalesce(dl, 0) AS dl, ai.ai_score FROM ({docs}) x LEFT JOIN len0 USING (doc_id) LEFT JOIN ai USING (doc_id)),
        st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT avg(dl) FROM (SELECT dl FROM docs ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100)) AS avgdl),
        f AS (SELECT term, doc_id, sum(tf) AS tf, list_sort(flatten(list(positions))) AS pos FROM post WHERE term IN ({quoted([*terms, *excluded])}) GROUP BY term, doc_id),
        s AS (SELECT f.doc_id, term, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * {times} AS s FROM f JOIN terms USING (term) JOIN docs ON docs.doc_id = f.doc_id, st),
        m AS (SELECT s.doc_id, sum(s) AS relevance, sum(s) * (1 - 0.2 * any_value(ai_score)) AS score FROM s JOIN docs USING (doc_id)
            WHERE {where} AND s.doc_id NOT IN (SELECT doc_id FROM f WHERE term IN ({quoted(excluded) or "''"})) GROUP BY s.doc_id HAVING {having})"""


SCORED = "SELECT doc_id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM m"
FLAG = {"thtion": 1, "attion": 1, "thing": 1}


def pos(term: str) -> str:
    return f"max(pos) FILTER (term = '{term}')"


def adjacent(a: str, b: str) -> str:
    return f"coalesce(list_has_any(list_transform({pos(a)}, lambda x: x + 1), {pos(b)}), FALSE)"


def _moved(term: str, by: int) -> str:
    return f"list_transform({pos(term)}, lambda x: x + {by})"


RUN = f"coalesce(list_has_any(list_intersect({_moved('ci', 2)}, {_moved('nci', 1)}), {pos('n')}), FALSE)"


# HTML


def entities(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def no_comments(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


def visible(x: str) -> str:
    x = no_comments(x)
    for tag in ("script", "style", "noscript", "template", "head"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return x


B = "[ \\t\\n\\r\\f\\x0B]+"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}', ''), '{B}\\z', '')"


def html_text(x: str = "html") -> str:
    plain = entities(f"regexp_replace({visible(x)}, '(?s)<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({plain}, '{B}', ' ', 'g'), ' ')"


def html_title(x: str = "html") -> str:
    return trimmed(entities(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def resolve(link: str, base: str) -> str:
    root = f"regexp_extract({base}, '(?s)^(.*?://[^/]*)', 1)"
    folder = f"CASE WHEN regexp_extract({base}, '(?s)^.*?://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract({base}, '(?s)^.*?://[^/]*(/(?:.*/)?)', 1) END"
    return (
        f"CASE WHEN starts_with({link}, 'http://') OR starts_with({link}, 'https://') OR {base} = '' THEN {link} WHEN NOT contains({base}, '://') THEN '' "
        f"WHEN starts_with({link}, '//') THEN regexp_extract({base}, '(?s)^(.*?)://', 1) || ':' || {link} WHEN starts_with({link}, '/') THEN {root} || {link} ELSE {root} || {folder} || {link} END"
    )


def snippet(x: str) -> str:
    head = f"regexp_extract(substr({x}, 1, 201), '(?s)^(.{{151,200}})[.!? ]', 1)"
    return f"CASE WHEN len({x}) <= 200 THEN {x} ELSE (CASE WHEN {head} <> '' THEN {head} ELSE substr({x}, 1, 150) END) || '...' END"


# URLs

PARTS = "(?is)^(https?)://([^/?#:]*)(?::([^/?#]*))?(/[^?#]*)?(?:\\?([^#]*))?"
HREF = "(?is)\\bhref\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')"
LINKS = f"""{P}, an AS (SELECT page_id, url AS base, unnest(regexp_extract_all({no_comments('html')}, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS a, generate_subscripts(regexp_extract_all({no_comments('html')}, '(?is)<a\\b[^>]*>.*?</a\\s*>'), 1) AS i FROM p),
        ah AS (SELECT *, {entities(f"(regexp_extract(regexp_extract(a, '(?is)^<a[^>]*>'), '{HREF}', 1) || regexp_extract(regexp_extract(a, '(?is)^<a[^>]*>'), '{HREF}', 2))")} AS href FROM an),
        al AS (SELECT page_id, i, {resolve('href', 'base')} AS url, {trimmed(entities("regexp_replace(regexp_replace(a, '(?s)([^<>]+)(<)', '\\1 \\2', 'g'), '(?s)<[^>]*>', '', 'g')"))} AS anchor_text FROM ah WHERE href <> '' AND NOT regexp_matches(href, '^(?:#|javascript:|mailto:)'))"""
ENCODED = fx.values(fx.ENCODED)
BOTH = f"{P}, u AS (SELECT page_id, url FROM p UNION ALL SELECT -column0, column1 FROM {ENCODED})"


def url_parts(source: str) -> str:
    part = lambda n: f"regexp_extract(url, '{PARTS}', {n})"
    return f"""SELECT *, {low(part(1))} AS scheme, {low(part(2))} AS host, coalesce(TRY_CAST(regexp_extract({part(3)}, '^-?\\d{{1,9}}') AS BIGINT), -1) AS port,
        CASE WHEN {part(4)} = '' THEN '/' ELSE {part(4)} END AS path, {part(5)} AS query FROM {source} WHERE regexp_matches(url, '{PARTS}')"""


_PLAIN = [(f"%{b:02X}", chr(b)) for b in range(33, 127) if chr(b).isalnum() or chr(b) in "-._~"]


def decoded(x: str) -> str:
    """Pieces from one % to the next, so that what decoding makes is not decoded again."""
    cases = " ".join(f"WHEN '{h}' THEN '{c}' || substr(q, 4)" for h, c in _PLAIN)
    return f"regexp_extract({x}, '^[^%]*') || array_to_string(list_transform(regexp_extract_all({x}, '%[^%]*'), lambda q: CASE upper(substr(q, 1, 3)) {cases} ELSE q END), '')"


def normalised(source: str, key: str, out: str = "normalized") -> str:
    port = "CASE WHEN port = -1 OR (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN '' ELSE ':' || port END"
    return f"SELECT s.{key}, coalesce(scheme || '://' || host || {port} || {decoded('path')} || CASE WHEN query = '' THEN '' ELSE '?' || query END, '') AS {out} FROM {source} s LEFT JOIN ({url_parts(source)}) x USING ({key})"


MT = "(?is)^(https?)://([^/]*)(/.*)?$"


def normalised_mt(x: str) -> str:
    whole = f"regexp_replace({x}, '(?s)#.*$', '')"
    g = lambda n: f"regexp_extract({whole}, '{MT}', {n})"
    scheme, host = low(g(1)), low(g(2))
    bare = f"CASE WHEN {scheme} = 'http' AND len({host}) > 3 THEN regexp_replace({host}, ':80\\z', '') WHEN {scheme} = 'https' AND len({host}) > 4 THEN regexp_replace({host}, ':443\\z', '') ELSE {host} END"
    rest = f"CASE WHEN {g(3)} IN ('', '/') THEN '/' WHEN ends_with({g(3)}, '/') AND NOT contains({g(3)}, '?') THEN substr({g(3)}, 1, len({g(3)}) - 1) ELSE {g(3)} END"
    return f"CASE WHEN regexp_matches({whole}, '{MT}') THEN {scheme} || '://' || {bare} || {rest} ELSE '' END"


def domain_mt(x: str) -> str:
    return low(f"regexp_extract({x}, '(?s)^.*?://([^/:]*)', 1)")


def domain_stored(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '(?s)^.*?://([^/]*)', 1), '^www\\.', '')"


def filtered(x: str = "url") -> tuple[list[tuple[str, str]], str]:
    """(reason, condition) in the order of the rules, and the number of query parameters."""
    query = f"regexp_extract({x}, '(?s)^[^?]*\\?(.*)$', 1)"
    params = f"CASE WHEN {query} = '' THEN 0 ELSE len({query}) - len(replace({query}, '&', '')) + 1 END"
    values_ = " OR ".join(f"contains({low(x)}, '{p}')" for p in LOW_VALUE)
    extensions = " OR ".join(f"ends_with({low(f'split_part({x}, {chr(39)}?{chr(39)}, 1)')}, '.{e}')" for e in EXTENSIONS)
    pages = " OR ".join(f"contains({low(x)}, '{c}{k}=')" for c in "?&" for k in ("page", "p", "offset", "start"))
    return [
        (f"'too long (' || strlen({x}) || ' chars)'", f"strlen({x}) > 256"), ("'not HTTP(S)'", f"NOT (starts_with({x}, 'http://') OR starts_with({x}, 'https://'))"), ("'bad extension'", f"({extensions})"),
        ("'pagination'", f"({pages} OR regexp_matches({low(x)}, '/pages?/\\d+'))"), ("'too many query params'", f"({params}) > 3"), ("'low-value pattern'", f"({values_})"),
    ], params


# Dates

MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def stamp(y: str, m: str, d: str) -> str:
    y, m, d = (f"TRY_CAST({x} AS INTEGER)" for x in (y, m, d))
    good = f"{y} BETWEEN 1970 AND 2100 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
    return f"coalesce(CASE WHEN {good} THEN (date_diff('day', DATE '1970-01-01', make_date({y}, {m}, 1)) + {d} - 1) * 86400 + 43200 END, 0)"


def month(x: str) -> str:
    return f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({x}, 1, 3)))"


def iso(x: str, pattern: str = "(\\d{4})-(\\d{2})-(\\d{2})") -> str:
    return stamp(*(f"regexp_extract({x}, '{pattern}', {n})" for n in (1, 2, 3)))


def said(x: str, before: str = "") -> str:
    g = lambda n: f"regexp_extract({x}, '(?i){before}{MONTH}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})', {n})"
    return stamp(g(3), month(g(1)), g(2))


def in_url(x: str) -> str:
    path = "/(\\d{4})/(\\d{1,2})(?:/(\\d{1,2}))?/"
    g = lambda n: f"regexp_extract({x}, '{path}', {n})"
    return f"CASE WHEN regexp_matches({x}, '{path}') THEN {stamp(g(1), g(2), f'CASE WHEN {g(3)} = {chr(39)}{chr(39)} THEN {chr(39)}1{chr(39)} ELSE {g(3)} END')} ELSE {iso(x)} END"


def positive(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(greatest({x}, 0), 0)" for x in xs) + ", 0)"


def any_date(x: str) -> str:
    return positive(iso(x), said(x), in_url(x))


def in_content(x: str) -> str:
    """For texts under 100 bytes."""
    loose = "(\\d{4})-(\\d{1,2})-(\\d{1,2})"
    label, other = "(?:published|posted|written|authored)(?:\\s+on)?[:\\s]+", "(?:date|updated|modified|last\\s+updated|last\\s+modified)[:\\s]+"
    year = lambda p, n: f"TRY_CAST(regexp_extract({x}, '{p}', {n}) AS INTEGER) BETWEEN 1995 AND 2030"
    whole, short = f"(?i){MONTH}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})", f"(?i){MONTH}\\s+(\\d{{4}})"
    first = f"CASE WHEN regexp_matches({x}, '(?i){label}{loose}') THEN {iso(x, f'(?i){label}{loose}')} ELSE {said(x, label)} END"
    alone = f"CASE WHEN {year(whole, 3)} THEN {said(x)} WHEN {year('(\\d{4})-(\\d{2})-(\\d{2})', 1)} THEN {iso(x)} ELSE 0 END"
    near = f"len(regexp_extract({x}, '(?is)^(.*?){MONTH}\\s+\\d{{4}}', 1)) <= 20 + len(regexp_extract({x}, '^[ \\t\\n\\r]*'))"
    begun = f"CASE WHEN regexp_matches({x}, '{short}') AND {near} AND {year(short, 2)} THEN {stamp(f'regexp_extract({x}, {chr(39)}{short}{chr(39)}, 2)', month(f'regexp_extract({x}, {chr(39)}{short}{chr(39)}, 1)'), '15')} ELSE 0 END"
    c = "(?i)(?:©|\\(c\\)|copyright)\\s*(\\d{4})"
    owned = f"CASE WHEN {year(c, 1)} THEN {stamp(f'regexp_extract({x}, {chr(39)}{c}{chr(39)}, 1)', '7', '1')} ELSE 0 END"
    return positive(first, iso(x, f"(?i){other}{loose}"), alone, begun, owned)


DATED = "o AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR AS DATE) AS day FROM orders)"
CUT = 1669766400


def era(t: str) -> str:
    return f"CASE WHEN {t} <= 0 THEN 'unknown' WHEN {t} < {CUT} THEN 'pre-ai' ELSE 'post-ai' END"


def with_era(t: str) -> str:
    day = f"strftime(make_timestamp(({t}) * 1000000), '%b %-d, %Y')"
    return f"CASE WHEN {t} <= 0 THEN '[Date: Unknown]' ELSE '[' || {day} || CASE WHEN {t} < {CUT} THEN ' · Pre-AI ✓]' ELSE ' · Post-AI]' END END"


# Page table

CRAWLED = f"""{P}, c0 AS (SELECT url, max(page_id) AS i, arg_max(html, page_id) AS html FROM p GROUP BY url),
        c AS (SELECT url, {domain_stored('url')} AS domain, CASE WHEN i % 7 <> 0 THEN 1700000000 + (i * 7919) % 1000 END AS crawled_at, CAST(CASE WHEN i % 5 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status_code, sha256(html) AS content_hash,
            CAST(strlen(html) AS BIGINT) AS content_size, CAST(NULL AS DOUBLE) AS ai_score, CAST(NULL AS VARCHAR) AS era, i % 3 = 0 AS indexed FROM c0)"""
BATCH = "c WHERE crawled_at IS NOT NULL AND status_code = 200 AND NOT indexed ORDER BY crawled_at, url LIMIT 20"

# Robots

ROBOTS = f"""rf AS (SELECT column0 AS domain, column1 AS content FROM {fx.values(fx.ROBOTS)}),
        r0 AS (SELECT domain, unnest(l) AS line, unnest(range(0, len(l))) AS seq FROM (SELECT domain, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM rf)),
        r1 AS (SELECT domain, seq, lower(trim(split_part(line, ':', 1))) AS directive, trim(regexp_replace(trim(regexp_extract(line, '^[^:]*:(.*)$', 1)), '#.*$', '')) AS value FROM r0 WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, ':')),
        r2 AS (SELECT *, CASE WHEN directive = 'user-agent' AND coalesce(lag(directive) OVER (PARTITION BY domain ORDER BY seq), 'x') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM r1 WHERE directive IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
        r3 AS (SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY seq) AS grp FROM r2),
        ra AS (SELECT DISTINCT domain, grp, lower(value) AS agent FROM r3 WHERE directive = 'user-agent'),
        rules AS (SELECT domain, agent, seq, directive = 'allow' AS allow, value AS path FROM ra JOIN r3 USING (domain, grp) WHERE directive IN ('allow', 'disallow')),
        rd AS (SELECT domain, grp, seq, TRY_CAST(regexp_extract(value, '^[+-]?\\d{{1,9}}') AS BIGINT) AS delay FROM r3 WHERE directive = 'crawl-delay'),
        agents AS (SELECT domain, agent, coalesce(arg_max(delay, seq) FILTER (delay IS NOT NULL), -1) AS crawl_delay FROM ra LEFT JOIN rd USING (domain, grp) GROUP BY domain, agent)"""


def allowed(bot: str) -> str:
    path = "CASE WHEN NOT contains(url, '://') THEN url WHEN regexp_extract(url, '^.*?://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^.*?://[^/]*(/.*)$', 1) END"
    return f"""SELECT id, '{bot}' AS bot, coalesce((SELECT arg_max(allow, len(path) * 2 + allow::INT) FROM rules WHERE rules.domain = w.domain AND rules.agent = w.agent AND path <> '' AND starts_with(w.at, path)), TRUE) AS allowed,
        coalesce((SELECT crawl_delay FROM agents WHERE agents.domain = w.domain AND agents.agent = w.agent), -1) AS crawl_delay
        FROM (SELECT column0 AS id, column1 AS domain, {path.replace('url', 'column2')} AS at, (SELECT arg_max(agent, agent = '{bot.lower()}') FROM agents WHERE agents.domain = column1 AND agent IN ('{bot.lower()}', '*')) AS agent FROM {fx.values(fx.ROBOTS_URLS)}) w"""


RULES_, PARAMS_ = filtered()
PAGE_INDEX = f"""{P}, pd AS (SELECT page_id AS doc_id, url, {html_title()} AS title, {html_text()} AS text FROM p),
        d AS (SELECT doc_id, text FROM pd),
        calls AS (SELECT doc_id, 1 AS field, title AS text FROM pd UNION ALL SELECT doc_id, 0, text FROM pd UNION ALL SELECT doc_id, 4, url FROM pd),
        tok AS (SELECT doc_id, field, unnest(range(0, len(k))) AS position, unnest(k) AS token FROM (SELECT doc_id, field, {kept('text')} AS k FROM calls)),
        {stem_ctes('tok')}, {POST}, terms AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term)"""
AVERAGE = "(SELECT doc_id, coalesce(dl, 0) AS dl FROM d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM post GROUP BY doc_id) USING (doc_id))"

#: Events as frontier entries.
ENTRIES = "SELECT 'http://h' || user_id || '.test/' || event_id AS url, 'h' || user_id || '.test' AS domain, event_id % 4 AS priority, event_id AS seq FROM events"

ORACLES = {
    "normalize": f"WITH {D} SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS normalized, {low('text')} AS lowered FROM d",
    "tokenize_plain": f"WITH {D} SELECT doc_id, array_to_string({WORDS.format('text')}, ',') AS tokens FROM d",
    "stop_words": f"WITH {D} SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS word FROM d) WHERE word IN ({quoted(STOP_WORDS)}) GROUP BY word",
    "stem_vocab": f"WITH {D}, {TOK}, {stem_ctes('tok')} SELECT token, stem FROM stems",
    "snippet": f"WITH {D} SELECT doc_id, {snippet('text')} AS snippet FROM d",
    "trim_whitespace": f"""WITH {D} SELECT doc_id, {trimmed("' ' || chr(9) || chr(10) || text || chr(12) || chr(10) || ' '")} AS trimmed FROM d""",
    "eras": """SELECT era, CASE WHEN lower(era) IN ('pre-ai', 'preai', 'pre_ai', 'human') THEN 'PRE_AI' WHEN lower(era) IN ('transition', 'trans') THEN 'TRANSITION' WHEN lower(era) IN ('ai-era', 'ai_era', 'aiera', 'ai') THEN 'AI_ERA' END AS parsed,
        CASE WHEN lower(era) IN ('pre-ai', 'preai', 'pre_ai', 'human') THEN 'Pre-AI' WHEN lower(era) IN ('transition', 'trans') THEN 'Transition' WHEN lower(era) IN ('ai-era', 'ai_era', 'aiera', 'ai') THEN 'AI-Era' ELSE 'Unknown' END AS display,
        CASE WHEN lower(era) IN ('pre-ai', 'pre_ai', 'preai') THEN 'PRE_AI' WHEN lower(era) IN ('post-ai', 'post_ai', 'postai', 'ai-era', 'ai_era', 'aiera') THEN 'AI_ERA' ELSE 'UNKNOWN' END AS stored
        FROM (VALUES ('pre-ai'), ('PreAI'), ('pre_ai'), ('human'), ('trans'), ('Transition'), ('ai-era'), ('aiera'), ('AI'), ('post-ai'), (''), ('x')) t(era)""",
    "tokenize_positions": f"""WITH {D}, v AS (SELECT doc_id, regexp_extract_all(text, '[^A-Za-z0-9]*[A-Za-z0-9]+') AS runs FROM d),
        w AS (SELECT doc_id, unnest(runs) AS run, unnest(range(0, len(runs))) AS i FROM v),
        x AS (SELECT doc_id, i, regexp_extract(run, '[A-Za-z0-9]+') AS original, sum(strlen(run)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM w)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, original, CAST(e - len(original) AS BIGINT) AS char_offset, lower(original) AS token FROM x
        WHERE len(original) <= 100 AND lower(original) NOT IN ({quoted(STOP_WORDS)})""",
    "postings_body": f"WITH {INDEX} SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM post",
    "token_df": f"WITH {INDEX} SELECT term, df FROM terms",
    "doc_length": f"WITH {INDEX} SELECT doc_id, count(*) AS doc_length FROM post GROUP BY doc_id",
    "avgdl_sample100": f"WITH {INDEX} SELECT (SELECT count(*) FROM d) AS doc_count, (SELECT count(*) FROM terms) AS term_count, (SELECT round(avg(dl), 6) FROM (SELECT dl FROM {AVERAGE} ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100)) AS avgdl",
    "avgdl_exact": f"WITH {INDEX} SELECT (SELECT count(*) FROM d) AS doc_count, (SELECT count(*) FROM terms) AS term_count, (SELECT round(avg(dl), 6) FROM {AVERAGE}) AS avgdl",
    "idf": f"WITH {INDEX} SELECT term, round(ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms",
    "remove_document": f"WITH {INDEX} SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE doc_id % 3 <> 0 GROUP BY term",
    "merge_index": f"""WITH {INDEX.replace("SELECT doc_id, coalesce(text, '') AS text FROM documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(translate(coalesce(text, ''), 'äöüéèêçàñóíáúß', '--------------')) || ' appended' ELSE coalesce(text, '') END AS text FROM documents")} SELECT term, df FROM terms""",
    "multi_field_index": f"WITH {PAGE_INDEX} SELECT term, CAST(field AS BIGINT) AS field, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY term, field",
    "is_indexed": f"WITH {INDEX} SELECT doc_id, count(*) AS doc_length, 'unknown' AS era, '' AS domain FROM post WHERE doc_id IN (0, 5, 77) GROUP BY doc_id",
    "bm25_or": f"WITH {ranked(FLAG)} {SCORED}",
    "bm25_topk": f"WITH {ranked(FLAG)} SELECT doc_id, round(score, 6) AS score, {snippet('text')} AS snippet FROM (SELECT * FROM m ORDER BY score DESC, doc_id LIMIT 10) JOIN d USING (doc_id)",
    "repeated_terms": f"WITH {ranked({'thing': 2, 'attion': 1}, having=f'{pos('attion')} IS NOT NULL')} {SCORED}",
    "exclusion": f"WITH {ranked({'attion': 1}, ['thing'])} {SCORED}",
    "phrase_pairwise": f"WITH {ranked({'ci': 2, 'nci': 2, 'n': 1, 'de': 1}, having=adjacent('ci', 'nci') + ' AND ' + adjacent('nci', 'n'))} {SCORED}",
    "phrase_contiguous": f"WITH {ranked({'ci': 1, 'nci': 1, 'n': 1}, having=RUN)} {SCORED}",
    "ai_filter_max": f"WITH {ranked({'attion': 1}, where='ai_score <= 0.1')} {SCORED}",
    "ai_filter_min": f"WITH {ranked({'attion': 1, 'thing': 1}, where='ai_score >= 0.1')} {SCORED}",
    "ai_penalty": f"WITH {D}, {ai_ctes('d')} SELECT doc_id, round(ai_score * 0.2, 6) AS penalty, round(10 * (1 - ai_score * 0.2), 6) AS final FROM ai",
    "tokenize_stemmed": f"WITH {D}, {TOK}, {stem_ctes('tok')} SELECT stem AS term, count(*) AS n, max(position) AS last FROM tok JOIN stems USING (token) GROUP BY stem",
    "range_size": "SELECT CAST(sum(strlen('c:' || c_custkey) + strlen(c_name)) AS BIGINT) AS bytes FROM customer WHERE 'c:' || c_custkey >= 'c:2' AND 'c:' || c_custkey < 'c:5'",
    "result_totals": f"WITH {ranked(FLAG)} SELECT count(*) AS total_matches, CAST(ceil(count(*) / 7.0) AS BIGINT) AS total_pages FROM m",
    "pagination": f"WITH {ranked(FLAG)} SELECT doc_id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM (SELECT * FROM m ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5)",
    "site_filter": f"WITH {ranked({'thing': 1, 'onth': 1}, where="(domain = 'example.com' OR ends_with(domain, '.example.com'))", index=PAGE_INDEX, docs=f"SELECT doc_id, 'unknown' AS era, {domain_stored('url')} AS domain FROM pd")} {SCORED}",
    "era_filter": f"WITH {ranked({'attion': 1}, where="era = 'post-ai'", docs="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pre-ai' WHEN doc_id % 3 = 1 THEN 'post-ai' ELSE 'unknown' END AS era, '' AS domain FROM d")} {SCORED}",
    "ai_vocab": f"WITH {REWRITTEN}, {ai_ctes('e')} SELECT doc_id, round(vocabulary, 6) AS vocabulary FROM ai",
    "ai_uniform": f"WITH {REWRITTEN}, {ai_ctes('e')} SELECT doc_id, round(uniformity, 6) AS uniformity FROM ai",
    "ai_repeat": f"WITH {REWRITTEN}, {ai_ctes('e')} SELECT doc_id, round(repetition, 6) AS repetition FROM ai",
    "ai_score": f"WITH {REWRITTEN}, {ai_ctes('e')} SELECT doc_id, round(ai_score, 6) AS ai_score FROM ai",
    "sentences": f"WITH {D}, {ai_ctes('d')} SELECT doc_id, n_sentences AS n, n_paragraphs AS paragraphs FROM ai",
    "html_lenient": """SELECT page_id, 'T' || page_id || ' — café ’A© &nosuch;' AS title, 'icon Head ' || page_id || ' one &amp; two Sub ' || page_id || ' More first second none' AS text_content,
        'Head ' || page_id || ',More' AS h1, 'Sub ' || page_id AS h2, 'http://h.test/x/' || page_id || ' first,http://h.test/y?a=1&b=2 second' AS links FROM pages""",
    "heading_postings": """SELECT page_id AS doc_id, term, field, tf, positions, 4 AS doc_length
        FROM pages, (VALUES ('head', 2, 1, '0'), ('sub', 3, 1, '0')) v(term, field, tf, positions)""",
    "title": f"WITH {P} SELECT page_id, {html_title()} AS title FROM p",
    "text": f"WITH {P}, x AS (SELECT page_id, {html_text()} AS text FROM p) SELECT page_id, text, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word_count FROM x",
    "html_tree": f"WITH {LINKS} SELECT p.page_id, {html_title()} AS title, {html_text()} AS text, (SELECT count(*) FROM al WHERE al.page_id = p.page_id AND al.url <> '') AS link_count FROM p",
    "links": f"WITH {LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url, anchor_text FROM al WHERE url <> ''",
    "hrefs": f"""WITH {P}, h AS (SELECT page_id, url AS base, unnest(l) AS href, unnest(range(0, len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1) AS l FROM p)),
        r AS (SELECT page_id, i, {resolve('href', 'base')} AS url FROM h WHERE NOT regexp_matches(href, '^(?:#|javascript:|mailto:)')) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url FROM r WHERE url <> ''""",
    "meta_tags": "SELECT page_id, 'About & ' || page_id AS description, '2021-05-0' || (page_id % 9 + 1) || 'T00:00:00Z' AS published, CAST(2 AS BIGINT) AS n FROM pages",
    "url_parse": f"WITH {BOTH} SELECT u.page_id, scheme, host, port, path, query FROM u LEFT JOIN ({url_parts('u')}) x USING (page_id)",
    "url_normalize": f"WITH {P} {normalised('p', 'page_id')}",
    "percent_decode": f"WITH n AS (SELECT column0 AS id, column1 AS url FROM {ENCODED}) {normalised('n', 'id')}",
    "url_normalize_mt": f"WITH {BOTH} SELECT page_id, {normalised_mt('url')} AS normalized FROM u",
    "domain_variants": f"""WITH {BOTH}, x AS ({url_parts('u')}) SELECT u.page_id, coalesce(host, '') AS frontier, {domain_mt('u.url')} AS mt, {domain_stored('u.url')} AS stored,
        CASE WHEN contains(u.url, '://') THEN regexp_extract(u.url, '^.*?://([^/]*)', 1) ELSE u.url END AS robots FROM u LEFT JOIN x USING (page_id)""",
    "link_resolve": f"WITH {P}, l AS (SELECT page_id, url, unnest(['http://x.test/a', '//cdn.test/b', '/c', 'd/e', '../f', '?g=1', '']) AS link FROM p) SELECT page_id, link, {resolve('link', 'url')} AS resolved FROM l",
    "url_filter": f"""WITH {P}, l AS (SELECT page_id, url AS base, unnest(range(0, 7)) AS k, unnest(['', '.PDF', '/pages/3', '?a=1&b=2&c=3&d=4', '/Login', '?x=1&offset=2', '/' || repeat('z', 240)]) AS e FROM p),
        u AS (SELECT page_id * 10 + k AS id, base || e AS url FROM l) SELECT id, NOT ({' OR '.join(c for _, c in RULES_)}) AS acceptable, CASE {' '.join(f'WHEN {c} THEN {r}' for r, c in RULES_)} ELSE 'unknown' END AS reason, CAST({PARAMS_} AS BIGINT) AS params,
        contains(url, 'test-') OR contains(url, 'example.com') AS test_url FROM u""",
    "make_timestamp": f"SELECT o_orderkey, {stamp('o_orderkey % 200 + 1940', 'o_orderkey % 14', 'o_orderkey % 33')} AS t FROM orders",
    "parse_dates": f"""WITH {DATED}, x AS (SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS iso, strftime(day, '%B %-d, %Y') AS said, 'http://h.test/' || strftime(day, '%Y/%-m/%-d') || '/x' AS path FROM o),
        y AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN said ELSE path END AS one FROM x) SELECT o_orderkey, {iso('iso')} AS iso, {said('said')} AS said, {in_url('path')} AS path, {any_date('one')} AS any FROM y""",
    "era_string": f"WITH {DATED}, x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE date_diff('day', DATE '1970-01-01', day) * 86400 END AS t FROM o) SELECT o_orderkey, {era('t')} AS era, {with_era('t')} AS shown, t > 0 AND t < {CUT} AS pre, t >= {CUT} AS post FROM x",
    "content_date": f"SELECT column0 AS id, {in_content('column1')} AS t FROM {fx.values(fx.CONTENT)}",
    "best_date": f"""WITH {DATED}, x AS (SELECT o_orderkey, o_orderkey % 4 AS k, (date_diff('day', DATE '1970-01-01', day)) * 86400 + 43200 AS t, date_diff('day', DATE '1970-01-01', date_trunc('month', day)) * 86400 + 43200 AS m FROM o),
        y AS (SELECT o_orderkey, CASE k WHEN 0 THEN t WHEN 1 THEN m WHEN 2 THEN t ELSE 0 END AS published, CASE k WHEN 3 THEN t ELSE 0 END AS modified FROM x)
        SELECT o_orderkey, published, modified, {era("CASE WHEN published > 0 THEN published ELSE modified END")} AS era FROM y""",
    "format_results": f"""WITH {P}, x AS (SELECT page_id, url, {html_title()} AS title, {html_text()} AS text, (page_id % 4) * 556590000 AS t, (page_id % 7) / 20.0 AS a FROM p), y AS (SELECT *, regexp_replace(translate({snippet('text')}, chr(10) || chr(13) || chr(9), '   '), ' +', ' ', 'g') AS s FROM x)
        SELECT page_id, CASE WHEN title = '' THEN '(No title)' WHEN len(title) > 60 THEN substr(title, 1, 57) || '...' ELSE title END AS title, CASE WHEN len(url) > 65 THEN substr(url, 1, 62) || '...' ELSE url END AS url,
        {with_era('t')} || CASE WHEN NOT (t > 0 AND t < {CUT}) AND a > 0.01 THEN '  AI: ' || CAST(floor(CAST(a AS DOUBLE) * 100) AS BIGINT) || '%' ELSE '' END AS line, CASE WHEN len(s) > 100 THEN substr(s, 1, 97) || '...' ELSE s END AS snippet FROM y""",
    "content_hash": f"WITH {P} SELECT page_id, sha256(html) AS content_hash, substr(md5(url), 1, 16) || '.html' AS key FROM p",
    "page_upsert": f"""WITH {CRAWLED}, b AS (SELECT CASE WHEN len(url) % 4 = 0 THEN url ELSE url || '/new' END AS url, domain, CAST(301 AS BIGINT) AS status_code, 'h' AS content_hash, CAST(7 AS BIGINT) AS content_size, CASE WHEN indexed THEN 0.5::DOUBLE END AS ai_score FROM c WHERE len(url) % 4 < 2)
        SELECT url, coalesce(c.domain, b.domain) AS domain, CASE WHEN c.url IS NOT NULL AND b.url IS NOT NULL THEN 1800000000 ELSE crawled_at END AS crawled_at, coalesce(b.status_code, c.status_code) AS status_code, coalesce(b.content_hash, c.content_hash) AS content_hash,
        coalesce(b.content_size, c.content_size) AS content_size, coalesce(b.ai_score, c.ai_score) AS ai_score, c.era, c.indexed FROM c FULL JOIN b USING (url)""",
    "mark_crawled": f"""WITH {CRAWLED}, b AS (SELECT CASE WHEN len(url) % 2 = 0 THEN url ELSE url || '/new' END AS url FROM c WHERE NOT indexed)
        SELECT url, coalesce(c.domain, {domain_stored('url')}) AS domain, CASE WHEN b.url IS NOT NULL THEN 1800000000 ELSE crawled_at END AS crawled_at, CASE WHEN b.url IS NOT NULL THEN 200 ELSE status_code END AS status_code, CASE WHEN b.url IS NOT NULL THEN 'n' ELSE content_hash END AS content_hash,
        CASE WHEN b.url IS NOT NULL THEN 9 ELSE content_size END AS content_size, ai_score, era, coalesce(indexed, FALSE) AS indexed FROM c FULL JOIN b USING (url)""",
    "unindexed_batch": f"WITH {CRAWLED} SELECT * FROM {BATCH}",
    "mark_indexed": f"WITH {CRAWLED}, b AS (SELECT url FROM {BATCH}) SELECT count(*) AS pages, count(*) FILTER (indexed OR url IN (SELECT url FROM b)) AS indexed FROM c",
    "page_counts": f"WITH {CRAWLED} SELECT count(*) AS pages, count(*) FILTER (indexed) AS indexed FROM c",
    "get_page": f"WITH {CRAWLED} SELECT * FROM c WHERE url = 'https://thther.example.org/en/685'",
    "key_values": "SELECT * FROM (SELECT 'c:' || c_custkey AS key, CASE WHEN c_custkey = 10 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey <> 11) WHERE starts_with(key, 'c:1') ORDER BY key LIMIT 50",
    "count_prefix": "SELECT count(*) AS n FROM customer WHERE starts_with('c:' || c_custkey, 'c:1')",
    "seeds": "SELECT 'http://a.test/' AS url, 'a.test' AS domain UNION ALL SELECT 'http://b.test/x', 'b.test'",
    "robots_rules": f"WITH {ROBOTS} SELECT * FROM rules",
    "robots_agents": f"WITH {ROBOTS} SELECT * FROM agents",
    "robots_allowed": f"WITH {ROBOTS} {allowed('LodeBot')} UNION ALL {allowed('unnamed')}",
    "frontier_dedup": f"""WITH f AS (SELECT column0 AS id, column0 AS seq, column1 AS url, column2 AS priority FROM {fx.values(fx.FRONTIER)}), n AS (SELECT f.seq, f.priority, x.u FROM f JOIN ({normalised('f', 'id', 'u')}) x ON f.id = x.id WHERE u <> '')
        SELECT u AS url, regexp_extract(u, '://([^/:]*)', 1) AS domain, arg_min(priority, seq) AS priority, min(seq) AS seq FROM n WHERE u <> 'http://c.test/' GROUP BY u""",
    "frontier_order": f"""WITH f AS (SELECT column0 AS id, column0 AS seq, column1 AS url, column2 AS priority FROM {fx.values(fx.FRONTIER)}), n AS (SELECT f.seq, f.priority, x.u FROM f JOIN ({normalised('f', 'id', 'u')}) x ON f.id = x.id WHERE u <> ''),
        g AS (SELECT u AS url, regexp_extract(u, '://([^/:]*)', 1) AS domain, arg_min(priority, seq) AS priority, min(seq) AS seq FROM n GROUP BY u) SELECT url, priority, (row_number() OVER (PARTITION BY domain ORDER BY priority, seq) - 1) * 500 AS fetch_at FROM g""",
    "politeness_schedule": "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS domain, 1000 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id) - 1) * 1000 AS fetch_at FROM events",
    "domain_cap": f"WITH {P}, x AS (SELECT page_id, {domain_stored('url')} AS domain FROM p) SELECT page_id, domain FROM x QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id) <= 5",
    "top_domains": f"WITH {P} SELECT {domain_stored('url')} AS domain, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, domain LIMIT 10",
    "crawl_round": f"""WITH {P}, x AS (SELECT page_id, url, {domain_mt('url')} AS domain FROM p), n AS (SELECT domain, count(*) AS have FROM x WHERE page_id % 2 = 0 GROUP BY domain)
        SELECT page_id, CASE WHEN {' OR '.join(c for _, c in RULES_)} THEN 'filtered' WHEN coalesce(have, 0) >= 4 THEN 'domain limit' WHEN ends_with(domain, 'example.org') AND regexp_matches(url, '^.*?://[^/]*/fr') THEN 'robots' ELSE 'fetch' END AS decision,
        CAST(CASE WHEN ends_with(domain, 'example.org') THEN 3000 ELSE 1000 END AS BIGINT) AS delay_ms FROM x LEFT JOIN n USING (domain)""",
    "new_links": f"WITH {LINKS}, u AS (SELECT DISTINCT url FROM al WHERE url <> '' AND NOT ({' OR '.join(c for _, c in RULES_)})), v AS (SELECT DISTINCT {normalised_mt('url')} AS n FROM u) SELECT n AS url, {domain_mt('n')} AS domain FROM v WHERE n <> '' AND n NOT IN (SELECT {normalised_mt('url')} FROM p)",
    "frontier_saved": f"SELECT url, domain, priority, seq AS added_at FROM ({ENTRIES})",
    "frontier_exported": f"SELECT url, 0 AS priority, seq FROM ({ENTRIES}) WHERE priority = 3",
    "next_url": f"WITH e AS ({ENTRIES}) SELECT url, seq FROM e WHERE domain NOT IN (SELECT domain FROM e WHERE seq % 97 = 0) ORDER BY priority, seq LIMIT 1",
    "frontier_counters": f"WITH e AS ({ENTRIES}) SELECT count(DISTINCT domain) FILTER (seq % 10 <> 0) AS urls_added, count(*) FILTER (seq % 10 <> 0) - count(DISTINCT domain) FILTER (seq % 10 <> 0) AS duplicates_rejected, count(*) FILTER (seq % 10 = 0) AS invalid FROM e",
    "crawl_counters": f"""SELECT count(*) FILTER (seq % 3 <> 0 AND seq % 4 <> 0) AS crawled, count(*) FILTER (seq % 3 <> 0 AND seq % 4 = 0) AS failed, count(*) FILTER (seq % 3 = 0) AS filtered,
        CAST(coalesce(sum(seq % 1000) FILTER (seq % 3 <> 0 AND seq % 4 <> 0), 0) AS BIGINT) AS bytes, CAST(sum(seq % 9) AS BIGINT) AS links_found, CAST(sum(seq % 5) AS BIGINT) AS links_accepted FROM ({ENTRIES})""",
    "robots_cache": f"SELECT domain, CASE WHEN max(seq) % 5 = 0 THEN '' ELSE '# ' || max(seq) END AS content FROM ({ENTRIES}) GROUP BY domain",
    "seed_list": f"WITH {P} SELECT page_id, trim(url) || e AS url FROM p, (VALUES (''), ('/b')) v(e) WHERE trim(url) || e <> ''",
    "latest_versions": "SELECT page_id, 'text ' || arg_max(v, (v * (page_id % 5 + 1)) % 11) AS html FROM pages, (VALUES (2), (7), (5)) x(v) GROUP BY page_id",
    "batch_search": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - item_id, coalesce(text, '') FROM benchmark), {TOK}, {stem_ctes('tok')}, {POST},
        dd AS (SELECT * FROM d WHERE doc_id >= 0), {ai_ctes('dd')},
        tt AS (SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE doc_id >= 0 GROUP BY term), len0 AS (SELECT doc_id, count(*) AS dl FROM post GROUP BY doc_id),
        docs AS (SELECT dd.doc_id, coalesce(dl, 0) AS dl, ai_score FROM dd LEFT JOIN len0 USING (doc_id) LEFT JOIN ai USING (doc_id)),
        st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT avg(dl) FROM (SELECT dl FROM docs ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100)) AS avgdl),
        q AS (SELECT -1 - doc_id AS query_id, term, sum(tf) AS times FROM post WHERE doc_id < 0 GROUP BY ALL), f AS (SELECT term, doc_id, sum(tf) AS tf FROM post WHERE doc_id >= 0 GROUP BY term, doc_id),
        s AS (SELECT query_id, f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * times) * (1 - 0.2 * any_value(ai_score)) AS score
            FROM f JOIN q USING (term) JOIN tt USING (term) JOIN docs ON docs.doc_id = f.doc_id, st GROUP BY query_id, f.doc_id)
        SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""",
    "parsed_queries": """SELECT * FROM (VALUES
        ('bitcoin price', 'bitcoin price', '', '', NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), NULL),
        ('bitcoin era:pre-ai ai:<0.3', 'bitcoin', '', '', 'PRE_AI', 0.3, NULL, NULL),
        ('price site:Example.com -scam', 'price', '', 'scam', NULL, NULL, NULL, 'example.com'),
        ('"machine learning" the basics', 'basic', 'machine learning', '', NULL, NULL, NULL, NULL),
        ('a:b -x: ai:2 e-mail', 'ab ai2 email', '', 'x', NULL, NULL, NULL, NULL),
        ('', '', '', '', NULL, NULL, NULL, NULL),
        ('open "quote running', 'open quot run', '', '', NULL, NULL, NULL, NULL),
        ('era:post-ai ai:0.5 ai:>0.2', 'erapostai', '', '', NULL, 0.5, 0.2, NULL)
        ) v("query", terms, phrases, excluded, era, max_ai, min_ai, site)""",
}
