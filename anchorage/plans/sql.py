"""The same queries in DuckDB SQL."""

from ..functions.text import OTHER_NAMESPACES
from ..operators.annotate import SEARCH
from .queries import BLACK_P, MIN_LINKS, MIN_TOTAL, THRESHOLD, WHITE_P, WHITE_SHARE, WHITE_TOTAL

_W = r"[\p{L}\p{N}_]"
_WORDS = rf"{_W}+(?:[''\-]{_W}+)*"
_NAMES = ", ".join(f"'{n}'" for n in OTHER_NAMESPACES)

_PAGES = r"""
pg AS (SELECT page_id, regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g') AS text FROM pages)
"""
_LINKS = (
    _PAGES
    + r""",
inn AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(nfc_normalize(text), '(?s)\[\[(.*?)\]\]', 1)), '^\s+|\s+$', '', 'g') AS x FROM pg),
ta AS (SELECT page_id, CASE WHEN strpos(x, '|') > 0 THEN trim(substr(x, 1, strpos(x, '|') - 1)) ELSE x END AS target,
  CASE WHEN strpos(x, '|') > 0 THEN trim(substr(x, strpos(x, '|') + 1)) ELSE x END AS anchor0 FROM inn),
lk AS (SELECT page_id, target, CASE WHEN anchor0 = '' THEN target ELSE anchor0 END AS anchor FROM ta
  WHERE target <> '' AND (strpos(target, ':') <= 1 OR lower(trim(split_part(target, ':', 1))) NOT IN ("""
    + _NAMES
    + r"""))),
sf AS (SELECT page_id, trim(regexp_replace(trim(target, '[] '), '\s+', ' ', 'g')) AS target, trim(regexp_replace(trim(anchor, '[] '), '\s+', ' ', 'g')) AS anchor FROM lk),
cnt AS (SELECT anchor, count(*) AS freq_link FROM sf WHERE length(anchor) >= 2 AND regexp_matches(anchor, '[\p{L}\p{N}]') GROUP BY anchor)
"""
)
_PAIRS = _LINKS + f""",
prs AS (SELECT anchor, target, count(*) AS pair_count FROM sf WHERE target <> '' AND anchor IN (SELECT anchor FROM cnt WHERE freq_link >= {MIN_LINKS}) GROUP BY ALL)
"""
_TOP = _PAIRS + """,
top AS (SELECT anchor, arg_min(target, (-pair_count, target)) AS target, max(pair_count) / sum(pair_count) AS target_share FROM prs GROUP BY anchor)
"""


def _plain(source: str, bounded_only: bool) -> str:
    """Counts by runs of word characters; or any occurrence of patterns without boundaries."""
    split = rf"regexp_extract_all(regexp_replace(text, '(?s)\[\[.*?\]\]', ' ', 'g'), '({_W}+|[^\p{{L}}\p{{N}}_]+)')"
    out = rf""",
pc AS (SELECT {split} AS p FROM {source}),
pat AS (SELECT anchor, regexp_full_match(anchor, '(?s){_W}(.*{_W})?') AS bounded, regexp_extract_all(anchor, '({_W}+|[^\p{{L}}\p{{N}}_]+)') AS q FROM cnt WHERE freq_link >= {MIN_LINKS}),
g1 AS (SELECT g, count(*) AS n FROM (SELECT unnest(p) AS g FROM pc) GROUP BY g),
gn AS (SELECT anchor, count(*) AS n FROM (SELECT p, unnest(p) AS g, generate_subscripts(p, 1) AS i FROM pc) JOIN pat ON g = q[1] AND bounded AND len(q) > 1 AND p[i : i + len(q) - 1] = q GROUP BY anchor),
hit AS (SELECT anchor, n AS freq_text FROM g1 JOIN pat ON g = anchor AND bounded UNION ALL SELECT anchor, n FROM gn"""
    if not bounded_only:
        out += rf"""
  UNION ALL SELECT anchor, CAST(sum((length(x) - length(replace(x, anchor, ''))) // length(anchor)) AS BIGINT) AS freq_text
  FROM (SELECT regexp_replace(text, '(?s)\[\[.*?\]\]', ' ', 'g') AS x FROM {source}) JOIN pat ON NOT bounded AND contains(x, anchor) GROUP BY anchor"""
    return out + ")\n"


_STATS = _TOP + _plain("pg", False) + f""",
st AS (SELECT anchor, freq_link, coalesce(freq_text, 0) AS freq_text, freq_link + coalesce(freq_text, 0) AS total,
  freq_link / (freq_link + coalesce(freq_text, 0)) AS p_link
  FROM cnt LEFT JOIN hit USING (anchor) WHERE freq_link + coalesce(freq_text, 0) >= {MIN_TOTAL})
"""
_ARTICLES = r"""
ar AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[a-z]*(?:tion|ung|eau|ción)', '[[\0]]', 'g'), '\n', E'\n\n', 'g') AS text FROM documents)
"""


def _ratio(x: str) -> tuple[str, str]:
    linked = rf"list_sum(list_transform(regexp_extract_all({x}, '(?s)\[\[(.*?)\]\]', 1), lambda i: len(regexp_extract_all(i, '{_WORDS}'))))"
    gaps = rf"list_sum(list_transform(regexp_split_to_array({x}, '(?s)\[\[.*?\]\]'), lambda g: len(regexp_extract_all(g, '{_WORDS}'))))"
    return f"CAST(coalesce({linked}, 0) AS INT)", f"CAST(coalesce({linked}, 0) + coalesce({gaps}, 0) AS INT)"


def _shown(x: str) -> tuple[str, str]:
    """Words of what links show, with targets apart, and words outside."""
    one = rf"CASE WHEN trim(split_part(i, '|', 1)) = '' THEN 0 WHEN strpos(i, '|') > 0 AND trim(substr(i, strpos(i, '|') + 1)) <> '' THEN len(regexp_extract_all(substr(i, strpos(i, '|') + 1), '{_WORDS}')) ELSE len(regexp_extract_all(split_part(i, '|', 1), '{_WORDS}')) END"
    linked = rf"coalesce(list_sum(list_transform(regexp_extract_all({x}, '(?s)\[\[(.*?)\]\]', 1), lambda i: {one})), 0)"
    gaps = rf"coalesce(list_sum(list_transform(regexp_split_to_array({x}, '(?s)\[\[.*?\]\]'), lambda g: len(regexp_extract_all(g, '{_WORDS}')))), 0)"
    return linked, gaps


_VP, _WP = _shown("p")
_VT, _WT = _shown("text")
_L, _T = _ratio("text")
_LP, _TP = _ratio("p")

_SEG = _PAGES + r""",
ok AS (SELECT page_id, text, regexp_extract_all(text, '\[\[([^\n]*?)\]\]', 1) AS inners, regexp_split_to_array(text, '\[\[[^\n]*?\]\]') AS gaps FROM pg
  WHERE len(list_filter(regexp_extract_all(text, '\[\[([^\n]*?)\]\]', 1), lambda x: length(x) - length(replace(x, '|', '')) > 1)) = 0),
al AS (SELECT page_id, i, 0 AS side, gaps[i] AS x FROM (SELECT page_id, gaps, generate_subscripts(gaps, 1) AS i FROM ok)
  UNION ALL SELECT page_id, i, 1, split_part(inners[i], '|', -1) FROM (SELECT page_id, inners, generate_subscripts(inners, 1) AS i FROM ok)),
sg AS (SELECT page_id, CAST(sum(length(x)) OVER w - length(x) AS INT) AS seg_start, CAST(sum(length(x)) OVER w AS INT) AS seg_end, x AS seg_text, side = 1 AS in_link
  FROM al WINDOW w AS (PARTITION BY page_id ORDER BY i, side)),
raw AS (SELECT page_id, string_agg(seg_text, '' ORDER BY seg_start, seg_end) AS raw FROM sg GROUP BY page_id)
"""
_TOKEN = rf"({_W}+|[^\p{{L}}\p{{N}}_\s])"
_BIO = _SEG + rf""",
tk AS (SELECT page_id, i, length(t[i]) AS n, length(g[i]) AS gap FROM (
  SELECT page_id, t, g, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(raw, '{_TOKEN}') AS t, regexp_split_to_array(raw, '{_TOKEN}') AS g FROM raw))),
tp AS (SELECT page_id, CAST(i AS INT) AS pos, CAST(sum(n + gap) OVER (PARTITION BY page_id ORDER BY i) AS INT) AS tok_end, n FROM tk),
tl AS (SELECT page_id, pos, CAST(tok_end - n AS INT) AS tok_start, tok_end FROM tp),
hl AS (SELECT DISTINCT page_id, pos FROM tl JOIN sg USING (page_id) WHERE in_link AND seg_start < tok_end AND seg_end > tok_start),
bl AS (SELECT tl.*, hl.pos IS NOT NULL AS hit, coalesce(lag(hl.pos IS NOT NULL) OVER (PARTITION BY tl.page_id ORDER BY tl.pos), false) AS before
  FROM tl LEFT JOIN hl ON tl.page_id = hl.page_id AND tl.pos = hl.pos),
bio AS (SELECT page_id, pos, tok_start, tok_end, CASE WHEN NOT hit THEN 0 WHEN before THEN 2 ELSE 1 END AS label FROM bl),
seq AS (SELECT page_id, pos, label FROM bio UNION ALL SELECT page_id, 0, -100 FROM raw UNION ALL
  SELECT raw.page_id, coalesce(max(pos), 0) + 1, -100 FROM raw LEFT JOIN bio ON raw.page_id = bio.page_id GROUP BY raw.page_id),
s1 AS (SELECT page_id, pos, label, CASE WHEN label = 0 AND lag(label) OVER w > 0 AND lead(label) OVER w > 0 THEN 2 ELSE label END AS f, max(pos) OVER (PARTITION BY page_id) AS last
  FROM seq WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
sm AS (SELECT page_id, pos, label, CASE WHEN pos < last - 1 AND f > 0 AND lag(f) OVER w = 0 AND lead(f) OVER w = 0 THEN 0 ELSE f END AS tag FROM s1 WINDOW w AS (PARTITION BY page_id ORDER BY pos))
"""
_PADDED = _BIO + rf""",
wd AS (SELECT page_id, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (SELECT page_id, regexp_extract_all(raw, '{_TOKEN}') AS t FROM raw)),
ids AS (SELECT page_id, pos, CAST(2 + list_sum(list_transform(range(1, least(8, length(w)) + 1), lambda k: unicode(substr(w, CAST(k AS INT), 1)) * CAST(power(31, k - 1) AS BIGINT))) % 32000 AS BIGINT) AS id FROM wd),
ln AS (SELECT raw.page_id, least(510, coalesce(max(pos), 0)) AS n FROM raw LEFT JOIN bio ON raw.page_id = bio.page_id GROUP BY raw.page_id),
pl AS (SELECT page_id, n, unnest(range(0, 512)) AS k FROM ln),
pd AS (SELECT pl.page_id, k, CASE WHEN k = 0 THEN 1 WHEN k = n + 1 THEN 2 WHEN k > n THEN 0 ELSE id END AS id, CASE WHEN k <= n + 1 THEN 1 ELSE 0 END AS mask,
  CASE WHEN k <= n THEN coalesce(tok_start, 0) ELSE 0 END AS ts, CASE WHEN k <= n THEN coalesce(tok_end, 0) ELSE 0 END AS te, CASE WHEN k <= n THEN coalesce(label, -100) ELSE -100 END AS label
  FROM pl LEFT JOIN bio ON bio.page_id = pl.page_id AND bio.pos = k LEFT JOIN ids ON ids.page_id = pl.page_id AND ids.pos = k)
"""


def _unlinked(source: str, p: float) -> str:
    return rf"""
li AS (SELECT page_id, regexp_extract_all(text, '(?s)\[\[(.*?)\]\]', 1) AS i, regexp_split_to_array(text, '(?s)\[\[.*?\]\]') AS g FROM {source}),
lx AS (SELECT page_id, k, g[k] AS gap, i[k] AS x, trim(split_part(i[k], '|', 1)) AS target, CASE WHEN strpos(i[k], '|') > 0 THEN trim(substr(i[k], strpos(i[k], '|') + 1)) ELSE '' END AS anchor
  FROM (SELECT page_id, i, g, generate_subscripts(g, 1) AS k FROM li)),
ly AS (SELECT *, CASE WHEN anchor = '' THEN target ELSE anchor END AS shown FROM lx),
ul AS (SELECT page_id, string_agg(gap || CASE WHEN x IS NULL THEN '' WHEN target <> '' AND trim(regexp_replace(trim(shown, '[] '), '\s+', ' ', 'g')) IN (SELECT anchor FROM st WHERE p_link <= {p}) THEN shown
  ELSE '[[' || x || ']]' END, '' ORDER BY k) AS text FROM ly GROUP BY page_id)
"""


#: Normalise, unlink, find the links that are left, link, and keep the paragraphs that hold links.
_REWRITTEN = _STATS + rf""",
nt AS (SELECT page_id, nfc_normalize(translate(text, chr(160) || '’‘ʼ`´', ' ' || repeat(chr(39), 5))) AS text FROM pg WHERE text <> ''),""" + _unlinked("nt", BLACK_P) + r""",
lz AS (SELECT page_id, regexp_extract_all(text, '(?s)\[\[.*?\]\]') AS i, regexp_split_to_array(text, '(?s)\[\[.*?\]\]') AS g FROM ul),
ls AS (SELECT page_id, CAST(sum(length(g[k]) + length(i[k])) OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS le, length(i[k]) AS n FROM (SELECT *, generate_subscripts(i, 1) AS k FROM lz)),
lspans AS (SELECT page_id, le - n AS ls, le FROM ls),""" + "__MATCHES__" + r""",
rp AS (SELECT page_id, list_filter(list_transform(string_split(text, E'\n\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM al2),
rk AS (SELECT page_id, k, ps[k] AS p FROM (SELECT *, generate_subscripts(ps, 1) AS k FROM rp))
"""


def _matches(source: str, key: str, linked: str = "") -> str:
    """Matches of the whitelist in texts: outside links, from the left, the longest first, none overlapping."""
    outside = f"AND NOT EXISTS (SELECT 1 FROM {linked} AS z WHERE z.{key} = oc.{key} AND z.ls < oc.s + length(anchor) AND z.le > oc.s)" if linked else ""
    return rf"""
wl AS (SELECT anchor, target, regexp_full_match(anchor, '(?s){_W}(.*{_W})?') AS bounded FROM st JOIN top USING (anchor) WHERE p_link >= {WHITE_P} AND total >= {WHITE_TOTAL} AND target_share >= {WHITE_SHARE}),
sp AS (SELECT {key}, text, anchor, target, bounded, string_split(text, anchor) AS p FROM {source} JOIN wl ON contains(text, anchor)),
oc AS (SELECT {key}, text, anchor, target, bounded, k, p, CAST(sum(length(p[k])) OVER (PARTITION BY {key}, anchor ORDER BY k) + (k - 1) * length(anchor) AS BIGINT) AS s
  FROM (SELECT *, generate_subscripts(p, 1) AS k FROM sp)),
mt AS (SELECT {key}, s, s + length(anchor) AS e, target FROM oc WHERE k < len(p) AND (NOT bounded OR
  NOT (s > 0 AND regexp_matches(substr(text, s, 1), '{_W}')) AND NOT regexp_matches(substr(text, s + length(anchor) + 1, 1), '{_W}')) {outside}),
ks AS (SELECT {key}, list_reduce(list_transform(list(struct_pack(s := s, e := e, t := target) ORDER BY s, e DESC), lambda x: [x]),
  lambda a, b: CASE WHEN b[1].s >= a[-1].e THEN list_concat(a, b) ELSE a END) AS m FROM mt GROUP BY {key}),
kp AS (SELECT {key}, generate_subscripts(m, 1) AS i, unnest(m, recursive := true) FROM ks)
"""


def _autolinked(source: str, key: str) -> str:
    return f"""
kq AS (SELECT {key}, i, s, e, t, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY i), 0) AS pe FROM kp),
bd AS (SELECT {key}, string_agg(substr(text, pe + 1, s - pe) || '[[' || t || '|' || substr(text, s + 1, e - s) || ']]', '' ORDER BY i) AS head, max(e) AS last FROM kq JOIN {source} USING ({key}) GROUP BY {key}),
al2 AS (SELECT {key}, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS text FROM {source} LEFT JOIN bd USING ({key}))
"""


_REWRITTEN = _REWRITTEN.replace("__MATCHES__", _matches("ul", "page_id", "lspans") + "," + _autolinked("ul", "page_id"))
_MATCHES = _STATS + "," + _matches("documents", "doc_id")
_AUTOLINKED = _MATCHES + "," + _autolinked("documents", "doc_id")
_HTML = _MATCHES + rf""",
dt AS (SELECT doc_id, i, length(t[i]) AS n, length(g[i]) AS gap FROM (
  SELECT doc_id, t, g, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS t, regexp_split_to_array(text, '{_TOKEN}') AS g FROM documents))),
de AS (SELECT doc_id, i AS pos, CAST(sum(n + gap) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS te, n FROM dt),
dg AS (SELECT de.doc_id, pos, te - n AS ts, CASE WHEN e > te - n THEN CASE WHEN s >= te - n THEN 1 ELSE 2 END ELSE 0 END AS tag FROM de ASOF LEFT JOIN kp ON de.doc_id = kp.doc_id AND de.te > kp.s),
dq AS (SELECT * FROM dg UNION ALL SELECT doc_id, 0, NULL, 0 FROM documents UNION ALL SELECT doc_id, max(pos) + 1, NULL, 0 FROM dg GROUP BY doc_id),
d1 AS (SELECT doc_id, pos, ts, CASE WHEN tag = 0 AND lag(tag) OVER w > 0 AND lead(tag) OVER w > 0 THEN 2 ELSE tag END AS f, max(pos) OVER (PARTITION BY doc_id) AS last FROM dq WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d2 AS (SELECT doc_id, pos, ts, CASE WHEN pos < last - 1 AND f > 0 AND lag(f) OVER w = 0 AND lead(f) OVER w = 0 THEN 0 ELSE f END > 0 AS link FROM d1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d3 AS (SELECT *, coalesce(lag(link) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM d2 WHERE ts IS NOT NULL),
d4 AS (SELECT doc_id, pos, link, ts AS a, lead(ts) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM d3 WHERE link <> before),
d5 AS (SELECT doc_id, pos, text, a, coalesce(b, length(text)) AS b FROM d4 JOIN documents USING (doc_id) WHERE link),
d6 AS (SELECT *, substr(text, a + 1, b - a) AS x, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS pe FROM d5),
hb AS (SELECT doc_id, string_agg(substr(text, pe + 1, a - pe) || '<a href="{SEARCH}' || replace(url_encode(x), '%2F', '/') || '" >' || x || '</a>', '' ORDER BY pos) AS head, max(b) AS last FROM d6 GROUP BY doc_id)
"""
_DUMP = r"""
dp AS (SELECT doc_id AS page_id, 'T' || doc_id AS title, CASE WHEN source = 'src3' THEN '#Redirection ' || text WHEN source = 'src5' THEN '' ELSE text END AS text FROM documents),
dn AS (SELECT DISTINCT 'T' || doc_id AS title FROM labels)
"""
_SQUEEZE = "html"
for _p, _to in (
    (r"(?s)\{\|.*?\|\}", ""), ("''''''", ""), ("''''", ""), ("__[A-Z_]+__", ""), (r"(?m)^[*#;:]+\s*", ""), (r"(?m)^-{4,}\s*$", ""),
    (r"\{\{[^{}]*\}\}", ""), ("&nbsp;", " "), ("&[a-zA-Z]+;", ""), ("&#[0-9]+;", ""), (r"[ \t]+", " "), (r" *\n *", r"\n"), (r"\n{3,}", r"\n\n"),
    (r"(?m)^\s*[,;.:\-–—|()]*\s*$", ""), (r"\n{3,}", r"\n\n"), (r"^\s+|\s+$", ""),
):
    _SQUEEZE = f"regexp_replace({_SQUEEZE}, '{_p}', E'{_to}', 'g')"

ORACLES: dict[str, str] = {
    "link_extract": f"WITH {_LINKS} SELECT page_id, target, anchor FROM lk",
    "link_spans": f"""WITH {_PAGES}, z AS (SELECT page_id, regexp_extract_all(text, '(?s)\\[\\[(.*?)\\]\\]', 1) AS i, regexp_split_to_array(text, '(?s)\\[\\[.*?\\]\\]') AS g FROM pg),
y AS (SELECT page_id, k, i[k] AS inner_text, length(g[k]) AS gap, length(i[k]) + 4 AS n FROM (SELECT *, generate_subscripts(i, 1) AS k FROM z))
SELECT page_id, CAST(sum(gap + n) OVER w - n AS INT) AS span_start, CAST(sum(gap + n) OVER w AS INT) AS span_end, inner_text FROM y WINDOW w AS (PARTITION BY page_id ORDER BY k)""",
    "link_counts": f"WITH {_LINKS} SELECT * FROM cnt",
    "anchor_targets": f"""WITH {_PAIRS} SELECT *, CAST(sum(pair_count) OVER (PARTITION BY anchor) AS BIGINT) AS total_pairs,
CAST(row_number() OVER (PARTITION BY anchor ORDER BY pair_count DESC, target) AS INT) AS rank FROM prs""",
    "top_target": f"WITH {_TOP} SELECT * FROM top",
    "plain_counts": f"WITH {_LINKS} {_plain('pg', False)} SELECT * FROM hit",
    "plain_counts_join": f"WITH {_LINKS} {_plain('documents', True)} SELECT * FROM hit",
    "surface_stats": f"WITH {_STATS} SELECT * FROM st",
    "blacklist": f"WITH {_STATS} SELECT * FROM st WHERE p_link <= {BLACK_P}",
    "whitelist": f"WITH {_STATS} SELECT anchor, target, freq_link, freq_text, total, p_link, target_share FROM st JOIN top USING (anchor) WHERE p_link >= {WHITE_P} AND total >= {WHITE_TOTAL} AND target_share >= {WHITE_SHARE}",
    "norm_text": "SELECT doc_id, nfc_normalize(translate(coalesce(text, ''), chr(160) || '’‘ʼ`´“”„', ' ''''''''''\"\"\"')) AS text FROM documents",
    "word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS INT) AS words FROM documents",
    "link_ratio": f"WITH {_ARTICLES} SELECT doc_id, {_L} AS linked, {_T} AS total, CASE WHEN {_T} > 0 THEN {_L} / {_T} ELSE 0.0 END AS link_ratio FROM ar",
    "paragraph_filter": f"""WITH {_ARTICLES}, q AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\\n\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM ar),
u AS (SELECT doc_id, k, ps[k] AS p FROM (SELECT *, generate_subscripts(ps, 1) AS k FROM q)),
f AS (SELECT doc_id, string_agg(p, E'\\n\\n' ORDER BY k) AS text FROM u WHERE {_TP} > 0 AND {_LP} / {_TP} > {THRESHOLD} GROUP BY doc_id)
SELECT doc_id, text, {_L} / {_T} AS link_ratio FROM f""",
    "strip_links": f"WITH {_PAGES} SELECT page_id, regexp_replace(text, '(?s)\\[\\[.*?\\]\\]', ' ', 'g') AS text FROM pg",
    "strip_markup": f"WITH {_SEG} SELECT page_id, raw FROM raw",
    "segments": f"WITH {_SEG} SELECT * FROM sg WHERE seg_text <> ''",
    "bio_labels": f"WITH {_BIO} SELECT * FROM bio",
    "padded_dataset": f"""WITH {_PADDED} SELECT page_id, string_agg(id, ',' ORDER BY k) AS input, string_agg(mask, ',' ORDER BY k) AS attention_mask, string_agg(ts, ',' ORDER BY k) AS starts,
string_agg(te, ',' ORDER BY k) AS ends, string_agg(label, ',' ORDER BY k) AS output FROM pd GROUP BY page_id""",
    "unlink_blacklist": f"WITH {_STATS}, {_unlinked('pg', 0.3)} SELECT page_id, text FROM ul",
    "rewritten_corpus": f"""WITH {_REWRITTEN}, rf AS (SELECT page_id, string_agg(p, E'\\n\\n' ORDER BY k) AS text FROM rk WHERE {_VP} + {_WP} > 0 AND {_VP} / ({_VP} + {_WP}) > 0.001 GROUP BY page_id)
SELECT page_id, text, CAST({_VT} / ({_VT} + {_WT}) AS FLOAT) AS link_ratio FROM rf""",
    "autolink_whitelist": f"WITH {_AUTOLINKED} SELECT doc_id, text FROM al2",
    "annotate_html": f"WITH {_HTML} SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS html FROM documents LEFT JOIN hb USING (doc_id)",
    "label_histogram": f"WITH {_BIO} SELECT label, count(*) AS n FROM bio GROUP BY label",
    "class_weights": f"WITH {_BIO}, h AS (SELECT label, count(*) AS n FROM bio GROUP BY label), x AS (SELECT label, n, sum(n) OVER () / (3 * n) AS w FROM h) SELECT label, n, w / max(CASE WHEN label = 0 THEN w END) OVER () AS weight FROM x",
    "smoothing": f"WITH {_BIO} SELECT page_id, CAST(pos AS INT) AS pos, tag FROM sm",
    "token_accuracy": f"WITH {_BIO} SELECT count(*) AS tokens, count(*) FILTER (tag = label) AS correct, count(*) FILTER (tag = label) / count(*) AS accuracy FROM sm WHERE label <> -100",
    "token_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings",
    "mean_loss": """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, vec_id % 3 AS g, (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS k FROM embeddings),
l AS (SELECT k, ln(exp(a) + exp(b) + exp(c)) - CASE g WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS nll, CASE g WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 22.0 ELSE 4.0 END AS w FROM e),
s AS (SELECT k, sum(nll * w) / sum(w) AS loss FROM l GROUP BY k) SELECT sum(loss) / ((SELECT count(*) FROM e) // 128 + 1) AS loss FROM s""",
    "split_sizes": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r < ceil(0.2::DOUBLE * n) THEN 'test' WHEN r < ceil(0.2::DOUBLE * n) + ceil(0.1::DOUBLE * (n - ceil(0.2::DOUBLE * n))) THEN 'dev' ELSE 'train' END AS part FROM r""",
    "seeded_split": """WITH c AS (SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS t FROM documents), x AS (SELECT n, t, ceil(0.1::DOUBLE * (n - t)) AS d FROM c)
SELECT 'test' AS part, CAST(t AS BIGINT) AS n FROM x UNION ALL SELECT 'dev', CAST(d AS BIGINT) FROM x UNION ALL SELECT 'train', CAST(n - t - d AS BIGINT) FROM x""",
    "squeeze": f"SELECT page_id, {_SQUEEZE} AS text FROM pages",
    "redirect_filter": f"WITH {_DUMP} SELECT page_id, title FROM dp WHERE text <> '' AND NOT regexp_matches(text, '^(?i)#redirect')",
    "resume_anti": f"WITH {_DUMP} SELECT page_id, title FROM dp WHERE text <> '' AND NOT regexp_matches(text, '^(?i)#redirect') AND title NOT IN (SELECT title FROM dn)",
    "extraction_counters": f"""WITH {_DUMP}, f AS (SELECT coalesce(text, '') = '' AS e, regexp_matches(text, '^(?i)#redirect') AS r, title IN (SELECT title FROM dn) AS s FROM dp)
SELECT count(*) AS pages, count(*) FILTER (e) AS empty, count(*) FILTER (NOT e AND r) AS redirects, count(*) FILTER (NOT e AND NOT r AND s) AS already_done, count(*) FILTER (NOT e AND NOT r AND NOT s) AS to_clean FROM f""",
    "url_quote": f"WITH {_LINKS} SELECT page_id, target, replace(url_encode(target), '%2F', '/') AS quoted FROM lk",
}
