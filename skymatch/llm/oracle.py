"""The SQL of queries that SQL can express."""

from __future__ import annotations

from .quality_rules import _ALL_STOP_WORDS, RULES
from .url_filter import Templates

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{SPACE}+'), lambda w: w <> '')"


def _kept(char_class: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{char_class}]+', '', 'g'))"


def op1() -> str:
    rules = " AND ".join(f"{r.count} {op} CAST({r.per} AS DOUBLE) * CAST({v} AS DOUBLE)" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    stop = ", ".join(f"'{w}'" for w in _ALL_STOP_WORDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words()} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM d, unnest(range(1, greatest(len(ws) - 6, 1))) u(i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(0, 8) r(j) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{SPACE}+', '', 'g')) AS word_chars, {_kept('#*$%&|<>')} AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
coalesce(cov.n, 0) AS n_repeat_words, {_kept('!')} AS n_exclaim, {_kept('\\p{L}')} AS n_alpha, {_kept('\\p{Lu}')} AS n_upper, len(list_filter(ws, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
len(list_filter(range(1, greatest(len(ws), 1)), lambda i: ws[i] = ws[i + 1])) AS n_stutter FROM l LEFT JOIN cov ON cov.doc_id = l.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({rules}) AS kept FROM b"""


def op6() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words(f"translate(text, '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 3) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def op7() -> str:
    lines = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    u = "(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 5e-1) / 4503599627370496e0"
    return f"""WITH d AS (SELECT doc_id, source, len({words()}) AS size, -ln({u}) / (greatest(CAST(len(list_distinct({lines})) AS DOUBLE) / greatest(len({lines}), 1), 5e-2)
* CASE WHEN {_kept('#*$%&|<>')} * 10 > len({words()}) THEN 5e-1 ELSE 1e0 END) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, 2e0 * source_size AS cap, (15e-1 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER b, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0e0)) AS level
FROM s WINDOW b AS (ORDER BY 2e0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT first(level ORDER BY cap / w, source) AS level FROM f WHERE level <= cap / w),
t AS (SELECT f.source, f.source_size, CASE WHEN f.level <= cap / w THEN least(cap, w * shared.level) ELSE cap END AS target FROM f CROSS JOIN shared),
r AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target / t.source_size) AS BIGINT) AS epochs, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN size > 0 THEN size * (epochs + CASE WHEN upto - size / 2e0 <= target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END AS taken FROM r"""


def op9(min_sites: int = 3) -> str:
    return f"""WITH l AS (SELECT doc_id, source, u.i AS pos, string_split(text, chr(10))[u.i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
w AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS full_ FROM l),
c AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS one FROM w WHERE full_ GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {min_sites}),
m AS (SELECT w.*, c.line IS NOT NULL AND c.one <> struct_pack(d := doc_id, p := pos) AS gone FROM w LEFT JOIN c ON c.line = w.line AND w.full_),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (full_) AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def op10(rules, how: Templates = Templates(), levels: int = 3) -> str:
    """levels: at least the number of segments of the longest path of the table that the query is checked on; SQL without recursion must write them out."""
    fits = []
    for r in sorted(rules, key=lambda r: -len(r.rule)):
        name, _, rest = r.rule.partition("/")
        fits.append((f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}')", r))
    known = "CASE " + " ".join(f"WHEN {f} THEN '{r.rule}'" for f, r in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits) + " END"

    def apart(n: str, k: str, n2: str, k2: str) -> str:
        """Whether k of n and k2 of n2 other pages differ significantly."""
        p = f"(1e0 * ({k} + {k2}) / ({n} + {n2}))"
        return f"coalesce(CASE WHEN {n} > 0 AND {n2} > 0 THEN abs(1e0 * {k} / {n} - 1e0 * ({k2}) / ({n2})) > {how.merge_z} * sqrt({p} * (1 - {p}) * (1e0 / {n} + 1e0 / ({n2}))) END, false)"

    steps, before = [], "t0"
    for i in range(levels):
        rest = f"array_to_string(list_transform(parts[{i + 1}:], lambda x: CASE WHEN t.pages >= {how.literal_pages} THEN x ELSE '*' END), '/')"
        steps.append(
            f"c{i} AS (SELECT host, template, coalesce(parts[{i + 1}], '') AS seg, sum(pages) AS pages, sum(labelled) AS n, sum(bad) AS k, count(*) AS shapes FROM {before} WHERE NOT done GROUP BY ALL), "
            f"a{i} AS (SELECT *, sum(pages) OVER w AS all_pages, sum(n) OVER w AS all_n, sum(k) OVER w AS all_k, sum(shapes) OVER w = 1 AS alone FROM c{i} WINDOW w AS (PARTITION BY host, template)), "
            f"s{i} AS (SELECT *, CASE WHEN pages >= {how.literal_pages} AND pages >= {how.literal_share} * all_pages OR n >= {how.own_labelled} AND {apart('n', 'k', 'all_n - n', 'all_k - k')} THEN seg ELSE '*' END AS step FROM a{i}), "
            f"b{i} AS (SELECT host, template, step, sum(n) AS n, sum(k) AS k FROM s{i} WHERE NOT alone GROUP BY ALL), "
            f"d{i} AS (SELECT *, sum(n) OVER w AS tn, sum(k) OVER w AS tk FROM b{i} WINDOW w AS (PARTITION BY host, template)), "
            f"e{i} AS (SELECT *, n > 0 AND NOT {apart('n', 'k', 'tn - n', 'tk - k')} AS near FROM d{i}), "
            f"f{i} AS (SELECT *, sum(CASE WHEN near THEN n ELSE 0 END) OVER w AS pn, sum(CASE WHEN near THEN k ELSE 0 END) OVER w AS pk FROM e{i} WINDOW w AS (PARTITION BY host, template)), "
            f"g{i} AS (SELECT *, n > 0 AND pn > 0 AND NOT {apart('n', 'k', 'pn - CASE WHEN near THEN n ELSE 0 END', 'pk - CASE WHEN near THEN k ELSE 0 END')} AS core FROM f{i}), "
            f"h{i} AS (SELECT *, CASE WHEN n = 0 THEN '?u' WHEN core THEN '?m' WHEN k * CASE WHEN pn > 0 THEN pn ELSE tn END > n * CASE WHEN pn > 0 THEN pk ELSE tk END THEN '?h' ELSE '?l' END AS side FROM g{i}), "
            f"i{i} AS (SELECT *, sum(n) OVER w AS sn, sum(k) OVER w AS sk FROM h{i} WINDOW w AS (PARTITION BY host, template, side)), "
            f"j{i} AS (SELECT *, CASE WHEN n > 0 AND (core OR NOT {apart('n', 'k', 'sn - n', 'sk - k')}) THEN side END AS grp FROM i{i}), "
            f"k{i} AS (SELECT host, template, step, CASE WHEN count(*) OVER (PARTITION BY host, template, grp) > 1 THEN grp END AS grp FROM j{i}), "
            f"l{i} AS (SELECT s.host, s.template, s.seg, s.alone, coalesce(k.grp, s.step) AS step FROM s{i} s LEFT JOIN k{i} k ON k.host = s.host AND k.template = s.template AND k.step = s.step), "
            f"t{i + 1} AS (SELECT t.* EXCLUDE (template, done), CASE WHEN t.done OR len(parts) <= {i} THEN t.template WHEN l.alone THEN t.template || '/' || {rest} ELSE t.template || '/' || l.step END AS template, t.done OR l.alone OR len(parts) <= {i} AS done "
            f"FROM {before} t LEFT JOIN l{i} l ON NOT t.done AND l.host = t.host AND l.template = t.template AND l.seg = coalesce(t.parts[{i + 1}], ''))"
        )
        before = f"t{i + 1}"
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {known} AS rule, {said} AS said, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS label_id FROM u),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
sh AS (SELECT host, shape, count(*) AS pages, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM r LEFT JOIN lab ON lab.doc_id = r.label_id GROUP BY host, shape),
t0 AS (SELECT host, shape, pages, labelled, bad, string_split(regexp_replace(shape, '^/', ''), '/') AS parts, '' AS template, false AS done FROM sh),
{', '.join(steps)},
prior AS (SELECT coalesce(sum(bad) / sum(labelled), 0e0) AS v FROM sh),
v AS (SELECT host, template, (sum(bad) + {how.prior_pages} * any_value(prior.v)) / (sum(labelled) + {how.prior_pages}) AS share FROM {before} CROSS JOIN prior GROUP BY host, template)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN v.share >= {how.reject} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN {before} t ON t.host = r.host AND t.shape = r.shape JOIN v ON v.host = t.host AND v.template = t.template"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(z AS BIGINT) for z in range(8)]), lambda v, z: {step})), CAST(4294967295 AS BIGINT))"


def op11() -> str:
    return f"""WITH t AS (SELECT conv_id, md5(length(r) || ':' || r || x) AS digest, length(x) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(r, 64), left(x, 64), md5(length(r) || ':' || r || x)) AS pos
FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
rebuilt AS (SELECT p.conv_id, t.pos, digest, chars FROM p JOIN t ON t.conv_id = p.base AND t.pos <= p.head UNION ALL SELECT p.conv_id, t.pos - p.h + p.head, digest, chars FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
s AS (SELECT conv_id, list(digest ORDER BY pos) AS ds, list(chars ORDER BY pos) AS cs FROM rebuilt GROUP BY conv_id),
a AS (SELECT p.conv_id, coalesce(ds, []) AS ds, coalesce(cs, []) AS cs FROM p LEFT JOIN s ON s.conv_id = p.conv_id),
m AS (SELECT conv_id, d AS depth, md5(array_to_string(ds[1:d], ',')) AS k, len(ds) = d AS ends, coalesce(cs[d], 0) AS chars FROM a, unnest(range(0, len(ds) + 1)) u(d)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY k, depth),
up AS (SELECT n.*, m.k AS pk FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT pk AS k, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.k = up.k AND kids.depth = up.depth),
totals AS (SELECT m.k, m.depth, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM full_nodes f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN totals ON totals.k = f.k AND totals.depth = f.depth LEFT JOIN n parent ON parent.k = f.pk AND parent.depth = f.depth - 1"""


def op12() -> str:
    return """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
