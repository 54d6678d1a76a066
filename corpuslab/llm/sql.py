"""DuckDB twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from corpuslab.llm import license_scan as L
from corpuslab.llm import quality as Q
from corpuslab.llm import source_audit as A

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text),
w AS (SELECT id, {WORDS} AS w FROM t),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
k AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.root, t.id) AS class_id, t.id AS text_id, t.copies AS n_copies, coalesce(k.n_links, 0) AS n_links
FROM documents d JOIN t ON t.text IS NOT DISTINCT FROM d.text LEFT JOIN c ON c.id = t.id LEFT JOIN k ON k.id = t.id
"""

OP3 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
gone AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (
         SELECT string_agg(w[j], ' ' ORDER BY j) FROM unnest(range(1, len(w) + 1)) u(j) WHERE NOT list_contains(gone, j)) END, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP6 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lw AS (SELECT doc_id, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
       FROM (SELECT doc_id, lang, unnest(w) AS x FROM t)),
size AS (SELECT lang, count(*) AS total FROM lw GROUP BY lang),
common AS (SELECT lang, x, count(*) AS n FROM lw JOIN size USING (lang) GROUP BY lang, x, total
           HAVING total >= {Q.MIN_LANG_WORDS} AND count(*) >= {Q.COMMON} * total),
base AS (SELECT doc_id, lang, text, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len([l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')])
    - len(list_distinct([l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')])) AS n_dup_lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY doc_id),
cls AS (SELECT doc_id, lang, [len(regexp_extract_all(text, c)) for c in
  ['[a-z]', '[A-Z]', '[0-9]', '[\\x20\\x09\\x0B-\\x0D]', '\\n', '[.,;:!?''"()-]', '[#*$%&|<>]', '[\\x00-\\x08\\x0E-\\x1F+/=@\\[\\]\\\\^_`{{}}~\\x7F]', '[^\\x00-\\x7F]']] AS p FROM t),
clen AS (SELECT doc_id, lang, unnest(range(1, 10)) AS i, unnest(p) AS n, list_sum(p) AS total FROM cls),
cref AS (SELECT lang, i, sum(n) AS n FROM clen GROUP BY lang, i),
cpair AS (SELECT doc_id, c.total, c.n / c.total::DOUBLE AS a, r.n / (sum(r.n) OVER (PARTITION BY doc_id))::DOUBLE AS b FROM clen c JOIN cref r USING (lang, i) WHERE c.total > 0),
cjs AS (SELECT doc_id, any_value(total) AS total, sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)) AS js FROM cpair GROUP BY doc_id),
wn AS (SELECT lw.doc_id, lw.lang, lw.x, count(*) AS n FROM lw JOIN common USING (lang, x) GROUP BY ALL),
wpair AS (SELECT b.doc_id, coalesce(wn.n, 0) AS n, c.n AS r, b.n_words, s.total FROM base b JOIN common c USING (lang) JOIN size s USING (lang)
          LEFT JOIN wn ON wn.doc_id = b.doc_id AND wn.x = c.x),
wall AS (SELECT doc_id, n / n_words::DOUBLE AS a, r / total::DOUBLE AS b FROM wpair WHERE n_words > 0
         UNION ALL SELECT doc_id, (any_value(n_words) - sum(n)) / any_value(n_words)::DOUBLE, (any_value(total) - sum(r)) / any_value(total)::DOUBLE FROM wpair WHERE n_words > 0 GROUP BY doc_id),
wjs AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)) AS js FROM wall GROUP BY doc_id),
o AS (SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  CASE WHEN total >= {Q.MIN_LANG_WORDS} AND cjs.total_chars >= {Q.MIN_CHARS} THEN cjs.js END AS char_js,
  CASE WHEN total >= {Q.MIN_LANG_WORDS} AND n_words >= {Q.MIN_WORDS} THEN wjs.js END AS word_js
  FROM base b LEFT JOIN cov USING (doc_id) LEFT JOIN size USING (lang) LEFT JOIN (SELECT doc_id, total AS total_chars, js FROM cjs) cjs USING (doc_id) LEFT JOIN wjs USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(char_js, 9) AS char_js, round(word_js, 9) AS word_js,
  (n_words < {Q.MIN_BASE_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words) AS base_failed,
  NOT (n_words < {Q.MIN_BASE_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words)
    AND coalesce(char_js <= {Q.MAX_CHAR_JS}, true) AND coalesce(word_js <= {Q.MAX_WORD_JS}, true) AS kept
FROM o
"""


# Licence patterns for RE2, which has neither look-around nor possessive repeats: every mark between words is doubled, so a
# match may take one half of the marks at its ends and still leave a half to its neighbours. \\x03 is a line end after which
# an Apache notice runs on (the look-ahead of its pattern).
_ANY, _EDGE = "[ \\n\\x01\\x03]", "[\\n\\x01\\x03]"
_GAP = "(?:  |\\n\\n|\\x03\\x03)"
_POINT = "(?:  |\\n\\n|\\x01\\x01|\\x03\\x03)"
_RUNS_ON = "(?:the license )?you may not use"


def _licence_pattern(p: str) -> str:
    p = p.replace(f"(?! {_RUNS_ON})", "")
    p = p.replace("license", "licen[cs]e").replace("~", "\2").replace(" ?", "\0").replace(" ", _GAP).replace("\0", _GAP + "?").replace("\2", _POINT + "?")
    p = re.sub(r"<<(\d+,\d+)>>", lambda m: f"(?:[a-z0-9]+{_POINT}){{{m[1]}}}?", p)
    return re.sub(r"<(\d+,\d+)>", lambda m: f"(?:[a-z0-9]+{_GAP}){{{m[1]}}}?", p)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op10() -> str:
    known = [*L.SENTENCES.items(), *L.TEXTS]
    long = [p for i, p in L.TEXTS if i in L.ANYWHERE]
    short = sorted((p for _, p in known if p not in long), key=len, reverse=True)
    halts = [p for p in short if _RUNS_ON in p]
    long, rest, halts = ("|".join(map(_licence_pattern, x)) for x in (sorted(long, key=len, reverse=True), [p for p in short if p not in halts], halts))
    lists = "|".join(map(_licence_pattern, L.LISTS))
    any_of = f"{_ANY}(?:{long}){_ANY}|{_EDGE}(?:{lists}){_EDGE}|{_EDGE}(?:{halts})[\\n\\x01]|{_EDGE}(?:{rest}){_EDGE}"
    names = " ".join(f"WHEN regexp_full_match(x, {_quoted(_licence_pattern(p))}) THEN ['{i}']" for i, p in known)
    listed = [*((i, p) for i, (_, _, p) in L.NAMES.items()), ("apache", f"apache license{L._V}2 0")]
    one = " ".join(f"WHEN regexp_matches(z, {_quoted(L.name_pattern(p))}) THEN '{i}-spdx'" for i, p in listed)
    words = "x"
    for find, put, how in (("[^a-z0-9]+", " ", "g"), (L.LIST_HEAD, "", ""), (L.LIST_TAIL, "", ""), (" or later", " later", "g")):
        words = f"regexp_replace({words}, {_quoted(find)}, '{put}', '{how}')"
    many = f"[y for y in [CASE {one} END for z in string_split_regex({words}, {_quoted(L.LIST_SPLIT)})] if y IS NOT NULL]"
    text = "lower(chr(10) || text || chr(10))"
    for find, put in ((r"\r\n|[\r\f\x0b]", "chr(10)"), (r"(?:https?://|www\.)[^ \t\n\x0b\f\r]*", "chr(10)"), (r"[^a-z0-9.!?:;\n]+", "' '"), (r" ?\n ?", "chr(10)"),
                      (r"\n\n+", "chr(1) || chr(1)"), (r"[.!?][ \n\x01]", "chr(1)"), (r"[:;][ \n]", "chr(10)"), (r"[.!?:;]+", "' '"), (r" +", "' '"),
                      (r" ?([\n\x01]) ?", "'\\1'"), (r"([ \n\x01])", "'\\1\\1'"), (f"\\n\\n({_licence_pattern(_RUNS_ON)})", "chr(3) || chr(3) || '\\1'")):
        text = f"regexp_replace({text}, {_quoted(find)}, {put}, 'g')"
    rules = [*L.ALL_RULES, *L.FALLBACK_RULES]
    runs = [n for n, r in enumerate(rules) if len(r[2]) > 1]
    steps = []
    for k, n in enumerate(runs):
        seq = "".join(f"|{i}|" for i in rules[n][2])
        steps.append(f"s{k + 1} AS (SELECT *, contains(rest{k}, '{seq}') AS r{n}, replace(rest{k}, '{seq}', '|#|') AS rest{k + 1} FROM s{k})")
    late = len(L.ALL_RULES)
    singles = ", ".join(f"contains(rest{len(runs)}, '|{r[2][0]}|') AS {'r' if n < late else 'c'}{n}" for n, r in enumerate(rules) if n not in runs)
    weak = (L.UNSPECIFIED, L.RESERVED)

    def gives_way(n):
        name = rules[n][0]
        over = [f"{'r' if k < late else 'c'}{k}" for k, (other, _, _) in enumerate(rules)
                if other != name and re.match(L.GIVES_WAY.get(name, "$"), other) and (other not in weak or name == L.RESERVED)]
        return f"c{n} AND NOT ({' OR '.join(over) or 'false'}) AS r{n}"
    given = ", ".join(gives_way(n) for n in range(late, len(rules)))
    found = ", ".join(f"CASE WHEN r{n} THEN '{name}' END" for n, (name, _, _) in enumerate(rules))
    verdict = " ".join(f"WHEN {' OR '.join(f'r{n}' for n, r in enumerate(rules) if r[1] == kind)} THEN '{kind}'" for kind in L.CLASSES)
    return f"""
WITH m AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {_quoted('(?i)' + L.WORDS)}) THEN {text} ELSE '' END AS t FROM documents),
f AS (SELECT doc_id, [x[2:-2] for x in regexp_extract_all(t, {_quoted(any_of)})] AS found FROM m),
s0 AS (SELECT doc_id, ids, array_to_string(['|' || x || '|' for x in ids], '') AS rest0 FROM (
  SELECT doc_id, flatten([CASE {names} ELSE {many} END for x in found if NOT regexp_matches(x, {_quoted(L.NEGATED)})]) AS ids FROM f)),
{", ".join(steps)},
u AS (SELECT *, {singles} FROM s{len(runs)}),
g AS (SELECT *, {given} FROM u),
o AS (SELECT *, [x for x in [{found}] if x IS NOT NULL] AS names FROM g)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce((SELECT string_agg(x, ',' ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(names) AS x, generate_subscripts(names, 1) AS k) GROUP BY x)), '') AS licenses,
  CASE {verdict} ELSE 'none' END AS verdict
FROM o
"""


OP10 = _op10()

OP5 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 199)) AS i, x FROM t WHERE len(x) >= 400),
g AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 400)) AS g FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 200, true) AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
m AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM c GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM m),
p AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
      string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substring(x, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN p USING (doc_id)
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {A.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(n) AS n FROM g GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * v.v))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT s.lang, s.term, (1 + 1000000000::HUGEINT * (sum(s.n) + 2) // (any_value(l.n) + 2 * any_value(v.v)))::BIGINT AS q
  FROM s JOIN l USING (lang) JOIN v USING (lang) GROUP BY s.lang, s.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT s.lang, s.source, 'term', s.term, (p - q) * (p - q) // (p + q) FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o)
WHERE part = 'pair' OR rank <= {A.TOP}
"""

SQL = {"op11_source_audit": OP11, "op1_jaccard_join": OP1, "op3_substring_dedup": OP3, "op5_suffix_dedup": OP5, "op6_quality_rules": OP6, "op10_license_scan": OP10}
