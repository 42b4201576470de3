"""The registered queries in SQL, for an independent engine to run on the same tables."""

from __future__ import annotations

from . import lexicon as L
from .functions.text import fold_table

WS = r"\s\x0b\x1c-\x1f\x{85}\pZ"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:[-'']{LETTER}+)*"
NL = "chr(10)"
D = f"replace(text, {NL}, {NL} || {NL})"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(x: str) -> str:
    inner = f"replace(replace(replace({x}, chr(13) || {NL}, {NL}), chr(13), {NL}), chr(160), ' ')"
    return strip(rf"regexp_replace(regexp_replace({inner}, '[ \t]+', ' ', 'g'), '\n{{3,}}', {NL} || {NL}, 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"


def lower_words(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: lower(w))"


def blanks(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^{WS}]+')"


def fold(x: str) -> str:
    before, after, _ = fold_table()
    return f"translate(lower({x}), {q(before)}, {q(after)})"


def fold_map() -> str:
    """A CTE of characters and what each folds to, for folding distinct words by a join."""
    before, after, several = fold_table()
    one = f"SELECT substr(b, i, 1) AS c, substr(a, i, 1) AS f FROM (SELECT {q(before)} AS b, {q(after)} AS a, unnest(range(1, {len(before)} + 1)) AS i)"
    more = ", ".join(f"({q(k)}, {q(v)})" for k, v in several.items())
    return f"fold_map AS MATERIALIZED ({one} UNION ALL SELECT * FROM (VALUES {more}) v(c, f))"


def rnd(x: str, digits: int) -> str:
    """x rounded half-even on its exact binary value: a whole number over a power of two, in 128-bit integers."""
    unit = 10**digits
    whole = f"list_transform([abs(v)], lambda a: list_transform([greatest(52 - floor(log2(a))::INTEGER, 0)], lambda e: list_transform([[(a * 2.0::DOUBLE ** e)::HUGEINT * {unit}, 1::HUGEINT << e]], lambda m: list_transform([m[1] // m[2]], lambda k: (k + CASE WHEN 2 * (m[1] - k * m[2]) > m[2] OR (2 * (m[1] - k * m[2]) = m[2] AND k % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {unit})[1])[1])[1])[1]"
    return f"(list_transform([({x})::DOUBLE], lambda v: CASE WHEN v IS NULL THEN NULL WHEN abs(v) < 1e-9 THEN 0.0::DOUBLE ELSE sign(v) * {whole} END)[1])"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(f"coalesce({x}, '')")}, '[a-z0-9]+')"


def members(x: str, allowed: list[str]) -> str:
    return f"len(list_filter({x}, lambda w: w IN ({', '.join(q(a) for a in sorted(set(allowed)))})))"


def lang(x: str) -> str:
    return f"CASE WHEN {members(x, L.STOP_EN)} > {members(x, L.STOP_ES)} THEN 'en' ELSE 'es' END"


ABBREVIATIONS = ", ".join(q(a) for a in L.ABBREVIATIONS)
DIGIT = "[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"
CLOSERS = """["''»”)\\]]*"""
WHOLE = rf"""
norm AS (SELECT doc_id, length({D}) AS raw, {norm(D)} AS t FROM documents),
cutup AS (SELECT doc_id, string_split_regex(t, '\n[{WS}]*\n') AS ps, regexp_extract_all(t, '\n[{WS}]*\n') AS seps FROM norm),
pars AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k, ps, seps FROM cutup),
placed AS (SELECT doc_id, p, k - 1 AS paragraph, coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(seps[1:k - 1], lambda x: length(x))), 0) AS off FROM pars),
toks AS (SELECT doc_id, paragraph, off, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM (SELECT *, regexp_extract_all(p, '^\s+|\S+\s*') AS l FROM placed)),
cores AS (SELECT *, regexp_replace(tok, '\s+$', '') AS core, lead(tok) OVER w AS nxt, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, paragraph ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS toff FROM toks WINDOW w AS (PARTITION BY doc_id, paragraph ORDER BY pos)),
ends AS (SELECT *, regexp_extract(core, '[.!?…]+{CLOSERS}$') AS suf FROM cores),
lasts AS (SELECT *, lower(regexp_extract(substr(core, 1, length(core) - length(suf)), '[\p{{L}}\p{{N}}_]+$')) AS lw FROM ends),
cuts AS (SELECT *, suf <> '' AND NOT (starts_with(suf, '.') AND lw <> '' AND (lw IN ({ABBREVIATIONS}) OR regexp_full_match(lw, '\p{{L}}') OR (regexp_full_match(lw, '{DIGIT}+') AND length(tok) - length(core) = 1 AND regexp_matches(coalesce(nxt, ''), '^{DIGIT}')))) AS cut FROM lasts),
ided AS (SELECT *, coalesce(sum(cut::INTEGER) OVER (PARTITION BY doc_id, paragraph ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM cuts),
joined AS (SELECT doc_id, paragraph, sid, string_agg(tok, '' ORDER BY pos) AS raw, min(off + toff) AS spot FROM ided GROUP BY ALL),
sents AS (SELECT doc_id, paragraph, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, sid) - 1) AS sent_id, spot + length(raw) - length(regexp_replace(raw, '^[{WS}]+', '')) AS start_at, {strip('raw')} AS text FROM joined WHERE {strip('raw')} <> '')
"""
#: The report reads no more than this much of a text; all else reads whole texts.
SENTENCES = WHOLE.replace(f"{norm(D)} AS t", f"substr({norm(D)}, 1, 300000) AS t")
LABELLED = f"labelled AS (SELECT d.doc_id, d.source, d.lang, l.quality AS y, round((length(text) % 997) / 997, 6) AS p, round((len({words('text')}) % 101) / 101, 6) AS q FROM documents d JOIN labels l USING (doc_id))"


def lexicon(of: str, probe: dict[str, L.Lexicon], part: str) -> str:
    """A pattern by the row's language."""
    def pattern(x: L.Lexicon) -> str:
        if part == "phrases":
            return q("(?i)(?:" + "|".join(f"(?:{p})" for p in x.phrases) + ")")
        return q(r"(?i)^(?:" + "|".join(x.connectors) + r")(?:[^\p{L}\p{N}_]|$)")

    en, es = pattern(probe["en"]), pattern(probe["es"])
    if part == "phrases":
        return f"CASE WHEN lang = 'en' THEN len(regexp_extract_all({of}, {en})) ELSE len(regexp_extract_all({of}, {es})) END"
    return f"CASE WHEN lang = 'en' THEN regexp_matches({of}, {en}) ELSE regexp_matches({of}, {es}) END"


def features(probe: dict[str, L.Lexicon], sentences: str = SENTENCES) -> str:
    """CTEs up to scored: a row per document with rounded features and the style score."""
    return rf"""{sentences},
base AS (SELECT doc_id, t, raw, {lower_words('t')} AS ws FROM norm),
langs AS (SELECT doc_id, t, raw, ws, len(ws) AS n, {lang('ws')} AS lang FROM base),
det AS (SELECT s.*, l.lang, len({words('s.text')}) AS n FROM sents s JOIN langs l USING (doc_id)),
hits AS (SELECT *, {lexicon('text', probe, 'phrases')} AS h, {lexicon('text', probe, 'connectors')} AS c, length(text) - length(translate(text, '?!', '')) AS asks FROM det),
per AS (SELECT doc_id, count(*) AS all_s, count(*) FILTER (WHERE n > 0) AS ns, coalesce(avg(n) FILTER (WHERE n > 0), 0) AS mean, coalesce(stddev_pop(n) FILTER (WHERE n > 0) / nullif(avg(n) FILTER (WHERE n > 0), 0), 0) AS cv, sum(h) AS h, sum(c::INTEGER) AS c, sum(asks) AS asks FROM hits GROUP BY doc_id),
parn AS (SELECT doc_id, paragraph, sum(n) AS n FROM hits GROUP BY ALL),
parv AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN {rnd('coalesce(stddev_pop(n) / nullif(avg(n), 0), 0)', 3)} END AS pv FROM parn GROUP BY doc_id),
feats AS (SELECT l.doc_id, l.lang, l.n, l.raw, l.t, coalesce(ns, 0) AS ns, coalesce(all_s, 0) AS all_s, {rnd('coalesce(mean, 0)', 2)} AS mean, {rnd('coalesce(cv, 0)', 3)} AS burst, pv, coalesce(h, 0) AS h, {rnd('coalesce(h, 0) * 100.0::DOUBLE / greatest(l.n, 1)', 3)} AS rate, {rnd('coalesce(c, 0)::DOUBLE / greatest(coalesce(all_s, 0), 1)', 3)} AS conn, coalesce(asks, 0) AS asks,
  {rnd('CASE WHEN l.n = 0 THEN 0 WHEN l.n <= 50 THEN len(list_distinct(ws)) / l.n ELSE list_sum(list_transform(range(1, l.n - 48), lambda i: len(list_distinct(ws[i:i + 49])))) / ((l.n - 49) * 50.0::DOUBLE) END', 3)} AS mattr
  FROM langs l LEFT JOIN per USING (doc_id) LEFT JOIN parv USING (doc_id)),
scored AS (SELECT *, 1 / (1 + exp(-(-4.0::DOUBLE * (burst - 0.45::DOUBLE) + 1.2::DOUBLE * least(rate, 4.0) - 0.6::DOUBLE + 3.0::DOUBLE * (conn - 0.15::DOUBLE) + coalesce(-2.0::DOUBLE * (pv - 0.35::DOUBLE), 0) + CASE WHEN asks > 0 THEN -0.3::DOUBLE ELSE 0 END))) AS style FROM feats)"""


def build(probe: dict[str, L.Lexicon], lm: dict) -> dict[str, str]:
    o: dict[str, str] = {}
    o["text_normalize"] = f"SELECT doc_id, length({norm(D)})::INTEGER AS chars, md5({norm(D)}) AS digest, length({D}) > 300000 AS truncated FROM documents"
    o["text_words"] = f"SELECT doc_id, len({words(D)})::INTEGER AS n_words, len({blanks(D)})::INTEGER AS n_blank, md5(array_to_string({lower_words(D)}, ' ')) AS digest, (length({D}) - length(translate({D}, '?!', '')))::INTEGER AS asks FROM documents"
    spelled = f"{D} || ' fin flor xii dzep kg ffix no ijs'"  # what the query's ligatures must fold to
    o["text_fold"] = f"SELECT doc_id, len({tokens(spelled)})::INTEGER AS n_tokens, md5(array_to_string({tokens(spelled)}, ' ')) AS digest FROM documents"
    o["text_cuts"] = rf"""WITH a AS (SELECT *, {D} AS x, {blanks(D)} AS w FROM documents), b AS (SELECT *, array_to_string(w[1:60], ' ') AS h FROM a),
c AS (SELECT *, greatest(coalesce(length(regexp_extract(h, '(?s)^.*[.?!] ')), 0) - 2, -1) AS spot FROM b)
SELECT doc_id, md5(array_to_string(w[1:120], ' ')) AS head, md5(CASE WHEN len(w) <= 60 THEN x WHEN spot > length(h) / 2 THEN substr(h, 1, spot + 1) ELSE h END) AS cut, md5(regexp_replace(lang || ' / ' || source, '[^a-zA-Z0-9.-]+', '_', 'g')) AS slug,
len(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'))::INTEGER AS n_chars_words, md5(regexp_replace(x || '[12][cita requerida]', '\[\d+\]|\[cita requerida\]|\x{{200B}}', '', 'g')) AS plain, 'https://' || lang || '.wikipedia.org/wiki/' || replace(source || ' a b', ' ', '_') AS url FROM c"""
    o["language_rule"] = f"WITH a AS (SELECT doc_id, {lower_words(D)} AS w FROM documents) SELECT doc_id, {members('w', L.STOP_ES)}::INTEGER AS es, {lang('w')} AS lang FROM a"

    o["spanish_filter"] = rf"""WITH a AS (SELECT doc_id, {D} AS x, regexp_extract_all(lower({D}), '[a-záéíóúñü]+') AS w, regexp_extract_all({D}, '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
b AS (SELECT *, greatest(len(w), 1) AS n, len(list_filter(ws, lambda v: lower(v) IN ({', '.join(q(v) for v in L.IBERIAN_WORDS)}) OR regexp_matches(lower(v), '(?:ção|ões)$'))) + len(regexp_extract_all(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])[ld]''[\p{{L}}\p{{N}}_]')) AS other FROM a),
c AS (SELECT doc_id, x, len(w) >= 50 AND {members('w', L.CORPUS_ES)} / n > 0.2 AND {members('w', L.CORPUS_EN)} / n < 0.03 AND other / n < 0.01 AS spanish FROM b)
SELECT doc_id, spanish, CASE WHEN len({blanks('x')}) < 100 THEN 'corto' WHEN NOT spanish THEN 'idioma' END AS reason FROM c"""

    o["paragraphs"] = f"WITH {WHOLE} SELECT doc_id, (k - 1)::INTEGER AS paragraph, length(p)::INTEGER AS chars, md5(p) AS digest FROM pars"
    o["sentence_split"] = f"WITH {WHOLE} SELECT doc_id, sent_id::INTEGER AS sent_id, paragraph::INTEGER AS paragraph, start_at::INTEGER AS start_at, (start_at + length(text))::INTEGER AS end_at, md5(text) AS digest FROM sents"
    o["mattr"] = f"WITH a AS (SELECT doc_id, {lower_words(D)} AS ws FROM documents) SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 50 THEN len(list_distinct(ws)) / len(ws) ELSE list_sum(list_transform(range(1, len(ws) - 48), lambda i: len(list_distinct(ws[i:i + 49])))) / ((len(ws) - 49) * 50.0::DOUBLE) END, 6) AS mattr FROM a"
    o["ngrams"] = f"""WITH a AS (SELECT doc_id, {tokens(D)} AS w FROM documents), e AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM a),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM g GROUP BY doc_id, g)
SELECT a.doc_id, count(r.g)::INTEGER AS n_grams, md5(coalesce(string_agg(r.g, '|' ORDER BY k), '')) AS digest FROM a LEFT JOIN r USING (doc_id) GROUP BY a.doc_id"""
    f = features(probe)
    o["lexicon_hits"] = f"WITH {f} SELECT doc_id, lang, sum(h)::BIGINT AS hits, sum(c::INTEGER)::BIGINT AS starts, sum(asks)::BIGINT AS asks FROM hits GROUP BY ALL"
    level = lambda x: f"CASE WHEN {x} < 0.35 THEN 'bajo' WHEN {x} < 0.65 THEN 'medio' ELSE 'alto' END"
    verdict = lambda x: f"CASE WHEN {x} < 0.35 THEN {q(L.VERDICTS[0])} WHEN {x} < 0.65 THEN {q(L.VERDICTS[1])} ELSE {q(L.VERDICTS[2])} END"
    o["style_features"] = f"""WITH {f} SELECT doc_id, lang, n::INTEGER AS words, ns::INTEGER AS sentences, mean AS mean_length, burst AS burstiness, pv AS paragraph_variation, mattr, rate AS phrase_rate, conn AS connector_share, asks::BIGINT AS asks, round(style, 6) AS style, {level('style')} AS level, {verdict('style')} AS verdict,
((burst < 0.35 AND ns >= 5)::INTEGER + (rate >= 1)::INTEGER + (conn >= 0.3)::INTEGER + coalesce(pv < 0.2, false)::INTEGER)::INTEGER AS n_reasons FROM scored"""
    o["report_rows"] = f"""WITH {f},
short AS (SELECT doc_id, paragraph, sum(n) AS pw, sum(greatest(n, 1)) AS w, count(*) AS k, count(*) FILTER (WHERE c) AS nc, sum(h) AS h, coalesce(sqrt(greatest(avg(n * n) - avg(n) * avg(n), 0)), 0) / greatest(avg(n), 1) AS spread FROM hits GROUP BY ALL),
g AS (SELECT s.*, sc.style AS p FROM short s JOIN scored sc USING (doc_id)),
gr AS (SELECT *, (h > 0)::INTEGER + (nc >= 2)::INTEGER + (k >= 3 AND spread < 0.3)::INTEGER AS own FROM g),
gs AS (SELECT doc_id, count(*) AS np, sum(CASE WHEN own = 0 AND p >= 0.65 THEN 1 ELSE own END) AS nr, sum(own + (p >= 0.35)::INTEGER) AS nt FROM gr GROUP BY doc_id)
SELECT doc_id, lang, {rnd('style', 3)} AS p, {verdict('style')} AS verdict, 'baja' AS confidence, CASE WHEN style >= 0.65 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flagged_fraction, n::INTEGER AS n_words, np::INTEGER AS n_paragraphs, all_s::INTEGER AS n_sentences,
((n < 250)::INTEGER + (raw > 300000)::INTEGER + (lang = 'en')::INTEGER + 1)::INTEGER AS n_warnings, nr::BIGINT AS n_reasons, nt::BIGINT AS n_suggestions FROM scored JOIN gs USING (doc_id) WHERE n >= 80"""
    before, after = L.TOO_SHORT.format(words="\0", least=80).split("\0")
    o["too_short"] = f"WITH a AS (SELECT doc_id, len({words(f'substr({norm(D)}, 1, 300000)')}) AS n FROM documents) SELECT doc_id, {q(before)} || n || {q(after)} AS message FROM a WHERE n < 80"
    o["short_turns"] = f"WITH a AS (SELECT role, len({blanks('text')}) AS n FROM conversations) SELECT role, count(*)::BIGINT AS n, sum((n BETWEEN 5 AND 400)::INTEGER)::BIGINT AS paraphrasable, sum((n >= 80)::INTEGER)::BIGINT AS comparable FROM a GROUP BY role"
    stop = ", ".join(q(w) for w in sorted(set(L.KEYWORD_STOP)))
    o["keyword_queries"] = rf"""WITH {WHOLE},
sized AS (SELECT doc_id, k, p, len({blanks('p')}) AS n FROM pars),
chosen AS (SELECT * FROM sized WHERE n >= 25 UNION ALL SELECT doc_id, 1, t, 0 FROM norm WHERE doc_id NOT IN (SELECT doc_id FROM sized WHERE n >= 25)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS r FROM chosen QUALIFY r <= 8),
ws AS (SELECT doc_id, r, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(p, '{LETTER}{{4,}}') AS l FROM top)),
kinds AS (SELECT DISTINCT w, lower(w) AS l FROM ws), {fold_map()},
letters AS (SELECT w, i, substr(l, i, 1) AS c FROM (SELECT w, l, unnest(range(1, length(l) + 1)) AS i FROM kinds WHERE strlen(l) > length(l))),
folds AS (SELECT w, l AS key FROM kinds WHERE strlen(l) = length(l) UNION ALL SELECT w, string_agg(coalesce(f, c), '' ORDER BY i) FROM letters LEFT JOIN fold_map USING (c) GROUP BY w),
keyed AS (SELECT ws.*, key FROM ws JOIN folds USING (w)), agg AS (SELECT doc_id, r, key, count(*) AS n, min(i) AS i, lower(arg_min(w, i)) AS w FROM keyed WHERE key NOT IN ({stop}) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r ORDER BY n DESC, length(key) DESC, i) AS k FROM agg QUALIFY k <= 6),
lists AS (SELECT t.doc_id, t.r, coalesce(string_agg(a.w, ' ' ORDER BY a.k), '') AS qs FROM top t LEFT JOIN ranked a USING (doc_id, r) GROUP BY ALL)
SELECT doc_id, count(DISTINCT qs)::INTEGER AS n_queries, arg_min(qs, r) AS first FROM lists GROUP BY doc_id"""
    overlap = f"""WITH {WHOLE},
st AS (SELECT doc_id, sent_id, paragraph, {tokens('text')} AS w FROM sents), sg AS (SELECT DISTINCT doc_id, sent_id, paragraph, len(w) AS words, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM st WHERE len(w) >= 8)),
it AS (SELECT item_id, {tokens('text')} AS w FROM benchmark), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM it)),
n AS (SELECT doc_id, sent_id, paragraph, words, count(*) AS n FROM sg GROUP BY ALL), k AS (SELECT doc_id, sent_id, item_id, count(*) AS k FROM sg JOIN ig USING (g) GROUP BY ALL),
best AS (SELECT n.*, k.item_id, k.k / n.n AS overlap FROM n JOIN k USING (doc_id, sent_id) QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY k.k DESC, k.item_id) = 1),
found AS (SELECT * FROM best WHERE overlap >= 0.4)"""
    o["overlap_matches"] = overlap + f" SELECT doc_id, sent_id::INTEGER AS sent_id, paragraph::INTEGER AS paragraph, 'item:' || item_id AS url, {rnd('overlap', 3)} AS overlap, words::INTEGER AS words FROM found"
    o["overlap_totals"] = overlap + f", tot AS (SELECT doc_id, sum(len(w)) AS a FROM st GROUP BY doc_id), m AS (SELECT doc_id, sum(words) AS w, count(DISTINCT item_id) AS s FROM found GROUP BY doc_id) SELECT doc_id, {rnd('coalesce(w, 0) / greatest(a, 1)', 4)} AS fraction, coalesce(s, 0)::INTEGER AS n_sources FROM tot LEFT JOIN m USING (doc_id)"
    area = lambda g, t: f"SELECT {g}, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / nullif((count(*) FILTER (WHERE y = 1))::DOUBLE * count(*) FILTER (WHERE y = 0), 0), 9) AS auroc, count(*)::BIGINT AS n FROM (SELECT {g}, y, rank() OVER (PARTITION BY {g} ORDER BY p) + (count(*) OVER (PARTITION BY {g}, p) - 1) / 2 AS r FROM {t}) GROUP BY {g}"
    o["auroc"] = f"WITH {LABELLED} {area('lang', 'labelled')}"
    o["one_against_rest"] = f"WITH {LABELLED}, g AS (SELECT DISTINCT lang AS against FROM labelled WHERE y = 1), r AS (SELECT g.against, y, p FROM labelled, g WHERE y = 0 UNION ALL SELECT lang, y, p FROM labelled WHERE y = 1) {area('against', 'r')}"
    o["tpr_at_fpr"] = f"""WITH {LABELLED}, c AS (SELECT lang, p, sum(y) AS pos, sum(1 - y) AS neg FROM labelled GROUP BY ALL),
r AS (SELECT lang, p, sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY lang), 0) AS tpr, sum(neg) OVER w / nullif(sum(neg) OVER (PARTITION BY lang), 0) AS fpr FROM c WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, round(coalesce(max(tpr) FILTER (WHERE fpr <= 0.1), 0), 9) AS tpr, max(p) FILTER (WHERE fpr <= 0.1 AND tpr = best) AS threshold FROM (SELECT *, max(CASE WHEN fpr <= 0.1 THEN tpr END) OVER (PARTITION BY lang) AS best FROM r) GROUP BY lang"""
    o["accuracy"] = f"WITH {LABELLED} SELECT lang, round(avg(((p >= 0.5) = (y = 1))::INTEGER), 9) AS accuracy, round(avg(-(y * ln(p + 1e-6) + (1 - y) * ln(1 - p + 1e-6))), 6) AS log_loss, round(avg((p >= 0.99)::INTEGER) FILTER (WHERE y = 0), 9) AS sure_share, round(corr(p, q), 6) AS r FROM labelled GROUP BY lang"
    o["method_rates"] = f"""WITH {LABELLED}, m AS (SELECT *, 'p' AS method, p AS s FROM labelled UNION ALL SELECT *, 'q', q FROM labelled), t AS (SELECT *, 'all' AS subset FROM m UNION ALL SELECT *, 'english' FROM m WHERE lang = 'en' UNION ALL SELECT *, 'hot' FROM m WHERE source = 'src0')
SELECT subset, method, count(*)::BIGINT AS n, round(avg((s >= 0.65)::INTEGER) FILTER (WHERE y = 0), 9) AS fpr, round(avg((s >= 0.65)::INTEGER) FILTER (WHERE y = 1), 9) AS tpr FROM t GROUP BY ALL"""
    o["group_audit"] = f"WITH {LABELLED} SELECT source, count(*)::BIGINT AS n, round(avg((p >= 0.65)::INTEGER) * 100, 1) AS flagged_pct, round(avg((p >= 0.35)::INTEGER) * 100, 1) AS uncertain_pct, round(avg(p), 3) AS mean_p FROM labelled GROUP BY source"
    o["quantile_shift"] = f"WITH {LABELLED}, a AS (SELECT quantile_cont(p, 0.95) AS v FROM labelled WHERE y = 0) SELECT round(v, 6) AS quantile, round(ln(0.65 / 0.35) - ln(v / (1 - v)), 6) AS shift FROM a"
    o["class_guard"] = f"WITH {LABELLED} SELECT source, count(*)::BIGINT AS n, count(DISTINCT y)::BIGINT AS classes FROM labelled GROUP BY source HAVING count(DISTINCT y) >= 2"
    o["standardised"] = f"WITH {LABELLED}, s AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq FROM labelled) SELECT doc_id, round((p - mp) / (sp + 1e-9), 5) AS z_p, round((q - mq) / (sq + 1e-9), 5) AS z_q FROM labelled, s"
    o["stratified_sample"] = f"WITH {LABELLED} SELECT doc_id, y FROM labelled QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) <= 30"
    o["first_of_text"] = f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {D} ORDER BY source, doc_id) = 1"
    draw = lambda x: f"(('0x' || substr(md5('42:' || {x}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    o["group_split"] = f"SELECT source, CASE WHEN {draw('source')} < 0.3 OR source IN (SELECT source FROM documents WHERE contains(source, '7') AND lang = 'fr') THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n FROM documents GROUP BY ALL"
    least = "list_position(g.loads, list_min(g.loads))"
    o["size_folds"] = f"""WITH RECURSIVE s AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, conv_id) AS r FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
g AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS conv_id, 0::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL SELECT s.r, s.conv_id, ({least} - 1)::BIGINT, list_transform(range(1, 6), lambda i: g.loads[i] + CASE WHEN i = {least} THEN s.n ELSE 0 END)::BIGINT[] FROM g JOIN s ON s.r = g.r + 1)
SELECT c.conv_id, c.turn, fold::INTEGER AS fold FROM conversations c JOIN g USING (conv_id)"""
    u = draw("doc_id || ':task'")
    task = f"CASE WHEN {u} < 0.6 THEN 'redactar' WHEN {u} < 0.8 THEN 'parafrasear' ELSE 'humanizar' END"
    o["task_choice"] = f"SELECT doc_id, {task} AS task FROM documents"
    pick = lambda options, salt: f"([{', '.join(q(x) for x in options)}])[(floor({draw(f"doc_id || ':{salt}'")} * {len(options)}))::INTEGER + 1]"
    n = "greatest(150, least(n, 600))::VARCHAR"
    academic = f"replace(replace(replace(replace({q(L.PROMPT_ACADEMIC)}, '{{words}}', {n}), '{{genre}}', {pick(L.GENRES, 'genre')}), '{{field}}', 'área'), '{{title}}', source)"
    encyclopedic = f"replace(replace({q(L.PROMPT_ENCYCLOPEDIC)}, '{{words}}', {n}), '{{title}}', source)"
    o["prompts"] = f"""WITH a AS (SELECT *, {D} AS x, len({blanks(D)}) AS n, {task} AS task FROM documents)
SELECT doc_id, md5(CASE WHEN task = 'parafrasear' THEN replace({pick(L.PARAPHRASE_PROMPTS, 'variant')}, '{{words}}', {n}) || {NL} || {NL} || x ELSE (CASE WHEN lang = 'es' THEN {academic} ELSE {encyclopedic} END) || (CASE WHEN task = 'humanizar' THEN {q(L.PROMPT_HUMANISE)} ELSE '' END) || {q(L.PROMPT_END)} END) AS digest FROM a"""
    o["oversample"] = f"WITH {LABELLED} SELECT y, (count(*) * CASE WHEN y = 1 THEN 3 ELSE 1 END)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS ids FROM labelled GROUP BY y"
    o["take_until"] = f"WITH {WHOLE}, z AS (SELECT doc_id, k, len({blanks('p')}) AS n FROM pars), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS t FROM z) SELECT doc_id, count(*)::BIGINT AS kept, sum(n)::BIGINT AS words FROM s WHERE t <= 650 GROUP BY doc_id"
    o["pending"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
    o["aligned_union"] = f"SELECT doc_id, lang, length({D})::BIGINT AS size, NULL::INTEGER AS y FROM documents UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels"
    o["joins"] = "SELECT lang, count(*)::BIGINT AS n, count(quality)::BIGINT AS labelled, count(*) FILTER (WHERE toxic = 1)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"
    o["inverted_index"] = f"WITH a AS (SELECT doc_id, {blanks(D)} AS w FROM documents) SELECT doc_id, len(list_distinct(w))::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS digest FROM a WHERE len(w) > 0"
    marked = q("(?i)(?:" + "|".join(f"(?:{p})" for p in probe["en"].phrases) + ")")
    x = rf"replace({D}, {NL} || {NL}, {NL} || {NL} || {NL} || {NL})"
    o["cleaning"] = rf"""WITH a AS (SELECT doc_id, {D} AS d, string_split('Claro, aquí va:' || {NL} || '**Título**' || {NL} || {NL} || '- ' || regexp_replace({x}, '[{WS}]+$', ''), {NL}) AS ls FROM documents),
b AS (SELECT *, list_transform(ls, lambda l: NOT (regexp_matches(l, '(?i)^\s*(aquí tienes|claro|por supuesto|a continuación|título\s*:|#)') OR (len({blanks('l')}) <= 12 AND NOT regexp_matches(regexp_replace(l, '[{WS}]+$', ''), '[.:]$')))) AS keep FROM a),
c AS (SELECT *, CASE WHEN list_contains(keep, true) THEN array_to_string(ls[list_position(keep, true):], {NL}) ELSE '' END AS g FROM b)
SELECT doc_id, md5({strip(rf"regexp_replace(regexp_replace(regexp_replace(g, '(?m)\*\*|__|^#+[\s\x0b\x{{85}}\pZ]*', '', 'g'), '(?m)^[\s\x0b\x{{85}}\pZ]*[-*•][\s\x0b\x{{85}}\pZ]+', '', 'g'), '\n{{3,}}', {NL} || {NL}, 'g')")}) AS generated,
md5({strip("replace(d, '**', '')")}) AS paraphrase, md5({strip(rf"regexp_replace(replace(replace(replace(regexp_replace('Resumen:  ' || d || '  &lt;ok&gt; ', '(?i)^\s*(resumen|introducci[oó]n)\s*[:.]?\s*', ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[{WS}]+', ' ', 'g')")}) AS abstract, md5(regexp_replace(d, {marked}, '<mark>\0</mark>', 'g')) AS marked FROM c"""
    o["token_statistics"] = f"""WITH a AS (SELECT doc_id, {lower_words(D)} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM a), s AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM t),
n AS (SELECT count(*) AS a, count(DISTINCT w) AS types FROM t), uni AS (SELECT w, (count(*) + 1) / (any_value(n.a) + any_value(n.types)) AS p FROM t, n GROUP BY w), bi AS (SELECT v, w, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL), nv AS (SELECT v, sum(n) AS nv FROM bi GROUP BY v),
perf AS (SELECT v, w, 0.5 * n / nv + 0.5 * p AS q, p FROM bi JOIN nv USING (v) JOIN uni USING (w)), h AS (SELECT sum(-p * ln(0.5 * p)) AS h FROM uni), cr AS (SELECT v, sum(-p * (ln(q) - ln(0.5 * p))) AS dh FROM perf GROUP BY v),
r AS (SELECT s.doc_id, -ln(perf.q) AS ppl, h.h + cr.dh AS xppl FROM s JOIN perf USING (v, w) JOIN cr USING (v), h) SELECT doc_id, count(*)::BIGINT AS n, round(avg(ppl), 5) AS ppl, round(avg(xppl), 5) AS xppl FROM r GROUP BY doc_id"""
    fixed = rf"""{WHOLE},
wl AS (SELECT doc_id, {words('t')} AS l, string_split_regex(t, '{WORD}') AS g FROM norm),
wt AS (SELECT doc_id, unnest(l) AS w, unnest(g[1:len(l)]) AS gap, generate_subscripts(l, 1) - 1 AS pos FROM wl),
tk AS (SELECT doc_id, pos, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY pos) - length(w) AS start_at, (1 + length(w) % 5)::DOUBLE AS ppl, (1 + length(w) % 7)::DOUBLE AS xppl FROM wt),
asg AS (SELECT tk.*, coalesce(s.sent_id, -1) AS sent_id FROM tk ASOF LEFT JOIN sents s ON tk.doc_id = s.doc_id AND tk.start_at >= s.start_at)"""
    o["token_sentences"] = f"WITH {fixed} SELECT doc_id, sent_id::INTEGER AS sent_id, count(*)::BIGINT AS n_tokens, sum(ppl) AS ppl, min(start_at)::INTEGER AS first_at FROM asg GROUP BY ALL"
    windows = f"""WITH {fixed},
per AS (SELECT s.doc_id, s.sent_id, count(a.pos) AS n, coalesce(sum(a.ppl), 0) AS a, coalesce(sum(a.xppl), 0) AS b FROM sents s LEFT JOIN asg a ON s.doc_id = a.doc_id AND s.sent_id = a.sent_id GROUP BY ALL),
cum AS (SELECT doc_id, sent_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS m, sum(n) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b FROM per WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
zero AS (SELECT doc_id, i, n, a, b FROM cum UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, 0 FROM cum),
lists AS (SELECT doc_id, list(n ORDER BY i) AS n, list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM zero GROUP BY doc_id),
rad AS (SELECT c.doc_id, c.sent_id, c.i, c.m, l.n, l.a, l.b, coalesce(list_filter(range(0, c.m + 1), lambda r: l.n[least(c.i + r, c.m) + 1] - l.n[greatest(c.i - r, 1)] >= 30)[1], c.m) AS r FROM cum c JOIN lists l USING (doc_id)),
win AS (SELECT *, greatest(i - r, 1) AS lo, least(i + r, m) AS hi FROM rad)
"""
    score = "(n[hi + 1] - n[lo])::BIGINT AS n_tokens, CASE WHEN n[hi + 1] - n[lo] > 0 THEN round((a[hi + 1] - a[lo]) / (b[hi + 1] - b[lo]), 6) END AS score"
    o["sentence_scores"] = windows + f"SELECT doc_id, sent_id::INTEGER AS sent_id, {score} FROM win"
    o["provided_sentence_scores"] = windows + f"SELECT doc_id, sent_id::INTEGER AS sent_id, (lo - 1)::INTEGER AS lo, (hi - 1)::INTEGER AS hi, {score} FROM win"
    sig = lambda z: f"1 / (1 + exp(-greatest(least({z}, 50), -50)))"
    o["signal_report"] = f"""WITH {features(probe, WHOLE)}, {fixed.split(WHOLE + ',')[1]},
ls AS (SELECT doc_id, avg(ppl) / avg(xppl) AS s FROM tk GROUP BY doc_id),
j AS (SELECT sc.doc_id, sc.style, ls.s, CASE WHEN lang = 'es' THEN (n % 100) / 100.0::DOUBLE END AS c, lang = 'es' AS cal FROM scored sc LEFT JOIN ls USING (doc_id)),
k AS (SELECT *, {sig(f"{lm['slope']}::DOUBLE * s + {lm['intercept']}")} AS lp, {sig('-1.2::DOUBLE - 1.0::DOUBLE * (s - 0.9::DOUBLE) / 0.1::DOUBLE + 0.5::DOUBLE * (style - 0.4::DOUBLE) / 0.2::DOUBLE + 1.25::DOUBLE * (ln(least(greatest(c, 1e-4), 1 - 1e-4) / (1 - least(greatest(c, 1e-4), 1 - 1e-4))) - 0.5::DOUBLE) / 3.0::DOUBLE')} AS mp FROM j)
SELECT doc_id, round(s, 6) AS lm_score, CASE WHEN s IS NOT NULL THEN round(lp, 6) END AS lm_p, cal AS calibrated, CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN round(mp, 6) END AS meta_p, round(CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN mp WHEN s IS NOT NULL THEN 0.8::DOUBLE * lp + 0.2::DOUBLE * style WHEN c IS NOT NULL THEN 0.3::DOUBLE * c + 0.7::DOUBLE * style ELSE style END, 6) AS p, s < {lm['threshold_low_fpr']}::DOUBLE AS predictable FROM k"""
    o["model_windows"] = f"""WITH a AS (SELECT doc_id, len({words(D)}) AS n FROM documents), b AS (SELECT *, range(1, n, 512) AS w, range(0, greatest(n, 1), 382) AS c FROM a)
SELECT doc_id, len(w)::INTEGER AS n_windows, coalesce(list_sum(list_transform(w, lambda s: least(s + 512, n) - s)), 0)::BIGINT AS scored, coalesce(list_sum(list_transform(w, lambda s: s - greatest(s - 64, 0))), 0)::BIGINT AS context, len(c)::INTEGER AS n_chunks,
list_sum(list_transform(c, lambda s: least(s + 382, n) - CASE WHEN s > 0 AND n - s < 95 THEN greatest(n - 382, 0) ELSE s END))::BIGINT AS chunked FROM b"""
    style_reason = ", ".join([
        f"CASE WHEN burst < 0.35 AND ns >= 5 THEN {q(L.STYLE_REASONS['uniform_sentences'])} END",
        "CASE WHEN rate >= 1 THEN " + " || h::VARCHAR || ".join(q(x) for x in L.STYLE_REASONS["phrases"].split("{n}")) + " END",
        f"CASE WHEN conn >= 0.3 THEN {q(L.STYLE_REASONS['connectors'])} END",
        f"CASE WHEN pv < 0.2 THEN {q(L.STYLE_REASONS['uniform_paragraphs'])} END",
    ])
    common = f"CASE WHEN n < 250 THEN {q(L.WARNINGS['short'].format(n=250))} END, CASE WHEN raw > 300000 THEN {q(L.WARNINGS['truncated'].format(n='300,000'))} END, CASE WHEN lang = 'en' THEN {q(L.WARNINGS['english'])} END"
    o["report_files"] = f"WITH {f} SELECT doc_id, {rnd('style', 3)} AS p, {verdict('style')} AS verdict, md5(concat_ws('|', {style_reason})) AS reasons, md5(concat_ws('|', {common}, {q(L.WARNINGS['style_only'])})) AS warnings FROM scored WHERE n >= 80"
    m, g = L.Mixing(), L.GUIDANCE
    both = f"{m.lm_classifier_style[0]}::DOUBLE * lm + {m.lm_classifier_style[1]}::DOUBLE * clf + {m.lm_classifier_style[2]}::DOUBLE * style"
    starts = lambda x: q(r"(?i)^(" + "|".join(x.connectors) + r")(?:[^\p{L}\p{N}_]|$)")
    phrases = lambda x: q("(?i)(?:" + "|".join(f"(?:{p})" for p in x.phrases) + ")")
    by_lang = lambda make: f"CASE WHEN lang = 'en' THEN {make(probe['en'])} ELSE {make(probe['es'])} END"
    found = by_lang(lambda x: f"regexp_extract_all(text, {phrases(x)})")
    first = by_lang(lambda x: f"nullif(regexp_extract(text, {starts(x)}, 1), '')")
    listed = " || list_aggregate(list_transform(ph[1:6], lambda w: '«' || w || '»'), 'string_agg', ', ') || ".join(q(x) for x in g["phrases"][0].split("{list}"))
    a, b = g["connectors"][0].removeprefix("{n}").split("{list}")
    chained = f"len(co)::VARCHAR || {q(a)} || list_aggregate(co[1:4], 'string_agg', ', ') || {q(b)}"
    o["signalled_report"] = f"""WITH {f},
sig AS (SELECT *, (doc_id % 101) / 101 AS lm, CASE WHEN lang = 'es' THEN (doc_id % 97 + 3) / 100 END AS clf, (doc_id % 13) / 10 + 0.3::DOUBLE AS score FROM scored WHERE n >= 80),
docp AS (SELECT *, CASE WHEN clf IS NOT NULL THEN {both} ELSE {m.lm_style[0]}::DOUBLE * lm + {m.lm_style[1]}::DOUBLE * style END AS p FROM sig),
sp AS (SELECT x.doc_id, x.sent_id, x.paragraph, x.start_at, x.text, x.n, x.lang, d.p AS dp, CASE WHEN x.sent_id < 40 THEN least(1.0::DOUBLE, ((x.doc_id * 7 + x.sent_id * 37) % 100) / 100 + 0.05::DOUBLE * least(x.h, 2)) ELSE d.style END AS raw, sum(x.n) OVER (PARTITION BY x.doc_id, x.paragraph) AS pw FROM hits x JOIN docp d USING (doc_id)),
cap AS (SELECT *, CASE WHEN pw < 8 THEN least(raw, dp) ELSE raw END AS p, {found} AS ph, {first} AS co FROM sp),
par AS (SELECT doc_id, paragraph, list_reduce(list(p * greatest(n, 1) ORDER BY sent_id), lambda a, b: a + b) / sum(greatest(n, 1)) AS p, count(*) AS k, coalesce(sqrt(greatest(avg(n * n) - avg(n) * avg(n), 0)), 0) / greatest(avg(n), 1) AS spread, list_sort(list_distinct(list_transform(flatten(list(ph)), lambda w: lower(w)))) AS ph, coalesce(list(co ORDER BY sent_id) FILTER (WHERE co IS NOT NULL), []) AS co FROM cap GROUP BY ALL),
own AS (SELECT *, len(ph) > 0 AS has, len(co) >= 2 AS many, k >= 3 AND spread < 0.3 AS even FROM par),
gui AS (SELECT o.*, pr.p AS body, concat_ws(';', CASE WHEN has THEN {listed} END, CASE WHEN many THEN {chained} END, CASE WHEN even THEN {q(g['rhythm'][0])} END, CASE WHEN o.p >= 0.65 AND NOT has AND NOT many AND NOT even THEN {q(g['predictable'])} END) AS why,
  concat_ws(';', CASE WHEN has THEN {q(g['phrases'][1])} END, CASE WHEN many THEN {q(g['connectors'][1])} END, CASE WHEN even THEN {q(g['rhythm'][1])} END, CASE WHEN o.p >= 0.35 THEN {q(g['voice'])} END) AS tips FROM own o JOIN pars pr ON o.doc_id = pr.doc_id AND o.paragraph = pr.k - 1),
pd AS (SELECT doc_id, md5(string_agg({strip('body')} || '~' || round({rnd('p', 3)} * 1000)::BIGINT || '~' || {level('p')} || '~' || why || '~' || tips, '|' ORDER BY paragraph)) AS digest FROM gui GROUP BY doc_id),
sd AS (SELECT doc_id, md5(string_agg(start_at || '~' || round({rnd('p', 3)} * 1000)::BIGINT || '~' || {level('p')}, '|' ORDER BY sent_id)) AS digest, sum(n) FILTER (WHERE p >= 0.65) AS flagged, sum(n) AS whole FROM cap GROUP BY doc_id)
SELECT doc_id, {rnd('p', 3)} AS p, {verdict('p')} AS verdict, CASE WHEN n < 250 THEN 'baja' WHEN n >= 500 AND abs(p - 0.5) > 0.3 AND (p >= 0.5) = (style >= 0.5) THEN 'alta' ELSE 'media' END AS confidence, {rnd('coalesce(flagged, 0) / greatest(whole, 1)', 3)} AS flagged_fraction,
md5(concat_ws('|', CASE WHEN clf >= 0.9 AND p >= 0.65 THEN {q(L.CLASSIFIER_REASON)} END, CASE WHEN score < 0.9 THEN {q(L.PREDICTABLE_REASON)} END, {style_reason})) AS reasons, md5(concat_ws('|', {common}, CASE WHEN doc_id % 2 <> 0 THEN {q(L.WARNINGS['uncalibrated'])} END)) AS warnings, pd.digest AS paragraphs, sd.digest AS sentences
FROM docp JOIN pd USING (doc_id) JOIN sd USING (doc_id)"""
    o["corpus_files"] = f"SELECT doc_id::VARCHAR AS id, source AS source_id, (doc_id % 2)::INTEGER AS label, lang AS domain, len({blanks(D)})::INTEGER AS words, md5({D}) AS digest FROM documents"
    o["split_files"] = f"SELECT CASE WHEN {draw('source')} < 0.3 THEN 'test' ELSE 'train' END AS split, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL"
    o["score_files"] = f"WITH {LABELLED} SELECT doc_id::VARCHAR AS id, p AS score FROM labelled"
    o["reject_files"] = o["spanish_filter"].replace("SELECT doc_id, spanish, CASE", "SELECT doc_id, CASE") + " WHERE len(" + blanks("x") + ") < 100 OR NOT spanish"
    d = L.Calibration()
    pick = lambda k, es: f"CASE WHEN lang = 'en' THEN {float(getattr(d, k))}::DOUBLE ELSE {es}::DOUBLE END AS {k}"
    o["artefact_files"] = f"SELECT doc_id, lang, {pick('slope', -12.0)}, {pick('intercept', 11.0)}, {pick('threshold_low_fpr', 0.9)}, lang = 'es' AS calibrated FROM documents"
    o["table_files"] = f"SELECT doc_id::VARCHAR AS id, (doc_id % 3 = 0)::INTEGER AS label, lang AS domain, md5({D}) AS digest FROM documents"
    o["text_files"] = f"SELECT source, length(t)::INTEGER AS chars, md5(t) AS digest, NULL::VARCHAR AS error FROM (SELECT source, string_agg(text || {NL}, '' ORDER BY doc_id) AS t FROM documents GROUP BY source) UNION ALL SELECT '', NULL, NULL, 'unsupported format: .csv'"
    o["works"] = rf"""WITH a AS (SELECT doc_id, source, array_to_string({blanks(f"'Resumen: Un &lt;b&gt; <i>texto</i> Abstract ' || {D} || ' Keywords a, b'")}, ' ') AS t FROM documents WHERE length({D}) > 0)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'doi:' ELSE 'id:' END || doc_id AS url, CASE WHEN doc_id % 3 > 0 THEN source ELSE '(sin título)' END AS title, 'OpenAlex' AS kind,
md5({strip(rf"regexp_replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '[{WS}]+', ' ', 'g')")}) AS digest FROM a"""
    o["source_duplicates"] = f"SELECT 'u' || (doc_id % 50) AS url, arg_max(source, doc_id) AS title, arg_max(lang, doc_id) AS kind, md5(arg_max({D}, doc_id)) AS digest, min(doc_id) AS ord FROM documents GROUP BY 1"
    places = lambda t, k: f"SELECT {k}, array_to_string(w[i:i + 4], ' ') AS g, min(i) AS i FROM (SELECT {k}, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM (SELECT {k}, {tokens(t[1])} AS w FROM {t[0]})) GROUP BY ALL"
    o["gram_sets"] = f"""WITH m AS ({places(('documents', D), 'doc_id')}), t AS ({places(('benchmark', 'text'), 'item_id')}), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT doc_id, item_id, count(*)::INTEGER AS n_shared, md5(string_agg(g, '|' ORDER BY m.i)) AS shared, (any_value(n) - count(*))::INTEGER AS n_only, round(count(*) / any_value(n), 6) AS share FROM m JOIN t USING (g) JOIN n USING (doc_id) GROUP BY doc_id, item_id"""
    squeezed = strip(f"regexp_replace(p, '[{WS}]+', ' ', 'g')")
    o["docx_files"] = f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split({D}, {NL} || {NL}), lambda p: {squeezed}), lambda p: p <> '' AND NOT regexp_matches(p, {q(L.REFERENCE_LINE)})) AS ps FROM documents), b AS (SELECT doc_id, array_to_string(ps || ['Cita (Ruiz)'], {NL} || {NL}) AS t FROM a)
SELECT doc_id, length(t)::INTEGER AS chars, md5(t) AS digest, NULL::VARCHAR AS error FROM b"""
    o["zip_files"] = f"SELECT doc_id, md5({D}) AS digest, NULL::VARCHAR AS home FROM documents WHERE doc_id % 5 > 0 AND {D} <> ''"
    o["provided_texts"] = f"SELECT doc_id, length({D}) || ':' || substr({D}, 1, 12) AS answer FROM documents"
    o["slices"] = f"""WITH {WHOLE}, g AS (SELECT doc_id, paragraph, min(start_at) AS a, max(start_at + length(text)) AS b FROM sents GROUP BY ALL), h AS (SELECT doc_id, paragraph, substr(t, (a + 1)::BIGINT, (b - a)::BIGINT) AS x FROM g JOIN norm USING (doc_id))
SELECT doc_id, paragraph::INTEGER AS paragraph, md5(x) AS digest, regexp_matches('Ruiz, A. B. (20' || (doc_id % 30) || '). ' || x, {q(L.REFERENCE_LINE)}) AS reference, regexp_matches(x, {q(L.REFERENCE_LINE)}) AS own_reference FROM h"""
    o["padded_batches"] = f"""WITH a AS (SELECT doc_id, length({D})::INTEGER AS size FROM documents), b AS (SELECT *, greatest(length(bin(size)) - 4, 0) AS s FROM a), c AS (SELECT *, (s * 16 + (size >> s))::INTEGER AS class, (((size >> s) + 1)::BIGINT << s) - 1 AS most FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY size, doc_id) - 1 AS place FROM c), e AS (SELECT *, (place // greatest(1, 50000 // greatest(most, 1)))::BIGINT AS batch FROM d)
SELECT class, batch, count(*)::BIGINT AS n, min(size) AS shortest, max(size) AS longest, (count(*) * max(size))::BIGINT AS cost, sum(doc_id)::BIGINT AS ids FROM e GROUP BY ALL"""
    o["rewrite_change"] = rf"""WITH a AS (SELECT doc_id, len(regexp_extract_all(lower({D}), '[\p{{L}}\p{{N}}_]+')) AS a, len(regexp_extract_all(lower(array_to_string({blanks(D)}[1:40], ' ')), '[\p{{L}}\p{{N}}_]+')) AS b FROM documents)
SELECT doc_id, CASE WHEN a + b > 0 THEN 1 - (2 * b) / (a + b) ELSE 0 END::DOUBLE AS change, b / greatest(a, 1) AS kept, b / greatest(a, 1) AS length_ratio FROM a"""
    o["contains_rules"] = "SELECT doc_id, contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'copyright') AS licensed, doc_id % 2 = 0 AND (contains(lower(source), 'src1') OR contains(lower(source), '9')) AS picked FROM documents"
    o["chunk_scores"] = f"""WITH a AS (SELECT doc_id, len({words(D)}) AS n FROM documents), b AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 382)) AS s FROM a), c AS (SELECT doc_id, CASE WHEN s > 0 AND n - s < 95 THEN greatest(n - 382, 0) ELSE s END AS s, least(s + 382, n) AS e FROM b)
SELECT doc_id, round(sum((s % 97) / 97 * (e - s)) / nullif(sum(e - s), 0), 6) AS classifier_p FROM c GROUP BY doc_id"""
    o["length_order"] = f"SELECT doc_id, length({D})::INTEGER AS chars FROM documents"
    mixed = f"CASE WHEN lang = 'en' THEN {m.lm_classifier_style[0]}::DOUBLE * p + {m.lm_classifier_style[1]}::DOUBLE * q + {m.lm_classifier_style[2]}::DOUBLE * r ELSE {m.lm_style[0]}::DOUBLE * p + {m.lm_style[1]}::DOUBLE * r END"
    o["fixed_weights"] = f"WITH {LABELLED}, t AS (SELECT *, (doc_id % 89) / 89 AS r FROM labelled) SELECT doc_id, {rnd(mixed, 6)} AS fixed_p FROM t"
    o["window_tokens"] = f"""WITH {fixed}, x AS (SELECT doc_id, w, pos, sum(length(gap) + length(w)) OVER o AS stop, length(w) AS n, coalesce(lag(length(w), 1) OVER o, 0) AS n1, coalesce(lag(length(w), 64) OVER o, 0) AS n64 FROM wt WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*)::BIGINT AS n, sum(pos * (1 + (n + 2 * n1 + 3 * n64) % 11))::BIGINT AS by_place, sum((stop - n) * (1 + (n + n64) % 7) + stop)::BIGINT AS by_start FROM x WHERE pos > 0 GROUP BY doc_id"""
    o["chunk_classifier"] = f"""WITH a AS (SELECT doc_id, list_transform({words(norm(D))}, lambda w: length(w)) AS l FROM documents), b AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, greatest(len(l), 1), 382)) AS s FROM a), c AS (SELECT doc_id, l, CASE WHEN s > 0 AND n - s < 95 THEN greatest(n - 382, 0) ELSE s END AS s, least(s + 382, n) AS e FROM b),
p AS (SELECT doc_id, e - s AS k, (coalesce(list_sum(list_transform(range(s, e), lambda i: l[i + 1] * (i - s + 1))), 0) % 97) / 97 AS p FROM c) SELECT doc_id, round(sum(p * k) / nullif(sum(k), 0), 6) AS classifier_p FROM p GROUP BY doc_id"""
    o["gram_features"] = f"""WITH a AS (SELECT doc_id, regexp_extract_all(hex(encode(' ' || coalesce({D}, '') || ' ')), '..') AS h FROM documents), g AS (SELECT doc_id, ('0x' || h[i] || h[i + 1] || h[i + 2])::BIGINT % 16381 AS b FROM (SELECT doc_id, h, unnest(range(1, len(h) - 1)) AS i FROM a)),
k AS (SELECT doc_id, b, count(*) AS n FROM g GROUP BY ALL) SELECT a.doc_id, count(b)::INTEGER AS n_features, coalesce(sum(n), 0)::BIGINT AS n_grams, coalesce(sum(b * n), 0)::BIGINT AS weighted FROM a LEFT JOIN k USING (doc_id) GROUP BY a.doc_id"""
    o["backoff_statistics"] = f"""WITH a AS (SELECT doc_id, {lower_words(D)} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM a),
s AS (SELECT doc_id, pos, w, coalesce(lag(w, 1) OVER o, '') AS v, coalesce(lag(w, 2) OVER o, '') AS u FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
tri AS (SELECT u, v, w, count(*) AS c FROM s GROUP BY ALL), bi AS (SELECT v, w, count(*) AS k FROM tri GROUP BY ALL), uni AS (SELECT w, count(*) AS m FROM bi GROUP BY w), z AS (SELECT sum(m) AS a, count(*) AS types FROM uni),
one AS (SELECT w, (m - 0.75::DOUBLE) / a + 0.75::DOUBLE * types / a / (types + 1) AS p1 FROM uni, z), least AS (SELECT 0.75::DOUBLE * types / a / (types + 1) AS p FROM z), h1 AS (SELECT (SELECT sum(p1 * ln(p1)) FROM one) + p * ln(p) AS h FROM least),
two AS (SELECT v, w, (k - 0.75::DOUBLE) / sum(k) OVER x + l2 * p1 AS p2, l2 * p1 AS rest, l2 FROM (SELECT *, 0.75::DOUBLE * count(*) OVER (PARTITION BY v) / sum(k) OVER (PARTITION BY v) AS l2 FROM bi) JOIN one USING (w) WINDOW x AS (PARTITION BY v)),
h2 AS (SELECT v, any_value(l2) * (ln(any_value(l2)) + any_value(h)) + sum(p2 * ln(p2) - rest * ln(rest)) AS h FROM two, h1 GROUP BY v),
three AS (SELECT u, v, w, p2, (c - 0.75::DOUBLE) / sum(c) OVER x + 0.75::DOUBLE * count(*) OVER x / sum(c) OVER x * p2 AS p3, 0.75::DOUBLE * count(*) OVER x / sum(c) OVER x AS l3 FROM tri JOIN two USING (v, w) WINDOW x AS (PARTITION BY u, v)),
cr AS (SELECT u, v, -(ln(any_value(l3)) + any_value(h)) - sum(p2 * (ln(p3) - ln(l3 * p2))) AS x FROM three JOIN h2 USING (v) GROUP BY u, v)
SELECT doc_id, count(*)::BIGINT AS n, round(avg(-ln(p3)), 5) AS ppl, round(avg(x), 5) AS xppl FROM s JOIN three USING (u, v, w) JOIN cr USING (u, v) WHERE pos > 1 GROUP BY doc_id"""
    tag = r"""(?:[^>"='']|=\s*(?:"[^"]*"|''[^'']*'')|=|["''])*"""  # quotes are doubled for SQL
    whole = "|".join(rf"<{k}(?:[\s/]{tag})?>.*?</{k}\s*>" for k in ("script", "style"))
    plain = "substr(x, strpos(x, chr(2)) + 1)"
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"), ("&nbsp;", "chr(160)"), ("&hellip;", "'…'"), ("&ndash;", "'–'"), ("&mdash;", "'—'"), ("&amp;", "'&'")):
        plain = f"replace({plain}, '{name}', {char})"
    # markup in marks, then events by page and place; windows sum the steps and take the least sum so far
    o["html_paragraphs"] = rf"""WITH a AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '(?is)(<!--.*?--\s*>|<[!?][^>]*>|{whole}|<[a-z]{tag}>|</\s*[a-z]{tag}>)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM pages),
e AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a), n AS (SELECT *, string_split(x, chr(2))[1] AS t, lower(regexp_extract(string_split(x, chr(2))[1], '(?i)^</?([a-z][^\t\n\r\f />]*)', 1)) AS name FROM e WHERE i > 1),
s AS (SELECT *, starts_with(t, '</') AS back, CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN 0 ELSE 1 END AS step FROM n),
d AS (SELECT *, CASE WHEN name IN ('table', 'sup', 'figure') THEN step WHEN name IN ('script', 'style') AND back THEN -1 ELSE 0 END AS h, CASE WHEN name = 'p' THEN step ELSE 0 END AS p FROM s),
c AS (SELECT *, sum(h) OVER w AS hs, sum(p) OVER w AS ps FROM d WINDOW w AS (PARTITION BY page_id ORDER BY i)), f AS (SELECT *, hs - least(0, min(hs) OVER w) AS hidden, ps - least(0, min(ps) OVER w) AS open FROM c WINDOW w AS (PARTITION BY page_id ORDER BY i)),
g AS (SELECT *, name = 'p' AND (back AND coalesce(lag(open) OVER w, 0) > 0 OR NOT back AND step = 0) AS cut FROM f WINDOW w AS (PARTITION BY page_id ORDER BY i)),
r AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY page_id ORDER BY i) AS k FROM g), q AS (SELECT page_id, k, string_agg(CASE WHEN open > 0 AND hidden = 0 THEN {plain} ELSE '' END, '' ORDER BY i) AS raw FROM r GROUP BY page_id, k), o AS (SELECT * FROM q QUALIFY k < max(k) OVER (PARTITION BY page_id)),
z AS (SELECT page_id, k, {strip(f"regexp_replace(raw, '[{WS}]+', ' ', 'g')")} AS t FROM o), y AS (SELECT page_id, list(t ORDER BY k) AS ps FROM z WHERE len({blanks('t')}) >= 15 GROUP BY page_id)
SELECT page_id, coalesce(len(ps), 0)::INTEGER AS n, md5(coalesce(array_to_string(ps, '|'), '')) AS digest FROM pages LEFT JOIN y USING (page_id)"""
    o["html_paragraphs_native"] = o["html_paragraphs"]
    return o
