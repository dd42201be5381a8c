"""DuckDB renderings of the operators, used as the correctness oracle.

The SQL is generated from the same literal rule tables as the Spark Columns, so both
engines evaluate one rule set; each engine runs its own regex, string, JSON and aggregate
implementations.
"""

from __future__ import annotations

from .. import catalogue as cat
from ..operators.detect import CONTEXT_CHARS
from ..operators.verify import DEFAULT_WINDOW, REASON_ALL_NEGATIVE, REASON_UNCERTAIN


def q(s: str) -> str:
    """SQL string literal (DuckDB: no backslash escapes, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def detect_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """One row per occurrence; overlaps are settled rule by rule, each against those kept before."""
    w = CONTEXT_CHARS
    ctes, kept = [f"src AS (SELECT row_number() OVER () AS r, {id_col}, {text_col} AS t FROM {table})"], []
    for k, (etype, label, pattern, group) in enumerate(cat.DETECTION_RULES):
        lengths = "list_sum(list_transform({0}, lambda x: length(x)))"
        start = f"coalesce({lengths.format('g[1:i]')}, 0) + coalesce({lengths.format('h[1:i - 1]')}, 0)"
        if group:
            start = f"{start} + length(h[i]) - {cat.DETECTION_TAILS[etype]} - length(v[i])"
        ctes.append(f"h{k} AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT r, {id_col}, t, "
                    f"regexp_extract_all(t, {q(pattern)}) AS h, regexp_extract_all(t, {q(pattern)}, {group}) AS v, "
                    f"regexp_split_to_array(t, {q(pattern)}) AS g FROM src) s WHERE len(h) > 0)")
        ctes.append(f"p{k} AS (SELECT r, {id_col}, t, v[i] AS entity_value, CAST({start} AS BIGINT) AS a FROM h{k})")
        ok = ["length(entity_value) > 0"]
        if etype == "IPV4":
            ok.append("greatest(" + ", ".join(f"CAST(split_part(entity_value, '.', {i}) AS INTEGER)" for i in range(1, 5)) + ") <= 255")
        if etype in cat.DETECTION_EDGES:
            left, right = cat.DETECTION_EDGES[etype]
            ok.append(f"NOT regexp_matches(CASE WHEN a > 1 THEN substring(t, a - 1, 2) ELSE substring(t, 1, a) END, {q(left)})")
            ok.append(f"NOT regexp_matches(substring(t, a + length(entity_value) + 1, 2), {q(right)})")
        for j in range(k):
            ok.append(f"NOT EXISTS (SELECT 1 FROM k{j} o WHERE o.r = p.r AND o.a < p.a + length(p.entity_value) "
                      f"AND p.a < o.a + length(o.entity_value))")
        # materialised: each level reads all levels before it
        ctes.append(f"k{k} AS MATERIALIZED (SELECT *, {q(etype)} AS entity_type, {q(label)} AS label FROM p{k} p WHERE "
                    + " AND ".join(ok) + ")")
        kept.append(f"SELECT * FROM k{k}")
    start = f"greatest(a - {w}, 0)"
    return f"""(
WITH {", ".join(ctes)}
SELECT {id_col}, entity_type, label, entity_value, CAST(a + 1 AS BIGINT) AS pos,
       substring(t, {start} + 1, a - {start} + length(entity_value) + {w}) AS context,
       CAST(a - {start} AS INTEGER) AS ctx_offset
FROM ({" UNION ALL ".join(kept)}) u)"""


def luhn_fail_sql(v: str) -> str:
    d = f"reverse(regexp_replace({v}, '[^0-9]', '', 'g'))"
    dig = f"CAST(substring({d}, i, 1) AS INTEGER)"
    total = (f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
             f"CASE WHEN i % 2 = 1 THEN {dig} WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 "
             f"ELSE {dig} * 2 END))")
    return f"NOT (length({d}) > 0 AND coalesce({total}, 0) % 10 = 0)"


def _hit_sql(scope: str, pattern: str, v: str, c: str) -> str:
    if scope == "after":
        return f"regexp_matches(vafter, {q(pattern)})"
    if scope == "value":
        return f"regexp_matches({v}, {q(pattern)})"
    if scope == "context":
        return f"regexp_matches({c}, {q(pattern)})"
    if scope == "context_absent":
        return f"NOT regexp_matches({c}, {q(pattern)})"
    if scope == "luhn_fail":
        return luhn_fail_sql(v)
    raise ValueError(scope)


def _first_sql(rules, t: str, v: str, c: str, pick) -> str:
    if not rules:
        return "NULL"
    whens = " ".join(f"WHEN {t} = {q(r[0])} AND {_hit_sql(r[2], r[3], v, c)} THEN {pick(r)}"
                     for r in rules)
    return f"CASE {whens} END"


def verify_select_sql(t: str = "entity_type", v: str = "entity_value", c: str = "vctx") -> str:
    """SELECT-list fragment (guard_reason, own, spec, ctx, verified, confidence, reason)."""
    rules = cat.VERIFY_RULES
    guard = _first_sql([r for r in rules if r[1] == "guard"], t, v, c, lambda r: q(r[5]))
    tests = {}
    why = {}
    for name in cat.TESTS:
        tr = [r for r in rules if r[1] == name]
        raw = _first_sql(tr, t, v, c, lambda r: "TRUE" if r[4] else "FALSE")
        tests[name] = f"(CASE WHEN ({guard}) IS NOT NULL THEN FALSE ELSE CAST({raw} AS BOOLEAN) END)"
        why[name] = _first_sql(tr, t, v, c, lambda r: q(r[5]))
    all_false = " AND ".join(f"NOT coalesce({tests[n]}, TRUE)" for n in cat.TESTS)
    verified = f"(NOT ({all_false}))"
    n_true = " + ".join(f"CAST(coalesce({tests[n]}, FALSE) AS INTEGER)" for n in cat.TESTS)
    conf = (f"CAST(CASE WHEN ({guard}) IS NOT NULL THEN 0.1 WHEN NOT {verified} THEN 0.2 "
            f"WHEN ({n_true}) = 0 THEN 0.5 WHEN ({n_true}) = 1 THEN 0.65 "
            f"WHEN ({n_true}) = 2 THEN 0.8 ELSE 0.95 END AS DOUBLE)")
    reason = f"CASE WHEN ({guard}) IS NOT NULL THEN ({guard}) WHEN NOT {verified} THEN {q(REASON_ALL_NEGATIVE)} "
    for n in cat.TESTS:
        reason += f"WHEN {tests[n]} THEN {q(cat.TEST_NAMES[n] + ': ')} || ({why[n]}) "
    reason += f"ELSE {q(REASON_UNCERTAIN)} END"
    return (f"CAST({guard} AS VARCHAR) AS guard_reason, {tests['own']} AS own, "
            f"{tests['spec']} AS spec, {tests['ctx']} AS ctx, {verified} AS verified, "
            f"{conf} AS confidence, {reason} AS reason")


def narrow_sql(window: int = DEFAULT_WINDOW) -> str:
    s = f"greatest(ctx_offset - {window}, 0)"
    return f"substring(context, {s} + 1, ctx_offset - {s} + length(entity_value) + {window})"


def verify_sql(cands_sql: str, window: int = DEFAULT_WINDOW) -> str:
    return f"""(
SELECT *, {verify_select_sql()}
FROM (SELECT *, {narrow_sql(window)} AS vctx,
             substring(context, ctx_offset + length(entity_value) + 1, {window}) AS vafter
      FROM {cands_sql} c0) c1)"""


def model_label_verdicts_sql(models) -> str:
    """Label-level verdicts of the rule-verifier variants (see operators.consolidate)."""
    from ..operators.consolidate import REASON_NO_GUARD
    parts = []
    for i, m in enumerate(models):
        if m.mode == "guards_only":
            verdict = f"guard_reason IS NULL AS verified, coalesce(guard_reason, {q(REASON_NO_GUARD)}) AS reason"
        else:
            verdict = "verified, reason"
        types = "" if m.types is None else "WHERE entity_type IN (" + ", ".join(q(t) for t in m.types) + ")"
        parts.append(f"SELECT doc_id, label, pos, {q(m.name)} AS model, {i} AS model_idx, {verdict} "
                     f"FROM {verify_sql(detect_sql(), m.window)} v{i} {types}")
    union = "\nUNION ALL\n".join(parts)
    return f"""(
SELECT doc_id, model, model_idx, label, bool_or(verified) AS verified,
       arg_min(reason, (NOT verified, pos)) AS reason
FROM ({union}) u GROUP BY doc_id, model, model_idx, label)"""


def truncate_sql(col: str, n: int = 200) -> str:
    return f"CASE WHEN length({col}) <= {n} THEN {col} ELSE substring({col}, 1, {n - 3}) || '...' END"


def long_sql(models) -> str:
    """The long consolidation view (record_id, input_text, model, load_order, pii, verified, reason)."""
    return f"""(
SELECT CAST(l.doc_id AS VARCHAR) AS record_id, {truncate_sql('d.text')} AS input_text, l.model,
       CAST(l.model_idx AS BIGINT) AS load_order, l.label AS pii, l.verified, l.reason
FROM {model_label_verdicts_sql(models)} l JOIN documents d ON d.doc_id = l.doc_id)"""


# ----------------------------------------------------------------------------- text helpers
_WS = "[ \\t\\n\\r\\f\\x0B]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def words_sql(x: str) -> str:
    s = strip_sql(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{_WS}+') END)"


def draw_sql(seed: str, m: int, *parts: str) -> str:
    from ..functions.draw import draw_sql as d
    return d(seed, m, *parts)


def detected_records_sql() -> str:
    """Documents with at least one detected label: (doc_id, text, piis sorted distinct)."""
    return f"""(SELECT d.doc_id, d.text, c.piis FROM documents d JOIN
  (SELECT doc_id, list_sort(list_distinct(list(label))) AS piis FROM {detect_sql()} c0 GROUP BY doc_id) c
  ON d.doc_id = c.doc_id)"""


def json_slice_sql(s: str) -> str:
    last = f"(length({s}) - strpos(reverse({s}), '}}') + 1)"
    return (f"(CASE WHEN strpos({s}, '{{') > 0 AND strpos({s}, '}}') > 0 AND {last} > strpos({s}, '{{') "
            f"THEN substring({s}, strpos({s}, '{{'), {last} - strpos({s}, '{{') + 1) END)")


# ----------------------------------------------------------------------------- prompts
def render_sql(template: str, values: dict[str, str]) -> str:
    from ..operators.prompts import _PH
    pieces, pos = [], 0
    for m in _PH.finditer(template):
        if m.group(1) in values:
            pieces.append(q(template[pos:m.start()]))
            pieces.append(f"({values[m.group(1)]})")
            pos = m.end()
    pieces.append(q(template[pos:]))
    return "(" + " || ".join(pieces) + ")"


def catalogue_map_sql() -> str:
    d = {}
    for name, _c, desc in cat.LABEL_CATALOGUE:
        if name and desc:
            d[name] = desc
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def list_repr_sql(lst: str) -> str:
    return (f"('[' || array_to_string(list_transform({lst}, lambda x: CASE WHEN strpos(x, '''') > 0 "
            f"THEN '\"' || x || '\"' ELSE '''' || x || '''' END), ', ') || ']')")


def describe_sql(lst: str) -> str:
    return (f"(CASE WHEN len({lst}) = 0 THEN {q(cat.NO_PIIS)} ELSE array_to_string(list_transform({lst}, "
            f"lambda p: '- **' || p || '**: ' || coalesce(({catalogue_map_sql()})[p], {q(cat.NO_DESCRIPTION)})), "
            f"chr(10)) END)")


def batch_prompt_sql(text: str, lst: str, mode: str) -> str:
    return render_sql(cat.BATCH_PROMPT, {
        "input_text": text, "detected_piis": list_repr_sql(lst),
        "element_descriptions": describe_sql(lst),
        "response_rules": f"CASE WHEN {mode} = 'reasoning' THEN {q(cat.REASONING_RULES)} ELSE {q(cat.SIMPLE_RULES)} END",
        "output_example": f"CASE WHEN {mode} = 'reasoning' THEN {q(cat.REASONING_EXAMPLE)} ELSE {q(cat.SIMPLE_EXAMPLE)} END",
    })


def single_prompt_sql(ctx: str, t: str, v: str) -> str:
    return render_sql(cat.SINGLE_PROMPT, {"context": ctx, "entity_type": t, "entity_value": v})


# ----------------------------------------------------------------------------- replies
def simple_reply_sql(id_col: str, lst: str) -> str:
    kept = f"list_filter({lst}, lambda d: {draw_sql('keep', 10, id_col, 'd')} < 7)"
    vs = f"(CASE WHEN len({kept}) = 0 THEN 'NONE' ELSE array_to_string({kept}, ', ') END)"
    firsts = (f"(CASE WHEN len({kept}) = 0 THEN 'NONE' ELSE array_to_string(list_transform({kept}, "
              f"lambda v: split_part(v, ' ', 1)), ', ') END)")
    as_json = (f"('superf00k {{\"verified_piis\":[' || array_to_string(list_transform({kept}, "
               f"lambda v: '\"' || v || '\"'), ',') || ']}}')")
    k = draw_sql("simple", 10, id_col)
    return (f"(CASE WHEN {k} <= 1 THEN {vs} WHEN {k} = 2 THEN 'Here is the list: ' || {vs} "
            f"WHEN {k} = 3 THEN lower({vs}) WHEN {k} = 4 THEN {firsts} "
            f"WHEN {k} = 5 THEN {vs} || chr(10) || 'These are verified.' "
            f"WHEN {k} = 6 THEN 'I apologize, ' || {vs} WHEN {k} = 7 THEN {as_json} "
            f"WHEN {k} = 8 THEN '' ELSE 'Salary, Weight' END)")


def reasoning_reply_sql(id_col: str, lst: str) -> str:
    from ..operators.scorer import DROP_REASON, KEEP_REASON
    keep = f"({draw_sql('keep', 10, id_col, 'd')} < 7)"
    item = (f"'{{\"pii\": \"' || d || '\", \"verified\": ' || CASE WHEN {keep} THEN 'true' ELSE 'false' END "
            f"|| ', \"reason\": \"' || CASE WHEN {keep} THEN {q(KEEP_REASON)} ELSE {q(DROP_REASON)} END || '\"}}'")
    body = f"('{{\"results\": [' || array_to_string(list_transform({lst}, lambda d: {item}), ', ') || ']}}')"
    k = draw_sql("reasoning", 10, id_col)
    return (f"(CASE WHEN {k} <= 2 THEN {body} "
            f"WHEN {k} = 3 THEN '```json' || chr(10) || {body} || chr(10) || '```' "
            f"WHEN {k} = 4 THEN replace(replace({body}, ': true', ': True'), ': false', ': False') "
            f"WHEN {k} = 5 THEN '```' WHEN {k} = 6 THEN '{{\"answer\": []}}' "
            f"WHEN {k} = 7 THEN 'I cannot say.' WHEN {k} = 8 THEN substring({body}, 1, strpos({body}, '}}')) "
            f"ELSE {body} || ' and {{\"x\": 1}}' END)")


def single_reply_sql(id_col: str, v: str) -> str:
    from ..operators.scorer import SINGLE_REPLIES
    k = draw_sql("single", len(SINGLE_REPLIES), id_col, v)
    return "(CASE " + " ".join(f"WHEN {k} = {i} THEN {q(r)}" for i, r in enumerate(SINGLE_REPLIES)) + " END)"


def parse_single_sql(reply: str) -> str:
    """SELECT fragment: verified, confidence, reason, parse_path from a single-entity reply."""
    sl = json_slice_sql(reply)
    bad_conf = (f"(json_exists({sl}, '$.confidence') AND "
                f"TRY_CAST(json_extract_string({sl}, '$.confidence') AS DOUBLE) IS NULL)")
    path = (f"(CASE WHEN {sl} IS NULL THEN 'P-02' WHEN NOT json_valid({sl}) THEN 'P-03' "
            f"WHEN {bad_conf} THEN 'P-03' ELSE 'P-01' END)")
    yes = f"(contains(lower({reply}), 'true') OR contains(lower({reply}), 'yes'))"
    return f"""CASE WHEN {path} = 'P-01' THEN (CASE WHEN json_exists({sl}, '$.verified') THEN TRY_CAST(json_extract_string({sl}, '$.verified') AS BOOLEAN) ELSE TRUE END)
       WHEN {path} = 'P-02' THEN {yes} ELSE TRUE END AS verified,
  CAST(CASE WHEN {path} = 'P-01' THEN (CASE WHEN json_exists({sl}, '$.confidence') THEN TRY_CAST(json_extract_string({sl}, '$.confidence') AS DOUBLE) ELSE 0.5 END)
       WHEN {path} = 'P-02' THEN (CASE WHEN {yes} THEN 0.7 ELSE 0.6 END) ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE WHEN {path} = 'P-01' THEN (CASE WHEN json_exists({sl}, '$.reason') THEN json_extract_string({sl}, '$.reason') ELSE {q(cat.REASON_SINGLE_DEFAULT)} END)
       WHEN {path} = 'P-02' THEN {q(cat.REASON_SINGLE_TEXT)} ELSE 'Parse error: invalid JSON' END AS reason,
  {path} AS parse_path"""


def parse_reasoning_sql(src: str) -> str:
    """From rows (doc_id, piis, raw_response) -> (doc_id, parse_path, items)."""
    nl = "chr(10)"
    return f"""(
WITH s0 AS (SELECT doc_id, piis, {strip_sql("coalesce(raw_response, '')")} AS rc0 FROM {src} x),
s1 AS (SELECT *, string_split(rc0, {nl})[2:] AS body FROM s0),
s2 AS (SELECT doc_id, piis, CASE WHEN starts_with(rc0, '```') THEN {strip_sql(f"array_to_string(CASE WHEN len(body) > 0 AND {strip_sql('body[-1]')} = '```' THEN body[1:len(body) - 1] ELSE body END, {nl})")} ELSE rc0 END AS rc FROM s1),
s3 AS (SELECT *, {json_slice_sql('rc')} AS sl FROM s2),
s4 AS (SELECT *, replace(replace(sl, ': True', ': true'), ': False', ': false') AS fx FROM s3),
s5 AS (SELECT *, CASE WHEN rc = '' OR rc = '```' THEN 'P-04' WHEN sl IS NULL THEN 'P-07'
                      WHEN NOT json_valid(fx) THEN 'P-08'
                      WHEN coalesce(json_type(fx, '$.results') = 'ARRAY', FALSE) THEN 'P-05' ELSE 'P-06' END AS parse_path FROM s4)
SELECT doc_id, parse_path, CASE
  WHEN parse_path = 'P-04' THEN list_transform(piis, lambda d: {{'pii': d, 'verified': FALSE, 'reason': {q(cat.REASON_EMPTY_REPLY)}}})
  WHEN parse_path = 'P-07' THEN list_transform(piis, lambda d: {{'pii': d, 'verified': FALSE, 'reason': {q(cat.REASON_NO_JSON)}}})
  WHEN parse_path = 'P-08' THEN list_transform(piis, lambda d: {{'pii': d, 'verified': TRUE, 'reason': {q(cat.REASON_DECODE_FAILED)}}})
  WHEN parse_path = 'P-05' THEN list_transform(list_filter(json_extract(fx, '$.results[*]'), lambda j: json_type(j) = 'OBJECT'),
        lambda j: {{'pii': json_extract_string(j, '$.pii'), 'verified': TRY_CAST(json_extract_string(j, '$.verified') AS BOOLEAN), 'reason': json_extract_string(j, '$.reason')}})
  ELSE list_transform(piis, lambda d: {{'pii': d, 'verified': FALSE, 'reason': {q(cat.REASON_BAD_STRUCTURE)}}}) END AS items
FROM s5)"""


def parse_simple_sql(src: str) -> str:
    """From rows (doc_id, piis, raw_response) -> (doc_id, parse_path, verified list)."""
    starts = " OR ".join(f"starts_with(lower(r0), {q(p)})" for p in cat.GARBAGE_PREFIXES)
    stops = " OR ".join(f"contains(lower(p), {q(w)})" for w in cat.STOP_WORDS)
    nl = "chr(10)"
    stop_match = "(lower(p) = lower(d) OR contains(lower(d), lower(p)) OR contains(lower(p), lower(d)))"
    match = (f"coalesce(list_filter(piis, lambda d: {stop_match})[1], "
             f"list_filter(piis, lambda d: list_has_any({words_sql('lower(p)')}, {words_sql('lower(d)')}))[-1])")
    return f"""(
WITH s0 AS (SELECT doc_id, piis, coalesce(raw_response, '') AS raw, {strip_sql("coalesce(raw_response, '')")} AS r0 FROM {src} x),
s1 AS (SELECT *, list_filter(piis, lambda d: strpos(r0, d) > 1)[1] AS hit FROM s0),
s2 AS (SELECT *, CASE WHEN ({starts}) AND hit IS NOT NULL THEN substring(r0, strpos(r0, hit)) ELSE r0 END AS r1 FROM s1),
s3 AS (SELECT *, list_filter(list_transform(string_split(r1, ','), lambda p: {strip_sql('p')}), lambda p: p <> '' AND upper(p) <> 'NONE') AS pa FROM s2),
s4 AS (SELECT *, list_filter(list_transform(pa, lambda p: CASE WHEN strpos(p, {nl}) > 0 THEN {strip_sql(f"split_part(p, {nl}, 1)")} ELSE p END),
                             lambda p: length(p) < 100 AND NOT ({stops})) AS parts FROM s3),
s5 AS (SELECT *, list_filter(list_transform(parts, lambda p: {match}), lambda x: x IS NOT NULL AND x <> '') AS m0,
              {json_slice_sql('raw')} AS sl FROM s4),
s6 AS (SELECT *, list_filter(list_transform(range(1, len(m0) + 1), lambda i: CASE WHEN list_position(m0, m0[i]) = i THEN m0[i] END), lambda x: x IS NOT NULL) AS matched FROM s5),
s7 AS (SELECT *, CASE WHEN contains(upper(substring(r1, 1, 20)), 'NONE') THEN 'P-11'
                      WHEN len(parts) > 0 THEN 'P-13'
                      WHEN sl IS NOT NULL AND NOT json_valid(sl) THEN 'P-15'
                      WHEN sl IS NOT NULL AND coalesce(json_type(sl, '$.verified_piis') = 'ARRAY', FALSE) THEN 'P-14'
                      ELSE 'P-15' END AS parse_path FROM s6)
SELECT doc_id, parse_path, CASE WHEN parse_path = 'P-11' THEN []::VARCHAR[] WHEN parse_path = 'P-13' THEN matched
  WHEN parse_path = 'P-14' THEN CAST(json_extract_string(sl, '$.verified_piis[*]') AS VARCHAR[]) ELSE piis END AS verified
FROM s7)"""


def entity_candidates_sql(src: str, w: int = CONTEXT_CHARS) -> str:
    """One row per occurrence of the given value (pos 0: it does not occur)."""
    start = f"greatest(pos - {w}, 1)"
    before = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + (i - 1) * length(entityValue) + 1"
    return f"""(SELECT * EXCLUDE (gaps, i), entityType AS entity_type, entityValue AS entity_value,
  substring(input, {start}, pos - {start} + length(entityValue) + {w}) AS context,
  CAST(pos - {start} AS INTEGER) AS ctx_offset
FROM (SELECT *, CAST(CASE WHEN len(gaps) > 1 THEN {before} ELSE 0 END AS BIGINT) AS pos
      FROM (SELECT *, unnest(range(1, greatest(len(gaps), 2))) AS i
            FROM (SELECT *, string_split(input, entityValue) AS gaps FROM {src} g0) g1) g2) g)"""


def entity_verdicts_sql(src: str, key: str = "recordId") -> str:
    """One verdict per record: any occurrence, the first with that verdict."""
    return f"""(SELECT * FROM {verify_sql(entity_candidates_sql(src))} e
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY NOT verified, pos) = 1)"""


# ----------------------------------------------------------------------------- decisions
def fmt2_sql(x: str) -> str:
    """Java-style %.2f: HALF_UP on the shortest decimal form of the double."""
    return f"printf('%.2f', round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 24)), 2))"


def logit_decision_sql(logits: str, t: str) -> str:
    e = f"list_transform({logits}, lambda v: exp(v - list_max({logits})))"
    conf = f"(({e})[2] / list_reduce({e}, lambda a, v: a + v))"
    tt = f"' (' || {t} || ')'"
    reason = (f"CASE WHEN {conf} >= 0.5 THEN (CASE WHEN {conf} > 0.9 THEN 'High confidence PII detection' || {tt} "
              f"WHEN {conf} > 0.7 THEN 'Likely PII' || {tt} ELSE 'Possible PII' || {tt} END) "
              f"ELSE (CASE WHEN {conf} < 0.3 THEN 'Low confidence, likely false positive' || {tt} "
              f"ELSE 'Uncertain, may be false positive' || {tt} END) END")
    return f"{conf} >= 0.5 AS verified, round({conf}, 4) AS confidence, {reason} AS reason"


def score_sql(seed: str, id_col: str, v: str, k) -> str:
    return f"(CAST({draw_sql(seed, 100, id_col, v, repr(str(k)).replace(chr(34), chr(39)))} AS DOUBLE) / 100.0)"


def spans_sql(id_col: str, v: str, ctx: str, off: str) -> str:
    before = f"regexp_replace(substring({ctx}, 1, {off}), ' +$', '')"
    neighbor = f"regexp_extract({before}, '([^ ]*)$', 1)"
    texts = [neighbor, f"substring({v}, 1, 4)", v]
    items = [f"{{'text': {t}, 'score': {score_sql('span', id_col, v, k)}}}" for k, t in enumerate(texts, 1)]
    return "[" + ", ".join(items) + "]"


def span_decision_sql(spans: str, v: str) -> str:
    match = f"list_filter({spans}, lambda s: contains(lower(s.text), lower({v})) OR contains(lower({v}), lower(s.text)))"
    hi = f"(list_filter({match}, lambda s: s.score >= 0.5)[1])"
    lo = f"(list_filter({match}, lambda s: s.score >= 0.3)[1])"
    from ..operators.decisions import NOT_DETECTED_SPANS
    return (f"({hi} IS NOT NULL OR {lo} IS NOT NULL) AS verified, "
            f"CAST(coalesce({hi}.score, {lo}.score, 0.5) AS DOUBLE) AS confidence, "
            f"CASE WHEN {hi} IS NOT NULL THEN 'Detected by span model with confidence ' || {fmt2_sql(f'{hi}.score')} "
            f"WHEN {lo} IS NOT NULL THEN 'Detected with low confidence ' || {fmt2_sql(f'{lo}.score')} "
            f"ELSE {q(NOT_DETECTED_SPANS)} END AS reason")


def tokens_sql(id_col: str, v: str, off: str) -> str:
    from ..operators.scorer import TOKEN_LABELS
    labs = "[" + ", ".join(q(x) for x in TOKEN_LABELS) + "]"
    n = f"length({v})"
    bounds = [(f"greatest({off} - 5, 0)", off), (off, f"{off} + 3"), (f"{off} + 3", f"{off} + {n}"),
              (f"{off} + {n}", f"{off} + {n}"), (f"{off} + {n}", f"{off} + {n} + 4")]
    items = []
    for k, (s, e) in enumerate(bounds, 1):
        lab = f"({labs})[{draw_sql('toklab', len(TOKEN_LABELS), id_col, v, repr(str(k)).replace(chr(34), chr(39)))} + 1]"
        items.append(f"{{'label': {lab}, 'tok_start': CAST({s} AS INTEGER), 'tok_end': CAST({e} AS INTEGER), "
                     f"'prob': {score_sql('tokprob', id_col, v, k)}}}")
    return "[" + ", ".join(items) + "]"


def token_decision_sql(tokens: str, text: str, v: str) -> str:
    from ..operators.decisions import NOT_DETECTED_TOKENS, NOT_FOUND
    start = f"(strpos(lower({text}), lower({v})) - 1)"
    end = f"({start} + length({v}))"
    hit = f"list_filter({tokens}, lambda t: t.tok_start < {end} AND t.tok_end > {start} AND t.label <> 'O')"
    labels = f"list_transform({hit}, lambda t: t.label)"
    n = f"len({hit})"
    avg = f"(list_reduce(list_transform({hit}, lambda t: t.prob), lambda a, x: a + x, CAST(0.0 AS DOUBLE)) / {n})"
    maxc = f"list_max(list_transform(list_distinct({labels}), lambda l: len(list_filter({labels}, lambda x: x = l))))"
    top = f"(list_filter(list_sort(list_distinct({labels})), lambda l: len(list_filter({labels}, lambda x: x = l)) = {maxc})[1])"
    return (f"({start} >= 0 AND {n} > 0) AS verified, "
            f"CAST(CASE WHEN {start} < 0 THEN 0.5 WHEN {n} > 0 THEN {avg} ELSE 0.6 END AS DOUBLE) AS confidence, "
            f"CASE WHEN {start} < 0 THEN {q(NOT_FOUND)} WHEN {n} > 0 THEN 'Detected as ' || {top} || ' with confidence ' || {fmt2_sql(avg)} "
            f"ELSE {q(NOT_DETECTED_TOKENS)} END AS reason")


def type_alias_sql(t: str) -> str:
    m = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in cat.TYPE_ALIASES.items()) + "}"
    return f"coalesce(({m})[upper({t})], lower({t}))"


def label_guard_sql(label_col: str, text_col: str) -> str:
    """First matching whole-text label guard (reason) or NULL."""
    whens = " ".join(f"WHEN {label_col} = {q(lab)} AND regexp_matches({text_col}, {q(pat)}) THEN {q(reason)}"
                     for lab, pat, reason in cat.LABEL_GUARDS)
    return f"(CASE {whens} END)"
