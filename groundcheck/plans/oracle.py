"""DuckDB SQL fragments the registered queries are checked against."""

from __future__ import annotations

from ..functions import text as tx
from ..sources.fixtures import CUES, DOTTED, HINTS

# the same class as text.WS, spelled out for DuckDB's regex engine
WS_SET = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS, NON_WS = f"[{WS_SET}]", f"[^{WS_SET}]"
URL = rf"https?://{NON_WS}+|www\.{NON_WS}+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return collapse(f"nfc_normalize(coalesce({x}, ''))")


def strip(x: str) -> str:
    return f"trim({x}, {quoted(tx.WS_CHARS)})"


def clean(x: str) -> str:
    # the plain forms of the patterns
    s = f"translate(coalesce({x}, ''), chr(13) || chr(10), '  ')"
    for pattern in (r"<[^>]+>", URL, rf"{NON_WS}+@{NON_WS}+\.(?:{tx.EMAIL_TLDS})"):
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    return norm(s)


def words(x: str, least: int = 1) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]{{{least},}}')"


def tokens(x: str) -> str:
    return words(f"lower({norm(x)})")


def ws_tokens(x: str) -> str:
    collapsed = collapse(f"coalesce({x}, '')")
    return f"list_filter(string_split({collapsed}, ' '), lambda t: t <> '')"


def jaccard(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
        f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
    )


def ngrams(t: str, n: int, glue: str = "chr(1)") -> str:
    if n == 1:
        return t
    shifted = ", ".join(f"{t}[{k + 1}:len({t}) - {n - 1 - k}]" for k in range(n))
    parts = f" || {glue} || ".join(f"z[{k + 1}]" for k in range(n))
    return f"CASE WHEN len({t}) < {n} THEN [] ELSE list_transform(list_zip({shifted}), lambda z: {parts}) END"


def containment(a: str, b: str, n: int) -> str:
    return (
        f"CASE WHEN len({a}) < {n} OR len({b}) < {n} THEN 0.0 ELSE "
        f"len(list_intersect({ngrams(a, n)}, {ngrams(b, n)})) / len(list_distinct({ngrams(b, n)})) END"
    )


def any_cue(x: str, cues: list[str]) -> str:
    return "CAST(" + " OR ".join(f"contains(lower({x}), {quoted(c)})" for c in cues) + " AS INT)"


def claims(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '.'), lambda s: {strip('s')}), lambda s: s <> '')"


def label_id(x: str) -> str:
    return f"CASE {x} WHEN 'no' THEN 0 WHEN 'intrinsic' THEN 1 WHEN 'extrinsic' THEN 2 END"


def label_name(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'no' WHEN 1 THEN 'intrinsic' WHEN 2 THEN 'extrinsic' END"


def first_max(p: list[str]) -> str:
    """0-based index of the first maximum of three values."""
    a, b, c = p
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def _logits(a: int, b: int, mod: int, scale: float) -> str:
    return ", ".join(f"((doc_id * {a + j} + n_chars * {b + 2 * j}) % {mod}) / {scale} AS z{j}" for j in range(3))


def _softmax(name: str, source: str) -> str:
    top = "greatest(z0, z1, z2)"
    total = " + ".join(f"exp(z{j} - {top})" for j in range(3))
    return f"SELECT id, label, {', '.join(f'exp(z{j} - {top}) / ({total}) AS {name}{j}' for j in range(3))} FROM {source}"


def split_cte(name: str, source: str, valid: float, seed: int) -> str:
    """Rows of ``source`` with their split: the class quotas, then the smallest keys per class."""
    return f"""{name}_counts AS (
  SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY label),
{name}_draws AS (SELECT *, CAST(ceil({valid} * total) AS BIGINT) AS draws FROM {name}_counts),
{name}_base AS (SELECT *, (n * draws) // total AS base, (n * draws) % total AS rest FROM {name}_draws),
{name}_quota AS (
  SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM {name}_base),
{name} AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.label ORDER BY md5('{seed}:' || s.id), s.id) <= q.quota
    THEN 'valid' ELSE 'train' END AS split
  FROM {source} s JOIN {name}_quota q ON s.label = q.label)"""


_TRIPLETS = f"""triplets AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.n_chars, d.text AS context,
    rtrim(split_part(ltrim(d.text, {quoted(DOTTED)}), '.', 1), {quoted(tx.WS_CHARS)}) AS prompt,
    ltrim(split_part(rtrim(d.text, {quoted(DOTTED)}), '.', -1), {quoted(tx.WS_CHARS)}) AS response,
    CASE WHEN l.toxic = 1 THEN 'extrinsic' WHEN l.quality = 0 THEN 'intrinsic' ELSE 'no' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_C, _P, _R = tokens("context"), tokens("prompt"), tokens("response")

# name -> (needs, definition)
CTES: dict[str, tuple[list[str], str]] = {
    "triplets": ([], _TRIPLETS),
    "dialogues": ([], """dialogues AS (
  SELECT u.conv_id || ':' || u.turn AS id, coalesce(b.text, '') AS context, u.text AS prompt, a.text AS response
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn - 1
  WHERE u.role = 'user')"""),
    "cleaned": (["triplets"], f"""cleaned AS (
  SELECT *, {clean('context')} AS context_clean, {clean('prompt')} AS prompt_clean, {clean('response')} AS response_clean
  FROM triplets)"""),
    "serialized": (["triplets"], f"""serialized AS (
  SELECT *, '[CLS] ' || {norm('context')} || ' [SEP] ' || {norm('prompt')} || ' [SEP] ' || {norm('response')} || ' [SEP]' AS serialized_text
  FROM triplets)"""),
    "rules": (["triplets"], f"""rule_tokens AS (
  SELECT *, {_C} AS c, {_P} AS p, {_R} AS r FROM triplets),
rules AS (
  SELECT id, label, {jaccard('c', 'r')} AS overlap_ctx_resp, {jaccard('p', 'r')} AS overlap_prompt_resp,
    CASE WHEN {any_cue('context', CUES)} <> {any_cue('response', CUES)} THEN 1.0 ELSE 0.0 END AS neg_mismatch,
    CAST({any_cue('response', HINTS)} AS DOUBLE) AS extrinsic_hint,
    len(r) / greatest(len(c), 1) AS response_length_ratio
  FROM rule_tokens)"""),
    "rule_scores": (["rules"], """rule_raw AS (
  SELECT id, label,
    greatest((0.55::DOUBLE * overlap_ctx_resp + 0.25::DOUBLE * overlap_prompt_resp) * (1.0::DOUBLE - 0.4::DOUBLE * neg_mismatch), 1e-6::DOUBLE) AS a,
    greatest(0.6::DOUBLE * neg_mismatch + 0.2::DOUBLE * (1.0::DOUBLE - overlap_ctx_resp), 1e-6::DOUBLE) AS b,
    greatest(0.6::DOUBLE * extrinsic_hint + 0.3::DOUBLE * (1.0::DOUBLE - overlap_prompt_resp), 1e-6::DOUBLE) AS c
  FROM rules),
rule_scores AS (SELECT id, label, a / (a + b + c) AS r0, b / (a + b + c) AS r1, c / (a + b + c) AS r2 FROM rule_raw)"""),
    "rule_votes": (["rule_scores"], f"""rule_votes AS (
  SELECT id, label, {label_name(first_max(['r0', 'r1', 'r2']))} AS predict_label FROM rule_scores)"""),
    "classical_scores": (["triplets"], f"""classical_z AS (SELECT id, label, {_logits(7, 3, 101, 25.0)} FROM triplets),
classical_scores AS ({_softmax('c', 'classical_z')})"""),
    "transformer_scores": (["triplets"], f"""transformer_z AS (SELECT id, label, {_logits(5, 11, 97, 20.0)} FROM triplets),
transformer_scores AS ({_softmax('t', 'transformer_z')})"""),
    "sources": (["classical_scores", "transformer_scores", "rule_scores"], """sources AS (
  SELECT c.id, c.label, c0, c1, c2, t0, t1, t2, r0, r1, r2
  FROM classical_scores c JOIN transformer_scores t ON c.id = t.id JOIN rule_scores r ON c.id = r.id)"""),
    "split15": (["triplets"], split_cte("split15", "triplets", 0.15, 42)),
    "split20": (["triplets"], split_cte("split20", "triplets", 0.2, 42)),
    "lexicon": ([], f"""lexicon_tokens AS (SELECT {ws_tokens('lower(' + clean('text') + ')')} AS t FROM benchmark),
lexicon AS (SELECT DISTINCT unnest(list_concat({ngrams('t', 2, "' '")}, list_concat({ngrams('t', 3, "' '")}, {ngrams('t', 4, "' '")}))) AS compound
  FROM lexicon_tokens)"""),
    "samples": ([], """samples AS (
  SELECT CAST(vec_id // 5 AS VARCHAR) AS id, CAST(vec_id % 5 AS INT) AS sample_idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""),
    "probe_weights": ([], """probe_weights AS (
  SELECT label AS layer, CASE WHEN vec_id % 2 = 0 THEN 'init' ELSE 'final' END AS step, vec_id AS out_dim,
    generate_subscripts(embedding, 1) - 1 AS in_dim, CAST(unnest(embedding) AS DOUBLE) AS w
  FROM embeddings)"""),
    "probe_states": ([], """probe_states AS (
  SELECT CAST(vec_id // 20 AS VARCHAR) AS id, CAST((vec_id % 20) // 2 AS INT) AS layer,
    CASE WHEN vec_id % 2 = 0 THEN 'init' ELSE 'final' END AS step, CAST(embedding AS DOUBLE[]) AS h
  FROM embeddings)"""),
    "claims": ([], f"""claim_lists AS (SELECT CAST(doc_id AS VARCHAR) AS id, {claims('text')} AS l FROM documents),
claims AS (SELECT id, generate_subscripts(l, 1) - 1 AS claim_idx, unnest(l) AS claim FROM claim_lists)"""),
    "evidence": ([], f"""benchmark_claims AS (SELECT DISTINCT item_id, unnest({claims('text')}) AS claim FROM benchmark),
document_claims AS (SELECT DISTINCT doc_id, unnest({claims('text')}) AS claim FROM documents),
evidence AS (
  SELECT claim, 1 AS tool_ord, 'benchmark' AS tool, 'item ' || min(item_id) AS result FROM benchmark_claims GROUP BY claim
  UNION ALL
  SELECT claim, 0, 'corpus', CASE WHEN count(*) > 1 THEN 'in ' || count(*) || ' documents' ELSE '' END FROM document_claims GROUP BY claim)"""),
    "verified": (["claims", "evidence"], """found AS (
  SELECT claim, string_agg('[' || tool || '] ' || result, ' | ' ORDER BY tool_ord) AS evidence FROM evidence WHERE result <> '' GROUP BY claim),
verified AS (
  SELECT id, claim_idx, c.claim, coalesce(f.evidence, 'No external evidence found.') AS evidence
  FROM claims c LEFT JOIN found f ON c.claim = f.claim)"""),
    "models": ([], """models AS (
  SELECT CASE WHEN lang = 'fr' THEN 'team/PhoBERT base ' ELSE 'team/xlm base ' END || source || '/' || lang AS model_name,
    CASE lang WHEN 'fr' THEN 'roberta' WHEN 'de' THEN 'xlm-roberta' ELSE 'bert' END AS model_type,
    CASE WHEN lang <> 'es' THEN 250 + (count(*) * 37) % 300 END AS max_position_embeddings
  FROM documents GROUP BY source, lang)"""),
    "grid": (["models"], r"""grid_limits AS (
  SELECT *, CASE WHEN model_type IN ('roberta', 'xlm-roberta') THEN max_position_embeddings - 2 ELSE max_position_embeddings END AS supported
  FROM models),
grid AS (
  SELECT trim(regexp_replace(model_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') || '_len' || max_length AS run_name,
    model_name, max_length, CASE WHEN contains(lower(model_name), 'phobert') THEN 'word_segmented' ELSE 'raw' END AS text_mode,
    CASE WHEN coalesce(max_length > supported, false) THEN 'unsupported' ELSE 'running' END AS status,
    CASE WHEN max_length > supported THEN 'length ' || max_length || ' is over the limit of ' || model_name || ' (' || supported || ')' END AS error,
    CASE WHEN max_length > supported THEN 0.0 END AS elapsed_minutes
  FROM (SELECT *, unnest([256, 512]) AS max_length FROM grid_limits))"""),
    "run_scores": ([], r"""run_scores AS (
  SELECT trim(regexp_replace(CASE WHEN lang = 'fr' THEN 'team/PhoBERT base ' ELSE 'team/xlm base ' END || source || '/' || lang, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') || '_len256' AS run_name,
    round(avg(n_chars % 100) / 100, 6) AS macro_f1, round(avg(n_chars % 50) / 50, 6) AS accuracy,
    CASE WHEN lang <> 'de' THEN round(sum(n_chars) / 60000.0::DOUBLE, 6) END AS elapsed_minutes
  FROM documents GROUP BY source, lang HAVING count(*) % 2 = 0)"""),
    "run_rows": (["grid", "run_scores"], """run_rows AS (
  SELECT g.run_name, model_name, max_length, text_mode,
    CASE WHEN status = 'running' AND s.run_name IS NOT NULL THEN 'skipped' ELSE status END AS status,
    CASE WHEN status = 'running' THEN macro_f1 END AS macro_f1, CASE WHEN status = 'running' THEN accuracy END AS accuracy,
    CASE WHEN status = 'running' AND s.run_name IS NOT NULL THEN coalesce(s.elapsed_minutes, 0.0) ELSE g.elapsed_minutes END AS elapsed_minutes,
    error
  FROM grid g LEFT JOIN run_scores s ON g.run_name = s.run_name)"""),
}


def tfidf_ctes(name: str, source: str, text: str, lowercase: bool, max_df: float, max_features: int, fit_where: str = "true", min_df: int = 2) -> str:
    """``{name}_counts``, ``{name}_vocab`` (fitted where ``fit_where`` holds) and ``{name}`` (all rows)."""
    x = f"lower({text})" if lowercase else text
    return f"""{name}_words AS (SELECT id, label, split, {words(x, 2)} AS w FROM {source}),
{name}_terms AS (SELECT id, label, split, unnest(list_concat(w, {ngrams('w', 2, "' '")})) AS term FROM {name}_words),
{name}_counts AS (SELECT id, label, split, term, count(*) AS tf FROM {name}_terms GROUP BY ALL),
{name}_vocab AS (
  SELECT term, df, cf, ln(({name}_n + 1) / (df + 1)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS cf, (SELECT count(*) FROM {source} WHERE {fit_where}) AS {name}_n
    FROM {name}_counts WHERE {fit_where} GROUP BY term)
  WHERE df >= {min_df} AND df <= {max_df} * {name}_n
  ORDER BY cf DESC, term LIMIT {max_features}),
{name}_raw AS (SELECT c.*, (1 + ln(tf)) * idf AS x FROM {name}_counts c JOIN {name}_vocab v ON c.term = v.term),
{name} AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS tfidf FROM {name}_raw)"""


def scores_cte(name: str, source: str) -> str:
    """``{name}``: per label seen as truth or prediction its support, predictions, hits and scores."""
    return f"""{name}_sides AS (
  SELECT label AS l, 1 AS s, 0 AS p, CASE WHEN label = predict_label THEN 1 ELSE 0 END AS t FROM {source}
  UNION ALL SELECT predict_label, 0, 1, 0 FROM {source}),
{name} AS (
  SELECT l, sum(s) AS support, sum(p) AS predicted, sum(t) AS tp,
    CASE WHEN sum(p) = 0 THEN 0.0 ELSE sum(t) / sum(p) END AS precision,
    CASE WHEN sum(s) = 0 THEN 0.0 ELSE sum(t) / sum(s) END AS recall,
    2 * sum(t) / (sum(s) + sum(p)) AS f1
  FROM {name}_sides GROUP BY l)"""


def sql(needs: list[str], body: str, extra: list[str] | None = None, recursive: bool = False) -> str:
    """``WITH`` the needed fragments in dependency order, the extra ones, then the query."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if CTES[name][1] not in done:
            done.append(CTES[name][1])

    for name in needs:
        add(name)
    parts = done + (extra or [])
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def texts_sql(needs: list[str], body: str, extra: list[str] | None = None, recursive: bool = False) -> str:
    """``sql`` over the triplets of all documents, those without a label too (``fixtures.texts``)."""
    return sql(needs, body, extra, recursive).replace("FROM documents d JOIN labels l", "FROM documents d LEFT JOIN labels l")
