"""The registered queries as DuckDB SQL over the same tables.

Written from the semantics, not from the Spark plans: similarity is a join of word
counts, the category scan a running count, the cascade plain CASE expressions.  Only
data is shared (cue packs, policy tables, prompt texts).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from claimcheck.functions import parsing, prompts, routing, scoring
from claimcheck.functions import text as tx
from claimcheck.plans import queries, tables
from claimcheck.rules import buckets, policy
from claimcheck.rules.cues import BENGALI, Predicate
from claimcheck.schemas import DEBUG_COLUMNS

CONFIG = tables.CONFIG
CUES = CONFIG.router.cues

# Everything that counts as white space, spelt out because RE2's \s is ASCII only.
WS = (
    r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split(x: str) -> str:
    return f"regexp_split_to_array({x}, '{WS}+')"


def words(x: str) -> str:
    return f"[w for w in {split(x)} if w <> '']"


def clean(x: str) -> str:
    bare = rf"regexp_replace(nfc_normalize({x}), '[\x{{200b}}-\x{{200d}}\x{{feff}}\x{{ad}}]', '', 'g')"
    flat = f"trim(regexp_replace({bare}, '{WS}+', ' ', 'g'))"
    return f"(CASE WHEN {flat} = '' OR lower({flat}) = 'null' OR {flat} = '[NULL]' THEN NULL ELSE {flat} END)"


def missing(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} IN ('', '[NULL]', 'None', 'nan'))"


def has(x: str, predicate: Predicate) -> str:
    rules = []
    for rule in predicate:
        groups = ["(" + " OR ".join(f"contains({x}, {lit(c)})" for c in g) + ")" for g in rule]
        rules.append("(" + " AND ".join(groups) + ")")
    return "(" + " OR ".join(rules) + ")"


def case_of(key: str, table: Mapping[str, object], default: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {lit(k)} THEN {v if isinstance(v, int | float) else lit(v)}" for k, v in table.items()
    )
    return f"(CASE {key} {arms} ELSE {default} END)"


def is_in(x: str, values: Sequence[str]) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def hits_of(text: str, tokens: str) -> str:
    return f"len([t for t in {tokens} if contains({text}, t)])"


def long_tokens(x: str, n: int) -> str:
    return f"[t for t in {split(x)} if length(t) >= {n}]"


def hypothesis(style: str, q: str = "prompt_bn", a: str = "response_bn") -> str:
    return {
        "answer_only": a,
        "qa_en": f"'The answer to the question ''' || {q} || ''' is: ' || {a}",
        "qa_bn": f"'প্রশ্নের উত্তর: ' || {a}",
        "claim_bn": f"'প্রশ্ন: ' || {q} || chr(10) || 'উত্তর: ' || {a}",
    }[style]


def overlap(premise: str, answer: str, share: float) -> str:
    bare = strip(f"translate({answer}, '*_', '')")
    big, small = long_tokens(bare, 3), long_tokens(bare, 2)
    return f"""CASE WHEN length({bare}) < 2 OR {strip(premise)} = '' THEN false
        WHEN contains({premise}, {bare}) THEN true
        WHEN len({big}) > 0 THEN {hits_of(premise, big)}::DOUBLE / len({big}) >= {share}::DOUBLE
        ELSE {hits_of(premise, small)} > 0 END"""


def irrelevant(prompt: str, evidence: str) -> str:
    tokens = long_tokens(prompt, 3)
    return f"""CASE WHEN {missing(evidence)} THEN true
        ELSE len({tokens}) > 0 AND {hits_of(strip(evidence), tokens)} = 0 END"""


def verdict(text: str) -> str:
    stated = f"lower(regexp_extract({text}, '(?is){parsing.VERDICT}', 1))"
    tail = f"lower(right({text}, 150))"
    return f"""CASE WHEN {stated} IN ('faithful', 'correct', 'truthful', 'f') THEN 'Faithful'
        WHEN {stated} <> '' THEN 'Hallucinated'
        WHEN contains({tail}, 'faithful') OR contains({tail}, 'correct') THEN 'Faithful'
        WHEN contains({tail}, 'hallucinated') OR contains({tail}, 'wrong') THEN 'Hallucinated' END"""


def vscore(v: str) -> str:
    return f"CASE {v} WHEN 'Faithful' THEN 0.9::DOUBLE WHEN 'Hallucinated' THEN 0.1::DOUBLE END"


FOUND = "coalesce(context, prompt_bn, '')"


def answer_hits(body: str, answer: str = "response_bn") -> tuple[str, str]:
    tokens = long_tokens(answer, 2)
    return hits_of(body, tokens), f"len({tokens})"


def fast_score(body: str = FOUND) -> str:
    h, n = answer_hits(body)
    return f"round((4 * {h} + 1)::DOUBLE / ({n} - {h} + 4 * {h} + 2)::DOUBLE, 6)"


def entail(body: str, text: str) -> str:
    h, n = answer_hits(body, text)
    return f"round(coalesce((4 * {h})::DOUBLE / nullif({n} - {h} + 4 * {h}, 0)::DOUBLE, 0), 6)"


def think_text(body: str = FOUND) -> str:
    h, n = answer_hits(body)
    return f"""'Found ' || {h} || ' of ' || {n} || ' words.' || chr(10) || CASE
        WHEN {h} * 5 >= {n} THEN 'verdict: Faithful'
        WHEN {h} * 10 >= {n} THEN 'verdict: Hallucinated' ELSE 'no decision' END"""


def evidence_block(x: str) -> str:
    return f"""CASE WHEN {missing(x)} THEN {lit(prompts.NO_EVIDENCE)}
        ELSE '<evidence>' || chr(10) || {strip(x)} || chr(10) || '</evidence>' END"""


def instruction(task: str) -> str:
    return case_of(task, policy.INSTRUCTIONS, lit(policy.INSTRUCTIONS["other_null"]))


def case_text() -> str:
    return f"""'Task: ' || task_type || chr(10) || 'Rule: ' || {instruction("task_type")} || chr(10) ||
        {evidence_block("context")} || chr(10) || 'Q: ' || prompt_bn || chr(10) ||
        'A: ' || response_bn || chr(10)"""


_MATH = [name for name, _ in routing.MATH_ORDER]
_MATH_TASK = "CASE " + " ".join(f"WHEN {n} THEN {lit(t)}" for n, t in routing.MATH_ORDER) + " END"
_FACT_TASK = """CASE WHEN context_given AND famous AND factual THEN 'famous_bn_fact_context'
    WHEN context_given THEN 'context_grounded_fact'
    WHEN famous THEN 'famous_bn_fact_null' ELSE 'general_fact_null' END"""
_OTHER_TASK = "CASE WHEN context_given THEN 'context_grounded_other' ELSE 'other_null' END"

_NLI = CONFIG.nli
_THINK = CONFIG.think
_K = CONFIG.retrieval.top_k
_THRESHOLD = CONFIG.retrieval.threshold


def bucket_of(word: str) -> str:
    return f"(('0x' || substr(md5({word}), 1, 6))::INTEGER % {tables.ENCODER.dim})"


def _passages_of(docs: str) -> str:
    return f"""SELECT source, doc_id * 10000000 + chunk.no AS passage_id, chunk.t AS text FROM (
        SELECT source, doc_id, unnest([{{'no': s // 170, 't': array_to_string(w[s + 1:s + 220], ' ')}}
            for s in range(0, len(w), 170)]) AS chunk
        FROM (SELECT source, doc_id, {words("text")} AS w FROM {docs})
    )"""


CTES: dict[str, str] = {
    "claims": f"""SELECT u.conv_id * {tables.TURN_SPAN} + u.turn AS id, u.conv_id, s.context,
            u.text AS prompt_bn, a.text AS response_bn
        FROM conversations u
        JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS context FROM conversations
            WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = u.conv_id
        WHERE u.role = 'user'""",
    "cleaned": f"""SELECT id, conv_id,
            CASE WHEN {clean("context")} IN ('None', 'nan') THEN NULL ELSE {clean("context")} END AS context,
            {clean("prompt_bn")} AS prompt_bn, {clean("response_bn")} AS response_bn FROM claims""",
    "flagged": "SELECT *, "
    + ", ".join(
        f"{has('prompt_bn', getattr(CUES, n))} AS {n}"
        for n in ["idiom", "literal", "grammar", *_MATH, "famous", "factual"]
    )
    + f""", {has("lower(prompt_bn)", CUES.translation)} AS translation,
        regexp_matches(prompt_bn, {lit(CUES.foreign_word)})
            OR regexp_matches(response_bn, {lit(CUES.foreign_word)}) AS "foreign",
        context IS NOT NULL AS context_given FROM cleaned""",
    "logits": f"""SELECT *, grammar::INT AS lg,
        {" + ".join(f"{n}::INT" for n in ("calendar", "speed", "profit", "average", "math_other"))} AS lm,
        idiom::INT + literal::INT AS li, {has("prompt_bn", CUES.translation)}::INT AS lt,
        factual::INT + famous::INT AS lf,
        0.5::DOUBLE + regexp_matches(response_bn, {lit(CUES.foreign_word)})::INT AS lo FROM flagged""",
    "categorised": """SELECT *, CASE greatest(lg, lm, li, lt, lf, lo)
            WHEN lg THEN 'G' WHEN lm THEN 'M' WHEN li THEN 'I' WHEN lt THEN 'T'
            WHEN lf THEN 'F' ELSE 'O' END AS category,
        CASE WHEN idiom THEN 'idiom_meaning_null' WHEN literal THEN 'literal_meaning_null'
            WHEN grammar THEN 'bangla_grammar' END AS lexical_task, """
    + f"{_MATH_TASK} AS math_task FROM logits",
    "tasked": f"""SELECT *, coalesce(lexical_task, math_task, CASE
            WHEN translation OR ("foreign" AND NOT factual) THEN 'translation_or_bilingual'
            WHEN factual OR (famous AND NOT context_given) THEN {_FACT_TASK}
            ELSE {_OTHER_TASK} END) AS static_task_type,
        CASE category WHEN 'G' THEN 'bangla_grammar' WHEN 'M' THEN coalesce(math_task, 'math_other')
            WHEN 'I' THEN CASE WHEN idiom THEN 'idiom_meaning_null' ELSE 'literal_meaning_null' END
            WHEN 'T' THEN 'translation_or_bilingual' WHEN 'F' THEN {_FACT_TASK}
            ELSE {_OTHER_TASK} END AS model_task FROM categorised""",
    "routed": f"""SELECT *, CASE
            WHEN lexical_task IS NOT NULL OR math_task IS NOT NULL THEN static_task_type
            WHEN model_task = 'translation_or_bilingual'
                AND {is_in("static_task_type", policy.STICKY_FACT_TASKS)} THEN static_task_type
            WHEN {is_in("model_task", policy.LEXICAL_ONLY_TASKS)} THEN static_task_type
            ELSE model_task END AS task_type FROM tasked""",
    "policed": f"""SELECT *, CASE WHEN context IS NOT NULL THEN 'original_context_present'
            WHEN {is_in("task_type", policy.NO_RETRIEVAL_TASKS)} THEN 'task_policy:' || task_type
            WHEN NOT {is_in("task_type", list(policy.RETRIEVAL_SOURCE))} THEN 'no_rag_source:' || task_type
            END AS skip_reason,
        {case_of("task_type", policy.RETRIEVAL_SOURCE)} AS preferred_source,
        {case_of("task_type", policy.FALLBACK_SOURCE)} AS fallback_source FROM routed""",
    "allowed": """SELECT *, skip_reason IS NULL AND (task_type <> 'other_null' OR factual)
        AS may_retrieve FROM policed""",
    "docs": f"""SELECT {case_of("lang", tables.SOURCE_OF_LANG)} AS source, doc_id, text
        FROM documents""",
    "passages": _passages_of("docs"),
    "found_sources": "SELECT DISTINCT source FROM passages",
    "resolved": """SELECT *, CASE WHEN p THEN preferred_source WHEN f THEN fallback_source
            ELSE preferred_source END AS resolved_source,
        CASE WHEN p AND f THEN fallback_source END AS second_source, p OR f AS index_found
        FROM (SELECT *,
            coalesce(preferred_source IN (SELECT source FROM found_sources), false) AS p,
            coalesce(fallback_source IN (SELECT source FROM found_sources), false) AS f
            FROM allowed)""",
    "search": f"""SELECT id AS qid, query, source FROM (
        SELECT id, CASE WHEN {is_in("task_type", ["idiom_meaning_null", "literal_meaning_null"])}
                THEN coalesce(lemma, prompt_bn) ELSE prompt_bn END AS query,
            unnest([s for s in [resolved_source, second_source] if s IS NOT NULL]) AS source
        FROM (SELECT *, ([q for q in quoted if length(q) = list_max([length(x) for x in quoted])
                and q <> ''])[1] AS lemma
            FROM (SELECT *, [{strip("m")} for m in
                regexp_extract_all(prompt_bn, '[“"‘''«](.+?)[”"’''»]', 1)] AS quoted
                FROM resolved WHERE may_retrieve AND index_found)))""",
    "query_terms": f"""SELECT qid, source, {bucket_of("w")} AS b, count(*) AS c
        FROM (SELECT qid, source, unnest({words("query")}) AS w FROM search) GROUP BY ALL""",
    "passage_terms": f"""SELECT source, passage_id, {bucket_of("w")} AS b, count(*) AS c
        FROM (SELECT source, passage_id, unnest({words("text")}) AS w FROM passages) GROUP BY ALL""",
    "scored_pairs": """SELECT d.qid, d.source, d.passage_id,
            round(d.dot::DOUBLE / (sqrt(q.n::DOUBLE) * sqrt(p.n::DOUBLE)), 6) AS score
        FROM (SELECT q.qid, q.source, p.passage_id, sum(q.c * p.c) AS dot FROM query_terms q
            JOIN passage_terms p ON q.source = p.source AND q.b = p.b GROUP BY ALL) d
        JOIN (SELECT qid, source, sum(c * c) AS n FROM query_terms GROUP BY ALL) q
            ON q.qid = d.qid AND q.source = d.source
        JOIN (SELECT source, passage_id, sum(c * c) AS n FROM passage_terms GROUP BY ALL) p
            ON p.source = d.source AND p.passage_id = d.passage_id""",
    "hits": f"""SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY qid, source
            ORDER BY score DESC, passage_id))::INTEGER AS rank FROM scored_pairs
            WHERE score >= {_THRESHOLD}::DOUBLE) WHERE rank <= {_K}""",
    "joined_hits": """SELECT h.qid, h.source, string_agg(p.text, ' ' ORDER BY h.rank) AS t,
            count(*)::INTEGER AS n_retrieved, max(h.score) AS retrieval_sim_max,
            round(avg(h.score), 6) AS retrieval_sim_mean
        FROM hits h JOIN passages p ON p.source = h.source AND p.passage_id = h.passage_id
        GROUP BY h.qid, h.source""",
    "evidence": "SELECT * EXCLUDE (t), t AS evidence FROM joined_hits",
    "chosen": """SELECT r.* EXCLUDE (context), r.context AS context_original,
            coalesce(a.evidence IS NULL AND b.evidence IS NOT NULL, false) AS by_fallback,
            coalesce(a.evidence, b.evidence) AS found,
            coalesce(a.n_retrieved, b.n_retrieved, 0) AS n_found,
            coalesce(a.retrieval_sim_max, b.retrieval_sim_max) AS sim_max,
            coalesce(a.retrieval_sim_mean, b.retrieval_sim_mean) AS sim_mean,
            r.may_retrieve AND r.index_found AS searched
        FROM resolved r
        LEFT JOIN evidence a ON a.qid = r.id AND a.source = r.resolved_source
        LEFT JOIN evidence b ON b.qid = r.id AND b.source = r.second_source""",
    "filled": """SELECT *, CASE WHEN searched THEN found ELSE context_original END AS context,
            CASE WHEN searched THEN n_found ELSE 0 END AS n_retrieved,
            CASE WHEN searched THEN sim_max END AS retrieval_sim_max,
            CASE WHEN searched THEN sim_mean END AS retrieval_sim_mean,
            searched AS rag_used,
            CASE WHEN searched AND by_fallback THEN second_source
                WHEN may_retrieve THEN resolved_source ELSE '' END AS rag_source,
            CASE WHEN searched THEN '' WHEN may_retrieve THEN 'index_missing:' || resolved_source
                ELSE coalesce(skip_reason, 'other_null_not_factual') END AS rag_skipped_reason,
            CASE WHEN searched AND by_fallback THEN 'rag:' || second_source || '(fallback)'
                WHEN searched THEN 'rag:' || resolved_source
                WHEN context_original IS NOT NULL THEN 'original_context' ELSE 'none' END
                AS evidence_source,
            CASE WHEN searched AND found IS NOT NULL THEN 'retrieved'
                WHEN searched THEN 'retrieval_empty'
                WHEN context_original IS NOT NULL THEN 'provided' ELSE 'no_evidence' END
                AS evidence_relevance
        FROM chosen""",
    "keyed": f"""SELECT *, sha256(concat_ws(chr(31), {lit(policy.CACHE_VERSION)}, task_type,
            coalesce(context_original, '[NULL]'), coalesce(context, '[NULL]'), prompt_bn,
            response_bn, {lit(CONFIG.meta_hash())})) AS case_key,
            {fast_score()} AS p_fast FROM filled""",
    "triggered": f"""SELECT *, p_fast BETWEEN {_THINK.low}::DOUBLE AND {_THINK.high}::DOUBLE AS near,
            task_type = 'bangla_grammar' AND p_fast BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE AS wide,
            {has("prompt_bn", CUES.grammar_rule_check)} AS rule_question,
            coalesce(len(regexp_extract_all(context_original,
                {lit(CUES.date_or_entity.replace(chr(92) + "d", chr(92) + "p{Nd}"))})), 0) >= 2
                AS many_mentions, {irrelevant("prompt_bn", "context")} AS off_topic FROM keyed""",
    "reasoned": f"""SELECT *, [x for x in [
            CASE WHEN near THEN 'near_threshold' END,
            CASE WHEN near AND {is_in("task_type", ["famous_bn_fact_null", "famous_bn_fact_context"])}
                THEN 'famous_bn_fact' END,
            CASE WHEN near AND task_type = 'context_grounded_fact' AND many_mentions
                THEN 'multi_entity_context' END,
            CASE WHEN near AND {is_in("task_type", policy.MATH_TASKS)} THEN 'math_needs_check' END,
            CASE WHEN wide AND rule_question THEN 'grammar_rule_check' END,
            CASE WHEN wide AND NOT rule_question THEN 'bangla_grammar_wide_window' END,
            CASE WHEN near AND task_type = 'translation_or_bilingual' THEN 'translation_check' END,
            CASE WHEN near AND may_retrieve AND off_topic THEN 'evidence_missing_keyphrase' END
            ] if x IS NOT NULL] AS reasons,
        {case_of("task_type", dict(_THINK.max_tokens_by_task), str(_THINK.max_tokens))} AS budget,
        coalesce(context_original, context) AS premise FROM triggered""",
    "eligible": f"""SELECT *, CASE WHEN NOT {is_in("task_type", _NLI.tasks)} THEN 'task_not_in_nli_list'
            WHEN premise IS NULL THEN 'empty_premise'
            WHEN rag_used AND (retrieval_sim_max IS NULL
                OR retrieval_sim_max < {_NLI.min_retrieval_similarity}::DOUBLE)
                THEN 'weak_rag_premise' END AS block FROM reasoned""",
    "entailed": f"""SELECT *, CASE WHEN block IS NULL
            THEN {entail("premise", "(" + hypothesis(_NLI.hypothesis_style) + ")")} END AS e FROM eligible""",
    "contradicted": """SELECT *, round((1 - e) * 0.6::DOUBLE, 6) AS c,
            round((1 - e) * 0.4::DOUBLE, 6) AS n FROM entailed""",
    "gated": f"""SELECT *, CASE WHEN block IS NULL THEN CASE
            WHEN abs(e - c) < CASE WHEN e > c THEN {_NLI.margin_faithful}::DOUBLE
                ELSE {_NLI.margin_hallucinated}::DOUBLE END THEN 'margin_too_low'
            WHEN e > c AND e <= n THEN 'entail_le_neutral'
            WHEN e > c AND NOT ({overlap("premise", "response_bn", _NLI.overlap_min)})
                THEN 'faithful_low_overlap'
            WHEN e > c AND p_fast < {_NLI.fast_max_for_faithful}::DOUBLE
                THEN 'faithful_fast_disagrees' END END AS objection FROM contradicted""",
    "gate": f"""SELECT *, block IS NULL AS nli_eligible, block IS NULL AND objection IS NULL AS nli_applied,
            coalesce(block, objection, '') AS nli_skip_reason, e AS nli_p_entail,
            c AS nli_p_contradict, n AS nli_p_neutral, abs(e - c) AS nli_margin,
            CASE WHEN block IS NULL AND coalesce(objection, '') <> 'margin_too_low'
                THEN CASE WHEN e > c THEN {_NLI.faithful_score}::DOUBLE
                    ELSE {_NLI.hallucinated_score}::DOUBLE END END AS p_nli FROM gated""",
    "thought": f"""SELECT *, len(reasons) > 0 AND NOT nli_applied AS triggered_think,
            CASE WHEN len(reasons) > 0 AND NOT nli_applied THEN {think_text()} END AS thinking_cot
        FROM gate""",
    "parsed": f"SELECT *, {verdict('thinking_cot')} AS verdict_parsed FROM thought",
    "scored": f"""SELECT *, CASE WHEN nli_applied THEN p_nli
            ELSE coalesce({vscore("verdict_parsed")}, p_fast) END AS p_llm,
            CASE WHEN nli_applied THEN ['nli_confident_skip_think']
                WHEN triggered_think AND verdict_parsed IS NULL
                    THEN list_append(reasons, 'verdict_unparsed')
                WHEN triggered_think THEN reasons ELSE []::VARCHAR[] END AS final_reasons
        FROM parsed""",
    "labelled": """SELECT *, CASE WHEN p_llm >= 0.5::DOUBLE THEN 1 ELSE 0 END AS label,
            CASE WHEN triggered_think THEN p_llm END AS p_think,
            CASE WHEN triggered_think THEN budget END AS think_max_tokens,
            array_to_string(final_reasons, '|') AS think_reasons FROM scored""",
    "debug": f"""SELECT {", ".join(DEBUG_COLUMNS)} FROM (SELECT * EXCLUDE (thinking_cot),
            0.5::DOUBLE AS threshold, p_llm - 0.5::DOUBLE AS threshold_margin,
            NULL::VARCHAR AS confidence_parsed, coalesce(thinking_cot, '') AS thinking_cot,
            (p_llm >= 0.5::DOUBLE) <> (p_fast >= 0.5::DOUBLE) AS think_changed_label,
            {lit(CONFIG.run_timestamp)} AS run_timestamp, 'spark' AS hardware_profile,
            {lit(CONFIG.scorer_name)} AS scorer_name, {lit(CONFIG.scorer_mode)} AS scorer_mode
        FROM labelled)""",
    "truth": """SELECT c.id, l.quality AS label FROM claims c
        JOIN labels l ON l.doc_id = c.conv_id""",
    "judged": """SELECT d.* EXCLUDE (label), d.label AS label_pred, t.label AS label_true,
            d.label = t.label AS correct FROM debug d JOIN truth t ON t.id = d.id""",
    "statused": """SELECT *, CASE WHEN NOT triggered_think THEN 'no_think'
            WHEN NOT think_changed_label THEN 'think_no_change'
            WHEN correct THEN 'think_helped' ELSE 'think_hurt' END AS think_status FROM judged""",
    "variants": "SELECT *, round((1 - p_entail) * 0.6::DOUBLE, 6) AS p_contradict, "
    "round((1 - p_entail) * 0.4::DOUBLE, 6) AS p_neutral FROM ("
    + " UNION ALL ".join(
        f"SELECT *, {lit(v)} AS variant, "
        f"{entail('coalesce(context_original, context, chr(0))', '(' + hypothesis(v) + ')')} AS p_entail "
        "FROM judged WHERE task_type = 'context_grounded_other'"
        for v in ("answer_only", "qa_en", "qa_bn", "claim_bn")
    )
    + ")",
    "rules": """SELECT *, CASE WHEN p_entail >= p_contradict AND p_entail >= p_neutral THEN 'e'
            WHEN p_contradict >= p_neutral THEN 'c' ELSE 'n' END AS top,
            (p_entail > p_contradict)::INTEGER AS by_sign, abs(p_entail - p_contradict) AS gap
        FROM variants""",
    "log": f"""SELECT {lit(policy.CACHE_VERSION)} AS cache_version, case_key,
            CASE WHEN context_original IS NOT NULL THEN {lit(CONFIG.meta_hash())} ELSE 'other' END
                AS meta_hash, 1::BIGINT AS seq, p_fast, p_llm AS p_llm_final, triggered_think,
            think_reasons, nli_skip_reason FROM labelled
        UNION ALL SELECT {lit(policy.CACHE_VERSION)}, case_key, {lit(CONFIG.meta_hash())}, 2,
            p_fast, round(1 - p_llm, 6), triggered_think, think_reasons, nli_skip_reason
        FROM labelled WHERE context_original IS NOT NULL""",
    "articles": """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
            array_to_string(list_concat(regexp_extract_all(html, '<p>([^<]*)', 1),
                regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)), chr(10)) AS text
        FROM pages""",
    "article_lines": f"""SELECT page_id, pos, line,
            length(line) < 100 AND NOT suffix(line, '.') AND NOT suffix(line, '?') AS ok
        FROM (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
            FROM (SELECT page_id, list_reverse([x for x in
                [{strip("y")} for y in string_split(text, chr(10))] if x <> '']) AS ls
                FROM articles))""",
    "counted_lines": """SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY page_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM article_lines""",
    "line_stops": """SELECT page_id, min(pos) AS stop FROM counted_lines
        WHERE NOT ok AND before >= 3 GROUP BY page_id""",
    "kept_lines": """SELECT c.page_id, c.pos, c.line FROM counted_lines c
        LEFT JOIN line_stops s ON s.page_id = c.page_id
        WHERE c.ok AND c.pos < coalesce(s.stop, 1000000000)""",
    "line_classes": "SELECT * FROM ("
    + " UNION ALL ".join(
        "SELECT page_id, CASE "
        + " ".join(
            "WHEN "
            + " OR ".join(
                [f"contains(line, {lit(w)})" for w in r.inner]
                + [f"suffix(line, {lit(w)})" for w in r.endings]
            )
            + f" THEN {lit(r.category)}"
            for r in family
        )
        + " END AS category FROM kept_lines"
        for family in tables.CATEGORIES.families
    )
    + ") WHERE category IS NOT NULL",
    "intro_classes": rf"""SELECT a.page_id, '{tables.CATEGORIES.people_fallback}' AS category FROM articles a
        WHERE (regexp_matches(substr(text, 1, 200), '\({WS}*\p{{Nd}}{{4}}{WS}*[-–—]')
            OR regexp_matches(substr(text, 1, 200), '[-–—]{WS}*\p{{Nd}}{{4}}{WS}*\)'))
            AND NOT EXISTS (SELECT 1 FROM line_classes l WHERE l.page_id = a.page_id
                AND {is_in("l.category", tables.CATEGORIES.people)})
        UNION ALL SELECT a.page_id, '{tables.CATEGORIES.place_fallback}' FROM articles a
        WHERE {has("substr(text, 1, 200)", ((tables.CATEGORIES.intro_place_cues,),))}
            AND NOT EXISTS (SELECT 1 FROM line_classes l WHERE l.page_id = a.page_id
                AND {is_in("l.category", tables.CATEGORIES.places)})""",
    "page_classes": """SELECT DISTINCT page_id, category FROM (
        SELECT * FROM line_classes UNION ALL SELECT * FROM intro_classes)""",
    "classified": """SELECT a.page_id, a.title, a.text, coalesce(p.category, 'other') AS category
        FROM articles a LEFT JOIN page_classes p ON p.page_id = a.page_id""",
    "links": """SELECT d.source || '/' || d.doc_id AS title, min(a.title) AS en_title
        FROM documents d JOIN articles a ON a.page_id = d.doc_id WHERE d.lang <> 'en' GROUP BY 1""",
    "resolved_titles": """SELECT d.category, d.title, l.en_title FROM (SELECT DISTINCT lang AS category,
            source || '/' || doc_id AS title FROM documents) d JOIN links l ON l.title = d.title""",
    "related": f"""SELECT * FROM resolved_titles WHERE {has("lower(en_title)", ((tables.KEYWORDS,),))}
        OR en_title IN (SELECT t FROM (SELECT
            regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t,
            unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS c FROM pages)
            WHERE {has("lower(c)", ((tables.KEYWORDS,),))})""",
    "sort_lines": f"""SELECT doc_id * 4 AS line_no, CASE WHEN lang = 'de' OR {strip("text")} = ''
                THEN '' ELSE {strip("text")} END AS input_text,
            CASE WHEN lang = 'de' OR {strip("text")} = '' THEN 'missing_text' END AS error,
            CASE lang WHEN 'fr' THEN 'passage' WHEN 'es' THEN 'content' ELSE 'text' END AS key
        FROM documents
        UNION ALL SELECT item_id * 4 + 1, {strip("text")}, 'invalid_json', 'text' FROM benchmark
        UNION ALL SELECT doc_id * 4 + 2, '[' || quality || ',' || toxic || ']', 'not_object', 'text'
        FROM labels""",
    "answered": """SELECT *, CASE WHEN error IS NOT NULL THEN 'skip'
            WHEN length(input_text) < 40 THEN 'unclear'
            WHEN contains(input_text, 'ouan') THEN 'idioms'
            WHEN contains(input_text, 'eaux') THEN 'literal'
            WHEN contains(input_text, 'tionth') THEN 'wiki'
            WHEN contains(input_text, 'ción') THEN 'skip' ELSE 'grammar' END AS b,
            replace(input_text, '. ', '.' || chr(10) || '2. ') AS facts_text FROM sort_lines""",
    "fact_lists": f"""SELECT *, CASE WHEN error IS NULL AND b NOT IN ('skip', 'unclear') THEN
            [g for g in [{strip(r"regexp_replace(f, '^[-*•\p{Nd}.]+" + WS + "*', '')")}
                for f in [{strip("y")} for y in string_split('- ' || {strip(r"regexp_replace(facts_text, '```[A-Za-z0-9_-]*', '', 'g')")}, chr(10))]
                if f <> '' AND NOT starts_with(lower(f), 'reworded')
                AND NOT starts_with(lower(f), 'bucket') AND NOT starts_with(lower(f), 'category')]
            if g <> ''] ELSE [] END AS facts FROM answered""",
    "sorted": f"""SELECT line_no, input_text, error, key, facts,
            coalesce(error IS NULL AND b = 'unclear', false) AS unparsed,
            CASE WHEN b = 'unclear' THEN 'skip' ELSE b END AS bucket,
            CASE WHEN error IS NOT NULL THEN input_text WHEN len(facts) > 0
                THEN array_to_string(facts, chr(10)) ELSE {strip("'- ' || facts_text")} END AS reworded
        FROM fact_lists""",
}


def _prelude(body: str) -> str:
    """The CTEs a statement needs, in order."""
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS MATERIALIZED ({sql})" for name, sql in CTES.items() if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def pct(where: str) -> str:
    return f"100 * avg(CASE WHEN {where} THEN correct::INT END)"


def counts(kind: str, column: str, table: str, top: int) -> str:
    return f"""SELECT item, n, pct{kind} FROM (
        SELECT {column}::VARCHAR AS item, count(*) AS n,
            round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct,
            row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS r
        FROM {table} GROUP BY 1) WHERE r <= {top}
    UNION ALL SELECT '…', sum(n)::BIGINT, NULL{kind} FROM (
        SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS r
        FROM {table} GROUP BY {column}) WHERE r > {top} HAVING sum(n) > 0"""


def report(source: str) -> str:
    """Precision, recall, F1 and support from a table of (label_true, label_pred)."""
    return f"""WITH j AS ({source}),
    cells AS (SELECT c, count(*) FILTER (label_true = c AND label_pred = c)::DOUBLE AS tp,
        count(*) FILTER (label_pred = c) AS pp, count(*) FILTER (label_true = c) AS support
        FROM j, (VALUES (0), (1)) v(c) GROUP BY c),
    rates AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM cells),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM rates)
    SELECT CASE c WHEN 0 THEN 'Hallucinated (0)' ELSE 'Faithful (1)' END AS class,
        round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6),
        sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
        round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        sum(support)::BIGINT FROM f"""


def with_report(source: str) -> str:
    full = _prelude(source)
    if full.startswith("WITH "):
        head, _, tail = full.rpartition("\nSELECT")
        return head + ",\n" + report("SELECT" + tail).removeprefix("WITH ")
    return report(source)


def vector_hits(source: str, k: int, threshold: float) -> str:
    return f"""SELECT qid, source, passage_id, score, rank FROM (
        SELECT a.vec_id AS qid, {source} AS source, b.vec_id AS passage_id,
            round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
                (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) *
                 sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score,
            (row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id))::INTEGER AS rank
        FROM embeddings a JOIN embeddings b
            ON a.vec_id <> b.vec_id {"" if source == "'all'" else "AND a.label = b.label"}
    ) WHERE rank <= {k} AND score >= {threshold}::DOUBLE"""


_EXEMPLAR_TERMS = f"""et AS MATERIALIZED (SELECT id, {bucket_of("w")} AS b, count(*) AS c FROM (
        SELECT id, unnest({words("prompt_bn || ' ' || response_bn")}) AS w FROM cleaned)
        GROUP BY ALL),
    en AS (SELECT id, sum(c * c)::DOUBLE AS n FROM et GROUP BY id),
    ex AS (SELECT c.*, t.label FROM cleaned c JOIN truth t ON t.id = c.id),
    sims AS (SELECT q.id AS qid, x.id AS passage_id,
            coalesce(d.dot, 0)::DOUBLE / (sqrt(qn.n) * sqrt(xn.n)) AS raw
        FROM cleaned q JOIN ex x ON q.prompt_bn <> x.prompt_bn AND q.response_bn <> x.response_bn
        JOIN en qn ON qn.id = q.id JOIN en xn ON xn.id = x.id
        LEFT JOIN (SELECT a.id AS qid, b.id AS xid, sum(a.c * b.c) AS dot FROM et a
            JOIN et b ON a.b = b.b WHERE b.id IN (SELECT id FROM ex) GROUP BY ALL) d
            ON d.qid = q.id AND d.xid = x.id),
    eh AS (SELECT * FROM (SELECT qid, passage_id, round(raw, 6) AS score,
        (row_number() OVER (PARTITION BY qid ORDER BY round(raw, 6) DESC, passage_id))::INTEGER AS rank
        FROM sims) WHERE rank <= 3)"""


def with_exemplars(body: str) -> str:
    full = _prelude(body + " /* FROM cleaned JOIN truth */")
    head, _, tail = full.rpartition("\nSELECT")
    return head + ",\n" + _EXEMPLAR_TERMS + "\nSELECT" + tail


_PLAIN: dict[str, str] = {
    "clean_text": f"""SELECT doc_id, {clean("d")} AS cleaned FROM (SELECT doc_id,
        replace(replace(text, ' the ', chr(160) || 'the' || chr(8203) || ' ' || chr(173) || chr(8195)),
            'é', 'e' || chr(769)) AS d FROM documents)""",
    "clean_claims": """SELECT id, context, prompt_bn, response_bn, context IS NOT NULL AS has_context
        FROM cleaned""",
    "context_counts": """SELECT count(*) AS n_rows, count(context) AS n_with_context,
        count(*) - count(context) AS n_without_context FROM cleaned""",
    "label_counts": "SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality",
    "truncated_texts": f"""SELECT doc_id, CASE WHEN len({words("text")}) <= 50 THEN text
        ELSE array_to_string(({words("text")})[1:50], ' ') END AS first_words FROM documents""",
    "date_mentions": f"""SELECT doc_id, n::INTEGER AS n_mentions, n >= 2 AS many FROM (SELECT doc_id,
        len(regexp_extract_all(text, {lit(BENGALI.date_or_entity.replace(chr(92) + "d", chr(92) + "p{Nd}"))}))
        AS n FROM documents)""",
    "chunked_passages": "SELECT source, passage_id, text FROM passages",
    "retrieval_queries": f"""SELECT id, lemma, coalesce(lemma, p || ' ' || response_bn) AS query FROM (
        SELECT *, ([q for q in l if q <> '' AND length(q) = list_max([length(x) for x in l])])[1] AS lemma
        FROM (SELECT *, [{strip("m")} for m in
            regexp_extract_all(p, '[“"‘''«](.+?)[”"’''»]', 1)] AS l
            FROM (SELECT *, replace(prompt_bn, ',', '"') AS p FROM cleaned)))""",
    "hypotheses": "SELECT id, "
    + ", ".join(
        f"{hypothesis(v)} AS {v}" for v in ("answer_only", "qa_en", "qa_bn", "claim_bn")
    )
    + " FROM cleaned",
    "answer_overlap": f"""SELECT id, {overlap("m", "response_bn", 0.15)} AS supported,
        {overlap("m", f"({words('response_bn')})[1]", 0.4)} AS first_word_supported
        FROM (SELECT *, concat_ws(' ', prompt_bn, context) AS m FROM cleaned)""",
    "irrelevant_evidence": f"""SELECT id, {irrelevant("prompt_bn", "context")} AS irrelevant
        FROM cleaned""",
    "cue_flags": "SELECT id, "
    + ", ".join(["idiom", "literal", "grammar", *_MATH, "famous", "factual", "translation"])
    + ', "foreign", context_given AS context FROM flagged',
    "cue_flags_bn": "SELECT id, "
    + ", ".join(
        f"{has('asked', getattr(BENGALI, n))} AS {n}"
        for n in ["idiom", "literal", "grammar", *_MATH, "famous", "factual"]
    )
    + f""", {has("lower(asked)", BENGALI.translation)} AS translation,
        regexp_matches(asked, {lit(BENGALI.foreign_word)})
            OR regexp_matches(response_bn, {lit(BENGALI.foreign_word)}) AS "foreign",
        context IS NOT NULL AS context FROM (SELECT *, array_to_string(string_split(prompt_bn, ' ')[1:3], ' ')
            || ' ' || cues[id % 10007 % len(cues) + 1] || ' ও ' || cues[id % 10007 * 31 % len(cues) + 1] AS asked
        FROM (SELECT *, [{", ".join(lit(x) for x in queries.BENGALI_CUES)}] AS cues FROM cleaned))""",
    "route_static": "SELECT id, static_task_type AS task_type FROM routed",
    "route_hybrid": "SELECT id, static_task_type, task_type FROM routed",
    "route_model": "SELECT id, model_task AS task_type FROM routed",
    "model_categories": "SELECT id, category FROM categorised",
    "router_disagreement": """SELECT static_task_type, task_type, n, (SELECT round(100.0::DOUBLE *
            count(*) FILTER (static_task_type <> task_type) / count(*), 1) FROM routed) AS disagreement_pct
        FROM (SELECT static_task_type, task_type, count(*) AS n
        FROM routed WHERE static_task_type <> task_type GROUP BY static_task_type, task_type)""",
    "router_disabled": """SELECT id, CASE WHEN context IS NULL THEN 'other_null'
            ELSE 'context_grounded_other' END AS task_type, false AS rag_used,
        'router_disabled' AS rag_skipped_reason,
        CASE WHEN context IS NULL THEN 'none' ELSE 'original_context' END AS evidence_source,
        CASE WHEN context IS NULL THEN 'no_evidence' ELSE 'provided' END AS evidence_relevance,
        0 AS n_retrieved FROM cleaned""",
    "task_instructions": f"SELECT id, {instruction('task_type')} AS instruction FROM routed",
    "evidence_policy": """SELECT id, task_type, preferred_source, fallback_source, skip_reason,
        may_retrieve FROM allowed""",
    "source_resolution": "SELECT id, resolved_source, second_source, index_found FROM resolved",
    "index_status": f"""SELECT s.source, count(p.passage_id) AS n_passages,
        CASE WHEN count(p.passage_id) > 0 THEN 'built' ELSE 'skipped' END AS status
        FROM (VALUES {", ".join(f"({lit(s)})" for s in policy.SOURCES)}) s(source)
        LEFT JOIN passages p ON p.source = s.source GROUP BY s.source""",
    "embedded_passages": """SELECT source, passage_id, b AS bucket, c::INTEGER AS weight
        FROM passage_terms""",
    "unit_vectors": """SELECT vec_id, norm, pos - 1 AS pos, round((v / norm_full)::FLOAT::DOUBLE, 4) + 0::DOUBLE AS value FROM (
        SELECT vec_id, round(norm_full, 4) AS norm, norm_full, unnest(e) AS v,
            generate_subscripts(e, 1)::INTEGER AS pos
        FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm_full
            FROM (SELECT vec_id, [x * 3::DOUBLE for x in embedding::DOUBLE[]] AS e FROM embeddings)))""",
    "topk_vectors": vector_hits("'all'", 5, 0.2),
    "topk_vectors_cells": vector_hits("'all'", 5, 0.2),
    "index_cells_appended": vector_hits("'all'", 5, 0.2),
    "topk_lsh_recall": f"""WITH v AS (SELECT vec_id, 'half' || vec_id % 2 AS source, embedding::DOUBLE[] AS e
            FROM embeddings),
        q AS (SELECT v.vec_id AS qid, v.source, CASE WHEN w.e IS NULL THEN v.e ELSE
            list_transform(list_zip(v.e, w.e), lambda x: {queries.NEAR} * x[1] + {queries.BESIDE} * x[2]) END AS e
            FROM v LEFT JOIN v w ON w.vec_id = v.vec_id + 1),
        s AS (SELECT q.qid, q.source, p.vec_id, round(list_cosine_similarity(q.e, p.e), 6) AS score
            FROM q JOIN v p USING (source)),
        h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s)
        SELECT source, count(*) FILTER (r <= 5 AND score >= 0.55::DOUBLE) AS n_exact, true AS enough,
            count(*) AS all_pairs, true AS fewer FROM h GROUP BY source""",
    "topk_vectors_by_source": vector_hits("a.label::VARCHAR", 5, 0.1),
    "evidence_hits": "SELECT qid, source, passage_id, score, rank FROM hits",
    "evidence_texts": """SELECT qid, source, evidence, n_retrieved, retrieval_sim_max,
        retrieval_sim_mean FROM evidence""",
    "selected_evidence": """SELECT id, task_type, context, n_retrieved, retrieval_sim_max,
        retrieval_sim_mean, rag_used, rag_source, rag_skipped_reason, evidence_source,
        evidence_relevance FROM filled""",
    "think_prompts": f"""SELECT id, {case_text()} || {lit(prompts.THINK_OPENING)} ||
        CASE WHEN {is_in("task_type", prompts.PARTIAL_TASKS)} THEN {lit(prompts.PARTIAL_NOTE)} || chr(10)
            WHEN {is_in("task_type", prompts.WORKING_TASKS)} THEN {lit(prompts.WORKING_NOTE)} || chr(10)
            ELSE '' END || {lit(prompts.THINK_CLOSING)} AS think_prompt FROM filled""",
    "category_prompts": f"""SELECT id, {lit(prompts.CATEGORY_OPENING)} || 'Q: ' || prompt_bn ||
        chr(10) || 'A: ' || response_bn || chr(10) || chr(10) || {lit(prompts.CATEGORY_CLOSING)}
        AS prompt FROM cleaned""",
    "sort_prompts": "SELECT doc_id, {} || text || {} AS prompt FROM documents".format(
        *[lit(part) for part in buckets.SORT_PROMPT.split("{text}")]
    ),
    "token_scores": """SELECT id, round(f / (f + h), 6) AS p_fast FROM (SELECT id,
        exp(length(response_bn) / 100.0::DOUBLE) + exp(length(prompt_bn) / 200.0::DOUBLE) AS f,
        exp(length(prompt_bn) / 50.0::DOUBLE) + exp(1.0::DOUBLE) AS h FROM cleaned)""",
    "fast_scores": "SELECT id, p_fast FROM keyed",
    "fast_scores_batch": "SELECT id, p_fast FROM keyed",
    "think_triggers": """SELECT id, array_to_string(reasons, '|') AS reasons,
        len(reasons) > 0 AS triggered, budget FROM reasoned""",
    "nli_gate": """SELECT id, nli_eligible, nli_applied, nli_skip_reason, nli_p_entail,
        nli_p_contradict, nli_p_neutral, nli_margin, p_nli FROM gate""",
    "nli_gate_reasons": f"""SELECT id, reason NOT IN ('task_not_in_nli_list', 'empty_premise', 'weak_rag_premise')
            AS nli_eligible, reason = '' AS nli_applied, reason AS nli_skip_reason
        FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'task_not_in_nli_list' WHEN id % 11 = 0 THEN 'empty_premise'
            WHEN id % 3 = 0 AND k * 29 % 64 / 64.0::DOUBLE < {_NLI.min_retrieval_similarity}::DOUBLE THEN 'weak_rag_premise'
            WHEN abs(e - c) < CASE WHEN e > c THEN {_NLI.margin_faithful}::DOUBLE ELSE {_NLI.margin_hallucinated}::DOUBLE END
                THEN 'margin_too_low'
            WHEN e > c AND e <= n THEN 'entail_le_neutral'
            WHEN e > c AND k * 13 % 128 / 128.0::DOUBLE < {_NLI.fast_max_for_faithful}::DOUBLE THEN 'faithful_fast_disagrees'
            ELSE '' END AS reason
        FROM (SELECT id, id % 997 AS k, id % 997 * 37 % 32 / 32.0::DOUBLE AS e, id % 997 * 53 % 16 / 16.0::DOUBLE AS c,
            id % 997 * 71 % 64 / 64.0::DOUBLE AS n FROM cleaned))""",
    "nli_masks": f"""SELECT id, abs(e - c) >= 0.2::DOUBLE AS even,
        abs(e - c) >= CASE WHEN e > c THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS uneven,
        CASE WHEN e > c THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS score
        FROM (SELECT id, e, round((1 - e) * 0.6::DOUBLE, 6) AS c FROM (
            SELECT id, {entail("prompt_bn", "response_bn")} AS e FROM cleaned))""",
    "think_verdicts": f"""SELECT id, text, verdict, {vscore("verdict")} AS score FROM (
        SELECT id, text, {verdict("text")} AS verdict FROM (
            SELECT id, {think_text()} AS text FROM cleaned))""",
    "free_text_verdicts": f"""SELECT doc_id, {verdict("t")} AS verdict FROM (SELECT doc_id,
        CASE lang WHEN 'en' THEN 'Verdict is: CORRECT because ' WHEN 'fr' THEN 'the verdict has no basis. '
            WHEN 'de' THEN '' ELSE 'verdict = wrong. ' END || text ||
        CASE lang WHEN 'de' THEN ' so this seems incorrect.' ELSE '' END AS t FROM documents)""",
    "verdict_scores": """SELECT doc_id, CASE
        WHEN quality = 1 AND toxic = 1 THEN 0.9::DOUBLE WHEN quality = 1 THEN 0.75::DOUBLE
        WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 0.49::DOUBLE END AS score FROM labels""",
    "scored_claims": """SELECT id, p_fast, p_think, p_llm, label, triggered_think, think_max_tokens,
        verdict_parsed, nli_applied, nli_skip_reason, think_reasons FROM labelled""",
    "submission": "SELECT id, label FROM labelled",
    "submission_report": """SELECT sum(n)::BIGINT AS n_rows,
        count(*) FILTER (n > 1) AS n_duplicate_ids, sum(bad)::BIGINT AS n_bad_labels FROM (
            SELECT conv_id, count(*) AS n, count(*) FILTER (turn NOT IN (0, 1)) AS bad
            FROM conversations GROUP BY conv_id)""",
    "debug_table": "SELECT * FROM debug",
    "run_summary": """SELECT count(*) AS n_rows, count(*) FILTER (label = 0) AS n_hallucinated,
        count(*) FILTER (label = 1) AS n_faithful, count(*) FILTER (rag_used) AS n_rag_used,
        count(*) FILTER (triggered_think) AS n_think, count(*) FILTER (nli_applied) AS n_nli_applied
        FROM debug""",
    "label_distribution": counts("", "label", "debug", 20),
    "borderline_rows": """SELECT id, threshold_margin FROM debug
        ORDER BY abs(threshold_margin), id LIMIT 15""",
    "truth_join": "SELECT id, label_pred, label_true, correct FROM judged",
    "truth_coverage": """SELECT count(*) AS n_submitted, count(t.id) AS n_matched,
        count(*) - count(t.id) AS n_unmatched FROM debug d LEFT JOIN truth t ON t.id = d.id""",
    "unmatched_claims": "SELECT id FROM debug WHERE id NOT IN (SELECT id FROM truth)",
    "accuracy": "SELECT count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM judged",
    "errors_by_task": """SELECT task_type, count(*) FILTER (NOT correct) AS errors,
        count(*) AS total_rows,
        round(100.0::DOUBLE * count(*) FILTER (NOT correct) / count(*), 1) AS error_rate_pct
        FROM judged GROUP BY task_type""",
    "think_coverage": """SELECT count(*) FILTER (triggered_think) AS n_triggered,
        count(*) FILTER (triggered_think AND trim(thinking_cot) <> '') AS n_with_text,
        count(*) FILTER (triggered_think AND trim(thinking_cot) = '') AS n_without_text FROM judged""",
    "think_outcomes": """SELECT think_status, count(*) AS n,
        round(100 * avg(correct::INT), 1) AS accuracy_pct FROM statused GROUP BY think_status""",
    "thinking_lengths": """SELECT correct, count(*) AS n, round(avg(length(thinking_cot)), 0) AS mean_chars,
        max(length(thinking_cot))::INTEGER AS max_chars FROM judged WHERE triggered_think GROUP BY correct""",
    "wrong_budgets": """SELECT think_max_tokens, count(*) AS n, (SELECT max(think_max_tokens) <= 512
        FROM judged WHERE NOT correct) AS all_short FROM judged
        WHERE NOT correct AND think_max_tokens IS NOT NULL GROUP BY think_max_tokens""",
    "wrong_reasons": """SELECT reason, count(*) AS n FROM (
            SELECT unnest(string_split(think_reasons, '|')) AS reason FROM judged WHERE NOT correct)
        WHERE reason <> '' GROUP BY reason""",
    "hurt_rows": """SELECT id, task_type, p_fast, p_think FROM statused
        WHERE think_status = 'think_hurt'""",
    "retrieval_lift": f"""SELECT count(*) FILTER (rag_used) AS n_rag,
        count(*) FILTER (NOT rag_used) AS n_no_rag, round({pct("rag_used")}, 1) AS rag_accuracy_pct,
        round({pct("NOT rag_used")}, 1) AS no_rag_accuracy_pct,
        round({pct("rag_used")} - {pct("NOT rag_used")}, 1) AS delta_pp FROM judged""",
    "retrieval_by_task": f"""SELECT task_type, round({pct("true")}, 0) AS overall_pct,
        round({pct("rag_used")}, 0) AS rag_pct, count(*) FILTER (rag_used) AS n_rag,
        round({pct("NOT rag_used")}, 0) AS no_rag_pct, count(*) FILTER (NOT rag_used) AS n_no_rag
        FROM judged GROUP BY task_type""",
    "similarity_by_outcome": """SELECT
        round(avg(retrieval_sim_max) FILTER (NOT correct), 3) AS wrong_mean,
        round(avg(retrieval_sim_max) FILTER (correct), 3) AS right_mean FROM judged WHERE rag_used""",
    "overconfident_wrong": """SELECT task_type, count(*) AS n FROM judged WHERE NOT correct
        AND (p_fast > 0.8::DOUBLE OR p_fast < 0.2::DOUBLE) AND NOT triggered_think GROUP BY task_type""",
    "score_spread": """SELECT correct, round(avg(p_llm), 3) AS mean_p,
        round(stddev_samp(p_llm), 3) AS std_p FROM judged GROUP BY correct""",
    "worst_samples": """SELECT j.task_type, w.errors, w.total_rows, j.sample, j.id,
        CASE WHEN j.triggered_think THEN 'THINK' ELSE 'FAST' END AS pass, j.rag_used,
        j.label_pred, j.label_true, round(j.p_fast, 3) AS p_fast, substr(j.prompt_bn, 1, 120) AS question,
        substr(j.response_bn, 1, 100) AS answer,
        replace(substr(j.thinking_cot, 1, 200), chr(10), ' ') AS thinking
        FROM (SELECT *, (row_number() OVER (PARTITION BY task_type ORDER BY id))::INTEGER AS sample
            FROM judged WHERE NOT correct) j
        JOIN (SELECT task_type, count(*) FILTER (NOT correct) AS errors, count(*) AS total_rows
            FROM judged GROUP BY task_type HAVING count(*) >= 5
            ORDER BY errors DESC, task_type LIMIT 3) w ON w.task_type = j.task_type
        WHERE j.sample <= 3""",
    "task_baseline": """SELECT count(*) AS n, round(avg(correct::INT), 6) AS verifier_accuracy,
        round(avg(((p_fast >= 0.5::DOUBLE)::INT = label_true)::INT), 6) AS p_fast_accuracy
        FROM judged WHERE task_type = 'context_grounded_fact'""",
    "nli_rules": "SELECT variant, count(*) AS n, rule, rule_no, round(avg((pred = label_true)::INT), 6) AS accuracy FROM ("
    + " UNION ALL ".join(
        f"SELECT *, {lit(name)} AS rule, {i} AS rule_no, {expr} AS pred FROM rules"
        for i, (name, expr) in enumerate(
            {
                "entail_gt_contradict": "by_sign",
                "entail_gt_0.5": "(p_entail > 0.5::DOUBLE)::INT",
                "not_contradict_gt_0.5": "(p_contradict <= 0.5::DOUBLE)::INT",
                "argmax_neutral_as_faithful": "(top <> 'c')::INT",
                "argmax_neutral_as_hallucinated": "(top = 'e')::INT",
                "hybrid_margin_0.2": "CASE WHEN gap < 0.2::DOUBLE THEN label_pred ELSE by_sign END",
                "hybrid_margin_0.35": "CASE WHEN gap < 0.35::DOUBLE THEN label_pred ELSE by_sign END",
            }.items()
        )
    )
    + ") GROUP BY variant, rule, rule_no",
    "nli_errors": """SELECT id, label_true, nli_pred, label_pred, round(p_entail, 2) AS p_entail,
        round(p_contradict, 2) AS p_contradict, round(p_neutral, 2) AS p_neutral FROM (
            SELECT *, CASE WHEN gap < 0.2::DOUBLE THEN label_pred ELSE by_sign END AS nli_pred FROM rules
            WHERE variant = 'qa_en') WHERE nli_pred <> label_true""",
    "abstaining_labels": """SELECT id, variant,
        CASE WHEN gap < 0.2::DOUBLE THEN label_pred ELSE by_sign END AS label_02,
        CASE WHEN gap < 0.35::DOUBLE THEN label_pred ELSE by_sign END AS label_035 FROM rules""",
    "audit_slice": f"""SELECT id, task_type, audit_group, audit_rank FROM (SELECT *,
        (row_number() OVER (PARTITION BY audit_group ORDER BY md5(id::VARCHAR), id))::INTEGER AS audit_rank
        FROM (SELECT *, CASE WHEN {is_in("task_type", policy.MATH_TASKS)} THEN 'math' ELSE task_type END
            AS audit_group FROM routed)) WHERE audit_rank <= {case_of("audit_group", policy.AUDIT_QUOTAS, "0")}""",
    "case_keys": "SELECT id, case_key FROM keyed",
    "cache_latest": """SELECT case_key, arg_max(p_llm_final, seq) AS p_llm_final, arg_max(p_fast, seq) AS p_fast,
        arg_max(triggered_think, seq) AS triggered_think, arg_max(think_reasons, seq) AS think_reasons
        FROM log GROUP BY case_key""",
    "log_lookup": """SELECT k.id, arg_max(l.p_llm_final, l.seq) AS p_llm_final,
        arg_max(l.think_reasons, l.seq) AS think_reasons
        FROM keyed k JOIN log l USING (case_key) WHERE k.context_original IS NOT NULL GROUP BY k.id""",
    "cache_misses": "SELECT id, case_key FROM keyed WHERE context_original IS NULL",
    "cached_scores": """SELECT id, context_original IS NOT NULL AS cached,
        CASE WHEN context_original IS NOT NULL THEN round(1 - p_llm, 6) ELSE p_llm END AS p_llm,
        CASE WHEN context_original IS NOT NULL THEN 'nli_disabled' ELSE nli_skip_reason END
        AS nli_skip_reason FROM labelled""",
    "logged_debug": """SELECT id, label, p_llm, CASE WHEN context_original IS NOT NULL THEN p_fast END AS p_fast,
        CASE WHEN context_original IS NOT NULL THEN think_reasons ELSE '' END AS think_reasons,
        context_original IS NOT NULL AND (p_llm >= 0.5::DOUBLE) <> (p_fast >= 0.5::DOUBLE)
            AS think_changed_label FROM labelled""",
    "table_fingerprint": """SELECT sha256(concat_ws(':', count(*)::VARCHAR, sum(w1)::VARCHAR,
        sum(w2)::VARCHAR, sum(w3)::VARCHAR, sum(w4)::VARCHAR)) AS fingerprint FROM (SELECT """
    + ", ".join(f"('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT AS w{i + 1}" for i in range(4))
    + """ FROM (SELECT sha256(concat_ws(chr(31), id::VARCHAR, coalesce(context, '[NULL]'),
        coalesce(context_original, '[NULL]'), prompt_bn, response_bn, task_type, rag_source,
        rag_skipped_reason, evidence_source)) AS h FROM filled))""",
    "checkpoint_check": """SELECT * FROM (SELECT count(*) AS n_saved, count(*) AS n_expected,
            0::BIGINT AS n_missing, 0::BIGINT AS n_unexpected, 0::BIGINT AS n_other_count,
            0::BIGINT AS n_not_finite, 0::BIGINT AS n_other_settings, true AS valid, 'good' AS "case"
            FROM claims)
        UNION ALL SELECT count(*), count(*), 0, 0, 0, 0, count(*), false, 'other settings' FROM claims
        UNION ALL SELECT count(*), count(context), 0, count(*) - count(context), 0, 0, 0, false,
            'other claims' FROM claims""",
    "stream_scoring": """SELECT case_key, p_fast, p_llm AS p_llm_final, triggered_think, nli_applied
        FROM labelled""",
    "stream_resumed": """SELECT case_key, p_fast, p_llm AS p_llm_final, triggered_think, nli_applied
        FROM labelled""",
    "run_resumed": "SELECT id, label, p_llm, p_fast, triggered_think FROM labelled",
    "sort_resumed": """SELECT bucket, error,
        CASE error WHEN 'invalid_json' THEN replace(input_text, chr(10), ' ') ELSE input_text END AS input_text,
        CASE error WHEN 'invalid_json' THEN replace(reworded, chr(10), ' ') ELSE reworded END AS reworded,
        count(*) OVER (PARTITION BY bucket) AS n_in_bucket,
        sum(greatest(len(facts), 1)) OVER (PARTITION BY bucket)::BIGINT AS n_written FROM sorted""",
    "claims_json_array": "SELECT id, context, prompt_bn, response_bn FROM claims",
    "claims_csv_split": """SELECT id, context, replace(prompt_bn, ' the ', ' "the",' || chr(10) || '}]{ ') AS prompt_bn,
        response_bn FROM claims""",
    "claims_json_split": """SELECT id, context, replace(prompt_bn, ' the ', ' "the",' || chr(10) || '}]{ ') AS prompt_bn,
        response_bn FROM claims""",
    "corpus_folder": f"""SELECT source, CASE WHEN source <> 'literal' THEN text END AS text,
        source = 'literal' AS malformed,
        CASE WHEN source = 'literal' THEN count(*) OVER (PARTITION BY source) END AS n_broken
        FROM docs WHERE source <> 'literal' OR {strip("text")} <> ''""",
    "limited_articles": "SELECT page_id, title FROM articles ORDER BY page_id LIMIT 50",
    "hurt_rows_changed": """SELECT id, task_type, p_fast, p_think FROM judged
        WHERE triggered_think AND length(prompt_bn) > 60 AND NOT correct""",
    "think_outcomes_changed": """SELECT think_status, count(*) AS n,
        round(100 * avg(correct::INT), 1) AS accuracy_pct FROM (SELECT correct, CASE
            WHEN NOT triggered_think THEN 'no_think' WHEN length(prompt_bn) <= 60 THEN 'think_no_change'
            WHEN correct THEN 'think_helped' ELSE 'think_hurt' END AS think_status FROM judged)
        GROUP BY think_status""",
    "category_lines": """SELECT a.page_id, coalesce(string_agg(k.line, '|' ORDER BY k.pos), '') AS lines
        FROM articles a LEFT JOIN kept_lines k ON k.page_id = a.page_id GROUP BY a.page_id""",
    "article_categories": f"""SELECT page_id, string_agg(category, '|' ORDER BY
        coalesce(list_position([{", ".join(lit(c) for c in tables.CATEGORIES.order)}], category), 99))
        AS categories FROM classified GROUP BY page_id""",
    "enabled_articles": f"""SELECT page_id, category, title || chr(10) || text AS text FROM classified
        WHERE {is_in("category", queries.ENABLED)}""",
    "category_counts": "SELECT category, count(*) AS n_articles FROM classified GROUP BY category",
    "category_metrics": f"""SELECT count(*) AS n_processed, count(*) FILTER (k) AS n_kept,
        count(*) FILTER (NOT k) AS n_skipped FROM (SELECT page_id,
            bool_or({is_in("category", queries.ENABLED)}) AS k FROM classified GROUP BY page_id)""",
    "resolved_titles": "SELECT category, title, en_title FROM resolved_titles",
    "related_pages": "SELECT category, title, en_title FROM related",
    "counterpart_passages": f"""SELECT r.category, r.en_title, a.title || chr(10) || a.text AS text
        FROM related r JOIN (SELECT title, min(text) AS text FROM articles GROUP BY title) a
            ON a.title = r.en_title WHERE length({strip("a.text")}) > 100""",
    "sort_line_errors": "SELECT line_no, input_text, error FROM sorted",
    "sorted_lines": """SELECT line_no, bucket AS parsed_bucket, unparsed, error,
        len(facts)::INTEGER AS n_facts, reworded FROM sorted""",
    "sorted_lines_batch": """SELECT line_no, bucket AS parsed_bucket, unparsed, error,
        len(facts)::INTEGER AS n_facts, reworded FROM sorted""",
    "sorted_facts": """SELECT bucket, line_no, fact_no - 1 AS fact_no, fact, fact AS stored FROM (
            SELECT bucket, line_no, unnest(facts) AS fact, generate_subscripts(facts, 1)::INTEGER AS fact_no
            FROM sorted WHERE len(facts) > 0)
        UNION ALL SELECT bucket, line_no, 0, NULL, CASE WHEN error = 'missing_text' AND input_text = ''
            THEN '  ' ELSE input_text END FROM sorted WHERE len(facts) = 0""",
    "unsorted_lines": "SELECT line_no, bucket AS parsed_bucket FROM sorted WHERE bucket <> 'skip'",
    "sort_bucket_counts": """SELECT bucket, count(*) AS n,
        sum(CASE WHEN bucket = 'skip' THEN 0 ELSE unparsed::INT END)::BIGINT AS n_unparsed
        FROM sorted GROUP BY bucket""",
    "claims_csv": "SELECT id, context, prompt_bn, response_bn FROM claims",
    "claims_json": "SELECT id, context, prompt_bn, response_bn FROM claims",
    "processed_claims": """SELECT id, context, prompt_bn, response_bn,
        context IS NOT NULL AS has_context FROM cleaned""",
    "corpus_jsonl": "SELECT source, text FROM docs WHERE source IN ('wiki', 'idioms')",
    "corpus_malformed": f"""SELECT source, count(*) AS n_lines,
        count(*) FILTER (source = 'literal') AS n_malformed FROM docs
        WHERE source <> 'literal' OR {strip("text")} <> '' GROUP BY source""",
    "first_text_keys": f"""SELECT doc_id, coalesce(CASE WHEN lang IN ('en', 'fr')
        THEN nullif({strip("text")}, '') END, source) AS first_text FROM documents""",
    "bucket_files": """SELECT bucket, bucket AS noted, sum(greatest(len(facts), 1))::BIGINT AS n_lines,
        sum(greatest(len(facts), 1) * line_no)::BIGINT AS line_sum FROM sorted GROUP BY bucket""",
    "category_files": f"""SELECT category, title || chr(10) || text AS text FROM classified
        WHERE {is_in("category", queries.ENABLED)}""",
    "title_lists": f"""SELECT category, {strip("title")} AS title FROM classified
        WHERE {strip("title")} <> ''""",
    "title_lists_capped": f"""SELECT category, title FROM (SELECT category, {strip("title")} AS title,
        row_number() OVER (PARTITION BY category ORDER BY {strip("title")}) AS n FROM classified
        WHERE {strip("title")} <> '') WHERE n <= 10""",
    "index_table": f"""SELECT source, passage_id, sha256(source || chr(31) || text) AS passage_hash,
        {tables.ENCODER.dim} AS dim FROM passages""",
    "score_log": """SELECT case_key, seq, p_fast, p_llm_final, think_reasons AS why FROM log""",
    "latest_run": "SELECT id, label, '20260102_000000' AS run_ts FROM labelled",
}


def statements() -> dict[str, str]:
    out = {name: _prelude(body) for name, body in _PLAIN.items()}
    out["log_compacted"] = out["cache_latest"]
    out["scored_claims_batch"] = out["scored_claims"]
    out["evidence_counts"] = _prelude(
        " UNION ALL ".join(
            counts(f", {lit(kind)} AS kind", column, table, 5)
            for kind, column, table in (
                ("task", "task_type", "filled"),
                ("source", "rag_source", "(SELECT * FROM filled WHERE rag_used)"),
                ("skipped", "rag_skipped_reason", "(SELECT * FROM filled WHERE rag_skipped_reason <> '')"),
            )
        )
    )
    out["classification_report"] = with_report("SELECT label_true, label_pred FROM judged")
    out["document_report"] = with_report(
        f"""SELECT l.quality AS label_true, (len({words("d.text")}) >= 40
        AND NOT regexp_matches(d.text, '[#$%&*!]{{2,}}'))::INT AS label_pred
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
    )
    rules = _PLAIN["nli_rules"]
    out["nli_best_rules"] = _prelude(
        f"""SELECT variant, rule AS best_rule, accuracy, row_number() OVER (ORDER BY accuracy DESC,
            list_position(['answer_only', 'qa_en', 'qa_bn', 'claim_bn'], variant)) = 1 AS is_best
        FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY accuracy DESC, rule_no) AS r
            FROM ({rules})) WHERE r = 1"""
    )
    out["exemplar_hits"] = with_exemplars(
        "SELECT qid, 'exemplars' AS source, passage_id, score, rank FROM eh"
    )
    out["exemplar_hits_cells"] = out["exemplar_hits"]
    out["fast_prompts"] = with_exemplars(
        f"""SELECT f.id, coalesce(s.shots, '') || {case_text()} ||
            {lit(prompts.FAST_CLOSING + prompts.FAST_CUE)} AS fast_prompt
        FROM filled f LEFT JOIN (select qid, string_agg('Ex ' || rank || chr(10) || 'E: ' ||
                coalesce(context, '[NULL]') || chr(10) || 'Q: ' || prompt_bn || chr(10) || 'A: ' ||
                response_bn || chr(10) || 'V: ' || CASE label WHEN 1 THEN 'F' ELSE 'H' END ||
                chr(10) || chr(10), '' ORDER BY rank) AS shots
            from eh join ex on ex.id = eh.passage_id group by qid) s ON s.qid = f.id"""
    )
    known = f"""(SELECT DISTINCT source, text FROM ({_passages_of("(SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))")}))"""
    absent = f"""FROM passages p WHERE NOT EXISTS (SELECT 1 FROM {known} k
        WHERE k.source = p.source AND k.text = p.text)"""
    out["passages_to_encode"] = _prelude(f"SELECT source, passage_id {absent}")
    out["embedded_missing"] = _prelude(
        f"""SELECT source, passage_id, sha256(source || chr(31) || text) AS passage_hash,
        len({words("text")}) AS n_words {absent}"""
    )
    single = queries.SINGLE_QUERY.split()
    out["single_retrieval"] = _prelude(
        f"""SELECT passage_id, text, score FROM (SELECT p.passage_id, p.text,
            round(coalesce(sum(t.c * q.c) FILTER (q.c > 0), 0)::DOUBLE /
                (sqrt(sum(t.c * t.c)::DOUBLE) * sqrt(any_value(qn.n)::DOUBLE)), 6) AS score
        FROM passages p
        JOIN passage_terms t ON t.source = p.source AND t.passage_id = p.passage_id
        LEFT JOIN (SELECT {bucket_of("w")} AS b, count(*) AS c FROM
            (SELECT unnest([{", ".join(lit(w) for w in single)}]) AS w) GROUP BY 1) q ON q.b = t.b,
        (SELECT sum(c * c) AS n FROM (SELECT count(*) AS c FROM
            (SELECT unnest([{", ".join(lit(w) for w in single)}]) AS w) GROUP BY {bucket_of("w")})) qn
        GROUP BY p.passage_id, p.text ORDER BY score DESC, p.passage_id LIMIT 5)
        WHERE score >= 0.3::DOUBLE"""
    )
    return out
