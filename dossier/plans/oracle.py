"""SQL for the registered queries, over the same given tables, written for DuckDB."""

from __future__ import annotations

from dossier.functions.messages import MESSAGES as M
from dossier.functions.values import AGENTS, INTERACTION_WORDS, SAFETY_WORDS, STOP_WORDS, WS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _m(key: str) -> str:
    return "'" + M[key].replace("'", "''") + "'"


def _any(words: tuple[str, ...], text: str = "lower_text") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _lead(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?]){WS}', '\\1' || chr(1), 'g')"
    return f"array_to_string(list_filter(string_split({marked}, chr(1)), lambda x: x <> '')[1:2], ' ')"


_AGENT_LIST = "list_filter([" + ", ".join(f"CASE WHEN (item_id & {1 << i}) = 0 THEN '{a}' END" for i, a in enumerate(AGENTS)) + "], lambda x: x IS NOT NULL)"

DOCS = f"""docs AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id AS doc_number, source, source || '-' || doc_id || '.txt' AS name,
    n_chars::BIGINT AS size_bytes, trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g')) AS text FROM documents)"""
CHUNKS = """offs AS (SELECT *, unnest(range(0, length(text), 1500)) AS off FROM docs),
chunks AS (
  SELECT doc_id || '-' || off AS chunk_id, doc_id, name AS doc_name, off::INTEGER AS char_offset,
    greatest(1, ceil(off / 2600.0))::INTEGER AS page, substring(text, off + 1, 1500) AS text, lower(substring(text, off + 1, 1500)) AS lower_text FROM offs)"""
REQS = f"""reqs AS (
  SELECT item_id, item_id::VARCHAR AS request_id, text AS question, {_AGENT_LIST} AS agents,
    list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains({_list(STOP_WORDS)}, x)) AS tokens FROM benchmark)"""
RD = """rd AS (
  SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY doc_number))::INTEGER AS doc_ordinal, doc_id
  FROM reqs JOIN docs ON source = 'src' || (item_id % 20))"""
SCORED = """scored AS (
  SELECT rd.request_id, doc_ordinal, c.*,
    coalesce(list_sum(list_transform(tokens, lambda t: CASE WHEN contains(lower_text, t) THEN CASE WHEN length(t) > 6 THEN 3 ELSE 2 END ELSE 0 END)), 0)::INTEGER AS score
  FROM rd JOIN chunks c USING (doc_id) JOIN reqs USING (request_id))"""
RANKED = """ranked AS (
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_ordinal, char_offset))::INTEGER AS rank FROM scored)
  WHERE rank <= 10)"""
TO_RANKED = f"WITH {DOCS},\n{CHUNKS},\n{REQS},\n{RD},\n{SCORED},\n{RANKED}"


def briefs(interaction: tuple[str, ...] = INTERACTION_WORDS, safety: tuple[str, ...] = SAFETY_WORDS) -> str:
    """Common tables up to a row per request with all summaries."""

    def on(agent: str, yes: str, no: str) -> str:
        return f"CASE WHEN list_contains(agents, '{agent}') THEN {yes} ELSE {no} END"

    off = _m("disabled.summary")
    return f"""{TO_RANKED},
flags AS (SELECT *, {_any(interaction)} AS is_inter, {_any(safety)} AS is_adv FROM ranked),
per AS (
  SELECT q.request_id, any_value(question) AS question, any_value(agents) AS agents, count(rank) AS n,
    coalesce(count_if(is_inter), 0) AS n_inter, coalesce(count_if(is_adv), 0) AS n_adv,
    max(text) FILTER (rank = 1) AS t1, max(text) FILTER (rank = 2) AS t2, max(doc_name) FILTER (rank = 1) AS name1, max(page) FILTER (rank = 1) AS page1,
    arg_min(text, rank) FILTER (is_inter) AS ti
  FROM reqs q LEFT JOIN flags k USING (request_id) GROUP BY q.request_id),
four AS (
  SELECT *,
    {on(AGENTS[0], _m("literature.summary"), off)} AS lit_summary,
    {on(AGENTS[0], "CASE WHEN n > 0 THEN 'medium' ELSE 'low' END", "'low'")} AS lit_confidence,
    {on(AGENTS[0], "least(n, 5)", "0")}::BIGINT AS n_excerpts,
    {on(AGENTS[1], f"CASE WHEN n_inter > 0 THEN {_m('interaction.summary.match')} ELSE {_m('interaction.summary.none')} END", off)} AS inter_summary,
    {on(AGENTS[1], "CASE WHEN n_inter > 1 THEN 'medium' ELSE 'low' END", "'low'")} AS inter_confidence,
    {on(AGENTS[2], f"CASE WHEN n_adv > 0 THEN {_m('adverse.summary.match')} ELSE {_m('adverse.summary.none')} END", off)} AS adv_summary,
    {on(AGENTS[2], "CASE WHEN n_adv > 1 THEN 'medium' ELSE 'low' END", "'low'")} AS adv_confidence,
    {on(AGENTS[3], _m("trial.summary"), off)} AS trial_summary,
    {on(AGENTS[3], "CASE WHEN n > 2 THEN 'medium' ELSE 'low' END", "'low'")} AS trial_confidence
  FROM per),
cons AS (
  SELECT *,
    {on(AGENTS[4], _m("consensus.summary"), off)} AS cons_summary,
    {on(AGENTS[4], f"trial_summary || ' ' || adv_summary || {_m('consensus.conclusion')}", _m("consensus.disabled.conclusion"))} AS conclusion,
    {on(AGENTS[4], "'medium'", "'low'")} AS cons_confidence,
    {on(AGENTS[4], f"[{_m('consensus.missing.tables')}, {_m('consensus.missing.context')}]", f"[{_m('consensus.disabled.missing')}]")} AS missing
  FROM four)"""


_ON = lambda k: f"list_contains(agents, '{AGENTS[k]}')"
BRIEFS = briefs()


def markdown(lit: str = "lit_summary", inter: str = "inter_summary", adv: str = "adv_summary", conclusion: str = "conclusion", missing: str = "missing") -> str:
    made = (
        f"{_m('report.title')} || chr(10) || chr(10) || '## Executive Summary' || chr(10) || {conclusion} || chr(10) || chr(10) || '## Key Findings' || chr(10) || "
        f"array_to_string(list_transform([{lit}, {inter}, {adv}, {conclusion}], lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || "
        f"'## Clinical Briefing' || chr(10) || trial_summary || chr(10) || chr(10) || '## Plain Summary' || chr(10) || {adv} || chr(10) || chr(10) || "
        f"'## Risks and Uncertainties' || chr(10) || array_to_string(list_transform({missing}, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || "
        f"'## Disclaimer' || chr(10) || {_m('disclaimer')}"
    )
    return f"CASE WHEN {_ON(5)} THEN {made} ELSE {_m('report.title')} || chr(10) || chr(10) || {_m('disclaimer')} END"


MARKDOWN = markdown()

# With a model's responses to some analyses, as tables.responses() has them.
MERGED = f"""{BRIEFS},
mi AS (SELECT *, request_id::BIGINT AS i FROM cons),
ma AS (
  SELECT *,
    CASE WHEN {_ON(0)} AND i % 4 = 0 THEN 'Model''s passages for ' || request_id WHEN {_ON(0)} AND i % 4 = 1 THEN 'Newer passages for ' || request_id ELSE lit_summary END AS m_lit,
    CASE WHEN {_ON(0)} AND i % 4 = 0 THEN 'high' WHEN {_ON(0)} AND i % 4 = 1 THEN 'medium' ELSE lit_confidence END AS m_lit_confidence,
    CASE WHEN {_ON(0)} AND i % 4 = 0 THEN 0 WHEN {_ON(0)} AND i % 4 = 1 THEN 1 ELSE n_excerpts END AS m_excerpts,
    CASE WHEN {_ON(0)} AND i % 4 > 1 THEN least(n, 4) ELSE 0 END AS m_evidence,
    CASE WHEN {_ON(0)} AND i % 4 < 2 THEN 0 ELSE 1 END AS m_limitations,
    CASE WHEN NOT {_ON(0)} OR i % 4 = 0 THEN NULL WHEN i % 4 = 1 THEN 'Quoted for ' || request_id ELSE substring(t1, 1, 280) END AS m_excerpt,
    CASE WHEN NOT {_ON(0)} OR i % 4 = 0 THEN NULL WHEN i % 4 = 1 THEN 'report.pdf' ELSE name1 END AS m_document,
    CASE WHEN NOT {_ON(0)} OR i % 4 = 0 THEN NULL WHEN i % 4 = 1 THEN 7 ELSE page1 END::INTEGER AS m_page,
    CASE WHEN {_ON(1)} AND i % 3 = 1 THEN 'Model''s interactions for ' || request_id ELSE inter_summary END AS m_inter,
    CASE WHEN {_ON(1)} AND i % 3 = 1 THEN NULL ELSE inter_confidence END AS m_inter_confidence,
    CASE WHEN {_ON(1)} THEN CASE WHEN i % 3 = 1 OR n_inter > 0 THEN 'moderate' ELSE 'unclear' END END AS m_severity,
    CASE WHEN {_ON(1)} THEN CASE WHEN i % 3 = 1 THEN 'Named by a model' WHEN n_inter > 0 THEN {_m("interaction.finding.match")} ELSE {_m("interaction.finding.none")} END END AS m_finding,
    CASE WHEN {_ON(2)} AND i % 3 = 0 THEN 'Model''s safety notes for ' || request_id ELSE adv_summary END AS m_adv,
    CASE WHEN {_ON(2)} AND i % 3 = 0 THEN 'high' ELSE adv_confidence END AS m_adv_confidence
  FROM mi),
mc AS (
  SELECT *, {_ON(4)} AND i % 6 = 5 AS m_external,
    CASE WHEN NOT {_ON(4)} THEN conclusion WHEN i % 6 = 5 THEN 'Model''s conclusion for ' || request_id ELSE trial_summary || ' ' || m_adv || {_m("consensus.conclusion")} END AS m_conclusion,
    CASE WHEN {_ON(4)} AND i % 6 = 5 THEN ['first gap', 'second gap'] ELSE missing END AS m_missing
  FROM ma)"""
MERGED_MARKDOWN = markdown("m_lit", "m_inter", "m_adv", "m_conclusion", "m_missing")


def interaction_findings(words: tuple[str, ...]) -> str:
    return f"""{briefs(interaction=words)}
SELECT request_id,
  CASE WHEN n_inter > 0 THEN {_m("interaction.finding.match")} ELSE {_m("interaction.finding.none")} END AS interaction,
  CASE WHEN n_inter > 0 THEN 'moderate' ELSE 'unclear' END AS severity, CASE WHEN n_inter > 0 THEN 'medium' ELSE 'high' END AS uncertainty,
  CASE WHEN n_inter > 0 THEN {_lead("ti")} ELSE {_m("interaction.notes.none")} END AS notes,
  CASE WHEN n_inter > 0 THEN substring(ti, 1, 240) ELSE {_m("interaction.evidence.none")} END AS evidence
FROM cons WHERE {_ON(1)}"""


def adverse_findings(words: tuple[str, ...]) -> str:
    return f"""{briefs(safety=words)},
m AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY rank))::INTEGER AS item FROM flags WHERE is_adv)
SELECT request_id, item, {_m("adverse.event")} AS event, {_lead("m.text")} AS source_evidence, 'medium' AS confidence
FROM m JOIN cons USING (request_id) WHERE item <= 3 AND {_ON(2)}"""


def screen(prefix: str, flag: str, count: str, k: int) -> str:
    """Evidence of a screen: the first four matched chunks, or of all if none matched."""
    return f"""{BRIEFS},
e AS (
  SELECT f.request_id, (row_number() OVER (PARTITION BY f.request_id ORDER BY rank))::INTEGER AS item, doc_name, page, substring(text, 1, 220) AS excerpt
  FROM flags f JOIN cons USING (request_id) WHERE {_ON(k)} AND ({flag} OR {count} = 0))
SELECT c.request_id, {prefix}_summary AS summary, {prefix}_confidence AS confidence, item, doc_name AS document_name, excerpt
FROM cons c LEFT JOIN (SELECT * FROM e WHERE item <= 4) e USING (request_id)"""


_SAVES = f"""s AS (
  SELECT event_id, user_id::VARCHAR AS id, 'Events of user ' || user_id AS question, event_type AS status,
    CASE WHEN user_id % 2 = 0 THEN 'authenticated' ELSE 'demo' END AS mode,
    CASE WHEN user_id % 3 <> 0 THEN {_list(AGENTS)}[1:(user_id % 6 + 1)::INTEGER] END AS selected_agents,
    CASE WHEN user_id % 4 <> 0 THEN event_id % 5 + 1 ELSE 0 END::BIGINT AS n_documents,
    CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k')::INTEGER END AS k,
    event_id % 10 <> 0 AS has_results, ts AS updated_at, min(ts) OVER (PARTITION BY user_id) AS created_at
  FROM events)"""
_LATEST = f"WITH {_SAVES}, u AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, event_id DESC) AS n FROM s) WHERE n = 1)"
_AGENT_COUNT = "coalesce(len(selected_agents), 0)::BIGINT"
_BRACKETS = "'[^a-z0-9]+'"

_UPLOADS = f"""WITH {DOCS},
{CHUNKS},
{REQS.replace("reqs AS (", "items AS (", 1)},
sent AS (SELECT 'u' || (doc_number // 8) AS request_id, doc_number // 8 AS g, doc_number % 5 <> 4 AS whole,
  (row_number() OVER (PARTITION BY doc_number // 8 ORDER BY doc_number))::INTEGER AS doc_ordinal, docs.* FROM docs),
reqs AS (SELECT DISTINCT sent.request_id, g, g % 10 = 9 AS bad, question, tokens FROM sent JOIN items ON item_id = g % 40),
rd AS (SELECT sent.request_id, doc_ordinal, doc_id FROM sent WHERE g % 10 <> 9 AND whole),
{SCORED},
{RANKED}"""

ORACLE_SQL = {
    "uploaded_requests": f"""{_UPLOADS} SELECT request_id, CASE WHEN NOT bad THEN reqs.question END AS question, CASE WHEN bad THEN 0 ELSE (SELECT count(*) FROM sent s WHERE s.request_id = reqs.request_id) END::BIGINT AS n_documents,
      NOT bad AND trim(reqs.question) <> '' AS valid, CASE WHEN bad THEN {_m('request.error.body')} WHEN trim(reqs.question) = '' THEN {_m('request.error')} END AS error FROM reqs""",
    "uploaded_documents": f"""{_UPLOADS} SELECT doc_id, name, size_bytes, greatest(1, ceil(length(text) / 2600.0))::INTEGER AS page_count, TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at,
      substring(text, 1, 280) AS preview, length(text)::BIGINT AS n_chars FROM sent WHERE g % 10 <> 9 AND whole""",
    "top_chunks_uploaded": f"{_UPLOADS} SELECT request_id, rank, chunk_id, doc_name, doc_ordinal, page, score FROM ranked",
    "quarantined_documents": f"""WITH r AS (SELECT doc_id AS n, CASE WHEN doc_id % 19 <> 7 THEN doc_id::VARCHAR END AS doc_id, source || '-' || doc_id || '.txt' AS name, text FROM documents
      UNION ALL SELECT doc_id, doc_id::VARCHAR, source || '-' || doc_id || '.txt', CASE WHEN doc_id % 23 = 3 THEN text || '!' ELSE text END FROM documents WHERE doc_id % 23 = 3 OR doc_id % 29 = 5)
      SELECT coalesce(doc_id, name) AS row, length(text)::BIGINT AS n_chars,
      CASE WHEN doc_id IS NULL THEN {_m('document.error.id')} WHEN count(DISTINCT coalesce(text, '')) OVER (PARTITION BY doc_id) > 1 THEN {_m('document.error.texts')} END AS error FROM r""",
    "ingest_documents": f"WITH {DOCS} SELECT doc_id, name, size_bytes, greatest(1, ceil(length(text) / 2600.0))::INTEGER AS page_count, substring(text, 1, 280) AS preview, length(text)::BIGINT AS n_chars FROM docs",
    "sanitize_text": f"WITH {DOCS} SELECT doc_id, text FROM docs",
    "document_preview": f"WITH {DOCS} SELECT doc_id, substring(text, 1, 280) AS preview FROM docs",
    "estimate_page_count": f"WITH {DOCS} SELECT doc_id, greatest(1, ceil(length(text) / 2600.0))::INTEGER AS page_count FROM docs",
    "pick_sentences": f"WITH {DOCS} SELECT doc_id, {_lead('text')} AS lead FROM docs",
    "chunk_documents": f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, doc_id, doc_name, char_offset, page, text FROM chunks",
    "stored_chunks": f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, doc_id, doc_name, char_offset, page, text FROM chunks",
    "top_chunks_stored": f"{TO_RANKED} SELECT request_id, rank, chunk_id, doc_ordinal, page, score FROM ranked",
    "chunk_page_estimate": f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, char_offset, page FROM chunks",
    "chunk_excerpts": f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, substring(text, 1, 220) AS evidence, substring(text, 1, 240) AS coverage, substring(text, 1, 280) AS literature FROM chunks",
    "request_intake": f"WITH {DOCS}, {REQS}, {RD} SELECT request_id, question, len(agents)::BIGINT AS n_agents, doc_ordinal, doc_id FROM reqs LEFT JOIN rd USING (request_id)",
    "tokenize_question": f"WITH {REQS} SELECT request_id, generate_subscripts(tokens, 1)::INTEGER AS position, unnest(tokens) AS token FROM reqs",
    "token_weight": f"WITH {REQS}, t AS (SELECT request_id, generate_subscripts(tokens, 1)::INTEGER AS position, unnest(tokens) AS token FROM reqs) SELECT *, CASE WHEN length(token) > 6 THEN 3 ELSE 2 END AS weight FROM t",
    "validate_requests": f"WITH {DOCS}, {REQS}, {RD}, n AS (SELECT request_id, count(*) AS n FROM rd GROUP BY 1) SELECT request_id, coalesce(n, 0)::BIGINT AS n_documents, trim(question) <> '' AND coalesce(n, 0) > 0 AS valid, CASE WHEN trim(question) = '' OR coalesce(n, 0) = 0 THEN {_m('request.error')} END AS error FROM reqs LEFT JOIN n USING (request_id)",
    "validate_requests_strict": f"WITH q AS (SELECT conv_id || '-' || turn AS request_id, coalesce(text, '') AS question FROM conversations WHERE role = 'user'), v AS (SELECT request_id, length(regexp_replace(regexp_replace(question, '^{WS}', ''), '{WS}$', '')) > 6 AS valid FROM q) SELECT request_id, valid, CASE WHEN NOT valid THEN {_m('request.error')} END AS error FROM v",
    "remove_documents": f"WITH {DOCS}, {REQS}, {RD} SELECT * FROM rd WHERE doc_id::BIGINT % 3 <> 0",
    "append_documents": f"WITH {DOCS}, {REQS}, {RD}, a AS (SELECT request_id, doc_ordinal AS o, doc_id FROM rd WHERE doc_id::BIGINT % 5 = 0), n AS (SELECT request_id, max(doc_ordinal) AS n FROM rd GROUP BY 1) SELECT * FROM rd UNION ALL SELECT request_id, (n + row_number() OVER (PARTITION BY request_id ORDER BY o))::INTEGER, doc_id FROM a JOIN n USING (request_id)",
    "keyword_score": f"{TO_RANKED} SELECT request_id, chunk_id, score FROM scored",
    "keyword_score_postings": f"{TO_RANKED} SELECT request_id, chunk_id, score FROM scored WHERE score > 0",
    "top_chunks": f"{TO_RANKED} SELECT request_id, rank, chunk_id, doc_ordinal, page, score FROM ranked",
    "top_chunks_single": f"{TO_RANKED} SELECT chunk_id, score FROM ranked WHERE request_id = (SELECT min(request_id) FROM reqs)",
    "coverage_summary": f"{TO_RANKED} SELECT request_id, rank, doc_name, page, substring(text, 1, 240) AS excerpt FROM ranked",
    "evidence_items": f"{TO_RANKED} SELECT request_id, rank, substring(text, 1, 220) AS excerpt, doc_name AS document_name, page, 'Page ' || page AS section, {_m('evidence.relevance')} AS relevance FROM ranked WHERE rank <= 4",
    "interaction_signal_chunks": f"{BRIEFS} SELECT request_id, rank, chunk_id FROM flags WHERE is_inter",
    "adverse_signal_chunks": f"{BRIEFS} SELECT request_id, rank, chunk_id FROM flags WHERE is_adv",
    "signal_support": f"{BRIEFS} SELECT request_id, n::BIGINT AS n_chunks, n_inter::BIGINT AS n_interaction, n_adv::BIGINT AS n_adverse FROM per",
    "agent_confidence": f"{BRIEFS} SELECT request_id, lit_confidence AS literature, inter_confidence AS interaction, adv_confidence AS adverse, trial_confidence AS trial, cons_confidence AS consensus, CASE WHEN {_ON(5)} THEN 'medium' ELSE 'low' END AS report FROM cons",
    "gate_agents": f"{BRIEFS} SELECT request_id, lit_summary AS literature, inter_summary AS interaction, adv_summary AS adverse, trial_summary AS trial, cons_summary AS consensus, CASE WHEN {_ON(5)} THEN {_m('report.summary')} ELSE {_m('disabled.summary')} END AS report FROM cons",
    "literature_search": f"{BRIEFS} SELECT request_id, lit_summary AS summary, lit_confidence AS confidence, CASE WHEN {_ON(0)} THEN least(n, 4) ELSE 0 END::BIGINT AS n_evidence, n_excerpts, CASE WHEN {_ON(0)} THEN {_m('literature.limitation')} ELSE {_m('disabled.limitation')} END AS limitation, {_m('disclaimer')} AS warning FROM cons",
    "literature_excerpts": f"{BRIEFS} SELECT request_id, rank AS item, substring(text, 1, 280) AS excerpt, doc_name AS document_name, page, 'Page ' || page AS section, {_m('literature.reason')} || question AS reason FROM ranked JOIN cons USING (request_id) WHERE rank <= 5 AND {_ON(0)}",
    "interaction_screen": screen("inter", "is_inter", "n_inter", 1),
    "interaction_findings": interaction_findings(INTERACTION_WORDS),
    "interaction_findings_custom": interaction_findings(("tion", "licens", "naus")),
    "adverse_screen": screen("adv", "is_adv", "n_adv", 2),
    "adverse_findings": adverse_findings(SAFETY_WORDS),
    "adverse_findings_custom": adverse_findings(("tion", "licens", "naus")),
    "trial_summary": f"""{BRIEFS} SELECT request_id, trial_summary AS summary, trial_confidence AS confidence,
      CASE WHEN {_ON(3)} THEN {_lead(f"coalesce(t1, {_m('trial.methods.none')})")} END AS methods,
      CASE WHEN {_ON(3)} THEN {_lead(f"coalesce(t2, t1, {_m('trial.findings.none')})")} END AS key_findings,
      CASE WHEN {_ON(3)} THEN {_m('trial.relevance')} || question END AS relevance FROM cons""",
    "consensus": f"""{BRIEFS} SELECT request_id, cons_confidence AS confidence, conclusion, array_to_string(missing, '; ') AS missing_evidence,
      CASE WHEN {_ON(4)} THEN {_m('consensus.agreement.question')} || question || '; ' || CASE WHEN n_excerpts > 0 THEN {_m('consensus.agreement.some')} ELSE {_m('consensus.agreement.sparse')} END ELSE '' END AS agreements,
      CASE WHEN {_ON(4)} THEN CASE WHEN n_inter > 0 AND {_ON(1)} THEN {_m('consensus.disagreement.moderate')} ELSE {_m('consensus.disagreement.none')} END ELSE '' END AS disagreements,
      CASE WHEN {_ON(4)} AND {_ON(0)} THEN least(n, 3) ELSE 0 END::BIGINT AS n_evidence FROM cons""",
    "report": f"""{BRIEFS} SELECT request_id, CASE WHEN {_ON(5)} THEN conclusion ELSE {_m('report.disabled.executive')} END AS executive_summary,
      CASE WHEN {_ON(5)} THEN array_to_string([lit_summary, inter_summary, adv_summary, conclusion], '; ') ELSE '' END AS key_findings,
      CASE WHEN {_ON(5)} THEN array_to_string(missing, '; ') ELSE {_m('report.disabled.risk')} END AS risks,
      CASE WHEN {_ON(5)} THEN {_m('report.question')} || question || '?; ' || {_m('report.follow_up')} ELSE {_m('report.disabled.follow_up')} END AS follow_up_questions,
      CASE WHEN {_ON(5)} THEN trial_summary || ' ' || inter_summary ELSE {_m('report.disabled.text')} END AS clinical_briefing,
      CASE WHEN {_ON(5)} THEN {_m('report.lay')} ELSE {_m('report.disabled.text')} END AS lay_summary,
      CASE WHEN {_ON(5)} AND {_ON(0)} THEN least(n, 4) ELSE 0 END::BIGINT AS n_evidence FROM cons""",
    "report_evidence_table": f"""{BRIEFS} SELECT request_id, {_m('report.topic')} AS topic,
      CASE WHEN n_excerpts > 0 THEN substring(t1, 1, 280) ELSE {_m('report.finding.none')} END AS finding,
      CASE WHEN n_excerpts > 0 THEN name1 || ' p.' || coalesce(page1::VARCHAR, 'n/a') ELSE {_m('report.source.none')} END AS source,
      lit_confidence AS confidence FROM cons WHERE {_ON(5)}""",
    "report_markdown": f"{BRIEFS} SELECT request_id, {MARKDOWN} AS markdown FROM cons",
    "report_files_round_trip": f"{BRIEFS} SELECT request_id, {MARKDOWN} AS markdown FROM cons",
    "session_document_parts": f"""WITH {DOCS}, {REQS}, {RD} SELECT request_id AS id, ((doc_ordinal - 1) // 20)::BIGINT AS part, count(*) AS n_documents, arg_min(name, doc_ordinal) AS first_document,
      arg_max(name, doc_ordinal) AS last_document, arg_max(substring(text, 1, 280), doc_ordinal) AS last_preview FROM rd JOIN docs USING (doc_id) GROUP BY 1, 2""",
    "citation_table": f"{BRIEFS} SELECT request_id, rank AS item, doc_name AS source, {_m('evidence.relevance')} AS relevance, 'Page ' || page AS location, substring(text, 1, 220) AS excerpt FROM ranked JOIN cons USING (request_id) WHERE rank <= 4 AND {_ON(0)}",
    "analysis_bundle": f"{BRIEFS} SELECT request_id, lit_confidence AS literature, n_excerpts, inter_summary AS interaction, adv_summary AS adverse, trial_summary AS trial, conclusion, {MARKDOWN} AS markdown FROM cons",
    "prompt_payloads": f"""{BRIEFS}, p AS (
      SELECT request_id, question, unnest(agents) AS agent_id, n, n_inter, n_adv FROM cons)
      SELECT request_id, agent_id, {_m('prompt.common')} || ' ' || CASE agent_id {" ".join(f"WHEN '{a}' THEN {_m(f'prompt.{a}')}" for a in AGENTS)} END AS system, question,
      CASE agent_id WHEN '{AGENTS[0]}' THEN least(n, 6) WHEN '{AGENTS[3]}' THEN least(n, 6) WHEN '{AGENTS[1]}' THEN least(n_inter, 6) WHEN '{AGENTS[2]}' THEN least(n_adv, 6) END::INTEGER AS n_chunks FROM p""",
    "merge_responses": f"""{BRIEFS} SELECT request_id,
      item_id % 5 IN (0, 1) AS external,
      CASE item_id % 5 WHEN 0 THEN 'External summary ' || request_id WHEN 1 THEN NULL ELSE lit_summary END AS summary,
      CASE item_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE lit_confidence END AS confidence,
      CASE WHEN item_id % 5 IN (0, 1) THEN 0 ELSE 1 END::BIGINT AS n_limitations
      FROM cons JOIN reqs USING (request_id)""",
    "session_row_mapping": f"WITH {_SAVES} SELECT event_id, id, question, status, mode, {_AGENT_COUNT} AS n_agents, n_documents, k, created_at, updated_at FROM s",
    "session_upsert": f"{_LATEST} SELECT id, question, status, mode, k, created_at, updated_at FROM u",
    "session_lookup": f"{_LATEST} SELECT id, status, has_results AS results_available FROM u",
    "recent_sessions": f"{_LATEST} SELECT id, status, created_at FROM u ORDER BY created_at DESC, id LIMIT 20",
    "session_mru": f"{_LATEST} SELECT id, status, updated_at AS saved_at FROM u ORDER BY updated_at DESC, id LIMIT 25",
    "session_cards": f"{_LATEST} SELECT id, mode, status, question, n_documents, {_AGENT_COUNT} AS n_agents, updated_at FROM u",
    "dashboard_stats": f"{_LATEST} SELECT count(*) AS n_sessions, coalesce(sum(n_documents), 0)::BIGINT AS n_documents FROM u",
    "session_store_upsert": f"{_LATEST} SELECT id, question, status, mode, k, created_at, updated_at FROM u",
    "session_store_lookup": f"{_LATEST} SELECT id, status, has_results AS results_available FROM u",
    "session_store_recent": f"{_LATEST} SELECT id, status, created_at FROM u ORDER BY created_at DESC, id LIMIT 20",
    "session_store_mru": f"{_LATEST} SELECT id, status, updated_at AS saved_at FROM u ORDER BY updated_at DESC, id LIMIT 25",
    "session_store_stats": f"{_LATEST} SELECT count(*) AS n_sessions, coalesce(sum(n_documents), 0)::BIGINT AS n_documents FROM u",
    "assemble_sessions": f"""{BRIEFS}, d AS (SELECT request_id, string_agg(doc_id, ',' ORDER BY doc_ordinal) AS documents FROM rd GROUP BY 1)
      SELECT request_id AS id, question, 'completed' AS status, 'demo' AS mode, len(agents)::BIGINT AS n_agents, coalesce(documents, '') AS documents, conclusion, TIMESTAMP '2024-01-01 00:00:00' AS created_at
      FROM cons LEFT JOIN d USING (request_id)""",
    "top_chunks_postings": f"{TO_RANKED} SELECT request_id, rank, chunk_id, doc_ordinal, page, score FROM ranked",
    "top_chunks_pruned": f"{TO_RANKED} SELECT request_id, rank, chunk_id, doc_ordinal, page, score FROM ranked",
    "interaction_signal_chunks_custom": f"{briefs(interaction=('tion', 'licens', 'naus'))} SELECT request_id, rank, chunk_id FROM flags WHERE is_inter",
    "adverse_signal_chunks_custom": f"{briefs(safety=('tion', 'licens', 'naus'))} SELECT request_id, rank, chunk_id FROM flags WHERE is_adv",
    "prompt_chunks": f"""{BRIEFS}, p AS (
      SELECT request_id, a.agent_id, rank, chunk_id, doc_name, page, score, text
      FROM flags CROSS JOIN (VALUES ('{AGENTS[0]}'), ('{AGENTS[1]}'), ('{AGENTS[2]}'), ('{AGENTS[3]}')) a(agent_id)
      WHERE agent_id IN ('{AGENTS[0]}', '{AGENTS[3]}') OR (agent_id = '{AGENTS[1]}' AND is_inter) OR (agent_id = '{AGENTS[2]}' AND is_adv)), o AS (
      SELECT *, (row_number() OVER (PARTITION BY request_id, agent_id ORDER BY rank))::INTEGER AS item FROM p)
      SELECT request_id, agent_id, item, chunk_id AS id, doc_name AS document_name, page, score, text FROM o JOIN cons USING (request_id)
      WHERE item <= 6 AND list_contains(agents, agent_id)""",
    "prompt_upstream": f"""{MERGED}, v AS (
      SELECT *, unnest(['{AGENTS[4]}', '{AGENTS[5]}']) AS agent_id FROM mc), w AS (SELECT * FROM v WHERE list_contains(agents, agent_id))
      SELECT request_id, agent_id, f.field, f.value FROM (
        SELECT request_id, agent_id, unnest([
          {{'field': 'literature.summary', 'value': m_lit}}, {{'field': 'literature.confidence', 'value': m_lit_confidence}}, {{'field': 'drug.summary', 'value': m_inter}},
          {{'field': 'drug.findings[0].severityEstimate', 'value': m_severity}}, {{'field': 'adverse.summary', 'value': m_adv}}, {{'field': 'trial.summary', 'value': trial_summary}},
          {{'field': 'trial.findings[0].keyFindings', 'value': CASE WHEN {_ON(3)} THEN {_lead(f"coalesce(t2, t1, {_m('trial.findings.none')})")} END}},
          {{'field': 'debate.finalConsensus', 'value': CASE WHEN agent_id = '{AGENTS[5]}' THEN m_conclusion END}},
          {{'field': 'debate.missingEvidence[0]', 'value': CASE WHEN agent_id = '{AGENTS[5]}' THEN m_missing[1] END}}]) AS f FROM w)""",
    "merged_analyses": f"""{MERGED} SELECT request_id, m_lit AS literature, m_inter AS interaction, m_adv AS adverse, trial_summary AS trial,
      m_lit_confidence AS literature_confidence, m_inter_confidence AS interaction_confidence, m_adv_confidence AS adverse_confidence, trial_confidence,
      m_evidence::BIGINT AS n_evidence, m_limitations::BIGINT AS n_limitations, m_excerpt AS first_excerpt, m_document AS first_document, m_page AS first_page, m_finding AS finding FROM mc""",
    "merged_consensus": f"""{MERGED} SELECT request_id, CASE WHEN NOT m_external THEN cons_confidence END AS confidence, m_conclusion AS conclusion, array_to_string(m_missing, '; ') AS missing_evidence,
      CASE WHEN {_ON(4)} AND NOT m_external THEN {_m('consensus.agreement.question')} || question || '; ' || CASE WHEN m_excerpts > 0 THEN {_m('consensus.agreement.some')} ELSE {_m('consensus.agreement.sparse')} END ELSE '' END AS agreements,
      CASE WHEN {_ON(4)} AND NOT m_external THEN CASE WHEN m_severity = 'moderate' THEN {_m('consensus.disagreement.moderate')} ELSE {_m('consensus.disagreement.none')} END ELSE '' END AS disagreements,
      CASE WHEN {_ON(4)} AND NOT m_external THEN least(m_evidence, 3) ELSE 0 END::BIGINT AS n_evidence FROM mc""",
    "merged_report": f"""{MERGED} SELECT request_id, CASE WHEN {_ON(5)} THEN m_conclusion ELSE {_m('report.disabled.executive')} END AS executive_summary,
      CASE WHEN {_ON(5)} THEN array_to_string([m_lit, m_inter, m_adv, m_conclusion], '; ') ELSE '' END AS key_findings,
      CASE WHEN {_ON(5)} THEN array_to_string(m_missing, '; ') ELSE {_m('report.disabled.risk')} END AS risks,
      CASE WHEN {_ON(5)} THEN {_m('report.question')} || question || '?; ' || {_m('report.follow_up')} ELSE {_m('report.disabled.follow_up')} END AS follow_up_questions,
      CASE WHEN {_ON(5)} THEN trial_summary || ' ' || m_inter ELSE {_m('report.disabled.text')} END AS clinical_briefing,
      CASE WHEN {_ON(5)} THEN {_m('report.lay')} ELSE {_m('report.disabled.text')} END AS lay_summary,
      CASE WHEN {_ON(5)} THEN m_evidence ELSE 0 END::BIGINT AS n_evidence, {MERGED_MARKDOWN} AS markdown,
      CASE WHEN {_ON(5)} THEN CASE WHEN m_excerpts > 0 THEN m_excerpt ELSE {_m('report.finding.none')} END END AS finding,
      CASE WHEN {_ON(5)} THEN CASE WHEN m_excerpts > 0 THEN m_document || ' p.' || coalesce(m_page::VARCHAR, 'n/a') ELSE {_m('report.source.none')} END END AS source,
      CASE WHEN {_ON(5)} THEN m_lit_confidence END AS confidence FROM mc""",
    "session_round_trip": f"""{MERGED}, d AS (
        SELECT request_id, count(*) AS n_documents, arg_max(name, doc_ordinal) AS last_document, arg_max(substring(text, 1, 280), doc_ordinal) AS last_preview, sum(size_bytes)::BIGINT AS n_bytes
        FROM rd JOIN docs USING (doc_id) GROUP BY 1)
      SELECT request_id AS id, CASE WHEN i % 2 = 0 THEN 'draft' ELSE 'completed' END AS status, coalesce(n_documents, 0) AS n_documents, last_document, last_preview, coalesce(n_bytes, 0) AS n_bytes,
        m_lit AS literature, m_inter AS interaction, m_adv AS adverse, trial_summary AS trial, m_conclusion AS conclusion, {MERGED_MARKDOWN} AS markdown,
        CASE WHEN i % 2 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
      FROM mc LEFT JOIN d USING (request_id)""",
}
