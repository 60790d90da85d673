"""The registered queries: every operator over the given tables, flat rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import excerpt, lead_sentences, sanitize
from dossier.operators import analyses, responses, retrieval, sessions
from dossier.plans.oracle import ORACLE_SQL
from dossier.sources import chunk_store, documents, report_files, session_store, storage, tables
from dossier.sources import requests as intake
from dossier.sources.shared import cut, shared_path

__all__ = ["ORACLE_SQL", "QUERIES"]

CUSTOM_WORDS = ("tion", "licens", "naus")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score_chunks(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), tables.chunks(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_chunks(_scored(spark, sf_dir), chunks=tables.chunks_of(spark, sf_dir))


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_chunks(tables.requests(spark, sf_dir), _ranked(spark, sf_dir))


def _analysed(spark: SparkSession, sf_dir: str, **words) -> DataFrame:
    return analyses.with_analyses(_briefs(spark, sf_dir), **words)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses with a model's responses to some of them."""
    return analyses.with_analyses(responses.with_responses(_briefs(spark, sf_dir), tables.responses(spark, sf_dir)))


def _items(df: DataFrame, column: str, *fields: str, **renamed: str) -> DataFrame:
    """An array column of structs as rows, numbered from 1. renamed: columns and the fields that they have."""
    each = df.select("request_id", F.posexplode(column).alias("pos", "e"))
    return each.select("request_id", (F.col("pos") + 1).alias("item"), *(F.col(f"e.{f}").alias(c) for c, f in {**dict(zip(fields, fields)), **renamed}.items()))


def ingest_documents(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", "name", "size_bytes", "page_count", "preview", F.char_length("text").cast("long").alias("n_chars"))


def sanitize_text(spark, sf_dir):
    return tables.raw_documents(spark, sf_dir).select("doc_id", sanitize(F.col("text")).alias("text"))


def document_preview(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", "preview")


def estimate_page_count(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", "page_count")


def pick_sentences(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", lead_sentences(F.col("text")).alias("lead"))


def chunk_documents(spark, sf_dir):
    return tables.chunks(spark, sf_dir).drop("lower_text")


def _stored(spark, sf_dir):
    """A store made from texts of which some were others then, and refreshed with the texts as they are."""
    docs, n = tables.documents(spark, sf_dir), F.col("doc_id").cast("long")
    then = docs.filter(n % 11 != 3).withColumn("text", F.when(n % 7 == 2, F.concat("text", F.lit(" draft"))).otherwise(F.col("text")))
    return chunk_store.refresh(docs, chunk_store.save_chunks(then, shared_path(spark, "chunk-store"), buckets=8))


def stored_chunks(spark, sf_dir):
    return chunk_store.stored_chunks(spark, _stored(spark, sf_dir)).drop("lower_text")


def top_chunks_stored(spark, sf_dir):
    chunks = chunk_store.stored_chunks(spark, _stored(spark, sf_dir))
    scored = retrieval.score_chunks(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), chunks)
    return retrieval.top_chunks(scored, chunks=chunks).select("request_id", "rank", "chunk_id", "doc_ordinal", "page", "score")


def chunk_page_estimate(spark, sf_dir):
    return tables.chunks(spark, sf_dir).select("chunk_id", "char_offset", "page")


def chunk_excerpts(spark, sf_dir):
    lengths = {"evidence": 220, "coverage": 240, "literature": 280}
    return tables.chunks(spark, sf_dir).select("chunk_id", *(excerpt(F.col("text"), n).alias(name) for name, n in lengths.items()))


def request_intake(spark, sf_dir):
    requests, named = intake.request_intake(tables.request_bodies(spark, sf_dir))
    counted = requests.select("request_id", "question", F.size("selected_agents").cast("long").alias("n_agents"))
    return counted.join(named, "request_id", "left")


def uploaded_requests(spark, sf_dir):
    """Requests as bodies with whole documents have them, checked."""
    checked = intake.validate_requests(*intake.request_intake(tables.upload_bodies(spark, sf_dir)))
    return checked.select("request_id", "question", "n_documents", "valid", "error")


def _uploads(spark, sf_dir):
    sent = intake.uploaded_documents(tables.upload_bodies(spark, sf_dir))
    return documents.ingest_documents(sent.filter("error is null").drop("error"))


def uploaded_documents(spark, sf_dir):
    return _uploads(spark, sf_dir).select("doc_id", "name", "size_bytes", "page_count", "uploaded_at", "preview", F.char_length("text").cast("long").alias("n_chars"))


def top_chunks_uploaded(spark, sf_dir):
    """The best chunks of each request, from bodies alone."""
    requests, named = intake.request_intake(tables.upload_bodies(spark, sf_dir))
    sent = cut(_uploads(spark, sf_dir), "uploads")
    chunks = documents.chunk_documents(sent)
    ranked = retrieval.top_chunks(retrieval.score_chunks(requests, named, chunks), chunks=chunks)
    return ranked.select("request_id", "rank", "chunk_id", "doc_name", "doc_ordinal", "page", "score")


def quarantined_documents(spark, sf_dir):
    """What can't be ingested, and how many rows can, by error."""
    checked = documents.checked_documents(tables.raw_uploads(spark, sf_dir))
    return checked.select(F.coalesce("doc_id", "name").alias("row"), F.char_length("text").cast("long").alias("n_chars"), "error")


def tokenize_question(spark, sf_dir):
    return retrieval.question_tokens(tables.requests(spark, sf_dir)).drop("weight")


def token_weight(spark, sf_dir):
    return retrieval.question_tokens(tables.requests(spark, sf_dir))


def validate_requests(spark, sf_dir):
    checked = intake.validate_requests(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir))
    return checked.select("request_id", "n_documents", "valid", "error")


def validate_requests_strict(spark, sf_dir):
    asked = tables.questions(spark, sf_dir).withColumn("selected_agents", F.array().cast("array<string>"))
    one = asked.select("request_id", F.lit(1).alias("doc_ordinal"), F.lit("0").alias("doc_id"))
    return intake.validate_requests(asked, one, min_question_chars=7).select("request_id", "valid", "error")


def remove_documents(spark, sf_dir):
    named = tables.request_documents(spark, sf_dir)
    return intake.remove_documents(named, named.filter("cast(doc_id as long) % 3 = 0")).select("request_id", "doc_ordinal", "doc_id")


def append_documents(spark, sf_dir):
    named = tables.request_documents(spark, sf_dir)
    return intake.append_documents(named, named.filter("cast(doc_id as long) % 5 = 0"))


def keyword_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "chunk_id", "score")


def keyword_score_postings(spark, sf_dir):
    return _by_postings(spark, sf_dir).filter("score > 0").select("request_id", "chunk_id", "score")


def _by_postings(spark, sf_dir):
    return retrieval.score_by_postings(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), tables.chunks(spark, sf_dir))


def top_chunks_postings(spark, sf_dir):
    ranked = retrieval.top_chunks(_by_postings(spark, sf_dir), chunks=tables.chunks_of(spark, sf_dir))
    return ranked.select("request_id", "rank", "chunk_id", "doc_ordinal", "page", "score")


def top_chunks_pruned(spark, sf_dir):
    """The same from the chunks that bounds of blocks leave over."""
    chunks = tables.chunks_of(spark, sf_dir)
    scored = retrieval.score_candidates(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), chunks, documents.block_documents(tables.documents(spark, sf_dir)))
    return retrieval.top_chunks(scored, chunks=chunks).select("request_id", "rank", "chunk_id", "doc_ordinal", "page", "score")


def top_chunks(spark, sf_dir):
    return _ranked(spark, sf_dir).select("request_id", "rank", "chunk_id", "doc_ordinal", "page", "score")


def top_chunks_single(spark, sf_dir):
    """One request is the feature: that with the least id."""
    least = F.lit(tables.requests(spark, sf_dir).agg(F.min("request_id")).first()[0])
    one = tables.requests(spark, sf_dir).filter(F.col("request_id") == least)
    named = tables.request_documents(spark, sf_dir).filter(F.col("request_id") == least)
    return retrieval.top_chunks_single(retrieval.score_chunks(one, named, tables.chunks(spark, sf_dir))).select("chunk_id", "score")


def coverage_summary(spark, sf_dir):
    return retrieval.coverage(_ranked(spark, sf_dir))


def evidence_items(spark, sf_dir):
    rows = retrieval.with_chunks(tables.requests(spark, sf_dir), _ranked(spark, sf_dir))
    items = rows.select("request_id", analyses.evidence(F.col("chunks")).alias("evidence"))
    return _items(items, "evidence", "excerpt", "document_name", "page", "section", "relevance").withColumnRenamed("item", "rank")


def _signal_chunks(column, **words):
    def query(spark, sf_dir):
        each = _analysed(spark, sf_dir, **words).select("request_id", F.explode(column).alias("c"))
        return each.select("request_id", F.col("c.rank").alias("rank"), F.col("c.chunk_id").alias("chunk_id"))

    return query


def signal_support(spark, sf_dir):
    count = lambda c: F.size(c).cast("long")
    return _analysed(spark, sf_dir).select("request_id", count("chunks").alias("n_chunks"), count("interaction_chunks").alias("n_interaction"), count("adverse_chunks").alias("n_adverse"))


def agent_confidence(spark, sf_dir):
    return _analysed(spark, sf_dir).select("request_id", *(F.col(f"{c}.confidence").alias(c) for c in analyses.COLUMNS))


def gate_agents(spark, sf_dir):
    return _analysed(spark, sf_dir).select("request_id", *(F.col(f"{c}.summary").alias(c) for c in analyses.COLUMNS))


def literature_search(spark, sf_dir):
    lit = F.col("literature")
    return _analysed(spark, sf_dir).select(
        "request_id",
        lit["summary"].alias("summary"),
        lit["confidence"].alias("confidence"),
        F.size(lit["evidence"]).cast("long").alias("n_evidence"),
        F.size(lit["top_relevant_excerpts"]).cast("long").alias("n_excerpts"),
        F.get(lit["limitations"], F.lit(0)).alias("limitation"),
        F.get(lit["warnings"], F.lit(0)).alias("warning"),
    )


def literature_excerpts(spark, sf_dir):
    return _items(_analysed(spark, sf_dir), "literature.top_relevant_excerpts", "excerpt", "document_name", "page", "section", reason="relevance_explanation")


def _screen(column):
    def query(spark, sf_dir):
        each = _analysed(spark, sf_dir).select("request_id", column, F.posexplode_outer(f"{column}.evidence").alias("pos", "e"))
        return each.select(
            "request_id",
            F.col(f"{column}.summary").alias("summary"),
            F.col(f"{column}.confidence").alias("confidence"),
            (F.col("pos") + 1).alias("item"),
            F.col("e.document_name").alias("document_name"),
            F.col("e.excerpt").alias("excerpt"),
        )

    return query


def _interaction_findings(**words):
    return lambda spark, sf_dir: _items(_analysed(spark, sf_dir, **words), "interaction.findings", "notes", "evidence", interaction="possible_interaction", severity="severity_estimate", uncertainty="uncertainty_level").drop("item")


def _adverse_findings(**words):
    return lambda spark, sf_dir: _items(_analysed(spark, sf_dir, **words), "adverse.findings", "source_evidence", event="adverse_event", confidence="confidence_level")


def trial_summary(spark, sf_dir):
    finding = F.get(F.col("trial.findings"), F.lit(0))
    fields = ("methods", "key_findings", "relevance")
    return _analysed(spark, sf_dir).select("request_id", F.col("trial.summary").alias("summary"), F.col("trial.confidence").alias("confidence"), *(finding[f].alias(f) for f in fields))


def consensus(spark, sf_dir):
    lists = ("missing_evidence", "agreements", "disagreements")
    return _analysed(spark, sf_dir).select(
        "request_id",
        F.col("consensus.confidence").alias("confidence"),
        F.col("consensus.final_consensus").alias("conclusion"),
        *(F.array_join(f"consensus.{c}", "; ").alias(c) for c in lists),
        F.size("consensus.evidence").cast("long").alias("n_evidence"),
    )


def _report(analysed, *more):
    texts = {"executive_summary": "executive_summary", "clinical_briefing": "physician_briefing", "lay_summary": "patient_friendly_summary"}
    lists = {"key_findings": "key_findings", "risks": "risks_and_uncertainties", "follow_up_questions": "recommended_follow_up_questions"}
    return analysed.select(
        "request_id",
        *(F.col(f"report.{f}").alias(c) for c, f in texts.items()),
        *(F.array_join(f"report.{f}", "; ").alias(c) for c, f in lists.items()),
        F.size("report.evidence").cast("long").alias("n_evidence"),
        *more,
    )


def report(spark, sf_dir):
    return _report(_analysed(spark, sf_dir))


def report_evidence_table(spark, sf_dir):
    return _items(_analysed(spark, sf_dir), "report.evidence_table", "topic", "finding", "confidence", source="supporting_source").drop("item")


def report_markdown(spark, sf_dir):
    return _analysed(spark, sf_dir).select("request_id", F.col("report.markdown_report").alias("markdown"))


def report_files_round_trip(spark, sf_dir):
    """Reports written to shared files, and each read back by its place."""
    path = shared_path(spark, "report-files")
    report_files.save_report_files(_analysed(spark, sf_dir), path)
    return report_files.read_report_files(spark, path)


def session_document_parts(spark, sf_dir):
    parts = sessions.document_parts(tables.request_documents(spark, sf_dir), sessions.document_records(tables.documents(spark, sf_dir)), part=20)
    first, last = (F.element_at("documents", F.lit(k)) for k in (1, -1))
    return parts.select("id", "part", F.size("documents").cast("long").alias("n_documents"), first["name"].alias("first_document"), last["name"].alias("last_document"), last["preview"].alias("last_preview"))


def citation_table(spark, sf_dir):
    return analyses.citations(_analysed(spark, sf_dir))


def analysis_bundle(spark, sf_dir):
    r = F.col("results")
    return analyses.bundle(_analysed(spark, sf_dir)).select(
        "request_id",
        r["literature_search"]["confidence"].alias("literature"),
        F.size(r["literature_search"]["top_relevant_excerpts"]).cast("long").alias("n_excerpts"),
        *(r[c]["summary"].alias(c.split("_")[1] if c == "drug_interaction" else c.split("_")[0]) for c in ("drug_interaction", "adverse_reaction", "trial_summarizer")),
        r["debate_consensus"]["final_consensus"].alias("conclusion"),
        r["report_generation"]["markdown_report"].alias("markdown"),
    )


def prompt_payloads(spark, sf_dir):
    prompts = analyses.prompt_payloads(_analysed(spark, sf_dir))
    return prompts.select("request_id", "agent_id", "system", F.get_json_object("user", "$.question").alias("question"), "n_chunks")


def prompt_chunks(spark, sf_dir):
    """The passages that each prompt has, from its JSON."""
    prompts = analyses.prompt_payloads(_analysed(spark, sf_dir))
    chunks = F.from_json(F.get_json_object("user", "$.chunks"), "array<struct<id:string,documentName:string,page:int,text:string,score:int>>")
    each = prompts.select("request_id", "agent_id", F.posexplode(chunks).alias("pos", "c"))
    return each.select("request_id", "agent_id", (F.col("pos") + 1).alias("item"), "c.id", F.col("c.documentName").alias("document_name"), "c.page", "c.score", "c.text")


def prompt_upstream(spark, sf_dir):
    """What consensus and report are told of the analyses before them, a field a row, from the prompts' JSON."""
    prompts = analyses.prompt_payloads(_merged(spark, sf_dir))
    paths = ("literature.summary", "literature.confidence", "drug.summary", "drug.findings[0].severityEstimate", "adverse.summary", "trial.summary", "trial.findings[0].keyFindings", "debate.finalConsensus", "debate.missingEvidence[0]")
    fields = F.array(*(F.struct(F.lit(p).alias("field"), F.get_json_object("user", f"$.{p}").alias("value")) for p in paths))
    each = prompts.filter("n_chunks is null").select("request_id", "agent_id", F.explode(fields).alias("f"))
    return each.select("request_id", "agent_id", "f.*")


def merged_analyses(spark, sf_dir):
    """Summaries and confidences with a model's responses to some analyses."""
    merged = _merged(spark, sf_dir)
    first = F.get(F.col("literature.top_relevant_excerpts"), F.lit(0))
    return merged.select(
        "request_id",
        *(F.col(f"{c}.summary").alias(c) for c in analyses.COLUMNS[:4]),
        *(F.col(f"{c}.confidence").alias(f"{c}_confidence") for c in analyses.COLUMNS[:4]),
        F.size("literature.evidence").cast("long").alias("n_evidence"),
        F.size("literature.limitations").cast("long").alias("n_limitations"),
        first["excerpt"].alias("first_excerpt"),
        first["document_name"].alias("first_document"),
        first["page"].alias("first_page"),
        F.get(F.col("interaction.findings"), F.lit(0))["possible_interaction"].alias("finding"),
    )


def merged_consensus(spark, sf_dir):
    lists = ("missing_evidence", "agreements", "disagreements")
    return _merged(spark, sf_dir).select(
        "request_id", F.col("consensus.confidence").alias("confidence"), F.col("consensus.final_consensus").alias("conclusion"), *(F.array_join(f"consensus.{c}", "; ").alias(c) for c in lists), F.size("consensus.evidence").cast("long").alias("n_evidence")
    )


def merged_report(spark, sf_dir):
    row = F.get(F.col("report.evidence_table"), F.lit(0))
    more = (F.col("report.markdown_report").alias("markdown"), row["finding"].alias("finding"), row["supporting_source"].alias("source"), row["confidence"].alias("confidence"))
    return _report(_merged(spark, sf_dir), *more)


def merge_responses(spark, sf_dir):
    """Responses for the literature search: whole, without fields, corrupt, empty and absent in turn."""
    computed = _analysed(spark, sf_dir).select(
        "request_id", F.lit("literature-search").alias("agent_id"), F.struct("literature.summary", "literature.confidence", "literature.limitations").alias("output")
    )
    turn = F.col("request_id").cast("long") % 5
    whole = F.to_json(F.struct(F.concat(F.lit("External summary "), "request_id").alias("summary"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("limitations")))
    content = F.when(turn == 0, whole).when(turn == 1, "{}").when(turn == 2, '{"summary": ').when(turn == 3, "")
    given = tables.requests(spark, sf_dir).filter(turn != 4).select("request_id", F.lit("literature-search").alias("agent_id"), content.alias("content"))
    merged = responses.merge_responses(computed, given, "summary string, confidence string, limitations array<string>")
    return merged.select("request_id", "external", "output.summary", "output.confidence", F.size("output.limitations").cast("long").alias("n_limitations"))


def session_row_mapping(spark, sf_dir):
    rows = sessions.read_sessions(tables.saves(spark, sf_dir))
    counts = (F.size("selected_agents").cast("long").alias("n_agents"), F.size("documents").cast("long").alias("n_documents"))
    return rows.select("event_id", "id", "question", "status", "mode", *counts, F.col("results.debate_consensus.final_consensus").cast("int").alias("k"), "created_at", "updated_at")


def _sessions(spark, sf_dir):
    stored, new = tables.saved_batches(spark, sf_dir)
    return sessions.read_sessions(sessions.upsert_sessions(stored, new))


def session_upsert(spark, sf_dir):
    return _sessions(spark, sf_dir).select("id", "question", "status", "mode", F.col("results.debate_consensus.final_consensus").cast("int").alias("k"), "created_at", "updated_at")


def session_lookup(spark, sf_dir):
    """Every saved id, and one that was never saved."""
    ids = tables.saves(spark, sf_dir).select("id").unionByName(spark.createDataFrame([("none such",)], "id string"))
    return sessions.lookup_sessions(_sessions(spark, sf_dir), ids).select("id", "status", "results_available")


def recent_sessions(spark, sf_dir):
    return sessions.recent_sessions(_sessions(spark, sf_dir)).select("id", "status", "created_at")


def session_mru(spark, sf_dir):
    return sessions.most_recent(tables.saves(spark, sf_dir).withColumnRenamed("updated_at", "saved_at")).select("id", "status", "saved_at")


def session_cards(spark, sf_dir):
    return sessions.session_cards(_sessions(spark, sf_dir))


def dashboard_stats(spark, sf_dir):
    return sessions.dashboard_stats(_sessions(spark, sf_dir))


def _store(spark, sf_dir):
    """A store in the shared folder, saved to in two batches."""
    path = shared_path(spark, "session-store")
    saves = tables.saves(spark, sf_dir)
    for k in range(2):
        session_store.save(spark, path, saves.filter(F.col("event_id") % 2 == k).drop("event_id"))
    return path


def session_store_upsert(spark, sf_dir):
    kept = session_store.read_store(spark, _store(spark, sf_dir))
    return kept.select("id", "question", "status", "mode", F.col("results.debate_consensus.final_consensus").cast("int").alias("k"), "created_at", "updated_at")


def session_store_lookup(spark, sf_dir):
    """Every saved id, and one that was never saved."""
    ids = tables.saves(spark, sf_dir).select("id").unionByName(spark.createDataFrame([("none such",)], "id string"))
    return session_store.lookup(spark, _store(spark, sf_dir), ids).select("id", "status", "results_available")


def session_store_recent(spark, sf_dir):
    return session_store.recent_sessions(spark, _store(spark, sf_dir)).select("id", "status", "created_at")


def session_store_mru(spark, sf_dir):
    return session_store.most_recent(spark, _store(spark, sf_dir)).select("id", "status", F.col("updated_at").alias("saved_at"))


def session_store_stats(spark, sf_dir):
    return session_store.stats(spark, _store(spark, sf_dir))


def session_round_trip(spark, sf_dir):
    """Sessions assembled, stored, read, saved again with another status, and listed: an analysis of each a row."""
    asked = tables.requests(spark, sf_dir)
    records = sessions.document_records(tables.documents(spark, sf_dir))
    made = sessions.assemble_sessions(asked, tables.request_documents(spark, sf_dir), analyses.bundle(_merged(spark, sf_dir)), documents=records)
    path = shared_path(spark, "sessions")
    storage.save_sessions(made, path)
    stored = storage.load_sessions(spark, path)
    again = stored.filter("cast(id as long) % 2 = 0").withColumn("status", F.lit("draft")).withColumn("updated_at", F.col("updated_at") + F.expr("interval 1 day"))
    kept = sessions.upsert_sessions(stored, again)
    r = F.col("results")
    return kept.select(
        "id",
        "status",
        F.size("documents").cast("long").alias("n_documents"),
        F.try_element_at("documents", F.lit(-1))["name"].alias("last_document"),
        F.try_element_at("documents", F.lit(-1))["preview"].alias("last_preview"),
        F.aggregate("documents", F.lit(0).cast("long"), lambda n, d: n + d["size"]).alias("n_bytes"),
        r["literature_search"]["summary"].alias("literature"),
        r["drug_interaction"]["summary"].alias("interaction"),
        r["adverse_reaction"]["summary"].alias("adverse"),
        r["trial_summarizer"]["summary"].alias("trial"),
        r["debate_consensus"]["final_consensus"].alias("conclusion"),
        r["report_generation"]["markdown_report"].alias("markdown"),
        "updated_at",
    )


def assemble_sessions(spark, sf_dir):
    asked = tables.requests(spark, sf_dir)
    made = sessions.assemble_sessions(asked, tables.request_documents(spark, sf_dir), analyses.bundle(_analysed(spark, sf_dir))).withColumn("documents", F.col("documents.id"))
    return made.select(
        "id", "question", "status", "mode", F.size("selected_agents").cast("long").alias("n_agents"), F.array_join("documents", ",").alias("documents"), F.col("results.debate_consensus.final_consensus").alias("conclusion"), "created_at"
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_documents, sanitize_text, document_preview, estimate_page_count, pick_sentences, chunk_documents, stored_chunks, chunk_page_estimate, chunk_excerpts,
        request_intake, uploaded_requests, uploaded_documents, top_chunks_uploaded, quarantined_documents, tokenize_question, token_weight, validate_requests, validate_requests_strict, remove_documents, append_documents,
        keyword_score, keyword_score_postings, top_chunks, top_chunks_postings, top_chunks_pruned, top_chunks_stored, top_chunks_single, coverage_summary, evidence_items, signal_support, agent_confidence, gate_agents,
        literature_search, literature_excerpts, trial_summary, consensus, report, report_evidence_table, report_markdown, report_files_round_trip, session_document_parts, citation_table, analysis_bundle,
        prompt_payloads, prompt_chunks, prompt_upstream, merge_responses, merged_analyses, merged_consensus, merged_report, session_row_mapping, session_upsert, session_lookup, recent_sessions, session_mru, session_cards, dashboard_stats, assemble_sessions, session_round_trip, session_store_upsert, session_store_lookup, session_store_recent, session_store_mru, session_store_stats,
    )
}
QUERIES |= {
    "interaction_signal_chunks": _signal_chunks("interaction_chunks"),
    "interaction_signal_chunks_custom": _signal_chunks("interaction_chunks", interaction_words=CUSTOM_WORDS),
    "adverse_signal_chunks": _signal_chunks("adverse_chunks"),
    "adverse_signal_chunks_custom": _signal_chunks("adverse_chunks", safety_words=CUSTOM_WORDS),
    "interaction_screen": _screen("interaction"),
    "adverse_screen": _screen("adverse"),
    "interaction_findings": _interaction_findings(),
    "interaction_findings_custom": _interaction_findings(interaction_words=CUSTOM_WORDS),
    "adverse_findings": _adverse_findings(),
    "adverse_findings_custom": _adverse_findings(safety_words=CUSTOM_WORDS),
}
