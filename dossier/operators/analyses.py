"""The four analyses of a request, their consensus and its report, as columns over one row per request.

The row has request_id, question, selected_agents and chunks (retrieval.with_chunks). As each analysis is an
expression on that row, consensus and report read the others' columns: nothing is joined or shuffled again. Where the
row has external responses (responses.with_responses), an analysis is the response to it if there is a valid one, and
consensus and report read that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.messages import MESSAGES
from dossier.functions.text import contains_any, excerpt, lead_sentences, section_label, source_label
from dossier.functions.values import ADVERSE, AGENTS, CONSENSUS, INTERACTION, INTERACTION_WORDS, LITERATURE, PROMPT_CHUNKS, REPORT, SAFETY_WORDS, TRIAL
from dossier.operators.responses import parsed
from dossier.sources.schemas import ANALYSES, BUNDLE, camel

#: Columns of with_analyses(), in the order of AGENTS.
COLUMNS = ("literature", "interaction", "adverse", "trial", "consensus", "report")
#: The type of each.
TYPES = dict(zip(COLUMNS, ANALYSES.values(), strict=True))

_EVIDENCE = "array<struct<excerpt:string,document_name:string,page:int,section:string,relevance:string>>"


def evidence(chunks: Column, messages: dict[str, str] = MESSAGES, n: int = 4) -> Column:
    """The first n chunks as evidence items."""
    return F.transform(
        F.slice(chunks, 1, n),
        lambda c: F.struct(
            excerpt(c["text"], 220).alias("excerpt"),
            c["doc_name"].alias("document_name"),
            c["page"].alias("page"),
            section_label(c["page"]).alias("section"),
            F.lit(messages["evidence.relevance"]).alias("relevance"),
        ),
    ).cast(_EVIDENCE)


def _common(name: str, summary: Column, confidence: Column, limitation: str, items: Column, messages: dict[str, str]) -> list[Column]:
    return [
        F.lit(name).alias("agent_name"),
        summary.alias("summary"),
        confidence.alias("confidence"),
        F.array(F.lit(limitation)).alias("limitations"),
        F.array(F.lit(messages["disclaimer"])).alias("warnings"),
        items.cast(_EVIDENCE).alias("evidence"),
    ]


def _confidence(n: Column, more_than: int) -> Column:
    return F.when(n > more_than, "medium").otherwise("low")


def _gated(column: str, real: list[Column], stub: list[Column], responses: Column | None) -> Column:
    """The analysis, or the response to it, if it is selected, else a row that says it was not."""
    agent, kind = AGENTS[COLUMNS.index(column)], TYPES[column]
    made = F.struct(*real).cast(kind)
    if responses is not None:
        made = F.coalesce(parsed(responses[agent], kind), made)
    return F.when(F.array_contains("selected_agents", agent), made).otherwise(F.struct(*stub).cast(kind))


def _said(*parts: Column) -> Column:
    """Texts put together; one that a response left out is empty."""
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def _stub(name: str, messages: dict[str, str], *more: Column) -> list[Column]:
    return [*_common(name, F.lit(messages["disabled.summary"]), F.lit("low"), messages["disabled.limitation"], F.array(), messages), *more]


def literature(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    chunks = F.col("chunks")
    excerpts = F.transform(
        F.slice(chunks, 1, 5),
        lambda c: F.struct(
            excerpt(c["text"], 280).alias("excerpt"),
            c["doc_name"].alias("document_name"),
            c["page"].alias("page"),
            section_label(c["page"]).alias("section"),
            F.concat(F.lit(messages["literature.reason"]), F.col("question")).alias("relevance_explanation"),
        ),
    )
    name = messages["literature.name"]
    real = _common(name, F.lit(messages["literature.summary"]), _confidence(F.size(chunks), 0), messages["literature.limitation"], evidence(chunks, messages), messages)
    return _gated("literature", [*real, excerpts], _stub(name, messages, F.array()), responses)


def _matched(words: tuple[str, ...]) -> Column:
    """Ranked chunks that contain a word of the lexicon."""
    return F.filter("chunks", lambda c: contains_any(c["lower_text"], words))


def _matched_or_all(matched: Column) -> Column:
    return F.when(F.size(matched) > 0, matched).otherwise(F.col("chunks"))


def interaction(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    """Reads interaction_chunks; exactly one finding."""
    matched = F.col("interaction_chunks")
    first, some = F.get(matched, F.lit(0))["text"], F.size(matched) > 0
    pick = lambda key: F.when(some, messages[f"{key}.match"]).otherwise(messages[f"{key}.none"])
    finding = F.struct(
        pick("interaction.finding").alias("possible_interaction"),
        F.when(some, "moderate").otherwise("unclear").alias("severity_estimate"),
        F.when(some, "medium").otherwise("high").alias("uncertainty_level"),
        F.when(some, lead_sentences(first)).otherwise(messages["interaction.notes.none"]).alias("notes"),
        F.when(some, excerpt(first, 240)).otherwise(messages["interaction.evidence.none"]).alias("evidence"),
    )
    name = messages["interaction.name"]
    items = evidence(_matched_or_all(matched), messages)
    real = _common(name, pick("interaction.summary"), _confidence(F.size(matched), 1), messages["interaction.limitation"], items, messages)
    return _gated("interaction", [*real, F.array(finding)], _stub(name, messages, F.array()), responses)


def adverse(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    """Reads adverse_chunks; a finding for each of the first three."""
    matched = F.col("adverse_chunks")
    findings = F.transform(
        F.slice(matched, 1, 3),
        lambda c: F.struct(
            F.lit(messages["adverse.event"]).alias("adverse_event"),
            F.lit(messages["adverse.frequency"]).alias("frequency"),
            F.lit(messages["adverse.population"]).alias("affected_population"),
            lead_sentences(c["text"]).alias("source_evidence"),
            F.lit("medium").alias("confidence_level"),
        ),
    )
    name = messages["adverse.name"]
    summary = F.when(F.size(matched) > 0, messages["adverse.summary.match"]).otherwise(messages["adverse.summary.none"])
    items = evidence(_matched_or_all(matched), messages)
    real = _common(name, summary, _confidence(F.size(matched), 1), messages["adverse.limitation"], items, messages)
    return _gated("adverse", [*real, findings], _stub(name, messages, F.array()), responses)


def trial(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    first, second = (F.get(F.col("chunks"), F.lit(k))["text"] for k in (0, 1))
    finding = F.struct(
        F.lit(messages["trial.objective"]).alias("study_objective"),
        lead_sentences(F.coalesce(first, F.lit(messages["trial.methods.none"]))).alias("methods"),
        lead_sentences(F.coalesce(second, first, F.lit(messages["trial.findings.none"]))).alias("key_findings"),
        F.lit(messages["trial.finding_limitation"]).alias("limitations"),
        F.concat(F.lit(messages["trial.relevance"]), F.col("question")).alias("relevance"),
    )
    name = messages["trial.name"]
    real = _common(name, F.lit(messages["trial.summary"]), _confidence(F.size("chunks"), 2), messages["trial.limitation"], evidence(F.col("chunks"), messages), messages)
    return _gated("trial", [*real, F.array(finding)], _stub(name, messages, F.array()), responses)


def consensus(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    """Reads the four analyses, whether they ran or not, and whether a model made them."""
    some = F.size("literature.top_relevant_excerpts") > 0
    moderate = F.get(F.col("interaction.findings"), F.lit(0))["severity_estimate"] == "moderate"
    name = messages["consensus.name"]
    real = _common(name, F.lit(messages["consensus.summary"]), F.lit("medium"), messages["consensus.limitation"], F.slice("literature.evidence", 1, 3), messages)
    real += [
        F.array(
            F.concat(F.lit(messages["consensus.agreement.question"]), F.col("question")),
            F.when(some, messages["consensus.agreement.some"]).otherwise(messages["consensus.agreement.sparse"]),
        ),
        F.array(F.when(moderate, messages["consensus.disagreement.moderate"]).otherwise(messages["consensus.disagreement.none"])),
        F.array(F.lit(messages["consensus.missing.tables"]), F.lit(messages["consensus.missing.context"])),
        _said(F.col("trial.summary"), F.lit(" "), F.col("adverse.summary"), F.lit(messages["consensus.conclusion"])),
    ]
    stub = _stub(name, messages, F.array(), F.array(), F.array(F.lit(messages["consensus.disabled.missing"])), F.lit(messages["consensus.disabled.conclusion"]))
    return _gated("consensus", real, stub, responses)


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: _said(F.lit("- "), x)), "\n")


def markdown(messages: dict[str, str] = MESSAGES) -> Column:
    """The report as text, from the other analyses' columns."""
    sections = [
        F.lit(messages["report.title"]),
        _said(F.lit("## Executive Summary\n"), F.col("consensus.final_consensus")),
        _said(F.lit("## Key Findings\n"), _bullets(_key_findings())),
        _said(F.lit("## Clinical Briefing\n"), F.col("trial.summary")),
        _said(F.lit("## Plain Summary\n"), F.col("adverse.summary")),
        _said(F.lit("## Risks and Uncertainties\n"), _bullets(F.col("consensus.missing_evidence"))),
        _said(F.lit("## Disclaimer\n"), F.lit(messages["disclaimer"])),
    ]
    return F.concat_ws("\n\n", *sections)


def _key_findings() -> Column:
    return F.array("literature.summary", "interaction.summary", "adverse.summary", "consensus.final_consensus")


def report(messages: dict[str, str] = MESSAGES, responses: Column | None = None) -> Column:
    """Reads the other five."""
    top = F.get(F.col("literature.top_relevant_excerpts"), F.lit(0))
    row = F.struct(
        F.lit(messages["report.topic"]),
        F.coalesce(top["excerpt"], F.lit(messages["report.finding.none"])),
        F.when(top.isNotNull(), source_label(top["document_name"], top["page"])).otherwise(messages["report.source.none"]),
        F.col("literature.confidence"),
    )
    name = messages["report.name"]
    real = _common(name, F.lit(messages["report.summary"]), F.lit("medium"), messages["report.limitation"], F.slice("literature.evidence", 1, 4), messages)
    real += [
        F.col("consensus.final_consensus"),
        _key_findings(),
        F.array(row),
        F.col("consensus.missing_evidence"),
        F.array(F.concat(F.lit(messages["report.question"]), F.col("question"), F.lit("?")), F.lit(messages["report.follow_up"])),
        F.lit(messages["disclaimer"]),
        _said(F.col("trial.summary"), F.lit(" "), F.col("interaction.summary")),
        F.lit(messages["report.lay"]),
        markdown(messages),
    ]
    none = F.lit(messages["report.disabled.text"])
    stub = _stub(
        name,
        messages,
        F.lit(messages["report.disabled.executive"]),
        F.array(),
        F.array(),
        F.array(F.lit(messages["report.disabled.risk"])),
        F.array(F.lit(messages["report.disabled.follow_up"])),
        F.lit(messages["disclaimer"]),
        none,
        none,
        F.lit(messages["report.title"] + "\n\n" + messages["disclaimer"]),
    )
    return _gated("report", real, stub, responses)


def with_analyses(
    rows: DataFrame, interaction_words: tuple[str, ...] = INTERACTION_WORDS, safety_words: tuple[str, ...] = SAFETY_WORDS, messages: dict[str, str] = MESSAGES
) -> DataFrame:
    """rows of retrieval.with_chunks() with the six analyses as structs; one row per request, chunks or not.

    If rows have `responses`, a map of an analysis to a model's JSON, a selected analysis is what that says.
    """
    given = F.col("responses") if "responses" in rows.columns else None
    screened = rows.withColumn("interaction_chunks", _matched(interaction_words)).withColumn("adverse_chunks", _matched(safety_words))
    four = screened.withColumns({c: made(messages, given) for c, made in zip(COLUMNS, (literature, interaction, adverse, trial), strict=False)})
    return four.withColumn("consensus", consensus(messages, given)).withColumn("report", report(messages, given))


def bundle(analysed: DataFrame) -> DataFrame:
    """request_id and one struct of all six."""
    return analysed.select("request_id", F.struct(*COLUMNS).cast(BUNDLE).alias("results"))


def citations(analysed: DataFrame, messages: dict[str, str] = MESSAGES) -> DataFrame:
    """Literature evidence, an item a row, with a default where its location is missing."""
    items = analysed.select("request_id", F.posexplode("literature.evidence").alias("pos", "e"))
    location = F.coalesce("e.section", F.lit(messages["citation.location.none"]))
    return items.select("request_id", (F.col("pos") + 1).alias("item"), F.col("e.document_name").alias("source"), F.col("e.relevance").alias("relevance"), location.alias("location"), F.col("e.excerpt").alias("excerpt"))


def prompt_payloads(analysed: DataFrame, messages: dict[str, str] = MESSAGES, n: int = PROMPT_CHUNKS) -> DataFrame:
    """Inputs of an external model: request_id, agent_id, system, user as JSON and n_chunks, for each selected agent.

    The first four get the question and the first n chunks, the screens only matched ones; consensus and report get
    what the others returned.
    """
    shown = lambda chunks: F.transform(F.slice(chunks, 1, n), lambda c: F.struct(c["chunk_id"].alias("id"), c["doc_name"].alias("documentName"), c["page"].alias("page"), c["text"].alias("text"), c["score"].alias("score")))
    parts = {
        LITERATURE: F.col("chunks"),
        INTERACTION: F.col("interaction_chunks"),
        ADVERSE: F.col("adverse_chunks"),
        TRIAL: F.col("chunks"),
    }
    keep_nulls = {"ignoreNullFields": "false"}
    users = [
        F.struct(F.lit(agent).alias("agent_id"), F.to_json(F.struct("question", shown(chunks).alias("chunks")), keep_nulls).alias("user"), F.least(F.size(chunks), F.lit(n)).alias("n_chunks"))
        for agent, chunks in parts.items()
    ]
    none = F.lit(None).cast("int").alias("n_chunks")
    said = [F.col(c).cast(camel(TYPES[c])).alias(key) for c, key in zip(COLUMNS, ("literature", "drug", "adverse", "trial", "debate"), strict=False)]
    users.append(F.struct(F.lit(CONSENSUS).alias("agent_id"), F.to_json(F.struct("question", *said[:4]), keep_nulls).alias("user"), none))
    users.append(F.struct(F.lit(REPORT).alias("agent_id"), F.to_json(F.struct("question", *said), keep_nulls).alias("user"), none))
    system = F.lit(messages["prompt.common"] + " ")
    texts = F.create_map(*(F.lit(x) for agent in AGENTS for x in (agent, messages[f"prompt.{agent}"])))
    each = analysed.select("request_id", "selected_agents", F.explode(F.array(*users)).alias("p")).filter(F.array_contains("selected_agents", F.col("p.agent_id")))
    return each.select("request_id", F.col("p.agent_id").alias("agent_id"), F.concat(system, texts[F.col("p.agent_id")]).alias("system"), F.col("p.user").alias("user"), F.col("p.n_chunks").alias("n_chunks"))
