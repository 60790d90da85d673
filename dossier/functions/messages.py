"""Wording of summaries, limitations and findings, by agent and branch. Every operator takes another table instead."""

MESSAGES = {
    "document.error.id": "The document has no id.",
    "document.error.texts": "Several texts were sent under this id.",
    "request.error.body": "The request's body is not a JSON object.",
    "disclaimer": "For research support only: findings may be incomplete or wrong, and need review by qualified people.",
    "evidence.relevance": "Ranked by keyword score for the question.",
    "disabled.summary": "Not run: this analysis was not selected.",
    "disabled.limitation": "Nothing was produced, as the analysis was not selected.",
    "literature.name": "Literature search",
    "literature.summary": "The passages with the highest keyword scores among the request's documents.",
    "literature.limitation": "Passages are ranked by the keywords they contain, not by meaning.",
    "literature.reason": "Has keywords of the question: ",
    "interaction.name": "Interaction screen",
    "interaction.summary.match": "Some passages mention possible interactions; how severe they are is open.",
    "interaction.summary.none": "No passage mentions interactions explicitly; nothing firm follows from that.",
    "interaction.limitation": "Clinical significance can't be told from passages alone.",
    "interaction.finding.match": "A passage mentions a possible interaction.",
    "interaction.finding.none": "No interaction was found in the passages.",
    "interaction.notes.none": "Without a passage on interactions there is nothing to quote here.",
    "interaction.evidence.none": "None of the best passages mentions an interaction.",
    "adverse.name": "Safety screen",
    "adverse.summary.match": "Some passages mention safety events.",
    "adverse.summary.none": "Few or no passages mention safety, so the list of events is incomplete.",
    "adverse.limitation": "How often events occur may be missing where tables were not extracted.",
    "adverse.event": "Mention of a safety event or warning",
    "adverse.frequency": "Not stated consistently",
    "adverse.population": "To be confirmed in the source",
    "trial.name": "Study summary",
    "trial.summary": "A short account of the study's methods, findings and relevance.",
    "trial.limitation": "Where documents cover several studies, check each one by itself.",
    "trial.objective": "To answer the main question of the documents.",
    "trial.methods.none": "The passages say little about methods.",
    "trial.findings.none": "Findings have to be taken from the studies themselves.",
    "trial.finding_limitation": "Check sample sizes and follow-up in the appendices.",
    "trial.relevance": "Bears on the question: ",
    "consensus.name": "Consensus",
    "consensus.summary": "Where the analyses agree, where they differ, and what is missing.",
    "consensus.limitation": "Gaps in the retrieved passages carry over.",
    "consensus.agreement.question": "All analyses address the question: ",
    "consensus.agreement.some": "Each can be traced to retrieved passages.",
    "consensus.agreement.sparse": "Evidence is sparse, so conclusions stay cautious.",
    "consensus.disagreement.moderate": "An interaction is plausible, but its severity is not settled.",
    "consensus.disagreement.none": "No finding rates an interaction as moderate.",
    "consensus.missing.tables": "Tables and appendices that plain text leaves out",
    "consensus.missing.context": "Literature and regulation outside the documents",
    "consensus.conclusion": " Use this as research support only.",
    "consensus.disabled.missing": "The consensus was not selected for this session.",
    "consensus.disabled.conclusion": "No conclusion was drawn, as the consensus was not selected.",
    "report.name": "Report",
    "report.summary": "All analyses in one report.",
    "report.limitation": "Compare with the source documents before passing this on.",
    "report.topic": "Retrieved evidence",
    "report.finding.none": "No passage",
    "report.source.none": "Documents of the request",
    "report.question": "What else is needed to answer: ",
    "report.follow_up": "Would labels or supplements change the conclusion?",
    "report.lay": "A short version for readers without training; ask a professional before acting on it.",
    "report.disabled.executive": "No report was made for this session.",
    "report.disabled.risk": "No report was made.",
    "report.disabled.follow_up": "Select the report to have one.",
    "report.disabled.text": "Not made.",
    "report.title": "# Research briefing",
    "citation.location.none": "Location not given",
    "request.error": "A question and at least one document are needed.",
    "request.error.agents": "The list of analyses is missing.",
    "prompt.common": "Be careful, claim nothing the documents don't say, and answer in JSON.",
    "prompt.literature-search": "Choose the passages that matter most for the question and say why, quoting exactly.",
    "prompt.drug-interaction": "Find possible drug interactions in the passages and state how uncertain they are.",
    "prompt.adverse-reaction": "List adverse events and warnings; keep what is observed apart from what is inferred.",
    "prompt.trial-summarizer": "Summarise design, endpoints, results and limits of the study.",
    "prompt.debate-consensus": "Compare the analyses; list agreements, differences and missing evidence.",
    "prompt.report-generation": "Combine the analyses into one report with an evidence table and a disclaimer.",
}
