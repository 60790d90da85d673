"""Schemas of stored tables and of JSON bodies. Nothing is inferred.

Fixed values: the fields of documents, sessions and the six analyses are the data model's, in snake case; JSON bodies of
models have the same fields in camel case.
"""

import re

DOCUMENT = "doc_id string, name string, size_bytes long, page_count int, uploaded_at timestamp, text string"
RESPONSE = "request_id string, agent_id string, content string, received_at timestamp"

_EVIDENCE = "array<struct<excerpt:string,document_name:string,page:int,section:string,relevance:string>>"
_BASE = f"agent_name:string,summary:string,confidence:string,limitations:array<string>,warnings:array<string>,evidence:{_EVIDENCE}"

# The outputs of the six analyses, in the order of AGENTS.
ANALYSES = {
    "literature_search": f"struct<{_BASE},top_relevant_excerpts:array<struct<excerpt:string,document_name:string,page:int,section:string,relevance_explanation:string>>>",
    "drug_interaction": f"struct<{_BASE},findings:array<struct<possible_interaction:string,severity_estimate:string,uncertainty_level:string,notes:string,evidence:string>>>",
    "adverse_reaction": f"struct<{_BASE},findings:array<struct<adverse_event:string,frequency:string,affected_population:string,source_evidence:string,confidence_level:string>>>",
    "trial_summarizer": f"struct<{_BASE},findings:array<struct<study_objective:string,methods:string,key_findings:string,limitations:string,relevance:string>>>",
    "debate_consensus": f"struct<{_BASE},agreements:array<string>,disagreements:array<string>,missing_evidence:array<string>,final_consensus:string>",
    "report_generation": (
        f"struct<{_BASE},executive_summary:string,key_findings:array<string>,"
        "evidence_table:array<struct<topic:string,finding:string,supporting_source:string,confidence:string>>,"
        "risks_and_uncertainties:array<string>,recommended_follow_up_questions:array<string>,research_disclaimer:string,"
        "physician_briefing:string,patient_friendly_summary:string,markdown_report:string>"
    ),
}
BUNDLE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in ANALYSES.items()) + ">"
DOCUMENT_RECORD = "struct<id:string,name:string,size:bigint,page_count:int,uploaded_at:timestamp,preview:string,text:string>"
SESSION = (
    f"id string, question string, status string, mode string, selected_agents array<string>, documents array<{DOCUMENT_RECORD}>, "
    f"results {BUNDLE}, created_at timestamp, updated_at timestamp"
)


def camel(schema: str) -> str:
    """A schema with its fields' names in camel case, as JSON has them."""
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), schema)
