"""Edge cases and properties of the engine's operators, on rows made here."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions.messages import MESSAGES
from dossier.functions.values import AGENTS
from dossier.operators import analyses, responses, retrieval, sessions
from dossier.sources import requests as intake
from dossier.sources.documents import chunk_documents, ingest_documents


def documents(spark, texts):
    raw = spark.createDataFrame([(str(k), f"d{k}", len(t or ""), None, t) for k, t in enumerate(texts)], "doc_id string, name string, size_bytes long, page_count int, text string")
    return ingest_documents(raw)


def analysed(spark, question, texts, agents=AGENTS, words=("rash",)):
    requests = spark.createDataFrame([("r", question, list(agents))], "request_id string, question string, selected_agents array<string>")
    named = spark.createDataFrame([("r", k + 1, str(k)) for k in range(len(texts))], "request_id string, doc_ordinal int, doc_id string")
    ranked = retrieval.top_chunks(retrieval.score_chunks(requests, named, chunk_documents(documents(spark, texts))))
    return analyses.with_analyses(retrieval.with_chunks(requests, ranked), interaction_words=words, safety_words=words)


def test_white_space_is_unicode_and_sanitising_is_idempotent(spark):
    odd = " a﻿  b\x0bc\t\n "
    df = spark.createDataFrame([(odd,), (None,), ("   ",)], "t string").select(text.sanitize(F.col("t")).alias("s"))
    assert [r.s for r in df.select("s", text.sanitize(F.col("s")).alias("again")).collect()] == ["a b c", "", ""]
    assert df.filter(text.sanitize(F.col("s")) != F.col("s")).count() == 0


def test_chunks_cover_the_text(spark):
    texts = ["", "   ", "x" * 1499, "x" * 1500, "y" * 1501, "ab " * 14000]
    docs = documents(spark, texts)
    rows = chunk_documents(docs).orderBy("doc_id", "char_offset").collect()
    for k, clean in ((r.doc_id, r.text) for r in docs.collect()):
        own = [r for r in rows if r.doc_id == k]
        assert "".join(r.text for r in own) == clean
        assert all(len(r.text) == 1500 for r in own[:-1])
    pages = {r.char_offset: r.page for r in rows}
    assert [pages[o] for o in (0, 1500, 3000, 39000)] == [1, 1, 2, 15]


def test_page_count_is_kept_where_it_is_known(spark):
    raw = spark.createDataFrame([("a", "n", 1, 7, "x"), ("b", "n", 1, 0, "x" * 2601), ("c", "n", 0, None, None)], "doc_id string, name string, size_bytes long, page_count int, text string")
    assert {r.doc_id: r.page_count for r in ingest_documents(raw).collect()} == {"a": 7, "b": 2, "c": 1}


def test_tokens_and_scores(spark):
    df = spark.createDataFrame([("Safety, safety für THE art!", "a heart of safety"), ("the and", "the"), (None, "x")], "q string, t string")
    got = df.select(text.tokenize(F.col("q")).alias("k"), text.keyword_score(text.tokenize(F.col("q")), F.col("t")).alias("s")).collect()
    assert [r.k for r in got] == [["safety", "safety", "f", "r", "art"], [], []]
    assert [r.s for r in got] == [2 + 2 + 2 + 2 + 2, 0, 0]
    assert df.limit(1).select(text.token_weight(F.lit("letters")).alias("a"), text.token_weight(F.lit("letter")).alias("b")).first() == (3, 2)


def test_requests_are_validated_and_kept(spark):
    requests = spark.createDataFrame(
        [("blank", "  \n", ["x"]), ("none", "A question", ["x"]), ("null", "A question", None), ("six", "abcdef", []), ("seven", "abcdefg", [])],
        "request_id string, question string, selected_agents array<string>",
    )
    named = spark.createDataFrame([(r, 1, "d") for r in ("blank", "null", "six", "seven")], "request_id string, doc_ordinal int, doc_id string")
    valid = lambda n: {r.request_id for r in intake.validate_requests(requests, named, n).collect() if r.valid}
    assert valid(1) == {"six", "seven"} and valid(7) == {"seven"}
    assert intake.validate_requests(requests, named).count() == 5


def test_bodies_may_be_corrupt(spark):
    bodies = spark.createDataFrame([("a", '{"question": "q", "documents": ["x", "y"], "selectedAgents": ["z"]}'), ("b", "{"), ("c", None)], "request_id string, body string")
    requests, named = intake.request_intake(bodies)
    assert {r.request_id: r.question for r in requests.collect()} == {"a": "q", "b": None, "c": None}
    assert sorted((r.doc_ordinal, r.doc_id) for r in named.collect()) == [(1, "x"), (2, "y")]


def test_bodies_with_whole_documents(spark):
    import json

    whole = {"id": "x", "name": "x.pdf", "size": 5, "pageCount": 3, "uploadedAt": "2024-01-02T03:04:05Z", "preview": "p", "text": "a text"}
    rows = [
        ("a", json.dumps({"question": "q", "documents": [whole, "stored", {"id": 7, "text": None}, {"name": "no id", "text": "t"}, '{"id": "text"}'], "selectedAgents": []})),
        ("b", json.dumps({"question": "q", "documents": [whole, {**whole, "id": "y"}], "selectedAgents": []})),
        ("c", json.dumps({"question": "q", "documents": [{**whole, "id": "y", "text": "another"}], "selectedAgents": "one"})),
        ("d", json.dumps({"question": 5, "documents": {"id": "x"}, "selectedAgents": []})),
        *((k, body) for k, body in (("e", "{"), ("f", "[1]"), ("g", None), ("h", '"text"'))),
    ]
    bodies = spark.createDataFrame(rows, "request_id string, body string")
    requests, named = intake.request_intake(bodies)
    assert {r.request_id: (r.question, r.body_error is None) for r in requests.collect()} == {
        "a": ("q", True), "b": ("q", True), "c": ("q", True), "d": ("5", True), "e": (None, False), "f": (None, False), "g": (None, False), "h": (None, False),
    }
    listed = sorted((r.request_id, r.doc_ordinal, r.doc_id) for r in named.collect())
    assert listed == [("a", 1, "x"), ("a", 2, "stored"), ("a", 3, "7"), ("a", 4, None), ("a", 5, '{"id": "text"}'), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "y")]
    checked = {r.request_id: r.error for r in intake.validate_requests(requests, named).collect()}
    assert {k for k, e in checked.items() if e is None} == {"a", "b"} and checked["e"] != checked["d"]
    sent = sorted(((r.doc_id or "", r.text or "", r.page_count, r.error is None) for r in intake.uploaded_documents(bodies).collect()))
    assert sent == [("", "t", None, False), ("7", "", None, True), ("x", "a text", 3, True), ("y", "a text", 3, False), ("y", "another", 3, False)]
    assert intake.uploaded_documents(bodies.limit(0)).count() == 0


def test_rows_that_cannot_be_ingested_are_kept_apart(spark, tmp_path):
    from dossier.sources import storage

    kinds = "doc_id string, name string, size_bytes long, page_count int, uploaded_at timestamp, text string"
    raw = [(i, n, 1, None, None, t) for i, n, t in [("a", "1", "x"), ("a", "2", "x"), ("b", "3", "x"), ("b", "4", "y"), ("b", "5", None), ("c", "6", None), ("c", "7", ""), (None, "8", "x"), (None, "9", "y")]]
    spark.createDataFrame(raw, kinds).write.parquet(f"{tmp_path}/raw")
    good, bad = storage.load_checked_documents(spark, f"{tmp_path}/raw")
    assert sorted(r.name for r in good.collect()) == ["1", "2", "6", "7"]
    assert sorted((r.name, r.doc_id is None) for r in bad.collect()) == [("3", False), ("4", False), ("5", False), ("8", True), ("9", True)]
    assert {r.error for r in bad.collect()} == {MESSAGES["document.error.id"], MESSAGES["document.error.texts"]}


def test_ranks_break_ties_by_document_and_offset(spark):
    got = analysed(spark, "nothing matches", ["a" * 3100, "b"] * 2).select(F.explode("chunks").alias("c")).select("c.*").orderBy("rank").collect()
    assert [(r.rank, r.chunk_id, r.score) for r in got] == list(zip(range(1, 9), ["0-0", "0-1500", "0-3000", "1-0", "2-0", "2-1500", "2-3000", "3-0"], [0] * 8))


def test_both_scores_agree(spark, sf_dir):
    from dossier.plans.registry import QUERIES

    plain = QUERIES["keyword_score"](spark, sf_dir).filter("score > 0")
    assert plain.exceptAll(QUERIES["keyword_score_postings"](spark, sf_dir)).count() == 0


def test_confidence_follows_support(spark):
    for n, want in ((0, ("medium", "low", "low", "low")), (1, ("medium", "low", "low", "low")), (2, ("medium", "medium", "medium", "low")), (3, ("medium", "medium", "medium", "medium"))):
        row = analysed(spark, "which rash", [f"A rash came. It went. {k}" for k in range(n)] or ["calm"]).first()
        assert tuple(row[c].confidence for c in analyses.COLUMNS[:4]) == want
        assert len(row.adverse.findings) == min(n, 3) and len(row.interaction.findings) == 1
    assert row.interaction.findings[0].notes == "A rash came. It went."


def test_requests_without_chunks_and_disabled_analyses(spark):
    row = analysed(spark, "q", [""]).first()
    assert row.literature.confidence == "low" and row.literature.top_relevant_excerpts == [] and row.report.evidence_table[0].finding
    off = analysed(spark, "q", ["a rash"], agents=("report-generation", "unknown")).first()
    assert all(off[c].evidence == [] and off[c].confidence == "low" for c in analyses.COLUMNS[:5])
    assert off.report.confidence == "medium" and off.report.risks_and_uncertainties == off.consensus.missing_evidence


def test_prompts_have_matched_chunks_only(spark):
    got = {r.agent_id: r.n_chunks for r in analyses.prompt_payloads(analysed(spark, "q", ["calm", "a rash"])).collect()}
    assert got == dict(zip(AGENTS, [2, 1, 1, 2, None, None]))


def test_responses_replace_valid_ones_only(spark):
    computed = spark.createDataFrame([(str(k), "a", ("own", ["l"])) for k in range(5)], "request_id string, agent_id string, output struct<summary:string,limitations:array<string>>")
    given = spark.createDataFrame([("0", "a", '{"summary": "x", "limitations": ["m"]}'), ("1", "a", "{}"), ("2", "a", "{"), ("3", "a", "")], "request_id string, agent_id string, content string")
    got = {r.request_id: (r.external, r.output.summary, r.output.limitations) for r in responses.merge_responses(computed, given, "summary string, limitations array<string>").collect()}
    assert got == {"0": (True, "x", ["m"]), "1": (True, None, []), "2": (False, "own", ["l"]), "3": (False, "own", ["l"]), "4": (False, "own", ["l"])}


def test_the_newest_valid_response_is_taken(spark):
    import datetime

    at = lambda day: datetime.datetime(2024, 1, day)
    given = [("r", "a", '{"summary": "old"}', at(1)), ("r", "a", '{"summary": "new"}', at(3)), ("r", "a", "{zzz", at(9)), ("r", "a", None, at(9)), ("s", "a", "zzz{", at(1)), ("t", "a", '{"summary": "b"}', None), ("t", "a", '{"summary": "a"}', None)]
    frame = spark.createDataFrame(given, "request_id string, agent_id string, content string, received_at timestamp")
    assert {r.request_id: r.content for r in responses.newest_valid(frame).collect()} == {"r": '{"summary": "new"}', "t": '{"summary": "b"}'}
    assert responses.newest_valid(frame.limit(0)).count() == 0


def test_responses_reach_consensus_and_report(spark):
    """All six analyses by a model, in the JSON that it writes; what it leaves out is null or empty."""
    import json

    rows = analysed(spark, "q", ["a rash"], words=()).select("request_id", "question", "selected_agents", "chunks")
    said = {
        "literature-search": {"agentName": "L", "summary": "found", "topRelevantExcerpts": [{"excerpt": "e", "documentName": "d", "page": 3, "relevanceExplanation": "why"}]},
        "drug-interaction": {"summary": "inter", "findings": [{"possibleInteraction": "x with y", "severityEstimate": "moderate", "uncertaintyLevel": "low"}]},
        "adverse-reaction": {"findings": [{"adverseEvent": "rash", "affectedPopulation": "all", "confidenceLevel": "high"}]},
        "trial-summarizer": {"summary": "study", "findings": [{"studyObjective": "o", "keyFindings": "k"}]},
        "unknown": {"summary": "no"},
    }
    given = spark.createDataFrame([("r", a, json.dumps(x)) for a, x in said.items()] + [("other", "trial-summarizer", "{}")], "request_id string, agent_id string, content string")
    row = analyses.with_analyses(responses.with_responses(rows, given)).first()
    assert row.literature.top_relevant_excerpts[0].relevance_explanation == "why" and row.literature.evidence == []
    assert row.interaction.findings[0].uncertainty_level == "low" and row.adverse.findings[0].affected_population == "all" and row.trial.findings[0].key_findings == "k"
    assert row.consensus.final_consensus.startswith("study ") and row.consensus.disagreements[0].startswith("An interaction")
    assert row.report.key_findings[:3] == ["found", "inter", None] and row.report.evidence_table[0].supporting_source == "d p.3"
    assert "None" not in row.report.markdown_report and "- found" in row.report.markdown_report
    quoted = json.dumps({"evidence": [{"excerpt": "e", "documentName": "d"}, {"excerpt": "f", "documentName": "d", "section": "Methods"}]})
    given_evidence = spark.createDataFrame([("r", "literature-search", quoted)], "request_id string, agent_id string, content string")
    cited = analyses.citations(analyses.with_analyses(responses.with_responses(rows, given_evidence))).orderBy("item").collect()
    assert [(r.source, r.location, r.excerpt) for r in cited] == [("d", MESSAGES["citation.location.none"], "e"), ("d", "Methods", "f")]
    both = {"debate-consensus": {"finalConsensus": "agreed", "missingEvidence": ["gap"]}, "report-generation": {"markdownReport": "# all", "recommendedFollowUpQuestions": ["more?"]}}
    last = spark.createDataFrame([("r", a, json.dumps(x)) for a, x in both.items()], "request_id string, agent_id string, content string")
    row = analyses.with_analyses(responses.with_responses(rows, last)).first()
    assert row.consensus.final_consensus == "agreed" and row.report.markdown_report == "# all" and row.report.recommended_follow_up_questions == ["more?"] and row.report.key_findings == []
    row = analyses.with_analyses(responses.with_responses(rows.withColumn("selected_agents", F.array(F.lit("report-generation"))), given)).first()
    assert row.literature.confidence == "low" and row.report.key_findings[0] == row.literature.summary != "found"


def test_sessions_are_stored_whole(spark, tmp_path):
    from dossier.sources import storage

    docs = documents(spark, ["a rash", "b", None]).withColumn("uploaded_at", F.lit("2024-01-01").cast("timestamp"))
    rows = analysed(spark, "q", ["a rash", "b", ""])
    named = spark.createDataFrame([("r", 2, "0"), ("r", 1, "1"), ("r", 3, "gone")], "request_id string, doc_ordinal int, doc_id string")
    asked = rows.select("request_id", "question", "selected_agents", F.lit("2024-01-01").cast("timestamp").alias("requested_at"))
    made = sessions.assemble_sessions(asked, named, analyses.bundle(rows), documents=sessions.document_records(docs, texts=True))
    storage.save_sessions(made, f"{tmp_path}/s")
    read = storage.load_sessions(spark, f"{tmp_path}/s")
    assert read.collect() == made.collect() and read.schema["results"].dataType == made.schema["results"].dataType
    one = read.first()
    assert [(d.id, d.name, d.text) for d in one.documents] == [("1", "d1", "b"), ("0", "d0", "a rash"), ("gone", None, None)]
    assert one.results.report_generation.markdown_report == rows.first().report.markdown_report
    both = sessions.upsert_sessions(read, made.withColumn("status", F.lit("draft")))
    assert [r.status for r in both.collect()] == ["draft"] and both.select("results").collect() == made.select("results").collect()


def test_equal_times_are_settled_alike_on_every_run(spark):
    rows = spark.createDataFrame([("a", f"s{k}", None) for k in range(20)], "id string, status string, updated_at timestamp").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    found = {sessions.upsert_sessions(rows.limit(0), rows.repartition(n)).first().status for n in (1, 3, 7)}
    assert len(found) == 1
    saved = rows.withColumnRenamed("updated_at", "saved_at")
    assert len({sessions.most_recent(saved.repartition(n)).first().status for n in (1, 3, 7)}) == 1


def test_joins_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    from dossier.operators import broadcasts
    from dossier.plans.registry import QUERIES

    names = ("keyword_score", "keyword_score_postings", "top_chunks", "top_chunks_postings", "top_chunks_pruned")
    want = {n: sorted(QUERIES[n](spark, sf_dir).collect()) for n in names}
    monkeypatch.setattr(broadcasts, "BROADCAST_BYTES", 0)
    assert {n: sorted(QUERIES[n](spark, sf_dir).collect()) for n in names} == want


def test_both_forms_rank_alike_with_zero_scores(spark):
    requests = spark.createDataFrame([("r", "rash and zebra zebra", []), ("s", "nothing here", []), ("t", None, [])], "request_id string, question string, selected_agents array<string>")
    named = spark.createDataFrame([(r, k + 1, str(k)) for r in "rst" for k in range(4)], "request_id string, doc_ordinal int, doc_id string")
    chunks = chunk_documents(documents(spark, ["calm", "a crash of zebras " * 200, None, "x-ray"]))
    plain = retrieval.top_chunks(retrieval.score_chunks(requests, named, chunks), chunks=chunks)
    posted = retrieval.top_chunks(retrieval.score_by_postings(requests, named, chunks), chunks=chunks)
    carried = retrieval.top_chunks(retrieval.score_chunks(requests, named, chunks))
    columns = ("request_id", "rank", "chunk_id", "score", "text", "lower_text")
    rows = [sorted(df.select(*columns).collect()) for df in (plain, posted, carried)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 3 * 5 and {r.score for r in rows[0]} == {0, 6}


def test_candidates_hold_the_best_chunks_and_leave_others_out(spark):
    """Bounds of blocks, with zero scores, ties, runs that chunks cut in two, and requests of few chunks."""
    import random

    from dossier.sources.documents import block_documents

    rng = random.Random(4)
    words = ["rash", "crash", "zebra", "nausea", "calm", "x" * 40, "tension", "art", "heart"]
    texts = [" ".join(rng.choice(words[: rng.choice([1, 3, 9])]) for _ in range(rng.choice([0, 5, 900, 2500]))) for _ in range(30)] + ["calm " * 3000, None]
    docs = documents(spark, texts)
    chunks = chunk_documents(docs)
    requests = spark.createDataFrame([("r", "rash and zebra zebra art"), ("s", "nothing here"), ("t", None), ("few", "zebra heart"), ("u", "calm tension nausea")], "request_id string, question string")
    named = spark.createDataFrame([(r, k + 1, str(k)) for r in "rstu" for k in range(len(texts))] + [("few", 1, "0"), ("few", 2, "2")], "request_id string, doc_ordinal int, doc_id string")
    everything = retrieval.score_chunks(requests, named, chunks)
    for block_chars in (1500, 6000):
        some = retrieval.score_candidates(requests, named, chunks, block_documents(docs, block_chars=block_chars), block_chars=block_chars)
        best = [sorted(retrieval.top_chunks(x).select("request_id", "rank", "chunk_id", "score").collect()) for x in (everything, some)]
        assert best[0] == best[1]
        assert some.columns == everything.columns and some.exceptAll(everything).count() == 0
        assert some.count() < everything.count() / 2


def test_words_are_found_by_their_rarest_gram(spark):
    import random

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc1") for _ in range(rng.randint(1, 9))) for _ in range(600)})
    tokens = [*rng.sample(words, 40), "a", "b1", "abc", "zzz", "z", "abcabc"]
    made = spark.createDataFrame([(t, k + 1) for k, t in enumerate(dict.fromkeys(tokens))], "token string, number int")
    found = retrieval.words_with_tokens(spark.createDataFrame([(w,) for w in words], "word string"), made)
    assert sorted((r.word, r.number) for r in found.collect()) == sorted((w, k + 1) for k, t in enumerate(dict.fromkeys(tokens)) for w in words if t in w)
    numbers = sorted(r.number for r in retrieval._numbered(made.select("token")).collect())
    assert numbers == list(range(1, len(set(tokens)) + 1))
    assert retrieval.words_with_tokens(spark.createDataFrame([], "word string"), made).count() == 0
    assert retrieval.words_with_tokens(spark.createDataFrame([("a",)], "word string"), made.limit(0)).count() == 0


def test_sessions(spark):
    made = "id string, updated_at timestamp, created_at timestamp, status string"
    rows = lambda *x: spark.createDataFrame([(i, *[F_TIME[t]] * 2, s) for i, t, s in x], made)
    import datetime

    F_TIME = {t: datetime.datetime(2024, 1, t) for t in range(1, 31)}
    stored, new = rows(("a", 1, "old"), ("b", 1, "old")), rows(("a", 1, "tie"), ("c", 2, "new"), ("c", 1, "older"))
    once = sessions.upsert_sessions(stored, new)
    assert {r.id: r.status for r in once.collect()} == {"a": "tie", "b": "old", "c": "new"}
    assert sessions.upsert_sessions(once, new).exceptAll(once).count() == 0
    many = rows(*[(f"{k:02}", k, "s") for k in range(1, 27)], ("01", 30, "again")).withColumnRenamed("updated_at", "saved_at")
    kept = [r.id for r in sessions.most_recent(many).orderBy(F.desc("saved_at")).collect()]
    assert len(kept) == 25 and kept[0] == "01" and "02" not in kept


def test_stored_tables(spark, sf_dir, tmp_path):
    import json
    import pathlib

    from dossier.sources import storage, tables

    bodies = [{"request_id": "a", "body": {"question": "q", "documents": ["x", "y"], "selectedAgents": None}}, {"request_id": "b", "body": {"question": "p", "documents": []}}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, bodies)) + "\nnot json\n")
    requests, named = storage.load_requests(spark, f"{tmp_path}/in.json")
    assert {r.request_id: r.selected_agents for r in requests.collect()} == {"a": None, "b": None} and named.count() == 2
    tables.raw_documents(spark, sf_dir).write.parquet(f"{tmp_path}/docs")
    assert storage.load_documents(spark, f"{tmp_path}/docs").exceptAll(tables.documents(spark, sf_dir)).count() == 0
    storage.save_sessions(tables.saves(spark, sf_dir).drop("event_id"), f"{tmp_path}/sessions")
    assert storage.load_sessions(spark, f"{tmp_path}/sessions").filter("documents is null or selected_agents is null").count() == 0
    briefs = analysed(spark, "q", ["a rash"])
    storage.save_reports(briefs, f"{tmp_path}/reports")
    storage.save_markdown(briefs, f"{tmp_path}/markdown")
    assert spark.read.parquet(f"{tmp_path}/reports").first().confidence == "medium"
    (text,) = pathlib.Path(f"{tmp_path}/markdown/request_id=r").glob("part-*")
    assert text.read_text().strip() == briefs.first().report.markdown_report


def test_report_files(spark, tmp_path):
    """Any report is read by its place; files follow bytes."""
    from dossier.sources import report_files

    reports = [(f"r{k:03}", (f"# Ünder {k}\n\n" + "x" * (k * 10),)) for k in range(200)] + [("null", (None,)), ("empty", ("",))]
    made = spark.createDataFrame(reports, "request_id string, report struct<markdown_report:string>").repartition(3)
    report_files.save_report_files(made, f"{tmp_path}/r", file_bytes=20_000)
    index = report_files.report_index(spark, f"{tmp_path}/r")
    assert index.count() == 202 and 10 <= index.select("file").distinct().count() <= 15
    for r in index.collect():
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length).decode() == (dict(reports)[r.request_id][0] or "")
    assert {r.request_id: r.markdown for r in report_files.read_report_files(spark, f"{tmp_path}/r").collect()} == {k: v or "" for k, (v,) in reports}
    some = spark.createDataFrame([("r007",), ("r007",), ("none such",)], "request_id string")
    assert [r.request_id for r in report_files.read_report_files(spark, f"{tmp_path}/r", some).collect()] == ["r007"]
    report_files.save_report_files(made.limit(0), f"{tmp_path}/none")
    assert report_files.read_report_files(spark, f"{tmp_path}/none").count() == 0


def test_long_document_lists_are_parts(spark):
    named = spark.range(30_000).selectExpr("'big' AS request_id", "int(id + 1) AS doc_ordinal", "string(id) AS doc_id").unionByName(spark.createDataFrame([("small", 1, "x"), ("small", 2, None)], "request_id string, doc_ordinal int, doc_id string"))
    parts = sessions.document_parts(named, part=1000)
    got = {(r.id, r.part): (len(r.documents), r.documents[0].id) for r in parts.collect()}
    assert got == {**{("big", k): (1000, str(1000 * k)) for k in range(30)}, ("small", 0): (2, "x")}
    made = spark.createDataFrame([("big", ["d"]), ("small", []), ("none", [])], "id string, documents array<string>")
    assert {r.id: (r.n_documents, r.n_parts) for r in sessions.counted_parts(made, parts).collect()} == {"big": (30_000, 30), "small": (2, 1), "none": (0, 0)}


def test_numbers_run_through_blocks(spark):
    from dossier.operators.numbering import numbered

    rows = [(k, o, t) for k in ("a", None) for o, t in [(None, "x"), (7, "b"), (7, "a"), (-3, "c"), (0, "d"), (100, "e"), (15, "f")]]
    got = numbered(spark.createDataFrame(rows, "key string, o long, t string"), "key", "o", "t", block=8).collect()
    for key in ("a", None):
        assert [r.t for r in sorted((r for r in got if r.key == key), key=lambda r: r.number)] == ["x", "c", "d", "a", "b", "f", "e"]
    assert sorted(r.number for r in got) == sorted(2 * list(range(1, 8)))


def test_the_shared_folder(spark, monkeypatch):
    """A local session may do with a temporary folder, a cluster's may not; what was written can be removed."""
    import os

    from dossier.sources import shared

    table = shared.cut(spark.range(5), "five")
    folder = shared.application_dir(spark).removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(folder)
    shared.remove_tables(spark)
    assert not os.path.exists(folder)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "local-cluster[3,2,3000]", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)


def test_widths_of_nested_rows(spark):
    """The bound of broadcasts counts texts and lists inside structs, lists and maps."""
    from dossier.operators import broadcasts

    made = spark.createDataFrame([("abc", ("é", [1, 2]), [("x" * 9, 1)], {"k": "vw"}, None)], "a string, s struct<t:string,l:array<int>>, r array<struct<u:string,n:int>>, m map<string,string>, z array<string>")
    want = 16 + (3 + 16) + (16 + 2 + 16 + 2 * 8 + 16) + (16 + (16 + 9 + 16 + 8)) + (16 + 1 + 16 + 16 + 2 + 16) + 16
    assert made.select(broadcasts.row_bytes(made)).first()[0] == want
