"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from dossier.llm import chat, contamination, mixing, quality, repeats, simhash, token_counts, token_store, toxicity, warc

DOCS = "doc_id long, text string, source string, target string, _row string, id long, rank int"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, None), (None, "null id here", "x"), (3, "", "y"), (4, "  \n ", "y"), (5, LONG, "x"), (6, LONG, None), (7, "a b c d e f", "z")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "r", 0, 0) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_mixing(docs, none):
    mixture = mixing.plan_mixture(docs)
    rows = mixing.with_repeats(mixture.sizes, mixture).collect()
    assert len(rows) == len(ROWS) and all(r.repeats <= 3 for r in rows if r.size)
    sources = {r.source: r for r in mixture.sources.collect()}
    assert sources["y"].source_size == 0 and sources["y"].target == 0 and None in sources
    total = sum(r.source_size for r in sources.values())
    assert abs(sum(r.target for r in sources.values()) - total) < 1e-6
    assert all(r.target <= 3 * r.source_size for r in sources.values())
    mixed = mixing.sample_mixture(docs)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.sample_mixture(docs).collect()))
    assert mixing.sample_mixture(none).count() == 0


def test_water_filling_is_the_fixed_point(spark):
    import random

    for seed in range(5):
        rng = random.Random(seed)
        sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 10_000]) for k in range(rng.randint(1, 12))}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        total, clamped = sum(sizes.values()), set()
        while True:
            free = [s for s in sizes if s not in clamped]
            left = total - sum(3 * sizes[s] for s in clamped)
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] >= 3 * sizes[s]}
            if not over:
                break
            clamped |= over
        want = {s: share.get(s, 3 * sizes[s]) for s in sizes}
        got = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3)
        assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, "a B c d e f"), (2, None), (3, ""), (4, "c d"), (5, "not in any text at all"), (1, "a B c d e f")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contamination.contained_items(docs, items).collect())
    assert got == [(1, 1)] * 4 + [(1, 4)] * 2 + [(7, 1)] * 2 + [(7, 4)]
    joined = contamination.contained_items(docs, items, index_bytes=40)
    assert sorted((r.doc_id, r.item_id) for r in joined.collect()) == got
    assert contamination.contained_items(none, items, index_bytes=0).count() == 0
    assert contamination.contained_items(none, items).count() == contamination.contained_items(docs, items.limit(0)).count() == 0
    for most in (1 << 24, 0):
        kept = contamination.drop_contaminated(docs, items, index_bytes=most)
        assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_containment_has_no_false_negatives():
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([4, 5, 6, 9, 30, 80])))) for k in range(150)]
    index = contamination.ItemIndex(items)
    texts = []
    for _, text in items:
        own = text.split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join([*rng.choices(words, k=400), *own, *rng.choices(words, k=400)]).encode())
    found = {(place, item) for place, item, _, _ in index.search(texts)}
    for place, text in enumerate(texts):
        for item, own in items:
            width = min(5, len(own.split()))
            whole = contamination.shingles(own.encode(), width)
            share = len(whole & contamination.shingles(text, width)) / len(whole)
            assert ((place, item) in found) == (share >= 0.8 - 1e-9)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    made = frame(spark, [(k, "plain words here" + (" insult" if k % 2 else ""), "x") for k in range(200)])
    machine = toxicity.train_toxicity(made, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(made, machine).collect()}
    assert min(s for k, s in scores.items() if k % 2) > 0.5 > max(s for k, s in scores.items() if not k % 2)
    odd = toxicity.score_toxicity(docs, machine)
    assert odd.count() == len(ROWS) and odd.filter("score is null").count() == 0
    assert toxicity.drop_toxic(made, machine).columns == made.columns and toxicity.drop_toxic(made, machine).count() == 100
    for nothing in (labels.limit(0), labels.filter("toxic = 0")):
        flat = toxicity.train_toxicity(made, nothing)
        assert {r.score for r in toxicity.score_toxicity(docs, flat).collect()}.__len__() == 1
    assert toxicity.score_toxicity(none, machine).count() == 0


def test_training_takes_one_row_of_an_id(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    made = frame(spark, [(1, f"insult {k}", "x") for k in range(3000)] + [(2, "plain words", "x"), (2, "plain words", "x"), (4, "other words", "x")])
    seen = []
    fit = toxicity.fit_machine

    def counted(terms, rows, given, *more):
        seen.append(len(given))
        return fit(terms, rows, given, *more)

    toxicity.fit_machine = counted
    try:
        toxicity.train_toxicity(made, labels, sample_rows=10)
    finally:
        toxicity.fit_machine = fit
    assert seen == [3]


def test_machine_learns_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        present = rng.random(6) < 0.5
        rows.append(np.flatnonzero(present))
        labels.append(float(present[0] and present[1]))
    machine = toxicity.fit_machine(np.arange(6), rows, np.array(labels), steps=600)
    margins = machine.margins(np.concatenate(rows), np.array([len(r) for r in rows]))
    assert np.mean((margins > 0) == np.array(labels)) > 0.98
    assert machine.factors[0] @ machine.factors[1] > 1


def test_repeats(spark, docs, none):
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in repeats.without_repeats(docs).collect())
    assert [(a, b, c) for a, b, c in got if a in (5, 6)] == [(5, len(LONG), 0), (6, len(LONG), 0)]
    assert len(got) == len(ROWS) and all(b == c for a, b, c in got if a not in (5, 6))
    assert repeats.without_repeats(none).count() == 0
    block = "".join(chr(97 + k * k % 23) for k in range(199))
    twice = frame(spark, [(1, block + "é", "x"), (2, block + "èx", "x"), (3, "y" + block, "x"), (4, "z" + block, "x"), (9, "q" * 201, "x")])
    assert {r.doc_id: len(r.kept) for r in repeats.without_repeats(twice).collect()} == {1: 1, 2: 2, 3: 200, 4: 200, 9: 0}


def test_periodic_texts_and_many_equal_rows(spark):
    """A text of one byte, a short period, both between other texts, and a text that many rows have."""
    import random

    rng = random.Random(8)
    prose = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, "a" * 300_000, "x"), (2, prose[:700] + "abc" * 50_000 + prose[700:900], "x"), (3, prose[:250] + "a" * 400, "y"), *[(4, prose[1000:2500], "z")] * 3000]
    made = frame(spark, rows).repartition(5)
    keyed = made.select(*repeats._keyed(made), "text")
    assert repeats.anchors(keyed.filter("id < 4"), chained=True).count() < 1000 < repeats.anchors(keyed.filter("id < 4")).count()
    lists = repeats.repeated_spans(keyed).collect()
    assert {(r.id, tuple(map(tuple, r.spans))) for r in lists} == {
        (1, ((0, 300_000),)), (2, ((0, 250), (700, 150_700))), (3, ((0, 650),)), (4, ((0, 1500),)),
    }
    got = {r.doc_id: r for r in repeats.without_repeats(made).select("doc_id", "n_bytes", "kept").distinct().collect()}
    assert len(got[1].kept) == len(got[4].kept) == 0 and got[2].n_bytes == 150_900
    assert bytes(got[2].kept).decode() == prose[250:700] + prose[700:900]


def test_long_texts_are_taken_in_chunks(docs):
    keyed = docs.select(*repeats._keyed(docs), "text")
    want = {(r.id, r.th): max(0, len((r.text or "").encode()) - 199) for r in keyed.collect()}
    for chunk in (700, 5000, 1 << 22):
        seen = {}
        for r in repeats.anchors(keyed.distinct(), chunk=chunk).collect():
            seen.setdefault((r.id, r.th), []).extend(range(r.at, r.at + r.n))
        assert all(sorted(seen.get(k, [])) == list(range(n)) for k, n in want.items())


def test_frequent_anchors_are_parted(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    columns = ("doc_id", "n_bytes", "spans", "kept")
    want = sorted(repeats.without_repeats(docs).select(*columns).collect())
    monkeypatch.setattr(repeats, "KINDS", 1)
    assert sorted(repeats.without_repeats(docs).select(*columns).collect()) == want


def test_parted_anchors_equal_brute_force(spark, monkeypatch):
    """Passages of 64 to 300 bytes among other words, and near copies, with every anchor of two kinds taken as frequent."""
    import collections
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [word(n) for n in (64, 130, 199, 200, 201, 230, 300)]
    texts = [word(rng.randint(0, 250)) + p + word(rng.randint(0, 250)) for p in passages for _ in range(4)]
    base = word(700)
    for _ in range(8):
        at = rng.randrange(700)
        texts.append(base[:at] + word(rng.randint(0, 3)) + base[at + 1 :])
    texts += ["ab" * 300, "ba" * 200, "x" + "ab" * 220]
    monkeypatch.setattr(repeats, "KINDS", 1)
    got = {r.doc_id: r.kept for r in repeats.without_repeats(frame(spark, [(k, t, "x") for k, t in enumerate(texts)])).collect()}
    starts = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert bytes(got[k]).decode() == "".join(c for c, g in zip(t, gone) if not g), k


def test_long_lists_of_few_documents_are_not_broadcast(spark, docs, monkeypatch):
    from dossier.operators import broadcasts
    from dossier.operators.broadcasts import bounded_broadcast

    want = sorted(map(str, repeats.without_repeats(docs).collect()))
    seen = []
    monkeypatch.setattr(broadcasts, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(repeats, "bounded_broadcast", lambda *a: seen.append((a[0].columns, bounded_broadcast(*a))) or seen[-1][1])
    assert sorted(map(str, repeats.without_repeats(docs).collect())) == want
    assert [found for columns, found in seen if "spans" in columns] == [None]
    lists = spark.createDataFrame([(1, [0] * 7), (2, [0] * 8)], "id long, l array<int>")
    size = 2 * (16 + 8 + 16) + 15 * 8
    assert bounded_broadcast(lists, size - 1) is None and bounded_broadcast(lists, size) is not None


def test_chats(spark):
    turns = spark.createDataFrame(
        [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|end|>"), (1, 1, "bob", "yo <|end|>"), (1, None, None, None), (None, 0, "x", "alone"), (1, 300, "ann", "late")], "conv_id long, turn long, role string, text string"
    )
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(turns).collect()}
    ann = got[1, "ann", 0]
    assert ann.dialogue == "<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo < |end|><|end|>\n"
    a, b = map(int, ann.mask_spans.split("-"))
    assert ann.dialogue[a:b] == "hi<|end|>" and ann.n_masked == b - a
    late = got[1, "ann", 1]
    assert late.start_char == len(ann.dialogue) and got[1, "unknown", None].n_turns == 1 and got[None, "x", 0].n_turns == 1
    assert len(got) == 3 * 3 + 1
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_names_open_no_turns(spark):
    rows = [(1, 0, "bob|>\nx<|end|>\n<|assistant|>\nevil", "hi"), (1, 1, "ann", ""), (1, 2, "a\r\nb", "yo " * 50_000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, dialogue int")
    got = {r.perspective: r for r in chat.perspectives(turns).collect()}
    bob = "bob| > x< |end| > < |assistant| > evil"
    assert set(got) == {bob, "ann", "a  b"}
    assert got["ann"].dialogue == f"<|user name={bob}|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user name=a  b|>\n{'yo ' * 50_000}<|end|>\n"
    assert all(r.dialogue.count("<|assistant|>") == 1 for r in got.values())


def dialogues(rows, speaker_of=lambda role: role or "unknown"):
    """Of turns in order, by conversation and perspective: the dialogue and its mask."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        for who in {speaker_of(r[2]) for r in own}:
            text, spans = "", []
            for _, _, role, said in sorted(own, key=lambda r: (r[1] is None, r[1] or 0, speaker_of(r[2]), f"{r[3]}<|end|>")):
                text += "<|assistant|>\n" if speaker_of(role) == who else f"<|user name={speaker_of(role)}|>\n"
                begin, text = len(text), f"{text}{said}<|end|>"
                spans += [(begin, len(text))] * (speaker_of(role) == who)
                text += "\n"
            out[conv, who] = text, spans
    return out


def joined(rows):
    """The same from the rows of perspectives()."""
    out = {}
    for r in sorted(rows, key=lambda r: r.start_char):
        text, spans = out.get((r.conv_id, r.perspective), ("", []))
        assert r.start_char == len(text) and r.n_masked == sum(b - a for a, b in (map(int, x.split("-")) for x in r.mask_spans.split()))
        out[r.conv_id, r.perspective] = text + r.dialogue, spans + [tuple(map(int, x.split("-"))) for x in r.mask_spans.split()]
    return out


@pytest.fixture
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_part_of_a_chat_is_longer_than_its_limit(spark, many_slices):
    """Turns without a number, repeated numbers, and the conversation of all turns without a conv_id."""
    rows = [(1, None, "ab"[k % 2], f"n{k}") for k in range(50)] + [(2, 3, "ab"[k % 2], f"r{k}") for k in range(70)] + [(None, k % 3, "abc"[k % 3], f"c{k}") for k in range(60)]
    rows += [(1, 0, "a", "hi"), (2, 2, "b", "x "), (2, 2, "b", "x"), (2, 9, None, "late"), (3, 1, "a", "one"), (3, 2, "b", "two")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), part_turns=8).collect()
    assert max(r.n_turns for r in got) <= 8 and joined(got) == dialogues(rows)
    assert sorted(r.n_turns for r in got if (r.conv_id, r.perspective, r.part) == (1, "a", None)) == [2] + [8] * 6


def test_repeated_turns_without_a_number_or_conversation_stay(spark, many_slices):
    rows = [(1, None, "a", "yes")] * 21 + [(1, None, "b", "no"), (1, 0, "b", "well?"), *[(None, 0, "a", "hi")] * 3, (None, 1, "b", "yo"), (2, 0, "a", "once")]
    given = [*rows, (2, 0, "a", "once")]
    got = chat.perspectives(spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(3), part_turns=8).collect()
    assert max(r.n_turns for r in got) <= 8 and joined(got) == dialogues(rows)


def test_token_counts(spark, docs, none):
    counted = token_counts.count_tokens(docs, ranks())
    edits = "array<struct<start:long,length:long,replacement:string>>"
    same = token_counts.apply_edits(counted.withColumn("edits", F.lit(None).cast(edits)), ranks())
    assert same.count() == len(ROWS) and same.filter("tokens_before <> tokens_after").count() == 0
    odd = F.array(F.struct(F.lit(None).cast("long").alias("start"), F.lit(10**9).cast("long").alias("length"), F.lit("all new").alias("replacement")))
    new = token_counts.apply_edits(counted.withColumn("edits", odd), ranks()).collect()
    assert {(r.text, r.tokens_after) for r in new} == {("all new", 2)}
    assert token_counts.count_tokens(none, ranks()).count() == 0


def test_edits_equal_full_counts():
    import random

    counter, rng, letters = token_counts.PieceCounter(ranks()), random.Random(1), "ab  \n\t'sé1,.!ß李"
    made = lambda sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
    for _ in range(300):
        text = made([0, 1, 5, 50, 600])
        tree = token_counts.CountedText(counter, text, *counter.leaves(text))
        for _ in range(4):
            start, length, new = rng.randint(0, len(tree.text) + 2), rng.choice([0, 1, 3, 100]), made([0, 1, 4, 400])
            text = tree.text[:start] + new + tree.text[start + length :]
            tree.edit(start, length, new)
            assert tree.text == text and tree.tokens.total == len(counter.encoding.encode_ordinary(text))


@pytest.mark.parametrize("leaf", [1, 2, 64])
def test_edits_at_leaf_boundaries_equal_full_counts(monkeypatch, leaf):
    """Every offset around boundaries inside white space and contractions."""
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    counter = token_counts.PieceCounter(ranks())
    texts = ["a\n\nfoo", "a\n\n\n  foo\t\tb", "a \n \n b  c", "I'v x'l we'r'", *("w " * k + "end\n\nfoo  bar\n\n\n" for k in range(60, 66))]
    for text in texts:
        for start in range(max(0, len(text) - 20), len(text) + 1):
            for length in (0, 1, 2):
                for new in ("", " ", "\n", "\n\n", "x", "e", "l", " y", "'"):
                    tree = token_counts.CountedText(counter, text, *counter.leaves(text))
                    tree.edit(start, length, new)
                    pieces, (chars, tokens) = counter.pattern.findall(tree.text), tree.leaves()
                    ends, at = {0}, 0
                    for piece in pieces:
                        ends.add(at := at + len(piece))
                    assert tree.tokens.total == sum(tokens) == len(counter.encoding.encode_ordinary(tree.text)), (text, start, length, new)
                    assert all(sum(chars[: k + 1]) in ends for k in range(len(chars))) and sum(chars) == len(tree.text)


def test_warc(spark):
    page = "<p>" + "x" * 200
    pages = spark.createDataFrame(
        [(2, "http://a/ b", page, 1), (1, "http://a", page, 1), (1, "http://a", page, 1), (3, None, None, 1), (None, "http://n\r\nX: y", page, 1), (4, "u", "é", 1), (5, "u", "é", 1)],
        "page_id long, url string, html string, digest int",
    )
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.verified) for r in warc.archived_pages(pages).collect()), key=str)
    assert got == sorted(
        [(0, "revisit", 1, 203, True), (1, "response", None, 203, True), (1, "response", None, 203, True), (2, "revisit", 1, 203, True), (3, "response", None, 0, True), (4, "response", None, 2, True), (5, "response", None, 2, True)],
        key=str,
    )
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_long_payloads_urls_and_several_archives(spark, tmp_path):
    """Payloads above what is read at once, urls above what a head has by default, and tasks that write many archives."""
    import hashlib

    rows = [(k, "http://h/" + "ü" * n, ("<b>é" + chr(97 + k)) * size) for k, (n, size) in enumerate([(1, 200_000), (1 << 20, 3), (5, 0), (7, 90_000), (1 << 16, 1)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}", archive_bytes=100)
    assert manifest.count() == len(rows)
    got = {r.page_id: r for r in warc.read_archives(manifest, f"file://{tmp_path}").collect()}
    for page_id, url, html in rows:
        data = html.encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest, got[page_id].verified) == (len(data), hashlib.sha256(data).hexdigest(), True)
        assert got[page_id].url == url
    assert max(r.head_bytes for r in manifest.collect()) > warc.HEAD_BYTES


def test_warc_reader_is_strict():
    import gzip
    import io

    whole = warc.record(1, "u", b"payload", __import__("hashlib").sha256(b"payload").hexdigest(), None)
    first = lambda data: list(warc.read_records(io.BytesIO(data)))
    assert [r.verified for r in first(gzip.compress(whole) * 3)] == [True] * 3
    assert not first(gzip.compress(whole.replace(b"payload\r\n", b"pAyload\r\n")))[0].verified
    for broken in (gzip.compress(whole)[:-20], gzip.compress(whole[:-2]), gzip.compress(whole + b"x")):
        with pytest.raises(ValueError):
            first(broken)


def test_quality(spark, docs, none):
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    rows = {r.doc_id: r for r in quality.quality(docs, trusted).collect()}
    assert rows[2].n_words == rows[3].n_words == 0 and rows[2].base_failed and not rows[2].kept and rows[2].llr is None
    assert rows[5].n_repeat_words == rows[5].n_words == 20_000
    assert set(docs.columns) <= set(quality.quality(docs, trusted).columns)
    assert quality.quality(none, trusted).count() == 0 and quality.quality(docs, trusted.limit(0)).count() == len(ROWS)


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert of[1] == {(next(iter(of[7]))[0], 1)} and of[2] == of[3] == of[4] == {("0" * 16, 2)} and {c for _, c in of[6]} == {5}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5]
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_by_themselves(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "red orange yellow green blue")], "item_id long, text string")
    texts = {k: " ".join(f"{k}{n}" for n in range(40)) for k in "abcde"}
    leak = texts["a"] + " one two three four five six"
    docs = frame(spark, [(None, leak, "x"), (None, texts["b"], "x"), (None, texts["c"], "x"), (1, leak, "x"), (1, texts["d"], "x"), (2, texts["e"] + " red orange yellow green blue", "x")])
    for most in (1 << 24, 60):
        apart = contamination.drop_contaminated(docs, items, index_bytes=most)
        assert apart.columns == docs.columns and sorted(map(str, apart.select("doc_id", "text").collect())) == sorted(str(r) for r in docs.select("doc_id", "text").collect() if r.text in texts.values())
    docs = frame(spark, [(None, texts["a"], "x"), (None, texts["b"], "x"), (1, texts["c"], "x"), (1, texts["d"], "y"), (2, texts["d"], "x"), (3, texts["a"], "x"), (None, texts["e"], "x"), (None, texts["e"], "x")])
    assert {simhash.near_duplicates(docs).select("fp").distinct().count()} == {5}
    single = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
    assert simhash.drop_near_duplicates(docs.withColumn("m", F.create_map(F.lit("k"), "source")).withColumn("a.b", F.lit(1))).count() == 5
    assert len(single) == 5 and set(single) == {(3, texts["a"]), (None, texts["b"]), (1, texts["c"]), (1, texts["d"]), (None, texts["e"])}


def test_token_store(docs, none):
    rows = token_store.tokens_on_disk(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert token_store.tokens_on_disk(none).count() == 0


def test_codes_are_addressable():
    import io

    import numpy as np

    from dossier.llm import dac

    rng = np.random.default_rng(4)
    writer, docs = dac.Writer(), []
    for k in range(40):
        docs.append(rng.integers(0, [1, 200, 50_000, 2**32][k % 4], rng.integers(0, 900)).astype("<u4"))
        writer.add(None if k == 3 else k, docs[-1])
    out = io.BytesIO()
    writer.write(out)
    codes, flat = dac.Reader(out.getvalue()), np.concatenate(docs)
    assert codes.n_ids == len(flat) and codes.null_ids.sum() == 1
    for at in rng.integers(0, len(flat), 500).tolist():
        assert codes[at] == flat[at]
    assert all((codes.span(a, b) == d).all() for a, b, d in zip(codes.starts, codes.starts[1:], docs))
    empty = io.BytesIO()
    dac.Writer().write(empty)
    assert dac.Reader(empty.getvalue()).n_ids == 0


def test_words_equal_the_library():
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from dossier.llm.word_tokens import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remember=20)
    texts = ["Hello, World.", "it's  don't", "ΑΣ ΣΑΣ İstanbul", "x<|endoftext|>y z", "a\xa0b c\x1cd", "漢字 かな", "é é", None, "", " \n", "#tag $5.00 .", "a. b, .,", "́ͅ x"]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(texts, parts, strict=True):
            assert part.tolist() == (encoder.tokenizer.encode(text, add_special_tokens=False).ids if text else []), text


def test_suffix_order_and_common_prefixes():
    """Places and common prefixes as sorting all suffixes gives them."""
    import random

    import numpy as np

    from dossier.llm import column_bwt as c

    rng = random.Random(8)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\0\xff"[: rng.choice([2, 4])]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 7))]
        strings += strings[: rng.randint(0, 2)]
        lengths = np.array([len(s) for s in strings])
        starts = np.cumsum(lengths) - lengths
        order, common = c.suffix_order(np.frombuffer(b"".join(strings), np.uint8), starts, lengths)
        whole = {int(a) + k: s[k : k + (len(s) - k) // 4 * 4] for a, s in zip(starts, strings) for k in range(len(s) - 3)}
        assert sorted(order.tolist()) == sorted(whole)
        symbols = {p: [s[k : k + 4] for k in range(0, len(s), 4)] for p, s in whole.items()}
        found = [symbols[p] for p in order.tolist()]
        assert found == sorted(found)
        same = [0] * bool(found) + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(found, found[1:])]
        assert common.tolist() == same


def test_suffix_order_finds_repeats():
    import collections
    import random

    from dossier.llm.column_bwt import repeated_windows

    rng = random.Random(3)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 6))]
        weights, windows = [rng.choice([1, 1, 2]) for _ in strings], [len(s) - 7 for s in strings]
        seen = collections.Counter()
        for s, w, n in zip(strings, weights, windows):
            seen.update({s[i : i + 8]: 0 for i in range(n)})
            for i in range(n):
                seen[s[i : i + 8]] += w
        for s, n, got in zip(strings, windows, repeated_windows(strings, weights, windows, 8)):
            assert got.tolist() == [seen[s[i : i + 8]] >= 2 for i in range(n)]


def test_the_rest_does_without_this_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2]
    rest = [p for p in (root / "dossier").rglob("*.py") if "llm" not in p.parts]
    assert rest and not any(re.search(r"dossier\.llm|corpus_pipeline", p.read_text()) for p in rest)
