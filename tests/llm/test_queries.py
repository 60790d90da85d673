"""Registered queries against SQL, or against brute force, on the smallest tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from dossier.llm.queries import ORACLE_SQL, QUERIES
from tests.oracles import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    """Every registered query, as it is registered."""
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_repeated_bytes(spark, sf_dir, texts):
    data = {k: t.encode() for k, t in texts.items()}
    starts = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for r in QUERIES["op4_repeated_bytes"](spark, sf_dir).collect():
        b = data[r.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if starts[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_edited_token_counts(spark, sf_dir, texts):
    from dossier.llm import token_counts as t

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter = t.PieceCounter(ranks)
    edited = t.apply_edits(t.revisions(t.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks)), ranks)
    n = 0
    for r in edited.collect():
        assert r.tokens_before == len(counter.encoding.encode_ordinary(texts[r.doc_id]))
        assert r.tokens_after == len(counter.encoding.encode_ordinary(r.text)) == sum(r.leaf_tokens)
        assert sum(r.leaf_chars) == len(r.text)
        n += r.text != texts[r.doc_id]
    assert n > len(texts) // 2


def test_quality_rules(spark, sf_dir, texts):
    rows = QUERIES["op8_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        words = WORD.findall(t)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= -0.25)


def test_likelihood_ratios_equal_counts_by_hand(spark, sf_dir, texts):
    """llr from tokens and buckets counted in plain Python, with Spark's hash of strings and of pairs of longs."""
    import math
    import unicodedata

    from dossier.llm import quality as q
    from pyspark.sql import functions as F

    kind = lambda c: "w" if c == "_" or unicodedata.category(c)[0] in "LMN" else "s" if c.isspace() else "p"

    def tokens(text):
        out, last = [], "s"
        for c in text.lower():
            k = kind(c)
            if k != "s":
                out = [*out[:-1], out[-1] + c] if k == last else [*out, c]
            last = k
        return out

    own = {k: tokens(t) for k, t in sorted(texts.items())[:60]}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isin(list(own)))
    trusted = spark.createDataFrame([(k,) for k in sorted(own)[::3]], "doc_id long")
    words = sorted({t for ts in own.values() for t in ts})
    hashed = dict(spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect())
    pairs = sorted({(hashed[a], hashed[b]) for ts in own.values() for a, b in zip(ts, ts[1:])})
    of_pair = {(r.a, r.b): r.h % q.BUCKETS for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    buckets = {k: [hashed[t] % q.BUCKETS for t in ts] + [of_pair[hashed[a], hashed[b]] for a, b in zip(ts, ts[1:])] for k, ts in own.items()}
    raw, target = collections.Counter(range(q.BUCKETS)), collections.Counter(range(q.BUCKETS))
    for k, bs in buckets.items():
        raw.update(bs)
        target.update(bs if k in sorted(own)[::3] else ())
    n_raw, n_target = raw.total(), target.total()
    for r in q.quality(docs, trusted).collect():
        bs = buckets[r.doc_id]
        want = sum(math.log(target[b] / n_target) - math.log(raw[b] / n_raw) for b in bs) / len(bs) if bs else None
        assert r.llr == (pytest.approx(want, abs=1e-9) if bs else None), r.doc_id
        assert r.kept == (not r.base_failed and r.llr is not None and r.llr >= q.THRESHOLD)


def test_quality_keeps_good_and_drops_bad_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality_rules"](spark, sf_dir).collect() if r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_toxicity_scores(spark, sf_dir, texts):
    rows = QUERIES["op3_toxicity_scores"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def score_by_hand(machine, text):
    """A score from the machine's terms, weights and factors, summed term by term and pair by pair in plain Python."""
    import math

    from dossier.llm import toxicity as t

    at = {int(x): k for k, x in enumerate(machine.terms)}
    words = {w.strip(t._EDGES) for w in (text or "").lower().split()} - {""}
    buckets = {b for w in words for b in (zlib.crc32(w.encode()) % t.BUCKETS, *(zlib.crc32(w[:n].encode(), n) % t.BUCKETS for n in t.BEGINNINGS if len(w) >= n))}
    found = sorted(at[b] for b in buckets if b in at)
    factors = machine.factors.tolist()
    margin = machine.bias + sum(machine.weights[k] for k in found)
    margin += sum(sum(x * y for x, y in zip(factors[a], factors[b])) for i, a in enumerate(found) for b in found[:i])
    return 1 / (1 + math.exp(-max(-30, min(30, margin))))


def test_toxicity_scores_equal_the_machine_by_hand(spark, sf_dir, texts):
    from dossier.llm import toxicity as t

    machine = t.train_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in QUERIES["op3_toxicity_scores"](spark, sf_dir).collect()}
    for doc_id, text in list(texts.items())[::4]:
        assert scores[doc_id] == pytest.approx(score_by_hand(machine, text), abs=1e-6)


def test_toxicity_learns_what_only_pairs_say(spark):
    """Two common words, toxic if just one of them is there: neither says anything alone."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(1200):
        a, b = rng.random(2) < 0.5
        words = [f"word{x}" for x in rng.integers(0, 300, 12)] + ["mention"] * int(a) + ["insult"] * int(b)
        rows.append((k, " ".join(rng.permutation(words))))
        labels.append((k, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from dossier.llm import toxicity as t

    machine = t.train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r.score >= 0.5 for r in t.score_toxicity(docs, machine).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([scored[k] == bool(labels[k][1]) for k in held]) > 0.9
    at = {int(x): machine.factors[k] for k, x in enumerate(machine.terms)}
    assert at[zlib.crc32(b"insult") % t.BUCKETS] @ at[zlib.crc32(b"mention") % t.BUCKETS] < 0


def test_toxicity_of_held_out_rows(spark):
    """On a table with enough labels: the smallest has three toxic rows to learn from."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op3_toxicity_scores"](spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_simhash_components(spark, sf_dir, texts):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    roots = components(prints)
    for r in QUERIES["op9_simhash_components"](spark, sf_dir).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == roots[r.doc_id]


def test_links_of_close_fingerprints(spark):
    from dossier.llm.components import connected_components
    from dossier.llm.simhash import fingerprint_links, tallied_pairs

    rng = np.random.default_rng(5)
    made = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)} | {0, -1}
    for x in list(made):
        for _ in range(12):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= -(1 << 63) if b == 63 else 1 << int(b)
            made.add(y)
    fps = spark.createDataFrame([(x,) for x in made], "fp long")
    mask = (1 << 64) - 1
    links = fingerprint_links(fps)
    got = {(r.a, r.b) for r in links.collect()}
    assert got == {(a, b) for a in made for b in made if a < b and ((a ^ b) & mask).bit_count() <= 2}
    same_bytes = lambda a, b: sum((a ^ b) & mask & 0xFF << 8 * p == 0 for p in range(8))
    assert all(r.shared == same_bytes(r.a, r.b) >= 6 for r in links.collect())
    tallies = tallied_pairs(fps).collect()
    assert len({(r.a, r.b) for r in tallies}) == len(tallies) and all(r.shared == same_bytes(r.a, r.b) for r in tallies)
    assert min(r.shared for r in tallies) < 6  # the count filter has something to drop
    label = {r.node: r.root for r in connected_components(links).collect()}
    assert all(label[a] == label[b] <= min(a, b) for a, b in got)


def test_token_files(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, sf_dir).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def contains(text, item):
    """Whether the text has four fifths of the item's five-word shingles, or of its own words if they are fewer."""
    own = item.lower().split()
    width = min(5, len(own))
    cut = lambda words: {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    return bool(own) and len(cut(own) & cut(text.lower().split())) >= 0.8 * len(cut(own)) - 1e-9


def check_stages(spark, sf_dir, folder):
    """Every stage of the pipeline over a folder of tables, against what it is to do to its own input, made without it."""
    import corpus_pipeline
    from dossier.llm import mixing, toxicity
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{folder}/stage{k}")
        seen.append(spark.read.parquet(f"{folder}/stage{k}"))
    assert all(df.columns == docs.columns for df in seen[:-1])
    given, clean, single, apart, mixed, tokens = ([(r.doc_id, r.text if hasattr(r, "text") else r) for r in df.collect()] for df in seen)
    count = collections.Counter

    machine = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert count(clean) == count(x for x in given if not len(machine.terms) or score_by_hand(machine, x[1]) < 0.5)

    prints = {k: fingerprint(text or "") for k, (_, text) in enumerate(clean)}
    groups = collections.defaultdict(set)
    for k, root in components(prints).items():
        groups[root].add(clean[k])
    firsts = [{x for x in g if (x[0] is None, x[0] or 0) == min((y is None, y or 0) for y, _ in g)} for g in groups.values()]
    assert len(single) == len(groups) and all(sum(x in g for x in single) == 1 for g in firsts)

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert count(apart) == count((k, text) for k, text in single if not any(contains(text or "", item or "") for item in items))

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, source, text FROM read_parquet('{folder}/stage2/*.parquet')")
    wanted = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, repeats FROM ({mixing.OP1_SQL})").fetchall()}
    assert count(k for k, _ in mixed) == {k: n for k, n in wanted.items() if n}
    assert all((k, text) in set(apart) for k, text in mixed)

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    rows = sorted((r for _, r in tokens), key=lambda r: r.start)
    order = sorted(mixed, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [k for k, _ in order]
    for r, (_, text) in zip(rows, order):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return given, clean, single, apart, mixed


def test_pipeline(spark, sf_dir, tmp_path):
    given, clean, single, apart, _ = check_stages(spark, sf_dir, tmp_path)
    assert len(given) > len(single) > len(apart)


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, extra columns of clashing names; and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row map<string,int>, score double, `repeats` string"
    plain = [" ".join(f"{w}{n}" for n in range(30)) for w in "abcde"]
    rows = [(1, plain[0]), (2, plain[0]), (3, None), (4, ""), (5, "  \n"), (None, plain[1]), (6, " ".join(f"w{n}" for n in range(60_000))), (7, plain[2] + " one two three four five six"), (8, plain[3])]
    made = spark.createDataFrame([(k, t, None, "x" if n % 3 else None, None, {"k": n}, 1.0, None) for n, (k, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(1, "One two three four five six"), (2, None), (None, "  ")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    made.write.parquet(f"{tmp_path}/odd/documents.parquet")
    _, clean, single, apart, _ = check_stages(spark, f"{tmp_path}/odd", f"{tmp_path}/odd-stages")
    assert len(clean) == len(rows) and {k for k, _ in single} - {k for k, _ in apart} == {7}
    assert sorted((k or 0 for k, _ in single)) == [0, 1, 3, 6, 7, 8]
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/odd/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    import corpus_pipeline

    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
