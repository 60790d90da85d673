"""Quality rules: hand-set counts of a text, and the log-likelihood ratio of its hashed n-grams.

Only DataFrame functions run. Word windows of a text are compared inside its own row, so no text is exploded for them;
n-grams are exploded only into counts that the map side has already summed by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import WORD, bounded_broadcast, cut, spread

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Buckets of the two multinomials.
BUCKETS = 10_000
#: Documents below this many nats per n-gram are less likely under the target than under the corpus, clearly so.
THRESHOLD = -0.25
#: Runs of word characters, and runs of punctuation.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


def _repeated_words(windows: str, ordered: str) -> Column:
    """Words that repeated windows cover. `ordered`: (hash, place) of each window, sorted; null if none repeats."""
    same = lambda i, by: F.coalesce(F.get(F.col(ordered), i + by)["h"] == F.get(F.col(ordered), i)["h"], F.lit(False))
    return F.filter(F.col(ordered), lambda _, i: ((i > 0) & same(i, -1)) | same(i, 1))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs (text).

    Repeated windows are found by the 64-bit hashes of a text's windows: where all are distinct nothing more is done,
    else they are sorted with their places. Null texts have no words. Columns of those names are replaced, and those
    named _words, _lines, _hashes, _windows, _ordered or _places are dropped.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_lines", lines)
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    windows = hashed.withColumn(
        "_windows",
        F.transform(F.slice("_hashes", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(F.col("_hashes"), i + 1, F.lit(WINDOW)))),
    )
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = windows.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs))
    repeated = ordered.withColumn("_places", F.sort_array(F.transform(_repeated_words("_windows", "_ordered"), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.coalesce(F.get(F.col("_places"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return (
        repeated.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_words", "_lines", "_hashes", "_windows", "_ordered", "_places")
    )


def with_buckets(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds _buckets: the hash bucket of each lower-cased token and of each two tokens in a row."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    hashed = docs.withColumn("_tokens", F.transform(tokens, lambda t: F.xxhash64(t)))
    of = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    after = F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens") - 1, F.lit(0)))
    pairs = F.transform(after, lambda t, i: of(F.xxhash64(F.get(F.col("_tokens"), i), t)))
    return hashed.withColumn("_buckets", F.concat(F.transform("_tokens", of), pairs)).drop("_tokens")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ratios, an array of each bucket's log-likelihood ratio of target to corpus.

    Both multinomials are counted over whole texts: the corpus over all docs (doc_id, text), the target over those with
    a doc_id in trusted; each bucket starts from 1. Without trusted documents all ratios are as if the target were
    uniform.
    """
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("_trusted")).filter("_trusted is not null").distinct(), "trusted")
    few = bounded_broadcast(ids)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if few is None:
        # Rows without a doc_id match nothing: they are dealt by their texts, not to the one task of the null key.
        given = given.withColumn("_key", F.coalesce("doc_id", F.xxhash64("text")))
        marked = given.join(ids, (F.col("_key") == F.col("_trusted")) & F.col("doc_id").isNotNull(), "left").drop("_key")
    else:
        marked = given.join(few, F.col("doc_id") == F.col("_trusted"), "left")
    # An inner explode would have Spark test the array's size first, on the expression that makes it, for every element.
    grams = with_buckets(marked, buckets).select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode_outer("_buckets").alias("bucket")).filter("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(1).cast("long").alias("raw"), F.lit(1).cast("long").alias("target"))
    both = counts.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    one = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return one.select(F.transform("rows", lambda x: F.log(x["target"] / F.col("target")) - F.log(x["raw"] / F.col("raw"))).alias("ratios"))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text, ...) with the columns of base_counts(), llr and kept.

    llr: the mean log-likelihood ratio over a text's n-grams, so that length does not count; null for a text without
    any. Columns named _tokens or _buckets are dropped. kept: not base_failed, and llr at or above the threshold; the same for the same rows on every run.
    No documents: no rows.
    """
    found = log_ratios(docs, trusted, buckets).first().ratios  # as many numbers as buckets, whatever the corpus
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")  # folded to one constant
    scored = with_buckets(base_counts(docs), buckets)
    total = F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    return (
        scored.withColumn("llr", F.when(F.size("_buckets") > 0, total / F.size("_buckets")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
        .drop("_buckets")
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rule counts, likelihood ratio and verdict of every document."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality(docs, trusted).drop("text")
