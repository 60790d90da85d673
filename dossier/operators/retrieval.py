"""Scoring and ranking of chunks for many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.search import number_scores, question_lines, text_scores
from dossier.functions.text import excerpt, token_weight, tokenize
from dossier.functions.values import STOP_WORDS, TOP_CHUNKS
from dossier.operators.broadcasts import bounded_broadcast, few_or_all
from dossier.operators.bundles import bundle_words, bundled, with_found
from dossier.operators.grams import GRAM, filed, gram_counts, token_grams
from dossier.operators.numbering import numbered
from dossier.sources.documents import BLOCK_CHARS
from dossier.sources.shared import cut

#: Requests of a document in one row, about.
LISTED = 1_000
#: Blocks in which distinct words are numbered.
BLOCKS = 256


def question_tokens(requests: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """request_id, position (from 1), token and weight."""
    exploded = requests.select("request_id", F.posexplode(tokenize(F.col("question"), stop_words)).alias("pos", "token"))
    return exploded.select("request_id", (F.col("pos") + 1).alias("position"), "token", token_weight(F.col("token")).alias("weight"))


def _asked(requests: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """_request and _question, its tokens with their weights as lines of one text; a row a request."""
    lines = question_lines(tokenize(F.col("question"), stop_words), token_weight)
    return requests.groupBy(F.col("request_id").alias("_request")).agg(F.max(lines).alias("_question"))


def _scoped(request_documents: DataFrame, places: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """places (doc_id, ...), a row for each with _named, the requests of its document, and _asked, their questions.

    more: columns of both that have to be equal too.

    So a text is read once for all its requests, however many they are: only LISTED of them at a time are in one row.
    Documents with the same requests share one list of questions. Where that is small enough to broadcast, and the
    documents' lists too, nothing is shuffled; else places are joined by doc_id.
    """
    asked = cut(asked, "questions")
    parts = max(1, -(-asked.count() // LISTED))
    named = request_documents.join(few_or_all(asked.select("_request")), F.col("request_id") == F.col("_request"))
    keys = {c: f"_of_{c}" for c in ("doc_id", *more)}
    lists = named.groupBy(*(F.col(c).alias(own) for c, own in keys.items()), F.pmod(F.xxhash64("request_id"), F.lit(parts)).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("request_id", "doc_ordinal"))).alias("_named"))
    ids = F.transform("_named", lambda x: x["request_id"])
    # Lists are made once: they are measured before they are joined.
    lists = cut(lists.select(*keys.values(), "_named", F.to_json(ids).alias("_set")), "request-lists")
    each = lists.groupBy("_set").agg(F.any_value(ids).alias("_ids")).select("_set", F.posexplode("_ids").alias("_pos", "_request"))
    gathered = each.join(few_or_all(asked), "_request").groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("_pos", "_question"))).alias("_q"))
    sets = cut(gathered.select("_set", F.transform("_q", lambda x: x["_question"]).alias("_asked")), "question-sets")
    few = bounded_broadcast(sets)
    of_place = reduce(Column.__and__, (F.col(c) == F.col(own) for c, own in keys.items()))
    if few is None:
        met = places.join(lists.join(sets, "_set"), of_place)
    else:
        met = places.join(few_or_all(lists), of_place).join(few, "_set")
    return met.drop("_set", *keys.values())


def _each_request(scored: DataFrame, score: str) -> DataFrame:
    """A row for each of _named and its score, in `score`, from the list _scores."""
    kept = [c for c in scored.columns if c not in ("_named", "_scores")]
    each = scored.select(*kept, F.explode(F.arrays_zip("_named", "_scores")).alias("_one"))
    return each.select(*kept, F.col("_one._named.request_id").alias("request_id"), F.col("_one._named.doc_ordinal").alias("doc_ordinal"), F.col("_one._scores").alias(score))


def score_chunks(requests: DataFrame, request_documents: DataFrame, chunks: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Every chunk of every request, with doc_ordinal and score; chunks that score 0 stay.

    A chunk is searched once for all that its requests ask (functions/search.py).
    """
    return _searched(_scoped(request_documents, chunks, _asked(requests, stop_words)))


def _searched(scoped: DataFrame) -> DataFrame:
    return _each_request(scoped.withColumn("_scores", text_scores(F.col("_asked"), F.col("lower_text"))).drop("_asked"), "score")


def top_chunks(scored: DataFrame, k: int = TOP_CHUNKS, chunks: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best chunks of each request by score, then document order, then offset, with their rank.

    Spark keeps k rows of a request in each task before the shuffle. With chunks given, rows are ranked by their keys
    alone, what is left is written to the shared folder, and its texts are looked up; else texts are carried along, but
    the lower-cased ones. chunks: all of them, or what makes those of some documents (doc_id), so that no other is cut
    again.
    """
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "doc_ordinal", "char_offset")
    rank = F.row_number().over(best)
    if chunks is None:
        return scored.drop("lower_text").withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("lower_text", F.lower("text"))
    keys = scored.select("request_id", "doc_ordinal", "doc_id", "char_offset", "score").withColumn("rank", rank).filter(F.col("rank") <= k)
    won = cut(keys.withColumnsRenamed({"doc_id": "_doc", "char_offset": "_offset"}), "top-chunks")
    found = _chunks_of(chunks, won.select(F.col("_doc").alias("doc_id")))
    return found.join(few_or_all(won), (F.col("doc_id") == F.col("_doc")) & (F.col("char_offset") == F.col("_offset"))).drop("_doc", "_offset")


def _chunks_of(chunks: DataFrame | Callable[[DataFrame], DataFrame], named: DataFrame) -> DataFrame:
    """Chunks, those of the named documents (doc_id) at least."""
    return chunks(named.distinct()) if callable(chunks) else chunks


def top_chunks_single(scored: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """The same for one request: a top-k without a window."""
    return scored.orderBy(F.desc("score"), "doc_ordinal", "char_offset").limit(k)


def score_by_postings(requests: DataFrame, request_documents: DataFrame, chunks: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The same rows, without their texts, by way of an index of words, for large batches of questions.

    A token is in a text if and only if it is in one of the text's runs of a-z and 0-9. _numbers_of_words() finds the
    tokens that each distinct run has; each chunk then has the numbers of the tokens that its runs have, and a score
    is made of the numbers that chunk and question share. So no text is searched for a token of any request.
    """
    wanted, asked = _numbered_tokens(requests, stop_words)
    found = _with_tokens(chunks.select("chunk_id", "doc_id", "char_offset", "page", "lower_text"), wanted)
    scoped = _scoped(request_documents, found, asked)
    return _each_request(_shared(scoped), "score")


def _numbered_tokens(requests: DataFrame, stop_words: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The questions' distinct tokens with numbers, and each request's numbers and their weights, as _question."""
    tokens = question_tokens(requests, stop_words)
    wanted = few_or_all(cut(_numbered(tokens.select("token").distinct()), "question-words"))
    numbers = tokens.join(wanted, "token").groupBy(F.col("request_id").alias("_request")).agg(F.collect_list(F.struct("number", "weight")).alias("_numbers"))
    lines = F.array_join(F.transform("_numbers", lambda x: F.concat_ws(" ", x["weight"], x["number"])), "\n")
    ids = requests.select(F.col("request_id").alias("_id")).distinct()
    return wanted, ids.join(numbers, F.col("_id") == F.col("_request"), "left").select(F.col("_id").alias("_request"), lines.alias("_question"))


def _with_tokens(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """places (lower_text, ...) with _found, the numbers of the tokens that their words contain, for the text.

    Words are looked up once for a bundle of places: neither words nor their numbers are shuffled for each place.
    """
    # Texts are taken apart once: what follows reads the written words.
    rows = cut(bundled(places, "lower_text"), "place-words")
    words = bundle_words(rows)
    by_word = cut(_numbers_of_words(words.select("word").distinct(), wanted), "word-postings")
    return with_found(rows, words.join(few_or_all(by_word), F.col("word") == F.col("_word")))


def _shared(scoped: DataFrame) -> DataFrame:
    """scoped with _scores: for each question (_asked) the weights of the numbers that it shares with a place (_found)."""
    return scoped.withColumn("_scores", number_scores(F.col("_asked"), F.col("_found"))).drop("_asked", "_found")


def score_candidates(requests: DataFrame, request_documents: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], blocks: DataFrame, k: int = TOP_CHUNKS, stop_words: tuple[str, ...] = STOP_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of score_chunks() that hold the k best chunks of each request; most others are never scored.

    chunks: as for top_chunks(). blocks: as block_documents() makes them, of block_chars characters. What a block's words share with a question
    bounds the score of its chunks. The blocks with the greatest bounds are scored first, as many as have k chunks; of
    the rest those are scored whose bound, or on a tie whose place in the order of documents, is ahead of the k-th best
    chunk found so far. A request with fewer than k chunks has all of them.
    """
    wanted, asked = _numbered_tokens(requests, stop_words)
    found = _with_tokens(blocks.select("doc_id", "first_offset", "n_chunks", "lower_text"), wanted)
    scoped = _scoped(request_documents, found, asked)
    bounds = cut(_each_request(_shared(scoped), "bound").select("request_id", "doc_ordinal", "doc_id", "first_offset", "n_chunks", "bound"), "block-bounds")
    best = Window.partitionBy("request_id").orderBy(F.desc("bound"), "doc_ordinal", "first_offset")
    first = bounds.withColumn("_turn", F.row_number().over(best)).filter(F.col("_turn") <= k)  # each task keeps k of a request
    ahead = F.coalesce(F.sum("n_chunks").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cut(first.withColumn("_ahead", ahead).filter(F.col("_ahead") < k).select("request_id", "doc_ordinal", "doc_id", "first_offset"), "first-blocks")
    scored = cut(_scored_blocks(requests, chunks, first, block_chars, stop_words).select("request_id", "doc_ordinal", "doc_id", "char_offset", "score"), "first-scores")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "doc_ordinal", "char_offset")
    last = scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == k)
    last = few_or_all(last.select(F.col("request_id").alias("_request"), _place_in_order("score", "char_offset").alias("_last")))
    named = few_or_all(first.withColumnsRenamed({"request_id": "_r", "doc_ordinal": "_o", "doc_id": "_d", "first_offset": "_f"}))
    rest = bounds.join(named, (F.col("request_id") == F.col("_r")) & (F.col("doc_ordinal") == F.col("_o")) & (F.col("doc_id") == F.col("_d")) & (F.col("first_offset") == F.col("_f")), "left_anti")
    rest = rest.join(last, F.col("request_id") == F.col("_request"), "left")
    rest = rest.filter(F.col("_last").isNull() | (_place_in_order("bound", "first_offset") < F.col("_last")))
    both = cut(rest.select("request_id", "doc_ordinal", "doc_id", "first_offset").unionByName(first), "candidate-blocks")
    return _scored_blocks(requests, chunks, both, block_chars, stop_words)


def _place_in_order(score: str, offset: str) -> Column:
    """Less for what ranks before."""
    return F.struct((-F.col(score)).alias("score"), F.col("doc_ordinal").alias("ordinal"), F.col(offset).alias("offset"))


def _scored_blocks(requests: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], chosen: DataFrame, block_chars: int, stop_words: tuple[str, ...]) -> DataFrame:
    """score_chunks() of the chunks of chosen (request_id, doc_ordinal, doc_id, first_offset) blocks."""
    blocks = _chunks_of(chunks, chosen.select("doc_id")).withColumn("first_offset", F.col("char_offset") - F.col("char_offset") % block_chars)
    return _searched(_scoped(chosen, blocks, _asked(requests, stop_words), "first_offset").drop("first_offset"))


def _numbered(tokens: DataFrame) -> DataFrame:
    """token and number, from 1 without gaps; tokens are put in order in blocks of their hash."""
    rows = tokens.select("token", F.lit(0).alias("_all"), F.pmod(F.xxhash64("token"), F.lit(BLOCKS)).alias("_part"))
    return numbered(rows, "_all", "_part", "token", block=1).select("token", F.col("number").cast("int").alias("number"))


def words_with_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """word and number of each of the tokens (token, number) that a word (word, distinct) contains; both of a-z and 0-9."""
    found = _numbers_of_words(words, tokens)
    return found.select(F.col("_word").alias("word"), F.explode("numbers").alias("number"))


def _numbers_of_words(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """_word and numbers, those of the tokens that the word contains, of words that contain some.

    An index of q-grams: a word that contains a token has all the token's grams, so the list of the rarest one of them
    has every such word, and its words are verified. A token of up to q characters is a gram itself, so its numbers are
    read off the words' grams. Lists of other grams are never made.
    """
    words = cut(words.select("word"), "words")
    counts = few_or_all(cut(gram_counts(words), "gram-counts"))
    # A token with a gram that no word has is in no word.
    rated = token_grams(tokens).join(counts, F.col("gram") == F.col("_gram"), "left")
    rarest = rated.groupBy("token", "number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("one")).filter("one.n > 0")
    rarest = cut(rarest.select("token", "number", F.col("one.gram").alias("_gram")), "rarest-grams")
    short = F.char_length("token") <= GRAM
    numbers = {r["_gram"]: r.number for r in rarest.filter(short).select("_gram", "number").collect()}  # codes of grams at most
    grams = [r["_gram"] for r in rarest.filter(~short).select("_gram").distinct().collect()]
    lists = cut(filed(words, numbers, grams), "gram-postings")
    met = lists.select(F.col("word").alias("_of"), F.explode("grams").alias("gram")).join(few_or_all(rarest.filter(~short)), F.col("gram") == F.col("_gram"))
    longer = cut(met.filter(F.contains("_of", "token")).groupBy("_of").agg(F.collect_list("number").alias("_more")), "long-tokens")
    both = F.concat("own", F.coalesce("_more", F.array().cast("array<int>")))
    return lists.join(few_or_all(longer), F.col("word") == F.col("_of"), "left").select(F.col("word").alias("_word"), both.alias("numbers")).filter(F.size("numbers") > 0)


def coverage(ranked: DataFrame) -> DataFrame:
    """Document, page and excerpt of each ranked chunk."""
    return ranked.select("request_id", "rank", "doc_name", "page", excerpt(F.col("text"), 240).alias("excerpt"))


def with_chunks(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """requests, each with its ranked chunks as one array in rank order; empty for requests without chunks.

    At most k chunks of a request are collected. All analyses are projections of this row, so they share one shuffle.
    """
    fields = F.struct("rank", "chunk_id", "doc_id", "doc_name", "page", "text", "lower_text", "score")
    gathered = ranked.groupBy(F.col("request_id").alias("_request")).agg(F.array_sort(F.collect_list(fields)).alias("_chunks"))
    joined = requests.join(gathered, F.col("request_id") == F.col("_request"), "left")
    return joined.withColumn("chunks", F.coalesce("_chunks", F.array().cast(joined.schema["_chunks"].dataType))).drop("_request", "_chunks")
