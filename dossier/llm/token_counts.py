"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import spread
from dossier.llm.word_tokens import by_bytes

#: Pre-tokens in a leaf; a leaf that has grown to four times as many is divided.
LEAF = 64
#: Bytes of texts that are taken at once; a longer text is alone.
PART_BYTES = 4 << 20
_REMEMBER = 200_000

COUNTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("leaf_chars", T.ArrayType(T.LongType())),
        T.StructField("leaf_tokens", T.ArrayType(T.LongType())),
    ]
)
EDITED = T.StructType(
    [*COUNTED.fields, T.StructField("n_edits", T.LongType()), T.StructField("tokens_before", T.LongType()), T.StructField("tokens_after", T.LongType()), T.StructField("reencoded_chars", T.LongType())]
)


class PieceCounter:
    """Splits text into pre-tokens and counts each one's tokens; remembers recent pre-tokens."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > _REMEMBER:
                self.known = {}
            found = self.known[piece] = len(self.encoding._encode_single_piece(piece))
        return found

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each LEAF pre-tokens of a text."""
        pieces = self.pattern.findall(text)
        chars, tokens = list(map(len, pieces)), list(map(self.count, pieces))
        steps = range(0, len(pieces), LEAF)
        return [sum(chars[k : k + LEAF]) for k in steps], [sum(tokens[k : k + LEAF]) for k in steps]


@functools.lru_cache(maxsize=1)
def piece_counter(ranks_path: str) -> PieceCounter:
    return PieceCounter(ranks_path)


class SumTree:
    """Subtree sums over leaves, in one list: node k has children 2k and 2k + 1."""

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def __getitem__(self, leaf: int) -> int:
        return self.sums[self.size + leaf]

    @property
    def total(self) -> int:
        return self.sums[1]

    def put(self, leaf: int, value: int) -> None:
        """Sets a leaf, and the sums above it."""
        k = self.size + leaf
        change = value - self.sums[k]
        while k and change:
            self.sums[k] += change
            k //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds position `at` of the total, and where the leaf starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.sums[k]:
                start += self.sums[k]
                k += 1
        return k - self.size, start


class CountedText:
    """A text with its trees of characters and tokens."""

    def __init__(self, counter: PieceCounter, text: str, leaf_chars: list[int], leaf_tokens: list[int]):
        self.counter, self.text, self.reencoded = counter, text, 0
        self._plant(leaf_chars, leaf_tokens)

    def _plant(self, leaf_chars: list[int], leaf_tokens: list[int]) -> None:
        self.n_leaves = len(leaf_chars)
        self.chars, self.tokens = SumTree(leaf_chars), SumTree(leaf_tokens)

    def leaves(self) -> tuple[list[int], list[int]]:
        both = [(self.chars[k], self.tokens[k]) for k in range(self.n_leaves) if self.chars[k]]
        return [c for c, _ in both], [t for _, t in both]

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces `length` characters from `start`; what lies outside the text is left out.

        A pre-token's end depends on what stands before it and on the next two characters: white space ends one before
        the last of a run if a character of another kind follows, and an apostrophe is alone unless one or two letters
        make it a contraction. So the split is the same up to the start of the leaf that holds the second character
        before the edit, and again from the first end of a leaf behind the edit at which the new split has an end too:
        only between them is text split and encoded anew.
        """
        n = len(self.text)
        start = min(max(0, start), n)
        stop = min(n, start + max(0, length))
        self.text = self.text[:start] + replacement + self.text[stop:]
        if not self.n_leaves:
            self._plant(*self.counter.leaves(self.text))
            self.reencoded += len(self.text)
            return
        first, begin = self.chars.find(min(max(0, start - 2), n - 1))
        last, old_end = first, begin + self.chars[first]
        shift = len(replacement) - (stop - start)
        pieces: list[int] = []
        counts: list[int] = []
        at = begin
        for match in self.counter.pattern.finditer(self.text, begin):
            pieces.append(match.end() - match.start())
            counts.append(self.counter.count(match.group()))
            at = match.end()
            if at >= start + len(replacement):
                while (old_end < stop or old_end + shift < at) and last + 1 < self.n_leaves:
                    last += 1
                    old_end += self.chars[last]
                if old_end >= stop and old_end + shift == at:
                    break
        else:
            last = self.n_leaves - 1
        self.reencoded += at - begin
        if len(pieces) <= 4 * LEAF:
            self.chars.put(first, sum(pieces))
            self.tokens.put(first, sum(counts))
            for leaf in range(first + 1, last + 1):
                self.chars.put(leaf, 0)
                self.tokens.put(leaf, 0)
            return
        steps = range(0, len(pieces), LEAF)
        chars = [self.chars[k] for k in range(self.n_leaves)]
        tokens = [self.tokens[k] for k in range(self.n_leaves)]
        chars[first : last + 1] = [sum(pieces[k : k + LEAF]) for k in steps]
        tokens[first : last + 1] = [sum(counts[k : k + LEAF]) for k in steps]
        self._plant(chars, tokens)


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text, and the leaves of its trees: characters and tokens of every LEAF pre-tokens.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no leaves, and texts may be of any length.
    Rows that share a doc_id, or have none, are documents of their own. No documents: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(ranks_path)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                both = [counter.leaves(text) if text else ([], []) for text in part.column(1).to_pylist()]
                leaves = [pa.array([x[i] for x in both], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *leaves], names=COUNTED.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, COUNTED)


def apply_edits(counted: DataFrame, ranks_path: str) -> DataFrame:
    """Texts and trees of counted (as by count_tokens(), with edits) after their edits.

    edits: array of (start, length, replacement), in characters (code points), each on the text as the one before left
    it; null for none. tokens_before and tokens_after are the roots' sums; reencoded_chars is what was split and encoded
    anew. A null text counts as empty; null numbers as 0, a null replacement as empty. Repeated rows are edited each
    for itself.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(ranks_path)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                rows = []
                for row in part.to_pylist():
                    counted_text = CountedText(counter, row["text"] or "", row["leaf_chars"] or [], row["leaf_tokens"] or [])
                    before, edits = counted_text.tokens.total, row["edits"] or []
                    for x in edits:
                        counted_text.edit(x["start"] or 0, x["length"] or 0, x["replacement"] or "")
                    chars, tokens = counted_text.leaves()
                    rows.append((row["doc_id"], counted_text.text, chars, tokens, len(edits), before, counted_text.tokens.total, counted_text.reencoded))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=EDITED.names)

    return counted.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(edit, EDITED)


def revisions(counted: DataFrame) -> DataFrame:
    """Adds edits: three revisions of each text, at places and of lengths drawn from its doc_id, with its own words."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    draw = lambda what, below: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(what)), below)

    def revision(k: int):
        taken = F.substr(F.col("text"), (draw(f"from{k}", n + 1) + 1).cast("int"), draw(f"take{k}", F.lit(60)).cast("int"))
        return F.struct(draw(f"start{k}", n + 1).cast("long").alias("start"), draw(f"length{k}", F.lit(40)).cast("long").alias("length"), F.coalesce(taken, F.lit("")).alias("replacement"))

    return counted.withColumn("edits", F.array(*map(revision, range(3))))


def op6_edited_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three revisions."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), ranks)
    return apply_edits(revisions(counted), ranks).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "n_edits", "tokens_before", "tokens_after", "reencoded_chars")
