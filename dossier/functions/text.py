"""Column functions over text. All are built-in expressions; none needs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.values import PAGE_CHARS, STOP_WORDS, WIDE, WS, WS_LATIN


def sanitize(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null is empty."""
    given = F.coalesce(text, F.lit(""))
    one_space = F.when(F.regexp_like(given, F.lit(WIDE)), F.regexp_replace(given, WS, " ")).otherwise(F.regexp_replace(given, WS_LATIN, " "))
    return F.trim(one_space)


def strip(text: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + WS, ""), WS + "$", "")


def pages_of(chars: Column) -> Column:
    """Estimated pages of so many characters, or the page at an offset: at least 1."""
    return F.greatest(F.lit(1), F.ceil(chars / PAGE_CHARS)).cast("int")


def excerpt(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def section_label(page: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string")))


def source_label(name: Column, page: Column) -> Column:
    return F.concat(name, F.lit(" p."), F.coalesce(page.cast("string"), F.lit("n/a")))


def lead_sentences(text: Column, n: int = 2) -> Column:
    """The first n sentences: text is cut after ., ! or ? where white space follows."""
    sentences = F.filter(F.split(text, "(?<=[.!?])" + WS), lambda x: x != "")
    return F.array_join(F.slice(sentences, 1, n), " ")


def tokenize(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased runs of a-z and 0-9 without stop words; order and repeats are kept. Null has none."""
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: (x != "") & ~F.array_contains(stop, x))


def token_weight(token: Column) -> Column:
    return F.when(F.char_length(token) > 6, 3).otherwise(2)


def keyword_score(tokens: Column, lower_text: Column) -> Column:
    """Sum of the weights of the tokens that the text contains; a repeated token counts again."""
    return F.aggregate(tokens, F.lit(0), lambda score, t: score + F.when(F.contains(lower_text, t), token_weight(t)).otherwise(0))


def contains_any(lower_text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text contains one of a few words anywhere."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lower_text, F.lit(word))
    return found
