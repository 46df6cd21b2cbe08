"""Text expressions. All are built-in column functions and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions import constants as K

NON_TERM = r"[^\p{L}\p{N}._-]+"
BLANK = r"^\s*$"


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def raw_words(text: Column) -> Column:
    return F.split(F.lower(text), NON_TERM)


def split_terms(text: Column) -> Column:
    """Search terms in written order: lower case, edges stripped of ``-._``, operators removed."""
    stripped = F.transform(raw_words(text), lambda word: F.regexp_replace(word, r"^[-._]+|[-._]+$", ""))
    return F.filter(stripped, lambda term: (term != "") & ~term.isin(*K.OPERATOR_WORDS))


def lexemes(text: Column) -> Column:
    """Search terms without English stop words, repeats kept."""
    return F.filter(split_terms(text), lambda term: ~term.isin(*K.ENGLISH_STOP_WORDS))


def keyword_query(text: Column) -> Column:
    return F.array_join(split_terms(text), " or ")


def distinct_words(text: Column) -> Column:
    """Distinct words longer than two characters, the unit of the near-duplicate measure."""
    return F.array_distinct(F.filter(raw_words(text), lambda word: F.length(word) > 2))


def content_words(text: Column) -> Column:
    return F.filter(distinct_words(text), lambda word: ~word.isin(*K.ANSWER_STOP_WORDS))


def token_count(text: Column) -> Column:
    """Whitespace tokens; the default counter."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda token: token != ""))


def sentences(text: Column) -> Column:
    """Lines and sentences without leading bullets, longer than the minimum."""
    pieces = F.split(text, r"\n+|(?<=[.!?])\s+")
    clean = F.transform(pieces, lambda piece: trim_space(F.regexp_replace(piece, r"^[-*]\s*", "")))
    return F.filter(clean, lambda sentence: F.length(sentence) > K.MIN_SENTENCE_CHARS)


def trim_space(text: Column) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set; an empty set overlaps nothing."""
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(shared / smaller)


def redact(text: Column) -> Column:
    """Masks key-shaped strings and bearer tokens."""
    keys = F.regexp_replace(text, r"\b(sk|pk|rk)-[A-Za-z0-9._*-]{8,}", "$1-<redacted>")
    return F.regexp_replace(keys, r"(?i)\bBearer\s+[A-Za-z0-9._*-]{8,}", "Bearer <redacted>")


def secret_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b(?:sk|pk|rk)-[A-Za-z0-9._*-]{8,}")) + F.regexp_count(
        text, F.lit(r"(?i)\bBearer\s+[A-Za-z0-9._*-]{8,}")
    )


def like_pattern(term: str) -> str:
    """A substring pattern for ``ilike`` in which the caller's wildcards are literal."""
    for character in ("\\", "%", "_"):
        term = term.replace(character, "\\" + character)
    return f"%{term}%"


def strip_terms(question: Column, dropped: Column) -> Column:
    """Removes whole words whose first term is in ``dropped``; adjacent punctuation stays."""
    bare_word = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"

    def keep_or_strip(piece: Column) -> Column:
        first_term = F.try_element_at(split_terms(F.regexp_extract(piece, bare_word, 2)), F.lit(1))
        return F.when(F.array_contains(dropped, first_term), F.regexp_replace(piece, bare_word, "$1$3")).otherwise(
            piece
        )

    pieces = F.regexp_extract_all(question, F.lit(r"(\s+|\S+)"), 1)
    text = F.array_join(F.transform(pieces, keep_or_strip), "")
    text = F.regexp_replace(text, r"\s{2,}", " ")
    return trim_space(F.regexp_replace(text, r"\s+([,.;:!?])", "$1"))


def highlight_pattern(question: Column) -> Column:
    """One alternation over a question's longer terms, longest first; empty when there is none."""
    terms = F.array_distinct(F.filter(split_terms(question), lambda term: F.length(term) >= K.MIN_HIGHLIGHT_CHARS))
    longest_first = F.transform(
        F.array_sort(F.transform(terms, lambda term: F.struct((-F.length(term)).alias("size"), term.alias("term")))),
        lambda entry: entry["term"],
    )
    literal = F.transform(
        longest_first,
        lambda term: F.concat(F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(K.INFLECTIONS)),
    )
    body = F.array_join(literal, "|")
    return F.when(
        F.size(terms) > 0,
        F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), body, F.lit(r")(?![\p{L}\p{N}])")),
    )


def hash_token(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token as a non-negative BIGINT."""
    codes = F.transform(F.split(token, ""), lambda character: F.ascii(character).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(K.FNV_OFFSET).cast("bigint"),
        lambda state, code: F.pmod(state.bitwiseXOR(code) * K.FNV_PRIME, F.lit(K.FNV_MODULUS).cast("bigint")),
    )


def embedding_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda token: token != "")


def normalise(vector: Column) -> Column:
    """``v / |v|`` in double precision; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda value: value.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda total, value: total + value * value))
    return F.when(norm == 0, doubles).otherwise(F.transform(doubles, lambda value: value / norm))
