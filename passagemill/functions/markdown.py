"""Per-document Markdown kernel: heading sections, then chunks.

Fence state, the open-heading stack and greedy packing depend on reading order, so a document is
handled by one call. Documents are independent; Spark runs the kernel over Arrow batches.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise, takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text

# A heading ends at any line end that the dot of the original rule stops at: also the two Unicode line separators.
HEADING = re.compile(r"(#{1,6})\s+([^\n\r\u2028\u2029]+?)\s*#*\s*")
FENCE = re.compile(r"\s*(`{3,}|~{3,})")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH_GAP = re.compile(r"\n\s*\n")

SECTION_TYPE = "struct<title: string, sections: array<struct<heading_path: array<string>, content: string>>>"
CHUNK_TYPE = (
    "struct<title: string, error: string, "
    "chunks: array<struct<ordinal: int, heading_path: array<string>, content: string>>>"
)

Counter = Callable[[str], int]


def whitespace_tokens(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Piece:
    path: list[str]
    content: str
    tokens: int


@dataclass(frozen=True)
class ChunkLimits:
    budget: int = K.CHUNK_BUDGET
    overlap: int = K.CHUNK_OVERLAP
    minimum: int = K.CHUNK_MINIMUM


def heading_lines(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """``(line number, level, text)`` of every heading outside a code fence."""
    fence = ""
    for number, line in enumerate(lines):
        if marker := FENCE.match(line):
            character = marker[1][0]
            if not fence:
                fence = character
            elif fence == character:
                fence = ""
        elif not fence and (heading := HEADING.fullmatch(line)):
            yield number, len(heading[1]), heading[2].strip()


def read_sections(body: str) -> tuple[str | None, list[tuple[list[str], str]]]:
    """The title and the non-empty stretches between headings with their ancestor headings."""
    lines = body.replace("\r\n", "\n").split("\n")
    title: str | None = None
    marks: list[tuple[int, list[str]]] = [(-1, [])]
    above: dict[int, str] = {}
    for number, level, text in heading_lines(lines):
        if level == 1 and title is None:
            title, above = text, {}
        else:
            above = {depth: name for depth, name in above.items() if depth < level} | {level: text}
        marks.append((number, [name for name in above.values() if name]))
    sections = []
    for (start, path), (end, _) in pairwise([*marks, (len(lines), [])]):
        block = lines[start + 1 : end]
        filled = [place for place, line in enumerate(block) if line.strip()]
        if filled:
            sections.append((path, "\n".join(block[filled[0] : filled[-1] + 1])))
    return title, sections


def clean_parts(gap: re.Pattern[str], text: str) -> list[str]:
    return [part for part in map(str.strip, gap.split(text)) if part]


def packed_ranges(sizes: list[int], budget: int) -> list[slice]:
    """Runs of neighbours, each closed when its next member would exceed the budget."""
    starts, total = [], 0
    for place, size in enumerate(sizes):
        if not starts or (place > starts[-1] and total + size > budget):
            starts.append(place)
            total = 0
        total += size
    return ranges_from(starts, len(sizes))


def ranges_from(starts: list[int], end: int) -> list[slice]:
    return [slice(a, b) for a, b in pairwise([*starts, end])]


def closing_sentences(text: str, budget: int, count: Counter) -> str:
    """The longest run of whole trailing sentences within the budget."""
    backwards = clean_parts(SENTENCE_GAP, text)[::-1]
    fitting = sum(1 for _ in takewhile(lambda total: total <= budget, accumulate(map(count, backwards))))
    return " ".join(backwards[:fitting][::-1]) if budget > 0 else ""


def sized_pieces(path: list[str], content: str, budget: int, limits: ChunkLimits, count: Counter) -> list[Piece]:
    """The section itself, or groups of its paragraphs and sentences with carried-over context."""
    tokens = count(content)
    if tokens <= budget:
        return [Piece(path, content, tokens)]
    units: list[str] = []
    for paragraph in clean_parts(PARAGRAPH_GAP, content):
        units += [paragraph] if count(paragraph) <= budget else clean_parts(SENTENCE_GAP, paragraph)
    groups = ["\n\n".join(units[run]) for run in packed_ranges([count(unit) for unit in units], budget)]
    carried = ["", *(closing_sentences(group, limits.overlap, count) for group in groups[:-1])]
    texts = [f"{context}\n\n{group}" if context else group for context, group in zip(carried, groups)]
    return [Piece(path, text, count(text)) for text in texts]


def joined(pieces: list[Piece], count: Counter) -> Piece:
    """One piece under the shared heading path; lower headings return to the text."""
    if len(pieces) == 1:
        return pieces[0]
    shared = os.path.commonprefix([piece.path for piece in pieces])
    parts: list[str] = []
    for piece in pieces:
        # The title is level 1 and never part of a path, so the first path entry is level 2.
        parts += [f"{'#' * level} {name}" for level, name in enumerate(piece.path, 2) if level > len(shared) + 1]
        parts.append(piece.content)
    text = "\n\n".join(parts)
    return Piece(shared, text, count(text))


def chunk_pieces(
    sections: list[tuple[list[str], str]], head_tokens: int, limits: ChunkLimits, count: Counter
) -> list[Piece]:
    floor = max(1, math.ceil(limits.budget * K.MIN_CONTENT_SHARE))
    budget = max(limits.budget - head_tokens, floor)
    sized = [piece for path, content in sections for piece in sized_pieces(path, content, budget, limits, count)]
    merged = [joined(sized[run], count) for run in packed_ranges([piece.tokens for piece in sized], budget)]
    if len(merged) < 2:
        return merged
    large = [place for place, piece in enumerate(merged) if place == 0 or piece.tokens >= limits.minimum]
    absorbed = [joined(merged[run], count) for run in ranges_from(large, len(merged))]
    if len(absorbed) > 1 and absorbed[0].tokens < limits.minimum:
        absorbed = [joined(absorbed[:2], count), *absorbed[2:]]
    return absorbed


def sections_column(body: Column) -> Column:
    def kernel(bodies: pd.Series) -> pd.DataFrame:
        parsed = [read_sections(body or "") for body in bodies]
        rows = [[{"heading_path": path, "content": content} for path, content in found] for _, found in parsed]
        return pd.DataFrame({"title": [title for title, _ in parsed], "sections": rows})

    return evaluated_once(kernel, SECTION_TYPE)(body)


def counted(texts: Column, counter: Counter = whitespace_tokens) -> Column:
    """Tokens of each text of an array by ``counter``; the default one needs no Python."""
    if counter is whitespace_tokens:
        return F.transform(texts, text.token_count)

    def kernel(lists: pd.Series) -> pd.Series:
        return lists.map(lambda values: None if values is None else [counter(value) for value in values])

    return evaluated_once(kernel, "array<int>")(texts)


def evaluated_once(kernel: Callable, result: str) -> Callable[..., Column]:
    """A vectorised function that Catalyst must not copy, as it would into a filter before an explode."""
    return F.pandas_udf(kernel, result).asNondeterministic()


def chunks_column(
    body: Column,
    subject: Column,
    tags: Column,
    limits: ChunkLimits = ChunkLimits(),
    counter: Counter = whitespace_tokens,
) -> Column:
    """Chunks of a document, or the error that kept it from being chunked."""

    def chunk_one(text: str, fallback: str, tag: str) -> tuple[str, str | None, list[dict]]:
        title = fallback
        try:
            found, sections = read_sections(text)
            title = fallback if found is None else found
            head = f"{title} [{tag}]" if tag else title
            pieces = chunk_pieces(sections, counter(head), limits, counter)
        except Exception as error:  # one bad document is quarantined, the batch goes on
            return title, str(error) or type(error).__name__, []
        return title, None, [
            {"ordinal": ordinal, "heading_path": piece.path, "content": piece.content}
            for ordinal, piece in enumerate(pieces)
        ]

    def kernel(bodies: pd.Series, subjects: pd.Series, tag_lists: pd.Series) -> pd.DataFrame:
        rows = [chunk_one(*row) for row in zip(bodies, subjects, tag_lists)]
        return pd.DataFrame(rows, columns=["title", "error", "chunks"])

    return evaluated_once(kernel, CHUNK_TYPE)(body, subject, tags)
