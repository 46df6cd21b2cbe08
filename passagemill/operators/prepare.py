"""Corpus preparation: path and body attributes, sections, chunks, breadcrumbs, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import markdown, text

SEPARATOR = " · "


def path_metadata(df: DataFrame, path: str = "source_path") -> DataFrame:
    """Adds ``doc_type`` (singular parent folder), ``date_text`` and ``subject`` from the path."""
    segments = F.filter(F.split(F.col(path), "/"), lambda segment: segment != "")
    filename = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    folder = F.when(F.size(segments) >= 2, F.try_element_at(segments, F.lit(-2)))
    basename = F.regexp_replace(filename, r"\.[^.]+$", "")
    date = F.nullif(F.regexp_extract(basename, r"^(\d{4}-\d{2}(?:-\d{2})?)(?:[-_]|$)", 1), F.lit(""))
    rest = F.when(date.isNull(), basename).otherwise(
        F.regexp_replace(F.expr("substring(basename, length(date_text) + 1)"), "^[-_]", "")
    )
    return (
        df.withColumn("basename", basename)
        .withColumn("date_text", date)
        .withColumn("doc_type", F.regexp_replace(folder, "s$", ""))
        .withColumn("subject", F.coalesce(F.nullif(rest, F.lit("")), F.col("basename")))
        .drop("basename")
    )


def document_attributes(df: DataFrame, subject: str = "subject", body: str = "body") -> DataFrame:
    """Adds ``version`` from the subject and ``lifecycle`` from the first three non-blank lines."""
    dotted = F.nullif(F.regexp_extract(F.col(subject), r"-(\d+(?:\.\d+)+)$", 1), F.lit(""))
    simple = F.nullif(F.regexp_extract(F.col(subject), r"(?i)-v(\d+)$", 1), F.lit(""))
    filled = F.filter(text.lines(F.col(body)), lambda line: ~line.rlike(text.BLANK))
    opening = F.lower(F.array_join(F.slice(filled, 1, 3), " "))
    return df.withColumn("version", F.coalesce(dotted, simple)).withColumn(
        "lifecycle",
        F.when(opening.contains("deprecated") | opening.contains("superseded"), "deprecated").when(
            opening.contains("current"), "current"
        ),
    )


def doc_date(df: DataFrame, date_text: str = "date_text") -> DataFrame:
    """Adds ``doc_date``; a year and month stand for the first day of that month."""
    value = F.col(date_text)
    full = F.when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01"))).otherwise(value)
    return df.withColumn("doc_date", full.try_cast("date"))


def front_matter(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``metadata``, ``body`` and ``unsupported_lines``; texts without a closed block keep their body."""
    lines = text.lines(F.col(content))
    is_fence = F.transform(lines, lambda line: line.rlike(r"^---[ \t]*$"))
    # Position of the closing fence among the lines behind the first one; 0 when there is none.
    closing = F.when(
        F.col(content).rlike(r"^---[ \t]*(?:\r?\n|$)"),
        F.array_position(F.slice(is_fence, F.lit(2), F.size(lines)), F.lit(True)),
    ).otherwise(F.lit(0))
    framed = df.withColumn("closing", closing.cast("int"))
    block = F.filter(
        F.slice(lines, F.lit(2), F.greatest(F.col("closing") - 1, F.lit(0))),
        lambda line: ~line.rlike(r"^\s*(#|$)"),
    )
    framed = framed.withColumn("block", F.when(F.col("closing") > 0, block).otherwise(F.array().cast("array<string>")))
    pair = r"(?s)^([^\s:][^:]*):(.*)$"
    entries = F.transform(
        F.filter("block", lambda line: line.rlike(pair)),
        lambda line: F.struct(
            text.trim_space(F.regexp_extract(line, pair, 1)).alias("key"),
            unquoted(text.trim_space(F.regexp_extract(line, pair, 2))).alias("value"),
        ),
    )
    framed = framed.withColumn("entries", entries)
    last = F.filter(
        "entries",
        lambda entry, place: ~F.exists(
            F.slice("entries", place + 2, F.size("entries")), lambda later: later["key"] == entry["key"]
        ),
    )
    return (
        framed.withColumn("metadata", F.map_from_entries(last))
        .withColumn("unsupported_lines", F.filter("block", lambda line: ~line.rlike(pair)))
        .withColumn(
            "body",
            F.when(
                F.col("closing") > 0, F.array_join(F.slice(lines, F.col("closing") + 2, F.size(lines)), "\n")
            ).otherwise(F.col(content)),
        )
        .drop("closing", "block", "entries")
    )


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def document_tags() -> Column:
    """``doc_type · date · subject`` without absent parts."""
    present = F.filter(F.array("doc_type", "date_text", "subject"), lambda tag: tag.isNotNull() & (tag != ""))
    return F.array_join(present, SEPARATOR)


def breadcrumb(title: Column, heading_path: Column) -> Column:
    tags = document_tags()
    head = F.when(tags != "", F.concat(title, F.lit(" ["), tags, F.lit("]"))).otherwise(title)
    return F.array_join(F.concat(F.array(head), heading_path), " > ")


def embedded_text(breadcrumb_text: Column, content: Column) -> Column:
    return F.concat(breadcrumb_text, F.lit("\n\n"), content)


def sections(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per heading section: ``title``, ``section_no``, ``heading_path`` and ``content``."""
    kept = [column for column in df.columns if column not in (body, "content")]
    parsed = df.select(*kept, markdown.sections_column(F.col(body)).alias("parsed"))
    return parsed.select(
        *kept,
        F.coalesce("parsed.title", "subject").alias("title"),
        F.posexplode("parsed.sections").alias("section_no", "section"),
    ).select(*kept, "title", "section_no", "section.heading_path", "section.content")


def chunked_documents(
    df: DataFrame,
    limits: markdown.ChunkLimits = markdown.ChunkLimits(),
    counter: markdown.Counter = markdown.whitespace_tokens,
) -> DataFrame:
    """Adds ``title``, ``chunk_error`` and the ``chunks`` array to prepared documents, without a shuffle."""
    parsed = df.withColumn(
        "parsed",
        markdown.chunks_column(F.col("body"), F.col("subject"), document_tags(), limits, counter),
    )
    return (
        parsed.withColumn("title", F.col("parsed.title"))
        .withColumn("chunk_error", F.col("parsed.error"))
        .withColumn("chunks", F.col("parsed.chunks"))
        .drop("parsed")
    )


def chunk_rows(df: DataFrame, counter: markdown.Counter = markdown.whitespace_tokens) -> DataFrame:
    """One row per chunk of ``chunked_documents`` with ids, breadcrumb, embedded text and token count by ``counter``."""
    return (
        df.select("source_path", "doc_type", "date_text", "subject", "title", F.explode("chunks").alias("chunk"))
        .select("*", "chunk.ordinal", "chunk.heading_path", "chunk.content")
        .withColumn("breadcrumb", breadcrumb(F.col("title"), F.col("heading_path")))
        .withColumn("embedded_text", embedded_text(F.col("breadcrumb"), F.col("content")))
        .select(
            document_id(F.col("source_path")).alias("document_id"),
            chunk_id(F.col("source_path"), F.col("ordinal")).alias("chunk_id"),
            "source_path",
            "doc_type",
            "title",
            "ordinal",
            "heading_path",
            "breadcrumb",
            "content",
            "embedded_text",
            markdown.counted(F.array("embedded_text"), counter)[0].alias("token_count"),
        )
    )


def chunk_corpus(corpus: DataFrame, limits: markdown.ChunkLimits = markdown.ChunkLimits()) -> DataFrame:
    """Chunks of a raw ``(source_path, content)`` corpus."""
    return chunk_rows(chunked_documents(front_matter(path_metadata(corpus)), limits))


def whole_text_chunks(corpus: DataFrame) -> DataFrame:
    """The one-chunk form: each text is a single passage titled by its subject."""
    named = path_metadata(corpus).withColumn("title", F.col("subject"))
    whole = F.struct(
        F.lit(0).alias("ordinal"), F.array().cast("array<string>").alias("heading_path"), F.col("content")
    )
    return chunk_rows(named.withColumn("chunks", F.array(whole)))


def document_id(path: Column) -> Column:
    return F.sha2(path, 256)


def chunk_id(path: Column, ordinal: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("#"), ordinal.cast("string")), 256)


def token_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens per document."""
    return chunks.groupBy("source_path").agg(
        F.count("*").alias("chunks"), F.sum("token_count").cast("bigint").alias("token_count")
    )


def redact_secrets(df: DataFrame, column: str = "content") -> DataFrame:
    """Masks key-shaped text and adds ``secrets``, the number of masked places."""
    return df.withColumn("secrets", text.secret_count(F.col(column)).cast("bigint")).withColumn(
        column, text.redact(F.col(column))
    )


def secret_hits(df: DataFrame, column: str = "content", by: str = "source") -> DataFrame:
    scanned = df.select(by, text.secret_count(F.col(column)).alias("secrets"))
    return scanned.groupBy(by).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("secrets") > 0).alias("documents_with_secrets"),
        F.sum("secrets").cast("bigint").alias("secrets"),
    )


def corpus_profile(prepared: DataFrame) -> DataFrame:
    """Token distribution, sections, headings, fences and front matter per document kind.

    ``prepared`` has ``doc_type``, ``content``, ``body`` and ``metadata``.
    """
    measured = prepared.select(
        "doc_type",
        text.token_count(F.col("body")).alias("tokens"),
        F.regexp_count("body", F.lit(r"(?m)^#{1,6}\s+\S")).alias("headings"),
        F.regexp_count("body", F.lit(r"(?m)^#{2}\s+\S")).alias("second_level"),
        F.regexp_count("body", F.lit(r"(?m)^\s*(`{3,}|~{3,})")).alias("fence_lines"),
        (F.size("metadata") > 0).alias("has_front_matter"),
    )
    return measured.groupBy("doc_type").agg(
        F.count("*").alias("documents"),
        F.min("tokens").alias("min_tokens"),
        F.percentile("tokens", F.lit(0.5)).alias("p50_tokens"),
        F.percentile("tokens", F.lit(0.9)).alias("p90_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.sum("headings").cast("bigint").alias("headings"),
        F.sum("second_level").cast("bigint").alias("second_level_headings"),
        F.sum("fence_lines").cast("bigint").alias("fence_lines"),
        F.count_if("has_front_matter").alias("with_front_matter"),
    )


def section_profile(section_rows: DataFrame) -> DataFrame:
    """Sections and their token distribution by heading depth."""
    measured = section_rows.select(
        F.size("heading_path").alias("depth"), text.token_count(F.col("content")).alias("tokens")
    )
    return measured.groupBy("depth").agg(
        F.count("*").alias("sections"),
        F.min("tokens").alias("min_tokens"),
        F.percentile("tokens", F.lit(0.5)).alias("p50_tokens"),
        F.max("tokens").alias("max_tokens"),
    )


def line_counts(df: DataFrame, by: str = "source", column: str = "content") -> DataFrame:
    """Occurrences of each non-blank line per group; combined map-side, so a repeated line is no hot key."""
    found = df.select(by, F.explode(text.lines(F.col(column))).alias("line"))
    return found.where(~F.col("line").rlike(text.BLANK)).groupBy(by, "line").agg(F.count("*").alias("n"))


def line_duplication(df: DataFrame, by: str = "source", column: str = "content") -> DataFrame:
    """Total and distinct lines per group and the most repeated line."""
    return line_counts(df, by, column).groupBy(by).agg(
        F.sum("n").alias("total_lines"),
        F.count("*").alias("distinct_lines"),
        F.max("n").alias("top_repeats"),
    )


def repeated_lines(df: DataFrame, limit: int, column: str = "content") -> DataFrame:
    """The most repeated lines of the corpus with the number of their occurrences."""
    counted = line_counts(df.withColumn("scope", F.lit(1)), "scope", column)
    return counted.select("line", "n").orderBy(F.desc("n"), "line").limit(limit)
