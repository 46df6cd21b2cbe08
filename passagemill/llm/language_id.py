"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text model is a mixture of letter trigrams per language, fitted on labelled rows. All other evidence is counted over
all rows, grouped, from what the text alone says: how often each language comes with each declared language and address
suffix, and how often it occurs on each host, where a host's shares are smoothed towards its suffix's and those towards
the shares of all rows. The posterior multiplies them; a row is accepted if one known language is likelier than not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.tables import apart, drop_documents, text_mark
from passagemill.session import persist_table

CELLS = 1 << 16
TRAINING_ROWS = 8_000  # the least bound of the labelled rows that the text model is fitted on
LABEL_ROWS = 500  # and of those of one label
UNKNOWN = "und"
OVERLAP = 1 / 3  # neighbouring trigrams share letters, so each counts a third
STRENGTH = 20.0  # rows that a parent's shares are worth against a host's own
BLOCK = 1 << 20

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_OPENS = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")} | {None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>|&[#\w]+;")
_ENTITY = re.compile(r"&[#\w]+;")


def visible_text(markup: str) -> str:
    """``markup`` without scripts, styles, comments, tags and entities, each a blank. What is never closed stays.

    One pass: for each kind it is remembered that no closing mark follows, so unclosed marks cost nothing more.
    """
    parts, at, looked, closed = [], 0, 0, dict.fromkeys(_CLOSES, True)
    while mark := _OPENS.search(markup, looked):
        kind = mark[1].lower() if mark[1] else None
        end = _CLOSES[kind].search(markup, mark.end()) if closed[kind] else None
        if end is None:
            closed[kind], looked = False, mark.start() + 1
            if not any(closed.values()):
                break
            continue
        parts += [markup[at : mark.start()], " "]
        at = looked = end.end()
    shown = "".join([*parts, markup[at:]])
    last = shown.rfind(">") + 1  # no tag ends after it
    return _TAG.sub(" ", shown[:last]) + _ENTITY.sub(" ", shown[last:])


def trigram_cells(text: str) -> Iterator[np.ndarray]:
    """Hash cells of all trigrams of folded letters, block by block; a trigram of blanks does not count."""
    data = np.frombuffer(b" " + text.encode() + b" ", dtype=np.uint8)
    for begin in range(0, max(len(data) - 2, 0), BLOCK):
        part = _FOLD[data[begin : begin + BLOCK + 2]].astype(np.uint32)
        key = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        key = key[(part[:-2] != 32) | (part[1:-1] != 32) | (part[2:] != 32)]
        yield ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]  # the last is UNKNOWN
    weights: np.ndarray  # log likelihood, cells x languages

    @staticmethod
    def fit(rows: DataFrame, text_col: str, lang_col: str, key: Column, most: int = TRAINING_ROWS) -> TextModel:
        """Counts trigrams of a sample of the labelled rows, bounded per label; rows without a label are left out.

        Fewer than ``2 * most`` rows are all taken. Of more, ``most`` is divided among the labels, but none gets less than
        ``LABEL_ROWS`` (or ``most``): a label with fewer than twice its part is taken whole, of another a share that is
        chosen by the hash of ``key``, with the row of the least hash, so every label is in the model.
        """
        labelled = rows.where(F.col(lang_col).isNotNull()).select(
            F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), key.alias("_key")
        )
        place = F.xxhash64("_key")
        found = labelled.groupBy("_lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
        wanted = max(most // max(len(found), 1), min(most, LABEL_ROWS))
        if sum(row.n for row in found) >= 2 * most:
            large = [row for row in found if row.n >= 2 * wanted]
            shares = rows.sparkSession.createDataFrame(
                [(row["_lang"], row.n // wanted, row.least) for row in large], "_large string, _share bigint, _least bigint"
            )
            taken = F.col("_share").isNull() | (F.pmod(place, "_share") == 0) | (place == F.col("_least"))
            labelled = labelled.join(F.broadcast(shares), F.col("_lang") == F.col("_large"), "left").where(taken)
        sample = labelled.select("_lang", "_text")

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text")):
                    own = counts.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                    for cells in trigram_cells(text.as_py() or ""):
                        own += np.bincount(cells, minlength=CELLS)
            for lang, own in counts.items():
                some = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "cell", "n"]
                )

        found = sample.mapInArrow(kernel, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
        languages = sorted(found["lang"].unique())
        weights = np.full((CELLS, len(languages) + 1), -np.log(CELLS), dtype=np.float64)
        for place, lang in enumerate(languages):
            own = np.full(CELLS, 0.1)
            rows_ = found[found["lang"] == lang]
            np.add.at(own, rows_["cell"].to_numpy(), rows_["n"].to_numpy())
            weights[:, place] = np.log(own / own.sum())
        return TextModel([*languages, UNKNOWN], weights)

    def likelihoods(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for cells in trigram_cells(text):
            total += self.weights[cells].sum(axis=0)
        return total * OVERLAP


def text_evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """Adds ``_ll`` (log likelihood of each language, relative to the best) and ``_says`` (the best) to ``rows``, drops ``_text``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [name for name in rows.columns if name != "_text"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column("_text"))
            table = np.array([known.likelihoods(visible_text(t) if markup else t) for t in texts]).reshape(-1, len(known.languages))
            table = table - table.max(axis=1, keepdims=True)
            prior = np.where(np.arange(len(known.languages)) == len(known.languages) - 1, np.log(1e-3), 0.0)
            says = [known.languages[i] for i in (table + prior).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(table.tolist(), pa.list_(pa.float64())), pa.array(says, pa.string())],
                [*names, "_ll", "_says"],
            )

    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in names)
    return rows.mapInArrow(kernel, f"{kinds}, _ll array<double>, _says string")


def _shares(table: DataFrame, by: list[str], languages: list[str]) -> DataFrame:
    """``by`` and, as an array, how many rows say each language."""
    counts = [F.count_if(F.col("_says") == lang).cast("double") for lang in languages]
    return table.groupBy(*by).agg(F.array(*counts).alias("_n"))


def _sum(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _smoothed(own: str, parent: str) -> Column:
    """A child's shares, its parent's being worth ``STRENGTH`` rows."""
    total = _sum(own)
    return F.zip_with(own, parent, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def identify(
    docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None,
    host: Column | None = None, suffix: Column | None = None, markup: bool = False,
) -> DataFrame:
    """``_id``, ``_mark``, ``language``, ``confidence``, ``text_language`` and ``accepted`` of each row's whole text.

    ``accepted``: the likeliest language is a known one and its posterior is at least one half. A row without letters, and
    a null or empty text, has no text evidence, is ``und`` and is not accepted. A missing declaration says nothing; rows
    without a host or suffix share those of the empty name. Repeated rows get equal results; an empty table gives an empty
    table; other columns are ignored.
    """
    languages = model.languages
    rows = docs.select(
        F.col(id_col).alias("_id"), text_mark(text_col).alias("_mark"), F.col(text_col).alias("_text"),
        *(F.coalesce((F.lit(None) if column is None else F.lower(column)).cast("string"), F.lit("")).alias(name)
          for name, column in (("_declared", declared), ("_suffix", suffix), ("_host", host))),
    )
    table = persist_table(text_evidence(rows, model, markup), "evidence")
    everywhere = [float(n) for n in (_shares(table, [], languages).first() or [[]])[0]]
    total = sum(everywhere)
    base = F.array(*(F.lit((n + 1.0) / (total + len(languages))) for n in everywhere))
    suffixes = (
        _shares(table, ["_suffix"], languages).withColumn("_base", base)
        .select("_suffix", _smoothed("_n", "_base").alias("_of_suffix"))
    )
    hosts = (
        _shares(table, ["_suffix", "_host"], languages).join(suffixes, "_suffix")
        .select("_suffix", "_host", _smoothed("_n", "_of_suffix").alias("_prior"))
    )
    # P(declared | language): the declarations that rows of each language come with.
    likelihood = F.zip_with("_n", F.array(*map(F.lit, everywhere)), lambda n, all_: (n + 0.5) / (all_ + 25.0))
    nothing = F.array(*(F.lit(1.0) for _ in languages))
    declarations = _shares(table, ["_declared"], languages).select(
        "_declared", F.when(F.col("_declared") == "", nothing).otherwise(likelihood).alias("_says_so")
    )
    fused = table.join(apart(hosts, "_suffix", "_host"), ["_suffix", "_host"]).join(apart(declarations, "_declared"), "_declared")
    score = F.zip_with(F.zip_with("_ll", "_prior", lambda a, b: a + F.log(b)), "_says_so", lambda a, b: a + F.log(b))
    fused = fused.withColumn("_score", score).withColumn("_top", F.array_max("_score"))
    fused = fused.withColumn("_sum", F.aggregate("_score", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("_top"))))
    blank = _sum("_ll") == 0
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_score", F.col("_top")).cast("int"))
    language = F.when(blank, F.lit(UNKNOWN)).otherwise(best)
    return fused.select("_id", "_mark", language.alias("language"), (1 / F.col("_sum")).alias("confidence"), F.col("_says").alias("text_language")).withColumn(
        "accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= 0.5)
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def declared_in(markup: Column) -> Column:
    """The primary subtag of the ``lang`` attribute of the ``html`` element, the first of that name."""
    attributes = F.regexp_extract(markup, r"(?i)<html\b([^>]*)", 1)
    return F.lower(F.regexp_extract(attributes, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]+)", 1))


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` for web pages: visible text, declared language, host and its suffix."""
    host = host_of(F.coalesce(F.col(url_col), F.lit("")))
    html = F.coalesce(F.col(html_col), F.lit(""))
    return identify(pages, model, id_col, html_col, F.nullif(declared_in(html), F.lit("")), host, suffix_of(host), markup=True)


def accepted_documents(docs: DataFrame, model: TextModel, id_col: str, text_col: str, declared: Column | None, host: Column | None) -> DataFrame:
    """``docs`` without those that ``identify`` does not accept."""
    found = identify(docs, model, id_col, text_col, declared, host)
    return drop_documents(docs, id_col, text_col, found.where("not accepted"))
