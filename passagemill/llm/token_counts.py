"""Token counts of whole texts: every distinct pre-token is cut into pieces once, documents only sum."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.session import persist_table

COMMON = 1 << 19  # so many of the most frequent pre-tokens at most are broadcast
COMMON_BYTES = 64  # and none that is longer; the broadcast table stays under 40 MB whatever the corpus

# A pre-token is a run of spaces and what follows it. No piece has a space mark after another character, so no merge
# crosses from one pre-token to the next. U+2581 is the model's own sign for a space.
_PRE_TOKEN = re.compile("[ \u2581]*[^ \u2581]+|[ \u2581]+")

_models: dict[bytes, sentencepiece.SentencePieceProcessor] = {}


def model_of(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    if proto not in _models:
        _models.clear()
        _models[proto] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return _models[proto]


def check_model(proto: bytes) -> None:
    """Pre-tokens are independent only if no piece holds a space mark after another character."""
    model = model_of(proto)
    if any(re.search("[^\u2581]\u2581", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("a piece of this model crosses words")


def pre_tokens(text: str | None) -> list[str]:
    """Of a text with the space that the model puts before it. Empty texts have none."""
    return _PRE_TOKEN.findall(" " + text) if text else []


def count_pieces(proto: bytes, tokens: list[str]) -> list[int]:
    """How many pieces each pre-token has: its own first space stands for the one that the model puts before a text."""
    numbers = [len(ids) for ids in model_of(proto).encode([token[1:] for token in tokens], num_threads=1)] if tokens else []
    # A lone space is an empty text to the model, but a piece inside a longer text.
    return [number if len(token) > 1 else 1 for token, number in zip(tokens, numbers)]


def piece_table(docs: DataFrame, text_col: str, proto: bytes) -> DataFrame:
    """``token``, ``times`` (over all whole texts) and ``pieces`` of each distinct pre-token."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0):
                counts.update(pre_tokens(text.as_py()))
                if len(counts) > 200_000:
                    yield out(counts)
                    counts = Counter()
            yield out(counts)

    def out(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "times"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = count_pieces(proto, batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("times"), pa.array(numbers, pa.int64())], ["token", "times", "pieces"])

    found = docs.select(text_col).mapInArrow(spread, "token string, times bigint")
    return found.groupBy("token").agg(F.sum("times").alias("times")).mapInArrow(pieces, "token string, times bigint, pieces bigint")


def common_tokens(table: DataFrame, most: int) -> Column:
    """True for the most frequent pre-tokens of ``table``, at most ``most`` in all.

    The cut is a frequency, found in a histogram of a few hundred cells (exact up to 64 occurrences).
    """
    cell = F.when(F.col("times") <= 64, F.col("times").cast("bigint")).otherwise(F.floor(F.log2("times") * 16) - 32 + 1)
    short = F.octet_length("token") <= COMMON_BYTES
    held, least = 0, None
    for row in table.where(short).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("times").alias("least")).orderBy(F.desc("cell")).collect():
        held += row.n
        if held > most:
            break
        least = row.least
    return short & (F.col("times") >= least) if least is not None else F.lit(False)


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, most: int = COMMON
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row's whole text.

    Counts equal those of the model's own library without begin and end tokens. The model file is read by the driver.
    Documents meet the common pre-tokens in a broadcast table of at most ``most`` short rows, and all others in a
    join. Null and empty texts have no tokens; repeated rows and rows without an id are counted each; an empty table
    gives an empty table; other columns are ignored.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    check_model(proto)
    table = persist_table(piece_table(docs, text_col, proto), "pieces")
    is_common = common_tokens(table, most)
    shared = docs.sparkSession.sparkContext.broadcast(table.where(is_common).select("token", "pieces").toArrow())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(*(column.to_pylist() for column in shared.value.columns)))
        rest_type = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            sizes, sums, rests = [], [], []
            for value in batch.column("_text"):
                text = value.as_py() or ""
                done, rest = 0, []
                for token, times in Counter(pre_tokens(text)).items():
                    pieces = known.get(token)
                    if pieces is None:
                        rest.append({"token": token, "times": times})
                    else:
                        done += pieces * times
                sizes.append(len(text.encode()))
                sums.append(done)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, rest_type)],
                ["_id", "n_bytes", "done", "rest"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    counted = persist_table(
        rows.mapInArrow(kernel, f"_id {id_type}, n_bytes bigint, done bigint, rest array<struct<token: string, times: bigint>>")
        .withColumn("_row", F.monotonically_increasing_id()),
        "counted",
    )
    others = (
        counted.select("_row", F.inline("rest")).join(table.where(~is_common).select("token", "pieces"), "token")
        .groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    )
    n_tokens = F.col("done") + F.coalesce("more", F.lit(0))
    return counted.drop("rest").join(others, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
