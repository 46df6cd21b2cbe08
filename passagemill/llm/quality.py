"""Quality rules: statistics of whole texts, and an isolation forest that finds the documents whose statistics stand out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.arrow import WHITE
from passagemill.llm.tables import hashed_share, text_mark
from passagemill.session import persist_table

SYMBOLS = b"#*$%&|<>"
TREES, SUBSAMPLE = 100, 256
TRAINING_ROWS = 20_000  # from twice as many labels on, the thresholds are found in Spark
BINS = 4_096  # of the scores, from 0 to 1
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of three words that occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), dtype=np.int64, count=n)
    distinct = np.int64(len(numbers))
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """In the order of ``STATISTICS``."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.translate(None, WHITE)]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, WHITE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_mark`` and the rule statistics of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_mark(text_col).alias("_mark"), F.col(text_col).alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([rule_statistics(text.as_py()) for text in batch.column("_text")], dtype=np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_mark"), *map(pa.array, table.T)], ["_id", "_mark", *STATISTICS]
            )

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"_id {id_type}, _mark int, " + ", ".join(f"{name} bigint" for name in STATISTICS))


#: Rules of one kind are judged by one forest, so that a trait that is common among good rows does not hide another.
KINDS = ("composition", "repetition", "size")


def features(table: np.ndarray) -> dict[str, np.ndarray]:
    """Per kind of rule: rates that do not depend on the length, and the length itself on a log scale."""
    words = np.maximum(table[:, 0], 1).astype(np.float64)
    return {
        "composition": np.stack([table[:, 1] / words, table[:, 2] / words], axis=1),
        "repetition": np.stack([table[:, 3] / words, table[:, 4] / words], axis=1),
        "size": np.log1p(table[:, :1].astype(np.float64)),
    }


def base_failed(table: np.ndarray) -> np.ndarray:
    return (table[:, 0] < 50) | (100 * table[:, 4] > 50 * table[:, 0])


def mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """The mean depth at which a random tree over ``n`` rows isolates one."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1.0)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``cut``, the two children, and the path length that a leaf stands for."""

    trees: list[tuple[np.ndarray, ...]]
    unit: float
    threshold: float = 1.0

    @staticmethod
    def fit(points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7, apart: bool = False) -> Forest:
        """``apart``: the points are drawn already, in the order of the trees, and each has the next ``subsample`` of them."""
        random = np.random.Generator(np.random.PCG64(seed))
        if apart and len(points) >= trees * subsample:
            drawn = [points[tree * subsample : (tree + 1) * subsample] for tree in range(trees)]
        else:
            drawn = None
        size = min(subsample, len(points))
        depth = int(np.ceil(np.log2(max(size, 2))))
        grown = [
            Forest._grow(points[random.choice(len(points), size, replace=False)] if drawn is None else drawn[tree], depth, random)
            for tree in range(trees if size else 0)
        ]
        return Forest(grown, float(max(mean_path(size), 1e-9)))

    @staticmethod
    def _grow(points: np.ndarray, limit: int, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []
        waiting = [(points, 0, None, None)]
        while waiting:
            held, depth, parent, side = waiting.pop()
            node = len(feature)
            if parent is not None:
                (left if side == 0 else right)[parent] = node
            low, high = held.min(axis=0), held.max(axis=0)
            varied = np.flatnonzero(high > low)
            leaf = depth >= limit or not len(varied)
            which = -1 if leaf else int(random.choice(varied))
            at = 0.0 if leaf else float(random.uniform(low[which], high[which]))
            for values, value in ((feature, which), (cut, at), (left, 0), (right, 0), (path, depth + float(mean_path(len(held))))):
                values.append(value)
            if not leaf:
                less = held[:, which] <= at
                waiting += [(held[less], depth + 1, node, 0), (held[~less], depth + 1, node, 1)]
        return tuple(map(np.array, (feature, cut, left, right, path)))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the nearer to 1, the sooner random splits isolate the point."""
        if not self.trees:
            return np.zeros(len(points))
        total = np.zeros(len(points))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(points), dtype=np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                less = points[inner, feature[at]] <= cut[at]
                node[inner] = np.where(less, left[at], right[at])
            total += path[node]
        return np.exp2(-total / len(self.trees) / self.unit)

    def calibrate(self, scores: np.ndarray, good: np.ndarray, keep: float) -> None:
        """The cut between two neighbouring scores of the best balanced accuracy that keeps the share ``keep`` of the good rows.

        Of equal cuts the one in the widest gap. Without a gain of a fifth, or without rows of both labels, nothing is cut.
        """
        self.threshold = 1.0
        if not good.any() or good.all():
            return
        order = np.argsort(scores, kind="stable")
        ranked, right = scores[order], good[order]
        gaps = np.diff(ranked)
        kept = np.cumsum(right)[:-1] / right.sum()
        gain = kept - np.cumsum(~right)[:-1] / (~right).sum()
        able = (gaps > 0) & (kept >= keep) & (gain > 0.2)
        if able.any():
            best = np.flatnonzero(able & (gain >= gain[able].max() - 1e-12))
            place = best[np.argmax(gaps[best])]
            self.threshold = float((ranked[place] + ranked[place + 1]) / 2)


def fit_forests(
    table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: float = 0.99, most: int = TRAINING_ROWS
) -> dict[str, Forest]:
    """One forest per kind of rule, over all labelled rows that pass the base rules: fitted on rows drawn from all, calibrated from all.

    Fewer than ``2 * most`` labels are brought to the driver. Of more, only the rows that the trees draw (``SUBSAMPLE`` each) are; the
    thresholds are then found in Spark. Unlabelled rows and null labels are left out; without labelled rows the forests find
    nothing anomalous.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    labelled = table.join(marked, "_id")
    if marked.count() >= 2 * most:
        return fit_forests_at_size(labelled, keep)
    rows = labelled.orderBy("_id", "_mark").select(*STATISTICS, "label").toPandas()
    counts, good = rows[STATISTICS].to_numpy(dtype=np.int64), rows["label"].to_numpy() == 1
    passed = ~base_failed(counts)
    forests = {}
    for kind, points in features(counts[passed]).items():
        forests[kind] = forest = Forest.fit(points)
        if len(points):
            forest.calibrate(forest.scores(points), good[passed], keep)
    return forests


def fit_forests_at_size(labelled: DataFrame, keep: float, trees: int = TREES, subsample: int = SUBSAMPLE) -> dict[str, Forest]:
    """``fit_forests`` for rows that do not fit the driver: each tree has rows of its own, drawn from all by a hash."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = persist_table(labelled.where(~failed).select("_id", "_mark", *STATISTICS, (F.col("label") == 1).alias("good")), "labelled")
    place, wanted = F.xxhash64(F.lit(7), "_id", "_mark"), trees * subsample
    drawn = rows.where(hashed_share(place, rows.count(), 2 * wanted)).orderBy(place, "_id", "_mark").limit(wanted).select(*STATISTICS)
    points = features(drawn.toPandas()[STATISTICS].to_numpy(dtype=np.int64))
    forests = {kind: Forest.fit(points[kind], trees, subsample, apart=True) for kind in KINDS}
    for kind, threshold in thresholds(rows, forests, keep).items():
        forests[kind].threshold = threshold
    return forests


def thresholds(rows: DataFrame, forests: dict[str, Forest], keep: float) -> dict[str, float]:
    """What ``Forest.calibrate`` finds, for each kind, from all ``rows`` (the statistics and ``good``); kinds where nothing is cut are left out.

    Equal scores are counted together; running counts are taken within bins of the score, on top of the counts of the bins below.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(name).to_numpy() for name in STATISTICS], axis=1)
            for kind, points in features(counts).items():
                kinds = pa.array([kind] * len(points), pa.string())
                yield pa.RecordBatch.from_arrays([kinds, pa.array(forests[kind].scores(points)), batch.column("good")], ["kind", "score", "good"])

    scored = rows.select(*STATISTICS, "good").mapInArrow(kernel, "kind string, score double, good boolean")
    right, wrong = F.sum(F.col("good").cast("bigint")).alias("right"), F.sum((~F.col("good")).cast("bigint")).alias("wrong")
    counted = persist_table(scored.groupBy("kind", "score").agg(right, wrong).withColumn("bin", F.floor(F.col("score") * BINS)), "scores")
    over = Window.partitionBy("kind").orderBy("bin")
    below = over.rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("kind", "bin").agg(F.sum("right").alias("r"), F.sum("wrong").alias("w"), F.min("score").alias("least")).select(
        "kind", "bin", F.coalesce(F.sum("r").over(below), F.lit(0)).alias("r"), F.coalesce(F.sum("w").over(below), F.lit(0)).alias("w"),
        F.lead("least").over(over).alias("least"),
        *(F.sum(name).over(Window.partitionBy("kind")).alias(f"all_{name}") for name in ("r", "w")),
    )
    inside = Window.partitionBy("kind", "bin").orderBy("score")
    cuts = counted.join(F.broadcast(bins), ["kind", "bin"]).where((F.col("all_r") > 0) & (F.col("all_w") > 0)).select(
        "kind", "score", F.coalesce(F.lead("score").over(inside), "least").alias("next"),
        ((F.col("r") + F.sum("right").over(inside)) / F.col("all_r")).alias("kept"),
        ((F.col("w") + F.sum("wrong").over(inside)) / F.col("all_w")).alias("lost"),
    ).withColumn("gain", F.col("kept") - F.col("lost"))
    able = persist_table(cuts.where(F.col("next").isNotNull() & (F.col("kept") >= keep) & (F.col("gain") > 0.2)), "cuts")
    best = able.join(F.broadcast(able.groupBy("kind").agg(F.max("gain").alias("most"))), "kind").where(F.col("gain") >= F.col("most") - 1e-12)
    widest = best.groupBy("kind").agg(F.max_by(F.struct("score", "next"), F.struct(F.col("next") - F.col("score"), -F.col("score"))).alias("cut"))
    return {row.kind: (row.cut.score + row.cut.next) / 2 for row in widest.collect()}


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = 0.99,
    most: int = TRAINING_ROWS,
) -> DataFrame:
    """Id, the rule statistics, ``base_failed``, a score per kind of rule and ``kept`` of each row.

    ``base_failed``: under 50 words, or over half of the words in repeated windows. ``kept``: not failed, and no score is over
    its forest's threshold; each keeps the share ``keep`` of the labelled good rows. ``most`` bounds what labels the driver
    takes (see ``fit_forests``); thresholds, statistics and verdicts are of all rows. Null and empty texts have no words and
    fail; repeated rows are judged each, null ids like others; an empty table gives an empty table; other columns are
    ignored.
    """
    table = persist_table(statistics(docs, id_col, text_col), "statistics")
    forests = fit_forests(table, labels, id_col, label_col, keep, most)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(name).to_numpy() for name in STATISTICS], axis=1)
            failed = base_failed(counts)
            scores = {kind: forests[kind].scores(points) for kind, points in features(counts).items()}
            kept = ~failed & np.all([scores[kind] <= forests[kind].threshold for kind in KINDS], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(batch.column(name) for name in STATISTICS), pa.array(failed),
                 *(pa.array(scores[kind]) for kind in KINDS), pa.array(kept)],
                ["_id", *STATISTICS, "base_failed", *KINDS, "kept"],
            )

    id_type = table.schema["_id"].dataType.simpleString()
    counts = ", ".join(f"{name} bigint" for name in STATISTICS)
    scores = ", ".join(f"{kind} double" for kind in KINDS)
    return table.mapInArrow(kernel, f"_id {id_type}, {counts}, base_failed boolean, {scores}, kept boolean").withColumnRenamed("_id", id_col)
