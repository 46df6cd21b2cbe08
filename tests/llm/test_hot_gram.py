"""Spans round one gram that is in very many surroundings."""

import numpy as np
import pyarrow as pa

from passagemill.llm import line_dedup
from passagemill.llm.arrow import Spans, Units
from passagemill.llm.winnowing import select_anchors


def test_surroundings_of_a_hot_line_are_told_apart(documents):
    """Of 300,000 different runs round one line, those that share 32 bits of their hash lose nothing to each other."""
    lines = pa.array([f"line {i}" for i in range(2000)])
    units = Units(lines, "lines")
    hot = lines[int(np.argmin(select_anchors(units.hashes(), units.first, 1, 1)[3]))].as_py()
    texts = [f"a{i}\n{hot}\nb{i}" for i in range(300_000)]
    units = Units(pa.array(texts), "lines")
    hashes = units.hashes()
    text, low, last, grams = select_anchors(hashes, units.first, 3, 1)
    _, short = Spans(hashes).of(low, last + 3)
    _, place, copies = np.unique(np.stack([grams.view(np.int64), short]), axis=1, return_inverse=True, return_counts=True)
    same = text[copies[place.ravel()] > 1]
    assert len(same) > 1
    rows = [(int(i), texts[i]) for i in same]
    got = line_dedup.line_dedup(documents(rows), run=3).collect()
    assert {(r["_id"], r.n_removed) for r in got} == {(i, 0) for i, _ in rows}
