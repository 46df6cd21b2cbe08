"""Numpy kernels against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from passagemill.llm import bpe_automaton, fuse, language_id, packing, quality, simhash, token_counts, winnowing
from passagemill.llm.arrow import Spans, Units

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(seed, letters, count, most):
    pick = random.Random(seed)
    return [None if pick.random() < 0.1 else "".join(pick.choice(letters) for _ in range(pick.randint(0, most))) for _ in range(count)]


@pytest.mark.parametrize("seed", range(20))
def test_units_are_words_and_lines(seed):
    texts = random_texts(seed, ["a", "bé", " ", "\n", "\t", "zz", "\x0b", "　"], 8, 30)
    column = pa.concat_arrays([pa.array(["xx yy"]), pa.array(texts, pa.string())]).slice(1)
    for kind, want in (
        ("words", [WORD.findall(text or "") for text in texts]),
        ("lines", [[line for line in (text or "").split("\n") if WORD.search(line)] for text in texts]),
    ):
        units = Units(column, kind)
        got = [
            [units.data[units.start[i] : units.end[i]].tobytes().decode() for i in range(units.first[row], units.first[row + 1])]
            for row in range(len(texts))
        ]
        assert got == want
        names = {}
        for unit, value in zip(itertools.chain(*want), units.hashes().tolist()):
            assert names.setdefault(unit, value) == value
        assert len(set(names.values())) == len(names)


def test_equal_windows_have_equal_anchors_and_spans_cover_every_window():
    pick = random.Random(4)
    words = [pick.randint(0, 3) for _ in range(400)]
    hashes = np.array([hash((w, 7)) & (2**63 - 1) for w in words], dtype=np.uint64)
    first = np.array([0, 150, 150, 160, 400])
    text, low, last, grams = winnowing.select_anchors(hashes, first, 12, 4)
    served = {start: gram for a, b, gram in zip(low, last, grams) for start in range(a, b + 1)}
    starts = [s for a, b in zip(first, first[1:]) for s in range(a, b - 12 + 1)]
    assert sorted(served) == starts
    by_window = {}
    for start in starts:
        assert by_window.setdefault(tuple(words[start : start + 12]), served[start]) == served[start]
    one, two = Spans(hashes).of(np.array(starts), np.array(starts) + 12)
    assert len(set(zip(one.tolist(), two.tolist()))) == len(by_window)


def test_texts_shorter_than_a_window_have_no_anchor():
    hashes = np.arange(5, dtype=np.uint64)
    assert all(len(x) == 0 for x in winnowing.select_anchors(hashes, np.array([0, 5]), 6, 2))
    assert len(winnowing.select_anchors(np.arange(12, dtype=np.uint64), np.array([0, 5, 12]), 6, 2)[0]) > 0


@pytest.mark.parametrize("count", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(count):
    keys = np.random.default_rng(count).integers(0, 1 << 63, count * 2, dtype=np.uint64)
    packed = fuse.build(keys[:count])
    assert fuse.contains(packed, keys[:count]).all()
    assert count < 1000 or fuse.contains(packed, keys[count:]).mean() < 0.02
    assert count < 50_000 or len(packed) < count * 1.25


def simple_fingerprint(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints():
    for text in random_texts(3, ["A", "b", "É", " ", " ", "\n", "word "], 200, 40):
        assert simhash.simhash(simhash.shingle_hashes((text or "").encode(), 3)) == simple_fingerprint(text)


def test_rule_statistics():
    for text in random_texts(5, ["a", "b", "é", " ", " ", "\n", "#", "|", "c "], 300, 60):
        words = WORD.findall(text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, gram in enumerate(grams) if grams.count(gram) > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        assert quality.rule_statistics(text) == (
            len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
        )


def test_isolation_forest_finds_what_stands_apart():
    random_ = np.random.default_rng(1)
    points = np.concatenate([random_.normal(0, 1, (500, 2)), random_.normal(8, 1, (25, 2))])
    good = np.arange(525) < 500
    forest = quality.Forest.fit(points)
    scores = forest.scores(points)
    forest.calibrate(scores, good, 0.98)
    assert (scores[~good] > forest.threshold).mean() > 0.9 and (scores[good] <= forest.threshold).mean() >= 0.98
    forest.calibrate(scores, np.ones(525, dtype=bool), 0.98)
    assert forest.threshold == 1.0
    assert quality.Forest.fit(points[:0]).scores(points[:3]).tolist() == [0, 0, 0]


def test_paths_of_a_tree_agree_with_walking_it():
    points = np.random.default_rng(2).normal(0, 1, (60, 3))
    forest = quality.Forest.fit(points, trees=5)
    for point, score in zip(points, forest.scores(points)):
        depth = 0.0
        for feature, cut, left, right, path in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] if point[feature[node]] <= cut[node] else right[node]
            depth += path[node]
        assert abs(score - 2 ** (-depth / 5 / forest.unit)) < 1e-12


@pytest.mark.parametrize("seed", range(30))
def test_length_buckets_are_optimal(seed):
    pick = random.Random(seed)
    lengths = sorted(pick.sample(range(60), pick.randint(1, 9)))
    counts = [pick.randint(1, 9) for _ in lengths]
    buckets = pick.randint(1, 4)

    def cost(bounds):
        return sum(n * min(b for b in bounds if b >= length) for length, n in zip(lengths, counts))

    bounds = packing.best_bounds(np.array(lengths), np.array(counts), buckets)
    assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == lengths[-1]
    assert cost(bounds) == min(
        cost([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], k)
    )


def test_no_lengths_no_buckets():
    assert packing.best_bounds(np.zeros(0, dtype=int), np.zeros(0, dtype=int), 3) == []


PIECES = ["a", "b", " ", " ", "  ", "▁", "the", "ing", "\n", "\t", "é", "中", "😀", "<s>", "</s>", "\0", "ﬁ", "　", "\xa0", "###", "1", "23"]


def test_piece_counts_equal_the_library():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto = file.read()
    token_counts.check_model(proto)
    model = token_counts.model_of(proto)
    for text in random_texts(6, PIECES, 5000, 14):
        assert sum(token_counts.count_pieces(proto, token_counts.pre_tokens(text))) == len(model.encode(text or ""))


SYMBOLS = PIECES + ["<|startoftext|>", "<|endoftext|>", "'s", "'T", "Σ", "aaaa", "ooo", "İ", "é", "'", "re", "tion", "er"]


def test_automaton_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        codec = bpe_automaton.codec_of(file.read())
    for text in random_texts(7, SYMBOLS, 5000, 12) + random_texts(8, list("aeionrtsl"), 5000, 14):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert codec.run(text or "") == want


def plain_bpe(symbols, ranks):
    while True:
        pairs = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_of_random_merges(seed):
    """Against merging one pair at a time, with merges that overlap and repeat letters."""
    pick = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    for _ in range(12):
        left, right = pick.choice(tokens), pick.choice(tokens)
        if left + right not in tokens:
            merges.append((left, right))
            tokens.append(left + right)
    automaton = bpe_automaton.Automaton({token: i for i, token in enumerate(tokens)}, merges)
    ranks = {merge: i for i, merge in enumerate(merges)}
    for size in range(1, 7):
        for word in itertools.product("abc", repeat=size):
            assert [tokens[i] for i in automaton.encode(list(word))] == plain_bpe(list(word), ranks)


def test_addresses_and_declarations(spark):
    from pyspark.sql import functions as F

    rows = [("https://u:p@Www.Example.CO.uk:80/x?y", '<HTML class=x LANG="De-at">'), ("nonsense", "<p lang=fr>"), (None, None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(
        language_id.host_of("url"), language_id.suffix_of(language_id.host_of(F.col("url"))), language_id.declared_in(F.col("html"))
    ).collect()
    assert [tuple(row) for row in got] == [("www.example.co.uk", "uk", "de"), ("", "", ""), (None, None, None)]
