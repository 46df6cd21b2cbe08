"""The near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest

from passagemill.llm import circulant, near_copies, set_links, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def linked(one, two):
    return len(one & two) >= 0.8 * len(one | two)


def firsts(rows):
    sets, root = [(i, shingles(text)) for i, text in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, (i, one) in enumerate(sets):
        for j, two in sets[:at]:
            if linked(one, two):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i for i in root if find(i) == i}


@pytest.mark.parametrize("share", [0.005, 0.02, 0.04])
def test_edited_copies(spark, documents, share):
    """Copies with a share of their words changed, some of them copies of copies."""
    pick, rows = random.Random(int(share * 1000)), []
    words = [f"w{i}" for i in range(3000)]
    for i in range(240):
        if i % 2 and i > 1:
            text = [pick.choice(words) if pick.random() < share else w for w in rows[pick.choice([i - 1, i - 2])][1].split()]
        else:
            text = pick.choices(words, k=pick.randint(150, 400))
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "one three")]
    kept = corpus_pipeline.remove_near_copies(spark, documents(rows), "")
    assert {r.doc_id for r in kept.collect()} == firsts(rows)


def test_large_group(spark, documents):
    """More copies of one text than meet each other under a key."""
    pick = random.Random(3)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(150):
        text = list(base)
        text[pick.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(f"c{i}-{j}" for j in range(50)) + " " + " ".join(base[:150])) for i in range(150, 170)]
    kept = corpus_pipeline.remove_near_copies(spark, documents(rows), "")
    assert {r.doc_id for r in kept.collect()} == firsts(rows)


def pages(pairs, near, shared, size=400, seed=5):
    """Pages of one template (``shared`` words of ``size`` alike, kept below the bound), each with one partner: the same page
    with ``near`` of its last words changed."""
    pick, rows = random.Random(seed), []
    frame = [f"t{i}" for i in range(shared)]
    for i in range(pairs):
        own = [f"p{i}-{j}" for j in range(size - shared)]
        rows.append((2 * i, " ".join(frame + own)))
        rows.append((2 * i + 1, " ".join(frame + own[: len(own) - near] + [f"q{i}-{j}" for j in range(near)])))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("pairs", [200, 1200])
def test_pairs_among_pages_of_one_template(spark, documents, pairs):
    """Every pair is found, whatever the number of pages that share a template just below the bound."""
    shared, near = 354, 42
    rows = pages(pairs, near, shared)
    one, two, other = (shingles(dict(rows)[i]) for i in (0, 1, 2))
    assert 0.8 <= len(one & two) / len(one | two) < 0.825 and 0.79 < len(one & other) / len(one | other) < 0.8
    found = near_copies.near_copy_components(documents(rows)).collect()
    assert {r["_id"]: r["component_id"] for r in found} == {i: i - i % 2 for i, _ in rows}


def test_pages_of_two_templates_and_a_crowd_of_copies(spark, documents):
    """Crowds that share the keys of another crowd, chains of copies, and the 0.85 of ``circulant``, against brute force."""
    pick, rows = random.Random(9), []
    frame = [f"t{i}" for i in range(150)]
    for i in range(260):
        kind = i % 4
        words = frame + [f"k{kind}-{j}" for j in range(22)]
        if kind == 3:
            words = frame[: 150 - i // 8] + [f"k3-{j}" for j in range(22 + i // 8)]
        words[pick.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(900, "one two three four"), (901, "One two  three four"), (902, "one two"), (903, None), (904, " "), rows[3], (None, rows[7][1])]
    sets = {i: shingles(text) for i, text in rows if i is not None}
    for found, bound in ((near_copies.near_copy_components(documents(rows)).collect(), 0.8), (circulant.near_duplicates(documents(rows)).collect(), 0.85)):
        root = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for i, one in sets.items():
                for j, two in sets.items():
                    if root[j] < root[i] and (one or two) and len(one & two) >= bound * len(one | two):
                        root[i], changed = root[j], True
        name = "doc_id" if bound == 0.85 else "_id"
        held = {r[name]: r["component_id"] for r in found}
        assert held.pop(None) == root[7]
        if bound == 0.8:
            root[904] = 903
        else:
            assert {r[name]: (r["n_shingles"], r["kept"]) for r in found if r[name] in (902, 903)} == {902: (1, True), 903: (0, True)}
        assert held == root


def test_two_large_components_meet_by_one_pair(spark, monkeypatch):
    """All pairs of two components are similar, but the first set of each hash is similar to none of them."""
    core = range(1000, 1099)
    held = {bytes([0, h - 1000]): [h] for h in core} | {bytes([kind, i]): [*core, 5000 + 100 * kind + i] for kind in (1, 2) for i in range(30)}
    rows = [(bytearray(name), hashes, *set_links.sketch(np.array(hashes, dtype=np.uint64)).tolist()) for name, hashes in held.items()]
    sets = spark.createDataFrame(rows, "set binary, hashes array<bigint>, " + ", ".join(f"{name} bigint" for name in set_links.SKETCH))
    roots = spark.createDataFrame([(bytearray([kind, i]), bytearray([kind, 0])) for kind in (1, 2) for i in range(30)], "node binary, root binary")
    met, real = [], set_links.candidates

    def counted(*args):
        met.append((found := real(*args)).count())
        return found

    monkeypatch.setattr(set_links, "candidates", counted)
    links = set_links.exact_links(sets, roots, set_links.Bound(5, 4)).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in links} == {(bytes([1, 0]), bytes([2, 0]))}
    assert sum(met) == 1  # of 900


def test_circulant_tables(spark, documents):
    found = circulant.near_duplicates(documents([], ("_id", "set", "keys", "n", "root", "hash")))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.collect() == []
    rows = [(1, "w " * 40_000), (2, "w"), (5, None), (5, None), (None, "a b"), (None, "a b")]
    found = circulant.near_duplicates(documents(rows, ("_id", "set", "keys", "n", "root", "hash"))).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 1, 1, True), (2, 1, 2, True), (5, 0, 5, True), (5, 0, 5, True), (None, 1, None, True), (None, 1, None, True)], key=str
    )


def test_circulant_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        one, two = np.unique(words[:250]), np.unique(words[25:275])
        agree.append(np.mean(circulant.coordinates(one) == circulant.coordinates(two)))
        assert (circulant.coordinates(one) == circulant.coordinates(one[::-1].copy())).all()
    assert abs(np.mean(agree) - 225 / 275) < 0.01
    assert len(np.unique(circulant.shifted(np.arange(1 << 16, dtype=np.uint64)))) == 1 << 16


def test_bounds_of_sizes(spark):
    bound = set_links.Bound(100, 85)
    from pyspark.sql import functions as F

    rows = spark.range(1, 400).select("id", bound.least_size(F.col("id")).alias("least"), bound.least_shared(F.col("id")).alias("shared")).collect()
    for r in rows:
        assert r.least == -(-85 * r.id // 100) and r.shared == -(-85 * r.id // 185)


def test_fingerprints_link_what_shingles_do_not(spark, documents):
    """Two short texts with one fingerprint up to two bits and a lower similarity; a near copy of the second hangs on both."""
    pick, words, pair = random.Random(5), [f"w{i}" for i in range(400)], None
    while pair is None:
        one = pick.choices(words, k=60)
        for at in range(60):
            two = [*one[:at], pick.choice(words), *one[at + 1 :]]
            two[(at + 20) % 60] = pick.choice(words)
            prints = [simhash.simhash(simhash.shingle_hashes(" ".join(text).encode(), 3)) for text in (one, two)]
            if (prints[0] ^ prints[1]).bit_count() <= 2 and not linked(shingles(" ".join(one)), shingles(" ".join(two))):
                pair = one, two
                break
    three = [*pair[1], "tail"]
    rows = [(4, " ".join(pair[0])), (7, " ".join(pair[1])), (9, " ".join(three)), (12, " ".join(pick.choices(words, k=60)))]
    docs = documents(rows)
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()} == {4, 12}
    assert {(r._id, r.component_id) for r in near_copies.near_copy_components(docs).collect()} == {(4, 4), (7, 7), (9, 7), (12, 12)}
