"""Each operator on small tables against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from passagemill.llm import (
    bpe_automaton, components, exact_dedup, language_id, line_dedup, packing, quality, simhash, substring_dedup, tables, token_counts, warc,
    winnowing,
)
from passagemill.session import persist_table
from tests.llm.conftest import CLASHING
from tests.llm.test_kernels import WORD, simple_fingerprint

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed, count, letters="abc", separators=" ", most=40):
    """Texts of few words, so that runs repeat; some copies, some nulls, some empty, one long, one row twice."""
    pick = random.Random(seed)
    texts = []
    for _ in range(count):
        if texts and pick.random() < 0.3:
            base = (pick.choice(texts) or "").split(" ")
            at = pick.randint(0, len(base))
            texts.append(" ".join(base[:at] + [pick.choice(letters)] + base[at:]))
        else:
            texts.append("".join(pick.choice(letters) + pick.choice(separators) for _ in range(pick.randint(0, most))))
    texts += [None, "", "  \n ", "".join(pick.choice(letters) + " " for _ in range(3000))]
    rows = [(i * 3, text) for i, text in enumerate(texts)]
    return [*rows, rows[1], rows[-1]]


def expected_repeats(rows, units, length, joiner):
    """Rows equal in id and text are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda row: row[0]):
        words = units(text)
        gone = set()
        for start in range(len(words) - length + 1):
            window = tuple(words[start : start + length])
            if window in seen:
                gone.update(range(start, start + length))
            seen.add(window)
        out[doc_id] = (len(words), len(gone), sha(joiner.join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 6), (3, 20)])
def test_substring_dedup(documents, seed, words):
    rows = corpus(seed, 60, letters="ab" if words < 20 else ["a"] * 20 + ["b"], separators=[" ", "\n", " \t"])
    got = substring_dedup.deduplicated_substrings(documents(rows, CLASHING), words=words).collect()
    want = expected_repeats(rows, lambda text: WORD.findall(text or ""), words, " ")
    assert len(got) == len(rows) and {row.doc_id: tuple(row)[1:] for row in got} == want


def test_line_dedup(documents):
    rows = corpus(5, 80, letters=["a", "b", "", "c d"], separators="\n")
    got = line_dedup.deduplicated_lines(documents(rows, CLASHING), run=3).collect()
    want = expected_repeats(rows, lambda text: [x for x in (text or "").split("\n") if WORD.search(x)], 3, "\n")
    assert len(got) == len(rows) and {row.doc_id: tuple(row)[1:] for row in got} == want


def test_kept_text_keeps_its_white_space(documents):
    rows = [(1, "a  b\nc d"), (2, " x\tb\nc d  y "), (3, "b\nc d"), (None, "q b c"), (None, "b c d r")]
    got = {(row["_id"], row["_text"]): row.kept_text for row in substring_dedup.substring_dedup(documents(rows), words=2, gram=1).collect()}
    # Rows without an id come first; of two documents with the same id, the marks decide which is earlier.
    assert got[3, "b\nc d"] == "" and got[1, "a  b\nc d"].startswith("a") and got[2, " x\tb\nc d  y "] == " x\ty "
    assert len(got) == 5


def test_ids_shared_by_different_texts_stay_apart(documents):
    rows = [(7, "one two three"), (7, "four five six"), (7, "one two three"), (8, "zero one two three")]
    got = Counter((row["_id"], row["_text"], row.n_removed) for row in substring_dedup.substring_dedup(documents(rows), words=3, gram=2).collect())
    assert got == {(7, "one two three", 0): 2, (7, "four five six", 0): 1, (8, "zero one two three", 3): 1}


def test_changed_documents(documents):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "x a b c d"), (4, None), (5, "z"), (3, "x a b c d")]
    docs = documents(rows, CLASHING)
    got = winnowing.with_kept_text(docs, "doc_id", "text", "n_chars", lambda d, i, t, carry: substring_dedup.substring_dedup(d, i, t, 4, 2, carry))
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == {
        (1, "a b c d", 7): 1, (3, "x ", 2): 2, (4, None, 0): 1, (5, "z", 1): 1,
    }


def test_exact_dedup(documents):
    pick = random.Random(3)
    texts = [pick.choice(["a b", "a  b", "a\n\tb", " a b", "", None, "c", "x " * 5000]) for _ in range(300)] + [f"only {i}" for i in range(50)]
    rows = [(pick.randint(0, 10**6), text) for text in texts]
    rows += [rows[0], (None, "c"), (None, "nobody else")]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACES.sub(" ", text or "")].append(doc_id)
    want = Counter()
    for doc_id, text in rows:
        plain = SPACES.sub(" ", text or "")
        keep = min((i for i in groups[plain] if i is not None), default=None)
        want[doc_id, keep, len(groups[plain]), doc_id == keep, sha(plain)] += 1
    docs = documents(rows, CLASHING)
    for old in ("doc_id < 400000", "false", "true"):
        is_old = F.coalesce(F.expr(old), F.lit(False))
        got = exact_dedup.deduplicated(docs.where(is_old), docs.where(~is_old))
        assert Counter(map(tuple, got.collect())) == want


def test_screen_passes_all_known_and_few_others(documents):
    old = documents([(i, f"old {i}") for i in range(400)])
    new = exact_dedup.grouped(documents([(i, f"old {i}" if i % 2 else f"new {i}") for i in range(400)]), "doc_id", "text")
    snapshot = exact_dedup.Snapshot.write(old, "doc_id", "text")
    assert 200 <= snapshot.screen(new.select("sha256")).count() < 215
    assert snapshot.known(new).count() == 200


def expected_components(rows):
    prints = {text: simple_fingerprint(text) for _, text in rows}
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for doc_id, text in rows:
        p = find(prints[text])
        least[p] = min((x for x in (least.get(p), doc_id) if x is not None), default=None)
    return Counter((doc_id, f"{prints[text]:016x}", least[find(prints[text])]) for doc_id, text in rows)


def test_simhash(documents):
    pick = random.Random(8)
    words = [f"W{i}" for i in range(300)]
    rows = [(i, None if i % 29 == 0 else "" if i % 31 == 0 else " ".join(pick.choices(words, k=pick.choice([1, 2, 3, 5, 200])))) for i in range(150)]
    for i in range(150, 260):
        copy = (pick.choice(rows)[1] or "").split()
        if copy:
            copy[pick.randrange(len(copy))] = "changed"
        rows.append((i, "\n".join(copy)))
    rows += [rows[3], (None, rows[5][1]), (None, "nobody else here at all")]
    docs = documents(rows, CLASHING)
    want = expected_components(rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _, least), n in want.items() if i == least for _ in range(n))


@pytest.mark.parametrize("limit", [2, 20, 4096])
def test_links_of_dense_classes(spark, documents, limit):
    """Many fingerprints that share halves, searched inside a class, over batches, and by two-bit keys."""
    pick = random.Random(limit)
    base = [pick.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << bit for bit in pick.sample(range(40), pick.randint(0, 4))) for b in base for _ in range(120)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        edges = simhash.linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp bigint"), limit)
        got = {frozenset(v) for v in groups_of(components.components(edges).collect()).values()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    left, want = set(prints), set()
    while left:
        group, front = set(), [left.pop()]
        while front:
            p = front.pop()
            group.add(p)
            near = {q for q in left if (p ^ q).bit_count() <= 2}
            left -= near
            front += near
        if len(group) > 1:
            want.add(frozenset(p - (1 << 64) if p >> 63 else p for p in group))
    assert got == want


def groups_of(rows):
    out = defaultdict(set)
    for row in rows:
        out[row.root].add(row.node)
    return out


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 3), (129, 110)]
    got = groups_of(components.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {0: set(range(41)), 100: set(range(100, 130))}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_of_random_graphs(spark):
    """Nodes as bytes, edges twice and both ways, at densities where components are many, one, or chains."""
    for seed, count in ((1, 30), (2, 60), (3, 200)):
        pick = random.Random(seed)
        edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(count)]
        edges += [(b, a) for a, b in edges[::3]] + edges[::4]
        least = list(range(60))
        for _ in range(60):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        found = components.components(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")).collect()
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert sorted((r.node[0], r.root[0]) for r in found) == [(x, least[x]) for x in sorted(linked)]


def test_components_end_with_the_stars(spark, monkeypatch):
    """Once edges are stars the next table says so; no whole round goes over them again, and tables of rounds do not stay."""
    written = []

    def persist(df, name):
        written.append((name, persist_table(df, name)))
        return written[-1][1]

    monkeypatch.setattr(components, "persist_table", persist)
    stars = spark.createDataFrame([(root, root + i) for root in (10, 40) for i in range(1, 20)], "a int, b int")
    found = components.components(stars)
    assert {(r.node, r.root) for r in found.collect()} == {(root + i, root) for root in (10, 40) for i in range(20)}
    assert [name for name, _ in written] == ["edges", "least"]
    path = components.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a int, b int"))
    assert {r.root for r in path.collect()} == {0}
    left = [name for name, table in written for file in table.inputFiles()[:1] if os.path.exists(file.removeprefix("file://"))]
    assert left == ["least", "least"]


def test_packing(documents):
    pick = random.Random(2)
    rows = [(i, "w " * pick.choice([0, 1, 3, 10, 50, 51, 900, 3000])) for i in range(400)] + [(None, None), (None, "a\nb"), (1, "same"), (1, "same")]
    got = packing.pack(documents(rows, CLASHING), buckets=4, budget=4000).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    batches = defaultdict(list)
    for row in got:
        assert row.n_tokens <= row.bucket_tokens
        batches[row.batch_id].append(row)
    for members in batches.values():
        assert len({m.bucket for m in members}) == 1 and sorted(m.place for m in members) == list(range(len(members)))
        assert len(members) * members[0].bucket_tokens <= 4000 or len(members) == 1
    lengths = Counter(len(WORD.findall(t or "")) for _, t in rows)
    bounds = packing.best_bounds(*map(__import__("numpy").array, zip(*sorted(lengths.items()))), 4)
    assert {r.bucket_tokens for r in got} == set(bounds)
    with pytest.raises(ValueError):
        packing.pack(documents(rows), buckets=0)


def test_quality_rules(documents, spark):
    pick = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, labels = [], []
    for i in range(400):
        odd = i % 20 == 0
        rows.append((i, " ".join(pick.choice(words) + str(pick.randint(0, 999)) + ("#" * pick.randint(1, 9) if odd else "") for _ in range(pick.randint(60, 200)))))
        if i < 300:
            labels.append((i, 0 if odd else 1))
    rows += [(1000, None), (1001, ""), (1002, "few words"), (1003, "a b c " * 40), (None, rows[1][1]), rows[1]]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1)], "doc_id bigint, quality int")
    got = quality.quality_rules(documents(rows, ("label", "kept", "_mark")), marks).collect()
    assert Counter((r.doc_id, *(r[name] for name in quality.STATISTICS)) for r in got) == Counter((i, *quality.rule_statistics(t)) for i, t in rows)
    for row in got:
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.base_failed and row.kept)
    later = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert sum(r.kept for r in later if r.doc_id % 20) >= 90
    none = quality.quality_rules(documents(rows), marks.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    got = quality.quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    kept = {row.quality: row.share for row in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.97 and kept[0] <= 0.1


@pytest.mark.parametrize("most", [0, 5, 1 << 19])
def test_token_counts(documents, most):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in corpus(9, 40, letters=["the", "ing", "é", "▁", "中文"], separators=[" ", "", "  ", "\n"])] + [(None, "x y"), (5, "x" * 5000)]
    got = token_counts.token_counts(documents(rows, CLASHING), path, limit=50, most=most).collect()
    want = Counter((i, len((t or "").encode()), n, n > 50) for i, t in rows for n in [len(model.encode(t or ""))])
    assert Counter(map(tuple, got)) == want


def test_round_trip(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = corpus(10, 30, letters=["The", "ing", "é", "<|endoftext|>", "it's"], separators=[" ", "", "\n"]) + [(None, "X")]
    got = bpe_automaton.round_trip(documents(rows, CLASHING), path).collect()
    counts = {(i, t): library.encode(t or "", add_special_tokens=False) for i, t in rows}
    want = Counter(
        (i, len(e.ids), hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in e.ids)).hexdigest(), sha(library.decode(e.ids, skip_special_tokens=False)))
        for i, t in rows for e in [counts[i, t]]
    )
    assert Counter(map(tuple, got)) == want


SOUNDS = {"xx": ["ba", "do", "gu"], "yy": ["ki", "mo", "ra"], "zz": ["shi", "tse", "pfu"]}


def tongue(pick, lang, n):
    return " ".join("".join(pick.choices(SOUNDS[lang], k=3)) for _ in range(n))


def test_language_id(documents, spark):
    pick = random.Random(6)
    rows = [(i, tongue(pick, lang, 40), lang, f"host{i % 5}.{lang}") for i in range(300) for lang in [pick.choice(list(SOUNDS))]]
    model = language_id.TextModel.fit(documents(rows[:200]), "text", "lang", F.col("doc_id"))
    assert model.languages == ["xx", "yy", "zz", "und"]
    tests = rows[200:] + [(900, "", "xx", "h"), (901, None, None, None), (902, "123 ###", "xx", "h"), (903, "жщю ждю щюж " * 20, "yy", "h"),
                          (None, tongue(pick, "xx", 9), "xx", "h"), rows[250]]
    docs = documents(tests, CLASHING + ("_host", "_declared"))
    got = {r["_id"]: r for r in language_id.identify(docs, model, "doc_id", "text", F.col("lang"), F.col("source")).collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows[200:])
    assert [got[i].language for i in (900, 901, 902, 903)] == ["und"] * 4 and not any(got[i].accepted for i in (900, 901, 902, 903))
    kept = language_id.accepted_documents(docs, model, "doc_id", "text", F.col("lang"), F.col("source"))
    assert kept.columns == docs.columns and kept.count() == 102
    assert language_id.identify(docs.limit(0), model, "doc_id", "text").count() == 0


def test_host_and_declaration_decide_ambiguous_text(documents):
    pick = random.Random(7)
    rows = [(i, tongue(pick, lang, 30), lang, f"only-{lang}") for i in range(400) for lang in [("xx", "yy")[i % 2]]]
    docs = documents(rows + [(900, "ba ki", None, "only-yy"), (901, "ba ki", None, "only-xx"), (902, "ba ki", "yy", "s"), (903, "ba ki", "xx", "s")])
    model = language_id.TextModel.fit(documents(rows), "text", "lang", F.col("doc_id"))
    got = {r["_id"]: r.language for r in language_id.identify(docs, model, "doc_id", "text", F.col("lang"), F.col("source")).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == ["yy", "xx", "yy", "xx"]


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.TextModel.fit(docs.where("doc_id % 2 = 0"), "text", "lang", F.col("doc_id"))
    held = docs.where("doc_id % 2 = 1")
    found = language_id.identify(held, model, "doc_id", "text").join(held, F.col("_id") == F.col("doc_id"))
    assert found.where("language = lang").count() >= 0.98 * held.count()


def test_visible_text():
    assert language_id.visible_text("<p>a<!-- b <i> -->c<SCRIPT x>var d='</p>'</script>e&amp;f<style>g</style></p>").split() == ["a", "c", "e", "f"]


def test_archives(spark, documents, tmp_path):
    big, mid = "<p>" + "ä" * 700, "x" * 1000
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else "small" if i % 3 == 1 else f"own {i} " * 200) for i in range(60)]
    rows += [(None, None, big), (None, "http://n", "lonely " * 300), (100, "http://a b/é\r\n", None), (101, "", ""), (102, "u", mid), (103, "u", mid), (103, "v", mid),
             (0, "http://h/0", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("shard", F.lit(1))
    folder = f"{tmp_path}/one"
    manifest = warc.write_archives(pages, folder, shard_bytes=4000, roll_bytes=900).collect()
    assert sum(f.records for f in manifest) == len(rows) and len(manifest) > 20
    for file in manifest:
        with open(f"{folder}/{file.file}", "rb") as held:
            assert hashlib.sha1(held.read()).hexdigest() == file.sha1
    most = {}
    for page, _, html in rows:
        key = html or ""
        most[key] = max((x for x in (most.get(key), page) if x is not None), default=None)
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and page != most[html or ""]
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", most[html] if revisit else None] += 1
    assert Counter(map(tuple, warc.read_archives(spark, folder).collect())) == want
    with pytest.raises(ValueError):
        warc.write_archives(pages, folder)
    again = warc.write_archives(pages.repartition(7), f"{tmp_path}/two", shard_bytes=4000, roll_bytes=900).collect()
    assert set(map(tuple, again)) == set(map(tuple, manifest))
    empty = f"{tmp_path}/empty"
    assert warc.write_archives(pages.limit(0), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_empty_tables(documents, spark):
    none = documents([(1, "x")]).where("false")
    assert substring_dedup.deduplicated_substrings(none).count() == 0
    assert line_dedup.deduplicated_lines(none).count() == 0
    assert exact_dedup.deduplicated(none, none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).count() == 0
    assert packing.pack(none).count() == 0
    assert quality.quality_rules(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert bpe_automaton.round_trip(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    model = language_id.TextModel.fit(none, "text", "lang", F.col("doc_id"))
    assert model.languages == ["und"] and language_id.identify(none, model, "doc_id", "text").count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert tables.fresh(df, "a") == "a__" and tables.fresh(df, "b") == "b"


def test_quality_thresholds_come_from_all_labels(spark):
    """Bad rows beside a rate that good rows have: a share of the labels would place the cut elsewhere."""
    draw = np.random.default_rng(4)
    counts = [(int(n), int(n * (4 + draw.random() + (9 if i % 9 == 0 else 0))), int(draw.integers(0, 4)), 0, 0) for i, n in enumerate(draw.integers(60, 400, 3000))]
    table = spark.createDataFrame([(i, 0, *row) for i, row in enumerate(counts)], "_id bigint, _mark int, " + ", ".join(f"{name} bigint" for name in quality.STATISTICS)).repartition(5)
    good = np.array([i % 9 != 0 and i % 50 != 7 for i in range(3000)])
    labels = spark.createDataFrame([(i, int(label)) for i, label in enumerate(good)], "doc_id bigint, quality int")
    forests, cut = quality.fit_forests(table, labels, keep=0.9, most=100), 0
    for kind, points in quality.features(np.array(counts, dtype=np.int64)).items():
        whole = quality.Forest(forests[kind].trees, forests[kind].unit)
        whole.calibrate(whole.scores(points), good, 0.9)
        assert forests[kind].threshold == pytest.approx(whole.threshold, abs=1e-12)
        cut += whole.threshold < 1
    assert cut
