"""Each training-data operator against a plain version of itself, on small tables with the odd cases in them."""

import hashlib
import random
import re
import tracemalloc
import zlib
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import components, fingerprints, licences, mixing, near_dedup, packing, paragraphs, pivot_search, quality, secrets, suffixes
from strataweave.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, kinds int, component int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghijéß") for _ in range(rng.randrange(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    base = prose(rng, 200)
    for k in range(12):  # near copies, some of them exact
        words = base.split()
        for _ in range(k // 3 * 2):
            words[rng.randrange(200)] = f"edit{k}{rng.randrange(9)}"
        out.append((100 + k, " ".join(words)))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "a b c"), (204, "A b C"), (205, "x " * 300), (206, "𝄞é " * 40), (207, "y" * 5000)]
    shared = prose(rng, 60)
    out += [(300 + k, f"{prose(rng, 30)} {shared} {prose(rng, 20)}") for k in range(3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a repeated id with another text, and null ids."""
    return spark.createDataFrame([(1, "token = abcdefgh " * 20), (1, "token = abcdefgh " * 20), (1, "other words here"), (None, "token=abcdefgh"), (None, None)], "doc_id long, text string").select("*", F.lit("s").alias("source"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


# secret scans


def spans_of(text):
    text, found = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end(), "assign")] if len(m[2]) >= 8 else []
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


SECRETS = [
    (1, 'token = "abcdefgh" é𝄞 password:secret=abcdefgh x'), (2, None), (3, ""), (4, "AKIA" + "A" * 11 + " AKIA" + "B" * 12 + " " + "a" * 31 + " " + "0f" * 20), (5, "TOKEN=secret:abcdefgh"),
    (6, "éé" * 50 + "𝄞api_key: 'zzzzzzzz' apikey=\"12345678\""), (7, "token=" + "ab" * 40 + " secret" + " " * 300 + "=" + "q" * 9), (8, "ghp_" + "a1" * 18 + " passwd=short"),
]


def test_secrets_equal_a_plain_scan(spark, docs, rows):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("_secret_kinds", F.lit(1))
    for frame, texts in ((df, dict(SECRETS)), (docs, dict(rows))):
        got = secrets.scan(frame).collect()
        assert len(got) == len(texts)
        for r in got:
            want = spans_of(texts[r.doc_id])
            told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
            assert set(told.split(",")) - {""} <= set(r.spans.split(","))
    assert "code_host:0:40" in next(r.spans for r in secrets.scan(df).collect() if r.doc_id == 8)


def test_trigram_queries_are_necessary():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for _, text in SECRETS:
            for m in re.finditer(rule.pattern, text or ""):
                assert query is None or any(all(t in m[0].lower() for t in c) for c in query)
    assert secrets.trigram_query("[0-9a-f]{32,}") is None
    assert secrets.trigram_query("abcd|xy") is None
    assert secrets.trigram_query("ab[cd]e?") == [frozenset({"abc"}), frozenset({"abd"})] or len(secrets.trigram_query("ab[cd]e?")) == 2


def test_secrets_in_odd_rows(odd, none):
    got = secrets.scan(odd).collect()
    assert sorted((r.doc_id is None, r.n_assign) for r in got) == [(False, 0), (False, 20), (False, 20), (True, 0), (True, 1)]
    assert secrets.scan(none).count() == 0


def test_redaction_leaves_no_secret_and_all_else(spark, docs):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == '[SECRET]" é𝄞 [SECRET] x' and got[1].n_chars == len(got[1].text) and got[2].text is None and got[5].text == SECRETS[4][1]
    assert not secrets.scan(out).filter("n_assign + n_access + n_hex > 0").count()
    clash = secrets.redact(df.withColumn("spans", F.lit("mine")).withColumn("kinds", F.lit(3)))
    assert {(r.spans, r.kinds) for r in clash.select("spans", "kinds").collect()} == {("mine", 3)}


def test_texts_of_many_secrets(spark, monkeypatch):
    many = [(1, "é token=abcdefgh1 AKIA" + "Z" * 14 + " password='secret=abcdefgh' " * 1500), (2, "no secret"), (3, "token=abcdefgh9")]
    df = spark.createDataFrame(many, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in many:
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_of(t)).encode()).hexdigest()
    redacted = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    monkeypatch.setattr(secrets, "PART", 7)
    assert redacted == {r.doc_id: r.text for r in secrets.redact(df).collect()} and "abcdefgh" not in redacted[1] and redacted[2] == "no secret"


# quality


def test_quality_learns_and_keeps_its_rows(spark, none):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80).title() if i % 4 else "BUY!! " * rng.randrange(20, 90), i % 4 and 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.drop("text"))
    got = {r.doc_id: r for r in quality.scored(df, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    again = quality.fit(df.drop("quality").repartition(7), df.drop("text").repartition(5))
    assert np.array_equal(model.leaves, again.leaves)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.held_out) for r in quality.scored(odd, model).collect())[2] == (True, False)
    assert quality.scored(none, model).count() == 0 and quality.accepted(none, model).columns == none.columns
    assert quality.fit(none, df.drop("text")).depth == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    model = quality.grow(x, (x[:, 1] + x[:, 2] > 0).astype(float), trees=5, depth=3)
    for row, score in zip(x[:40], model.scores(x[:40]), strict=True):
        total = model.start
        for f, t, leaf in zip(model.features, model.thresholds, model.leaves, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += leaf[k - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


# near duplicates


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(docs, rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    want = linked(sets, percent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_a_quasi_clique_is_settled_exactly(spark):
    rng = random.Random(8)
    base = prose(rng, 120, 4000).split()
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"e{k}x{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    want = linked({i: shingle_set(t) for i, t in rows}, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_pages_of_one_template_make_no_pairs_below_the_threshold(spark):
    rng = np.random.default_rng(6)
    template = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2)
    pages = [np.sort(np.concatenate([template, rng.integers(0, 1 << 63, int(n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for n in rng.integers(10, 14, 300)]
    near = [np.sort(np.concatenate([pages[0][:-2], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))]  # a link that must be found
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(pages + near)], "node long, set binary").cache()
    due = sets.select("node", F.col("node").alias("component"), (F.col("node") > 0).alias("minor"))
    pairs = {(r.a, r.b) for r in near_dedup.by_prefix(sets, due, 85).collect()}
    assert (0, 300) in pairs and len(pairs) < 10  # of 45,150


def test_hubs_link_copies_with_an_edit_each(spark):
    rng = random.Random(18)
    base = prose(rng, 60, 4000).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = list(base)
        words[6 + k % 48] = f"edit{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == linked({i: shingle_set(t) for i, t in rows}, 80) and set(got.values()) == {0}


def test_near_duplicates_in_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 3 + [("None", "None", False)] * 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    sketch = near_dedup.Sketch(registers=512)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b, both = (sketch.of_sets(s, np.array([0])) for s in (x[:2000], x[1000:], x))
    assert np.array_equal(np.maximum(a, b), both)
    assert sketch.estimate(a, b, np.array([2000.0]), np.array([2000.0]))[0] == pytest.approx(1 / 3, abs=0.08)


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100)}


# paragraphs


def test_paragraphs_and_pasted_passages(spark, none):
    rng = random.Random(5)
    passage, line = prose(rng, 52, 5000), prose(rng, 60, 5000)
    other = line.split()
    other[30] = "changed"
    rows = [
        (1, f"{prose(rng, 40, 5000)} {passage} {prose(rng, 30, 5000)}"), (2, f"{prose(rng, 33, 5000)} {passage} {prose(rng, 30, 5000)}\n{line}"), (3, prose(rng, 100, 5000)),
        (4, " ".join(other) + "\n" + prose(rng, 50, 5000)), (5, None), (6, ""), (None, passage), (7, passage),
    ]
    got = {r.doc_id: r for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()}
    assert len(got) == 8 and not any(got[k].n_removed for k in (1, 3, 5, 6, None))
    assert got[4].n_paragraphs == 1 and got[4].spans == f"0:{len(' '.join(other).encode()) + 1}"  # with its line's end
    at = rows[1][1].encode().find(passage.encode())
    for doc, zero in ((2, at), (7, 0)):
        assert got[doc].n_removed > 0
        for span in got[doc].spans.split(","):
            a, b = map(int, span.split(":"))
            assert zero <= a < b <= zero + len(passage.encode())
    assert paragraphs.paragraph_dedup(none).count() == 0


def test_near_lines_are_found_and_only_they_are_removed(spark):
    rng = random.Random(15)
    lines = []
    for _ in range(60):  # groups of near copies around the threshold
        base = prose(rng, 60, 3000).split()
        for _ in range(rng.randrange(2, 6)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            lines.append(" ".join(words))
    rng.shuffle(lines)
    ids = [rng.choice([-1, 1]) * rng.randrange(1 << 62) for _ in range(len(lines) // 3)]
    docs = {i: lines[3 * k : 3 * k + 3] for k, i in enumerate(ids)}
    got = {r.doc_id: r for r in paragraphs.paragraph_dedup(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")).collect()}
    flat = [(i, k) for i in sorted(docs) for k in range(3)]
    want = linked({n: shingle_set(docs[i][k]) for n, (i, k) in enumerate(flat)}, 80)
    gone = {flat[n] for n, c in want.items() if c != n}
    found = set()
    for i, x in docs.items():
        at = 0
        for k, line in enumerate(x):
            if any(a <= at and at + len(line.encode()) <= b for a, b in (map(int, s.split(":")) for s in got[i].spans.split(",") if s)):
                found.add((i, k))
            at += len(line.encode()) + 1
    assert len(gone) > 40 and found <= gone and len(found) >= 0.97 * len(gone)
    assert sum(r.n_paragraphs for r in got.values()) == len(found)


def test_near_equal_neighbours_of_one_text_meet(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(20):  # lines of fewer words than a window, next to each other, and blank lines that end blocks
        line = [f"w{x}" for x in rng.integers(0, 10**6, 20 + i % 5)]
        first, second = " ".join(line), " ".join([*line[:-1], "other"])
        rows.append((i, f"{first}\n\n{second}"))
        want[i] = f"{len(first) + 2}:{len(first) + 2 + len(second)}"
    got = {r.doc_id: r.spans for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


class Handed:
    """In place of a DataFrame: hands out the function that a step gives to its tasks."""

    def mapInArrow(self, run, schema):
        return run

    def repartition(self, *by):
        return self

    sortWithinPartitions = repartition


def most_held(run, rows):
    """(batches, MB that Python and numpy held at most meanwhile)."""
    tracemalloc.start()
    try:
        return list(run(iter(rows))), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_of_paragraphs_dont_hold_all_columns_of_every_key():
    rng = np.random.default_rng(15)
    words = np.array([f"w{i}" for i in range(10**5)])
    n, near, one = 60_000, 100, 5000
    texts = [" ".join(words[rng.integers(0, len(words), 25)]) for _ in range(n)]
    texts[-near:] = [f"{x} more" for x in texts[:near]]
    rows = [pa.record_batch([pa.array(np.arange(i, i + one)), pa.array(np.zeros(one, np.int64)), pa.array(texts[i : i + one])], ["doc", "part", "text"]) for i in range(0, n, one)]
    dealt, sent = most_held(paragraphs.sketched(Handed(), 1), rows)
    solved, held = most_held(paragraphs.gathered(Handed(), 1), [pa.Table.from_batches(dealt).combine_chunks().to_batches()[0]])
    found = pa.Table.from_batches(solved)
    met = {doc for doc, kind in zip(found["doc"].to_pylist(), found["kind"].to_pylist(), strict=True) if kind is None}
    assert met == {*range(near), *range(n - near, n)}
    assert sent < 85, sent  # MB; 121 with all columns of every key
    assert held < 35, held  # 74 there


def test_paragraph_rows_of_one_id_have_their_own_spans(spark, odd):
    rng = random.Random(7)
    line = prose(rng, 30, 5000)
    rows = [(1, line), (1, prose(rng, 9, 5000) + "\n" + line), (1, line), (2, None), (-(1 << 62), "")]
    got = sorted((r.doc_id, r.n_removed, r.spans) for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 5 and got[0] == (-(1 << 62), 0, "") and got[4] == (2, 0, "")
    size = len(line.encode())
    assert sum(r[1] for r in got) == 2 * size and {r[2] for r in got[1:4]} >= {"", f"0:{size}"}
    assert paragraphs.paragraph_dedup(odd).count() == 5


def test_equal_windows_are_removed_wherever_they_are_pasted(spark):
    rng = random.Random(21)
    passage = prose(rng, 51, 9000)
    rows = [(k, f"{prose(rng, rng.randrange(30, 90), 9000)} {passage} {prose(rng, rng.randrange(30, 90), 9000)}") for k in range(40)]
    got = {r.doc_id: r for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[0].n_removed and all(got[k].n_passages > 0 for k in range(1, 40))
    assert all(got[k].n_removed < 1.4 * len(passage.encode()) for k in range(1, 40))


def test_short_lines_and_blocks_of_them_are_paragraphs(spark):
    rng = random.Random(6)
    line, word = prose(rng, 10, 5000), prose(rng, 1, 5000)
    words = prose(rng, 60, 5000).split()
    laid = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    edited = [*words[:30], "changed", *words[31:]]
    alike = prose(rng, 19, 5000)  # a line that is most of its block
    rows = [
        (1, f"{line}\n\n{prose(rng, 30, 5000)}\n{word}"), (2, f"{prose(rng, 12, 5000)}\n\n{line}\n\n{word}"),
        (3, laid(words, 8)), (4, laid(edited, 7)), (5, f"{alike}\nend"), (6, f"{alike}\nend"), (7, "end\n" + alike), (8, f"{prose(rng, 9, 5000)}\n{prose(rng, 9, 5000)}"),
    ]
    got = {r.doc_id: r for r in paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = {i: len(t.encode()) for i, t in rows}
    assert sorted(i for i in got if not got[i].n_removed) == [1, 3, 5, 8]
    assert got[2].n_removed == len(f"{line}\n{word}".encode())
    assert all(got[i].spans == f"0:{size[i]}" for i in (4, 6, 7))


# suffixes


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_equal_a_plain_scan(spark, docs, rows):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdé ") for _ in range(150)) for _ in range(6)]
    hard = [(i, "".join(rng.choice(parts)[rng.randrange(40) : rng.randrange(60, 150)] for _ in range(8))) for i in range(50)]
    hard += [(100, "ab" * 400), (101, "a" * 500), (102, None), (103, ""), (104, parts[0][:99])]
    for frame, texts in ((spark.createDataFrame(hard, "doc_id long, text string"), hard), (docs, rows)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(frame).collect()}
        assert got == removed(texts)


def test_repeats_across_rows_of_one_id(odd, none):
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in suffixes.repeats(odd).collect())
    # the first of two equal rows keeps its first period and what a whole window needs
    assert got[0] == (False, 16, 0) and {g[2] for g in got if g[1] == 340} == {340 - 17, 340}
    assert suffixes.repeats(none).count() == 0


def test_multikey_order_is_the_lexicographic_order():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    assert np.array_equal(suffixes.multikey_order(*keys), np.lexsort(keys[::-1]))
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    assert np.array_equal(suffixes.sliding_least(x, 7), [x[i : i + 7].min() for i in range(294)])


# search


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 16))
    m[50:120] = m[50]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(400, None), (450, [1.0, float("nan")] + [0.0] * 14), (500, [None] + [1.0] * 15), (550, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(tuple(r) for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    q = np.floor(256 * m).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == want
    assert pivot_search.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert pivot_search.top_k(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_search_gathers_no_matrices_for_a_broadcast(spark, monkeypatch):
    plans, own = {}, pivot_search.table
    monkeypatch.setattr(pivot_search, "table", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and own(df, name))
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 8)) * np.where(np.arange(300) % 3, 1, 1e4)[:, None]  # too large for 16 bits and single precision
    m[100:200] = m[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert "SortMergeJoin" in plans["first"] and "Broadcast" not in plans["first"]
    q = np.floor(256 * m).astype(np.int64)
    want = []
    for i in range(0, 300, 50):
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5])]
    assert got == want


# fingerprints


def spans_alike(t, u):
    """The plain likeness: shared spans of both texts, all of them."""
    a, b = ({x[k : k + min(16, len(x))] for k in range(max(len(x) - 15, min(1, len(x))))} for x in (t, u))
    return 1.0 if t == u else 2 * len(a & b) / (len(a & b) + len(a | b)) if a | b else 0.0


def test_fingerprints_follow_the_next_document(docs, rows, none):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    prints: dict = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = t or "", u or "", got[i]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_next == pytest.approx(spans_alike(t, u), abs=0.25) and r.near_edited == pytest.approx(spans_alike(t, e), abs=0.25)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.common_start == next((k for k, (x, y) in enumerate(zip(t, u)) if x != y), min(len(t), len(u)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    for (i, _), (j, _) in zip(order, order[1:], strict=False):
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, got[j].fingerprint)
    assert fingerprints.fingerprints(none).count() == 0


def test_small_edits_anywhere_keep_fingerprints_alike():
    rng = random.Random(2)
    t = prose(rng, 2000, 3000)
    same = fingerprints.Print(t)
    for places in ([0, -1], [len(t) // 2], [5, 1000, 4000, -9]):
        u = list(t)
        for k in places:
            u[k] = "#"
        u = "".join(u)
        assert 0.9 < fingerprints.likeness(same.told, fingerprints.Print(u).told) < 1 or spans_alike(t, u) > 0.985
    assert fingerprints.likeness(same.told, fingerprints.Print(prose(rng, 2000, 3000)).told) < 0.05
    exact = [abs(fingerprints.likeness(fingerprints.Print(a).told, fingerprints.Print(b).told) - spans_alike(a, b)) for a, b in ((t[:k], t[: k // 2] + t[-k // 2 :]) for k in range(200, 6000, 300))]
    assert np.mean(exact) < 0.08


def test_long_texts_are_worked_through_in_blocks(monkeypatch):
    rng = random.Random(1)
    t, u = prose(rng, 700), prose(rng, 650)
    whole, other = fingerprints.Print(t), fingerprints.Print(t[:3000] + u)
    want = whole.told, whole.common_start(other), fingerprints.likeness(whole.told, other.told)
    monkeypatch.setattr(fingerprints, "BLOCK", 97)
    whole, other = fingerprints.Print(t), fingerprints.Print(t[:3000] + u)
    assert (whole.told, whole.common_start(other), fingerprints.likeness(whole.told, other.told)) == want


def test_buckets_of_two_hand_on_their_next(docs, rows, monkeypatch):
    want = sorted(map(tuple, fingerprints.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET", 2)
    assert sorted(map(tuple, fingerprints.fingerprints(docs).collect())) == want


def test_an_id_of_many_rows_is_cut_by_its_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 3)
    rows = [(5, f"text {k}") for k in range(40)] + [(None, f"none {k}") for k in range(30)] + [(9, "top"), (5, "text 3"), (5, "text 3"), (4, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(df.select("*", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    texts = [r.text for r in order]
    want = sorted((hashlib.sha256(fingerprints.edited(t, u).encode()).hexdigest(), fingerprints.Print(t).told) for t, u in zip(texts, texts[1:] + texts[:1], strict=True))
    assert sorted((r.edited_sha256, r.fingerprint) for r in fingerprints.fingerprints(df).collect()) == want
    assert fingerprints.fingerprints(odd).count() == 5


def test_prefix_arrays_answer_spans():
    a, b = fingerprints.Prefix("xxabcdefzz"), fingerprints.Prefix("abcdefgh")
    assert a.same(2, b, 0, 6) and not a.same(2, b, 0, 7) and a.extension(2, b, 0) == 6 and b.extension(0, a, 2) == 6
    assert a.spans(4)[2] == b.spans(4)[0] and a.spans(4)[2] != b.spans(4)[1]


# licences


def test_licences_equal_a_plain_scan(spark, docs, rows, none):
    cases = [(1, "CC-BY all rights reserved cc by cc cc by general public license General  Public\nlicense all all rights reserved"), (2, None), (3, ""), (4, "é all rights reserved"), (5, licences.TEMPLATES[2][1] + " x " + licences.TEMPLATES[4][1])]  # the MIT text and the Apache header
    for frame, texts in ((spark.createDataFrame(cases, "doc_id long, text string"), cases), (docs, rows)):
        got = {r.doc_id: r for r in licences.licences(frame).collect()}
        for i, t in texts:
            w = licences.tokens(t or "")
            hits = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(hits, default=(None,))[0], max(hits, default=(None,))[0], ",".join(sorted({x for _, x in hits})))
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if texts is cases:
            assert got[5].labels == "apache-2.0-header,mit-text" and got[5].score == 1
    assert licences.licences(none).count() == 0


def plain_chain(template, words, k):
    """The most words of ``template`` that a chain of maximal runs may cover in ``words``, by trying every run as its last."""
    anchors = []
    for i in range(len(words)):
        for t in range(len(template)):
            if words[i] == template[t] and not (i and t and words[i - 1] == template[t - 1]):
                n = 0
                while i + n < len(words) and t + n < len(template) and words[i + n] == template[t + n]:
                    n += 1
                if n >= licences.ANCHOR:
                    anchors.append((t, i, n))
    best = {}
    for t, i, n in sorted(anchors, key=lambda a: (a[1], a[0])):
        before = [c for (u, j, m), c in best.items() if 0 <= t - u - m <= licences.GAP and 0 <= i - j - m <= licences.GAP]
        best[t, i, n] = n + max(before, default=0)
    return max(best.values(), default=0)


def test_labels_are_those_of_well_covered_templates(spark):
    rng = random.Random(31)
    cases = []
    for k in range(30):
        label, text = rng.choice(licences.TEMPLATES)
        words = text.split()
        for _ in range(rng.choice([0, 2, 6, 20])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = [f"zz{rng.randrange(9)}"]
        cases.append((k, prose(rng, 20) + " " + " ".join(words[rng.choice([0, 0, len(words) // 2]) :]) + " " + prose(rng, 20)))
    cases.append((99, " ".join(["permission is hereby"] * 300)))
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    seen = 0
    for i, t in cases:
        w = licences.tokens(t)
        cover = {}
        for label, text in licences.TEMPLATES:
            own = licences.tokens(text)
            n = plain_chain(own, w, label)
            if n >= licences.COVER * len(own):
                cover[label] = max(cover.get(label, 0), min(1.0, n / len(own)))
        r = got[i]
        assert set(r.labels.split(",")) - {""} - set(r.base_labels.split(",")) == set(cover) - set(r.base_labels.split(","))
        assert r.score == pytest.approx(max([*cover.values(), 1.0 * bool(r.base_labels)], default=0.0))
        seen += bool(cover)
    assert seen > 12
    many = licences.licences(spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string"), templates=[("mine", "Two three FOUR five")]).first()
    assert (many.labels, many.score, many.spans) == ("mine", 1.0, "mine:1:5")


def test_matching_statistics_are_the_longest_runs():
    rng = random.Random(6)
    templates = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    text = [rng.randrange(4) for _ in range(200)]
    runs = {tuple(t[a:b]) for t in templates for a in range(12) for b in range(a, 13)}
    automaton = licences.Automaton(templates)
    for j, (state, n) in enumerate(automaton.statistics(text)):
        assert n == max(k for k in range(j + 2) if tuple(text[j + 1 - k : j + 1]) in runs)
        assert n == 0 or all(templates[k][at - n : at] == text[j + 1 - n : j + 1] for k, at in automaton.where[state])


# packing


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    strange = [(900, "İstanbul ΣΑΣ é don't I'LL <|endoftext|> a b a\x1cb 'tis, word.'s l'été.!? ½ ª x́."), (901, "word, WORD! Word. wörd's " * 30)]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(strange, "doc_id long, text string"))
    pieces = packing.pack(df, packing.vocabulary()).collect()
    by: dict = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, t in rows + strange:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids
        assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 and p.doc_tokens == len(ids) and p.offset == 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert packing.pack(none, packing.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, packing.vocabulary(), longest=1000)


def test_another_vocabulary_goes_through_its_own_tokenizer(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert not packing.encoder(path).cuts and packing.encoder(packing.vocabulary()).cuts
    tokenizer, got = Tokenizer.from_file(path), {}
    for p in sorted(packing.pack(docs, path, end=7).collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(p.ids)
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for i, t in rows}


def test_cuts_are_binary_digits():
    assert packing.cuts(5000) == [2048, 2048, 512, 256, 128, 8] and packing.cuts(1) == [1]


# mixing


def test_targets_fill_up():
    assert mixing.fill([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.fill([1, 100], [5, 2]) == pytest.approx([3, 98])
    assert mixing.fill([0, 0], [1, 1]) == [0, 0] and mixing.fill([], []) == []


def test_sainte_lague_equals_the_highest_quotients():
    rng = random.Random(9)
    assert mixing.sainte_lague([250, 50], 9) == [8, 1]
    for _ in range(300):
        votes = [rng.choice([0, rng.randrange(1, 1000), 50, 250, rng.random() * 90]) for _ in range(rng.randrange(1, 8))]
        seats, limits = rng.randrange(0, 60), rng.choice([None, [rng.randrange(0, 30) for _ in votes]])
        want = [0] * len(votes)
        for _ in range(seats):
            q = [(Fraction(v) / (2 * s + 1) if v and s < m else -1, -k) for k, (v, s, m) in enumerate(zip(votes, want, limits or [10**9] * len(votes), strict=True))]
            if max(q)[0] > 0:
                want[-max(q)[1]] += 1
        assert mixing.sainte_lague(votes, seats, limits) == want


def test_targets_equal_the_plain_filling(spark):
    rng = random.Random(12)
    for n in (1, 7, 60):
        sizes = {f"0s{rng.randrange(10**6)}": rng.choice([0, 1, 5, rng.randrange(1, 10**6)]) for _ in range(n)} | {"1": 40}
        rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "_mix_source string, _mix_size long")
        order = sorted(sizes)
        want = mixing.fill([sizes[k] for k in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
        got = {r._mix_source: r._mix_target for r in mixing.targets(rows).collect()}
        assert [got[k] for k in order] == pytest.approx(want)


def plain_blocks(rows, block, quota):
    """Words drawn of each (doc, size) that stand in this order on a shard's line, with the order of its blocks."""
    size = sum(n for _, n in rows)
    owner = [d for d, n in rows for _ in range(n)]
    blocks = [owner[k : k + block] for k in range(0, size, block)]
    full, rest = divmod(quota, size)
    n = len(blocks)
    mul = next(k for k in range(max(1, int(n * 0.618)), n + 2) if gcd(k, n) == 1)
    taken = {d: full * k for d, k in rows}
    for b in sorted(range(n), key=lambda b: (mul * b + 7919) % n):
        for d in blocks[b][: max(0, rest)]:
            taken[d] += 1
        rest -= len(blocks[b])
    return taken


def test_sources_of_any_size_meet_their_targets(spark):
    rng = random.Random(4)
    rows, sources = [], [1, 5, 8, 20, 31, 33, 50, 4000, 9000]
    for k, total in enumerate(sources):
        left = total
        while left:
            n = min(left, rng.randrange(1, 90))
            rows.append((len(rows), " ".join(f"w{rng.randrange(99)}" for _ in range(n)), f"s{k}"))
            left -= n
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    orders = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(1)).alias("o")).collect()}
    got = got.collect()
    for s in {r.source for r in got}:
        own = sorted((r for r in got if r.source == s), key=lambda r: orders[r.doc_id])
        quota = int(own[0].target + 0.5)
        assert sum(r.taken for r in own) == quota and all(r.taken <= 3 * r["size"] for r in own)
        assert {r.doc_id: r.taken for r in own} == plain_blocks([(r.doc_id, r["size"]) for r in own], 32, quota)


def test_mix_meets_its_targets_and_is_drawn(spark, docs, rows, odd, none):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    assert {r.doc_id: r.size for r in got} == size and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r["size"] for r in own)
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    drawn = mixing.drawn(docs.withColumn("target", F.lit(1)).withColumn("docs", F.lit(2)).withColumn("size", F.lit("x")))
    assert drawn.columns == [*docs.columns, "target", "docs", "size"] and {(r.target, r.docs, r["size"]) for r in drawn.collect()} == {(1, 2, "x")}
    words: dict = {}
    for r in drawn.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert {i: words.get(i, 0) for i in size} == {r.doc_id: r.taken for r in got}
    assert mixing.mix(odd).count() == 5 and mixing.mix(none).count() == 0 and mixing.drawn(none).count() == 0


def test_repeated_and_null_ids_are_drawn_as_they_are_counted(spark):
    rng = random.Random(19)
    rows = [(rng.choice([None, 1, 1, 2, k]), prose(rng, rng.choice([0, 3, 40, 40, 200])), rng.choice(["a", "b", None])) for k in range(120)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, source string")
    planned = sum(r.taken for r in mixing.mix(docs).collect())
    assert planned == sum(len(WORD.findall(r.text)) for r in mixing.drawn(docs).collect()) > 0


# texts


def test_shingles_know_their_texts():
    import pyarrow as pa

    texts = ["A b c d e f", None, "", "a b", "a b c d e f", "d e f a b"]
    for _, n, data, offsets in tx.chunks(pa.array(texts)):
        got = tx.sets(data, offsets)
        assert [len(s) for s in got] == [2, 0, 0, 1, 2, 1] and np.array_equal(got[0], got[4]) and n == 6
    assert sum(n for _, n, _, _ in tx.chunks(pa.array(texts).slice(1, 4), 3)) == 4


def test_a_footer_of_many_documents_is_spread(spark, monkeypatch):
    rng = random.Random(41)
    footer = prose(rng, 9, 999)[:57]
    rows = [(k, prose(rng, 40, 5000) + footer + prose(rng, 40, 5000)) for k in range(120)] + [(200 + k, footer * 4) for k in range(3)]
    monkeypatch.setattr(suffixes, "HEAVY", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slim = df.selectExpr("doc_id AS doc", "0 AS part", "text")
    assert len(suffixes._sampled(slim, 100, 8)[1])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(df).collect()}
    assert got == removed(rows)


def test_a_text_of_five_megabytes(spark):
    from tokenizers import Tokenizer

    rng = random.Random(51)
    parts = [prose(rng, 3000, 4000) for _ in range(60)]
    long_ = "\n".join(rng.choice(parts) + rng.choice([" token=abcdefgh1234", "", " cc by"]) for _ in range(330))
    assert len(long_.encode()) > 5_000_000
    rows = [(1, long_), (2, long_[:3000]), (3, parts[5] + " all rights reserved"), (4, long_.replace("a", "b", 40))]
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_of(t)).encode()).hexdigest()
    model = quality.grow(np.random.default_rng(1).normal(size=(50, len(quality.STATISTICS))), np.arange(50) % 2, trees=3)
    assert quality.scored(df, model).count() == 4
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert near == linked({i: shingle_set(t) for i, t in rows}, 85)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(df).collect()} == removed(rows)
    lines = {r.doc_id: r.n_removed for r in paragraphs.paragraph_dedup(df).collect()}
    assert lines[1] > 0.7 * len(long_.encode()) and lines[4] > 0.95 * len(long_.encode())
    prints = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert prints[4].near_next < 0.9 and prints[1].n_chars == len(long_) and fingerprints.likeness(prints[1].fingerprint, prints[4].fingerprint) > 0.8
    assert {r.doc_id: r.n_base for r in licences.licences(df).collect()}[1] == len(re.findall(r"\bcc by\b", long_))
    tokenizer, ids = Tokenizer.from_file(packing.vocabulary()), {}
    for p in sorted(packing.pack(df, packing.vocabulary()).collect(), key=lambda p: p.start):
        ids.setdefault(p.doc_id, []).extend(p.ids)
    assert ids == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    assert sum(len(WORD.findall(r.text)) for r in mixing.drawn(df).collect()) == sum(taken.values()) == sum(len(WORD.findall(t)) for _, t in rows)
