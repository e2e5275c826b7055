"""Operators on text against plain versions of the same rules."""

from __future__ import annotations

import collections
import math

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from manyfold.llm import decontaminate, html_text, language_id, line_dedup, mixing, neighbours, queries, simhash_dedup, substring_dedup, token_counts, url_filter
from manyfold.llm.pieces import vocabulary
from tests.conftest import SMALL

VOCABULARY = queries.vocabulary_path()


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    codes = sorted({m for _, m in marks})
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: math.inf)
    for doc, m in marks:
        if doc is not None:
            least[find(m)] = min(least[find(m)], doc)
    return [(doc, f"{m:016x}", None if least[find(m)] == math.inf else least[find(m)]) for doc, m in marks]


def test_simhash_components(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    base = rows[0][1]
    near = [(9000 + k, base + " x" * k) for k in range(6)]
    odd = [(None, base), (7001, None), (7002, ""), (7003, " \n"), (7004, "one two"), (7004, "one two"), (7005, "one two x1"), (None, "one two")]
    rows += near + odd
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = queries_simhash(df)
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def queries_simhash(df):
    found = simhash_dedup.near_duplicates(df)
    shown = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
    return [tuple(r) for r in shown.collect()]


def test_links_equal_brute_force_in_clusters(spark):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = {0, (1 << 64) - 1}
    for c in centers.tolist():
        for _ in range(120):
            code = c
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                code ^= 1 << bit
            codes.add(code)
    codes = np.array(sorted(codes), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    got = {frozenset((r.u, r.v)) for r in simhash_dedup.links(df).collect()}
    apart = np.bitwise_count(codes[:, None] ^ codes[None])
    signed = codes.view(np.int64).tolist()
    assert got == {frozenset((signed[i], signed[j])) for i, j in zip(*np.nonzero((apart <= 2) & (apart > 0)))}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 201)], "u long, v long")
    roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert {roots[k] for k in range(71)} == {0} and roots[201] == 200


def plain_survivors(rows):
    """The least (doc_id, text) of each component of fingerprints, ids that are null last."""
    marks = [plain_fingerprint(t) for _, t in rows]
    least = {c: g for c, (_, _, g) in zip(marks, plain_components([(k, m) for k, m in enumerate(marks)]))}
    groups = collections.defaultdict(list)
    for (doc, text), mark in zip(rows, marks):
        groups[least[mark]].append((doc is None, doc or 0))
    return sorted(min(g) for g in groups.values())


def test_one_document_of_each_group_stays(spark):
    text = "some words that are many enough to make shingles of three words each"
    rows = [(3, text, "a"), (1, text, "b"), (2, text.upper(), "c"), (5, "quite another text with other words in it", "d"), (5, "quite another text with other words in it", "d"), (None, text, "e"), (None, "a text without an id", "f"), (None, "a text without an id", "f")]
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted((r.doc_id or 0, r.row) for r in kept) == [(0, "f"), (1, "b"), (5, "d")]


def test_survivors_equal_all_pairs(spark):
    """Groups of edited copies, some of which are linked to others only through a third."""
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    rows += [(8000, None), (8001, ""), (8002, " "), (8003, "one two"), (8004, "ONE\ttwo"), (8005, "one two three"), (None, "one two four"), (None, None)]
    for group, size in enumerate((2, 5, 60)):
        words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        for copy in range(size):
            own = list(words)
            for at in rng.integers(0, len(own), rng.integers(0, 4)):
                own[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((9000 + 100 * group + copy, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash_dedup.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == plain_survivors(rows)
    assert len(got) < len(rows) - 40


def test_rows_of_one_id_are_compared_by_their_texts(spark):
    words = [[f"{letter}{k}" for k in range(60)] for letter in "abcd"]
    clean, near, other = (" ".join(w) for w in words[:3])
    rows = [(7, other, "clean of 7"), (7, near.upper(), "copy of 3"), (3, near, "3"), (9, clean, "one"), (9, clean.upper(), "one"), (9, " ".join(words[3]), "second of 9"), (9, None, "null of 9")]
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted(r.row for r in kept) == ["3", "clean of 7", "null of 9", "one", "second of 9"]


# Decontamination


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def shingles(text, size=5):
    words = plain_words(text)
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def test_leaks_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = items[0][1].split()
    docs += [
        (5001, "before " * 3000 + items[0][1].upper() + " after" * 3000),
        (5002, " ".join([*words[: len(words) // 2], *["other"] * 40, *words[len(words) // 2 :]])),
        (5003, " ".join(words[: max(5, len(words) // 3)])),
        (5004, None),
        (5005, ""),
        (None, "x " + items[1][1]),
        (5001, "before " * 3000 + items[0][1].upper() + " after" * 3000),
        (5006, "one two three four five"),
    ]
    items += [(904, docs[3][1].split()[5]), (905, " ".join(docs[4][1].split()[2:6])), (906, "never said"), (907, "..."), (908, docs[3][1].split()[5])]
    items += [(900, items[0][1]), (900, items[0][1]), (901, None), (902, "four words are few"), (903, "One, two; three - four: five!"), (None, items[1][1] + " z")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for item, text in items:
        size = min(5, len(plain_words(text)))
        own = shingles(text, size) if size else set()
        if own and item is not None:
            for doc, t in docs:
                if len(own & shingles(t, size)) / len(own) >= 0.8:
                    want.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) > 3 and {900, 904, 908} < {item for _, item in want}
    assert got.count() == got.distinct().count()


def test_decontaminated_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "clean text of the same id", "y"), (None, "a b c d e", "z"), (2, None, "w")], "doc_id long, text string, leak_doc string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert sorted(r.leak_doc for r in decontaminate.decontaminate(docs, items).collect()) == ["w", "y"]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 4


# Substring dedup


def test_passages_inside_lines_go_once(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    passage = prose(80) + "."
    texts = {k: prose(60) for k in range(1, 9)}
    for k in (2, 4, 6):
        texts[k] = f"é{prose(20)} {passage} {prose(30)}"
    texts[9] = texts[3]
    texts[10], texts[11] = None, ""
    df = spark.createDataFrame([(k, t, "r") for k, t in texts.items()], "doc_id long, text string, row string")
    got = {r.row.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    core = " ".join(passage.split()[12:66])
    assert core in got[2].text and core not in got[4].text and core not in got[6].text
    assert got[9].text == "" and got[3].text == texts[3]
    for k in (1, 5, 7, 8, 10, 11):
        assert got[k].text == texts[k] and not got[k].removed
    for k in (4, 6):
        rest = texts[k]
        for span in reversed(got[k].removed):
            rest = rest[: span["from"]] + rest[span["to"] :]
        assert rest == got[k].text
        words = got[k].text.split()
        assert words[:15] == texts[k].split()[:15] and words[-15:] == texts[k].split()[-15:]


def test_long_text_is_cut_into_pieces(spark):
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}é." for x in rng.integers(0, 10**9, 60_000))
    df = spark.createDataFrame([(1, text), (2, "before all. " + text)], "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in substring_dedup.drop_repeats(df).collect()}
    assert got[1] == text and len(got[2]) < 400


def plain_units(text):
    """Words, and first word and length of the lines and paragraphs of a text."""
    words, blocks = [], [[]]
    for line in text.lower().split("\n"):
        own = line.split()
        if own:
            blocks[-1].append((len(words), len(own)))
            words += own
        else:
            blocks.append([])
    lines = [x for block in blocks for x in block]
    return words, lines + [(block[0][0], sum(n for _, n in block)) for block in blocks if len(block) > 1]


def plain_repeats(texts, n=substring_dedup.MIN_WORDS, least=substring_dedup.MIN_LINE_WORDS):
    """The places of the words that go: covered by a line, paragraph or run of n words that an earlier document has, or this one before."""
    first, gone = {}, {}
    for doc, text in sorted(texts.items()):
        words, units = plain_units(text)
        gone[doc] = set()
        runs = [("run", k, n) for k in range(len(words) - n + 1)]
        for kind, k, size in sorted([("unit", k, m) for k, m in units if m >= least]) + runs:
            owner, place = first.setdefault((kind, *words[k : k + size]), (doc, k))
            if owner != doc or k - place >= size:
                gone[doc].update(range(k, k + size))
    return gone


def test_lines_and_paragraphs_go_once(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"{x:x}" for x in rng.integers(1 << 28, 1 << 32, n).tolist())
    paragraph, line, heading = prose(25), prose(12), prose(4)
    texts = {k: f"{heading}\n\n{prose(40)}\n\n{paragraph}\n\n{prose(20)}" for k in range(5)}
    words = paragraph.split()
    texts[5] = f"{prose(20)}\n\n{' '.join(words[:9]).upper()}\n {' '.join(words[9:17])}\t\n{' '.join(words[17:])}\n\n{prose(20)}"
    texts[6], texts[7] = f"{line}\n{prose(15)}\n{line}", f"{prose(15)}\r\n  {line}  \r\n{prose(15)}"
    texts[8], texts[9] = f"{prose(8)} {line} {prose(8)}", line
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.row.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert {k: got[k].words_removed for k in texts} == {0: 0, 1: 25, 2: 25, 3: 25, 4: 25, 5: 25, 6: 12, 7: 12, 8: 0, 9: 12}
    assert all(got[k].text.startswith(heading) and got[k].text == texts[k].replace(paragraph, "") for k in range(1, 5))
    assert got[6].text.startswith(line) and got[9].text == ""
    for k in texts:
        cut = "".join(texts[k][x["from"] : x["to"]] + " " for x in got[k].removed)
        assert len(cut.split()) == got[k].words_removed
    longer = {r.row.doc_id: r.words_removed for r in substring_dedup.drop_repeats(df, min_line_words=4).collect()}
    assert [longer[k] for k in range(1, 5)] == [29] * 4


def test_repeats_of_odd_tables(spark):
    same = " ".join(f"w{k}" for k in range(20))
    rows = [(1, same, 1), (1, same, 2), (None, same, 3), (2, None, 4), (3, "\n \n", 5), (3, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words_removed int").withColumn("text_digest", F.lit("x"))
    got = {r.row.words_removed: (r.text, r.words_removed) for r in substring_dedup.drop_repeats(df).collect()}
    assert got == {1: (same, 0), 2: (same, 0), 3: ("", 20), 4: (None, 0), 5: ("\n \n", 0), 6: ("", 0)}
    assert substring_dedup.drop_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("stops", [True, False])
def test_whole_passages_of_30_to_150_words_go(spark, stops):
    """The same passage at random places of two documents, with sentences of usual length or none; nothing else goes."""
    rng = np.random.default_rng(4)
    prose = lambda n: [f"{x:x}" + "." * (stops and rng.random() < 0.08) for x in rng.integers(1 << 28, 1 << 32, n).tolist()]
    texts, left = {}, {}
    for trial, size in enumerate([29, 30, 51, 60, 75, 100, 150] * 20):
        passage = prose(size)
        for doc in (2 * trial, 2 * trial + 1):
            before, after = prose(rng.integers(0, 80)), prose(rng.integers(0, 80))
            texts[doc] = " ".join([*before, *passage, *after])
            left[doc] = [*before, *after] if doc % 2 and size >= 30 else [*before, *passage, *after]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.row.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert {k: got[k].text.split() for k in texts} == left
    assert all(got[k].words_removed == len(texts[k].split()) - len(left[k]) for k in texts)


def test_repeats_equal_brute_force(spark):
    """Passages of several documents that share parts of each other, in lines or not, repeats within a text, periods, and real texts."""
    rng = np.random.default_rng(6)
    source = [f"s{k}" for k in range(400)]
    texts = {}
    for doc in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            a, size = rng.integers(0, 400), rng.integers(5, 90)
            parts += source[a : a + size] + [f"x{x}" for x in rng.integers(0, 10**9, rng.integers(0, 3))]
        texts[doc] = "\n".join(parts) if doc % 2 else " ".join(parts).upper()
        if doc % 4 == 0:
            texts[doc] = "".join(w + ("\n \n" if int(w[1:]) % 40 == 0 else "\n" if int(w[1:]) % 12 == 0 else " ") for w in parts)
    texts[100], texts[101] = "a " * 200, "b c d " * 50
    texts |= {200 + k: f"y{k} " + " ".join(source[100:140]) + f" z{k}" for k in range(80)}
    texts |= {1000 + r.doc_id: r.text or "" for r in documents(spark).select("doc_id", "text").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    gone = plain_repeats(texts)
    got = {r.row.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert {k: got[k].words_removed for k in texts} == {k: len(v) for k, v in gone.items()}
    for k, text in texts.items():
        words = text.split()
        assert " ".join(got[k].text.split()) == " ".join(w for at, w in enumerate(words) if at not in gone[k])


# Language


def plain_probability(word, pieces, p):
    best = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            k = pieces.get(word[start:end])
            if k is not None:
                best[end] += best[start] * p[k]
        if word[end - 1] not in pieces:
            best[end] += best[end - 1] * language_id.UNKNOWN
    return best[-1]


def test_forward_sums_and_expected_counts():
    names, _ = vocabulary(VOCABULARY)
    pieces = {x: k for k, x in enumerate(names)}
    p = np.random.default_rng(0).dirichlet(np.ones(len(names)), 2).T
    words = ["▁the", "▁straße", "▁日本xy", "x", "▁" + "a" * 31]
    sums = language_id.Sums(VOCABULARY, words, p)
    want = [[plain_probability(w, pieces, p[:, k]) for k in range(2)] for w in words]
    assert np.allclose(sums.logs(), np.log(want))
    # Each letter belongs to one piece or is unknown, so expected uses times lengths add up to the letters.
    known = ["▁the", "▁other"]
    sums = language_id.Sums(VOCABULARY, known, p)
    uses = sums.expected(np.ones((2, 1)))
    assert np.allclose((uses * sums.lattice.length[:, None]).sum(axis=0), sum(map(len, known)))


def test_held_out_accuracy_and_odd_texts(spark):
    docs = documents(spark)
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", "en"), (90003, "123 !!", "fr"), (None, "the and of", None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs.select("doc_id", "text", "lang").union(odd), VOCABULARY)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == docs.count() + 4
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (90001, 90002, 90003))
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), VOCABULARY).collect()} == {"und"}


def test_number_signs_are_no_letters_and_every_label_is_learned(spark):
    assert language_id.words_of("½ ² Ⅷ ① 12") == [] and language_id.words_of("a½b") == ["▁a", "▁b"]
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 30, f"l{k:03}", "clash") for k in range(300)]
    df = spark.createDataFrame([*rows, (901, "½ ² Ⅷ", "l000", "x"), (902, "x" * 100_000, None, None), (902, "x" * 100_000, None, None)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df, VOCABULARY, rounds=1).collect()}
    assert got[901].lang_pred == "und" and got[901].score == 0 and 0 < got[902].score <= 1
    learned = [k for k, r in got.items() if k < 300 and not r.held_out]
    assert len({got[k].lang_pred for k in learned}) > 200
    assert language_id.identify(df.limit(0), VOCABULARY, rounds=1).collect() == []


def test_a_worker_learns_a_word_once(spark, monkeypatch):
    """A worker keeps the words of its tasks while the model is the same; long runs count the letters of their stretches."""
    p = np.full((len(language_id.vocabulary(VOCABULARY)[0]), 2), 1e-5) * [1.0, 2.0]
    judge = language_id.predictor(spark, ["a", "b"], p, VOCABULARY).func
    learned, whole = [], language_id.Sums
    monkeypatch.setattr(language_id, "Sums", lambda path, words, p: (learned.extend(words), whole(path, words, p))[1])
    texts = pd.Series(["one two", "x" * 70 + " two", None, "12"])
    first, again = (pd.concat(judge(iter([texts]))) for _ in range(2))
    assert first.equals(again) and sorted(learned) == sorted(["▁one", "▁two", "▁" + "x" * 31, "x" * 32, "x" * 7])
    assert first["letters"].tolist() == [8, 75, 0, 0] and first["lang_pred"].tolist() == ["b", "b", "und", "und"]
    other = language_id.predictor(spark, ["a", "b"], p[:, ::-1], VOCABULARY).func
    assert pd.concat(other(iter([texts])))["lang_pred"].tolist() == ["a", "a", "und", "und"] and len(learned) == 10


def test_every_labelled_text_teaches(spark):
    """One text among a thousand has the letter that tells; by its hash it was in no sample of 400."""
    ids = spark.range(1000, 2000).withColumnRenamed("id", "doc_id").filter(~language_id.held_out())
    last = ids.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) > 0.9 * (1 << 30)).first().doc_id
    rows = [(k, "a", "l0") for k in range(1000)] + [(k, "q " * 20 if k == last else "b b b b", "l1") for k in range(1000, 2000)]
    df = spark.createDataFrame([*rows, (5000, "q", None)], "doc_id long, text string, lang string")
    assert language_id.identify(df, VOCABULARY).filter("doc_id = 5000").first().lang_pred == "l1"


def test_without_labels_nothing_is_rejected(spark):
    df = spark.createDataFrame([(k, "some text", None) for k in range(50)], "doc_id long, text string, lang string")
    assert language_id.keep_known_languages(df, VOCABULARY).count() == 50
    assert {r.lang_pred for r in language_id.identify(df, VOCABULARY).collect()} == {"und"}


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    rng = np.random.default_rng(8)
    noise = [(70000 + k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(100)), None) for k in range(10)]
    foreign = "Kolme miestä käveli hiljaa metsän läpi, eikä kukaan heistä tiennyt, mihin polku lopulta johtaisi ennen yön tuloa. " * 4
    odd = spark.createDataFrame([*noise, (70100, foreign, None), (70101, None, "en"), (70102, "12 !", "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.keep_known_languages(docs.union(odd), VOCABULARY).select("doc_id").collect()}
    assert not {k for k in kept if k >= 70000}
    # Of the documents, junk apart, nearly all stay.
    assert len(kept) >= 0.95 * docs.count()


# Tokens


def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models

    pieces, scores = vocabulary(VOCABULARY)
    byte_pieces = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *byte_pieces, *zip(pieces, scores.tolist())], unk_id=0, byte_fallback=True))
    texts = [r.text for r in documents(spark).select("text").collect()]
    texts += ["日本語 テスト\n\n  x", "a" * 700, "  ", "\n", "é½² _3a.b..c!! \t tab nb", "🙂🙂 x🙂", "▁▁a b▁c", "", "same same", "same same"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, VOCABULARY).collect()}
    assert got.pop(-1) == 0
    for k, text in enumerate(texts):
        want = len(exact.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert got[k] == want, text[:50]


# Pages


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("just some words", "just some words"),
        ("<p>a &amp; b<br>c</p><script>x('</p>')</script>", "a & b c"),
        (
            "<html><head><title>t</title></head><body><header><a href='/'>Home</a></header><nav><ul><li><a href='/x'>x</a></li></ul></nav>"
            "<div class='cookie-notice'>We use cookies on this site and so on and on.</div><article><header><h1>Title</h1></header>"
            "<p>First  paragraph\n with <b>bold</b> words that go on for a while.<p>Second paragraph &eacute; that is long enough too.</article>"
            "<aside>Side text of some length that is not wanted.</aside><div id='comments'><p>I do not agree with any of this at all.</p></div>"
            "<form><label>Mail</label></form><footer>&copy; all of us</footer></body></html>",
            "Title\nFirst paragraph with bold words that go on for a while.\nSecond paragraph é that is long enough too.",
        ),
        (
            "<body><div class='menu'><a href='a'>A</a></div><div id='main-content'><h2>Head</h2><div>One long line of text that says a lot of things.</div>"
            "<div>Another long line of text that says even more than that.</div></div><div class='sidebar widget'>Popular posts of the week</div></body>",
            "Head\nOne long line of text that says a lot of things.\nAnother long line of text that says even more than that.",
        ),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


SENTENCE = "This is a sentence of the article that goes on for quite some time, as they do."
ENTRY = "".join(f"<p>{k}. {SENTENCE} {SENTENCE}</p>" for k in range(12))
WANTED = "\n".join(f"{k}. {SENTENCE} {SENTENCE}" for k in range(12))


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><article><h1>Title</h1><p>A short lead.</p><div class=entry>{ENTRY}</div></article></body>", f"Title\nA short lead.\n{WANTED}"),
        (f"<body><div><h1>Title</h1><p>A short lead.</p><div class=entry>{ENTRY}</div></div><footer>x</footer></body>", f"Title\nA short lead.\n{WANTED}"),
        (f"<article><p>A short lead.</p><blockquote>{ENTRY}</blockquote><p>And an end.</p></article>", f"A short lead.\n{WANTED}\nAnd an end."),
        (f"<body><article>{ENTRY}</article><article><p>{SENTENCE} {SENTENCE}</p></article></body>", f"{WANTED}\n{SENTENCE} {SENTENCE}"),
        (f"<html><head><title>t</title><meta charset=utf-8><body><article>{ENTRY}</article></body></html>", WANTED),
        (f"<html><head><title>t</title><script>var x = 1;</script><div>{ENTRY}</div></html>", WANTED),
        *((f"<body><div class='{c}'><article>{ENTRY}</article><div class=sidebar><p>{SENTENCE}</p></div></div></body>", WANTED) for c in ("wrap has-sidebar", "with-sidebar", "no-sidebar")),
        (f"<body><div class=has-sidebar><div>{ENTRY}</div><div class=sidebar><p>Popular posts</p></div></div></body>", WANTED),
        (f"<body><article><p>{SENTENCE} {SENTENCE}</p></article><div id=comments><article>{ENTRY}</article></div></body>", f"{SENTENCE} {SENTENCE}"),
    ],
)
def test_the_whole_article_stays(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>before <button>press</button> after</p>", "before after"),
        ("<p>a <svg><text>x</text></svg>b <span class=ad>buy</span>c</p>", "a b c"),
        (f"<article><p>Energy <math><mi>E</mi></math> is {SENTENCE}</p></article>", f"Energy E is {SENTENCE}"),
        (f"<body><article><h1 class=social>Title</h1><div class=hidden-figure><p>{SENTENCE}</p></div><p class='related work'>{SENTENCE}</p></article></body>", f"Title\n{SENTENCE}\n{SENTENCE}"),
        (f"<body><article><p>{SENTENCE}</p><p>one <span class=promo>buy now</span> two {SENTENCE}</p><div class='hidden'>gone</div></article></body>", f"{SENTENCE}\none two {SENTENCE}"),
    ],
)
def test_blocks_stay_whole(html, want):
    assert html_text.main_text(html) == want


def test_deep_pages_take_linear_time():
    import time

    for n, page in ((100_000, "<b>" * 100_000 + "</div>" * 100_000), (100_000, "<div><p>" * 50_000 + "x" + "</i>" * 100_000), (50_000, "<header>" * 50_000)):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10, (n, page[:10])


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{SENTENCE}</p>", "t", 3), (1, "u", f"<p>{SENTENCE}</p>", "t", 3), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "", 0), *[(1, SENTENCE, len(SENTENCE))] * 2]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pages_keep_their_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        import html as h
        import re

        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


# Neighbours


def test_neighbours_recall_and_order(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    copies = [(10_000 + 10 * k, vectors[7].tolist()) for k in range(40)]
    odd = [(20_000, None), (20_100, [0.0] * 64), (20_200, [float("nan")] * 64), (20_300, [1.0]), (None, vectors[7].tolist()), (7, vectors[7].tolist())]
    df = rows.union(spark.createDataFrame(copies + odd, rows.schema))
    vectors |= {k: np.array(v) for k, v in copies}
    got = collections.defaultdict(list)
    for r in neighbours.neighbours(df, F.col("vec_id") % 100 == 0, trees=2).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {k for k in vectors if k % 100 == 0}
    ids = np.array(sorted(vectors))
    table = np.array([vectors[k] for k in ids])
    found = 0
    for q, rows_ in got.items():
        apart = np.sqrt(((table - vectors[q]) ** 2).sum(axis=1))
        order = [(int(ids[k]), apart[k]) for k in np.lexsort((ids, apart)) if ids[k] != q][:10]
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows_] == sorted((s, v) for _, v, s in rows_)
        assert all(math.isclose(s, np.sqrt(((vectors[v] - vectors[q]) ** 2).sum()), rel_tol=1e-12, abs_tol=1e-12) for _, v, s in rows_)
        found += len({v for v, _ in order} & {v for _, v, _ in rows_})
        if q >= 10_000:
            assert [v for _, v, _ in rows_] == [v for v, _ in order]
    assert found / (10 * len(got)) >= 0.95
    assert neighbours.neighbours(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.neighbours(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def nearest_found(spark, vectors, every):
    """Rows of each query, and the share of its true ten nearest among them."""
    df = spark.createDataFrame([(k, v.tolist(), "clash", 1.0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, id string, dist double")
    got = collections.defaultdict(set)
    for r in neighbours.neighbours(df, F.col("vec_id") % every == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(vectors), every):
        apart = ((vectors - vectors[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        hits += len(got[q] & set(np.argsort(apart, kind="stable")[:10].tolist()))
    return got, hits / (10 * len(got))


def test_every_query_of_a_small_table_finds_ten(spark):
    vectors = np.random.default_rng(3).normal(size=(60, 8)).astype(np.float32)
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, recall = nearest_found(spark, vectors, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [len(got[q]) for q in range(0, 60, 10)] == [10] * 6 and recall == 1


def test_recall_over_many_blocks(spark):
    """The query's own settings on a table of twenty blocks, in clusters that random projections part."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(60, 32))[rng.integers(0, 60, 5000)] + 0.6 * rng.normal(size=(5000, 32))).astype(np.float32)
    got, recall = nearest_found(spark, vectors, 100)
    assert recall >= 0.95 and {len(v) for v in got.values()} == {10}


# Mixing


def plain_inverse(share, knots):
    steps = np.linspace(0, 1, 200_001)
    level = np.interp(steps, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate([[0], np.cumsum((level[1:] + level[:-1]) / 2 * np.diff(steps))])
    return np.interp(share * area[-1], area, steps)


def test_positions_follow_the_demand(spark):
    rows = [(k, source, "w " * (1 + k % 7)) for k, source in enumerate(["a", "b", "c", None] * 300)]
    rows += [(5000, "a", None), (5001, "b", ""), (None, "a", "x y"), (3, None, "w " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.row.source].append(r)
        assert r.taken <= 2 * r.size and r.taken == sum(p["words"] for p in r.passes)
        assert r.size == len((r.row.text or "").split())
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    for k, (source, own) in enumerate(sorted(by.items(), key=lambda x: (x[0] is None, x[0]))):
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].target <= 2 * own[0].source_size
        drift = mixing.DRIFT[k % 3] / 2
        knots = [(0, weights[source] * (1 - drift)), (1, weights[source] * (1 + drift))]
        places = sorted((p["position"], p["words"]) for r in own for p in r.passes)
        before = 0
        for position, words in places:
            assert math.isclose(position, plain_inverse(before / own[0].target, knots), abs_tol=1e-4)
            before += words
    total = sum(r.size for r in out)
    assert math.isclose(sum(own[0].target for own in by.values()), 1.5 * total, rel_tol=1e-9)
    order = [r.mix_position for r in mixing.training_order(df).collect()]
    assert order == sorted(order)
    assert mixing.mix(df.limit(0)).count() == 0


# Lines and urls


def test_lines_of_a_site(spark):
    rows = [(k, "s", f"head {k}\n  Follow us \n\nfoot") for k in range(9)] + [(20, "t", "Follow us"), (21, None, "Follow us\nx"), (22, "s", None), (23, "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lines_", F.lit(1)).withColumn("n_dropped", F.lit("clash"))
    got = {r.row.doc_id: r for r in line_dedup.drop_site_lines(df, min_pages=3).collect()}
    assert got[4].text == "head 4\n" and got[4].n_dropped == 2 and got[4].n_lines == 4
    assert got[20].text == "Follow us" and got[21].text == "Follow us\nx" and got[22].text is None and got[23].text == ""
    assert line_dedup.without_site_lines(df).columns == df.columns
    assert line_dedup.without_site_lines(df.limit(0)).count() == 0


def test_distrust_flows_back_along_links(spark):
    rules = spark.createDataFrame([("bad.test/", "block"), ("good.test/", "allow")], "rule string, verdict string")
    rows = [
        (1, "http://bad.test/x", ""),
        (2, "http://friend.test/a", "<a href='https://bad.test/'>x</a>"),
        (3, "http://linked.test/a", ""),
        (4, "http://www.good.test/a?b", "<a href=//linked.test/a>"),
        (5, "no url", None),
        (6, None, None),
        (7, "http://OTHER.test", None),
        (7, "http://OTHER.test", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[1] == ("bad.test", "/x", "bad.test/", "block")
    assert got[2] == ("friend.test", "/a", None, "block")
    assert got[3] == ("linked.test", "/a", None, "allow")
    assert got[4] == ("www.good.test", "/a", "good.test/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][:3] == ("other.test", "", None)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_a_farm_around_a_blocked_host(spark):
    """Hosts that link to nothing but one blocked host are blocked, however many; a host with many other links is not."""
    rules = spark.createDataFrame([("bad.test/", "block")], "rule string, verdict string")
    rows = [(0, "http://bad.test/", "")]
    rows += [(k, f"http://farm{k}.test/{'x' * 5000 * (k == 7)}", "<a href='http://bad.test/'>x</a>") for k in range(1, 101)]
    rows += [(200, "http://portal.test/", "".join(f"<a href='//site{k}.test/'>" for k in range(50)) + "<a href=//bad.test/>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, rule string, n_ int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules).collect()}
    assert got.pop(200) == "allow" and set(got.values()) == {"block"} and len(got) == 101


# The pipeline


def test_stages_on_odd_documents(spark, tmp_path):
    import corpus_pipeline

    text = "the words of this document are many and they go on for a while so that shingles can be made"
    rows = [(1, text, "en", "a", 5), (2, text, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "123", "en", "b", 3), (None, text + " and more of it", "en", "a", 9), (6, "x " * 40_000, "en", None, 80_000), (6, "x " * 40_000, "en", None, 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("clash")).withColumn("size", F.lit(7))
    spark.createDataFrame([(1, "the words of this document are many")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.mix(spark, frame, str(tmp_path)).collect()


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs, before = documents(spark), None
    truth = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SMALL), "test-stage")
        now = {r.doc_id: r.text for r in docs.collect()}
        before = before or truth
        assert set(now) <= set(before)
        if name == "near-duplicates":
            assert [(False, d) for d in sorted(now)] == plain_survivors(list(before.items()))
        if name == "benchmark":
            items = [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            leaked = {d for d, t in before.items() if any(i and len(i & shingles(t)) / len(i) >= 0.8 for i in items)}
            assert set(now) == set(before) - leaked
        before = now
    mixed = corpus_pipeline.mix(spark, docs, SMALL).collect()
    assert sum(r.mix_words for r in mixed) == pytest.approx(1.5 * sum(len(t.split()) for t in before.values()), abs=25)


CLASHES = "text_digest fp node root n_ salt_ heavy_ light_ found_ name names line hash score lang_pred held_out tokens n_tokens item_id host rule verdict dist id vec q removed row".split()


def plain_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("which", ["language", "lines", "urls", "tokens", "prints", "leaks", "near"])
def test_clashing_names_and_empty_tables(spark, which):
    """Columns named like the operators' own play no part, and an empty table gives an empty one."""
    prose = lambda k: " ".join(f"word{(k * 7 + j) % 60}" for j in range(40))
    texts = [(k % 9 if k % 10 else None, prose(k % 7) if k % 6 else None, "s", "ab"[k % 2]) for k in range(30)]
    docs = spark.createDataFrame([*texts, (50, "", None, None), (51, prose(3) * 300, "s", "a")], "doc_id long, text string, source string, lang string")
    items = spark.createDataFrame([(1, prose(3)), (2, None)], "item_id long, text string")
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.net/x" if k % 4 else None, f"<a href='http://h{k}.org/'>x</a>") for k in range(12)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(k, [float(k), 1.0, float(k % 5)]) for k in range(150)], "vec_id long, embedding array<float>")
    rules = spark.createDataFrame(queries.RULES, "rule string, verdict string")
    path = queries.vocabulary_path()
    frame, run = {
        "language": (docs, lambda d: language_id.identify(d, path).select("doc_id", "lang_pred", "score")),
        "lines": (docs, lambda d: line_dedup.drop_site_lines(d, min_pages=2).select("row.doc_id", "text", "n_lines", "n_dropped")),
        "urls": (pages, lambda d: url_filter.filter_urls(d, rules).select("page_id", "host", "path", "rule", "verdict")),
        "tokens": (docs, lambda d: token_counts.count_tokens(d, path).select("doc_id", "n_tokens")),
        "prints": (docs, lambda d: simhash_dedup.near_duplicates(d).select("doc_id", "fp", "component_id")),
        "leaks": (docs, lambda d: decontaminate.find_leaks(d, items).select("doc_id", "item_id", "containment")),
        "near": (vectors, lambda d: neighbours.neighbours(d, F.col("vec_id") % 50 == 0)),
    }[which]
    clashing = frame.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in frame.columns])
    want = plain_rows(run(frame))
    assert want and plain_rows(run(clashing)) == want
    assert run(clashing.limit(0)).collect() == []
