"""Packing, repair and prefix trie against plain versions of the same rules."""

from __future__ import annotations

import collections
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from manyfold.llm import conversation_repair, packing, prefix_trie, queries
from tests.conftest import SMALL

CONVERSATION = "conv_id long, turn long, role string, text string"


def written(spark, tmp_path, name, rows, schema, parts=4):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def made_conversations(seed, convs=60, long=0):
    """Conversations that share beginnings, with nulls, ties, gaps, repeats and blank turns."""
    draw = random.Random(seed)
    texts = ["Hi.", "So?", "no end", " ", "", "A! b", None, "Grüße.", "last\n", "q" * 70 + "1.", "q" * 70 + "2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in draw.sample(range(200), convs):
        n = draw.randint(1, 12)
        for k in range(n):
            turn = draw.choice([k, k, k, k + draw.randint(0, 3), None])
            rows.append((c, turn, draw.choice(roles[:2] if draw.random() < 0.6 else roles), draw.choice(texts[: draw.choice([3, len(texts)])])))
    rows += [(500, k, "user" if k % 3 else "assistant", f"t{k % 7}.") for k in range(long)]
    rows += [(505, k, "user" if k % 3 else "assistant", f"t{k % 7}.") for k in range(long)]
    return rows + rows[:7]


# Packing


def plain_pieces(texts, tokenizer):
    out = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4").tobytes()
            out.append((doc, piece, start, len(own) // 4, zlib.crc32(own)))
    return out


def check_sequences(rows, capacity):
    """Sequences have no gap and no overlap; returns their number."""
    held = collections.defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


ODD_TEXTS = [None, "", " ", "  a  b ", "A.b, c!? D...", "Don't we'll I'VE", "naïve Ῥόδος ΣΑΣ.", "á ́b ̣́ c", "x<|endoftext|>y <|ENDOFTEXT|>. <|startoftext|>", "1234 5,6 ٣", "日本語 テキスト。", "  \x1c\x1d tab\tend\r\n", "é." * 50, "한글 ..", "w." * 9000, "long " * 9000]
ODD_TEXTS += ["İstanbul. ISTANBUL ıı ŉa ſo Straße. ÉCOLE, œuvre ª º µ× Ÿ.", "été… été. l'été Ünïcödé!? ǅ Ǆ", "ÀÉ" * 40]


def test_pieces_have_the_tokenizers_ids(spark, tmp_path, monkeypatch):
    texts = [(k if k % 4 else None, t) for k, t in enumerate(ODD_TEXTS)] + [(3, "same"), (3, "same")]
    texts += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    folder = written(spark, tmp_path, "documents", [(d, t, "x", 1) for d, t in texts], "doc_id long, text string, sequence_id string, length int")
    got = queries.op11_pack(spark, folder).collect()
    expected = plain_pieces(texts, Tokenizer.from_file(queries.tokenizer_path()))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    used = check_sequences([(r.length, r.sequence_id, r.offset) for r in got], 4096)
    assert used <= -(-sum(r.length for r in got) // 4096) + 2


def test_texts_are_tokenised_in_parts(monkeypatch):
    text = " ".join(t for t in ODD_TEXTS if t)
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    words = packing.Words(queries.tokenizer_path())
    whole = words.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    pieces = list(packing.pieces_of(text, words, 100, 1))
    assert np.concatenate(pieces).tolist() == whole and {len(p) for p in pieces[:-1]} == {100}


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 10)
    words = packing.Words(queries.tokenizer_path())
    for text in [*filter(None, ODD_TEXTS), "one two. three", "ONE two three. four five six seven eight nine ten eleven", "one two"]:
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    everything = "".join(map(chr, range(1, 0x250)))
    for text in [everything, " ".join(everything), " ".join(c + "a." for c in everything), " ".join("b" + c for c in everything)]:
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_words_go_to_the_model_alone():
    """Only words with other signs go through the whole tokenizer; none does when all that is new is letters."""
    words = packing.Words(queries.tokenizer_path())
    whole, calls = words.tokenizer, []

    class Watched:
        model = whole.model

        def encode_batch_fast(self, some, **settings):
            calls.append(sorted(some))
            return whole.encode_batch_fast(some, **settings)

    words.tokenizer = Watched()
    for text in ("plain words", "Plain wörds, again.", "more plain words", "don't 12 WORDS."):
        assert words.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert calls == [[""], [",", "."], ["12", "don't"]]


@pytest.mark.parametrize("sizes", ["mixed", "halves", "equal", "large"])
def test_packing_in_many_buckets(spark, sizes):
    draw = np.random.default_rng(3)
    made = {
        "mixed": np.minimum(draw.geometric(0.02, 6000), 100),
        "halves": draw.permutation(np.repeat([50, 49, 51, 25, 75], 600)),
        "equal": np.full(3000, 60),
        "large": draw.integers(51, 101, 2000),
    }[sizes]
    df = spark.createDataFrame([(k, int(s)) for k, s in enumerate(made)], "doc_id long, length long")
    got = packing.pack(df, capacity=100, bucket=400).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(made.tolist()))
    used = check_sequences([(r.length, r.sequence_id, r.offset) for r in got], 100)
    least = max(-(-int(made.sum()) // 100), int((made > 50).sum()))
    assert used <= 1.03 * least + 2


def test_sum_of_squares_takes_the_least_sum():
    draw = np.random.default_rng(5)
    sizes = draw.integers(1, 21, 200)
    bins, offsets, gaps = packing.sum_of_squares(sizes, 20)
    open_gaps: dict[int, int] = {}
    for at in np.argsort(-sizes, kind="stable"):
        size, number = int(sizes[at]), int(bins[at])

        def total(gap):
            left = [g for b, g in open_gaps.items()] + [20 - size] if gap is None else [g for g in open_gaps.values()]
            if gap is not None:
                left.remove(gap)
                left.append(gap - size)
            return sum(n * n for g, n in collections.Counter(left).items() if g)

        best = min([total(None)] + [total(g) for g in set(open_gaps.values()) if g >= size])
        assert total(open_gaps.get(number)) == best
        open_gaps[number] = open_gaps.get(number, 20) - size
    assert [open_gaps[b] for b in range(len(gaps))] == gaps.tolist()


def test_packing_refuses_what_cannot_fit(spark):
    with pytest.raises(Exception, match="not within 1 to 10"):
        packing.pack(spark.createDataFrame([(1, 11)], "doc_id long, length long"), capacity=10).collect()
    with pytest.raises(ValueError, match="already have"):
        packing.pack(spark.createDataFrame([(1, 11)], "offset long, length long"))


def test_sequences_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "x " * 30)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, queries.tokenizer_path(), capacity=20)
    whole = packing.sequences(packing.pack(pieces, capacity=20)).collect()
    assert sum(r.n_tokens for r in whole) == 2 + 1 + 1 + 31 and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert queries.op11_pack(spark, written(spark, tmp_path, "documents", [], "doc_id long, text string")).collect() == []


# Repair


def plain_repair(rows):
    given = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else x
        role, text = show(role), show(text)
        kept = given[conv]
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    space = " \t\n\x0b\x0c\r"
    out = {}
    for conv, kept in given.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(f"{' ' if conv is None else conv}:{len(r[1].encode())}:{r[1]}:{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(space)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = plain_edits(kept, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def plain_edits(kept, faults):
    """All edits, cheapest first and then by their initials."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(kept) and state in ("", "a"):
            return cost, audit, lines
        new = after[state]
        heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*lines, full[new] + ":")))
        if at < len(kept):
            _, role, text = kept[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] in ("", "truncated"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new, (*lines, f"{full[new]}:{text}")))
                if role[:1] == new or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))


@pytest.mark.parametrize(("segment", "parts"), [(1 << 16, 8), (5, 3), (40, 1)])
def test_repair(spark, tmp_path, monkeypatch, segment, parts):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = [*made_conversations(1, long=300), (None, 1, "user", "a."), (None, None, None, None), (600, None, "x", None), (-3, -5, "s", "b."), (-3, 9, "assistant", "c!")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = queries.op12_repair(spark, written(spark, tmp_path, "conversations", rows, CONVERSATION)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    expected = plain_repair(rows)
    assert len(got) == len(expected)
    for row in got:
        assert tuple(row[n] for n in names) == expected[row.conv_id], row.conv_id


def test_runs_equal_single_steps():
    draw = random.Random(2)
    for _ in range(300):
        symbols = np.array([s for _ in range(4) for s in [draw.randrange(12)] * draw.choice([1, 2, 3, 80])])
        edits, _ = conversation_repair.repair_symbols(symbols)
        matrix = conversation_repair.matrix_of(symbols)
        cost = min(matrix[0][k] + conversation_repair.ENDS[k] for k in range(4))
        price = {"D": 4, "I": 3, "K": 0, "R": 3}
        assert cost == sum(price[e] + 3 * (s % 3 == 1 and e in "KR") for s, x in zip(symbols, edits) for e in x[::2])


def test_repair_of_empty_table_and_other_columns(spark, tmp_path):
    assert queries.op12_repair(spark, written(spark, tmp_path / "a", "conversations", [], CONVERSATION)).collect() == []
    rows = [(2, 0, "user", "Hi.", "k", 1), (2, 1, "assistant", "Yes " * 50_000 + ".", None, 2)]
    folder = written(spark, tmp_path / "b", "conversations", rows, CONVERSATION + ", key string, id int")
    (row,) = queries.op12_repair(spark, folder).collect()
    assert tuple(row)[1:] == plain_repair([r[:4] for r in rows])[2]


# Prefix trie


def plain_trie(rows):
    given = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", (text or "")[:64], text or ""))
    order = {}
    for conv, kept in given.items():
        order[conv] = [(r[2], r[4]) for r in sorted(kept)]
    built = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(order.get(c - c % 5, [])[:h] + own[h:])
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, members in nodes.items():
        worth = (len(members) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += worth
    out = []
    for n, members in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c in members if built[c] == n)).encode()).hexdigest()
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n], ends))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("parts", "block", "listed"), [(8, 1 << 12, 1 << 14), (3, 4, 2), (1, 7, 1)])
def test_prefix_trie(spark, tmp_path, monkeypatch, parts, block, listed):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "LISTED", listed)
    same = [(c, k, "user", f"turn {k}") for c in range(1000, 1060) for k in range(3 + c % 3)]
    rows = [r for r in made_conversations(4, long=150) if r[1] is not None] + same + [(None, 1, "user", "x"), (7001, None, None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie_rows(queries.op13_prefix_trie(spark, written(spark, tmp_path, "conversations", distinct_turns(rows), CONVERSATION)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain_trie(distinct_turns(rows))


def distinct_turns(rows):
    """The rows without those of one turn, role and opening, whose order a hash decides."""
    return list({(*r[:3], (r[3] or "")[:64]): r for r in rows}.values())


def test_prefix_trie_of_repeats_ties_and_empty_tables(spark, tmp_path):
    rows = made_conversations(6)
    got = queries.op13_prefix_trie(spark, written(spark, tmp_path / "a", "conversations", rows, CONVERSATION))
    again = queries.op13_prefix_trie(spark, written(spark, tmp_path / "b", "conversations", rows[::-1], CONVERSATION, 2))
    assert trie_rows(got) == trie_rows(again)
    assert queries.op13_prefix_trie(spark, written(spark, tmp_path / "c", "conversations", [], CONVERSATION)).collect() == []
    one = queries.op13_prefix_trie(spark, written(spark, tmp_path / "d", "conversations", [(3, None, None, "x" * 300_000, "y")], CONVERSATION + ", depth string"))
    assert trie_rows(one) == plain_trie([(3, None, None, "x" * 300_000)])


def test_polynomial_hashes_of_parts():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 60, 500).astype(np.uint64)
    base = prefix_trie.BASES[0]
    plain, total = [], 0
    for k, v in enumerate(x.tolist()):
        total = (total + v * pow(base, k, prefix_trie.PRIME)) % prefix_trie.PRIME
        plain.append(total)
    terms = prefix_trie.times(x, prefix_trie.power(base, np.arange(500)))
    assert prefix_trie.running(terms).tolist() == plain
    back = prefix_trie.times(prefix_trie.power(base, np.array([-7, 3])), prefix_trie.power(base, np.array([7, -3])))
    assert back.tolist() == [1, 1]
