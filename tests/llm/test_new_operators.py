"""Packing, fill-in-the-middle and importance resampling: against brute force and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from rookery.llm import fill_middle, importance, packing, registry, token_counts

SF = "/root/testdata/sf0.001"
CLASH = ", ".join(f"`{n}` string" for n in ("place", "n", "form", "first", "second", "frame", "units", "length", "offset", "group", "turn", "score", "rank", "weight", "key", "ids", "data", "piece"))


@pytest.fixture
def clashing(spark):
    """A documents table with columns that are named as those operators make, from (doc_id, text)."""

    def make(*rows):
        return spark.createDataFrame([(*r, "en", "a", 1, *["x"] * 18) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make


# 11 packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.paths()[0])


def check_packing(rows, texts, library, size=1024):
    """`texts` lists (doc_id, text); every document whole and in order, every sequence gapless and within its size."""
    expected = Counter()
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % size + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], range(first, len(ids) + 1, size))):
            expected[i, piece, a, b - a, zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def least_sequences(rows, size=1024):
    """No packing has fewer: full ones stand alone, and so do pieces of more than half a sequence."""
    return max(math.ceil(sum(r.length for r in rows) / size), sum(r.length > size // 2 for r in rows))


def test_packing_of_all_documents(spark, library):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = registry.queries()["op11_pack"](spark, SF).collect()
    assert check_packing(rows, texts, library) <= least_sequences(rows) * 1.01 + 1


def test_packing_edges(spark, clashing, library):
    long = "Some words, and more of them. " * 3000
    texts = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (3, long), (4, " x" * 1023), (5, " x" * 1022), (6, " x" * 2047), (7, "a<|endoftext|>b"), (8, "y" * 3000)]
    rows = packing.pack(spark, clashing(*texts)).collect()
    check_packing(rows, texts, library)
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert [(r.piece, r.start, r.length) for r in sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)] == [(0, 0, 1024), (1, 1024, 1024)]
    assert packing.pack(spark, clashing((1, "a")).limit(0)).count() == 0


def test_packing_in_groups_and_the_sequences_themselves(spark, docs, library):
    draw = random.Random(3)
    texts = [(i, " x" * draw.randint(0, 150)) for i in range(3000)] + [(9000 + i, " x") for i in range(1500)]
    few = packing.pack(spark, docs(*texts), size=128, group=500).collect()
    # A few sequences stay unfilled in each of nine groups.
    assert check_packing(few, texts, library, 128) <= least_sequences(few, 128) + 9 * 4
    found = packing.sequences(spark, docs(*texts[:200]), size=128).collect()
    assert sum(len(r.ids) for r in found) == sum(len(library.encode(t).ids) + 1 for _, t in texts[:200])
    assert max(len(r.ids) for r in found) <= 128 and sum(r.ids.count(2) for r in found) == 200


def test_each_place_makes_the_squares_smallest():
    """The choice against squares summed anew, for every sequence that a piece could go to."""
    draw = random.Random(4)
    counts = Counter(draw.randint(1, 29) for _ in range(300))
    filled, opened = {}, Counter()
    for length, sequence, offset in packing.pack_lengths(counts, 30):
        assert filled.get(sequence, 0) == offset
        squares = {}
        for gap in [g for g, n in opened.items() if n and g >= length]:
            after = opened.copy()
            after[gap] -= 1
            after[gap - length] += gap > length
            squares[gap] = sum(n * n for n in after.values())
        if squares:
            assert squares[30 - offset] == min(squares.values())
            opened[30 - offset] -= 1
        else:
            assert offset == 0
        filled[sequence] = offset + length
        opened[30 - offset - length] += offset + length < 30


def test_ids_in_parts_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    enc = token_counts.encoder(*token_counts.paths())
    draw = random.Random(6)
    for _ in range(2000):
        text = "".join(draw.choice(["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "　", "🙂", "<|endoftext|>", ".", "word"]) for _ in range(40))
        assert packing.token_ids(enc, text).tolist() == library.encode(text, add_special_tokens=False).ids, text


# 12 fill in the middle


def plain_middle(doc_id, text):
    import hashlib

    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), sha(output), sha(text), output


MIDDLE_TEXTS = ["", None, "a", "été 12 <b> no markers\n", "has <M> in it", "x" * 700, "é" * 500, "one two three " * 300, "ab1" * 200, "x" * 90 + "1" + "y" * 90, "🙂 <P", "<S><", "1" * 64 + "word" * 40]


@pytest.mark.parametrize("size", [1, 7, 64, fill_middle.FRAME])
def test_middle_equals_plain_code_for_any_frame(spark, clashing, size):
    rows = [(i * 100 + k, t if size > 1 or t is None else t[:40]) for i in range(6) for k, t in enumerate(MIDDLE_TEXTS)] + [(None, "no id here"), (3, "twice"), (3, "twice")]
    expected = Counter((i, *plain_middle(i, t)[:6]) for i, t in rows)
    table = clashing(*rows)
    assert Counter(map(tuple, fill_middle.fill_in_middle(spark, table, size=size).collect())) == expected
    assert {"psm", "spm", "plain"} == {k[2] for k in expected}
    outputs = Counter((r.doc_id, r.form, r.output) for r in fill_middle.transformed(spark, table, size=size).collect())
    assert outputs == Counter((i, plain_middle(i, t)[1], plain_middle(i, t)[6]) for i, t in rows)


def test_middle_of_nothing_and_of_one_long_text(spark, docs):
    assert fill_middle.fill_in_middle(spark, docs().limit(0)).count() == 0
    text = "Words of a very long text, 1 after 2. " * 40_000
    assert tuple(fill_middle.fill_in_middle(spark, docs((5, text))).collect()[0])[1:] == plain_middle(5, text)[:6]


def test_output_alone_gives_the_text():
    for parts in ([b"a", b"b", b"c"], [b"", b"", b""], [b"<", b"S>", b"<P"], [b"<M", b"", b">"]):
        for form in ("psm", "spm"):
            assert fill_middle.restored_of(fill_middle.output_of(parts, form), form) == b"".join(parts)


# 13 importance resampling


def plain_importance(docs, target, longest=1, n=10_000, least=20, percent=10):
    import hashlib

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: w + ([" ".join(p) for p in zip(w, w[1:])] if longest == 2 else [])
    bucket = lambda g: zlib.crc32(g.encode()) % n
    s, t = (Counter(bucket(g) for _, x in table for g in grams(words(x))) for table in (docs, target))
    of_s, of_t = sum(s.values()) + n, sum(t.values()) + n
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * of_s / ((s[b] + 1.0) * of_t)))
    rows = []
    for i, x in docs:
        own = grams(words(x))
        weight = sum(gain(bucket(g)) for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in rows)


DOCS = [(i, f"Word{i % 7} and the other {'word ' * (i % 40)} été {i} ends") for i in range(400)] + [(1000, None), (1001, ""), (None, "no id " * 30), (1002, "x" * 500 + " y" * 30), (1003, "same words " * 20), (1003, "same words " * 20)]
TARGET = [(1, "the other word and été"), (2, None), (3, "unseen words same same")]


@pytest.mark.parametrize(("longest", "head"), [(1, 1 << 16), (2, 1 << 16), (1, 3), (2, 3)])
def test_importance_equals_plain_code_for_any_head(spark, clashing, monkeypatch, longest, head):
    monkeypatch.setattr(importance, "HEAD", head)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    ranks = importance.importance_ranks(spark, clashing(*DOCS), target, longest)
    assert ranks.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, ranks.drop("n_words").collect())) == plain_importance(DOCS, TARGET, longest)


def test_importance_draws_rows_with_all_columns(spark, clashing):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    table = clashing(*DOCS)
    for percent in (0, 10, 55, 100):
        drawn = importance.resample(spark, table, target, percent=percent)
        assert drawn.columns == table.columns
        expected = Counter({k[0]: 0 for k in plain_importance(DOCS, TARGET)})
        for k, m in plain_importance(DOCS, TARGET, percent=percent).items():
            expected[k[0]] += m * (k[4] is not None)
        assert Counter(r.doc_id for r in drawn.collect()) == +expected


def test_importance_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_ranks(spark, docs().limit(0), none).count() == 0
    found = importance.importance_ranks(spark, docs((1, "a " * 25), (2, None)), none).drop("n_words").collect()
    assert Counter(map(tuple, found)) == plain_importance([(1, "a " * 25), (2, None)], [])
    with pytest.raises(ValueError):
        importance.importance_ranks(spark, docs((1, "a")), none, longest=3)


def test_head_is_bounded_and_its_states_go_on(spark, docs):
    states, pairs = importance.head_vocabulary(spark, docs((1, "to be or not to be " + "q" * 100), (2, "to go")), 2)
    assert states == {w: zlib.crc32(w) for w in (b"to", b"be", b"or", b"not", b"go")}
    assert pairs[b"to", b"be"] == zlib.crc32(b"to be") % importance.BUCKETS
    known = importance.Head(states, {}, 97)
    assert known.buckets_of([b"to", b"unseen", b"go"], 2).tolist() == [zlib.crc32(g) % 97 for g in (b"to", b"unseen", b"go", b"to unseen", b"unseen go")]
