"""The pipeline's near copies: against all pairs, on edge cases, and the layout its recall rests on."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rookery.llm import near_copies

LONG = "word " * 30_000 + "end"


def shingles(text, size=5):
    words = (text or "").lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def changed(words, n, draw):
    """A copy in which `n` words are others."""
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"other{draw.randrange(10**9)}"
    return out


def test_near_copies_of_all_pairs(spark, docs):
    draw = random.Random(11)
    texts, number = {}, 0
    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([60, 200, 600]))]
        for n in [0, *[draw.randrange(1, max(2, len(words) // 40)) for _ in range(draw.randrange(5))]]:
            texts[number] = " ".join(changed(words, n, draw))
            number += 1
    sets = {i: shingles(t) for i, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    found = {r.doc_id: r.component for r in near_copies.grouped(spark, docs(*texts.items())).collect()}
    assert len(close) > 60 and sum(found[a] == found[b] for a, b in close) >= 0.9 * len(close)
    # Every member of a group has a near copy in it, by the shingles themselves.
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, []).append(i)
    for group in groups.values():
        if len(group) > 1:
            assert all(any(a != b and similarity(sets[a], sets[b]) >= 0.8 for b in group) for a in group)
    left = {r.doc_id for r in near_copies.drop_near_copies(spark, docs(*texts.items())).collect()}
    assert left == {min(g) for g in groups.values()}


def test_blank_texts_repeats_and_null_ids(spark, docs):
    words = [f"word{i}" for i in range(400)]
    text, near = " ".join(words), " ".join([*words[:399], "other"])
    table = docs((5, None), (4, ""), (7, " \n"), (8, "one two"), (8, "one two"), (None, "one  TWO"), (9, LONG), (None, near), (20, text), (None, "alone here"), (None, "alone here"), (3, "one two x"))
    left = near_copies.drop_near_copies(spark, table)
    assert left.columns == table.columns
    # Rows without an id come last: the near copy with an id stays, and one of those that have no other.
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "alone here"), (3, "one two x"), (4, ""), (8, "one two"), (9, LONG), (20, text)]
    assert near_copies.drop_near_copies(spark, docs().limit(0)).count() == 0


def test_near_copies_that_share_an_id(spark, docs):
    words = [f"word{i}" for i in range(400)]
    near = " ".join([*words[:399], "other"])
    rows = [(5, " ".join(words)), (5, near), (7, "one two"), (7, "something else entirely, with words of its own"), (6, "One  two"), (3, "last of all"), (3, "last of all"), (3, "unlike that one")]
    left = near_copies.drop_near_copies(spark, docs(*rows)).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id != 5) == [(3, "last of all"), (3, "unlike that one"), (6, "One  two"), (7, rows[3][1])]
    assert len([r for r in left if r.doc_id == 5]) == 1


def test_a_large_group_of_copies_is_one(spark, docs):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    table = docs(*((i, " ".join(changed(words, 3, draw))) for i in range(1500)), *((5000 + i, f"alone {i} {draw.random()}") for i in range(300)))
    left = sorted(r.doc_id for r in near_copies.drop_near_copies(spark, table).collect())
    # A copy may by chance be far from all ends of its buckets; nearly none is.
    assert left[0] == 0 and left[-300:] == list(range(5000, 5300)) and len(left) <= 1 + 300 + 15


def test_words_follow_from_the_recall():
    draw = random.Random(1)
    p = near_copies._part_apart(0.8)
    assert near_copies.words_used(recall=0.5) < near_copies.words_used() < near_copies.words_used(recall=0.96)
    n = near_copies.words_used()
    met = lambda: draw.random() < 0.8 and sum(draw.random() < p for _ in range(near_copies.BITS)) <= 2
    assert sum(any(met() for _ in range(n)) for _ in range(2000)) >= 0.92 * 2000
    with pytest.raises(ValueError):
        near_copies.words_used(0.5, 0.99)


def test_fingerprints_differ_as_much_as_the_sets():
    draw = random.Random(2)
    words = [f"w{draw.randrange(9999)}" for _ in range(3000)]
    for n in (0, 60, 140):
        a, b = (near_copies.shingle_hashes(" ".join(w).encode(), 5) for w in (words, changed(words, n, draw)))
        alike = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        x, y = (near_copies.fingerprint_words(h) for h in (a, b))
        apart = sum((p ^ q).bit_count() for p, q in zip(x[0], y[0])) / (near_copies.BITS * near_copies.WORDS)
        assert apart == pytest.approx(near_copies._part_apart(alike), abs=0.08)
        assert n or x == y
    assert len(near_copies.shingle_hashes(b"one two", 5)) == 1 and len(near_copies.shingle_hashes(b" \n", 5)) == 0
    assert near_copies.fingerprint_words(near_copies.shingle_hashes(b"", 5))[0] == [0] * near_copies.WORDS


def test_no_link_at_the_threshold_is_left_out(spark, docs, monkeypatch):
    """Groups are those of all pairs at the similarity, also where the variants find none, and with a passage that all have."""
    draw = random.Random(23)
    passage, texts = [f"p{i}" for i in range(14)], {}
    for _ in range(50):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([30, 60, 200]))]
        for _ in range(draw.randrange(1, 5)):
            texts[len(texts)] = " ".join([*changed(words, draw.randrange(0, max(2, len(words) // 35)), draw), *passage])
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}
    close = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    for _ in sets:
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    for finds in (True, False):
        if not finds:
            monkeypatch.setattr(near_copies, "links", lambda spark, *_: spark.createDataFrame([], "a long, b long"))
        found = {r.doc_id: r.component for r in near_copies.grouped(spark, docs(*texts.items())).collect()}
        groups = {c: min(i for i in found if found[i] == c) for c in found.values()}
        assert {i: groups[c] for i, c in found.items()} == least and len(close) > 30


def test_prefixes_share_what_they_need():
    draw = random.Random(4)
    for _ in range(3000):
        t, n = draw.choice([0.3, 0.5, 0.8, 0.9]), draw.randrange(1, 60)
        a = set(draw.sample(range(200), n))
        b = set(draw.sample(sorted(a), draw.randrange(1, n + 1))) | set(draw.sample(range(200), draw.randrange(0, 4)))
        if similarity(a, b) >= t:
            (p, need), (q, _) = (near_copies.prefix_length(len(x), t) for x in (a, b))
            assert len(set(sorted(a)[:p]) & set(sorted(b)[:q])) >= need >= 1


def test_workers_get_few_texts_at_a_time(spark, docs, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, stored = spark.conf.get(name), {}, near_copies.stored

    def noted(spark, frame, table):
        seen[table] = int(spark.conf.get(name))
        return stored(spark, frame, table)

    monkeypatch.setattr(near_copies, "stored", noted)
    words = [f"word{i}" for i in range(400)]
    table = docs(*((i, " ".join([*words[:399], f"other{i}"])) for i in range(20)))
    assert [r.doc_id for r in near_copies.drop_near_copies(spark, table).collect()] == [0]
    assert seen["fingerprints"] == seen["shingles"] == near_copies.BATCH_ROWS and seen["nodes"] == int(before)
    assert spark.conf.get(name) == before
    with near_copies.batches_of(spark, 3):
        sizes = spark.range(0, 20, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["id"]) for b in batches), "id long")
        assert max(r.id for r in sizes.collect()) == 3


def test_parities_differ_in_no_more_than_the_sets():
    draw = random.Random(6)
    for n in (0, 1, 40, 700, 5000):
        a = {draw.getrandbits(63) for _ in range(n)}
        b = set(draw.sample(sorted(a), n * 3 // 4)) | {draw.getrandbits(63) for _ in range(20)}
        x, y = (near_copies.parities(np.array(sorted(s), np.uint64)).tolist() for s in (a, b))
        assert len(x) * 64 == near_copies.PARITIES
        assert sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) <= len(a ^ b)


def test_texts_that_are_nearly_near_copies_are_not_paired(spark, docs, monkeypatch):
    """Copies of one text that differ too much from each other share most shingles, but few of their pairs are tested; all links stay."""
    draw, tables, stored = random.Random(8), {}, near_copies.stored

    def noted(spark, frame, table):
        tables[table] = stored(spark, frame, table)
        return tables[table]

    monkeypatch.setattr(near_copies, "stored", noted)
    words = [f"w{i}" for i in range(150)]
    texts = {i: " ".join(changed(words, 5, draw)) for i in range(200)}
    texts |= {200 + i: " ".join([*texts[i].split(), "end"]) for i in range(10)}
    found = {r.doc_id: r.component for r in near_copies.grouped(spark, docs(*texts.items())).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}
    close = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    for _ in range(20):
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    groups = {c: min(i for i in found if found[i] == c) for c in found.values()}
    assert {i: groups[c] for i, c in found.items()} == least
    pairs = len(texts) * (len(texts) - 1) // 2
    assert tables["close-across"].count() < 0.2 * pairs and len(set(least.values())) > 100
