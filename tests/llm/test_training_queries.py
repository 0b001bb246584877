"""Every registered query of the subpackage: against its SQL, or against plain code over whole tables."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
import xxhash

import __spark_entry__ as contract
import corpus_pipeline
from compare import difference, open_tables
from rookery.llm import html_content, pii, registry, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return open_tables(SF)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def collected(spark, name):
    return {r["doc_id"]: r for r in registry.queries()[name](spark, SF).collect()}


def test_the_contract_has_all_queries():
    names = set(contract.queries())
    assert set(registry.queries()) < names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert difference(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name]) is None


def test_quality_on_held_out_labels(spark, duck):
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    found = collected(spark, "op4_quality")
    assert set(found) == {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
    held = [(found[i], q) for i, q in labels.items() if found[i].held_out]
    assert sum(r.predicted == q for r, q in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_pii_equals_plain_patterns(spark, texts):
    found = collected(spark, "op5_pii")
    for i, text in texts.items():
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in pii.base_spans(text))
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert found[i].spans.startswith(joined)


def test_token_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.paths()[0])
    found = collected(spark, "op6_token_counts")
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len(text.encode()), n, n > 512)


def shingles(text):
    words = text.lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_equals_all_pairs(spark, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    component = {i: i for i in texts}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                component[y] = x
    found = collected(spark, "op7_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_html_equals_the_article(spark, duck):
    import html

    found = {r.page_id: r for r in registry.queries()["op9_html_content"](spark, SF).collect()}
    for page_id, url, page in duck.sql("SELECT page_id, url, html FROM pages").fetchall():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
        text = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?\w+>", " ", article))).strip()
        assert (found[page_id].url, found[page_id].text, found[page_id].n_chars) == (url, text, len(text))


def test_pipeline_stages(spark, duck, texts):
    """Each stage's result against what the operators' checked results say of its input."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns = documents, documents.columns
    source = {r.doc_id: r.source for r in documents.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        after = stage(spark, docs, SF)
        assert after.columns == columns
        rows = after.collect()
        ids = {r.doc_id for r in rows}
        was = {r.doc_id: r.text for r in docs.collect()}
        assert all(was[r.doc_id] == r.text for r in rows) and len(was) == before
        if name == "quality classifier":
            scores = collected(spark, "op4_quality")
            assert ids == {i for i, r in scores.items() if r.predicted}
        elif name == "exact dedup":
            groups = defaultdict(list)
            for i, t in was.items():
                groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
            assert ids == {min(g)[1] for g in groups.values()}
        elif name == "simhash near-dedup":
            sets = {i: shingles(t) for i, t in was.items()}
            close = [(i, j) for i in was for j in was if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            # Only near copies of others go, never the smallest of a group, and of nine pairs in ten one.
            assert set(was) - ids <= {j for _, j in close}
            assert close and sum(not {i, j} <= ids for i, j in close) >= 0.9 * len(close)
        elif name == "benchmark decontamination":
            con = duckdb.connect()
            con.register("documents", after.toPandas())
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
            assert con.sql(f"SELECT count(*) FROM ({registry.oracle_sql()['op10_decontaminate']}) WHERE contaminated").fetchall() == [(0,)]
            assert ids < set(was)
        else:
            assert n == len(corpus_pipeline.STAGES) - 1 and ids <= set(was) and max(sum(r.doc_id == i for r in rows) for i in ids) <= 3
            assert all(r.source == source[r.doc_id] for r in rows)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert len(rows) == len(ids)
            docs = spark.createDataFrame(rows, documents.schema)
