"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest

from rookery.llm import components, decontam, exact_dedup, html_content, license_scan, line_dedup, mixing, quality, simhash, token_counts

LONG = "word " * 30_000 + "end"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(rows):
    found = {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    return found


# 1 mixing


def test_targets_stop_at_the_cap_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985), ("d", 0)], "source string, size long")
    found = {r.source: r for r in mixing.source_targets(spark, sizes).collect()}
    assert [found[s].weight for s in ("a", "b", "c", "d", None)] == [1, 2, 3, 1, 2]
    # c, then a, stop at three times their size, d at nothing; b and null share the rest equally.
    assert [found[s].target for s in ("a", "c", "d")] == [30.0, 15.0, 0.0]
    assert found["b"].target == found[None].target == (2000 - 45) / 2


def test_mix_takes_near_the_target_and_reruns_agree(spark, docs):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(4000)] + [(None, None, None), (5000, "", "a")]
    table = docs(*rows)
    plan = mixing.mix_plan(spark, table).collect()
    for s in "ab":
        own = [r for r in plan if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.05 * own[0].target
    assert all(r.taken <= 3 * r.size for r in plan)
    first, second = mixing.mix(spark, table), mixing.mix(spark, table)
    assert first.columns == table.columns
    assert counted(first.collect()) == counted(second.collect()) == {r.doc_id: r.copies for r in plan if r.copies}


def test_mix_of_nothing(spark, docs):
    assert mixing.mix_plan(spark, docs().limit(0)).count() == 0
    assert mixing.mix(spark, docs().limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_plan(spark, docs((1, None), (2, ""))).collect()] == [0, 0]


# 2 license scan


def test_license_places_and_notices(spark, docs, by_id):
    far = "x " * 40 + "Released under the MIT License. mit\nlicense " + "y " * 500 + "GENERAL public LICENSE"
    rows = [(1, far), (2, None), (3, ""), (4, "mit x license apache"), (5, "Licensed: under CC BY-NC 4.0."), (6, LONG + " apache license"), (7, "All rights\treserved")]
    found = by_id(license_scan.license_labels(spark, docs(*rows)))
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (3, 43, 547)
    assert found[1].base_labels == "gpl,mit" and found[1].labels == "gpl,mit,mit-notice"
    assert [(found[i].n_words, found[i].n_base, found[i].labels, found[i].score) for i in (2, 3)] == [(0, 0, "", 0.0)] * 2
    assert (found[4].n_base, found[4].labels, found[4].first_word) == (0, "", None)
    assert found[5].labels == "cc-by-nc" and found[5].score == 1.0 and found[5].base_labels == ""
    assert (found[6].base_labels, found[6].first_word, found[6].n_words) == ("apache", 30_001, 30_003)
    assert found[7].labels == "reserved"


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_license_texts_as_templates(spark, docs, by_id):
    words = MIT_TEXT.split()
    assert len(words) > 150
    notices = {"mit-text": MIT_TEXT, "short": "all rights reserved", "empty": ""}
    fill = lambda n: "x " * n
    rows = [
        (1, fill(333) + MIT_TEXT + fill(77)),
        (2, fill(200) + " ".join(w for k, w in enumerate(words) if k % 12) + fill(9)),  # a twelfth of the words is missing
        (3, " ".join(words[: len(words) // 2])),
        (4, fill(20) + "All rights reserved. Apache License"),
        (5, " ".join(w + " " + fill(6) for w in words)),  # far too thin
    ]
    found = by_id(license_scan.license_labels(spark, docs(*rows), notices))
    assert {i: r.labels for i, r in found.items()} == {1: "mit-text", 2: "mit-text", 3: "", 4: "apache,short", 5: ""}
    assert found[1].score == 1.0 and 0.8 <= found[2].score < 1.0
    assert (found[4].n_base, found[4].first_word) == (1, 23)


def test_scattered_notices_equal_plain_code(spark, docs, by_id):
    """Also texts that share no run of words with a template."""
    import random

    draw = random.Random(21)
    found_templates = license_scan.templates()
    texts = {1: "under cc by nc 4 0", 2: "This work is under a Creative Commons attribution 4 0 international"}
    for i in range(3, 150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            words = list(draw.choice(found_templates)[2])
            draw.shuffle(words)
            parts += words[: draw.randrange(len(words) // 2, len(words) + 1)] + ["x"] * draw.randrange(60)
        texts[i] = " ".join(parts)
    found = by_id(license_scan.license_labels(spark, docs(*texts.items())))
    for i, text in texts.items():
        words = license_scan.plain_words(text)
        labels, score = set(), 0.0
        for first in range(0, max(1, len(words)), 32):
            block = words[first : first + 64]
            for kind, label, phrase in found_templates:
                share = len(set(phrase) & set(block)) / len(set(phrase))
                places = [s for s in range(min(32, len(block))) if block[s : s + len(phrase)] == phrase]
                if share >= 0.8 and (kind != "base" or places):
                    labels.add(label)
                    score = max(score, share)
        assert (found[i].labels, found[i].score) == (",".join(sorted(labels)), score), text


def test_license_repeats_and_empty(spark, docs):
    row = (1, "the MIT license")
    assert [(r.n_base, r.labels) for r in license_scan.license_labels(spark, docs(row, row, (None, "mit license"))).collect()] == [(1, "mit")] * 3
    assert license_scan.license_labels(spark, docs().limit(0)).count() == 0


# 3 exact dedup


def test_exact_groups(spark, docs, by_id):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab "), (4, None), (5, " \t"), (6, ""), (7, LONG), (8, LONG.replace(" ", "\n")), (9, LONG[:-1])]
    found = by_id(exact_dedup.exact_duplicates(spark, docs(*rows)))
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in found.items()} == {
        1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (5, 3, False), 5: (5, 3, True), 6: (5, 3, False),
        7: (7, 2, True), 8: (7, 2, False), 9: (9, 1, True),
    }
    assert found[1].text_sha256 == sha("ab") and found[4].text_sha256 == sha("")


def test_exact_ties_repeats_null_ids_and_empty(spark, docs):
    table = docs((None, "x y"), (2, "x y"), (2, "x y"), (3, "other"), (None, "alone"))
    found = exact_dedup.exact_duplicates(spark, table).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in found) == [(0, 0, True), (0, 2, False), (2, 2, False), (2, 2, True), (3, 3, True)]
    left = exact_dedup.drop_exact_duplicates(spark, table)
    assert left.columns == table.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "alone"), (2, "x y"), (3, "other")]
    assert exact_dedup.drop_exact_duplicates(spark, docs().limit(0)).count() == 0


# 4 quality


def test_quality_without_labels_of_both_kinds(spark, docs):
    table = docs((1, "a"), (2, None), (3, ""), (None, LONG))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in quality.quality_scores(spark, table, none).collect()} == {(0.5, 1)}
    ones = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(spark, table, ones).collect()} == {1.0}
    assert quality.quality_scores(spark, docs().limit(0), ones).count() == 0


def test_quality_learns_and_filters_with_all_columns(spark, docs):
    good = [(i, f"These are plain words of text number {i}, as one would write them.") for i in range(0, 400, 2)]
    bad = [(i, "BUY!! NOW!! $$$ ### %%% " * (i % 5 + 1)) for i in range(1, 400, 2)]
    table = docs(*good, *bad, (1000, None), (None, "Some more words of text, as one would write them."))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)] * 2, "doc_id long, quality int, toxic int")
    scores = quality.quality_scores(spark, table, labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in scores if r.doc_id is not None and r.doc_id < 400)
    left = quality.drop_rejected(spark, table, labels)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} >= {i for i, _ in good} and not {r.doc_id for r in left.collect()} & {i for i, _ in bad}


def test_statistics_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a b a", None, "", "é ü!\nline\nline\n", LONG[:3000], "To To To of"]
    together = quality.batch_statistics(pa.array(texts))
    alone = np.concatenate([quality.batch_statistics(pa.array(["skipped", t]).slice(1)) for t in texts])
    assert np.allclose(together, alone)
    assert together[5][13] == 0.5 and together[5][14] == 0.5 and together[3][18] == pytest.approx(1 / 3)


# 6 token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.paths()[0])


def test_chunks_splice_to_the_whole_count(spark, docs, by_id, library):
    texts = {
        1: "Some words, and 12 more; it's  all\n\n fine. " * 200, 2: None, 3: "", 4: "x" * 5000, 5: " " * 3000 + "end" + " " * 3000,
        6: "été <|endoftext|> ça " * 300, 7: "中文没有空格" * 500, 8: "<|endoftext|>" * 100, 9: "a b" * 40,
    }
    found = by_id(token_counts.token_counts(spark, docs(*texts.items()), chunk=256, overlap=32))
    assert {i: r.n_tokens for i, r in found.items()} == {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in texts.items()}
    assert found[6].n_bytes == len(texts[6].encode()) and found[1].over_limit and not found[2].over_limit


def test_token_repeats_and_empty(spark, docs):
    row = (1, "a b " * 500)
    assert len({tuple(r) for r in token_counts.token_counts(spark, docs(row, row), chunk=256, overlap=32).collect()}) == 1
    assert token_counts.token_counts(spark, docs().limit(0)).count() == 0


def test_fast_encoding_equals_the_library(library):
    import random

    fast = token_counts.encoder(*token_counts.paths())
    points = [c for c in [*range(0x3400), *range(0xA000, 0x20000, 11)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}2 .{chr(c)}. {chr(c)}{chr(c)}\n{chr(c)} x" for c in points]
    draw = random.Random(1)
    texts += ["".join(draw.choice("ab  \n\t\r.,'s 12é 　中🙂́!") for _ in range(60)) for _ in range(3000)]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert fast.count(text) == len(whole), text


# 7 simhash and components


def test_simhash_blank_texts_repeats_and_null_ids(spark, docs):
    table = docs((5, None), (4, ""), (7, " \n"), (8, "one two"), (8, "one two"), (None, "one  TWO"), (9, LONG))
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, table).collect()}
    assert found == {(5, 4), (4, 4), (7, 4), (8, 8), (None, 8), (9, 9)}
    assert simhash.near_duplicates(spark, docs().limit(0)).count() == 0


def test_links_lose_no_pair(spark):
    import random

    draw, prints = random.Random(5), set()
    for _ in range(60):
        seed = draw.getrandbits(64)
        for _ in range(12):
            near = seed
            for b in draw.sample(range(64), draw.randint(0, 4)):
                near ^= 1 << b
            prints.add(near)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = {r.node: r.component for r in components.components(spark, simhash.links(table)).collect()}
    least = {p: p for p in prints}
    close = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    for _ in prints:
        if not any(least[a] != least[b] for a, b in close):
            break
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    assert {p: found.get(p, p) for p in prints} == least


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame(path + star + [(5000, 5000)], "a long, b long")
    found = {r.node: r.component for r in components.components(spark, links).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1400)}


# 8 line dedup


def test_lines(spark, docs, by_id):
    same = "A line that comes back"
    rows = [(1, f"{same}\nx\n{same}"), (2, f" {same.upper()} \nnew line of two"), (3, same), (4, None), (5, ""), (6, "x\nx\nninechars\nninechars"), (7, f"{same}\n" * 20_000), (8, "ten chars é"), (9, "TEN CHARS é")]
    table = docs(*rows)
    found = by_id(line_dedup.line_counts(spark, table))
    assert {i: (r.n_lines, r.n_dropped) for i, r in found.items()} == {1: (3, 0), 2: (2, 1), 3: (1, 1), 4: (1, 0), 5: (1, 0), 6: (4, 0), 7: (20_001, 20_000), 8: (1, 0), 9: (1, 1)}
    assert [found[i].kept_sha256 for i in (2, 3, 4, 7)] == [sha("new line of two"), sha(""), sha(""), sha("")]
    kept = by_id(line_dedup.dedup_lines(spark, table))
    assert kept[1].text == rows[0][1] and kept[2].text == "new line of two" and kept[4].text is None and kept[2].key == "x"


def test_full_filters_change_nothing(spark, docs):
    rows = [(i, f"line number {i}\nline number {i // 2}\nshared by everyone") for i in range(300)]
    small = line_dedup.line_counts(spark, docs(*rows), bits=1 << 10).collect()
    assert sorted(small) == sorted(line_dedup.line_counts(spark, docs(*rows)).collect())


def test_filters_are_sized_by_the_lines(spark, docs):
    rows = [(i, "\n".join(f"line number {i * 1000 + k} of all" for k in range(100))) for i in range(3000)] + [(9000, None)]
    table = docs(*rows)
    bits = line_dedup.filter_bits(table)
    assert bits == 1 << 22 and line_dedup.filter_bits(docs((1, None))) == line_dedup.LEAST_BITS == line_dedup.filter_bits(docs().limit(0))

    def share(bits):
        """Of all lines, which stand once, those that are suspected."""
        bitmap = np.frombuffer(line_dedup.seen_twice(table, bits), np.uint8)
        keys = [k for _, t in rows[:300] for k in line_dedup._keys(t.encode())]
        return line_dedup._has(bitmap, line_dedup._places(keys, bits)).mean()

    # A filter of a 64th of the size suspects all lines.
    assert share(bits) < 0.1 and share(bits // 64) > 0.9


def test_line_repeats_null_ids_and_empty(spark, docs):
    row = (1, "only in one document")
    found = line_dedup.line_counts(spark, docs(row, row, (None, row[1]), (None, row[1]))).collect()
    assert [r.n_dropped for r in found] == [0, 0, 0, 0]
    assert line_dedup.line_counts(spark, docs().limit(0)).count() == 0


# 9 html


def test_page_without_an_article():
    page = """<html><body class="with-sidebar"><header><h1>Site</h1></header><ul class="menu"><li><a href=x>Home</a><li><a>About</a></ul>
    <div id=content><h1>Title here</h1><p>First paragraph, long enough to be text.<p>Second &amp; l&#97;st, with <a href=y>a link</a>
    in it.</p><div class="ad">Buy now</div><!-- note --></div><div class="comments"><article><p>Great post!</p></article></div>
    <div class="cookie-notice">We use cookies.</div><script>var t = "</p><p>no text</p>";</script><form><label>Email</label></form>
    <aside><p>More to read on this site, a long list of it.</p></aside><footer>&copy; x</footer></body></html>"""
    assert html_content.main_text(page, {}) == "Title here First paragraph, long enough to be text. Second & last, with a link in it."


def test_names_inside_an_article_drop_none_of_its_text():
    text = "A paragraph with enough words to be text, and an end."
    for part in (f'<section id="discussion"><h2>H</h2><p>{text}</section>', f'<h2 id="social-impact">H</h2><p>{text}', f'<section class="related-work"><h2>H</h2><p>{text}</section>', f'<h2>H</h2><p id="search-space">{text}'):
        assert html_content.main_text(f"<article><p>First.</p>{part}<p>Last.</article>", {}) == f"First. H {text} Last."
    wrapped = f'<article><h1>H</h1><p>First.<div class="social-story"><p>{text}<p>{text}</div></article>'
    assert html_content.main_text(wrapped, {}) == f"H First. {text} {text}"
    page = f'<nav><a href=x>Home</a></nav><div class="content with-sidebar"><p>{text}<p>{text}<div class="sidebar">More</div></div>'
    assert html_content.main_text(page, {}) == f"{text} {text}"
    # Boilerplate and comments stand, however long they are.
    for name in ("comments", "cookie-notice"):
        page = f'<article><p>{text}</article><div class="{name}"><p>{text}<p>{text}<p>{text}</div>'
        assert html_content.main_text(page, {}) == text
    assert html_content.main_text(f'<article><p>{text}<div class="ad">Buy</div><section id="comments"><p>{text}<p>{text}</section></article>', {}) == text
    assert html_content.main_text(f'<p>{text}<div id="content"><p>{text}</div><div class="comments"><p>{text}<p>{text}<p>{text}</div>', {}).count(text) == 2


def test_formulas_and_fallback_text_of_an_article_stay():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. <object data=f>Fallback</object> <svg><text>Label</text></svg> <noscript>Shown</noscript><script>var x</script></article>"
    assert html_content.main_text(page, {}) == "So x=2 holds. Fallback Label Shown"


def test_classifier_and_ties_together_outvote_names_but_not_tags():
    text = "one two three"
    yes = {f"tag {t}": 4.0 for t in ("div", "p", "footer")}
    page = f'<div id="content"><p>{text}</p><div class="ad">{text}</div><p>{text}</p><footer>x</footer></div>'
    assert html_content.main_text(page, yes).count(text) == 3
    assert html_content.main_text(page, {}).count(text) == 2 and not html_content.main_text(page, yes).endswith("x")


def test_deep_and_broken_pages_take_linear_time():
    assert html_content.main_text("<div>word " * 20_000, {}).count("word") in (0, 20_000)
    assert html_content.main_text("</p></div>" * 20_000 + "<article>" + "<div><p>text" * 5_000 + "</article>", {}).count("text") == 5_000


def test_minimum_cut_equals_all_cuts():
    import itertools
    import random

    draw = random.Random(2)
    for _ in range(400):
        n = draw.randint(1, 9)
        capacity = [draw.choice([-1, 1]) * draw.random() for _ in range(n)]
        ties = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if draw.random() < 0.5:
                ties[a][b] = ties[b][a] = draw.random()

        def cost(side):
            own = sum(abs(c) for c, s in zip(capacity, side) if (c > 0) != s)
            return own + sum(w for a in range(n) for b, w in ties[a].items() if a < b and side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_content.minimum_cut(capacity, ties)) == pytest.approx(best)


@pytest.mark.parametrize("kind", ["tiny", "even", "mixed"])
@pytest.mark.parametrize("shape", ["list", "nested", "dense"])
def test_undecided_blocks_take_linear_time(kind, shape):
    import random
    import time

    draw = random.Random(3)
    n = 20_000 if shape != "dense" else 4_000
    weight = {"tiny": lambda: draw.choice([-1, 1]) * 0.001, "even": lambda: draw.choice([-1, 1]) * 0.5, "mixed": lambda: draw.uniform(-1, 1)}[kind]
    capacity = [weight() for _ in range(n)]
    ties = [{} for _ in range(n)]

    def tie(a, b, w):
        ties[a][b] = ties[b][a] = w

    for i in range(n - 1):
        tie(i, i + 1, 0.6)
    for i in range(n):
        if shape == "nested" and i % 2 == 0 and i + 2 < n:
            tie(i, i + 2, 0.4)
        if shape == "dense":
            for step in (2, 3):
                if i + step < n:
                    tie(i, i + step, 0.4)
    started = time.time()
    side = html_content.minimum_cut(capacity, ties)
    assert len(side) == n and time.time() - started < (2 if shape != "dense" else 20)


def test_classifier_and_cut_decide_where_no_tag_does(spark):
    import re

    duck = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    pages = [r.html for r in duck]
    odds = html_content.train(spark.createDataFrame([(p,) for p in pages], "html string"))
    # The same pages with nothing but plain elements without names.
    bare = [re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b[^>]*>", r"<\1div>", re.sub(r'\s(class|id|role)="[^"]*"', "", p)) for p in pages]
    kept = lost = added = 0
    for page, plain in zip(pages, bare):
        article, found = html_content.main_text(page, odds).split(), html_content.main_text(plain, odds).split()
        own, seen = set(article), set(found)
        kept, lost, added = kept + len(own & seen), lost + len(own - seen), added + len(seen - own)
    assert kept >= 0.9 * (kept + lost) and kept >= 0.8 * (kept + added), (kept, lost, added)


def test_pages_null_broken_repeated_and_empty(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>a <b>b<br>c", "x"), (3, "u", "<p>a <b>b<br>c", "x"), (None, "u", "<article>" + "<p>w w w." * 5000, "x"), (4, "u", "1 < 2 &nbsp; & <unclosed", "x")]
    found = html_content.main_texts(spark, spark.createDataFrame(rows, schema)).collect()
    assert [(r.text, r.n_chars) for r in found if r.page_id in (1, 2)] == [("", 0)] * 2
    assert len(found) == 6 and len([r for r in found if r.page_id is None][0].text.split()) == 15_000
    assert html_content.main_texts(spark, spark.createDataFrame([], schema)).count() == 0


# 10 decontamination


def test_windows_and_short_items(spark, docs, by_id):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, twelve), (2, "Alpha Beta"), (3, None), (4, "..."), (None, twelve), (5, twelve + " more"), (6, "solo")], "item_id long, text string")
    rows = [
        (1, f"x {twelve.upper()} y"), (2, twelve.replace(" ten", "")), (3, "alpha, beta! gamma alpha beta"), (4, None), (5, ""), (6, LONG + " " + twelve),
        (7, " ".join(twelve.split()[:10])), (8, "alpha gamma beta"), (9, "solo solo x"),
    ]
    found = by_id(decontam.contamination(spark, docs(*rows), items))
    assert {i: (r.n_hit, r.n_items, r.contaminated) for i, r in found.items()} == {
        1: (12, 2, True), 2: (0, 0, False), 3: (4, 1, True), 4: (0, 0, False), 5: (0, 0, False), 6: (12, 2, True), 7: (10, 2, True), 8: (0, 0, False), 9: (2, 1, True),
    }
    assert found[1].items_sha256 == sha("1,5") and found[4].items_sha256 == sha("") and found[6].n_words == 30_013


def test_items_without_an_id_count_as_hits(spark, docs, by_id):
    items = spark.createDataFrame([(None, "one two three four"), (None, "one two three four"), (7, "five six")], "item_id long, text string")
    table = docs((1, "x one two three four y"), (2, "one two three"), (3, "one two three four five six"))
    found = by_id(decontam.contamination(spark, table, items))
    assert {i: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in found.items()} == {
        1: (4, 0, sha(""), True), 2: (0, 0, sha(""), False), 3: (6, 1, sha("7"), True),
    }
    assert [r.doc_id for r in decontam.drop_contaminated(spark, table, items).collect()] == [2]


def test_repetitive_texts_and_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "to " * 30), (2, "to " * 12)], "item_id long, text string")
    row = (1, "to " * 3000 + "end")
    found = decontam.contamination(spark, docs(row, row, (None, "to be")), items).collect()
    assert sorted((r.n_hit, r.n_items) for r in found) == [(0, 0), (3000, 2), (3000, 2)]
    left = decontam.drop_contaminated(spark, docs(row, (2, "clean")), items)
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == docs(row).columns
    assert [r.n_words for r in decontam.contamination(spark, docs((1, "a b")), items.limit(0)).collect()] == [2]
    assert decontam.contamination(spark, docs().limit(0), items).count() == 0
