"""Personal data by bootstrapped contextual extraction.

Seeds are emails, IP addresses, card numbers and phone numbers that their own form proves, and secrets: long strings in which
letters and digits take turns as in keys and passwords, but not in words and numbers. Each seed, and each
other string that looks like an identifier (an @ or at least `LEAST_DIGITS` digits), induces lexical patterns from the
words around it. Spark scores the graph of patterns and instances in rounds: a pattern by the scores of the strings it
surrounds over all places of its cue in the corpus, an instance by its best pattern, seeds at 1. What a round discovers supports
further patterns in the next, also where these surround no seed. Patterns with a high rating and
enough support mark the strings they surround as identifiers, which the forms alone did not see.

Texts are read twice, for the strings and to count the patterns' cues; all rounds work on the edges. Edges are distinct before they are joined, patterns with too few
instances to ever have enough support are left out first, and sums are partial before their shuffle, so a frequent context
is one row per map task. Cues are whole however long they are.

Defined results: null and empty texts hold nothing; offsets are code points, ends exclusive; spans of
one kind never overlap, spans of different kinds may; rows that repeat an id and a text have equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, stored

KINDS = ("email", "ip", "card", "phone")
#: The kinds of what the method adds: what patterns discover, and secrets.
FOUND, SECRET = "id", "secret"
LEAST_DIGITS = 5
#: Characters of a secret, letters and digits among them, and changes between the two; digits and changes where all letters are capitals.
SECRET_LENGTH, SECRET_OF_EACH, SECRET_CHANGES, CAPITALS_OF_EACH = 16, 4, 4, 2
#: Rounds of scoring; least score and summed instance scores of an accepted pattern.
ROUNDS, LEAST_SCORE, LEAST_SUPPORT = 4, 0.8, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
# The look-behinds drop starts inside a run of digits, which match only where the run's own start does.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LIKE = re.compile(r"[0-9@]+")
_KEY, _CHANGE = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
#: What ends a string that looks like an identifier.
_STOPS = frozenset(" \t\n\r\x0b\x0c\"'<>|,;:()[]{}=")

# Cues are cut alike around a string and in the whole corpus, by Python and by Spark: before a string a word with all the
# marks behind it, as in `token = "`, after it a word with the marks ahead of it. So each cue stands next to one place only.
_GAP, _MARKS = r"\x20\x09-\x0D", r"\"'<>|,;:()\[\]{}="
_ENDS = _MARKS + ".!?"
BEFORE, AFTER = rf"(?:[^{_GAP}{_MARKS}]++|[{_MARKS}]++)(?:[{_GAP}]*+[{_MARKS}]++)*+", rf"[{_ENDS}]*+[^{_GAP}{_ENDS}]++|[{_ENDS}]++"
_BEFORE, _AFTER, _SPACES, _AHEAD = re.compile(BEFORE), re.compile(AFTER), frozenset(" \t\n\r\x0b\x0c"), _STOPS | frozenset(".!?")
#: Code points around a string that are searched for its cues first; as many times as it takes they are doubled.
REACH = 40

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The seeds, by kind as listed and then by start."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def lookalikes(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Other strings with an @ or enough digits, or the form of a secret, outside the spans `taken`."""
    found: list[tuple[int, int]] = []
    spans = sorted((s, e) for _, s, e in taken)
    end, k = 0, 0
    for m in _LIKE.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in _STOPS:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] not in _STOPS:
            end += 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        part = text[start:end]
        if "@" in part.strip("@") or len(_DIGIT.findall(part)) >= LEAST_DIGITS or is_secret(part.rstrip(".!?")):
            found.append((start, end))
    return found


def is_secret(part: str) -> bool:
    if len(part) < SECRET_LENGTH or not _KEY.fullmatch(part):
        return False
    digits, letters, changes = len(_DIGIT.findall(part)), sum(c.isalpha() for c in part), len(_CHANGE.findall(part))
    capitals = part.isalnum() and part.isupper() and min(digits, changes) >= CAPITALS_OF_EACH
    return capitals or min(digits, letters) >= SECRET_OF_EACH and changes >= SECRET_CHANGES


def secrets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those look-alikes that are secrets, without the marks that end a sentence."""
    found = []
    for s, e in spans:
        end = s + len(text[s:e].rstrip(".!?"))
        if is_secret(text[s:end]):
            found.append((s, end))
    return found


def _cue_before(text: str, start: int) -> str | None:
    reach = REACH
    while True:
        low = max(0, start - reach)
        cues = [m[0] for m in _BEFORE.finditer(text, low, start)]
        # The first may be cut, and the second is only whole behind another.
        if len(cues) > 1 or not low:
            return cues[-1] if cues else None
        reach *= 2


def _cue_after(text: str, end: int) -> str | None:
    reach = REACH
    while True:
        high = min(len(text), end + reach)
        cue = _AFTER.search(text, end, high)
        if cue and cue.end() < high or high == len(text):
            return cue[0] if cue else None
        reach *= 2


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a string: the cue before it and the cue after it, unless they hold digits or the string ends inside one."""
    found = []
    if start and text[start - 1] in _STOPS:
        cue = _cue_before(text, start)
        if cue:
            found.append(f"{cue.lower()} _")
    if end < len(text) and (text[end] in _SPACES or text[end] in _AHEAD and text[end - 1] not in _AHEAD):
        cue = _cue_after(text, end)
        if cue:
            found.append(f"_ {cue.lower()}")
    return [p for p in found if not _DIGIT.search(p)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SCHEMA = "base array<struct<kind:string,start:long,end:long>>, secrets array<struct<kind:string,start:long,end:long>>, seeds array<struct<start:long,end:long,instance:string,patterns:array<string>>>, others array<struct<start:long,end:long,instance:string,patterns:array<string>>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def seen(text: str, spans: list[tuple[int, int]]) -> list[dict]:
        found, taken = [], set()
        for s, e in spans:
            # A place counts once, also where strings of several kinds start or end there.
            around = [(p, s if p.endswith(" _") else -e) for p in patterns(text, s, e)]
            of = [p for p in around if p not in taken]
            taken.update(of)
            found.append({"start": s, "end": e, "instance": hashlib.md5(text[s:e].lower().encode()).hexdigest(), "patterns": [p for p, _ in of]})
        return found

    for batch in batches:
        base, kept, seeds, others = [], [], [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            spans = base_spans(text)
            like = lookalikes(text, spans)
            keys = secrets(text, like)
            starts = {s for s, _ in keys}
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            kept.append([{"kind": SECRET, "start": s, "end": e} for s, e in keys])
            seeds.append(seen(text, [*((s, e) for _, s, e in spans), *keys]))
            others.append(seen(text, [(s, e) for s, e in like if s not in starts]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, _SPANS), pa.array(kept, _SPANS), pa.array(seeds, _SEEN), pa.array(others, _SEEN)], names=["key", "doc_id", "base", "secrets", "seeds", "others"])


def extracted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, secrets, seeds, others) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "doc_id", "text")
    return stored(spark, texts.mapInArrow(_read, f"key string, doc_id {kind}, {_SCHEMA}"), "identifiers")


def _cue_counts(spark: SparkSession, docs: DataFrame, patterns_: DataFrame) -> DataFrame:
    """(pattern, n): how often the cue of each pattern stands in the whole corpus, cut as around the strings."""
    ahead = F.col("pattern").endswith(" _")
    cue = F.when(ahead, F.expr("substring(pattern, 1, length(pattern) - 2)")).otherwise(F.expr("substring(pattern, 3)"))
    cues = stored(spark, patterns_.select("pattern", ahead.alias("ahead"), cue.alias("cue")), "cues")
    cut = [F.struct(F.lit(is_ahead).alias("ahead"), F.regexp_extract_all("text", F.lit(how), F.lit(0)).alias("cues")) for is_ahead, how in ((True, BEFORE), (False, AFTER))]
    each = docs.select(F.explode(F.array(*cut)).alias("c")).select("c.ahead", F.explode("c.cues").alias("cue")).withColumn("cue", F.lower("cue"))
    counts = each.join(cues.select("ahead", "cue"), ["ahead", "cue"], "left_semi").groupBy("ahead", "cue").agg(F.count("*").alias("n"))
    return stored(spark, cues.join(counts, ["ahead", "cue"]).select("pattern", "n"), "cue-counts")


def accepted_patterns(spark: SparkSession, docs: DataFrame, each: DataFrame) -> DataFrame:
    """(pattern, rating) of the patterns that surround identifiers and little else.

    A pattern's rating is the summed scores of the strings it surrounds over all places of its cue, glued to what it
    surrounds or not, so a cue that ordinary words follow too is rated near 0.
    """

    def edges_of(column: str, seed: int) -> DataFrame:
        one = each.select(F.explode(column).alias("o"))
        return one.select(F.explode("o.patterns").alias("pattern"), F.col("o.instance").alias("instance"), F.lit(seed).alias("seed"))

    edges = edges_of("seeds", 1).unionByName(edges_of("others", 0)).groupBy("pattern", "instance")
    edges = stored(spark, edges.agg(F.max("seed").alias("seed"), F.count("*").alias("places")), "pattern-edges")
    # Each instance adds at most one to a pattern's support.
    frequent = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= LEAST_SUPPORT).select("pattern")
    counts = _cue_counts(spark, docs, frequent)
    edges = stored(spark, edges.join(counts, "pattern"), "frequent-edges")
    scores = stored(spark, edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "instances")
    for k in range(ROUNDS):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(
            F.sum("score").alias("support"), (F.sum(F.col("score") * F.col("places")) / F.max("n")).alias("rating")
        )
        rated = stored(spark, rated.where(F.col("support") >= LEAST_SUPPORT).select("pattern", F.least("rating", F.lit(1.0)).alias("rating")), "patterns")
        if k < ROUNDS - 1:
            best = edges.join(rated, "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), F.max("rating")).alias("best"))
            scores = stored(spark, scores.join(best, "instance", "left").select("instance", F.coalesce("best", "score").alias("score")), "instances")
    return rated.where(F.col("rating") >= LEAST_SCORE)


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, found) of each row: the base spans, and the secrets and the spans that patterns discovered."""
    each = extracted(spark, docs)
    accepted = stored(spark, accepted_patterns(spark, docs, each), "accepted-patterns")
    others = each.select("key", F.explode("others").alias("o")).select("key", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    found = others.join(accepted, "pattern", "left_semi").select("key", F.struct(F.lit(FOUND).alias("kind"), "start", "end").alias("span"))
    found = found.groupBy(F.col("key").alias("of")).agg(F.array_sort(F.collect_set("span")).alias("found"))  # at most a document's
    joined = each.select("key", "doc_id", "base", "secrets").join(stored(spark, found, "found"), F.col("key") == F.col("of"), "left")
    none = F.array().cast(each.schema["base"].dataType)
    return joined.select("key", "doc_id", "base", F.concat(F.coalesce("found", none), "secrets").alias("found"))


def span_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each document."""
    each = personal_data(spark, docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return each.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"))
