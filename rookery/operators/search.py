"""Search for very many terms at once, by an index of the names' short substrings.

The index holds every run of 1, 2, 3, 6 and 12 characters (a gram) of each user's handle and first name in lower case. A term that matches a name
contains, between its wildcards, only text that the name has too; so all users whom it matches are among
those of its rarest gram, and only they are compared with it. Long texts of a term are looked up by long grams: users who share three characters
grow with the users, and so would the comparisons of each term. Terms are a table of any size, and the plan does not grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .predicates import _OLDEST
from .prefilter import BITS_PER_ID, bitmap_bits, id_bitmap, may_match
from .ranking import top_k
from .skew import ROWS_PER_SALT, SALTS, spread_join

#: Characters of the longest gram whose users are counted. Those of a longer one are estimated by the counts of its pieces.
GRAM = 3
#: Characters of the grams.
LENGTHS = (1, 2, GRAM, 6, 12)
#: Users whose grams one task sorts and writes: each name is then stored once in a file, as its dictionary fits a page.
USERS_PER_TASK = 8192
#: Bits for each gram that is asked for: about one of a hundred others passes.
BITS_PER_GRAM = 80
NAMES = ("handle", "first_name")
#: What the index holds of a user beside the gram: what a term is compared with and matches are ordered by.
_INDEXED = "gram string, id bigint, handle string, first_name string, creation_time timestamp_ntz"


def _runs_of(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))


def _new_grams(texts: list[Column], at: Column) -> Column:
    """The grams that start at a place of the texts, for all places each gram of any text once: where it is first, in the first text that has it. The empty one is at place 1."""
    grams = [F.when(at == 1, F.lit(""))]
    for number, text in enumerate(texts):
        for n in LENGTHS:
            gram = F.substr(text, at, F.lit(n))
            is_new = (at + n - 1 <= F.length(text)) & (F.instr(text, gram) == at)
            for earlier in texts[:number]:
                is_new = is_new & (F.instr(earlier, gram) == 0)
            grams.append(F.when(is_new, gram))
    return F.array(*grams)


def term_pattern(term: Column) -> Column:
    """The term as a pattern for `ilike`: `%` and `_` are wildcards, and a backslash before an ordinary character stands for that character."""
    return F.concat(F.lit("%"), F.regexp_replace(term, r"(\\[%_\\])|\\(.)", "$1$2"), F.lit("%"))


def _literals(pattern: Column) -> Column:
    """The texts between a pattern's wildcards, in lower case."""
    literals = F.regexp_extract_all(F.lower(pattern), F.lit(r"((?:\\[%_\\]|[^%_\\])+)"), F.lit(1))
    return F.transform(literals, lambda t: F.regexp_replace(t, r"\\(.)", "$1"))


def _longest_runs(text: Column) -> Column:
    """The grams of a text that are as long as it has any."""
    runs = F.array(text)
    for n in LENGTHS:
        runs = F.when(F.length(text) >= n, _runs_of(text, n)).otherwise(runs)
    return runs


def term_grams(pattern: Column) -> Column:
    """Grams that every text matching the pattern contains: the longest ones of its text between wildcards, or the empty one."""
    grams = F.flatten(F.transform(_literals(pattern), _longest_runs))
    return F.when(F.size(grams) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(grams))


def _pieces(gram: Column) -> Column:
    """A gram cut into grams that are counted."""
    cut = F.transform(F.sequence(F.lit(1), F.length(gram), F.lit(GRAM)), lambda i: F.substr(gram, i, F.lit(GRAM)))
    return F.when(F.length(gram) <= GRAM, F.array(gram)).otherwise(F.array_distinct(cut))


def save_name_index(users: DataFrame, path: str) -> None:
    """Write the index of all users below `path`: each gram with the users that have it, and how many these are for grams of up to `GRAM` characters.

    Users are dealt out before their grams are made, and each file has the grams of its users, in order of the grams: no gram is shuffled.
    """
    lowered = [f"_{c}" for c in NAMES]
    plain = users.select("id", *NAMES, "creation_time", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(low) for c, low in zip(NAMES, lowered, strict=True)])
    dealt = plain.repartition(max(1, -(-users.count() // USERS_PER_TASK)), "id")
    last = F.greatest(F.lit(1), *[F.length(low) for low in lowered])
    places = dealt.withColumn("_at", F.explode(F.sequence(F.lit(1), last)))
    grams = places.withColumn("gram", F.explode(_new_grams([F.col(low) for low in lowered], F.col("_at"))))
    rows = grams.filter(F.col("gram").isNotNull()).select("gram", "id", *NAMES, "creation_time")
    rows.sortWithinPartitions("gram", "id").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/grams")
    counted = users.sparkSession.read.schema("gram string").parquet(f"{path}/grams").filter(F.length("gram") <= GRAM)
    counted.groupBy("gram").agg(F.count("*").alias("n")).write.mode("errorifexists").parquet(f"{path}/counts")


def load_name_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(_INDEXED).parquet(f"{path}/grams"),
        spark.read.schema("gram string, n bigint").parquet(f"{path}/counts"),
    )


def _wanted(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, _pattern, _text, gram, _n): each distinct term with its longest text between wildcards, its rarest gram and about how many users have that.

    Terms with a gram that surely no name has are left out.
    """
    asked = terms.select("term").distinct().withColumn("_pattern", term_pattern(F.col("term")))
    texts = F.sort_array(F.transform(_literals(F.col("_pattern")), lambda t: F.struct(F.length(t).alias("n"), t.alias("text"))), asc=False)
    asked = asked.withColumn("_text", F.coalesce(F.get(texts, F.lit(0))["text"], F.lit("")))
    pieces = asked.select("term", "_pattern", "_text", F.explode(term_grams(F.col("_pattern"))).alias("gram"))
    pieces = pieces.withColumn("_piece", F.explode(_pieces(F.col("gram"))))
    # As if pieces met by chance: of all users, the share of the first times the share of the second, and so on.
    everyone = F.coalesce(counts.filter(F.col("gram") == "").select("n").scalar(), F.lit(1)).cast("double")
    share = F.sum(F.ln(F.col("n") / everyone))
    needed = pieces.join(counts.toDF("_piece", "n"), "_piece", "left").groupBy("term", "_pattern", "_text", "gram")
    needed = needed.agg(F.when(F.count("n") == F.count(F.lit(1)), F.exp(share) * everyone).otherwise(0).alias("n"))
    # A gram that no name has excludes the term.
    rarest = needed.groupBy("term", "_pattern", "_text").agg(F.min(F.struct("n", "gram")).alias("_least")).filter(F.col("_least.n") > 0)
    return rarest.select("term", "_pattern", "_text", F.col("_least.gram").alias("gram"), F.col("_least.n").alias("_n"))


def search_users_indexed(users: DataFrame, terms: DataFrame, index: tuple[DataFrame, DataFrame], k: int | None = 50) -> DataFrame:
    """`search_users` for every distinct `term` of a frame; column `term` tells which one matched. `k=None` gives all matches.

    Terms are compared with the names in the index, and each is cut to its k before users are joined: candidates, of which a frequent gram has
    very many, are not shuffled. Grams that no term asks for are told by a bitmap and are not shuffled either. The terms with their grams
    are written to the shared folder first.
    """
    grams, counts = index
    path, spark = work_dir(users.sparkSession, "terms"), users.sparkSession

    def written(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    # Needed three times, and its expressions take long for each term.
    wanted = written("wanted", _wanted(terms, counts))
    # A gram is hot by its comparisons: its users times its terms.
    load = wanted.groupBy("gram").agg((F.max("_n") * F.count(F.lit(1))).alias("_load")).filter(F.col("_load") > ROWS_PER_SALT)
    # Written, so that Spark knows how few they are.
    hot = written("hot", load.select("gram", F.ceil(F.col("_load") / ROWS_PER_SALT).cast("int").alias(SALTS)))
    bits = bitmap_bits(wanted.count() * (BITS_PER_GRAM // BITS_PER_ID), least_bits=1)
    if bits is not None:
        grams = may_match(grams, "gram", id_bitmap(wanted, "gram", bits), bits)
    matches = F.lit(False)
    for name in NAMES:
        # The pattern is made into an expression for each comparison; most names lack the text already.
        has_text = F.contains(F.lower(F.col(name)), F.col("_text"))
        matches = matches | F.coalesce(has_text & F.ilike(F.col(name), F.col("_pattern")), F.lit(False))
    oldest = [F.col(c).asc() for c in _OLDEST]
    asked = wanted.drop("_n")
    found = spread_join(grams, asked, "gram", "id", "inner", hot=hot).filter(matches).select("term", "_pattern", "_text", *_OLDEST)
    if k is not None:
        found = top_k(found, ["term"], oldest, k)
    found = users.join(found.select("id", "term", "_pattern", "_text"), "id").filter(matches).drop("_pattern", "_text")
    return found if k is None else top_k(found, ["term"], oldest, k)
