"""Candidates of a search by index are compared where the index is, and not shuffled."""

import random

from pyspark.sql import functions as F

from rookery.operators import search


def test_candidates_are_cut_before_users_are_joined(spark, social, tmp_path, rows):
    people = [{"id": i, "handle": f"name_{i % 40}", "first_name": "Ann"} for i in [*range(300), 5, 6]]
    users = social(users=people).users
    search.save_name_index(users, str(tmp_path / "i"))
    index = search.load_name_index(spark, str(tmp_path / "i"))
    terms = spark.createDataFrame([("an",), ("name_3",), ("%_",), ("nobody",)], "term string")
    found = search.search_users_indexed(users, terms, index, 7)
    assert {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()} == {"an": 7, "name_3": 7, "%_": 7}
    whole = search.search_users_indexed(users, terms, index, None)
    assert set(rows(found, "term", "id", "handle")) <= set(rows(whole, "term", "id", "handle"))
    # Ranked below the join with users, and once more above it.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2


def test_long_texts_of_terms_are_looked_up_by_long_grams(spark, social, tmp_path):
    """Users who share three characters with a term grow with the users; those compared with a term must not."""
    users = social(users=[{"id": i, "handle": f"member_{i:07d}", "first_name": "Ann"} for i in range(3000)]).users
    search.save_name_index(users, str(tmp_path / "i"))
    grams, counts = search.load_name_index(spark, str(tmp_path / "i"))
    terms = spark.range(3000).select(F.format_string("er\\_%07d", "id").alias("term"))
    looked_up = terms.select("term", F.explode(search.term_grams(search.term_pattern(F.col("term")))).alias("gram"))
    held = looked_up.join(grams.groupBy("gram").count(), "gram").groupBy("term").agg(F.min("count").alias("n"))
    assert held.agg(F.max("n")).first()[0] <= 20
    found = search.search_users_indexed(users, terms, (grams, counts))
    assert found.count() == 3000 and found.filter(F.substring("handle", -7, 7) != F.substring("term", -7, 7)).count() == 0


def test_long_names_are_found_as_term_by_term(spark, social, tmp_path, rows):
    from rookery.operators import predicates

    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abA_%İ\U0001f642") for _ in range(rng.randrange(most)))
    people = [{"id": i, "handle": word(40), "first_name": word(30) if i % 5 else None} for i in range(200)]
    users = social(users=[*people, {"handle": "abababababab", "first_name": "abababababab"}]).users
    search.save_name_index(users, str(tmp_path / "i"))
    index = search.load_name_index(spark, str(tmp_path / "i"))
    # One row for each gram of a user.
    assert index[0].count() == index[0].distinct().count() and index[0].filter("gram = ''").count() == 201
    names = [p["handle"] for p in people if len(p["handle"]) > 20]
    terms = sorted({*[n[3:3 + rng.randrange(1, 16)] for n in names], *[word(16) for _ in range(40)], "ababab", "abababababab"})
    found = search.search_users_indexed(users, spark.createDataFrame([(t,) for t in terms], "term string"), index, None)
    assert rows(found, "term", "id") == rows(predicates.search_users_many(users, terms, 10_000).filter("id IS NOT NULL"), "term", "id")
