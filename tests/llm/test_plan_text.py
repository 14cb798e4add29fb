"""What the driver keeps of a plan does not grow with the tables."""

from trellium.llm import bloom, jaccard_join, scratch, spelling


def test_plans_of_near_copies_hold_no_filter(spark):
    def length(n):
        rows = [(i, f"one two three four five six seven eight nine ten {i // 2} twelve" + " more" * (i % 2)) for i in range(n)]
        with scratch.scope():
            kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Rule(5, 80, 100))
            plan = kept._jdf.queryExecution().toString()
            return len(plan), kept.count()

    (small, few), (large, many) = length(20), length(1200)
    assert (few, many) == (10, 600)
    assert large < small * 1.2


def test_rows_within_a_filter_and_the_others(spark):
    keys, rows = spark.range(0, 3000, 3), spark.range(3000)
    bits, hashes = bloom.plan(1000, 16.0)
    words = bloom.build(keys, "id", bits, hashes, 3)
    within = {r[0] for r in bloom.within(rows, "id", words, bits, hashes, 3).collect()}
    others = {r[0] for r in bloom.within(rows, "id", words, bits, hashes, 3, held=False).collect()}
    assert set(range(0, 3000, 3)) <= within and len(within) < 1100
    assert within | others == set(range(3000)) and not within & others


def test_words_exploded_by_band_are_not_broadcast(spark):
    with scratch.scope():
        words = scratch.store(spark.range(5000).selectExpr("concat('word', lpad(translate(id, '0123456789', 'abcdefghij'), 6, 'k')) as word", "5L as n"), "words")
        pairs = spelling.near_pairs(words.df)
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
