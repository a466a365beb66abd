"""What joins move: plans that keep texts and repeated rows where they are, and the rows they give."""

from pyspark.sql import functions as F

from riskledger.operators import corpus as C, rules as RO
from riskledger.sources.rules import load_rules


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_is_dealt_to_fixed_partitions(spark):
    big = spark.createDataFrame([(i % 3 or None, i) for i in range(40)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (None, "n")], "k int, w string")
    for how in ("inner", "left", "left_semi"):
        joined = C.salted_join(big, small, ["k"], ["v"], how)
        plan = _plan(joined)
        assert "BroadcastExchange" not in plan and plan.count("REPARTITION_BY_NUM") == 2
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, big.join(small, "k", how).collect()))


def test_texts_are_not_shuffled_by_rule_key(spark):
    rules = load_rules(spark)[0]
    files = spark.range(20).select(F.lit("AGENTS.md").alias("name"), F.lit("text").alias("text"), F.lit(True).alias("content_ok"))
    found = RO.apply_rules(files, rules, deep=True)
    assert "Exchange hashpartitioning" not in _plan(found) and found.count() == 20


def test_rows_of_texts_and_rules_are_not_shuffled(spark, monkeypatch):
    rules = [(i, ["ing", "No", "none"], "kw", 0.1, 0.9, 2) for i in range(30)] + [(3, ["run"], "u", 0.2, None, 1), (None, ["ing"], "x", 0.3, None, 1)]
    frame = spark.createDataFrame(rules, "rule_rank int, terms array<string>, prefix string, confidence double, boost double, threshold int")
    texts = spark.createDataFrame([(1, "running, NO"), (1, "running, NO"), (2, "ing"), (3, None), (4, "n")], "k int, text string")
    monkeypatch.setattr(RO, "POSTINGS", 7)
    found = RO.term_rules(texts, ["k"], frame)
    plan = _plan(found)
    assert "Exchange" not in plan[:plan.index("inline(_rules")]
    want = {(k, i): (0.9, ["kw:ing", "kw:No"]) if k == 1 else (0.1, ["kw:ing"]) for k in (1, 2) for i in range(30) if i != 3}
    rows = found.collect()
    assert {(r.k, r.rule_rank): (r.confidence, r.signals) for r in rows if r.rule_rank != 3} == want
    assert sorted((r.k, r.confidence, r.signals) for r in rows if r.rule_rank == 3) == [
        (1, 0.2, ["u:ing", "u:run", "u:No"]), (1, 0.9, ["kw:ing", "kw:run", "kw:No"]), (2, 0.1, ["kw:ing"]), (2, 0.2, ["u:ing"])]


def test_texts_with_several_terms_of_a_rule(spark, monkeypatch):
    """Rules by every number and place of terms against a plain loop."""
    import itertools
    words = ["ab", "ing", "xyz", "Abc d", "none at all"]
    rules = [(i, list(t), "kw", 0.1, 0.9, 2) for i, t in enumerate([*itertools.permutations(words, 2), *itertools.permutations(words[:4], 3), ("ab", "ab"), ("ing",), ()])]
    texts = [(i, " ".join(c)) for i, c in enumerate(c for n in range(5) for c in itertools.combinations(["AB,", "thing", "xyz!", "abc de"], n))] + [(99, None)]
    want = set()
    for (k, text), (rank, terms, *_) in itertools.product(texts, rules):
        if hit := [f"kw:{t}" for t in terms if text and t.lower() in text.lower()]:
            want.add((k, rank, 0.9 if len(hit) > 1 else 0.1, tuple(hit)))
    frame = spark.createDataFrame(rules, "rule_rank int, terms array<string>, prefix string, confidence double, boost double, threshold int")
    for size in (3, 1000):
        monkeypatch.setattr(RO, "POSTINGS", size)
        found = RO.term_rules(spark.createDataFrame(texts, "k int, text string"), ["k"], frame)
        rows = [(r.k, r.rule_rank, r.confidence, tuple(r.signals)) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want) > 300


def test_terms_with_a_run_in_no_text_meet_no_text(spark, monkeypatch):
    joined = []
    plain = RO.salted_join
    monkeypatch.setattr(RO, "salted_join", lambda *a, **b: joined.append(a[1]) or plain(*a, **b))
    texts = spark.createDataFrame([(1, "no such thing"), (2, "term of it")], "k int, text string")
    found = RO.term_hits(texts, ["k"], spark.createDataFrame([("no such term 7",), ("thing",)], "term string"))
    assert [tuple(r) for r in found.collect()] == [(1, "thing")] and [r.term for r in joined[0].collect()] == ["thing"]
