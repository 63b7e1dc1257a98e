import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm.mixing import Mix, budgets, place, select_mix, shared, token_count


def test_shared():
    assert shared(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert shared(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert shared(100, [1, 0, 1], [30, 99, 40]) == [30, 0, 40]
    assert sum(shared(101, [1, 1, 1], [50, 50, 50])) == 101
    assert shared(0, [1], [5]) == [0] and shared(5, [], []) == []


def test_shortage_goes_to_siblings_before_ancestors():
    tokens = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 500, ("b", "y"): 500}
    out = budgets(tokens, ["top", "low"], Mix({}, share=400 / 1510, max_epochs=1))
    assert out == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    tokens[("a", "y")] = 20
    out = budgets(tokens, ["top", "low"], Mix({}, share=400 / 1030, max_epochs=1))
    assert out == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 185, ("b", "y"): 185}


def brute(spark, rows, mix):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    leaf = lambda r: (r[2] or "(none)", r[3] or "(none)")
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += count(r[1])
    given = budgets(tokens, ["lang", "source"], mix)
    df = spark.createDataFrame([(r[0], r[1], e) for r in set(rows) for e in range(mix.max_epochs)], "i long, t string, e int")
    at = {(r["i"], r["t"], r["e"]): r["p"] for r in df.select("*", place(mix, "e", F.xxhash64("i", "t")).alias("p")).collect()}
    out, by = [], defaultdict(list)
    for r in rows:
        by[leaf(r)].append(r)
    for name, own in by.items():
        n = max(1, tokens[name])
        out += [(r[0], r[1], e) for e in range(given[name] // n) for r in own]
        e, rest, total = given[name] // n, given[name] % n, 0
        groups = defaultdict(list)
        for r in own:
            groups[at.get((r[0], r[1], e), 0)].append(r)
        for _, same in sorted(groups.items()) if rest else []:
            total += sum(count(r[1]) for r in same)
            if total > rest:
                break
            out += [(r[0], r[1], e) for r in same]
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2"])) for i in range(400)]
    rows += [(500, None, "en", "s0"), (501, "", "de", "s1"), (502, " \n", None, None), (3, *rows[3][1:]), (None, "a b", "en", "s9"), (503, "w " * 5000, "fr", "s0"), (504, None, "zz", "s0")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, tokens int").repartition(3)
    for mix in (Mix({"lang": {"en": 1.0, "de": 5.0, "fr": 0.5}, "source": {"s2": 0.0}}, 0.8, 3), Mix({}, 2.0, 2), Mix({}, 0.0, 1), Mix({}, 1.0, 1)):
        out = select_mix(df, {"lang": F.col("lang"), "source": F.col("source")}, mix)
        assert sorted(((r["doc_id"], r["text"], r["epoch"]) for r in out.collect()), key=repr) == brute(spark, rows, mix)


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([("a\x0bb  c d",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(token_count(F.col("text"))).collect()] == [3, 0, 0]
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert select_mix(none, {"lang": F.col("lang")}, Mix()).count() == 0
