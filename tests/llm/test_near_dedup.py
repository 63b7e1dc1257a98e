import random
import re

from tidemark.llm.near_dedup import near_duplicates, open_pairs, prefixes


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]  # rows of one id are one node
    name = {i: i for i, _ in rows if i is not None}
    changed = True
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if None not in (a, b) and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return sorted(((i, len(s), name.get(i), i == name.get(i)) for i, s in sets), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(40)]
    for i in range(40, 140):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    base = " ".join(word() for _ in range(80)).split()  # one crowded group
    for i in range(200, 290):
        words = list(base)
        words[rng.randrange(80)] = word()
        words[rng.randrange(80)] = word()
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "ONE\ttwo "), (305, "one"), (None, "one two"), (303, "one two"), (303, rows[7][1]), (308, rows[9][1]), (308, rows[11][1])]
    rows += [(306, "x" * 20000 + " y " * 3000), (307, "x" * 20000 + " y " * 3000)]
    assert run(spark, rows) == brute(rows)


def test_no_similar_pair_is_left_out(spark):
    """Sets of one frequent passage and others: all that are similar are paired, and hardly any that share the passage alone."""
    rng = random.Random(5)
    sets = {i: set(range(46)) | {rng.randrange(1000 + 40 * (i // 3), 1040 + 40 * (i // 3)) for _ in range(rng.randint(4, 30))} for i in range(90)}
    pool = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    table = spark.createDataFrame([(i, bytes([i]), sorted(s)) for i, s in sets.items()], "node long, digest binary, shingles array<long>")
    found = {(r["a"], r["b"]) for r in open_pairs(prefixes(pool, table), pool).collect()}
    every = [(a, b) for a in sets for b in sets if a < b]
    similar = {(a, b) for a, b in every if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert similar and similar <= found and len(found - similar) < len(every) / 10


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_pages_of_one_template_do_not_meet(spark):
    """Sets that share much, but not enough, aren't paired at all, though their shingles are frequent."""
    from tidemark.llm import near_dedup
    from pyspark.sql import functions as F

    common = " ".join(f"t{i}" for i in range(84))
    docs = spark.createDataFrame([(i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(16))) for i in range(600)], "doc_id long, text string")
    shingles = F.expr("transform(sequence(0, 95), i -> xxhash64(array_join(slice(split(text, ' '), i + 1, 5), ' ')))")
    sets = docs.select(F.col("doc_id").alias("node"), F.xxhash64("doc_id").cast("string").cast("binary").alias("digest"), shingles.alias("shingles"))
    known = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    first = near_dedup.prefixes(known, sets)
    assert first.count() > 0
    guests, hosts = near_dedup.sizes_met(first), first.withColumn("class", near_dedup.size_class(F.col("n")))
    assert guests.join(hosts, ["shingle", "class"]).count() == 0
    out = near_dedup.near_duplicates(docs)
    assert out.where("kept").count() == 600
