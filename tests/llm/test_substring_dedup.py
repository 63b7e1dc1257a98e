import random
import re

from tidemark.llm.substring_dedup import SPAN, UNIT, remove_repeats


def cut(text):
    """[(words, start)] of each sentence, word by word."""
    out, now, end = [], [], None
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", text):
        if end is not None and b"\n" in text[end : m.start()] and now:
            out.append(now)
            now = []
        now.append((re.sub(rb"[A-Z]", lambda c: c[0].lower(), m[0]), m.start()))
        end = m.end()
        if m[0][-1:] in b".!?":
            out.append(now)
            now = []
    out += [now] if now else []
    return [(tuple(w for w, _ in s[i : i + UNIT]), s[i][1]) for s in out for i in range(0, len(s), UNIT)]


def brute(rows):
    found, first = [], {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        units = cut((t or "").encode())
        for a in range(len(units)):
            n, b = 0, a
            while b < len(units) and (n < SPAN or b - a < 2):
                n += len(units[b][0])
                b += 1
            if n >= SPAN and b - a >= 2:
                words = tuple(w for u, _ in units[a:b] for w in u)
                found.append((i, t, a, b, words))
    order = {}
    for i, t, a, b, words in found:
        order.setdefault(words, (i, t, a))
    gone = {}
    for i, t, a, b, words in found:
        if order[words] != (i, t, a):
            gone.setdefault((i, t), set()).update(range(a, b))
    out = []
    for i, t in rows:
        data, units, bad = (t or "").encode(), cut((t or "").encode()), gone.get((i, t), set())
        edges = [s for _, s in units] + [len(data)]
        clean = data if not bad else (data[: edges[0]] + b"".join(data[edges[k] : edges[k + 1]] for k in range(len(units)) if k not in bad)).rstrip()
        out.append((i, None if t is None else clean.decode(), len(units), len(bad)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, at string, n_removed int").repartition(3)
    return sorted(((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in remove_repeats(df).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    say = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", ".", "!", "?"])
    prose = lambda n: rng.choice([" ", " ", "\n", "  "]).join(say(rng.randint(1, 24)) for _ in range(n))
    shared = [prose(6) for _ in range(3)] + [say(60)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(1, 6))]
        if rng.random() < 0.5:
            parts += [rng.choice(shared), prose(2)]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (3, rows[3][1]), (200, rows[4][1]), (None, rows[5][1]), (103, shared[0] + " " + shared[0].upper())]
    rows += [(104, "word " * 5000), (105, "The. And. Of."), (106, "The. And. Of.")]
    assert run(spark, rows) == brute(rows)


def test_passage_stays_once_and_clean_texts_are_left(spark):
    passage = " ".join(f"p{k}" + ("." if k % 13 == 12 else "") for k in range(65))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + ". " + passage + f" tail{i} here.") for i in range(30)] + [(50, " ".join(f"c{k}" for k in range(90)))]
    out = {i: t for i, t, _, _ in run(spark, rows)}
    assert passage in out[0] and not any("p30" in out[i] for i in range(1, 30))
    assert all(f"w{i}x3" in out[i] for i in range(30)) and out[50] == rows[-1][1]


def test_passage_within_sentences_goes(spark):
    """Runs of 51 words and more that begin and end anywhere in a sentence, against the words that were planted."""
    rng = random.Random(8)
    rows, planted = [], {}
    for j in range(60):
        stop = rng.choice([0, 23, 31])
        passage = [f"p{j}x{k}" + ("." if stop and k % stop == stop - 1 else "") for k in range(rng.choice([51, 51, 65, 81]))]
        for i in (2 * j, 2 * j + 1):
            before, behind = [[f"{s}{i}x{k}" for k in range(rng.randint(1, 45))] for s in "bz"]
            rows.append((i, " ".join(before + passage + behind)))
            planted[i] = set(passage)
    out = {i: t for i, t, _, _ in run(spark, rows)}
    lost = {i: set(t.split()) - set(out[i].split()) for i, t in rows}
    assert not any(lost[i] for i in range(0, 120, 2)) and all(lost[i] <= planted[i] for i in lost)
    assert sum(map(bool, lost.values())) >= 58 and sum(map(len, lost.values())) > 0.65 * sum(len(planted[i]) for i in range(1, 120, 2))


def test_empty(spark):
    assert run(spark, []) == []
