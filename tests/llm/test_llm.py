"""The training-data operators on small cases: brute force, round trips, odd input."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("rangeloom.llm")

from rangeloom.llm import bpe, chat, decontaminate, exact_dedup, html_extract, line_dedup, near_dup, quality, recurrent_lm, toxicity  # noqa: E402

DOCS = "doc_id long, text string"
#: Odd rows: null and empty texts, ties, repeated rows, a null id, extra columns that clash with the operators' own names.
ODD = [(1, None), (2, ""), (3, "One two three"), (3, "One two three"), (4, "one TWO three"), (None, "one two three"), (5, "x"), (6, "word " * 3000)]


def odd(spark, rows=ODD):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"keep_id": F.lit("a"), "kept": F.lit("b"), "score": F.lit(7), "n": F.lit(1), "key": F.lit(2), "label": F.lit(3), "line": F.lit("l")})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(spark):
    rows = ODD + [(7, "ÄB"), (8, "äb"), (9, "Äb")]
    got = exact_dedup.report(odd(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    for r in got:
        members = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in v)
        assert r["keep_id"] == max(i for i in members if i is not None) and r["group_size"] == len(members)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.report(spark.createDataFrame([], DOCS)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(odd(spark, rows)).collect()) == [2, 4, 5, 6, 8, 9]


def brute_near(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower(t)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def family(n, words, seed):
    random.seed(seed)
    base = [f"w{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(random.randrange(4)):
            own[random.randrange(words)] = f"v{random.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_dup_equals_brute_force(spark, monkeypatch):
    texts = family(60, 120, 1) + family(8, 60, 2) + family(5, 9, 3) + ["a b", "a  B", "", None, "z"] + ["same text of some words here"] * 4
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    want = brute_near(rows)
    for bucket, members in ((4000, 400), (8, 10)):  # whole, and dealt out in blocks
        monkeypatch.setattr(near_dup, "FAMILY", members)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.annotate(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == want


def test_near_dup_odd_rows(spark):
    got = near_dup.annotate(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[4]["component_id"] == 3 and not by[4]["kept"] and by[3]["kept"]
    assert near_dup.annotate(spark.createDataFrame([], DOCS)).count() == 0


def test_forest_spans_every_component():
    rng = np.random.default_rng(0)
    m = rng.random((90, 90)) < 0.02
    m |= m.T
    links = near_dup.forest(90, lambda a, b: m[np.ix_(a, b)], block=4)
    root = list(range(90))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        assert m[a, b] and find(a) != find(b)
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in zip(*np.nonzero(m)))


@pytest.mark.parametrize("few", [near_dup.FEW_LINKS, 0])
def test_components_on_the_driver_and_by_rounds(spark, few):
    """A path, a hub, a cycle of large and negative ids and random links; few links take a fixed number of jobs."""
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(400, 460)] + [(2**62, -7), (-7, 2**40), (2**40, 2**62), (9000, 9000)]
    links += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(90)]
    root = {x: x for link in links for x in link}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup(f"components-{few}", "")
    got = near_dup.components(frame, few).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in got} == {x: y for x, y in root.items() if x != y} and len(got) == len({x for x, y in root.items() if x != y})
    assert jobs <= 10 or not few
    assert near_dup.components(frame.limit(0), few).count() == 0



def brute_hits(text, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) if w]
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for a in range(len(x) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark):
    random.seed(6)
    some = lambda n: " ".join(random.choice("abcde") + random.choice("fgh") for _ in range(n))
    items = [(10, some(30)), (2, some(13)), (33, some(4)), (5, some(1)), (6, None), (7, "--"), (8, some(12)), (10, some(20))]
    rows = [(i, some(random.randrange(60))) for i in range(30)]
    rows += [(50, "Q " + items[0][1][:60] + " r"), (51, items[1][1].upper() + "!"), (52, (some(9) + " " + items[0][1] + " ") * 3), (53, None), (54, items[6][1])]
    for chosen in (items, [x for x in items if x[0] not in (33, 5)], []):
        got = decontaminate.report(spark.createDataFrame(rows, DOCS), spark.createDataFrame(chosen, "item_id long, text string")).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, found, sha = brute_hits(dict(rows)[r["doc_id"]], chosen)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, found, sha, hit > 0 and 20 * hit >= n)


def test_decontamination_removes_spans(spark):
    item = " ".join(f"t{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "Clean, text.")], DOCS)
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "before after", 2: "Clean, text."}
    assert [r["doc_id"] for r in decontaminate.remove_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [2]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_edit_distance(spark):
    from pyspark.sql import functions as F

    random.seed(2)
    word = lambda: "".join(random.choice("abé") for _ in range(random.randrange(9)))
    rows = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    empty = F.expr("cast(array() as array<string>)")
    chars = lambda t, c: F.when(F.col(t) == "", empty).otherwise(F.col(c))
    for k in (1, 2, 3):
        for r in df.withColumn("ok", line_dedup.within_edits(chars("a", "x"), chars("b", "y"), k)).collect():
            assert r["ok"] == (edit(r["a"], r["b"]) <= k), (r["a"], r["b"], k)


def test_line_dedup_equals_brute_force(spark):
    random.seed(9)
    base = ["".join(random.choice("abcdé ") for _ in range(random.choice([20, 21, 30, 41]))) for _ in range(12)]

    def change(s):
        i = random.randrange(len(s))
        return random.choice([s[:i] + s[i + 1 :], s[:i] + "Z" + s[i:], s[:i] + "Y" + s[i + 1 :]])

    lines = base + [change(random.choice(base)) for _ in range(60)] + [change(change(random.choice(base))) for _ in range(20)] + ["short", "shorf"]
    rows = [(i, "\n".join(random.choice(lines) for _ in range(6)) + "\n\n") for i in range(40)] + [(90, None), (91, "")]
    count, first = collections.Counter(), {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x:
                count[x] += 1
                first[x] = min(first.get(x, i), i)
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in count}
    links = {x: [y for y in count if x != y and min(len(x), len(y)) >= 20 and edit(x, y) <= 1] for x in count}
    want = {sha[x]: (len(x), count[x], first[x], len(links[x]), min((first[y], sha[y]) for y in [x, *links[x]])[1]) for x in count}
    got = {r["line_sha256"]: (r["n_chars"], r["n_rows"], r["first_doc_id"], r["n_links"], r["class_sha256"]) for r in line_dedup.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and any(v[3] for v in want.values())
    assert line_dedup.report(spark.createDataFrame([], DOCS)).count() == 0


def test_line_links_equal_brute_force(spark):
    from pyspark.sql import functions as F

    random.seed(10)
    lines = {"".join(random.choice("abé ") for _ in range(random.choice([9, 10, 19, 25, 33, 64]))) for _ in range(12)}
    for s in sorted(lines) * 12:
        for _ in range(random.randrange(1, 8)):
            i = random.randrange(len(s))
            s = random.choice([s[:i] + s[i + 1 :], s[:i] + "Z" + s[i:], s[:i] + "Y" + s[i + 1 :]])
        lines.add(s)
    lines |= {"the report was sent to the big office", "the report was sent to the city office"}
    lines = sorted(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.sha2("line", 256).alias("sha"))
    sha = {hashlib.sha256(x.encode()).hexdigest(): x for x in lines}
    pairs = [(a, b, min(len(a), len(b)), edit(a, b)) for a, b in itertools.combinations(lines, 2)]
    of = lambda found: {tuple(sorted((sha[r["sa"]], sha[r["sb"]]))) for r in found.collect()}
    want = {(a, b) for a, b, n, d in pairs if d <= min(6, n // 10)}
    assert of(line_dedup.links(df)) == want and ("the report was sent to the big office", "the report was sent to the city office") not in of(line_dedup.links(df, lambda m: F.lit(1), 1))
    assert of(line_dedup.links(df, lambda m: F.when(m >= 9, 3).otherwise(0), 3)) == {(a, b) for a, b, n, d in pairs if d <= 3 and n >= 9}


def test_lines_are_cut(spark):
    from pyspark.sql import functions as F

    a, b, c = (f"the long line that stands here number {x} and goes on" for x in ("xx", "xy", "yy"))  # a-b and b-c are one edit apart, a-c two
    rows = [(5, f"{c}\n\nown\n{a}"), (2, f"{a}\n{b}\nown"), (3, None), (4, ""), (None, "own\nlast"), (None, "own\nlast"), (2, "more\nmore"), (1, "x\n" + c)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit("l"))
    one = lambda m: F.when(m >= 20, 1).otherwise(0)
    got = line_dedup.deduplicate(docs, limit=one, most=1)
    assert got.columns == docs.columns
    want = [(1, "x\n" + c), (2, "more"), (2, "own"), (3, None), (4, ""), (5, ""), (None, "last"), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    places = line_dedup.members(docs, limit=one, most=1).collect()
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b, c)}
    assert len(places) == 14 and {r["class_sha256"] for r in places if r["line_sha256"] in sha.values()} == {min(sha.values())}
    assert sorted((r["doc_id"], r["at"]) for r in places if r["kept"] and r["doc_id"]) == [(1, 0), (1, 1), (2, 0), (2, 2)]
    assert line_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.tokenizer_of(bpe.read_vocabulary(path))
    random.seed(8)
    texts = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "Hello  world!\n\n it's 123 ½ été 日本 😀", "aaaaaaaaaaaa " * 5]
    texts += ["".join(random.choice("aeinrst '\n1é.") for _ in range(random.randrange(40))) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t
    got = bpe.report(odd(spark), path).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(own.encode(t or "")) for _, t in ODD)
    back = bpe.decode(bpe.encode(odd(spark), path), path).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in ODD)
    assert bpe.report(spark.createDataFrame([], DOCS), path).count() == 0


def test_bpe_long_words_equal_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.tokenizer_of(bpe.read_vocabulary(path))
    random.seed(12)
    letters, han = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(5000))
    for t in (letters, "".join(random.choices("ACGT", k=3000)), han, "a" * 5000):
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids and own.decode(own.encode(t)) == t


def labelled(spark, n, word, kind):
    random.seed(12)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = [f"{random.choice('bcdf')}{random.choice('aeiou')}{random.choice('lmnr')}" for _ in range(40)]
        if bad:
            for _ in range(6):
                w[random.randrange(40)] = word + random.choice("aeiou") + random.choice("klm")
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels)


def test_toxicity_learns_stems(spark):
    docs, labels, truth = labelled(spark, 400, "grux", "toxic")
    got = toxicity.report(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < 300


def test_toxicity_and_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(3, 1, 1), (4, None, None), (None, 0, 0)], "doc_id long, toxic int, quality int")
    for labels in (none, one):
        for op in (toxicity, quality):
            got = op.report(odd(spark), labels).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
            assert op.report(spark.createDataFrame([], DOCS), labels).count() == 0


def test_quality_learns(spark):
    docs, labels, truth = labelled(spark, 500, "ZZ%%", "quality")
    held = [r for r in quality.report(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_trees_score_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality.N_STATISTICS))
    t = quality.fit(x, (x[:, 3] > 0.2).astype(float))

    def one(row):
        z = t.start
        for f, c, v in zip(t.feature, t.threshold, t.value):
            i = 0
            for _ in range(quality.DEPTH):
                i = 2 * i + 1 + int(f[i] >= 0 and row[f[i]] > c[i])
            z += v[i - len(f)]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(t.score(x), [one(r) for r in x])


def test_language_model(spark, monkeypatch):
    random.seed(4)
    texts = [" ".join(["the", "cat", "sat"] * random.randrange(1, 6) if i % 2 else ["le", "chat", "dort"] * random.randrange(1, 6)) for i in range(150)]
    rows = list(enumerate(texts)) + [(900, None), (901, "the UNSEEN word"), (902, "the UNSEEN word")]
    monkeypatch.setattr(recurrent_lm, "HEAD", 4)  # the other tokens go by the join
    got = {r["doc_id"]: r for r in recurrent_lm.report(spark.createDataFrame(rows, DOCS)).collect()}
    count: collections.Counter = collections.Counter()
    split = {i: recurrent_lm.tokens(t) for i, t in rows}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    total, distinct = sum(count.values()), len(count)
    for i, w in split.items():
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), total)
        assert got[i]["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert recurrent_lm.report(spark.createDataFrame([], DOCS)).count() == 0


def test_network_trains_on_all_documents(spark):
    texts = ["one two three " * (i % 7) for i in range(120)]
    words = collections.Counter(w for t in texts for w in recurrent_lm.tokens(t))
    mass = np.full(recurrent_lm.SPELLED, 0.5)
    for w, n in words.items():
        mass[recurrent_lm.spelled(w)] += n + 0.5
    lex = recurrent_lm.Lexicon(list(words), np.array(list(words.values()), float), sum(words.values()), len(words), mass)
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    one, two = (recurrent_lm.train_network(docs.repartition(n), lex, warm_tokens=100, shard_tokens=200) for n in (1, 7))
    assert one.seen == two.seen == sum(words.values())
    assert all(np.allclose(one.p[n], two.p[n], atol=1e-6) for n in one.p)  # whatever the partitioning


def test_network_gradients_and_windows():
    lex = recurrent_lm.Lexicon([b"a", b"b"], np.array([5.0, 3.0]), 8, 2, np.full(recurrent_lm.SPELLED, 0.5))
    net = recurrent_lm.Network.fresh(lex)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1050, n) for n in (1, 31, 32, 33, 100)]
    whole = net.score(docs)
    for d, s in zip(docs, whole):  # one document, one step at a time
        h, total, x = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0, recurrent_lm.INPUTS - 1
        for y in d:
            hs, h, _ = net.walk(np.array([[x]]), h)
            total += float(net.outputs(hs[0], np.array([y]))[0][0])
            x = y
        assert math.isclose(s, total, rel_tol=1e-4)
    every = np.arange(recurrent_lm.OWN + recurrent_lm.SPELLED)
    h = np.tile(rng.normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32), (len(every), 1))
    assert math.isclose(float(np.exp(net.outputs(h, every)[0]).sum()), 1, rel_tol=1e-4)


def test_network_steps_are_as_plain_numbers_give():
    """Steps by gate against float64 arithmetic, with resets; scores of weights whose logits leave float32's exponentials."""
    lex = recurrent_lm.Lexicon([b"a", b"b"], np.array([5.0, 3.0]), 8, 2, np.full(recurrent_lm.SPELLED, 0.5))
    net, rng = recurrent_lm.Network.fresh(lex), np.random.default_rng(3)
    n, x = recurrent_lm.HIDDEN, rng.integers(0, recurrent_lm.INPUTS, (40, 9))
    reset = (rng.random(x.shape) < 0.1).astype(np.float32)
    p, h, states = {k: v.astype(float) for k, v in net.p.items()}, np.zeros((9, n)), []
    for t in range(len(x)):
        h = h * (1 - reset[t])[:, None]
        a, g = p["x"][x[t]] + p["b"], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(a[:, i : i + n] + g[:, i : i + n]))) for i in (0, n))
        new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        h = new + z * (h - new)
        states.append(h)
    table, u = net.gates()
    assert table.flags.c_contiguous and u.flags.c_contiguous and table.dtype == u.dtype == np.float32
    assert np.allclose(net.walk(x, np.zeros((9, n), np.float32), reset)[0], states, atol=1e-5)
    plain = net.run(table, u, x, np.zeros((9, n), np.float32))
    assert np.allclose(plain[0], net.walk(x, np.zeros((9, n), np.float32))[0], atol=1e-6) and np.array_equal(plain[1], plain[0][-1])
    unit, at = rng.integers(0, recurrent_lm.OWN + recurrent_lm.SPELLED, 9), np.array(states[-1], np.float32)
    for scale in (1, 200):
        net.p["c"] = (p["c"] * scale).astype(np.float32)
        one, two = net.log_probabilities(at, unit), net.outputs(at, unit)[0]
        assert np.isfinite(one).all() and (scale > 1 or np.allclose(one, two, atol=1e-5))
        if scale == 1:
            by_class = {k: sum(math.exp(v) for v in row @ p["c"] + p["cb"]) for k, row in enumerate(at.astype(float))}
            spelled = [i for i, v in enumerate(unit) if v >= recurrent_lm.OWN]
            for i in spelled:
                k = unit[i] - recurrent_lm.OWN + recurrent_lm.OWN // recurrent_lm.GROUP
                assert math.isclose(one[i], float(at[i].astype(float) @ p["c"][:, k] + p["cb"][k]) - math.log(by_class[i]), abs_tol=1e-4)


def test_tokens_of_whole_batches():
    """Codes of a batch against tokens one by one; texts with white space at the edges, control bytes, other scripts, none."""
    pa = pytest.importorskip("pyarrow")
    texts = ["a B  c\x0b\x0c\n", "", " \t ", None, "\x1ca\x85b \xa0 \u00c4A \u2003", "zz zz q", "\r\nB a", "x" * 70_000 + " " + "\U0001f600 b"]
    words = [recurrent_lm.tokens(t) for t in texts]
    for head in ([b"a", b" ", b"b", b"zz"], [b"a", b"b"], []):
        lex = recurrent_lm.Lexicon(head, np.arange(len(head), 0, -1.0), 20, 9, np.full(recurrent_lm.SPELLED, 0.5))
        for part in (slice(None), slice(2, 7), slice(1, 2)):
            column = pa.array([None] + texts + ["b"])[1:-1][part]  # a slice of an Arrow column
            code, sizes, rows, beyond = lex.codes(column)
            want = [head.index(w) if w in head else -1 - recurrent_lm.spelled(w) for t in words[part] for w in t]
            assert code.tolist() == want and sizes.tolist() == [len(t) for t in words[part]]
            assert sorted(zip(rows.tolist(), beyond.to_pylist())) == sorted((i, w) for i, t in enumerate(words[part]) for w in t if w not in head)
            assert lex.units(code).tolist() == [c if c >= 0 else recurrent_lm.OWN - 1 - c for c in want]
    batch = pa.record_batch([pa.array(["ab", None, "x" * 50, "c", "d" * 9])], ["t"])
    cut = [[r["t"] for r in b.to_pylist()] for b in recurrent_lm.portions(iter([batch, batch.slice(0, 0)]), 0)]
    assert cut == [["ab", None, "x" * 50, "c", "d" * 9]]


def test_scoring_keeps_its_rows_full(monkeypatch):
    """Documents of uneven lengths share lanes: not many more steps than tokens for all lanes, and each score as if alone."""
    rng = np.random.default_rng(5)
    lex = recurrent_lm.Lexicon([b"a", b"b"], np.array([5.0, 3.0]), 8, 2, np.full(recurrent_lm.SPELLED, 0.5))
    net, steps, run = recurrent_lm.Network.fresh(lex), [], recurrent_lm.Network.run
    monkeypatch.setattr(recurrent_lm, "BATCH", 16)
    docs = [rng.integers(0, 1050, n) for n in [400, 0] + [5, 130, 1, 64] * 40]
    alone = [net.score([d])[0] for d in docs]
    monkeypatch.setattr(recurrent_lm.Network, "run", lambda self, table, u, x, *more: steps.append(len(x)) or run(self, table, u, x, *more))
    assert np.allclose(net.score(docs), alone, rtol=1e-5)
    assert sum(steps) <= 1.2 * sum(map(len, docs)) / 16
    assert net.score([]).shape == (0,) and net.score([docs[1]]).tolist() == [0]



def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav>menu</nav><div class="cookie-notice">ok</div><article>'
        "<h1>Title &amp; x</h1><p>One&nbsp;two<br>three<p>Four <b>five</b></p><div class='ad'>buy</div><section id=comments><p>nice</p></section></article>"
        "<aside>s</aside><form>f</form><footer>&copy; end</footer></body></html>"
    )
    plain = lambda s: f"<body><ul><li>Home of the big site here</li><li>All about us and more</li></ul><p>{s}</p><p>All rights reserved by the big site</p></body>"
    rows = [(1, "http://a.example/1", page), (2, "http://b.example/1", plain("Some text of page two")), (3, "http://b.example/2", plain("Other words on page three")), (4, None, None), (5, "x", ""), (6, "http://a.example/2", page), (6, "http://a.example/2", page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[6] == "Title & x\n\nOne two three\n\nFour five"
    assert (by[2], by[3], by[4], by[5]) == ("Some text of page two", "Other words on page three", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_by_page_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 80))
        symbols, page = rng.integers(0, 3, n), np.sort(rng.integers(0, 4, n))
        symbols = np.where(np.diff(page, append=-1) != 0, -1 - np.arange(n), symbols)  # each page ends in its own symbol
        seen = collections.defaultdict(set)
        for i in range(n - 3):
            if page[i] == page[i + 3]:
                seen[tuple(symbols[i : i + 4])].add(page[i])
        start, pages = html_extract.runs_by_page(symbols, page, 4)
        assert {tuple(symbols[i : i + 4]): k for i, k in zip(start.tolist(), pages.tolist())} == {x: len(v) for x, v in seen.items()}


def words_like(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgklmn')}{r.choice('aeiou')}{r.choice('rstvz')}{r.randrange(1000)}" for _ in range(n))


def site(n, host="big.example", template=30, article=False):
    """Pages of one host with a template before and behind a text of their own, and every tenth page twice."""
    top, end = words_like(template, 1), words_like(9, 2)
    body = (lambda t: f"<article><p>{t}</p><p>{end}</p></article>") if article else (lambda t: f"<div>{top}</div><p>{t}</p><div>{end}</div>")
    rows = [(i, f"http://{host}/{i}", body(words_like(40, 1000 + i))) for i in range(n)]
    return rows + [(n + i, u, h) for i, u, h in rows[::10]]


def texts_of(spark, rows, **more):
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), **more).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"] for r in got}


def test_html_host_is_compared_as_a_whole(spark, monkeypatch):
    rows = site(401) + [(9000, "http://one.example/", "<p>" + words_like(30, 7) + "</p>")]
    want = {i: re.search("<p>(.*)</p>", h)[1] for i, _, h in rows}
    assert texts_of(spark, rows) == want
    whole = texts_of(spark, rows, cover=False)
    assert sum(whole[i] != want[i] for i in want) == len(rows) - 1  # what covering removes
    monkeypatch.setattr(html_extract, "PORTION", 40_000)  # several portions a host
    assert texts_of(spark, rows) == want
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", 0)  # runs come with the rows
    assert texts_of(spark, rows) == want


def test_html_rare_runs_over_portions_equal_brute_force(spark, monkeypatch):
    """A run on exactly one in TEMPLATE of a host's pages goes, one on a page less stays, however the host is split."""
    n = 120
    least = html_extract.least_pages(n)
    some, few = words_like(12, 31), words_like(12, 32)
    rows = [(i, f"http://h.example/{i}", f"<p>{words_like(25, 50 + i)}</p>" + (f"<p>{some}</p>" if i % 20 == 0 else "") + (f"<p>{few}</p>" if i % 24 == 1 else "")) for i in range(n)]
    assert sum(some in h for _, _, h in rows) == least == 6 and sum(few in h for _, _, h in rows) == least - 1
    want = {i: "\n\n".join(x for x in re.findall("<p>(.*?)</p>", h) if x != some) for i, _, h in rows}
    assert texts_of(spark, rows) == want
    monkeypatch.setattr(html_extract, "PORTION", 5_000)
    assert texts_of(spark, rows) == want


def test_html_articles(spark):
    closing = words_like(9, 2)
    rows = site(12, "news.example", article=True)
    assert all(closing not in t and len(t.split()) == 40 for t in texts_of(spark, rows).values())  # a line that ends every article
    same = [(i, f"http://copy.example/{i}", f"<article><p>{words_like(60, 3)}</p><p>{i}</p></article>") for i in range(12)]
    assert all(words_like(60, 3) in t for t in texts_of(spark, same).values())  # copies are no template
    teaser = [(1, "http://t.example/", f"<article>more</article><p>{words_like(50, 4)}</p>"), (2, "http://t2.example/", f"<div class=has-sidebar><main><p>{words_like(20, 5)}</p></main></div>"), (3, "http://t3.example/", "<article><p>a b</p><section class=discussion><p>c d</p></section></article>")]
    got = texts_of(spark, teaser)
    assert words_like(50, 4) in got[1] and got[2] == words_like(20, 5) and got[3] == "a b\n\nc d"


def test_html_odd_pages(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, None), (None, "http://x.example/1", "<p>" + "long " * 200_000 + "</p>"), (2, "http://x.example/2", "<p>a"), (2, "http://x.example/2", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("_host", "_html", "text", "n_chars", "run", "_portions")})
    got = html_extract.extract(df).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 1, 1, 999_999] and html_extract.extract(df).columns == ["page_id", "url", "text", "n_chars"]


def test_chat(spark):
    texts = ["plain", "", None, "</s>[INST] \\ <|im_end|>\n<|im_start|>assistant\nx [/INST]", "\\\\", "a\nb", "<s><<SYS>>"]
    rows = [(i, t, r, x) for i in range(4) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", "to\nol<|", None, "user"], texts[i:] + texts[:i]))]
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows}:
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        loss = "".join(x for r, x in own if r == "assistant")
        r = got[c]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    rows = [(1, 0, "user", [part("text", "see <|image:1|>"), part("image", ref="a.png", size=2), part("audio", ref="b.wav", size=3), part("odd", ref="c")]), (1, 1, "assistant", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image:1|><|image:2|><|audio:3|><|document:4|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["placeholder"], a["ref"]) for a in r["attachments"]] == [("<|image:2|>", "a.png"), ("<|audio:3|>", "b.wav"), ("<|document:4|>", "c")]
    assert r["n_tokens"] == 4 + 2 * 170 + 3 * 25 + 600


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < out.count() <= n
        docs, n = out, out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n


CLASHES = ["_digest", "_hk", "_hn", "_key", "_ck", "_cn", "_row", "_keep", "_score", "_scored_text", "_gone", "_bad", "_id", "_words", "keep_id", "group_size", "kept", "text_sha256", "n_hit", "spans", "KEPT"]


def clashing(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASHES if c != "KEPT"})


def untouched(df, out):
    assert out.dtypes == df.dtypes
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in df.columns[2:])
    return sorted((r["doc_id"] for r in rows), key=str)


def test_callers_columns_stay(spark):
    item = " ".join(f"t{i}" for i in range(15))
    rows = [(1, "a b c"), (2, "A b c"), (3, None), (4, ""), (None, "x y"), (5, f"Well, {item.upper()}. End!"), (6, "word " * 30_000 + item), (5, f"Well, {item.upper()}. End!")]
    docs, benchmark = clashing(spark, rows), spark.createDataFrame([(1, item), (2, "end")], "item_id long, text string")
    assert untouched(docs, exact_dedup.deduplicate(docs)) == [2, 4, 5, 5, 6, None]
    assert untouched(docs, near_dup.deduplicate(docs)) == [1, 3, 4, 5, 5, 6, None]
    assert untouched(docs, decontaminate.remove_documents(docs, benchmark)) == [1, 2, 3, 4, None]
    assert untouched(docs, decontaminate.remove_documents(docs, benchmark, per_hit=20)) == [1, 2, 3, 4, 6, None]
    cut = decontaminate.remove_spans(docs, benchmark)
    assert untouched(docs, cut) == [1, 2, 3, 4, 5, 5, 6, None]
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[5] == "Well, !" and {r["doc_id"]: r["text"] for r in cut.collect()}[1] == "a b c"
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert untouched(docs, toxicity.reject(docs, labels, threshold=2.0)) == [1, 2, 3, 4, 5, 5, 6, None]


def test_toxicity_likelihoods_equal_brute_force():
    """Interpolated Kneser-Ney estimates, byte by byte, from plain dictionaries; also with counts beyond 16 bits."""
    vocabulary = ([b"good", b"goods", b"fine"], [b"bad", b"badly", b"good"])
    n = (np.array([70_000, 3, 5]), np.array([4, 1, 90_000]))
    counts = toxicity.Counts()
    for c in (0, 1):
        counts.add(c, vocabulary[c], n[c])
    model = toxicity.Model(counts)
    raw = [collections.Counter(), collections.Counter()]  # (context, byte) of each class
    left = collections.defaultdict(set)
    for c in (0, 1):
        for w, k in zip(vocabulary[c], n[c].tolist()):
            s = b"\n" + w + b"\n"
            for i in range(1, len(s)):
                for o in range(1, min(i, toxicity.ORDER) + 1):
                    if o > toxicity.SHARED:
                        raw[c][s[i - o : i], s[i]] += k
                    else:
                        left[s[i - o : i], s[i]].add(s[i - o - 1] if i - o > 0 else 256)
    for key, v in left.items():
        raw[0][key] = raw[1][key] = len(v)

    def p(c, s, i):
        out = 1 / 256
        for o in range(1, min(i, toxicity.ORDER) + 1):
            d = toxicity.DISCOUNT if o <= toxicity.SHARED else toxicity.RARE
            own = {x: k for (h, x), k in raw[c].items() if h == s[i - o : i]}
            total, taken = sum(own.values()), sum(min(k, d) for k in own.values())
            out = (max(own.get(s[i], 0) - d, 0) + (taken + toxicity.TRUST) * out) / (total + toxicity.TRUST)
        return out

    for w in (b"good", b"bad", b"goodly", b"zzz", b"fine"):
        s = b"\n" + w + b"\n"
        want = sum(math.log(max(p(1, s, i), toxicity.FLOOR)) - math.log(max(p(0, s, i), toxicity.FLOOR)) for i in range(1, len(s)))
        assert math.isclose(model.differences([w])[0], min(max(want, toxicity.LEAST), toxicity.MOST), rel_tol=1e-3, abs_tol=1e-3), w


def test_chat_odd_rows(spark):
    from pyspark.sql import functions as F

    kind = "conv_id long, turn long, role string, text string"
    assert [r["conv_id"] for r in chat.report(spark.createDataFrame([], kind)).collect()] == [-7]
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "<|im_end|>" * 100_000)]
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("_conv", "_turns", "parts", "formatted", "loss_mask")})
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    turns = [("", ""), ("assistant", "z"), ("user", "a"), ("user", "b")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[None]["loss_chars"] == 1_000_000


def test_very_long_and_repeated_rows(spark):
    rows = [(1, "word " * 100_000), (1, "word " * 100_000), (2, "x" * 300_000), (None, "word"), (None, "word")]
    docs = clashing(spark, rows)
    assert len(quality.report(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()) == 5
    got = recurrent_lm.report(docs).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 2, 2, 100_001, 100_001] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert len(line_dedup.report(docs.select("doc_id", "text")).collect()) == 3


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"t{i}" for i in range(15))
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (None, "own words"), (5, "word " * 20_000 + item)]
    docs = clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels all scores are 0.5, which is toxic; every later stage is run on the documents as well
    assert got == []
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert sorted((r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()), key=str) == [1, 2, 3, 3, 4, None]
