"""Learning and similarity against brute force: explanations, cross-validation, blocks of sparse vectors."""

import collections
import math
import random
import time

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.operators import bayes, boosting, induction, linkage, ml, selection, sgd
from fernspan.operators import similarity as S
from fernspan.operators.components import components

CLASSES = ["ham", "smishing", "spam"]


def messages(n=90, seed=1):
    r = random.Random(seed)
    own = {"ham": ["lunch", "home", "later"], "smishing": ["verify", "account", "don't", "x-ray"], "spam": ["sale", "offer", "free"]}
    return [(i, " ".join(r.choice([*own[y], "the", "a", "Call", "now", "ünïcode", "re-do"]) for _ in range(r.randint(1, 25))), y) for i, y in enumerate(r.choice(CLASSES) for _ in range(n))]


def test_cells_are_those_of_hashing_tf(spark):
    terms = ["", "a", "ab", "abc", "abcd", "abcde", "ünï", "日本語", "x" * 37, "two words", "😀"]
    tf = HashingTF(inputCol="w", outputCol="h", numFeatures=ml.FEATURES)
    assert ml.cells([t.encode() for t in terms], ml.FEATURES).tolist() == [tf.indexOf(t) for t in terms]


def test_linear_explanations_equal_those_by_rows(spark):
    d = spark.createDataFrame(messages(), "id long, text string, y string")
    p = ml.labelled(ml.prepared(d), CLASSES)
    odd = spark.createDataFrame([(900, "verify"), (901, "!!! ... verify your account"), (902, None), (903, "a b c"), (904, "verify account verify account the the")], "id long, text string")
    some = d.filter("id < 20").select("id", "text").unionByName(odd)
    for name in ("lr_word",):
        model = ml.ladder()[name].fit(p)
        assert ml.LinearText.fits(model)
        fast, slow = ({r["id"]: r["flags"] for r in f(model, some, "id", CLASSES, "smishing", draws=120).collect()} for f in (ml.explained, ml.explained_by_rows))
        assert fast == slow and len(fast) == 24
    assert not ml.LinearText.fits(ml.ladder()["nb_counts"].fit(p))


def test_word_pairs_cost_grows_with_the_words(spark):
    def took(n):
        d = spark.createDataFrame([(i, " ".join(f"w{j % 997}" for j in range(n))) for i in range(8)], "id long, text string").repartition(1)
        best = 1e9
        for _ in range(3):
            began = time.time()
            ml.prepared(d, chars=False).select(F.sum(F.size("word_pairs")), F.sum(F.size(S.word_ngrams(F.col("text"), 1, 3)))).collect()
            best = min(best, time.time() - began)
        return best

    took(1000)
    assert took(16_000) <= 5 * took(4000) + 0.5
    (row,) = ml.prepared(spark.createDataFrame([("One two, three",)], "text string")).select("word_pairs", S.word_ngrams(F.col("text"), 1, 3).alias("g")).collect()
    assert row["word_pairs"] == ["one", "two", "three", "one two", "two three"] and row["g"] == [*row["word_pairs"], "one two three"]


def brute_bayes(rows, classes, alpha, least):
    """rows: (doc, fold, y, Counter of (kind, term))"""
    out = {}
    for doc, fold, _, own in rows:
        train = [x for x in rows if x[1] != fold]
        df = collections.Counter(t for x in train for t in x[3])
        vocabulary = {t for t, n in df.items() if n >= least.get(t[0], 1)}
        logs = []
        for c in classes:
            mine = [x for x in train if x[2] == c]
            counts = collections.Counter()
            for x in mine:
                counts.update({t: n for t, n in x[3].items() if t in vocabulary})
            z = sum(counts.values()) + alpha * len(vocabulary)
            logs.append(math.log(len(mine) / len(train)) + sum(n * math.log((counts[t] + alpha) / z) for t, n in own.items() if t in vocabulary) if mine else -math.inf)
        out[doc] = logs
    return out


def test_folds_from_one_table_of_counts(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(4), r.choice(CLASSES), collections.Counter((r.choice(["word", "pair"]), f"t{r.randrange(12)}") for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows.append((99, 1, "ham", collections.Counter()))
    d = spark.createDataFrame([(i, f, y, [(k, t) for (k, t), n in c.items() for _ in range(n)]) for i, f, y, c in rows], "doc long, fold int, y string, terms array<struct<kind string, term string>>")
    configs = ml.grid([0.5, 2.0], [1, 3], [2])
    got = bayes.out_of_fold(d.drop("terms"), bayes.counted(d, [], F.col("terms")), [], CLASSES, configs).collect()
    assert len(got) == len(rows) * len(configs)
    for k, c in enumerate(configs):
        want = brute_bayes(rows, CLASSES, c.alpha, c.least)
        for x in got:
            if x["config"] == k:
                assert np.allclose(x["logs"], want[x["doc"]]) and math.isclose(sum(x["proba"]), 1)
                assert x["pred"] == CLASSES[int(np.argmax(x["logs"]))]


def test_a_class_that_training_lacks_is_never_answered(spark):
    d = spark.createDataFrame([(1, 0, "ham", [("word", "a")]), (2, 1, "spam", [("word", "b")]), (3, 1, "ham", [("word", "a")])], "doc long, fold int, y string, terms array<struct<kind string, term string>>")
    got = {x["doc"]: x["pred"] for x in bayes.out_of_fold(d.drop("terms"), bayes.counted(d, [], F.col("terms")), [], CLASSES, [bayes.Config()]).collect()}
    assert got == {1: "ham", 2: "ham", 3: "ham"}


def vectors_of(spark, texts):
    d = spark.createDataFrame([*enumerate(texts)], "k long, text string")
    c = S.term_counts(d, "k", T.char_wb(F.col("text"), 3, 5))
    return S.tfidf(c, "k", S.idf_table(c, "k")).cache()


def test_blocks_equal_all_pairs(spark):
    r = random.Random(2)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(3, 40))) for _ in range(60)]
    texts += [" ".join(f"{w}x" if r.random() < 0.1 else w for w in texts[n % 7].split()) for n in range(60)]
    base = [word() for _ in range(30)]
    texts += [" ".join([*base[:n], f"q{n}", *base[n:]]) for n in range(30)]  # one large group of near copies
    texts += ["日本 語 テ キ ス ト"] * 2
    v = vectors_of(spark, texts)
    rows = collections.defaultdict(dict)
    for x in v.collect():
        rows[x["k"]][x["term"]] = x["w"]
    want = {(a, b): s for a in rows for b in rows if a < b and (s := sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items())) >= S.THRESHOLD}
    assert len(want) > 435
    for block, mass in ((7, 0.5), (16, 0.2), (512, 0.9)):
        links = S.blocked(v, "k", block=block, mass=mass)
        got = {(x["a"], x["b"]): x["cosine"] for x in links.filter("kind = 0").collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
        f = S.pruning(links).first()
        assert f["pairs"] == len(rows) * (len(rows) - 1) // 2 and f["scored"] >= len(want)
    forest = S.blocked(v, "k", block=16, forest=True).filter("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = spark.createDataFrame([*want], "src long, dst long")
    assert sorted(map(tuple, components(forest).collect())) == sorted(map(tuple, components(pairs).collect()))
    assert forest.count() < len(want)
    assert S.blocked(v.limit(0), "k").count() == 0


def test_blocks_of_other_kinds_are_skipped(spark):
    r = random.Random(4)
    kinds = [[a + b for a in "bdfg" for b in "ae"], [a + b for a in "klmn" for b in "iou"]]
    texts = [" ".join("".join(r.choice(k) for _ in range(3)) for _ in range(20)) for k in kinds for _ in range(64)]
    f = S.pruning(S.blocked(vectors_of(spark, texts), "k", block=16, mass=0.9)).first()
    assert f["skipped"] > 0 and f["left_over"] < f["pairs"]


def boosted_by_hand(x, y, k, cuts, start, rounds, depth, rate, ridge, least, bins):
    """Plain numpy, one row of a tree at a time; the same gain, the same order of ties."""
    b = boosting.binned(x, cuts)
    scores = np.tile(start, (len(x), 1))
    for _ in range(rounds):
        g, h = boosting.gradients(scores, y)
        add = np.zeros_like(scores)
        for c in range(k):
            todo = [(np.arange(len(x)), 0)]
            while todo:
                rows, level = todo.pop()
                gs, hs = sum(int(v) for v in g[rows, c]), sum(int(v) for v in h[rows, c])
                u = boosting.UNIT
                best = None
                if level < depth:
                    for j in range(x.shape[1]):
                        for cut in range(bins):
                            left = rows[b[rows, j] <= cut]
                            lg, lh = int(g[left, c].sum()), int(h[left, c].sum())
                            if lh / u < least or (hs - lh) / u < least:
                                continue
                            gain = (lg / u) ** 2 / (lh / u + ridge) + ((gs - lg) / u) ** 2 / ((hs - lh) / u + ridge) - (gs / u) ** 2 / (hs / u + ridge)
                            if gain > (best[0] + 1e-12 if best else 1e-9):
                                best = (gain, j, cut)
                if best is None:
                    add[rows, c] = rate * -(gs / u) / (hs / u + ridge)
                else:
                    side = b[rows, best[1]] <= best[2]
                    todo += [(rows[side], level + 1), (rows[~side], level + 1)]
        scores = scores + add
    return boosting.softmax(scores)


def test_boosting_equals_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 4)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + (x[:, 2] > 0.7)
    x[::17, 1] = np.nan
    rows = [(i, CLASSES[c], *(None if i % 50 == 3 and j == 3 else float(v) for j, v in enumerate(row))) for i, (c, row) in enumerate(zip(y, x, strict=True))]
    x[[i for i in range(500) if i % 50 == 3], 3] = np.nan
    d = spark.createDataFrame([*rows, (999, "none of them", 0.0, 0.0, 0.0, 0.0)], "id long, y string, a double, b double, c double, d double")
    how = dict(rounds=7, depth=3, rate=0.3, bins=16, ridge=1.0, least=1e-3)
    m = boosting.fit(d.repartition(5), ["a", "b", "c", "d"], "y", CLASSES, **how)
    again = boosting.fit(d.coalesce(1), ["a", "b", "c", "d"], "y", CLASSES, **how)
    assert m == again
    want = boosted_by_hand(x, y, 3, m.cuts, m.start, 7, 3, 0.3, 1.0, 1e-3, 16)
    got = {r["id"]: (r["proba"], r["pred"]) for r in boosting.scored(m, d, "id").collect()}
    assert len(got) == 501 and all(np.allclose(got[i][0], want[i], atol=1e-6) for i in range(500))
    assert np.mean([got[i][1] == CLASSES[c] for i, c in enumerate(y)]) > 0.9
    one = boosting.fit(d.filter("y = 'ham'"), ["a"], "y", CLASSES, rounds=2)
    assert {r["pred"] for r in boosting.scored(one, d, "id").collect()} == {"ham"}


def test_descent_equals_a_single_process(spark, monkeypatch):
    monkeypatch.setattr(sgd, "SHARD_ROWS", 40)
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        c = int(r.integers(3))
        cells = sorted({int(v) for v in r.integers(0, 20, 4)} | {20 + c})
        rows.append((i, CLASSES[c], (cells, [float(v) for v in r.random(len(cells))])))
    rows += [(900, "ham", ([], [])), (901, "other", ([1], [1.0])), (902, None, ([1], [1.0]))]
    d = spark.createDataFrame(rows, "id long, y string, f struct<indices array<int>, values array<double>>")
    m = sgd.fit(d.repartition(6), "id", "y", F.col("f"), 23, CLASSES, epochs=4, alpha=1e-3)
    same = sgd.fit(d.coalesce(1), "id", "y", F.col("f"), 23, CLASSES, epochs=4, alpha=1e-3)
    assert np.array_equal(m.weights, same.weights) and m.losses == same.losses
    # one process: the same shards and orders, weights averaged in plain doubles
    shards = collections.defaultdict(list)
    for x in d.filter("y in ('ham', 'smishing', 'spam')").withColumn("shard", F.expr("pmod(xxhash64(id, 1), 4)")).withColumn("h", F.array(*(F.xxhash64(F.col("id").cast("string"), F.lit(1), F.lit(e)) for e in range(4)))).collect():
        shards[x["shard"]].append((x["h"], str(x["id"]), CLASSES.index(x["y"]), np.array(x["f"]["indices"], int), np.array(x["f"]["values"])))
    w, b, losses = np.zeros((3, 23)), np.zeros(3), []
    for e in range(4):
        parts = []
        for own in shards.values():
            own = [(c, i, v) for _, _, c, i, v in sorted(own, key=lambda x: (x[0][e], x[1]))]
            parts.append((len(own) / 151, *sgd.shard_epoch(w, b, own, 1e-3, e * len(own), sgd.first_step(1e-3))))
        losses.append(sum(x[3] for x in parts) / 151)
        w, b = w + sum(x[0] * (x[1] - w) for x in parts), b + sum(x[0] * (x[2] - b) for x in parts)
    assert np.allclose(m.weights, w, atol=1e-6) and np.allclose(m.losses, losses, atol=1e-6) and losses[-1] < losses[0] / 2
    p = {x["id"]: x for x in sgd.scored(m, d, "id", F.col("f")).collect()}
    assert np.mean([p[i]["pred"] == y for i, y, _ in rows[:150]]) > 0.95 and all(abs(sum(x["proba"]) - 1) < 1e-9 for x in p.values())


def brute_rules(rows, columns, beam, longest, least, significance, most):
    """rows: dicts with __y; the same search over plain lists."""
    classes = sorted({r["__y"] for r in rows})
    count = lambda rs: tuple(sum(r["__y"] == c for r in rs) for c in classes)
    limit = induction.critical(len(classes) - 1, significance)
    left, out = rows, []
    while len(out) < most and sum(c > 0 for c in count(left)) > 1:
        before, found, tried = count(left), [], [()]
        for _ in range(longest):
            level = {}
            for t in tried:
                for c in columns:
                    for v in {r[c] for r in left if r[c] is not None} if c not in dict(t) else ():
                        new = tuple(sorted([*t, (c, v)]))
                        n = count([r for r in left if all(r[a] == x for a, x in new)])
                        if sum(n) >= least:
                            e = round(-sum(k / sum(n) * math.log2(k / sum(n)) for k in n if k), 9) + 0.0
                            lrs = 2 * sum(k * math.log((k / sum(n)) / (m / sum(before))) for k, m in zip(n, before, strict=True) if k)
                            level[new] = (e, -sum(n), len(new), new, lrs, n)
            ranked = sorted(level.values(), key=lambda x: x[:4])
            found += [x for x in ranked if x[4] >= limit][:1]
            tried = [x[3] for x in ranked[:beam]]
        if not found:
            break
        best = min(found, key=lambda x: x[:4])
        out.append((best[3], classes[max(range(len(classes)), key=lambda i: (best[5][i], -i))], best[5]))
        left = [r for r in left if not all(r[a] == v for a, v in best[3])]
    rest = count(left) if left else count(rows)
    return [*out, ((), classes[max(range(len(classes)), key=lambda i: (rest[i], -i))], count(left))]


def test_rules_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for _ in range(240):
        x = {"a": r.choice("pqr"), "b": r.choice(["u", "v", None]), "c": r.choice("klmn"), "d": r.choice("xy")}
        y = "good" if x["a"] == "p" and x["b"] == "u" else "bad" if x["c"] == "k" else r.choice(["good", "bad", "bad", "odd"])
        rows.append({**x, "__y": y})
    d = spark.createDataFrame([(*(x[c] for c in "abcd"), x["__y"]) for x in rows] + [("p", "u", "k", "x", None)], "a string, b string, c string, d string, y string")
    for how in ({"beam": 5, "longest": 3, "least": 2, "significance": 0.05}, {"beam": 2, "longest": 2, "least": 5, "significance": 0.01}):
        got = induction.induce(d, ["a", "b", "c", "d"], "y", most_rules=6, **how)
        assert [(x.conditions, x.answer, x.counts) for x in got] == brute_rules(rows, ["a", "b", "c", "d"], most=6, **how)
    assert got[0].conditions and got[-1].conditions == ()
    told = induction.applied(got, d).groupBy("rule").count().collect()
    assert {x["rule"]: x["count"] for x in told if x["rule"] < len(got)} == {i + 1: sum(x.counts) + (1 if i == next(j for j, g in enumerate(got) if all({"a": "p", "b": "u", "c": "k", "d": "x"}[k] == v for k, v in g.conditions)) else 0) for i, x in enumerate(got[:-1])}
    assert induction.induce(d.limit(0), ["a"], "y") == []
    assert abs(induction.critical(1, 0.05) - 3.841459) < 1e-5 and abs(induction.critical(2, 0.05) - 5.991465) < 1e-5 and abs(induction.critical(5, 0.01) - 15.08627) < 1e-4


def brute_linkage(points):
    """Single linkage the slow way: (height, first, second, size)."""
    clusters, out = {i: {i} for i in points}, []
    d = lambda a, b: math.dist(points[a], points[b])
    while len(clusters) > 1:
        h, _, _, x, y = min((*min((d(a, b), min(a, b), max(a, b)) for a in clusters[x] for b in clusters[y]), x, y) for x in clusters for y in clusters if x < y)
        clusters[x] |= clusters.pop(y)
        out.append((h, x, y, len(clusters[x])))
    return out


def test_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    monkeypatch.setattr(linkage, "ROWS", 3)
    r = random.Random(9)
    points = {i * 3: [float(r.randrange(6)), float(r.randrange(6))] for i in range(40)}  # many ties
    d = spark.createDataFrame([*points.items(), (None, [1.0, 1.0]), (500, None)], "id long, v array<double>").repartition(5)
    ids, tree = linkage.spanning_tree(d, "id", "v", "euclidean")
    want = brute_linkage(points)
    assert tree.count() == 39 and sorted(x["d"] for x in tree.collect()) == [h for h, *_ in want]
    got = [tuple(x) for x in linkage.merges(ids, tree).orderBy("step").collect()]
    assert [(h, x, y, n) for _, h, x, y, n in got] == want and [s for s, *_ in got] == [*range(1, 40)]
    assert [tuple(x)[1:] for x in linkage.merges(ids, tree, 5).orderBy("step").collect()] == want[-5:]
    for k in (1, 4, 40, 99):
        assert linkage.cut_into(ids, tree, k).select("component").distinct().count() == min(k, 40)
    at = linkage.cut_at(ids, tree, 1.0).select("component").distinct().count()
    assert at == 40 - sum(h <= 1.0 for h, *_ in want)
    assert linkage.spanning_tree(d.limit(0), "id", "v")[1].count() == 0 and linkage.spanning_tree(d.filter("id = 0"), "id", "v")[1].count() == 0


def test_quantiles_of_a_dominant_group(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    monkeypatch.setattr(selection, "BINS", 4)
    r = random.Random(10)
    rows = [("hot", r.choice([r.gauss(0, 1), 0.0, 1e300, -1e300, 1e-300, 7.0])) for _ in range(900)]
    rows += [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 7)) for v in range(n)] + [(None, 3.0), (None, 5.0), ("a", None), ("b", math.nan), ("none", None), ("same", 4.0), ("same", 4.0)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    q = selection.quantiles(d, F.col("k"), F.col("v"), shares)
    assert "percentile" not in q._jdf.queryExecution().toString().lower()
    got = {(x["k"], x["share"]): x["q"] for x in q.collect()}
    groups = collections.defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups[k].append(v)
    assert {k for k, _ in got} == groups.keys()
    for (k, p), x in got.items():
        s = sorted(groups[k])
        low = math.floor((len(s) - 1) * p)
        high = min(low + 1, len(s) - 1)
        assert x == s[low] + (s[high] - s[low]) * ((len(s) - 1) * p - low)
    assert selection.quantiles(d.limit(0), F.col("k"), F.col("v"), shares).count() == 0


def test_stripes_of_blocks(spark, monkeypatch):
    """However few blocks travel at a time, the links are those of all pairs, and no pair of blocks is met twice or left out."""
    r = random.Random(12)
    known = ["".join(r.choices("bdfgklmnaeiou", k=6)) for _ in range(300)]
    texts = [" ".join(r.choices(known, k=20)) for _ in range(60)]
    texts += [t.replace(t.split()[0], "else", 1) for t in texts[:30]]
    v = vectors_of(spark, texts)
    want = {(x["a"], x["b"]) for x in S.similar_pairs(v, "k").collect()}
    for size in (1, 20_000):
        monkeypatch.setattr(S, "STRIPE_BYTES", size)
        links = S.blocked(v, "k", block=16)
        got = [(x["a"], x["b"]) for x in links.filter("kind = 0").collect()]
        assert sorted(got) == sorted(want)
        assert S.pruning(links).first()["pairs"] == len(texts) * (len(texts) - 1) // 2
