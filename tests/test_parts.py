"""Components on awkward graphs, image headers, held cases, explanations and verdicts."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fernspan.operators import components as C
from fernspan.operators import ml
from fernspan.plans import build
from fernspan.sources import loaders


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def path(order):
    return list(zip(order, order[1:], strict=False))


def shuffled(n, seed):
    x = list(range(n))
    random.Random(seed).shuffle(x)
    return x


def test_components_of_awkward_graphs(spark):
    """One graph of many parts, each with ids of its own: paths in every order, stars, a tree, a grid, loops."""
    parts = [path(list(range(1000))), path(list(range(1000))[::-1]), path(shuffled(1000, 1)), path(shuffled(2000, 2)), [(0, i) for i in range(1, 300)], [(300, i) for i in range(300)]]
    parts += [[(i, (i - 1) // 2) for i in range(1, 500)], [(20 * i + j, 20 * i + j + 1) for i in range(20) for j in range(19)] + [(20 * i + j, 20 * i + 20 + j) for i in range(19) for j in range(20)], [(5, 5), (7, 7), (7, 8), (8, 7)]]
    edges = [(a + 10_000 * k, b + 10_000 * k) for k, e in enumerate(parts) for a, b in e]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    assert {r["v"]: r["component"] for r in C.components(df).collect()} == union_find(edges)


def test_components_never_stop_early(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        C.components(spark.createDataFrame(path(shuffled(200, 3)), "src long, dst long"))


def test_image_headers(spark, tmp_path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 300, 200, 1) + b"\0" * 3
    (tmp_path / "NORMAL").mkdir()
    (tmp_path / "NORMAL" / "IM-0001.png").write_bytes(png)
    (tmp_path / "NORMAL" / "IM-0002.jpeg").write_bytes(jpeg)
    (tmp_path / "NORMAL" / "IM-0003.jpg").write_bytes(b"\xff\xd8")
    got = sorted(tuple(r) for r in loaders.load_images(spark, str(tmp_path)).select("file", "cls", "patient", "width", "height", "mode", "aspect").collect())
    assert got == [("IM-0001.png", "NORMAL", "IM-0001", 640, 480, "RGB", 1.33), ("IM-0002.jpeg", "NORMAL", "IM-0002", 200, 300, "L", 0.67), ("IM-0003.jpg", "NORMAL", "IM-0003", None, None, None, None)]


def test_explanations_find_the_word(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    r = random.Random(4)
    rows = []
    for i in range(120):
        bad = i % 2 == 0
        rows.append((i, " ".join(r.sample(words, 6) + (["jackpot"] if bad else ["lunch"])), "smishing" if bad else "ham"))
    classes = ["ham", "smishing"]
    d = ml.labelled(ml.prepared(spark.createDataFrame(rows, "id long, text string, y string")), classes)
    model = ml.ladder()["lr_word"].fit(d)
    many = " ".join(f"w{i}" for i in range(400))  # more words than draws, the telling one last
    messages = spark.createDataFrame([(1, "alpha beta jackpot gamma"), (2, f"{many} jackpot"), (3, "jackpot")], "id long, text string")
    got = {x["id"]: x["flags"] for x in ml.explained(model, messages, "id", classes, "smishing", draws=150).collect()}
    assert got[1][0] == "jackpot" and "jackpot" in got[2] and got[3] == ["jackpot"]
    p = {x["id"]: x for x in build.predict_batch(model, messages, classes, explain="id", draws=100).collect()}
    assert p[3]["predicted"] == "smishing" and p[3]["verdict"].startswith("⚠️ Likely scam (") and "Flagged on: 'jackpot'" in p[3]["verdict"]
    with pytest.raises(Exception, match="empty message"):
        build.predict_batch(model, messages.withColumn("text", F.lit("  ")), classes).collect()


def test_html_pages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(build, "PAGE_ROWS", 3)
    page = lambda n: build.html_table(spark.range(n).withColumn("x", F.lit("a<b")), ["id", "x"], [-F.col("id")], "T").collect()[0]["html"]
    assert page(3) == "<h1>T</h1><table><tr><th>id</th><th>x</th></tr>" + "".join(f"<tr><td>{i}</td><td>a&lt;b</td></tr>" for i in (2, 1, 0)) + "</table>"
    assert page(0) == "<h1>T</h1><table><tr><th>id</th><th>x</th></tr></table>"
    with pytest.raises(Exception, match="more than 3 rows"):
        page(4)
