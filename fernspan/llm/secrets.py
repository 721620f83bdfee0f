"""Secret scans: base patterns, and a character convolutional network over every other candidate with its context.

Base findings are the leftmost, non-overlapping matches of three patterns.  A candidate is any run of at least
``MIN_CANDIDATE`` characters of ``[A-Za-z0-9+/_=.-]``, or what base findings leave of it.  The network (numpy) reads ``INSIDE`` characters
of the candidate at a time, every half of that, and ``CONTEXT`` characters on either side, as character classes: embedding,
convolution of width ``WIDTH``, ReLU, the maximum over the inside and the maximum over its context, and a logistic output; a
candidate's score is the largest of its windows'.  It is trained on labelled findings: windows of candidates within base
findings are positive, the others are not.  Distinct windows of held-out documents (a third, by hash of the text; windows
that other documents have too are not held out) calibrate the output (Platt) and set the threshold: the largest at which
``RECALL`` of the held-out positives is still found.  Candidates above it become spans of kind ``cnn``; base findings always stay.

The network is fitted on every distinct window of the labelled findings of all documents: windows are dealt by hash to parts of about
``PART_ROWS``, in every round each part goes on from the common parameters with its own windows, and the parts' parameters are
averaged.  Each batch has both classes, the rarer one's windows in turn; where they are few they are dealt to several parts.  Curve and
threshold come from the scores of every held-out window.  One pass over the texts finds the windows, one scans.
Everything reads every text whole, in whatever length.  Positions are code points, ends exclusive.

Defined results: null text is empty: no findings (digest of the empty string, empty spans); rows that repeat a doc_id or have
none are scanned one by one; other columns are not looked at; without examples of both classes there is no network and only
base findings are reported; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.operators.selection import order_statistics
from fernspan.session import Kept, keep, lean, ship, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
#: A cheap test before the first pattern: one of its keywords, then a mark.
_HINT = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)

MIN_CANDIDATE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CANDIDATE)
CONTEXT = 24
INSIDE = 48
LENGTH = INSIDE + 2 * CONTEXT
RECALL = 0.98
#: Distinct windows of a part, about, and those of the rarer class that it should have.
PART_ROWS, PART_RARE = 20_000, 256
ROUNDS = 2
#: Windows of the commoner class in a batch, least of the rarer one, and batches of a part in a round, at least.
BATCH, RARE, LEAST_BATCHES = 64, 16, 125
FILTERS, WIDTH, EMBED, ALPHABET = 16, 5, 8, 100
#: Newton steps of the curve at most.
STEPS = 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start, then kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of every run that lie outside base findings and are long enough."""
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(base) and base[i][2] <= at:
            i += 1
        for s, _, e in base[i:]:
            if s >= end:
                break
            if s - at >= MIN_CANDIDATE:
                out.append((at, s))
            at = max(at, e)
        if end - at >= MIN_CANDIDATE:
            out.append((at, end))
    return out


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """What of a candidate the network reads at a time: all of it, in steps of half a window."""
    if b - a <= INSIDE:
        return [(a, b)]
    return [(x, x + INSIDE) for x in [*range(a, b - INSIDE, INSIDE // 2), b - INSIDE]]


def window(text: str, a: int, b: int) -> np.ndarray:
    """Character classes of up to INSIDE characters between their contexts: 0 nothing, 1 to 95 ASCII, 96 to 99 others."""
    left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    out = np.zeros(LENGTH, np.uint8)
    for at, s in ((CONTEXT - len(left), left), (CONTEXT, text[a:b]), (CONTEXT + INSIDE, right)):
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        out[at : at + len(c)] = np.where((c >= 32) & (c < 127), c - 31, np.where(c == 10, 96, np.where(c < 32, 97, np.where(c < 0x250, 98, 99))))
    return out


class Network:
    """Embedding, convolution, two maxima, logistic output; its parameters are a few thousand numbers."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (ALPHABET, EMBED)),
            "w": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
            "b": np.zeros(FILTERS),
            "v": r.normal(0, 0.3, 2 * FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, x: np.ndarray):
        # the convolution of embeddings is a sum of one table's rows for each place of the filter
        tables = np.matmul(self.p["e"][None], self.p["w"].reshape(WIDTH, EMBED, FILTERS)).astype(np.float32)
        n = LENGTH - WIDTH + 1
        h = tables[0][x[:, :n]]
        for k in range(1, WIDTH):
            h += tables[k][x[:, k : k + n]]
        h += self.p["b"].astype(np.float32)
        np.maximum(h, 0, out=h)
        lo, hi = CONTEXT - WIDTH // 2, CONTEXT + INSIDE - WIDTH // 2
        inside = h[:, lo:hi]
        outside = np.concatenate([h[:, :lo], h[:, hi:]], 1)
        i, o = inside.argmax(1), outside.argmax(1)
        pooled = np.concatenate([np.take_along_axis(inside, i[:, None], 1)[:, 0], np.take_along_axis(outside, o[:, None], 1)[:, 0]], 1).astype(np.float64)
        return pooled, np.concatenate([i + lo, np.where(o < lo, o, o + hi - lo)], 1), pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 128])[2] for i in range(0, len(x), 128)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._curve(self.logits(x))

    def _curve(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on the logistic loss, the classes weighing the same in every batch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in _batches(y, r):
                share = np.array([max(1, (y[at] == 0).sum()), max(1, (y[at] == 1).sum())])
                weight = 0.5 * len(at) / share[y[at]]
                pooled, where, z = self._forward(x[at])
                dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                g = {"v": pooled.T @ dz, "c": dz.sum(keepdims=True)}
                dh = dz[:, None] * self.p["v"] * (pooled > 0)  # n, 2 * FILTERS: reaches the positions of the maxima only
                dw, db, de = np.zeros_like(self.p["w"]), np.zeros(FILTERS), np.zeros_like(self.p["e"])
                rows = np.arange(len(at))[:, None]
                picked = self.p["e"][x[at][rows[..., None], where[..., None] + np.arange(WIDTH)]].reshape(len(at), 2 * FILTERS, WIDTH * EMBED)
                for half in (slice(0, FILTERS), slice(FILTERS, 2 * FILTERS)):
                    dw += np.einsum("nfd,nf->df", picked[:, half], dh[:, half])
                    db += dh[:, half].sum(0)
                    back = dh[:, half, None] * self.p["w"].T[None]  # n, FILTERS, WIDTH * EMBED
                    chars = x[at][rows[..., None], where[:, half, None] + np.arange(WIDTH)]
                    back, chars = back.reshape(-1, EMBED), chars.ravel()
                    de += np.stack([np.bincount(chars, back[:, j], ALPHABET) for j in range(EMBED)], 1)
                g |= {"w": dw, "b": db, "e": de}
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)

        def sums(a: float, b: float) -> tuple[float, ...]:
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            d, h = p - y, p * (1 - p) + 1e-6
            return (d * z).mean(), d.mean(), (h * z * z).mean(), (h * z).mean(), h.mean()

        good = np.sort(z[y == 1])
        self.settle(sums, float(good[int((1 - RECALL) * len(good))]) if len(good) else None)

    def settle(self, sums: Callable[[float, float], tuple[float, ...]], lowest: float | None) -> None:
        """Scale and shift by Newton steps on means over the held-out windows; the threshold is the probability of a logit."""
        w = np.array([1.0, 0.0])
        for _ in range(STEPS):
            dz, d, hzz, hz, h = sums(float(w[0]), float(w[1]))
            step = np.linalg.solve(np.array([[hzz + 1e-3, hz], [hz, h]]), np.array([dz + 1e-3 * (w[0] - 1), d]))
            w = w - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-7:
                break
        self.scale, self.shift = float(max(w[0], 1e-3)), float(w[1])
        self.threshold = 1.0 if lowest is None else float(self._curve(np.array([lowest]))[0])

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size


def _batches(y: np.ndarray, r: np.random.Generator) -> Iterator[np.ndarray]:
    """All windows in batches: those of the commoner class once, those of the rarer one in turn, each at least once."""
    many, few = sorted((np.flatnonzero(y == 1), np.flatnonzero(y == 0)), key=len, reverse=True)
    many, few = r.permutation(many), r.permutation(few)
    parts = np.array_split(many, max(1, -(-len(many) // BATCH)))
    each = max(RARE, -(-len(few) // len(parts)))
    for i, part in enumerate(parts):
        yield np.concatenate([part, few[np.arange(i * each, (i + 1) * each) % len(few)]]) if len(few) else part


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of labelled candidates: (x, y, held): y is 1 within base findings; held for the documents that are held out."""
    for b in batches:
        x, y, held = [], [], []
        for text, aside in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text:
                continue
            base = base_spans(text)
            parts = [(1, m.start(), m.end()) for s, _, e in base for m in CANDIDATE.finditer(text, s, e)]
            for label, a, z in [*parts, *((0, *c) for c in candidates(text, base))]:
                for u, v in pieces(a, z):
                    x.append(window(text, u, v).tobytes())
                    y.append(label)
                    held.append(aside)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32()), pa.array(held, pa.int32())], names=["x", "y", "held"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, LENGTH), b.column(1).to_numpy()) for b in batches if b.num_rows]
    return (np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])) if held else (np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int32))


def _fit_part(net):
    """A part's own parameters after a round, and how many windows gave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = _arrays(batches)
        if len(x):
            own = Network()
            own.take(net.value)
            most = max((y == 1).sum(), (y == 0).sum())
            own.fit(x, y, epochs=max(1, -(-LEAST_BATCHES * BATCH // int(most))))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([own.flat()], pa.list_(pa.float64()))], names=["n", "p"])

    return run


def _fit_parts(rows: DataFrame, sizes: dict[int, int]) -> Network:
    """Rounds of parts that go on from the average of all. rows: x, y."""
    sc, rare = rows.sparkSession.sparkContext, min(sizes, key=sizes.get)
    parts = -(-sum(sizes.values()) // PART_ROWS)
    copies = min(parts, -(-PART_RARE * parts // sizes[rare]))
    mine = F.pmod(F.xxhash64("x", F.lit(11)), F.lit(parts))
    several = F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0))
    dealt = rows.select("x", "y", F.explode(several).alias("i")).select("x", "y", F.pmod(mine + F.col("i"), F.lit(parts)).alias("part"))
    net = Network()
    for _ in range(ROUNDS):
        shared = sc.broadcast(net.flat())
        # parts meet in one task now and then, which is then one part; their order there is told
        own = dealt.repartition(parts, "part").sortWithinPartitions(F.xxhash64("x"), "x").select("x", "y").mapInArrow(lean(_fit_part(shared)), "n long, p array<double>")
        own = keep(own, "secret_parts")
        total = own.agg(F.sum("n")).first()[0]
        # whole numbers, so that the order of the parts doesn't matter
        sums = own.select(F.posexplode("p").alias("at", "v"), "n").groupBy("at").agg(F.sum(F.round(F.col("v") * F.col("n") / total * 1e15).cast("decimal(20,0)")).cast("double").alias("v"))
        got = sums.orderBy("at").toArrow()
        net.take(got.column("v").to_numpy() / 1e15)
    return net


def _logits(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _arrays([b])
            yield pa.RecordBatch.from_arrays([pa.array(net.value.logits(x), pa.float64()), pa.array(y, pa.int32())], names=["z", "y"])

    return run


def train(docs: DataFrame) -> Network | None:
    """A network fitted on every distinct window of the labelled candidates of all documents; None without both classes."""
    aside = (F.pmod(F.xxhash64("text"), F.lit(3)) == 2).cast("int").alias("held")
    rows = docs.select("text", aside).mapInArrow(lean(_examples), "x binary, y int, held int")
    examples = Kept(rows.groupBy("y", "x").agg(F.min("held").alias("held")), "secret_examples")
    sizes = {(r["held"], r["y"]): r["n"] for r in examples.df.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    if any(sizes.get((side, k), 0) < 3 for side in (0, 1) for k in (0, 1)):
        return None
    net = _fit_parts(examples.df.filter("held = 0"), {k: sizes[0, k] for k in (0, 1)})
    shared = docs.sparkSession.sparkContext.broadcast(net)
    scores = Kept(examples.df.filter("held = 1").select("x", "y").mapInArrow(lean(_logits(shared)), "z double, y int"), "secret_scores")

    def sums(a: float, b: float) -> tuple[float, ...]:
        z = F.col("z")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * z + b))))
        d, h = p - F.col("y"), p * (1 - p) + 1e-6
        return tuple(scores.df.agg(F.avg(d * z), F.avg(d), F.avg(h * z * z), F.avg(h * z), F.avg(h)).first())

    good = scores.df.filter("y = 1").select(F.lit(0).alias("k"), F.col("z").alias("v"))
    ends = good.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = ends.select("k", F.lit(int((1 - RECALL) * sizes[1, 1])).cast("long").alias("rank"))
    net.settle(sums, order_statistics(good, wanted, ends).first()["v"])
    tidy(docs.sparkSession, examples, scores)
    return net


def _scan(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value if net is not None else None
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            base = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in s) for s in spans]
            counts = [[sum(k == kind for _, k, _ in s) for s in spans] for kind in range(3)]
            if model is not None:
                owner, x, best = [], [], {}

                def judge(owner=owner, x=x, best=best) -> None:
                    if x:
                        for c, p in zip(owner, model.probability(np.stack(x)), strict=True):
                            best[c] = max(best.get(c, 0.0), p)
                    owner.clear()
                    x.clear()

                for i, t in enumerate(texts):
                    for a, z in candidates(t, spans[i]):
                        for u, v in pieces(a, z):
                            owner.append((i, a, z))
                            x.append(window(t, u, v))
                            if len(x) >= 4096:
                                judge()
                judge()
                for (i, a, z), p in best.items():
                    if p >= model.threshold:
                        spans[i].append((a, 3, z))
            found = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(s)) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()), pa.array(found, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = train(docs)
    shared = spark.sparkContext.broadcast(net) if net is not None else None
    return docs.mapInArrow(lean(_scan(shared)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
