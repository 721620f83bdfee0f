"""Queries: TF-IDF, near copies, clusters, splits, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.operators import linkage as L
from fernspan.operators import similarity as S
from fernspan.operators import split as P
from fernspan.operators import vectors as V
from fernspan.operators.components import components
from fernspan.session import keep, table


def word_tfidf(spark, sf):
    """Word 1-2-gram TF-IDF of the benchmark passages."""
    b = table(spark, sf, "benchmark")
    c = S.term_counts(b, "item_id", S.word_ngrams(F.col("text"), 1, 2))
    v = S.tfidf(c, "item_id", S.idf_table(c, "item_id"))
    return v.select("item_id", "term", F.round("w", 6).alias("w"))


def word_tfidf_top(spark, sf):
    """The same over the 300 terms that occur most in two passages or more."""
    b = table(spark, sf, "benchmark")
    c = keep(S.term_counts(b, "item_id", S.word_ngrams(F.col("text"), 1, 2)), "q_counts")
    v = S.tfidf(c, "item_id", S.idf_table(c, "item_id", 2, 300))
    return v.select("item_id", "term", F.round("w", 6).alias("w"))


def char_tfidf_norms(spark, sf):
    """Terms, largest weight and norm of every conversation turn's character n-gram vector."""
    d = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text")
    c = S.term_counts(d, "k", T.char_wb(F.col("text"), 3, 5))
    v = S.tfidf(c, "k", S.idf_table(c, "k"))
    return v.groupBy("k").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("largest"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


def _benchmark_vectors(spark, sf):
    b = table(spark, sf, "benchmark")
    c = keep(S.term_counts(b, "item_id", T.char_wb(F.col("text"), 3, 5)), "q_counts")
    return keep(S.tfidf(c, "item_id", S.idf_table(c, "item_id")), "q_vectors")


def near_copy_pairs(spark, sf):
    """Pairs of benchmark passages with a cosine of 0.2 or more."""
    return S.similar_pairs(_benchmark_vectors(spark, sf), "item_id", 0.2).select("a", "b", F.round("cosine", 6).alias("cosine"))


def near_copy_semijoin(spark, sf):
    """For every conversation turn the largest cosine with a benchmark passage, weights fitted on both."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text")
    bench = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("k"), "text")
    c = keep(S.term_counts(turns.unionByName(bench), "k", T.char_wb(F.col("text"), 3, 5)), "q_counts")
    v = keep(S.tfidf(c, "k", S.idf_table(c, "k")), "q_vectors")
    ours = v.filter(F.col("k").startswith("b"))
    m = S.best_match(v.filter(~F.col("k").startswith("b")), ours, "k")
    return m.select(F.col("a").alias("k"), F.round("cosine", 6).alias("cosine"), (F.col("cosine") >= 0.2).alias("near"))


def near_copy_clusters(spark, sf):
    return S.near_copy_clusters(table(spark, sf, "documents"), "doc_id", "text")


def near_copy_pruning(spark, sf):
    """What the exact comparison of all documents' character vectors costs: pairs of blocks skipped, pairs of texts left by bounds, pairs scored."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("k"))
    links = S.blocked_packed(S.packed_tfidf(d, "k", "text", lambda x: T.char_wb(x, 3, 5)))
    return S.pruning(links).join(F.broadcast(links.filter("kind = 0").agg(F.count("*").alias("links"))))


def cluster_sizes(spark, sf):
    return S.cluster_sizes(embedding_components(spark, sf))


def _templates(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    # written once: filters and joins on it would normalise every text anew
    return keep(d.select("doc_id", "source", "quality", F.md5(T.normalise_text(F.col("text"))).alias("template")), "templates")


def group_split(spark, sf):
    """Template split: counts by side and label, and the templates found on both sides (none)."""
    s = P.group_split(_templates(spark, sf), "template", "quality", 0.2)
    sides = s.groupBy("template").agg(F.count_distinct("side").alias("n"))
    return s.groupBy("side", "quality").agg(F.count("*").alias("n"), F.count_distinct("template").alias("templates")).join(F.broadcast(sides.agg(F.count_if(F.col("n") > 1).alias("crossing"))))


def random_split(spark, sf):
    s = P.random_split(_templates(spark, sf), "doc_id", "quality", 0.2)
    return s.groupBy("side", "quality").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def pinned_roles(spark, sf):
    d = P.pinned(_templates(spark, sf), F.col("source"), ["src1", "src2"], ["src3"])
    held = d.filter((F.col("role") == "pool") & (P.bucket(F.col("template"), 5) == 0))
    train = d.filter((F.col("role") == "pool") & (P.bucket(F.col("template"), 5) != 0))
    clean = P.without_leaks(d.filter("role = 'synthetic'"), held, "template")
    parts = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held"))).unionByName(clean.select(*d.columns).withColumn("part", F.lit("synthetic"))).unionByName(d.filter("role = 'shift'").withColumn("part", F.lit("shift")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def fold_table(spark, sf):
    return P.folds(_templates(spark, sf), "template").groupBy("fold").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def split_overlap(spark, sf):
    """Held-out rows whose template also trains, under a split by rows and one by templates."""
    t = _templates(spark, sf)
    out = None
    for name, s in (("rows", P.random_split(t, "doc_id", "quality", 0.2)), ("templates", t.withColumn("side", F.when(P.bucket(F.col("template"), 5) == 0, "hold").otherwise("train")))):
        held = s.filter("side = 'hold'")
        twins = held.join(s.filter("side = 'train'").select("template").distinct(), "template", "left_semi")
        row = held.agg(F.count("*").alias("held")).join(F.broadcast(twins.agg(F.count("*").alias("twins")))).select(F.lit(name).alias("split"), "held", "twins")
        out = row if out is None else out.unionByName(row)
    return out


def embedding_knn(spark, sf):
    n = V.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)
    return n.select(F.col("a").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("b").alias("neighbour"), F.round("cosine", 5).alias("cosine"))


def embedding_vote(spark, sf):
    e = table(spark, sf, "embeddings")
    p = V.vote(V.neighbours(e, "vec_id", "embedding", 5), e, "vec_id", "label").join(e.select("vec_id", "label"), "vec_id")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


def embedding_pairs(spark, sf):
    p = V.close_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return p.select("a", "b", F.round("cosine", 5).alias("cosine"))


def embedding_components(spark, sf):
    c = V.threshold_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return c.select("vec_id", "cluster")


def embedding_tree_cut(spark, sf):
    """Clusters of the merge tree at the height where embedding_components links."""
    ids, tree = L.spanning_tree(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return L.cut_at(ids, tree, 0.6).select(F.col("v").alias("vec_id"), F.col("component").alias("cluster"))


def embedding_dendrogram(spark, sf):
    """The last thousand merges of all embeddings, with heights and sizes."""
    m = L.merges(*L.spanning_tree(table(spark, sf, "embeddings"), "vec_id", "embedding"))
    return m.withColumn("height", F.round("height", 6))


def component_chains(spark, sf):
    """Customers of a nation as a chain, each linked with the next one: long paths whose ids rise along them."""
    c = table(spark, sf, "customer")
    nxt = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return components(c.select(F.col("c_custkey").alias("src"), F.coalesce(nxt, "c_custkey").alias("dst")))


QUERIES = {f.__name__: f for f in (component_chains, word_tfidf, word_tfidf_top, char_tfidf_norms, near_copy_pairs, near_copy_semijoin, near_copy_clusters, near_copy_pruning, cluster_sizes, group_split, random_split, pinned_roles, fold_table, split_overlap, embedding_knn, embedding_vote, embedding_pairs, embedding_components, embedding_tree_cut, embedding_dendrogram)}


def _wb(rows: str) -> str:
    """Vectors of character n-grams as CTEs over rows(k, text)."""
    return f"""WITH rows AS ({rows}), w AS (SELECT k, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x : x <> '')) AS w FROM rows),
p AS (SELECT k, ' ' || w || ' ' AS p, n FROM w, (VALUES (3), (4), (5)) v(n) WHERE n = 3 OR length(w) + 2 > n - 1),
t AS (SELECT k, unnest(list_transform(generate_series(1, greatest(length(p) - n + 1, 1)), lambda i : substring(p, i::INT, n))) AS term FROM p),
c AS (SELECT k, term, count(*) AS c FROM t GROUP BY ALL), i AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT k) FROM c)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
x AS (SELECT k, c.term, (1 + ln(c)) * idf AS x FROM c JOIN i USING (term)), v AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM x)
"""


_BENCH = "SELECT item_id AS k, text FROM benchmark"
_TURNS = "SELECT conv_id || '-' || turn AS k, text FROM conversations"
from fernspan.plans.q_text import normal_sql  # noqa: E402

_TPL = f"t AS (SELECT doc_id, source, quality, md5({normal_sql('text')}) AS template FROM documents JOIN labels USING (doc_id))"


def _bucket(key: str, k: int) -> str:
    return f"('0x' || substr(md5('42/' || {key}), 1, 8))::UBIGINT % {k}"


_COS = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id)"

ORACLES = {
    "component_chains": "SELECT c_custkey AS v, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer",
    "word_tfidf": """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM benchmark),
t AS (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2),
c AS (SELECT item_id, term, count(*) AS c FROM t GROUP BY ALL), i AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT item_id) FROM c)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term), x AS (SELECT item_id, c.term, (1 + ln(c)) * idf AS x FROM c JOIN i USING (term))
SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS w FROM x""",
    "word_tfidf_top": """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM benchmark),
t AS (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2),
c AS (SELECT item_id, term, count(*) AS c FROM t GROUP BY ALL), i AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT item_id) FROM c)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(c) DESC, term LIMIT 300), x AS (SELECT item_id, c.term, (1 + ln(c)) * idf AS x FROM c JOIN i USING (term))
SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS w FROM x""",
    "char_tfidf_norms": _wb(_TURNS) + "SELECT k, count(*) AS terms, round(max(w), 6) AS largest, round(sum(w * w), 6) AS norm FROM v GROUP BY k",
    "near_copy_pairs": _wb(_BENCH) + "SELECT a, b, round(s, 6) AS cosine FROM (SELECT x.k AS a, y.k AS b, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.term = y.term AND x.k < y.k GROUP BY ALL) WHERE s >= 0.2 - 1e-9",
    "near_copy_semijoin": _wb(_TURNS + " UNION ALL SELECT 'b' || item_id, text FROM benchmark") + "SELECT a AS k, round(max(s), 6) AS cosine, max(s) >= 0.2 AS near FROM (SELECT x.k AS a, y.k AS b, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.term = y.term AND NOT starts_with(x.k, 'b') AND starts_with(y.k, 'b') GROUP BY ALL) GROUP BY a",
    "random_split": f"WITH {_TPL} SELECT CASE WHEN {_bucket('quality || chr(47) || doc_id', 5)} = 0 THEN 'hold' ELSE 'train' END AS side, quality, count(*) AS n, cast(sum(doc_id) AS BIGINT) AS id_sum FROM t GROUP BY ALL",
    "group_split": f"""WITH {_TPL}, m AS (SELECT template, quality, count(*) AS n FROM t GROUP BY ALL), j AS (SELECT template, quality AS major FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY n DESC, quality) AS r FROM m) WHERE r = 1),
d AS (SELECT template, major, {_bucket('template', 64)} AS b FROM j), e AS (SELECT *, row_number() OVER (PARTITION BY major, b ORDER BY md5('42/' || template), template) AS r FROM d), s AS (SELECT t.*, CASE WHEN (r + b) % 5 = 0 THEN 'hold' ELSE 'train' END AS side FROM t JOIN e USING (template))
SELECT side, quality, count(*) AS n, count(DISTINCT template) AS templates, 0::BIGINT AS crossing FROM s GROUP BY side, quality""",
    "pinned_roles": f"""WITH {_TPL}, d AS (SELECT *, CASE WHEN source IN ('src3') THEN 'shift' WHEN source IN ('src1', 'src2') THEN 'synthetic' ELSE 'pool' END AS role, {_bucket('template', 5)} = 0 AS h FROM t),
p AS (SELECT *, CASE WHEN role = 'pool' AND h THEN 'held' WHEN role = 'pool' THEN 'train' ELSE role END AS part FROM d) SELECT part, count(*) AS n, cast(sum(doc_id) AS BIGINT) AS id_sum FROM p WHERE part <> 'synthetic' OR template NOT IN (SELECT template FROM p WHERE part = 'held') GROUP BY part""",
    "fold_table": f"WITH {_TPL} SELECT cast({_bucket('template', 5)} AS INTEGER) AS fold, count(*) AS n, cast(sum(quality) AS BIGINT) AS good FROM t GROUP BY 1",
    "split_overlap": f"""WITH {_TPL}, s AS (SELECT 'rows' AS split, template, {_bucket('quality || chr(47) || doc_id', 5)} = 0 AS h FROM t UNION ALL SELECT 'templates', template, {_bucket('template', 5)} = 0 FROM t)
SELECT split, count(*) AS held, count(*) FILTER (EXISTS (SELECT 1 FROM s z WHERE z.split = s.split AND z.template = s.template AND NOT z.h)) AS twins FROM s WHERE h GROUP BY split""",
    "embedding_knn": _COS + " SELECT a AS vec_id, cast(rank AS INTEGER) AS rank, b AS neighbour, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s) WHERE rank <= 5",
    "embedding_vote": _COS + ", k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s), c AS (SELECT a, la, lb, count(*) AS n FROM k WHERE rank <= 5 GROUP BY ALL), p AS (SELECT a, la, lb, row_number() OVER (PARTITION BY a ORDER BY n DESC, lb) AS r FROM c) SELECT la AS label, count(*) AS n, count(*) FILTER (la = lb) AS hits FROM p WHERE r = 1 GROUP BY la",
    "embedding_pairs": _COS + " SELECT a, b, round(cosine, 5) AS cosine FROM s WHERE a < b AND cosine >= 0.4",
    "cluster_sizes": _COS.replace("WITH v", "WITH RECURSIVE v") + ", e AS (SELECT a, b FROM s WHERE cosine >= 0.4), r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), c AS (SELECT x, min(y) AS cluster FROM r GROUP BY x) SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM c GROUP BY cluster) GROUP BY size",
    "embedding_components": _COS.replace("WITH v", "WITH RECURSIVE v") + ", e AS (SELECT a, b FROM s WHERE cosine >= 0.4), r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS vec_id, min(y) AS cluster FROM r GROUP BY x",
}
ORACLES["embedding_tree_cut"] = ORACLES["embedding_components"]
