"""Composites: building leak-free splits, scoring a batch of messages, rendering, ablations and the split study."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.operators import bayes, dedup, metrics, ml, similarity, split, vocabulary
from fernspan.session import Kept, keep, tidy

# The marks and headlines of a verdict, its notes, and messages whose verdict should survive rewording (probe, variant, text, wanted).
MARKS = {"ham": "✅", "spam": "📣", "smishing": "⚠️"}
UNSURE, UNKNOWN = "❔", "•"
HEADLINES = {"ham": "No scam signals found", "spam": "Marketing / spam", "smishing": "Likely scam"}
REVIEW_NOTE = "\n🔎 {}, so a person should check it. Until then, treat it as suspicious: don't click links, pay, or share codes."
REVIEW_HAM, REVIEW_OTHER = "There is still enough chance this is a scam", "I'm not certain about this one"
HAM_NOTE = "\nThis is not a guarantee. If it asks for money, a code or a login, check with the sender on a number you already trust."
PROBES = (
    ("obfuscation", "plain", "Your DBS account has been locked. Verify now at http://dbs-sg-verify.top", "smishing"),
    ("obfuscation", "leetspeak", "Y0ur DB5 acc0unt has been l0cked. Verify now at http://dbs-sg-verify.top", "smishing"),
    ("obfuscation", "plain", "Your OCBC card is suspended. Reactivate at http://ocbc-secure.co/login", "smishing"),
    ("obfuscation", "leetspeak", "Y0ur 0CBC card is susp3nded. Reactivate at http://ocbc-secure.co/login", "smishing"),
    ("link_form", "http", "Your parcel is held at customs. Pay the fee at http://sgpost-clear.co/pay", "smishing"),
    ("link_form", "bare domain", "Your parcel is held at customs. Pay the fee at sgpost-clear.co/pay", "smishing"),
    ("link_form", "no link", "Your parcel is held at customs. Reply with your card number to pay the fee", "smishing"),
    ("benign_link", "news", "check out this article https://www.straitstimes.com/singapore/abc", "ham"),
    ("benign_link", "maps", "Meet here later ok https://maps.google.com/?q=bugis+junction", "ham"),
    ("benign_link", "photos", "Uploaded the trip photos https://photos.app.goo.gl/xyz", "ham"),
    ("no_link_scam", "new number", "Hi mum this is my new number, my phone broke. Can you PayNow me $500 urgently", "smishing"),
    ("no_link_scam", "job", "Hi, I am Jessica from Lazada HR. Part time job, earn $300-$800 daily. Interested?", "smishing"),
)


def build_splits(rows: DataFrame, rank: Column, synthetic: list[str], shift: list[str], test_size: float = 0.2, val_size: float = 0.15, threshold: float = 0.7) -> DataFrame:
    """(row_id, text, label, source, text_clean, cluster, split) from (row_id, text, label, source).

    Exact copies keep the row of the best source; near copies share a cluster, and whole clusters are split; synthetic rows
    only train and shift rows only measure, and both lose what shares a cluster with the side they must not know.
    """
    d = dedup.priority_dedup(rows, T.dedup_key(F.col("text")), rank, F.col("row_id")).withColumn("text_clean", T.normalise_text(F.col("text")))
    d = keep(d.filter(F.length("text_clean") > 0), "build_rows")
    c = similarity.near_copy_clusters(d, "row_id", "text", threshold)
    d = keep(split.pinned(d.join(c, "row_id"), F.col("source"), synthetic, shift), "build_clusters")
    pool = split.group_split(d.filter("role = 'pool'"), "cluster", "label", test_size)
    rest = split.group_split(pool.filter("side = 'train'").drop("side"), "cluster", "label", val_size, seed=43)
    names = [x for x in d.columns if x != "role"]
    test = pool.filter("side = 'hold'").select(*names, F.lit("test").alias("split"))
    val = rest.filter("side = 'hold'").select(*names, F.lit("val").alias("split"))
    train = rest.filter("side = 'train'").select(*names, F.lit("train").alias("split"))
    made = split.without_leaks(d.filter("role = 'synthetic'"), test.unionByName(val), "cluster").select(*names, F.lit("train").alias("split"))
    train = train.unionByName(made)
    away = split.without_leaks(d.filter("role = 'shift'"), train, "cluster").select(*names, F.lit("shift").alias("split"))
    return reduce(DataFrame.unionByName, (train, val, test, away))


def predict_batch(model: PipelineModel, messages: DataFrame, classes: list[str], rule: str = "argmax", review_cost: float = metrics.REVIEW_COST, explain: str | None = None, draws: int = 1000) -> DataFrame:
    """Per message: label, confidence, scores by class and whether a person should look; a blank message is an error.

    explain names a key of messages: warnings then get their red flags, and every message its verdict in words.
    """
    text = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(F.raise_error(F.lit("cannot classify an empty message")))
    d = ml.scored(model, ml.prepared(messages.withColumn("text", text)), classes)
    label = metrics.min_cost_class(F.col("proba")) if rule == "min_cost" else metrics.argmax_class(F.col("proba"))
    d = d.withColumn("label_", label)
    scores = F.map_from_arrays(F.array(*map(F.lit, classes)), "proba")
    out = d.select(*messages.columns, F.col("label_").alias("predicted"), F.element_at(scores, F.col("label_")).alias("confidence"), scores.alias("scores"), (metrics.answer_cost(F.col("proba"), F.col("label_")) > review_cost).alias("needs_review"))
    if explain is None:
        return out
    out = keep(out, "predictions")
    flags = [ml.explained(model, out.filter(F.col("predicted") == c).select(explain, "text"), explain, classes, c, draws) for c in classes if c != "ham"]
    out = out.join(reduce(DataFrame.unionByName, flags), explain, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return out.withColumn("verdict", verdict(F.col("predicted"), F.col("confidence"), F.col("flags"), F.col("needs_review")))


def verdict(label: Column, confidence: Column, flags: Column, review: Column) -> Column:
    """A verdict in words: mark, headline, percentage, red flags, and what to do about it."""
    of = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    mark = F.when((label == "ham") & review, UNSURE).otherwise(F.coalesce(F.try_element_at(of(MARKS), label), F.lit(UNKNOWN)))
    pct = F.bround(confidence * 100, 0).cast("long").cast("string")
    quoted = F.array_join(F.transform(flags, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    why = F.when(label == "ham", REVIEW_NOTE.format(REVIEW_HAM)).otherwise(REVIEW_NOTE.format(REVIEW_OTHER))
    note = F.when(review, why).when(label == "ham", HAM_NOTE).otherwise("")
    head = F.concat(mark, F.lit(" "), F.coalesce(F.try_element_at(of(HEADLINES), label), label), F.lit(" ("), pct, F.lit("%)"))
    return F.concat(head, F.when(F.size(flags) > 0, F.concat(F.lit("\nFlagged on: "), quoted)).otherwise(""), note)


#: Rows that a page may hold: it is one string, put together in one task.
PAGE_ROWS = 10_000


def html_table(df: DataFrame, columns: list[str], order: list[Column], title: str) -> DataFrame:
    """One row with an HTML page: a table of the (few, aggregated) rows in order, values escaped; more than PAGE_ROWS rows are an error, never a shorter page."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    some = df.select(F.struct(*order).alias("o"), cells.alias("r")).limit(PAGE_ROWS + 1)  # no task ever gets more
    rows = some.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]), "").alias("body"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    page = F.concat(F.lit(f"<h1>{title}</h1><table>{head}"), "body", F.lit("</table>"))
    return rows.select(F.when(F.col("n") > PAGE_ROWS, F.raise_error(F.lit(f"more than {PAGE_ROWS} rows for one page"))).otherwise(page).alias("html"))


def cleaning_ablation(df: DataFrame, fields: dict[str, Column], classes: list[str], folds: int = 5) -> DataFrame:
    """Per text field and cleaning level: mean and deviation over the folds of naive Bayes' macro F1, and the words that are left. df: doc_id, y.

    Fields and levels come one after the other, so that what one takes on disk is gone before the next: a level's texts are made from those of
    the level before. The vocabulary is told by distinct words.
    """
    spark, keys = df.sparkSession, ["field", "level"]
    fold = split.bucket(F.concat_ws("/", "y", "doc_id"), folds, 5).cast("int")
    words, scores = [], []
    for name, field in fields.items():
        rows = Kept(df.select(F.col("doc_id").alias("doc"), fold.alias("fold"), "y", F.coalesce(field, F.lit("")).alias("text")), "ablation_texts")
        v = vocabulary.stage_words(rows.df, [], F.col("text")).groupBy(F.col("stage").alias("level")).agg(F.count_distinct("word").alias("vocabulary"))
        words.append(keep(v, "ablation_words").withColumn("field", F.lit(name)))
        for k in range(len(T.STAGES) + 1):
            if k:
                before, rows = rows, Kept(rows.df.withColumn("text", T.STAGES[k - 1](F.col("text"))), "ablation_texts")
                tidy(spark, before)
            p = bayes.words_out_of_fold(rows.df.withColumn("words", ml.WORDS_OF(F.col("text"))), [], classes, [bayes.Config()], ["fold", "y", "pred"])
            scores.append(p.withColumns({"field": F.lit(name), "level": F.lit(k)}))
        tidy(spark, rows)
    each = metrics.summary(reduce(DataFrame.unionByName, scores), [*keys, "fold"])
    out = each.groupBy(*keys).agg(F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("deviation"), F.sum("n").alias("n"))
    return out.join(reduce(DataFrame.unionByName, words), keys)


def augmentation_ablation(rows: DataFrame, synthetic: Column, classes: list[str], fit) -> DataFrame:
    """With and without generated training rows: metrics on the validation side and false alarms on the shift set. rows: as build_splits gives them."""
    d = keep(ml.prepared(rows.withColumn("y", F.col("label")).drop("label"), chars=False), "augmentation")
    val, shift, out = d.filter("split = 'val'"), d.filter("split = 'shift'"), []
    for name, train in (("real_only", d.filter((F.col("split") == "train") & ~synthetic)), ("real_plus_synthetic", d.filter("split = 'train'"))):
        model = fit().fit(ml.labelled(train, classes))
        p = keep(ml.scored(model, val, classes).select("y", "pred"), "augmentation_scores")
        alarms = ml.scored(model, shift, classes).agg(F.avg((F.col("pred") != "ham").cast("double")).alias("shift_false_alarms"))
        one = (p.agg(metrics.mean_cost(p).alias("expected_cost")), alarms, train.agg(F.count("*").alias("train_rows")))  # one row each
        s = reduce(lambda x, y: x.join(F.broadcast(y)), one, metrics.summary(p))
        out.append(s.select(F.lit(name).alias("condition"), "train_rows", "n", "accuracy", "macro_f1", "target_recall", "expected_cost", "shift_false_alarms"))
    return reduce(DataFrame.unionByName, out)


def repeated_ablation(rows: DataFrame, synthetic: Column, classes: list[str], fit, seeds: int = 6) -> DataFrame:
    """The same over repeated splits of the real train and validation rows by cluster; generated rows that share a held-out cluster go."""
    d = keep(ml.prepared(rows.filter("split in ('train', 'val')").withColumn("y", F.col("label")).drop("label"), chars=False), "repeated")
    made, pool, out = d.filter(synthetic), d.filter(~synthetic), []
    for seed in range(seeds):
        s = keep(split.group_split(pool, "cluster", "y", 0.2, seed), "repeated_split")
        held = s.filter("side = 'hold'").drop("side")
        real = s.filter("side = 'train'").drop("side")
        every = real.unionByName(split.without_leaks(made, held, "cluster"))
        for name, train in (("real_only", real), ("with_generated", every)):
            model = fit().fit(ml.labelled(train, classes))
            out.append(ml.scored(model, held, classes).select(F.lit(seed).alias("seed"), F.lit(name).alias("condition"), "y", "pred"))
    r = metrics.summary(keep(reduce(DataFrame.unionByName, out), "repeated_scores"), ["seed", "condition"])
    wide = r.groupBy("seed").agg(*(F.max(F.when(F.col("condition") == n, F.col(c))).alias(f"{c}_{n}") for n in ("real_only", "with_generated") for c in ("target_recall", "macro_f1")))
    return wide.withColumn("recall_gain", F.col("target_recall_with_generated") - F.col("target_recall_real_only")).withColumn("f1_gain", F.col("macro_f1_with_generated") - F.col("macro_f1_real_only"))


def split_study(df: DataFrame, classes: list[str], fit, seeds: tuple[int, ...] = (42, 1, 2), target: str = metrics.TARGET) -> DataFrame:
    """Target recall by splitting method and seed, for held-out rows with a twin in training (the same template or a near copy) and without.

    random splits rows; delete splits templates and drops training rows that nearly copy a held-out one; cluster splits near-copy clusters.
    """
    t = df.withColumn("template", F.md5(T.normalise_text(F.col("text"))))
    t = keep(t.join(similarity.near_copy_clusters(t, "doc_id", "text"), "doc_id"), "study_rows")
    out = []
    for method, seed in ((m, s) for m in ("random", "delete", "cluster") for s in seeds):
        if method == "random":
            s = split.random_split(t, "doc_id", "y", 0.2, seed)
        else:
            s = split.group_split(t, "template" if method == "delete" else "cluster", "y", 0.2, seed)
        s = keep(s, "study")
        train, held = s.filter("side = 'train'").drop("side"), s.filter("side = 'hold'").drop("side")
        if method == "delete":
            train = split.without_leaks(train, held, "cluster")
        known = [train.select(k).distinct().withColumn(f"by_{k}", F.lit(True)) for k in ("template", "cluster")]
        p = ml.scored(fit().fit(train), held, classes).join(known[0], "template", "left").join(known[1], "cluster", "left")
        p = p.filter(F.col("y") == target).select((F.col("pred") == target).cast("double").alias("hit"), (F.coalesce("by_template", F.lit(False)) | F.coalesce("by_cluster", F.lit(False))).alias("twin"))
        of = lambda c: F.avg(F.when(c, F.col("hit")))
        out.append(p.agg(F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.count("*").alias("targets"), F.avg("hit").alias("recall"), F.count_if("twin").alias("twins"), of(F.col("twin")).alias("twin_recall"), F.count_if(~F.col("twin")).alias("new"), of(~F.col("twin")).alias("new_recall")))
    return keep(reduce(DataFrame.unionByName, out), "study_table")
