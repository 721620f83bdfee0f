"""Queries: text normalisation, keys, dedup, cleaning stages, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.operators import dedup, lemmas, vocabulary
from fernspan.session import keep, table


def _sql(pattern: str) -> str:
    return pattern.replace("(?i)", "").replace("'", "''")


def _flags(pattern: str) -> str:
    return "'gi'" if "(?i)" in pattern else "'g'"


def normal_sql(col: str) -> str:
    s = col
    for p, put in T.PLACEHOLDERS:
        s = f"regexp_replace({s}, '{_sql(p)}', '{put}', {_flags(p)})"
    return f"trim(regexp_replace(regexp_replace(lower({s}), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


KEY_SQL = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"


def _stage_sql(level: int, field: str = "coalesce(text, '')") -> str:
    s = field
    q = lambda x: x.replace("'", "''")
    if level >= 1:
        for a, b in T.ENTITIES:
            s = f"replace({s}, '{q(a)}', '{q(b)}')"
        for c in ("…", "½", "¼", "¾", "™", "ﬁ", "ﬂ"):
            s = f"replace({s}, '{c}', '{T.EXPANDED[c]}')"
        s = f"translate({s}, '{T.DECOMPOSED}', '{q(T.ASCII_OF)}')"
        s = f"trim(regexp_replace(lower(regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"
    if level >= 2:
        for a, b in T.CONTRACTIONS:
            s = f"replace({s}, '{q(a)}', '{q(b)}')"
    if level >= 3:
        s = f"trim(regexp_replace(regexp_replace(regexp_replace({s}, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    if level >= 4:
        stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
        s = f"array_to_string(list_filter(string_split({s}, ' '), lambda w : length(w) > 2 AND w NOT IN ({stop})), ' ')"
    if level >= 5:
        arms = []
        for end, put, least in T.SUFFIXES:
            more = " AND NOT ends_with(w, 'ss')" if end == "s" else ""
            arms.append(f"WHEN ends_with(w, '{end}') AND length(w) >= {least}{more} THEN left(w, length(w) - {len(end)}) || '{put}'")
        s = f"array_to_string(list_transform(string_split({s}, ' '), lambda w : CASE {' '.join(arms)} ELSE w END), ' ')"
    return s


def text_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalise_text(F.col("text")).alias("text_clean"), T.word_count(F.col("text")).cast("long").alias("n_words"))


def dedup_key_groups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.dedup_key(F.col("text")).alias("k")).filter(F.length("k") > 0)
    return d.groupBy(F.md5("k").alias("key_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def _ranked(spark, sf):
    return table(spark, sf, "documents").withColumn("rank", F.try_to_number(F.substring("source", 4, 10), F.lit("9999999999")).cast("long"))


def priority_dedup(spark, sf):
    d = _ranked(spark, sf).select("doc_id", "source", "lang", "rank", "text")
    out = dedup.priority_dedup(d, T.dedup_key(F.col("text")), F.col("rank"), F.col("doc_id"))
    return out.select("doc_id", "source", "lang", F.length(T.normalise_text(F.col("text"))).cast("long").alias("clean_chars"))


def label_conflicts(spark, sf):
    """Rows whose text appears under more than one source (the role of the label)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return dedup.label_conflicts(d, T.dedup_key(F.col("text")), "source").select("doc_id", "source", "n_labels", F.md5("dedup_key").alias("key_md5"))


def duplicate_counts(spark, sf):
    return dedup.duplicate_counts(table(spark, sf, "documents"), ["lang", "text"])


def subset_dedup(spark, sf):
    d = dedup.first_of_each(table(spark, sf, "documents"), ["lang", "text"], [F.col("doc_id")])
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def template_overlap(spark, sf):
    """Benchmark templates (normalised passages) that also are whole documents' templates or not."""
    d = table(spark, sf, "documents").select(T.normalise_text(F.col("text")).alias("t"), "doc_id", "source")
    held = d.filter(F.col("source").isin("src0", "src1")).select("t").distinct()
    rest = d.filter(~F.coalesce(F.col("source").isin("src0", "src1"), F.lit(False)))
    return rest.join(held, "t", "left_semi").groupBy("source").agg(F.count("*").alias("n_overlap"))


_LEVELS = [f"c{k}" for k in range(6)]


def cleaning_stages(spark, sf):
    d = T.with_stages(table(spark, sf, "documents").select("doc_id", "text"), "text", _LEVELS)
    return d.select("doc_id", *(F.md5(c).alias(f"s{k}") for k, c in enumerate(_LEVELS)))


def stage_vocabulary(spark, sf):
    """Distinct words left after each cleaning stage."""
    v = vocabulary.stage_words(table(spark, sf, "documents").select("text"), [], F.col("text"))
    return v.groupBy("stage").agg(F.count_distinct("word").alias("vocabulary"), F.sum("n").alias("n_words"))


def slug_overlap(spark, sf):
    p = table(spark, sf, "pages")
    slug = T.slug_words(F.lower("url"))
    body = F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("([a-z]+)"), 1))
    return p.select("page_id", F.size(slug).cast("long").alias("n_slug"), F.round(F.size(F.array_intersect(slug, body)) / F.greatest(F.size(slug), F.lit(1)), 6).alias("overlap"))


def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_unescape(F.col("html"))).alias("unescaped_md5"), F.length(T.html_unescape(F.col("html"))).cast("long").alias("n_chars"))


def ui_noise_filter(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.without_ui_noise(F.concat(F.lit("Today 10:31 am\n"), F.col("text"), F.lit("\nDelivered\n9.05 read"))).alias("kept"))


def top_tokens_by_lang(spark, sf):
    """The 300 most frequent words of each language, then without stop words, then the first fifteen."""
    from pyspark.sql import Window

    t = table(spark, sf, "documents").select("lang", F.explode(T.long_tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    first = t.withColumn("r", F.row_number().over(w)).filter("r <= 300").filter(~F.col("word").isin(*T.STOP_WORDS))
    return first.withColumn("r", F.row_number().over(w)).filter("r <= 15").select("lang", "word", "n", F.col("r").cast("long").alias("r"))


def red_flag_words(spark, sf):
    """Red-flag filter over each conversation turn's words, weighted by their length."""
    toks = T.words(F.col("text"))
    d = table(spark, sf, "conversations").withColumn("toks", toks)
    return d.select("conv_id", "turn", F.array_join(T.red_flags(F.col("toks"), F.transform("toks", lambda w: F.length(w) / 100.0)), "|").alias("flags"))


def label_alias_map(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", T.label_of(F.col("quality") + F.col("toxic")).alias("label"))


def char_wb_ngrams(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.char_wb(F.col("text"), 3, 5)).alias("g"))
    return d.groupBy("g").agg(F.count("*").alias("n"))


def _cleaned_words(spark, sf):
    d = T.with_stages(table(spark, sf, "documents").select("doc_id", "text"), "text", _LEVELS[:5])
    return keep(d.select("doc_id", T.words(F.col(_LEVELS[4])).alias("words")), "cleaned_words")


def lemma_table(spark, sf):
    """Every distinct word left of the documents after cleaning, as noun and then as verb, by a lexicon of the documents themselves."""
    return lemmas.lemma_table(_cleaned_words(spark, sf), "doc_id", "words")


def lemmatised_texts(spark, sf):
    """The cleaned documents with every word replaced by its lemma."""
    d = _cleaned_words(spark, sf)
    out = lemmas.lemmatised(d, "doc_id", "words", lemmas.lemma_table(d, "doc_id", "words"))
    return out.select("doc_id", F.md5(F.array_join("words", " ")).alias("lemmas_md5"), F.size("words").cast("long").alias("n"))


def ascii_forms(spark, sf):
    """Characters of the documents outside ASCII, and what compatibility decomposition leaves of them."""
    c = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\x00-\x7F]+", ""), ""))).alias("c")).filter("c <> ''")
    return c.groupBy("c").agg(F.count("*").alias("n")).select("c", T.to_ascii(F.col("c")).alias("ascii"), "n")


QUERIES = {
    f.__name__: f
    for f in (text_normalise, dedup_key_groups, priority_dedup, label_conflicts, duplicate_counts, subset_dedup, template_overlap, cleaning_stages, stage_vocabulary, slug_overlap, html_unescape, ui_noise_filter, top_tokens_by_lang, red_flag_words, label_alias_map, char_wb_ngrams, lemma_table, lemmatised_texts, ascii_forms)
}

_NOISE = _sql(T.UI_NOISE)
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FLAGGED = ", ".join(f"'{w}'" for w in T.NOT_A_FLAG)
_UNESCAPED = "html"
for _a, _b in T.ENTITIES:
    _UNESCAPED = "replace({}, '{}', '{}')".format(_UNESCAPED, _a.replace("'", "''"), _b.replace("'", "''"))
_WB = """
WITH w AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x : x <> '')) AS w FROM conversations),
p AS (SELECT ' ' || w || ' ' AS p FROM w),
g AS (SELECT p, n FROM p, (VALUES (3), (4), (5)) v(n) WHERE n = 3 OR length(p) > n - 1)
SELECT g, count(*) AS n FROM (
  SELECT unnest(list_transform(generate_series(1, greatest(length(p) - n + 1, 1)), lambda i : substring(p, i::INT, n))) AS g FROM g
) GROUP BY g
"""



def _lemma_sql() -> str:
    """CTEs up to ``lm`` (word, noun, lemma, n): as lemmas.lemma_table."""
    def accepted(word: str, rules: tuple, irregular: dict) -> str:
        forms = [f"SELECT {word} AS word, {word} AS form FROM src"] + [f"SELECT {word}, left({word}, length({word}) - {len(a)}) || '{b}' FROM src WHERE ends_with({word}, '{a}') AND length({word}) > {len(a)}" for a, b in rules]
        exact = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in irregular.items()) + " END"
        return f"SELECT word, coalesce({exact}, min(form ORDER BY length(form), form) FILTER (form IN (SELECT word FROM lx)), word) AS lemma FROM ({' UNION '.join(forms)}) GROUP BY word"

    docs = f"w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(trim({_stage_sql(4)}), '\\s+'), lambda x : x <> '') AS ws FROM documents)"
    count = f"c AS MATERIALIZED (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY word), lx AS MATERIALIZED (SELECT word FROM c WHERE docs >= {lemmas.LEAST_DOCS})"
    noun = accepted("word", lemmas.NOUN, lemmas.IRREGULAR_NOUNS).replace("FROM src", "FROM c")
    verb = accepted("noun", lemmas.VERB, lemmas.IRREGULAR_VERBS).replace("FROM src", "FROM nn")
    return f"{docs}, {count}, nn AS MATERIALIZED (SELECT word, lemma AS noun FROM ({noun})), vb AS (SELECT word AS noun, lemma FROM ({verb})), lm AS MATERIALIZED (SELECT nn.word, nn.noun, vb.lemma, c.n FROM nn JOIN vb USING (noun) JOIN c ON c.word = nn.word)"


ORACLES = {
    "lemma_table": f"WITH {_lemma_sql()} SELECT * FROM lm",
    "lemmatised_texts": f"WITH {_lemma_sql()}, e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w), j AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS t, count(*) AS n FROM e JOIN lm USING (word) GROUP BY doc_id) SELECT doc_id, md5(coalesce(t, '')) AS lemmas_md5, coalesce(j.n, 0) AS n FROM w LEFT JOIN j USING (doc_id)",
    "ascii_forms": f"SELECT c, regexp_replace(translate(c, '{T.DECOMPOSED}', '{T.ASCII_OF.replace(chr(39), chr(39) * 2)}'), '[^\\x00-\\x7F]', '', 'g') AS ascii, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY c",
    "text_normalise": f"SELECT doc_id, {normal_sql('text')} AS text_clean, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x : x <> '')) AS n_words FROM documents",
    "dedup_key_groups": f"SELECT md5(k) AS key_md5, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {KEY_SQL} AS k FROM documents) WHERE length(k) > 0 GROUP BY k HAVING count(*) > 1",
    "priority_dedup": f"""SELECT doc_id, source, lang, length({normal_sql('text')}) AS clean_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY try_cast(substring(source, 4, 10) AS BIGINT) NULLS LAST, doc_id) AS rn FROM documents WHERE length({KEY_SQL}) > 0) WHERE rn = 1""",
    "label_conflicts": f"""WITH d AS (SELECT doc_id, source, {KEY_SQL} AS k FROM documents), m AS (SELECT k, count(DISTINCT source) AS n_labels FROM d WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT source) > 1)
        SELECT doc_id, source, n_labels, md5(k) AS key_md5 FROM d JOIN m USING (k)""",
    "duplicate_counts": "SELECT cast(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, cast(sum(n) - count(*) AS BIGINT) AS n_extra, cast(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_in_groups FROM (SELECT count(*) AS n FROM documents GROUP BY lang, text)",
    "subset_dedup": "SELECT lang, count(*) AS n, cast(sum(id) AS BIGINT) AS id_sum FROM (SELECT lang, text, min(doc_id) AS id FROM documents GROUP BY lang, text) GROUP BY lang",
    "template_overlap": f"""WITH d AS (SELECT source, {normal_sql('text')} AS t FROM documents)
        SELECT source, count(*) AS n_overlap FROM d WHERE source NOT IN ('src0', 'src1') AND t IN (SELECT t FROM d WHERE source IN ('src0', 'src1')) GROUP BY source""",
    "cleaning_stages": "SELECT doc_id, " + ", ".join(f"md5({_stage_sql(k)}) AS s{k}" for k in range(6)) + " FROM documents",
    "stage_vocabulary": " UNION ALL ".join(f"SELECT {k} AS stage, count(DISTINCT w) AS vocabulary, count(*) AS n_words FROM (SELECT unnest(list_filter(regexp_split_to_array(trim({_stage_sql(k)}), '\\s+'), lambda x : x <> '')) AS w FROM documents)" for k in range(6)),
    "slug_overlap": """WITH p AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(replace(regexp_replace(list_extract(string_split(regexp_replace(lower(url), '/+$', ''), '/'), -1), '_us_[0-9a-f]+$', ''), '-', ' '), '\\s+'), lambda x : x <> '')) AS s,
        regexp_extract_all(lower(html), '[a-z]+') AS b FROM pages)
        SELECT page_id, len(s) AS n_slug, round(len(list_intersect(s, list_distinct(b))) / greatest(len(s), 1), 6) AS overlap FROM p""",
    "html_unescape": f"SELECT page_id, md5({_UNESCAPED}) AS unescaped_md5, length({_UNESCAPED}) AS n_chars FROM pages",
    "ui_noise_filter": f"""SELECT conv_id, turn, trim(array_to_string(list_filter(list_transform(regexp_split_to_array('Today 10:31 am' || chr(10) || text || chr(10) || 'Delivered' || chr(10) || '9.05 read', '\\r\\n|\\r|\\n'),
        lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x : x <> '' AND NOT regexp_matches(x, '{_NOISE}', 'i')), ' ')) AS kept FROM conversations""",
    "top_tokens_by_lang": f"""WITH t AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) AS word FROM documents) GROUP BY lang, word),
        a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r0 FROM t), b AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM a WHERE r0 <= 300 AND word NOT IN ({_STOP}))
        SELECT lang, word, n, r FROM b WHERE r <= 15""",
    "red_flag_words": f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x : x <> '') AS toks FROM conversations),
        f AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(toks, lambda x : length(x) > 1), lambda x : trim(x, '.,!?:;"''()[]')), lambda x : x <> '' AND lower(x) NOT IN ({_FLAGGED}) AND regexp_matches(x, '[\\p{{L}}£$€]')) AS fl FROM t)
        SELECT conv_id, turn, array_to_string(list_slice(list_filter(fl, lambda x, i : list_position(fl, x) = i), 1, 5), '|') AS flags FROM f""",
    "label_alias_map": "SELECT doc_id, CASE cast(quality + toxic AS VARCHAR) WHEN '0' THEN 'ham' WHEN '1' THEN 'spam' WHEN '2' THEN 'smishing' END AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "char_wb_ngrams": _WB,
}
