"""Queries over text blocks, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import layout as L
from quire.operators import protect as P
from quire.operators import quality as Q
from quire.operators import sequence as S
from quire.operators import stats as A
from quire.operators import translate as X
from quire.plans.registry import query
from quire.sources.views import V_BLOCK_SQL, table, v_block

# Regex twins for DuckDB (RE2): the same languages without look-around.
_LETTERS = "[A-Za-z]"
_REAL_WORD_SQL = r"regexp_matches({0}, '\b(?:[A-Za-z][a-z]{{2,}}|[A-Z]{{3,}})\b|[a-z]{{3,}}')"

UNIT_SQL = rf"""
WITH {V_BLOCK_SQL},
w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM v_block WHERE regexp_matches(text, '[a-z]{{3,}}')),
c AS (SELECT *, CASE WHEN prev IS NULL THEN 1
  WHEN rtrim(prev, ' ') LIKE '%-' THEN 0
  WHEN regexp_matches(rtrim(prev, ' '), '[.!?;:]$') THEN 1
  WHEN regexp_matches(ltrim(text, ' '), '^[\p{{Ll}}]') THEN 0
  WHEN length(rtrim(prev, ' ')) >= 80 THEN 0 ELSE 1 END AS is_new FROM w),
u AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS unit FROM c),
g AS (SELECT lang, doc_id, unit, count(*) AS n, sum(length(text)) AS chars FROM u GROUP BY lang, doc_id, unit)
SELECT lang, count(DISTINCT doc_id) AS docs, CAST(sum(n) AS BIGINT) AS lines, count(*) AS units, count(*) FILTER (n > 1) AS multi, CAST(sum(chars) AS BIGINT) AS chars FROM g GROUP BY lang
"""


@query("units_by_lang", UNIT_SQL)
def units_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lines stitched into units by neighbour rules (P15, W01, simplified to shared regex syntax), counted by language."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = v_block(spark, sf_dir).filter(F.col("text").rlike("[a-z]{3,}")).withColumn("prev", F.lag("text").over(w))
    t = F.rtrim("prev")
    new = F.when(F.col("prev").isNull(), 1).when(t.endswith("-"), 0).when(t.rlike("[.!?;:]$"), 1).when(F.ltrim("text").rlike(r"^[\p{Ll}]"), 0).when(F.length(t) >= 80, 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("unit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = rows.groupBy("lang", "doc_id", "unit").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return by.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("lines"), F.count("*").alias("units"), F.count_if(F.col("n") > 1).alias("multi"), F.sum("chars").alias("chars"))


@query("stitched_units")
def stitched_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, P12, P15, W01, A08 in full: each document's units with their joined text's key."""
    rows = v_block(spark, sf_dir).withColumn("type", B.text_block_type(F.col("text")))
    units = B.unit_texts(B.stitch_units(rows, ["doc_id"], ["ord"]), ["doc_id"], "ord")
    return units.select("doc_id", "unit", "n_blocks", F.length("source").alias("chars"), F.md5("source").alias("source_md5"))


@query("block_type_counts")
def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 with all text rules, counted by language and type."""
    return v_block(spark, sf_dir).withColumn("type", B.text_block_type(F.col("text"))).groupBy("lang", "type").agg(F.count("*").alias("n"))


@query(
    "block_types_plain",
    rf"""WITH {V_BLOCK_SQL},
    c AS (SELECT lang, CASE
      WHEN regexp_matches(text, '^(Fig\.?|Figure|Table)( |$)') THEN 'caption'
      WHEN regexp_matches(trim(text, ' '), '^[0-9]{{1,4}}$') THEN 'pagenum'
      WHEN regexp_matches(text, '^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]') THEN 'heading'
      WHEN regexp_matches(trim(text, ' '), '^[A-Z][A-Za-z]{{2,15}}$') THEN 'heading' ELSE 'body' END AS type FROM v_block)
    SELECT lang, type, count(*) AS n FROM c GROUP BY lang, type""",
)
def block_types_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches that both engines' patterns share."""
    t = F.col("text")
    kind = (
        F.when(t.rlike(r"^(Fig\.?|Figure|Table)( |$)"), "caption").when(F.trim(t).rlike("^[0-9]{1,4}$"), "pagenum")
        .when(t.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]"), "heading").when(F.trim(t).rlike("^[A-Z][A-Za-z]{2,15}$"), "heading").otherwise("body")
    )
    return v_block(spark, sf_dir).groupBy("lang", kind.alias("type")).agg(F.count("*").alias("n"))


@query(
    "furniture_lines",
    rf"""WITH {V_BLOCK_SQL}, k AS (SELECT substring(lower(regexp_replace(text, '[0-9\t\n\r\f\v ]', '', 'g')), 1, 40) AS key FROM v_block)
    SELECT key, count(*) AS n FROM k WHERE length(key) > 6 GROUP BY key HAVING count(*) >= 3""",
)
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04, A10."""
    return B.furniture(v_block(spark, sf_dir))


@query(
    "caps_profile",
    rf"""WITH {V_BLOCK_SQL}, c AS (SELECT doc_id, ord, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u FROM v_block)
    SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(round(u / n, 6) AS DOUBLE) AS ratio FROM c WHERE n >= 6""",
)
def caps_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09."""
    rows = v_block(spark, sf_dir).select("doc_id", "ord", F.round(T.caps_ratio(F.col("text")), 6).alias("ratio"))
    return rows.filter("ratio is not null")


@query(
    "number_rows",
    rf"""WITH {V_BLOCK_SQL}, t AS (SELECT doc_id, ord, list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: regexp_replace(w, '[.·⋅⋯]', '', 'g') <> '') AS w FROM v_block)
    SELECT doc_id, count(*) AS n FROM t WHERE len(w) >= 2 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9.,%×x±+\-/()]+'))) * 2 > len(w) GROUP BY doc_id""",
)
def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10's number rows, by document."""
    return v_block(spark, sf_dir).filter(T.is_number_row(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("line_predicates")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each language each predicate holds for."""
    t = F.col("text")
    preds = {"heading": T.is_heading(t), "caption": T.is_caption(t), "contact": T.is_contact(t), "reference": T.is_reference(t), "bibliography": T.is_bibliography(t), "mathish": T.is_mathish(t, T.math_score(t)), "numericish": T.is_numericish(t), "footer": T.is_footer(t), "list_item": T.is_list_item(t), "leader": T.is_leader(t), "fragment": T.is_fragment(t), "japanese": T.has_japanese(t), "real_word": T.has_real_word(t)}
    return v_block(spark, sf_dir).groupBy("lang").agg(*[F.count_if(p).alias(k) for k, p in preds.items()])


@query("echo_ratio", "SELECT doc_id, CAST(round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1), 6) AS DOUBLE) AS ratio, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0.8 * greatest(length(text), 1) AS echo FROM documents")
def echo_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 at a share of 0.8."""
    n = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(n, 6).alias("ratio"), T.is_echo(F.col("text"), 0.8).alias("echo"))


_MASKS = [(1, "a ⟦T0⟧ b ⟦T1⟧", "⟦T1⟧ x ⟦T0⟧"), (2, "a ⟦T0⟧", "b"), (3, "⟦T0⟧", "⟦T0⟧⟦T0⟧"), (4, "plain", "simple"), (5, "⟦T2⟧ ⟦T10⟧", "⟦T10⟧⟦T3⟧")]


@query(
    "placeholder_check",
    """WITH m(id, src, out) AS (VALUES """ + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in _MASKS) + r"""),
    p AS (SELECT id, list_sort(regexp_extract_all(src, '⟦T[0-9]+⟧')) AS s, list_sort(regexp_extract_all(out, '⟦T[0-9]+⟧')) AS o FROM m)
    SELECT CAST(id AS BIGINT) AS id, s = o AS same, len(list_filter(list_distinct(s), lambda x: NOT list_contains(o, x))) AS missing, len(list_filter(list_distinct(o), lambda x: NOT list_contains(s, x))) AS extra FROM p""",
)
def placeholder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, U01."""
    df = spark.createDataFrame(_MASKS, "id bigint, src string, out string")
    s, o = T.placeholders(F.col("src")), T.placeholders(F.col("out"))
    return df.select("id", T.placeholders_equal(F.col("src"), F.col("out")).alias("same"), F.size(F.array_except(s, o)).cast("bigint").alias("missing"), F.size(F.array_except(o, s)).cast("bigint").alias("extra"))


@query(
    "kill_set",
    rf"""WITH {V_BLOCK_SQL}, o AS (SELECT doc_id, ord, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS n FROM v_block),
    b AS (SELECT item_id, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS n FROM benchmark)
    SELECT DISTINCT doc_id, CAST(ord AS INTEGER) AS ord, item_id FROM o JOIN b ON length(b.n) >= 3 AND contains(o.n, b.n)""",
)
def kill_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that contain a benchmark item's normal form, in blocks of the items."""
    rows = v_block(spark, sf_dir).select("doc_id", "ord", T.match_key(F.col("text")).alias("n"))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.match_key(F.col("text")).alias("b"))
    out = None
    for part in X._blocks(items, "item_id"):
        got = rows.join(F.broadcast(part), (F.length("b") >= 3) & F.col("n").contains(F.col("b"))).select("doc_id", "ord", "item_id")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


@query(
    "residual_words",
    r"""WITH b AS (SELECT lower(string_agg(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'), '|')) AS blob FROM benchmark),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM documents)
    SELECT doc_id, count(*) AS n FROM w, b WHERE NOT contains(b.blob, lower(word)) GROUP BY doc_id""",
)
def residual_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each document that no benchmark text holds. Words are looked up once each: their
    distinct forms meet the items in blocks, then join back by equality."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.latin_words(F.col("text")))).alias("word"))
    forms = words.select(F.lower("word").alias("form")).distinct()
    items = table(spark, sf_dir, "benchmark").select("item_id", T.wide_key(F.col("text")).alias("blob"))
    known = None
    for part in X._blocks(items, "item_id"):
        got = forms.join(F.broadcast(part), F.col("blob").contains(F.col("form")), "left_semi")
        known = got if known is None else known.unionByName(got)
    left = words.join(known.distinct(), F.lower("word") == F.col("form"), "left_anti")
    return left.groupBy("doc_id").agg(F.count("*").alias("n"))


_TERMS = [("the", "ザ"), ("ation", "アシオン"), ("und", "ウント"), ("que", "ク"), ("ing th", "イング"), ("zzz", "ズ")]


@query(
    "glossary_hits",
    f"WITH {V_BLOCK_SQL}, g(term, ja) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TERMS) + ") SELECT term, ja, count(*) AS n, count(DISTINCT doc_id) AS docs FROM v_block JOIN g ON contains(lower(text), term) GROUP BY term, ja",
)
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03."""
    rows = v_block(spark, sf_dir).select(F.struct("doc_id", "ord").alias("uid"), F.col("text").alias("source"))
    hits = X.glossary_hits(rows, spark.createDataFrame(_TERMS, "term string, ja string"))
    return hits.groupBy("term", "ja").agg(F.count("*").alias("n"), F.countDistinct("uid.doc_id").alias("docs"))


_MEMO = [("The", "a"), ("The an", "b"), ("D e", "c"), ("É", "d"), ("Ein", "e"), ("Einzu", "f"), ("Q", "g")]


@query(
    "memo_longest_prefix",
    f"WITH {V_BLOCK_SQL}, m(prefix, ja) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MEMO) + r"""), n AS (SELECT regexp_replace(prefix, '[\t\n\r\f\v ]', '', 'g') AS p, ja FROM m),
    t AS (SELECT doc_id, ord, regexp_replace(text, '[\t\n\r\f\v ]', '', 'g') AS s FROM v_block),
    j AS (SELECT doc_id, ord, arg_max(ja, length(p)) AS ja FROM t LEFT JOIN n ON starts_with(s, p) GROUP BY doc_id, ord)
    SELECT coalesce(ja, '') AS ja, count(*) AS n FROM j GROUP BY 1""",
)
def memo_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04."""
    rows = v_block(spark, sf_dir).select(F.struct("doc_id", "ord").alias("uid"), F.col("text").alias("source"))
    return X.memo_prefix(rows, spark.createDataFrame(_MEMO, "prefix string, ja string")).groupBy("ja").agg(F.count("*").alias("n"))


@query(
    "cache_misses",
    f"""WITH {V_BLOCK_SQL}, k AS (SELECT doc_id, ord, sha256('memo' || chr(1) || '' || chr(1) || text) AS key FROM v_block), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
    SELECT doc_id, count(*) AS n, count(*) FILTER (c.key IS NULL) AS misses FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
)
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds every third document's lines."""
    rows = v_block(spark, sf_dir).withColumn("key", T.content_key(F.lit("memo"), F.lit(""), F.col("text")))
    cache = rows.filter("doc_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return rows.join(cache, "key", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("protect_text")
def protect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' tokens masked, and whether restoring gives the text but for stripped space."""
    rows = P.with_masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    back = T.strip_spaces(T.restore(F.col("masked"), F.col("tokens"))) == T.strip_spaces(F.col("text"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5("masked").alias("masked_md5"), back.alias("restored"))


@query(
    "pack_requests",
    f"""WITH RECURSIVE {V_BLOCK_SQL}, e AS (SELECT doc_id, ord, length(text) AS n FROM v_block),
    s AS (SELECT doc_id, ord, CAST(0 AS BIGINT) AS grp, CAST(n AS BIGINT) AS size, 1 AS items, n FROM e WHERE ord = 0
      UNION ALL SELECT e.doc_id, e.ord, s.grp + CASE WHEN s.size + e.n > 6000 OR s.items >= 10 THEN 1 ELSE 0 END, CASE WHEN s.size + e.n > 6000 OR s.items >= 10 THEN e.n ELSE s.size + e.n END,
        CASE WHEN s.size + e.n > 6000 OR s.items >= 10 THEN 1 ELSE s.items + 1 END, e.n FROM s JOIN e ON e.doc_id = s.doc_id AND e.ord = s.ord + 1)
    SELECT doc_id, grp, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY doc_id, grp""",
)
def pack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines in requests of at most 6,000 characters and 10 lines."""
    rows = v_block(spark, sf_dir).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.length("text").alias("chars"))
    packed = S.pack_greedy(rows, ["doc_id"], "ord", "chars")
    return rows.join(packed, ["doc_id", "ord"]).groupBy("doc_id", "grp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(
    "pack_by_count",
    f"""WITH {V_BLOCK_SQL} SELECT doc_id, CAST(ord // 10 AS BIGINT) AS grp, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_block GROUP BY doc_id, ord // 10""",
)
def pack_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14 where only the number of units binds: checks the fold against arithmetic."""
    rows = v_block(spark, sf_dir).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.length("text").alias("chars"))
    packed = S.pack_greedy(rows, ["doc_id"], "ord", "chars", max_size=1 << 40)
    return rows.join(packed, ["doc_id", "ord"]).groupBy("doc_id", "grp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


# Dollars a million tokens in and out, for a large, a middle and a small model.
PRICES = [("large", 5.0, 25.0), ("middle", 3.0, 15.0), ("small", 1.0, 5.0)]


@query(
    "cost_estimate",
    f"""WITH {V_BLOCK_SQL}, p(model, i, o) AS (VALUES """ + ", ".join(f"('{m}', {i}, {o})" for m, i, o in PRICES) + """),
    b AS (SELECT lang, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_block GROUP BY lang),
    r AS (SELECT *, CAST(greatest(1, ceil(units / 10), ceil(chars / 6000)) AS BIGINT) AS requests FROM b),
    t AS (SELECT *, CAST(chars / 4 + requests * 280 + units * 12 AS DOUBLE) AS tokens_in, CAST(chars / 2 AS DOUBLE) AS tokens_out FROM r)
    SELECT lang, units, chars, requests, tokens_in, tokens_out, model, CAST(round(tokens_in / 1e6 * i + tokens_out / 1e6 * o, 4) AS DOUBLE) AS usd, CAST(round((tokens_in / 1e6 * i + tokens_out / 1e6 * o) / 2, 4) AS DOUBLE) AS usd_batch FROM t, p""",
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    rows = v_block(spark, sf_dir).select("lang", F.length("text").alias("chars"))
    return A.cost_estimate(rows, spark.createDataFrame(PRICES, "model string, usd_in double, usd_out double"), ["lang"])


@query(
    "page_coverage",
    f"""WITH {V_BLOCK_SQL}, b AS (SELECT v.source AS page, length(text) AS n, l.doc_id IS NOT NULL AS done FROM v_block v LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
    c AS (SELECT page, CAST(sum(CASE WHEN done THEN n ELSE 0 END) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS chars FROM b GROUP BY page)
    SELECT page, covered, chars, CAST(round(covered / chars, 6) AS DOUBLE) AS share, covered / chars < 0.5 AS skip FROM c""",
)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents count as translated, a source as a page."""
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    rows = v_block(spark, sf_dir).withColumnRenamed("source", "page").join(done, "doc_id", "left")
    return A.coverage(rows, F.coalesce("done", F.lit(False)), "page")


@query(
    "proportional_split",
    """WITH t AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n, CAST(round_even(1000 * length(text) / sum(length(text)) OVER (PARTITION BY conv_id), 0) AS BIGINT) AS share, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
    e AS (SELECT *, sum(share) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
    SELECT conv_id, turn, n, CAST(CASE WHEN nxt IS NULL THEN 1000 ELSE least(1000, coalesce(before, 0) + share) END AS BIGINT) AS cut_end, CAST(least(1000, coalesce(before, 0)) AS BIGINT) AS cut_start FROM e""",
)
def proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of 1,000 characters cut by the turns' own shares."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return A.proportional_split(rows, "conv_id", "turn", "n", F.lit(1000).cast("bigint"))


@query("charset", "WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents) SELECT lang, ch FROM c WHERE ch <> ''")
def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return A.charset(table(spark, sf_dir, "documents"), keys=["lang"])


@query("missing_chars", "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = 'en') SELECT ch FROM c WHERE ch <> '' AND ch NOT IN (SELECT ch FROM b)")
def missing_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that English documents never use."""
    docs = table(spark, sf_dir, "documents")
    return A.missing_chars(A.charset(docs), A.charset(docs.filter("lang = 'en'")))


@query(
    "match_keys",
    rf"""WITH {V_BLOCK_SQL} SELECT doc_id, CAST(ord AS INTEGER) AS ord, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS f01, lower(regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '[\t\n\r\f\v ]', '', 'g')) AS f04, sha256(text) AS f19, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS f24 FROM v_block""",
)
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01, F04, F19, F24."""
    t = F.col("text")
    return v_block(spark, sf_dir).select("doc_id", "ord", T.match_key(t).alias("f01"), F.lower(T.strip_spaces(T.strip_digits(t))).alias("f04"), T.content_key(t).alias("f19"), F.length(T.html_escape(t)).cast("bigint").alias("f24"))


@query("sentence_counts")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, and pieces of at most 300 characters where sentences allow."""
    rows = S.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=300)
    return rows.select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.size("chunks").alias("pieces"), F.aggregate("chunks", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"))


@query("token_budget", "SELECT doc_id, CAST(least(16000, greatest(1024, floor(n_chars * 1.2) + 256)) AS INTEGER) AS budget FROM documents")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    return table(spark, sf_dir, "documents").select("doc_id", G.token_budget(F.col("n_chars")).cast("int").alias("budget"))


@query("translate_memo")
def translate_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through cache, token-only rule and the identity engine; echoes of words stay untranslated."""
    rows = v_block(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ord").alias("uid"), "lang", F.col("text").alias("masked"))
    cache = spark.createDataFrame([], "key string, target_masked string")
    out = X.translate_units(rows, cache, X.IdentityEngine())
    return out.groupBy("lang").agg(F.count("*").alias("units"), F.count("target_masked").alias("done"))


@query("wrapped_lines")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents broken to lines of 500 at size 10."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(10.0).alias("size"), F.lit(500.0).alias("width"))
    return L.wrapped(rows).select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "|")).alias("lines_md5"))


@query(
    "quality_units",
    """SELECT conv_id AS doc_id, 'translator' AS role, 'untranslated' AS kind, CAST(count(*) AS VARCHAR) AS detail, 'reengine' AS param FROM conversations WHERE turn % 4 = 0 GROUP BY conv_id
    UNION ALL SELECT conv_id, 'translator', 'placeholder_leak', CAST(count(*) AS VARCHAR), 'reengine' FROM conversations WHERE turn % 4 = 1 GROUP BY conv_id
    UNION ALL SELECT c.conv_id, 'editor', 'empty_output', CAST(coalesce(p.n, 0) AS VARCHAR), 'restrip' FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn % 4 <> 0) c
      LEFT JOIN (SELECT conv_id, sum(least(length(text), 40)) AS n FROM conversations WHERE turn % 4 = 3 GROUP BY conv_id) p USING (conv_id) WHERE coalesce(p.n, 0) < 50""",
)
def quality_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q01, Q02, Q06 over all turns of conversations. Constructed: every fourth turn lacks its target, the one behind it leaks a
    placeholder, and only the fourth of each four is drawn."""
    conv = table(spark, sf_dir, "conversations")
    target = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("訳⟦T1⟧"), "text")).when(F.col("turn") % 4 != 0, F.concat(F.lit("訳"), "text"))
    units = conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("uid"), F.col("text").alias("source"), target.alias("target"))
    placed = conv.filter("turn % 4 = 3").select(F.col("conv_id").alias("doc_id"), "text")
    return Q.untranslated(units).unionByName(Q.placeholder_leak(units)).unionByName(Q.empty_output(units, placed))


@query("text_functions")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02, F03, F07, F09-F13, F21, F22, F27, P20-P23 on the lines: digests of what each gives."""
    t = F.col("text")
    cols = {"f02": T.match_key_drop(t), "f03": T.wide_key(t), "f07": T.english_date(t), "f09": T.tighten_placeholders(T.pad_placeholders(t)), "f10": P.normal_form(t), "f11": T.fix_glyphs(t), "f12": T.drawable(t, r"[^\x20-\x7E]"), "f13": T.ascii_cjk(t), "f21": F.to_json(T.progress_event(t)), "f22": T.safe_filename(t), "p20": T.digits_survive(F.regexp_extract_all(t, F.lit(r"([0-9]+)"), 1), t).cast("string"), "p21": T.is_token_only(t).cast("string")}
    return v_block(spark, sf_dir).groupBy("lang").agg(*[F.sum(F.crc32(F.coalesce(c, F.lit("")).cast("binary"))).alias(k) for k, c in cols.items()])
