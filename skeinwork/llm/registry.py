"""Queries of this package over the corpus tables, and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import bodies, coherence, distinctive, fusion, leakage, nearcopies, packing, repetition
from skeinwork.operators.joins import join_key_stats, small
from skeinwork.operators.unpack import POSTING, unpack_values
from skeinwork.plans import sql
from skeinwork.session import spread, stage
from skeinwork.sources.tables import normal_word, table, trimmed

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TOP_PARTS = 5
MIN_COUNT, MIN_URLS, MAX_URLS, TOP_TERMS = 6, 2, 12, 10


# -- 2: keyword strings and link lists


def p2_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every crawled page with its words outside of sentences and the mean mutual information of its neighbouring words."""
    out = coherence.incoherence(table(spark, root, "crawl"), "url_hash", "page")
    return out.select(F.col("id").alias("url_hash"), "n_words", "loose_words", F.round("loose_share", 6).alias("loose_share"), F.round("mean_pmi", 6).alias("mean_pmi"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Crawled pages of which more than half of the own words are not in sentences."""
    out = coherence.incoherence(table(spark, root, "crawl"), "url_hash", "page")
    return out.where(F.col("loose_share") > coherence.SPAM_SHARE).select(F.col("id").alias("url_hash"))


# -- 5: the main body


def _wanted_pages(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "extract_jobs").select("url_hash").where("url_hash IS NOT NULL").distinct()
    return spread(table(spark, root, "page_cache").select("url_hash", "page").where("page IS NOT NULL")).join(small(jobs), "url_hash", "left_semi")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Line numbers of the article in every wanted page; what recurs is learned from all stored pages."""
    recurring = bodies.recurring_lines(table(spark, root, "page_cache"), "page", by_line=True)
    return bodies.body_lines(_wanted_pages(spark, root), "url_hash", "page", recurring).select(F.col("id").alias("url_hash"), "line_no").distinct()


def p5_crawl_bodies(spark: SparkSession, root: str) -> DataFrame:
    """The text of the main body of every crawled page; rows that repeat a page are told by a digest before they are shuffled."""
    pages = table(spark, root, "crawl").select("url_hash", "page").where("page IS NOT NULL")
    recurring = bodies.recurring_lines(pages, "page", by_line=False)
    found = bodies.body_text(pages, "url_hash", "page", recurring).select(F.col("id").alias("url_hash"), "body")
    return found.groupBy("url_hash", F.sha2("body", 256).alias("digest")).agg(F.first("body").alias("body")).select("url_hash", "body")


# -- 4: one ranking from several scores


def usable_ranks(spark: SparkSession, root: str) -> DataFrame:
    """``url``, ``rank``: of the rows of a url whose score is a finite number, the newest; at equal times the higher one."""
    text = trimmed("current_score")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    rows = table(spark, root, "pageranks").select("url", "computed_at", value.alias("rank")).where("url IS NOT NULL AND abs(rank) < double('infinity')")
    newest = F.max(F.struct(F.coalesce(F.col("computed_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), "rank"))
    return rows.groupBy("url").agg(newest.alias("m")).select("url", F.col("m.rank").alias("rank"))


def term_candidates(spark: SparkSession, root: str) -> DataFrame:
    """``word``, ``url``, ``count``, ``rank`` of the pages of every query term."""
    terms = table(spark, root, "query_terms").select(normal_word("word").alias("word")).where("word IS NOT NULL").distinct()
    index = table(spark, root, "inv_index").select(normal_word("word").alias("word"), "priority1").where("priority1 IS NOT NULL")
    postings = unpack_values(index.join(small(terms), "word"), "priority1", ["word"], POSTING)
    # `count` is the largest of a page's postings; a posting without a number still makes its page a candidate
    pages = postings.groupBy("word", "url").agg(F.max(F.coalesce("count", F.lit(0))).alias("count"))
    return pages.join(usable_ranks(spark, root), "url")


def p4_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The pages of each query term in one order, by the median of their ranks in count and page rank."""
    out = fusion.aggregate_ranks(term_candidates(spark, root), "word", "url", {"rank": 1.0, "count": 1.0})
    return out.select("word", "url", "position", "median_rank", "mean_rank", "rank_rank", "rank_count", "n_items")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages that at most a fifth of their term's pages exceed, in either score."""
    out = fusion.rank_items(term_candidates(spark, root), "word", "url", {"rank": 1.0, "count": 1.0})
    top = ((F.col("rank_rank") - 1) * TOP_PARTS <= F.col("n_items")) & ((F.col("rank_count") - 1) * TOP_PARTS <= F.col("n_items"))
    return out.where(top).select("word", "url")


# -- 7: how distinctive a term is


def term_frequencies(spark: SparkSession, root: str) -> DataFrame:
    """``word``, ``url``, ``title_field`` and ``body_field`` (counts of postings in priority1 and 3, null without one),
    ``in_title`` (in doc_word_count.title) and their sum ``tf``.

    Fragments flushed twice count once: the largest count of a page's postings in a field holds.
    """
    index = table(spark, root, "inv_index").select(normal_word("word").alias("word"), "priority1", "priority3").where("word IS NOT NULL")
    parts = []
    for field, n in (("priority1", 1), ("priority3", 3)):
        count = F.coalesce("count", F.lit(0))
        got = unpack_values(index, field, ["word"], POSTING)
        parts.append(got.select("word", "url", *[(count if n == k else F.lit(None).cast("bigint")).alias(f"f{k}") for k in (1, 3)], F.lit(0).cast("bigint").alias("ft")))
    titles = table(spark, root, "doc_word_count").where("url IS NOT NULL AND title IS NOT NULL").select("url", "title").distinct()
    words = titles.select("url", F.explode(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("word"))
    words = words.groupBy("word", "url").agg(F.count(F.lit(1)).alias("ft"))
    nothing = F.lit(None).cast("bigint")
    parts.append(words.select("word", "url", nothing.alias("f1"), nothing.alias("f3"), "ft"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("word", "url").agg(F.max("f1").alias("title_field"), F.max("f3").alias("body_field"), F.max("ft").alias("in_title"))
    tf = F.coalesce("title_field", F.lit(0)) + F.coalesce("body_field", F.lit(0)) + F.col("in_title")
    return stage(rows.withColumn("tf", tf), "term-frequencies")


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all terms; ``n_urls``: pages with postings of the word, whatever their counts."""
    rows = term_frequencies(spark, root)
    posted = F.count(F.when(F.col("title_field").isNotNull() | F.col("body_field").isNotNull(), 1))
    urls = stage(rows.groupBy("word").agg(posted.alias("n_urls"), F.count(F.lit(1)).alias("__rows")), "urls-of-words")

    total = urls.agg(F.sum("__rows")).first()[0] or 0
    rows = join_key_stats(rows, urls, ["word"], "__rows", total).drop("__rows")
    return distinctive.divergence_scores(stage(rows, "frequencies"), "url", "word", "tf")


def _report(terms: DataFrame) -> DataFrame:
    return terms.select("url", "word", "place", "tf", "n_docs", F.round("score", 6).alias("score"))


def p7_scores(spark: SparkSession, root: str) -> DataFrame:
    """The scores of all terms of every page, with their place: the page's most distinctive term has place 1."""
    return _report(distinctive.placed_terms(_scored(spark, root), "url", "word"))


def p7_leading(spark: SparkSession, root: str) -> DataFrame:
    """The ten most distinctive terms of every page."""
    return _report(distinctive.leading_terms(_scored(spark, root), "url", "word", TOP_TERMS))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Terms that are frequent in the body of their page and rare in the collection."""
    rare = (F.col("body_field") >= MIN_COUNT) & F.col("n_urls").between(MIN_URLS, MAX_URLS) & F.col("score").isNotNull()
    return _scored(spark, root).where(rare).select("url", "word")


# -- 8: containers


def _packed(spark: SparkSession, root: str) -> tuple[DataFrame, dict[int, int]]:
    # the list of capacities is a setting, not data: a row per container size
    capacities = {r.spec_id: r.capacity for r in table(spark, root, "pack_specs").collect()}
    lengths = packing.token_counts(table(spark, root, "documents"), "doc_id", "text")
    return packing.pack(lengths, capacities), capacities


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    return _packed(spark, root)[0]


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and the share of filled space, for each capacity."""
    out, capacities = _packed(spark, root)
    boxes = out.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("used"))
    size = F.create_map(*[F.lit(int(x)).cast("bigint") for kv in capacities.items() for x in kv])[F.col("spec_id")]
    out = boxes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * size))


def p8_checks(spark: SparkSession, root: str) -> DataFrame:
    """What any packing has to hold, for each capacity: documents and tokens placed, containers that are too full, documents that were split
    though they fit, and documents whose pieces do not follow one another."""
    out, capacities = _packed(spark, root)
    out = stage(out, "packing")
    size = F.create_map(*[F.lit(int(x)).cast("bigint") for kv in capacities.items() for x in kv])[F.col("spec_id")]
    full = out.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("used")).groupBy("spec_id").agg(F.count(F.when(F.col("used") > size, 1)).alias("too_full"))
    ordered = F.array_sort(F.collect_list(F.struct("first_token", "n_tokens")))
    follows = F.aggregate(ordered, F.lit(0).cast("bigint"), lambda at, x: F.when(at == x.first_token, at + x.n_tokens).otherwise(F.lit(-1).cast("bigint")))
    docs = out.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"), follows.alias("end"))
    docs = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.count(F.when((F.col("n") <= size) & (F.col("parts") > 1), 1)).alias("split_though_fit"), F.count(F.when(F.col("end") != F.col("n"), 1)).alias("broken"))
    return docs.join(full, "spec_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that had to be split, for each capacity."""
    return _packed(spark, root)[0].where("n_parts > 1 AND part = 0").select("spec_id", "doc_id").distinct()


# -- 9: evaluation texts in the corpus


def p9_leaks(spark: SparkSession, root: str) -> DataFrame:
    """All documents with ten or more consecutive words of an evaluation item, with extent and place of the longest match."""
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the items of which they hold at least 30 % in such runs."""
    found = p9_leaks(spark, root).where(F.col("covered_words") * 100 >= F.col("item_words") * leakage.SHARE_PERCENT)
    return found.select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    """The documents into which no item leaked."""
    documents = table(spark, root, "documents").select("doc_id", "source", "lang")
    return leakage.without_leaks(documents, p9_found(spark, root), "doc_id")


# -- 10: repetition


def p10_repetition(spark: SparkSession, root: str) -> DataFrame:
    """Shares of repeated content of every document."""
    out = repetition.repetition(table(spark, root, "documents"), "doc_id", "text")
    return out.select(*[F.round(c, 6).alias(c) if "share" in c else F.col(c) for c in out.columns])


def p10_words(spark: SparkSession, root: str) -> DataFrame:
    """Words of every document that lie in repeated runs of three, six and ten words."""
    out = repetition.repetition(table(spark, root, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_words", *[f"repeated_words_{n}" for n in repetition.LENGTHS])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents of which at least 30 % of the words lie in repeated runs of six."""
    out = repetition.repetition(table(spark, root, "documents"), "doc_id", "text")
    return out.where("n_words > 0 AND repeated_words_6 * 10 >= n_words * 3").select("doc_id").distinct()


QUERIES = {
    "p1_found": nearcopies.p1_found, "p1_groups": nearcopies.p1_groups, "p2_found": p2_found, "p2_scores": p2_scores, "p5_found": p5_found, "p5_crawl_bodies": p5_crawl_bodies,
    "p4_found": p4_found, "p4_ranking": p4_ranking, "p7_found": p7_found, "p7_scores": p7_scores, "p7_leading": p7_leading, "p8_found": p8_found, "p8_packing": p8_packing, "p8_checks": p8_checks, "p10_words": p10_words,
    "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_clean": p9_clean, "p10_found": p10_found, "p10_repetition": p10_repetition,
}

_CANDIDATES = f"""t AS (SELECT DISTINCT {sql.normal_word()} AS word FROM query_terms WHERE {sql.normal_word()} IS NOT NULL),
    c AS (SELECT word, url, max(coalesce(cnt, 0)) AS n FROM ({sql.postings(1)}) WHERE word IN (SELECT word FROM t) GROUP BY word, url),
    s AS (SELECT url, computed_at, TRY_CAST(regexp_replace(current_score, '{sql.AROUND}', '', 'g') AS DOUBLE) AS score FROM pageranks WHERE url IS NOT NULL
      AND regexp_full_match(regexp_replace(current_score, '{sql.AROUND}', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')),
    r AS (SELECT url, max_by(score, struct_pack(a := computed_at, b := score)) AS score FROM s WHERE isfinite(score) GROUP BY url),
    x AS (SELECT c.word, c.url, rank() OVER (PARTITION BY word ORDER BY score DESC) AS rank_rank, rank() OVER (PARTITION BY word ORDER BY n DESC) AS rank_count, count(*) OVER (PARTITION BY word) AS n_items
      FROM c JOIN r USING (url)),
    y AS (SELECT *, least(rank_rank, rank_count) AS median_rank, (rank_rank + rank_count) / 2 AS mean_rank FROM x)"""

_WORDS = f"""u AS (SELECT word, url, max(CASE WHEN field = 1 THEN coalesce(cnt, 0) END) AS f1, max(CASE WHEN field = 3 THEN coalesce(cnt, 0) END) AS f3
    FROM ({sql.postings(1)} UNION ALL {sql.postings(3)}) WHERE word IS NOT NULL GROUP BY word, url)"""

_TOKENS = "len(regexp_extract_all(text, '[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9 \\t\\r\\n]'))"

_RUNS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS p, ws FROM w WHERE len(ws) >= 6),
    k AS (SELECT doc_id, n, p, hash(ws[p : p + 5]) AS h FROM g WHERE p + 5 <= n),
    d AS (SELECT doc_id, n, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY p) AS o FROM k) WHERE o > 1),
    c AS (SELECT doc_id, n, least(6, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 6)) AS gain FROM d)"""

_COUNTED = _WORDS + """, tt AS (SELECT url, word, count(*) AS ft FROM (SELECT url, unnest(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS word
      FROM (SELECT DISTINCT url, title FROM doc_word_count WHERE url IS NOT NULL AND title IS NOT NULL)) GROUP BY ALL),
    tf AS (SELECT word, url, coalesce(f1, 0) + coalesce(f3, 0) + coalesce(ft, 0) AS tf FROM u FULL JOIN tt USING (word, url)), f AS (SELECT * FROM tf WHERE tf > 0 AND url IS NOT NULL),
    w AS (SELECT word, count(*) AS n_docs, sum(tf) AS total FROM f GROUP BY word), d AS (SELECT url, sum(tf) AS len FROM f GROUP BY url), c AS (SELECT count(*) AS n, sum(len) AS len FROM d),
    x AS (SELECT url, word, tf, n_docs, tf * log2(1 + (c.len / c.n) / d.len) AS t, total / c.n AS lam FROM f JOIN w USING (word) JOIN d USING (url), c),
    y AS (SELECT url, word, tf, n_docs, (log2(1 + lam) + t * log2((1 + lam) / lam)) / (t + 1) AS score FROM x),
    z AS (SELECT url, word, CAST(tf AS BIGINT) AS tf, n_docs, row_number() OVER (PARTITION BY url ORDER BY round(score, 9) DESC, word) AS place, round(score, 6) AS score FROM y)"""


def _repeated(n: int) -> str:
    """Words of a document in runs of n that began at an earlier word."""
    return f"""(SELECT doc_id, sum(gain) AS r FROM (SELECT doc_id, least({n}, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, {n})) AS gain FROM
        (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, h ORDER BY p) AS o FROM (SELECT doc_id, p, md5(array_to_string(ws[p : p + {n - 1}], ' ')) AS h
        FROM (SELECT doc_id, ws, generate_subscripts(ws, 1) AS p FROM w) WHERE p + {n - 1} <= len(ws))) WHERE o > 1) GROUP BY doc_id)"""


# Named entities that stand for a letter, sign or blank of the texts; numbered ones are left to the tables' own texts.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&eacute;", "é"), ("&uuml;", "ü"), ("&ouml;", "ö"), ("&auml;", "ä"), ("&szlig;", "ß"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ntilde;", "ñ"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&amp;", "&"))


def _plain(text: str) -> str:
    text = f"regexp_replace({text}, '<!--(?s:.*?)-->|</?[A-Za-z!?][^>]*>', ' ', 'g')"
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return text


_LEAKS = f"""dw AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower({_plain("text")}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
    dr AS (SELECT d, p, array_to_string(ws[p : p + 9], ' ') AS r FROM (SELECT d, ws, generate_subscripts(ws, 1) AS p FROM dw) WHERE p + 9 <= len(ws)),
    ir AS (SELECT i, p, array_to_string(ws[p : p + 9], ' ') AS r FROM (SELECT i, ws, generate_subscripts(ws, 1) AS p FROM iw) WHERE p + 9 <= len(ws)),
    hit AS (SELECT d, i, ir.p AS q, dr.p AS p FROM dr JOIN ir USING (r)),
    cov AS (SELECT d, i, sum(gain) AS covered FROM (SELECT d, i, least(10, coalesce(lead(q) OVER (PARTITION BY d, i ORDER BY q) - q, 10)) AS gain FROM (SELECT DISTINCT d, i, q FROM hit)) GROUP BY d, i),
    run AS (SELECT d, i, min(q) AS q, min(p) AS p, count(*) + 9 AS size FROM (SELECT *, q - row_number() OVER (PARTITION BY d, i, p - q ORDER BY q) AS k FROM hit) GROUP BY d, i, p - q, k),
    best AS (SELECT d, i, arg_min(struct_pack(size := size, q := q, p := p), struct_pack(a := -size, b := p)) AS b FROM run GROUP BY d, i),
    pair AS (SELECT doc_id, item_id, CAST(covered AS BIGINT) AS covered_words, len(iw.ws) AS item_words, covered / len(iw.ws) AS share, b.size AS match_words, b.q - 1 AS match_in_item, b.p - 1 AS match_in_doc
      FROM cov JOIN best USING (d, i) JOIN dw USING (d) JOIN iw USING (i)),
    found AS (SELECT DISTINCT doc_id, item_id FROM pair WHERE covered_words * 100 >= item_words * {leakage.SHARE_PERCENT})"""

_NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|</?[A-Za-z!?][^>]*>"


def _page_words() -> str:
    text = f"regexp_replace(page, '{_NOISE}', ' ', 'g')"
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


_VERSIONS = f"""pw AS (SELECT DISTINCT url_hash AS id, {_page_words()} AS ws FROM crawl WHERE page IS NOT NULL AND url_hash IS NOT NULL),
    ps AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS seqs FROM pw WHERE len(ws) >= {nearcopies.WORDS}),
    pc AS (SELECT min(id) AS rep, seqs FROM ps GROUP BY seqs), members AS (SELECT DISTINCT id, rep FROM ps JOIN pc USING (seqs)),
    sh AS (SELECT rep, unnest(seqs) AS s, len(seqs) AS n FROM pc),
    links AS (SELECT a.rep AS a, b.rep AS b FROM sh a JOIN sh b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= {nearcopies.ALIKE} * (a.n + b.n - count(*))),
    copies AS (SELECT id, rep FROM members WHERE id <> rep), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)"""

SQL = {
    "p1_found": f"WITH {_VERSIONS} SELECT DISTINCT least(x, y) AS url_hash_a, greatest(x, y) AS url_hash_b FROM (SELECT a AS x, b AS y FROM links UNION ALL SELECT id, rep FROM copies UNION ALL SELECT id, b FROM copies JOIN ways ON a = rep) WHERE x <> y",
    "p1_groups": f"WITH RECURSIVE {_VERSIONS}, reach(n, m) AS (SELECT rep, rep FROM pc UNION SELECT n, b FROM reach JOIN ways ON a = m), g AS (SELECT n, min(m) AS group_id FROM reach GROUP BY n), d AS (SELECT a, count(*) AS n_links FROM ways GROUP BY a) SELECT id AS url_hash, rep AS representative, group_id, coalesce(n_links, 0) AS n_links FROM members JOIN g ON n = rep LEFT JOIN d ON a = rep",
    "p7_scores": f"WITH {_COUNTED} SELECT url, word, place, tf, n_docs, score FROM z",
    "p7_leading": f"WITH {_COUNTED} SELECT url, word, place, tf, n_docs, score FROM z WHERE place <= {TOP_TERMS}",
    "p8_checks": f"SELECT spec_id, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, 0::BIGINT AS too_full, 0::BIGINT AS split_though_fit, 0::BIGINT AS broken FROM (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE text IS NOT NULL), pack_specs WHERE n > 0 GROUP BY spec_id",
    "p9_leaks": f"WITH {_LEAKS} SELECT * FROM pair",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM found",
    "p9_clean": f"WITH {_LEAKS} SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found WHERE doc_id IS NOT NULL)",
    "p10_words": "WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) AS ws FROM documents) SELECT doc_id, len(ws) AS n_words, "
    + ", ".join(f"CAST(coalesce(r{n}.r, 0) AS BIGINT) AS repeated_words_{n}" for n in repetition.LENGTHS)
    + " FROM w "
    + " ".join(f"LEFT JOIN {_repeated(n)} r{n} USING (doc_id)" for n in repetition.LENGTHS),
    "p4_found": f"WITH {_CANDIDATES} SELECT word, url FROM y WHERE (rank_rank - 1) * {TOP_PARTS} <= n_items AND (rank_count - 1) * {TOP_PARTS} <= n_items",
    "p4_ranking": f"WITH {_CANDIDATES} SELECT word, url, row_number() OVER (PARTITION BY word ORDER BY median_rank, mean_rank, url) AS position, median_rank, mean_rank, rank_rank, rank_count, n_items FROM y",
    "p7_found": f"WITH {_WORDS}, n AS (SELECT word, count(*) AS n FROM u GROUP BY word) SELECT url, word FROM u JOIN n USING (word) WHERE f3 >= {MIN_COUNT} AND n BETWEEN {MIN_URLS} AND {MAX_URLS}",
    "p8_found": f"SELECT spec_id, doc_id FROM (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE text IS NOT NULL) JOIN pack_specs ON n > capacity",
    "p10_found": f"WITH {_RUNS} SELECT doc_id FROM c GROUP BY doc_id, n HAVING sum(gain) * 10 >= n * 3",
}
