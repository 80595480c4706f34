"""Queries over what is kept between runs: lexical and vector indexes, indexes in buckets, monitors and crawls, trained models; and over models and files; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import contrastive, models, order, qa, rules, search, training
from tesserae.operators.lexical import LexicalIndex, indexed_search
from tesserae.operators.order import checkpointed, shared_folder
from tesserae.operators.vector_index import VectorIndex
from tesserae.plans import standins
from tesserae.sources import files, pages
from tesserae.streaming import monitor

#: 300 categories of three keywords each, so that many of them occur in a text.
MANY = rules.Rules({"The": "articles"}, {f"c{k:03d}": [f"{a}{b}{c}" for a, b, c in ((chr(97 + k % 26), chr(97 + k * 7 % 26), chr(97 + k * 11 % 26)), (chr(97 + k * 3 % 26), "e", chr(97 + k % 23)), (chr(65 + k % 26), chr(97 + k * 5 % 26), " "))] for k in range(300)})


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _moved_index(spark, sf_dir) -> LexicalIndex:
    """A lexical index of documents after three upserts: it begins with other texts, other documents and one third of them missing."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    index = LexicalIndex(spark, shared_folder(spark), order=("lang", "n_chars"))
    other = F.when(F.col("lang") == "fr", "an older text of it").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("first of all. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    index.upsert(docs.filter("doc_id % 3 <> 0 or lang = 'fr'").withColumn("text", other))
    index.upsert(docs.filter("lang = 'fr'"))
    index.upsert(docs.filter("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "soon replaced").otherwise(F.col("text"))))
    index.upsert(docs.filter("doc_id % 5 = 0 or doc_id % 7 = 0"))
    return index


def q62_blockmax_topk(spark, sf_dir):
    """The ten best documents for every benchmark text, from a kept index whose blocks are skipped by their bounds."""
    found = _moved_index(spark, sf_dir).top_k(_t(spark, sf_dir, "benchmark"), 10, "item_id", "text")
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("bm25"))


def q63_kept_statistics(spark, sf_dir):
    """Documents of each term, documents and lengths in all (the empty term), after three upserts."""
    return _moved_index(spark, sf_dir).terms().select("term", "df", "total")


def q64_compacted_index(spark, sf_dir):
    """The best document for every benchmark text after the versions of an index were rewritten as one."""
    index = _moved_index(spark, sf_dir)
    index.compact()
    found = index.top_k(_t(spark, sf_dir, "benchmark"), 1, "item_id", "text")
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("bm25"))


def _vectors(spark, sf_dir) -> VectorIndex:
    """A vector index of embeddings after an upsert: a fifth of them were filed under other vectors."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(spark, shared_folder(spark))
    index.build(rows.filter("vec_id % 7 <> 0").withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.upsert(rows.filter("vec_id % 5 = 0 or vec_id % 7 = 0"))
    return index


def q65_cells_exact(spark, sf_dir):
    """The ten nearest others of every vector whose id is divisible by 50, by probing all cells."""
    queries = _t(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    index = _vectors(spark, sf_dir)
    found = index.search(queries, 10, len(index.centres()), "vec_id", same=False)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def q66_cells_recall(spark, sf_dir):
    """How many of those are found in three quarters of the cells, and which share of all pairs meets for it: one row (neighbours, found, recall, met)."""
    queries, read = _t(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0"), []
    index = _vectors(spark, sf_dir)
    n = len(index.centres())
    near = index.search(queries, 10, -(-3 * n // 4), "vec_id", same=False, read=read).select("query_id", "id", F.lit(1).alias("hit"))
    both = index.search(queries, 10, n, "vec_id", same=False).join(near, ["query_id", "id"], "left")
    share = round(read[0][0] / read[0][1], 4) if read[0][1] else None
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.try_divide(F.count("hit").cast("double"), F.count("*")), 4).alias("recall"), F.lit(share).cast("double").alias("met"))


def q80_indexed_search(spark, sf_dir):
    """The five best documents for every benchmark text with a vector, by both kept indexes after their upserts."""
    rows = _t(spark, sf_dir, "embeddings").join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vectors = VectorIndex(spark, shared_folder(spark))
    vectors.build(rows.filter("vec_id % 7 <> 0"))
    vectors.upsert(rows.filter("vec_id % 7 = 0"))
    queries = _t(spark, sf_dir, "benchmark").join(_t(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    found = indexed_search(_moved_index(spark, sf_dir), vectors, queries)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


_DOC = "doc_id long, text string, lang string"


def q67_upsert_in_place(spark, sf_dir):
    """An index in buckets: a third of the documents is put in late, one language is replaced twice, and some are removed."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = files.BucketedIndex(spark, shared_folder(spark), _DOC, "doc_id", 16)
    index.upsert(docs.filter("doc_id % 3 <> 0"))
    late = docs.filter("doc_id % 3 = 0 or lang = 'fr'").withColumn("ordinal", F.lit(0))
    index.upsert(late.unionByName(docs.filter("lang = 'fr'").withColumn("text", F.concat(F.lit("v2 "), "text")).withColumn("ordinal", F.lit(1))), ordinal="ordinal")
    index.remove(docs.filter("doc_id % 11 = 0"))
    return index.rows().select("doc_id", F.md5("text").alias("text_md5"))


def q68_co_located_join(spark, sf_dir):
    """Documents and their vectors from two tables in buckets of one key, joined without a shuffle."""
    folder, buckets = shared_folder(spark), 16
    docs = files.write_co_located(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), f"{folder}/docs", "doc_id", buckets)
    vectors = files.write_co_located(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label"), f"{folder}/vectors", "doc_id", buckets)
    return docs.join(vectors, "doc_id").select("doc_id", "lang", "n_chars", "label", F.round(T.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>")), 6).alias("norm"))


_BATCHES = 4


def _arriving(spark, sf_dir, folder):
    """Documents as notices that come in four batches of files, each put into the folder when it is taken; a quarter of the URLs comes twice."""
    docs = _t(spark, sf_dir, "documents")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    size = most // _BATCHES + 1
    url = F.concat(F.lit("http://h.org/"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % size).otherwise(F.col("doc_id")).cast("string"))
    rows = docs.select("doc_id", T.title_of("text").alias("title"), url.alias("url"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("date"), T.body_of("text").alias("body"))
    for k in range(_BATCHES):
        rows.filter(F.floor(F.col("doc_id") / size) == k).drop("doc_id").write.mode("append").parquet(folder)
        yield spark.readStream.schema("title string, url string, date string, body string").parquet(folder)


def q69_index_new(spark, sf_dir):
    """A monitor over four batches: categories and index records of the notices that are new in each. It is started anew for each and goes on where it was."""
    from tesserae.plans.catalog import RULES

    index, checkpoint = monitor.monitored_index(spark, shared_folder(spark), 16), shared_folder(spark)
    for stream in _arriving(spark, sf_dir, shared_folder(spark)):
        monitor.index_new(stream, index, RULES, checkpoint).awaitTermination()
    return index.rows().select("url", "date", "category", "epoch", F.md5("document").alias("document_md5"))


def q70_resumed_crawl(spark, sf_dir):
    """Orders as items of a listing, newest first, 50 on a page and a page in a file; the crawl of the newest two years is stopped and goes on."""
    from tesserae.plans.catalog import _order_rows

    rows = checkpointed(_order_rows(spark, sf_dir).select("page", F.col("position").cast("long").alias("position"), F.col("o_orderkey").cast("string").alias("url"), F.when(F.col("o_orderkey") % 89 != 0, F.col("date")).alias("date")))
    newest = rows.agg(F.max(F.substring("date", 1, 4))).first()[0] or "0000"
    since = f"{int(newest) - 1:04d}"
    folder, out, state, checkpoint = (shared_folder(spark) for _ in range(4))
    pages = rows.agg(F.max("page")).first()[0] or 0
    chunk = max(1, -(-pages // 8))  # files of as many pages, so that a crawl takes a few batches at any scale
    for k in range(8):
        rows.filter(F.floor((F.col("page") - 1) / chunk) == k).coalesce(1).write.mode("append").parquet(folder)
        if k == 2:  # the listing is known so far: a run ends here, and another one goes on below
            _crawl(spark, folder, out, state, checkpoint, since)
    _crawl(spark, folder, out, state, checkpoint, since)
    return spark.read.schema("url string, date string, page long, position long, epoch long").json(out).select("url", "date", "page")


def _crawl(spark, folder, out, state, checkpoint, since):
    stream = spark.readStream.schema("page long, position long, url string, date string").option("maxFilesPerTrigger", 1).parquet(folder)
    monitor.crawl_on(stream, out, state, checkpoint, since).awaitTermination()


def q71_many_keywords(spark, sf_dir):
    """Categories by 900 keywords, each text being read once."""
    return _t(spark, sf_dir, "documents").select("doc_id", rules.infer_category_at_once(MANY, T.title_of("text"), T.body_of("text")).alias("category"))


def q72_counted_crawl(spark, sf_dir):
    """Pages that are new are written, and counted while they are: one row (new, skipped, empty, written)."""
    found = _t(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("body"), "page_id")
    folder = shared_folder(spark)
    counts = pages.counted_crawl(found, found.filter("page_id % 3 = 0"), lambda rows: rows.write.parquet(folder))
    return spark.read.parquet(folder).agg(*[F.lit(n).cast("long").alias(k) for k, n in counts.items()], F.count("*").alias("written"))


def _pairs_of(title: str, body: str):
    """A question on each of the first three lines that say something."""
    for k, line in enumerate([x for x in body.split("\n") if len(x) > 20][:3]):
        yield f"What does {title[:20]} say in place {k + 1}?", line, "well" if k == 0 else "user", line[:50]


def q73_seed_pairs(spark, sf_dir):
    """Question-answer pairs of long notices by a table function in a lateral join."""
    notices = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("notice_id"), T.title_of("text").alias("title"), T.body_of("text").alias("body"))
    made = qa.seed_pairs(notices, _pairs_of)
    return made.select("notice_id", "question", F.md5("answer").alias("answer_md5"), "type", "source_span")


def q74_contrastive(spark, sf_dir):
    """An encoder trained on the two halves of whole documents: its loss before and after, and how many more of the halves it had not seen find each other; one row."""
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    docs = _t(spark, sf_dir, "documents").select("doc_id", words.alias("w"), half.alias("h")).filter("h >= 5")
    pairs = docs.select("doc_id", F.array_join(F.slice("w", F.lit(1), F.col("h")), " ").alias("query"), F.array_join(F.slice("w", F.col("h") + 1, F.size("w") - F.col("h")), " ").alias("positive"))
    pairs = checkpointed(order.stratified_split(pairs.withColumn("label", F.lit(0)), "label", "doc_id", 10))
    folder, shape = shared_folder(spark), contrastive.Shape(features=1024, size=16, rounds=15)
    # equal ones are told by a hash: the bounds of ranges, which are found on the driver, are no whole texts
    train = pairs.filter("split = 'train'").withColumn("same", F.sha2("positive", 256))
    losses = contrastive.train(order.round_robin(train, "same", "doc_id"), folder, shape)
    ends = losses.agg(F.round(F.max_by("loss", -F.col("round")), 3).alias("loss_before"), F.round(F.max_by("loss", "round"), 3).alias("loss_after"))
    held = pairs.filter("split = 'eval'")

    def found(weights, name):
        rows = checkpointed(held.select(F.col("doc_id").alias("id"), contrastive.encode("query", weights).alias("q"), contrastive.encode("positive", weights).alias("p")))
        best = search.nearest(rows.select("id", F.col("p").alias("v")), rows.select("id", F.col("q").alias("v")), 1, "id", "id", "v")
        return best.agg(F.count_if(F.col("query_id") == F.col("id")).alias(name))

    before, after = found(contrastive.start(shape), "found_before"), found(contrastive.load(spark, folder), "found_after")
    return ends.crossJoin(before).crossJoin(after).crossJoin(held.agg(F.count("*").alias("held_out")))  # one row each


def q75_lenient_lines(spark, sf_dir):
    """JSON lines some of which are broken or lack their key: those are left out."""
    folder, key = shared_folder(spark), F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"doc_id": '), key, F.lit(', "lang": "'), "lang", F.lit('"}'))
    keyless = F.concat(F.lit('{"lang": "'), "lang", F.lit('"}'))
    lines = F.when(F.col("doc_id") % 7 == 0, F.substring(whole, 1, 12)).when(F.col("doc_id") % 11 == 0, keyless).otherwise(whole)
    _t(spark, sf_dir, "documents").select(lines.alias("value")).write.text(folder)
    return files.read_json_lines(spark, folder, "doc_id long, lang string", required="doc_id")


def q76_summaries(spark, sf_dir):
    """Summaries by a model that fails for some prompts, which get their first sentences instead."""
    said = models.summarize(T.title_of("text"), T.body_of("text"), standins.DigestModel("***"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(said).alias("summary_md5"))


def q77_embedded(spark, sf_dir):
    """Places of documents' vectors that are not zero, and their signs."""
    vector = models.embed("text")
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(vector).alias("place", "value"))
    return rows.filter("value <> 0").select("doc_id", "place", F.signum("value").cast("int").alias("sign"))


def q78_saved_classifier(spark, sf_dir):
    """What a classifier that was saved and loaded says, beside what it said before."""
    rows = training.classify_dataset(_t(spark, sf_dir, "documents").select("doc_id", T.title_of("text").alias("title"), T.body_of("text").alias("body"), F.col("lang").alias("category")), ["en", "fr", "de", "es"], keep=("doc_id",))
    folder, model = shared_folder(spark), models.train_text_classifier(rows)
    models.save_classifier(model, ["en", "fr", "de", "es"], folder)
    first = models.predicted_category(rows, (model, ["en", "fr", "de", "es"]), F.lit("none"))
    again = models.predicted_category(rows, models.load_classifier(spark, folder), F.lit("none"))
    both = first.select("doc_id", F.col("category").alias("before")).join(again.select("doc_id", F.col("category").alias("after")), "doc_id")
    return both.select("doc_id", (F.col("before") == F.col("after")).alias("same"))


def q79_first_pdf_pages(spark, sf_dir):
    """The text of the first ten pages of PDF files."""
    pdf = _t(spark, sf_dir, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.translate(F.coalesce("text", F.lit("")), "\n", "\f").cast("binary").alias("content"))
    return pages.recognised(pdf, standins.PlainEngine(), 10).select("path", F.md5("text").alias("text_md5"))


def _topk_sql(k: int, columns: str) -> str:
    from tesserae.plans.catalog import _hybrid_sql

    return _hybrid_sql(f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS INTEGER) AS rank FROM lex) WHERE rank <= {k}", items="")


def _many_sql() -> str:
    from tesserae.plans.catalog import _BODY, _TITLE

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = [(w, c) for c, ws in MANY.keywords.items() for w in ws]
    table = "(VALUES " + ", ".join(f"({quote(w)}, {quote(c)})" for w, c in words) + ") AS k(word, category)"
    return f"""
        WITH d AS (SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents),
        t AS (SELECT doc_id, min(category) AS c FROM d JOIN {table} ON contains(title, word) GROUP BY doc_id),
        b AS (SELECT doc_id, min(category) AS c FROM d JOIN {table} ON contains(body, word) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN starts_with(title, 'The') THEN 'articles' ELSE coalesce(t.c, b.c, 'other') END AS category FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id)"""


def oracle_sql(catalog_sql) -> dict[str, str]:
    """catalog_sql: the SQL of a query of the catalogue."""
    from tesserae.plans.catalog import _BODY, _STRIP, _TITLE, _WS, _category_sql

    arriving = f"""
        s AS (SELECT max(doc_id) // {_BATCHES} + 1 AS size FROM documents),
        a AS (SELECT doc_id // size AS epoch, {_TITLE} AS title, {_BODY} AS body, 'http://h.org/' || CASE WHEN doc_id % 4 = 0 THEN doc_id % size ELSE doc_id END AS url, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS date FROM documents, s),
        first AS (SELECT *, date AS doc_id FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY date) = 1)"""
    return {
        "q62_blockmax_topk": _topk_sql(10, "query_id, rank, doc_id, round(bm25, 6) AS bm25"),
        "q64_compacted_index": _topk_sql(1, "query_id, doc_id, round(bm25, 6) AS bm25"),
        "q80_indexed_search": catalog_sql("q06_multi_query_search"),
        "q63_kept_statistics": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)
            SELECT term, count(*) AS df, 0::BIGINT AS total FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term UNION ALL SELECT '', count(*), CAST(sum(len(w)) AS BIGINT) FROM w""",
        "q65_cells_exact": """
            WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(r.e, r.e))) AS s FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 10""",
        "q67_upsert_in_place": "SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN 'v2 ' || text ELSE text END) AS text_md5 FROM documents WHERE doc_id % 11 <> 0",
        "q68_co_located_join": "SELECT doc_id, lang, n_chars, label, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm FROM documents JOIN embeddings ON doc_id = vec_id",
        "q69_index_new": f"""
            WITH {arriving}, c AS ({_category_sql("SELECT doc_id, title, body FROM first")})
            SELECT url, date, category, epoch, md5('Title: ' || title || chr(10) || chr(10) || body) AS document_md5 FROM first JOIN c USING (doc_id)""",
        "q70_resumed_crawl": """
            WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
            r AS (SELECT o_orderkey, d, row_number() OVER (ORDER BY d DESC, o_orderkey) - 1 AS p FROM o),
            i AS (SELECT CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderkey % 89 <> 0 THEN d END AS date, p // 50 + 1 AS page, p FROM r),
            e AS (SELECT coalesce(min(p), 9223372036854775807) AS e FROM i WHERE date < (SELECT printf('%04d', CAST(max(substr(date, 1, 4)) AS INTEGER) - 1) FROM i))
            SELECT url, date, page FROM i, e WHERE p < e""",
        "q71_many_keywords": _many_sql(),
        "q72_counted_crawl": """
            WITH p AS (SELECT url, CASE WHEN page_id % 7 <> 0 THEN html END AS body, page_id FROM pages), d AS (SELECT DISTINCT url FROM p WHERE page_id % 3 = 0),
            m AS (SELECT p.*, d.url IS NULL AS new FROM p LEFT JOIN d USING (url))
            SELECT count(*) FILTER (WHERE new) AS new, count(*) FILTER (WHERE NOT new) AS skipped, count(*) FILTER (WHERE new AND trim(coalesce(body, '')) = '') AS empty, count(*) FILTER (WHERE new) AS written FROM m""",
        "q75_lenient_lines": "SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0",
        "q76_summaries": rf"""
            WITH d AS (SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents),
            s AS (SELECT *, title || chr(10) || chr(10) || substr(body, 1, 512) AS prompt, list_filter(list_transform(regexp_split_to_array(body, '[.!?。]{_WS}*'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: length(x) > 10) AS p FROM d)
            SELECT doc_id, md5(CASE WHEN NOT contains(prompt, '***') THEN 'Reply ' || md5(prompt) || ' ' WHEN len(p) > 0 THEN array_to_string(p[1:2], '. ') || '.' ELSE substr(body, 1, 150) END) AS summary_md5 FROM s""",
        "q77_embedded": r"""
            WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))) AS h FROM documents),
            p AS (SELECT doc_id, CAST(CAST('0x' || substr(h, 1, 2) AS INTEGER) % 64 AS INTEGER) AS place, CASE WHEN CAST('0x' || substr(h, 15, 2) AS INTEGER) >= 128 THEN 1 ELSE -1 END AS v FROM w)
            SELECT doc_id, place, CAST(sign(sum(v)) AS INTEGER) AS sign FROM p GROUP BY doc_id, place HAVING sum(v) <> 0""",
        "q78_saved_classifier": "SELECT doc_id, true AS same FROM documents",
        "q79_first_pdf_pages": rf"""
            WITH t AS (SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:10], ' ') AS t FROM documents), s AS (SELECT doc_id, regexp_replace(t, {_STRIP}, '', 'g') AS t FROM t)
            SELECT '/d/' || doc_id || '.pdf' AS path, md5(t) AS text_md5 FROM s WHERE t <> ''""",
        "q73_seed_pairs": f"""
            WITH n AS (SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents),
            l AS (SELECT doc_id, title, list_filter(string_split(body, chr(10)), lambda x: length(x) > 20)[1:3] AS l FROM n WHERE length(body) > 300),
            u AS (SELECT doc_id, title, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM l)
            SELECT doc_id AS notice_id, 'What does ' || substr(title, 1, 20) || ' say in place ' || k || '?' AS question, md5(line) AS answer_md5, CASE WHEN k = 1 THEN 'well' ELSE 'user' END AS type, substr(line, 1, 50) AS source_span FROM u""",
    }


QUERIES = {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit() and callable(f)}
