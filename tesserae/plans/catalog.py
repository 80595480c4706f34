"""The engine's queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import images, models, order, profiles, qa, rules, search, training
from tesserae.operators.order import shared_folder
from tesserae.plans import standins, stored
from tesserae.sources import files, pages
from tesserae.streaming import monitor

#: Neutral rules for the queries; real boards bring their own.
RULES = rules.Rules({"The": "articles", "Les": "articles"}, {"verbs": ["tion ", "mente"], "nouns": ["heit", "keit", "eaux"], "marks": ["###", "!!"]})
LABELS = ["en", "fr", "de"]
TITLE_WORDS = ("The", "La", "Der", "Les")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark, sf_dir, item: int = 0):
    text = _t(spark, sf_dir, "benchmark").filter(F.col("item_id") == item).select(F.col("item_id").alias("query_id"), "text")
    vector = _t(spark, sf_dir, "embeddings").filter(F.col("vec_id") == item).select(F.col("embedding").alias("q"))
    return text, vector


def _hybrid(spark, sf_dir, lang=None):
    docs = files.scan(_t(spark, sf_dir, "documents").withColumnRenamed("lang", "category"), lang).withColumnRenamed("category", "lang")
    text, vector = _query(spark, sf_dir)
    hits = search.hybrid_search(docs, _t(spark, sf_dir, "embeddings"), text, vector)
    return docs, hits


def _with_lang(docs, hits):
    return docs.join(F.broadcast(hits), docs["doc_id"] == hits["id"]).select("rank", "doc_id", "lang", F.round("score", 4).alias("score"))


def q01_hybrid_search(spark, sf_dir):
    return _with_lang(*_hybrid(spark, sf_dir))


def _bm25(spark, sf_dir, lang=None):
    docs = _t(spark, sf_dir, "documents")
    docs = docs.filter(F.col("lang") == lang) if lang else docs
    text, _ = _query(spark, sf_dir)
    scored = search.bm25(docs, search.query_terms(text, "query_id", "text"))
    return docs.select("doc_id").join(scored, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25"))


def q02_bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir)


def q03_bm25_filtered(spark, sf_dir):
    return _bm25(spark, sf_dir, "en")


def q04_vector_topk(spark, sf_dir):
    _, vector = _query(spark, sf_dir)
    top = search.cosine(_t(spark, sf_dir, "embeddings"), vector).orderBy(F.desc("similarity"), "vec_id").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")).alias("rank"), "vec_id", F.round("similarity", 6).alias("score"))


def q05_hybrid_search_filtered(spark, sf_dir):
    return _with_lang(*_hybrid(spark, sf_dir, "en"))


def q06_multi_query_search(spark, sf_dir):
    queries = _t(spark, sf_dir, "benchmark").join(_t(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    found = search.multi_query_search(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings"), queries)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def q07_recommend(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(_t(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "embedding")
    _, vector = _query(spark, sf_dir, 1)
    return search.recommend(rows, vector, ["fr", "de"]).select("rank", F.col("id").alias("doc_id"), "category", F.round("score", 4).alias("score"))


def q08_summarize_extractive(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.extractive_summary(F.coalesce("text", F.lit(""))).alias("summary"))


def q09_tokenize_stats(spark, sf_dir):
    n = F.size(T.tokenize("text"))
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).cast("long").alias("tokens"), F.round(F.avg(n), 4).alias("mean_tokens"), F.max(n).cast("long").alias("most"))


def q10_clean_title(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.clean_title(T.title_of("text"), TITLE_WORDS, ("NEW", "hot", ".")).alias("title"))


def q11_clean_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.clean_url("url", ("ref",)).alias("url"))


def q12_doc_id_md5(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("doc_id"))


def _categorised(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", rules.infer_category(RULES, T.title_of("text"), T.body_of("text")).alias("category"))


def q13_infer_category(spark, sf_dir):
    return _categorised(spark, sf_dir)


def q14_category_counts(spark, sf_dir):
    return _categorised(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def q15_html_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


def q15b_html_text(spark, sf_dir):
    """Text of whole pages and their image and PDF lists, by the parser."""
    body = pages.bodies(_t(spark, sf_dir, "pages").select("url", "html").distinct())
    return body.select("url", "text", F.size("images").alias("n_images"), F.size("pdfs").alias("n_pdfs"))


def q16_upsert_index(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("doc_id"), F.col("doc_id").alias("n"), "text", "lang")
    changed = docs.filter("lang = 'fr'").withColumn("text", F.concat(F.lit("v2 "), "text"))
    again = changed.withColumn("text", F.concat(F.lit("v3 "), "text")).withColumn("at", F.lit(2))
    out = files.upsert(docs, changed.withColumn("at", F.lit(1)).unionByName(again), "doc_id", "at")
    return out.select("doc_id", F.md5("text").alias("text_md5"))


def q17_resume_unprocessed(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    left = files.unseen(docs, _t(spark, sf_dir, "labels"), "doc_id")
    return files.unseen(left, docs.filter("false"), "text", "doc_id").select("doc_id")


def q18_positional_join(spark, sf_dir):
    docs = order.with_position(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    turns = order.with_position(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return turns.join(docs, "position").select("conv_id", "turn", "doc_id")


def q19_listing_prefix_stop(spark, sf_dir):
    items = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    keyed = items.withColumn("newest", F.datediff(F.lit("2100-01-01"), F.to_date("date")))
    return pages.until_older(keyed, "2000", "newest", "o_orderkey").select("o_orderkey", "date")


def q20_qa_count_plan(spark, sf_dir):
    body = T.body_of("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.qa_counts(body)["well"].alias("n_well"), T.qa_counts(body)["user"].alias("n_user"), (F.length(body) > 300).alias("eligible"))


def q21_llm_context(spark, sf_dir):
    docs, hits = _hybrid(spark, sf_dir)
    rows = docs.join(F.broadcast(hits), docs["doc_id"] == hits["id"]).select("rank", T.title_of("text").alias("title"), F.lit(None).cast("string").alias("date"), T.body_of("text").alias("body"))
    return search.answer_context(rows)


def _pairs(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    ask = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("at"), F.col("text").alias("answer"))
    # notices that say what is answered, or half of it, or something else
    notice = F.when(F.col("conv_id") % 3 == 0, F.col("answer")).when(F.col("conv_id") % 3 == 1, F.substr("answer", F.lit(1), F.floor(F.length("answer") / 2).cast("int"))).otherwise(F.col("question"))
    return ask.join(reply, ["conv_id", "at"]).withColumn("notice", notice)


def q22_judge_pipeline(spark, sf_dir):
    judged = qa.judge(_pairs(spark, sf_dir), standins.EchoTextModel())
    return judged.select("conv_id", "at", qa.verdict(F.col("hallucination"), F.col("judge_score")).alias("verdict"), "judge_score", "unchecked", "needs_review", F.size("inferred_claims").alias("n_inferred"))


def q23_judge_stats(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    return qa.verdict_stats(labels.withColumn("verdict", qa.verdict(F.col("toxic") == 1, F.when(F.col("quality") == 1, 5).otherwise(2))), skipped=10)


def q24_recall_at_k_mrr(spark, sf_dir):
    return search.retrieval_quality(_t(spark, sf_dir, "embeddings"))


def q25_ordered_distinct_corpus(spark, sf_dir):
    first = _t(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return order.with_position(first, "doc_id", name="corpus_id")


def q26_interleave_batches(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("positive"))
    return order.round_robin(docs, "positive", "doc_id").select("doc_id", "rn", "batch")


def q27_train_eval_split(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    split = order.hashed_split(labels, "doc_id").withColumnRenamed("split", "split_10")
    return order.stratified_split(split, "quality", "doc_id").select("doc_id", "split_10", F.col("split").alias("split_stratified"))


def q28_classify_dataset(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").filter(F.col("lang").isin(*LABELS)).join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    notices = docs.select("doc_id", T.title_of("text").alias("title"), T.body_of("text").alias("body"), F.col("lang").alias("category"))
    return training.classify_dataset(notices, LABELS, keep=("doc_id",))


def q29_classify_train_predict(spark, sf_dir):
    rows = order.stratified_split(q28_classify_dataset(spark, sf_dir), "label", "doc_id")
    model = models.train_text_classifier(rows.filter("split = 'train'"))
    return model.transform(rows.filter("split = 'eval'")).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


def q30_ocr_tiles(spark, sf_dir):
    tiles = pages.ocr_tiles(F.col("n_chars").cast("int"))
    return _t(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", F.posexplode(tiles).alias("tile", "t")).select("doc_id", "tile", "t.top", "t.bottom")


def q31_parse_json_repair(spark, sf_dir):
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit(" thank you"))).otherwise(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", T.parsed_json(reply, "k long")["k"].alias("k"))


def q32_first_turn_flag(spark, sf_dir):
    turns = order.first_turns(_t(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "is_first", F.concat(search.greeting(F.col("role"), F.col("is_first")), "text").alias("greeting"))


def q33_image_filter_ocr_clean(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.JPG", "logo.png", "x.gif?v=1", "scan.tiff", "photo", "p.pdf?a=.png"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.is_text_image(name).alias("wanted"), T.image_format(name).alias("format"), F.md5(T.clean_ocr("text")).alias("clean_md5"))


def q34_stream_dedup(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    seen = monitor.run_to_table(monitor.first_seen(stream.select("user_id", "ts"), "user_id", "ts", "30 days"), shared_folder(spark), shared_folder(spark))
    return seen.select("user_id")


def q35_resume_jsonl(spark, sf_dir):
    """Half of the rows are written first, the rest by a second run that skips what is done."""
    folder = shared_folder(spark)
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    files.append_json_lines(docs.filter("doc_id % 2 = 0"), folder)
    done = order.checkpointed(files.read_json_lines(spark, folder, "doc_id long, text_md5 string", required="doc_id"))
    files.append_json_lines(files.unseen(docs, done, "doc_id"), folder)
    return files.read_json_lines(spark, folder, "doc_id long, text_md5 string", strict=True)


def q36_ann_lsh(spark, sf_dir):
    """Recall of neighbours by random projections against exact search, for the vectors whose id is divisible by 50: one row (queries, neighbours, found, recall)."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.filter("vec_id % 50 = 0")
    near = search.nearest_in_buckets(rows, queries, 10, "vec_id").select("query_id", "id", F.lit(1).alias("hit"))
    exact = search.nearest(rows, queries, 11, "vec_id", "vec_id").filter("query_id <> id")
    exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter("place <= 10")
    both = exact.join(near, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.try_divide(F.count("hit").cast("double"), F.count("*")), 4).alias("recall"))


def q37_crawl_counts(spark, sf_dir):
    found = _t(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("body"), "page_id")
    return pages.crawl_counts(found, found.filter("page_id % 3 = 0"))


def q38_compare_models(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return search.compare_models({"whole": rows, "half": rows.withColumn("embedding", F.slice("embedding", 1, 32))})


def q39_first_rows_split(spark, sf_dir):
    train, held = order.first_rows_split(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return train.select("doc_id", F.lit("train").alias("split")).union(held.select("doc_id", F.lit("eval")))


def q40_seed_questions(spark, sf_dir):
    notices = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("notice_id"), T.title_of("text").alias("title"), T.body_of("text").alias("body"))
    return qa.seed_questions(notices).groupBy("type").agg(F.count("*").alias("n"))


def q41_index_scan(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(T.title_of("text").alias("title"), F.col("doc_id").cast("string").alias("url"), F.lit("2026").alias("date"), T.body_of("text").alias("body"), F.col("lang").alias("category"))
    return files.scan(files.index_records(rows), "de").select("doc_id", "category", F.md5("document").alias("document_md5"))


HOST = "http://h.org"


def _order_rows(spark, sf_dir):
    """Orders as items of a listing, newest first, 50 on a page; every 97th is pinned, every 89th has no date."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    placed = order.with_position(rows.withColumn("newest", F.datediff(F.lit("2100-01-01"), F.to_date("date"))), "newest", "o_orderkey")
    return placed.withColumn("page", F.floor(F.col("position") / 50) + 1)


def _listing(rows, board):
    """Pages (page, html) of a board with these items."""
    key = F.col("o_orderkey").cast("string")
    pinned = F.col("o_orderkey") % 97 == 0
    own = board.pinned == "own"
    title = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "학사  The order ").otherwise("Order "), key, F.lit(" 새글"))
    cells = F.concat(
        F.lit(f'<td class="{board.title}">'), F.when(pinned, "" if own else '<b class="notice">!</b>').otherwise(""), F.lit('<a href="/v?id='), key, F.lit('&amp;layout=x">'), title, F.lit("</a></td>"),
        F.when(F.col("o_orderkey") % 89 == 0, "").otherwise(F.concat(F.lit(f'<td class="{board.date}"> '), "date", F.lit(" </td>"))),
    )
    row = F.concat(F.when(pinned & F.lit(own), '<tr class="row notice">').otherwise("<tr>"), cells, F.lit("</tr>"))
    html = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    return html.select("page", F.concat(F.lit("<table class='board-table'><tr><th>Title</th></tr>"), "rows", F.lit("</table>")).alias("html"))


def q42_crawl_all(spark, sf_dir):
    """The newest year of a listing with the bodies and categories of its items."""
    rows = _order_rows(spark, sf_dir)
    key = F.col("o_orderkey").cast("string")
    posts = rows.filter("o_orderkey % 3 = 0").select(F.concat(F.lit(f"{HOST}/v?id="), key).alias("url"), F.concat(F.lit("<h1>x</h1><div class='txt'><p>Station "), key, F.lit("</p><p> of the line<script>1</script></div><p>y")).alias("html"))
    year = rows.agg(F.max(F.substring("date", 1, 4))).first()[0] or ""
    return pages.crawl_all(_listing(rows, pages.Board()), posts, year, RULES, pages.Board(host=HOST, labels=("학사",)), "txt")


def q43_listing_variants(spark, sf_dir):
    """Items of two other kinds of listing: pinned rows by a class inside, plain titles and URLs."""
    rows = _order_rows(spark, sf_dir)
    own, inside = pages.Board(host=HOST), pages.Board("title", "date", "descendant", host=HOST)
    found = [pages.listing_items(_listing(rows, b), b, clean=False).withColumn("variant", F.lit(v)) for v, b in (("own", own), ("inside", inside))]
    return found[0].unionByName(found[1]).select("variant", "page", "position", "title", "url", "date")


def _posts(spark, sf_dir):
    """Documents as posts with images and files."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    key = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<h1>before</h1><div class="txt box"><!-- c --><p>'), text, F.lit('</p><style>p{}</style><img src="/i/'), key, F.lit('.png"><img src="/img/LOGO.png"><img src="http://o.org/x.gif?a=1"><a href="/download/'), key, F.lit('"> Plan.PDF </a><a href="/download/x">more</a></div><p>after'))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), key).alias("url"), html.alias("html"), "text")


def q44_post_bodies(spark, sf_dir):
    found = pages.bodies(_posts(spark, sf_dir), "txt", HOST)
    return found.select("url", F.md5("text").alias("text_md5"), F.array_join("images", " ").alias("images"), F.array_join("pdfs", " ").alias("pdfs"))


def q45_full_bodies(spark, sf_dir):
    """Posts with the text of their PDF files; their images are too small to be read."""
    posts = _posts(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    pdf = posts.select(F.concat(F.lit(f"{HOST}/download/"), key).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    image = posts.select(F.concat(F.lit(f"{HOST}/i/"), key, F.lit(".png")).alias("path"), F.concat(F.lit("P5 50 20 255\n"), F.repeat(F.lit("x"), F.lit(1000))).cast("binary").alias("content"))
    found = pages.full_bodies(posts, pdf.unionByName(image), standins.PlainEngine(), "txt", HOST)
    return found.select("url", F.md5("body").alias("body_md5"))


def q46_json_array(spark, sf_dir):
    """Documents written as JSON arrays and read again."""
    folder = shared_folder(spark)
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    files.write_json(docs, folder)
    files.write_json(docs, folder)  # replaces the first
    return files.read_json_array(spark, folder, "doc_id long, text string, lang string, source string").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


def _notices(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return _t(spark, sf_dir, "documents").select("doc_id", T.title_of("text").alias("title"), key.alias("url"), F.lit("2026").alias("date"), T.body_of("text").alias("body"), F.col("lang").alias("category"))


def q47_index_guard(spark, sf_dir):
    """Rows of the index before it is made, after, and after it is to be made again of fewer notices."""
    folder, notices = shared_folder(spark), _notices(spark, sf_dir).drop("doc_id")
    before = order.checkpointed(files.open_index(spark, folder).agg(F.count("*").alias("n")).select(F.lit("before").alias("step"), "n"))
    made = files.ensure_index(spark, folder, notices).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).select(F.lit("made").alias("step"), "n")
    kept = files.ensure_index(spark, folder, notices.limit(1)).agg(F.count("*").alias("n")).select(F.lit("kept").alias("step"), "n")
    return before.unionByName(made).unionByName(kept)


def q48_accuracy(spark, sf_dir):
    """How well the length of a text tells its quality."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return training.accuracy(rows.withColumn("prediction", (F.length("text") > 500).cast("int")), "quality")


def q49_profiles(spark, sf_dir):
    """Customers as profiles, nations as tracks, regions as colleges."""
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("r_name")).alias("college"), F.col("n_name").alias("track"), F.array("c_mktsegment", F.lit("exchange")).alias("interests"))
    homes = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("track"), F.concat(F.lit("http://"), F.lower("n_name")).alias("url"))
    found = profiles.looked_up(people, nation.select(F.col("r_name").alias("college"), F.col("n_name").alias("track")), homes)
    options = profiles.interest_options(["BUILDING", "MACHINERY"], "exchange", "BUILDING")
    query = search.profile_text(F.col("college"), F.col("track"), F.lit("2"), F.col("interests"))
    return found.select("c_custkey", F.array_join("tracks", ",").alias("tracks"), "homepage", query.alias("query"), F.size(F.array_intersect("interests", options)).alias("n_known"))


def q50_corpus_ids(spark, sf_dir):
    pairs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), T.title_of("text").alias("query"), F.col("text").alias("positive"))
    return training.corpus_ids(pairs).select(F.col("position").alias("doc_id"), "corpus_id")


def q51_answers(spark, sf_dir):
    """Answers to all benchmark questions, of a stand-in model that gives a digest of its prompt; some have no hits, and one makes the model fail."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    asked = items.join(_t(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    found = search.multi_query_search(docs, _t(spark, sf_dir, "embeddings"), asked).filter("query_id % 5 <> 4")
    notices = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("url"), T.title_of("text").alias("title"), T.body_of("text").alias("body"))
    hits = found.join(notices.select("id", "url", "title"), "id").withColumn("date", F.lit("2026"))
    item = F.col("item_id")
    questions = items.select(item.alias("query_id"), F.col("text").alias("question"), F.when(item % 2 == 1, F.concat(F.lit("N"), item.cast("string"))).alias("name"), (item % 3 == 0).alias("is_first"))
    return search.answers(questions, hits, notices.select("url", "body"), standins.DigestModel("Hello N3."))


def q52_first_long_notices(spark, sf_dir):
    return qa.first_long(_notices(spark, sf_dir), "doc_id").select("doc_id", F.md5(qa.format_notice(F.col("title"), F.col("date"), F.col("category"), F.col("body"))).alias("text_md5"))


def q53_bm25_of_postings(spark, sf_dir):
    """Postings that are written, brought up to date after an upsert, and searched."""
    docs, folder = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), shared_folder(spark)
    older = docs.withColumn("text", F.when(F.col("lang") == "fr", "an older text").otherwise(F.col("text")))
    search.postings(older).write.parquet(f"{folder}/old")
    changed = docs.filter("lang = 'fr'")
    search.replaced_postings(spark.read.parquet(f"{folder}/old"), changed).write.parquet(f"{folder}/new")
    text, _ = _query(spark, sf_dir)
    scored = search.bm25_of(spark.read.parquet(f"{folder}/new"), search.query_terms(text, "query_id", "text"))
    return docs.select("doc_id").join(scored, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25"))


def q54_image_gate(spark, sf_dir):
    height, width = (F.col("n_chars") % 3000).cast("int"), (F.col("doc_id") % 300).cast("int")
    docs = _t(spark, sf_dir, "documents").filter("n_chars is not null")
    return docs.select("doc_id", pages.large_enough(height, width).alias("large"), F.size(pages.ocr_tiles(height)).alias("n_tiles"))


def q55_profile_cache(spark, sf_dir):
    """A profile that is written, replaced, read and removed."""
    path = shared_folder(spark)
    one = spark.createDataFrame([("Kim", "IT", "Web", "2", ["a", "b"])], files.PROFILE)
    files.write_profile(one, path)
    files.write_profile(one.withColumn("grade", F.lit("3")), path)
    kept = order.checkpointed(files.read_profile(spark, path).select("name", "grade", F.array_join("interests", ",").alias("interests")))
    files.delete_profile(spark, path)
    return kept.unionByName(files.read_profile(spark, path).agg(F.count("*").cast("string").alias("grade")).select(F.lit("rows after").alias("name"), "grade", F.lit("").alias("interests")))


def q56_tokenized(spark, sf_dir):
    rows = models.tokenized(_t(spark, sf_dir, "documents").select("doc_id", "text"), length=64)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("doc_id", F.size("input_ids").alias("length"), total("attention_mask").alias("n_real"), total("input_ids").alias("sum_of_ids"))


def q57_enough_rows(spark, sf_dir):
    """Whether tables have enough rows to train and to evaluate, and one more than they have."""
    rows = []
    for name in ("labels", "benchmark", "region"):
        table = _t(spark, sf_dir, name)
        rows.append((name, training.enough(table, training.LEAST_TRAIN), training.enough(table, training.LEAST_EVAL), training.enough(table, table.count() + 1)))
    return spark.createDataFrame(rows, "name string, train boolean, eval boolean, more boolean")


def q58_prompt_parts(spark, sf_dir):
    """Numbered claims, waiting times, elapsed times."""
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("429: retryDelay: "), (F.col("doc_id") % 50).cast("string"), F.lit("s"))).otherwise("429")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.numbered(T.sentences(F.coalesce("text", F.lit(""))))).alias("numbered_md5"), T.retry_delay(said).alias("wait"), T.elapsed("doc_id").alias("elapsed"))


def q59_training_pairs(spark, sf_dir):
    """Questions and answers that passed the judge."""
    return qa.training_pairs(qa.judge(_pairs(spark, sf_dir), standins.EchoTextModel()))


def q60_base64(spark, sf_dir):
    """Files of a folder, and documents as files, in base64."""
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.as_base64(rows).select("path", F.md5("base64").alias("base64_md5"))


def q61_classified(spark, sf_dir):
    """Categories by a model that knows some texts, by rules where it says nothing, and "other" where it names none of the labels."""
    title, body = T.title_of("text"), T.body_of("text")
    found = models.classify(title, body, rules.infer_category(RULES, title, body), ["nouns", "short"], standins.LengthModel())
    return _t(spark, sf_dir, "documents").select("doc_id", found.alias("category"))


_HYBRID = """
    docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents {filter}),
    tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM docs),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tok) GROUP BY term),
    idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS v FROM df, st),
    idf AS (SELECT term, CASE WHEN v < 0 THEN (SELECT 0.25 * avg(v) FROM idf0) ELSE v END AS idf FROM idf0),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark {items}) GROUP BY ALL),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    lex AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25 FROM tf JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
    qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (SELECT query_id FROM q)),
    sims AS (SELECT query_id, doc_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q))) AS s FROM docs JOIN embeddings ON doc_id = vec_id, qv),
    cand AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 10),
    vec AS (SELECT query_id, doc_id, (s - min(s) OVER (PARTITION BY query_id)) / (max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id) + 1e-9) AS v FROM cand),
    sc AS (SELECT query_id, doc_id, bm25 / CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN max(bm25) OVER (PARTITION BY query_id) ELSE 1 END AS b FROM lex),
    fused AS (SELECT query_id, doc_id, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(b, 0), 10) AS score FROM vec FULL JOIN sc USING (query_id, doc_id)),
    best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused)
"""


def _hybrid_sql(select: str, where: str = "", items: str = "WHERE item_id = 0") -> str:
    return "WITH " + _HYBRID.format(filter=where, items=items) + select


_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_STRIP = rf"'^{_WS}+|{_WS}+$'"
_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
_BODY = "CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"
_BM25 = "SELECT d.doc_id, round(coalesce(bm25, 0), 6) AS bm25 FROM docs d LEFT JOIN lex USING (doc_id)"
_TOP = "SELECT rank, best.doc_id, lang, round(score, 4) AS score FROM best JOIN docs USING (doc_id) WHERE rank <= 5"


def _category_sql(rows: str = "", key: str = "doc_id") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = [f"WHEN starts_with(title, {quote(p)}) THEN {quote(c)}" for p, c in RULES.prefixes.items()]
    for field in ("title", "body"):
        whens += [f"WHEN {' OR '.join(f'contains({field}, {quote(w)})' for w in words)} THEN {quote(c)}" for c, words in RULES.keywords.items()]
    return f"SELECT {key}, CASE {' '.join(whens)} ELSE {quote(RULES.default)} END AS category FROM ({rows or f'SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents'})"


def _quality_sql(vector: str) -> str:
    return f"""
        WITH v AS (SELECT vec_id, label, CAST({vector} AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS q, b.vec_id AS c, a.label = b.label AS rel, round(list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-9) * (sqrt(list_inner_product(b.e, b.e)) + 1e-9)), 12) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM s),
        f AS (SELECT v.vec_id, min(rank) FILTER (WHERE rel) AS rank FROM v LEFT JOIN r ON q = vec_id GROUP BY v.vec_id)
        SELECT 'Recall@' || k AS metric, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 4) AS value FROM f, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k
        UNION ALL SELECT 'MRR', round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) FROM f"""


_JUDGED = rf"""
    turns AS (SELECT a.conv_id, a.turn AS "at", a.text AS question, r.text AS answer FROM conversations a JOIN conversations r ON a.conv_id = r.conv_id AND r.turn = a.turn + 1 WHERE a.role = 'user' AND r.role = 'assistant'),
    pairs AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN answer WHEN 1 THEN substr(answer, 1, CAST(floor(length(answer) / 2) AS INTEGER)) ELSE question END AS notice FROM turns),
    claims AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]{_WS}*'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: length(x) > 10)[1:3] AS claims FROM pairs),
    verified AS (SELECT *, list_filter(claims, lambda c: NOT contains(notice, c) AND length(c) % 3 <> 0) AS inferred, list_filter(claims, lambda c: NOT contains(notice, c) AND length(c) % 3 = 0) AS wrong FROM claims),
    judged AS (SELECT *, len(wrong) > 0 AS hallucination, len(claims) = 0 AS unchecked, len(claims) > 0 AND len(inferred) / greatest(len(claims), 1) > 0.2 AS needs_review,
        CASE WHEN len(wrong) > 0 THEN 0 ELSE 1 + (length(question) + length(answer) + length(notice) + 2) % 5 END AS judge_score FROM verified)
"""
_LISTED = """
    o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY date DESC, o_orderkey) - 1 AS p FROM o),
    l AS (SELECT *, p // 50 + 1 AS page, o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AS listed FROM r)
"""
_PROMPT = """'Answer the question from these notices in two or three sentences. Name dates, amounts and conditions.' || chr(10) || 'Begin with: ' || CASE WHEN hello <> '' THEN hello ELSE '(no greeting)' END
    || chr(10) || chr(10) || 'Notices:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || question"""


ORACLE_SQL = {
    "q01_hybrid_search": _hybrid_sql(_TOP),
    "q02_bm25_scores": _hybrid_sql(_BM25),
    "q03_bm25_filtered": _hybrid_sql(_BM25, "WHERE lang = 'en'"),
    "q04_vector_topk": """
        WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
        s AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q))) AS s FROM embeddings, q),
        r AS (SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "q05_hybrid_search_filtered": _hybrid_sql(_TOP, "WHERE lang = 'en'"),
    "q06_multi_query_search": _hybrid_sql("SELECT query_id, rank, doc_id, round(score, 4) AS score FROM best WHERE rank <= 5", items="WHERE item_id IN (SELECT vec_id FROM embeddings)"),
    "q07_recommend": """
        WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1),
        s AS (SELECT doc_id, lang AS category, list_inner_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q, q))) AS s FROM documents JOIN embeddings ON doc_id = vec_id, q),
        t AS (SELECT *, round(s, 4) + CASE WHEN category IN ('fr', 'de') THEN 0.05 ELSE 0 END AS b FROM s ORDER BY s DESC, doc_id LIMIT 5)
        SELECT CAST(row_number() OVER (ORDER BY least(b, 1.0) DESC, s DESC, doc_id) AS INTEGER) AS rank, doc_id, category, round(least(b, 1.0), 4) AS score FROM t""",
    "q08_summarize_extractive": rf"""
        WITH s AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?。]{_WS}*'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: length(x) > 10) AS p FROM documents)
        SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], '. ') || '.' ELSE substr(text, 1, 150) END AS summary FROM s""",
    "q09_tokenize_stats": r"""
        SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 4) AS mean_tokens, max(n) AS most
        FROM (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS n FROM documents) GROUP BY lang""",
    "q10_clean_title": rf"""
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TITLE}, '[\r\n]', ' ', 'g'), '{_WS}{{2,}}', ' ', 'g'), {_STRIP}, '', 'g'),
            '^(?:The|La|Der|Les){_WS}*', ''), {_STRIP}, '', 'g'), '(?i){_WS}*(?:NEW|hot|\.){_WS}*$', ''), {_STRIP}, '', 'g') AS title FROM documents""",
    "q11_clean_url": """
        WITH p AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS path, CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#')) ELSE '' END AS fragment,
            list_filter(string_split(substr(split_part(url, '#', 1), CASE WHEN strpos(split_part(url, '#', 1), '?') > 0 THEN strpos(url, '?') + 1 ELSE length(url) + 1 END), '&'),
                lambda x: strpos(x, '=') > 0 AND split_part(x, '=', 2) <> '' AND split_part(x, '=', 1) <> 'ref') AS kept FROM pages)
        SELECT page_id, path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || CASE WHEN fragment = '#' THEN '' ELSE fragment END AS url FROM p""",
    "q12_doc_id_md5": "SELECT page_id, md5(url) AS doc_id FROM pages",
    "q13_infer_category": _category_sql(),
    "q14_category_counts": f"SELECT category, count(*) AS n FROM ({_category_sql()}) GROUP BY category",
    "q15_html_extract": r"""
        SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links,
            array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links FROM pages""",
    "q16_upsert_index": "SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_id, md5(CASE WHEN lang = 'fr' THEN 'v3 v2 ' || text ELSE text END) AS text_md5 FROM documents",
    "q17_resume_unprocessed": "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY text",
    "q18_positional_join": """
        WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), c AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS p FROM conversations)
        SELECT conv_id, turn, doc_id FROM c JOIN d USING (p)""",
    "q19_listing_prefix_stop": """
        WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY date DESC, o_orderkey) AS p FROM o)
        SELECT o_orderkey, date FROM r WHERE p < coalesce((SELECT min(p) FROM r WHERE substr(date, 1, 4) < '2000'), 1e18) AND substr(date, 1, 4) = '2000'""",
    "q20_qa_count_plan": f"""
        SELECT doc_id, CAST(CASE WHEN length(b) < 300 THEN 2 ELSE 3 END AS INTEGER) AS n_well, CAST(CASE WHEN length(b) < 300 THEN 1 ELSE 2 END AS INTEGER) AS n_user, length(b) > 300 AS eligible
        FROM (SELECT doc_id, {_BODY} AS b FROM documents)""",
    "q21_llm_context": _hybrid_sql(f"""
        , x AS (SELECT rank, {_TITLE} AS title, substr({_BODY}, 1, 800) AS body FROM best JOIN docs USING (doc_id) WHERE rank <= 3)
        SELECT string_agg('[Notice ' || rank || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Date: ' || chr(10) || 'Body: ' || CASE WHEN body <> '' THEN body ELSE '(no body)' END, chr(10) || chr(10) ORDER BY rank) AS context FROM x"""),
    "q23_judge_stats": """
        WITH c AS (SELECT CAST(count(*) FILTER (WHERE coalesce(toxic, 0) <> 1 AND quality = 1) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS hallucinated,
            CAST(count(*) FILTER (WHERE coalesce(toxic, 0) <> 1 AND coalesce(quality, 0) <> 1) AS BIGINT) AS low, count(*) + 10 AS total FROM labels)
        SELECT *, round(passed * 100.0 / total, 1)::DOUBLE AS passed_rate, round(hallucinated * 100.0 / total, 1)::DOUBLE AS hallucinated_rate, round(low * 100.0 / total, 1)::DOUBLE AS low_rate FROM c""",
    "q24_recall_at_k_mrr": _quality_sql("embedding"),
    "q37_crawl_counts": """
        WITH d AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0), m AS (SELECT p.page_id, d.url IS NULL AS fresh FROM pages p LEFT JOIN d USING (url))
        SELECT count(*) FILTER (WHERE fresh) AS "new", count(*) FILTER (WHERE NOT fresh) AS skipped, count(*) FILTER (WHERE fresh AND page_id % 7 = 0) AS "empty" FROM m""",
    "q38_compare_models": f"SELECT metric, w.value AS whole, h.value AS half FROM ({_quality_sql('embedding')}) w JOIN ({_quality_sql('embedding[1:32]')}) h USING (metric)",
    "q39_first_rows_split": "SELECT doc_id, 'train' AS split FROM labels UNION ALL (SELECT doc_id, 'eval' FROM labels ORDER BY doc_id LIMIT 50)",
    "q41_index_scan": f"SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_id, lang AS category, md5('Title: ' || {_TITLE} || chr(10) || chr(10) || {_BODY}) AS document_md5 FROM documents WHERE lang = 'de'",
    "q25_ordered_distinct_corpus": "SELECT min(doc_id) AS doc_id, row_number() OVER (ORDER BY min(doc_id)) - 1 AS corpus_id FROM documents GROUP BY text",
    "q26_interleave_batches": """
        WITH g AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) AS INTEGER) AS rn, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
        SELECT doc_id, rn, CAST((row_number() OVER (ORDER BY rn, first) - 1) // 64 AS BIGINT) AS batch FROM g""",
    "q27_train_eval_split": """
        WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) - 1 AS p, CAST('0x' || substr(md5(doc_id || '-42-' || quality), 1, 8) AS BIGINT) % 100 AS s FROM labels)
        SELECT doc_id, CASE WHEN p < greatest(50, (SELECT count(*) FROM labels) // 10) THEN 'eval' ELSE 'train' END AS split_10, CASE WHEN s < 10 THEN 'eval' ELSE 'train' END AS split_stratified FROM h""",
    "q28_classify_dataset": f"""
        SELECT doc_id, {_TITLE} || ' ' || substr({_BODY}, 1, 256) AS text, CAST(list_position(['en', 'fr', 'de'], lang) - 1 AS INTEGER) AS label
        FROM documents WHERE lang IN ('en', 'fr', 'de') AND doc_id IN (SELECT doc_id FROM labels)""",
    "q30_ocr_tiles": """
        WITH t AS (SELECT doc_id, CAST(n_chars AS INTEGER) AS h, unnest(range(0, greatest(CAST(n_chars AS INTEGER) - 101, 0) + 1, 1400)) AS top FROM documents WHERE n_chars > 0)
        SELECT doc_id, CAST(top // 1400 AS INTEGER) AS tile, CAST(top AS INTEGER) AS top, CAST(least(top + 1500, h) AS INTEGER) AS bottom FROM t""",
    "q31_parse_json_repair": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "q32_first_turn_flag": """
        WITH f AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_first FROM conversations)
        SELECT conv_id, turn, is_first, CASE WHEN is_first THEN 'Hello ' || role || '. ' ELSE '' END || text AS greeting FROM f""",
    "q33_image_filter_ocr_clean": rf"""
        SELECT doc_id, doc_id % 6 NOT IN (1, 2) AS wanted, ['jpg', 'png', 'jpg', 'tiff', 'jpg', 'pdf'][doc_id % 6 + 1] AS format,
            md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{{2,}}', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}{T.KEPT_MARKS}]', '', 'g'), {_STRIP}, '', 'g')) AS clean_md5 FROM documents""",
    "q34_stream_dedup": "SELECT DISTINCT user_id FROM events",
    "q35_resume_jsonl": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "q22_judge_pipeline": f"""WITH {_JUDGED}
        SELECT conv_id, "at", CASE WHEN hallucination THEN 'hallucinated' WHEN judge_score >= 4 THEN 'passed' ELSE 'low' END AS verdict, CAST(judge_score AS INTEGER) AS judge_score, unchecked, needs_review, CAST(len(inferred) AS INTEGER) AS n_inferred FROM judged""",
    "q40_seed_questions": f"""
        WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents), n AS (SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(body, '[.!?。]{_WS}*'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: length(x) > 10)) AS n FROM b WHERE length(body) > 300),
        q AS (SELECT unnest(range(least(n, 5))) AS i FROM n)
        SELECT CASE WHEN i < 3 THEN 'well' ELSE 'user' END AS type, count(*) AS n FROM q GROUP BY ALL""",
    "q42_crawl_all": f"""
        WITH {_LISTED}, y AS (SELECT max(substr(date, 1, 4)) AS year FROM l),
        stop AS (SELECT coalesce(min(p), 1e18) AS p FROM l, y WHERE listed AND substr(date, 1, 4) <> year AND page >= 5),
        kept AS (SELECT l.* FROM l, y, stop WHERE listed AND substr(date, 1, 4) = year AND l.p < stop.p),
        ends AS (SELECT coalesce(min(page), 1e18) AS page FROM (SELECT DISTINCT page FROM l) WHERE page NOT IN (SELECT page FROM kept)),
        items AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'The order ' ELSE 'Order ' END || o_orderkey AS title, '{HOST}/v?id=' || o_orderkey AS url, date, CASE WHEN o_orderkey % 3 = 0 THEN 'Station ' || o_orderkey || ' of the line' ELSE '' END AS body FROM kept, ends WHERE kept.page < ends.page)
        {_category_sql('SELECT * FROM items', 'title, url, date, body')}""",
    "q43_listing_variants": f"""
        WITH {_LISTED}
        SELECT variant, page, CAST(p % 50 + 1 AS INTEGER) AS position, CASE WHEN o_orderkey % 2 = 0 THEN '학사  The order ' ELSE 'Order ' END || o_orderkey || ' 새글' AS title, '{HOST}/v?id=' || o_orderkey || '&layout=x' AS url, date
        FROM l, (SELECT unnest(['own', 'inside']) AS variant) WHERE listed""",
    "q44_post_bodies": f"""
        SELECT 'u' || doc_id AS url, md5(ltrim(regexp_replace(coalesce(text, ''), {_STRIP}, '', 'g') || ' Plan.PDF more', ' ')) AS text_md5, '{HOST}/i/' || doc_id || '.png' AS images, '{HOST}/download/' || doc_id AS pdfs FROM documents""",
    "q45_full_bodies": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_STRIP}, '', 'g') AS t FROM documents)
        SELECT 'u' || doc_id AS url, md5(ltrim(t || ' Plan.PDF more', ' ') || CASE WHEN t <> '' THEN ' [PDF] ' || t ELSE '' END) AS body_md5 FROM t""",
    "q46_json_array": "SELECT doc_id, md5(text) AS text_md5, lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents",
    "q47_index_guard": "SELECT 'before' AS step, 0 AS n UNION ALL SELECT unnest(['made', 'kept']), (SELECT count(*) FROM documents)",
    "q48_accuracy": "SELECT count(*) AS n, round(avg(CASE WHEN quality = CASE WHEN length(text) > 500 THEN 1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM labels JOIN documents USING (doc_id)",
    "q49_profiles": """
        WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS tracks FROM n GROUP BY r_name)
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'other' ELSE tracks END AS tracks, CASE WHEN n_nationkey % 2 = 0 THEN 'http://' || lower(n_name) END AS homepage,
            CASE WHEN c_custkey % 10 = 0 THEN '' ELSE n.r_name END || ' ' || n_name || ' 2 interests: ' || c_mktsegment || ', exchange' AS query, CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 1 END AS INTEGER) AS n_known
        FROM customer JOIN n ON c_nationkey = n_nationkey JOIN t ON t.r_name = n.r_name""",
    "q50_corpus_ids": "WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, text FROM documents) SELECT doc_id, CASE WHEN text IS NOT NULL THEN dense_rank() OVER (PARTITION BY text IS NULL ORDER BY first) - 1 END AS corpus_id FROM f",
    "q51_answers": _hybrid_sql(
        f""", x AS (SELECT query_id, rank, '[Notice ' || rank || ']' || chr(10) || 'Title: ' || {_TITLE} || chr(10) || 'Date: 2026' || chr(10) || 'Body: ' || CASE WHEN substr({_BODY}, 1, 800) <> '' THEN substr({_BODY}, 1, 800) ELSE '(no body)' END AS block FROM best JOIN docs USING (doc_id) WHERE rank <= 3 AND query_id % 5 <> 4),
        c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM x GROUP BY query_id),
        a AS (SELECT item_id AS query_id, text AS question, CASE WHEN item_id % 6 = 3 THEN 'Hello N' || item_id || '. ' ELSE '' END AS hello, context FROM benchmark LEFT JOIN c ON query_id = item_id)
        SELECT query_id, CASE WHEN context IS NULL THEN '{search.NO_HITS}' WHEN hello = 'Hello N3. ' THEN '[model error] no reply to this prompt' ELSE 'Reply ' || md5({_PROMPT}) END AS reply FROM a""",
        items="WHERE item_id IN (SELECT vec_id FROM embeddings)",
    ),
    "q52_first_long_notices": f"""
        SELECT doc_id, md5('Title: ' || {_TITLE} || chr(10) || 'Date: 2026' || chr(10) || 'Category: ' || lang || chr(10) || 'Body: ' || {_BODY}) AS text_md5 FROM documents WHERE length({_BODY}) > 300 ORDER BY doc_id LIMIT 3""",
    "q53_bm25_of_postings": _hybrid_sql(_BM25),
    "q54_image_gate": "SELECT doc_id, n_chars % 3000 >= 30 AND doc_id % 300 >= 100 AS large, CAST(greatest(n_chars % 3000 - 101, 0) // 1400 + 1 AS INTEGER) AS n_tiles FROM documents WHERE n_chars IS NOT NULL",
    "q55_profile_cache": "SELECT 'Kim' AS name, '3' AS grade, 'a,b' AS interests UNION ALL SELECT 'rows after', '0', ''",
    "q56_tokenized": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
        i AS (SELECT doc_id, list_append(list_transform(w, lambda x: 2 + CAST('0x' || substr(md5(x), 7, 2) || substr(md5(x), 5, 2) || substr(md5(x), 3, 2) || substr(md5(x), 1, 2) AS BIGINT) % 32766), 1)[1:64] AS i FROM w)
        SELECT doc_id, 64::INTEGER AS length, CAST(len(i) AS BIGINT) AS n_real, CAST(list_sum(i) AS BIGINT) AS sum_of_ids FROM i""",
    "q57_enough_rows": """
        SELECT name, n >= 10 AS train, n >= 5 AS eval, false AS more FROM (SELECT 'labels' AS name, count(*) AS n FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'region', count(*) FROM region)""",
    "q58_prompt_parts": rf"""
        WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?。]{_WS}*'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: length(x) > 10) AS p FROM documents)
        SELECT doc_id, md5(coalesce(array_to_string(list_transform(p, lambda x, i: i || '. ' || x), chr(10)), '')) AS numbered_md5, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 + 2 ELSE 60 END AS INTEGER) AS wait, doc_id // 60 || ' min ' || doc_id % 60 || ' s' AS elapsed FROM s""",
    "q60_base64": "SELECT CAST(doc_id AS VARCHAR) AS path, md5(base64(encode(text))) AS base64_md5 FROM documents",
    "q61_classified": f"""
        WITH r AS ({_category_sql()}), s AS (SELECT doc_id, length({_TITLE} || ' ' || substr({_BODY}, 1, 200)) % 3 AS n FROM documents)
        SELECT doc_id, CASE n WHEN 0 THEN 'short' WHEN 1 THEN 'other' ELSE category END AS category FROM r JOIN s USING (doc_id)""",
    "q59_training_pairs": f"WITH {_JUDGED} SELECT question AS query, answer AS positive FROM judged WHERE NOT hallucination AND judge_score >= 4",
}

QUERIES = {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit() and callable(f)}
QUERIES |= stored.QUERIES
ORACLE_SQL |= stored.oracle_sql(ORACLE_SQL.get)
