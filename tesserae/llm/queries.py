"""The queries over the operators of this folder, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import ann, arrow_output, bpe, conversation, exact_dedup, html, langid, merkle, minhash, oracles, packing, quality, suffix_dedup, topk
from tesserae.llm.common import held_out, shared_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on_tables(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the 100-byte strings that start earlier, as digests."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every vector whose id is divisible by 50 with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 85 % of their 3-word shingles in common."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token files and reads them back."""
    folder = shared_dir(spark)
    manifest = arrow_output.write_sequences(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")).collect()
    read = arrow_output.read_documents(spark, folder, manifest)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20 among all others."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.dictionaries(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, the documents being taken in as two batches."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits of damaged conversations."""
    whole = table(spark, sf_dir, "conversations")
    return conversation.report_of(whole, conversation.damaged(whole))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its proof leads to when some texts have been lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    fields = ["doc_id", "source", "lang", "n_chars"]
    claimed = merkle.row_hash(*map(F.col, fields), F.when(tampered, lower).otherwise(F.col("text")))
    proved = merkle.manifest(docs, [*fields, "text"], "lang", "doc_id", claimed=claimed)
    out = proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_token_files": op7_token_files,
    "op8_ann": op8_ann,
    "op9_language": op9_language,
    "op10_html": op10_html,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_merkle": oracles.MERKLE,
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # every string of 100 bytes, in hexadecimal digits
    "op3_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 99, 0))) AS i FROM t)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
        g AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
        p AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY ALL),
        q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS spans FROM p GROUP BY doc_id),
        k AS (SELECT doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([0], coalesce(list_transform(spans, lambda x: x.b), [])) AS begins, list_concat(coalesce(list_transform(spans, lambda x: x.a), []), [len(h) // 2]) AS ends FROM t LEFT JOIN q USING (doc_id))
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
        sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1), lambda j: substr(h, 2 * begins[j] + 1, 2 * (ends[j] - begins[j]))), ''))) AS kept_sha256 FROM k
    """,
    "op6_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY u) USING (doc_id)
    """,
    # for pages that have their text in one article, without other elements to leave out in it
    "op10_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(b|i|em|strong|a|span|u|code)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
        u AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS t FROM t),
        x AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM u)
        SELECT page_id, url, text, length(text) AS n_chars FROM x
    """,
}
