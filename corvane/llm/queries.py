"""The registered queries of this subpackage: thin wrappers that derive the contract's columns from the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bin_completion, block_max, embed_dedup, exact_dedup, html_wrapper, jaccard_join, packing, pii, prefix_trie, quality, secrets, sentencepiece_nbest, warc
from corvane.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [rule[0] for rule in secrets.BASE_RULES]
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count(spans, k) for k in kinds], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    # what was just written must come back whole: a gap here would be a lost page
    sound = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), F.col("archive"), F.col("start"), F.col("reason"))).cast("boolean"))
    return read.where(sound).select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to")
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_wrapper.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs, labels.where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_nbest.encode_nbest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", "rank", "n_pieces", "score", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count(spans, k) for k in pii.BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bin_completion.pack_few(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_secrets, op4_warc, op5_html, op6_quality, op7_sentencepiece, op8_jaccard, op9_pii, op10_embeddings, op11_prefix_trie, op12_ranked_search, op13_bin_completion)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h""",
    "op8_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS e,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text))) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list(e ORDER BY p) AS s, string_split(c::VARCHAR, '') AS digits FROM t GROUP BY c),
        -- CRC-32 bit by bit: the least significant bit of each byte comes first
        h AS (SELECT c, s, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(digits,
                lambda g: list_transform(range(8), lambda i: (ascii(g)::BIGINT >> i) & 1)))), lambda r, b: xor(r >> 1, (xor(r, b) & 1) * 3988292384))) % 4 END AS h FROM o),
        q AS (SELECT a.c, CASE WHEN a.h = 0 OR b.s IS NULL THEN a.s[a.h + 1:] ELSE b.s[:a.h] || a.s[a.h + 1:] END AS s FROM h a LEFT JOIN o b ON b.c = a.c - a.c % 20),
        m AS (SELECT c, d, s[1:d] AS k, len(s) = d AS is_end FROM q, unnest(range(len(s) + 1)) u(d)),
        v AS (SELECT d, k, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends FROM m GROUP BY d, k),
        f AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
        w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(k[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
            FROM v LEFT JOIN f USING (d, k)),
        t2 AS (SELECT a.d, w.k[1:a.d] AS k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM w, unnest(range(w.d + 1)) a(d) GROUP BY ALL)
        SELECT w.c AS conv_id, w.d AS depth, p.c AS parent_conv_id, w.n AS n_convs, w.n_children, t2.n_leaves, t2.saved_tokens, sha256(w.ends) AS ends_sha256
        FROM w JOIN t2 USING (d, k) LEFT JOIN v p ON p.d = w.d - 1 AND p.k = w.k[1:w.d - 1]""",
    "op12_ranked_search": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
        g AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        i AS (SELECT row_number() OVER () AS i, item_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
        q AS (SELECT i, term, count(*) AS repeats FROM (SELECT i, unnest(t) AS term FROM i) GROUP BY ALL),
        s AS (SELECT i, r, sum(repeats * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t)::BIGINT * n_docs) // n_terms))))::BIGINT AS score
            FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), g GROUP BY i, r)
        SELECT item_id, (row_number() OVER t)::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) JOIN i USING (i) WHERE score > 0
        WINDOW t AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER t <= 10""",
}
