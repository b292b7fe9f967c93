"""Registered queries of the corpus operators: each applies one to its whole table."""

from pyspark.sql import functions as F

from . import bfd_packing, chat_format, exact_dedup, hilbert_packing, jaccard_join, lm_score, mixing, quality, substring_dedup, topk
from . import tokens as T


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_bfd_packing(spark, sf_dir):
    return T.pieces_of(bfd_packing.pack(table(spark, sf_dir, "documents")))


def op5_lm_score(spark, sf_dir):
    """Trigrams."""
    out = lm_score.backoff_scores(table(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 9).alias("mean_log_score"))


def op6_hilbert_packing(spark, sf_dir):
    return T.pieces_of(hilbert_packing.pack(table(spark, sf_dir, "documents")))


def op7_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat_format.format_chats(turns.unionByName(extra).withColumn("parts", chat_format.text_parts(F.col("text"))))
    out = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.trained_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_topk(spark, sf_dir):
    return topk.topk(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0).drop("query_row")


def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_jaccard_join, op3_exact_dedup, op4_bfd_packing, op5_lm_score, op6_hilbert_packing, op7_chat_format, op8_mixing, op9_topk, op10_quality)
}

ORACLES = {
    "op2_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        t AS (SELECT doc_id, unnest(s) AS t FROM s),
        n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * i >= 8 * (x.n + y.n - i)
              UNION ALL SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON x.doc_id < y.doc_id AND x.n = 0 AND y.n = 0),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        walk AS (SELECT a AS node, a AS seen FROM u UNION SELECT walk.node, u.b FROM walk JOIN u ON walk.seen = u.a),
        g AS (SELECT node, min(seen) AS class_id FROM walk GROUP BY node),
        l AS (SELECT a, count(*) AS n_links FROM u GROUP BY a)
        SELECT n.doc_id, coalesce(class_id, n.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, n AS set_size
        FROM n LEFT JOIN g ON g.node = n.doc_id LEFT JOIN l ON l.a = n.doc_id""",
    "op5_lm_score": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
        q AS (SELECT *, lag(x) OVER d AS h, lag(x, 2) OVER d AS g FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        o1 AS (SELECT doc_id, x, count(*) AS c FROM q GROUP BY doc_id, x), c1 AS (SELECT x, sum(c) AS c FROM o1 GROUP BY x),
        o2 AS (SELECT doc_id, h, x, count(*) AS c FROM q WHERE h IS NOT NULL GROUP BY doc_id, h, x), c2 AS (SELECT h, x, sum(c) AS c FROM o2 GROUP BY h, x),
        o3 AS (SELECT doc_id, g, h, x, count(*) AS c FROM q WHERE g IS NOT NULL GROUP BY doc_id, g, h, x), c3 AS (SELECT g, h, x, sum(c) AS c FROM o3 GROUP BY g, h, x),
        l1 AS (SELECT doc_id, x, (c1.c - o1.c)::DOUBLE AS c FROM o1 JOIN c1 USING (x)), l2 AS (SELECT doc_id, h, x, (c2.c - o2.c)::DOUBLE AS c FROM o2 JOIN c2 USING (h, x)),
        l3 AS (SELECT doc_id, g, h, x, (c3.c - o3.c)::DOUBLE AS c FROM o3 JOIN c3 USING (g, h, x)),
        n AS (SELECT doc_id, len(w)::BIGINT AS n, ((SELECT count(*) FROM p) - len(w))::DOUBLE AS rest FROM w),
        r AS (SELECT q.doc_id, CASE WHEN t.c > 0 THEN ln(t.c / hb.c)
                WHEN b.c > 0 THEN ln(b.c / hu.c) + CASE WHEN q.g IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
                WHEN u.c > 0 THEN ln(u.c / rest) + CASE WHEN q.h IS NULL THEN 0 WHEN q.g IS NULL THEN ln(0.4::DOUBLE) ELSE 2 * ln(0.4::DOUBLE) END
                ELSE -ln(rest + 1) + CASE WHEN q.h IS NULL THEN 0 WHEN q.g IS NULL THEN ln(0.4::DOUBLE) ELSE 2 * ln(0.4::DOUBLE) END END AS s
              FROM q JOIN n USING (doc_id) JOIN l1 u ON u.doc_id = q.doc_id AND u.x = q.x
              LEFT JOIN l1 hu ON hu.doc_id = q.doc_id AND hu.x = q.h LEFT JOIN l2 b ON b.doc_id = q.doc_id AND b.h = q.h AND b.x = q.x
              LEFT JOIN l2 hb ON hb.doc_id = q.doc_id AND hb.h = q.g AND hb.x = q.h LEFT JOIN l3 t ON t.doc_id = q.doc_id AND t.g = q.g AND t.h = q.h AND t.x = q.x),
        t AS (SELECT doc_id, sum(s) AS s FROM r GROUP BY doc_id)
        SELECT n.doc_id, n AS n_words, round(coalesce(s, 0.0::DOUBLE), 6) AS log_score, CASE WHEN n > 0 THEN round(s / n, 9) END AS mean_log_score FROM n LEFT JOIN t USING (doc_id)""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                          regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op7_chat_format": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\\\<\\[]')) + length(role) + len(regexp_extract_all(role, '[\\\\<\\[]')) + 23 AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
