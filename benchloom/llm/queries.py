"""Named queries of the training-data operators and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    chat_format, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, pieces,
    spelling, suffix_dedup, token_files, tokens, toxicity,
)
from .common import shuffles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_embedding_dedup", """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN embedding IF x <> 0]) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM p UNION
            SELECT t.a, p.b FROM t JOIN p ON t.b = p.a) SELECT a, min(b) AS low FROM t GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links,
           least(vec_id, coalesce(low, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
    FROM embeddings LEFT JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op1_embedding_dedup(spark, folder):
    return (embedding_dedup.embedding_dedup(table(spark, folder, "embeddings"))
            .withColumnRenamed("id", "vec_id"))


@query("op2_line_dedup", """
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM d),
    l AS (SELECT doc_id, source, unnest(parts) AS part,
                 generate_subscripts(parts, 1) AS pos FROM p),
    s AS (SELECT trim(part) AS line FROM l WHERE trim(part) <> ''
          GROUP BY 1 HAVING count(DISTINCT source) >= 10),
    k AS (SELECT l.doc_id, count(*) FILTER (s.line IS NOT NULL) AS gone, count(*) AS n,
                 coalesce(string_agg(part, chr(10) ORDER BY pos)
                          FILTER (s.line IS NULL), '') AS rest
          FROM l LEFT JOIN s ON trim(l.part) = s.line GROUP BY l.doc_id),
    c AS (SELECT d.doc_id, n, gone, d.text, rest FROM d JOIN k USING (doc_id))
    SELECT doc_id, n AS n_lines, gone AS n_removed, sha256(rest) AS kept_sha256 FROM c""")
def op2_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_pieces")
def op3_pieces(spark, folder):
    encoded = pieces.encode_pieces(table(spark, folder, "documents"),
                                   public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return encoded.withColumnRenamed("id", "doc_id")


@query("op4_token_files")
def op4_token_files(spark, folder):
    place = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), place,
                                  public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return (token_files.read_token_files(spark, place, digest_only=True)
            .withColumnRenamed("id", "doc_id"))


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    counts = tokens.count_tokens(table(spark, folder, "documents"),
                                 public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, folder):
    return (suffix_dedup.suffix_dedup(table(spark, folder, "documents"))
            .withColumnRenamed("id", "doc_id"))


def mix_levels():
    """Domain by the number of the source, then language, then source."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = (F.when(number == "", "unknown").when(number.cast("int") < 10, "web")
              .when(number.cast("int") < 15, "books").otherwise("code"))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


MIX_WEIGHTS = [{"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2}, {"src0": 2}]


@query("op7_source_mix", """
    WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE
             length(text) - length(translate(text, ' ' || chr(10), '')) + 1 END AS tokens,
           coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
           TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) AS k
        FROM documents),
    r AS MATERIALIZED (SELECT *, CASE WHEN k IS NULL THEN 'unknown' WHEN k < 10 THEN 'web'
             WHEN k < 15 THEN 'books' ELSE 'code' END AS domain FROM d),
    leaf AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens,
                    (sum(tokens) * 3)::BIGINT AS cap FROM r GROUP BY ALL),
    n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 5
             WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight,
             (SELECT floor(sum(cap) / 3 * 0.6::DOUBLE) FROM leaf)::DOUBLE AS budget
           FROM leaf GROUP BY domain),
    a1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, domain
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, domain
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open FROM n1),
    b1 AS (SELECT *, cap::DOUBLE * open <= weight::DOUBLE * (budget - spent) AS f FROM a1),
    c1 AS (SELECT *, min(f::INT) OVER (ORDER BY cap::DOUBLE / weight, domain
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS sated FROM b1),
    t1 AS (SELECT domain, CASE WHEN sated THEN cap::DOUBLE ELSE weight::DOUBLE * ((budget
               - coalesce(sum(cap) FILTER (sated) OVER (), 0)::DOUBLE)
               / (sum(weight) FILTER (NOT sated) OVER ())::DOUBLE) END AS budget FROM c1),
    n2 AS (SELECT domain, language, sum(cap)::BIGINT AS cap, CASE language WHEN 'en' THEN 6
             WHEN 'de' THEN 2 ELSE 1 END AS weight, any_value(budget) AS budget
           FROM leaf JOIN t1 USING (domain) GROUP BY domain, language),
    a2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight,
               language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
             sum(weight) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight, language
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open FROM n2),
    b2 AS (SELECT *, cap::DOUBLE * open <= weight::DOUBLE * (budget - spent) AS f FROM a2),
    c2 AS (SELECT *, min(f::INT) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight,
               language ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS sated FROM b2),
    t2 AS (SELECT domain, language, CASE WHEN sated THEN cap::DOUBLE ELSE weight::DOUBLE *
             ((budget - coalesce(sum(cap) FILTER (sated) OVER (PARTITION BY domain), 0)::DOUBLE)
             / (sum(weight) FILTER (NOT sated) OVER (PARTITION BY domain))::DOUBLE) END AS budget
           FROM c2),
    n3 AS (SELECT domain, language, origin, tokens, cap, CASE origin WHEN 'src0' THEN 2
             ELSE 1 END AS weight, budget FROM leaf JOIN t2 USING (domain, language)),
    a3 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, language
               ORDER BY cap::DOUBLE / weight, origin
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
             sum(weight) OVER (PARTITION BY domain, language ORDER BY cap::DOUBLE / weight,
               origin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open
           FROM n3),
    b3 AS (SELECT *, cap::DOUBLE * open <= weight::DOUBLE * (budget - spent) AS f FROM a3),
    c3 AS (SELECT *, min(f::INT) OVER (PARTITION BY domain, language
               ORDER BY cap::DOUBLE / weight, origin
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS sated FROM b3),
    t3 AS (SELECT domain, language, origin, tokens, floor(CASE WHEN sated THEN cap::DOUBLE
             ELSE weight::DOUBLE * ((budget - coalesce(sum(cap) FILTER (sated)
               OVER (PARTITION BY domain, language), 0)::DOUBLE)
             / (sum(weight) FILTER (NOT sated) OVER (PARTITION BY domain, language))::DOUBLE)
             END)::BIGINT AS target FROM c3),
    e AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 0 END AS whole,
                 target - CASE WHEN tokens > 0 THEN target // tokens ELSE 0 END * tokens AS rest
          FROM t3),
    o AS (SELECT r.doc_id, domain, language, origin, r.tokens, whole, rest,
                 sum(r.tokens) OVER (PARTITION BY domain, language, origin
                   ORDER BY md5('mix:' || whole || ':' || doc_id)) AS upto
          FROM r JOIN e USING (domain, language, origin))
    SELECT doc_id, domain, language, origin, tokens,
           whole + (upto - tokens < rest)::INT AS epochs FROM o""")
def op7_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), mix_levels(), MIX_WEIGHTS, share=0.6,
                      max_epochs=3, seed="mix").withColumnRenamed("id", "doc_id")


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    return (docs.withColumn("score", model.score(F.col("text")))
            .select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


@query("op9_jaccard_join")
def op9_jaccard_join(spark, folder):
    return (jaccard_join.jaccard_join(table(spark, folder, "documents"))
            .withColumnRenamed("id", "doc_id"))


@query("op10_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
          FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)""")
def op10_exact_dedup(spark, folder):
    rows = exact_dedup.dedup_newest_first(table(spark, folder, "documents"),
                                          scratch_path(spark, "digest-index"), shuffles(spark))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


@query("op11_chat_format", """
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    g AS (SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text)
                     FILTER (role = 'assistant'), '') AS loss,
            sum(length('<|im_start|>' || url_encode(role) || chr(10) || '<|im_end|>' || chr(10))
                + length(replace(replace(text, '\\', '\\\\'), '|', '\\|')))::BIGINT AS formatted_chars
          FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
           sha256(loss) AS loss_sha256, formatted_chars FROM g""")
def op11_chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    turns = chat_format.format_turns(rows.unionByName(tricky), chat_format.text_parts(F.col("text")),
                                     F.col("role") == "assistant")
    return chat_format.digests(chat_format.assemble_blocks(turns))


@query("op12_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
            list_inner_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
    p AS (SELECT anchor_id, id, score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id
               ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id,
           p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    QUALIFY rank <= 10""")
def op12_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


@query("op13_spelling")
def op13_spelling(spark, folder):
    words = spelling.count_words(table(spark, folder, "documents"))
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
