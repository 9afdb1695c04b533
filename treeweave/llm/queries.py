"""The registered queries of this subpackage: thin, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, codes, html, langid, neardup, packing, quality, substrings, topk, toxicity, urls
from .shared import held_out, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), 2048)


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are decoded where they are encoded: one Python worker a task, which gets some MB of text at once."""
    small_batches(spark, 1000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer(), decoded="text").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the smallest id of its class, the class's rows, and whether it is the one that stays."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "copies", "kept")


def op5_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.training_texts(docs, ~held_out(F.col("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Network | float:
    return toxicity.train(*toxicity.labelled_sample(docs, labels, ~held_out(F.col("doc_id"))))


def op9_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


def op11_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned from documents whose id's crc32 modulo 3 isn't 1."""
    held_out_ = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out_)
    return found.select("doc_id", held_out_.alias("held_out"), "score", "predicted")


def op12_integer_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_best_two_fit": op1_best_two_fit,
    "op2_bpe_automaton": op2_bpe_automaton,
    "op3_threshold_topk": op3_threshold_topk,
    "op4_weighted_minhash": op4_weighted_minhash,
    "op5_minimum_cut": op5_minimum_cut,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_gated_recurrent": op9_gated_recurrent,
    "op10_bloom_cascade": op10_bloom_cascade,
    "op11_fourier_ridge": op11_fourier_ridge,
    "op12_integer_codebooks": op12_integer_codebooks,
    "op13_striped_alignment": op13_striped_alignment,
}

#: One round of assignment (to the entries of table {book}), and one of new entries.
ASSIGN_SQL = """
{name} AS (SELECT vec_id, p, v, e, d FROM (SELECT x.vec_id, x.p, x.v, c.e, x.s - 2 * CAST(list_dot_product(x.f, c.f) AS BIGINT) + c.s AS d,
             ROW_NUMBER() OVER (PARTITION BY x.vec_id, x.p ORDER BY x.s - 2 * CAST(list_dot_product(x.f, c.f) AS BIGINT) + c.s, c.e) AS rn
           FROM parts x JOIN {book} c ON x.p = c.p) WHERE rn = 1)"""
MOVE_SQL = """
{name} AS (SELECT c.p, c.e, COALESCE(m.v, c.v) AS v, CAST(COALESCE(m.v, c.v) AS DOUBLE[]) AS f, CAST(list_dot_product(CAST(COALESCE(m.v, c.v) AS DOUBLE[]), CAST(COALESCE(m.v, c.v) AS DOUBLE[])) AS BIGINT) AS s
  FROM {book} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM {assigned}, range(1, 5) r(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""
#: Vectors of 64 components; sums and products are whole numbers far below 2**53, so doubles hold them exactly.
CODEBOOKS_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, range(16) r(p)),
parts AS (SELECT *, CAST(v AS DOUBLE[]) AS f, CAST(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS s FROM cut),
firsts AS (SELECT vec_id, CAST(ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT p, e, v, f, s FROM parts JOIN firsts USING (vec_id)),
{ASSIGN_SQL.format(name="a0", book="b0")}, {MOVE_SQL.format(name="b1", book="b0", assigned="a0")},
{ASSIGN_SQL.format(name="a1", book="b1")}, {MOVE_SQL.format(name="b2", book="b1", assigned="a1")},
{ASSIGN_SQL.format(name="a2", book="b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
labelled AS (SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM coded c JOIN kept k ON k.vec_id = c.vec_id)
SELECT *, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM labelled
"""

#: Where SQL can say it. Tokens, index searches and trained models it can't.
ORACLE_SQL: dict[str, str] = {
    "op3_threshold_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_integer_codebooks": CODEBOOKS_SQL,
    "op10_bloom_cascade": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, COALESCE(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
      ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT h.*, rule, verdict, ROW_NUMBER() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS rn
      FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM m WHERE rn = 1
""",
}
