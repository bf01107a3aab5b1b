"""Registered queries of the operators in this folder, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, arrow_output, conversations, conversations_sql, decontaminate, fingerprints, langid, language_model, linededup, neardup_text, neardup_vectors, packing, sharding, toxicity
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: File names of the vocabularies in the public tokenizer folder.
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_line_dedup", linededup.duckdb_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_gated_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score_documents(docs, ~held_out(5, 1)).select(
        "doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_arrow_sequences")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard")


@query("op4_kernel_langid")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(3, 1))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


DECONTAMINATION_SQL = r"""WITH
    low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, len(k) AS size, array_to_string(k, ' ') AS k FROM (SELECT item_id,
        w[s:s + 12] AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0))),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS k FROM (SELECT doc_id, w, size,
        unnest(range(1, len(w) - size + 2)) AS s FROM low, sizes WHERE len(w) >= size)),
    hits AS (SELECT doc_id, item_id, s, p.size FROM places p JOIN windows USING (k)),
    words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS i FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
    FROM low LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op5_prefix_decontamination", DECONTAMINATION_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op6_jump_shards", sharding.duckdb_sql(40))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


VECTOR_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_dot_product(e, e) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
    reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT s, b FROM reach JOIN links ON a = t)
    SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(t) AS component_id, v.vec_id = min(t) AS kept
    FROM v JOIN reach ON s = v.vec_id GROUP BY v.vec_id"""


@query("op7_cross_polytope", VECTOR_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.link_vectors(table(spark, sf_dir, "embeddings"), 0.98)


TEXT_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s
        FROM w WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id
        GROUP BY 1, 2) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
    reach AS (SELECT doc_id AS s, doc_id AS t FROM w UNION SELECT s, b FROM reach JOIN links ON a = t)
    SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(t) AS component_id, w.doc_id = min(t) AS kept
    FROM w JOIN reach ON s = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY w.doc_id"""


@query("op8_fast_minhash", TEXT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_text.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_clause_grammar")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, capacity=2048)


@query("op11_lookup_sketches", fingerprints.duckdb_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op12_space_anchors")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary(), vocabulary(PIECES))


@query("op13_auction_repair", conversations_sql.duckdb_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))
