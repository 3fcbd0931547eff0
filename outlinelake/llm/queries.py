"""The queries of this package for __spark_entry__.py, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, centroids, exact_dedup, hamming, minhash, packing, pitman_yor, prefix_trie, quality, suffix_dedup, token_files, warc, wu_manber
from .common import documents


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir), held=pitman_yor.held_out())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end=0))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.merge(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(documents(spark, sf_dir), history=F.pmod(F.col("doc_id"), F.lit(2)) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hamming.top_k(vectors, queries=F.col("vec_id") % 20 == 0, k=10, bits=hamming.width(vectors))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string")) % 9
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), base, most=8, head=head)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.digests(wu_manber.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _clusters(rounds: int) -> str:
    """Rounds of assigning and moving, one after the other."""
    sql = """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, floor(1024 * unnest(e))::BIGINT AS x FROM kept),
        c0 AS MATERIALIZED (SELECT k, i, x AS c FROM (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept) JOIN x USING (r) WHERE k < 8)"""
    for n in range(rounds + 1):
        sql += f""", a{n} AS MATERIALIZED (SELECT r, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)"""
        if n < rounds:
            sql += f""", c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM c{n} LEFT JOIN (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i) USING (k, i))"""
    return sql + f""", h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
        SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN h USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_prefix_trie": """
            WITH c AS (SELECT conv_id AS c, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
            h AS (SELECT c, xor(crc, 4294967295) % 9 AS h FROM c),
            o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
            n AS (SELECT h.c, list_concat(coalesce(list_slice(b.l, 1, h), []), list_slice(o.l, h + 1, len(o.l))) AS l FROM h JOIN o ON o.c = h.c LEFT JOIN o b ON b.c = h.c - h.c % 5),
            p AS (SELECT c, len(l) AS length, d, list_slice(l, 1, d) AS k FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM n)),
            t AS (SELECT k, d, min(c) AS c, count(*) AS n, CASE WHEN d > 0 THEN strlen(k[d].t) ELSE 0 END AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = d) AS ends FROM p GROUP BY k, d),
            u AS (SELECT *, list_slice(k, 1, d - 1) AS up FROM t),
            kids AS (SELECT up AS k, d - 1 AS d, count(*) AS children FROM u WHERE d > 0 GROUP BY ALL),
            s AS (SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN kids USING (k, d)),
            b AS (SELECT list_slice(k, 1, a) AS k, a AS d, sum((n - 1) * bytes) AS saved, count(*) FILTER (WHERE children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM s) GROUP BY ALL)
            SELECT s.c AS conv_id, s.d AS depth, q.c AS parent_conv_id, s.n AS n_convs, s.children AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
            FROM s JOIN b USING (k, d) LEFT JOIN t q ON q.k = s.up AND q.d = s.d - 1""",
        "op12_centroids": _clusters(10),
        "op13_wu_manber": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
            b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
            p AS (SELECT DISTINCT item_id, least(len(l), 10) AS m, array_to_string(list_slice(l, s, s + least(len(l), 10) - 1), ' ') AS pattern FROM (SELECT *, unnest(range(1, greatest(len(l) - 8, 2))) AS s FROM b WHERE len(l) > 0)),
            g AS (SELECT doc_id, m, s, array_to_string(list_slice(l, s, s + m - 1), ' ') AS pattern FROM (SELECT doc_id, l, m, unnest(range(1, len(l) - m + 2)) AS s FROM w, (SELECT DISTINCT m FROM p))),
            f AS (SELECT DISTINCT doc_id, item_id, m, s FROM g JOIN p USING (m, pattern)),
            i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM f GROUP BY doc_id),
            h AS (SELECT doc_id, count(DISTINCT t) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS t FROM f) GROUP BY doc_id)
            SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM w LEFT JOIN i USING (doc_id) LEFT JOIN h USING (doc_id)""",
        "op4_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> original THEN original END AS refers_to FROM f""",
        "op6_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id = first(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
        "op7_hamming": """
            WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
                FROM c AS q, c WHERE q.vec_id % 20 = 0),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM p)
            SELECT * FROM r WHERE rank <= 10""",
    }
