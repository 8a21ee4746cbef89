"""The queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import caps, chat, fingerprints, gru, language, minhash, mixing, pieces, sharding, warc
from .common import new_path, table


def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "begins")


def op2_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""


def op3_gru(spark, sf_dir):
    return gru.score(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
       coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


def piece_model() -> str:
    """Path of the public merge-type vocabulary; it lies at the same place on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op6_pieces(spark, sf_dir, model_path=None):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), model_path or piece_model())


def op7_embeddings(spark, sf_dir):
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT d.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(m.c, d.vec_id) AS component_id,
       coalesce(m.c, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN k ON k.a = d.vec_id LEFT JOIN m ON m.a = d.vec_id
"""


def op8_language(spark, sf_dir):
    found = language.identify(language.of_documents(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").drop("text_hash")


def language_id_pages(spark, sf_dir):
    """The same evidence model over raw pages: markup language, address suffix, hosts."""
    found = language.identify(language.of_pages(table(spark, sf_dir, "pages")))
    return found.withColumnRenamed("id", "page_id").drop("text_hash")


def op9_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         list(struct_pack(t := turn, r := role, x := text) ORDER BY turn, role, text) AS turns
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, turns FROM c GROUP BY turns),
p AS (
  SELECT DISTINCT list_slice(turns, 1, i) AS turns
  FROM (SELECT turns, unnest(generate_series(1, n_turns - 1)) AS i FROM u)),
kept AS (SELECT conv_id, n_turns, n_copies FROM u WHERE turns NOT IN (SELECT turns FROM p))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY ALL
"""


def queries():
    return {"op1_mixing": op1_mixing, "op2_warc": op2_warc, "op3_gru": op3_gru, "op4_sharding": op4_sharding, "op5_minhash": op5_minhash, "op6_pieces": op6_pieces, "op7_embeddings": op7_embeddings, "op8_language": op8_language, "op9_fingerprints": op9_fingerprints, "op10_chat": op10_chat, "language_id_pages": language_id_pages}


def oracle_sql():
    return {"op2_warc": OP2_SQL, "op5_minhash": OP5_SQL, "op7_embeddings": OP7_SQL, "op10_chat": OP10_SQL}
