"""Registered queries of the subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.llm import byte_bpe, chat, exact_dedup, fill_middle, html_text, language_id, line_quality, merkle, ngram_join, packing, sharding, url_filter, vp_search
from relief.llm.common import shared_table
from relief.sources.tables import table

RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
END_OF_DOCUMENT = 2
SHARDS = 16
PREDICT_GOOD_FROM = 0.7


def fold(folds: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % folds


def op1_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50; factor 1, that is exact."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vp_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ngram_join.ngram_join(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)
    return rows.select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), hash_all=True)
    return rows.withColumnRenamed("content_hash", "text_sha256")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT)
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), encode)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs, fold(3) != 1)
    rows = language_id.predict(docs, model)
    return rows.withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = line_quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), fold(4) != 2)
    rows = line_quality.predict(docs, model)
    return rows.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= PREDICT_GOOD_FROM).cast("int"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), RULES)


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    placed = sharding.shard_rows(shared_table(rows), SHARDS, order=["doc_id", "key", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    escaped = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    examples = chat.expand_examples(chat.format_conversations(turns.unionByName(escaped)))
    # from here on only the examples are read
    turn = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("last"), chat.read_turns(F.col("text"))).alias("read"),
    )
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (
        read.select("conv_id", "example", "chars", "loss", F.size("read").cast("long").alias("n"), F.sha2(F.array_join(turn, ""), 256).alias("digest"))
        .groupBy("conv_id")
        .agg(F.max("n").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), replies.alias("replies"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    decoded = byte_bpe.decode(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document's leaf is claimed with its text's A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*others, F.col("text"))
    lowered = F.when(F.col("text").isNotNull(), exact_dedup.lower_ascii(F.col("text")))
    claimed = F.when(fold(3) == 0, merkle.leaf_digest(*others, lowered)).otherwise(leaf)
    rows = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf, claimed)
    return rows.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_middle.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    restored = fill_middle.restore(formed)
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_vp_search, op2_ngram_join, op3_exact_dedup, op4_vector_packing, op5_language_id, op6_line_quality, op7_url_filter, op8_minimax_shards, op9_prefix_targets, op10_byte_bpe, op11_html_text, op12_merkle_manifest, op13_fill_middle)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
), c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node
), k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a
), same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY sorted) AS class_id FROM (SELECT doc_id, list(g ORDER BY g) AS sorted FROM s GROUP BY doc_id)
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(same.class_id, d.doc_id) AS class_id, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN same USING (doc_id)
"""

OP3_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""

OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(role) + 5 * length(regexp_replace(role, '[^|]', '', 'g')) + 4 * length(regexp_replace(role, '[^&]', '', 'g')) + 3 * length(regexp_replace(role, '[^<]', '', 'g'))
         + length(text) + 4 * length(regexp_replace(text, '[^&]', '', 'g')) + 3 * length(regexp_replace(text, '[^<]', '', 'g')) + 8 AS chars
  FROM t
), r AS (
  SELECT *, sum(chars) OVER w AS stop, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN stop ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

#: zlib's crc32 of an id's decimal text: one list entry per character and eight for its bits
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(doc_id::VARCHAR, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""


def merkle_sql(levels: int = 8) -> str:
    """Trees by one aggregate per level (enough for 8 ** ``levels`` documents a language), folds by one join per level."""
    names = ("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text: str) -> str:
        values = [text if c == "text" else f"{c}::VARCHAR" for c in names]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    lower = f"CASE WHEN text IS NOT NULL THEN {_LOWER} END"
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS key, {leaf('text')} AS d, CASE WHEN {CRC32_SQL} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d, claimed) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, row_number() OVER () AS rid FROM leaves)",
        "t0 AS (SELECT key, pos, n, d FROM l)",
    ]

    def grow(name: str) -> list[str]:
        return [
            f"""{name}{k + 1} AS (SELECT key, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d
              FROM {name}{k} GROUP BY key, pos // 8, n)"""
            for k in range(levels)
        ]

    def climb(name: str, path: str) -> list[str]:
        return [
            f"""{path}{k + 1} AS (SELECT p.rid, p.key, p.pos // 8 AS pos,
                CASE WHEN any_value(x.n) > 1 THEN sha256(string_agg(CASE WHEN x.pos = p.pos THEN p.folded ELSE x.d END, '' ORDER BY x.pos)) ELSE any_value(p.folded) END AS folded,
                any_value(p.proof) || coalesce(string_agg(x.d, '' ORDER BY x.pos) FILTER (x.pos <> p.pos), '') AS proof
              FROM {path}{k} p JOIN {name}{k} x ON x.key = p.key AND x.pos // 8 = p.pos // 8 GROUP BY p.rid, p.key, p.pos)"""
            for k in range(levels)
        ]

    parts += grow("t")
    parts += ["p0 AS (SELECT rid, key, pos, claimed AS folded, '' AS proof FROM l)", *climb("t", "p")]
    parts += [f"f0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, d, key AS of FROM t{levels})", *grow("f")]
    parts += [f"q0 AS (SELECT p.rid, '' AS key, f0.pos, p.folded, p.proof FROM p{levels} p JOIN f0 ON f0.of = p.key)", *climb("f", "q")]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT l.doc_id, l.d AS leaf, f0.d AS subroot, r.d AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root, q.folded = r.d AS verified
FROM l JOIN f0 ON f0.of = l.key JOIN q{levels} q USING (rid) CROSS JOIN f{levels} r"""
    )


OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), c AS (
  SELECT *, '<P>' || t[1:least(a, b)] AS p, '<M>' || t[least(a, b) + 1:greatest(a, b)] AS m, '<S>' || t[greatest(a, b) + 1:] AS s FROM d
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN s || p || m ELSE p || s || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

#: the other queries' results depend on hashes, trained models or tokenizers; tests hold them against brute force
ORACLE = {"op2_ngram_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op9_prefix_targets": OP9_SQL, "op12_merkle_manifest": merkle_sql(), "op13_fill_middle": OP13_SQL}
