"""The queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import chat, hard_negatives, language, line_quality, main_text, merkle, mixing, near_duplicates, neighbours, ngram_join, packing, quality_rules, token_files
from recordloom.llm.common import fold_of, table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1 = """
    WITH d AS (
        SELECT doc_id, source, length(text) AS chars, length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS letters,
               coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
        FROM documents
    ),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
        FROM d GROUP BY source
    ),
    l AS (
        SELECT *, (3 * source_size)::DOUBLE AS fill,
               ((sum(source_size) OVER ())::DOUBLE - coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM s
    ),
    w AS (SELECT arg_min(level, fill / weight) AS water FROM l WHERE level * weight < fill),
    t AS (SELECT source, source_size, CASE WHEN water * weight < fill THEN water * weight ELSE fill END AS target FROM l, w),
    r AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
    ),
    k AS (
        SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, d.source,
               greatest(round(r.target)::BIGINT - r.epochs * r.source_size, 0) AS rest,
               -ln((('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
               / coalesce(0.25 + 0.75 * (letters / chars) * (letters / chars), 0.25) AS key
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    ),
    o AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 0) - size AS ahead,
               count(*) OVER (PARTITION BY source, key, size) AS n
        FROM k
    )
    SELECT doc_id, size, source_size, target,
           (epochs * size + CASE WHEN rest >= ahead + n * size THEN size WHEN rest > ahead THEN (rest - ahead) // n ELSE 0 END)::BIGINT AS taken
    FROM o
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), ["doc_id"])


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs.withColumn("held_out", fold_of(docs["doc_id"], 4) == 2), ["doc_id", "held_out"])


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    probe = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{chat.PROBE}'), (-1, 1, 'assistant', '{chat.PROBE}') AS t(conv_id, turn, role, text)")
    probe = probe.to(log.schema) if kinds else probe
    return chat.digests(chat.render(chat.fold(chat.events_of(log.unionByName(probe)))))


OP5 = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ),
    e AS (
        SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g') AS safe_role,
               regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g') AS safe_text
        FROM c
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(safe_role) + length(safe_text) + 24)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
"""


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_text(table(spark, folder, "pages"), ["page_id", "url"])


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op9_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_quality.classify(docs.withColumn("held_out", fold_of(docs["doc_id"], 5) == 0), table(spark, folder, "labels"), ["doc_id", "held_out"])


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).drop("proof")


OP11 = """
    WITH RECURSIVE crc_table AS MATERIALIZED (
        SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ),
    d AS MATERIALIZED (
        SELECT doc_id, lang, coalesce(length(n.s) || ':' || n.s, '-') AS a,
               coalesce(strlen(source) || ':' || source, '-') AS b, coalesce(strlen(lang) || ':' || lang, '-') AS c,
               coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS e, coalesce(strlen(text) || ':' || text, '-') AS f,
               coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS g,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(n.s, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS crc
        FROM documents, crc_table, LATERAL (SELECT doc_id::VARCHAR AS s) n
    ),
    leaf AS MATERIALIZED (
        SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx,
               count(*) OVER (PARTITION BY lang) AS n, sha256(a || b || c || e || f) AS leaf,
               sha256(a || b || c || e || CASE WHEN crc % 3 = 0 THEN g ELSE f END) AS seen
        FROM d
    ),
    node(tree, level, idx, n, digest, kids) AS (
        SELECT tree, 0, idx, n, leaf, NULL::VARCHAR[] FROM leaf
        UNION ALL
        SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
        FROM node WHERE n > 1 GROUP BY tree, level, idx // 8, n
    ),
    upper(tree, level, idx, n, digest, kids) AS (
        SELECT -1, 0, tree, count(*) OVER (), digest, NULL::VARCHAR[] FROM node WHERE n = 1
        UNION ALL
        SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
        FROM upper WHERE n > 1 GROUP BY tree, level, idx // 8, n
    ),
    climb(doc_id, home, level, idx, n, folded, proof) AS (
        SELECT doc_id, tree, 0, idx, n, seen, '' FROM leaf
        UNION ALL
        SELECT c.doc_id, c.home, r.level, r.idx, r.n, sha256(array_to_string(r.kids[1:c.idx % 8] || [c.folded] || r.kids[c.idx % 8 + 2:], '')),
               c.proof || array_to_string(r.kids[1:c.idx % 8] || r.kids[c.idx % 8 + 2:], '')
        FROM climb c JOIN node r ON r.tree = c.home AND r.level = c.level + 1 AND r.idx = c.idx // 8 WHERE c.n > 1
    ),
    rise(doc_id, level, idx, n, folded, proof) AS (
        SELECT c.doc_id, 0, u.idx, u.n, c.folded, c.proof FROM climb c JOIN upper u ON u.level = 0 AND u.idx = c.home WHERE c.n = 1
        UNION ALL
        SELECT c.doc_id, r.level, r.idx, r.n, sha256(array_to_string(r.kids[1:c.idx % 8] || [c.folded] || r.kids[c.idx % 8 + 2:], '')),
               c.proof || array_to_string(r.kids[1:c.idx % 8] || r.kids[c.idx % 8 + 2:], '')
        FROM rise c JOIN upper r ON r.level = c.level + 1 AND r.idx = c.idx // 8 WHERE c.n > 1
    )
    SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = t.digest AS verified
    FROM leaf l JOIN rise r ON r.doc_id = l.doc_id AND r.n = 1 JOIN upper s ON s.level = 0 AND s.idx = l.tree JOIN upper t ON t.n = 1
"""


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_sets(table(spark, folder, "documents"))


OP12 = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    s AS MATERIALIZED (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS shingle
        FROM w
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    edge AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, b.y FROM reach r JOIN edge b ON b.x = r.y),
    low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id
"""


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, label, F.col("vec_id") % 100 == 0)


OP13 = """
    WITH v AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_chat": op5_chat,
    "op6_neighbours": op6_neighbours,
    "op7_main_text": op7_main_text,
    "op8_packing": op8_packing,
    "op9_line_quality": op9_line_quality,
    "op10_token_files": op10_token_files,
    "op11_merkle": op11_merkle,
    "op12_ngram_join": op12_ngram_join,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op1_mixing": OP1, "op5_chat": OP5, "op11_merkle": OP11, "op12_ngram_join": OP12, "op13_hard_negatives": OP13}
