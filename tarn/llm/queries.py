"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, hard_negatives, language_id, license_scan, ngram_join, packing, pii, piece_codec, prefix_trie, quality_rules, sharding, token_codec, warc

#: Production parameters.
SHARD_BYTES = 64 << 20
SMALL_SHARD_BYTES = 64 << 10
TOKEN_BUDGET = 8192
BUCKETS = 16
#: Conversations that take their first turns from one of them.
TRIE_FAMILY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def _sharded(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), limit)


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharded(spark, sf_dir, SHARD_BYTES)


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharded(spark, sf_dir, SMALL_SHARD_BYTES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exact_dedup.decisions(table(spark, sf_dir, "documents"), keep="largest")
    return made.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.lengths_of(table(spark, sf_dir, "documents"))
    return packing.pack(rows, TOKEN_BUDGET, BUCKETS).withColumnRenamed("key", "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is; set TARN_TOKENIZERS to a folder to use other files."""
    folder = os.environ.get("TARN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"))
    made = warc.read_back(spark, path)
    return made.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_codec.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_codec.read_tokens(spark, path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = quality_rules.BASE.rejects().alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "fail_bits")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    take = F.crc32(F.col("conv_id").cast("string")) % (prefix_trie.MAX_GRAFT + 1)
    rows = prefix_trie.grafted(turns, F.col("conv_id") - F.col("conv_id") % TRIE_FAMILY, take)
    return prefix_trie.trie(rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    made = language_id.predict(docs, model)
    return made.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


POLICIES = (quality_rules.STANDARD, quality_rules.STRICT)


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a policy over one ledger: what each rule rejects, and rejects alone."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.ablation(rows, POLICIES[0]).unionByName(quality_rules.ablation(rows, POLICIES[1]))


def quality_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two versions of a policy keep, and what the second takes away and gives back."""
    return quality_rules.compared(quality_rules.ledger(table(spark, sf_dir, "documents")), *POLICIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_extendible_sharding": op2_extendible_sharding,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_warc": op6_warc,
        "op7_token_files": op7_token_files,
        "op8_quality_rules": op8_quality_rules,
        "op9_pii": op9_pii,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_language_id": op13_language_id,
        "sharding_small_limit": sharding_small_limit,
        "quality_ablation": quality_ablation,
        "quality_versions": quality_versions,
    }


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sharding_sql(limit: int) -> str:
    return f"""
    WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
    n AS (SELECT CAST(d AS INTEGER) AS depth, h >> CAST(60 - d AS INTEGER) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
          FROM r, range(0, 61) t(d) GROUP BY 1, 2),
    s AS (SELECT r.doc_id, r.n_bytes, min(n.depth) AS depth FROM r JOIN n ON r.h >> CAST(60 - n.depth AS INTEGER) = n.prefix
          WHERE n.shard_bytes <= {limit} OR n.depth = 60 GROUP BY r.doc_id, r.n_bytes)
    SELECT s.doc_id, s.n_bytes, s.depth, CASE WHEN s.depth = 0 THEN '' ELSE right(lpad(bin(n.prefix), 60, '0'), s.depth) END AS shard, n.shard_bytes, n.shard_rows, n.shard_bytes > {limit} AS oversized
    FROM s JOIN r USING (doc_id) JOIN n ON n.depth = s.depth AND n.prefix = r.h >> CAST(60 - s.depth AS INTEGER)"""


#: crc32 of a decimal id: one list element a byte, then eight for its bits.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
    lambda x: list_concat([CAST(ascii(x) AS BIGINT)], list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _trie_sql() -> str:
    return rf"""
    WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % {TRIE_FAMILY} AS base, {CRC32_SQL.format("conv_id")} % 4 AS h, max(pos) AS n FROM t GROUP BY conv_id),
    g AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS nb FROM c LEFT JOIN c b ON b.conv_id = c.base),
    r AS (SELECT g.conv_id, t.pos AS d, t.role, t.text FROM g JOIN t ON t.conv_id = g.base AND t.pos <= g.nb
          UNION ALL SELECT g.conv_id, t.pos - g.h + g.nb, t.role, t.text FROM g JOIN t ON t.conv_id = g.conv_id AND t.pos > g.h),
    p AS (SELECT conv_id, d, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, text FROM r
          UNION ALL SELECT conv_id, 0, '', '' FROM g),
    l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
    n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(regexp_extract_all(text, '[^ 	-
]+'))) AS w FROM p GROUP BY d, k),
    u AS (SELECT DISTINCT n.conv_id, n.d, m.conv_id AS up FROM n LEFT JOIN p ON p.d = n.d - 1 AND p.conv_id = n.conv_id LEFT JOIN n m ON m.d = p.d AND m.k = p.k),
    f AS (SELECT n.*, u.up, (SELECT count(*) FROM u v WHERE v.up = n.conv_id AND v.d = n.d + 1) AS n_children FROM n JOIN u ON u.conv_id = n.conv_id AND u.d = n.d),
    a AS (SELECT conv_id AS a_conv, d AS a_d, conv_id, d FROM f UNION ALL SELECT f.up, a.a_d - 1, a.conv_id, a.d FROM a JOIN f ON f.conv_id = a.a_conv AND f.d = a.a_d WHERE f.d > 0),
    s AS (SELECT a.a_conv, a.a_d, CAST(sum((f.n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.w) AS BIGINT) AS saved_tokens FROM a JOIN f ON f.conv_id = a.conv_id AND f.d = a.d GROUP BY 1, 2),
    e AS (SELECT p.d, p.k, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS h FROM p JOIN l ON l.conv_id = p.conv_id AND l.d = p.d GROUP BY p.d, p.k)
    SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.up AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
    FROM f JOIN s ON s.a_conv = f.conv_id AND s.a_d = f.d LEFT JOIN e ON e.d = f.d AND e.k = f.k"""


def _rejects_sql(policy: quality_rules.Policy, without: str = "") -> str:
    veto, vote = (sum(quality_rules.BIT[r] for r in rules if r != without) for rules in (policy.veto, policy.vote))
    return f"((fail_bits & {veto}) <> 0 OR bit_count(fail_bits & {vote}) >= {policy.votes})"


def _policy_sql(ledger: str) -> dict[str, str]:
    """SQL of the policies' queries, over the ledger as SQL has it."""
    name = lambda p: f"{p.name}-{p.version}"
    ablation = [
        f"SELECT '{name(p)}' AS policy, '{rule}' AS rule, count(*) FILTER ((fail_bits & {quality_rules.BIT[rule]}) <> 0) AS n_failed, count(*) FILTER ({_rejects_sql(p)} AND NOT {_rejects_sql(p, rule)}) AS n_only_by_this FROM q"
        for p in POLICIES for rule in (*p.veto, *p.vote)
    ]
    versions = []
    for old, p in zip((POLICIES[0], *POLICIES), POLICIES, strict=False):
        now, before = _rejects_sql(p), _rejects_sql(old)
        versions.append(f"SELECT '{name(p)}' AS policy, count(*) AS n_rows, count(*) FILTER (NOT {now}) AS n_kept, count(*) FILTER ({now} AND NOT {before}) AS n_lost, count(*) FILTER (NOT {now} AND {before}) AS n_won FROM q")
    return {k: f"WITH q AS ({ledger}) " + " UNION ALL ".join(parts) for k, parts in (("quality_ablation", ablation), ("quality_versions", versions))}


def oracle_sql() -> dict[str, str]:
    found = _oracles()
    return found | _policy_sql(found["op8_quality_rules"])


def _oracles() -> dict[str, str]:
    rules = " + ".join(f"CASE WHEN {sql} THEN {1 << i} ELSE 0 END" for i, (_, sql) in enumerate(quality_rules.RULES))
    veto = sum(quality_rules.BIT[r] for r in quality_rules.STANDARD.veto)
    vote = sum(quality_rules.BIT[r] for r in quality_rules.STANDARD.vote)
    return {
        "op2_extendible_sharding": _sharding_sql(SHARD_BYTES),
        "sharding_small_limit": _sharding_sql(SMALL_SHARD_BYTES),
        "op3_exact_dedup": f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
        "op6_warc": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, h, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
           {" || ".join(f"substr('{warc.BASE32}', CAST((CAST('0x' || substr(s, {5 * i + 1}, 5) AS BIGINT) >> {b}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for b in (15, 10, 5, 0))} AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, TRUE AS intact FROM d""",
        "op11_hard_negatives": """
    WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, r.vec_id AS i, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s FROM r a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
    p AS (SELECT a, i, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, i) <= 5)
    SELECT p.a AS anchor_id, p.i AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.i ORDER BY n.s DESC, n.i) AS INTEGER) AS rank, n.i AS negative_id, p.s AS positive_score, n.s AS negative_score
    FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
    QUALIFY rank <= 3""",
        "op12_prefix_trie": _trie_sql(),
        "op8_quality_rules": rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM t),
    p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM d, range(0, 3) r(o) WHERE k > 1 GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                 coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
                 length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^|]', '', 'g')) AS n_pipes
          FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
    b AS (SELECT *, CAST({rules} AS INTEGER) AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
           NOT ((fail_bits & {veto}) <> 0 OR bit_count(fail_bits & {vote}) >= 2) AS kept, fail_bits FROM b""",
    }
