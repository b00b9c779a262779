"""The opN_ queries: each applies an operator to its whole table and derives the digests of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, language_id, line_dedup, lm_score, merkle, near_dedup, packing, periodic, quality, secrets, suffix_dedup
from .common import UPPER, documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return lm_score.score(documents(spark, sf_dir), good)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    applied = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return applied.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "keep_bitmap")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tokens = packing.tokenise(docs, tokenizer_file("word_bpe_49k.json"))
    return packing.pack_groups(tokens, *packing.size_of(docs)).drop("ids")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    base = F.lit(quality.mask(1)).cast("long")
    return judged.withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0)


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the text whose words from a on repeat with period p, in every tenth document by crc32 of its id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " ", -1), "").alias("words"))
    sized = words.withColumns({"n": F.size("words"), "a": (F.col("g") % F.greatest(F.size("words"), F.lit(1))).cast("int")})
    sized = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    return sized.select("doc_id", F.when(planted, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_runs(documents(spark, sf_dir)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    runs = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *periodic.greatest(), F.sha2(runs.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    claimed = F.when(tampered, F.unhex(merkle.leaf(*rest, F.replace("text", F.lit("\n")))))
    proved = merkle.manifest(documents(spark, sf_dir), merkle.leaf(*rest, F.col("text")), carried={"claimed": claimed})
    proved = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), merkle.fold(F.coalesce(F.lower(F.hex("claimed")), F.col("leaf")), F.col("steps")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_ann_search, op3_exact_dedup, op4_language_id, op5_lm_score, op6_line_dedup, op7_suffix_dedup, op8_packing, op9_near_dedup, op10_secret_scan, op11_quality_rules, op12_periodic_runs, op13_merkle_manifest)}

ORACLE_SQL = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS k FROM documents),
             g AS (SELECT k, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY k)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM t JOIN g USING (k)
    """,
    "op6_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
             r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
             j AS (SELECT k.doc_id, pos, line, keeper IS NULL OR keeper = k.doc_id AS kept FROM k LEFT JOIN r USING (key)),
             i AS (SELECT *, kept IS DISTINCT FROM lag(kept) OVER (PARTITION BY doc_id ORDER BY pos) AS starts FROM j),
             n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM i),
             b AS (SELECT doc_id, string_agg(a || '+' || n, ',' ORDER BY a) AS keep_bitmap FROM (SELECT doc_id, run, min(pos) AS a, count(*) AS n FROM n WHERE kept GROUP BY doc_id, run) GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256, coalesce(any_value(keep_bitmap), '') AS keep_bitmap
        FROM j LEFT JOIN b USING (doc_id) GROUP BY doc_id
    """,
    "op11_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
             u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
             g AS (SELECT doc_id, pos, word, lag(word) OVER o AS before, {" || ' ' || ".join("word" if i == 0 else f"lead(word, {i}) OVER o" for i in range(quality.WINDOW))} AS gram
                   FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
             t AS (SELECT doc_id, pos, word = before AS stutters, gram IS NOT NULL AND count(gram) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
             c AS (SELECT doc_id, stutters, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {quality.WINDOW - 1} PRECEDING AND CURRENT ROW) AS covered FROM t),
             r AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words, count(*) FILTER (stutters) AS n_stutters FROM c GROUP BY doc_id),
             m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                          len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_word_lines,
                          len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
                          len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
                          len(list_filter(words, lambda x: regexp_matches(x, '\\pL'))) AS n_letter_words,
                          len(list_filter({list(quality.FUNCTION_WORDS)}, lambda x: list_contains(words, x))) AS n_function_words, coalesce(n_stutters, 0) AS n_stutters
                   FROM w LEFT JOIN r USING (doc_id)),
             f AS (SELECT *, {" + ".join(f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES))} AS failed FROM m)
        SELECT *, {quality.LATEST} AS policy, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed & {quality.mask()} = 0 AS kept FROM f
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE
             d AS (SELECT doc_id, source, row_number() OVER () AS rid, text, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT) AS codes,
                          concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head
                   FROM documents),
             c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, codes), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc FROM d),
             h AS (SELECT doc_id, source, rid, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                          CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed FROM c),
             s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, count(*) OVER () AS sources FROM (SELECT DISTINCT source FROM documents)),
             v AS (SELECT h.*, sid, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY sid) AS n FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
             t AS (SELECT sid, 0 AS level, idx, n, leaf AS digest FROM v
                   UNION ALL SELECT sid, level + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY sid, level, idx // 3),
             r AS (SELECT sid, level AS height, digest AS subroot FROM t WHERE n = 1),
             u AS (SELECT 0 AS level, sid AS idx, sources AS n, subroot AS digest FROM r JOIN s USING (sid)
                   UNION ALL SELECT level + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 3),
             g AS (SELECT rid, unnest(range(height)) AS level, sid, idx FROM v JOIN r USING (sid)),
             a AS (SELECT rid, g.level, t.digest, t.idx AS place, g.idx // (3 ** g.level)::BIGINT AS own FROM g LEFT JOIN t ON t.sid = g.sid AND t.level = g.level AND t.idx // 3 = g.idx // (3 ** (g.level + 1))::BIGINT),
             b AS (SELECT sid, u.level, u.digest, u.idx AS place, sid // (3 ** u.level)::BIGINT AS own FROM r JOIN u ON u.n > 1 AND u.idx // 3 = sid // (3 ** (u.level + 1))::BIGINT),
             p AS (SELECT rid, level, digest, place, own FROM a UNION ALL SELECT rid, height + b.level, b.digest, place, own FROM v JOIN r USING (sid) JOIN b USING (sid)),
             q AS (SELECT rid, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS r FROM p GROUP BY rid, level),
             f AS (SELECT rid, 0 AS level, claimed AS cur FROM v UNION ALL SELECT f.rid, f.level + 1, sha256(q.l || cur || q.r) FROM f JOIN q ON q.rid = f.rid AND q.level = f.level),
             e AS (SELECT rid, arg_max(cur, level) AS folded_root FROM f GROUP BY rid),
             w AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM q GROUP BY rid)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM v JOIN r USING (sid) JOIN e USING (rid) LEFT JOIN w USING (rid), (SELECT digest AS root FROM u WHERE n = 1)
    """,
}
