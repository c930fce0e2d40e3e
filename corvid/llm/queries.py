"""Queries of this subpackage over the whole tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import align, audit, fingerprint, itq, langid, linededup, minhash, packing, pieces, quality, sharding, warc, weakrules
from corvid.llm.common import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    # written in between: the same Python workers encode first and decode then, and a lost executor encodes nothing again
    encoded = written(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), f"{shared_dir(spark)}/ids")
    decoded = pieces.decode(encoded, model)
    text = F.encode("text", "UTF-8")
    return decoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.length("text").alias("decoded_chars"), F.crc32(text).alias("decoded_crc32"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    field = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out))
    doc, score = F.col("record.doc_id"), F.col("score")
    return quality.score(docs, field).select(doc.alias("doc_id"), (langid.fold(doc, 5) == 0).alias("held_out"), "score", F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return done.select(F.col("record.doc_id").alias("doc_id"), "text", "n_units", "n_removed", spans.alias("removed"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), shards=40)


def op9_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, langid.fold(F.col("doc_id"), 3) != 1)
    found = langid.identify(docs.select("doc_id", "text"), model)
    doc = F.col("record.doc_id")
    return found.select(doc.alias("doc_id"), (langid.fold(doc, 3) == 1).alias("held_out"), "found.lang_pred", "found.score")


def op7_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return done.select("doc_id", *align.FIELDS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weakrules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(F.col("record.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_crf": op2_quality_crf,
    "op3_warc_archive": op3_warc_archive,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_itq_near_vectors": op7_itq_near_vectors,
    "op8_external_shuffle": op8_external_shuffle,
    "op9_canonical_fingerprint": op9_canonical_fingerprint,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_alignment": op12_token_alignment,
    "op13_weak_rules": op13_weak_rules,
}

#: Smallest node reachable over links(a, b) from each of nodes(id).
_REACH = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.b = l.a),
        parts AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""
_BITS = ", ".join(f"'{k:04b}'" for k in range(16))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH units AS (
            SELECT doc_id, pos - 1 AS pos, unit, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS folded
            FROM (SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS pos
                  FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] |[。！？])', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents))
        ), placed AS (
            SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                   row_number() OVER (PARTITION BY folded ORDER BY doc_id, pos) > 1 AS repeated
            FROM units
        ), runs AS (
            SELECT doc_id, pos, length(folded) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, repeated ORDER BY pos) AS run
            FROM placed WHERE folded <> '' QUALIFY repeated
        ), gone AS (
            SELECT doc_id, pos, sum(chars) OVER (PARTITION BY doc_id, run) >= 160 AS gone FROM runs
        ), told AS (SELECT p.*, coalesce(g.gone, false) AS gone FROM placed p LEFT JOIN gone g USING (doc_id, pos))
        SELECT doc_id, coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_units,
               CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
               coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(length(unit) AS VARCHAR), ',' ORDER BY pos) FILTER (gone), '') AS removed
        FROM told GROUP BY doc_id
    """,
    "op3_warc_archive": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: [{_BITS}][instr('0123456789abcdef', substr(hex, i, 1))]), '') AS bits, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, k * 5 + j + 1, 1) AS INTEGER) * (16 >> j)))::INTEGER + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b
    """,
    "op7_itq_near_vectors": f"""
        WITH RECURSIVE u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u),
        nodes AS (SELECT id FROM n),
        links AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.label = y.label AND x.id < y.id WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.98), {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id OR b = id) AS n_links, component_id, id = component_id AS kept FROM parts
    """,
    "op10_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0b\f\r]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
        nodes AS (SELECT doc_id AS id FROM s), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))), {_REACH}
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN parts ON id = doc_id
    """,
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0b\f\r]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
                CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' ELSE '' END ||
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        h AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1 : step - 1] AS before FROM o, range(1, 6) r(step)),
        x AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, h.*, contains(fails, f) AS hit, coalesce(list_has_any(string_split(before, ''), string_split(fails, '')), false) AND before <> '' AND fails <> '' AS early FROM s, h),
        r AS (SELECT part, filter_order, step, f,
                CAST(sum(n) FILTER (NOT hit AND NOT early) AS BIGINT) AS kept, CAST(sum(n) FILTER (hit AND NOT early) AS BIGINT) AS removed, CAST(sum(n) FILTER (hit AND early) AS BIGINT) AS redundant,
                CAST(sum(n) FILTER (fails = f) AS BIGINT) AS unique_fails, CAST(sum(n) FILTER (hit AND NOT early AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (hit AND NOT early AND toxic) AS BIGINT) AS toxic_lost
              FROM x GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
               coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
        FROM r
    """,
}
