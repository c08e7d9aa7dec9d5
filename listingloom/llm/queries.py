"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from listingloom.llm import (
    crc_resampling,
    decontamination,
    exact_dedup,
    filter_audit,
    importance,
    language,
    packing,
    ppm,
    preference,
    simhash_trie,
    surrogates,
    token_counts,
    toxicity,
)
from listingloom.llm.common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    """Every document's weight, and whether the sample of half the documents has it."""
    return importance.importance_sample(read(spark, d, "documents"), read(spark, d, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the window."""
    hits = decontamination.benchmark_hits(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return hits.select("doc_id", "item_id", "start", "n_words", "similarity")


def op3_pii_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.surrogate_texts(read(spark, d, "documents"))


def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, d, "documents"))


def op5_preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation with a reply against itself with its neighbour's last reply."""
    turns, pairs = preference.swapped_replies(read(spark, d, "conversations"))

    def text(spans: str) -> Column:
        each = F.transform(spans, lambda s: F.concat_ws("+", s["start"], s["length"]))
        return F.array_join(each, ",").alias(spans)

    made = preference.preference_pairs(turns, pairs)
    return made.select(
        "pair_id", "common_turns", "prompt", "chosen", "rejected",
        text("chosen_spans"), text("rejected_spans"),
    )


def op6_noisy_channel_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, read(spark, d, "labels"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(read(spark, d, "documents"))


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    found = language.languages(read(spark, d, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    groups = simhash_trie.near_groups(read(spark, d, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_ppm_scores(spark: SparkSession, d: str) -> DataFrame:
    return ppm.text_scores(read(spark, d, "documents"))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, d, "documents"), read(spark, d, "labels"))


def op13_target_resampling(spark: SparkSession, d: str) -> DataFrame:
    return crc_resampling.resample(read(spark, d, "documents"), read(spark, d, "benchmark"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_importance_resampling, op2_benchmark_decontamination, op3_pii_surrogates,
        op4_exact_dedup, op5_preference_pairs, op6_noisy_channel_toxicity, op7_best_fit_packing,
        op8_token_counts, op9_language_id, op10_simhash_near_dedup, op11_ppm_scores,
        op12_filter_audit, op13_target_resampling, pipeline,
    )
}

LLM_ORACLES: dict[str, str] = {
    "op5_preference_pairs": """
        WITH last AS (
            SELECT conv_id, max(turn) AS turn FROM conversations
            WHERE role = 'assistant' GROUP BY conv_id
        ),
        replies AS (
            SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN last l
            ON c.conv_id = l.conv_id AND c.turn = l.turn
        ),
        rejected_turns AS (
            SELECT c.conv_id, c.turn, c.role, c.text
            FROM conversations c JOIN last l ON c.conv_id = l.conv_id WHERE c.turn < l.turn
            UNION ALL
            SELECT a.conv_id, a.turn, 'assistant', coalesce(b.text, '')
            FROM replies a LEFT JOIN replies b ON b.conv_id = xor(a.conv_id, 1)
        ),
        chosen_turns AS (
            SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
            JOIN last l ON c.conv_id = l.conv_id
        ),
        both_sides AS (
            SELECT 'c' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
            FROM chosen_turns
            UNION ALL
            SELECT 'r', *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
            FROM rejected_turns
        ),
        compared AS (
            SELECT conv_id, k, count(*) = 2 AND count(DISTINCT role) = 1
                   AND count(DISTINCT text) = 1 AS same
            FROM both_sides GROUP BY conv_id, k
        ),
        common AS (
            SELECT conv_id, CAST(coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS INTEGER) AS n
            FROM compared GROUP BY conv_id
        ),
        written AS (
            SELECT b.conv_id, b.side, b.k, b.k <= c.n AS shared, b.role,
                   '<|' || b.role || '|>' || chr(10) AS head,
                   '<|' || b.role || '|>' || chr(10) || b.text || '<|end|>' || chr(10) AS turn_text
            FROM both_sides b JOIN common c ON b.conv_id = c.conv_id
        ),
        placed AS (
            SELECT *, sum(length(turn_text)) OVER
                   (PARTITION BY conv_id, side, shared ORDER BY k) - length(turn_text) AS pos
            FROM written
        )
        SELECT p.conv_id AS pair_id, c.n AS common_turns,
            coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (WHERE side = 'c' AND shared), '') AS prompt,
            coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared), '') AS chosen,
            coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared), '') AS rejected,
            coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '+' ||
                CAST(length(turn_text) - length(head) - 1 AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_spans,
            coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '+' ||
                CAST(length(turn_text) - length(head) - 1 AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_spans
        FROM placed p JOIN common c ON p.conv_id = c.conv_id
        GROUP BY p.conv_id, c.n
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_filter_audit": """
        WITH labelled AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
                   bool_or(coalesce(toxic = 1, false)) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ),
        docs AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ),
        flagged AS (
            SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body)
                      THEN 4 ELSE 0 END)
                   + (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END)
                   + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END) AS mask
            FROM docs d LEFT JOIN labelled l ON d.doc_id = l.doc_id
        ),
        counted AS (
            SELECT part, mask, good, toxic, count(*) AS n FROM flagged GROUP BY ALL
        ),
        letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
        ),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
              AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ),
        steps AS (
            SELECT filter_order, step, letter, bit AS own,
                   (SELECT coalesce(sum(l.bit), 0) FROM letters l
                    WHERE instr(substr(filter_order, 1, step - 1), l.letter) > 0)::BIGINT AS earlier
            FROM orders, generate_series(1, 5) AS g(step), letters
            WHERE letter = substr(filter_order, step, 1)
        ),
        made AS (
            SELECT part, filter_order, step, letter,
                sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & earlier <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 AND good THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM counted, steps GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept,
               removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM made
    """,
}
