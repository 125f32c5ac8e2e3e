"""Queries of providers, runs, measures and files, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import _CHAT, _FIRST, _ISSUES, _NB, _STRIP, _TOKENS, WS, labelled, query, table
from .functions.text import split_words
from .functions.work import cut, work_dir
from .operators import analysis, dedup, generate, metrics, recognise, records
from .plans.curate import CurateConfig, curate
from .plans.pipeline import PipelineConfig, Run, prepare, profile_records, read_records
from .providers.offline import HashedNgrams, OfflineProvider
from .sources import files


def doc_records(spark, sf_dir):
    """documents as records with prompt, response, classify_text and content."""
    return records.to_records(table(spark, sf_dir, "documents"), "doc_id")


def chat_records(spark, sf_dir):
    return records.to_records(records.assemble_chats(table(spark, sf_dir, "conversations")), "conv_id")


def doc_lines(spark, sf_dir, *columns):
    """documents as JSON lines with _ord."""
    docs = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), *columns), {"ignoreNullFields": "false"})
    return docs.select(F.col("doc_id").alias("_ord"), line.alias("value"))


_SCORE = f"""SELECT doc_id, len(issues) = 0 AS ok, CASE WHEN len(issues) = 0 THEN 10::DOUBLE * (0.6::DOUBLE * v + 0.4::DOUBLE * least(1::DOUBLE, n / 50)) ELSE 2 END AS overall
    FROM (SELECT doc_id, len(t) AS n, CASE WHEN len(t) = 0 THEN 0 ELSE len(list_distinct(t)) / len(t) END::DOUBLE AS v FROM (SELECT doc_id, {_TOKENS.replace("text", "left(coalesce(text, ''), 2500)")} AS t FROM documents)) JOIN ({_ISSUES}) USING (doc_id)"""


@query(f"SELECT doc_id, ok AS rule_check_passed, round(overall, 6) AS overall_score, ok AND overall >= 7 AS kept FROM ({_SCORE})")
def audit_scores(spark, sf_dir):
    scored = generate.audit(doc_records(spark, sf_dir), "doc_id", OfflineProvider())
    return generate.quality_split(scored, 7.0).select("doc_id", "rule_check_passed", F.round("overall_score", 6).alias("overall_score"), "kept")


def _tidy(c: str) -> str:
    words = f"array_to_string(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> ''), ' ')"
    return f"upper(left({words}, 1)) || substr({words}, 2)"


@query(f"SELECT conv_id, {_tidy('prompt')} AS prompt, {_tidy('response')} AS response FROM ({_CHAT})")
def refine_offline(spark, sf_dir):
    return generate.refine(chat_records(spark, sf_dir), "conv_id", OfflineProvider()).select("conv_id", "prompt", "response")


@query(f"""SELECT conv_id::VARCHAR AS original_id, k AS evolution_type, trim(prompt || chr(10) || CASE k WHEN 'deepen_reasoning' THEN 'Explain each step and why it follows.' WHEN 'add_constraints' THEN 'Answer in at most three sentences and name one limit.' ELSE 'Use one concrete example.' END) AS prompt, response
    FROM (SELECT *, ['deepen_reasoning', 'add_constraints', 'concretize'][1 + (row_number() OVER (ORDER BY conv_id) - 1) % 3] AS k FROM ({_CHAT}))""")
def evolve_offline(spark, sf_dir):
    return generate.evolve(chat_records(spark, sf_dir), "conv_id", OfflineProvider()).select("original_id", "evolution_type", "prompt", "response")


_FIRST_SENTENCE = "regexp_extract(s, '(?s)^(.*?[.!?])\\s', 1)"


@query(f"SELECT conv_id::VARCHAR AS original_id, 'dpo' AS fmt, prompt, response AS chosen, CASE WHEN {_FIRST_SENTENCE} <> '' THEN {_FIRST_SENTENCE} ELSE left(s, length(s) // 2) END AS rejected FROM (SELECT *, {_STRIP.replace('text', 'response')} AS s FROM ({_CHAT}))")
def dpo_offline(spark, sf_dir):
    return generate.preference_pairs(chat_records(spark, sf_dir), "conv_id", OfflineProvider()).select("original_id", "fmt", "prompt", "chosen", "rejected")


_ROTATED = f"""p AS ({_NB}),
    o AS (SELECT doc_id, text, toxic::VARCHAR AS label, list_filter(regexp_split_to_array(left(coalesce(text, ''), 4000), '{WS}+'), lambda x: x <> '') AS w FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
    r AS (SELECT doc_id, label, text, array_to_string(w[2:] || w[:1], ' ') AS new FROM o WHERE len(w) > 1),
    b AS (SELECT doc_id, label, false AS is_synthetic, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_'']+'), ' ') AS norm FROM o
        UNION ALL SELECT doc_id, label, true, array_to_string(regexp_extract_all(lower(new), '[a-z0-9_'']+'), ' ') FROM r JOIN p USING (doc_id) WHERE predicted = label AND confidence >= 0.55
        AND len(regexp_extract_all(new, '[A-Za-z0-9_'']+')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_'']+'))) BETWEEN 0.5 AND 2)"""


@query(f"""WITH {_ROTATED} SELECT doc_id::VARCHAR AS source, label, is_synthetic FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY is_synthetic, doc_id::VARCHAR) AS k FROM b WHERE norm <> '') WHERE k = 1""")
def augment_offline(spark, sf_dir):
    rows = labelled(spark, sf_dir).where("toxic is not null")
    return generate.augment(rows, "doc_id", "text", "toxic", OfflineProvider()).select(F.coalesce("source_id", "id").alias("source"), "label", "is_synthetic")


@query(f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN ['the', 'de', 'und'][1 + length(t) % 3] WHEN a >= b AND a >= c THEN 'the' WHEN b >= c THEN 'de' ELSE 'und' END AS label
    FROM (SELECT doc_id, t, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'de')) AS b, len(list_filter(w, lambda x: x = 'und')) AS c
    FROM (SELECT doc_id, left(coalesce(text, ''), 4000) AS t, {_TOKENS.replace("text", "left(coalesce(text, ''), 4000)")} AS w FROM documents WHERE {_STRIP} <> ''))""")
def classify_offline(spark, sf_dir):
    found = generate.classify(table(spark, sf_dir, "documents"), "doc_id", "text", OfflineProvider(), "multi-class", ["the", "de", "und"])
    return found.where("classification_error is null").select("doc_id", F.col("labels")[0].alias("label"))


@query(f"""SELECT doc_id, (k - 1)::INT AS k, 'What does the text say about ' || array_to_string(string_split(s, ' ')[1:4], ' ') || '?' AS instruction, s AS output
    FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter(string_split(regexp_replace(array_to_string(list_filter(regexp_split_to_array(left(coalesce(text, ''), 50000), '{WS}+'), lambda x: x <> ''), ' '), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(string_split(x, ' ')) >= 5)[1:3] AS l FROM documents))""")
def synthesize_offline(spark, sf_dir):
    return generate.synthesize(table(spark, sf_dir, "documents"), "doc_id", "text", OfflineProvider(), 3).select("doc_id", "k", "instruction", "output")


@query(f"""SELECT f.doc_id, CASE WHEN coalesce(text, '') = '' THEN 'validate' WHEN rn > 1 THEN 'dedup' WHEN overall < 7 THEN 'filter' END AS stage,
    CASE WHEN coalesce(text, '') = '' THEN 'no usable text' WHEN rn > 1 THEN 'exact_duplicate' WHEN overall < 7 THEN 'Final quality score ' || printf('%.2f', overall) || ' is below 7.00.' END AS reason
    FROM ({_FIRST}) f JOIN ({_SCORE}) s USING (doc_id)""")
def pipeline_full(spark, sf_dir):
    config = PipelineConfig(dedup_method="exact", classification="off", scrub_pii=False)
    rows = Run(config).run(prepare(records.from_lines(doc_lines(spark, sf_dir), keep=("_ord",)))).rows
    return rows.select(F.col("_ord").alias("doc_id"), "stage", "reason")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, quality::VARCHAR AS label, 'strict_existing_labels' AS action FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND coalesce(text, '') <> ''")
def pipeline_strict(spark, sf_dir):
    docs = labelled(spark, sf_dir).where("quality is not null")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label")))
    result = Run(PipelineConfig(accuracy_contract="strict")).run(prepare(records.from_lines(docs.select(F.col("doc_id").alias("_ord"), line.alias("value")), keep=("_ord",))))
    action = result.metrics["stages"]["classify"]["action"]
    return result.accepted.select(F.col("_ord").alias("doc_id"), F.md5("text").alias("text_md5"), F.col("labels")[0].alias("label"), F.lit(action).alias("action"))


@query("SELECT 'raw' AS format, count(*) AS row_count, 'label' AS existing_label_field, count(DISTINCT quality) > 1 AS classification_applicable, string_agg(DISTINCT quality::VARCHAR, ',' ORDER BY quality::VARCHAR) AS classes, CASE count(DISTINCT quality) WHEN 2 THEN 'binary' WHEN 1 THEN NULL ELSE 'multi-class' END AS task_type FROM documents JOIN labels USING (doc_id)")
def profile_records_full(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label")), {"ignoreNullFields": "false"})
    p = profile_records(records.from_lines(docs.select(F.col("doc_id").alias("_ord"), line.alias("value")), keep=("_ord",)), OfflineProvider())
    row = (p["format"], p["row_count"], p["existing_label_field"], p["classification_applicable"], ",".join(p["classes"]), p["task_type"])
    return spark.createDataFrame([row], "format string, row_count long, existing_label_field string, classification_applicable boolean, classes string, task_type string")


@query("SELECT doc_id::VARCHAR AS id, 'raw' AS fmt, md5(coalesce(text, '')) AS text_md5, lang AS label FROM documents UNION ALL SELECT 'c' || conv_id, 'chat', md5(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role IN ('user', 'human'))), NULL FROM conversations GROUP BY conv_id")
def records_per_row(spark, sf_dir):
    docs = doc_lines(spark, sf_dir, F.col("lang").alias("label")).select("value")
    chats = records.assemble_chats(table(spark, sf_dir, "conversations"))
    chats = chats.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), "messages")).alias("value"))
    rows = records.from_lines(docs.unionByName(chats))
    return rows.select("id", "fmt", F.md5("classify_text").alias("text_md5"), F.col("labels")[0].alias("label"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_cell_decode(spark, sf_dir):
    rows = files.decode_cells(table(spark, sf_dir, "events").select("event_id", "props"), "props", "map<string,string>")
    return rows.select("event_id", F.explode("props.json")).select("event_id", "key", "value")


@query(f"""WITH j AS (SELECT item_id, {_TOKENS.replace("text", "coalesce(d.text, '')")} AS p, {_TOKENS.replace("text", "coalesce(b.text, '')")} AS e FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    c AS (SELECT item_id, t, count(*) FILTER (s = 'p') AS a, count(*) FILTER (s = 'e') AS b FROM (SELECT item_id, unnest(p) AS t, 'p' AS s FROM j UNION ALL SELECT item_id, unnest(e), 'e' FROM j) GROUP BY ALL),
    o AS (SELECT item_id, sum(least(a, b)) AS o FROM c GROUP BY item_id)
    SELECT item_id, (p = e)::INT::DOUBLE AS exact_match, round(CASE WHEN len(p) + len(e) = 0 THEN 1 ELSE 2 * coalesce(o, 0) / (len(p) + len(e)) END, 6) AS token_f1 FROM j LEFT JOIN o USING (item_id)""")
def token_f1_benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").alias("b").join(table(spark, sf_dir, "documents").alias("d"), F.col("b.item_id") == F.col("d.doc_id")).select("item_id", F.col("d.text").alias("p"), F.col("b.text").alias("e"))
    return metrics.answer_scores(rows, "p", "e").select("item_id", "exact_match", F.round("token_f1", 6).alias("token_f1"))


@query()
def rouge_l_benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").alias("b").join(table(spark, sf_dir, "documents").alias("d"), F.col("b.item_id") == F.col("d.doc_id")).select("item_id", F.col("d.text").alias("p"), F.col("b.text").alias("e"))
    return metrics.answer_scores(rows, "p", "e").select("item_id", F.round("rouge_l", 6).alias("rouge_l"))


_BIGRAMS = f"""t AS (SELECT {_TOKENS.replace("text", "coalesce(text, '')")} AS w FROM benchmark),
    b AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM t) GROUP BY ALL),
    c AS (SELECT a, sum(n) AS total, first(b ORDER BY n DESC, b) AS best FROM b GROUP BY a),
    v AS (SELECT greatest(1, count(DISTINCT x)) AS v FROM (SELECT unnest(w) AS x FROM t)),
    d AS (SELECT doc_id, {_TOKENS.replace("text", "coalesce(text, '')")} AS w FROM documents),
    h AS (SELECT doc_id, p.a AS a, p.b AS b, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM d) GROUP BY ALL),
    s AS (SELECT doc_id, k, h.b = best AS hit, -ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * (SELECT v FROM v))) AS nll FROM h LEFT JOIN b USING (a, b) LEFT JOIN c ON c.a = h.a)"""


@query(f"WITH {_BIGRAMS} SELECT sum(k)::BIGINT AS eval_transitions, round(coalesce(sum(k) FILTER (hit), 0) / sum(k), 6) AS next_token_accuracy, round(exp(sum(nll * k) / sum(k)), 4) AS perplexity FROM s")
def bigram_language_model(spark, sf_dir):
    out = metrics.language_model(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("eval_transitions", F.round("next_token_accuracy", 6).alias("next_token_accuracy"), F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {_BIGRAMS} SELECT doc_id, round(exp(sum(nll * k) / sum(k)), 4) AS perplexity, exp(sum(nll * k) / sum(k)) <= 900 AS kept FROM s GROUP BY doc_id")
def perplexity_filter(spark, sf_dir):
    out = metrics.perplexity_filter(table(spark, sf_dir, "documents"), "doc_id", "text", 900.0, table(spark, sf_dir, "benchmark"))
    return out.where("perplexity < double('inf')").select("doc_id", F.round("perplexity", 4).alias("perplexity"), "kept")


_OUTCOME = f"SELECT doc_id, lang, source, CASE WHEN coalesce(text, '') = '' THEN 'validate' WHEN rn > 1 THEN 'dedup' WHEN len(issues) > 0 THEN 'filter' END AS stage FROM ({_FIRST}) f JOIN ({_ISSUES}) i USING (doc_id)"


def outcome(spark, sf_dir):
    return curate(table(spark, sf_dir, "documents"), "doc_id", CurateConfig(redact_pii=False))


@query(f"SELECT lang AS category, sum(n)::BIGINT AS input, coalesce(sum(n) FILTER (stage IS NULL), 0)::BIGINT AS retained, coalesce(sum(n) FILTER (stage IS NOT NULL), 0)::BIGINT AS lost, coalesce(string_agg(stage || '=' || n, ',' ORDER BY stage), '') AS lost_by_stage FROM (SELECT lang, stage, count(*) AS n FROM ({_OUTCOME}) GROUP BY ALL) GROUP BY lang")
def defect_breakdown(spark, sf_dir):
    rows = metrics.defect_breakdown(outcome(spark, sf_dir), "lang", "stage")
    shown = F.array_join(F.transform(F.map_entries("lost_by_stage"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.withColumn("lost_by_stage", shown)


@query(f"""WITH g AS (SELECT k, sum(n) AS n, count(*) AS l, max(n) AS top FROM (SELECT coalesce(text, '') AS k, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY k), o AS ({_OUTCOME})
    SELECT (SELECT count(*) FROM o) AS input_rows, (SELECT count(*) FROM o WHERE stage IS NULL) AS retained_rows, (SELECT count(*) FROM o WHERE stage IS NOT NULL) AS deleted_rows, count(*) AS unique_content_rows, count(*) FILTER (n > 1) AS duplicate_groups,
    coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (l > 1) AS conflicting_groups, coalesce(sum(n - top) FILTER (l > 1), 0)::BIGINT AS conflicting_rows, coalesce(sum(n) FILTER (k = ''), 0)::BIGINT AS empty_rows FROM g""")
def hygiene_outcome(spark, sf_dir):
    out = metrics.hygiene_summary(outcome(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "text", "lang", "stage", "reason")
    return out.select("input_rows", "retained_rows", "deleted_rows", "unique_content_rows", "duplicate_groups", "duplicate_rows", "conflicting_groups", "conflicting_rows", "empty_rows")


_KEPT = f"SELECT doc_id FROM ({_OUTCOME}) WHERE stage IS NULL"


@query(f"""SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT count(*) FILTER (NOT w AND NOT h) AS tp, count(*) FILTER (w AND NOT h) AS fp, count(*) FILTER (NOT w AND h) AS fn, count(*) FILTER (w AND h) AS tn
    FROM (SELECT doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS w, doc_id IN ({_KEPT}) AS h FROM documents))""")
def recovery_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    out = metrics.recovery_accuracy(docs, "doc_id", clean, outcome(spark, sf_dir).where("stage is null"), "text")
    return out.select("tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"))


@query(f"""SELECT count(*) AS source_rows, count(*) FILTER (k) AS source_retained, count(*) FILTER (NOT k) AS source_lost, 0::BIGINT AS source_changed, sum(length(text))::BIGINT AS characters_before, coalesce(sum(length(text)) FILTER (k), 0)::BIGINT AS characters_after
    FROM (SELECT coalesce(text, '') AS text, doc_id IN ({_KEPT}) AS k FROM documents)""")
def source_preservation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    kept = outcome(spark, sf_dir).where("stage is null").select("doc_id", "response")
    out = metrics.preservation(docs.withColumnRenamed("text", "response"), kept, "doc_id", "response")
    return out.select("source_rows", "source_retained", "source_lost", "source_changed", "characters_before", "characters_after")


@query("SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def run_spread(spark, sf_dir):
    out = metrics.run_spread(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_SETS = "SELECT list_filter(['q' || quality, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS a, list_filter(['q' || toxic, CASE WHEN quality = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS p FROM labels"


@query(f"""WITH s AS ({_SETS}), e AS (SELECT a, p, unnest(list_distinct(a || p)) AS l FROM s), f AS (SELECT l, 2 * count(*) FILTER (list_contains(a, l) AND list_contains(p, l)) / (count(*) + count(*) FILTER (list_contains(a, l) AND list_contains(p, l))) AS f FROM e GROUP BY l)
    SELECT (SELECT round(avg(f), 6) FROM f) AS macro_f1, (SELECT round(avg((list_sort(a) = list_sort(p))::INT), 6) FROM s) AS subset_accuracy""")
def multilabel_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        F.array_compact(F.array(F.concat(F.lit("q"), "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("a"),
        F.array_compact(F.array(F.concat(F.lit("q"), "toxic"), F.when(F.col("quality") == 0, "toxic"))).alias("p"),
    )
    out = metrics.multilabel_scores(rows, "a", "p")
    return out.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("subset_accuracy", 6).alias("subset_accuracy"))


@query()
def nearest_document(spark, sf_dir):
    docs = generate.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "text", HashedNgrams())
    items = generate.embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", HashedNgrams())
    return metrics.nearest(docs, items, "id", "embedding").select("query", "nearest", F.round("sim", 4).alias("sim"))


@query()
def semantic_text_dedup(spark, sf_dir):
    docs = generate.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", HashedNgrams())
    return dedup.semantic_keep(cut(docs.select("doc_id", "embedding"), "vectors"), "doc_id", "embedding", 0.95, sims=False).select(F.col("ord").alias("doc_id"), "keep")


@query("SELECT count(*) AS records, count(*) FILTER (len(m) > 0 AND u AND a) AS kept FROM (SELECT conv_id, list(role) FILTER (trim(coalesce(text, '')) <> '') AS m, bool_or(role IN ('user', 'human') AND trim(coalesce(text, '')) <> '') AS u, bool_or(role IN ('assistant', 'gpt', 'model') AND trim(coalesce(text, '')) <> '') AS a FROM conversations GROUP BY conv_id)")
def normalise_chats(spark, sf_dir):
    chats = records.assemble_chats(table(spark, sf_dir, "conversations"))
    return chats.agg(F.count("*").alias("records")).join(metrics.normalise(chats, "chat").agg(F.count("*").alias("kept")))


@query("SELECT event_type AS provider, NOT grouping(event_type) = 0 AS is_total, count(*) AS runs, round(sum(value), 4) AS amount FROM events GROUP BY GROUPING SETS ((event_type), ())")
def usage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupingSets([[F.col("event_type")], []], F.col("event_type")).agg((F.grouping("event_type") == 1).alias("is_total"), F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("amount")).withColumnRenamed("event_type", "provider")


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, dense_rank() OVER (ORDER BY toxic) AS l FROM labels) WHERE k <= 25 // 2 + CASE WHEN l <= 25 % 2 THEN 1 ELSE 0 END")
def balanced_cap(spark, sf_dir):
    return analysis.balanced_cap(table(spark, sf_dir, "labels"), "toxic", "doc_id", 25).select("doc_id", "toxic")


@query(f"SELECT f.doc_id FROM ({_FIRST}) f WHERE rn = 1 AND length(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) > 0")
def blank_rejection(spark, sf_dir):
    config = PipelineConfig(dedup_method="exact", classification="off", scrub_pii=False, quality_mode="off", reject_blank=True)
    rows = Run(config).run(prepare(records.from_lines(doc_lines(spark, sf_dir), keep=("_ord",)))).accepted
    return rows.select(F.col("_ord").alias("doc_id"))


@query("WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS p, (100 + n_nationkey)::BIGINT AS c FROM nation UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation), d(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.c, d.depth + 1 FROM d JOIN e ON e.p = d.node WHERE depth < 5) SELECT node, min(depth) AS depth FROM d GROUP BY node")
def lineage_cyclic(spark, sf_dir):
    down = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + 100).cast("long").alias("child"))
    edges = down.unionByName(down.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return analysis.lineage(edges, 1).where("depth >= 0")


@query("SELECT doc_id, len(" + _TOKENS.replace("text", "coalesce(text, '')") + ") AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(metrics.tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')) AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split_words(F.coalesce("text", F.lit("")))).cast("long").alias("words"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id::VARCHAR AS id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def input_order(spark, sf_dir):
    """documents as JSON lines in folders of 1, 2, 4, ... rows, read back in their order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = analysis.positions(docs, "doc_id", "place").withColumn("part", (F.floor(F.log2(F.col("place") + 1)) + 100).cast("int"))
    path = f"{work_dir(spark)}/input-order-{uuid.uuid4().hex}.jsonl"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the writer sorts by folder, in place of any order that doesn't begin with it, and text folders are another column to it
    placed.repartitionByRange(tasks, "place").sortWithinPartitions("part", "place").select("part", F.col("doc_id").cast("string").alias("id"), "text").write.partitionBy("part").json(path)
    return read_records(spark, path).select(F.col("_ord").alias("place"), "id", F.md5("text").alias("text_md5"))


_CARDS = r"list_filter(regexp_extract_all(coalesce(text, ''), '\b(?:\d[ -]?){12,18}\d\b'), lambda c: list_sum(list_transform(list_reverse(string_split(regexp_replace(c, '[ -]', '', 'g'), '')), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT ELSE (2 * d::INT) // 10 + (2 * d::INT) % 10 END)) % 10 = 0)"
_IBANS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b'), lambda c: replace(c, ' ', '')), lambda c: length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda x: CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE x::INT END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1)"


@query(f"SELECT doc_id, len({_CARDS}) AS n_cards, len({_IBANS}) AS n_ibans, len(regexp_extract_all(coalesce(text, ''), '\\b9\\d{{2}}[- ](?:5\\d|6[0-5]|7\\d|8[0-8]|9[0-24-9])[- ]\\d{{4}}\\b')) AS n_itins FROM documents")
def pii_checked(spark, sf_dir):
    """Numbers that hold by their check sums or ranges."""
    found = recognise.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", recognise.Finder(entities=["CREDIT_CARD", "IBAN_CODE", "US_ITIN"]))
    n = lambda e: F.size(F.filter("spans", lambda s: s["entity"] == e)).cast("long")
    return found.select("doc_id", n("CREDIT_CARD").alias("n_cards"), n("IBAN_CODE").alias("n_ibans"), n("US_ITIN").alias("n_itins"))


@query()
def pii_spans(spark, sf_dir):
    """All entities of every document, with their places in the text."""
    found = recognise.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
