"""One query per operator, over whole tables, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_shards, cap_filters, dialogue, fair_mix, licenses, line_dedup, lsm_dedup, phrases, quality, simhash_ball, tier_packing, token_files, toxicity


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, labels.where(~held))
    out = toxicity.toxicity_scores(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents")).drop("row")


def op5_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lsm_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_bin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_shards.assign(table(spark, sf_dir, "documents"), shards=40)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("key")


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_token_files, op4_line_dedup, op5_lsm_exact_dedup, op6_bin_shards, op7_quality_rules, op8_simhash_ball, op9_tier_packing, op10_fair_mix, op11_phrases, op12_cap_filters, op13_dialogue_repair)}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical form, line by line: lists of words and signs of its own instead of the operator's patterns."""
    t = f"lower(coalesce({text}, ''))"
    openings = [w[:4] for w in (re.findall("[^\\W_]+", x.lower()) for x in licenses.KNOWN.values()) if len(w) >= 25]
    first = "|".join("[^\\p{L}\\p{N}]+".join(w) for w in openings)
    head = f"regexp_extract(low, {_literal(f'(?s)^(.*?)(?:{first})')}, 1)"
    bare = "regexp_replace(h, '^[^\\p{L}\\p{N}©]+', '')"
    named = "regexp_matches(hw, '^(the )?[a-z0-9.-]{2,12}( [0-9]-clause)? licen[cs]e')"
    t = f"(SELECT CASE WHEN regexp_matches(low, {_literal(first)}) AND h <> '' AND (starts_with(hw, '©') OR starts_with(hw, 'copyright') OR starts_with(hw, 'c)') OR {named}) AND list_max(list_transform(string_split(h, chr(10)), lambda x: length(x))) <= 160 THEN substr(low, length(h) + 1) ELSE low END FROM (SELECT *, {bare} AS hw FROM (SELECT low, {head} AS h FROM (SELECT {t} AS low))))"
    word = "regexp_replace(x, '^[^\\p{L}\\p{N}]+', '')"
    # a line goes if it begins with a sign, or with a word that a year or sign follows, or if it is a title
    signs = "starts_with(regexp_replace(s.x, '^[^\\p{L}\\p{N}©]+', ''), '©') OR starts_with(s.w, 'all rights reserved') OR starts_with(s.w, 'spdx-license-identifier')"
    year = "regexp_matches(s.w, '^copyright[^\\p{L}\\p{N}]*([0-9]{4}|\\(c\\)|©|<year>|\\[yyyy\\])') OR regexp_matches(s.x, '^[^\\p{L}\\p{N}]*\\(c\\)[^\\p{L}\\p{N}]*(copyright\\b|[0-9]{4})')"
    title = "regexp_full_match(s.w, '(the )?[a-z0-9.-]{2,12}( [0-9]-clause)? licen[cs]e([^\\p{L}\\p{N}]*\\([a-z0-9 .-]{2,20}\\))?[^\\p{L}\\p{N}]*')"
    kept = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {{'x': x, 'w': {word}}}), lambda s: NOT ({' OR '.join((signs, year, title))}))"
    out = f"array_to_string(list_transform({kept}, lambda s: regexp_replace(s.x, '^[^\\p{{L}}\\p{{N}}]*\\(?([0-9]{{1,2}}|[a-z])[.)][ \\t]+', '')), chr(10))"
    words = {a: b for a, b in licenses.SPELLINGS.items() if " " not in a}
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items())
    out = f"list_transform(string_split(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: CASE w {case} ELSE w END)"
    out = f"' ' || array_to_string({out}, '  ') || ' '"
    for a, b in licenses.SPELLINGS.items():
        if a not in words:
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


#: All phrases of up to 4 words as strings, all cuts of the frequent ones, and a phrase's longer neighbours by its ends.
_PHRASES_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT row_number() OVER () AS id, lang, p FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
    w AS (SELECT id, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT id, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)),
    l AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
    g AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS p FROM l) WHERE p IS NOT NULL GROUP BY lang, p HAVING count(*) >= 30),
    n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
    c AS (SELECT lang, p, string_split(p, ' ') AS c, f AS a FROM g WHERE contains(p, ' ')),
    k AS (SELECT lang, p, a, k, array_to_string(c[1:k], ' ') AS first, array_to_string(c[k + 1:], ' ') AS rest, len(c) AS size FROM (SELECT *, unnest(range(1, len(c))) AS k FROM c)),
    s AS (SELECT k.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score FROM k JOIN g x ON x.lang = k.lang AND x.p = k.first JOIN g y ON y.lang = k.lang AND y.p = k.rest),
    gone AS (SELECT lang, first AS p FROM s WHERE k = size - 1 AND size > 2 AND 100 * a >= 80 * l UNION SELECT lang, rest FROM s WHERE k = 1 AND size > 2 AND 100 * a >= 80 * r),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM b ANTI JOIN gone USING (lang, p))
    SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""

#: All pairs, and the components by spreading the least id.
_VECTORS_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id WHERE c.root < l.b),
    m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.id = vec_id"""

#: CRC-32 bit by bit; then forward over the turns, with the best cost and audit of each state (before a turn, up to two are inserted).
_DIALOGUE_SQL = r"""
    WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS k FROM conversations),
    h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, k), lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, y: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 20 AS h FROM z),
    d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE h <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    f AS (SELECT *, left(role, 1) AS c, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
    t AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
    ins(s, cost, audit, s2, rep) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 3, 'I', 2, ['user:']), (0, 6, 'II', 3, ['user:', 'assistant:']), (1, 0, '', 1, []), (1, 3, 'I', 2, ['user:']), (1, 6, 'II', 3, ['user:', 'assistant:']),
        (2, 0, '', 2, []), (2, 3, 'I', 3, ['assistant:']), (2, 6, 'II', 2, ['assistant:', 'user:']), (3, 0, '', 3, []), (3, 3, 'I', 2, ['user:']), (3, 6, 'II', 3, ['user:', 'assistant:'])),
    ways(s, c, op, s2, cost) AS (VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0), (0, NULL, 'D', 0, 4), (1, NULL, 'D', 1, 4), (2, NULL, 'D', 2, 4), (3, NULL, 'D', 3, 4), (0, NULL, 'R', 2, 3), (1, NULL, 'R', 2, 3), (2, NULL, 'R', 3, 3), (3, NULL, 'R', 2, 3)),
    r AS (SELECT conv_id, 1::BIGINT AS i, 0 AS s, {'cost': 0, 'audit': '', 'rep': []::VARCHAR[]} AS b FROM (SELECT DISTINCT conv_id FROM t)
        UNION ALL
        SELECT r.conv_id, r.i + 1, ways.s2, min({'cost': r.b.cost + ins.cost + ways.cost + CASE WHEN t.fault = 't' AND ways.op <> 'D' THEN 3 ELSE 0 END, 'audit': r.b.audit || ins.audit || ways.op,
            'rep': r.b.rep || ins.rep || CASE ways.op WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE ways.s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.text] END})
        FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i JOIN ins ON ins.s = r.s JOIN ways ON ways.s = ins.s2 AND (ways.c IS NULL OR ways.c = t.c) AND (ways.op = 'D' OR t.fault NOT IN ('b', 'd')) GROUP BY r.conv_id, r.i, ways.s2),
    u AS (SELECT r.conv_id, min({'cost': r.b.cost + ins.cost, 'audit': r.b.audit || ins.audit, 'rep': r.b.rep || ins.rep}) AS b FROM r JOIN (SELECT conv_id, max(i) + 1 AS i FROM t GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i JOIN ins ON ins.s = r.s AND ins.s2 IN (0, 3) GROUP BY r.conv_id),
    q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.rep, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN u ON u.conv_id IS NOT DISTINCT FROM e.conv_id"""


def oracle_sql() -> dict[str, str]:
    norm = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"
    known = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in licenses.KNOWN.items())
    return {
        "op11_phrases": _PHRASES_SQL,
        "op12_cap_filters": _VECTORS_SQL,
        "op13_dialogue_repair": _DIALOGUE_SQL,
        "op2_license_scan": f"""
            WITH k AS (SELECT sha256({_canonical_sql("t")}) AS digest, min(n) AS license FROM (VALUES {known}) v(n, t) GROUP BY 1),
            d AS (SELECT doc_id, {_canonical_sql("text")} AS c FROM documents)
            SELECT doc_id, sha256(c) AS digest, CASE WHEN c <> '' THEN license END AS license FROM d LEFT JOIN k ON sha256(c) = k.digest""",
        "op5_lsm_exact_dedup": f"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({norm}) AS text_sha256 FROM documents),
            g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    }
