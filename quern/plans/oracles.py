"""SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from quern.plans.views import CORPUS, EVALS, PUZZLES, ROLLOUTS, SOLUTIONS

BASE = f"corpus AS ({CORPUS}), evals AS ({EVALS})"

# Exact and n-gram matches of ``recs`` (id, text) with ``evals``; {n}: length, {t}: threshold.
MATCH = """
norms AS (SELECT eid, ordinal, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS norm FROM evals),
exact AS (SELECT norm, arg_min(eid, ordinal) AS eid FROM norms WHERE norm <> '' GROUP BY norm),
etoks AS (SELECT eid, ordinal, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM evals),
eplaces AS (SELECT eid, ordinal, t, unnest(range(1, len(t) - {n} + 2)) AS p FROM etoks WHERE len(t) >= {n}),
egrams AS (SELECT array_to_string(list_slice(t, p, p + {n} - 1), ' ') AS gram, arg_min(eid, ordinal) AS eid FROM eplaces GROUP BY 1),
toks AS (SELECT id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS norm, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM recs),
known AS (SELECT id, t, eid AS x FROM toks LEFT JOIN exact USING (norm)),
places AS (SELECT id, t, unnest(range(1, len(t) - {n} + 2)) AS p FROM known WHERE x IS NULL AND len(t) >= {n}),
found AS (SELECT id, p, eid FROM (SELECT id, p, array_to_string(list_slice(t, p, p + {n} - 1), ' ') AS gram FROM places) g JOIN egrams USING (gram)),
items AS (SELECT id, eid, count(*) AS k, min(p) AS p FROM found GROUP BY id, eid),
ranked AS (SELECT id, eid, sum(k) OVER (PARTITION BY id) AS matched, row_number() OVER (PARTITION BY id ORDER BY k DESC, p) AS r FROM items),
rated AS (SELECT known.id AS id, x, eid, CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE WHEN matched IS NULL THEN 0.0::DOUBLE ELSE matched::DOUBLE / (len(t) - {n} + 1) END AS hit_rate
  FROM known LEFT JOIN (SELECT * FROM ranked WHERE r = 1) best ON known.id = best.id),
classified AS (SELECT id, (x IS NOT NULL OR hit_rate > {t}) AS is_hit, CASE WHEN x IS NOT NULL THEN 'exact' WHEN hit_rate > {t} THEN 'ngram' ELSE '' END AS match_type, hit_rate,
  CASE WHEN x IS NOT NULL THEN x WHEN hit_rate > {t} THEN eid END AS matched_eval FROM rated)"""

DOCUMENTS = f"WITH {BASE}, recs AS (SELECT id, text FROM corpus), {MATCH.format(n=13, t=0.1)}"
LINES = f"""WITH {BASE}, recs AS (SELECT id * 4294967296 + p - 1 AS id, line AS text FROM
  (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM corpus) s), {MATCH.format(n=13, t=0.8)}"""

# Flat boxes: whether a box, what it holds, and the distinct normal forms of all.
PARSED = rf"""WITH sols AS ({SOLUTIONS}),
last AS (SELECT *, string_split(solution, chr(92) || 'boxed') AS parts FROM sols),
boxes AS (SELECT id, problem, solution, source,
  CASE WHEN len(parts) > 1 AND regexp_matches(parts[-1], '^ *\{{[^{{}}]*\}}') THEN regexp_extract(parts[-1], '^ *\{{([^{{}}]*)\}}', 1) END AS last_box,
  list_distinct(list_transform(regexp_extract_all(solution, '\\boxed *\{{([^{{}}]*)\}}', 1), lambda x: trim(replace(replace(replace(trim(x), chr(92) || 'left', ''), '$', ''), chr(10), '')))) AS answers FROM last),
truth AS (SELECT *, CASE WHEN len(answers) = 0 THEN 'no_boxed' WHEN len(answers) > 1 THEN 'multi_boxed' WHEN answers[1] = '' THEN 'empty' WHEN length(answers[1]) > 100 THEN 'too_long' ELSE 'ok' END AS reason FROM boxes),
parsed AS (SELECT *, reason = 'ok' AS keep, CASE WHEN reason = 'ok' THEN answers[1] END AS answer FROM truth)"""
INSTRUCTION = "' Please reason step by step, and put your final answer within ' || chr(92) || 'boxed{}.'"

# Answers and grades of ``rolls``.
GRADED = rf"""WITH rolls AS ({ROLLOUTS}),
ex AS (SELECT *, replace(list_extract(regexp_extract_all(text, '#### (-?[0-9.,]+)', 1), -1), ',', '') AS strict,
  regexp_extract_all(text, '-?[0-9.,]+') AS nums, string_split(text, chr(92) || 'boxed') AS parts FROM rolls),
fl AS (SELECT *, coalesce(list_extract(list_filter(nums, lambda x: x <> '.' AND x <> ''), -1), list_extract(nums, 1)) AS flexible,
  CASE WHEN len(parts) > 1 AND regexp_matches(parts[-1], '^ *\{{[^{{}}]*\}}') THEN regexp_extract(parts[-1], '^ *\{{([^{{}}]*)\}}', 1) END AS box FROM ex),
an AS (SELECT *, regexp_replace(trim(replace(coalesce(strict, flexible), ',', '')), '\.+$', '') AS number FROM fl),
graded AS (SELECT *, CASE WHEN data_source = 'openai/gsm8k' THEN number WHEN data_source = 'math500' THEN box END AS answer,
  CASE WHEN data_source = 'openai/gsm8k' AND number = truth THEN 1.0::DOUBLE WHEN data_source = 'math500' AND box = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness,
  CASE WHEN data_source = 'openai/gsm8k' AND strict IS NOT NULL THEN 1.0::DOUBLE WHEN data_source = 'math500' AND box IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_ok FROM an)"""
RATES = GRADED + """,
rates AS (SELECT sample, count_if(correctness > 0.5)::BIGINT AS correct_count, max(k)::BIGINT AS k_samples, count_if(correctness > 0.5)::DOUBLE / max(k) AS pass_rate,
  (['gsm8k', 'numina', 'countdown'])[(sample % 3 + 1)::INT] AS source FROM graded GROUP BY sample)"""
LONG = GRADED + """,
lf AS (SELECT data_source AS eval_set, sample AS sample_index, data_source, truth, CASE WHEN idx = 0 THEN 'greedy' ELSE 'sampled' END AS kind, idx::BIGINT - 1 AS ci, text, coalesce(answer, '') AS answer, correctness, format_ok, correctness + format_ok * 0.1::DOUBLE AS total FROM graded),
votes AS (SELECT eval_set, sample_index, data_source, truth, answer, count(*) AS votes, min(ci) AS f FROM lf WHERE kind = 'sampled' AND answer <> '' GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY eval_set, sample_index ORDER BY votes DESC, f) AS r FROM votes),
maj AS (SELECT eval_set, sample_index, answer, votes, CASE WHEN regexp_replace(answer, '^,$', '') = truth AND data_source <> 'other' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness FROM won WHERE r = 1)"""

PUZZLED = f"WITH puz AS ({PUZZLES})"
DRAW = "md5(concat_ws(':', '42', cast({} AS VARCHAR)))"

ORACLES: dict[str, str] = {
    "decontam_documents": f"{DOCUMENTS} SELECT id, is_hit, match_type, hit_rate, matched_eval FROM classified",
    "decontam_lines": f"{LINES} SELECT id, is_hit, match_type, hit_rate, matched_eval FROM classified WHERE is_hit OR hit_rate > 0",
    "decontam_stats": f"{DOCUMENTS} SELECT count(*)::BIGINT AS total, count_if(is_hit)::BIGINT AS flagged, count_if(NOT is_hit)::BIGINT AS kept, count_if(NOT is_hit)::DOUBLE / count(*) AS retention FROM classified",
    "decontam_counts": f"{DOCUMENTS} SELECT match_type, subsource, count(*)::BIGINT AS n FROM classified JOIN corpus USING (id) WHERE is_hit GROUP BY GROUPING SETS ((match_type), (subsource))",
    "decontam_review": f"{DOCUMENTS} SELECT id, match_type, round_even(hit_rate, 3)::DOUBLE AS hit_rate, matched_eval, subsource, substring(text, 1, 300) AS problem FROM classified JOIN corpus USING (id) WHERE is_hit ORDER BY id LIMIT 30",
    "decontam_clean": f"{DOCUMENTS} SELECT corpus.id AS id, subsource FROM corpus WHERE id NOT IN (SELECT id FROM classified WHERE is_hit)",
    "decontam_index": f"WITH {BASE}, recs AS (SELECT id, text FROM corpus), {MATCH.format(n=13, t=0.8)} SELECT gram, eid FROM egrams",
    "text_normalised": f"WITH {BASE}, x AS (SELECT eid, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS norm, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens FROM evals) SELECT eid, norm, n_tokens, greatest(0, n_tokens - 12)::BIGINT AS n_grams FROM x",
    "truth_parsed": f"{PARSED} SELECT id, answer, reason, last_box, last_box IS NOT NULL AS has_box FROM parsed",
    "five_fields": f"{PARSED} SELECT 'numina_math' AS data_source, 'user' AS role, problem || {INSTRUCTION} AS content, 'math' AS ability, 'rule' AS style, answer AS ground_truth, id AS index, source AS subsource FROM parsed WHERE keep",
    "clean_stats": f"{PARSED} SELECT count(*)::BIGINT AS original, count_if(keep)::BIGINT AS kept, count_if(NOT keep)::BIGINT AS dropped, round_even(count_if(keep)::DOUBLE / count(*), 4)::DOUBLE AS retention FROM parsed",
    "clean_subsources": f"{PARSED} SELECT source AS subsource, count(*)::BIGINT AS total, count_if(keep)::BIGINT AS kept, round_even(count_if(keep)::DOUBLE / count(*), 4)::DOUBLE AS rate FROM parsed GROUP BY source",
    "clean_reasons": f"{PARSED} SELECT reason, count(*)::BIGINT AS n FROM parsed WHERE reason <> 'ok' GROUP BY reason",
    "eval_five_fields": f"SELECT 'math500' AS data_source, p_name || {INSTRUCTION} AS content, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE cast(p_size AS VARCHAR) END AS ground_truth, p_partkey AS index, p_brand AS subject, p_size::BIGINT AS level FROM part",
    "eval_empty_answers": "SELECT count_if(p_partkey % 10 = 0)::BIGINT AS n_empty FROM part",
    "eval_samples": f"SELECT 'math500_test' AS eval_set, p_partkey AS index, 'math500' AS data_source, '<|im_start|>user' || chr(10) || p_name || {INSTRUCTION} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt_text, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE cast(p_size AS VARCHAR) END AS ground_truth, p_name AS raw_question FROM part",
    "chat_prompts": "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, coalesce(text, '')) || '<|im_start|>assistant' || chr(10)) AS prompt_md5, count(*)::BIGINT AS n_turns FROM conversations GROUP BY conv_id",
    "prompts_fitting": f"WITH {BASE} SELECT id FROM corpus WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) <= 512",
    "sample_uniform": f"WITH {BASE} SELECT id, subsource FROM corpus ORDER BY {DRAW.format('id')}, id LIMIT 100",
    "sample_stratified": f"""WITH {BASE}, r AS (SELECT id, subsource, row_number() OVER (PARTITION BY subsource ORDER BY md5(concat_ws(':', '42', subsource, cast(id AS VARCHAR))), id) AS k, count(*) OVER (PARTITION BY subsource) AS c, count(*) OVER () AS n FROM corpus)
        SELECT id, subsource FROM r WHERE k <= least(c, round_even(150.0::DOUBLE * c / n, 0)::BIGINT)""",
    "sample_first": f"WITH {BASE} SELECT id, subsource FROM corpus ORDER BY id LIMIT 25",
    "rows_numbered": "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer",
    "rows_shuffled": f"SELECT c_custkey, row_number() OVER (ORDER BY {DRAW.format('c_custkey')}) - 1 AS shuffle_pos FROM customer",
    "rows_random": f"WITH {BASE} SELECT id, substring(text, 1, 600) AS text FROM corpus ORDER BY {DRAW.format('id')}, id LIMIT 5",
    "rows_peeked": f"WITH {BASE} SELECT cast(id AS VARCHAR) AS id, substring(text, 1, 120) AS text, subsource FROM corpus ORDER BY corpus.id LIMIT 2",
    "subsource_distribution": f"WITH {BASE}, d AS (SELECT coalesce(CASE WHEN id % 11 > 0 THEN subsource END, 'unknown') AS subsource FROM corpus) SELECT subsource, count(*)::BIGINT AS n, 100 * count(*)::DOUBLE / sum(count(*)) OVER () AS pct FROM d GROUP BY subsource",
    "pool_totals": "WITH p AS (SELECT 'documents' AS pool, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages) SELECT pool, sum(n)::BIGINT AS n FROM p GROUP BY ROLLUP (pool)",
    "answers_extracted": f"{GRADED} SELECT sample, idx, strict, flexible, answer, CASE WHEN data_source = 'openai/gsm8k' THEN '#### ' || answer WHEN data_source = 'math500' THEN chr(92) || 'boxed' || chr(123) || answer || chr(125) ELSE answer END AS completion FROM graded",
    "grades": f"{GRADED} SELECT sample, idx, data_source, correctness, format_ok, correctness + format_ok * 0.1::DOUBLE AS total_reward FROM graded",
    "puzzle_grades": f"""{PUZZLED}, g AS (SELECT id, CASE WHEN id % 5 IN (0, 3) THEN 1.0::DOUBLE WHEN id % 5 = 1 AND a + b + c = target THEN 1.0::DOUBLE WHEN id % 5 = 2 AND a = b AND b = c AND a * a * a = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness, CASE WHEN id % 5 = 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS format_ok FROM puz)
        SELECT id, correctness, format_ok, correctness + format_ok * 0.1::DOUBLE AS total_reward FROM g""",
    "puzzle_sides": f"""{PUZZLED} SELECT id, CASE id % 5 WHEN 0 THEN concat('(', a, ' + ', b, ') * ', c) WHEN 1 THEN concat(a, ' + ', b, ' + ', c) WHEN 2 THEN concat(a, '*', a, '*', a) WHEN 3 THEN concat(target, '|(', a, '+', b, ')*', c) END AS sides,
        CASE WHEN id % 5 = 2 THEN concat_ws(',', a, a, a) WHEN id % 5 < 4 THEN array_to_string(list_sort([a, b, c]), ',') END AS used, target::DOUBLE AS target FROM puz""",
    "group_advantages": f"{GRADED}, r AS (SELECT sample, idx, correctness + format_ok * 0.1::DOUBLE AS t FROM graded) SELECT sample, idx, round((t - avg(t) OVER w) / (coalesce(stddev_samp(t) OVER w, 0.0::DOUBLE) + 1e-6::DOUBLE), 6) + 0.0::DOUBLE AS advantage FROM r WINDOW w AS (PARTITION BY sample)",
    "pass_rates": f"{RATES} SELECT sample, correct_count, k_samples, pass_rate, source FROM rates",
    "bucket_stats": f"{RATES} SELECT source, count(*)::BIGINT AS num_samples, count_if(pass_rate = 1)::BIGINT AS too_easy, count_if(pass_rate = 0)::BIGINT AS too_hard, count_if(pass_rate > 0 AND pass_rate < 1)::BIGINT AS keep, round(avg(pass_rate), 9) AS mean_pass_rate FROM rates GROUP BY source",
    "bucket_histogram": f"{RATES}, bins AS (SELECT unnest(range(0, 13))::BIGINT AS correct_count), c AS (SELECT correct_count, count(*) AS n FROM rates GROUP BY 1) SELECT correct_count, coalesce(n, 0)::BIGINT AS n FROM bins LEFT JOIN c USING (correct_count)",
    "bucket_rollup": f"{RATES} SELECT source, count(*)::BIGINT AS n, count_if(pass_rate > 0 AND pass_rate < 1)::BIGINT AS keep, count_if(pass_rate > 0 AND pass_rate < 1)::DOUBLE / count(*) AS keep_share FROM rates GROUP BY ROLLUP (source)",
    "mix_filtered": f"{RATES} SELECT sample, source FROM rates WHERE pass_rate > 0 AND pass_rate < 1",
    "mix_taken": f"""{RATES}, f AS (SELECT sample, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '42', source, cast(sample AS VARCHAR))), sample) AS r FROM rates WHERE pass_rate > 0 AND pass_rate < 1)
        SELECT sample, source FROM f WHERE r <= CASE source WHEN 'gsm8k' THEN 50 WHEN 'numina' THEN 100 ELSE 1000000000 END""",
    "mix_schema_union": f"""{PARSED}, puz AS ({PUZZLES}) SELECT 'numina_math' AS data_source, id AS index, problem AS question, NULL AS numbers, NULL::VARCHAR AS target FROM parsed WHERE keep
        UNION ALL SELECT 'countdown', id, NULL, concat_ws(',', a, b, c), cast(target AS VARCHAR) FROM puz""",
    "eval_scored": f"{LONG} SELECT sample_index, kind AS completion_kind, ci AS completion_index, answer AS extracted_answer, correctness, format_ok, total AS total_reward FROM lf",
    "eval_majority": f"{LONG} SELECT sample_index, answer AS extracted_answer, votes, correctness FROM maj",
    "eval_metrics": f"""{LONG}, g AS (SELECT eval_set, min(data_source) AS data_source, count_if(kind = 'greedy')::BIGINT AS n, coalesce(avg(CASE WHEN kind = 'greedy' THEN correctness END), 0) AS p, coalesce(avg(CASE WHEN kind = 'greedy' THEN format_ok END), 0) AS f, coalesce(avg(CASE WHEN kind = 'greedy' THEN total END), 0) AS t, coalesce(avg(CASE WHEN kind = 'sampled' THEN total END), 0) AS s FROM lf GROUP BY eval_set),
        m AS (SELECT eval_set, sum(correctness) AS c FROM maj GROUP BY eval_set)
        SELECT g.eval_set AS eval_set_name, data_source, n AS num_samples, round(p, 9) AS pass_at_1, round(coalesce(c, 0) / n, 9)::DOUBLE AS maj_at_8, round(f, 9) AS format_rate, round(t, 9) AS total_reward_greedy, round(s, 9) AS total_reward_sampled_mean FROM g LEFT JOIN m ON g.eval_set = m.eval_set""",
    "eval_long_form": f"{LONG} SELECT sample_index, kind AS completion_kind, CASE WHEN kind = 'greedy' THEN -1 ELSE ci END::BIGINT AS completion_index, text AS completion_text FROM lf",
    "source_checks": f"WITH rolls AS ({ROLLOUTS}) SELECT count(*)::BIGINT AS n, (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT data_source AS d FROM rolls) x) AS sources FROM rolls",
    "puzzle_prompts": f"{PUZZLED} SELECT id, concat('Numbers: ', a, ', ', b, ', ', c, chr(10), 'Target: ', target, chr(10), 'Go.') AS content FROM puz",
    "puzzles_distinct": f"{PUZZLED}, k AS (SELECT id, target, row_number() OVER (PARTITION BY array_to_string(list_sort([a, b, c]), ','), target ORDER BY id) AS r FROM puz) SELECT id, target FROM k WHERE r = 1",
    "puzzles_unseen": f"{PUZZLED}, k AS (SELECT id, target, array_to_string(list_sort([a, b, c]), ',') AS n FROM puz) SELECT id, target FROM k WHERE id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.id % 4 > 0 AND o.n = k.n AND o.target = k.target)",
    "puzzles_wrong": "SELECT p_partkey AS id, p_partkey AS target FROM part WHERE false",
}
ORACLES["metrics_json"] = f"""SELECT eval_set_name, concat('{{"eval_set_name":"', eval_set_name, '","data_source":"', data_source, '","num_samples":', num_samples, ',"pass_at_1":', pass_at_1::DECIMAL(12,6), ',"maj_at_8":', maj_at_8::DECIMAL(12,6), ',"format_rate":', format_rate::DECIMAL(12,6), ',"total_reward_greedy":', total_reward_greedy::DECIMAL(12,6), ',"total_reward_sampled_mean":', total_reward_sampled_mean::DECIMAL(12,6), '}}') AS json FROM ({ORACLES['eval_metrics']})"""
