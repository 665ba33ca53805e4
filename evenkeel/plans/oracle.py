"""ANSI-SQL text of every checkable query, in the dialect of DuckDB, written independently of the operators."""

from __future__ import annotations

import re

from evenkeel.operators import judge

# The white-space class of functions/text.py in RE2 spelling.
SPACE = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def norm(x: str) -> str:
    return (
        f"regexp_replace(trim(regexp_replace(lower({x}), '[{SPACE}]+', ' ', 'g'), ' '), '[^a-z0-9 ]', '', 'g')"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(f'({p})::VARCHAR' for p in parts)}), 1, 8))::BIGINT"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def parsed(x: str) -> str:
    assign = rf"regexp_extract(lower({x}), 'score\s*=\s*([0-9]*\.?[0-9]+)', 1)"
    alone = rf"regexp_extract(lower({x}), '\b(0(?:\.\d+)?|1(?:\.0+)?)\b', 1)"
    return (
        f"(CASE WHEN {assign} <> '' THEN least(1.0::DOUBLE, ({assign})::DOUBLE) "
        f"WHEN {alone} <> '' THEN least(1.0::DOUBLE, ({alone})::DOUBLE) END)"
    )


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QA = """qa AS (
  SELECT 'c' || u.conv_id || 't' || u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS gold_answer
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

ANSWERS = f"""{QA}, cells AS (
  SELECT 'm' || m AS model, m, id AS question_id, r::INTEGER AS run_index, question, gold_answer,
         {draw("7", "'m' || m", "id", "r")} AS h, string_split(coalesce(gold_answer, question), ' ') AS w
  FROM qa, range(1, 6) t(m), range(0, 10) s(r)), sized AS (
  SELECT *, 4 + h % (3 * m) AS k, CASE WHEN h % 4 = 0 THEN 2 ELSE 1 END AS st FROM cells), answers AS (
  SELECT model, question_id, run_index, question, gold_answer, h,
    CASE WHEN h % 101 = 0 THEN NULL WHEN h % 103 = 0 THEN ''
         ELSE array_to_string(CASE h % 18 WHEN 4 THEN list_filter(w, lambda x, i: (i - 1) % 7 <> 6)
             WHEN 13 THEN list_concat(w[len(w) // 2 + 1:], w[1:len(w) // 2])
             ELSE list_concat(w[st:st + k - 1], CASE WHEN h % 6 = 1 THEN w[1:2] ELSE [] END) END, ' ')
              || CASE WHEN h % 5 = 0 THEN '.' ELSE '' END END AS response_text,
    CASE WHEN h % 83 <> 0 THEN k END AS eval_count,
    CASE WHEN h % 97 = 0 THEN 0 WHEN h % 89 = 0 THEN NULL ELSE (200 + h % 4000) * 1000000 END AS total_duration,
    CASE h % 5 WHEN 0 THEN '' WHEN 1 THEN 'no score given'
         WHEN 2 THEN '{{"score": 0.' || h % 10 || ', "rationale": "x"}}'
         WHEN 3 THEN 'Score = 1.' || h % 10 || ' rationale=x'
         ELSE 'score=0.' || h % 10 || ' rationale=x' END AS judge_text
  FROM sized)"""

NORMED = f"""{ANSWERS}, normed AS (
  SELECT *, {norm('response_text')} AS nr, {norm('gold_answer')} AS ng, {parsed('judge_text')} AS judge_score
  FROM answers), pairs AS (
  SELECT *, row_number() OVER () AS pid, {tokens('nr')} AS a, {tokens('ng')} AS b
  FROM (SELECT DISTINCT nr, ng FROM normed WHERE nr IS NOT NULL AND ng IS NOT NULL))"""

GRAMS = """orders AS (SELECT unnest([1, 2, 3, 4]) AS n), ga AS (
  SELECT pid, n, array_to_string(a[i:i + n - 1], ' ') AS g, count(*) AS c
  FROM pairs, orders, range(1, (SELECT max(len(a)) + 1 FROM pairs)) r(i) WHERE i + n - 1 <= len(a) GROUP BY ALL), goldn AS (
  SELECT ng, any_value(b) AS b FROM pairs GROUP BY ng), gb AS (
  SELECT ng, n, array_to_string(b[i:i + n - 1], ' ') AS g, count(*) AS c
  FROM goldn, orders, range(1, (SELECT max(len(b)) + 1 FROM pairs)) r(i) WHERE i + n - 1 <= len(b) GROUP BY ALL), hits AS (
  SELECT pid, n, sum(least(ga.c, gb.c))::BIGINT AS m
  FROM ga JOIN pairs USING (pid) JOIN gb USING (ng, n, g) GROUP BY pid, n)"""

# Token F1 and, when asked, BLEU and ROUGE-L of every distinct text pair.
F1_PART = """f1s AS (
  SELECT p.pid, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN m IS NULL THEN 0.0::DOUBLE
    ELSE 2 * (m::DOUBLE / len(a)) * (m::DOUBLE / len(b)) / (m::DOUBLE / len(a) + m::DOUBLE / len(b)) END AS token_f1
  FROM pairs p LEFT JOIN hits h ON h.pid = p.pid AND h.n = 1)"""
BLEU_PART = """precisions AS (
  SELECT p.pid, o.n, coalesce(h.m, 0) AS m, greatest(len(a) - o.n + 1, 1) AS total
  FROM pairs p CROSS JOIN orders o LEFT JOIN hits h ON h.pid = p.pid AND h.n = o.n), bleus AS (
  SELECT p.pid, CASE WHEN max(m) FILTER (n = 1) = 0 THEN 0.0::DOUBLE ELSE
    exp(sum(0.25::DOUBLE * ln(CASE WHEN m = 0 THEN 0.1::DOUBLE ELSE m::DOUBLE END / total)))
    * any_value(CASE WHEN len(a) < len(b) THEN exp(1 - len(b)::DOUBLE / greatest(len(a), 1)) ELSE 1.0::DOUBLE END) END AS bleu
  FROM precisions JOIN pairs p USING (pid) GROUP BY p.pid)"""
ROUGE_PART = """places AS (
  SELECT pid, len(a) AS na, len(b) AS nb, flatten(list_transform(a, lambda t:
    list_reverse(list_filter(range(1, len(b) + 1), lambda j: b[j] = t)))) AS js FROM pairs), tails AS (
  SELECT pid, na, nb, len(list_reduce(list_transform(js, lambda j: [j]), lambda t, j:
    list_concat(list_concat(list_filter(t, lambda v: v < j[1]), j), list_filter(t, lambda v: v >= j[1])[2:]),
    []::BIGINT[])) AS lcs FROM places), rouges AS (
  SELECT pid, CASE WHEN lcs IS NULL OR lcs = 0 THEN 0.0::DOUBLE ELSE
    2 * (lcs::DOUBLE / na) * (lcs::DOUBLE / nb) / (lcs::DOUBLE / na + lcs::DOUBLE / nb) END AS rouge_l FROM tails)"""

# Characters in matching blocks: the longest run of a box splits it, level by level (a query with it says WITH RECURSIVE).
SIMILAR_PART = """sim_golds AS (
  SELECT ng, row_number() OVER () AS gid, length(ng) AS n FROM (SELECT DISTINCT ng FROM pairs)), sim_sides AS (
  SELECT pid, gid, string_split(nr, '') AS x, string_split(ng, '') AS y, length(nr) AS nx, length(ng) AS ny
  FROM pairs JOIN sim_golds USING (ng) WHERE length(nr) > 0 AND length(ng) > 0), sim_chars AS (
  SELECT gid, n, unnest(string_split(ng, '')) AS ch, unnest(range(n)) AS j FROM sim_golds WHERE n > 0), sim_letters AS (
  SELECT gid, ch, list(j) AS js FROM sim_chars GROUP BY gid, n, ch HAVING n < 200 OR count(*) <= n // 100 + 1), sim_placed AS (
  SELECT pid, gid, unnest(x) AS ch, unnest(range(nx)) AS i FROM sim_sides), sim_equals AS (
  SELECT pid, i, unnest(js) AS j FROM sim_placed JOIN sim_letters USING (gid, ch)), sim_stretches AS (
  SELECT pid, i - j AS d, min(i) AS s, max(i) + 1 AS e FROM (
    SELECT pid, i, j, i - row_number() OVER (PARTITION BY pid, i - j ORDER BY i) AS island FROM sim_equals)
  GROUP BY pid, i - j, island), sim_boxes AS (
  SELECT pid, 0::BIGINT AS al, nx::BIGINT AS ah, 0::BIGINT AS bl, ny::BIGINT AS bh, 0::BIGINT AS size, 0 AS level FROM sim_sides
  UNION ALL
  (WITH sim_clipped AS (
    SELECT b.pid, b.al, b.ah, b.bl, b.bh, b.level, greatest(s, al, bl + d) AS i, d, least(e, ah, bh + d) - greatest(s, al, bl + d) AS k
    FROM sim_boxes b JOIN sim_stretches t ON t.pid = b.pid AND least(e, ah, bh + d) > greatest(s, al, bl + d)), sim_best AS (
    SELECT pid, al, bl, min({'k': -k, 'i': i, 'j': i - d}) AS m FROM sim_clipped GROUP BY pid, al, bl), sim_seeds AS (
    SELECT b.pid, b.al, b.ah, b.bl, b.bh, b.level, coalesce(m.i, b.al) AS i, coalesce(m.j, b.bl) AS j, coalesce(-m.k, 0) AS k
    FROM sim_boxes b LEFT JOIN sim_best USING (pid, al, bl) WHERE b.al < b.ah AND b.bl < b.bh), sim_grown AS (
    SELECT s.*, coalesce(list_min(list_filter(range(least(i - al, j - bl)), lambda t: x[i - t] <> y[j - t])), least(i - al, j - bl)) AS back,
      coalesce(list_min(list_filter(range(least(ah - i, bh - j) - k), lambda t: x[i + k + t + 1] <> y[j + k + t + 1])), least(ah - i, bh - j) - k) AS fore
    FROM sim_seeds s JOIN sim_sides USING (pid)), sim_blocks AS (
    SELECT pid, al, ah, bl, bh, level, i - back AS i, j - back AS j, k + back + fore AS k FROM sim_grown WHERE k + back + fore > 0)
  SELECT pid, al, i, bl, j, k, level + 1 FROM sim_blocks UNION ALL SELECT pid, i + k, ah, j + k, bh, 0, level + 1 FROM sim_blocks)), likenesses AS MATERIALIZED (
  SELECT p.pid, CASE WHEN length(nr) + length(ng) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(chars, 0) / (length(nr) + length(ng)) END AS string_similarity
  FROM pairs p LEFT JOIN (SELECT pid, sum(size)::BIGINT AS chars FROM sim_boxes GROUP BY pid) USING (pid))"""

PERFORMANCE = """eval_count::DOUBLE AS output_tokens, total_duration::DOUBLE / 1e6 AS latency_ms,
  CASE WHEN total_duration > 0 THEN eval_count::DOUBLE / (total_duration::DOUBLE / 1e9) END AS tokens_per_second"""
EQUALITY = """(response_text IS NOT DISTINCT FROM gold_answer)::INTEGER::DOUBLE AS exact_match,
  (normed.nr IS NOT DISTINCT FROM normed.ng)::INTEGER::DOUBLE AS normalized_exact_match"""

SCORED_F1 = f"""{NORMED}, {GRAMS.replace('[1, 2, 3, 4]', '[1]')}, {F1_PART}, scored AS (
  SELECT normed.*, {PERFORMANCE}, {EQUALITY}, token_f1
  FROM normed LEFT JOIN pairs USING (nr, ng) LEFT JOIN f1s USING (pid))"""
SCORED = f"""{NORMED}, {GRAMS}, {F1_PART}, {BLEU_PART}, {ROUGE_PART}, scored AS (
  SELECT normed.*, {PERFORMANCE}, {EQUALITY}, token_f1, bleu, rouge_l
  FROM normed LEFT JOIN pairs USING (nr, ng) LEFT JOIN f1s USING (pid) LEFT JOIN bleus USING (pid)
  LEFT JOIN rouges USING (pid))"""
SCORED_ALL = f"""{SCORED.replace(', scored AS (', ', lexical AS (')}, {SIMILAR_PART}, scored AS (
  SELECT lexical.*, string_similarity FROM lexical LEFT JOIN pairs USING (nr, ng) LEFT JOIN likenesses USING (pid))"""
SCORED_SIMILAR = f"""{NORMED}, {SIMILAR_PART}, scored AS (
  SELECT normed.*, string_similarity FROM normed LEFT JOIN pairs USING (nr, ng) LEFT JOIN likenesses USING (pid))"""

METRICS = ("exact_match", "normalized_exact_match", "token_f1", "string_similarity", "bleu", "rouge_l", "judge_score")
F1_METRICS = ("exact_match", "normalized_exact_match", "token_f1", "judge_score")


def r9(x: str, name: str | None = None) -> str:
    return f"round({x}, 9) AS {name or x}"


def stats(metrics) -> str:
    calls = {"mean": "avg", "median": "median", "std": "stddev_samp", "min": "min", "max": "max"}
    return ", ".join(r9(f"{f}({m})", f"{m}_{s}") for m in metrics for s, f in calls.items())


RUNS = """runs AS (
  SELECT model, question_id, count(run_index) AS n_runs, count(DISTINCT response_text) AS unique_responses,
    count(DISTINCT nr) AS unique_normalized_responses, avg(length(response_text)) AS avg_response_length
  FROM normed GROUP BY ALL), modal AS (
  SELECT model, question_id, max(c) AS modal_normalized_response_count FROM (
    SELECT model, question_id, nr, count(*) AS c FROM normed GROUP BY ALL) GROUP BY ALL), run_stats AS (
  SELECT model, question_id, n_runs, unique_responses, unique_normalized_responses, avg_response_length,
    unique_responses::DOUBLE / n_runs AS response_uniqueness_rate,
    unique_normalized_responses::DOUBLE / n_runs AS normalized_response_uniqueness_rate,
    modal_normalized_response_count, modal_normalized_response_count::DOUBLE / n_runs AS normalized_self_agreement_rate
  FROM runs JOIN modal USING (model, question_id))"""
RUN_COLUMNS = ", ".join(
    [
        "n_runs",
        "unique_responses",
        "unique_normalized_responses",
        r9("avg_response_length"),
        r9("response_uniqueness_rate"),
        r9("normalized_response_uniqueness_rate"),
        "modal_normalized_response_count",
        r9("normalized_self_agreement_rate"),
    ]
)
MEAN_F1 = """means AS (SELECT model, question_id, avg(token_f1) AS token_f1_mean, avg(rouge_l) AS rouge_l_mean,
  avg(judge_score) AS judge_score_mean FROM scored GROUP BY ALL)"""
REPRO_COLUMNS = ("normalized_self_agreement_rate", "normalized_response_uniqueness_rate")
QUALITY_COLUMNS = ("token_f1_mean", "rouge_l_mean", "judge_score_mean")


def bootstrap(source: str, columns, n_boot: int = 1000, seed: int = 42) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"v_{c} AS (SELECT model, list({c} ORDER BY {c}) AS v FROM {source} WHERE {c} IS NOT NULL GROUP BY model), "
            f"b_{c} AS (SELECT model, b, avg(v[{draw(str(seed), 'model', 'b', 'i')} % len(v) + 1]) AS m "
            f"FROM v_{c}, range(0, {n_boot}) t(b), range(0, (SELECT max(len(v)) FROM v_{c})) s(i) "
            f"WHERE i < len(v) GROUP BY ALL), "
            f"i_{c} AS (SELECT model, quantile_cont(m, 0.025) AS {c}_ci_low, quantile_cont(m, 0.975) AS {c}_ci_high "
            f"FROM b_{c} GROUP BY model)"
        )
    means = ", ".join(f"avg({c}) AS {c}_mean" for c in columns)
    joins = " ".join(f"LEFT JOIN i_{c} USING (model)" for c in columns)
    parts.append(
        f"summary AS (SELECT * FROM (SELECT model, count(*) AS n_questions, {means} FROM {source} GROUP BY model) {joins})"
    )
    return ", ".join(parts)


def summary_columns(columns) -> str:
    return ", ".join(r9(f"{c}_{p}") for c in columns for p in ("mean", "ci_low", "ci_high"))


PAIR_BUDGET = 20


def run_pairs(budget: int = PAIR_BUDGET, seed: int = 42) -> str:
    """All index pairs ranked, a Floyd sample of ranks, and the runs in seeded order, joined relationally."""
    last = f"(total - {budget} + t[1])"
    drawn = f"({draw(str(seed), 'model', 'question_id', 't[1]')} % ({last} + 1))"
    return f"""ordered AS (
  SELECT model, question_id, run_index, response_text AS text, row_number() OVER (
    PARTITION BY model, question_id ORDER BY {draw(str(seed), 'model', 'question_id', 'run_index')}, run_index) - 1 AS at
  FROM answers), sizes AS (
  SELECT model, question_id, count(*) AS n, (count(*) * (count(*) - 1) / 2)::BIGINT AS total FROM answers GROUP BY ALL
), picks AS (
  SELECT model, question_id, n, unnest(CASE WHEN total > {budget} THEN
    list_reduce(list_transform(range(0, {budget}), lambda i: [i]), lambda s, t: list_append(s,
      CASE WHEN list_contains(s, {drawn}) THEN {last} ELSE {drawn} END), []::BIGINT[])
    ELSE range(0, total) END) AS rank FROM sizes), index_pairs AS (
  SELECT model, question_id, i, j FROM picks JOIN (
    SELECT i, j, (j * (j - 1) / 2)::BIGINT + i AS rank FROM range(0, (SELECT max(n) FROM sizes)) a(i), range(0, (SELECT max(n) FROM sizes)) b(j) WHERE i < j)
  USING (rank)), touched AS (
  SELECT model, question_id, x, row_number() OVER (PARTITION BY model, question_id ORDER BY x) - 1 AS at FROM (
    SELECT model, question_id, i AS x FROM index_pairs UNION SELECT model, question_id, j FROM index_pairs)),
  chosen AS (
  SELECT p.model, p.question_id, least(a.run_index, b.run_index) AS run_i, greatest(a.run_index, b.run_index) AS run_j,
    CASE WHEN a.run_index < b.run_index THEN a.text ELSE b.text END AS text_i,
    CASE WHEN a.run_index < b.run_index THEN b.text ELSE a.text END AS text_j
  FROM index_pairs p
  JOIN touched ti ON ti.model = p.model AND ti.question_id = p.question_id AND ti.x = p.i
  JOIN touched tj ON tj.model = p.model AND tj.question_id = p.question_id AND tj.x = p.j
  JOIN ordered a ON a.model = p.model AND a.question_id = p.question_id AND a.at = ti.at
  JOIN ordered b ON b.model = p.model AND b.question_id = p.question_id AND b.at = tj.at)"""


def text_match(pairs: str, left: str, right: str, tag: str = "") -> str:
    """Greedy matching of the md5-digit vectors of the space-separated tokens of two text columns."""
    digit = "('0x' || substr(md5(tok), d, 1))::INTEGER - 7.5::DOUBLE"
    made = f"""texts2 AS (SELECT DISTINCT {left} AS x, {right} AS y FROM {pairs} WHERE {left} IS NOT NULL AND {right} IS NOT NULL),
  words AS (SELECT DISTINCT unnest(list_concat({tokens('x')}, {tokens('y')})) AS tok FROM texts2), vecs AS (
  SELECT tok, list({digit} ORDER BY d) AS v FROM words, range(1, 9) r(d) GROUP BY tok), lx AS (
  SELECT x, y, unnest({tokens('x')}) AS tx FROM texts2), ly AS (
  SELECT x, y, unnest({tokens('y')}) AS ty FROM texts2), cos AS (
  SELECT x, y, tx, ty, list_cosine_similarity(a.v, b.v) AS c
  FROM (SELECT DISTINCT x, y, tx FROM lx) JOIN (SELECT DISTINCT x, y, ty FROM ly) USING (x, y)
  JOIN vecs a ON a.tok = tx JOIN vecs b ON b.tok = ty), px AS (
  SELECT x, y, avg(best) AS p FROM lx JOIN (SELECT x, y, tx, max(c) AS best FROM cos GROUP BY ALL) USING (x, y, tx) GROUP BY ALL), py AS (
  SELECT x, y, avg(best) AS r FROM ly JOIN (SELECT x, y, ty, max(c) AS best FROM cos GROUP BY ALL) USING (x, y, ty) GROUP BY ALL),
  matched AS (SELECT x, y, coalesce(p, 0)::DOUBLE AS p, coalesce(r, 0)::DOUBLE AS r,
    CASE WHEN coalesce(p, 0) + coalesce(r, 0) = 0 THEN 0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1
  FROM texts2 LEFT JOIN px USING (x, y) LEFT JOIN py USING (x, y))"""
    names = ("texts2", "words", "vecs", "lx", "ly", "cos", "px", "py", "matched")
    return re.sub(rf"\b({'|'.join(names)})\b", rf"\1{tag}", made)


PASSES = f"""{ANSWERS}, long AS (
  SELECT model || '|' || question_id AS response_idx, run_index AS pass_index, {parsed('judge_text')} AS judge_score
  FROM answers), per AS (
  SELECT response_idx, count(judge_score) AS k, avg(judge_score) AS m, sum(judge_score) AS s,
    stddev_samp(judge_score) AS within_std FROM long GROUP BY ALL), good AS (SELECT * FROM per WHERE k >= 2)"""
ICC = """parts AS (
  SELECT count(*) AS n, sum(k)::DOUBLE AS total, sum(s) / sum(k) AS grand FROM good), ss AS (
  SELECT sum(k * (m - grand) ** 2) AS between_ss FROM good, parts), sw AS (
  SELECT sum((l.judge_score - g.m) ** 2) AS within_ss FROM long l JOIN good g USING (response_idx)), icc AS (
  SELECT (between_ss / (n - 1) - within_ss / (total - n))
    / (between_ss / (n - 1) + (total / n - 1) * within_ss / (total - n)) AS icc1 FROM parts, ss, sw)"""

RETRY = literal(f"{judge.DEFAULT_RUBRIC}\n\n{judge.RETRY_FORMAT}\n\nQUESTION: ")
PROMPTS = f"""prompts AS (
  SELECT *, {literal(judge.LEAD_IN)} || '{{"instructions": ' || to_json({literal(judge.DEFAULT_RUBRIC)})::VARCHAR
    || ', "question": ' || to_json(question)::VARCHAR || ', "gold_answer": ' || to_json(coalesce(gold_answer, 'nan'))::VARCHAR
    || ', "model_answer": ' || to_json(coalesce(response_text, 'nan'))::VARCHAR
    || ', "output_format": {judge.OUTPUT_FORMAT}}}' AS judge_prompt,
    {RETRY} || question || chr(10) || 'GOLD_ANSWER: ' || coalesce(gold_answer, 'nan') || chr(10) || 'MODEL_ANSWER: '
    || coalesce(response_text, 'nan') || chr(10) AS judge_fallback
  FROM answers), asked AS (
  SELECT *, ('0x' || substr(md5(judge_prompt), 1, 8))::BIGINT AS hp,
    ('0x' || substr(md5(judge_fallback), 1, 8))::BIGINT AS hf FROM prompts), replied AS (
  SELECT *, CASE WHEN hp % 7 > 1 THEN 'score=0.' || hp % 10 || ' rationale=x' WHEN hp % 7 = 1 THEN 'undecided'
    WHEN hf % 7 > 1 THEN 'score=0.' || hf % 10 || ' rationale=x' WHEN hf % 7 = 1 THEN 'undecided'
    ELSE '' END AS reply FROM asked)"""

SUBSET = f"""drawn AS (
  SELECT *, {draw("42", "model", "question_id", "run_index")} AS dr FROM replied), rank_in AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY dr, question_id, run_index) AS rn FROM drawn), subset AS (
  SELECT *, row_number() OVER (ORDER BY model, rn) - 1 AS response_idx FROM rank_in WHERE rn <= 5)"""

REQUESTS = f"""{QA}, grid AS (
  SELECT 'm' || m AS model, id AS question_id, question, gold_answer, r::INTEGER AS run_index, 42 + r AS seed
  FROM qa, range(1, 6) t(m), range(0, 10) s(r))"""


def replies(runs: int, models: int = 5) -> str:
    return f"""{QA}, calls AS (
  SELECT 'm' || m AS model, id AS question_id, question, gold_answer, r::INTEGER AS run_index, 42 + r AS seed,
    {draw("'m' || m", "42 + r", "question")} AS h
  FROM qa, range(1, {models + 1}) t(m), range(0, {runs}) s(r)), answers AS (
  SELECT *, array_to_string(string_split(question, ' ')[1:2 + h % 4], ' ') AS response_text,
    (200 + h % 4000) * 1000000 AS total_duration, 2 + h % 4 AS eval_count FROM calls)"""


SEMANTIC = """semantic AS (SELECT model, question_id, avg(f1) AS sm, CASE WHEN count(f1) > 1 THEN stddev_pop(f1) END AS ss,
  count(f1) AS n_semantic_pairs FROM chosen LEFT JOIN matched ON x = text_i AND y = text_j GROUP BY ALL)"""
SEMANTIC_COLUMNS = f"""{r9('sm', 'semantic_self_similarity_mean')}, {r9('ss', 'semantic_self_similarity_std')}, n_semantic_pairs"""
BERT = ("bertscore_precision", "bertscore_recall", "bertscore_f1")


def similarity() -> str:
    return f"""{NORMED}, sim AS (
  SELECT a.model AS model_a, b.model AS model_b, avg((a.nr = b.nr)::INTEGER) AS similarity
  FROM normed a JOIN normed b USING (question_id, run_index)
  WHERE a.nr IS NOT NULL AND b.nr IS NOT NULL GROUP BY ALL)"""


def queries() -> dict[str, str]:
    agg = f"{SCORED_F1}, {RUNS}"
    both = f"{SCORED}, {RUNS}, {MEAN_F1}"
    qa_list = "row_number() OVER (ORDER BY conv_id, turn)"
    raw = "model, question_id, run_index, response_text, eval_count, total_duration"
    doc = norm("text")
    return {
        # sources and sinks
        "read_gold_csv": f"WITH {QA} SELECT 'q' || {qa_list} AS id, question, gold_answer, '' AS category FROM qa",
        "read_gold_markdown": f"""WITH {QA} SELECT id, {strip("replace(question, chr(10), ' ')")} AS question,
            {strip("replace(coalesce(gold_answer, ''), chr(10), ' ')")} AS gold_answer, '' AS category FROM qa""",
        "normalize_qa_source": f"""SELECT {strip("question")} AS question, {strip("answer")} AS answer,
            'MedicationQA' AS source, focus || ' | ' || kind AS focus_area FROM (
            SELECT CASE WHEN turn % 3 = 0 THEN ' ' || text || chr(10) ELSE text END AS question,
              CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE text END AS answer, role AS focus,
              CASE WHEN turn % 2 = 0 THEN '' ELSE 'turn' END AS kind FROM conversations)
            WHERE {strip("question")} <> '' AND {strip("answer")} <> ''""",
        "read_responses": f"WITH {ANSWERS} SELECT {raw} FROM answers",
        "write_responses": f"""WITH {ANSWERS} SELECT kind, {raw}, question, gold_answer
            FROM answers, (SELECT unnest(['jsonl', 'parquet', 'csv']) AS kind)""",
        "read_stage": f"""WITH {ANSWERS} SELECT kind, {raw} FROM answers, (SELECT unnest(['csv', 'parquet']) AS kind)""",
        "write_stage": f"WITH {ANSWERS} SELECT {raw} FROM answers",
        "write_scored": f"""WITH {SCORED_F1} SELECT model, question_id, run_index, response_text,
            {r9('token_f1')}, {r9('exact_match')} FROM scored""",
        "write_aggregates": f"""WITH {NORMED}, {RUNS} SELECT model, question_id, {RUN_COLUMNS} FROM run_stats""",
        "write_judge_reliability": f"""WITH {PASSES}, {ICC} SELECT 'scores' AS kind, *, NULL::DOUBLE AS passes, NULL::DOUBLE AS n_responses,
              NULL::DOUBLE AS mean_within_response_std, NULL::DOUBLE AS median_within_response_std, NULL::DOUBLE AS icc1 FROM (SELECT model || '|' || question_id AS response_idx, model, question_id,
            run_index AS pass_index, {parsed('judge_text')} AS judge_score, judge_text FROM answers)
            UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, NULL, NULL, 10.0, count(*), {r9('avg(within_std)', 'a')},
              {r9('median(within_std)', 'b')}, (SELECT round(icc1, 9) FROM icc) FROM good""",
        "export_sample": f"WITH {QA} SELECT id, question, gold_answer FROM qa ORDER BY {draw('42', 'id')}, id LIMIT 50",
        # projections and filters
        "head_sample": f"WITH {QA} SELECT id, question FROM qa ORDER BY conv_id, turn LIMIT 25",
        "random_sample": f"WITH {QA} SELECT id, question FROM qa ORDER BY {draw('7', 'id')}, id LIMIT 50",
        "with_performance": f"""WITH {ANSWERS} SELECT model, question_id, run_index, output_tokens, {r9('latency_ms')},
            {r9('tokens_per_second')} FROM (SELECT *, {PERFORMANCE} FROM answers)""",
        "with_normalized": f"WITH {NORMED} SELECT model, question_id, run_index, nr AS normalized_response, ng AS normalized_gold FROM normed",
        "with_response_len": f"WITH {ANSWERS} SELECT model, question_id, run_index, length(response_text) AS response_len FROM answers",
        "usable_rows": f"""WITH {QA} SELECT id FROM qa WHERE {strip('question')} <> '' AND {strip('gold_answer')} <> ''""",
        # joins
        "request_grid": f"""WITH {REQUESTS} SELECT model, 'ollama' AS provider, question_id, question, gold_answer,
            '' AS category, run_index, seed, 'Be brief.' AS system FROM grid""",
        "pending_requests": f"""WITH {ANSWERS} SELECT model, question_id, run_index FROM answers WHERE h % 3 = 0""",
        "attach_semantic": f"""WITH {NORMED}, {RUNS}, {run_pairs()}, {text_match('chosen', 'text_i', 'text_j')}, {SEMANTIC}
            SELECT r.model, r.question_id, n_runs, {SEMANTIC_COLUMNS}
            FROM run_stats r LEFT JOIN semantic s ON s.model = r.model AND s.question_id = r.question_id AND r.model <> 'm5'""",
        "pairwise_model_similarity": f"WITH {similarity()} SELECT model_a, model_b, {r9('similarity')} FROM sim",
        "run_pairs": f"WITH {ANSWERS}, {run_pairs()} SELECT * FROM chosen",
        # aggregations
        "metric_stats": f"WITH RECURSIVE {SCORED_ALL} SELECT model, question_id, {stats(METRICS)} FROM scored GROUP BY ALL",
        "run_stats": f"WITH {NORMED}, {RUNS} SELECT model, question_id, {RUN_COLUMNS} FROM run_stats",
        "uniqueness_rates": f"""WITH {NORMED}, {RUNS} SELECT model, question_id, {r9('response_uniqueness_rate')},
            {r9('normalized_response_uniqueness_rate')} FROM run_stats""",
        "self_agreement": f"""WITH {NORMED}, {RUNS} SELECT model, question_id, n_runs, modal_normalized_response_count,
            {r9('normalized_self_agreement_rate')} FROM run_stats""",
        "compute_aggregates": f"""WITH RECURSIVE {SCORED_ALL}, {RUNS}, {run_pairs()}, {text_match('chosen', 'text_i', 'text_j')}, {SEMANTIC},
            {text_match('answers', 'response_text', 'gold_answer', '_g')}, all_scored AS (
            SELECT scored.*, p AS bertscore_precision, r AS bertscore_recall, f1 AS bertscore_f1
            FROM scored LEFT JOIN matched_g ON x = response_text AND y = gold_answer)
            SELECT * FROM (
            SELECT model, question_id, {stats((*METRICS, *BERT))} FROM all_scored GROUP BY ALL) JOIN (
            SELECT model, question_id, {RUN_COLUMNS} FROM run_stats) USING (model, question_id) LEFT JOIN (
            SELECT model, question_id, {SEMANTIC_COLUMNS} FROM semantic) USING (model, question_id)""",
        "model_means": f"""WITH {NORMED}, {RUNS} SELECT model, count(*) AS n_questions,
            {', '.join(r9(f'avg({c})', f'{c}_mean') for c in REPRO_COLUMNS)} FROM run_stats GROUP BY model""",
        "bootstrap_ci": f"""WITH {NORMED}, {RUNS}, {bootstrap('run_stats', REPRO_COLUMNS)} SELECT model,
            {', '.join(r9(f'{c}_ci_{s}') for c in REPRO_COLUMNS for s in ('low', 'high'))} FROM summary""",
        "model_summary": f"""WITH {both}, {bootstrap('means', QUALITY_COLUMNS)}
            SELECT model, n_questions, {summary_columns(QUALITY_COLUMNS)} FROM summary""",
        "quality_by_model": f"""WITH RECURSIVE {SCORED_ALL} SELECT model, {', '.join(r9(f'{f}({m})', f'{m}_{s}')
            for s, f in (('avg', 'avg'), ('median', 'median'))
            for m in METRICS if m != 'normalized_exact_match')},
            row_number() OVER (ORDER BY avg(token_f1) DESC NULLS LAST, model)::INTEGER AS place FROM scored GROUP BY model""",
        "reproducibility_by_model": f"""WITH {NORMED}, {RUNS} SELECT model, {', '.join(r9(f'avg({c})', c) for c in REPRO_COLUMNS)},
            row_number() OVER (ORDER BY avg(normalized_self_agreement_rate) DESC NULLS LAST, model)::INTEGER AS place
            FROM run_stats GROUP BY model""",
        "reproducibility_by_model_question": f"""WITH {NORMED}, {RUNS} SELECT model, question_id, n_runs,
            {', '.join(r9(c) for c in REPRO_COLUMNS)} FROM run_stats""",
        "global_uniqueness": f"""WITH {NORMED} SELECT model, count(response_text) AS total_outputs,
            count(DISTINCT response_text) AS unique_outputs, count(DISTINCT nr) AS unique_normalized_outputs,
            round(count(DISTINCT response_text)::DOUBLE / count(response_text), 9) AS global_response_uniqueness_rate,
            round(count(DISTINCT nr)::DOUBLE / count(response_text), 9) AS global_normalized_uniqueness_rate,
            row_number() OVER (ORDER BY count(DISTINCT nr)::DOUBLE / count(response_text), model)::INTEGER AS place
            FROM normed GROUP BY model""",
        "performance_by_model": f"""WITH {ANSWERS} SELECT model, {', '.join(r9(f'{f}({m})', f'{m}_{s}')
            for s, f in (('avg', 'avg'), ('median', 'median'))
            for m in ('latency_ms', 'output_tokens', 'tokens_per_second'))},
            row_number() OVER (ORDER BY avg(latency_ms) NULLS LAST, model)::INTEGER AS place
            FROM (SELECT *, {PERFORMANCE} FROM answers) GROUP BY model""",
        "semantic_repro": f"""WITH {ANSWERS}, {run_pairs()}, {text_match('chosen', 'text_i', 'text_j')}
            SELECT model, question_id, {r9('avg(f1)', 'semantic_self_similarity_mean')},
            CASE WHEN count(f1) > 1 THEN round(stddev_pop(f1), 9) END AS semantic_self_similarity_std,
            count(f1) AS n_semantic_pairs
            FROM chosen LEFT JOIN matched ON x = text_i AND y = text_j GROUP BY ALL""",
        "within_response_std": f"WITH {PASSES} SELECT response_idx, k AS parsed, {r9('within_std')} FROM good",
        "icc1": f"WITH {PASSES}, {ICC} SELECT {r9('icc1')} FROM icc",
        "judge_summary": f"""WITH {PASSES}, {ICC} SELECT 10.0::DOUBLE AS passes, count(*)::DOUBLE AS n_responses,
            {r9('avg(within_std)', 'mean_within_response_std')}, {r9('median(within_std)', 'median_within_response_std')},
            (SELECT round(icc1, 9) FROM icc) AS icc1 FROM good""",
        "judge_parse_audit": f"""WITH {NORMED} SELECT count(*) AS n_rows, count(judge_score) AS parsed_scores,
            count(*) - count(judge_score) AS parse_failures FROM normed""",
        "run_progress": f"""WITH {ANSWERS} SELECT model, count(*) AS total_calls, count(*) FILTER (h % 3 <> 0) AS completed_calls,
            count(*) FILTER (h % 3 = 0) AS pending_calls FROM answers GROUP BY model""",
        # windows, ranking, reshaping
        "stratified_subset": f"""WITH {ANSWERS}, {PROMPTS}, {SUBSET} SELECT model, question_id, run_index, response_text FROM subset""",
        "group_ratio": f"""WITH {NORMED}, g AS (SELECT model, question_id,
            count(DISTINCT response_text)::DOUBLE / count(*) AS u, count(DISTINCT nr)::DOUBLE / count(*) AS un
            FROM normed GROUP BY ALL) SELECT model, question_id, run_index, {r9('u', 'is_unique_response')},
            {r9('un', 'is_unique_normalized_response')} FROM normed JOIN g USING (model, question_id)""",
        "least_reproducible": f"""WITH {NORMED}, {RUNS} SELECT model, question_id, n_runs, {', '.join(r9(c) for c in REPRO_COLUMNS)},
            row_number() OVER (ORDER BY normalized_self_agreement_rate, normalized_response_uniqueness_rate DESC, model, question_id)::INTEGER AS place
            FROM run_stats QUALIFY place <= 20""",
        "union_responses": f"WITH {ANSWERS} SELECT model, question_id, run_index, response_text FROM answers",
        "similarity_matrix": f"""WITH {similarity()} SELECT model_a AS model, {', '.join(
            f"round(max(similarity) FILTER (model_b = 'm{i}'), 9) AS m{i}" for i in range(1, 6))} FROM sim GROUP BY model_a""",
        "token_f1_heatmap": f"WITH {SCORED_F1} SELECT model, question_id, {r9('avg(token_f1)', 'token_f1_mean')} FROM scored GROUP BY ALL",
        "token_f1_bar": f"""WITH {SCORED_F1} SELECT model, {r9('avg(token_f1)', 'mean')}, {r9('stddev_samp(token_f1)', 'sd')},
            {r9('avg(token_f1) - stddev_samp(token_f1)', 'low')}, {r9('avg(token_f1) + stddev_samp(token_f1)', 'high')}
            FROM scored GROUP BY model""",
        "string_similarity_box": f"""WITH RECURSIVE {SCORED_SIMILAR}, q AS (SELECT model, quantile_cont(string_similarity, 0.25) AS q1,
            quantile_cont(string_similarity, 0.5) AS median, quantile_cont(string_similarity, 0.75) AS q3 FROM scored GROUP BY model)
            SELECT model, {r9('any_value(q1)', 'q1')}, {r9('any_value(median)', 'median')}, {r9('any_value(q3)', 'q3')},
            {r9('min(string_similarity) FILTER (string_similarity >= q1 - 1.5 * (q3 - q1))', 'whisker_low')},
            {r9('max(string_similarity) FILTER (string_similarity <= q3 + 1.5 * (q3 - q1))', 'whisker_high')},
            count(*) FILTER (string_similarity < q1 - 1.5 * (q3 - q1) OR string_similarity > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM scored JOIN q USING (model) GROUP BY model""",
        "ci_bars": f"""WITH {NORMED}, {RUNS}, {bootstrap('run_stats', REPRO_COLUMNS)} {' UNION ALL '.join(
            f"SELECT model, '{c}' AS metric, round({c}_mean, 9) AS mean, round(greatest({c}_mean - {c}_ci_low, 0), 9) AS whisker_low, "
            f"round(greatest({c}_ci_high - {c}_mean, 0), 9) AS whisker_high FROM summary" for c in REPRO_COLUMNS)}""",
        # scalar and pair functions
        "normalize": f"SELECT doc_id, {doc} AS normalized, length(text) AS chars FROM documents",
        "exact_match": f"WITH {NORMED} SELECT model, question_id, run_index, {EQUALITY} FROM normed",
        "token_f1": f"WITH {SCORED_F1} SELECT model, question_id, run_index, {r9('token_f1')} FROM scored",
        "string_similarity": f"WITH RECURSIVE {SCORED_SIMILAR} SELECT model, question_id, run_index, {r9('string_similarity')} FROM scored",
        "bleu": f"WITH {SCORED} SELECT model, question_id, run_index, {r9('bleu')} FROM scored",
        "rouge_l": f"WITH {SCORED} SELECT model, question_id, run_index, {r9('rouge_l')} FROM scored",
        "embedding_match": """WITH v AS (SELECT vec_id, vec_id // 16 AS pair_id, (vec_id // 8) % 2 AS side, embedding::DOUBLE[] AS e
            FROM embeddings), c AS (SELECT a.pair_id, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS s
            FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = CASE WHEN a.pair_id IN
              (SELECT pair_id FROM v WHERE side = 1) THEN 1 ELSE 0 END), p AS (
            SELECT pair_id, avg(s) AS p FROM (SELECT pair_id, i, max(s) AS s FROM c GROUP BY ALL) GROUP BY pair_id), r AS (
            SELECT pair_id, avg(s) AS r FROM (SELECT pair_id, j, max(s) AS s FROM c GROUP BY ALL) GROUP BY pair_id)
            SELECT pair_id, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1
            FROM p JOIN r USING (pair_id)""",
        "score_semantic": f"""WITH {ANSWERS}, {text_match('answers', 'response_text', 'gold_answer')}
            SELECT model, question_id, run_index, {r9('p', 'bertscore_precision')}, {r9('r', 'bertscore_recall')},
            {r9('f1', 'bertscore_f1')} FROM answers LEFT JOIN matched ON x = response_text AND y = gold_answer""",
        "parse_judge_score": f"WITH {ANSWERS} SELECT model, question_id, run_index, {parsed('judge_text')} AS judge_score FROM answers",
        "judge_requests": f"WITH {ANSWERS}, {PROMPTS} SELECT model, question_id, run_index, judge_prompt, judge_fallback FROM prompts",
        "preview": f"SELECT conv_id, turn, left(replace(text, chr(10), ' '), 160) AS preview FROM conversations",
        "format_mean_ci": f"""WITH {NORMED}, {RUNS}, {bootstrap('run_stats', REPRO_COLUMNS)} SELECT model AS "Model",
            {', '.join(f"format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', {c}_mean, {c}_ci_low, {c}_ci_high) AS {a}"
            for c, a in zip(REPRO_COLUMNS, ('agreement', 'uniqueness')))} FROM summary""",
        # caller's functions
        "run_requests": f"""WITH {replies(10)} SELECT model, 'ollama' AS provider, question_id, question, gold_answer, '' AS category,
            run_index, seed, response_text, true AS done, total_duration, eval_count, '' AS shared_instruction FROM answers""",
        "apply_judge": f"""WITH {ANSWERS}, {PROMPTS} SELECT model, question_id, run_index, {parsed('reply')} AS judge_score,
            reply AS judge_rationale FROM replied""",
        "rejudge": f"""WITH {ANSWERS}, {PROMPTS}, {SUBSET} SELECT response_idx, model, question_id, run_index, p::INTEGER AS pass_index,
            {parsed('reply')} AS judge_score, reply AS judge_text FROM subset, range(0, 5) t(p)""",
        "judge_reliability": f"""WITH {ANSWERS}, {PROMPTS}, {SUBSET}, long AS (
            SELECT response_idx, p::INTEGER AS pass_index, {parsed('reply')} AS judge_score FROM subset, range(0, 5) t(p)),
            per AS (SELECT response_idx, count(judge_score) AS k, avg(judge_score) AS m, sum(judge_score) AS s,
              stddev_samp(judge_score) AS within_std FROM long GROUP BY ALL), good AS (SELECT * FROM per WHERE k >= 2), {ICC}
            SELECT 5.0::DOUBLE AS passes, count(*)::DOUBLE AS n_responses,
            {r9('avg(within_std)', 'mean_within_response_std')}, {r9('median(within_std)', 'median_within_response_std')},
            (SELECT round(icc1, 9) FROM icc) AS icc1 FROM good""",
        "encode": f"""WITH words AS (SELECT text, unnest({tokens('text')}) AS tok FROM (SELECT DISTINCT text FROM conversations)),
            sums AS (SELECT text, count(*) AS vectors, {', '.join(
                f"sum(('0x' || substr(md5(tok), {d}, 1))::INTEGER - 7.5::DOUBLE) AS s{d}" for d in range(1, 9))}
              FROM words GROUP BY text)
            SELECT DISTINCT c.text, coalesce(vectors, 0) AS vectors, {', '.join(
                f"coalesce(s{d}, 0)::DOUBLE AS s{d}" for d in range(1, 9))}
            FROM conversations c LEFT JOIN sums s ON s.text = c.text WHERE c.text IS NOT NULL""",
        "evaluate": f"""WITH {replies(3, 3)}, normed AS (SELECT *, {norm('response_text')} AS nr FROM answers), {RUNS}
            SELECT model, {', '.join(r9(f'avg({c})', c) for c in REPRO_COLUMNS)} FROM run_stats GROUP BY model""",
        # report tables
        "table_1_quality": f"""WITH {both}, {bootstrap('means', QUALITY_COLUMNS)} SELECT model AS "Model",
            {', '.join(f'''format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', {c}_mean, {c}_ci_low, {c}_ci_high) AS "{t}"'''
            for c, t in zip(QUALITY_COLUMNS, ('Token F1', 'ROUGE-L', 'Judge')))} FROM summary""",
        "table_2_reproducibility": f"""WITH {NORMED}, {RUNS}, {bootstrap('run_stats', REPRO_COLUMNS)} SELECT model AS "Model",
            {', '.join(f'''format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', {c}_mean, {c}_ci_low, {c}_ci_high) AS "{t}"'''
            for c, t in zip(REPRO_COLUMNS, ('Self-agreement (lexical) ↑', 'Uniqueness (lexical) ↓')))} FROM summary""",
        # streaming
        "stream_responses": f"WITH {ANSWERS} SELECT {raw} FROM answers",
        "stream_progress": f"WITH {ANSWERS} SELECT model, count(*) AS completed_calls FROM answers GROUP BY model",
    }
