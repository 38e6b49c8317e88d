"""DuckDB SQL with the rows of the registered queries, put together from named steps."""

from __future__ import annotations

from ..functions.text import ENGLISH_STOPWORDS
from ..operators import diagnose, labelling, significance
from .queries import DRAWN, MEASURES

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
SPLIT = r"[^\s\p{Z}\x0b\x{85}]+"
STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS) + "]"

CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0)"
KNOWN = f"""{CORPUS},
asked AS (SELECT doc_id, regexp_extract_all(text, '{SPLIT}') AS w FROM corpus WHERE doc_id::BIGINT % 50 = 0),
forms AS (SELECT doc_id, f, array_to_string(list_slice(w, s, s + 5), ' ') AS text FROM asked, (VALUES ('a', 1), ('b', 8), ('c', 15)) AS v(f, s)),
queries AS (SELECT 'q-' || doc_id || '-' || f AS query_id, text FROM forms WHERE text <> ''),
qrels AS (SELECT 'q-' || doc_id || '-' || f AS query_id, doc_id, 2 AS relevance FROM forms WHERE text <> '')"""
PASSAGE = f"""{CORPUS},
queries AS (SELECT 'b-' || item_id AS query_id, text FROM benchmark WHERE length(text) > 0),
qrels AS (SELECT DISTINCT query_id, doc_id, 1 AS relevance FROM queries JOIN corpus ON contains(corpus.text, queries.text))"""


def terms(text: str, stop: bool) -> str:
    found = f"regexp_extract_all(lower({text}), '{TERM}')"
    return f"list_filter({found}, lambda t: NOT list_contains({STOP}, t))" if stop else found


def words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '{WORD}'))"


IDF = {
    "lucene": "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))",
    "robertson": "ln(greatest(1e0, (n - df + 0.5e0) / (df + 0.5e0)))",
    "atire": "ln(n / df)",
    "bm25+": "ln((n + 1) / df)",
    "bm25l": "ln((n + 1) / (df + 0.5e0))",
}


def bm25(out: str, method: str = "lucene", k1: float = 1.5, b: float = 0.75, stop: bool = True, k: int = 10, units: str = "corpus", unit: str = "doc_id") -> str:
    """Steps that end in `out` (query_id, unit, rank, score)."""
    norm = f"(1 - {b}e0 + {b}e0 * dl / avgdl)"
    c = f"(tf / {norm})"
    part = {
        "lucene": f"tf / (tf + {k1}e0 * {norm})",
        "atire": f"tf * ({k1}e0 + 1) / (tf + {k1}e0 * {norm})",
        "bm25l": f"({k1}e0 + 1) * ({c} + 0.5e0) / ({k1}e0 + {c} + 0.5e0) - ({k1}e0 + 1) * 0.5e0 / ({k1}e0 + 0.5e0)",
    }
    part |= {"robertson": part["lucene"], "bm25+": part["atire"]}
    absent = {"bm25+": "0.5e0", "bm25l": f"({k1}e0 + 1) * 0.5e0 / ({k1}e0 + 0.5e0)"}.get(method, "0e0")
    p = out
    return f"""{p}_tok AS (SELECT {unit} AS unit, {terms('text', stop)} AS t FROM {units}),
{p}_stat AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM {p}_tok),
{p}_post AS MATERIALIZED (SELECT unit, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT unit, len(t)::DOUBLE AS dl, unnest(t) AS term FROM {p}_tok) GROUP BY ALL),
{p}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {p}_post GROUP BY term),
{p}_q AS (SELECT query_id, term, count(*) * {IDF[method]} AS w FROM (SELECT query_id, unnest({terms('text', stop)}) AS term FROM queries) JOIN {p}_df USING (term), {p}_stat GROUP BY query_id, term, n, df),
{p}_hit AS (SELECT query_id, unit, sum(w * ({part[method]})) AS score FROM {p}_q JOIN {p}_post USING (term), {p}_stat GROUP BY ALL),
{p}_match AS (SELECT * FROM {p}_hit WHERE round(score, 9) > 0),
{p}_pad AS (SELECT query_id, unit, 0e0 AS score FROM (SELECT query_id, unit FROM queries, (SELECT unit FROM {p}_tok ORDER BY unit LIMIT {k})) ANTI JOIN {p}_match USING (query_id, unit)),
{p}_off AS (SELECT query_id, sum(w) * {absent} AS off FROM {p}_q GROUP BY query_id),
{p}_all AS (SELECT query_id, unit, round(score + coalesce(off, 0), 9) AS score FROM (SELECT * FROM {p}_match UNION ALL SELECT * FROM {p}_pad) LEFT JOIN {p}_off USING (query_id)),
{out} AS MATERIALIZED (SELECT query_id, unit AS {unit}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit)::INTEGER AS rank, score FROM {p}_all QUALIFY rank <= {k})"""


def tfidf(low: int, high: int, sublinear: bool, smooth: bool, k: int = 10) -> str:
    grams = lambda table, unit: f"SELECT {unit}, gram, count(*)::DOUBLE AS tf FROM (SELECT {unit}, unnest(list_transform(generate_series(1, length(t) - n + 1), lambda i: substr(t, i, n))) AS gram FROM (SELECT {unit}, lower(text) AS t FROM {table}), (SELECT unnest(generate_series({low}, {high})) AS n) WHERE length(t) >= n) GROUP BY ALL"
    idf = "ln((1 + n) / (1 + df)) + 1" if smooth else "ln(n / greatest(df, 1)) + 1"
    weight = "(1 + ln(tf))" if sublinear else "tf"
    return f"""g AS MATERIALIZED ({grams('corpus', 'doc_id')}),
gi AS MATERIALIZED (SELECT gram, {idf} AS idf FROM (SELECT gram, count(*)::DOUBLE AS df FROM g GROUP BY gram), (SELECT count(*)::DOUBLE AS n FROM corpus)),
gn AS (SELECT doc_id, sqrt(sum(pow({weight} * idf, 2))) AS norm FROM g JOIN gi USING (gram) GROUP BY doc_id),
qg AS (SELECT query_id, gram, {weight} * idf AS qw, idf FROM ({grams('queries', 'query_id')}) JOIN gi USING (gram)),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qg GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(qw * {weight} * idf) AS dot FROM qg JOIN g USING (gram) GROUP BY ALL),
m AS (SELECT query_id, doc_id, round(dot / (CASE WHEN norm = 0 THEN 1 ELSE norm END * CASE WHEN qnorm = 0 THEN 1 ELSE qnorm END), 9) AS score FROM dots JOIN gn USING (doc_id) JOIN qn USING (query_id)),
m2 AS (SELECT * FROM m WHERE score > 0),
pad AS (SELECT query_id, doc_id, 0e0 AS score FROM (SELECT query_id, doc_id FROM queries, (SELECT doc_id FROM corpus ORDER BY doc_id LIMIT {k})) ANTI JOIN m2 USING (query_id, doc_id))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM (SELECT * FROM m2 UNION ALL SELECT * FROM pad) QUALIFY rank <= {k}"""


def dense(metric: str) -> str:
    return f"""corpus AS (SELECT vec_id::VARCHAR AS doc_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS v, label FROM embeddings WHERE embedding IS NOT NULL),
asked AS (SELECT 'v-' || doc_id AS query_id, v AS q, label FROM corpus WHERE doc_id::BIGINT % 50 = 0),
qrels AS (SELECT query_id, doc_id, 1 AS relevance FROM asked JOIN corpus USING (label)),
scored AS (SELECT query_id, doc_id, round({metric}(q, v), 9) AS score FROM asked, corpus),
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM scored QUALIFY rank <= 10)"""


def best(out: str, run: str) -> str:
    """`out` (query_id, gold_rank, best_relevant) and the labelled run `out`_rows."""
    return f"""{out}_rows AS (SELECT r.*, coalesce(q.relevance, 0) > 0 AS hit, greatest(coalesce(q.relevance, 0), 0)::DOUBLE AS gain FROM {run} r SEMI JOIN (SELECT query_id FROM qrels WHERE relevance > 0) j USING (query_id) LEFT JOIN qrels q USING (query_id, doc_id)),
{out} AS (SELECT query_id, min(rank) FILTER (hit) AS gold_rank, arg_min(doc_id, rank) FILTER (hit) AS best_relevant FROM {out}_rows GROUP BY query_id)"""


def measures(out: str, run: str, names: tuple[str, ...]) -> str:
    def value(name: str) -> str:
        kind, _, cut = name.partition("@")
        within = f"rank <= {cut}" if cut else "true"
        hits = f"coalesce(count(*) FILTER (hit AND {within}), 0)::DOUBLE"
        ideal = f"list_slice(ideal, 1, {cut})" if cut else "ideal"
        return {
            "nDCG": f"coalesce(sum(gain / log2(rank + 1)) FILTER ({within}), 0) / list_sum(list_transform({ideal}, lambda g, i: g / log2(i + 1)))",
            "RR": f"coalesce(1e0 / min(rank) FILTER (hit AND {within}), 0)",
            "R": f"{hits} / n_relevant",
            "P": f"{hits} / {cut or 1}",
            "AP": f"coalesce(sum(seen::DOUBLE / rank) FILTER (hit AND {within}), 0) / n_relevant",
            "Success": f"({hits} > 0)::INTEGER::DOUBLE",
        }[kind]

    parts = " UNION ALL ".join(f"SELECT query_id, '{n}' AS measure, {value(n)} AS value FROM {out}_seen GROUP BY query_id, n_relevant, ideal" for n in names)
    return f"""{out}_ideal AS (SELECT query_id, count(*) AS n_relevant, list(relevance::DOUBLE ORDER BY relevance DESC) AS ideal FROM qrels WHERE relevance > 0 GROUP BY query_id),
{out}_seen AS MATERIALIZED (SELECT i.query_id, n_relevant, ideal, rank, coalesce(hit, false) AS hit, coalesce(gain, 0) AS gain, sum(hit::INTEGER) OVER (PARTITION BY i.query_id ORDER BY rank) AS seen FROM {out}_ideal i LEFT JOIN {run}_best_rows USING (query_id)),
{out} AS MATERIALIZED ({parts})"""


def evidence(out: str, run: str, before: str | None = None) -> str:
    overlap = lambda a, b: f"round(CASE WHEN max({a}::INTEGER) = 0 OR max({b}::INTEGER) = 0 THEN 0 ELSE coalesce(sum(w) FILTER ({a} AND {b}), 0) / sum(w) FILTER ({a} OR {b}) END, {diagnose.OVERLAP_PLACES})"
    p = out
    earlier = f"LEFT JOIN (SELECT query_id, gold_rank AS rank_before_rerank FROM {before}) USING (query_id)" if before else ""
    return f"""{p}_facts AS (SELECT query_id, min(rank) FILTER (hit) AS gold_rank, arg_min(doc_id, rank) FILTER (hit) AS best_relevant, arg_min(score, rank) FILTER (hit) AS gold_score, arg_min(doc_id, rank) AS top1,
  arg_min(hit, rank) AS top1_is_relevant, arg_min(score, rank) AS top_score, (count(*) FILTER (score = 0))::INTEGER AS zeros FROM {run}_best_rows GROUP BY query_id),
{p}_ref AS (SELECT query_id, arg_max(doc_id, (relevance, doc_id)) AS reference FROM qrels WHERE relevance > 0 GROUP BY query_id),
{p}_known AS (SELECT *, coalesce(best_relevant, reference) AS gold FROM {p}_facts JOIN {p}_ref USING (query_id)),
{p}_sides AS (SELECT query_id, 'q' AS side, text FROM {p}_known JOIN queries USING (query_id)
  UNION ALL SELECT query_id, 'g', text FROM {p}_known JOIN corpus ON doc_id = gold UNION ALL SELECT query_id, 't', text FROM {p}_known JOIN corpus ON doc_id = top1),
{p}_terms AS (SELECT query_id, term, bool_or(side = 'q') AS q, bool_or(side = 'g') AS g, bool_or(side = 't') AS t FROM (SELECT query_id, side, unnest({words('text')}) AS term FROM {p}_sides) GROUP BY ALL),
{p}_idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM (SELECT unnest({words('text')}) AS term FROM corpus), (SELECT count(*)::DOUBLE AS n FROM corpus) GROUP BY term, n),
{p}_over AS (SELECT query_id, {overlap('q', 'g')} AS qg, {overlap('t', 'g')} AS tg, (count(*) FILTER (q))::INTEGER AS n_tokens FROM (SELECT *, coalesce(idf, 1) AS w FROM {p}_terms LEFT JOIN {p}_idf USING (term)) GROUP BY query_id),
{out} AS MATERIALIZED (SELECT query_id, CASE WHEN gold_rank IS NULL OR coalesce(gold_score = 0, false) THEN 'miss' WHEN gold_rank = 1 THEN 'ok' ELSE 'rank' END AS symptom, gold_rank, best_relevant, top1, top1_is_relevant,
  top_score - gold_score AS score_margin, coalesce(qg, 0) AS query_gold_overlap, CASE WHEN top1_is_relevant THEN 0 ELSE coalesce(tg, 0) END AS competitor_gold_overlap, coalesce(n_tokens, 0) AS query_token_count,
  NOT top1_is_relevant AND coalesce(top_score - gold_score = 0, false) AS tied_with_top1, coalesce(gold_score = 0, false) AS gold_score_is_zero, zeros AS retrieved_with_zero_score, {'rank_before_rerank' if before else 'NULL::INTEGER AS rank_before_rerank'}
  FROM {p}_known LEFT JOIN {p}_over USING (query_id) {earlier})"""


def calibration(out: str, ev: str) -> str:
    at = lambda v, where, f: f"(SELECT coalesce(list({v} ORDER BY {v})[round_even({f}e0 * (count(*) - 1), 0)::INTEGER + 1], 0) FROM {ev} WHERE {where})"
    return f"{out} AS (SELECT count(*) AS n, count(*) >= {diagnose.MIN_QUERIES} AS sufficient, {at('query_gold_overlap', 'true', diagnose.LOW_QUANTILE)} AS low_query_gold_overlap, {at('competitor_gold_overlap', chr(39).join(['symptom = ', 'rank', '']), diagnose.HIGH_QUANTILE)} AS high_competitor_gold_overlap FROM {ev})"


def hypotheses(out: str, ev: str, cal: str) -> str:
    return f"""{out}_flags AS (SELECT query_id, coalesce(rank_before_rerank IS NOT NULL AND (gold_rank IS NULL OR gold_rank > rank_before_rerank), false) AS d, tied_with_top1 AS t, sufficient AS s,
  sufficient AND symptom = 'rank' AND competitor_gold_overlap >= high_competitor_gold_overlap AS h, sufficient AND query_gold_overlap <= low_query_gold_overlap AS l FROM {ev}, {cal} WHERE symptom <> 'ok'),
{out} AS MATERIALIZED (SELECT query_id, 'rerank_regression' AS kind, 1e0 AS confidence, 'rule' AS producer, 0 AS place FROM {out}_flags WHERE d
  UNION ALL SELECT query_id, 'score_tie', 0.9e0, 'rule', 1 FROM {out}_flags WHERE t UNION ALL SELECT query_id, 'hard_negative', 0.5e0, 'rule', 2 FROM {out}_flags WHERE h
  UNION ALL SELECT query_id, 'lexical_mismatch', 0.4e0, 'rule', 3 FROM {out}_flags WHERE l UNION ALL SELECT query_id, 'unexplained', 0e0, 'rule', 4 FROM {out}_flags WHERE NOT s OR NOT (d OR t OR h OR l))"""


def deltas(out: str, left: str, right: str, left_ev: str, right_ev: str) -> str:
    w = lambda c: f"coalesce({c}, 1073741824)"
    return f"""{out} AS MATERIALIZED (SELECT *, direction <> 'unchanged' AND (coalesce(lt, false) OR coalesce(rt, false)) AS arbitrary FROM (
  SELECT query_id, l.gold_rank AS left_rank, r.gold_rank AS right_rank, CASE WHEN {w('r.gold_rank')} < {w('l.gold_rank')} THEN 'improved' WHEN {w('r.gold_rank')} > {w('l.gold_rank')} THEN 'regressed' ELSE 'unchanged' END AS direction, a.tied_with_top1 AS lt, b.tied_with_top1 AS rt
  FROM {left} l JOIN {right} r USING (query_id) LEFT JOIN {left_ev} a USING (query_id) LEFT JOIN {right_ev} b USING (query_id)))"""


def rerank(out: str, candidates: str, penalty: float) -> str:
    q, d = words("q.text"), words("c.text")
    return f"""{out}_s AS (SELECT query_id, doc_id, {q} AS q, {d} AS d FROM {candidates} r JOIN queries q USING (query_id) JOIN corpus c USING (doc_id)),
{out} AS MATERIALIZED (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM (
  SELECT query_id, doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, d))::DOUBLE / len(q) - {penalty}e0 * ln(1 + len(d)) END, 9) AS score FROM {out}_s) QUALIFY rank <= 10)"""


def cut(out: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{out} AS MATERIALIZED (SELECT doc_id || '#' || (i - 1) AS chunk_id, doc_id, array_to_string(list_slice(w, pos[i] + 1, pos[i] + {size}), ' ') AS text FROM (
  SELECT doc_id, w, pos, unnest(generate_series(1, len(pos))) AS i FROM (SELECT doc_id, w, generate_series(0, greatest(1, len(w) - {overlap}) - 1, {step}) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{SPLIT}') AS w FROM corpus) WHERE len(w) > 0)))"""


def _with(*steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n"


RIGHT = {"k1": 0.9, "b": 0.2, "stop": False}
LEFT_STEPS = (KNOWN, bm25("lrun"), best("lrun_best", "lrun"))
BOTH_STEPS = (*LEFT_STEPS, bm25("rrun", **RIGHT), best("rrun_best", "rrun"))
DIAGNOSED = (*LEFT_STEPS, evidence("lev", "lrun"), calibration("lcal", "lev"), hypotheses("lhyp", "lev", "lcal"))
COMPARED = (*BOTH_STEPS, evidence("lev", "lrun"), evidence("rev", "rrun"), deltas("delta", "lrun_best", "rrun_best", "lev", "rev"))
RERANKED = (*LEFT_STEPS, bm25("cand", k=50), best("cand_best", "cand"), rerank("xrun", "cand", 0.0), best("xrun_best", "xrun"))
MEASURED = (*BOTH_STEPS, measures("lm", "lrun", MEASURES), measures("rm", "rrun", MEASURES))
RE_EVIDENCE = (*RERANKED, evidence("xev", "xrun", "cand_best"))
VIEW = "view_ AS (SELECT d.*, l.symptom AS left_symptom, r.symptom AS right_symptom FROM delta d JOIN lev l USING (query_id) JOIN rev r USING (query_id))"
DRAW = f"drawn AS (SELECT query_id FROM lev WHERE symptom <> 'ok' ORDER BY md5('{labelling.SEED}:' || query_id), query_id LIMIT {DRAWN})"
LABELS = "given AS (SELECT query_id, symptom, CASE WHEN query_id LIKE '%b' THEN 'lexical_mismatch' ELSE 'hard_negative' END AS cause FROM lev WHERE symptom <> 'ok')"
AGREED = "agreed AS (SELECT query_id, cause, coalesce(p, []) AS p, list_contains(coalesce(p, []), cause) AS hit FROM given LEFT JOIN (SELECT query_id, list(DISTINCT kind) AS p FROM lhyp GROUP BY query_id) USING (query_id))"
R6 = lambda c: f"round({c}, 6) AS {c}"
EVIDENCE_COLUMNS = f"query_id, symptom, gold_rank, best_relevant, top1, top1_is_relevant, {R6('score_margin')}, {R6('query_gold_overlap')}, {R6('competitor_gold_overlap')}, query_token_count, tied_with_top1, gold_score_is_zero, retrieved_with_zero_score, rank_before_rerank"


def hashed(resamples: int = 200) -> str:
    seed, tail = significance.SEED, (1 - significance.CONFIDENCE) / 2
    draw = lambda kind: f"('0x' || substr(md5('{seed}:{kind}:' || b || ':' || i), 1, 8))::BIGINT"
    return (
        _with(*BOTH_STEPS, measures("lm", "lrun", ("nDCG@10", "RR")), measures("rm", "rrun", ("nDCG@10", "RR")))
        + f""", vals AS (SELECT measure, list(round(r.value - l.value, 9) ORDER BY query_id) AS d FROM lm l JOIN rm r USING (query_id, measure) GROUP BY measure),
draws AS (SELECT measure, len(d) AS n, round(list_sum(d) / len(d), 9) AS delta, round(list_sum(list_transform(generate_series(0, len(d) - 1), lambda i: d[({draw('b')}) % len(d) + 1])) / len(d), 9) AS boot,
  round(list_sum(list_transform(generate_series(0, len(d) - 1), lambda i: CASE WHEN ({draw('s')}) % 2 = 0 THEN d[i + 1] ELSE -d[i + 1] END)) / len(d), 9) AS flip FROM vals, (SELECT unnest(generate_series(1, {resamples})) AS b)),
found AS (SELECT measure, n::BIGINT AS n, delta, quantile_cont(boot, {tail}::DOUBLE) AS lo, quantile_cont(boot, {1 - tail}::DOUBLE) AS hi, (count(*) FILTER (abs(flip) >= abs(delta)) + 1) / {resamples + 1}e0 AS p FROM draws GROUP BY ALL)
SELECT measure, n, delta, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(p, 9) AS p_value, lo > 0 OR hi < 0 AS interval_excludes_zero, n < {significance.ENOUGH} AS underpowered,
  p < {significance.ALPHA}e0 AND (lo > 0 OR hi < 0) AND NOT n < {significance.ENOUGH} AS is_real FROM found"""
    )


ORACLE_SQL: dict[str, str] = {
    "tokenize_terms": _with(CORPUS) + f"SELECT doc_id, len({words('text')})::INTEGER AS n_terms, md5(array_to_string(list_sort({words('text')}), ' ')) AS terms_md5 FROM corpus",
    "bm25_tokens_stopped": _with(CORPUS) + f"SELECT doc_id, len(t)::INTEGER AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {terms('text', True)} AS t FROM corpus)",
    "word_split": _with(CORPUS) + f"SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{SPLIT}') AS w FROM corpus)",
    "term_frequency": _with(CORPUS) + f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms('text', True)}) AS term FROM corpus) GROUP BY ALL",
    "doc_frequency_idf": _with(CORPUS) + f"SELECT term, count(*) AS df, round(ln((1 + n) / (1 + count(*))) + 1, 9) AS idf FROM (SELECT unnest({words('text')}) AS term FROM corpus), (SELECT count(*)::DOUBLE AS n FROM corpus) GROUP BY term, n",
    "doc_length_stats": _with(CORPUS) + f"SELECT count(*)::DOUBLE AS n, round(avg(len({terms('text', True)})), 6) AS avgdl FROM corpus",
    "char_ngrams_df": _with(CORPUS) + "SELECT gram, sum(tf)::BIGINT AS occurrences, count(*) AS df FROM (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) AS gram FROM (SELECT doc_id, lower(text) AS t FROM corpus) WHERE length(t) >= 3) GROUP BY ALL) GROUP BY gram",
    **{f"bm25_{n}_topk": _with(KNOWN, bm25("run", m)) + "SELECT * FROM run" for n, m in (("lucene", "lucene"), ("robertson", "robertson"), ("atire", "atire"), ("plus", "bm25+"), ("l", "bm25l"))},
    "tfidf_char_topk": _with(KNOWN, tfidf(3, 5, True, True)),
    "tfidf_raw_tf_topk": _with(KNOWN, tfidf(3, 3, False, False)),
    "dense_cosine_topk": _with(dense("list_cosine_similarity")) + f"SELECT query_id, doc_id, rank, {R6('score')} FROM run",
    "dense_dot_topk": _with(dense("list_dot_product")) + f"SELECT query_id, doc_id, rank, {R6('score')} FROM run",
    "passage_bm25_topk": _with(PASSAGE, bm25("run")) + "SELECT * FROM run",
    "chunk_fixed_words": _with(CORPUS, cut("chunks", 120, 30)) + "SELECT chunk_id, doc_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM chunks",
    "chunk_whole": _with(CORPUS) + "SELECT doc_id AS chunk_id, doc_id, length(text)::INTEGER AS n_chars FROM corpus",
    "chunks_per_document": _with(CORPUS, cut("chunks", 180, 40)) + "SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id",
    "chunk_mean": _with(CORPUS, cut("chunks", 180, 40)) + "SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_chunks, round(avg(n), 6) AS mean_chunks FROM (SELECT count(*) AS n FROM chunks GROUP BY doc_id)",
    "bm25_chunked_folded": _with(KNOWN, cut("chunks", 120, 30), bm25("crun", k=50, units="chunks", unit="chunk_id")) + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM (SELECT query_id, doc_id, max(score) AS score FROM crun JOIN chunks USING (chunk_id) GROUP BY ALL) QUALIFY rank <= 10",
    "rerank_coverage": _with(KNOWN, bm25("cand", k=50), rerank("xrun", "cand", 0.0)) + "SELECT * FROM xrun",
    "rerank_coverage_penalty": _with(KNOWN, bm25("cand", k=50), rerank("xrun", "cand", 0.05)) + "SELECT * FROM xrun",
    "rerank_movement": _with(*RERANKED) + "SELECT query_id, b.gold_rank AS before_rank, a.gold_rank AS after_rank FROM cand_best b JOIN xrun_best a USING (query_id)",
    "judged_queries": _with(PASSAGE) + "SELECT DISTINCT query_id FROM qrels",
    "best_relevant": _with(*LEFT_STEPS) + "SELECT * FROM lrun_best",
    "reference_gold": _with(PASSAGE) + "SELECT query_id, max(doc_id) AS reference_gold FROM qrels GROUP BY query_id",
    "rank_scores": _with(KNOWN, bm25("lrun")) + "SELECT query_id, doc_id, (count(*) OVER (PARTITION BY query_id) - rank + 1)::DOUBLE AS rank_score FROM lrun",
    "metrics_long": _with(*LEFT_STEPS, measures("lm", "lrun", MEASURES)) + f"SELECT query_id, measure, {R6('value')} FROM lm",
    # A query of the known-item task has one relevant document, of grade 2, and no other label.
    "metrics_more": _with(*LEFT_STEPS, "sized AS (SELECT query_id, count(*) AS n FROM lrun GROUP BY query_id)") + f"""SELECT query_id, measure, {R6('value')} FROM (
        SELECT query_id, unnest(['ERR', 'RBP', 'Judged@10', 'Bpref', 'Rprec', 'SetP', 'SetR', 'SetF']) AS measure,
            unnest([coalesce(3.0 / 16 / gold_rank, 0), coalesce(0.2 * pow(0.8, gold_rank - 1), 0), CASE WHEN gold_rank <= 10 THEN 0.1 ELSE 0 END, CASE WHEN gold_rank IS NULL THEN 0 ELSE 1 END,
                CASE WHEN gold_rank = 1 THEN 1 ELSE 0 END, CASE WHEN gold_rank IS NULL THEN 0 ELSE 1.0 / n END, CASE WHEN gold_rank IS NULL THEN 0 ELSE 1 END, CASE WHEN gold_rank IS NULL THEN 0 ELSE 2.0 / (n + 1) END]::DOUBLE[]) AS value
        FROM lrun_best JOIN sized USING (query_id))""",
    "metrics_aggregate": _with(*LEFT_STEPS, measures("lm", "lrun", MEASURES)) + "SELECT measure, round(avg(value), 6) AS value FROM lm GROUP BY measure",
    "metrics_passage": _with(PASSAGE, bm25("run"), best("run_best", "run"), measures("m", "run", MEASURES)) + f"SELECT query_id, measure, {R6('value')} FROM m",
    "metrics_dense": _with(dense("list_cosine_similarity"), best("run_best", "run"), measures("m", "run", MEASURES)) + f"SELECT query_id, measure, {R6('value')} FROM m",
    "evidence": _with(*DIAGNOSED) + f"SELECT {EVIDENCE_COLUMNS} FROM lev",
    "evidence_reranked": _with(*RE_EVIDENCE) + f"SELECT {EVIDENCE_COLUMNS} FROM xev",
    "weighted_overlap": _with(*DIAGNOSED) + f"SELECT query_id, {R6('query_gold_overlap')}, {R6('competitor_gold_overlap')} FROM lev",
    "calibration": _with(*DIAGNOSED) + f"SELECT n, sufficient, {R6('low_query_gold_overlap')}, {R6('high_competitor_gold_overlap')} FROM lcal",
    "hypotheses": _with(*DIAGNOSED) + "SELECT * FROM lhyp",
    "hypotheses_reranked": _with(*RE_EVIDENCE, calibration("xcal", "xev"), hypotheses("xhyp", "xev", "xcal")) + "SELECT * FROM xhyp",
    "failure_sets": _with(*DIAGNOSED) + "SELECT kind, count(*)::INTEGER AS n, string_agg(query_id, ',' ORDER BY query_id) AS queries FROM lhyp GROUP BY kind",
    "symptom_counts": _with(*DIAGNOSED) + "SELECT symptom, count(*) AS n FROM lev GROUP BY symptom",
    "cause_counts": _with(*DIAGNOSED) + "SELECT kind, count(*) AS n FROM lhyp GROUP BY kind",
    "diff_deltas": _with(*COMPARED) + "SELECT query_id, left_rank, right_rank, direction, arbitrary FROM delta",
    "diff_counts": _with(*COMPARED) + "SELECT count(*) FILTER (direction = 'improved') AS improved, count(*) FILTER (direction = 'regressed') AS regressed, count(*) FILTER (direction = 'unchanged') AS unchanged, count(*) FILTER (arbitrary) AS arbitrary FROM delta",
    "diff_became": _with(*COMPARED) + "SELECT query_id, left_rank IS NOT DISTINCT FROM 1 AND right_rank IS DISTINCT FROM 1 AS became_failure, left_rank IS DISTINCT FROM 1 AND right_rank IS NOT DISTINCT FROM 1 AS became_success FROM delta",
    "fails_both": _with(*COMPARED) + "SELECT l.query_id FROM lev l JOIN rev r USING (query_id) WHERE l.symptom <> 'ok' AND r.symptom <> 'ok'",
    "movement_order": _with(*COMPARED) + "SELECT query_id, coalesce(right_rank, 1073741824) - coalesce(left_rank, 1073741824) AS moved FROM delta",
    "viewer_rows": _with(*COMPARED, VIEW) + "SELECT query_id, left_rank, right_rank, direction, arbitrary, left_symptom, right_symptom FROM view_",
    "viewer_fails_both": _with(*COMPARED, VIEW) + "SELECT query_id, direction, left_symptom, right_symptom FROM view_ WHERE left_symptom <> 'ok' AND right_symptom <> 'ok'",
    "viewer_opener": _with(*COMPARED, VIEW) + "SELECT query_id, direction, right_symptom FROM view_ WHERE direction <> 'unchanged' ORDER BY CASE WHEN direction = 'regressed' AND right_symptom <> 'ok' THEN 0 ELSE 1 END, coalesce(right_rank, 1073741824) - coalesce(left_rank, 1073741824), query_id LIMIT 1",
    "rerank_explains": _with(*RE_EVIDENCE) + "SELECT query_id, l.gold_rank AS left_rank, x.gold_rank AS right_rank, e.rank_before_rerank AS right_before, e.rank_before_rerank IS NOT NULL AND e.rank_before_rerank IS NOT DISTINCT FROM l.gold_rank AND e.gold_rank IS NOT DISTINCT FROM x.gold_rank AS explained FROM lrun_best l JOIN xrun_best x USING (query_id) JOIN xev e USING (query_id)",
    "set_sizes": _with(*COMPARED, calibration("lcal", "lev"), hypotheses("lhyp", "lev", "lcal"), calibration("rcal", "rev"), hypotheses("rhyp", "rev", "rcal")) + "SELECT kind, coalesce(a, 0) AS left_n, coalesce(b, 0) AS right_n FROM (SELECT kind, count(DISTINCT query_id) AS a FROM lhyp GROUP BY kind) FULL JOIN (SELECT kind, count(DISTINCT query_id) AS b FROM rhyp GROUP BY kind) USING (kind)",
    "paired_delta": _with(*MEASURED) + "SELECT measure, count(*) AS n, round(avg(l.value), 6) AS left_mean, round(avg(r.value), 6) AS right_mean, round(avg(r.value - l.value), 6) AS delta FROM lm l JOIN rm r USING (query_id, measure) GROUP BY measure",
    "paired_coverage_check": _with(*MEASURED) + "SELECT count(*) FILTER (l.value IS NOT NULL AND r.value IS NOT NULL) AS n_shared, count(*) FILTER (r.value IS NULL) AS n_left_only, count(*) FILTER (l.value IS NULL) AS n_right_only FROM lm l FULL JOIN rm r USING (query_id, measure)",
    "significance_hashed": hashed(),
    "label_sample_hashed": _with(*DIAGNOSED, DRAW) + "SELECT query_id FROM drawn",
    "label_cases": _with(*DIAGNOSED, DRAW)
    + f""", known AS (SELECT e.*, coalesce(best_relevant, reference) AS gold_id FROM drawn JOIN lev e USING (query_id) JOIN lev_ref USING (query_id)),
hits AS (SELECT query_id, string_agg(concat_ws(':', rank, doc_id, hit), ',' ORDER BY rank) AS retrieved FROM lrun_best_rows SEMI JOIN drawn USING (query_id) WHERE rank <= {labelling.TOP} GROUP BY query_id)
SELECT query_id, q.text AS query, symptom, gold_rank, gold_id, md5(substr(c.text, 1, {labelling.SNIPPET})) AS gold_md5, retrieved, {R6('query_gold_overlap')} FROM known JOIN queries q USING (query_id) JOIN corpus c ON c.doc_id = gold_id JOIN hits USING (query_id)""",
    "label_agreement": _with(*DIAGNOSED, LABELS, AGREED) + "SELECT (SELECT count(*) FROM given) AS labelled, count(*) AS compared, count(*) FILTER (hit) AS agreed, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (hit) / count(*)::DOUBLE END, 6) AS accuracy FROM agreed",
    "label_agreement_by_cause": _with(*DIAGNOSED, LABELS, AGREED) + "SELECT kind AS cause, coalesce(said, 0) AS said, coalesce(confirmed, 0) AS confirmed, coalesce(missed, 0) AS missed, round(confirmed / said::DOUBLE, 6) AS precision FROM (SELECT kind, count(*) AS said, count(*) FILTER (kind = cause) AS confirmed FROM (SELECT cause, unnest(p) AS kind FROM agreed) GROUP BY kind) FULL JOIN (SELECT cause AS kind, count(*) AS missed FROM agreed WHERE NOT hit GROUP BY cause) USING (kind)",
    "label_unlabelled": _with(*DIAGNOSED, DRAW, LABELS) + "SELECT query_id FROM drawn ANTI JOIN (FROM given WHERE symptom <> 'miss') USING (query_id)",
    "referential_violations": "SELECT doc_id::VARCHAR AS doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "duplicate_ids": "SELECT conv_id::VARCHAR AS query_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "flagship_known_item": _with(*LEFT_STEPS) + "SELECT query_id, gold_rank, CASE WHEN gold_rank IS NULL THEN 'miss' WHEN gold_rank = 1 THEN 'ok' ELSE 'rank' END AS symptom, coalesce(round(1e0 / gold_rank, 6), 0) AS rr FROM lrun_best",
}

_SELECT = "SELECT measure, n, delta, round(lo, 9)"
_HASHED = ORACLE_SQL["significance_hashed"]
_VERDICTS = _HASHED.replace(_SELECT, f", verdicts AS ({_SELECT}") + ")\n"
ORACLE_SQL |= {
    "real_differences": _VERDICTS + "SELECT measure, delta FROM verdicts WHERE is_real",
    "verdict_counts": _VERDICTS + "SELECT count(*) FILTER (is_real) AS n_real, count(*) FILTER (NOT is_real) AS n_not_real, count(*) FILTER (delta > 0) AS n_up, count(*) FILTER (delta < 0) AS n_down FROM verdicts",
    "demo_opener": _with(*COMPARED) + "SELECT query_id, direction, left_rank IS DISTINCT FROM 1 AND right_rank IS NOT DISTINCT FROM 1 AS became_success FROM delta WHERE direction <> 'unchanged' ORDER BY CASE WHEN direction = 'improved' AND left_rank IS DISTINCT FROM 1 AND right_rank IS NOT DISTINCT FROM 1 THEN 0 WHEN direction = 'improved' THEN 1 ELSE 2 END, query_id LIMIT 1",
    "dataset_summary": _with(KNOWN) + "SELECT (SELECT count(*) FROM corpus) AS n_docs, count(DISTINCT query_id) AS n_judged FROM qrels",
    "run_health": _with(*DIAGNOSED, measures("lm", "lrun", MEASURES)) + "SELECT measure, round(avg(value), 6) AS value, (SELECT count(*) FROM lev WHERE symptom <> 'ok') AS n_failing, (SELECT count(*) FROM lev) AS n_judged FROM lm GROUP BY measure",
}

#: One document's or query's part of what other queries return.
ORACLE_SQL |= {
    "chunks_of_document": f"SELECT * FROM ({ORACLE_SQL['chunk_fixed_words']}) WHERE doc_id = '50'",
    "hits_of_query": f"SELECT * FROM ({ORACLE_SQL['bm25_lucene_topk']}) WHERE query_id = 'q-50-a'",
    "causes_of_query": f"SELECT * FROM ({ORACLE_SQL['hypotheses']}) WHERE query_id = 'q-0-a'",
}
