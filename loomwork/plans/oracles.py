"""The SQL of every query in the catalogue, for an engine that shares no code with it."""

from __future__ import annotations

from loomwork.operators.sketch import Bloom
from loomwork.plans.catalogue import COMMON, PROBE_WORDS, RATE, SEED, SHARDS

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format
_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents"

_WORDS = f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS('text')}) AS token FROM documents),
wc AS (SELECT token, count(*) AS n FROM t GROUP BY token)
"""

_CORPORA = f"""
WITH l AS MATERIALIZED (SELECT lang, {_TOKENS('line')} AS t FROM ({_LINES})),
w AS (SELECT lang, unnest(t) AS token FROM l),
p AS (SELECT lang, unnest(list_transform(range(1, len(t)), lambda i: struct_pack(x := t[i], y := t[i + 1]))) AS g FROM l WHERE len(t) >= 2),
fw AS MATERIALIZED (SELECT token, count(*) AS n FROM w WHERE lang = 'en' GROUP BY token),
bw AS MATERIALIZED (SELECT token, count(*) AS n FROM w WHERE lang IS DISTINCT FROM 'en' GROUP BY token),
fp AS MATERIALIZED (SELECT g.x AS x, g.y AS y, count(*) AS n FROM p WHERE lang = 'en' GROUP BY ALL),
bp AS MATERIALIZED (SELECT g.x AS x, g.y AS y, count(*) AS n FROM p WHERE lang IS DISTINCT FROM 'en' GROUP BY ALL)
"""


def _odds(n2: str) -> str:
    return f"ln(((f.n + 1::DOUBLE / n1) / (n1 + 1::DOUBLE)) / ((b.n + 1::DOUBLE / {n2}) / ({n2} + 1::DOUBLE)))"


_WORD_ODDS = """SELECT token, f.n AS f, b.n AS b, round({}, 6) AS score
FROM fw f JOIN bw b USING (token), (SELECT count(*)::DOUBLE AS n1 FROM fw), (SELECT count(*)::DOUBLE AS n2 FROM bw)"""
_PAIR_ODDS = f"""SELECT f.x, f.y, f.n AS f, b.n AS b, {_odds('n2')} AS score
FROM fp f JOIN bp b USING (x, y), (SELECT count(*)::DOUBLE AS n1 FROM fp), (SELECT count(*)::DOUBLE AS n2 FROM bp)"""
_PHRASES = f"""
, odds AS ({_PAIR_ODDS}),
ph AS (
  SELECT o.x, o.y, o.score, o.f AS phrase_count, a.n AS x_count, b.n AS y_count,
    ln(((o.f + 1::DOUBLE / vp) / (np + 1::DOUBLE)) / (((a.n + 1::DOUBLE / vw) / (nw + 1::DOUBLE)) * ((b.n + 1::DOUBLE / vw) / (nw + 1::DOUBLE)))) AS phraseness
  FROM odds o JOIN fw a ON a.token = o.x JOIN fw b ON b.token = o.y,
    (SELECT count(*)::DOUBLE AS vw, sum(n)::DOUBLE AS nw FROM fw), (SELECT count(*)::DOUBLE AS vp, sum(n)::DOUBLE AS np FROM fp)
)
"""

_FIVE = f"""
WITH l AS (SELECT {_TOKENS('line')} AS t FROM ({_LINES})),
g AS (SELECT unnest(list_transform(range(1, len(t) - 3), lambda i: struct_pack(a := t[i], b := t[i + 1], c := t[i + 2], d := t[i + 3], e := t[i + 4]))) AS g FROM l WHERE len(t) >= 5),
n5 AS (SELECT g.a AS a, g.b AS b, g.c AS c, g.d AS d, g.e AS e, count(*) AS n FROM g GROUP BY ALL)
"""


def _answer(binding: str, where: str, top: int) -> str:
    return f"""{_FIVE}, m AS (SELECT {binding} AS binding, sum(n)::BIGINT AS n FROM n5 WHERE {where} GROUP BY ALL)
SELECT binding, n, round(n::DOUBLE / (SELECT sum(n) FROM m), 6) AS probability FROM m ORDER BY n DESC, binding LIMIT {top}"""


_SINK_EDGES = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
_BOTH_EDGES = "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"


def _pagerank(edges: str, steps: int, mode: str) -> str:
    """CTEs p0 to p<steps>."""
    out = f"""
WITH e AS MATERIALIZED ({edges}), deg AS (SELECT src, count(*) AS d FROM e GROUP BY src),
w AS MATERIALIZED (SELECT e.src, e.dst, d FROM e JOIN deg USING (src)),
p0 AS MATERIALIZED (SELECT src AS node, 1::DOUBLE AS score FROM deg)"""
    for i in range(steps):
        hops = f"SELECT w.dst AS node, 0.85::DOUBLE * p{i}.score / w.d AS score FROM w JOIN p{i} ON p{i}.node = w.src"
        if mode == "inlinks":
            step = f"SELECT node, sum(score) + 0.15::DOUBLE AS score FROM ({hops}) GROUP BY node"
        else:
            resets = "SELECT src, 0.15::DOUBLE FROM deg" if mode == "sources" else f"SELECT node, 0.15::DOUBLE FROM p{i}"
            step = f"SELECT node, sum(score) AS score FROM ({hops} UNION ALL {resets}) GROUP BY node"
        out += f",\np{i + 1} AS MATERIALIZED ({step})"
    return out


_MATRIX = "SELECT l_suppkey AS r, l_partkey AS c, l_quantity AS w FROM lineitem"
_PRODUCT = f"SELECT a.r AS row, b.r AS col, sum(a.w * b.w) AS w FROM ({_MATRIX}) a JOIN ({_MATRIX}) b ON a.c = b.c GROUP BY ALL"

_TRAIN = "SELECT DISTINCT o_custkey::VARCHAR AS item FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"
_H60 = "cast('0x' || substr(md5({}), 1, 15) AS BIGINT)".format
_SEEDS = "[" + ", ".join(f"{s}::BIGINT" for s in Bloom(1, RATE, SEED).seeds) + "]"
_HASHES = Bloom(1, RATE, SEED).hashes
_BITS = f"""
WITH train AS ({_TRAIN}),
size AS (SELECT *, cast(round(m / 31::DOUBLE + 1) AS BIGINT) AS words FROM (SELECT cast(floor(2 * greatest(1, count(*)) * ln(1 / {RATE}::DOUBLE) + 0.5) AS BIGINT) AS m FROM train)),
bits AS (SELECT DISTINCT xor(s, {_H60('item')}) % m AS position FROM train, size, (SELECT unnest({_SEEDS}) AS s))
"""
_PROBE = f"""
, probe AS (SELECT c_custkey::VARCHAR AS item FROM customer),
members AS (SELECT item FROM (SELECT item, xor(s, {_H60('item')}) % m AS position FROM probe, size, (SELECT unnest({_SEEDS}) AS s)) q
  LEFT JOIN bits USING (position) GROUP BY item HAVING count(bits.position) = count(*))
"""
_SHARD = f"(cast('0x' || md5(chr(34) || c_name || chr(34)) AS UHUGEINT) % {SHARDS})::BIGINT"

SQL: dict[str, str] = {
    "wc_documents": f"{_WORDS} SELECT token, n FROM wc",
    "wc_top10": f"{_WORDS} SELECT token, n FROM wc ORDER BY n DESC, token LIMIT 10",
    "wc_probe_words": f"{_WORDS} SELECT token, n FROM wc WHERE token IN ({', '.join(repr(w) for w in PROBE_WORDS)})",
    "tokens_map_only": f"{_WORDS} SELECT doc_id, token FROM t",
    "bigram_count": f"""WITH l AS (SELECT {_TOKENS('line')} AS t FROM ({_LINES})),
p AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: struct_pack(x := t[i], y := t[i + 1]))) AS g FROM l WHERE len(t) >= 2)
SELECT g.x AS x, g.y AS y, count(*) AS n FROM p GROUP BY ALL""",
    "vocab_totals": f"""{_CORPORA}
SELECT 'fg' AS corpus, count(*) AS vocabulary, sum(n)::BIGINT AS total FROM fw UNION ALL SELECT 'bg', count(*), sum(n)::BIGINT FROM bw""",
    "logodds_words": _CORPORA + _WORD_ODDS.format(_odds("n2")),
    "logodds_words_fgvocab": _CORPORA + _WORD_ODDS.format(_odds("n1")),
    "logodds_bigrams": f"{_CORPORA} SELECT x, y, f, b, round(score, 6) AS score FROM ({_PAIR_ODDS})",
    "logodds_top_bottom": f"""{_CORPORA}, s AS ({_WORD_ODDS.format(_odds("n2"))}),
r AS (SELECT token, score, row_number() OVER (ORDER BY score DESC, token)::INTEGER AS hi, row_number() OVER (ORDER BY score, token)::INTEGER AS lo FROM s)
SELECT 'top' AS side, hi AS rank, token, score FROM r WHERE hi <= 10 UNION ALL SELECT 'bottom', lo, token, score FROM r WHERE lo <= 10""",
    "phraseness": f"{_CORPORA} {_PHRASES} SELECT x, y, phrase_count, x_count, y_count, round(phraseness, 6) AS phraseness FROM ph",
    "good_phrases": f"{_CORPORA} {_PHRASES} SELECT x, y, round(score, 6) AS score, round(phraseness, 6) AS phraseness FROM ph WHERE phraseness > 2.5",
    "ngram5_build": f"{_FIVE} SELECT a, b, c, d, e, n FROM n5",
    "ngram_marginal_c": _answer("'C=' || c", "true", 10),
    "ngram_const_b": _answer("'B=' || b || ',C=' || c", f"b = '{COMMON['b']}'", 10),
    "ngram_b_given_c": _answer("'B=' || b || ',C=' || c", f"c = '{COMMON['c']}'", 10),
    "ngram_five_slots": _answer("'A=' || a || ',B=' || b || ',C=' || c || ',D=' || d || ',E=' || e", f"b = '{COMMON['b']}'", 20),
    "ngram_match_share": f"""{_FIVE}, s AS (SELECT coalesce(sum(n) FILTER (b = '{COMMON['b']}'), 0)::BIGINT AS matched, coalesce(sum(n), 0)::BIGINT AS total FROM n5)
SELECT matched, total, round(100::DOUBLE * matched / nullif(total, 0), 6) AS percent FROM s""",
    "graph_degrees": f"SELECT src AS node, count(*) AS degree FROM ({_SINK_EDGES}) GROUP BY src",
    "graph_adjacency": f"SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM ({_SINK_EDGES}) GROUP BY src",
    "pagerank_sources": f"{_pagerank(_SINK_EDGES, 10, 'sources')} SELECT node, round(score, 6) AS score FROM p10",
    "pagerank_growing": f"{_pagerank(_SINK_EDGES, 5, 'growing')} SELECT node, round(score, 6) AS score FROM p5",
    "pagerank_inlinks": f"{_pagerank(_BOTH_EDGES, 10, 'inlinks')} SELECT node, round(score, 6) AS score FROM p10",
    "pagerank_progress": _pagerank(_BOTH_EDGES, 10, "sources")
    + " UNION ALL ".join(f" SELECT {i} AS iteration, count(*) AS n, round(max(score), 6) AS high, round(min(score), 6) AS low, round(avg(score), 6) AS mean FROM p{i}" for i in range(10)),
    "pagerank_ends": f"""{_pagerank(_SINK_EDGES, 10, 'sources')}
SELECT 'first' AS place, node, round(score, 6) AS score FROM (SELECT * FROM p10 ORDER BY node LIMIT 3)
UNION ALL SELECT 'last', node, round(score, 6) FROM (SELECT * FROM p10 ORDER BY node DESC LIMIT 3)""",
    "matmul_abt": f"SELECT row, col, round(w, 6) AS w FROM ({_PRODUCT})",
    "gram_embeddings": """WITH a AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS w FROM embeddings)
SELECT a.vec_id AS row, b.vec_id AS col, round(sum(a.w * b.w), 6) AS w FROM a JOIN a b ON a.i = b.i GROUP BY ALL""",
    "matmul_check": f"""WITH p AS MATERIALIZED ({_PRODUCT})
SELECT (SELECT count(*) FROM (SELECT row, col, w FROM p EXCEPT ALL SELECT col, row, w FROM p)) = 0 AS same""",
    "vector_add": """WITH a AS (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS place, unnest(embedding)::DOUBLE AS w FROM embeddings)
SELECT a.vec_id, a.place, round(a.w + b.w, 6) AS c FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.place = a.place""",
    "bloom_params": f"{_BITS} SELECT m AS bits, {_HASHES} AS hashes, words FROM size",
    "bloom_bits": f"{_BITS} SELECT position // 31 AS word, bit_or(1::BIGINT << (position % 31)) AS value FROM bits GROUP BY 1",
    "bloom_density": f"{_BITS} SELECT round(count(*) / (SELECT 31 * words FROM size)::DOUBLE, 6) AS density FROM bits",
    "bloom_members": f"{_BITS} {_PROBE} SELECT item FROM members",
    "bloom_overlap": f"""{_BITS} {_PROBE}
SELECT m AS bits, round(m / 8::DOUBLE / 1024, 6) AS kb, {_HASHES} AS hashes,
  (SELECT round(count(*) / (SELECT 31 * words FROM size)::DOUBLE, 6) FROM bits) AS density, (SELECT count(*) FROM train) AS lines1, (SELECT count(*) FROM probe) AS lines2,
  (SELECT count(*) FROM members) AS overlap, (SELECT round(count(*) * 0.01::DOUBLE)::BIGINT FROM probe) AS expected_false FROM size""",
    "autodiff_p1": """SELECT l_orderkey, l_linenumber, round((2 * l_quantity + l_discount) * (2 * l_quantity + l_discount), 6) AS f,
  round(4 * (2 * l_quantity + l_discount), 6) AS d_x1, round(2 * (2 * l_quantity + l_discount), 6) AS d_x2 FROM lineitem""",
    "autodiff_lnsq": "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice * l_extendedprice), 6) AS f, round(2 / l_extendedprice, 6) AS d_x FROM lineitem",
    "autodiff_grad_sum": """SELECT round(sum((2 * l_quantity + l_discount) * (2 * l_quantity + l_discount)), 2) AS f,
  round(sum(4 * (2 * l_quantity + l_discount)), 2) AS d_x1, round(sum(2 * (2 * l_quantity + l_discount)), 2) AS d_x2 FROM lineitem""",
    "mr_wordcount": f"{_WORDS} SELECT token, n FROM wc",
    "mr_sorted_runs": """SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value)::INTEGER AS place
FROM (SELECT chr(34) || p_brand || chr(34) AS key, chr(34) || p_size || chr(34) AS value FROM part)""",
    "mr_map_only": "SELECT lower(n_name) AS value FROM nation UNION ALL SELECT length(n_name)::VARCHAR FROM nation",
    "shard_assign": f"SELECT c_name, {_SHARD} AS shard FROM customer",
    "shard_stats": f"SELECT {_SHARD} AS shard, count(*) AS lines FROM customer GROUP BY 1",
    "kv_roundtrip": "SELECT chr(34) || s_name || chr(34) || chr(9) || s_suppkey AS line, s_name AS key, s_suppkey AS value FROM supplier",
    "head_tail": """SELECT c_custkey, c_name, 'head' AS place FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10)
UNION ALL SELECT c_custkey, c_name, 'tail' FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 10)""",
    "json_keys": rf"SELECT chr(34) || n_name || chr(34) AS key, len({_TOKENS('n_name')})::INTEGER AS words FROM nation",
    "autodiff_both_ways": "SELECT l_orderkey, l_linenumber, round(4 * (2 * l_quantity + l_discount), 6) AS d_x1, round(8 * l_quantity + 4 * l_discount, 6) AS t_x1 FROM lineitem",
    "text_lines": f"{_WORDS} SELECT token, n FROM wc",
    "text_edges": "SELECT l_suppkey::VARCHAR AS node, count(*) AS degree FROM lineitem GROUP BY 1",
    "text_ngrams": _answer("'B=' || b || ',C=' || c", f"b = '{COMMON['b']}'", 10),
    "json_matrices": "SELECT a.n_nationkey AS row, b.n_nationkey AS col, count(*)::DOUBLE AS w FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1, 2",
    "text_sink": f"""WITH t AS (SELECT unnest({_TOKENS('p_name')}) AS token FROM part)
SELECT '(' || chr(39) || token || chr(39) || ', ' || count(*) || ')' AS line FROM t GROUP BY token""",
    "sharded_text": f"SELECT {_SHARD}::INTEGER AS shard, c_name AS line FROM customer",
    "dataset_combine": "SELECT l_suppkey AS node, count(*) AS edges, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY 1",
    "dataset_join": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ngram_report": f"""SELECT binding, format('{{:,}}', n) AS n, lpad(format('{{:.2f}}', 100 * probability), 7, ' ') || '%' AS share
FROM ({_answer("'B=' || b || ',C=' || c", f"b = '{COMMON['b']}'", 10)})""",
    "dataset_wordcount": f"""WITH t AS (SELECT unnest({_TOKENS('p_name')}) AS token FROM part)
SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) > 1""",
    "dataset_local": "SELECT i AS x, i * i AS y, i::VARCHAR AS t FROM range(5, 10) r(i)",
    "dataset_take": "SELECT r_name AS name, (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM region) AS held FROM region ORDER BY r_name LIMIT 3",
}
