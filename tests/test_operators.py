"""Operators on small inputs, with results worked out by hand or by plain Python."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.functions.strings import bigrams, grams, json_value, md5_mod, stripped, tokens
from loomwork.operators import autodiff, graph, lexicon, linalg, mapreduce, ngram, sketch
from loomwork.operators.dataset import Context
from loomwork.operators.text import most_common, ngram_count, word_count
from loomwork.sources import files, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Text


def test_tokens_are_lower_case_runs_of_word_characters(spark):
    df = spark.createDataFrame([("It's Über_1, naïve—東京 ٣!",), ("",), (None,)], "line string")
    assert [r[0] for r in df.select(tokens(F.col("line"))).collect()] == [["it", "s", "über_1", "naïve", "東京", "٣"], [], None]


def test_neighbours_stay_inside_a_line_and_need_enough_words(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    found = [[tuple(x) for x in r[0]] for r in df.select(bigrams(F.col("t"))).collect()]
    assert found == [[("a", "b"), ("b", "c")], [], []]
    assert [len(r[0]) for r in df.select(grams(F.col("t"), 3, ["x", "y", "z"])).collect()] == [1, 0, 0]


def test_strip_takes_any_white_space(spark):
    df = spark.createDataFrame([("\t a b \r\n",)], "s string")
    assert df.select(stripped(F.col("s")), stripped(F.col("s"), left=False)).first()[:] == ("a b", "\t a b")


def test_word_count_and_ties(spark):
    df = spark.createDataFrame([("b a",), ("a c",), ("b",)], "line string")
    assert rows(word_count(df)) == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in most_common(word_count(df), 2, "token").collect()] == [("a", 2), ("b", 2)]


# Sources and files


def test_edge_lines_need_two_fields(spark, tmp_path):
    (tmp_path / "g").write_text("a b\n\n c\td \nx\nx y z\n")
    assert rows(text.edges(text.lines(spark, str(tmp_path / "g")))) == [("a", "b"), ("c", "d")]


def test_ngram_lines(spark, tmp_path):
    (tmp_path / "n").write_text("a b c d e\t12\na b c d\t1\na b c d e\tx\nno tab\n")
    assert rows(text.weighted_ngrams(text.lines(spark, str(tmp_path / "n")))) == [("a", "b", "c", "d", "e", 12)]


def test_matrices_of_a_json_document_and_their_check(spark, tmp_path):
    document = {"a": [[0, 0, 1], [0, 1, 2], [1, 1, 3]], "b": [[0, 0, 1], [0, 1, 1]], "r": [[0, 0, 3], [1, 0, 3]]}
    (tmp_path / "m.json").write_text(json.dumps(document, indent=1))
    m = text.matrices(spark, str(tmp_path / "m.json"))
    product = linalg.matmul_abt(m["a"], m["b"])
    assert rows(product) == [(0, 0, 3.0), (1, 0, 3.0)]
    assert linalg.same_rows(product, m["r"]).first().same
    assert not linalg.same_rows(product, m["r"].unionByName(m["r"].limit(1))).first().same


def test_cancelled_entries_stay(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "row long, col long, w double")
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0)], "row long, col long, w double")
    assert rows(linalg.matmul_abt(a, b)) == [(0, 0, 0.0)]


def test_line_set_skips_blank_lines(spark):
    df = spark.createDataFrame([(" a ",), ("",), ("  \t",)], "line string")
    assert rows(text.line_set(df)) == [("a",)]


def test_sharded_text(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(50)], "line string")
    store, path = files.ShardedText(spark, 4), str(tmp_path / "s")
    stats = dict(map(tuple, store.put(lines, path).collect()))
    import hashlib

    expected = Counter(int(hashlib.md5(json.dumps(f"line {i}").encode()).hexdigest(), 16) % 4 for i in range(50))
    assert stats == {i: expected[i] for i in range(4)}
    assert sorted(r.line for r in store.merged(path).collect()) == sorted(f"line {i}" for i in range(50))
    assert len(store.head(path, 3)) == min(3, expected[0]) and len(store.tail(path, 3)) == min(3, expected[3])


def test_write_text(spark, tmp_path):
    files.write_text(spark.createDataFrame([(1,), (2,)], "value long"), str(tmp_path / "t"))
    assert rows(spark.read.text(str(tmp_path / "t"))) == [("1",), ("2",)]


# Two corpora


def test_log_odds_by_hand(spark):
    fg, bg = (spark.createDataFrame(x, "token string, n long") for x in ([("a", 3), ("b", 1)], [("a", 1), ("c", 5), ("d", 1)]))
    (row,) = lexicon.log_odds(fg, bg, ["token"]).collect()
    assert row.token == "a" and math.isclose(row.score, math.log(((3 + 1 / 2) / 3) / ((1 + 1 / 3) / 4)))
    (row,) = lexicon.log_odds(fg, bg, ["token"], "foreground").collect()
    assert math.isclose(row.score, math.log(((3 + 1 / 2) / 3) / ((1 + 1 / 2) / 3)))


def test_existing_fields_win(spark):
    df = spark.createDataFrame([("a", 1)], "x string, n long")
    assert lexicon.add_field(df, "n", F.lit(9)).first().n == 1
    table = spark.createDataFrame([("a", 7)], "token string, c long")
    assert lexicon.lookup(df, "x", table, "token", "c", "n").first().n == 1
    assert lexicon.lookup(df, "x", table, "token", "c", "m").first().m == 7


def test_top_bottom_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.0)], "token string, score double")
    found = [(r.side, r["rank"], r.token) for r in lexicon.top_bottom(df, 2, ["token"]).orderBy("side", "rank").collect()]
    assert found == [("bottom", 1, "c"), ("bottom", 2, "a"), ("top", 1, "a"), ("top", 2, "b")]


# Patterns


def test_pattern_query(spark):
    df = spark.createDataFrame([("a", "no", "x", "p", "q", 3), ("b", "no", "y", "p", "q", 1), ("a", "yes", "x", "p", "q", 5), ("c", "no", "x", "r", "s", 4)], "a string, b string, c string, d string, e string, n long")
    got = ngram.distribution(ngram.count_bindings(df, {"b": "no", "c": "_"}), 10).collect()
    assert [(r.binding, r.n, r.probability) for r in got] == [("B=no,C=x", 7, 0.875), ("B=no,C=y", 1, 0.125)]
    assert tuple(ngram.match_share(df, {"b": "no", "c": "_"}).first()) == (8, 13, 100 * 8 / 13)
    assert ngram.distribution(ngram.count_bindings(df, {"b": "never"}), 10).collect() == []
    assert tuple(ngram.match_share(df.limit(0), {"b": "no"}).first()) == (0, 0, None)
    with pytest.raises(ValueError):
        ngram.count_bindings(df, {"z": "_"})


def test_probabilities_sum_to_one(spark):
    df = ngram_count(spark.createDataFrame([("a b a b a b a c",)], "line string"), 2, "ab")
    assert math.isclose(sum(r.probability for r in ngram.distribution(ngram.count_bindings(df, {"a": "_", "b": "_"}), 100).collect()), 1)


# Graphs


def plain_pagerank(edges, steps, mode, reset=0.15):
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    scores = dict.fromkeys(out, 1.0)
    for _ in range(steps):
        new = Counter()
        for s, score in scores.items():
            for d in out.get(s, []):
                new[d] += (1 - reset) * score / len(out[s])
        resets = {"sources": out, "growing": scores, "inlinks": new}[mode]
        for node in list(resets):
            new[node] += reset
        scores = dict(new)
    return scores


@pytest.mark.parametrize("mode", graph.MODES)
def test_pagerank_modes(spark, mode):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("e", "a")]  # d is a sink, e has no incoming edge
    got = dict(map(tuple, graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), 7, mode).collect()))
    expected = plain_pagerank(edges, 7, mode)
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)


def test_pagerank_keeps_the_sum_without_sinks(spark):
    edges = [(i, (i * 7 + k) % 20) for i in range(20) for k in range(3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert math.isclose(graph.pagerank(df, 10).agg(F.sum("score")).first()[0], 20)
    with pytest.raises(ValueError):
        next(graph.pagerank_steps(df, 1, "none"))


# Sketches


def test_bloom_sizes():
    spec = sketch.Bloom(7000, 0.01)
    assert (spec.bits, spec.hashes) == (64472, 7)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    spec = sketch.Bloom(300, 0.01, 3)
    train = spark.createDataFrame([(f"in {i}",) for i in range(300)], "item string")
    probe = spark.createDataFrame([(f"in {i}",) for i in range(300)] + [(f"out {i}",) for i in range(1000)] + [("in 1",)], "item string")
    built = spec.build(train)
    found = [r.item for r in spec.contains(probe, built).collect()]
    assert sum(x.startswith("in") for x in found) == 301 and sum(x.startswith("out") for x in found) < 40
    places = {r.position for r in built.collect()}
    words = {r.word: r.value for r in spec.words_of(built).collect()}
    assert places == {w * 31 + b for w, v in words.items() for b in range(31) if v >> b & 1}
    report = spec.report(train, probe).first()
    assert (report.lines1, report.lines2, report.overlap, report.expected_false) == (300, 1301, len(found), 13)


# Programs


def test_programs_with_known_results(spark):
    p = autodiff.DOUBLE_PLUS_SQUARED
    row = autodiff.backward(autodiff.forward(spark.createDataFrame([(2.0, 3.0)], "x1 double, x2 double"), p), p).first()
    assert (row.z1, row.z2, row.f, row.d_x1, row.d_x2) == (4, 7, 49, 28, 14)
    p = autodiff.LOG_OF_SQUARE
    row = autodiff.backward(autodiff.forward(spark.createDataFrame([(4.0,)], "x double"), p), p).first()
    assert (row.z, row.d_z, row.d_x) == (16, 0.0625, 0.5) and math.isclose(row.f, math.log(16))


def test_gradients_agree_with_finite_differences(spark):
    p = [("a", "mul", ("x", "y")), ("b", "add", ("a", "x")), ("c", "square", ("b",)), ("f", "ln", ("c",))]
    df = spark.createDataFrame([(1.3, 0.7)], "x double, y double")
    value = lambda x, y: math.log((x * y + x) ** 2)
    row = autodiff.backward(autodiff.forward(df, p), p).first()
    assert math.isclose(row.d_x, (value(1.3 + 1e-6, 0.7) - value(1.3 - 1e-6, 0.7)) / 2e-6, rel_tol=1e-6)
    assert math.isclose(row.d_y, (value(1.3, 0.7 + 1e-6) - value(1.3, 0.7 - 1e-6)) / 2e-6, rel_tol=1e-6)


def test_undefined_values_are_null(spark):
    p = autodiff.LOG_OF_SQUARE
    row = autodiff.backward(autodiff.forward(spark.createDataFrame([(0.0,)], "x double"), p), p).first()
    assert row.f is None and row.d_x is None


def test_vector_add(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(linalg.vector_add(F.col("a"), F.col("b"))).first()[0] == [4.0, 6.0]


# Map and reduce


def test_map_reduce_of_letters(spark):
    items = spark.createDataFrame([("ab ba",), ("ab",)], "line string")
    job = mapreduce.Job(lambda s: [(w, c) for w in s.split() for c in w], lambda k, vs: [(k, "".join(vs))])
    assert rows(job.map_reduce(items, "string", "string")) == [("ab", "aabb"), ("ba", "ab")]  # values in order of their bytes


def test_reducers_may_stop_early_and_yield_any_number(spark):
    items = spark.createDataFrame([(i,) for i in range(10)], "x long")
    job = mapreduce.Job(lambda x: [(x % 3, x)], lambda k, vs: [] if k == 1 else [(k, next(vs)), (k, -1)])
    assert rows(job.map_reduce(items, "long", "long")) == [(0, -1), (0, 0), (2, -1), (2, 2)]


def test_combiner_gives_the_same(spark):
    items = spark.createDataFrame([(w,) for w in "a b a c a b".split()], "w string")
    plain = mapreduce.Job(lambda w: [(w, 1)], lambda k, vs: [(k, sum(vs))])
    combined = mapreduce.Job(lambda w: [(w, 1)], lambda k, vs: [(k, sum(vs))], combine=lambda a, b: a + b)
    assert rows(plain.map_reduce(items)) == rows(combined.map_reduce(items)) == [("a", 3), ("b", 2), ("c", 1)]


def test_abstract_jobs_raise():
    with pytest.raises(NotImplementedError):
        mapreduce.Job().map("x")
    with pytest.raises(NotImplementedError):
        mapreduce.Job().reduce("x", iter(()))


def test_keys_keep_their_type_and_lines_round_trip():
    assert mapreduce.encode(1) != mapreduce.encode("1")
    for pair in [("a\tb\n", 1), (1, "x"), (["t", 2], None), ("é", 1.5)]:
        assert mapreduce.pair(mapreduce.line(*pair)) == pair


def test_groups_skip_what_was_left():
    assert [(k, next(v)) for k, v in mapreduce.groups([("a", 1), ("a", 2), ("b", 3)])] == [("a", 1), ("b", 3)]


def test_md5_shards(spark):
    import hashlib

    keys = [f"key {i}" for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for n in (1, 7, 1000003):
        got = [r[0] for r in df.select(md5_mod(json_value(F.col("k")), n)).collect()]
        assert got == [int(hashlib.md5(json.dumps(k).encode()).hexdigest(), 16) % n for k in keys]


def test_lazy_collections(spark, tmp_path):
    (tmp_path / "t").write_text("a b\nb\n")
    ctx = Context(spark)
    calls = ctx.from_list([1, 2, 3]).map(lambda x: x + 1).filter(lambda x: x > 2)
    assert sorted(calls.collect()) == [3, 4] and len(calls.take(1)) == 1 and calls.count() == 2
    counted = ctx.text_file(str(tmp_path / "t")).flat_map(str.split).map(lambda w: (w, 1)).reduce_by_key(lambda a, b: a + b)
    assert sorted(counted.collect()) == [("a", 1), ("b", 2)]
    assert sorted(counted.map(lambda kv: kv[1]).collect()) == [1, 2]
    mixed = ctx.from_list([(1, 1), ("1", 2), ((1, 2), 3)]).reduce_by_key(lambda a, b: a + b).collect()
    assert sorted(mixed, key=repr) == sorted([(1, 1), ("1", 2), ([1, 2], 3)], key=repr)


def test_streaming_counts(spark, tmp_path):
    from loomwork.streaming.wordcount import running_counts, token_stream

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a b a",)], "text string").write.parquet(folder)
    query = running_counts(token_stream(spark, folder, "text string"), "counts_so_far", str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert rows(spark.table("counts_so_far")) == [("a", 2), ("b", 1)]


def test_lazy_collection_by_key_and_as_a_whole(spark):
    c = Context(spark)
    pairs = c.from_list([("a", 1), ("b", 2), ("a", 3), ("é", 4)])
    assert sorted(pairs.combine_by_key(lambda x: [x], lambda s, x: sorted([*s, x]), lambda s, t: sorted(s + t)).collect()) == [("a", [1, 3]), ("b", [2]), ("é", [4])]
    other = c.from_list([("a", "x"), ("a", "y"), ("z", "w")])
    assert sorted(pairs.join(other).collect()) == [("a", (1, "x")), ("a", (1, "y")), ("a", (3, "x")), ("a", (3, "y"))]
    assert sorted(pairs.keys().distinct().collect()) == ["a", "b", "é"] and sorted(pairs.map_values(lambda x: -x).values().collect()) == [-4, -3, -2, -1]
    assert pairs.sort_by(lambda p: p[1], ascending=False).collect()[0] == ("é", 4) and pairs.sort_by(lambda p: p[0]).take(1) == [("a", 1)] or pairs.sort_by(lambda p: p[0]).take(1) == [("a", 3)]
    assert pairs.values().reduce(lambda a, b: a + b) == 10 and pairs.union(pairs).count() == 8
    assert c.from_list([(1, "x"), (2, None)]).to_rows("n int, t string").orderBy("n").collect() == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        c.from_list([]).reduce(lambda a, b: a)


def test_peekable():
    it = mapreduce.Peekable([1, 2, 3], most=2)
    assert it.peek() == 1 and next(it) == 1 and it.has_more()
    with pytest.raises(OverflowError):
        it.push_back(9), it.push_back(8)
    assert list(it) == [9, 2, 3] and not it.has_more()
    with pytest.raises(StopIteration):
        it.peek()


def test_keys_have_one_json_text(spark):
    keys = ["é", "a\tb", "日本 😀", 'q"\\', "plain"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(json_value(F.col("k"))).collect()]
    assert got == [mapreduce.encode(k) for k in keys]


def test_tiles_give_the_same_product(spark):
    rows = [(i, k, float(i * k % 5)) for i in range(12) for k in range(4)] + [(0, 1, 2.0)]
    a = spark.createDataFrame(rows, "row long, col long, w double")
    assert sorted(linalg.matmul_abt(a, a).collect()) == sorted(linalg.matmul_abt(a, a, tiles=3).collect())


def test_steps_of_pagerank_do_not_shuffle_edges(spark):
    """Between the held weights and the join stands no exchange."""
    edges = spark.createDataFrame([(i % 7, i % 5) for i in range(60)], "src long, dst long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = list(graph.pagerank_steps(edges, 2, "inlinks"))
        plan = steps[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[: plan.index("InMemoryTableScan [src")].splitlines()[-2:]
    assert "SortMergeJoin" in plan and not any("Exchange" in x for x in above), plan


def test_bindings_are_counted_by_one_shuffle(spark, sf_dir):
    from loomwork.plans.catalogue import QUERIES

    df = QUERIES["ngram_marginal_c"](spark, sf_dir)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the distribution and its total read one
    assert QUERIES["phraseness"](spark, sf_dir).inputFiles()


def test_copy_benchmark(spark):
    assert {r.what for r in linalg.copy_benchmark(spark, 1000, 1).collect()} == {"add", "copy"}


def test_malformed_lines_are_an_error_if_asked(spark):
    lines = spark.createDataFrame([("a b c d e\t3",), ("a b\t1",), ("no count",)], "line string")
    assert text.weighted_ngrams(lines).count() == 1
    with pytest.raises(Exception, match="malformed line"):
        text.weighted_ngrams(lines, strict=True).collect()
    assert text.weighted_ngrams(lines.limit(1), strict=True).count() == 1
    with pytest.raises(Exception, match="malformed line"):
        text.edges(lines, strict=True).collect()


def test_held_collection(spark):
    held = Context(spark).from_list([3, 1, 2]).cache()
    assert sorted(held.collect()) == [1, 2, 3] and held.count() == 3


def test_products_are_summed_in_tiles_and_not_dealt(spark):
    """Products never stand as rows: one deal of sums' blocks, and the same results as the join of columns."""
    import random

    draw = random.Random(3)
    entries = [(draw.choice([-700, -3, 0, 5, 511, 512, 900]) + draw.randrange(40), draw.randrange(9), draw.choice([None, 1.5, -2.0, 0.0])) for _ in range(900)]
    entries += [(None, 1, 2.0), (7, None, 3.0), (600, 77, None), (601, 77, 4.0), (601, 77, 4.0)]
    a, b = spark.createDataFrame(entries, "row int, col long, w double"), spark.createDataFrame(entries[::2], "row long, col long, w double")
    made = linalg.matmul_abt(a, b)
    assert rows(made) == rows(linalg._joined(a, b, 1)) and made.dtypes[0] == ("row", "int")
    assert "HashAggregate(keys=[row" not in made._jdf.queryExecution().executedPlan().toString()
    full = spark.createDataFrame([(i, k, float(i - k)) for i in range(600) for k in range(6)], "row long, col long, w double")
    assert rows(linalg.matmul_abt(full, full)) == rows(linalg._joined(full, full, 1))
    far = spark.createDataFrame([(i << 20, i % 3, float(i)) for i in range(60)], "row long, col long, w double")
    assert not linalg._close(far) and len(rows(linalg.matmul_abt(far, far))) == 1200


def test_a_transpose_is_compared_by_one_deal_of_the_table(spark):
    def said(items):
        m = spark.createDataFrame(items, "row long, col long, w double")
        assert m.sparkSession is spark
        assert linalg.symmetric(m).first().same == linalg.same_rows(m, m.select(F.col("col").alias("row"), F.col("row").alias("col"), "w")).first().same
        return linalg.symmetric(m).first().same

    assert said([(1, 2, 3.0), (2, 1, 3.0), (4, 4, 1.0), (None, 1, 2.0), (1, None, 2.0), (None, None, 5.0)]) and said([])
    assert not said([(1, 2, 3.0), (2, 1, 4.0)]) and not said([(1, 2, 3.0)]) and not said([(None, 2, 3.0)])
    assert not said([(1, 2, 3.0), (1, 2, 3.0), (2, 1, 3.0)]) and not said([(1, 2, None), (2, 1, 0.0)])


def test_phrase_counts_are_worked_out_once(spark, sf_dir):
    """Both corpora are counted before the result is read: its plan has no document and no list of tokens."""
    from loomwork.plans.catalogue import QUERIES

    df = QUERIES["good_phrases"](spark, sf_dir)
    assert not any("documents" in f for f in df.inputFiles())
    counts = spark.createDataFrame([("a", 2, 1), ("b", 0, 3), ("c", 4, 0)], "token string, f long, b long")
    kept, sizes = lexicon.held(counts, "t")
    assert rows(kept) == [("a", 2, 1)] and sizes.first().asDict() == {"n1": 2, "n2": 2, "total": 6}
    assert rows(lexicon.counted_odds(kept, ["token"], sizes=sizes)) == rows(lexicon.counted_odds(counts, ["token"]))


def test_runs_of_words_are_dealt_as_one_text(spark):
    df = ngram_count(spark.createDataFrame([("a b a b",), ("B a",)], "line string"), 2, "xy")
    assert rows(df) == [("a", "b", 2), ("b", "a", 2)] and df.columns == ["x", "y", "n"]
    assert "hashpartitioning(_run" in df._jdf.queryExecution().executedPlan().toString()


def test_counted_runs_are_written_compressed(spark, sf_dir):
    from loomwork.plans.catalogue import QUERIES

    files_read = QUERIES["text_ngrams"](spark, sf_dir).inputFiles()
    assert files_read and all(f.endswith(".gz") for f in files_read)


def test_equal_texts_are_encoded_once_by_a_combiner(spark, monkeypatch):
    import pyarrow as pa

    asked = []
    plain = mapreduce.encode
    monkeypatch.setattr(mapreduce, "encode", lambda x: asked.append(x) or plain(x))
    job = mapreduce.Job(lambda w: [(w, 1), (1, 1), (True, 1), ("1", 1)], combine=lambda a, b: a + b)

    class Items:
        def mapInArrow(self, run, _):
            return [tuple(x) for b in run([pa.RecordBatch.from_pydict({"w": ["é\\"] * 50})]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    assert sorted(job._mapped(Items())) == sorted([('"\\u00e9\\\\"', "50"), ("1", "50"), ("true", "50"), ('"1"', "50")])
    assert asked.count("é\\") == 1
    for x in ("", "7", "é\\", 'q"', "²", 5, -3, 10**30, 1.5, True, None, [1, "a"], {"k": [2]}):
        assert plain(x) == json.dumps(x) and mapreduce.decode(plain(x)) == x and type(mapreduce.decode(plain(x))) is type(x)


@pytest.mark.parametrize("mode", graph.MODES)
def test_edges_of_pagerank_are_dealt_once(spark, mode):
    edges = spark.createDataFrame([(i % 7, i % 5) for i in range(60)] + [(None, 3), (2, 2)], "src long, dst long")
    moves = graph._moves(edges, mode, 0.15, 4)
    plan = moves._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(src#") == 1 + (mode == "growing") and plan.count("Join") == 0, plan  # its nodes are told apart
    found = rows(moves.groupBy("src").agg(F.round(F.sum("w"), 9), F.sum("r")))
    assert found == [(i, 1.0, 0.0 if mode == "inlinks" else 0.15) for i in range(7)]
