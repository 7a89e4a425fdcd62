"""The query catalogue: a function from (spark, folder of tables) to a DataFrame for every name.

Foreground corpus: documents in English; background: those in other languages.
Graphs are made of ``lineitem``: supplier to part in one id space (most parts
are sinks), or both ways with prefixed ids. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.strings import json_value, percent, thousands, tokens
from loomwork.operators import autodiff, dataset, graph, lexicon, linalg, mapreduce, ngram, sketch
from loomwork.operators import text as words
from loomwork.operators.lineage import scratch_path
from loomwork.sources import text as sources
from loomwork.sources.files import ShardedText, write_text
from loomwork.sources.files import head_tail as ends_of
from loomwork.sources.text import document_lines, line_set, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Nine words whose counts are compared between implementations.
PROBE_WORDS = "the of and to in that is was he".split()
#: Frequent words of the documents, as constants of the pattern queries.
COMMON = {"b": "the", "c": "of", "d": "the"}
SHARDS = 4


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines: a line feed is no word character, so words need no splitting."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))


def _counts(spark: SparkSession, sf_dir: str, pairs: bool = False) -> DataFrame:
    """Counts of words or of pairs, ``f`` in documents in English and ``b`` in all others, those of no known language too."""
    lines = document_lines(table(spark, sf_dir, "documents"), "lang")
    return words.two_corpora(lines, F.col("lang").eqNullSafe("en"), pairs)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Words


@query
def wc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(_whole(spark, sf_dir))


@query
def wc_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.most_common(words.word_count(_whole(spark, sf_dir)), 10, "token")


@query
def wc_probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.token_rows(_whole(spark, sf_dir)).where(F.col("token").isin(PROBE_WORDS))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def tokens_map_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.token_rows(_whole(spark, sf_dir), "doc_id")


@query
def bigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.bigram_count(document_lines(table(spark, sf_dir, "documents")))


# Two corpora


@query
def vocab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _counts(spark, sf_dir).agg(*[x for c in ("f", "b") for x in (F.count_if(F.col(c) > 0).alias(f"v{c}"), F.coalesce(F.sum(c), F.lit(0)).alias(f"n{c}"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("corpus"), F.col(f"v{c}").alias("vocabulary"), F.col(f"n{c}").alias("total")) for name, c in (("fg", "f"), ("bg", "b"))])))


def _word_odds(spark: SparkSession, sf_dir: str, vocabulary: str = "background") -> DataFrame:
    return lexicon.counted_odds(_counts(spark, sf_dir), ["token"], vocabulary)


def _foreground(counts: DataFrame) -> DataFrame:
    return counts.where("f > 0").withColumnRenamed("f", "n").drop("b")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, sizes = lexicon.held(_counts(spark, sf_dir, pairs=True), "pairs")
    counted, _ = lexicon.held(_counts(spark, sf_dir), "words", "f > 0")
    scored = lexicon.counted_odds(pairs, ["x", "y"], sizes=sizes).withColumn("phrase_count", F.col("f"))
    return lexicon.phraseness(scored, _foreground(counted), _foreground(pairs), sizes.select(F.col("n1").alias("vp"), F.col("total").alias("np")))


@query
def logodds_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_word_odds(spark, sf_dir), "score")


@query
def logodds_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexicon.counted_odds(_counts(spark, sf_dir, pairs=True), ["x", "y"]), "score")


@query
def logodds_words_fgvocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_word_odds(spark, sf_dir, "foreground"), "score")


@query
def logodds_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ranked on the rounded score, so that both engines see the same ties.
    return lexicon.top_bottom(_rounded(_word_odds(spark, sf_dir), "score"), 10, ["token"])


@query
def phraseness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_phrases(spark, sf_dir).select("x", "y", "phrase_count", "x_count", "y_count", "phraseness"), "phraseness")


@query
def good_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexicon.good_phrases(_phrases(spark, sf_dir)).select("x", "y", "score", "phraseness"), "score", "phraseness")


# Patterns over n-grams


def _five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.ngram_count(document_lines(table(spark, sf_dir, "documents")), 5, "abcde")


def _answer(spark: SparkSession, sf_dir: str, pattern: dict[str, str], top: int) -> DataFrame:
    # Bindings are counted straight from the runs of words: one shuffle, of bindings.
    runs = words.ngram_rows(document_lines(table(spark, sf_dir, "documents")), 5, "abcde", "".join(sorted(pattern)))
    return _rounded(ngram.distribution(ngram.count_bindings(runs, pattern), top), "probability")


@query
def ngram5_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark, sf_dir)


@query
def ngram_marginal_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, {"c": "_"}, 10)


@query
def ngram_const_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, {"b": COMMON["b"], "c": "_"}, 10)


@query
def ngram_b_given_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, {"b": "_", "c": COMMON["c"]}, 10)


@query
def ngram_five_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, {"a": "_", "b": COMMON["b"], "c": "_", "d": "_", "e": "_"}, 20)


@query
def ngram_match_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ngram.match_share(words.ngram_rows(document_lines(table(spark, sf_dir, "documents")), 5, "abcde", "b"), {"b": COMMON["b"]}), "percent")


@query
def ngram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a pattern as a report's texts."""
    found = _answer(spark, sf_dir, {"b": COMMON["b"], "c": "_"}, 10)
    return found.select("binding", thousands(F.col("n")).alias("n"), percent(F.col("probability"), 2, 7).alias("share"))


# Graphs


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def _both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    return pairs.select(F.inline(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("s").alias("dst")))))


@query
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_sinks(spark, sf_dir))


@query
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_sinks(spark, sf_dir)).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query
def pagerank_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.pagerank(_sinks(spark, sf_dir), 10, "sources"), "score")


@query
def pagerank_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.pagerank(_sinks(spark, sf_dir), 5, "growing"), "score")


@query
def pagerank_inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.pagerank(_both_ways(spark, sf_dir), 10, "inlinks"), "score")


@query
def pagerank_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.progress(_both_ways(spark, sf_dir), 10, "sources"), "high", "low", "mean")


@query
def pagerank_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.ends(graph.pagerank(_sinks(spark, sf_dir), 10, "sources")), "score")


# Matrices and vectors


def _orders_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("w"))


@query
def matmul_abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _orders_matrix(spark, sf_dir)
    return _rounded(linalg.matmul_abt(a, a), "w")


@query
def gram_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = linalg.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return _rounded(linalg.matmul_abt(a, a, tiles=4), "w")  # every column is full


@query
def matmul_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of whole numbers times its transpose is its own transpose."""
    a = _orders_matrix(spark, sf_dir)
    return linalg.symmetric(linalg.matmul_abt(a, a))


@query
def vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    sums = rows.join(after, "vec_id").select("vec_id", F.posexplode(linalg.vector_add(F.col("v"), F.col("u"))).alias("place", "c"))
    return _rounded(sums, "c")


# Sketches


#: Share of false positives of the filters, and where their seeds are drawn from.
RATE, SEED = 0.01, 0


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order before 1996."""
    early = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return line_set(early.select(F.col("o_custkey").cast("string").alias("line")).distinct())


def _bloom(train: DataFrame) -> sketch.Bloom:
    """A filter sized for what goes into it: one number is counted before."""
    return sketch.Bloom(max(1, train.count()), RATE, SEED)


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_set(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("line")))


@query
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    bloom = _bloom(_train(spark, sf_dir))
    return spark.range(1).select(F.lit(bloom.bits).cast("long").alias("bits"), F.lit(bloom.hashes).alias("hashes"), F.lit(bloom.words).cast("long").alias("words"))


@query
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    bloom = _bloom(train)
    return bloom.words_of(bloom.build(train))


@query
def bloom_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    bloom = _bloom(train)
    return _rounded(bloom.density(bloom.build(train)), "density")


@query
def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    bloom = _bloom(train)
    return bloom.contains(_probe(spark, sf_dir), bloom.build(train))


@query
def bloom_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    return _rounded(_bloom(train).report(train, _probe(spark, sf_dir)), "kb", "density")


# Programs


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_extendedprice").alias("x"))


@query
def autodiff_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", "x1", "x2")
    program = autodiff.DOUBLE_PLUS_SQUARED
    return _rounded(autodiff.backward(autodiff.forward(rows, program), program).select("l_orderkey", "l_linenumber", "f", "d_x1", "d_x2"), "f", "d_x1", "d_x2")


@query
def autodiff_lnsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", "x")
    program = autodiff.LOG_OF_SQUARE
    return _rounded(autodiff.backward(autodiff.forward(rows, program), program).select("l_orderkey", "l_linenumber", "f", "d_x"), "f", "d_x")


@query
def autodiff_grad_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir).select("x1", "x2")
    program = autodiff.DOUBLE_PLUS_SQUARED
    sums = autodiff.backward(autodiff.forward(rows, program), program).agg(F.sum("f").alias("f"), F.sum("d_x1").alias("d_x1"), F.sum("d_x2").alias("d_x2"))
    return sums.withColumns({c: F.round(c, 2) for c in ("f", "d_x1", "d_x2")})


@query
def autodiff_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives by the backward pass, and by tangents carried forward."""
    rows = _inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", "x1", "x2")
    program = autodiff.DOUBLE_PLUS_SQUARED
    back = autodiff.backward(autodiff.forward(rows, program), program)
    both = autodiff.tangents(back.select("l_orderkey", "l_linenumber", "x1", "x2", "z1", "z2", "d_x1"), program, "x1")
    return _rounded(both.select("l_orderkey", "l_linenumber", "d_x1", F.col("t_f").alias("t_x1")), "d_x1", "t_x1")


# Map and reduce with user functions


def _pairs_of(text: str):
    import re

    return ((w, 1) for w in re.findall(r"\w+", text.lower()))


@query
def mr_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = mapreduce.Job(_pairs_of, lambda key, values: [(key, sum(values))], combine=lambda a, b: a + b)
    return job.map_reduce(_whole(spark, sf_dir).select("line"), "string", "long").select(F.col("key").alias("token"), F.col("value").alias("n"))


@query
def mr_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and sizes, grouped by brand, with their place in the run of each key."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size")
    runs = mapreduce.Job(lambda row: [(row[0], row[1])]).sorted_runs(parts.select("p_brand", F.col("p_size").cast("string")))
    return runs.select("key", "value", F.row_number().over(Window.partitionBy("key").orderBy("value")).alias("place"))


@query
def mr_map_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_name")
    return mapreduce.Job(lambda name: [name.lower(), len(name)]).map_only(names)


@query
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapreduce.assign_shards(table(spark, sf_dir, "customer").select("c_name"), "c_name", SHARDS)


@query
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapreduce.shard_stats(shard_assign(spark, sf_dir))


@query
def kv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as lines, and read from them again."""
    rows = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey")
    line = rows.select(mapreduce.line_column(F.col("s_name"), F.col("s_suppkey")).alias("line"))
    fields = F.split("line", "\t", 2)
    return line.select("line", F.from_json(F.concat(F.lit('{"x":'), fields[0], F.lit("}")), "x string")["x"].alias("key"), fields[1].cast("long").alias("value"))


@query
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(json_value(F.col("n_name")).alias("key"), F.size(tokens(F.col("n_name"))).alias("words"))


# Text files: tables are written as text and read by the readers of text


def _written(df: DataFrame, name: str, column: str = "line", compression: str = "none") -> str:
    path = scratch_path(df.sparkSession, name)
    write_text(df, path, column, compression)
    return path


@query
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of a text file that holds the lines of all documents."""
    path = _written(document_lines(table(spark, sf_dir, "documents")), "lines")
    return words.word_count(sources.lines(spark, path))


@query
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of a graph whose edges are lines of text."""
    path = _written(_sinks(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("line")), "edges")
    return graph.degrees(sources.edges(sources.lines(spark, path)))


@query
def text_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over a file of weighted n-grams."""
    counted = _five(spark, sf_dir)
    path = _written(counted.select(F.concat(F.concat_ws(" ", *"abcde"), F.lit("\t"), F.col("n")).alias("line")), "ngrams", compression="gzip")
    pattern = {"b": COMMON["b"], "c": "_"}
    return _rounded(ngram.distribution(ngram.count_bindings(sources.weighted_ngrams(sources.lines(spark, path)), pattern), 10), "probability")


@query
def json_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of two matrices out of one JSON document: nations by region, a table of fixed size."""
    entry = F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(1.0))
    document = table(spark, sf_dir, "nation").agg(F.collect_list(entry).alias("a"), F.collect_list(entry).alias("b"), F.collect_list(entry).alias("r"))
    held = sources.matrices(spark, _written(document.select(F.to_json(F.struct("a", "b", "r")).alias("line")), "matrices"))
    return linalg.matmul_abt(held["a"], held["b"])


@query
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced pairs as lines of text, written and read again."""
    job = mapreduce.Job(_pairs_of, lambda key, values: [(key, sum(values))], combine=lambda a, b: a + b)
    reduced = job.map_reduce(table(spark, sf_dir, "part").select("p_name"), "string", "long")
    return sources.lines(spark, _written(mapreduce.text_of(reduced), "pairs", "value"))


@query
def sharded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put to shards, and merged shard by shard."""
    store, path = ShardedText(spark, SHARDS), scratch_path(spark, "shards")
    store.put(table(spark, sf_dir, "customer").select(F.col("c_name").alias("line")), path)
    return store.merged(path)


def _both_fields(line: str) -> list:
    src, dst = line.split(" ")
    return [(int(src), int(dst))]


@query
def dataset_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, lowest and highest target of each source, by a lazy collection over a text file and a combiner of three functions."""
    path = _written(_sinks(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("line")), "edges")
    pairs = dataset.Context(spark).text_file(path).flat_map(_both_fields)
    states = pairs.combine_by_key(lambda x: (1, x, x), lambda s, x: (s[0] + 1, min(s[1], x), max(s[2], x)), lambda s, t: (s[0] + t[0], min(s[1], t[1]), max(s[2], t[2])))
    return states.map(lambda x: (x[0], *x[1])).to_rows("node long, edges long, low long, high long")


@query
def dataset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations beside their regions, by a join of two lazy collections."""
    held = dataset.Context(spark)
    nations = held.from_frame(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"))
    regions = held.from_frame(table(spark, sf_dir, "region").select("r_regionkey", "r_name")).distinct()
    return nations.join(regions).values().sort_by(lambda pair: pair[0]).to_rows("nation string, region string")


@query
def dataset_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, by a lazy collection."""
    names = dataset.Context(spark).from_frame(table(spark, sf_dir, "part").select("p_name"))
    counted = names.flat_map(_pairs_of).reduce_by_key(lambda a, b: a + b)
    return counted.filter(lambda pair: pair[1] > 1).to_rows("token string, n long")


@query
def dataset_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local list as a lazy collection, beside the same list as rows."""
    squares = dataset.Context(spark).from_list(range(10)).map(lambda x: (x, x * x)).to_rows("x long, y long")
    return squares.join(sources.rows(spark, [(x, str(x)) for x in range(5, 15)], "x long, t string"), "x")


@query
def dataset_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three regions by name, taken from a sorted collection, and how many there are."""
    regions = dataset.Context(spark).from_frame(table(spark, sf_dir, "region").select("r_name")).cache()
    first = regions.sort_by(lambda name: name).take(3)
    return sources.rows(spark, [(name, regions.count(), len(regions.collect())) for name in first], "name string, n long, held long")
