"""python -m loomwork COMMAND

list                                     names of the queries
run QUERY --data DIR [--out DIR | --rows N]
ngram FILE [--top K] [--a WORD] ... [--e WORD]
ranks EDGES [--steps N] [--mode MODE]    progress and ends of PageRank over a file of edges
words FILE [--background FILE] [--top K] most common words, or the words that tell two files apart
fs put|merge|head|tail|stats ...         text in shards
job FILE CLASS SOURCE OUT [--map-only]   a user's map and reduce over lines of text
"""

from __future__ import annotations

import argparse
import importlib.util
import sys

from pyspark.sql import DataFrame, SparkSession

from loomwork.operators import graph, lexicon, mapreduce, ngram
from loomwork.operators import text as words
from loomwork.plans.catalogue import QUERIES
from loomwork.sources import files, text


def percent(share: float, width: int = 0) -> str:
    return f"{100 * share:{width}.04f}%"


def print_top_bottom(scored: DataFrame, k: int, keys: list[str]) -> None:
    """The k highest and the k lowest scores, a line each."""
    for side in ("top", "bottom"):
        print(f"{side} {k}")
        for row in lexicon.top_bottom(scored, k, keys).where(f"side = '{side}'").orderBy("rank").collect():
            print(f"{row['rank']:<5d}{row['score']:8.4f} {' '.join(row[c] for c in keys)}")


def print_progress(steps: DataFrame) -> None:
    """Number, highest, lowest and mean score that enter each iteration, a line each."""
    for row in steps.orderBy("iteration").collect():
        print(f"iteration {row['iteration']}: {row['n']:,} nodes, high {row['high']:.4f}, low {row['low']:.4f}, mean {row['mean']:.4f}")


def print_shards(stats: DataFrame) -> None:
    for row in stats.orderBy("shard").collect():
        print(f"shard {row['shard']}: {row['lines']:,} lines")


def load_job(path: str, name: str) -> mapreduce.Job:
    """An instance of a user's class out of a file of Python, which goes to the tasks by value: they need no copy of the file."""
    from pyspark import cloudpickle

    spec = importlib.util.spec_from_file_location("loomwork_user_job", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, name)()


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="write the whole result here, as Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show without --out")
    pattern = commands.add_parser("ngram", help="distribution of what a pattern's slots are bound to; _ binds any word")
    pattern.add_argument("file")
    pattern.add_argument("--top", type=int, default=10)
    for slot in "abcde":
        pattern.add_argument(f"--{slot}")
    ranks = commands.add_parser("ranks")
    ranks.add_argument("edges")
    ranks.add_argument("--steps", type=int, default=10)
    ranks.add_argument("--mode", choices=graph.MODES, default="sources")
    common = commands.add_parser("words")
    common.add_argument("file")
    common.add_argument("--background")
    common.add_argument("--top", type=int, default=10)
    fs = commands.add_parser("fs").add_subparsers(dest="action", required=True)
    for action, names in {"put": ("source", "path"), "merge": ("path", "out"), "head": ("path",), "tail": ("path",), "stats": ("path",)}.items():
        one = fs.add_parser(action)
        for name in names:
            one.add_argument(name)
        one.add_argument("--shards", type=int, default=4)
    job = commands.add_parser("job")
    for name in ("file", "name", "source", "out"):
        job.add_argument(name)
    job.add_argument("--map-only", action="store_true")
    job.add_argument("--key", default="string", help="type of the reduced keys")
    job.add_argument("--value", default="long", help="type of the reduced values")
    return parser


def _fs(spark: SparkSession, given: argparse.Namespace) -> None:
    store = files.ShardedText(spark, given.shards)
    if given.action == "put":
        print_shards(store.put(text.lines(spark, given.source), given.path))
    elif given.action == "merge":
        print_shards(store.get_merge(given.path, given.out))
    elif given.action == "stats":
        print_shards(store.stats(given.path))
    else:
        print("\n".join(getattr(store, given.action)(given.path)))


def main(args: list[str] | None = None) -> None:
    given = _arguments().parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("loomwork").getOrCreate()
    if given.command == "run":
        result = QUERIES[given.query](spark, given.data)
        if given.out:
            result.write.mode("overwrite").parquet(given.out)
        else:
            result.show(given.rows, truncate=False)
    elif given.command == "ngram":
        query = {s: getattr(given, s) for s in "abcde" if getattr(given, s) is not None}
        grams = text.weighted_ngrams(text.lines(spark, given.file))
        share = ngram.match_share(grams, query).first()
        print(f"{share.matched:,} matching ngrams" + ("" if share.percent is None else f" ({share.percent:.04f}%)"))
        for i, row in enumerate(ngram.distribution(ngram.count_bindings(grams, query), given.top).collect()):
            print(f"{i + 1:<5d}{percent(row.probability, 7)} {row.binding}")
    elif given.command == "ranks":
        edges = text.edges(text.lines(spark, given.edges))
        print_progress(graph.progress(edges, given.steps, given.mode))
        for row in graph.ends(graph.pagerank(edges, given.steps, given.mode)).orderBy("node").collect():
            print(f"{row['place']:6s}{row['score']:10.4f} {row['node']}")
    elif given.command == "words":
        counts = words.word_count(text.lines(spark, given.file))
        if given.background:
            print_top_bottom(lexicon.log_odds(counts, words.word_count(text.lines(spark, given.background)), ["token"]), given.top, ["token"])
        else:
            for row in words.most_common(counts, given.top, "token").collect():
                print(f"{row.n:>12,} {row.token}")
    elif given.command == "fs":
        _fs(spark, given)
    else:
        job, lines = load_job(given.file, given.name), text.lines(spark, given.source)
        found = job.map_only(lines) if given.map_only else mapreduce.text_of(job.map_reduce(lines, given.key, given.value))
        files.write_text(found, given.out)


if __name__ == "__main__":
    main()
