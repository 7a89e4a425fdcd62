"""The command line."""

from loomwork.__main__ import main


def test_list(capsys):
    main(["list"])
    assert "wc_documents" in capsys.readouterr().out.split()


def test_run(spark, sf_dir, tmp_path, capsys):
    main(["run", "wc_top10", "--data", sf_dir, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
    main(["run", "bloom_params", "--data", sf_dir])
    assert "bits" in capsys.readouterr().out


def test_ngram(spark, tmp_path, capsys):
    (tmp_path / "n").write_text("a no x d e\t3\na no y d e\t1\nb of x d e\t4\n")
    main(["ngram", str(tmp_path / "n"), "--b", "no", "--c", "_"])
    assert capsys.readouterr().out.splitlines() == ["4 matching ngrams (50.0000%)", "1    75.0000% B=no,C=x", "2    25.0000% B=no,C=y"]


def test_sharded_files(spark, tmp_path, capsys):
    (tmp_path / "in").write_text("".join(f"line {i}\n" for i in range(30)))
    main(["fs", "put", str(tmp_path / "in"), str(tmp_path / "s"), "--shards", "3"])
    put = capsys.readouterr().out.splitlines()
    assert len(put) == 3 and sum(int(x.split()[2]) for x in put) == 30
    main(["fs", "merge", str(tmp_path / "s"), str(tmp_path / "m"), "--shards", "3"])
    assert capsys.readouterr().out.splitlines() == put
    merged = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(merged) == sorted(f"line {i}" for i in range(30))
    main(["fs", "head", str(tmp_path / "s"), "--shards", "3"])
    assert capsys.readouterr().out.splitlines() == merged[: min(10, int(put[0].split()[2]))]
    main(["fs", "tail", str(tmp_path / "s"), "--shards", "3"])
    assert capsys.readouterr().out.splitlines() == merged[-min(10, int(put[2].split()[2])) :]


def test_a_users_job(spark, tmp_path):
    (tmp_path / "own.py").write_text(
        "from loomwork.operators.mapreduce import Job\n\ndef split(x):\n    return x.split()\n\n"
        "class Count(Job):\n    def map(self, line):\n        return ((w, 1) for w in split(line))\n\n    def reduce(self, key, values):\n        yield key, sum(values)\n"
    )
    (tmp_path / "in").write_text("a b a\nit's b\n")
    main(["job", str(tmp_path / "own.py"), "Count", str(tmp_path / "in"), str(tmp_path / "out")])
    got = sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines())
    assert got == sorted(["('a', 2)", "('b', 2)", '("it\'s", 1)'])
    main(["job", str(tmp_path / "own.py"), "Count", str(tmp_path / "in"), str(tmp_path / "mapped"), "--map-only"])
    got = sorted(x for f in (tmp_path / "mapped").glob("part-*") for x in f.read_text().splitlines())
    assert got == sorted(["('a', 1)"] * 2 + ["('b', 1)"] * 2 + ['("it\'s", 1)'])


def test_reports(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("a b\nb a\nc a\n")
    main(["ranks", str(tmp_path / "e"), "--steps", "2"])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "iteration 0: 3 nodes, high 1.0000, low 1.0000, mean 1.0000" and out[2].startswith("first")
    (tmp_path / "f").write_text("x x y\n")
    (tmp_path / "g").write_text("x y y z\n")
    main(["words", str(tmp_path / "f"), "--top", "1"])
    assert capsys.readouterr().out.split() == ["2", "x"]
    main(["words", str(tmp_path / "f"), "--background", str(tmp_path / "g"), "--top", "1"])
    assert [x.split()[-1] for x in capsys.readouterr().out.splitlines()] == ["1", "x", "1", "y"]
