import hashlib
import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import line_dedup as ld
from loomwork.llm.catalogue import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def content_hash(i, text):
    """XXH64 of the id and the text, each after a 4-byte mark of whether it is null, chained by the seed."""
    h = 42
    for part in ((i is None).to_bytes(4, "little"), b"" if i is None else i.to_bytes(8, "little", signed=True), bytes(4), text.encode()):
        if part or i is not None:
            h = xxhash.xxh64_intdigest(part, seed=h)
    return h - 2**64 if h >= 2**63 else h


def allowed(n, edits, share):
    return min(edits, n // share)


def brute(rows, edits=2, share=10):
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, content_hash(rows[n][0], rows[n][1] or "")))
    first, seen = {}, set()
    for place, n in enumerate(order):
        i, text = rows[n][0], rows[n][1] or ""
        if (i, text) in seen:  # a repeated row shares the decisions of the first
            continue
        seen.add((i, text))
        for p, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (place, p, (i, text)))
    far = [x for x in first if len(x) >= share]
    gone = set()
    for a in range(len(far)):
        for b in range(a):
            most = allowed(min(len(far[a]), len(far[b])), edits, share)
            if abs(len(far[a]) - len(far[b])) <= most and distance(far[a], far[b]) <= most:
                gone.add(max(far[a], far[b], key=lambda x: first[x][:2]))
    out = []
    for i, text, *_ in rows:
        text = text or ""
        lines, kept, removed, close = text.split("\n"), [], 0, 0
        for p, line in enumerate(lines):
            own = line.strip(" ") and first[line][1:] == (p, (i, text))
            if not line.strip(" ") or (own and line not in gone):
                kept.append(line)
            else:
                removed += 1
                close += bool(own)
        out.append((i, len(lines), removed, close, "\n".join(kept)))
    return sorted(out, key=repr)


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(line))
        if kind == 0:
            line[at] = rng.choice("abé😀")
        elif kind == 1:
            del line[at]
        else:
            line.insert(at, rng.choice("abé😀"))
    return "".join(line)


def test_against_brute_force(docs_of):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([3, 8, 9, 10, 12, 18, 19, 20, 21, 22, 30, 31, 60]))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(rng.randint(0, 4))] + rng.choices(["", " ", "short", "other short"], k=2)
        rng.shuffle(lines)
        rows.append((rng.randrange(50), "\n".join(lines), "en", "s", 0))
    got = sorted(map(tuple, ld.line_dedup(docs_of(rows)).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 10


def test_rows_without_id_whose_murmur_hashes_collide(spark, docs_of):
    """Two texts without an id that a 32-bit hash of the text can't tell apart stay two rows."""
    text = F.concat(F.lit("line number "), F.col("id").cast("string"), F.lit(" of a text that has no id at all\nsecond line "), F.col("id").cast("string"))
    pairs = spark.range(200_000).select(text.alias("t")).groupBy(F.hash(F.lit(True), "t")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").limit(3).collect()
    assert pairs
    rows = [(None, t, "en", "s", 0) for p in pairs for t in p.ts[:2]] + [(1, "x\n" + pairs[0].ts[0].split("\n")[0], "en", "s", 0)]
    got = sorted(map(tuple, ld.line_dedup(docs_of(rows), 0, 1).collect()), key=repr)
    assert got == brute(rows, 0, 1) and sum(r[2] for r in got) == 1


def test_query_against_brute_force(spark, tmp_path):
    """The registered query on a small folder, lines of all lengths."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (1, 2, 5, 9, 10, 11, 15, 19, 20, 25, 29, 30, 40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(4)), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, n, removed, close, hashlib.sha256(kept.encode()).hexdigest()) for i, n, removed, close, kept in brute(rows)]
    got = QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sum(r.n_near for r in got) > 5


def test_repeated_rows_share_their_decisions(docs_of):
    rows = [(None, "the same text again\nand again", "en", "s", 0)] * 30 + [(1, "the same text again", "en", "s", 0)]
    got = sorted(map(tuple, ld.line_dedup(docs_of(rows)).collect()), key=repr)
    assert got == brute(rows) and [r[4] for r in got].count("and again") == 30


def test_odd_documents(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (4, 5, 8)]  # brute force can't do the long ones
    rows += [(40, "a\nb\na\n\n", "", "", 0), (41, "a\r\nb", "", "", 0), (42, "b", "", "", 0)]
    assert sorted(map(tuple, ld.line_dedup(docs_of(rows)).collect()), key=repr) == brute(rows)


def test_long_lines_that_differ_little(docs_of):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long, "", "", 0), (2, long[:30_000] + "X" + long[30_001:-5] + long[-4:], "", "", 0), (3, long[:-3], "", "", 0), (4, "Y" + long + "Z", "", "", 0)]
    got = {r.doc_id: r.n_near for r in ld.line_dedup(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}  # 3 is three edits from 1


def test_other_columns_come_along(docs_of):
    rows = [(1, "x", "en", "s", 0), (2, "x\ny", "de", None, 0)]
    got = ld.line_dedup(docs_of(rows), also=("lang", "source")).select("doc_id", "kept", "lang", "source").collect()
    assert sorted(map(tuple, got)) == [(1, "x", "en", "s"), (2, "y", "de", None)]


def test_empty_table(docs_of):
    assert ld.line_dedup(docs_of([])).collect() == []


def test_every_pair_within_the_edits_shares_a_probed_segment():
    rng = random.Random(4)

    def cuts(n, edits):
        parts = edits + 1
        sizes = [n // parts + (i >= parts - n % parts) for i in range(parts)]
        starts = [sum(sizes[:i]) for i in range(parts)]
        return list(zip(starts, sizes))

    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(rng.choice("ab") for _ in range(rng.randint(8, 20)))
            b = edited(rng, a, rng.randint(0, edits))
            if distance(a, b) <= edits and a != b:
                short, long = sorted((a, b), key=len)
                index = {(i, short[s : s + z]) for i, (s, z) in enumerate(cuts(len(short), edits))}
                probed = set()
                for less, i, shift in ld.probes(edits):
                    if less == len(long) - len(short):
                        s, z = cuts(len(short), edits)[i]
                        if s + shift >= 0:
                            probed.add((i, long[s + shift : s + shift + z]))
                assert index & probed, (a, b)


def test_frequent_keys_lose_no_pair(docs_of, monkeypatch):
    """Many lines that differ by a word here and there, or by a letter."""
    monkeypatch.setattr(ld, "FREQUENT", 3)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)]
    rows = []
    for i in range(50):
        w = list(base)
        w[i % 9] = "abcdefgh"[i % 8] * 5
        rows.append((i, edited(rng, " ".join(w), rng.randrange(2)), "", "", 0))
    rows += [(100 + i, edited(rng, rng.choice(rows)[1], 1), "", "", 0) for i in range(10)]
    got = sorted(map(tuple, ld.line_dedup(docs_of(rows)).collect()), key=repr)
    assert got == brute(rows) and sum(r[3] for r in got) > 3


def test_frequent_keys_of_short_lines(docs_of, monkeypatch):
    monkeypatch.setattr(ld, "FREQUENT", 2)
    rng = random.Random(12)
    rows = [(i, edited(rng, "abcdefgh" + rng.choice(["ijkl", "ijklmnopqrst", "zz"]) + rng.choice(["", "xyzxyz"]), rng.randrange(4)), "", "", 0) for i in range(120)]
    got = sorted(map(tuple, ld.line_dedup(docs_of(rows)).collect()), key=repr)
    assert got == brute(rows) and sum(r[3] for r in got) > 20


def test_a_further_segment_is_shared_by_every_pair():
    """For one segment of every pair, a probe of the rest meets the indexed line's rest."""
    rng = random.Random(5)

    def cuts(n, edits):
        sizes = [n // (edits + 1) + (i >= edits + 1 - n % (edits + 1)) for i in range(edits + 1)]
        return [(sum(sizes[:i]), sizes[i]) for i in range(edits + 1)]

    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(rng.choice("ab") for _ in range(rng.randint(8, 20)))
            b = edited(rng, a, rng.randint(0, edits))
            if distance(a, b) > edits or a == b:
                continue
            short, long = sorted((a, b), key=len)
            found = False
            for less, i, shift in ld.probes(edits):
                if less != len(long) - len(short):
                    continue
                s, z = cuts(len(short), edits)[i]
                if s + shift < 0 or long[s + shift : s + shift + z] != short[s : s + z]:
                    continue
                x, y, left = (short[s + z :], long[s + shift + z :], edits - i) if i < edits else (short[:s], long[: s + shift], edits)
                parts = cuts(len(x), left)
                assert all(len(y) - len(x) == (less - shift if i < edits else shift) for _ in "1")
                found |= any(p + t >= 0 and y[p + t : p + t + w] == x[p : p + w] for j, t in ld.further(left, len(y) - len(x)) for p, w in [parts[j]])
            assert found, (a, b)


def test_signatures_of_near_lines_are_near(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdefghé😀 ") for _ in range(rng.randint(5, 60)))
        pairs.append((a, edited(rng, a, 2)))
    df = spark.createDataFrame(pairs, "a string, b string")
    near = ld.may_be_near(ld.signature(F.col("a")), ld.signature(F.col("b")), 2)
    assert df.where(near).count() == len(pairs)


def test_number_of_probes():
    assert [len(ld.probes(e)) for e in (0, 1, 2)] == [1, 4, 12]


PAIRS = st.tuples(st.text("ab😀é", max_size=12), st.text("ab😀é", max_size=12))


@settings(max_examples=15, deadline=None)
@given(st.lists(PAIRS, min_size=30, max_size=60))
def test_banded_distance(spark, pairs):
    rows = list(dict.fromkeys(pairs + [(a, a[1:] + "b") for a, _ in pairs]))
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2):
        got = df.select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("cut"), ld.banded(F.col("a"), F.col("b"), edits).alias("whole")).collect()
        for r in got:
            assert r.cut == r.whole == (distance(r.a, r.b) <= edits), (r, edits)
