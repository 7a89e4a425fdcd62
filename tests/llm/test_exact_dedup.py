import hashlib

from loomwork.llm.catalogue import ORACLES, QUERIES
from loomwork.llm.exact_dedup import exact_dedup

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, taken = max(known, default=None), False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_documents(docs_of, odd_rows):
    assert result(exact_dedup(docs_of(odd_rows))) == brute(odd_rows)


def test_only_ascii_letters_change_case(docs_of):
    rows = [(1, "ÄB", "", "", 0), (2, "äb", "", "", 0), (3, "Äb", "", "", 0), (4, "İ", "", "", 0), (5, "i̇", "", "", 0)]
    assert result(exact_dedup(docs_of(rows))) == brute(rows)


def test_one_of_many_repeated_rows_stays(docs_of):
    rows = [(1, "x", "", "", 0)] * 40 + [(9, "X", "", "", 0)] * 40 + [(None, "y", "", "", 0)] * 3
    got = result(exact_dedup(docs_of(rows)))
    assert got == brute(rows) and sum(r[3] for r in got) == 2


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).collect() == []


def test_query_matches_sql(same_as_sql):
    same_as_sql(QUERIES["op10_exact_dedup"], ORACLES["op10_exact_dedup"])
