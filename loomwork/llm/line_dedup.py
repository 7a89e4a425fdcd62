"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (text between line feeds) goes where an equal line came before it in the
corpus, or a near one: within one edit for every ``share`` characters of the
shorter line, and ``edits`` at most. Documents are ordered by id, null last, then
by content; lines by their place. Blank lines always stay.

1. Occurrences of a line are reduced to its first place, its count and two
   64-bit hashes, without its text; map tasks combine first, so a line that
   makes up a large part of all lines is a row of each map task.
2. The first copies are split into segments, one more than the edits that their
   length allows. A line within that many edits has one of them unchanged, shifted
   by no more than the edits on one side allow, so every line probes the index
   with the substrings that its length and each indexed length admit
   (multi-match-aware selection). A key holds the segment's number, the indexed
   length and the substring's hash. Keys are made in one pass over the texts. The
   index has one row for each key: how many lines have it and two of them, so a
   key of one or two lines gives its pairs in the probe itself. Lines of larger
   keys meet by key. Where more than ``FREQUENT`` share one (near copies by the
   thousand do), they meet by a further segment: if a pair's edits are i before its
   segment i and no more than the rest after it, as for one of its segments they
   are, then what stands on one side can be cut in the same way again. There
   each line brings a signature of its characters, too, and only pairs whose
   signatures are within reach of each other leave the join. No pair that is
   within the edits is lost.
3. Candidate pairs are verified on the texts: common starts and ends are cut
   off, and a banded bit-parallel distance runs over what differs: one long
   holds the 2 * edits + 1 cells of a column around the diagonal.
4. A line with a verified earlier partner goes; so do all copies but the first
   of any line. Documents get their dropped places as one array.

Texts are shuffled by document only: for the keys, for the lines of frequent keys,
for the lines that are in a pair, and for the result. Each step's shuffle files go
when it ends, its table when the last step that reads it has ended.

Rows are told apart by two 64-bit hashes of their id and text, lines by two of
their characters.

Defined cases: a null text counts as empty. Rows alike in id and text count as
one row, each getting the same decision; null ids come last. Of equal or near
lines in one document the earlier one stays. A line of fewer than ``share``
characters is allowed no edit, so it goes as an exact copy only. Very long lines
and texts are compared whole; they take memory in proportion to their length. A
row of which nothing but blank lines is left keeps those. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import content_key, discard, stored

#: Edits allowed at most, and characters of the shorter line for each of them.
EDITS, SHARE = 2, 10
#: Lines that may share an index key before its pairs are sifted by signatures.
FREQUENT = 16
#: Powers of two that the search for common starts and ends goes down from.
_DOUBLINGS = 31


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0) of a line; the last segments are the longer ones."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = parts - length % parts  # so many segments have no extra character
    extra = F.greatest(F.lit(0), F.lit(i) - short)
    return (base * i + extra + 1).cast("int"), (base + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring that a line must probe."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            left, right = i, edits - i
            out += [(less, i, s) for s in range(max(-left, less - right), min(left, less + right) + 1)]
    return out


def _key(line: Column, i: int, indexed: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), indexed, F.substring(line, start, size))


def allowed(n: Column, edits: int, share: int) -> Column:
    """Edits that a pair is allowed whose shorter line has ``n`` characters."""
    return F.least(F.lit(edits), F.floor(n / share).cast("int"))


def _keys(line: Column, n: Column, edits: int, share: int) -> Column:
    """Keys of a line, each with whether it is its own in the index or one to probe.

    An indexed length has as many segments as its edits ask for.
    """

    def keys(most: int) -> list[tuple[Column, Column]]:
        out = []
        for less, i, shift in probes(most):
            start, size = segment(n - less, i, most)
            out.append((n - less, F.struct(_key(line, i, n - less, start + shift, size).alias("key"), F.lit(less == shift == 0).alias("own"))))
        return out

    some = [F.when(allowed(m, edits, share) == most, key) for most in range(1, edits + 1) for m, key in keys(most)]
    every = F.array(*[key for _, key in keys(edits)])
    return F.when(n >= edits * share + edits, every).otherwise(F.array_compact(F.array(*some)))


def further(edits: int, longer: int) -> list[tuple[int, int]]:
    """(segment, shift) of every substring to probe in a string that is ``longer`` (or shorter, below 0) than the indexed one."""
    return [(j, s) for j in range(edits + 1) for s in range(max(-j, longer - (edits - j)), min(j, longer + edits - j) + 1)]


def _further_keys(line: Column, n: Column, edits: int, share: int) -> Column:
    """Keys of a line as of ``_keys``, each with one more segment of what stands after its own (before it, if it is the last)."""
    out = []
    for most in range(1, edits + 1):
        for less, i, shift in probes(most):
            start, size = segment(n - less, i, most)
            key = _key(line, i, n - less, start + shift, size)
            if i < most:  # the rest of the line, and of the indexed one
                left, first, indexed, longer = most - i, start + shift + size, n - less - (start + size) + 1, less - shift
            else:
                left, first, indexed, longer = most, F.lit(1), start - 1, shift
            for j, s in further(left, longer):
                at, width = segment(indexed, j, left)
                more = F.xxhash64(key, F.lit(j), F.substring(line, F.greatest(F.lit(1), first + at - 1 + s), width))
                held = F.struct(key.alias("key"), more.alias("more"), F.lit(less == shift == s == 0).alias("own"))
                out.append(F.when(allowed(n - less, edits, share) == most, held))
    if not out:  # no edits: all of a key's lines are equal
        return F.array().cast("array<struct<key:bigint,more:bigint,own:boolean>>")
    return F.array_compact(F.array(*out))


def signature(line: Column) -> Column:
    """Parities of a line's characters and of its neighbours, each hashed to 64 places.

    An edit flips at most two places of the first and four of the second.
    """
    place = lambda *c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*c), F.lit(64)).cast("int"))
    zero = F.lit(0).cast("long")
    ones = lambda chars: F.aggregate(chars, zero, lambda s, c: s.bitwiseXOR(place(c)))
    twos = lambda chars: F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, lambda s, i: s.bitwiseXOR(place(F.get(chars, i - 1), F.get(chars, i))))
    return _bind(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), lambda chars: F.struct(ones(chars).alias("ones"), twos(chars).alias("twos")))


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two signatures differ in no more places than ``edits`` edits can flip."""
    apart = lambda c: F.bit_count(a[c].bitwiseXOR(b[c]))
    return (apart("ones") <= 2 * edits) & (apart("twos") <= 4 * edits)


def _bind(value: Column, then) -> Column:
    """Name a value for the expression ``then``, which evaluates it once for a row."""
    return F.transform(F.array(value), then)[0]


def _common(x: Column, y: Column) -> Column:
    """How many characters two strings have in common from the start: a binary search on equal prefixes."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(_DOUBLINGS))])

    def longer(p: Column, step: Column) -> Column:
        fits = (p + step <= F.least(F.length(x), F.length(y))) & (F.substring(x, p + 1, step) == F.substring(y, p + 1, step))
        return p + F.when(fits, step).otherwise(F.lit(0))

    return F.aggregate(powers, F.lit(0), longer)


def banded(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``: banded, bit-parallel.

    Bit k of column j stands for row j + k - edits. ``vp`` and ``vn`` hold the
    rows whose distance is one more or one less than that of the row above; the
    distance itself is followed along the band's lower edge and then along the
    last row. No sum leaves the low bits, so nothing overflows.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    bit = lambda k: F.lit(1 << k).cast("long")
    m, n = F.length(a), F.length(b)
    characters = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    def run(rows: Column, columns: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            vp, vn = state["vp"], state["vn"]

            def after(d0: Column) -> Column:
                hp = vn.bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(vp)))
                hn, down = d0.bitwiseAND(vp), F.shiftrightunsigned(d0, 1)
                last_row = F.call_function("shiftleft", bit(0), (m - j + edits).cast("int"))
                on = lambda x: F.when(x.bitwiseAND(last_row) != 0, 1).otherwise(0)
                more = F.when(j <= m - edits, F.when(d0.bitwiseAND(bit(2 * edits)) != 0, 0).otherwise(1)).otherwise(on(hp) - on(hn))
                return F.struct(hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["far"] + more).cast("int").alias("far"))

            def moved(pm: Column) -> Column:
                return _bind((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full), after)

            same = [F.when(F.get(rows, j + (k - edits - 1)) == F.get(columns, j - 1), bit(k)).otherwise(F.lit(0).cast("long")) for k in range(width)]
            return _bind(reduce(lambda x, y: x.bitwiseOR(y), same), moved)

        first = F.struct(F.lit((1 << width) - (1 << edits)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(edits)).cast("int").alias("far"))
        return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["far"] <= edits)

    bits = _bind(characters(a), lambda rows: _bind(characters(b), lambda columns: run(rows, columns)))
    return F.when(F.abs(m - n) > edits, F.lit(False)).when((m <= edits) & (n <= edits), F.lit(True)).otherwise(bits)


def _inside(x: Column, y: Column, edits: int) -> Column:
    """False only where two strings that differ in their first and in their last character can't be within ``edits`` edits.

    One edit is at either end, so of what is between them in ``x``, cut into one
    piece more than there are edits left, some piece is in ``y`` as it stands.
    """
    pieces = edits - 1
    if pieces < 1:
        return (F.length(x) <= edits) & (F.length(y) <= edits)
    size = F.greatest(F.lit(0), F.floor((F.length(x) - 2) / pieces).cast("int"))
    held = [F.contains(y, F.substring(x, F.lit(2) + size * i, size)) for i in range(pieces)]
    return reduce(lambda p, q: p | q, held)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are within ``edits`` edits: what they share at both ends is cut off first."""
    cut = lambda x, y, p: F.struct(F.substring(x, p + 1, F.length(x)).alias("x"), F.substring(y, p + 1, F.length(y)).alias("y"))
    turned = lambda t: F.struct(F.reverse(t["x"]).alias("x"), F.reverse(t["y"]).alias("y"))
    start = _bind(_common(a, b), lambda p: cut(a, b, p))
    both = _bind(_bind(start, turned), lambda t: _bind(_common(t["x"], t["y"]), lambda q: cut(t["x"], t["y"], q)))
    return _bind(both, lambda t: F.when(_inside(t["x"], t["y"], edits), banded(t["x"], t["y"], edits)).otherwise(F.lit(False)))


def near_copies(a: Column, b: Column, edits: int = EDITS, share: int = SHARE) -> Column:
    """Whether two strings are within the edits that the shorter one is allowed."""
    most = allowed(F.least(F.length(a), F.length(b)), edits, share)
    choice = F.when(most == edits, within(a, b, edits))
    for fewer in range(1, edits):
        choice = choice.when(most == fewer, within(a, b, fewer))
    return choice.otherwise(F.lit(False))


_PLACE = ("no_id", "id", "k1", "k2", "pos")


def _rows(docs: DataFrame, id_column: str, text_column: str, also: tuple[str, ...]) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in also]) if also else F.lit(None).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), rest.alias("rest"))
    k1, k2 = content_key("doc_id", "text")
    return rows.select("doc_id", "text", "rest", F.coalesce("doc_id", F.lit(0)).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col("doc_id").isNull().alias("no_id"))


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def line_dedup(docs: DataFrame, edits: int = EDITS, share: int = SHARE, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_near, kept`` and the columns ``also`` for every row.

    ``n_lines`` counts all lines, ``n_removed`` those that went, ``n_near`` those
    of them that no equal line came before; ``kept`` is the text left.
    """
    rows = _rows(docs, id_column, text_column, also)
    texts = rows.select("k1", "k2", "text")

    # 1. The first place of every line.
    each = rows.select(*_PLACE[:-1], F.posexplode(_lines()).alias("pos", "line")).where(F.length(F.trim("line")) > 0)
    each = each.select(*_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("n"))
    firsts = each.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("at"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    firsts = stored(firsts, "lines-first")
    more = firsts.where("c > 1").select("h1", "h2", "at")
    copies = each.join(more, ["h1", "h2"]).where(F.struct(*_PLACE) != F.col("at")).select("k1", "k2", "pos", F.lit(0).alias("near"))

    # 2. Segments and probes of the first copies that are allowed an edit.
    wanted = firsts.where(F.col("n") >= share).groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.pos", "h1")).alias("places"))

    def lines_at(places: DataFrame, *also: str) -> DataFrame:
        held = texts.join(places, ["k1", "k2"]).select(_lines().alias("all"), "places")
        one = held.select(F.inline(F.transform("places", lambda p: F.struct(p["h1"].alias("h1"), *[p[c].alias(c) for c in also], F.get("all", p["pos"]).alias("line")))))
        return one.distinct() if also else one

    longer = lines_at(wanted).withColumn("n", F.length("line"))
    keys = longer.select("h1", F.inline(_keys(F.col("line"), F.col("n"), edits, share)))
    keys = stored(keys, "lines-keys")
    own, probe = keys.where("own").select("key", "h1"), keys.where("NOT own").select("key", F.col("h1").alias("a"))
    # A repeated row gives its lines again: they count once.
    index = own.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    index = stored(index.withColumn("lines", F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.col("lines"))), "lines-index")
    met = probe.join(index.hint("shuffle_hash"), "key").where("lines > 1 OR lo <> a")
    met = stored(met, "lines-met")
    few = met.where("lines <= 2").select("a", F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    few = few.unionByName(index.where("lines = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    # Keys of more lines: all that have or probe one meet those that have it.
    held = stored(own.join(index.where("lines > 2").select("key", "lines"), "key").distinct(), "lines-members")
    discard(keys)
    members = held.select("key", F.col("h1").alias("a"), "lines", F.lit(True).alias("own"))
    many = members.unionByName(met.where("lines > 2").select("key", "a", "lines", F.lit(False).alias("own")).distinct())
    mine = lambda df: df.where("own").select(F.col("key").alias("k"), F.col("a").alias("b"), *[F.col(c).alias("theirs") for c in df.columns if c == "sign"])
    apart = (F.col("key") == F.col("k")) & (F.col("a") != F.col("b"))
    usual, crowd = many.where(F.col("lines") <= FREQUENT), many.where(F.col("lines") > FREQUENT)
    usual = usual.join(mine(usual), apart).select("a", "b")

    def located(ids: DataFrame, *also: str) -> DataFrame:
        """The lines of some hashes, with their places if wanted."""
        there = firsts.where(F.col("n") >= share).join(ids, "h1", "left_semi")
        return lines_at(there.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.pos", "h1", "at")).alias("places")), *also)

    crowded = stored(index.where(F.col("lines") > FREQUENT).select("key"), "lines-crowded")
    split = located(crowd.select(F.col("a").alias("h1")).distinct())
    split = split.select(F.col("h1").alias("a"), "line", signature(F.col("line")).alias("sign"))
    split = split.select("a", "sign", F.inline(_further_keys(F.col("line"), F.length("line"), edits, share)))
    crowd = split.join(crowded, "key", "left_semi").select(F.col("more").alias("key"), "a", "own", "sign")
    crowd = stored(crowd.distinct(), "lines-crowd")
    sifted = crowd.join(mine(crowd), apart & may_be_near(F.col("sign"), F.col("theirs"), edits)).select("a", "b")
    every = few.unionByName(usual).unionByName(sifted).where("a <> b")
    pairs = stored(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lines-pairs")
    discard(index, met, held, crowd, crowded)

    # 3. Verify on the texts of the lines that are in a pair.
    side = located(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "at")
    left, right = (side.select(F.col("h1").alias(c), F.col("at").alias(f"{c}_at"), F.col("line").alias(f"{c}_line")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a_at", "b_at", F.col("a_line").alias("a"), F.col("b_line").alias("b"))
    later = both.where(near_copies(F.col("a"), F.col("b"), edits, share)).select(F.greatest("a_at", "b_at").alias("at")).distinct()
    close = stored(later.select("at.k1", "at.k2", "at.pos", F.lit(1).alias("near")), "lines-near")
    discard(pairs)

    # 4. Drop.
    drops = copies.unionByName(close).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "near")).alias("drops"))
    held = rows.join(drops, ["k1", "k2"], "left").select("doc_id", "rest", _lines().alias("all"), F.coalesce("drops", F.array().cast("array<struct<pos:int,near:int>>")).alias("drops"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.transform("drops", lambda d: d["pos"]))
    return held.select(
        "doc_id",
        F.size("all").cast("long").alias("n_lines"),
        F.size("drops").cast("long").alias("n_removed"),
        F.size(F.filter("drops", lambda d: d["near"] == 1)).cast("long").alias("n_near"),
        F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n").alias("kept"),
        *[F.col(f"rest.{c}").alias(c) for c in also],
    )
