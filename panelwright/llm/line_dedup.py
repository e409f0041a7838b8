"""Fuzzy line dedup as DataFrame operations: MinHash signatures, banding, exact Jaccard, union-find."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.llm.runtime import checkpoint

#: Characters in a shingle, and the Jaccard similarity (as a fraction) from which lines are duplicates.
SHINGLE, SIMILAR = 8, (4, 5)
#: 16 MinHash lanes in a 4 x 4 grid. Bands are its rows, columns and xor-diagonals: 12 bands of 4
#: lanes, of which two share one lane at most. Lines at similarity 0.8 meet in some band with
#: probability 0.99, at 0.9 in all but 1 of 100,000 cases.
LANES = 16
BANDS = [[4 * i + j for j in range(4)] for i in range(4)] + [[4 * i + j for i in range(4)] for j in range(4)] + [[4 * i + (i ^ j) for i in range(4)] for j in range(4)]
#: Shingles that one row of the signature aggregate holds, and longs in a line's sketch (64 cells each).
STRIDE, SKETCH = 6, 16
#: Rows up to which a side is broadcast (8 to 60 bytes each); beyond that the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Buckets with up to this many lines outside their largest proven group are tried in all pairs that aren't linked yet; others are split by shingles first.
PAIRED = 2048
#: Where buckets hold more than so many pairs of lines that aren't linked yet for each of their lines, groups are merged along pivots first.
CROWDED = 64
#: Pivots of a bucket: lines of its most frequent root, and of the others; so many of those that a line differs from least are verified.
PIVOTS, NEAREST = (2, 4), 4


def _salt(lane: int) -> int:
    """A lane's xor mask: its own leading bits, so that lanes look at different parts of the hash range."""
    mask = (lane << 28) | ((0x9E3779B1 * (lane + 1) * (lane + 1)) & 0x0FFFFFFF)
    return mask - (1 << 32) if mask >= 1 << 31 else mask


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds ``_key`` (orders documents: the id, or a hash for other types and null), ``_hash`` and ``_lines``."""
    other = F.xxhash64(F.col(doc_id), F.col(text))
    key = F.coalesce(F.col(doc_id).cast("long"), other) if dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint") else other
    return docs.select("*", key.alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.split(F.col(text), "\n", -1).alias("_lines"))


def _line_hash(norm: str) -> Column:
    return F.xxhash64(norm)


def _lines(keyed: DataFrame) -> DataFrame:
    """Every line with a visible character: ``(_key, _hash, pos, norm, line)``, ``line`` a hash of its comparison form."""
    each = keyed.select("_key", "_hash", F.posexplode("_lines").alias("pos", "raw"))
    norm = each.select("_key", "_hash", "pos", F.lower(F.trim("raw")).alias("norm")).where("norm <> ''")
    return norm.withColumn("line", _line_hash("norm"))


def _shingle(wide: Column, place: Column) -> Column:
    """The shingle at a 1-based place of a line in two-byte characters."""
    return F.substring(wide, 2 * place - 1, 2 * SHINGLE)


def _places(wide: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(wide) / 2).cast("int") - F.lit(SHINGLE - 1)))


def _hashes(wide: Column) -> Column:
    """The shingles of a line in two-byte characters, as 64-bit hashes, repeats included.

    The line is the variable of an outer lambda: a column would be copied whole for each shingle.
    """
    return F.transform(F.array(wide), lambda line: F.transform(_places(line), lambda p: F.xxhash64(_shingle(line, p))))[0]


def _set_of(wide: Column) -> Column:
    return F.array_distinct(_hashes(wide))


def _signed(lines: DataFrame) -> DataFrame:
    """A row per distinct line: its lanes ``m0``.., ``keeper`` (the smallest document key) and ``copies``.

    Lines are told apart by ``line`` and ``proof``, a second hash of 64 bits. Every row of the
    aggregate holds ``STRIDE`` shingles, of which each lane takes the least first.
    """
    wide = lines.select("line", _proof().alias("proof"), "_key", F.encode("norm", "UTF-16BE").alias("wide"))
    wide = wide.select("*", F.greatest(F.lit(1), (F.octet_length("wide") / 2).cast("int") - F.lit(SHINGLE - 1)).alias("held"))
    each = wide.select("line", "proof", "_key", "wide", "held", F.explode(F.sequence(F.lit(1), F.col("held"), F.lit(STRIDE))).alias("place"))
    at = [F.least(F.col("place") + j, F.col("held")) if j else F.col("place") for j in range(STRIDE)]  # behind the last one, the last again
    each = each.select("line", "proof", "_key", "place", *[F.hash(_shingle(F.col("wide"), p)).alias(f"h{j}") for j, p in enumerate(at)])
    lanes = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(_salt(i))) for j in range(STRIDE)])).alias(f"m{i}") for i in range(LANES)]
    return each.groupBy("line", "proof").agg(*lanes, F.min("_key").alias("keeper"), F.count_if(F.col("place") == 1).alias("copies"))


def _proof(seed: int = 1) -> Column:
    return F.xxhash64("norm", F.lit(seed))


def told_apart(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` with a ``line`` that no two different texts share, and their ``_signed`` rows, written.

    Texts whose first hash is another text's too take a further one. Of ``n`` distinct lines about
    ``n * n / 2 ** 65`` do, 270 of 10 ** 11, so that their hashes fit a condition.
    """
    seed = 1
    while True:
        signed = checkpoint(_signed(lines))
        shared = [r[0] for r in signed.groupBy("line").count().where("count > 1").select("line").collect()]
        if not shared:
            return lines, signed
        seed += 1
        lines = lines.withColumn("line", F.when(F.col("line").isin(shared), _proof(seed)).otherwise(F.col("line")))


def _banded(signed: DataFrame) -> DataFrame:
    """``(line, band)``: the 12 buckets of every distinct line, as hashes of a band's number and its lanes."""
    return signed.select("line", F.explode(F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in lanes]) for b, lanes in enumerate(BANDS)])).alias("band"))


def _bands(lines: DataFrame) -> DataFrame:
    return _banded(_signed(lines))


def _members(signed: DataFrame) -> DataFrame:
    """``(band, line, head)``: the lines of every bucket that has two or more, with the smallest of them."""
    ends = _banded(signed).groupBy("band").agg(F.min("line").alias("head"), F.max("line").alias("last"))
    shared = checkpoint(ends.where("head < last").drop("last"))
    return checkpoint(_banded(signed).join(_sized(shared, shared.count()), "band").select("band", "line", "head"))


def _occurrences(lines: DataFrame, signed: DataFrame, members: DataFrame) -> DataFrame:
    """``(_key, _hash, pos, line, norm)`` of all lines that occur twice or share a bucket; ``norm`` is null but for the latter in the document that keeps them."""
    shared = members.select("line", F.lit(True).alias("shared")).distinct()
    wanted = checkpoint(signed.select("line", "keeper", "copies").join(shared, "line", "left").where("copies > 1 or shared").select("line", "keeper", "shared"))
    met = lines.select("_key", "_hash", "pos", "line", "norm").join(_sized(wanted, 2 * wanted.count()), "line")
    return checkpoint(met.select("_key", "_hash", "pos", "line", F.when(F.col("shared") & (F.col("_key") == F.col("keeper")), F.col("norm")).alias("norm")))


def _bodies(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(line, norm)`` of the lines in ``wanted``, which is checkpointed and holds each once."""
    return lines.select("line", "norm").join(_sized(wanted, wanted.count()), "line", "left_semi").distinct()


def _sketched(bodies: DataFrame) -> DataFrame:
    """``(line, n, s0, ..)``: how many distinct shingles a line has, and for each of 1,024 cells whether it holds an odd number of them."""
    each = bodies.select("line", F.explode(_set_of(F.encode("norm", "UTF-16BE"))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    word = F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH - 1))
    cells = each.select("line", bit.alias("bit"), word.alias("word"))
    return cells.groupBy("line").agg(F.count("*").cast("int").alias("n"), *[F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(SKETCH)])


def _apart(a: str, b: str) -> Column:
    """At least so many shingles are in one of two lines alone: each of them turns one cell, and sizes differ by no more."""
    turned = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return F.greatest(F.abs(F.col(f"{a}n") - F.col(f"{b}n")), turned)


def _may_be_alike(a: str, b: str) -> Column:
    """False only for lines that can't be alike: of ``s`` shingles in two sets, ``d`` in one alone, J = (s - d) / (s + d)."""
    over, under = SIMILAR
    return _apart(a, b) * (under + over) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (under - over)


def _named(sketches: DataFrame, prefix: str, line: str) -> DataFrame:
    return sketches.select(F.col("line").alias(line), *[F.col(c).alias(f"{prefix}{c}") for c in sketches.columns if c != "line"])


def _alike(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose whole shingle sets, of ``sum`` shingles together, are similar enough."""
    u, v = (bodies.select(F.col("line").alias(x), F.col("norm").alias(f"norm_{x}")) for x in "uv")
    met = pairs.select("u", "v", "sum").join(u, "u").join(v, "v")
    both = F.size(F.array_intersect(_hashes(F.encode("norm_u", "UTF-16BE")), _hashes(F.encode("norm_v", "UTF-16BE"))))
    over, under = SIMILAR
    # A generator keeps the optimizer from moving the count into the condition, where it would be made twice.
    counted = met.select("u", "v", "sum", F.inline(F.array(F.struct(both.alias("both")))))
    return counted.where(F.col("both") * under >= (F.col("sum") - F.col("both")) * over).select("u", "v")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1.05))).cast("int")


def _prefix_keys(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(key, line, root, n)``: large buckets' rows ``(band, line, root)`` under keys of which two lines that are alike share one.

    Sets of ``n`` and ``m`` shingles that are alike share ``t = ceil(4 (n + m) / 9)`` of them, so in
    any one order of shingles they share one among the first ``n - t + 1`` and ``m - t + 1``. The
    order is by how many lines of the bucket have a shingle, rarest first. A key is the bucket, such
    a shingle, and both lines' size classes (5 % wide), which keep these prefixes short.
    """
    each = rows.join(sets, "line").select("band", "line", "root", "n", F.explode("shingles").alias("h"))
    often = each.groupBy("band", "h").agg(F.count("*").alias("often"))
    placed = each.join(often, ["band", "h"])
    ordered = placed.groupBy("band", "line", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("order"))
    least, most = F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]), F.floor(F.col("n") * SIMILAR[1] / SIMILAR[0])
    mine = ordered.withColumn("mine", _size_class(F.col("n"))).withColumn("theirs", F.explode(F.sequence(_size_class(least), _size_class(most))))
    low = F.greatest(least, F.ceil(F.pow(F.lit(1.05), F.col("theirs"))) - 1)  # one less than the class's least size, for rounding
    shared = F.ceil((F.col("n") + low) * SIMILAR[0] / sum(SIMILAR))
    prefix = F.slice("order", F.lit(1), F.greatest(F.lit(1), F.col("n") - shared + 1).cast("int"))
    keyed = mine.select("band", "line", "root", "n", "mine", "theirs", F.explode(prefix).alias("s")).where("s.often > 1")
    return keyed.select(F.xxhash64("band", "s.h", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("key"), "line", "root", "n")


def _across(keyed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of lines under one key that have different roots, ``a`` and ``b``, and may be alike.

    The lines of a key's most frequent root are only met by others, so that a large group which is
    proven alike isn't paired with itself; at most twice the wanted pairs are looked at.
    """
    held = keyed.groupBy("key", "root").agg(F.count("*").alias("held"))
    main = checkpoint(held.groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots"))
    rows = checkpoint(keyed.select("key", "line", "root").join(main, "key").join(sketches, "line"))
    cells = [c for c in sketches.columns if c != "line"]
    a = rows.where("root <> main").select("key", F.col("line").alias("p"), F.col("root").alias("root_p"), *[F.col(c).alias(f"a{c}") for c in cells])
    b = rows.select("key", F.col("line").alias("q"), F.col("root").alias("root_q"), "main", *[F.col(c).alias(f"b{c}") for c in cells])
    met = a.join(b, "key").where((F.col("root_p") != F.col("root_q")) & ((F.col("root_q") == F.col("main")) | (F.col("p") < F.col("q"))) & _may_be_alike("a", "b"))
    found = met.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), F.least("root_p", "root_q").alias("a"), F.greatest("root_p", "root_q").alias("b"), (F.col("an") + F.col("bn")).alias("sum"), _apart("a", "b").alias("apart"))
    return found.distinct()


def _first_links(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(u, v, sum)``: every line with that head of its buckets which it differs from least, if they may be alike."""
    met = members.where("line <> head").select("line", "head").distinct().join(_named(sketches, "a", "line"), "line").join(_named(sketches, "b", "head"), "head")
    near = met.where(_may_be_alike("a", "b")).select("line", "head", _apart("a", "b").alias("apart"), (F.col("an") + F.col("bn")).alias("sum"))
    best = near.groupBy("line").agg(F.min(F.struct("apart", "head", "sum")).alias("best"))
    return best.select(F.least("line", "best.head").alias("u"), F.greatest("line", "best.head").alias("v"), "best.sum").distinct()


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``(line, group)`` after the links ``(a, b)`` between groups, or lines that have none yet."""
    joined = checkpoint(connected_components(links, "a", "b").select(F.col("node").alias("group"), "component"))
    moved = groups.join(joined, "group", "left").select("line", F.coalesce("component", "group").alias("group"))
    return checkpoint(moved.unionByName(joined.select(F.col("group").alias("line"), F.col("component").alias("group"))).distinct())


def _mixed(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, bool]:
    """``(band, line, root, main, apart)``: lines of buckets with several roots, the most frequent of them and how many lines have another; whether pairs are many."""
    rooted = members.select("band", "line").join(groups, "line", "left").select("band", "line", F.coalesce("group", "line").alias("root"))
    roots = rooted.groupBy("band", "root").agg(F.count("*").alias("held"))
    mixed = roots.groupBy("band").agg(F.max_by("root", F.struct("held", "root")).alias("main"), (F.sum("held") - F.max("held")).alias("apart"), F.sum("held").alias("held"))
    mixed = checkpoint(mixed.where("apart > 0"))
    pairs, held = mixed.agg(F.sum(F.col("apart").cast("double") * F.col("held")), F.sum("held")).first()
    return checkpoint(rooted.join(mixed.drop("held"), "band")), (pairs or 0) > CROWDED * (held or 0)


def _pivoted(rooted: DataFrame, sketches: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between roots that share a bucket: each line is verified with the ``NEAREST`` pivots that it differs from least.

    Pivots are lines of each bucket that hashes pick: ``PIVOTS`` of its most frequent root and of
    the others. A line outside the most frequent root meets no more than these, so that the pairs
    grow with the lines, whatever their groups. Several links a line join in one turn what one link
    a root would join in many, each of which costs dozens of small stages.
    """
    main = F.col("root") == F.col("main")
    sides = [(side, i) for side, n in zip((main, ~main), PIVOTS, strict=True) for i in range(n)]
    chosen = [F.min_by(F.struct("line", "root"), F.when(side, F.xxhash64("line", F.lit(i)))) for side, i in sides]
    pivots = checkpoint(rooted.groupBy("band").agg(F.array(*chosen).alias("pivots")).select("band", F.inline("pivots")).toDF("band", "pivot", "root_q").distinct())
    others = rooted.where(~main).select("line", "root", "band")
    met = others.join(_sized(pivots, pivots.count()), "band").where(F.col("root") != F.col("root_q")).select("line", "root", "pivot", "root_q").distinct()
    near = met.join(_named(sketches, "a", "line"), "line").join(_named(sketches, "b", "pivot"), "pivot").where(_may_be_alike("a", "b"))
    pair = F.struct(_apart("a", "b").alias("apart"), F.least("line", "pivot").alias("u"), F.greatest("line", "pivot").alias("v"), (F.col("an") + F.col("bn")).alias("sum"), F.least("root", "root_q").alias("a"), F.greatest("root", "root_q").alias("b"))
    found = near.select("line", pair.alias("pair")).groupBy("line").agg(F.slice(F.sort_array(F.collect_set("pair")), 1, NEAREST).alias("pairs"))
    best = checkpoint(found.select(F.inline("pairs")).distinct())
    return checkpoint(_alike(best, bodies).join(best.select("u", "v", "a", "b"), ["u", "v"]).select("a", "b"))


def _rest(members: DataFrame, bodies: DataFrame, sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """``(line, group)`` after all pairs of a bucket that ``groups`` leaves apart have been verified too."""
    rooted, crowded = _mixed(members, groups)
    if crowded:
        groups = _merged(groups, _pivoted(rooted, sketches, bodies))
        rooted, _ = _mixed(members, groups)
    if not rooted.take(1):
        return groups
    keyed = rooted.where(F.col("apart") <= PAIRED).select(F.col("band").alias("key"), "line", "root")
    large = rooted.where(F.col("apart") > PAIRED)
    if large.take(1):
        sets = _bodies(bodies, checkpoint(large.select("line").distinct())).select("line", F.inline(F.array(F.struct(_set_of(F.encode("norm", "UTF-16BE")).alias("shingles")))))
        keyed = keyed.unionByName(_prefix_keys(large, checkpoint(sets.select("line", "shingles", F.size("shingles").alias("n")))).select("key", "line", "root"))
    pairs = checkpoint(_across(keyed, sketches))
    # The likeliest pair of every root goes first; what it joins needs no further pair.
    each = pairs.select(F.explode(F.array("a", "b")).alias("root"), F.struct("apart", "u", "v", "sum", "a", "b").alias("pair"))
    nearest = checkpoint(each.groupBy("root").agg(F.min("pair").alias("pair")).select("pair.*").distinct())
    near = checkpoint(_alike(nearest, bodies).join(nearest.select("u", "v", "a", "b"), ["u", "v"]).select("a", "b"))
    grown = checkpoint(connected_components(near, "a", "b"))
    a, b = (grown.select(F.col("node").alias(x), F.col("component").alias(f"new_{x}")) for x in "ab")
    left = pairs.join(nearest, ["u", "v"], "left_anti").join(a, "a", "left").join(b, "b", "left")
    left = checkpoint(left.where(F.coalesce("new_a", "a") != F.coalesce("new_b", "b")).select("u", "v", "sum", "a", "b"))
    far = _alike(left, bodies).join(left.select("u", "v", "a", "b"), ["u", "v"]).select("a", "b")
    return _merged(groups, near.unionByName(far))


def duplicate_lines(lines: DataFrame, signed: DataFrame) -> DataFrame:
    """``(line, group, keeper)`` for each line, of those that ``told_apart`` gives, that occurs twice or has a near duplicate.

    ``group`` is the smallest line hash of its component, ``keeper`` the smallest document key
    that holds any line of the component.
    """
    members = _members(signed)
    return _grouped(signed, members, _occurrences(lines, signed, members))


def _grouped(signed: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    bodies = checkpoint(seen.where("norm is not null").select("line", "norm").distinct())
    sketches = checkpoint(_sketched(bodies))
    # First every line is linked to the likeliest head of its buckets; then the pairs that this leaves apart are tried.
    links = checkpoint(_first_links(members, sketches))
    groups = connected_components(_alike(links, bodies)).select(F.col("node").alias("line"), F.col("component").alias("group"))
    groups = _rest(members, bodies, sketches, groups)

    member = signed.select("line", "keeper", "copies").join(groups, "line", "left").where("copies > 1 or group is not null")
    member = checkpoint(member.select("line", "keeper", F.coalesce("group", "line").alias("group")))
    # Written, so that the join deals plain rows and adaptive execution can split a group of very many lines.
    least = checkpoint(member.groupBy("group").agg(F.min("keeper").alias("first")))
    return member.join(_sized(least, least.count()), "group").select("line", "group", F.col("first").alias("keeper"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines (split at ``\\n``) are compared lower-cased and without outer blanks. Lines whose sets of
    8-character shingles (a shorter line is one shingle) have a Jaccard similarity of 0.8 or more
    link; of each connected component one line stays: the first in the document with the smallest
    id, so whole copies of a document empty the later copy, not both. Blank lines always stay.

    Candidates are all pairs of lines that meet in one of 12 bands of 4 MinHash lanes and that links
    found before don't join already; crowded buckets merge their groups along pivots before, large ones are
    split by an exact prefix filter. Sketches that
    bound from below how many shingles two lines don't share leave out pairs that can't be alike;
    every other candidate is verified on its whole shingle sets, and components are found by joins.
    Lines equal in their comparison form (by 128 bits of hashes) are one class from the start and
    pre-aggregated before they are shuffled.

    Null text stays null with 0 lines; empty text stays empty. Rows that repeat id and text are one
    document and keep the same lines; a null id orders by a hash. Long texts and lines are read
    whole, in memory in proportion to them. An empty table gives an empty one. Other columns pass through; the names ``_key``, ``_hash``, ``_lines``, ``_gone``,
    ``n_lines`` and ``n_dropped`` are taken by this operator and replaced if present.
    """
    mine = ["_key", "_hash", "_lines", "_gone", "n_lines", "n_dropped"]
    docs = docs.drop(*mine)
    columns = docs.columns
    keyed = _documents(docs, doc_id, text)
    lines, signed = told_apart(_lines(keyed))
    members = _members(signed)
    # One pass over the texts gives the lines that may be in a group, and where they are.
    seen = _occurrences(lines, signed, members)
    member = checkpoint(_grouped(signed, members, seen))
    seen = checkpoint(seen.drop("norm").join(_sized(member, 3 * member.count()), "line").drop("line"))
    first = checkpoint(seen.where("_key = keeper").groupBy("group").agg(F.min(F.struct("_hash", "pos")).alias("kept")))
    gone = seen.join(_sized(first, first.count()), "group").where("_key <> keeper or _hash <> kept._hash or pos <> kept.pos")
    gone = checkpoint(gone.groupBy("_key", "_hash").agg(F.collect_set("pos").alias("_gone")))
    held = gone.agg(F.count("*"), F.sum(F.size("_gone"))).first()
    joined = keyed.join(_sized(gone, (held[0] or 0) + (held[1] or 0) // 4), ["_key", "_hash"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda p: F.get("_lines", p)), "\n"))
    return joined.select(
        *[kept.alias(text) if c == text else F.col(c) for c in columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"),
    )
