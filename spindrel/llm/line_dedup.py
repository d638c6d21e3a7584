"""Fuzzy line dedup by MinHash, in DataFrame operations alone.

Lines are trimmed and lower-cased; a line's shingles are the ``SHINGLE`` characters (units of
UTF-16) from every position, a shorter line is one shingle.  Each of ``BANDS * ROWS`` signature
values is the least of the shingles' hashes under its own mask; ``ROWS`` values are one band.
Lines that share a band are candidates, compared by the exact Jaccard similarity of their whole
shingle sets.  Links of ``threshold`` or more are joined by distributed union-find, and one line
of each component stays: the first by doc_id (null last) and place.

Every pair of a band is compared, but for pairs that are connected already: bands of up to
``SMALL`` lines at once; in larger ones each line first with its neighbours and the band's first,
then all pairs of different components, block by block.  With 5 bands of 2 rows a pair at
similarity 0.8 shares a band with a chance of 0.994; banding is the approximate step.

For speed a line is cut into stretches of ``STRETCH`` positions, one generated row each, whose
hashes and minima are plain columns that compile; a hash aggregate takes the minima of a line.
The text is read once for the minima and once more for the lines that share a band or stand more than
once: these are found by a bitmap of their hashes that is sent to all tasks, and written with their
places; of the text only lines that share a band are moved.  Lines count as equal by 128 bits of hash.  Equal lines are collapsed with map-side
combining before anything else, so a line in a third of all documents is one row.

Edge cases: blank lines are no lines to compare and all stay; null and empty texts have no
lines; wholly equal rows (id and text) count as one document and get one result each; ids may
be whole numbers or text; empty tables give empty results; :func:`deduplicate` keeps the columns
of the input whatever their names, and drops documents that had lines and lose all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.llm.common import id_key, written
from spindrel.llm.components import components

SHINGLE, STRETCH = 12, 16
BANDS, ROWS = 5, 2
#: Lines of a band that are compared at once, and lines of a larger band in a block.
SMALL, BLOCK = 32, 2048
#: Words of bins, of which all pairs are compared first.
BINS = 32
#: Of a large band: the words of parities that are compared first, and then, of lines of over
#: ``LONG`` shingles, the least hashes.
WORDS, LONG, SKETCH = 16, 1024, 64
#: The bitmap of the lines to read again: bits a line, bits in a row, bits in all at most (64 MB;
#: with more lines it lets more pass that the join behind it leaves out).
MARKS, PAGE, MOST = 32, 1 << 13, 1 << 29
_BLANK = " \t\n\x0b\x0c\r"
#: One mask a signature value: the least of ``hash ^ mask`` is a random choice of its own.
_MASKS = [int(x) for x in np.random.default_rng(5).integers(-(1 << 31), 1 << 31, BANDS * ROWS)]
#: A document: whether its id is null, the id, a hash of the text; a place: a line of it.
_DOC = ["k0", "k1", "k2"]
_PLACE = [*_DOC, "pos"]


def _doc_keys(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").isNull().alias("k0"), id_key(docs).alias("k1"), F.xxhash64("text").alias("k2")]


def _keys(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(*_doc_keys(docs), "text")


def _norm(line: Column) -> Column:
    # Trimming reads all of a line, so only lines with a blank at an end are trimmed.
    ends = reduce(or_, [end for c in _BLANK for end in (line.startswith(c), line.endswith(c))])
    return F.lower(F.when(ends, F.btrim(line, F.lit(_BLANK))).otherwise(line))


def _units(norm: Column) -> Column:
    """Two bytes a character, so that a position is found without reading what is before it."""
    return F.encode(norm, "UTF-16BE")


def _last(units: Column) -> Column:
    """The byte, from 1, at which the last shingle begins."""
    return F.greatest(F.octet_length(units) - 2 * SHINGLE + 1, F.lit(1))


def _shingle(units: Column, at: Column) -> Column:
    return F.substring(units, at, F.lit(2 * SHINGLE))


def _ring(units: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), _last(units), F.lit(2)), lambda at: F.xxhash64(_shingle(units, at)))


def shingles(units: Column) -> Column:
    """The hashes of a line's shingles, repeats included."""
    # Held by a lambda, the bytes are not copied out of their row for every position.
    return F.transform(F.array(units), _ring)[0]


def _lines(docs: DataFrame) -> DataFrame:
    """(k0, k1, k2, pos, norm, h1, h2): the lines that are not blank and their hashes."""
    lines = _keys(docs).select(*_DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(*_PLACE, _norm(F.col("line")).alias("norm")).where("norm <> ''")
    return lines.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(1), "norm")})


def _stretches(lines: DataFrame, known: list[str]) -> DataFrame:
    """(known, at, s0, ...): the hashes of the shingles of ``norm``, ``STRETCH`` a row."""
    cut = lines.select(*known, _units(F.col("norm")).alias("units"))
    cut = cut.withColumn("last", _last(F.col("units"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STRETCH))))
    # Behind the last shingle it is taken again, which changes no minimum and no set.
    return cut.select(*known, "at", *[F.hash(_shingle(F.col("units"), F.least(F.col("at") + 2 * i, F.col("last")))).alias(f"s{i}") for i in range(STRETCH)])


def signed(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, b0, ...): one row per distinct line; n: how often it stands, its bands."""
    hashed = _stretches(_lines(docs), ["h1", "h2"])
    least = hashed.select("h1", "h2", "at", *[F.least(*[F.col(f"s{i}").bitwiseXOR(F.lit(mask)) for i in range(STRETCH)]).alias(f"m{r}") for r, mask in enumerate(_MASKS)])
    begun = F.sum(F.when(F.col("at") == 1, F.lit(1)).otherwise(F.lit(0))).alias("n")
    least = least.groupBy("h1", "h2").agg(begun, *[F.min(f"m{r}").alias(f"m{r}") for r in range(len(_MASKS))])
    return least.select("h1", "h2", "n", *[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]).alias(f"b{b}") for b in range(BANDS)])


def places(docs: DataFrame) -> DataFrame:
    """(k0, k1, k2, pos, h1, h2, b0, ...): the lines that are not blank, their hashes and bands."""
    return _lines(docs).drop("norm").join(signed(docs).drop("n"), ["h1", "h2"])


def distinct_lines(found: DataFrame) -> DataFrame:
    """(h1, h2, bands): one row per distinct line of ``places`` or ``signed``."""
    bands = [f"b{b}" for b in range(BANDS)]
    return found.groupBy("h1", "h2").agg(*[F.first(b).alias(b) for b in bands]).select("h1", "h2", F.array_distinct(F.array(*bands)).alias("bands"))


def _buckets(distinct: DataFrame) -> DataFrame:
    """(node, band, k, others): lines of bands with k > 1; others: the lines to compare first.

    These are all earlier lines of a band of up to ``SMALL`` lines, and of a larger one the two
    before and the first.
    """
    order = Window.partitionBy("band").orderBy("node")
    every = distinct.select("node", F.explode(F.array_distinct(F.array(*[f"b{b}" for b in range(BANDS)]))).alias("band"))
    shared = every.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("k > 1")
    shared = shared.withColumns({"before": F.collect_list("node").over(order.rowsBetween(1 - SMALL, -1)), "b0": F.first("node").over(order)})
    chain = F.array_except(F.array_union(F.slice("before", F.greatest(F.size("before") - 1, F.lit(1)), 2), F.array("b0")), F.array("node"))
    return shared.select("node", "band", "k", F.when(F.col("k") <= SMALL, F.col("before")).otherwise(chain).alias("others"))


def _marked(lines: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Of ``lines`` all that have an h1 of the ``n`` rows of ``wanted``, and few others."""
    bits = PAGE * max(1, min(MARKS * n, MOST) // PAGE)
    slot = F.pmod(F.col("h1"), F.lit(bits).cast("bigint"))
    page, word, bit = F.floor(slot / PAGE), F.floor(slot % PAGE / 64).cast("int"), (slot % 64).cast("int")
    set_ = wanted.select(page.alias("page"), word.alias("word"), bit.alias("bit")).groupBy("page", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    pages = set_.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    pages = pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE // 64 - 1)), lambda w: F.coalesce(F.col("set")[w], F.lit(0).cast("bigint"))).alias("words"))
    here = (page == F.col("page")) & (F.getbit(F.get("words", word), bit) == 1)
    return lines.join(F.broadcast(pages), here, "left_semi")


def _similar(one: Column, two: Column, threshold: float) -> Column:
    """Whether two arrays of shingles, of n_a and n_b distinct ones, are similar."""
    return F.exists(F.array(F.size(F.array_intersect(one, two))), lambda s: s >= threshold * (F.col("n_a") + F.col("n_b") - s))


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): of the pairs (a, b, n_a, n_b, norm_a, norm_b), n with repeats, those of similar sets.

    Where the sets would be similar even if nothing were repeated, their sizes need not be known.
    What is generated is made once, whatever asks for it.
    """
    once = lambda df, value, name: df.select("*", F.explode(F.array(value)).alias(name))
    both = once(pairs, F.struct(*[shingles(_units(F.col(f"norm_{x}"))).alias(x) for x in "ab"]), "sets").drop("norm_a", "norm_b")
    both = once(both, F.size(F.array_intersect("sets.a", "sets.b")), "s")
    enough = lambda size: F.col("s") >= threshold * (size - F.col("s"))
    exact = F.size(F.array_distinct("sets.a")) + F.size(F.array_distinct("sets.b"))
    return both.where(enough(F.col("n_a") + F.col("n_b")) | enough(exact)).select("a", "b")


def _sizes(threshold: float) -> Column:
    return (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))


def _possible(threshold: float) -> Column:
    """Whether the least hashes (sketch_a, sketch_b) leave open that sets of n_a and n_b are similar.

    The sketch that ends first lies within the range of the other, so what it has alone the other
    set has not; of similar sets x and y, x has at most (n_x - threshold n_y) / (1 + threshold) alone.
    """
    common = F.size(F.array_intersect("sketch_a", "sketch_b"))
    end = lambda x: F.when(F.col(f"n_{x}") > SKETCH, F.element_at(f"sketch_{x}", -1)).otherwise(F.lit((1 << 63) - 1))
    open_ = lambda x, y: F.size(f"sketch_{x}") - common <= (F.col(f"n_{x}") - threshold * F.col(f"n_{y}")) / (1 + threshold) + 1e-6
    return F.when(end("a") <= end("b"), open_("a", "b")).otherwise(open_("b", "a"))


def _bins(texts: DataFrame) -> DataFrame:
    """(node, n, x0, ...): n: the positions of ``norm``; which of 64 * ``BINS`` bins hold a shingle.

    Repeats change nothing, so no set is made; of very long lines most bins hold one.  A stretch's
    bits are put together in compiled columns, so a position is no row of its own.
    """
    lines = texts.withColumn("n", F.floor((_last(_units(F.col("norm"))) + 1) / 2).cast("int"))
    each = _stretches(lines, ["node", "n"])
    word = [F.col(f"s{i}").bitwiseAND(BINS - 1).alias(f"w{i}") for i in range(STRETCH)]
    bit = [F.expr(f"shiftleft(1L, shiftright(s{i}, {BINS.bit_length() - 1}))").alias(f"t{i}") for i in range(STRETCH)]
    held = lambda w: reduce(Column.bitwiseOR, [F.when(F.col(f"w{i}") == w, F.col(f"t{i}")).otherwise(F.lit(0).cast("bigint")) for i in range(STRETCH)])
    return each.select("node", "n", *word, *bit).groupBy("node", "n").agg(*[F.bit_or(held(w)).alias(f"x{w}") for w in range(BINS)])


def _parities(nodes: DataFrame) -> DataFrame:
    """(node, x0, ...): of the distinct shingles of ``units``, which of 64 * ``WORDS`` bins hold an odd number."""
    each = nodes.select("node", F.explode(F.array_distinct(shingles(F.col("units")))).alias("h"))
    bit = each.select("node", F.col("h").bitwiseAND(WORDS - 1).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {WORDS.bit_length() - 1}) & 63))").alias("bit"))
    return bit.groupBy("node").agg(*[F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"x{w}") for w in range(WORDS)])


def _near(threshold: float, words: int = WORDS, x: str = "x") -> Column:
    """Whether the parities or bins (x0_a, x0_b, ...; ``x`` names them) leave open that sets of n_a and n_b, or fewer, are similar.

    A bin of different parity, or that one set has alone, holds a shingle that one set has alone;
    of similar sets at most (n_a + n_b) (1 - threshold) / (1 + threshold) shingles are in one alone.
    """
    differ = reduce(add, [F.bit_count(F.col(f"{x}{w}_a").bitwiseXOR(F.col(f"{x}{w}_b"))) for w in range(words)])
    return differ <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _rest(buckets: DataFrame, texts: DataFrame, bins: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the links within large bands that ``found`` does not connect.

    A band's lines are dealt to blocks; each pair of blocks is compared by itself, within the
    join, so that only links leave it.  Lines that share several large bands are compared in the
    least of these.  Whole shingle sets are compared unless the bins of both, or of long lines the
    parities or the ``SKETCH`` least hashes, already show that they cannot be similar; no link is
    lost by that.
    The sets are made from the lines where they are compared: they are several times as large, and
    adaptive execution would split the join by their bytes, on both sides at once.
    """
    large = buckets.where(F.col("k") > SMALL).select("node", "band", "k")
    large = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = large.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band")
    large = written(large.join(mixed, "band", "left_semi"), "line-large")
    lines = texts.join(large.groupBy("node").agg(F.collect_set("band").alias("bands")), "node").select("node", "bands", _units(F.col("norm")).alias("units"))
    lines = written(lines.withColumn("n", F.size(F.array_distinct(shingles(F.col("units"))))), "line-texts-large")
    sketch = F.when(F.col("n") > LONG, F.slice(F.sort_array(F.array_distinct(shingles(F.col("units")))), 1, SKETCH))
    odd = _parities(lines.where(F.col("n") > LONG))
    lines = lines.join(bins.select("node", *[F.col(f"x{w}").alias(f"y{w}") for w in range(BINS)]), "node").join(odd, "node", "left").withColumn("sketch", sketch)
    dealt = large.join(lines, "node").withColumn("m", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", *[f"y{w}" for w in range(BINS)], *[f"x{w}" for w in range(WORDS)], "sketch", "bands", "units")]
    left = dealt.select("band", F.col("s").alias("i"), F.explode(F.sequence("s", F.col("m") - 1)).alias("j"), *side("a"))
    right = dealt.select("band", F.explode(F.sequence(F.lit(0), F.col("s"))).alias("i"), F.col("s").alias("j"), *side("b"))
    open_ = (F.col("component_a") != F.col("component_b")) & ((F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b")))
    here = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")
    long_ = F.col("sketch_a").isNull() | F.col("sketch_b").isNull() | (_near(threshold) & _possible(threshold))
    alike = _similar(shingles(F.col("units_a")), shingles(F.col("units_b")), threshold)
    both = left.join(right, ["band", "i", "j"]).where(open_ & _sizes(threshold) & _near(threshold, BINS, "y") & here & long_ & alike)
    return both.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct()


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` after ``more``, (node, component) of linked components, single nodes among them."""
    moved = found.join(more.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return moved.unionByName(more.join(found, "node", "left_anti"))


def classes(buckets: DataFrame, texts: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """(node, component) of the lines that have a link; a link: shingle sets at least that similar."""
    pairs = buckets.select(F.col("node").alias("a"), F.explode("others").alias("b")).distinct()
    bins = written(_bins(texts), "line-bins")
    # Only lines whose bins leave it open that they are similar meet whole.
    side = lambda x: bins.toDF(x, *[f"{c}_{x}" for c in bins.columns[1:]])
    open_ = pairs.join(side("b"), "b").join(side("a"), "a").where(_near(threshold, BINS)).select("a", "b", "n_a", "n_b")
    both = open_.join(texts.toDF("b", "norm_b"), "b").join(texts.toDF("a", "norm_a"), "a")
    found = components(_alike(both, threshold))
    if not buckets.where(F.col("k") > SMALL).isEmpty():
        more = written(_rest(buckets, texts, bins, found, threshold), "line-links")
        found = found if more.isEmpty() else _joined(found, components(more))
    return found


def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """(k0, k1, k2, removed) of the documents that lose any line."""
    # Once written, the numbers of the lines are fixed.
    distinct = written(signed(docs).withColumn("node", F.monotonically_increasing_id()), "lines")
    buckets = written(_buckets(distinct), "line-buckets")
    # Only lines that stand more than once or share a band can go: these are read again, once.
    shared = buckets.select("node", F.lit(True).alias("shared")).distinct()
    wanted = distinct.select("node", "h1", "h2", "n").join(shared, "node", "left").where("shared or n > 1")
    wanted = written(wanted, "line-wanted")
    every = written(_marked(_lines(docs).select(*_PLACE, "h1", "h2", "norm"), wanted, wanted.count()), "line-places")
    near = wanted.where("shared").select("h1", "h2", "node")
    texts = _marked(every.select("h1", "h2", "norm"), near, near.count()).groupBy("h1", "h2").agg(F.first("norm").alias("norm"))
    texts = written(texts.join(near, ["h1", "h2"]).select("node", "norm"), "line-texts")
    found = classes(buckets, texts, threshold=threshold)
    # The lines that stand more than once, or that have a link; of each class of them one place stays.
    classed = wanted.select("node", "h1", "h2", "n").join(found, "node", "left").where("component is not null or n > 1")
    kin = written(every.select(*_PLACE, "h1", "h2").join(classed.select("h1", "h2", F.coalesce("component", "node").alias("class")), ["h1", "h2"]).select(*_PLACE, "class"), "line-kin")
    stays = written(kin.groupBy("class").agg(F.min(F.struct(*_PLACE)).alias("stays")), "line-stays")
    gone = kin.join(stays, "class").where(F.struct(*_PLACE) != F.col("stays"))
    return gone.groupBy(*_DOC).agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def removed_lines(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), n_removed, removed (places of lines from 0)."""
    removed = _judged(docs, threshold)
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(_BLANK)) != "")
    rows = docs.select("doc_id", *_doc_keys(docs), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint").alias("n_lines"))
    found = rows.join(removed, _DOC, "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def deduplicate(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The documents without the lines that go; those that lose all their lines are dropped."""
    names = docs.columns
    safe = docs.toDF(*[c if c in ("doc_id", "text") else f"given {c}" for c in names])
    removed = _judged(safe.select("doc_id", "text"), threshold)
    found = safe.select("*", *_doc_keys(safe)).join(removed, _DOC, "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i))
    found = found.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    found = found.where(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*[F.col(c if c in ("doc_id", "text") else f"`given {c}`").alias(c) for c in names])
