"""Mixing sources to target weights, by a splitting tree of multivariate hypergeometric draws; built-in functions only.

A source is the stream of its documents' words, in an order by hash. It is cut into blocks of equally many words, at
most ``BLOCK`` and at most a 1024th of its target. A target of q blocks takes every block once or twice: visits 0 to
q - 1 run over the source's blocks in one random order for each pass. The numbers of visits of all sources are exact,
and a binary tree deals them to output shards: a node draws how many of its visits of each source go to its left half,
source after source from a hypergeometric distribution, and hands the rest to the right. So a shard's composition is as
if all visits of all sources had been shuffled, but no task sees them: a node is one row with one number a source. A
shard gets ranges of visits, disjoint by construction, finds their blocks by a permutation that needs no sort
(swap-or-not rounds), takes the documents in them and orders them by hash. All chance is hashing, so reruns agree.

The hypergeometric number is drawn by inversion outwards from the mode, over twelve standard deviations and 24 more, and
stays within its support in any case; quotas are exact whatever is drawn. Positions in a source are sums in two steps,
over buckets of some thousand documents and over buckets, so a source with most of the rows is no hot task.

Null texts have size 0; documents of size 0 are never taken. Sources are compared by code point, null is a source of its
own and the last; a source without words has target 0. Repeated rows are rows of their own, so that each of them may be
taken twice. Rows without a doc_id are mixed like others. An empty table gives no rows. Columns of ``documents`` other
than doc_id, source and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm.common import written
from anisomap.storage import written_with

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block and of an output shard, documents of a bucket, parts of a target that blocks must not exceed.
BLOCK, SHARD, BUCKET, FINE = 8192, 1 << 24, 4096, 1024
ROUNDS, LEVELS = 24, 8
SPACE = " \t\n\x0b\f\r"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(text: str) -> Column:
    whole = F.btrim(F.col(text), F.lit(SPACE))
    return F.when(F.coalesce(whole, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(whole, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _uniform(*by: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11) / F.lit(float(1 << 53))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20).cast("long")).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(n: Column, k: Column, m: Column, u: Column) -> Column:
    """How many of k marked among n are in a draw of m, from a uniform number u."""
    zero = F.lit(0).cast("long")

    def walk(c: Column) -> Column:
        n, k, m, mode = c["n"], c["k"], c["m"], c["mode"]
        out = n - k - m
        parts = [(1, k), (-1, mode), (-1, k - mode), (1, n - k), (-1, m - mode), (-1, out + mode), (-1, n), (1, m), (1, n - m)]
        top = F.exp(sum((s * _log_factorial(x) for s, x in parts), F.lit(0.0)))
        sd = F.sqrt(m.cast("double") * k / n * (n - k) / n * (n - m) / F.greatest(n - 1, F.lit(1)))
        steps = F.least(c["high"] - c["low"], F.ceil(12 * sd) + 24)

        def step(a: Column, j: Column) -> Column:
            x, y = (mode + j - 1).cast("double"), (mode - j + 1).cast("double")
            up = a["up"] * (k - x) * (m - x) / ((x + 1) * (out + x + 1))
            # Below the support the product is 0 already; a divisor of 0 there must not make it null.
            down = F.when(a["down"] == 0, F.lit(0.0)).otherwise(a["down"] * y * (out + y) / ((k - y + 1) * (m - y + 1)))
            up = F.when(a["up"] == 0, F.lit(0.0)).otherwise(up)
            return _let(F.struct(up.alias("up"), down.alias("down")), lambda p: F.struct(
                (a["left"] - p["up"] - p["down"]).alias("left"), p["up"].alias("up"), p["down"].alias("down"),
                F.when(a["x"] >= 0, a["x"]).when(a["left"] < p["up"], mode + j).when(a["left"] < p["up"] + p["down"], mode - j).otherwise(F.lit(-1).cast("long")).alias("x"),
            ))

        start = _let(top, lambda p: F.struct((c["u"] - p).alias("left"), p.alias("up"), p.alias("down"), F.when(c["u"] < p, mode).otherwise(F.lit(-1).cast("long")).alias("x")))
        found = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), start, step, lambda a: a["x"])
        return _let(found, lambda x: F.when(x < 0, mode).otherwise(x))

    low, high = F.greatest(zero, m + k - n), F.least(k, m)
    mode = F.floor((k + 1).cast("double") * (m + 1) / (n + 2))
    c = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), u.alias("u"), low.alias("low"), high.alias("high"), F.least(F.greatest(mode, low), high).alias("mode"))
    return _let(c, lambda c: F.when(c["low"] == c["high"], c["low"]).otherwise(walk(c)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, number, source_size, target): one row a source of ``sizes`` (source, size).

    Sources in order take the weights in turn. Targets are in proportion to them, and their excess over ``most`` sizes
    is shared by the others until none is above: sources are at their limit in order of limit by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    number = (F.row_number().over(order) - 1).alias("number")
    sources = sources.select("source", "source_size", number).withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")))
    sources = sources.withColumn("limit", most * F.col("source_size").cast("double"))
    full = Window.orderBy(F.col("limit") / F.col("w"), "number")
    before, after, everything = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    wanted = share * F.sum("source_size").over(everything)
    sources = sources.withColumn("level", (wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first source whose limit is above the level that those before it leave gives the level of all others.
    free = F.when(F.col("limit") > F.col("level") * F.col("w"), F.struct(F.col("limit") / F.col("w"), F.col("number"), F.col("level").alias("level")))
    level = F.min(free).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("w"), F.col("limit")))
    return sources.select("source", "number", "source_size", target.alias("target"))


def _blocks(sources: DataFrame) -> DataFrame:
    """Sources with words a block, blocks, and the quota of visits."""
    size, target = F.col("source_size"), F.col("target")
    words = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(target / FINE))).cast("long")
    passes = F.floor(target / F.greatest(size, F.lit(1))).cast("long")
    got = sources.withColumn("words", words).withColumn("blocks", F.ceil(size / F.col("words")).cast("long")).withColumn("passes", passes)
    rest = F.round((target - F.col("passes") * size) / F.col("words")).cast("long")
    return got.withColumn("quota", F.col("passes") * F.col("blocks") + F.least(rest, F.col("blocks"))).drop("passes")


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, number, blocks, start, visits): the visits start .. start + visits - 1 of each source that a shard makes.

    ``sources`` has number, blocks and quota; ``shards`` is a power of two. Their sizes differ by one visit at most.
    """
    item = F.struct("number", "blocks", "quota")
    tree = sources.where("quota > 0").agg(F.sort_array(F.collect_list(item)).alias("s"), F.sum("quota").alias("all")).where("all > 0")
    tree = tree.select(
        F.lit(0).cast("long").alias("node"), "all", F.transform("s", lambda x: F.struct(x["number"], x["blocks"])).alias("of"),
        F.transform("s", lambda x: F.lit(0).cast("long")).alias("start"), F.transform("s", lambda x: x["quota"]).alias("visits"),
    )
    width, level = shards, 0
    while width > 1:
        upto = lambda shard: F.floor(shard.cast("decimal(38,0)") * F.col("all") / F.lit(shards)).cast("long")
        first = F.col("node") * width
        room = upto(first + width // 2) - upto(first)
        start = F.struct(F.aggregate("visits", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), room.alias("m"), F.array().cast("array<long>").alias("left"))

        chance = (F.lit(seed), F.lit(level), F.col("node"))

        def draw(a: Column, i: Column) -> Column:
            k = F.element_at("visits", i + 1)
            x = hypergeometric(a["n"], k, a["m"], _uniform(*chance, i))  # noqa: B023  called at once
            return _let(x, lambda x: F.struct((a["n"] - k).alias("n"), (a["m"] - x).alias("m"), F.array_append(a["left"], x).alias("left")))

        left = F.aggregate(F.sequence(F.lit(0), F.size("visits") - 1), start, draw, lambda a: a["left"])
        tree = tree.withColumn("left", left)
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("start"), F.col("left").alias("visits")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("start", "left", lambda a, b: a + b).alias("start"), F.zip_with("visits", "left", lambda a, b: a - b).alias("visits")),
        )
        tree = tree.select("all", "of", F.explode(halves).alias("h")).select("h.node", "all", "of", "h.start", "h.visits")
        width, level = width // 2, level + 1
        if level % LEVELS == 0 and width > 1:
            tree = tree.repartition("node")
    each = F.explode(F.arrays_zip(F.col("of"), F.col("start"), F.col("visits"))).alias("e")
    return tree.select(F.col("node").alias("shard"), each).select("shard", "e.of.number", "e.of.blocks", "e.start", "e.visits").where("visits > 0")


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of i in a random order of 0 .. n - 1 that ``key`` names: rounds in which i may change places with k - i."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return _let(other, lambda y: F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, y)), F.lit(2)) == 0, y).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, swap)


def _placed(documents: DataFrame, seed: int, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their source's numbers and their place in its stream of words, the sources, and the words of all."""
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    rows, (n, words) = written_with(rows, "sizes", F.sum("size"))
    buckets = max(1, -(-n // BUCKET))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    sources = written(_blocks(source_targets(rows, weights, share, most)), "sources")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, *on: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in on))
    bases = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).alias("a")
    bases = bases.join(sources.alias("b"), same("a", "b", "source")).select("a.*", "number", "source_size", "target", "words")
    local = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(local), F.lit(0))).alias("a")
    placed = rows.join(bases.alias("b"), same("a", "b", "source", "bucket"))
    placed = placed.select("doc_id", "a.source", "size", "number", "source_size", "target", "words", (F.col("base") + F.col("before")).alias("place"))
    return written(placed, "placed"), sources, int(words or 0)


def _mixture(placed: DataFrame, sources: DataFrame, words: int, shard: int, seed: int, share: float) -> DataFrame:
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, share * words / shard))))
    leaves = written(split_quotas(sources, shards, seed), "leaves").repartition("shard", "number")
    visits = leaves.select("shard", "number", "blocks", F.explode(F.expr("sequence(start, start + visits - 1)")).alias("visit"))
    run = F.expr("visit div blocks")
    visits = visits.select("shard", "number", "visit", permuted(F.col("visit") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("number"), run).alias("block"))
    block = F.explode(F.expr("sequence(place div words, (place + size - 1) div words)")).alias("block")
    pieces = placed.where("size > 0").select("doc_id", "source", "number", "place", "size", "words", block)
    low, high = F.greatest(F.col("block") * F.col("words"), F.col("place")), F.least((F.col("block") + 1) * F.col("words"), F.col("place") + F.col("size"))
    pieces = pieces.select("doc_id", "source", "number", "place", "block", (low - F.col("place")).alias("start"), (high - low).alias("length"))
    order = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "number", "visit", "place"), "number", "visit", "place"))
    return pieces.join(visits, ["number", "block"]).select("shard", order.alias("position"), "source", "doc_id", "number", "place", "start", "length")


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shard: int = SHARD, seed: int = 0
) -> DataFrame:
    """(shard, position, source, doc_id, number, place, start, length): the words that every output shard takes, in order.

    start and length are words of the document; number and place name its row: the source's number, and the row's first
    word in the source's stream.
    """
    return _mixture(*_placed(documents, seed, weights, share, most), shard, seed, share)


def taken(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Every row of ``documents`` with its size, its source's size and target, and the words that the mixture takes of it."""
    placed, sources, words = _placed(documents, seed, weights, share, most)
    sums = _mixture(placed, sources, words, shard, seed, share).groupBy("number", "place").agg(F.sum("length").alias("taken"))
    rows = placed.withColumn("at", F.when(F.col("size") > 0, F.col("place")))
    sums = sums.withColumnRenamed("place", "at")
    return rows.join(sums, ["number", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
