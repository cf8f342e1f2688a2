"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document has a fractional copy probability. A reduction tree makes them whole: a level deals the open units of each source into
hashed blocks; in a block two units exchange words at random until one of them is whole, the other meets the next unit, and so on, until
at most one is open, which the next level takes. Every exchange keeps the words of its pair. In a source's last block, which also gets about
HELD units of it that no level folds, each unit exchanges words with the pool of all smaller ones until none but the smallest is open, and
that is rounded by its probability. So every document's expected copies are its source's target over its source's size, and a source misses
its target by less than one unit, most often the smallest of its last block; by more only where one unit outweighs all smaller ones.

Defined results: a null text has no words; a null source is a source of its own, ordered last; a source without words gets a
target of 0; rows with equal or null ids are mixed one by one; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
HELD = 16  # units of a source, about, that wait for its last block, so that it has small ones
BLOCK = 64  # open units of a block, about; a level leaves one of them at most
UNITS_PER_TASK = 20_000
RUN = 1000  # rows that are made from one counted row at once
SEED = 20240301
WHOLE = 1e-9  # probabilities this near to 0 or 1 are whole


def draw(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def ranked(sources: DataFrame) -> DataFrame:
    """sources (distinct in source) with place: 0, 1, ... by code point, null last; sorted in ranges, no task holds all of them."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(parts, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    # The id of a row holds its partition's number in the upper bits and its place in the lower 33.
    at = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))  # one row a partition
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("place", F.col("before") + at).drop("part", "row", "before")


def targets(rows: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, sid, source_size, target): share * all sizes dealt by weight, no source above most times its own size.

    The excess of capped sources goes to the others by weight: a level of words for each weight that rises until no further source is
    above its cap. Each step is one sum over the sources, and a step that caps no further source is the last.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = ranked(s).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    s = materialise(s)
    cap = most * F.col("source_size")
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        over = cap <= F.col("w") * F.lit(level) if n_capped >= 0 else F.lit(False)
        n, size, weight = s.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        if n == n_capped or not weight:
            break
        n_capped, level = n, (total - most * (size or 0)) / weight
    target = F.least(cap, F.col("w") * F.lit(level)) if weight else cap
    return s.select("source", F.col("place").alias("sid"), "source_size", target.cast("double").alias("target"))


def exchange(a: Column, b: Column, level: Column) -> Column:
    """(a, b): the probabilities of two units after a random exchange of words that makes one of them 0 or 1.

    Either a rises and b falls by as many words, or the reverse, as far as it goes; the direction is drawn so that both expectations
    stay. The words of the pair, size times p, stay whatever is drawn.
    """
    ratio = b["size"] / a["size"]
    limits = F.struct(F.least(1 - a["p"], b["p"] * ratio).alias("rise"), F.least(a["p"], (1 - b["p"]) * ratio).alias("fall"), ratio.alias("ratio"))

    def moved(x: Column) -> Column:
        up = draw(a["id"], a["size"], a["k"], a["p"], b["id"], b["size"], b["k"], level) * (x["rise"] + x["fall"]) < x["fall"]
        return let(F.when(up, x["rise"]).otherwise(-x["fall"]), lambda by: F.struct((a["p"] + by).alias("a"), (b["p"] - by / x["ratio"]).alias("b")))

    return let(limits, moved)


def fold(units: Column, level: Column) -> Column:
    """(open, won) of a block's units (size, id, k, p): the one still open, and the places of those that became 1."""
    fields = ("size", "id", "k", "p")
    numbered = F.transform(units, lambda u, i: F.struct(*(u[f].alias(f) for f in fields), i.cast("int").alias("at")))
    start = F.struct(F.get(numbered, F.lit(0)).alias("open"), F.array().cast("array<int>").alias("won"))

    def step(acc: Column, u: Column) -> Column:
        a = acc["open"]

        def settled(p: Column) -> Column:
            off = lambda x: F.least(F.abs(x), F.abs(1 - x))
            first = off(p["a"]) <= off(p["b"])  # whichever is whole leaves
            left = F.when(first, F.struct(a["at"].alias("at"), p["a"].alias("p"))).otherwise(F.struct(u["at"].alias("at"), p["b"].alias("p")))
            kept, value = F.when(first, u).otherwise(a), F.when(first, p["b"]).otherwise(p["a"])
            still = F.struct(*(kept[f].alias(f) for f in fields[:3]), value.alias("p"), kept["at"].alias("at"))
            return F.struct(still.alias("open"), F.when(left["p"] > 0.5, F.concat(acc["won"], F.array(left["at"]))).otherwise(acc["won"]).alias("won"))

        return let(exchange(a, u, level), settled)

    return F.aggregate(F.slice(numbered, 2, F.size(numbered)), start, step)


def root(units: Column, level: Column) -> Column:
    """0 or 1 for each place of a source's last block, whose units come largest first.

    Each unit exchanges words with the pool of all smaller ones: it rises to 1 while they fall in proportion, or falls to 0 while they rise in
    proportion to what they lack, drawn so that every expectation stays. What is open at the end is the smallest unit, or one larger
    than all smaller ones could fill; it is rounded by its probability. The pool's probabilities are scale * p + shift, so a step is a few sums.
    """
    sums = F.struct(F.aggregate(units, F.lit(0.0), lambda s, u: s + u["size"]).alias("size"), F.aggregate(units, F.lit(0.0), lambda s, u: s + u["size"] * u["p"]).alias("held"))
    start = F.struct(sums["size"].alias("size"), sums["held"].alias("held"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.array().cast("array<int>").alias("sel"))

    def step(acc: Column, u: Column) -> Column:
        size, held = acc["size"] - u["size"], acc["held"] - u["size"] * u["p"]  # of the smaller ones, as they began
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc["scale"] * u["p"] + acc["shift"]))
        full = F.greatest(F.lit(0.0), F.least(size, acc["scale"] * held + acc["shift"] * size))
        state = F.struct(p.alias("p"), full.alias("full"), (size - full).alias("room"), size.alias("size"), held.alias("held"))

        def limits(x: Column) -> Column:
            return F.struct(*(x[c].alias(c) for c in ("p", "full", "room", "size", "held")), F.least(u["size"] * (1 - x["p"]), x["full"]).alias("rise"), F.least(u["size"] * x["p"], x["room"]).alias("fall"))

        def moved(x: Column) -> Column:
            up = draw(u["id"], u["size"], u["k"], level, F.lit("root")) * (x["rise"] + x["fall"]) < x["fall"]
            # The words that the pool gives, as a part of what it holds or lacks.
            keeps = F.when(up, 1 - F.coalesce(x["rise"] / F.nullif(x["full"], F.lit(0.0)), F.lit(0.0))).otherwise(1 - F.coalesce(x["fall"] / F.nullif(x["room"], F.lit(0.0)), F.lit(0.0)))
            now = x["p"] + F.when(up, x["rise"]).otherwise(-x["fall"]) / u["size"]
            return F.struct(*(x[c].alias(c) for c in ("size", "held")), now.alias("now"), up.alias("up"), keeps.alias("keeps"))

        def ended(x: Column) -> Column:
            own = draw(u["id"], u["size"], u["k"], level, F.lit("last"))
            sel = F.when(x["now"] <= WHOLE, 0).when(x["now"] >= 1 - WHOLE, 1).otherwise((own < x["now"]).cast("int"))
            return F.struct(
                x["size"].alias("size"), x["held"].alias("held"), (acc["scale"] * x["keeps"]).alias("scale"),
                F.when(x["up"], acc["shift"] * x["keeps"]).otherwise(1 - (1 - acc["shift"]) * x["keeps"]).alias("shift"), F.concat(acc["sel"], F.array(sel)).alias("sel"),
            )

        return let(let(let(state, limits), moved), ended)

    return F.aggregate(units, start, step)["sel"]


def chosen(units: Column, r: Column, is_last: Column, level: Column) -> Column:
    """For each place of a folded block 0 or 1; null for a unit that stays open. The last block of a source leaves none open."""
    first = F.transform(units, lambda u, i: F.when(~r["open"]["at"].eqNullSafe(i.cast("int")), F.array_contains(r["won"], i.cast("int")).cast("int")))
    return F.when(is_last, root(units, level)).otherwise(first)


def rounded(units: DataFrame) -> DataFrame:
    """(id, size, sid, base, sel) of units (id, k, size, sid, base, p) with 0 < p < 1: each p becomes 0 or 1 and each source's words stay.

    Every level is written to the shared folder. A source is done after the level at which it had one block.
    """
    done, now, level = [], units.withColumn("held", F.lit(False)), 0
    unit = F.struct(F.col("size"), F.col("id"), F.col("k"), F.col("p"), F.col("base"))
    keys = ["id", "k", "size", "sid", "base", "p", "held"]
    while True:
        blocks = materialise(now.groupBy("sid").agg(F.ceil(F.count_if(~F.col("held")) / BLOCK).alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1))))
        n_sources, most, n_blocks = blocks.agg(F.count("*"), F.max("blocks"), F.sum("blocks")).first()
        tasks = max(now.sparkSession.sparkContext.defaultParallelism, (n_blocks or 0) * BLOCK // UNITS_PER_TASK)
        dealt = now.join(small(blocks, n_sources), "sid")
        if not level:
            waits = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", "size", "k", F.lit("held")), F.col("blocks") * (BLOCK // HELD)) == 0)
            dealt = materialise(dealt.withColumn("held", waits))
        waiting = dealt.where("held and blocks > 1").select(*keys)
        dealt = dealt.where("not (held and blocks > 1)").withColumn("block", F.pmod(F.xxhash64("id", "size", "k", F.lit(level)), F.col("blocks")))
        # Blocks are few bytes but much work: as many tasks as cores at least.
        folded = dealt.repartition(tasks, "sid", "block").groupBy("sid", "blocks", "block").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
        folded = folded.select("sid", "units", (F.col("blocks") == 1).alias("is_last"), fold(F.col("units"), F.lit(level)).alias("r"))
        folded = folded.select("sid", F.col("r.open.p").alias("p"), F.arrays_zip("units", chosen(F.col("units"), F.col("r"), F.col("is_last"), F.lit(level)).alias("sel")).alias("x"))
        out = folded.select("sid", F.col("p").alias("open_p"), F.explode("x").alias("x"))
        out = materialise(out.select("sid", "x.units.id", "x.units.k", "x.units.size", "x.units.base", "x.sel", F.col("x.sel").isNull().alias("open"), F.when(F.col("x.sel").isNull(), F.col("open_p")).alias("p")))
        done.append(out.where("not open").select("id", "size", "sid", "base", "sel"))
        now, level = out.where("open").withColumn("held", F.lit(False)).select(*keys).unionAll(waiting), level + 1
        if (most or 0) <= 1:
            break
    for d in done[1:]:
        done[0] = done[0].unionAll(d)
    return done[0]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row: how often the mix takes it."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    # Rows alike in all three are counted and numbered (k), so that no block gets more of them than its share.
    counted = materialise(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    each = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / RUN) - 1)))
    each = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN) - 1)))
    each = each.select("id", "source", "size", (F.col("run") * RUN + F.col("j")).cast("long").alias("k"))
    goal = materialise(targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), share, most))
    few = small(goal, goal.count())
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(times + WHOLE)
    both = each.join(few, each["source"].eqNullSafe(few["source"])).select("id", "k", "size", "sid", base.cast("int").alias("base"), F.greatest(times - base, F.lit(0.0)).alias("p"))
    is_whole = (F.col("p") <= WHOLE) | (F.col("size") == 0)
    whole = both.where(is_whole).select("id", "size", "sid", "base", F.lit(0).alias("sel"))
    out = whole.unionAll(rounded(both.where(~is_whole))).join(few, "sid")
    copies = F.col("base") + F.col("sel")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
