"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of a hash, form blocks of `block` rows. Source s with the integer weight a(s) out of
A = sum of a is served as in an ideal fluid: a(s) blocks in a unit of virtual time v as long as it has any, so at v it
has had min(a(s) * v, b(s)) of its b(s) blocks. T(v), the sum over the sources, is real time in blocks; once a source is
used up, the others share its part. Block i of s (from 1) is released at floor(T((i - 1) / a(s))) and due at ceil(T(i /
a(s))). In each slot the released block with the earliest deadline is served (then the source's name decides). So at any
time each source is less than one block away from its share, and all rows are used, each once.

At whole v every source has had whole blocks, so slots T(v) to T(v + 1) are a schedule of their own, a round. Most of these are
alike: they differ only where a source runs out. A schedule is worked out once for each different round, at most two for each
source and one more; a block's slot is then a lookup by source and place. Weights are divided by their common divisor; if they still
sum to over PRECISION they are rounded to that sum, each 1 at least, so a round is never wider than PRECISION and the sources.

Within a round earliest-deadline-first is worked out by halves, so that it takes a number of windows that grows with the logarithm
of the width. Blocks that are always served when one is released fill slots that do not depend on their order: sorted by release,
block j (from 0) takes slot j + max(release - index) over the blocks up to it. So the half with the earlier deadlines fills these
slots, whatever the other half does, and the other half what is left; each half is then a schedule of the same kind over
its own slots, counted anew. Groups of LEAF blocks or fewer are folded slot by slot. The tables of sources, rounds and slots grow
with the number and weights of the sources, not with rows.

A row's place in its source is by the SHA-256 of the ordering columns, whatever the files' layout: its rank in a bucket of hashes plus
the rows in the buckets before. Buckets hold about BUCKET_ROWS rows, however large the source, so no task gets a source
whole. A bucket that holds over four times as many, as one key has very many rows, is dealt out in pieces by row number.

All of it is DataFrame expressions. Null sources are a source of their own; null ids and texts are allowed, the text is
never read but for its hash. An empty table gives an empty table. Repeated rows are all placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.session import stored

BLOCK, PARTS, POWER, BUCKET_ROWS = 8, 128, 0.5, 1024
PRECISION, LEAF, BROADCAST_ROWS = 1 << 16, 128, 1 << 18


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def source_table(docs: DataFrame, source: str = "source", block: int = BLOCK, parts: int = PARTS, power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """source, n, blocks and the integer weight of each source.

    weights (source, weight: long) gives the weights; a source that is not listed gets 1. Without it they are in
    proportion to n to the power of `power`, `parts` together, each 1 at least.
    """
    sizes = docs.groupBy(_key(source).alias("__key")).agg(F.count("*").alias("n"))
    if weights is not None:
        named = weights.select(_key("source").alias("__key"), F.col("weight").cast("long").alias("weight")).groupBy("__key").agg(F.max("weight").alias("weight"))
        sized = sizes.join(named, "__key", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long"))
    else:
        share = F.pow("n", F.lit(power)) / F.sum(F.pow("n", F.lit(power))).over(Window.partitionBy())
        sized = sizes.withColumn("weight", F.greatest(F.lit(1), F.round(share * parts)).cast("long"))
    # Euclid's steps by a fold: 92 are enough for 63 bits.
    step = "aggregate(sequence(1, 92), named_struct('a', g, 'b', w), (z, i) -> if(z.b = 0, z, named_struct('a', z.b, 'b', z.a % z.b)), z -> z.a)"
    whole = sized.agg(F.sum("weight").cast("double").alias("__all"), F.collect_set("weight").alias("w")).select("__all", F.expr(f"aggregate(w, 0L, (g, w) -> {step})").alias("__divisor"))
    reduced = F.when(F.col("__all") / F.col("__divisor") <= PRECISION, F.expr("weight div __divisor")).otherwise(F.greatest(F.lit(1), F.round(F.col("weight") * PRECISION / F.col("__all"))).cast("long"))
    joined = sized.withColumn("__one", F.lit(1)).join(F.broadcast(whole.withColumn("__one", F.lit(1))), "__one")
    return stored(joined.select("__key", "n", reduced.alias("weight"), F.ceil(F.col("n") / block).alias("blocks")), "sources")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def schedules(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rounds, slots): v0, v1, start and width of each run of like rounds; and within a round the slot, release and deadline of each block.

    A run of rounds v0 <= v < v1 begins at slot `start` and takes `width` slots a round.
    """
    s = sources.select("__key", F.col("weight").alias("a"), F.col("blocks").alias("b"))
    last = F.expr("(b + a - 1) div a")
    ends = s.select(F.explode(F.array(F.expr("b div a"), last)).alias("v0")).union(sources.sparkSession.range(1)).distinct()
    order = Window.orderBy("v0")
    runs = stored(ends.select("v0", F.lead("v0").over(order).alias("v1"), (F.row_number().over(order) - 1).alias("run")), "runs")
    upto = runs.select(F.col("v0").alias("last"), F.col("run").alias("after"))
    each = s.withColumn("last", last).join(upto, "last").select("__key", "a", "b", F.explode(F.expr("sequence(0, after - 1)")).alias("run"))
    active = stored(each.join(runs, "run").select("run", "__key", "a", F.expr("least(a, b - a * v0)").alias("m")), "active")
    sums = active.groupBy("run").agg(F.sum("a").alias("all"), F.sum("m").alias("width"))
    before = F.coalesce(F.sum(F.expr("width * (v1 - v0)")).over(Window.orderBy("v0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = stored(runs.where("v1 is not null").join(sums, "run").select("run", "v0", "v1", "all", "width", before.alias("start")), "rounds")
    # Fluid time at v = i / a: sources that have run out by then have had their m blocks, the others a * v.
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("__key", "string"), ("a", "long"), ("i", "long"))]
    out = active.where("m < a").select("run", (F.col("m") / F.col("a")).alias("x"), F.lit(0).alias("kind"), F.col("a").alias("da"), F.col("m").alias("dm"), *blank)
    blocks = active.select("run", "__key", "a", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i"))
    blocks = blocks.select("run", (F.col("i") / F.col("a")).alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("da"), F.lit(0).cast("long").alias("dm"), "__key", "a", "i")
    gone = Window.partitionBy("run").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    timed = out.unionByName(blocks).withColumns({"ra": F.sum("da").over(gone), "rm": F.sum("dm").over(gone)}).where("kind = 1")
    timed = timed.join(_few(rounds.select("run", "all", "width")), "run").withColumn("t", F.expr("i * (all - ra) + a * rm"))
    released = F.coalesce(F.lag(F.expr("t div a")).over(Window.partitionBy("run", "__key").orderBy("i")), F.lit(0))
    due = timed.select("run", "width", "__key", "i", released.alias("r"), F.expr("(t + a - 1) div a").alias("d"))
    none = F.lit(None)
    jobs = due.select("run", F.lit(0).cast("long").alias("grp"), F.col("width").alias("n"), F.lit(0).alias("kind"), F.col("r").alias("x"), (F.row_number().over(Window.partitionBy("run").orderBy("d", "__key", "i")) - 1).cast("long").alias("rank"), F.struct("__key", "i", "r", "d").alias("job"), none.cast("long").alias("slot"))
    places = rounds.select("run", F.col("width").alias("n"), F.explode(F.expr("sequence(0L, width - 1)")).alias("slot"))
    free = places.select("run", F.lit(0).cast("long").alias("grp"), "n", F.lit(1).alias("kind"), F.col("slot").alias("x"), none.cast("long").alias("rank"), none.cast(jobs.schema["job"].dataType).alias("job"), "slot")
    state, widest = stored(jobs.unionByName(free), "blocks"), rounds.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
    level = 0
    while -(-widest >> level) > LEAF:
        state, level = _halved(state), level + 1
        state = stored(state, "halves") if level % 4 == 0 else state
    arrays = state.groupBy("run", "grp").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("rank", "x", "job")))).alias("left"), F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("x", "slot")))).alias("own")
    )
    # The fold over a group's slots: of the blocks not yet served, the first in order of deadline among those released.
    pick = "element_at(filter(z.left, j -> j.x <= t), 1)"
    fold = f"aggregate(sequence(0L, size(left) - 1L), named_struct('left', left, 'done', slice(left, 1, 0)), (z, t) -> named_struct('left', filter(z.left, j -> j.rank <> {pick}.rank), 'done', concat(z.done, array({pick}))), z -> z.done)"
    served = arrays.select("run", F.inline(F.expr(f"zip_with({fold}, own, (j, o) -> struct(j.job as job, o.slot as slot))")))
    slots = served.join(_few(rounds.select("run", "v0")), "run").select("v0", "job.__key", "job.i", "slot", "job.r", "job.d")
    return rounds.select("v0", "v1", "start", "width"), stored(slots, "slots")


def _halved(state: DataFrame) -> DataFrame:
    """Each group of over LEAF blocks as two, the first with the earlier deadlines; blocks and slots are counted anew in each.

    state: run, grp, n (blocks, as many slots), kind (0 block, 1 slot), x (release or number of the slot), rank (by deadline), job, slot.
    """
    first = F.when(F.col("n") > LEAF, F.ceil(F.col("n") / 2)).otherwise(F.col("n"))
    rows = state.withColumn("n1", first).withColumn("one", F.coalesce((F.col("kind") == 0) & (F.col("rank") < F.col("n1")), F.lit(False)))
    sorted_ = Window.partitionBy("run", "grp", "one").orderBy("x", "rank")
    index = (F.row_number().over(sorted_) - 1).cast("long")
    rows = rows.withColumn("index", index).withColumn("taken", F.col("index") + F.max(F.col("x") - F.col("index")).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    points = F.when(F.col("one"), F.array(F.struct("kind", "x"), F.struct(F.lit(2).alias("kind"), F.col("taken").alias("x")))).otherwise(F.array(F.struct("kind", "x")))
    keep = ["run", "grp", "n", "n1", "one", "rank", "job", "slot"]
    rows = rows.select(*keep, F.inline(points))
    along = Window.partitionBy("run", "grp").orderBy("x", "kind")
    held = F.lead("kind").over(along).eqNullSafe(F.lit(2)) & F.lead("x").over(along).eqNullSafe(F.col("x"))
    rows = rows.withColumns({"before": F.sum((F.col("kind") == 2).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)), "held": held}).where("kind < 2")
    rows = rows.withColumn("one", F.when(F.col("kind") == 1, F.col("held")).otherwise(F.col("one")))
    half = lambda a, b: F.when(F.col("one"), a).otherwise(b)
    return rows.select(
        "run", half(2 * F.col("grp"), 2 * F.col("grp") + 1).alias("grp"), half(F.col("n1"), F.col("n") - F.col("n1")).alias("n"), "kind",
        half(F.col("before"), F.col("x") - F.col("before")).alias("x"), half(F.col("rank"), F.col("rank") - F.col("n1")).alias("rank"), "job", "slot",
    )


def mix(docs: DataFrame, order_by: list[str], source: str = "source", block: int = BLOCK, parts: int = PARTS, power: float = POWER, weights: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """docs with block, release, deadline, slot and position (all from 0); position is the row's place in the mixture.

    order_by: the columns whose hash orders a source's rows. prefix goes before the new columns' names.
    """
    sources = source_table(docs, source, block, parts, power, weights)
    rounds, slots = schedules(sources)
    bound = sources.select("__key", "weight", "blocks", F.col("n").alias("__n"))
    words = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order_by]
    digest = F.sha2(F.concat_ws("|", *words).cast("binary"), 256)
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), _key(source).alias("__key"), digest.alias("__hash"), F.monotonically_increasing_id().alias("__salt"))
    share = F.conv(F.substring("__hash", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = hashed.join(_few(bound), "__key").withColumn("__bucket", F.floor(share * F.ceil(F.col("__n") / BUCKET_ROWS)))
    counts = stored(rows.groupBy("__key", "__bucket").agg(F.count("*").alias("__rows")), "buckets")
    bucket = ["__key", "__bucket", "__piece"]
    if counts.where(F.col("__rows") > 4 * BUCKET_ROWS).isEmpty():
        rows, pieces = rows.withColumn("__piece", F.lit(0).cast("long")), counts.withColumn("__piece", F.lit(0).cast("long"))
    else:
        large = counts.select("__key", "__bucket", F.when(F.col("__rows") > 4 * BUCKET_ROWS, F.ceil(F.col("__rows") / BUCKET_ROWS)).otherwise(1).alias("__pieces"))
        rows = rows.join(large, ["__key", "__bucket"]).withColumn("__piece", F.pmod("__salt", "__pieces"))
        pieces = stored(rows.groupBy(*bucket).agg(F.count("*").alias("__rows")), "pieces")
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__key").orderBy("__bucket", "__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Runs and gaps are looked up once for each piece, which spans few of them; its rows look among those.
    runs = rounds.agg(F.array_sort(F.collect_list(F.struct("v0", "v1", "start", "width"))).alias("__runs")).scalar()
    # The last block of a source may hold fewer rows: what is missing moves later rows forward.
    ended = sources.where(f"blocks * {block} > n").select("__key", F.expr(f"blocks * {block} - n").alias("gap"), F.expr("(blocks - 1) div weight").alias("v"), F.expr("(blocks - 1) % weight + 1").alias("i"))
    ended = ended.join(_few(rounds), F.col("v1") == F.col("v") + 1)
    gaps = ended.join(_few(slots), ["__key", "i", "v0"]).select(F.expr("start + (v - v0) * width + slot").alias("slot"), "gap")
    gaps = stored(gaps, "gaps").agg(F.array_sort(F.collect_list(F.struct("slot", "gap"))).alias("__gaps")).scalar()
    spans = pieces.withColumn("__before", before).join(_few(bound.select("__key", "weight")), "__key").withColumns({"__runs": runs, "__gaps": gaps})
    spans = spans.withColumns({"__low": F.expr(f"(__before div {block}) div weight"), "__high": F.expr(f"((__before + __rows - 1) div {block}) div weight")})
    spans = spans.withColumn("__runs", F.expr("filter(__runs, x -> x.v1 > __low and x.v0 <= __high)"))
    edge = lambda n, v: F.expr(f"element_at(__runs, {n}).start + ({v} - element_at(__runs, {n}).v0) * element_at(__runs, {n}).width")
    spans = spans.withColumns({"__from": edge(1, "__low"), "__to": edge(-1, "__high + 1")})
    spans = spans.select(*bucket, "__before", "__runs", F.expr("aggregate(__gaps, 0L, (t, x) -> t + if(x.slot < __from, x.gap, 0L))").alias("__gone"), F.expr("filter(__gaps, x -> x.slot >= __from and x.slot < __to)").alias("__gaps"))
    placed = rows.join(spans, bucket)
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("__hash", *[F.col(f"__doc.`{c}`") for c in order_by], "__salt"))
    at = placed.withColumn("__at", F.col("__before") + rank - 1).withColumns({"block": F.floor(F.col("__at") / block), "__off": F.col("__at") % block})
    at = at.withColumns({"__v": F.expr("block div weight"), "__i": F.expr("block % weight + 1")})
    at = at.withColumn("__run", F.expr("element_at(filter(__runs, x -> x.v0 <= __v and __v < x.v1), 1)"))
    at = at.withColumn("v0", F.col("__run.v0")).join(_few(slots.withColumnRenamed("i", "__i")), ["__key", "v0", "__i"])
    base = F.expr("__run.start + (__v - v0) * __run.width")
    out = at.withColumns({"__slot": base + F.col("slot"), "release": base + F.col("r"), "deadline": base + F.col("d")})
    moved = F.expr(f"__slot * {block} + __off - aggregate(__gaps, __gone, (t, x) -> t + if(x.slot < __slot, x.gap, 0L))")
    made = {"block": F.col("block"), "release": F.col("release"), "deadline": F.col("deadline"), "slot": F.col("__slot"), "position": moved}
    return out.select("__doc.*", *[c.alias(prefix + name) for name, c in made.items()])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, ["doc_id"])


OP4_SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce('=' || source, '') AS k, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT k, ceil(n / {float(BLOCK)})::BIGINT AS b, greatest(1, round(pow(n, {POWER}) / sum(pow(n, {POWER})) OVER () * {PARTS}))::BIGINT AS a FROM n),
j AS (SELECT x.k, i, floor(sum(least(y.a * (i - 1) / x.a::DOUBLE, y.b)) + 1e-9)::BIGINT AS r, ceil(sum(least(y.a * i / x.a::DOUBLE, y.b)) - 1e-9)::BIGINT AS d
      FROM (SELECT k, a, unnest(range(1, b + 1)) AS i FROM w) x, w y GROUP BY x.k, x.a, i),
q AS (SELECT list(rs ORDER BY k) AS rs, list(ds ORDER BY k) AS ds, list(k ORDER BY k) AS ks, sum(len(rs)) AS total FROM (SELECT k, list(r ORDER BY i) AS rs, list(d ORDER BY i) AS ds FROM j GROUP BY k)),
e AS (SELECT -1::BIGINT AS slot, list_transform(ks, lambda x: 0::BIGINT) AS had, 0::BIGINT AS p FROM q UNION ALL
      SELECT slot + 1, list_transform(had, lambda h, x: h + (x = p2)::BIGINT), p2 FROM (SELECT slot, had, list_min(list_transform(list_filter(range(1, len(had) + 1),
        lambda x: had[x] < len(rs[x]) AND rs[x][had[x] + 1] <= slot + 1), lambda x: ds[x][had[x] + 1] * 1000 + x)) % 1000 AS p2 FROM e, q WHERE slot + 1 < total)),
f AS (SELECT slot, ks[p] AS k, had[p] - 1 AS block FROM e, q WHERE slot >= 0),
o AS (SELECT doc_id, source, coalesce('=' || source, '') AS k, row_number() OVER (PARTITION BY coalesce('=' || source, '') ORDER BY sha256(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS place FROM documents)
SELECT doc_id, source, block, r AS release, d AS deadline, slot, row_number() OVER (ORDER BY slot, place) - 1 AS position
FROM (SELECT *, place // {BLOCK} AS block FROM o) JOIN f USING (k, block) JOIN j ON j.k = f.k AND j.i = block + 1
"""
