"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. Cases: a NULL text has size 0; a NULL source is a source of its own, last in
order; a source of size 0 has target 0; repeated rows (same id and text) are told apart by a number; a share above
the maximum of epochs gives every source its maximum; an empty table gives no rows. Only the id, the text
and the source column are read; names that begin with ``_mix`` are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.llm.common import WORD, materialised, ranked

DIGIT_BITS = 10
DIGITS = 3
TICKET_BITS = 63
PARTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """All rows with their source, their size in words and a seeded ticket of 63 bits."""
    ticket = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    return docs.withColumns(
        {"_mix_source": F.col(source_col), "_mix_size": word_count(F.col(text_col)), "_mix_ticket": ticket}
    )


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt out to the sources in code-point order, NULL last, beginning anew after the last weight."""
    placed = ranked(sources, F.col("_mix_source").asc_nulls_last(), name="_mix_at")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return placed.withColumn("_mix_weight", values[(F.col("_mix_at") % len(weights)).cast("int")]).drop("_mix_at")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds each source's target: its weight's part of ``share`` of all sizes, but at most ``epochs`` times
    its size, the excess being dealt out again by weight until no source is above.

    A source is clamped when its cap is below ``level * weight``. The level only rises from round to round,
    so the level is all the state there is; a round is one sum over the sources, and it ends when no
    further source is clamped."""
    cap = F.col("_mix_source_size") * F.lit(epochs)
    total = sources.agg(
        F.coalesce(F.sum("_mix_source_size"), F.lit(0)), F.coalesce(F.sum("_mix_weight"), F.lit(0.0))
    ).first()
    wanted, level = share * total[0], share * total[0] / total[1] if total[1] else 0.0
    clamped = -1
    while True:
        above = cap < F.lit(level) * F.col("_mix_weight")
        count, caps, free = sources.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("_mix_weight"))), F.lit(0.0)),
        ).first()
        if count == clamped or not free:
            break
        clamped, level = count, (wanted - caps) / free
    if not free:  # every source is at its maximum
        return sources.withColumn("_mix_target", cap.cast("double"))
    return sources.withColumn("_mix_target", F.least(cap, F.lit(level) * F.col("_mix_weight")).cast("double"))


def _numbered(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Gives rows of one source, id and text tickets of their own, the same set of them at every reading.

    ``shared`` has the tickets that stand more than once. Their rows are numbered within ``PARTS`` parts and the
    parts put one after the other, so many equal rows are no hot task."""
    if shared is None:
        return rows
    group = F.xxhash64("_mix_source", "_mix_ticket")
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    many = materialised(rows.join(shared, "_mix_ticket", "left_semi").withColumns({"_mix_group": group, "_mix_part": part}))
    counts = many.groupBy("_mix_group", "_mix_part").agg(F.count("*").alias("_mix_n"))
    earlier = Window.partitionBy("_mix_group").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_mix_group", "_mix_part", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_mix_n"))
    within = F.row_number().over(Window.partitionBy("_mix_group", "_mix_part").orderBy("_mix_ticket"))
    number = F.col("_mix_n") + F.col("_mix_row") - 1
    own = F.when(number == 0, F.col("_mix_ticket")).otherwise(
        F.shiftrightunsigned(F.xxhash64("_mix_ticket", number), 1)
    )
    told = many.withColumn("_mix_row", within).join(before, ["_mix_group", "_mix_part"]).withColumn("_mix_ticket", own)
    return rows.join(shared, "_mix_ticket", "left_anti").select(*rows.columns).unionAll(told.select(*rows.columns))


def _cut(tickets: DataFrame, state: DataFrame) -> DataFrame:
    """Finds per source the last ticket up to which ``tickets`` are taken without going over ``_mix_rest``.

    A radix selection: each round sums the sizes by the next digit of the tickets that share the boundary
    prefix so far, which combines before it is shuffled, so a source with a third of the rows is no hot
    task; the few tickets that share the whole prefix are then taken in order. Adds the pass (the largest size that
    it took and its last ticket) to ``_mix_passes`` and lessens ``_mix_rest`` by what was taken."""
    state = state.withColumns({"_mix_cut": F.lit(0).cast("long"), "_mix_limit": F.col("_mix_rest")})
    for k in range(1, DIGITS + 1):
        prefix = F.shiftrightunsigned(F.col("_mix_ticket"), TICKET_BITS - k * DIGIT_BITS)
        inside = _with(tickets, state).where(F.shiftrightunsigned(prefix, DIGIT_BITS) == F.col("_mix_cut"))
        bins = inside.groupBy("_mix_source", prefix.alias("_mix_bin")).agg(F.sum("_mix_size").alias("_mix_mass"))
        # at most 2**DIGIT_BITS bins a source
        ordered = Window.partitionBy("_mix_source").orderBy("_mix_bin")
        upto = bins.withColumn("_mix_upto", F.sum("_mix_mass").over(ordered)).withColumnRenamed(
            "_mix_source", "_mix_key"
        )
        over = F.col("_mix_upto") > F.col("_mix_rest")
        found = (
            state.join(upto, F.col("_mix_source").eqNullSafe(F.col("_mix_key")), "left")
            .groupBy(state.columns)
            .agg(
                F.min(F.when(over, F.struct("_mix_bin", "_mix_upto", "_mix_mass"))).alias("_mix_first"),
                F.max("_mix_bin").alias("_mix_last"),
                F.max("_mix_upto").alias("_mix_all"),
            )
        )
        below = F.coalesce(F.col("_mix_first._mix_upto") - F.col("_mix_first._mix_mass"), F.col("_mix_all"), F.lit(0))
        beyond = F.coalesce(F.col("_mix_last") + 1, F.shiftleft("_mix_cut", DIGIT_BITS))  # nothing goes over
        state = materialised(
            found.withColumns(
                {
                    "_mix_cut": F.coalesce(F.col("_mix_first._mix_bin"), beyond),
                    "_mix_rest": F.col("_mix_rest") - below,
                }
            ).drop("_mix_first", "_mix_last", "_mix_all")
        )
    width = DIGITS * DIGIT_BITS
    low = TICKET_BITS - width
    edge = _with(tickets, state).where(F.shiftrightunsigned("_mix_ticket", low) == F.col("_mix_cut"))
    upto = F.sum("_mix_size").over(Window.partitionBy("_mix_source").orderBy("_mix_ticket"))
    edge = edge.select("_mix_source", "_mix_ticket", "_mix_rest", upto.alias("_mix_upto"))
    over = F.col("_mix_upto") > F.col("_mix_rest")
    found = edge.groupBy(F.col("_mix_source").alias("_mix_key")).agg(
        F.min(F.when(over, F.col("_mix_ticket"))).alias("_mix_first"),
        F.max(F.when(~over, F.col("_mix_upto"))).alias("_mix_more"),
    )
    beyond = F.when(F.col("_mix_cut") >= 1 << width, F.lit((1 << TICKET_BITS) - 1)).otherwise(
        F.shiftleft("_mix_cut", low) - 1
    )
    one = F.struct(
        F.col("_mix_limit").cast("double").alias("limit"), F.coalesce(F.col("_mix_first") - 1, beyond).alias("last")
    )
    return materialised(
        state.join(found, F.col("_mix_source").eqNullSafe(F.col("_mix_key")), "left")
        .withColumns(
            {
                "_mix_passes": F.concat("_mix_passes", F.array(one)),
                "_mix_rest": F.col("_mix_rest") - F.coalesce("_mix_more", F.lit(0)),
            }
        )
        .drop("_mix_key", "_mix_first", "_mix_more", "_mix_cut", "_mix_limit")
    )


def _with(tickets: DataFrame, state: DataFrame) -> DataFrame:
    """Joins on the source. The state is a written table of one row a source, so Spark knows its size and
    broadcasts it only below its threshold; beyond, a skewed source is split by adaptive execution."""
    keyed = state.withColumnRenamed("_mix_source", "_mix_key")
    return tickets.join(keyed, F.col("_mix_source").eqNullSafe(F.col("_mix_key"))).drop("_mix_key")


def _passed() -> Column:
    """Whether a pass took the row: it was small enough for the pass and its ticket was not beyond the last."""
    return F.exists("_mix_passes", lambda p: (F.col("_mix_size") <= p["limit"]) & (F.col("_mix_ticket") <= p["last"]))


@dataclass(frozen=True)
class Mixture:
    """The state of a mixture: one row per source with its size, target and selection."""

    state: DataFrame
    seed: int
    id_col: str
    text_col: str
    source_col: str
    shared: DataFrame | None = None

    def _taken(self, rows: DataFrame) -> DataFrame:
        extra = _passed() | F.coalesce(F.col("_mix_ticket") == F.col("_mix_fill"), F.lit(False))
        repeats = F.col("_mix_whole") + F.when(extra & (F.col("_mix_extra") > 0), 1).otherwise(0)
        return _with(rows, self.state).withColumn("_mix_repeats", repeats)

    def plan(self, rows: DataFrame) -> DataFrame:
        """Per row of ``rows``: its id, size, source size, target and words taken."""
        return self._taken(rows).select(
            F.col(self.id_col),
            F.col("_mix_size").alias("size"),
            F.col("_mix_source_size").alias("source_size"),
            F.col("_mix_target").alias("target"),
            (F.col("_mix_size") * F.col("_mix_repeats")).cast("long").alias("taken"),
            F.col("_mix_repeats").cast("int").alias("repeats"),
        )

    def rows(self, docs: DataFrame) -> DataFrame:
        """The mixed documents themselves: each row as often as the mixture takes it."""
        tickets = _numbered(sized(docs, self.id_col, self.text_col, self.source_col, self.seed), self.shared)
        copies = F.explode(F.sequence(F.lit(1), F.col("_mix_repeats")))
        taken = self._taken(tickets).where(F.col("_mix_repeats") > 0)
        return taken.withColumn("_mix_copy", copies).select(*docs.columns)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | DataFrame = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[Mixture, DataFrame]:
    """Plans a mixture; returns it with the table of sizes and tickets that it was planned from.

    ``weights`` are dealt out in order of the sources, or come as a table (source, weight). Every document is
    taken whole ``floor(target / size)`` times. What is left of the target is filled by one more
    repetition of the documents with the lowest seeded tickets, pass by pass over those that still fit until none
    does, and by one more where it comes nearer to the target. A pass ends at a document larger than its rest."""
    tickets = materialised(
        sized(docs, id_col, text_col, source_col, seed).select(
            F.col(id_col), "_mix_source", "_mix_size", "_mix_ticket"
        )
    )
    shared = materialised(tickets.groupBy("_mix_ticket").count().where("count > 1").select("_mix_ticket"))
    if shared.limit(1).count():
        tickets = materialised(_numbered(tickets, shared))
    else:
        shared = None
    sources = tickets.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col(weights.columns[0]).alias("_mix_key"), F.col(weights.columns[1]).alias("_w"))
        weighed = sources.join(given, F.col("_mix_source").eqNullSafe(F.col("_mix_key")), "left").select(
            *sources.columns, F.coalesce(F.col("_w").cast("double"), F.lit(0.0)).alias("_mix_weight")
        )
    else:
        weighed = cyclic_weights(sources, tuple(weights))
    targets = water_fill(materialised(weighed), share, epochs)
    size = F.col("_mix_source_size")
    whole = F.when(size > 0, F.floor(F.col("_mix_target") / size)).otherwise(0)
    state = materialised(
        targets.withColumn("_mix_whole", whole).withColumn(
            "_mix_extra", F.col("_mix_target") - F.col("_mix_whole") * size
        )
    )
    passes = F.array().cast("array<struct<limit:double,last:bigint>>")
    state = state.withColumns({"_mix_rest": F.col("_mix_extra"), "_mix_passes": passes})
    left = tickets
    while True:
        fits = (F.col("_mix_size") > 0) & (F.col("_mix_size") <= F.col("_mix_rest")) & ~_passed()
        left = materialised(_with(left, state).where(fits).select(*tickets.columns))
        if not left.limit(1).count():
            break
        state = _cut(left, state)  # takes at least the first that fits
    # Nothing fits any more; the document that comes nearest from above, if it misses by less.
    nearest = (
        _with(tickets, state)
        .where((F.col("_mix_size") > F.col("_mix_rest")) & (F.col("_mix_size") <= F.col("_mix_rest") * 2) & ~_passed())
        .groupBy("_mix_source")
        .agg(F.min(F.struct("_mix_size", "_mix_ticket")).alias("_mix_best"))
        .withColumnRenamed("_mix_source", "_mix_key")
    )
    state = materialised(
        state.join(nearest, F.col("_mix_source").eqNullSafe(F.col("_mix_key")), "left")
        .withColumn("_mix_fill", F.col("_mix_best._mix_ticket"))
        .drop("_mix_key", "_mix_best")
    )
    return Mixture(state, seed, id_col, text_col, source_col, shared), tickets
