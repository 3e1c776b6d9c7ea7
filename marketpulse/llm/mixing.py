"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents are counted into cells (source, language, topic) of token weights. The cells are raked: scaled in turn so that
each margin meets its target shares, until all do. A cell's fitted weight over its tokens is the inclusion probability of
its documents, on the scale at which the largest is 1, so no cell is asked for more than it has.

On that scale the rarest cell decides how much stays. With a wanted share of all tokens the probabilities are
min(1, factor * weight/tokens) instead: cells that are taken whole stay at 1, and the others make up for them, so that the
share and all margins are met as far as the cells have tokens. `report` tells what was met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import n_words
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

CAP_SWEEPS, CAP_ROUNDS, CAP_TOLERANCE = 2, 12, 1e-9
MARGINS = ("source", "lang", "topic")
#: Exponents on the observed shares of a margin: 1 keeps them, 0 makes all values equal.
TEMPERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Topics by what a text holds, the first that fits; else `prose`.
TOPICS = (("licence", ("License", "license", "LICENSE")), ("contact", ("@",)), ("table", ("|",)))
NO_VALUE = "(none)"
SWEEPS, MAX_ROUNDS, TOLERANCE = 6, 8, 1e-12
SEED = "mix"
#: Up to so many cells are raked in one task, without any shuffle; more are dealt out by margin.
ONE_TASK_CELLS = 50_000


def topic(text: Column) -> Column:
    """Topic of a text; null has none."""
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(text, F.lit(mark))
        out = F.when(found, name).otherwise(out)
    return F.when(text.isNotNull(), out)


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) drawn by the id: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, tempers: dict[str, float] | None = None,
         targets: dict[str, dict[str, float]] | None = None, share: float | None = None) -> DataFrame:
    """Cells (margins, tokens > 0) with their fitted `weight` (adds up to 1) and `rate` (inclusion probability).

    share: the wanted part of all tokens (0 to 1); without it the largest rate is 1 and nothing else is asked. The wanted
    shares of each margin are in columns `to_` and its name.

    A margin with given targets takes those shares, scaled to 1; a value that is not listed gets 0. Other margins take the
    observed shares to the power of their temper.
    """
    tempers, targets = {**TEMPERS, **(tempers or {})}, targets or {}
    cells = cells.select(*margins, F.col("tokens").cast("double").alias("tokens"))
    goal = []
    for m in margins:
        shares = cells.groupBy(m).agg(F.sum("tokens").alias("tokens"))
        if m in targets:
            want = F.lit(0.0)
            for value, part in sorted(targets[m].items()):
                want = F.when(F.col(m) == value, float(part)).otherwise(want)
        else:
            want = F.pow("tokens", F.lit(tempers.get(m, 1.0)))
        shares = shares.select(m, want.alias("want"))
        total = shares.agg(F.sum("want").alias("total"))
        goal.append(shares.crossJoin(F.broadcast(total)).select(m, F.when(F.col("total") > 0, F.col("want") / F.col("total")).otherwise(0.0).alias(f"to_{m}")))
    fitted = cells
    for m, shares in zip(margins, goal):
        fitted = fitted.join(shares, m)
    fitted = materialize(fitted.withColumn("weight", F.col("tokens")), "cells")
    few = fitted.count() <= ONE_TASK_CELLS
    for _ in range(MAX_ROUNDS):
        now = fitted.coalesce(1) if few else fitted
        for _ in range(SWEEPS):
            for m in margins:
                whole = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("weight", F.when(whole > 0, F.col("weight") * F.col(f"to_{m}") / whole).otherwise(0.0))
        fitted = materialize(now, "raked")
        if max(_gap(fitted, m) for m in margins) < TOLERANCE:
            break
    if share is not None:
        return _capped(fitted, margins, share)
    most = F.max(F.col("weight") / F.col("tokens")).alias("most")
    out = fitted.crossJoin(F.broadcast(fitted.agg(most)))
    rate = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens") / F.col("most"))).otherwise(0.0)
    return out.select(*margins, "tokens", "weight", rate.alias("rate"), *[f"to_{m}" for m in margins])


def _factor(goal: Column, room: str, want: str, within: list[str], ties: list[str]) -> Column:
    """A number for each row; the largest of a group is the x at which its sum of min(room, x * want) is the goal.

    The sum is concave in x, so of the solutions with none, one, two... of the rows that fill up first taken whole the
    largest holds. If a group has less than the goal, that x takes all of it.
    """
    fills = F.col(room) / F.col(want)
    full = Window.partitionBy(*within).orderBy(fills, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*within).orderBy(fills.desc(), *[F.col(t).desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    return (goal - F.coalesce(F.sum(room).over(full), F.lit(0.0))) / F.sum(want).over(rest)


def _capped(fitted: DataFrame, margins: tuple[str, ...], share: float) -> DataFrame:
    """Cells raked again with no cell above its tokens, to a total of `share` of all tokens or what the targets allow."""
    values, wanted = {}, float(min(1.0, max(0.0, share))) * (fitted.agg(F.sum("tokens")).first()[0] or 0.0)
    for m in margins:
        held = fitted.groupBy(m).agg(F.sum("tokens").alias("held"), F.first(f"to_{m}").alias("want"))
        values[m] = materialize(held, "margin").where("want > 0")
        wanted = min(wanted, values[m].agg(F.sum("held")).first()[0] or 0.0)
    now = fitted.withColumn("asked", F.col("weight") * wanted)
    for m in margins:
        # What a value of the margin lacks, the others make up for in proportion.
        solved = values[m].withColumn("one", F.lit(1)).withColumn("factor", _factor(F.lit(wanted), "held", "want", ["one"], [m]))
        solved = solved.withColumn("factor", F.max("factor").over(Window.partitionBy("one")))
        goal = solved.select(m, F.least(F.col("held"), F.col("factor") * F.col("want")).alias(f"goal_{m}"))
        now = now.join(broadcast_if_small(materialize(goal, "goal")), m, "left")
    alive, now = F.col("asked") > 0, materialize(now, "asked")
    few = now.count() <= ONE_TASK_CELLS
    for _ in range(CAP_ROUNDS if wanted > 0 else 0):
        turn = now.where(alive).coalesce(1) if few else now.where(alive)
        for _ in range(CAP_SWEEPS):
            for m in margins:
                turn = turn.withColumn("factor", _factor(F.col(f"goal_{m}"), "tokens", "asked", [m], [o for o in margins if o != m]))
                turn = turn.withColumn("factor", F.max("factor").over(Window.partitionBy(m)))
                # Bounded, as cells that cannot meet all margins together would ask for ever more.
                turn = turn.withColumn("asked", F.least(F.col("asked") * F.col("factor"), F.col("tokens") * 1e9))
        now = materialize(turn.unionByName(now.where(~alive).withColumn("factor", F.lit(0.0))).drop("factor"), "capped")
        taken = F.sum(F.least("asked", "tokens"))
        gaps = [now.groupBy(m).agg(F.abs(taken - F.first(f"goal_{m}")).alias("gap")).agg(F.max("gap")).first()[0] or 0.0 for m in margins]
        if max(gaps) < CAP_TOLERANCE * wanted:
            break
    taken = F.least("asked", "tokens")
    whole = now.agg(F.sum(taken).alias("whole"))
    out = now.crossJoin(F.broadcast(whole))
    return out.select(*margins, "tokens", F.when(F.col("whole") > 0, taken / F.col("whole")).otherwise(0.0).alias("weight"),
                      (taken / F.col("tokens")).alias("rate"), *[f"to_{m}" for m in margins])


def report(cells: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """margin, value, tokens, kept_share (of its tokens), share (of all kept tokens), wanted, gap; margin and value `all` for the whole.

    cells: as `rake` gives them. Kept tokens are expected ones: tokens times rate.
    """
    kept = F.sum(F.col("tokens") * F.col("rate"))
    whole = cells.agg(F.sum("tokens").alias("tokens"), kept.alias("kept"))
    total = whole.select(F.col("kept").alias("total"))
    out = whole.select(F.lit("all").alias("margin"), F.lit("all").alias("value"), "tokens", "kept", F.lit(1.0).alias("wanted"))
    for m in margins:
        out = out.unionByName(cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(
            F.sum("tokens").alias("tokens"), kept.alias("kept"), F.first(f"to_{m}").alias("wanted")))
    got = F.when(F.col("total") > 0, F.col("kept") / F.col("total"))
    return out.crossJoin(F.broadcast(total)).select("margin", "value", "tokens", (F.col("kept") / F.col("tokens")).alias("kept_share"),
                                                    got.alias("share"), "wanted", (got - F.col("wanted")).alias("gap"))


def _gap(cells: DataFrame, m: str) -> float:
    sums = cells.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"to_{m}").alias("t"))
    return sums.agg(F.max(F.abs(F.col("w") - F.col("t")))).first()[0] or 0.0


def mix(docs: DataFrame, keep: list[str], tempers: dict[str, float] | None = None,
        targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None, share: float | None = None) -> DataFrame:
    """The columns `keep` of every document, then n_tokens, rate and kept: whether calibrated sampling chose it.

    docs: doc_id, text, lang, source. Null sources, languages and topics are a value of their own. Tokens are words between
    white space; a document without any has no weight and is kept with its cell's rate, 0 if the cell has no tokens at all. Rows of one doc_id share
    their fate if they share their cell. share: the part of all tokens to keep; see `rake`. An empty table gives an empty result.
    """
    configure(docs.sparkSession)
    text = F.col("text").cast("string")
    names = [f"c{i}" for i in range(len(keep))]
    none = lambda c: F.coalesce(c, F.lit(NO_VALUE))
    values = [none(F.col("source").cast("string")), none(F.col("lang").cast("string")), none(topic(text) if topic_of is None else topic_of)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], uniform(F.col("doc_id")).alias("draw"),
                       *[v.alias(m) for v, m in zip(values, MARGINS)], n_words(text).alias("n_tokens"))
    cells = docs.select(*[v.alias(m) for v, m in zip(values, MARGINS)], n_words(text).alias("n_tokens")).groupBy(*MARGINS).agg(
        F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    cells = rake(materialize(cells, "cell-tokens"), MARGINS, tempers, targets, share).select(*MARGINS, "rate")
    cells = broadcast_if_small(materialize(cells, "rates"))
    out = rows.join(cells, list(MARGINS), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return out.select(*names, "n_tokens", "rate", (F.col("draw") < F.col("rate")).alias("kept")).toDF(*keep, "n_tokens", "rate", "kept")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, all columns."""
    names = docs.columns
    mixed = mix(docs, names, **options).toDF(*[f"c{i}" for i in range(len(names) + 3)])
    return mixed.where(F.col(f"c{len(names) + 2}")).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
