"""Mixing sources to target weights that change over training: a curriculum.

Each source's share of the token stream is piecewise linear in training time t from 0 to 1, given at common knots and
normalised there. Its integral times the token budget is the source's cumulative demand. Within a source, documents stand in
a hashed order; the one that begins at cumulative token c is trained on when demand reaches c: its position is the inverse of
the demand at c. Documents beyond the demand are left out; where demand exceeds supply the source is repeated as often as that
takes. Where max_epochs bounds the repeats, a source that reaches its bound ends there, and its share goes to the others in
proportion to theirs from then on (an additional knot); so does the share of a scheduled source without tokens. What a source
falls short of its own target is reported by shortfall(). The result is range-sorted by position.

Cumulative tokens come from sums by (source, hash bucket) and a window within each bucket, so a hot source is spread over
many tasks, and the order doesn't depend on the partitioning.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and takes the position where it
stands; a source without any tokens has no demand, its documents are left out; null doc_ids and repeated rows are placed like any other row; ties in the order are broken by doc_id and text; an
empty table gives no rows; other columns are carried along; the two
that this operator adds, whose names are parameters, take the place of any of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ready

KNOTS, TEMPERATURE, MAX_EPOCHS = (0.0, 1.0), 0.5, None
ROWS_A_BUCKET, MOST_BUCKETS = 4000, 1 << 20


def natural_to_tempered(sources: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """The default schedule: from the sources' shares of tokens at the start to those shares to the power temperature at the end."""
    all_ = sources.agg(F.sum("_supply").alias("_t"), F.sum(F.pow(F.col("_supply").cast("double"), F.lit(temperature))).alias("_p"))
    x = sources.crossJoin(F.broadcast(all_))
    return x.select("_s", "_supply", F.array(F.col("_supply") / F.col("_t"), F.pow(F.col("_supply").cast("double"), F.lit(temperature)) / F.col("_p")).alias("_share"))


def water_filled(supply: np.ndarray, share: np.ndarray, knots: tuple, budget: float, most: int | None) -> tuple[list, np.ndarray]:
    """Segments (t0, t1, p0, p1, d0, d1, b) by source and the tokens that each gets; share: by source and knot. A source that
    has been repeated most times ends; those that are left are normalised anew, there and at the knots that follow."""
    cap = np.where(supply > 0, np.inf if most is None else supply * float(most), 0.0)
    live, d, segs = cap > 0, np.zeros(len(supply)), [[] for _ in supply]
    for k in range(len(knots) - 1):
        p, q, t0, t1 = share[:, k], share[:, k + 1], float(knots[k]), float(knots[k + 1])
        while t1 > t0:
            a, b = np.where(live, p, 0.0), np.where(live, q, 0.0)
            if not a.any() and not b.any():
                break
            # where all weights vanish at one end, their ratios are those of the other end
            a, b = (a if a.any() else b), (b if b.any() else a)
            a, b, h = a / a.sum(), b / b.sum(), t1 - t0
            over = live & (d + budget * (a + b) / 2 * h > cap)
            x = np.full(len(d), h)
            r = (cap[over] - d[over]) / budget
            x[over] = 2 * r / np.maximum(a[over] + np.sqrt(np.maximum(a[over] ** 2 + 2 * (b[over] - a[over]) / h * r, 0.0)), 1e-300)
            step = min(h, float(x.min()))
            ends = over & (x <= step)
            up = np.where(ends, cap, d + budget * (a * step + (b - a) * step * step / (2 * h)))
            if step > 0:
                for i in np.flatnonzero(up > d).tolist():
                    segs[i].append((t0, t0 + step, float(a[i]), float(a[i] + (b[i] - a[i]) * step / h), float(d[i]), float(up[i]), float(budget)))
                d = up
            live = live & ~ends
            p, t0 = p + (q - p) * step / h, t0 + step if ends.any() else t1
    return segs, d


def _on_driver(sources: DataFrame, schedule: dict | None, knots: tuple, budget: int | None, most: int | None, temperature: float):
    """(sources, supply, target, segments, tokens placed); a null source is "\0". Holds the sources on the driver."""
    budget = (sources.agg(F.sum("_supply")).first()[0] or 0) if budget is None else budget
    if schedule is not None:
        names = [s if s is not None else "\0" for s in schedule]
        t = sources.sparkSession.createDataFrame([(s,) for s in names], "_s string")
        have = {r["_s"]: r["_supply"] for r in sources.join(F.broadcast(t) if len(names) < 10_000 else t, "_s").collect()}
        share = np.array([[float(x) for x in w[: len(knots)]] for w in schedule.values()]).reshape(len(names), len(knots))
    else:
        have = {r["_s"]: r["_supply"] for r in sources.filter("_supply > 0").collect()}
        names, knots = sorted(have), KNOTS
        share = np.array([[have[s], float(have[s]) ** temperature] for s in names], float).reshape(len(names), 2)
    supply = np.array([have.get(s, 0) for s in names], float)
    norm = share.sum(0)
    share = share / np.where(norm > 0, norm, 1.0)
    target = budget * ((share[:, 1:] + share[:, :-1]) / 2 * np.diff(knots)).sum(1)
    return names, supply, target, *water_filled(supply, share, knots, float(budget), most)


def _sums(row: DataFrame) -> DataFrame:
    """Tokens by source and bucket, those before it, and the source's."""
    sums = row.groupBy("_s", "_b").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_b")
    return sums.select("_s", "_b", (F.sum("_sum").over(before) - F.col("_sum")).alias("_off"), F.sum("_sum").over(Window.partitionBy("_s")).alias("_supply"))


def _tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def shortfall(docs: DataFrame, schedule: dict | None = None, knots: tuple = KNOTS, budget: int | None = None, max_epochs: int | None = MAX_EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, supply, target, placed, short) in tokens: what each source of curriculum() falls short of its own target."""
    sources = docs.select(F.coalesce("source", F.lit("\0")).alias("_s"), _tokens("text").alias("_n")).groupBy("_s").agg(F.sum("_n").alias("_supply"))
    names, supply, target, _, placed = _on_driver(sources, schedule, knots, budget, max_epochs, temperature)
    rows = [(None if s == "\0" else s, int(n), float(t), float(p), max(0.0, float(t - p))) for s, n, t, p in zip(names, supply, target, placed)]
    return docs.sparkSession.createDataFrame(rows, "source string, supply bigint, target double, placed double, short double")


def position_in(c, segs):
    """Time at which the demand described by segs (t0, t1, p0, p1, d0, d1, b) reaches c tokens."""
    s = F.element_at(F.filter(segs, lambda x: c < x["d1"]), 1)
    q = (c - s["d0"]) / s["b"]
    a = (s["p1"] - s["p0"]) / (2 * (s["t1"] - s["t0"]))
    return F.least(s["t1"], s["t0"] + F.when(q > 0, 2 * q / (s["p0"] + F.sqrt(F.greatest(F.lit(0.0), s["p0"] * s["p0"] + 4 * a * q)))).otherwise(0.0))


def curriculum(docs: DataFrame, schedule: dict | None = None, knots: tuple = KNOTS, budget: int | None = None, max_epochs: int | None = MAX_EPOCHS, temperature: float = TEMPERATURE, position: str = "position", epoch: str = "epoch") -> DataFrame:
    """docs in training order, with position (0 to 1) and epoch; budget: tokens, by default those of docs."""
    ready(docs.sparkSession)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    hashed = F.xxhash64("_row.doc_id", "_row.text")
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    row = row.select("_row", F.coalesce("_row.source", F.lit("\0")).alias("_s"), F.pmod(hashed, F.lit(buckets)).alias("_b"), hashed.alias("_h"), _tokens("_row.text").alias("_n"))
    sums = _sums(row)
    sources = sums.select("_s", "_supply").distinct()
    if schedule is None and max_epochs is None:
        plan = natural_to_tempered(sources, temperature).crossJoin(F.broadcast(sources.agg(F.sum("_supply").cast("double").alias("_budget"))) if budget is None else sources.sparkSession.range(1).select(F.lit(float(budget)).alias("_budget")))
        p0, p1 = F.element_at("_share", 1), F.element_at("_share", 2)
        demand = F.col("_budget") * (p0 + p1) / 2
        segs = F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), p0.alias("p0"), p1.alias("p1"), F.lit(0.0).alias("d0"), demand.alias("d1"), F.col("_budget").alias("b")))
        plan = plan.select("_s", segs.alias("_segs"), demand.alias("_demand"))
    else:
        keys, _, _, segs, placed = _on_driver(sources, schedule, knots, budget, max_epochs, temperature)
        plan = docs.sparkSession.createDataFrame([(s, x, float(d)) for s, x, d in zip(keys, segs, placed)], "_s string, _segs array<struct<t0: double, t1: double, p0: double, p1: double, d0: double, d1: double, b: double>>, _demand double")
    buckets_ = sums.join(plan, "_s")
    within = Window.partitionBy("_s", "_b").orderBy("_h", "_row.doc_id", "_row.text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = row.join(buckets_, ["_s", "_b"]).withColumn("_c", F.col("_off") + F.sum("_n").over(within) - F.col("_n"))
    most = F.ceil(F.try_divide(F.col("_demand") - F.col("_c"), F.col("_supply"))).cast("int")
    times = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), most)), lambda e: (F.col("_c") + e * F.col("_supply")) < F.col("_demand"))
    out = placed.select("_row", "_segs", "_c", "_supply", F.explode(times).alias("_e"))
    out = out.select("_row", "_e", position_in((F.col("_c") + F.col("_e") * F.col("_supply")).cast("double"), F.col("_segs")).alias("_p"))
    kept = [F.col("_row").getField(c).alias(c) for c in names if c not in (position, epoch)]
    return out.sort("_p", "_row.doc_id", "_e").select(*kept, F.col("_p").alias(position), F.col("_e").alias(epoch))
