"""Mixing sources to target weights by entropy balancing.

Every document has a rate (its expected number of copies). Among all rates that meet the constraints, those are wanted
that are closest to the corpus (rate 1) in relative entropy: a source's documents must sum to the source's tokens and
keep its mean length, and no rate may pass max_repeat. The dual of this problem is convex with two unknowns per source;
its solution tilts the rates exponentially, rate = min(max_repeat, exp(a + b (tokens / mean - 1))). Newton iterations
solve it, each one aggregation over the table of (source, length, number of documents), all sources at once; only sums
per source reach the driver.

Rates become copies: the whole part, and one more for the documents with the smallest (hash - fraction). The cut on that
difference is found by two histograms per source so that the source's tokens meet its target to within a document or so.

Defined results: source names are compared trimmed and without case. Documents without a listed source are not selected.
A source that cannot reach its tokens (too few, even max_repeat times) is taken max_repeat times whole and reported as
not reached; a listed source without documents is reported with 0. Documents without tokens get no copies. Negative
or null weights count as 0. ``total_tokens`` defaults to the tokens of all documents of listed sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.session import checkpoint

#: mix_target holds one row per source; more than this is refused (they become literals of the plan).
MAX_SOURCES = 1000
BINS = 4096


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _by_source(values: dict[str, float], kind: str = "double") -> Column:
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast(kind)


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """{source: (weight, max_repeat)}; a source listed twice has its weights added and the larger max_repeat."""
    rows = targets.select(source_key(F.col("source")).alias("source"), "weight", "max_repeat").where("source is not null")
    rows = rows.groupBy("source").agg(F.sum("weight").alias("w"), F.max("max_repeat").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r.source: (max(0.0, float(r.w or 0)), max(0, int(r.m or 0))) for r in rows}


def solve(lengths: DataFrame, wanted: dict[str, float], cap: dict[str, int], have: dict[str, tuple[float, float]], rounds: int = 60) -> dict[str, tuple[float, float]]:
    """Dual solution (a, b) of each source: ``lengths`` is (source, n_tokens, docs), ``wanted`` the tokens of each source,
    ``have`` its (tokens, documents)."""
    mean = {s: have[s][0] / have[s][1] for s in wanted}
    goal = {s: wanted[s] / mean[s] for s in wanted}  # wanted number of documents, at the mean length
    at = {s: (0.0, 0.0) for s in wanted}
    open_ = set(wanted)
    step = {s: 1.0 for s in wanted}
    last = {s: math.inf for s in wanted}
    move = {s: (0.0, 0.0) for s in wanted}
    for _ in range(rounds):
        if not open_:
            break
        x = F.col("n_tokens") / _by_source(mean) - 1
        eta = _by_source({s: at[s][0] for s in open_}) + _by_source({s: at[s][1] for s in open_}) * x
        top = F.log(_by_source({s: float(cap[s]) for s in open_}))
        rate = F.exp(F.least(eta, top))
        free = F.when(eta < top, rate).otherwise(0.0)
        # value of the dual's potential: exp below the cap, linear above it
        psi = F.when(eta <= top, rate).otherwise(rate * (1 + eta - top))
        d = F.col("docs")
        sums = (
            lengths.where(F.col("source").isin(list(open_)))
            .groupBy("source")
            .agg(
                F.sum(rate * d).alias("g0"), F.sum(rate * x * d).alias("g1"), F.sum(psi * d).alias("f"),
                F.sum(free * d).alias("h00"), F.sum(free * x * d).alias("h01"), F.sum(free * x * x * d).alias("h11"),
            )
            .collect()
        )
        for r in sums:
            s, (a, b) = r.source, at[r.source]
            value = r.f - a * goal[s]
            if value > last[s] + 1e-9 * abs(last[s]) and step[s] > 1e-6:  # overshot: go back half way
                step[s] /= 2
                at[s] = (a - move[s][0] * step[s], b - move[s][1] * step[s])
                continue
            last[s], step[s] = value, 1.0
            g0, g1 = r.g0 - goal[s], r.g1
            if abs(g0) <= 1e-7 * goal[s] and abs(g1) <= 1e-7 * goal[s]:
                open_.discard(s)
                continue
            ridge = 1e-9 * (r.h00 + r.h11) + 1e-12
            h00, h01, h11 = r.h00 + ridge, r.h01, r.h11 + ridge
            det = h00 * h11 - h01 * h01
            if det <= 1e-18 * h00 * h11 or h11 <= ridge * 2:  # all lengths equal: one unknown
                da, db = -g0 / h00, 0.0
                if abs(g0) <= 1e-7 * goal[s]:
                    open_.discard(s)
                    continue
            else:
                da, db = -(h11 * g0 - h01 * g1) / det, -(h00 * g1 - h01 * g0) / det
            big = max(abs(da), abs(db), 2.0) / 2.0
            move[s] = (da / big, db / big)
            at[s] = (a + move[s][0], b + move[s][1])
    return at


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of documents ``sized`` (doc_id, source, n_tokens).

    selection: doc_id, source, n_tokens, rate, copies (copies > 0). report: source, wanted and actual tokens and shares.
    """
    target = read_targets(targets)
    spark = sized.sparkSession
    docs = sized.select("doc_id", source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    docs = docs.where(F.col("source").isin(list(target)) & (F.col("n_tokens") > 0))
    lengths = checkpoint(docs.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    rows = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t"), F.sum("docs").alias("d")).collect()
    have = {r.source: (float(r.t), float(r.d)) for r in rows}
    cap = {s: m for s, (_, m) in target.items()}
    weights = sum(w for w, _ in target.values()) or 1.0
    total = float(sum(t for t, _ in have.values()) if total_tokens is None else total_tokens)
    share = {s: w / weights for s, (w, _) in target.items()}
    goal = {s: share[s] * total for s in target}
    most = {s: have.get(s, (0.0, 0.0))[0] * cap[s] for s in target}
    within = {s: goal[s] for s in target if 0 < goal[s] < most[s]}
    solved = solve(lengths, within, cap, have)
    mean = {s: t / d for s, (t, d) in have.items()}
    eta = _by_source({s: a for s, (a, _) in solved.items()}) + _by_source({s: b for s, (_, b) in solved.items()}) * (
        F.col("n_tokens") / _by_source(mean) - 1
    )
    full = {s: float(cap[s]) for s in target if goal[s] >= most[s] and goal[s] > 0}
    top = _by_source({s: float(c) for s, c in cap.items()})
    rate = F.coalesce(_by_source(full), F.least(top, F.exp(eta)), F.lit(0.0))
    docs = docs.withColumn("rate", rate)
    base = F.floor(F.col("rate") + 1e-9)
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    docs = docs.withColumn("base", base.cast("int")).withColumn("e", u - (F.col("rate") - base))
    can = docs.where((F.col("base") < top) & F.col("source").isin(list(within)))
    sure = docs.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()
    missing = {s: goal[s] - sum(r.t for r in sure if r.source == s) for s in within}
    lo, hi = {s: -1.0 for s in within}, {s: 1.0 + 2**-20 for s in within}
    for _ in range(2):  # the second histogram refines the bin in which the first one ends
        width = {s: (hi[s] - lo[s]) / BINS for s in within}
        if not within:
            break
        at = F.floor((F.col("e") - _by_source(lo)) / _by_source(width))
        hist = can.where((F.col("e") >= _by_source(lo)) & (F.col("e") < _by_source(hi))).groupBy("source", at.alias("bin"))
        found = {s: {} for s in within}
        for r in hist.agg(F.sum("n_tokens").alias("t")).collect():  # at most sources x BINS rows
            found[r.source][r.bin] = r.t
        for s in within:
            k = 0
            while k < BINS and missing[s] >= found[s].get(k, 0):
                missing[s] -= found[s].get(k, 0)
                k += 1
            lo[s], hi[s] = lo[s] + k * width[s], lo[s] + (k + 1) * width[s]
    extra = (F.col("e") < _by_source(lo)) & (F.col("base") < top)
    copies = F.col("base") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    picked = docs.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "rate", "copies")
    wanted = spark.createDataFrame(
        [(s, share[s], cap[s], goal[s], have.get(s, (0.0, 0.0))[0], have.get(s, (0.0, 0.0))[1], s in within) for s in sorted(target)],
        "source string, wanted_share double, max_repeat int, wanted_tokens double, available_tokens double, available_docs double, reached boolean",
    )
    sums = picked.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.count("*").alias("documents"), F.max("copies").alias("largest_copies")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    report = wanted.join(sums, "source", "left").withColumn("actual_tokens", zero(F.col("t"))).drop("t")
    everything = report.agg(F.sum("actual_tokens").alias("all_tokens"))
    report = report.join(F.broadcast(everything)).withColumn("actual_share", F.col("actual_tokens") / F.col("all_tokens"))
    report = report.withColumn("share_of_wanted_total", F.col("actual_tokens") / F.lit(total or 1.0)).drop("all_tokens")
    return picked, report.withColumns({"documents": zero(F.col("documents")), "largest_copies": zero(F.col("largest_copies"))})
