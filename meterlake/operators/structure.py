"""Song structure: feature points, robust novelty, boundaries, sections and neutral families.

Long form throughout: a point reaches the boundaries it is context of by an explode of fixed size (28 rows), so
there is no range join, and every step is keyed by track and pass. Only the choice among peaks and the
assignment of families are sequential; both fold over what is bounded (peaks of one pass, at most 96 sections).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as X
from . import selection, timeline

KEY = timeline.KEY
REGION_COLUMNS = [f"region_{n}" for n, *_ in dims.REGIONS]
#: Feature groups, their weights, and the floors of the robust scale.
GROUPS = {"energy": ["rms_db", "lufs_s"], "spectrum": ["centroid_log2", *REGION_COLUMNS], "stereo": ["stereo_correlation", "stereo_width"], "dynamics": ["crest_db"], "temporal": ["flux_log"]}
NOVELTY = {"activity": 0.25, "energy": 0.20, "spectrum": 0.20, "chroma": 0.15, "stereo": 0.08, "dynamics": 0.06, "temporal": 0.06}
SIMILARITY = {"activity": 0.30, "spectrum": 0.22, "energy": 0.18, "chroma": 0.15, "stereo": 0.07, "dynamics": 0.05, "duration": 0.03}
FLOORS = {"centroid_log2": 0.15, "flux_log": 0.15, "stereo_correlation": 0.08, "stereo_width": 0.05, "crest_db": 0.75}
LEAST_COVERAGE, CONTEXT_COVERAGE = 0.2, 0.35


def points(partials: DataFrame) -> DataFrame:
    """One feature row per bin (C04); features are null below the coverage floor."""
    rows = timeline.finalize(partials, [*KEY, "bin_index"], F.lit(1.0))
    ok = F.col("coverage_ratio") >= LEAST_COVERAGE
    features = [c for g in GROUPS.values() for c in g]
    rows = rows.withColumns({"centroid_log2": F.when(F.col("centroid_hz") > 0, F.log2("centroid_hz")), "flux_log": F.log1p(1000 * F.greatest(F.lit(0.0), F.col("spectral_flux_mean")))})
    kept = [F.when(ok, F.col(c)).alias(c) for c in features if c in rows.columns]
    chroma = [F.when(ok, F.col(f"chroma_{i}")).alias(f"chroma_{i}") for i in range(12)] if "chroma_0" in rows.columns else []
    return rows.select(*KEY, "bin_index", F.col("coverage_ratio").alias("coverage"), "active_ratio", *kept, *chroma)


def robust(point_rows: DataFrame) -> DataFrame:
    """Long form (track, pass, bin, feature, z) with median and MAD per pass (C05; A20, A21)."""
    features = [c for g in GROUPS.values() for c in g if c in point_rows.columns]
    long = point_rows.unpivot([*KEY, "bin_index"], [F.col(c).cast("double").alias(c) for c in features], "feature", "x").where("x is not null")
    scale = selection.median_and_mad(long, [*KEY, "feature"], "x")
    floor = F.lit(1.0)
    for name, value in FLOORS.items():
        floor = F.when(F.col("feature") == name, value).otherwise(floor)
    z = (F.col("x") - F.col("median")) / F.greatest(floor, 1.4826 * F.col("mad"))
    return long.join(scale, [*KEY, "feature"]).select(*KEY, "bin_index", "feature", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)).alias("z"))


def _context(rows: DataFrame) -> DataFrame:
    """Each bin as context of the boundaries near it: columns boundary, scale, right."""
    spots = [(s, d, d <= 0) for s in dims.SCALES for d in range(1 - s, s + 1)]
    near = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(d).alias("d"), F.lit(r).alias("right")) for s, d, r in spots])
    return rows.withColumn("near", F.explode(near)).withColumn("boundary", F.col("bin_index") + F.col("near.d")).select("*", "near.scale", "near.right").drop("near")


def _side(c: str, right: bool) -> Column:
    return F.avg(F.when(F.col("right") == right, F.col(c)))


def novelty(point_rows: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """Score of every boundary (C06): (track, pass, bin_index, score). ``activity``: (track, bin_index, active_ratio) of all tracks."""
    spot = [*KEY, "boundary", "scale"]
    context = _context(point_rows.select(*KEY, "bin_index", "coverage"))
    gate = context.groupBy(*spot).agg(
        F.count_if(~F.col("right")).alias("n_left"), F.count_if(F.col("right")).alias("n_right"), F.round(F.least(_side("coverage", False), _side("coverage", True)), 6).alias("coverage")
    )
    least = F.greatest(F.lit(1), F.ceil(F.col("scale") * 0.5))
    ends = point_rows.groupBy(*KEY).agg(F.min("bin_index").alias("first"), F.max("bin_index").alias("last"))
    gate = gate.where((F.col("n_left") >= least) & (F.col("n_right") >= least) & (F.col("coverage") >= CONTEXT_COVERAGE)).join(ends, KEY).where("boundary > first and boundary <= last")
    moved = _context(robust(point_rows)).groupBy(*spot, "feature").agg(F.abs(_side("z", True) - _side("z", False)).alias("d")).where("d is not null")
    group = F.lit(None).cast("string")
    for name, fields in GROUPS.items():
        group = F.when(F.col("feature").isin(fields), name).otherwise(group)
    parts = moved.groupBy(*spot, group.alias("part")).agg(X.change_score(F.avg("d")).alias("change"))
    if "chroma_0" in point_rows.columns:
        sides = _context(point_rows.where("chroma_0 is not null").select(*KEY, "bin_index", *[f"chroma_{i}" for i in range(12)]))
        means = sides.groupBy(*spot).agg(*[F.array(*[_side(f"chroma_{i}", r) for i in range(12)]).alias(n) for n, r in (("l", False), ("r", True))])
        near = X.cosine("l", "r")
        parts = parts.unionByName(means.select(*spot, F.lit("chroma").alias("part"), (1 - near).alias("change")).where("change is not null"))
    if activity is not None:
        track = _context(activity.select(F.col("runtime_id").alias("other"), "bin_index", "active_ratio")).groupBy("boundary", "scale", "other").agg(F.abs(_side("active_ratio", True) - _side("active_ratio", False)).alias("d"))
        moved = track.where("d is not null").groupBy("boundary", "scale").agg(F.avg("d").alias("change"))
        parts = parts.unionByName(gate.select(*spot).join(moved, ["boundary", "scale"]).select(*spot, F.lit("activity").alias("part"), "change"))
    weight = F.lit(None).cast("double")
    for name, w in NOVELTY.items():
        weight = F.when(F.col("part") == name, w).otherwise(weight)
    raw = parts.withColumn("w", weight).groupBy(*spot).agg((F.sum(F.col("w") * F.col("change")) / F.sum("w")).alias("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") * F.sqrt("coverage")))
    out = gate.join(raw, spot).withColumn("one", score)
    return out.groupBy(*KEY, F.col("boundary").alias("bin_index")).agg(F.avg("one").alias("score"), F.count("*").alias("scales"), F.min("coverage").alias("coverage"))


def smooth(scores: DataFrame) -> DataFrame:
    """Weights 1/4, 1/2, 1/4 over the neighbours that exist, by bin value."""
    shifts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])
    spread = scores.withColumn("s", F.explode(shifts)).select(*KEY, (F.col("bin_index") + F.col("s.d")).alias("bin_index"), (F.col("score") * F.col("s.w")).alias("x"), F.col("s.w").alias("w"), (F.col("s.d") == 0).alias("own"))
    return spread.groupBy(*KEY, "bin_index").agg((F.sum("x") / F.sum("w")).alias("smoothed"), F.bool_or("own").alias("own")).where("own").drop("own")


def peaks(smoothed: DataFrame, sensitivity: float = 0.55) -> DataFrame:
    """Bins at least as high as both neighbours (a missing one counts as -1) and over the threshold."""
    stats = smoothed.groupBy(*KEY).agg(F.percentile("smoothed", 0.5).alias("p50"), F.percentile("smoothed", 0.9).alias("p90"))
    sens = min(0.95, max(0.1, sensitivity))
    threshold = F.greatest(F.lit(0.12), F.col("p50") + sens * F.greatest(F.lit(0.0), F.col("p90") - F.col("p50")))
    w = Window.partitionBy(*KEY).orderBy("bin_index")
    near = lambda f, d: F.when(f("bin_index").over(w) == F.col("bin_index") + d, f("smoothed").over(w)).otherwise(F.lit(-1.0))
    marked = smoothed.withColumns({"prev": near(F.lag, -1), "next": near(F.lead, 1)})
    return marked.where("smoothed >= prev and smoothed >= next").join(stats, KEY).withColumn("threshold", threshold).where("smoothed >= threshold").select(*KEY, "bin_index", "smoothed", "threshold")


def boundaries(peak_rows: DataFrame, point_rows: DataFrame, least: int = 8, most: int = 48) -> DataFrame:
    """Peaks taken by score, keeping ``least`` seconds to the ends and to those taken."""
    ends = point_rows.groupBy(*KEY).agg(F.min("bin_index").alias("first"), (F.max("bin_index") + 1).alias("end"), F.count("*").alias("n")).where(F.col("n") >= max(12, 2 * least))
    inside = peak_rows.join(ends, KEY).where((F.col("bin_index") - F.col("first") >= least) & (F.col("end") - F.col("bin_index") >= least))
    lists = inside.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("smoothed")).alias("minus"), "bin_index"))).alias("p"))
    taken = F.aggregate(
        "p",
        F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) < most - 1) & ~F.exists(acc, lambda y: F.abs(y - x["bin_index"]) < least), F.concat(acc, F.array(x["bin_index"]))).otherwise(acc),
    )
    return lists.select(*KEY, F.explode(F.sort_array(taken)).alias("bin_index"))


def sections(boundary_rows: DataFrame, point_rows: DataFrame) -> DataFrame:
    """(track, pass, section, start, end) between boundaries."""
    ends = point_rows.groupBy(*KEY).agg(F.min("bin_index").alias("first"), (F.max("bin_index") + 1).alias("last"))
    starts = boundary_rows.select(*KEY, "bin_index").union(ends.select(*KEY, F.col("first").alias("bin_index")))
    w = Window.partitionBy(*KEY).orderBy("bin_index")
    out = starts.distinct().withColumns({"ord": F.row_number().over(w), "next": F.lead("bin_index").over(w)}).join(ends, KEY)
    return out.select(*KEY, F.format_string("S%02d", "ord").alias("section"), F.col("ord").cast("int").alias("ord"), F.col("bin_index").alias("start"), F.coalesce("next", "last").alias("end"))


def section_bins(section_rows: DataFrame, partials: DataFrame) -> DataFrame:
    """Sections with the bins they hold (J09). Bins are whole seconds, so a section explodes to its seconds and
    meets bins by equality, not by a range join. ``section_rows`` may leave out track and pass to meet all."""
    on = [c for c in KEY if c in section_rows.columns]
    seconds = section_rows.where("end > start").withColumn("bin_index", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    return seconds.join(partials, [*on, "bin_index"])


def summaries(section_rows: DataFrame, partials: DataFrame) -> DataFrame:
    """A summary per section (T34 core)."""
    joined = section_bins(section_rows, partials).withColumn("length", F.col("end") - F.col("start"))
    return timeline.finalize(joined, [*KEY, "section", "ord", "start", "end"], F.max("length").cast("double"))


def section_range(requests: DataFrame, maps: DataFrame) -> DataFrame:
    """Start, end and family of requested sections (C22): requests (request, map_id, section), maps (map_id, made, section, start, end, family).

    Section names are trimmed and upper-cased; a null ``map_id`` means the map made last. A request without a map
    or a section keeps its row, with the reason.
    """
    newest = maps.agg(F.max_by("map_id", "made").alias("newest"))
    asked = requests.crossJoin(F.broadcast(newest)).select("request", F.coalesce("map_id", "newest").alias("map_id"), F.upper(F.trim("section")).alias("section"))
    known = maps.select("map_id").distinct().withColumn("known", F.lit(True))
    spots = maps.select("map_id", F.upper("section").alias("section"), "start", "end", "family")
    reason = F.when(F.col("known").isNull(), "no_map").when(F.col("start").isNull(), "no_section")
    return asked.join(known, "map_id", "left").join(spots, ["map_id", "section"], "left").select("request", "map_id", "section", "start", "end", "family", reason.alias("reason"))


def _mean_of(parts: list[Column]) -> Column:
    have = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda acc, x: acc + x) / F.size(have))


def section_activity(section_rows: DataFrame, active: DataFrame) -> DataFrame:
    """How active every track is in each section of every pass: (track, pass, ord, other, active), from (runtime_id, bin_index, active_ratio)."""
    other = active.select(F.col("runtime_id").alias("other"), "bin_index", "active_ratio")
    seconds = section_rows.where("end > start").select(*KEY, "ord", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("bin_index"))
    return seconds.join(other, "bin_index").groupBy(*KEY, "ord", "other").agg(F.avg("active_ratio").alias("active"))


def section_similarity(summary: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """Similarity of all pairs of sections of a pass, rounded to 5 digits (C08 first half); ``activity`` is from section_activity."""
    pitches = [f"chroma_{i}" for i in range(12)]
    if set(pitches) <= set(summary.columns):
        summary = summary.withColumn("chroma", F.when(F.col(pitches[0]).isNotNull(), F.array(*pitches))).drop(*pitches)
    cols = [c for c in summary.columns if c not in KEY]
    a = summary.select(*KEY, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = summary.select(*KEY, *[F.col(c).alias(f"{c}_b") for c in cols])
    p = a.join(b, KEY).where("ord_a < ord_b")
    near = lambda c, scale: X.similarity(f"{c}_a", f"{c}_b", scale)
    logs = lambda c: F.log1p(1000 * F.greatest(F.lit(0.0), F.col(c)))
    ratio = F.when((F.col("centroid_hz_a") > 0) & (F.col("centroid_hz_b") > 0), F.exp(-F.abs(F.log2(F.try_divide("centroid_hz_a", "centroid_hz_b")))))
    length = F.ln((F.col("end_a") - F.col("start_a")) / (F.col("end_b") - F.col("start_b")))
    parts = {
        "energy": _mean_of([near("rms_db", 6.0), near("lufs_s", 6.0)]),
        "spectrum": _mean_of([ratio, *[near(r, 6.0) for r in REGION_COLUMNS if r in cols]]),
        "stereo": _mean_of([near("stereo_correlation", 0.5), near("stereo_width", 0.75)]),
        "dynamics": _mean_of([near("crest_db", 6.0), X.similarity(logs("spectral_flux_mean_a"), logs("spectral_flux_mean_b"), 1.0)]),
        "duration": F.exp(-F.abs(length) / 0.7),
    }
    if "chroma" in cols:
        parts["chroma"] = X.cosine("chroma_a", "chroma_b")
    if activity is not None:
        x, y = (activity.select(*KEY, F.col("ord").alias(f"ord_{n}"), "other", F.col("active").alias(f"active_{n}")) for n in "ab")
        moved = x.join(y, [*KEY, "other"]).where("ord_a < ord_b").groupBy(*KEY, "ord_a", "ord_b").agg((1 - F.avg(F.abs(F.col("active_a") - F.col("active_b")))).alias("activity"))
        p = p.join(moved, [*KEY, "ord_a", "ord_b"], "left")
        parts["activity"] = F.col("activity")
    # Parts as one array: each is used twice below, and long expressions are not to be repeated.
    order = list(parts)
    p = p.select(*KEY, "ord_a", "ord_b", F.array(*[parts[n] for n in order]).alias("parts"))
    weights = F.array(*[F.lit(SIMILARITY[n]) for n in order])
    add = lambda f: F.aggregate(F.zip_with("parts", weights, f), F.lit(0.0), lambda acc, x: acc + x)
    score = F.try_divide(add(lambda x, w: F.coalesce(x * w, F.lit(0.0))), add(lambda x, w: F.when(x.isNotNull(), w).otherwise(0.0)))
    return p.select(*KEY, "ord_a", "ord_b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 5).alias("score"))


def families(section_rows: DataFrame, pairs: DataFrame, threshold: float = 0.78) -> DataFrame:
    """Sections in order join the family of highest mean similarity if it reaches the threshold, else found one
    (C08 second half): (track, pass, ord, family, occurrence). A pass has at most 96 sections."""

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        score = {(a, b): s for a, b, s in zip(right["ord_a"], right["ord_b"], right["score"], strict=True)}
        members: list[list[int]] = []
        out = []
        for o in sorted(left["ord"]):
            known = [[x for m in f if (x := score.get((m, o))) is not None and x == x] for f in members]
            means = [sum(f) / len(f) if f else -1.0 for f in known]  # missing scores are left out
            best = max(range(len(means)), key=lambda i: (means[i], -i), default=None)
            if best is None or means[best] < threshold:
                best = len(members)
                members.append([])
            members[best].append(o)
            out.append((*key, o, chr(65 + best) if best < 26 else chr(64 + best // 26) + chr(65 + best % 26), len(members[best])))
        return pd.DataFrame(out, columns=[*KEY, "ord", "family", "occurrence"])

    # Fresh columns on both sides: they may come from the same table.
    left, right = (df.select(*[F.col(c).alias(c) for c in [*KEY, *rest]]) for df, rest in ((section_rows, ["ord"]), (pairs, ["ord_a", "ord_b", "score"])))
    return left.groupBy(*[F.col(c) for c in KEY]).cogroup(right.groupBy(*[F.col(c) for c in KEY])).applyInPandas(assign, "runtime_id string, transport_epoch int, ord int, family string, occurrence int")


def fixed_sections(length: int = 24, until: int = 180) -> list[tuple[str, int, int, int]]:
    """A section table by the clock: (section, ord, start, end)."""
    return [(f"S{i + 1:02d}", i + 1, s, min(until, s + length)) for i, s in enumerate(range(0, until, length))]
