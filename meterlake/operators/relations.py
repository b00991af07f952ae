"""Sections across tracks: stories, pair evidence and what changes between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import structure, timeline

COVERAGE = 0.2
METRICS = ["rms_db", "crest_db", "centroid_hz", "stereo_correlation", "stereo_width", "active_ratio"]
REGIONS = structure.REGION_COLUMNS


def select_passes(partials: DataFrame, start: int, end: int, preferred: int | None = None) -> DataFrame:
    """One pass per track for a range (C03): most covered seconds, then the larger number; a preferred pass
    wins if it has any bin there. Unlike C02, reception time plays no part."""
    inside = timeline.overlapping(partials, start, end)
    totals = inside.groupBy(*timeline.KEY).agg(F.sum(F.bit_count("coverage_mask")).alias("slots"))
    want = F.lit(False) if preferred is None else F.col("transport_epoch") == preferred
    best = totals.groupBy("runtime_id").agg(F.max(F.struct(want.alias("preferred"), "slots", "transport_epoch")).alias("b"))
    return best.select("runtime_id", F.col("b.transport_epoch").alias("transport_epoch"))


def section_tracks(sections: DataFrame, partials: DataFrame, passes: DataFrame) -> DataFrame:
    """A summary of every track in every section (J09, T34): sections without track meet all chosen passes."""
    chosen = partials.join(passes, timeline.KEY, "left_semi")
    joined = structure.section_bins(sections, chosen).withColumn("length", F.col("end") - F.col("start"))
    rows = timeline.finalize(joined, ["runtime_id", "section", "ord"], F.max("length").cast("double"))
    return rows.withColumn("evidence", F.col("coverage_ratio") >= COVERAGE)


def section_deltas(rows: DataFrame) -> DataFrame:
    """Change of each measure against the section before (W05); null if either side lacks coverage."""
    w = Window.partitionBy("runtime_id").orderBy("ord")
    both = F.col("evidence") & F.lag("evidence").over(w)
    return rows.select("runtime_id", "section", "ord", *[F.when(both, F.round(F.col(c) - F.lag(c).over(w), 4)).alias(f"{c}_delta") for c in METRICS])


def family_stats(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Mean, least, most and spread of each measure by track and family (G04, A25), over sections with evidence."""
    long = rows.where("evidence").join(families, "section").unpivot(["runtime_id", "family"], [F.col(c).cast("double").alias(c) for c in METRICS], "metric", "x").where("x is not null")
    return long.groupBy("runtime_id", "family", "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.min("x"), 4).alias("least"), F.round(F.max("x"), 4).alias("most"), F.round(F.max("x") - F.min("x"), 4).alias("spread")
    )


def extremes(rows: DataFrame) -> DataFrame:
    """The sections where each measure is least and most (O05); ties go to the earlier section."""
    long = rows.where("evidence").unpivot(["runtime_id", "section", "ord"], [F.col(c).cast("double").alias(c) for c in METRICS], "metric", "x").where("x is not null")
    agg = long.groupBy("runtime_id", "metric").agg(F.min(F.struct("x", "ord", "section")).alias("lo"), F.min(F.struct((-F.col("x")).alias("x"), "ord", "section")).alias("hi"))
    return agg.select("runtime_id", "metric", F.col("lo.section").alias("least_section"), F.col("hi.section").alias("most_section"))


def _shape(side: str) -> Column:
    """Region powers normalised to one; null if a region is."""
    powers = [X.power(f"{r}_{side}") for r in REGIONS]
    total = sum(powers[1:], powers[0])
    return F.array(*[p / total for p in powers])


def pair_sections(rows: DataFrame, most_tracks: int = 24, least_overlap: float = 0.15, least_priority: float = 0.18) -> DataFrame:
    """Evidence of every pair of tracks in every section, with its status."""
    w = Window.partitionBy("section").orderBy(F.desc("active_ratio"), "runtime_id")
    near = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_tracks)
    have = [r for r in REGIONS if r in rows.columns]
    cols = ["runtime_id", "active_ratio", "coverage_ratio", "rms_db", "stereo_width", *have]
    a, b = (near.select("section", "ord", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    p = a.join(b.drop("ord"), "section").where("runtime_id_a < runtime_id_b")
    covered = F.least("coverage_ratio_a", "coverage_ratio_b") >= COVERAGE
    overlap = F.round(F.least("active_ratio_a", "active_ratio_b"), 4)
    parts = [(0.3, X.proximity(F.col("rms_db_a") - F.col("rms_db_b"), 24.0)), (0.2, X.proximity(F.col("stereo_width_a") - F.col("stereo_width_b"), 1.5))]
    if have:
        spectral = F.aggregate(F.zip_with(_shape("a"), _shape("b"), lambda x, y: F.least(x, y)), F.lit(0.0), lambda acc, x: acc + x)
        parts.append((0.5, F.when(F.forall(_shape("a"), lambda x: x.isNotNull()) & F.forall(_shape("b"), lambda x: x.isNotNull()), spectral)))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    shape = F.round(F.try_divide(sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts), F.lit(0.0)), weight), 4)
    p = p.withColumns({"overlap": F.when(covered, overlap), "shape": F.when(covered, shape)}).withColumn("priority", F.round(F.col("overlap") * F.col("shape"), 4))
    status = (
        F.when(~covered, "insufficient_coverage")
        .when(F.col("overlap").isNull() | F.col("priority").isNull(), "missing_activity_evidence")
        .when(F.col("overlap") < least_overlap, "insufficient_activity_overlap")
        .when(F.col("priority") < least_priority, "below_shortlist_threshold")
        .otherwise("shortlisted")
    )
    louder = F.when(F.abs(F.col("rms_db_a") - F.col("rms_db_b")) >= 0.25, F.when(F.col("rms_db_a") > F.col("rms_db_b"), F.col("runtime_id_a")).otherwise(F.col("runtime_id_b")))
    return p.select(X.pair_id("runtime_id_a", "runtime_id_b").alias("pair_id"), "section", "ord", "overlap", "shape", "priority", status.alias("status"), louder.alias("louder"))


def shortlist_changes(pair_rows: DataFrame) -> DataFrame:
    """Pairs that enter, leave or stay in the shortlist from one section to the next."""
    w = Window.partitionBy("pair_id").orderBy("ord")
    now, before = F.col("status"), F.lag("status").over(w)
    kind = F.when((now == "shortlisted") & (before != "shortlisted"), "entered_shortlist").when((now != "shortlisted") & (before == "shortlisted"), "left_shortlist").when(now != before, "availability_changed")
    return pair_rows.withColumn("change", kind).where("change is not null").select("pair_id", "section", "change")


def top_relations(pair_rows: DataFrame, k: int = 12) -> DataFrame:
    """The pairs of highest priority over all sections."""
    best = pair_rows.groupBy("pair_id").agg(F.max("priority").alias("top"), F.round(F.avg("priority"), 4).alias("mean"), F.count_if(F.col("status") == "shortlisted").alias("sections"))
    return best.where("top is not null").orderBy(F.desc("top"), F.desc("mean"), F.desc("pair_id")).limit(k)



def family_presence(pair_rows: DataFrame, families: DataFrame) -> DataFrame:
    """Each pair by family (G05): its sections observed, shortlisted and unavailable, the shortlisted share and the top priority."""
    seen = ~F.col("status").isin("insufficient_coverage", "missing_activity_evidence")
    short = F.col("status") == "shortlisted"
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("section")))), ",")
    return pair_rows.join(families, "section").groupBy("pair_id", "family").agg(
        F.count_if(seen).alias("observed"),
        listed(short).alias("shortlisted_sections"),
        listed(~seen).alias("unavailable_sections"),
        F.round(F.try_divide(F.count_if(short), F.count_if(seen)), 5).alias("shortlisted_ratio"),
        F.round(F.max(F.when(short, F.col("priority"))), 5).alias("top_priority"),
    )


def family_counts(families: DataFrame, by: list[str]) -> DataFrame:
    """Sections of each family."""
    return families.groupBy(*by, "family").agg(F.count("*").alias("sections"))


def similar_sections(similarity: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Of each section the k most similar others, whichever side of the pair it is."""
    sides = [similarity.select(*by, F.col(f"ord_{x}").alias("ord"), F.col(f"ord_{y}").alias("other"), "score") for x, y in ("ab", "ba")]
    w = Window.partitionBy(*by, "ord").orderBy(F.desc("score"), "other")
    return sides[0].union(sides[1]).where("score is not null").withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
