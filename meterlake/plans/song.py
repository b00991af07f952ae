"""Registered queries on song structure, stories, relations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import compare, pairs, recent, relations, state, structure, timeline
from ..sources import frames as source
from ..sources.cache import TableCache
from . import oracle as sql
from . import tools
from .lineage import cut, shared_folder
from .tools import AS_OF, SUMMARY, SUMMARY_COLUMNS, WB, P, PS, partials, query, window

SECTIONS = "sec AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {o}, {a}, {b})" for n, o, a, b in structure.fixed_sections()) + ") v(section, ord, s0, s1))"
FAMILIES = "fam AS (SELECT section, CASE WHEN ord % 2 = 1 THEN 'A' ELSE 'B' END AS family FROM sec)"


def fixed(spark):
    return spark.createDataFrame(structure.fixed_sections(), "section string, ord int, start int, end int")


def labels(spark):
    return fixed(spark).select("section", F.when(F.col("ord") % 2 == 1, "A").otherwise("B").alias("family"))


_POINTS = f"""b AS ({sql.summary('runtime_id, transport_epoch, bin', '1')}), pt AS (SELECT runtime_id, transport_epoch, bin, coverage_ratio AS coverage, active_ratio,
 CASE WHEN coverage_ratio >= 0.2 THEN rms_db END AS rms_db, CASE WHEN coverage_ratio >= 0.2 THEN lufs_s END AS lufs_s, CASE WHEN coverage_ratio >= 0.2 AND centroid_hz > 0 THEN log2(centroid_hz) END AS centroid_log2,
 CASE WHEN coverage_ratio >= 0.2 THEN stereo_correlation END AS stereo_correlation, CASE WHEN coverage_ratio >= 0.2 THEN stereo_width END AS stereo_width, CASE WHEN coverage_ratio >= 0.2 THEN crest_db END AS crest_db,
 CASE WHEN coverage_ratio >= 0.2 THEN ln(1 + 1000 * greatest(0, spectral_flux_mean)) END AS flux_log FROM b)"""


@query("c04_points", f"{PS}, {_POINTS} SELECT runtime_id, transport_epoch, bin AS bin_index, coverage, active_ratio, rms_db, lufs_s, round(centroid_log2, 6) AS centroid_log2, stereo_correlation, stereo_width, crest_db, round(flux_log, 6) AS flux_log FROM pt")
def c04(spark, sf_dir):
    p = structure.points(partials(spark, sf_dir, True))
    return p.withColumns({"centroid_log2": F.round("centroid_log2", 6), "flux_log": F.round("flux_log", 6)})


_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT runtime_id, transport_epoch, bin, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM pt WHERE {c} IS NOT NULL" for c in ("rms_db", "lufs_s", "centroid_log2", "stereo_correlation", "stereo_width", "crest_db", "flux_log")) + ")"
_Z = f"""{_LONG}, md AS (SELECT runtime_id, transport_epoch, feature, median(x) AS m FROM lg GROUP BY ALL), mad AS (SELECT lg.runtime_id, lg.transport_epoch, lg.feature, any_value(m) AS m, median(abs(x - m)) AS d FROM lg JOIN md ON lg.runtime_id = md.runtime_id AND lg.transport_epoch = md.transport_epoch AND lg.feature = md.feature GROUP BY ALL),
z AS (SELECT lg.runtime_id, lg.transport_epoch, lg.bin, lg.feature, greatest(-5.0, least(5.0, (x - m) / greatest(CASE lg.feature WHEN 'centroid_log2' THEN 0.15 WHEN 'flux_log' THEN 0.15 WHEN 'stereo_correlation' THEN 0.08 WHEN 'stereo_width' THEN 0.05 WHEN 'crest_db' THEN 0.75 ELSE 1.0 END, CAST(1.4826 AS DOUBLE) * d))) AS z
 FROM lg JOIN mad ON lg.runtime_id = mad.runtime_id AND lg.transport_epoch = mad.transport_epoch AND lg.feature = mad.feature)"""


@query("c05_robust_z", f"{PS}, {_POINTS}, {_Z} SELECT runtime_id, transport_epoch, bin AS bin_index, feature, round(z, 4) AS z FROM z")
def c05(spark, sf_dir):
    return structure.robust(structure.points(partials(spark, sf_dir, True))).withColumn("z", F.round("z", 4))


_NOVELTY = f"""{_Z}, ends AS (SELECT runtime_id, transport_epoch, min(bin) AS b0, max(bin) AS b1 FROM pt GROUP BY ALL), sc(s) AS (VALUES (2), (4), (8)),
bd AS (SELECT runtime_id, transport_epoch, CAST(unnest(range(b0 + 1, b1 + 1)) AS INTEGER) AS b FROM ends),
gt AS (SELECT bd.runtime_id, bd.transport_epoch, bd.b, s, count(*) FILTER (WHERE bin < b) AS nl, count(*) FILTER (WHERE bin >= b) AS nr, round(least(avg(coverage) FILTER (WHERE bin < b), avg(coverage) FILTER (WHERE bin >= b)), 6) AS cov
  FROM bd, sc, pt WHERE pt.runtime_id = bd.runtime_id AND pt.transport_epoch = bd.transport_epoch AND bin >= b - s AND bin < b + s GROUP BY ALL),
gk AS (SELECT * FROM gt WHERE nl >= greatest(1, ceil(s * 0.5)) AND nr >= greatest(1, ceil(s * 0.5)) AND cov >= 0.35),
dz AS (SELECT gk.runtime_id, gk.transport_epoch, gk.b, gk.s, feature, abs(avg(z) FILTER (WHERE bin >= b) - avg(z) FILTER (WHERE bin < b)) AS d FROM gk JOIN z ON z.runtime_id = gk.runtime_id AND z.transport_epoch = gk.transport_epoch AND z.bin >= b - s AND z.bin < b + s GROUP BY ALL),
gp AS (SELECT runtime_id, transport_epoch, b, s, CASE WHEN feature IN ('rms_db', 'lufs_s') THEN 'energy' WHEN feature = 'centroid_log2' THEN 'spectrum' WHEN feature = 'crest_db' THEN 'dynamics' WHEN feature = 'flux_log' THEN 'temporal' ELSE 'stereo' END AS part, 1 - exp(-avg(d) / 1.5) AS c FROM dz WHERE d IS NOT NULL GROUP BY ALL),
rw AS (SELECT runtime_id, transport_epoch, b, s, sum(c * CAST(CASE part WHEN 'energy' THEN 0.2 WHEN 'spectrum' THEN 0.2 WHEN 'stereo' THEN 0.08 ELSE 0.06 END AS DOUBLE)) / sum(CAST(CASE part WHEN 'energy' THEN 0.2 WHEN 'spectrum' THEN 0.2 WHEN 'stereo' THEN 0.08 ELSE 0.06 END AS DOUBLE)) AS r FROM gp GROUP BY ALL),
nv AS (SELECT gk.runtime_id, gk.transport_epoch, gk.b AS bin, avg(greatest(0, least(1, r * sqrt(cov)))) AS score, count(*) AS scales FROM gk JOIN rw ON rw.runtime_id = gk.runtime_id AND rw.transport_epoch = gk.transport_epoch AND rw.b = gk.b AND rw.s = gk.s GROUP BY ALL)"""


@query("c06_novelty", f"{PS}, {_POINTS}, {_NOVELTY} SELECT runtime_id, transport_epoch, bin AS bin_index, round(score, 5) AS score, scales FROM nv")
def c06(spark, sf_dir):
    return structure.novelty(structure.points(partials(spark, sf_dir, True))).select("runtime_id", "transport_epoch", "bin_index", F.round("score", 5).alias("score"), "scales")


_SMOOTH = f"{_NOVELTY}, sm AS (SELECT x.runtime_id, x.transport_epoch, x.bin, sum(y.score * CASE WHEN y.bin = x.bin THEN 0.5 ELSE 0.25 END) / sum(CASE WHEN y.bin = x.bin THEN 0.5 ELSE 0.25 END) AS v FROM nv x JOIN nv y ON x.runtime_id = y.runtime_id AND x.transport_epoch = y.transport_epoch AND abs(x.bin - y.bin) <= 1 GROUP BY ALL)"


@query("w07_smooth", f"{PS}, {_POINTS}, {_SMOOTH} SELECT runtime_id, transport_epoch, bin AS bin_index, round(v, 5) AS smoothed FROM sm")
def w07(spark, sf_dir):
    return structure.smooth(structure.novelty(structure.points(partials(spark, sf_dir, True)))).withColumn("smoothed", F.round("smoothed", 5))


@query(
    "w08_peaks",
    f"""{PS}, {_POINTS}, {_SMOOTH}, th AS (SELECT runtime_id, transport_epoch, greatest(CAST(0.12 AS DOUBLE), quantile_cont(v, 0.5) + CAST(0.55 AS DOUBLE) * greatest(0, quantile_cont(v, 0.9) - quantile_cont(v, 0.5))) AS t FROM sm GROUP BY ALL)
    SELECT a.runtime_id, a.transport_epoch, a.bin AS bin_index, round(a.v, 5) AS smoothed FROM sm a JOIN th ON a.runtime_id = th.runtime_id AND a.transport_epoch = th.transport_epoch
    LEFT JOIN sm p ON p.runtime_id = a.runtime_id AND p.transport_epoch = a.transport_epoch AND p.bin = a.bin - 1 LEFT JOIN sm q ON q.runtime_id = a.runtime_id AND q.transport_epoch = a.transport_epoch AND q.bin = a.bin + 1
    WHERE a.v >= coalesce(p.v, -1) AND a.v >= coalesce(q.v, -1) AND a.v >= t""",
)
def w08(spark, sf_dir):
    n = structure.novelty(structure.points(partials(spark, sf_dir, True)))
    return structure.peaks(structure.smooth(n)).select("runtime_id", "transport_epoch", "bin_index", F.round("smoothed", 5).alias("smoothed"))


def cache(spark) -> TableCache:
    """The maps of this session or cluster."""
    return TableCache(spark, f"{shared_folder(spark)}/maps")


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/events.parquet", f"{sf_dir}/embeddings.parquet"]


def _make_map(spark, sf_dir, sensitivity: float, least: int) -> dict:
    """Boundaries, sections, summaries, similarities and families of every pass, the passes chosen, and the map of the song: the
    sections of the pass that is covered best, with what each track does in them."""
    p = cut(partials(spark, sf_dir, True, True))
    pts = cut(structure.points(p))
    passes = cut(relations.select_passes(p, 0, 180).select(*timeline.KEY))
    active = cut(p.join(passes, timeline.KEY, "left_semi").select("runtime_id", "bin_index", (F.col("active_count") / F.greatest(F.lit(1), F.col("frame_count"))).alias("active_ratio")))
    smoothed = cut(structure.smooth(structure.novelty(pts, active)))
    found = cut(structure.boundaries(structure.peaks(smoothed, sensitivity), pts, least))
    secs = cut(structure.sections(found, pts))
    s = cut(structure.summaries(secs, p))
    similarity = cut(structure.section_similarity(s, structure.section_activity(secs, active)))
    families = cut(structure.families(secs, similarity))
    covered = p.join(passes, timeline.KEY, "left_semi").groupBy(*timeline.KEY).agg(F.sum(F.bit_count("coverage_mask")).alias("n"))
    lead = covered.orderBy(F.desc("n"), *timeline.KEY).limit(1).select(*timeline.KEY)
    song = cut(secs.join(lead, timeline.KEY).join(families, [*timeline.KEY, "ord"]).select("section", "ord", "start", "end", "family", "occurrence"))
    tracks = relations.section_tracks(song.drop("family", "occurrence"), p, passes)
    return {"boundaries": found, "sections": secs, "summaries": s, "similarity": similarity, "families": families, "passes": passes, "song": song, "tracks": tracks}


def section_map(spark, sf_dir, sensitivity: float = 0.55, least: int = 8):
    """The map of the events (K08, T33): (id, tables), found by its inputs and parameters or built."""
    params = {"map": 1, "sensitivity": sensitivity, "least": least}
    return cache(spark).build(_inputs(sf_dir), params, lambda: _make_map(spark, sf_dir, sensitivity, least))


@query("c08_families")
def c08(spark, sf_dir):
    return section_map(spark, sf_dir)[1].read("families")


@query("j12_similar_sections")
def j12(spark, sf_dir):
    return relations.similar_sections(section_map(spark, sf_dir)[1].read("similarity"), timeline.KEY)


@query("t33_section_map")
def t33(spark, sf_dir):
    """The map as rows: sections, families, and an id of the boundaries of its pass."""
    tables = section_map(spark, sf_dir)[1]
    s, named = tables.read("summaries"), tables.read("families")
    bounds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))), lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    ids = s.groupBy(*timeline.KEY).agg(F.substring(F.sha1(F.concat_ws("|", *timeline.KEY, bounds)), 1, 12).alias("map_id"))
    return s.select(*timeline.KEY, "section", "ord", "start", "end", "rms_db", "coverage_ratio").join(named, [*timeline.KEY, "ord"]).join(ids, timeline.KEY)


_NAMES = [n for n, *_ in dims.REGIONS]
_FRAME_REGIONS = f"""fb AS (SELECT f.runtime_id, f.transport_epoch, f.bin, arrival_seq, {sql.region_case('g.i')} AS region, avg(pow(10, (rms_db + 20 * CAST(embedding[g.i + 1] AS DOUBLE)) / 10)) AS p FROM f JOIN embeddings e ON e.vec_id = f.vec_id, (SELECT unnest(range(32)) AS i) g
  WHERE (mask & 4) <> 0 AND rms_db + 20 * CAST(embedding[g.i + 1] AS DOUBLE) > -120 AND {sql.region_case('g.i')} IS NOT NULL GROUP BY ALL)"""
#: pt with the regions' levels; cn: chroma of a bin, long; ac: activity of each track in its chosen pass.
_WHOLE_POINTS = f"""{_POINTS.replace("pt AS (", "pt0 AS (")}, {_FRAME_REGIONS},
rb AS (SELECT runtime_id, transport_epoch, bin, {", ".join(f"round(10 * log10(greatest(avg(p) FILTER (WHERE region = {i}), 1e-12)), 4) AS region_{n}" for i, n in enumerate(_NAMES))} FROM fb GROUP BY ALL),
pt AS (SELECT pt0.*, {", ".join(f"CASE WHEN coverage >= 0.2 THEN region_{n} END AS region_{n}" for n in _NAMES)} FROM pt0 LEFT JOIN rb ON rb.runtime_id = pt0.runtime_id AND rb.transport_epoch = pt0.transport_epoch AND rb.bin = pt0.bin),
sq AS (SELECT vec_id, [pow(CAST(embedding[i + 1] AS DOUBLE), 2) for i in range(32)] AS q FROM embeddings), sl AS (SELECT vec_id, q, list_sum(q[1:12]) AS low, list_sum(q) AS whole FROM sq),
cs AS (SELECT f.runtime_id, f.transport_epoch, f.bin, g.i, sum(greatest(1e-6, low / whole) * q[g.i + 1] / low) AS e FROM f JOIN sl ON sl.vec_id = f.vec_id, (SELECT unnest(range(12)) AS i) g WHERE (mask & 32) <> 0 AND low > 0 GROUP BY ALL),
cn AS (SELECT cs.*, round(e / sum(e) OVER (PARTITION BY cs.runtime_id, cs.transport_epoch, cs.bin), 5) AS c FROM cs JOIN pt ON pt.runtime_id = cs.runtime_id AND pt.transport_epoch = cs.transport_epoch AND pt.bin = cs.bin WHERE coverage >= 0.2),
ps AS (SELECT runtime_id, transport_epoch FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY n DESC, transport_epoch DESC) AS r FROM (SELECT runtime_id, transport_epoch, sum(bit_count(cover)) AS n FROM acc WHERE bin >= 0 AND bin < 180 GROUP BY ALL)) WHERE r = 1),
ac AS (SELECT acc.runtime_id AS other, bin, CAST(active AS DOUBLE) / greatest(1, n) AS a FROM acc JOIN ps ON acc.runtime_id = ps.runtime_id AND acc.transport_epoch = ps.transport_epoch)"""
_SIDES = "avg({0}) FILTER (WHERE bin < b) AS l, avg({0}) FILTER (WHERE bin >= b) AS r"
_MORE_PARTS = f"""cm AS (SELECT gk.runtime_id, gk.transport_epoch, gk.b, gk.s, i, {_SIDES.format('c')} FROM gk JOIN cn ON cn.runtime_id = gk.runtime_id AND cn.transport_epoch = gk.transport_epoch AND cn.bin >= b - s AND cn.bin < b + s GROUP BY ALL),
cp AS (SELECT runtime_id, transport_epoch, b, s, 'chroma' AS part, 1 - sum(l * r) / nullif(sqrt(sum(l * l) * sum(r * r)), 0) AS c FROM cm GROUP BY ALL HAVING bool_and(l IS NOT NULL AND r IS NOT NULL)),
am AS (SELECT bs.b, bs.s, other, {_SIDES.format('a')} FROM (SELECT DISTINCT b, s FROM gk) bs JOIN ac ON bin >= b - s AND bin < b + s GROUP BY ALL),
ap AS (SELECT b, s, avg(abs(r - l)) AS c FROM am WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
gq AS (SELECT * FROM gp UNION ALL SELECT * FROM cp WHERE c IS NOT NULL UNION ALL SELECT gk.runtime_id, gk.transport_epoch, gk.b, gk.s, 'activity', ap.c FROM gk JOIN ap ON ap.b = gk.b AND ap.s = gk.s)"""
_WHOLE_NOVELTY = (
    _NOVELTY.replace(_LONG, _LONG[:-1] + "".join(f" UNION ALL SELECT runtime_id, transport_epoch, bin, 'region_{n}', CAST(region_{n} AS DOUBLE) FROM pt WHERE region_{n} IS NOT NULL" for n in _NAMES) + ")")
    .replace("WHEN feature = 'centroid_log2' THEN", "WHEN feature = 'centroid_log2' OR feature LIKE 'region_%' THEN")
    .replace("WHEN 'stereo' THEN 0.08 ELSE 0.06", "WHEN 'stereo' THEN 0.08 WHEN 'chroma' THEN 0.15 WHEN 'activity' THEN 0.25 ELSE 0.06")
    .replace("FROM gp GROUP BY ALL)", "FROM gq GROUP BY ALL)")
    .replace("rw AS (", f"{_MORE_PARTS}, rw AS (")
)


@query("c06_whole_novelty", f"{PS}, {_WHOLE_POINTS}, {_WHOLE_NOVELTY} SELECT runtime_id, transport_epoch, bin AS bin_index, round(score, 5) AS score, scales FROM nv")
def c06_whole(spark, sf_dir):
    """Novelty from all its parts: levels, spectrum with regions, chroma, stereo, dynamics, change and the activity of all tracks."""
    p = cut(partials(spark, sf_dir, True, True))
    passes = relations.select_passes(p, 0, 180).select(*timeline.KEY)
    active = p.join(passes, timeline.KEY, "left_semi").select("runtime_id", "bin_index", (F.col("active_count") / F.greatest(F.lit(1), F.col("frame_count"))).alias("active_ratio"))
    return structure.novelty(structure.points(p), active).select("runtime_id", "transport_epoch", "bin_index", F.round("score", 5).alias("score"), "scales")


_PASS_OF = "{0}.runtime_id = {1}.runtime_id AND {0}.transport_epoch = {1}.transport_epoch"


@query(
    "c07_boundaries",
    f"""{PS.replace("WITH ", "WITH RECURSIVE ", 1)}, {_WHOLE_POINTS}, {_SMOOTH.replace(_NOVELTY, _WHOLE_NOVELTY)},
    th AS (SELECT runtime_id, transport_epoch, greatest(CAST(0.12 AS DOUBLE), quantile_cont(v, 0.5) + CAST(0.55 AS DOUBLE) * greatest(0, quantile_cont(v, 0.9) - quantile_cont(v, 0.5))) AS t FROM sm GROUP BY ALL),
    en AS (SELECT runtime_id, transport_epoch, min(bin) AS e0, max(bin) + 1 AS e1 FROM pt GROUP BY ALL HAVING count(*) >= 16),
    pk AS (SELECT a.runtime_id, a.transport_epoch, a.bin, row_number() OVER (PARTITION BY a.runtime_id, a.transport_epoch ORDER BY a.v DESC, a.bin) AS k FROM sm a JOIN th ON {_PASS_OF.format('a', 'th')} JOIN en ON {_PASS_OF.format('a', 'en')}
      LEFT JOIN sm p ON {_PASS_OF.format('p', 'a')} AND p.bin = a.bin - 1 LEFT JOIN sm q ON {_PASS_OF.format('q', 'a')} AND q.bin = a.bin + 1
      WHERE a.v >= coalesce(p.v, -1) AND a.v >= coalesce(q.v, -1) AND a.v >= t AND a.bin - e0 >= 8 AND e1 - a.bin >= 8),
    tk AS (SELECT runtime_id, transport_epoch, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS taken FROM en
      UNION ALL SELECT tk.runtime_id, tk.transport_epoch, pk.k, CASE WHEN len(taken) < 47 AND len([x for x in taken if abs(x - bin) < 8]) = 0 THEN list_append(taken, CAST(bin AS INTEGER)) ELSE taken END FROM tk JOIN pk ON {_PASS_OF.format('pk', 'tk')} AND pk.k = tk.k + 1)
    SELECT runtime_id, transport_epoch, unnest(taken) AS bin_index FROM (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY runtime_id, transport_epoch ORDER BY k DESC) = 1)""",
)
def c07(spark, sf_dir):
    return section_map(spark, sf_dir)[1].read("boundaries")


@query("k08_map_profile")
def k08_profile(spark, sf_dir):
    """What each track does in the sections of the built map (T34), with the sections' families."""
    tables = section_map(spark, sf_dir)[1]
    return tables.read("tracks").join(tables.read("song").select("section", "family", "occurrence"), "section").select("runtime_id", "section", "family", "occurrence", "evidence", *SUMMARY_COLUMNS)


@query("k08_map_story")
def k08_story(spark, sf_dir):
    """Extremes over the built map's sections and how many of its families each measure is seen in."""
    tables = section_map(spark, sf_dir)[1]
    rows = tables.read("tracks")
    families = relations.family_stats(rows, tables.read("song").select("section", "family")).groupBy("runtime_id", "metric").agg(F.count_distinct("family").alias("families"))
    return relations.extremes(rows).join(families, ["runtime_id", "metric"])


@query("k08_map_relationships")
def k08_relations(spark, sf_dir):
    """The strongest pairs over the built map's sections, with spectra."""
    return relations.top_relations(relations.pair_sections(section_map(spark, sf_dir)[1].read("tracks")))


@query("c03_passes", f"{P}, x AS (SELECT runtime_id, transport_epoch, sum(bit_count(cover)) AS n FROM acc WHERE bin + 1 > 20 AND bin < 60 GROUP BY ALL) SELECT runtime_id, transport_epoch FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY n DESC, transport_epoch DESC) AS r FROM x) WHERE r = 1")
def c03(spark, sf_dir):
    return relations.select_passes(partials(spark, sf_dir), 20, 60)


_CHOSEN = "ps AS (SELECT runtime_id, transport_epoch FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY n DESC, transport_epoch DESC) AS r FROM (SELECT runtime_id, transport_epoch, sum(bit_count(cover)) AS n FROM acc WHERE bin >= 0 AND bin < 180 GROUP BY ALL)) WHERE r = 1)"
_ST = f"""{SECTIONS}, {_CHOSEN}, j AS (SELECT acc.*, section, ord, s1 - s0 AS len FROM acc JOIN ps ON acc.runtime_id = ps.runtime_id AND acc.transport_epoch = ps.transport_epoch JOIN sec ON acc.bin >= s0 AND acc.bin < s1),
st AS (SELECT *, coverage_ratio >= 0.2 AS evidence FROM ({sql.summary('runtime_id, section, ord', 'max(len)', 'j')}))"""


def _section_tracks(spark, sf_dir, spectra=False):
    p = partials(spark, sf_dir, True, spectra)
    return relations.section_tracks(fixed(spark), p, relations.select_passes(p, 0, 180))


@query("t34_section_profile", f"{PS}, {_ST} SELECT runtime_id, section, evidence, {SUMMARY} FROM st")
def t34(spark, sf_dir):
    return _section_tracks(spark, sf_dir).select("runtime_id", "section", "evidence", *SUMMARY_COLUMNS)


_M = relations.METRICS
_lag = "lag({0}) OVER (PARTITION BY runtime_id ORDER BY ord)"


@query("w05_section_delta", f"{PS}, {_ST} SELECT runtime_id, section, " + ", ".join(f"CASE WHEN evidence AND {_lag.format('evidence')} THEN round({c} - {_lag.format(c)}, 4) END AS {c}_delta" for c in _M) + " FROM st")
def w05(spark, sf_dir):
    return relations.section_deltas(_section_tracks(spark, sf_dir)).drop("ord")


_ML = "ml AS (" + " UNION ALL ".join(f"SELECT runtime_id, section, ord, '{c}' AS metric, CAST({c} AS DOUBLE) AS x FROM st WHERE evidence AND {c} IS NOT NULL" for c in _M) + ")"


@query("g04_family_stats", f"{PS}, {_ST}, {FAMILIES}, {_ML} SELECT runtime_id, family, metric, count(*) AS n, round(avg(x), 8) AS mean, round(min(x), 4) AS least, round(max(x), 4) AS most, round(max(x) - min(x), 4) AS spread FROM ml JOIN fam ON ml.section = fam.section GROUP BY ALL")
def g04(spark, sf_dir):
    return relations.family_stats(_section_tracks(spark, sf_dir), labels(spark))


@query("o05_extremes", f"{PS}, {_ST}, {_ML} SELECT runtime_id, metric, arg_min(section, x * 1e6 + ord * 1e-3) AS least_section, arg_max(section, x * 1e6 - ord * 1e-3) AS most_section FROM ml GROUP BY ALL")
def o05(spark, sf_dir):
    return relations.extremes(_section_tracks(spark, sf_dir))


@query("t35_track_story", f"{PS}, {_ST}, {FAMILIES}, {_ML} SELECT runtime_id, metric, arg_min(ml.section, x * 1e6 + ord * 1e-3) AS least_section, arg_max(ml.section, x * 1e6 - ord * 1e-3) AS most_section, count(DISTINCT family) AS families FROM ml JOIN fam ON ml.section = fam.section GROUP BY ALL")
def t35(spark, sf_dir):
    rows = _section_tracks(spark, sf_dir)
    fams = relations.family_stats(rows, labels(spark)).groupBy("runtime_id", "metric").agg(F.count_distinct("family").alias("families"))
    return relations.extremes(rows).join(fams, ["runtime_id", "metric"])


_PAIR = """pr AS (SELECT least(a.runtime_id, b.runtime_id) || '::' || greatest(a.runtime_id, b.runtime_id) AS pair_id, a.section, a.ord, a.evidence AND b.evidence AS ok, round(least(a.active_ratio, b.active_ratio), 4) AS ov, a.rms_db AS ra, b.rms_db AS rb, a.runtime_id AS ia, b.runtime_id AS ib,
  CASE WHEN a.rms_db IS NOT NULL AND b.rms_db IS NOT NULL THEN 1 - least(1, abs(a.rms_db - b.rms_db) / 24) END AS p1, CASE WHEN a.stereo_width IS NOT NULL AND b.stereo_width IS NOT NULL THEN 1 - least(1, abs(a.stereo_width - b.stereo_width) / 1.5) END AS p2
  FROM st a JOIN st b ON a.section = b.section AND a.runtime_id < b.runtime_id),
pe AS (SELECT *, CASE WHEN ok THEN ov END AS overlap, CASE WHEN ok THEN round((coalesce(p1 * CAST(0.3 AS DOUBLE), 0) + coalesce(p2 * CAST(0.2 AS DOUBLE), 0)) / nullif(CASE WHEN p1 IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN p2 IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 0), 4) END AS shape FROM pr),
pp AS (SELECT *, round(overlap * shape, 4) AS priority FROM pe),
pv AS (SELECT pair_id, section, ord, overlap, shape, priority, CASE WHEN NOT ok THEN 'insufficient_coverage' WHEN overlap IS NULL OR priority IS NULL THEN 'missing_activity_evidence' WHEN overlap < CAST(0.15 AS DOUBLE) THEN 'insufficient_activity_overlap' WHEN priority < CAST(0.18 AS DOUBLE) THEN 'below_shortlist_threshold' ELSE 'shortlisted' END AS status,
  CASE WHEN abs(ra - rb) >= 0.25 THEN CASE WHEN ra > rb THEN ia ELSE ib END END AS louder FROM pp)"""


@query("c09_pair_evidence", f"{PS}, {_ST}, {_PAIR} SELECT pair_id, section, overlap, shape, priority, status, louder FROM pv")
def c09(spark, sf_dir):
    return relations.pair_sections(_section_tracks(spark, sf_dir)).drop("ord")


@query(
    "w06_shortlist_changes",
    f"""{PS}, {_ST}, {_PAIR}, ch AS (SELECT pair_id, section, status AS n, lag(status) OVER (PARTITION BY pair_id ORDER BY ord) AS b FROM pv)
    SELECT pair_id, section, CASE WHEN n = 'shortlisted' THEN 'entered_shortlist' WHEN b = 'shortlisted' THEN 'left_shortlist' ELSE 'availability_changed' END AS change FROM ch WHERE n <> b""",
)
def w06(spark, sf_dir):
    return relations.shortlist_changes(relations.pair_sections(_section_tracks(spark, sf_dir)))


@query("t36_relationships", f"{PS}, {_ST}, {_PAIR} SELECT pair_id, max(priority) AS top, round(avg(priority), 4) AS mean, count(*) FILTER (WHERE status = 'shortlisted') AS sections FROM pv GROUP BY 1 HAVING max(priority) IS NOT NULL ORDER BY top DESC, mean DESC, pair_id DESC LIMIT 12")
def t36(spark, sf_dir):
    return relations.top_relations(relations.pair_sections(_section_tracks(spark, sf_dir)))


@query(
    "g05_family_presence",
    f"""{PS}, {_ST}, {_PAIR}, {FAMILIES} SELECT pair_id, family, count(*) FILTER (WHERE seen) AS observed, coalesce(string_agg(CASE WHEN short THEN section END, ',' ORDER BY section), '') AS shortlisted_sections, coalesce(string_agg(CASE WHEN NOT seen THEN section END, ',' ORDER BY section), '') AS unavailable_sections,
    round(CAST(count(*) FILTER (WHERE short) AS DOUBLE) / nullif(count(*) FILTER (WHERE seen), 0), 5) AS shortlisted_ratio, round(max(CASE WHEN short THEN priority END), 5) AS top_priority
    FROM (SELECT pv.*, family, status NOT IN ('insufficient_coverage', 'missing_activity_evidence') AS seen, status = 'shortlisted' AS short FROM pv JOIN fam ON fam.section = pv.section) GROUP BY ALL""",
)
def g05(spark, sf_dir):
    return relations.family_presence(relations.pair_sections(_section_tracks(spark, sf_dir)), labels(spark))


@query("g06_family_counts", f"{PS}, {_ST}, {FAMILIES} SELECT runtime_id, family, count(*) AS sections FROM st JOIN fam ON fam.section = st.section GROUP BY ALL")
def g06(spark, sf_dir):
    return relations.family_counts(_section_tracks(spark, sf_dir).join(labels(spark), "section"), ["runtime_id"])


#: rg: region levels of each track in each section, in dB; rs: their shares of power, null where one of the five regions has no level.
_REGIONS = f"""{_FRAME_REGIONS},
rg AS (SELECT fb.runtime_id, section, region, round(10 * log10(greatest(avg(p), 1e-12)), 4) AS db FROM fb JOIN ps ON fb.runtime_id = ps.runtime_id AND fb.transport_epoch = ps.transport_epoch JOIN sec ON fb.bin >= s0 AND fb.bin < s1 GROUP BY ALL),
rs AS (SELECT runtime_id, section, region, pow(10, db / 10) / sum(pow(10, db / 10)) OVER (PARTITION BY runtime_id, section) AS share, count(*) OVER (PARTITION BY runtime_id, section) AS regions FROM rg),
p3 AS (SELECT a.runtime_id AS ia, b.runtime_id AS ib, a.section, sum(least(a.share, b.share)) AS p3 FROM rs a JOIN rs b ON a.section = b.section AND a.region = b.region AND a.runtime_id < b.runtime_id WHERE a.regions = 5 AND b.regions = 5 GROUP BY ALL)"""
_SPECTRAL = _PAIR.replace("coalesce(p2 * CAST(0.2 AS DOUBLE), 0)) /", "coalesce(p2 * CAST(0.2 AS DOUBLE), 0) + coalesce(p3 * CAST(0.5 AS DOUBLE), 0)) /").replace("WHEN p2 IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 0)", "WHEN p2 IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN p3 IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 0 END, 0)").replace("AS shape FROM pr)", "AS shape FROM pr LEFT JOIN p3 USING (ia, ib, section))")


@query("c09_spectral_pairs", f"{PS}, {_ST}, {_REGIONS}, {_SPECTRAL} SELECT pair_id, section, overlap, shape, priority, status, louder FROM pv")
def c09s(spark, sf_dir):
    return relations.pair_sections(_section_tracks(spark, sf_dir, True)).drop("ord")


# --- comparison ---

_HALF = f"""WITH {sql.frames()}, wa AS (SELECT * FROM f WHERE received_at >= 20 AND received_at <= 80 AND track <> 'view'), wb AS (SELECT * FROM f WHERE received_at >= 100 AND received_at <= 160 AND track <> 'click'),
""" + ", ".join(
    f"""s{x} AS (SELECT runtime_id, round(CAST(count(*) FILTER (WHERE sp) AS DOUBLE) / count(*), 4) AS active_ratio, round(10 * log10(greatest(avg(CASE WHEN sp AND rms_db > -120 THEN pow(10, rms_db / 10) END), 1e-12)), 4) AS rms_db, round(avg(crest_db) FILTER (WHERE sp), 4) AS crest_db,
    round(avg(centroid_hz) FILTER (WHERE sp), 2) AS centroid_hz, round(avg(corr) FILTER (WHERE sp), 4) AS stereo_correlation, round(avg(width) FILTER (WHERE sp), 4) AS stereo_width FROM w{x} GROUP BY 1)"""
    for x in "ab"
)
_DELTAS = ", ".join(f"round(b.{m} - a.{m}, 4) AS {m}_delta" for m in compare.METRICS)
_STATES = f"st AS (SELECT coalesce(a.runtime_id, b.runtime_id) AS runtime_id, CASE WHEN a.runtime_id IS NULL THEN 'added' WHEN b.runtime_id IS NULL THEN 'removed' ELSE 'shared' END AS state, {_DELTAS} FROM sa a FULL JOIN sb b ON a.runtime_id = b.runtime_id)"


def _states(spark, sf_dir):
    f = tools.frames(spark, sf_dir)
    return recent.average(recent.window(f.where("track <> 'view'"), 80.0, 60.0)), recent.average(recent.window(f.where("track <> 'click'"), 160.0, 60.0))


@query("t16_compare_snapshots", f"{_HALF}, {_STATES} SELECT * FROM st")
def t16(spark, sf_dir):
    return compare.compare(*_states(spark, sf_dir))


@query("s02_removed", f"{_HALF} SELECT runtime_id FROM sa EXCEPT SELECT runtime_id FROM sb")
def s02(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    return a.select("runtime_id").exceptAll(b.select("runtime_id"))


@query("s01_shared", f"{_HALF} SELECT runtime_id FROM sa INTERSECT SELECT runtime_id FROM sb")
def s01(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    return a.select("runtime_id").intersect(b.select("runtime_id"))


@query("s03_missing_targets", f"{_HALF} SELECT runtime_id FROM sa WHERE runtime_id NOT IN (SELECT runtime_id FROM sb)")
def s03(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    return compare.missing(a.select("runtime_id"), b)


@query("c10_verify", f"{_HALF}, {_STATES} SELECT runtime_id, state, state = 'shared' AND coalesce(abs(active_ratio_delta) <= 0.15, false) AS controlled FROM st")
def c10(spark, sf_dir):
    return compare.verify(*_states(spark, sf_dir)).select("runtime_id", "state", "controlled")


_RV = ", ".join(
    f"r{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runtime_id ORDER BY coverage_ratio DESC, last_received_at DESC, transport_epoch DESC) AS r FROM ({sql.summary('runtime_id, transport_epoch', '40', f'(SELECT * FROM acc WHERE bin >= {lo} AND bin < {lo + 40})')})) WHERE r = 1)"
    for x, lo in (("a", 20), ("b", 100))
)


@query(
    "c11_range_verify",
    f"""{P}, {_RV}, v AS (SELECT ra.runtime_id, ra.transport_epoch AS before_epoch, rb.transport_epoch AS after_epoch, round(rb.rms_db - ra.rms_db, 4) AS rms_delta, CASE WHEN rb.coverage_ratio IS NULL THEN 'missing_after' WHEN least(ra.coverage_ratio, rb.coverage_ratio) < CAST(0.3 AS DOUBLE) THEN 'insufficient_coverage'
    WHEN rb.first_received_at <= ra.last_received_at THEN 'stale_after' WHEN rb.dropped_blocks > ra.dropped_blocks THEN 'dropped_blocks' END AS reason FROM ra LEFT JOIN rb ON ra.runtime_id = rb.runtime_id) SELECT *, reason IS NULL AS controlled FROM v""",
)
def c11(spark, sf_dir):
    p = partials(spark, sf_dir)
    return compare.verify_range(timeline.resolve_range(p, 20, 60, 0.3), timeline.resolve_range(p, 100, 140, 0.3), 0.3)


_LEVEL = "SELECT round(10 * log10(greatest(avg(CASE WHEN sp AND rms_db > -120 THEN pow(10, rms_db / 10) END), 1e-12)), 4) AS x FROM w WHERE runtime_id = '{}'"


@query(
    "t47_compare_reference",
    f"""{WB} SELECT CAST(a.band AS INTEGER) AS band, round(b.plain_db - a.plain_db, 4) AS absolute_db, round(b.plain_db + ({_LEVEL.format('rt-click')}) - ({_LEVEL.format('rt-view')}) - a.plain_db, 4) AS normalised_db
    FROM means a JOIN means b ON a.band = b.band AND a.runtime_id = 'rt-click' AND b.runtime_id = 'rt-view'""",
)
def t47(spark, sf_dir):
    w = window(spark, sf_dir, True)
    m, level = recent.band_means(w), recent.average(w)
    one = lambda rows, r: rows.where(F.col("runtime_id") == r)
    return compare.compare_reference(one(m, "rt-click"), one(m, "rt-view"), one(level, "rt-click"), one(level, "rt-view"))


@query(
    "c13_reference_regions",
    f"""{WB}, rg AS (SELECT runtime_id, CAST({sql.region_case()} AS INTEGER) AS region, round(10 * log10(greatest(avg(pow(10, plain_db / 10)), 1e-12)), 4) AS db FROM means GROUP BY ALL)
    SELECT a.region, round(b.db - a.db, 4) AS absolute_db, round(b.db + ({_LEVEL.format('rt-click')}) - ({_LEVEL.format('rt-view')}) - a.db, 4) AS normalised_db FROM rg a JOIN rg b ON a.region = b.region AND a.runtime_id = 'rt-click' AND b.runtime_id = 'rt-view'""",
)
def c13_regions(spark, sf_dir):
    w = window(spark, sf_dir, True)
    r, level = recent.regions(recent.band_means(w)), recent.average(w)
    one = lambda rows, t: rows.where(F.col("runtime_id") == t)
    return compare.compare_reference(one(r, "rt-click"), one(r, "rt-view"), one(level, "rt-click"), one(level, "rt-view"), "region", "region_db")


@query(
    "c22_section_range",
    f"""WITH {sql.frames()}, sec AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {o}, {a}, {b})" for n, o, a, b in structure.fixed_sections())}) v(section, ord, s0, s1)), maps AS (SELECT DISTINCT 'map-' || runtime_id AS map_id, section, s0, s1, CASE WHEN ord % 2 = 1 THEN 'A' ELSE 'B' END AS family FROM f, sec),
    rq AS (SELECT arrival_seq AS request, upper(trim(' s0' || (arrival_seq % 10))) AS section, coalesce(CASE WHEN arrival_seq % 3 = 0 THEN runtime_id WHEN arrival_seq % 3 = 1 THEN runtime_id || '-x' END, (SELECT max(runtime_id) FROM f)) AS r FROM f)
    SELECT request, 'map-' || r AS map_id, rq.section, s0 AS "start", s1 AS "end", family, CASE WHEN k.map_id IS NULL THEN 'no_map' WHEN s0 IS NULL THEN 'no_section' END AS reason
    FROM rq LEFT JOIN (SELECT DISTINCT map_id FROM maps) k ON k.map_id = 'map-' || r LEFT JOIN maps ON maps.map_id = 'map-' || r AND maps.section = rq.section""",
)
def c22(spark, sf_dir):
    """A request per frame: for its track's map, for one that no one made, or for the last."""
    f = tools.frames(spark, sf_dir)
    maps = f.select("runtime_id").distinct().crossJoin(F.broadcast(fixed(spark).join(labels(spark), "section"))).select(F.concat(F.lit("map-"), "runtime_id").alias("map_id"), F.col("runtime_id").alias("made"), "section", "start", "end", "family")
    which = F.when(F.col("arrival_seq") % 3 == 0, F.concat(F.lit("map-"), "runtime_id")).when(F.col("arrival_seq") % 3 == 1, F.concat(F.lit("map-"), "runtime_id", F.lit("-x")))
    return structure.section_range(f.select(F.col("arrival_seq").alias("request"), which.alias("map_id"), F.concat(F.lit(" s0"), F.col("arrival_seq") % 10).alias("section")), maps)


@query(
    "x26_fingerprint",
    f"""WITH {sql.frames()}, {tools.LATEST}, {tools.BINDINGS}, tr AS (SELECT l.runtime_id, l.track, b.fl_track_index AS i, b.fl_track_name AS n, b.slot AS s, coalesce('mixer:' || b.fl_track_index || '/slot:' || b.slot, l.runtime_id) AS identity FROM latest l LEFT JOIN bindings b ON l.runtime_id = b.runtime_id)
    SELECT substr(sha256('[' || string_agg('{{"analyzer_name":"' || track || '","fl_track_index":' || coalesce(i::VARCHAR, 'null') || ',"fl_track_name":' || coalesce('"' || n || '"', 'null') || ',"identity":"' || identity || '","runtime_id":"' || runtime_id || '","slot":' || coalesce(s::VARCHAR, 'null') || '}}', ',' ORDER BY identity) || ']'), 1, 16) AS fingerprint FROM tr""",
)
def x26(spark, sf_dir):
    return compare.fingerprint(state.bound(tools._live(spark, sf_dir).withColumnRenamed("track", "analyzer_name"), source.bindings(spark)))


@query("t20_top_pairs_recent")
def t20_top(spark, sf_dir):
    """The strongest evidence of each pair over the whole song instead of a window."""
    return tools.evidence_of(tools.frames(spark, sf_dir, spectra=True).where(F.col("received_at") <= AS_OF), k=1)


@query("r10_wire_round_trip", f"WITH {sql.frames()} SELECT runtime_id, count(*) AS n, round(sum(rms_db), 3) AS rms, count(lufs_s) AS lufs, count(corr) AS corr, CAST(sum(dropped) AS BIGINT) AS dropped FROM f GROUP BY 1")
def r10(spark, sf_dir):
    """Frames to 150-argument messages and back through the parser."""
    f = tools.frames(spark, sf_dir, spectra=True)
    have = {n.lower() for n in f.columns}
    everything = [*source.BASE, *source.ARRAYS, "analysis_profile_index", *[n for part in (source.LOUDNESS, source.VALIDITY, source.TEMPORAL, source.STEREO, source.SEMANTIC, source.RUNTIME, source.TRANSPORT, source.TRANSPORT_INTS) for n in part.values()]]
    for n in everything:
        if n not in have:
            f = f.withColumn(n, F.lit(None).cast("array<double>" if n in source.ARRAYS else "double"))
    for n in source.TRANSPORT_FLAGS.values():
        f = f.withColumn(n, F.lit(True))
    back = source.parse_wire(source.to_wire(f))
    return back.groupBy("runtime_id").agg(F.count("*").alias("n"), F.round(F.sum("rms_db"), 3).alias("rms"), F.count("lufs_s").alias("lufs"), F.count("stereo_correlation").alias("corr"), F.sum("dropped_blocks").alias("dropped"))
