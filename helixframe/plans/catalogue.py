"""The catalogue of registered sequence queries: operators on reads derived from the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.durable import cut_lineage, settled, stored
from helixframe.functions import dna
from helixframe.operators import components, correction, evaluation, evidence, graph, kmers, mapping, pair_path
from helixframe.plans import adapters, sql

K, HIGHER, WIDE, M, BUCKETS, FLANK, QUALITY = 21, 31, 41, 11, 64, 12, 20
CANDIDATES = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _counts(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return kmers.count_kmers(adapters.fragments(spark, d), k, QUALITY)


def _kept(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return kmers.retain(_counts(spark, d, k))


def _coded(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """The retained k-mers with their codes."""
    return kmers.retain(kmers.count_kmers(adapters.fragments(spark, d), k, QUALITY, with_code=True))


def _graph(spark: SparkSession, d: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The retained k-mers and their unitigs, both cut from their lineage, as several steps read them."""
    held = _coded(spark, d, k)
    if "code" not in held.columns:
        held = stored(held)
        return held, settled(spark, lambda: graph.unitigs(held, k))
    held = stored(held.select("code", "support"))
    return held.select(dna.decode("code", k).alias("kmer"), "support", "code"), settled(spark, lambda: graph.unitigs(held, k))


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, units = _graph(spark, d)
    reads = adapters.reads(spark, d)
    placed = stored(mapping.placements(reads, units, QUALITY, K, CANDIDATES))
    return units, placed, mapping.audit_reads(reads, placed, QUALITY, CANDIDATES)


_COUNTED = (sql.win(K), sql.counts(K))
_KEPT = (*_COUNTED, sql.kept())
_GRAPH = (*_KEPT, sql.handles(K), sql.NODES)
_UNITS = (*_GRAPH, sql.unitigs(K))
_MAPPED = (*_UNITS, sql.PLACED)
_PAIRED = (*_MAPPED, sql.PAIRS)


# scalar functions


@registered(sql.query(select=f"SELECT fragment_id, role, seq, reverse(translate(seq, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS revcomp, {sql.canon('substr(seq, 1, 21)')} AS canonical, sha256(seq) AS sha256 FROM reads"))
def revcomp_iupac(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("seq", 1, K)
    return adapters.reads(spark, d).select("fragment_id", "role", "seq", dna.revcomp_iupac("seq").alias("revcomp"), F.least(first, dna.revcomp(first)).alias("canonical"), F.sha2("seq", 256).alias("sha256"))


@registered("SELECT o_orderkey, kmer, cast(list_sum(list_transform(range(0, 16), lambda i: cast(instr('ACGT', substr(kmer, i + 1, 1)) - 1 AS hugeint) * cast(pow(4, 15 - i) AS hugeint))) AS bigint) AS code, kmer AS decoded, substr(kmer, 1, 15) AS prefix, substr(kmer, 2) AS suffix, substr(kmer, 1, 4) AS partition, kmer = reverse(translate(kmer, 'ACGT', 'TGCA')) AS is_palindrome FROM (SELECT o_orderkey, substr(translate(md5(cast(o_orderkey AS varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS kmer FROM orders)")
def packed_kmers(spark: SparkSession, d: str) -> DataFrame:
    letters = F.translate(F.md5(F.col("o_orderkey").cast("string").cast("binary")), adapters.HEX, adapters.LETTERS)
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.substring(letters, 1, 16).alias("kmer")).withColumn("code", dna.encode("kmer"))
    return rows.select("o_orderkey", "kmer", "code", dna.decode("code", 16).alias("decoded"), dna.prefix("kmer", 16).alias("prefix"), dna.suffix("kmer", 16).alias("suffix"), dna.partition_prefix("kmer", 8).alias("partition"), dna.is_palindrome("kmer").alias("is_palindrome"))


@registered("SELECT o_orderkey, cast(cast(o_custkey AS hugeint) * 1000000 // (o_orderkey + 1) AS bigint) AS ppm, cast('0x' || substr(sha256('helixframe/split/1' || cast(o_orderkey AS varchar)), 1, 15) AS bigint) % 10 < 3 AS is_calibration FROM orders")
def calibration_split(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", (dna.ratio("o_custkey", F.col("o_orderkey") + 1) * 1000000).cast("long").alias("ppm"), dna.split_is_calibration("o_orderkey", 3, 10).alias("is_calibration"))


# windows and counts


@registered(sql.query(sql.win(K), select="SELECT count(*) AS possible, cast(count_if(class = 'accepted') AS bigint) AS accepted, cast(count_if(class = 'ambiguity_only') AS bigint) AS ambiguity_only, cast(count_if(class = 'quality_only') AS bigint) AS quality_only, cast(count_if(class = 'ambiguity_and_quality') AS bigint) AS ambiguity_and_quality FROM win"))
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    return kmers.window_stats(adapters.reads(spark, d), K, QUALITY)


@registered(sql.query(sql.win(K), select="SELECT fragment_id, role, pos, w AS window, kmer, class FROM win"))
def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.windows(adapters.reads(spark, d), K, QUALITY).select("fragment_id", "role", "pos", "window", "kmer", "class")


@registered(sql.query(*_COUNTED, select="SELECT kmer, support FROM counts"))
def kmer_count_fragment(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@registered(sql.query(sql.win(K), select="SELECT kmer, count(*) AS support FROM win WHERE kmer IS NOT NULL GROUP BY kmer"))
def kmer_count_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_kmers(adapters.fragments(spark, d), K, QUALITY, "occurrence")


@registered(sql.query(sql.win(41), sql.counts(41), select="SELECT kmer, support FROM counts"))
def kmer_count_wide(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, 41)


@registered(sql.query(*_KEPT, select="SELECT kmer, support FROM kept"))
def kmer_retained(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)


@registered(sql.query(*_COUNTED, select="SELECT kmer, support, CASE WHEN support >= 3 THEN 'retained' ELSE 'discarded' END AS decision FROM counts"))
def retention_decisions(spark: SparkSession, d: str) -> DataFrame:
    return kmers.retention_decisions(_counts(spark, d), 3)


@registered(sql.query(*_COUNTED, select="SELECT support, count(*) AS distinct_canonical_keys FROM counts GROUP BY support"))
def support_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kmers.support_histogram(_counts(spark, d))


@registered(sql.query(*_COUNTED, select="SELECT count(*) AS observed_keys, cast(sum(support) AS bigint) AS observed_mass, cast(count_if(support >= 2) AS bigint) AS retained_keys, cast(sum(support) FILTER (support >= 2) AS bigint) AS retained_mass, cast(count_if(support < 2) AS bigint) AS removed_keys, cast(sum(support) FILTER (support < 2) AS bigint) AS removed_mass FROM counts"))
def count_summary(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_summary(_counts(spark, d))


_DIGEST = "SELECT '{label}' AS label, count(*) AS keys, cast(sum(support) AS bigint) AS mass, sha256(cast(count(*) AS varchar) || ':' || " + " || ':' || ".join(f"cast(sum(cast('0x' || substr(h, {1 + 15 * i}, 15) AS bigint)) AS varchar)" for i in range(4)) + ") AS digest FROM (SELECT support, sha256(kmer || chr(9) || cast(support AS varchar)) AS h FROM {source})"


@registered(sql.query(*_KEPT, select=_DIGEST.format(label="observed", source="counts") + " UNION ALL " + _DIGEST.format(label="retained", source="kept")))
def transform_digests(spark: SparkSession, d: str) -> DataFrame:
    return kmers.transform_summary(_counts(spark, d))


@registered(sql.query(*_COUNTED, select="SELECT kmer FROM counts WHERE support >= 2"))
def two_hit_keys(spark: SparkSession, d: str) -> DataFrame:
    return kmers.two_hit_keys(adapters.fragments(spark, d), K, QUALITY)


_MINIMIZED = f"""
  mins AS (
    SELECT kmer, support, list_min(list_transform(range(0, {K - M + 1}), lambda i: {{'key': least(substr(kmer, i + 1, {M}), reverse(translate(substr(kmer, i + 1, {M}), 'ACGT', 'TGCA'))), 'pos': i}})) AS m FROM counts),
  minimized AS MATERIALIZED (
    SELECT kmer, support, m.key AS minimizer, cast(m.pos AS int) AS minimizer_pos,
           cast(list_sum(list_transform(range(0, {M}), lambda i: (instr('ACGT', substr(m.key, i + 1, 1)) - 1) * cast(pow(4, {M - 1} - i) AS bigint))) AS bigint) % {BUCKETS} AS bucket_id
    FROM mins)"""


@registered(sql.query(*_COUNTED, _MINIMIZED, select="SELECT * FROM minimized"))
def minimizers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.minimizers(kmers.count_kmers(adapters.fragments(spark, d), K, QUALITY, with_code=True), K, M, BUCKETS)


@registered(sql.query(*_COUNTED, _MINIMIZED, select="SELECT bucket_id, count(*) AS distinct_keys, cast(sum(support) AS bigint) AS occurrences FROM minimized GROUP BY bucket_id"))
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.bucket_counts(kmers.count_kmers(adapters.fragments(spark, d), K, QUALITY, with_code=True), K, M, BUCKETS)


@registered(
    sql.query(
        *_COUNTED,
        _MINIMIZED,
        """
  marked AS (SELECT fragment_id, role, pos, minimizer, bucket_id FROM win JOIN minimized USING (kmer)),
  runs AS (SELECT *, sum(new) OVER (PARTITION BY fragment_id, role ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN lag(minimizer) OVER w = minimizer AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS new FROM marked WINDOW w AS (PARTITION BY fragment_id, role ORDER BY pos)))""",
        select="SELECT fragment_id, role, min(pos) AS first_window, count(*) AS window_count, any_value(minimizer) AS minimizer, any_value(bucket_id) AS bucket_id FROM runs GROUP BY fragment_id, role, run",
    )
)
def super_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.super_kmers(adapters.reads(spark, d), K, M, BUCKETS, QUALITY)


# graph


@registered(sql.query(*_KEPT, sql.handles(K), select="SELECT * FROM handles"))
def handles(spark: SparkSession, d: str) -> DataFrame:
    return graph.handles(_kept(spark, d), K)


@registered(sql.query(*_GRAPH, select="SELECT node, indeg, outdeg, is_palindrome, touches_self_rc, is_boundary FROM nodes"))
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of(_coded(spark, d), K).select("node", "indeg", "outdeg", "is_palindrome", "touches_self_rc", "is_boundary")


@registered(sql.query(*_GRAPH, select="SELECT node, indeg, outdeg FROM nodes WHERE is_boundary"))
def boundary_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of(_coded(spark, d), K).filter("is_boundary").select("node", "indeg", "outdeg")


@registered(sql.query(*_GRAPH, select="SELECT node, in_mask, out_mask, touches_self_rc, is_boundary FROM nodes"))
def node_state_masks(spark: SparkSession, d: str) -> DataFrame:
    return evidence.state_masks(_coded(spark, d), K)


@registered(sql.query(*_UNITS, select="SELECT unitig_id, seq, topology, sequence_sha256 FROM units"))
def unitigs(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("unitig_id", "seq", "topology", "sequence_sha256")


@registered(sql.query(*_UNITS, select="SELECT unitig_id, length(seq) AS length, edge_steps, canonical_kmers, minimum_support, lower_median_support, maximum_support FROM units"))
def unitig_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("unitig_id", F.length("seq").cast("long").alias("length"), "edge_steps", "canonical_kmers", "minimum_support", "lower_median_support", "maximum_support")


@registered(sql.query(*_UNITS, sql.links(K), select="SELECT * FROM links"))
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    kept, units = _graph(spark, d)
    return graph.links(units, K)


@registered(
    sql.query(
        *_UNITS,
        sql.links(K),
        """
  pairs_of AS MATERIALIZED (SELECT from_segment AS u, to_segment AS v FROM links UNION SELECT to_segment, from_segment FROM links),
  reach AS (SELECT u AS node, u AS seen FROM pairs_of UNION SELECT r.node, p.v FROM reach r JOIN pairs_of p ON r.seen = p.u)""",
        select="SELECT node AS unitig_id, min(seen) AS component FROM reach GROUP BY node",
    )
)
def link_components(spark: SparkSession, d: str) -> DataFrame:
    kept, units = _graph(spark, d)
    return components.connected_components(graph.links(units, K), "from_segment", "to_segment").select(F.col("node").alias("unitig_id"), "component")


@registered(sql.query(*_UNITS, sql.links(K), select="SELECT 'links that do not overlap' AS rule, cast(0 AS bigint) AS rows UNION ALL SELECT 'handles without their mate', 0 UNION ALL SELECT 'unitig keys less retained keys', cast((SELECT sum(canonical_kmers) FROM units) - (SELECT count(*) FROM kept) AS bigint)"))
def graph_invariants(spark: SparkSession, d: str) -> DataFrame:
    kept, units = _graph(spark, d)
    linked = graph.links(units, K)
    one = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("rows"))
    mass = units.agg(F.sum("canonical_kmers").alias("a")).crossJoin(kept.agg(F.count("*").alias("b"))).select(F.lit("unitig keys less retained keys").alias("rule"), (F.col("a") - F.col("b")).alias("rows"))
    return one("links that do not overlap", graph.link_overlaps(units, linked, K)).unionByName(one("handles without their mate", graph.rc_asymmetry(kept, K))).unionByName(mass)


# mapping


@registered(sql.query(*_MAPPED, select='SELECT fragment_id, role, unitig_id, start, "end", strand FROM placed'))
def placements(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d)[1].filter("unitig_id IS NOT NULL").select("fragment_id", "role", "unitig_id", "start", "end", "strand")


@registered(sql.query(*_MAPPED, select=f"SELECT r.role, g.state, coalesce(n, 0) AS reads FROM (SELECT DISTINCT role FROM audits) r CROSS JOIN (VALUES {sql.READ_GRID}) g(state) LEFT JOIN (SELECT role, state, count(*) AS n FROM audits GROUP BY ALL) c ON c.role = r.role AND c.state = g.state"))
def read_states(spark: SparkSession, d: str) -> DataFrame:
    return mapping.read_states(_mapped(spark, d)[2])


@registered(
    sql.query(
        *_MAPPED,
        "told AS (SELECT unitig_id, fragment_id, role, count(*) AS n, max(state) = 'single_placement_group' AS single FROM placed JOIN audits USING (fragment_id, lane, role) WHERE n_groups BETWEEN 1 AND 1000 GROUP BY unitig_id, fragment_id, role)",
        select="SELECT unitig_id, cast(coalesce(sum(n), 0) AS bigint) AS placements, cast(coalesce(count_if(single), 0) AS bigint) AS single_reads, cast(coalesce(count_if(NOT single), 0) AS bigint) AS multi_reads FROM units LEFT JOIN told USING (unitig_id) GROUP BY unitig_id",
    )
)
def unitig_placements(spark: SparkSession, d: str) -> DataFrame:
    units, placed, audits = _mapped(spark, d)
    return mapping.unitig_placements(placed, audits, units)


_PAIR_COUNTS = f"SELECT {{lane}} AS lane, g.state, count(p.fragment_id) AS fragments FROM {{lanes}} CROSS JOIN (VALUES {sql.PAIR_GRID}) g(state) LEFT JOIN pairs p ON p.state = g.state {{on}} GROUP BY ALL"


@registered(sql.query(*_PAIRED, select=_PAIR_COUNTS.format(lane="cast(-1 AS int)", lanes="(SELECT 1)", on="") + " UNION ALL " + _PAIR_COUNTS.format(lane="l.lane", lanes="(SELECT DISTINCT lane FROM pairs) l", on="AND p.lane = l.lane")))
def pair_states(spark: SparkSession, d: str) -> DataFrame:
    units, placed, audits = _mapped(spark, d)
    return mapping.pair_states(mapping.audit_pairs(audits, placed, units)).withColumn("lane", F.coalesce("lane", F.lit(-1)))


@registered(
    sql.query(
        *_PAIRED,
        "crossing AS (SELECT lane, least(p1, p2) AS a, greatest(p1, p2) AS b FROM pairs WHERE state = 'cross_unitig_observation')",
        select="SELECT lane, " + ", ".join(f'{s}."{c}" AS {c}_{s}' for s in "ab" for c in ("segment", "end", "strand", "end_distance", "mate_role")) + ", count(*) AS supplied_fragment_instances FROM crossing GROUP BY ALL",
    )
)
def pair_links(spark: SparkSession, d: str) -> DataFrame:
    units, placed, audits = _mapped(spark, d)
    return mapping.pair_links(mapping.audit_pairs(audits, placed, units))


_SPANS = """
  sole AS (SELECT fragment_id, lane, role, unitig_id, start, "end", strand FROM audits JOIN placed USING (fragment_id, lane, role) WHERE state = 'single_placement_group'),
  both_placed AS (SELECT a.lane, a.unitig_id = b.unitig_id AS same, a.start AS s1, b.start AS s2, greatest(a."end", b."end") - least(a.start, b.start) AS span, CASE WHEN a.start < b.start THEN a.strand || b.strand ELSE b.strand || a.strand END AS o FROM sole a JOIN sole b ON a.fragment_id = b.fragment_id AND a.role = 'R1' AND b.role = 'R2'),
  spans AS (SELECT lane, span, CASE WHEN NOT same THEN 'different' WHEN s1 = s2 THEN 'coincident' ELSE 'included' END AS kind, CASE o WHEN '+-' THEN 'FR' WHEN '-+' THEN 'RF' WHEN '++' THEN 'FF' ELSE 'RR' END AS o FROM both_placed),
  tallied AS (
    SELECT lane, cast(count_if(kind = 'included') AS bigint) AS included, cast(count_if(kind = 'different') AS bigint) AS different_unitig, cast(count_if(kind = 'coincident') AS bigint) AS coincident_start,
           cast(count_if(kind = 'included' AND o = 'FR') AS bigint) AS fr, cast(count_if(kind = 'included' AND o = 'RF') AS bigint) AS rf, cast(count_if(kind = 'included' AND o = 'FF') AS bigint) AS ff, cast(count_if(kind = 'included' AND o = 'RR') AS bigint) AS rr FROM spans GROUP BY lane),
  led AS (SELECT *, greatest(fr, rf, ff, rr) AS leading_pairs FROM tallied),
  leads AS (SELECT *, CASE WHEN leading_pairs > 0 AND (fr = leading_pairs)::int + (rf = leading_pairs)::int + (ff = leading_pairs)::int + (rr = leading_pairs)::int = 1 THEN CASE leading_pairs WHEN fr THEN 'FR' WHEN rf THEN 'RF' WHEN ff THEN 'FF' ELSE 'RR' END END AS leading_orientation FROM led),
  quantiles AS (SELECT s.lane, """ + ", ".join(f"cast(quantile_disc(span, {q / 100}) AS bigint) AS p{q}" for q in (10, 25, 50, 75, 90)) + """ FROM spans s JOIN leads l ON s.lane = l.lane AND s.o = l.leading_orientation WHERE kind = 'included' GROUP BY s.lane)"""


@registered(
    sql.query(
        *_MAPPED,
        _SPANS,
        select="""SELECT lane, included, different_unitig, coincident_start, fr, rf, ff, rr, leading_orientation, leading_pairs, p10, p25, p50, p75, p90,
      CASE WHEN included < 20 THEN 'insufficient_included_pairs' WHEN leading_orientation IS NULL THEN 'no_unique_leading_orientation' WHEN leading_pairs < 10 THEN 'insufficient_leading_orientation_pairs'
           WHEN leading_pairs * 10 < included * 9 THEN 'dominance_below_threshold' WHEN p90 - p10 > 1000 THEN 'central_span_interval_too_wide' ELSE 'available' END AS availability
    FROM leads LEFT JOIN quantiles USING (lane)""",
    )
)
def library_model(spark: SparkSession, d: str) -> DataFrame:
    _, placed, audits = _mapped(spark, d)
    return mapping.library_model(audits, placed)


# read-witnessed evidence and several k


def _both_units(k: int, win: str) -> str:
    return f"SELECT cast({k} AS int) AS k, kmer, count(DISTINCT fragment_id) AS fragments, count(*) AS occurrences FROM {win} WHERE kmer IS NOT NULL GROUP BY kmer"


@registered(sql.query(sql.win(K), sql.win(HIGHER, "win_higher"), select=_both_units(K, "win") + " UNION ALL " + _both_units(HIGHER, "win_higher")))
def portfolio_counts(spark: SparkSession, d: str) -> DataFrame:
    """Supports of both k in both units, from one scan."""
    return evidence.portfolio_counts(adapters.fragments(spark, d), [K, HIGHER], QUALITY)


@registered(sql.query(sql.ledger(K), select="SELECT * FROM ledger"))
def transition_ledger(spark: SparkSession, d: str) -> DataFrame:
    return evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY)


@registered(sql.query(*_UNITS, sql.ledger(K), sql.interior(K), sql.segments(K), select="SELECT * FROM segments"))
def witnessed_segments(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    return evidence.witnessed_segments(units, evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY), K).drop("topology")


@registered(
    sql.query(
        *_UNITS,
        sql.ledger(K),
        sql.interior(K),
        sql.segments(K),
        f"inside AS (SELECT unitig_id, segment_no, least(q, {sql.rc('q')}) AS qmer FROM (SELECT unitig_id, segment_no, substr(seq, i, {K + 1}) AS q FROM (SELECT unitig_id, segment_no, seq, cast(unnest(range(1, length(seq) - {K} + 1)) AS int) AS i FROM segments WHERE length(seq) > {K})))",
        "sums AS (SELECT unitig_id, segment_no, count(*) AS n, sum(occurrences) AS o, sum(fragments) AS f FROM inside JOIN ledger USING (qmer) GROUP BY ALL)",
        select="SELECT unitig_id, segment_no, coalesce(n, 0) AS transitions, cast(coalesce(o, 0) AS bigint) AS occurrences, cast(coalesce(f, 0) AS bigint) AS fragments FROM segments LEFT JOIN sums USING (unitig_id, segment_no)",
    )
)
def segment_evidence(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    ledger = stored(evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY))
    return evidence.segment_evidence(evidence.witnessed_segments(units, ledger, K), ledger, K).drop("topology")


_OVER = f"""
  over_links AS (
    SELECT right(CASE from_orientation WHEN '+' THEN a.seq ELSE {sql.rc("a.seq")} END, {K}) || substr(CASE to_orientation WHEN '+' THEN b.seq ELSE {sql.rc("b.seq")} END, {K}, 1) AS q
    FROM links JOIN units a ON from_segment = a.unitig_id JOIN units b ON to_segment = b.unitig_id),
  candidates AS (SELECT qmer, bool_or(i) AS in_unitig, bool_or(l) AS in_link FROM (SELECT qmer, true AS i, false AS l FROM interior UNION ALL SELECT {sql.canon("q")}, false, true FROM over_links) GROUP BY qmer),
  known AS (SELECT qmer, occurrences, fragments, {sql.canon(f"left(qmer, {K})")} IN (SELECT kmer FROM kept) AND {sql.canon(f"right(qmer, {K})")} IN (SELECT kmer FROM kept) AS ends FROM ledger)"""


@registered(
    sql.query(
        *_UNITS,
        sql.links(K),
        sql.ledger(K),
        sql.interior(K),
        _OVER,
        select="SELECT qmer, coalesce(in_unitig, false) AS in_unitig, coalesce(in_link, false) AS in_link, coalesce(occurrences, 0) AS occurrences, coalesce(fragments, 0) AS fragments, CASE WHEN fragments IS NULL THEN 'excluded_no_witness' WHEN NOT ends THEN 'excluded_endpoint' WHEN in_unitig IS NULL THEN 'unplaced' ELSE 'admitted' END AS decision FROM candidates FULL JOIN known USING (qmer)",
    )
)
def transition_decisions(spark: SparkSession, d: str) -> DataFrame:
    kept, units = _graph(spark, d)
    ledger = evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY, with_code=True)
    return evidence.transition_decisions(ledger, units, graph.links(units, K), kept, K)


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _coded(spark, d, K), _coded(spark, d, HIGHER)


@registered(sql.query(sql.two_k(K, HIGHER), select="SELECT higher, spot AS lower_offset, lower_kmer, CASE WHEN literal = lower_kmer THEN '+' ELSE '-' END AS orientation, lower_support IS NOT NULL AS present FROM embedded"))
def multik_contains(spark: SparkSession, d: str) -> DataFrame:
    return evidence.multik_contains(*_two(spark, d), K, HIGHER)


@registered(sql.query(sql.two_k(K, HIGHER), select="SELECT lower_kmer, lower_support, count(*) AS higher_keys, cast(sum(higher_support) AS bigint) AS higher_support FROM (SELECT DISTINCT lower_kmer, lower_support, higher, higher_support FROM embedded WHERE lower_support IS NOT NULL) GROUP BY ALL"))
def multik_supports(spark: SparkSession, d: str) -> DataFrame:
    return evidence.multik_supports(*_two(spark, d), K, HIGHER)


@registered(sql.query(sql.two_k(K, HIGHER), select="SELECT DISTINCT lower_kmer, side, base, higher FROM contexts SEMI JOIN (SELECT lower_kmer, side FROM contexts GROUP BY ALL HAVING count(DISTINCT base) > 1) m USING (lower_kmer, side)"))
def multik_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.multik_conflicts(*_two(spark, d), K, HIGHER)


@registered(sql.query(sql.two_k(K, HIGHER), f"sides AS (SELECT kmer AS lower_kmer, unnest(CASE WHEN kmer = {sql.rc('kmer')} THEN ['fixed_point'] ELSE ['left', 'right'] END) AS side FROM low)", select="SELECT lower_kmer, side FROM sides ANTI JOIN contexts USING (lower_kmer, side)"))
def multik_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return evidence.multik_unresolved(*_two(spark, d), K, HIGHER)


_BESIDE = f"""
  shown AS (SELECT l.kmer, l.w, l.pos, a.pos AS before, b.pos AS upto
    FROM (SELECT * FROM lwin WHERE kmer IS NOT NULL) l
    ASOF LEFT JOIN (SELECT fragment_id, role, pos FROM hwin WHERE kmer IS NOT NULL) a ON l.fragment_id = a.fragment_id AND l.role = a.role AND l.pos > a.pos
    ASOF LEFT JOIN (SELECT fragment_id, role, pos FROM hwin WHERE kmer IS NOT NULL) b ON l.fragment_id = b.fragment_id AND l.role = b.role AND l.pos >= b.pos),
  bare AS (
    SELECT kmer, w, 'left' AS raw FROM shown WHERE coalesce(before < pos - {HIGHER - K}, true)
    UNION ALL SELECT kmer, w, 'right' FROM shown WHERE coalesce(upto < pos - {HIGHER - K - 1}, true))"""


@registered(sql.query(sql.win(K, "lwin"), sql.win(HIGHER, "hwin"), _BESIDE, select=f"SELECT kmer AS lower_kmer, CASE WHEN w = {sql.rc('w')} THEN 'fixed_point' WHEN w = kmer THEN raw WHEN raw = 'left' THEN 'right' ELSE 'left' END AS side, count(*) AS lower_window_occurrences FROM bare GROUP BY ALL"))
def multik_unresolved_sides(spark: SparkSession, d: str) -> DataFrame:
    return evidence.unresolved_sides(adapters.fragments(spark, d), K, HIGHER, QUALITY)


def _units_of(k: int) -> str:
    return "(" + sql.query(sql.win(k), sql.counts(k), sql.kept(), sql.handles(k), sql.NODES, sql.unitigs(k), select=f"SELECT '{k}' AS k, topology, seq FROM units") + ")"


@registered(f"SELECT topology, seq, string_agg(k, ',' ORDER BY k) AS members, count(*) > 1 AS agreement FROM (SELECT * FROM {_units_of(K)} UNION ALL SELECT * FROM {_units_of(HIGHER)}) GROUP BY topology, seq")
def exact_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evidence.exact_agreement({k: _graph(spark, d, k)[1] for k in (K, HIGHER)})


@registered(sql.query(sql.win(WIDE), sql.counts(WIDE), sql.kept(), sql.handles(WIDE), sql.NODES, sql.unitigs(WIDE), select="SELECT unitig_id, seq, topology, edge_steps, minimum_support, lower_median_support, maximum_support FROM units"))
def unitigs_wide(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, WIDE)[1].select("unitig_id", "seq", "topology", "edge_steps", "minimum_support", "lower_median_support", "maximum_support")


@registered(sql.query(sql.win(K + 1), select="SELECT fragment_id, role, pos, kmer AS qmer, CASE WHEN w = kmer THEN '+' ELSE '-' END AS orientation FROM win WHERE kmer IS NOT NULL"))
def qmer_windows(spark: SparkSession, d: str) -> DataFrame:
    return evidence.qmer_windows(adapters.reads(spark, d), K, QUALITY)


_SEGMENTED = (*_UNITS, sql.ledger(K), sql.interior(K), sql.segments(K))
_EDGES = f"edges AS MATERIALIZED (SELECT unitig_id, segment_no, step, literal, {sql.canon('literal')} AS kmer FROM (SELECT unitig_id, segment_no, step, substr(seq, step + 1, {K}) AS literal FROM (SELECT *, cast(unnest(range(0, edge_steps)) AS int) AS step FROM segments)))"


def _segmented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The retained k-mers, their unitigs, the ledger and the witnessed segments, each cut from its lineage."""
    kept, units = _graph(spark, d)
    ledger = stored(evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY))
    return kept, units, ledger, stored(evidence.witnessed_segments(units, ledger, K))


@registered(sql.query(*_SEGMENTED, _EDGES, select="SELECT unitig_id, segment_no, step, kmer, CASE WHEN literal = kmer THEN '+' ELSE '-' END AS orientation FROM edges"))
def edge_placements(spark: SparkSession, d: str) -> DataFrame:
    return evidence.edge_placements(_segmented(spark, d)[3], K)


@registered(sql.query(*_SEGMENTED, _EDGES, select="SELECT unitig_id, segment_no, count(*) AS edges, cast(sum(support) AS bigint) AS total, min(support) AS minimum, cast(quantile_disc(support, 0.5) AS bigint) AS lower_median, max(support) AS maximum FROM edges JOIN kept USING (kmer) GROUP BY ALL"))
def segment_support(spark: SparkSession, d: str) -> DataFrame:
    kept, _, _, segments = _segmented(spark, d)
    return evidence.segment_support(segments, kept, K)


_SEGMENT_LINKS = f"""
  segment_views AS (SELECT {{'unitig_id': unitig_id, 'segment_no': segment_no}} AS id, '+' AS o, seq AS s FROM segments UNION ALL SELECT {{'unitig_id': unitig_id, 'segment_no': segment_no}}, '-', {sql.rc("seq")} FROM segments),
  touching AS (
    SELECT a.id AS a, a.o AS oa, b.id AS b, b.o AS ob, right(a.s, {K}) || substr(b.s, {K}, 1) AS q
    FROM segment_views a JOIN segment_views b ON right(a.s, {K - 1}) = left(b.s, {K - 1})),
  segment_links AS (
    SELECT DISTINCT least({{'a': a, 'oa': oa, 'b': b, 'ob': ob}}, {{'a': b, 'oa': CASE ob WHEN '+' THEN '-' ELSE '+' END, 'b': a, 'ob': CASE oa WHEN '+' THEN '-' ELSE '+' END}}) AS l
    FROM touching WHERE {sql.canon("q")} IN (SELECT qmer FROM ledger))"""


@registered(sql.query(*_SEGMENTED, _SEGMENT_LINKS, select="SELECT l.a.unitig_id AS from_unitig, l.a.segment_no AS from_no, l.oa AS from_orientation, l.b.unitig_id AS to_unitig, l.b.segment_no AS to_no, l.ob AS to_orientation FROM segment_links"))
def segment_links(spark: SparkSession, d: str) -> DataFrame:
    _, _, ledger, segments = _segmented(spark, d)
    return evidence.segment_links(segments, ledger, K)


@registered()
def forced_paths(spark: SparkSession, d: str) -> DataFrame:
    """The witnessed segments, joined again where the links leave no choice."""
    _, _, ledger, segments = _segmented(spark, d)
    found = evidence.forced_paths(segments, stored(evidence.segment_links(segments, ledger, K)), K)
    return found.select(F.array_join("path_segments", " ").alias("path"), "seq", "topology")


_RULES = ["observed keys are retained or removed", "observed mass is retained or removed", "retained keys were observed", "retained mass is the summary''s", "handles are twice the keys less palindromes", "unitigs hold every retained key once", "unitigs are as long as their edges", "segments hold every edge once", "segments are as long as their edges", "transitions lie between edges", "cuts are the transitions without a witness", "transitions are shown or cut", "every ledger row is decided on", "decisions hold all occurrences", "decisions hold all fragments", "no fragment counts more often than it occurs"]
_TOTALS = ["(SELECT count(*) FROM counts)", "(SELECT sum(support) FROM counts)", "(SELECT count(*) FROM kept)", "(SELECT sum(support) FROM kept)", "(SELECT count(*) FROM handles)", "(SELECT count(*) FROM kept)", "(SELECT sum(length(seq)) FROM units)", "(SELECT sum(edge_steps) FROM units)", "(SELECT sum(length(seq)) FROM segments)", "(SELECT count(*) FROM interior)", "(SELECT count(*) FROM segments WHERE segment_no > 0)", "(SELECT count(*) FROM interior)", "(SELECT count(*) FROM ledger)", "(SELECT sum(occurrences) FROM ledger)", "(SELECT sum(fragments) FROM ledger)", "0"]


@registered(sql.query(*_SEGMENTED, select=" UNION ALL ".join(f"SELECT '{rule}' AS rule, cast({n} AS bigint) AS \"left\", cast({n} AS bigint) AS \"right\"" for rule, n in zip(_RULES, _TOTALS, strict=True))))
def conservation(spark: SparkSession, d: str) -> DataFrame:
    counts = stored(kmers.count_kmers(adapters.fragments(spark, d), K, QUALITY, with_code=True))
    kept = kmers.retain(counts)
    units = settled(spark, lambda: graph.unitigs(kept, K))
    ledger = stored(evidence.transition_ledger(adapters.fragments(spark, d), K, QUALITY, with_code=True))
    segments = stored(evidence.witnessed_segments(units, ledger, K))
    decided = stored(evidence.transition_decisions(ledger, units, graph.links(units, K), kept, K))
    return evidence.conservation(counts, kept, units, segments, ledger, decided, K)


# pairs as evidence for paths


def _paired(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units, their links, parts (lengths and components), placements and the pairs with whether they calibrate."""
    units, placed, _ = _mapped(spark, d)
    linked = stored(graph.links(units, K))
    labels = components.connected_components(linked, "from_segment", "to_segment").select(F.col("node").alias("unitig_id"), "component")
    pairs = adapters.fragments(spark, d).select("fragment_id", "lane", dna.split_is_calibration("fragment_id", 3, 10).alias("calibrates"))
    return units, linked, stored(pair_path.segments(units, labels)), placed, pairs


_ANCHORS = """
  pairs_of AS MATERIALIZED (SELECT from_segment AS u, to_segment AS v FROM links UNION SELECT to_segment, from_segment FROM links),
  reach AS (SELECT u AS node, u AS seen FROM pairs_of UNION SELECT r.node, p.v FROM reach r JOIN pairs_of p ON r.seen = p.u),
  labels AS MATERIALIZED (SELECT node AS unitig_id, min(seen) AS component FROM reach GROUP BY node),
  told AS (SELECT p.*, coalesce(component, unitig_id) AS component FROM placed p LEFT JOIN labels USING (unitig_id)),
  sides AS (SELECT fragment_id, lane, role, count(*) AS n, min(unitig_id) AS unitig_id, min(component) AS component, min(start) AS s, min("end") AS e, min(strand) AS o FROM told GROUP BY ALL),
  calibrating AS (SELECT DISTINCT fragment_id, lane FROM reads WHERE cast('0x' || substr(sha256('helixframe/split/1' || cast(fragment_id AS varchar)), 1, 15) AS bigint) % 10 < 3),
  anchored AS (
    SELECT c.fragment_id, c.lane, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'no_placement' WHEN a.n > 1 OR b.n > 1 THEN 'nonunique_placement' WHEN a.component <> b.component THEN 'cross_component' WHEN a.unitig_id <> b.unitig_id THEN 'different_unitig' WHEN a.s = b.s THEN 'coincident_start' ELSE 'included' END AS disposition,
           CASE WHEN a.s < b.s THEN a.o || b.o ELSE b.o || a.o END AS o, greatest(a.e, b.e) - least(a.s, b.s) AS span, greatest(a.s, b.s) - CASE WHEN a.s < b.s THEN a.e ELSE b.e END AS inside
    FROM calibrating c LEFT JOIN sides a ON a.fragment_id = c.fragment_id AND a.role = 'R1' LEFT JOIN sides b ON b.fragment_id = c.fragment_id AND b.role = 'R2'),
  faced AS (SELECT lane, disposition, span, inside, CASE WHEN disposition = 'included' THEN CASE o WHEN '+-' THEN 'FR' WHEN '-+' THEN 'RF' WHEN '++' THEN 'FF' ELSE 'RR' END END AS o FROM anchored),
  tallied AS (
    SELECT lane, """ + ", ".join(f"cast(count_if(disposition = '{x}') AS bigint) AS {x}" for x in pair_path.DISPOSITIONS) + ", " + ", ".join(f"cast(count_if(o = '{x}') AS bigint) AS {x.lower()}" for x in pair_path.ORIENTATIONS) + """ FROM faced GROUP BY lane),
  led AS (SELECT *, greatest(fr, rf, ff, rr) AS dominant_pairs FROM tallied),
  leads AS (SELECT *, CASE WHEN dominant_pairs > 0 AND (fr = dominant_pairs)::int + (rf = dominant_pairs)::int + (ff = dominant_pairs)::int + (rr = dominant_pairs)::int = 1 THEN CASE dominant_pairs WHEN fr THEN 'FR' WHEN rf THEN 'RF' WHEN ff THEN 'FF' ELSE 'RR' END END AS dominant_orientation FROM led),
  ranked AS (SELECT f.lane, """ + ", ".join(f"cast(quantile_disc({c}, {q / 100}) AS bigint) AS {name}_p{q}" for c, name in (("span", "span"), ("inside", "inner")) for q in (10, 50, 90)) + """ FROM faced f JOIN leads l ON f.lane = l.lane AND f.o = l.dominant_orientation GROUP BY f.lane)"""


@registered(
    sql.query(
        *_MAPPED,
        sql.links(K),
        _ANCHORS,
        select="SELECT lane, " + ", ".join(pair_path.DISPOSITIONS) + """, fr, rf, ff, rr, dominant_orientation, dominant_pairs, span_p10, span_p50, span_p90, inner_p10, inner_p50, inner_p90,
      CASE WHEN included < 10 THEN 'insufficient_anchors' WHEN dominant_orientation IS NULL THEN 'no_unique_dominant_orientation' WHEN dominant_pairs < 10 THEN 'insufficient_dominant_anchors' WHEN dominant_pairs * 10 < included * 9 THEN 'dominance_below_threshold'
           WHEN span_p90 - span_p10 > 1000 THEN 'span_interval_too_wide' WHEN inner_p90 - inner_p10 > 1000 THEN 'inner_interval_too_wide' ELSE 'available' END AS availability
    FROM leads LEFT JOIN ranked USING (lane)""",
    )
)
def pair_models(spark: SparkSession, d: str) -> DataFrame:
    _, _, parts, placed, pairs = _paired(spark, d)
    return pair_path.lane_models(pair_path.anchors(pairs.filter("calibrates"), placed, parts))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    _, linked, parts, placed, pairs = _paired(spark, d)
    models = cut_lineage(pair_path.lane_models(pair_path.anchors(pairs.filter("calibrates"), placed, parts)))
    replayed = pairs.filter("NOT calibrates").drop("calibrates")
    sized, facts, hits = pair_path.search(replayed, placed, parts, linked, models, K)
    return stored(pair_path.decisions(sized, facts)), hits, replayed, placed, parts


@registered()
def pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[0]


@registered()
def path_evidence(spark: SparkSession, d: str) -> DataFrame:
    return pair_path.path_evidence(*_decided(spark, d))


# correction


@registered(sql.query(select="SELECT fragment_id, role, cast(s AS int) AS start, cast(greatest(e - s, 0) AS int) AS length, CASE WHEN greatest(e - s, 0) < 40 THEN 'too_short' WHEN regexp_matches(substr(seq, cast(s + 1 AS int), cast(e - s AS int)), '[^ACGT]') THEN 'internal_ambiguity' WHEN e - s = 60 THEN 'unchanged' ELSE 'trimmed' END AS state FROM (SELECT fragment_id, role, seq, length(regexp_extract(bad, '^(1*)', 1)) AS s, 60 - length(regexp_extract(bad, '(1*)$', 1)) AS e FROM (SELECT fragment_id, role, seq, list_reduce(list_transform(range(1, 61), lambda i: CASE WHEN regexp_matches(substr(seq, i, 1), '[^ACGT]') OR substr(qual, i, 1) = '!' THEN '1' ELSE '0' END), lambda a, b: a || b) AS bad FROM reads))"))
def trim_range(spark: SparkSession, d: str) -> DataFrame:
    return correction.trim_ranges(adapters.reads(spark, d), QUALITY, 40)


_CHOICES = ", ".join(f"('{old}', '{new}')" for old, news in correction.CHOICES.items() for new in news)
_EDITS = f"""
  weak AS (SELECT fragment_id, role, seq, pos, substr(seq, pos + 1, 1) AS old FROM (SELECT *, cast(unnest(range(0, length(seq))) AS int) AS pos FROM reads) WHERE regexp_matches(substr(seq, pos + 1, 1), '[^ACGT]') OR substr(qual, pos + 1, 1) = '!'),
  edits AS MATERIALIZED (SELECT fragment_id, role, pos, old, new, substr(seq, 1, pos) || new || substr(seq, pos + 2) AS candidate FROM weak JOIN (VALUES {_CHOICES}) n(symbol, new) ON symbol = old)"""


@registered(sql.query(_EDITS, select="SELECT * FROM edits"))
def edit_candidates(spark: SparkSession, d: str) -> DataFrame:
    return correction.edit_candidates(adapters.reads(spark, d), QUALITY)


@registered(
    sql.query(
        *_COUNTED,
        _EDITS,
        f"looked AS (SELECT fragment_id, role, pos, old, new, {sql.canon(f'substr(candidate, i, {K})')} AS kmer FROM (SELECT *, cast(unnest(range(1, length(candidate) - {K} + 2)) AS int) AS i FROM edits))",
        select="SELECT fragment_id, role, pos, old, new, count(*) AS windows, cast(count_if(coalesce(support, 0) >= 2) AS bigint) AS trusted_windows, cast(sum(coalesce(support, 0)) AS bigint) AS support FROM looked LEFT JOIN counts USING (kmer) GROUP BY ALL",
    )
)
def spectrum_scores(spark: SparkSession, d: str) -> DataFrame:
    found = correction.edit_candidates(adapters.reads(spark, d), QUALITY)
    counts = kmers.count_kmers(adapters.fragments(spark, d), K, QUALITY, with_code=True)
    return correction.spectrum_scores(found, ["fragment_id", "role", "pos", "old", "new"], "candidate", counts, K)


#: All sets of one and two changes, with their evidence on both spectra. Reads have two weak bases at most, so no limit of the search is met.
_SEARCH = (
    *_COUNTED,
    sql.win(HIGHER, "win_higher"),
    sql.counts(HIGHER, "win_higher", "counts_higher"),
    f"""
  known AS MATERIALIZED (SELECT * FROM counts UNION ALL SELECT * FROM counts_higher),
  ks AS (SELECT * FROM (VALUES ({K}), ({HIGHER})) v(k)),
  raw AS MATERIALIZED (SELECT fragment_id, role, k, i, coalesce(support, 0) AS n FROM (SELECT fragment_id, role, k, i, {sql.canon("substr(seq, i + 1, k)")} AS kmer FROM (SELECT fragment_id, role, seq, k, cast(unnest(range(0, length(seq) - k + 1)) AS int) AS i FROM reads CROSS JOIN ks)) LEFT JOIN known USING (kmer)),
  sites AS MATERIALIZED (SELECT fragment_id, role, seq, pos, substr(seq, pos + 1, 1) AS old, ascii(substr(qual, pos + 1, 1)) - 33 AS phred FROM (SELECT *, cast(unnest(range(0, length(seq))) AS int) AS pos FROM reads) WHERE regexp_matches(substr(seq, pos + 1, 1), '[^ACGT]') OR substr(qual, pos + 1, 1) = '!'),
  early AS MATERIALIZED (SELECT r.fragment_id, r.role, length(r.seq) AS len, CASE WHEN w.whole THEN 'already_trusted' WHEN s.fragment_id IS NULL THEN 'no_editable_bases' END AS early FROM reads r JOIN (SELECT fragment_id, role, min(n) >= 2 AS whole FROM raw GROUP BY ALL) w USING (fragment_id, role) LEFT JOIN (SELECT DISTINCT fragment_id, role FROM sites) s ON r.fragment_id = s.fragment_id AND r.role = s.role),
  singles AS MATERIALIZED (SELECT fragment_id, role, seq, pos, old, new, phred FROM sites JOIN (VALUES {_CHOICES}) n(symbol, new) ON symbol = old JOIN early USING (fragment_id, role) WHERE early IS NULL),
  sets AS MATERIALIZED (
    SELECT row_number() OVER () AS c, *, substr(seq, 1, p1) || w1 || CASE WHEN p2 IS NULL THEN substr(seq, p1 + 2) ELSE substr(seq, p1 + 2, p2 - p1 - 1) || w2 || substr(seq, p2 + 2) END AS candidate FROM (
      SELECT fragment_id, role, seq, 1 AS n_edits, pos AS p1, old AS o1, new AS w1, cast(NULL AS int) AS p2, cast(NULL AS varchar) AS o2, cast(NULL AS varchar) AS w2, phred AS penalty FROM singles
      UNION ALL SELECT a.fragment_id, a.role, a.seq, 2, a.pos, a.old, a.new, b.pos, b.old, b.new, a.phred + b.phred FROM singles a JOIN singles b ON a.fragment_id = b.fragment_id AND a.role = b.role AND a.pos < b.pos)),
  over AS MATERIALIZED (SELECT c, fragment_id, role, k, i, {sql.canon("substr(candidate, i + 1, k)")} AS kmer FROM (SELECT c, fragment_id, role, candidate, p1, p2, k, cast(unnest(range(0, length(seq) - k + 1)) AS int) AS i FROM sets CROSS JOIN ks) WHERE (i <= p1 AND p1 < i + k) OR (i <= p2 AND p2 < i + k)),
  layered AS (SELECT c, k, count(*) AS n_all, count_if(coalesce(support, 0) >= 2) AS t, count_if(coalesce(support, 0) >= 2) - count_if(n >= 2) AS gt, sum(coalesce(support, 0)) - sum(n) AS gs, count_if(n = 1) AS low FROM over JOIN raw USING (fragment_id, role, k, i) LEFT JOIN known USING (kmer) GROUP BY c, k),
  judged AS MATERIALIZED (
    SELECT *, layers >= 1 AND trusted_gain >= 1 AND support_gain >= 1 AND sound AS qualified FROM (
      SELECT c, cast(sum(gt) AS bigint) AS trusted_gain, cast(sum(gs) AS bigint) AS support_gain, cast(count_if(gt > 0 OR gs > 0) AS bigint) AS layers, bool_and(gt >= 0 AND gs >= 0 AND n_all = t) AS sound, cast(sum(low) AS bigint) AS low, coalesce(max(gt) FILTER (k = {K}), 0) AS gt1, coalesce(max(gs) FILTER (k = {K}), 0) AS gs1, coalesce(max(gt) FILTER (k = {HIGHER}), 0) AS gt2, coalesce(max(gs) FILTER (k = {HIGHER}), 0) AS gs2 FROM layered GROUP BY c)
    JOIN sets USING (c)),
  fits AS (SELECT * FROM judged WHERE qualified),
  tops AS (SELECT fragment_id, role, max(gt1) AS a, max(gs1) AS b, max(gt2) AS c2, max(gs2) AS d, max(layers) AS e, min(penalty) AS f, min(n_edits) AS g FROM fits GROUP BY ALL),
  best AS (SELECT fragment_id, role, any_value(n_edits) AS n_edits, any_value(p1) AS p1, any_value(o1) AS o1, any_value(w1) AS w1, any_value(p2) AS p2, any_value(o2) AS o2, any_value(w2) AS w2 FROM fits JOIN tops USING (fragment_id, role) WHERE gt1 = a AND gs1 = b AND gt2 = c2 AND gs2 = d AND layers = e AND penalty = f AND n_edits = g GROUP BY fragment_id, role HAVING count(*) = 1),
  told AS MATERIALIZED (SELECT e.fragment_id, e.role, e.len, CASE WHEN early IS NOT NULL THEN early WHEN t.fragment_id IS NULL THEN 'evidence_below_thresholds' WHEN b.fragment_id IS NULL THEN 'conflicting_candidates' END AS reason, b.* EXCLUDE (fragment_id, role) FROM early e LEFT JOIN tops t USING (fragment_id, role) LEFT JOIN best b USING (fragment_id, role)),
  ruled AS MATERIALIZED (SELECT *, CASE WHEN reason IS NULL THEN 'corrected' WHEN reason = 'conflicting_candidates' THEN 'quarantined' ELSE 'unchanged' END AS state FROM told),
  changes_of AS (SELECT fragment_id, role, p1 AS pos, o1 AS old, w1 AS new FROM best UNION ALL SELECT fragment_id, role, p2, o2, w2 FROM best WHERE p2 IS NOT NULL)""",
)
_HANDED = "CASE WHEN state <> 'quarantined' THEN {0} END"


def _corrected(spark: SparkSession, d: str, **given) -> DataFrame:
    return correction.correct(adapters.reads(spark, d), _spectra(spark, d), QUALITY, **given)


def _spectra(spark: SparkSession, d: str) -> dict[int, DataFrame]:
    held = stored(kmers.spectra(adapters.fragments(spark, d), [K, HIGHER], QUALITY).select("k", "code", F.col("fragments").alias("support")))
    return {k: held.filter(F.col("k") == k) for k in (K, HIGHER)}


@registered(sql.query(*_SEARCH, select=f"SELECT fragment_id, role, state, reason, coalesce(n_edits, 0) AS n_edits, pos, old, new, {_HANDED.format('0')} AS start, {_HANDED.format('cast(len AS int)')} AS length FROM ruled LEFT JOIN changes_of USING (fragment_id, role)"))
def corrected_reads(spark: SparkSession, d: str) -> DataFrame:
    return _corrected(spark, d)


_TRIM = """
  ends AS (SELECT fragment_id, role, seq, length(regexp_extract(bad, '^(1*)', 1)) AS s, 60 - length(regexp_extract(bad, '(1*)$', 1)) AS e FROM (SELECT fragment_id, role, seq, list_reduce(list_transform(range(1, 61), lambda i: CASE WHEN regexp_matches(substr(seq, i, 1), '[^ACGT]') OR substr(qual, i, 1) = '!' THEN '1' ELSE '0' END), lambda a, b: a || b) AS bad FROM reads)),
  cuts AS MATERIALIZED (SELECT fragment_id, role, cast(s AS int) AS s, cast(e - s AS int) AS n FROM ends WHERE e - s BETWEEN 40 AND 59 AND NOT regexp_matches(substr(seq, cast(s + 1 AS int), cast(e - s AS int)), '[^ACGT]')),
  trimmed AS MATERIALIZED (
    SELECT fragment_id, role, len, coalesce(n_edits, 0) AS n_edits, CASE WHEN undecided AND n IS NOT NULL THEN 'trimmed' ELSE state END AS state, CASE WHEN NOT undecided THEN reason WHEN n IS NULL THEN 'terminal_trim_criteria_not_met' ELSE 'unresolved_low_quality_or_ambiguous_termini' END AS reason, CASE WHEN undecided THEN coalesce(s, 0) WHEN state <> 'quarantined' THEN 0 END AS start, CASE WHEN undecided THEN coalesce(n, len) WHEN state <> 'quarantined' THEN len END AS length
    FROM (SELECT *, coalesce(reason IN ('no_editable_bases', 'evidence_below_thresholds'), false) AS undecided FROM ruled) LEFT JOIN cuts USING (fragment_id, role))"""


@registered(sql.query(*_SEARCH, _TRIM, select="SELECT state, reason, count(*) AS reads, cast(sum(len) AS bigint) AS bases, cast(sum(coalesce(length, 0)) AS bigint) AS emitted_bases, cast(sum(CASE WHEN state = 'trimmed' THEN len - length ELSE 0 END) AS bigint) AS trimmed_bases, cast(sum(n_edits) AS bigint) AS changed_bases FROM trimmed GROUP BY state, reason"))
def correction_accounting(spark: SparkSession, d: str) -> DataFrame:
    """States, reasons and bases where unresolved reads lose their weak ends."""
    return correction.accounting(adapters.reads(spark, d), _corrected(spark, d, unresolved="trim_low_quality_terminals"))


_EVIDENCE = f"""
  evaluated AS MATERIALIZED (
    SELECT fragment_id, role, sha256('{correction.CANDIDATE}' || candidate) AS candidate_id, cast(n_edits AS bigint) AS n_edits, p1 || ':' || o1 || '>' || w1 || CASE WHEN p2 IS NULL THEN '' ELSE ',' || p2 || ':' || o2 || '>' || w2 END AS changes, qualified, layers, trusted_gain, support_gain, cast(penalty AS bigint) AS penalty, low, cast((o1 IN ('A', 'C', 'G', 'T'))::int + coalesce((o2 IN ('A', 'C', 'G', 'T'))::int, 0) AS bigint) AS substitutions
    FROM judged)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return correction.evaluated_candidates(adapters.reads(spark, d), _spectra(spark, d), QUALITY)


@registered(sql.query(*_SEARCH, _EVIDENCE, select="SELECT *, n_edits - substitutions AS ambiguities FROM (SELECT *, cast(row_number() OVER (PARTITION BY fragment_id, role ORDER BY candidate_id) AS int) AS rank FROM evaluated) WHERE rank <= 8"))
def correction_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The eight candidates of every searched read with the smallest ids, and their evidence."""
    return correction.alternatives(_evaluated(spark, d))


_ROW = "sha256(candidate_id || chr(9) || changes || chr(9) || qualified::int || chr(9) || layers || chr(9) || trusted_gain || chr(9) || support_gain || chr(9) || penalty || chr(9) || low)"


@registered(sql.query(*_SEARCH, _EVIDENCE, select=f"SELECT fragment_id, role, count(*) AS evaluated, cast(count_if(qualified) AS bigint) AS qualified, cast(count_if(substitutions > 0) AS bigint) AS exact_substitutions, cast(count_if(substitutions < n_edits) AS bigint) AS ambiguity_resolutions, cast(count_if(substitutions > 0 AND substitutions < n_edits) AS bigint) AS mixed, cast(count_if(low > 0) AS bigint) AS with_low, count(*) > 8 AS truncated, sha256('{correction.CANDIDATES}' || string_agg({_ROW}, '' ORDER BY n_edits, changes) || count(*)) AS digest FROM evaluated GROUP BY fragment_id, role"))
def candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every searched read's candidates, and a digest over all of them in order."""
    return correction.candidate_evidence(_evaluated(spark, d))


# evaluation against the genomes that the reads come from


def _truth_windows(size: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT w, count(*) AS n, min(truth_class) AS lo FROM (SELECT truth_class, substr(s, i, {size}) AS w FROM (SELECT truth_class, s, cast(unnest(range(1, length(s) - {size} + 2)) AS int) AS i FROM (SELECT truth_class, seq AS s FROM truths UNION ALL SELECT truth_class, {sql.rc('seq')} FROM truths))) GROUP BY w)"


_JUNCTIONS = (
    _truth_windows(2 * FLANK, "whole"),
    _truth_windows(FLANK, "part"),
    f"""
  cut AS (SELECT unitig_id, b, substr(seq, b - {FLANK} + 1, {2 * FLANK}) AS w, substr(seq, b - {FLANK} + 1, {FLANK}) AS l, substr(seq, b + 1, {FLANK}) AS r FROM (SELECT unitig_id, seq, cast(unnest(range({FLANK}, length(seq) - {FLANK} + 1)) AS int) AS b FROM units WHERE length(seq) >= {2 * FLANK})),
  judged AS (
    SELECT unitig_id, b, coalesce(c.n, 0) AS compatible, coalesce(x.n, 0) AS left_placements, coalesce(y.n, 0) AS right_placements, CASE WHEN c.n IS NOT NULL THEN 'correct_truth_adjacency' WHEN x.n IS NULL OR y.n IS NULL THEN 'indeterminate_unmapped_flank' WHEN x.n > 1 OR y.n > 1 THEN 'indeterminate_ambiguous_flank' ELSE 'false_junction' END AS classification, x.lo <> y.lo AS differ
    FROM cut LEFT JOIN whole c ON cut.w = c.w LEFT JOIN part x ON cut.l = x.w LEFT JOIN part y ON cut.r = y.w)""",
)


@registered(sql.query(*_UNITS, *_JUNCTIONS, select="SELECT g.classification, count(j.classification) AS boundaries, cast(coalesce(count_if(j.classification = 'false_junction' AND differ), 0) AS bigint) AS chimeras FROM (VALUES ('correct_truth_adjacency'), ('indeterminate_unmapped_flank'), ('indeterminate_ambiguous_flank'), ('false_junction')) g(classification) LEFT JOIN judged j ON j.classification = g.classification GROUP BY g.classification"))
def junction_classes(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    contigs = units.select(F.col("unitig_id").alias("contig_id"), "seq")
    boundaries = units.agg(F.sum(F.greatest(F.length("seq") - 2 * FLANK + 1, F.lit(0)).cast("long")).alias("n"))
    return evaluation.junction_classes(evaluation.junctions(contigs, adapters.truths(spark, d), FLANK, correct=False), boundaries)


#: Contigs of two molecules: the first 128 (140) bases of a genome and the last 96 of the next one's copy. Before base 128 and behind the
#: join stand spots that tell the copies apart, before base 140 none.
_CHIMERAS = "units AS (SELECT 2 * a.molecule + k AS unitig_id, left(a.seq, cast(128 + 12 * k AS int)) || right(b.seq, 96) AS seq FROM truths a JOIN truths b ON b.molecule = a.molecule + 1 CROSS JOIN (VALUES (0), (1)) AS kinds(k) WHERE a.truth_class = 'primary' AND b.truth_class = 'minor')"


@registered(sql.query(_CHIMERAS, *_JUNCTIONS, select="SELECT unitig_id AS contig_id, cast(b AS int) AS boundary, classification, compatible, left_placements, right_placements, coalesce(classification = 'false_junction' AND differ, false) AS primary_minor_chimera FROM judged WHERE classification <> 'correct_truth_adjacency'"))
def chimeric_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of contigs joined from two molecules, so that every class but the correct one has rows."""
    truths = stored(adapters.truths(spark, d))
    heads = truths.filter("truth_class = 'primary'").select("molecule", F.col("seq").alias("head"))
    tails = truths.filter("truth_class = 'minor'").select((F.col("molecule") - 1).alias("molecule"), F.right("seq", F.lit(96)).alias("tail"))
    kinds = heads.join(tails, "molecule").select("molecule", "head", "tail", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    contigs = kinds.select((2 * F.col("molecule") + F.col("k")).alias("contig_id"), F.concat(F.left("head", 128 + 12 * F.col("k")), "tail").alias("seq"))
    return evaluation.junction_evidence(evaluation.junctions(contigs, truths, FLANK, correct=False), "non_correct")


_ALIGNED = f"""
  contig_views AS (SELECT unitig_id, '+' AS strand, seq AS s FROM units UNION ALL SELECT unitig_id, '-', {sql.rc("seq")} FROM units),
  truth_posts AS (SELECT molecule, truth_class, seq, cast(unnest(range(0, length(seq) - 21 + 1)) AS int) AS start FROM truths),
  aligned AS MATERIALIZED (SELECT unitig_id AS contig_id, molecule, truth_class, strand, start, cast(start + length(s) AS int) AS "end" FROM contig_views JOIN truth_posts ON left(s, 21) = substr(seq, start + 1, 21) AND substr(seq, start + 1, length(s)) = s)"""


@registered(sql.query(*_UNITS, _ALIGNED, select="SELECT * FROM aligned"))
def exact_alignments(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    return evaluation.exact_alignments(units.select(F.col("unitig_id").alias("contig_id"), "seq"), adapters.truths(spark, d))


@registered(
    sql.query(
        *_UNITS,
        _ALIGNED,
        'bases AS (SELECT molecule, truth_class, count(*) AS n FROM (SELECT DISTINCT molecule, truth_class, unnest(range(start, "end")) AS x FROM aligned) GROUP BY ALL)',
        select="SELECT molecule, truth_class, length(seq) AS length, coalesce(n, 0) AS covered, coalesce(n, 0) * 1000000 // length(seq) AS covered_ppm FROM truths LEFT JOIN bases USING (molecule, truth_class)",
    )
)
def coverage_mask(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    truths = adapters.truths(spark, d)
    found = evaluation.coverage(evaluation.exact_alignments(units.select(F.col("unitig_id").alias("contig_id"), "seq"), truths).select("molecule", "truth_class", "start", "end"), truths)
    return found.select("molecule", "truth_class", "length", "covered", (F.col("fraction") * 1000000).cast("long").alias("covered_ppm"))


@registered(sql.query(*_UNITS, *_JUNCTIONS, select="SELECT unitig_id AS contig_id, cast(b AS int) AS boundary, classification, compatible, left_placements, right_placements, coalesce(classification = 'false_junction' AND differ, false) AS primary_minor_chimera FROM judged WHERE classification <> 'correct_truth_adjacency'"))
def junction_rows(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    rows = evaluation.junctions(units.select(F.col("unitig_id").alias("contig_id"), "seq"), adapters.truths(spark, d), FLANK, correct=False)
    return evaluation.junction_evidence(rows, "non_correct")


_RECOVERED = """
  told AS (SELECT DISTINCT contig_id, molecule, truth_class, start, "end" FROM aligned),
  classes AS (SELECT contig_id, count(*) AS places, count(DISTINCT {'m': molecule, 'c': truth_class}) AS molecules FROM told GROUP BY contig_id),
  bases AS MATERIALIZED (SELECT contig_id, molecule, truth_class, places, molecules, unnest(range(start, "end")) AS x FROM told JOIN classes USING (contig_id)),
  masks AS (
    SELECT molecule, truth_class, cast(count(DISTINCT x) FILTER (places = 1) AS bigint) AS "unique", count(DISTINCT x) AS "upper" FROM bases GROUP BY ALL),
  shared AS (SELECT molecule, truth_class, count(DISTINCT x) AS "lower" FROM (SELECT contig_id, molecule, truth_class, x FROM bases WHERE molecules = 1 GROUP BY contig_id, molecule, truth_class, x, places HAVING count(*) = places) GROUP BY ALL)"""


@registered(
    sql.query(
        *_UNITS,
        _ALIGNED,
        _RECOVERED,
        select='SELECT molecule, truth_class, length(seq) AS length, coalesce("unique", 0) AS "unique", coalesce("lower", 0) AS "lower", coalesce("upper", 0) AS "upper" FROM truths LEFT JOIN masks USING (molecule, truth_class) LEFT JOIN shared USING (molecule, truth_class)',
    )
)
def recovery_bounds(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    truths = adapters.truths(spark, d)
    placed = stored(evaluation.exact_alignments(units.select(F.col("unitig_id").alias("contig_id"), "seq"), truths))
    return evaluation.recovery_bounds(placed, truths).select("molecule", "truth_class", "length", "unique", "lower", "upper")


_RINGS = f"""
  turned AS (SELECT molecule AS contig_id, right(seq, cast(256 - molecule % 256 AS int)) || left(seq, cast(molecule % 256 AS int)) AS seq FROM truths WHERE truth_class = 'primary'),
  ring_views AS (SELECT contig_id, '+' AS strand, seq AS s FROM turned UNION ALL SELECT contig_id, '-', {sql.rc("seq")} FROM turned),
  rings AS (SELECT molecule, truth_class, seq || left(seq, 255) AS seq, cast(unnest(range(0, 256)) AS int) AS start FROM truths)"""


@registered(sql.query(_RINGS, select="SELECT contig_id, molecule, truth_class, strand, start, cast(start + 256 AS int) AS \"end\" FROM ring_views JOIN rings ON substr(rings.seq, start + 1, 21) = left(s, 21) AND substr(rings.seq, start + 1, 256) = s"))
def ring_alignments(spark: SparkSession, d: str) -> DataFrame:
    """The genomes as rings, and contigs that start elsewhere on them."""
    truths = adapters.truths(spark, d)
    at = (F.col("molecule") % 256).cast("int")
    contigs = truths.filter("truth_class = 'primary'").select(F.col("molecule").alias("contig_id"), F.concat(F.right("seq", 256 - at), F.left("seq", at)).alias("seq"))
    return evaluation.exact_alignments(contigs, truths.withColumn("topology", F.lit("circular")))


@registered()
def contig_alignments(spark: SparkSession, d: str) -> DataFrame:
    """The primary alignment of every unitig to the genomes and their copies."""
    _, units = _graph(spark, d)
    return evaluation.contig_alignments(units.select(F.col("unitig_id").alias("contig_id"), "seq"), adapters.truths(spark, d), seed=K)


@registered()
def alignment_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, units = _graph(spark, d)
    contigs, truths = units.select(F.col("unitig_id").alias("contig_id"), "seq"), adapters.truths(spark, d)
    placed = stored(evaluation.exact_alignments(contigs, truths))
    return evaluation.alignment_metrics(evaluation.contig_alignments(contigs, truths, seed=K), contigs, placed, truths)


@registered()
def fitting_alignments(spark: SparkSession, d: str) -> DataFrame:
    """All reads against the genomes and their copies that share a k-mer with them, the best alignment of each."""
    return evaluation.best_fits(adapters.reads(spark, d), adapters.truths(spark, d), K)
