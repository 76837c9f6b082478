"""The catalogue's queries as SQL for an engine with recursive CTEs and lists, built from named CTEs."""

from __future__ import annotations

from helixframe.plans.adapters import reads_cte

RC = "reverse(translate({s}, 'ACGT', 'TGCA'))"


def rc(s: str) -> str:
    return RC.format(s=s)


def canon(s: str) -> str:
    return f"least({s}, {rc(s)})"


def win(k: int, name: str = "win") -> str:
    return f"""
  {name} AS MATERIALIZED (
    SELECT fragment_id, lane, role, pos, w,
           CASE WHEN n AND q THEN 'ambiguity_and_quality' WHEN n THEN 'ambiguity_only' WHEN q THEN 'quality_only' ELSE 'accepted' END AS class,
           CASE WHEN NOT n AND NOT q THEN {canon("w")} END AS kmer
    FROM (
      SELECT fragment_id, lane, role, pos, substr(seq, pos + 1, {k}) AS w, regexp_matches(substr(seq, pos + 1, {k}), '[^ACGT]') AS n, regexp_matches(substr(qual, pos + 1, {k}), '[!-4]') AS q
      FROM (SELECT *, cast(unnest(range(0, length(seq) - {k} + 1)) AS int) AS pos FROM reads WHERE length(seq) >= {k})))"""


def counts(k: int, source: str = "win", name: str = "counts") -> str:
    return f"{name} AS MATERIALIZED (SELECT kmer, count(DISTINCT fragment_id) AS support FROM {source} WHERE kmer IS NOT NULL GROUP BY kmer)"


def kept(source: str = "counts", name: str = "kept") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {source} WHERE support >= 2)"


def handles(k: int) -> str:
    return f"""
  handles AS MATERIALIZED (
    SELECT s AS spelling, kmer, CASE WHEN s = kmer THEN '+' ELSE '-' END AS orientation, support, substr(s, 1, {k - 1}) AS src, substr(s, 2, {k - 1}) AS dst, {rc("s")} AS mate_spelling
    FROM (SELECT DISTINCT kmer, support, s FROM (SELECT kmer, support, unnest([kmer, {rc("kmer")}]) AS s FROM kept)))"""


NODES = f"""
  nodes AS MATERIALIZED (
    SELECT *, indeg <> 1 OR outdeg <> 1 OR is_palindrome OR touches_self_rc AS is_boundary FROM (
      SELECT node, cast(sum(i) AS bigint) AS indeg, cast(sum(o) AS bigint) AS outdeg, bit_or(im) AS in_mask, bit_or(om) AS out_mask, bool_or(f) AS touches_self_rc, node = {rc("node")} AS is_palindrome
      FROM (
        SELECT src AS node, 0 AS i, 1 AS o, 0 AS im, cast(1 << (instr('ACGT', right(spelling, 1)) - 1) AS int) AS om, spelling = mate_spelling AS f FROM handles
        UNION ALL
        SELECT dst, 1, 0, cast(1 << (instr('ACGT', left(spelling, 1)) - 1) AS int), 0, spelling = mate_spelling FROM handles)
      GROUP BY node))"""


def unitigs(k: int) -> str:
    framed = "unhex(format('{:02x}{:02x}000000000000', length(seq) % 256, length(seq) // 256))"
    return f"""
  inner_nodes AS MATERIALIZED (SELECT node FROM nodes WHERE NOT is_boundary),
  next AS MATERIALIZED (SELECT a.spelling AS a, b.spelling AS b FROM handles a JOIN inner_nodes ON a.dst = node JOIN handles b ON b.src = node),
  walk AS (
    SELECT spelling AS head, spelling, 0 AS step FROM handles WHERE src NOT IN (SELECT node FROM inner_nodes)
    UNION ALL
    SELECT head, b, step + 1 FROM walk JOIN next ON walk.spelling = next.a),
  spelled AS (
    SELECT head, head || coalesce(string_agg(CASE WHEN step > 0 THEN right(walk.spelling, 1) END, '' ORDER BY step), '') AS seq, count(*) AS edge_steps, count(DISTINCT kmer) AS canonical_kmers,
           min(support) AS minimum_support, quantile_disc(support, 0.5) AS lower_median_support, max(support) AS maximum_support
    FROM walk JOIN handles ON walk.spelling = handles.spelling GROUP BY head),
  units AS MATERIALIZED (
    SELECT 'utg-' || sha256('helixframe/unitig/1'::BLOB || unhex('{k:02x}') || unhex('00') || {framed} || seq::BLOB) AS unitig_id, seq, 'linear' AS topology, edge_steps, canonical_kmers,
           minimum_support, lower_median_support, maximum_support, sha256(seq) AS sequence_sha256
    FROM spelled WHERE seq <= {rc("seq")})"""


def links(k: int) -> str:
    return f"""
  views AS (SELECT unitig_id, '+' AS o, seq AS s FROM units UNION ALL SELECT unitig_id, '-', {rc("seq")} FROM units),
  met AS (
    SELECT a.unitig_id AS a, a.o AS oa, b.unitig_id AS b, b.o AS ob
    FROM views a JOIN nodes n ON right(a.s, {k - 1}) = n.node AND n.is_boundary JOIN views b ON left(b.s, {k - 1}) = n.node),
  links AS MATERIALIZED (
    SELECT DISTINCT l.a AS from_segment, l.oa AS from_orientation, l.b AS to_segment, l.ob AS to_orientation FROM (
      SELECT least({{'a': a, 'oa': oa, 'b': b, 'ob': ob}}, {{'a': b, 'oa': CASE ob WHEN '+' THEN '-' ELSE '+' END, 'b': a, 'ob': CASE oa WHEN '+' THEN '-' ELSE '+' END}}) AS l FROM met))"""


PLACED = f"""
  usable AS (SELECT *, length(seq) > 0 AND NOT regexp_matches(seq, '[^ACGT]') AND NOT regexp_matches(qual, '[!-4]') AS eligible FROM reads),
  strands AS (SELECT fragment_id, lane, role, '+' AS strand, seq AS s FROM usable WHERE eligible UNION ALL SELECT fragment_id, lane, role, '-', {rc("seq")} FROM usable WHERE eligible),
  posted AS (SELECT unitig_id, seq AS u, cast(unnest(range(0, length(seq) - 15 + 1)) AS int) AS start FROM units WHERE length(seq) >= 15),
  placed AS MATERIALIZED (
    SELECT DISTINCT fragment_id, lane, role, unitig_id, start, cast(start + length(s) AS int) AS "end", strand
    FROM strands JOIN posted ON left(s, 15) = substr(u, start + 1, 15) AND substr(u, start + 1, length(s)) = s),
  audits AS MATERIALIZED (
    SELECT fragment_id, lane, role, coalesce(n, 0) AS n_groups,
           CASE WHEN NOT eligible THEN 'ineligible_ambiguity_or_quality' WHEN coalesce(n, 0) > 1000 THEN 'indeterminate_candidate_limit' WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'single_placement_group' ELSE 'multiple_placement_groups' END AS state
    FROM usable LEFT JOIN (SELECT fragment_id, lane, role, count(*) AS n FROM placed GROUP BY ALL) USING (fragment_id, lane, role))"""

PAIRS = """
  ends AS (
    SELECT fragment_id, lane, role, unitig_id, strand, start, length(seq) - "end" AS rest
    FROM audits JOIN placed USING (fragment_id, lane, role) JOIN units USING (unitig_id) WHERE state = 'single_placement_group'),
  points AS (
    SELECT fragment_id, lane, role, {'segment': unitig_id, 'end': CASE WHEN start < rest THEN 'L' WHEN start > rest THEN 'R' END, 'strand': strand, 'end_distance': least(start, rest), 'mate_role': role} AS p FROM ends),
  mated AS (
    SELECT x.fragment_id, x.lane, x.state AS s1, y.state AS s2, p1.p AS p1, p2.p AS p2
    FROM audits x JOIN audits y ON x.fragment_id = y.fragment_id AND x.role = 'R1' AND y.role = 'R2'
    LEFT JOIN points p1 ON p1.fragment_id = x.fragment_id AND p1.role = 'R1' LEFT JOIN points p2 ON p2.fragment_id = x.fragment_id AND p2.role = 'R2'),
  pairs AS MATERIALIZED (
    SELECT *, CASE
      WHEN 'ineligible_ambiguity_or_quality' IN (s1, s2) THEN 'mate_ineligible'
      WHEN 'indeterminate_candidate_limit' IN (s1, s2) THEN 'mate_indeterminate_candidate_limit'
      WHEN 'unmapped' IN (s1, s2) THEN 'mate_unmapped'
      WHEN 'multiple_placement_groups' IN (s1, s2) THEN 'mate_multiple_placement_groups'
      WHEN p1.segment = p2.segment THEN 'same_linear_unitig'
      WHEN p1."end" IS NULL OR p2."end" IS NULL THEN 'endpoint_tie' ELSE 'cross_unitig_observation' END AS state
    FROM mated)"""

#: Read states of a remap, and pair states of paired input, in order.
READ_GRID = "('ineligible_ambiguity_or_quality'), ('indeterminate_candidate_limit'), ('unmapped'), ('single_placement_group'), ('multiple_placement_groups')"
PAIR_GRID = "('mate_ineligible'), ('mate_indeterminate_candidate_limit'), ('mate_unmapped'), ('mate_multiple_placement_groups'), ('same_linear_unitig'), ('endpoint_tie'), ('cross_unitig_observation')"


def ledger(k: int) -> str:
    return f"{win(k + 1, 'qwin')}, ledger AS MATERIALIZED (SELECT kmer AS qmer, count(*) AS occurrences, count(DISTINCT fragment_id) AS fragments FROM qwin WHERE kmer IS NOT NULL GROUP BY kmer)"


def interior(k: int) -> str:
    return f"interior AS (SELECT unitig_id, step, {canon(f'substr(seq, step, {k + 1})')} AS qmer FROM (SELECT unitig_id, seq, cast(unnest(range(1, length(seq) - {k} + 1)) AS int) AS step FROM units WHERE length(seq) > {k}))"


def segments(k: int) -> str:
    return f"""
  firsts AS (SELECT unitig_id, 0 AS f FROM units UNION ALL SELECT unitig_id, step FROM interior WHERE qmer NOT IN (SELECT qmer FROM ledger)),
  segments AS MATERIALIZED (
    SELECT unitig_id, cast(row_number() OVER w - 1 AS int) AS segment_no, cast(f AS int) AS first_step, cast(coalesce(lead(f) OVER w, length(seq) - {k - 1}) - f AS int) AS edge_steps,
           substr(seq, f + 1, coalesce(lead(f) OVER w, length(seq) - {k - 1}) - f + {k - 1}) AS seq
    FROM firsts JOIN units USING (unitig_id) WINDOW w AS (PARTITION BY unitig_id ORDER BY f))"""


def embedded(k: int, higher: int) -> str:
    return f"""
  embedded AS (
    SELECT higher, higher_support, spot, literal, e.lower_kmer, c.support AS lower_support
    FROM (SELECT higher, higher_support, spot, substr(higher, spot + 1, {k}) AS literal, {canon(f"substr(higher, spot + 1, {k})")} AS lower_kmer
          FROM (SELECT kmer AS higher, support AS higher_support, cast(unnest(range(0, {higher - k + 1})) AS int) AS spot FROM high)) e
    LEFT JOIN low c ON e.lower_kmer = c.kmer),
  beside AS (
    SELECT lower_kmer, literal, higher, 'left' AS side, substr(higher, spot, 1) AS base FROM embedded WHERE lower_support IS NOT NULL AND spot > 0
    UNION ALL
    SELECT lower_kmer, literal, higher, 'right', substr(higher, spot + {k} + 1, 1) FROM embedded WHERE lower_support IS NOT NULL AND spot + {k} < {higher}),
  contexts AS MATERIALIZED (
    SELECT lower_kmer, higher,
           CASE WHEN lower_kmer = {rc("lower_kmer")} THEN 'fixed_point' WHEN literal <> lower_kmer THEN CASE side WHEN 'left' THEN 'right' ELSE 'left' END ELSE side END AS side,
           CASE WHEN (lower_kmer = {rc("lower_kmer")} AND side = 'left') OR (lower_kmer <> {rc("lower_kmer")} AND literal <> lower_kmer) THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base
    FROM beside)"""


def two_k(k: int, higher: int) -> str:
    """`low` and `high`: the retained k-mers of two k."""
    parts = [win(k, "lwin"), counts(k, "lwin", "lcounts"), kept("lcounts", "low"), win(higher, "hwin"), counts(higher, "hwin", "hcounts"), kept("hcounts", "high"), embedded(k, higher)]
    return ", ".join(parts)


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join([reads_cte(), *ctes]) + "\n" + select
