"""The tables of a result bundle with their fixed columns, from the operators' results.

Every function gives a DataFrame whose rows `bundle.tsv_lines` writes in presentation order. Nulls are written NA.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import kmers, mapping

VERSION = "1.0"
# Fixed output values.
UNITS = {"fragment": "supplied_fragment_instance", "occurrence": "accepted_window_occurrence"}
ENUMERATION = ("placement_enumeration_complete", "unavailable_closed_walk_audit_unsupported", "unavailable_remap_disabled", "indeterminate_candidate_limit")


def longest_first() -> list[Column]:
    """The presentation order of sequences: longest first, then by spelling and id."""
    return [F.col("length_bases").desc(), F.col("seq"), F.col("unitig_id")]


def unitig_evidence(units: DataFrame, k: int, minimum_support: int | None, unit: str = "fragment", placed: DataFrame | None = None) -> DataFrame:
    """unitig_evidence: 17 columns, and seq behind them for the order. `placed` is mapping.unitig_placements; None if nothing was mapped."""
    nothing = F.lit(None).cast("long")
    if placed is None:
        told = units.withColumns({"placements": nothing, "single_reads": nothing, "multi_reads": nothing})
        open_status = F.lit(ENUMERATION[2])
    else:
        told = units.join(placed, "unitig_id", "left")
        open_status = F.when(F.col("placements").isNull(), ENUMERATION[3]).otherwise(ENUMERATION[0])
    status = F.when(F.col("topology") != "linear", ENUMERATION[2] if placed is None else ENUMERATION[1]).otherwise(open_status)
    return told.select(
        F.lit(VERSION).alias("schema_version"),
        "unitig_id",
        F.length("seq").alias("length_bases"),
        F.lit(k).alias("k"),
        "topology",
        "edge_steps",
        "canonical_kmers",
        F.lit(UNITS[unit]).alias("support_unit"),
        F.lit(minimum_support if minimum_support is not None else 1).alias("retention_min_support"),
        F.col("minimum_support").alias("minimum_represented_key_support"),
        F.col("lower_median_support").alias("lower_median_represented_key_support"),
        F.col("maximum_support").alias("maximum_represented_key_support"),
        F.col("placements").alias("enumeration_complete_read_placements"),
        F.col("single_reads").alias("single_group_read_instances"),
        F.col("multi_reads").alias("multi_group_read_instances_with_group"),
        status.alias("placement_enumeration_status"),
        "sequence_sha256",
        "seq",
    )


def pair_links(links: DataFrame, k: int) -> DataFrame:
    """pair_links: 15 columns, of mapping.pair_links."""
    ends = [F.col(f"{c}_{s}") for s in "ab" for c in ("segment", "end", "strand", "end_distance", "mate_role")]
    return links.select(F.lit(VERSION).alias("schema_version"), F.lit(k).alias("k"), F.col("lane").alias("lane_ordinal"), *ends, "supplied_fragment_instances", F.lit("exact_unique_placement_pair_observation").alias("status"))


def pair_audit_summary(pairs: DataFrame, k: int) -> DataFrame:
    """pair_audit_summary: 4 columns, all states of paired input in their order, zeros too; `pairs` is mapping.audit_pairs."""
    totals = mapping.pair_states(pairs).filter("lane IS NULL")
    rank = F.array_position(F.array(*map(F.lit, mapping.PAIR_STATES)), F.col("state"))
    return totals.select(F.lit(VERSION).alias("schema_version"), F.lit(k).alias("k"), "state", F.col("fragments").alias("supplied_fragment_instances")).orderBy(rank)


def transform_summary(counts: DataFrame, minimum_support: int, unit: str = "fragment") -> DataFrame:
    """transform_summary: one row for the support filter, of 16 columns: keys and mass before, after and removed, and the states' digests."""
    before, after = kmers.state_digest(counts, "observed"), kmers.state_digest(kmers.retain(counts, minimum_support), "retained")
    removed = kmers.state_digest(counts.filter(F.col("support") < minimum_support), "removed")
    named = lambda df, p: df.select(F.col("keys").alias(f"{p}_keys"), F.col("mass").alias(f"{p}_mass"), F.col("digest").alias(f"{p}_digest"))
    one = named(before, "in").crossJoin(named(after, "out")).crossJoin(named(removed, "gone"))  # rows of one each
    return one.select(
        F.lit(VERSION).alias("schema_version"),
        F.lit(1).alias("stage_order"),
        F.lit("minimum_support_filter").alias("algorithm_id"),
        F.lit("1").alias("algorithm_version"),
        F.lit(UNITS[unit]).alias("support_unit"),
        F.to_json(F.struct(F.lit(minimum_support).alias("minimum_support"))).alias("parameters_json"),
        F.col("in_keys").alias("input_distinct_canonical_keys"),
        F.col("in_mass").alias("input_support_mass"),
        F.col("out_keys").alias("output_distinct_canonical_keys"),
        F.col("out_mass").alias("output_support_mass"),
        F.col("gone_keys").alias("removed_key_count"),
        F.col("gone_mass").alias("removed_support_mass"),
        F.col("gone_digest").alias("decision_set_sha256"),
        F.col("in_digest").alias("pre_state_sha256"),
        F.col("out_digest").alias("post_state_sha256"),
        F.lit("complete").alias("status"),
    )


def alignments(rows: DataFrame, truths: DataFrame) -> DataFrame:
    """alignments: 18 columns, of evaluation.contig_alignments."""
    shape = truths.select("molecule", "truth_class", *(["topology"] if "topology" in truths.columns else [F.lit("linear").alias("topology")]))
    told = rows.join(shape, ["molecule", "truth_class"], "left")
    consumed = F.col("matches") + F.col("mismatches") + F.col("deleted")
    return told.select(F.lit(VERSION).alias("schema_version"), "contig_id", "contig_length", "status", F.col("molecule").alias("molecule_id"), "truth_class", "topology", "strand", F.col("start").alias("oriented_reference_start"), consumed.alias("reference_bases_consumed"), "matches", "mismatches", F.col("inserted").alias("inserted_bases"), F.col("deleted").alias("deleted_bases"), F.col("edits").alias("edit_distance"), F.col("columns").alias("alignment_columns"), F.col("equally_best").alias("equally_best_molecule_strands"), "cigar")


def junctions(rows: DataFrame) -> DataFrame:
    """junctions: the classes and placement counts of evaluation.junctions (or of junction_evidence for other modes)."""
    return rows.select(F.lit(VERSION).alias("schema_version"), "contig_id", F.col("boundary").alias("boundary_zero_based"), "classification", F.col("compatible").alias("compatible_placement_count"), F.col("left_placements").alias("left_flank_placement_count"), F.col("right_placements").alias("right_flank_placement_count"), "primary_minor_chimera")


def of_all_k(tables: dict[int, DataFrame]) -> DataFrame:
    """One table of the tables of several k, with the k in front."""
    every = None
    for k, df in sorted(tables.items()):
        rows = df.select(F.lit(k).alias("k"), *[c for c in df.columns if c != "k"])
        every = rows if every is None else every.unionByName(rows)
    return every


def run_status(units: DataFrame) -> dict:
    """The status of a run: complete, or complete without a unitig under its parameters."""
    return {"status": "software_run_complete_no_unitigs_under_parameters" if units.isEmpty() else "software_run_complete"}
