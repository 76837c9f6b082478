"""Read-witnessed transitions, graphs constrained by them, and relations between graphs of several k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.durable import never_broadcast, settled, stored
from helixframe.functions import dna, packed
from helixframe.operators import graph, kmers, limits, lookup


def transition_ledger(reads: DataFrame, k: int, minimum_quality: int = 20, with_code: bool = False) -> DataFrame:
    """qmer, occurrences, fragments: the canonical (k+1)-mers of accepted windows, in both units.

    `reads` may be fragments (with both mates in a row, so that nothing but partial counts is shuffled) or single reads. With
    `with_code` and k + 1 up to 31 also `code`, by which `transition_decisions` goes on without reading spellings again.
    """
    if k + 1 <= packed.LONGEST:
        frags = reads if "reads" in reads.columns else kmers.fragments(reads)
        return kmers.spectrum(frags, k + 1, minimum_quality).select(dna.decode("code", k + 1).alias("qmer"), "occurrences", "fragments", *["code"] * with_code)
    single = kmers.reads_of(reads) if "reads" in reads.columns else reads
    seen = kmers.windows(single, k + 1, minimum_quality).filter("kmer IS NOT NULL").groupBy("fragment_id", "kmer").agg(F.count("*").alias("n"))
    return seen.groupBy(F.col("kmer").alias("qmer")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("fragments"))


def _interior(units: DataFrame, k: int, *key: str) -> DataFrame:
    """unitig_id, other key columns, step, qmer: the transitions inside linear walks, and around closed ones (the last is the closure)."""
    ring = F.when(F.col("topology") == "linear", F.col("seq")).otherwise(F.concat("seq", F.substr("seq", F.lit(k), F.lit(1))))
    rows = units.select("unitig_id", *key, ring.alias("s")).filter(F.length("s") > k)
    return rows.select("unitig_id", *key, F.explode(F.sequence(F.lit(1), F.length("s") - k)).alias("step"), "s").select("unitig_id", *key, "step", dna.canonical(F.substr("s", F.col("step"), F.lit(k + 1))).alias("qmer"))


def witnessed_segments(units: DataFrame, ledger: DataFrame, k: int) -> DataFrame:
    """unitig_id, segment_no, first_step, edge_steps, topology, seq: unitigs cut wherever no read shows the transition.

    A step is an edge; transition s lies between edges s and s+1. A closed walk stays closed only if all its
    transitions and its closure are shown; else its segments are linear. Nothing is joined again afterwards.
    """
    missing = _interior(units, k).join(ledger.select("qmer"), "qmer", "left_anti").groupBy("unitig_id").agg(F.array_sort(F.collect_list("step")).alias("missing"))
    every = units.join(missing, "unitig_id", "left").withColumn("edges", F.length("seq") - (k - 1)).withColumn("missing", F.coalesce("missing", F.array().cast("array<int>")))
    topology = F.when(F.size("missing") == 0, F.col("topology")).otherwise("linear")
    # the closure is no place to cut: it is the transition after the last edge
    firsts = F.concat(F.array(F.lit(0)), F.filter("missing", lambda s: s < F.col("edges")))
    split = every.select("unitig_id", "seq", "edges", topology.alias("topology"), firsts.alias("firsts"))
    parts = split.select("*", F.posexplode("firsts").alias("segment_no", "first_step"))
    last = F.coalesce(F.get("firsts", F.col("segment_no") + 1), F.col("edges"))
    return parts.select("unitig_id", "segment_no", "first_step", (last - F.col("first_step")).alias("edge_steps"), "topology", F.substr("seq", F.col("first_step") + 1, last - F.col("first_step") + (k - 1)).alias("seq"))


def transition_decisions(ledger: DataFrame, units: DataFrame, linked: DataFrame, retained: DataFrame, k: int) -> DataFrame:
    """qmer, in_unitig, in_link, occurrences, fragments, decision.

    Candidates are the transitions inside unitigs and over links; a ledger row is none of them if an
    endpoint was not retained. Decisions: admitted, excluded_no_witness, excluded_endpoint, unplaced.
    """
    over = _link_transitions(units, linked, k)
    if k + 1 <= packed.LONGEST:
        return _coded_decisions(ledger, units, over, retained, k)
    inside = _interior(units, k).select("qmer", F.lit(True).alias("i"), F.lit(False).alias("l"))
    over = over.select("qmer", F.lit(False).alias("i"), F.lit(True).alias("l"))
    candidates = inside.unionByName(over).groupBy("qmer").agg(F.max("i").alias("in_unitig"), F.max("l").alias("in_link"))
    ends = ledger.withColumn("p", dna.canonical(F.left("qmer", F.lit(k)))).withColumn("s", dna.canonical(F.right("qmer", F.lit(k))))
    kept = retained.select("kmer", F.lit(True).alias("kept"))
    known = ends.join(kept.select(F.col("kmer").alias("p"), F.col("kept").alias("pk")), "p", "left").join(kept.select(F.col("kmer").alias("s"), F.col("kept").alias("sk")), "s", "left")
    every = candidates.join(known.select("qmer", "occurrences", "fragments", F.coalesce(F.col("pk") & F.col("sk"), F.lit(False)).alias("ends")), "qmer", "full")
    decision = F.when(F.col("fragments").isNull(), "excluded_no_witness").when(~F.col("ends"), "excluded_endpoint").when(F.col("in_unitig").isNull(), "unplaced").otherwise("admitted")
    no = F.lit(False)
    return every.select("qmer", F.coalesce("in_unitig", no).alias("in_unitig"), F.coalesce("in_link", no).alias("in_link"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("fragments", F.lit(0)).alias("fragments"), decision.alias("decision"))


def _link_transitions(units: DataFrame, linked: DataFrame, k: int) -> DataFrame:
    """qmer: the transitions over links. Only the first and last k bases of unitigs are moved."""
    ends = units.select("unitig_id", F.left("seq", F.lit(k)).alias("l"), F.right("seq", F.lit(k)).alias("r"))
    a, b = ends.select(F.col("unitig_id").alias("from_segment"), F.col("l").alias("fl"), F.col("r").alias("fr")), ends.select(F.col("unitig_id").alias("to_segment"), F.col("l").alias("tl"), F.col("r").alias("tr"))
    last = F.when(F.col("from_orientation") == "+", F.col("fr")).otherwise(dna.revcomp("fl"))
    first = F.when(F.col("to_orientation") == "+", F.col("tl")).otherwise(dna.revcomp("tr"))
    return linked.join(a, "from_segment").join(b, "to_segment").select(dna.canonical(F.concat(last, F.right(first, F.lit(1)))).alias("qmer"))


def _interior_codes(units: DataFrame, k: int) -> DataFrame:
    """code: the canonical (k+1)-mers of `_interior`, k + 1 at most 31."""
    ring = F.when(F.col("topology") == "linear", F.col("seq")).otherwise(F.concat("seq", F.substr("seq", F.lit(k), F.lit(1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kmers.row_slices(batches, lambda b: kmers.bases(b.column("s"))):
            codes, bad, _ = packed.reads_of(batch.column("s"), pa.nulls(batch.num_rows, pa.string()), 0)
            at = np.flatnonzero(packed.clean(bad, k + 1))
            if len(at):
                forward, backward = packed.windows(codes, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(forward[at], backward[at]).view(np.int64))], names=["code"])

    return units.select(ring.alias("s")).mapInArrow(cut, "code long")


def _coded_decisions(ledger: DataFrame, units: DataFrame, over: DataFrame, retained: DataFrame, k: int) -> DataFrame:
    """`transition_decisions` by codes, in two steps: which ledger rows lack an endpoint, and all that is known of a transition, summed up."""
    q = k + 1
    known = ledger.select((F.col("code") if "code" in ledger.columns else dna.encode("qmer")).alias("code"), "occurrences", "fragments")
    kept = (retained.select("code") if "code" in retained.columns else retained.select(dna.encode("kmer").alias("code"))).withColumnRenamed("code", "end")
    least = lambda c: F.least(c, packed.revcomp_code(c, k))
    both = F.array_distinct(F.array(least(F.shiftright("code", 2)), least(F.col("code").bitwiseAND(F.lit(4**k - 1)))))
    lacking = stored(known.select("code", F.explode(both).alias("end")).join(never_broadcast(kept), "end", "left_anti").select("code").distinct())
    none = F.lit(0).cast("long")
    row = lambda rows, bit, *sums: rows.select("code", F.lit(bit).alias("bits"), *(sums or (none.alias("occurrences"), none.alias("fragments"))))
    every = row(_interior_codes(units, k), 1).unionByName(row(over.select(dna.encode("qmer").alias("code")), 2)).unionByName(row(known, 4, "occurrences", "fragments")).unionByName(row(lacking, 8))
    met = every.groupBy("code").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"), F.sum("fragments").alias("fragments"))
    has = lambda bits: F.col("bits").bitwiseAND(F.lit(bits)) != 0
    decision = F.when(~has(4), "excluded_no_witness").when(has(8), "excluded_endpoint").when(~has(3), "unplaced").otherwise("admitted")
    return met.select(dna.decode("code", q).alias("qmer"), has(1).alias("in_unitig"), has(2).alias("in_link"), "occurrences", "fragments", decision.alias("decision"))


def unsupported_adjacencies(segments: DataFrame, ledger: DataFrame, k: int) -> DataFrame:
    """Transitions inside segments, and around closed ones, without a ledger row: empty if all is well."""
    return _interior(segments, k).select("qmer").join(ledger, "qmer", "left_anti").distinct()


def segment_evidence(segments: DataFrame, ledger: DataFrame, k: int) -> DataFrame:
    """unitig_id, segment_no, topology, transitions, occurrences, fragments (sums over its inner transitions; a closure is a link and not among them)."""
    inner = _interior(segments.withColumn("topology", F.lit("linear")), k, "segment_no")
    sums = inner.join(ledger, "qmer").groupBy("unitig_id", "segment_no").agg(F.count("*").alias("transitions"), F.sum("occurrences").alias("occurrences"), F.sum("fragments").alias("fragments"))
    return segments.select("unitig_id", "segment_no", "topology").join(sums, ["unitig_id", "segment_no"], "left").na.fill(0, ["transitions", "occurrences", "fragments"])


def edge_placements(segments: DataFrame, k: int) -> DataFrame:
    """unitig_id, segment_no, step, kmer (canonical), orientation: every oriented edge of every segment; a k-mer has one at most."""
    steps = segments.filter(F.length("seq") >= k).select("unitig_id", "segment_no", "seq", F.explode(F.sequence(F.lit(0), F.col("edge_steps") - 1)).alias("step"))
    literal = F.substr("seq", F.col("step") + 1, F.lit(k))
    named = steps.select("unitig_id", "segment_no", "step", literal.alias("literal")).withColumn("kmer", dna.canonical("literal"))
    return named.select("unitig_id", "segment_no", "step", "kmer", F.when(F.col("literal") == F.col("kmer"), "+").otherwise("-").alias("orientation"))


def segment_support(segments: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """unitig_id, segment_no, edges, total, minimum, lower_median, maximum support of each segment's edges."""
    held = edge_placements(segments, k).join(counts, "kmer").groupBy("unitig_id", "segment_no")
    lower = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY support)").cast("long")
    return held.agg(F.count("*").alias("edges"), F.sum("support").alias("total"), F.min("support").alias("minimum"), lower.alias("lower_median"), F.max("support").alias("maximum"))


def segment_links(segments: DataFrame, ledger: DataFrame, k: int) -> DataFrame:
    """from_unitig, from_no, from_orientation, to_unitig, to_no, to_orientation: segments that meet in a transition with a ledger row.

    Ends and starts are joined by their node; what the cut removed is not in the ledger, so it does not come back. A
    closed segment is linked to itself.
    """
    linear = segments.filter("topology = 'linear'").select(F.struct("unitig_id", "segment_no").alias("id"), "seq")
    views = linear.select("id", F.inline(F.array(F.struct(F.lit("+").alias("o"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("o"), dna.revcomp("seq").alias("s")))))
    ends = views.select(F.right("s", F.lit(k - 1)).alias("node"), F.col("id").alias("a"), F.col("o").alias("oa"), F.right("s", F.lit(k)).alias("last"))
    starts = views.select(F.left("s", F.lit(k - 1)).alias("node"), F.col("id").alias("b"), F.col("o").alias("ob"), F.substr("s", F.lit(k), F.lit(1)).alias("next"))
    met = ends.join(starts, "node").withColumn("qmer", dna.canonical(F.concat("last", "next"))).join(ledger.select("qmer"), "qmer", "left_semi")
    closed = segments.filter("topology <> 'linear'").select(F.struct("unitig_id", "segment_no").alias("a")).select("a", F.lit("+").alias("oa"), F.col("a").alias("b"), F.lit("+").alias("ob"))
    every = met.select(dna.canonical_link("a", "oa", "b", "ob").alias("l")).distinct().unionByName(closed.select(F.struct("a", "oa", "b", "ob").alias("l")))
    return every.select(F.col("l.a.unitig_id").alias("from_unitig"), F.col("l.a.segment_no").alias("from_no"), F.col("l.oa").alias("from_orientation"), F.col("l.b.unitig_id").alias("to_unitig"), F.col("l.b.segment_no").alias("to_no"), F.col("l.ob").alias("to_orientation"))


def forced_paths(segments: DataFrame, linked: DataFrame, k: int, max_rounds: int = 40) -> DataFrame:
    """path_segments (unitig_id, segment_no and orientation in order), seq, topology: segments joined where nothing else is possible.

    A link is forced if it is the only one out of its first end and the only one into its second, between two different
    segments (`linked` is segment_links). Whatever has a choice stays apart. A path and its reverse complement are one,
    spelled as the smaller; a path that closes is spelled from its smallest rotation.
    """
    named = lambda u, n, o: F.concat_ws(":", u, F.col(n).cast("string"), o)
    closed = segments.filter("topology <> 'linear'")
    linear = segments.filter("topology = 'linear'").withColumn("id", F.concat_ws(":", "unitig_id", F.col("segment_no").cast("string")))
    views = stored(linear.select("id", F.inline(F.array(F.struct(F.lit("+").alias("o"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("o"), dna.revcomp("seq").alias("s"))))).select(F.concat_ws(":", "id", "o").alias("id"), "s"))
    forward = linked.select(named("from_unitig", "from_no", "from_orientation").alias("a"), named("to_unitig", "to_no", "to_orientation").alias("b"))
    backward = linked.select(named("to_unitig", "to_no", dna.flip("to_orientation")).alias("a"), named("from_unitig", "from_no", dna.flip("from_orientation")).alias("b"))
    arcs = stored(forward.unionByName(backward).distinct())
    single = lambda c: arcs.groupBy(c).agg(F.count("*").alias("n")).filter("n = 1").select(c)
    body = lambda c: F.regexp_extract(c, "^(.*):.$", 1)
    forced = arcs.join(single("a"), "a").join(single("b"), "b").filter(body("a") != body("b")).select(F.col("a").alias("prev"), F.col("b").alias("next"))
    first = F.col("prev").isNull()
    start = views.join(forced, F.col("id") == F.col("next"), "left").select("id", F.lit(0).alias("support"), F.coalesce("prev", "id").alias("ptr"), F.when(first, 0).otherwise(1).cast("long").alias("dist"), first.alias("done"))
    walked = graph.ranked(stored(start, shuffled=False), max_rounds)
    steps = walked.join(views, "id").groupBy("head", "topology").agg(F.array_sort(F.collect_list(F.struct("step", "id", "s"))).alias("steps"))
    rest = F.concat_ws("", F.transform("steps", lambda x: F.substr(x["s"], F.lit(k))))
    raw = F.concat(F.left(F.col("steps")[0]["s"], F.lit(k - 1)), rest)
    ring = F.when(F.col("topology") != "linear", rest)
    turned = F.least(dna.minimum_rotation(ring), dna.minimum_rotation(dna.revcomp(ring)))
    round_seq = F.left(F.repeat(turned, F.lit(k)), F.length(ring) + k - 1)
    spelled = steps.select(F.col("steps.id").alias("path_segments"), "topology", F.when(F.col("topology") == "linear", raw).otherwise(round_seq).alias("seq"), raw.alias("raw"))
    one = spelled.filter((F.col("topology") != "linear") | (F.col("raw") <= dna.revcomp("raw"))).groupBy("seq", "topology", F.array_sort(F.transform("path_segments", lambda x: F.regexp_extract(x, "^(.*):.$", 1))).alias("members")).agg(F.min("path_segments").alias("path_segments"))
    alone = closed.select(F.array(named("unitig_id", "segment_no", F.lit("+"))).alias("path_segments"), "seq", "topology")
    return one.select("path_segments", "seq", "topology").unionByName(alone)


def qmer_windows(reads: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """fragment_id, role, pos, qmer, orientation of the accepted windows of k+1 bases."""
    if k + 1 <= packed.LONGEST:
        given = reads.select("fragment_id", "role", "seq", "qual")
        kinds = dict(given.dtypes)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in kmers.row_slices(batches, lambda b: kmers.bases(b.column("seq"))):
                codes, bad, firsts = packed.reads_of(batch.column("seq"), batch.column("qual"), minimum_quality)
                at = np.flatnonzero(packed.clean(bad, k + 1))
                if not len(at):
                    continue
                forward, backward = (x[at] for x in packed.windows(codes, k + 1))
                row = np.searchsorted(firsts, at, "right") - 1
                of = lambda name: batch.column(name).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([of("fragment_id"), of("role"), pa.array((at - firsts[row]).astype(np.int32)), pa.array(np.minimum(forward, backward).astype(np.int64)), pa.array(forward <= backward)], names=["fragment_id", "role", "pos", "code", "plain"])

        found = given.mapInArrow(find, f"fragment_id {kinds['fragment_id']}, role {kinds['role']}, pos int, code long, plain boolean")
        return found.select("fragment_id", "role", "pos", dna.decode("code", k + 1).alias("qmer"), F.when(F.col("plain"), "+").otherwise("-").alias("orientation"))
    seen = kmers.windows(reads, k + 1, minimum_quality).filter("kmer IS NOT NULL")
    return seen.select("fragment_id", "role", "pos", F.col("kmer").alias("qmer"), F.when(F.col("window") == F.col("kmer"), "+").otherwise("-").alias("orientation"))


def _embedded(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """higher, at, literal, lower_kmer (canonical), lower_support: every lower k-mer inside every higher one."""
    rows = higher.select(F.col("kmer").alias("higher"), F.col("support").alias("higher_support"), F.explode(F.sequence(F.lit(0), F.lit(higher_k - k))).alias("at"))
    cut = rows.withColumn("literal", F.substr("higher", F.col("at") + 1, F.lit(k)))
    return cut.withColumn("lower_kmer", dna.canonical("literal")).join(lower.select(F.col("kmer").alias("lower_kmer"), F.col("support").alias("lower_support")), "lower_kmer", "left")


#: Lower windows of a higher k-mer that have one bucket: its code and support, the first window's place, and how many they are.
_HELD = np.dtype([("code", "<u8"), ("support", "<i8"), ("first", "u1"), ("windows", "u1")])


def _held_runs(higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """The lower windows of higher k-mers in the buckets of their minimizers, as runs."""
    m, many = min(kmers.MINIMIZER, k), higher_k - k + 1

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kmers.gathered(batches):
            code = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [(code >> np.uint64(2 * (higher_k - m - i))) & np.uint64(4**m - 1) for i in range(higher_k - m + 1)]
            mixed = np.stack([kmers._mixed(np.minimum(x, packed.revcomp_codes(x, m))) for x in parts])
            bucket = kmers._bucket(packed.sliding_minimum(mixed, k - m + 1)).T.ravel()  # of each window of each higher k-mer
            new = np.ones((len(code), many), bool)
            new[:, 1:] = np.diff(bucket.reshape(-1, many), axis=1) != 0
            at = np.flatnonzero(new)
            rows = np.zeros(len(at), _HELD)
            rows["code"], rows["first"], rows["windows"] = code[at // many], at % many, np.diff(np.append(at, new.size))
            rows["support"] = batch.column("support").to_numpy(zero_copy_only=False)[at // many]
            yield lookup._blobs(rows, bucket[at], k, 1)

    return _with_codes(higher).select("code", F.col("support").cast("long").alias("support")).mapInArrow(ship, lookup._SHIPPED)


def _windows_of(rows: np.ndarray, k: int, higher_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of runs its row, its place, its canonical code, and whether it is spelled so."""
    many = rows["windows"].astype(np.int64)
    row = np.repeat(np.arange(len(rows)), many)
    at = rows["first"][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    literal = (rows["code"][row] >> (2 * (higher_k - k - at)).astype(np.uint64)) & np.uint64(4**k - 1)
    back = packed.revcomp_codes(literal, k)
    return row, at, np.minimum(literal, back), literal <= back


def _bucket_by_bucket(lower: DataFrame, higher: DataFrame, k: int, higher_k: int, part, end, kind: str) -> DataFrame:
    """Lower k-mers and the runs of higher ones meet in the buckets of their minimizers.

    `part(known, rows, before)` gets a bucket's lower k-mers (rising), runs of it, all of a higher k-mer's at once, and what it returned
    last; it returns a batch or None, and what it is given next. `end(known, before)` returns the last batch of a bucket or None.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, posted, runs, held, before = None, [], [], 0, None

        def known() -> np.ndarray:
            rows = np.concatenate([np.zeros(0, lookup._KNOWN), *posted])
            return rows[np.argsort(rows["code"], kind="stable")]

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal runs, held, before
            if runs:
                out, before = part(known(), np.concatenate(runs), before)
                if out is not None:
                    yield out
            if last and (out := end(known(), before)) is not None:
                yield out
            runs, held, before = [], 0, None if last else before

        for batch in batches:
            data, firsts = packed.text_bytes(batch.column("data"))
            for i, (bucket, of) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind")], strict=True)):
                if bucket != now or held >= kmers.COUNTED:
                    yield from flush(bucket != now)
                    posted, now = posted if bucket == now else [], bucket
                blob = data[firsts[i] : firsts[i + 1]].tobytes()
                if of:
                    runs.append(np.frombuffer(blob, _HELD))
                    held += int(runs[-1]["windows"].sum(dtype=np.int64))
                else:
                    posted.append(np.frombuffer(blob, lookup._KNOWN))
        yield from flush(True)

    every = _held_runs(higher, k, higher_k).unionByName(lookup._posted(_with_codes(lower), k))
    return every.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(meet, kind)


def _places(known: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where codes stand among known ones, and whether they do."""
    if not len(known):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    at = np.minimum(np.searchsorted(known["code"], code), len(known) - 1)
    return at, known["code"][at] == code


def multik_contains(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """higher, lower_offset, lower_kmer, orientation, present: what each higher k-mer contains of the lower set.

    Up to 31 bases a higher k-mer is shipped once for each bucket that its lower windows have, not once for each of them.
    """
    if higher_k > packed.LONGEST:
        orientation = F.when(F.col("literal") == F.col("lower_kmer"), "+").otherwise("-")
        return _embedded(lower, higher, k, higher_k).select("higher", F.col("at").alias("lower_offset"), "lower_kmer", orientation.alias("orientation"), F.col("lower_support").isNotNull().alias("present"))

    def part(known: np.ndarray, rows: np.ndarray, before: None) -> tuple[pa.RecordBatch, None]:
        row, at, code, plain = _windows_of(rows, k, higher_k)
        columns = [rows["code"][row].view(np.int64), at.astype(np.int32), code.view(np.int64), plain, _places(known, code)[1]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["higher", "at", "lower", "plain", "present"]), None

    found = _bucket_by_bucket(lower, higher, k, higher_k, part, lambda known, before: None, "higher long, at int, lower long, plain boolean, present boolean")
    return found.select(dna.decode("higher", higher_k).alias("higher"), F.col("at").alias("lower_offset"), dna.decode("lower", k).alias("lower_kmer"), F.when(F.col("plain"), "+").otherwise("-").alias("orientation"), "present")


def multik_supports(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """lower_kmer, lower_support, higher_keys, higher_support: lower k-mers and the higher ones that hold them.

    What a higher k-mer holds twice is one. Up to 31 bases sums are made in the buckets of the lower k-mers' minimizers; of longer ones partial
    sums are shuffled.
    """
    if higher_k > packed.LONGEST:
        cut = lambda i: dna.canonical(F.substr("kmer", i, F.lit(k)))
        held = F.array_distinct(F.array(*[cut(F.lit(i + 1)) for i in range(higher_k - k + 1)]))
        sums = higher.select(F.explode(held).alias("lower_kmer"), "support").groupBy("lower_kmer").agg(F.count("*").alias("higher_keys"), F.sum("support").alias("higher_support"))
        return lower.select(F.col("kmer").alias("lower_kmer"), F.col("support").alias("lower_support")).join(sums, "lower_kmer")

    def part(known: np.ndarray, rows: np.ndarray, before: np.ndarray | None) -> tuple[None, np.ndarray]:
        row, _, code, _ = _windows_of(rows, k, higher_k)
        at, there = _places(known, code)
        at, whose = at[there], row[there]
        order = np.lexsort((rows["code"][whose], at))
        at, whose = at[order], whose[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (rows["code"][whose[1:]] != rows["code"][whose[:-1]])
        sums = np.zeros((2, len(known)), np.int64) if before is None else before
        np.add.at(sums[0], at[new], 1)
        np.add.at(sums[1], at[new], rows["support"][whose[new]])
        return None, sums

    def end(known: np.ndarray, sums: np.ndarray | None) -> pa.RecordBatch | None:
        if sums is None:
            return None
        held = sums[0] > 0
        return pa.RecordBatch.from_arrays([pa.array(known["code"][held].view(np.int64)), pa.array(known["support"][held]), pa.array(sums[0][held]), pa.array(sums[1][held])], names=["lower", "lower_support", "higher_keys", "higher_support"])

    found = _bucket_by_bucket(lower, higher, k, higher_k, part, end, "lower long, lower_support long, higher_keys long, higher_support long")
    return found.select(dna.decode("lower", k).alias("lower_kmer"), "lower_support", "higher_keys", "higher_support")


def multik_contexts(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """lower_kmer, side, base, higher: the base beside a lower k-mer in a higher one, seen from the canonical spelling.

    For a k-mer that is its own reverse complement both sides fold into one, `fixed_point`.
    """
    rows = _embedded(lower, higher, k, higher_k).filter("lower_support IS NOT NULL")
    flank = lambda side, at: F.struct(F.lit(side).alias("side"), F.substr("higher", at, F.lit(1)).alias("base"))
    beside = F.filter(F.array(F.when(F.col("at") > 0, flank("left", F.col("at"))), F.when(F.col("at") + k < higher_k, flank("right", F.col("at") + k + 1))), lambda x: x.isNotNull())
    seen = rows.select("lower_kmer", "literal", "higher", F.inline(beside))
    turned = F.col("literal") != F.col("lower_kmer")
    fixed = F.col("lower_kmer") == dna.revcomp("lower_kmer")
    complement = F.translate("base", "ACGT", "TGCA")
    side = F.when(fixed, "fixed_point").when(turned, F.when(F.col("side") == "left", "right").otherwise("left")).otherwise(F.col("side"))
    base = F.when(fixed, F.when(F.col("side") == "left", complement).otherwise(F.col("base"))).when(turned, complement).otherwise(F.col("base"))
    return seen.select("lower_kmer", side.alias("side"), base.alias("base"), "higher")


SIDES = ["left", "right", "fixed_point"]


def _context_bits(higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """lower, higher (codes), bits: the contexts that a lower k-mer has in a higher one; bit 4 * side + base, sides as in SIDES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three, mask = np.uint64(3), np.uint64(4**k - 1)
        for batch in batches:
            code = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(higher_k - k + 1):
                behind = higher_k - k - at
                literal = (code >> np.uint64(2 * behind)) & mask
                back = packed.revcomp_codes(literal, k)
                fixed, plain = literal == back, literal < back
                bits = np.zeros(len(code), np.int32)
                if at:
                    base = ((code >> np.uint64(2 * (behind + k))) & three).astype(np.int32)
                    bits |= 1 << np.where(fixed, 11 - base, np.where(plain, base, 7 - base))
                if behind:
                    base = ((code >> np.uint64(2 * (behind - 1))) & three).astype(np.int32)
                    bits |= 1 << np.where(fixed, 8 + base, np.where(plain, 4 + base, 3 - base))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(literal, back).view(np.int64)), batch.column("code"), pa.array(bits)], names=["lower", "higher", "bits"])

    return higher.select("code").mapInArrow(cut, "lower long, higher long, bits int")


def _side_bits(mask: str, side) -> Column:
    return F.call_function("shiftright", F.col(mask), 4 * side).bitwiseAND(F.lit(15))


def _with_codes(rows: DataFrame) -> DataFrame:
    return rows if "code" in rows.columns else rows.withColumn("code", dna.encode("kmer"))


def multik_conflicts(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """All context rows of a (lower k-mer, side) beside which two bases or more occur.

    Of k-mers up to 31 bases masks of bases are summed up first, and only contexts of lower k-mers with a mixed side become rows.
    """
    if higher_k > packed.LONGEST:
        rows = multik_contexts(lower, higher, k, higher_k).distinct()
        mixed = rows.groupBy("lower_kmer", "side").agg(F.min("base").alias("x"), F.max("base").alias("y")).filter("x <> y").select("lower_kmer", "side")
        return rows.join(mixed, ["lower_kmer", "side"], "left_semi")
    bits = _context_bits(_with_codes(higher), k, higher_k)
    several = lambda side: F.bit_count(_side_bits("mask", side)) > 1
    mixed = bits.groupBy("lower").agg(F.bit_or("bits").alias("mask")).filter(several(F.lit(0)) | several(F.lit(1)) | several(F.lit(2)))
    kept = mixed.join(never_broadcast(_with_codes(lower).select(F.col("code").alias("lower"))), "lower", "left_semi")
    places = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda p: (F.call_function("shiftright", F.col("bits"), p).bitwiseAND(F.lit(1)) == 1) & several(F.floor(p / 4).cast("int")))
    rows = bits.join(never_broadcast(kept), "lower").select("lower", "higher", F.explode(places).alias("place")).distinct()
    side = F.get(F.array(*map(F.lit, SIDES)), F.floor(F.col("place") / 4).cast("int"))
    return rows.select(dna.decode("lower", k).alias("lower_kmer"), side.alias("side"), F.substr(F.lit(dna.EXACT), F.col("place") % 4 + 1, F.lit(1)).alias("base"), dna.decode("higher", higher_k).alias("higher"))


def multik_unresolved(lower: DataFrame, higher: DataFrame, k: int, higher_k: int) -> DataFrame:
    """lower_kmer, side: the sides of lower k-mers that no higher k-mer covers."""
    if higher_k > packed.LONGEST:
        sides = lower.select(F.col("kmer").alias("lower_kmer"), F.explode(F.when(F.col("kmer") == dna.revcomp("kmer"), F.array(F.lit("fixed_point"))).otherwise(F.array(F.lit("left"), F.lit("right")))).alias("side"))
        return sides.join(multik_contexts(lower, higher, k, higher_k).select("lower_kmer", "side").distinct(), ["lower_kmer", "side"], "left_anti")
    masks = _context_bits(_with_codes(higher), k, higher_k).groupBy(F.col("lower").alias("code")).agg(F.bit_or("bits").alias("seen"))
    told = _with_codes(lower).select("code").join(never_broadcast(masks), "code", "left").select("code", F.coalesce("seen", F.lit(0)).alias("mask"))
    fixed = F.col("code") == packed.revcomp_code("code", k)
    open_ = lambda side: F.when(_side_bits("mask", F.lit(side)) == 0, SIDES[side])
    sides = F.filter(F.when(fixed, F.array(open_(2))).otherwise(F.array(open_(0), open_(1))), lambda x: x.isNotNull())
    return told.select("code", F.explode(sides).alias("side")).select(dna.decode("code", k).alias("lower_kmer"), "side")


def accepted_stretches(reads: DataFrame, minimum_quality: int = 20) -> DataFrame:
    """fragment_id, lane, role, stretch: the longest runs of exact bases of sufficient quality of every read."""
    seq = F.upper("seq")
    bad = F.zip_with(F.split(kmers.ambiguity_mask(seq), ""), F.split(kmers.quality_mask(seq, F.col("qual"), minimum_quality), ""), lambda n, q: F.greatest(n, q))
    sound = F.array_join(F.zip_with(F.split(seq, ""), bad, lambda s, b: F.when(b == "1", ".").otherwise(s)), "")
    return reads.filter(F.length("seq") > 0).select("fragment_id", "lane", "role", F.explode(F.split(sound, "[^ACGT]+")).alias("stretch")).filter("stretch <> ''")


def covering_flanks(stretch: Column, start: Column, k: int, higher_k: int) -> tuple[Column, Column]:
    """Whether a higher window of the same stretch holds the lower window at `start` and the base left, and right, of it."""
    room = F.length(stretch) >= higher_k
    return room & (start > 0), room & (start + k < F.length(stretch))


def _bare_sides(codes: np.ndarray, bad: np.ndarray, k: int, higher_k: int) -> tuple[np.ndarray, np.ndarray]:
    """4 * code + side (as in SIDES) of the lower k-mers of reads whose side no higher window covers, rising, and how often each stands there.

    A bad place is behind every read. Stretches between bad places that hold a higher window have only a first left side and a last right one.
    """
    ends = np.flatnonzero(bad)
    starts = np.concatenate([[0], ends + 1])[:-1]
    held = ends - starts >= k
    starts, lasts = starts[held], ends[held] - k
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = lasts - starts < higher_k - k
    many = (lasts - starts + 1)[short]
    every = np.arange(many.sum()) + np.repeat(starts[short] - (np.cumsum(many) - many), many)
    forward, backward = packed.windows(codes, k)

    def named(at: np.ndarray, side: int) -> np.ndarray:
        plain, turned = forward[at], backward[at]
        told = np.where(plain == turned, 2, np.where(plain < turned, side, 1 - side))
        return (np.minimum(plain, turned) << np.uint64(2)) | told.astype(np.uint64)

    key, n = np.unique(np.concatenate([named(starts[~short], 0), named(lasts[~short], 1), named(every, 0), named(every, 1)]), return_counts=True)
    return key.view(np.int64), n


def unresolved_sides(reads: DataFrame, k: int, higher_k: int, minimum_quality: int = 20) -> DataFrame:
    """lower_kmer, side, lower_window_occurrences: how often a side of a lower k-mer stands in a read with no higher window about it.

    Sides are seen from the canonical spelling; those of a k-mer that is its own reverse complement fold into one,
    `fixed_point`, so it may count twice an occurrence. `reads` may be fragments or single reads. k-mers of up to 31 bases are found as
    codes, many reads at once, and only counts of codes are shuffled; longer ones go as strings.
    """
    if k > packed.LONGEST:
        return _unresolved_texts(kmers.reads_of(reads) if "reads" in reads.columns else reads, k, higher_k, minimum_quality)
    frags = reads if "reads" in reads.columns else reads.select(F.array(F.struct("seq", "qual")).alias("reads"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kmers.row_slices(batches, kmers.fragment_bases):
            rows = batch.column("reads").flatten()
            codes, bad, _ = packed.reads_of(rows.field("seq"), rows.field("qual"), minimum_quality)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _bare_sides(codes, bad, k, higher_k)], names=["key", "n"])

    counts = frags.select("reads").mapInArrow(find, "key long, n long").groupBy("key").agg(F.sum("n").alias("lower_window_occurrences"))
    side = F.get(F.array(*map(F.lit, SIDES)), F.col("key").bitwiseAND(F.lit(3)).cast("int"))
    return counts.select(dna.decode(F.shiftrightunsigned("key", 2), k).alias("lower_kmer"), side.alias("side"), "lower_window_occurrences")


def _unresolved_texts(reads: DataFrame, k: int, higher_k: int, minimum_quality: int) -> DataFrame:
    """`unresolved_sides` of k-mers that are too long for a code.

    Inside a stretch that holds a higher window only its first and last lower window have such a side, so no other window is made.
    """
    stretches = accepted_stretches(reads, minimum_quality).select("stretch").filter(F.length("stretch") >= k)
    last = F.length("stretch") - k
    ends = F.when(last > 0, F.array(F.lit(0), last)).otherwise(F.array(F.lit(0)))
    rows = stretches.select("stretch", F.explode(F.when(F.length("stretch") >= higher_k, ends).otherwise(F.sequence(F.lit(0), last))).alias("start"))
    left, right = covering_flanks(F.col("stretch"), F.col("start"), k, higher_k)
    seen = rows.select(F.substr("stretch", F.col("start") + 1, F.lit(k)).alias("literal"), F.explode(F.filter(F.array(F.when(~left, "left"), F.when(~right, "right")), lambda x: x.isNotNull())).alias("side"))
    named = seen.withColumn("lower_kmer", dna.canonical("literal"))
    turned = F.when(F.col("side") == "left", "right").otherwise("left")
    side = F.when(F.col("literal") == dna.revcomp("literal"), "fixed_point").when(F.col("literal") == F.col("lower_kmer"), F.col("side")).otherwise(turned)
    return named.groupBy("lower_kmer", side.alias("side")).agg(F.count("*").alias("lower_window_occurrences"))


def exact_agreement(units_by_k: dict[int, DataFrame]) -> DataFrame:
    """topology, seq, members, agreement: sequences of the unitigs of several k, and whether more than one k gives them."""
    every = None
    for k, units in sorted(units_by_k.items()):
        rows = units.select(F.lit(k).alias("k"), "topology", "seq")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("topology", "seq").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("members"), (F.count_distinct("k") > 1).alias("agreement"))


def portfolio_counts(frags: DataFrame, ks: list[int], minimum_quality: int = 20) -> DataFrame:
    """k, kmer, fragments, occurrences of several k (rising, each at most 31), all from one scan of the fragments."""
    found = kmers.spectra(frags, limits.multi_k(ks), minimum_quality)
    spelling = F.coalesce(*[F.when(F.col("k") == k, dna.decode("code", k)) for k in ks])
    return found.select("k", spelling.alias("kmer"), "fragments", "occurrences")


def portfolio(frags: DataFrame, ks: list[int], minimum_support: int = 2, minimum_quality: int = 20) -> dict[int, dict[str, DataFrame]]:
    """For each k (rising, two or more): counts, retained, unitigs, links, ledger and segments.

    The spectra of every k and of its transitions (k + 1) come from one scan and are written once to the checkpoint folder, if all are of 31
    bases at most; longer ones are counted for each k. What several steps of one k read is cut from its lineage.
    """
    limits.multi_k(ks)
    out = {}
    coded = max(ks) < packed.LONGEST
    held = stored(kmers.spectra(frags, [*ks, *(k + 1 for k in ks)], minimum_quality)) if coded else None
    for k in ks:
        if coded:
            of = lambda n: held.filter(F.col("k") == n)
            counts = of(k).select(dna.decode("code", k).alias("kmer"), F.col("fragments").alias("support"), "code")
            ledger = of(k + 1).select(dna.decode("code", k + 1).alias("qmer"), "occurrences", "fragments")
        else:
            counts = stored(kmers.count_kmers(frags, k, minimum_quality, with_code=True))
            ledger = stored(transition_ledger(frags, k, minimum_quality))
        kept = kmers.retain(counts, minimum_support)
        units = settled(frags.sparkSession, lambda kept=kept, k=k: graph.unitigs(kept, k))
        out[k] = {"counts": counts.select("kmer", "support"), "retained": kept.select("kmer", "support"), "unitigs": units, "links": graph.links(units, k), "ledger": ledger, "segments": witnessed_segments(units, ledger, k)}
    return out


def conservation(counts: DataFrame, kept: DataFrame, units: DataFrame, segments: DataFrame, ledger: DataFrame, decided: DataFrame, k: int, minimum_support: int = 2) -> DataFrame:
    """rule, left, right: totals that must balance, each side summed on its own."""
    total = lambda df, e="count(*)": df.agg(F.coalesce(F.expr(e).cast("long"), F.lit(0).cast("long")).alias("n"))
    edges = graph.handles(kept, k)
    summary = kmers.count_summary(counts, minimum_support)
    inner = _interior(units, k)
    shown = inner.join(ledger.select("qmer"), "qmer", "left_semi")
    rules = [
        ("observed keys are retained or removed", total(summary, "max(observed_keys)"), total(summary, "max(retained_keys + removed_keys)")),
        ("observed mass is retained or removed", total(summary, "max(observed_mass)"), total(summary, "max(retained_mass + removed_mass)")),
        ("retained keys were observed", total(kept), total(kept.join(counts, "kmer", "left_semi"))),
        ("retained mass is the summary's", total(kept, "sum(support)"), total(summary, "max(retained_mass)")),
        ("handles are twice the keys less palindromes", total(edges), total(kept, "2 * count(*) - count_if(kmer = reverse(translate(kmer, 'ACGT', 'TGCA')))")),
        ("unitigs hold every retained key once", total(units, "sum(canonical_kmers)"), total(kept)),
        ("unitigs are as long as their edges", total(units, "sum(length(seq))"), total(units, f"sum(edge_steps) + count(*) * {k - 1}")),
        ("segments hold every edge once", total(segments, "sum(edge_steps)"), total(units, "sum(edge_steps)")),
        ("segments are as long as their edges", total(segments, "sum(length(seq))"), total(segments, f"sum(edge_steps) + count(*) * {k - 1}")),
        ("transitions lie between edges", total(inner), total(units, "sum(CASE topology WHEN 'linear' THEN edge_steps - 1 ELSE edge_steps END)")),
        ("cuts are the transitions without a witness", total(segments.filter("segment_no > 0")), total(inner.filter("qmer IS NOT NULL").join(units.filter("topology = 'linear'").select("unitig_id"), "unitig_id", "left_semi").join(ledger.select("qmer"), "qmer", "left_anti"))),
        ("transitions are shown or cut", total(inner), total(shown.select("qmer").unionByName(inner.select("qmer").join(ledger.select("qmer"), "qmer", "left_anti")))),
        ("every ledger row is decided on", total(ledger), total(decided.filter("decision <> 'excluded_no_witness'"))),
        ("decisions hold all occurrences", total(ledger, "sum(occurrences)"), total(decided, "sum(occurrences)")),
        ("decisions hold all fragments", total(ledger, "sum(fragments)"), total(decided, "sum(fragments)")),
        ("no fragment counts more often than it occurs", total(ledger, "count_if(fragments > occurrences)"), total(ledger.limit(0))),
    ]
    every = None
    for rule, left, right in rules:
        # One row by one row, each counted on its own, so that the shuffle files of one rule are gone before the next.
        row = stored(left.select(F.col("n").alias("left"))).crossJoin(stored(right.select(F.col("n").alias("right")))).select(F.lit(rule).alias("rule"), "left", "right")
        every = row if every is None else every.unionByName(row)
    return every


def state_masks(counts: DataFrame, k: int) -> DataFrame:
    """node, in_mask, out_mask, touches_self_rc, is_boundary."""
    return graph.nodes_of(counts, k).select("node", "in_mask", "out_mask", "touches_self_rc", "is_boundary")

