"""FASTX reading and result bundles."""

import gzip

import pytest

from pyspark.sql import functions as F

from helixframe.operators import graph, kmers, limits
from helixframe.sources import artifacts, bundle, dataset, fastx


def put(path, text, zipped=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) if zipped else data)
    return str(path)


def test_pairs_are_zipped_over_lanes(spark, tmp_path):
    a = put(tmp_path / "a.fq", "@x/1\nACGT\n+\nIIII\n@y/1 1:N\nAC\nGT\n+y/1\nII\nII\n")
    b = put(tmp_path / "b.fq", "@x/2\nTTTT\n+\nIIII\n@y/2\nGGGG\n+\n!!!!\n", zipped=True)
    c, d = put(tmp_path / "c.fa", ">z/1\nACG\nT\n"), put(tmp_path / "d.fa", ">z/2\nnnRY\n")
    rows = fastx.read_fastx(spark, r1=[a, c], r2=[b, d]).orderBy("fragment_id", "role").collect()
    assert [(r.fragment_id, r.lane, r.role, r.read_id, r.seq, r.qual) for r in rows] == [
        (0, 0, "R1", "x", "ACGT", "IIII"), (0, 0, "R2", "x", "TTTT", "IIII"), (1, 0, "R1", "y", "ACGT", "IIII"), (1, 0, "R2", "y", "GGGG", "!!!!"), (2, 1, "R1", "z", "ACGT", None), (2, 1, "R2", "z", "NNRY", None),
    ]


@pytest.mark.parametrize("text", ["@broken\nACGT\n+\nI\n", ">x\nACGJ\n", "", "text", ">x\n\n", "@x\nAC\n+y\nII\n"])
def test_malformed_files_raise(spark, tmp_path, text):
    with pytest.raises(fastx.InputError):
        fastx.read_fastx(spark, single=[put(tmp_path / "x", text)])


def test_mates_that_do_not_fit_raise(spark, tmp_path):
    a, b = put(tmp_path / "a", ">x/1\nAC\n>y/1\nAC\n"), put(tmp_path / "b", ">y/2\nAC\n>x/2\nAC\n")
    with pytest.raises(fastx.InputError, match="pair identity"):
        fastx.read_fastx(spark, r1=[a], r2=[b])
    with pytest.raises(fastx.InputError, match="twice"):
        fastx.read_fastx(spark, r1=[a], r2=[a])
    (tmp_path / "t").write_bytes(gzip.compress(b">x\nAC\n")[:-3])
    with pytest.raises(fastx.InputError, match="gzip"):
        fastx.read_fastx(spark, single=[str(tmp_path / "t")])


def test_a_bundle_is_whole_never_replaced_and_changes_show(spark, tmp_path):
    held = spark.createDataFrame([("CAA", 2), ("AAC", 3), ("AAG", 5)], "kmer string, support long")
    held = held.selectExpr("least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer", "support")
    units = graph.unitigs(held, 3)
    linked = graph.links(units, 3)
    tables = {"unitigs.fasta": bundle.fasta_lines(units), "assembly.gfa": bundle.gfa_lines(units, linked, 3), "histogram.tsv": bundle.tsv_lines(kmers.support_histogram(held), ["support"])}
    root = str(tmp_path / "out")
    digest = bundle.write_bundle(spark, root, tables, {"k": 3}, bundle.report_html(units, "a <b>"))
    assert len(digest) == 64 and bundle.verify_bundle(spark, root).isEmpty()
    assert [r.value for r in spark.read.text(f"{root}/histogram.tsv").collect()][0] == "support\tdistinct_canonical_keys"
    with pytest.raises(FileExistsError):
        bundle.write_bundle(spark, root, tables, {})
    (tmp_path / "out" / "report.html").write_text("x")
    (tmp_path / "out" / ".report.html.crc").unlink()  # the local file system's own checksum
    (tmp_path / "out" / "more").write_text("x")
    assert {(r.path, r.problem) for r in bundle.verify_bundle(spark, root).collect()} == {("report.html", "changed"), ("more", "unlisted")}


def test_spellings_of_one_file_are_told(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n")
    (tmp_path / "b.fa").symlink_to(tmp_path / "a.fa")
    for other in (f"{tmp_path}/./a.fa", f"{tmp_path}/b.fa"):
        with pytest.raises(fastx.InputError, match="twice"):
            fastx.read_fastx(spark, [str(tmp_path / "a.fa"), other])


def test_sources_are_counted_with_their_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.fa").write_text(">x 1:\nACGT\n>y\nAC\n")
    rows = fastx.records(spark, fastx.sources(spark, [str(tmp_path / "a.fa")]))
    found = fastx.source_digests(rows).first()
    assert (found.records, found.bases, found.raw_sha256) == (2, 6, hashlib.sha256((tmp_path / "a.fa").read_bytes()).hexdigest())


def make_dataset(root, change=lambda files: None):
    import hashlib
    import json

    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    ring = "ACGTTGCAAGGCTTACGATC"
    clean = {"r1": (ring + ring)[15:25], "r2": turned(ring[3:13])}
    seen = {"r1": clean["r1"][:4] + "A" + clean["r1"][5:], "r2": clean["r2"]}
    assert seen["r1"] != clean["r1"]
    origin = lambda r, first, step: f"1\t0\t{r}\tS\tm\tcircular\t{'+' if step > 0 else '-'}\t{first}\t{step}\t10\t0\t10\tfalse\t{sha(clean[r])}\t{sha(seen[r])}\tNA\n"
    files = {
        "reads.fastq": "".join(f"@{r}\n{s}\n+\n{'I' * 9 + '+'}\n" for r, s in seen.items()),
        "truth.fasta": f">m\n{ring}\n",
        "origins.tsv": "\t".join(x.split()[0] for x in dataset.LEDGERS["origins"].split(", ")) + "\n" + origin("r1", 15, 1) + origin("r2", 12, -1),
        "errors.tsv": "\t".join(x.split()[0] for x in dataset.LEDGERS["errors"].split(", ")) + f"\n1\tr1\t4\t19\tsubstitution\t{clean['r1'][4]}\tA\n",
        "quality_events.tsv": "\t".join(x.split()[0] for x in dataset.LEDGERS["quality_events"].split(", ")) + "\n1\tr1\t9\tlow_quality\t10\n",
    }
    listed = [{"path": p, "role": "x", "visibility": "evaluation_only", "bytes_decimal": str(len(t)), "sha256": sha(t)} for p, t in files.items()]
    change(files)
    described = {"files": listed, "evaluation_truth": {"fasta_path": "truth.fasta", "molecules": [{"molecule_id": "m", "truth_class": "primary", "topology": "circular", "length_bases_decimal": "20", "sequence_sha256": sha(ring)}]}}
    root.mkdir()
    for p, t in {**files, "dataset.json": json.dumps(described, indent=1)}.items():
        (root / p).write_text(t)
    return str(root)


def rules(spark, root):
    ledgers = [dataset.read_ledger(spark, f"{root}/{k}.tsv", k) for k in ("origins", "errors", "quality_events")]
    return sorted(map(tuple, dataset.ledger_errors(fastx.read_fastx(spark, [f"{root}/reads.fastq"]), dataset.truths(spark, root), *ledgers).collect()))


def test_datasets_are_verified_and_their_ledgers_replayed(spark, tmp_path):
    root = make_dataset(tmp_path / "good")
    assert dataset.manifest_errors(spark, root).isEmpty() and rules(spark, root) == []
    worse = make_dataset(tmp_path / "bad", lambda f: f.update({"errors.tsv": f["errors.tsv"].replace("\tA\n", "\tC\n") + "1\tr2\t0\t0\ts\tA\tC\n", "quality_events.tsv": f["quality_events.tsv"].replace("\t10\n", "\t11\n")}))
    assert sorted(map(tuple, dataset.manifest_errors(spark, worse).collect())) == [("errors.tsv", "size"), ("quality_events.tsv", "changed")]
    assert rules(spark, worse) == [("r1", "a quality that is not there"), ("r1", "an error that is not there"), ("r2", "an error that is not there"), ("r2", "number of errors")]
    with pytest.raises(fastx.InputError, match="header"):
        dataset.read_ledger(spark, f"{root}/errors.tsv", "origins")


def test_an_assembly_may_be_empty_if_allowed(spark, tmp_path):
    (tmp_path / "none.fasta").write_text("")
    assert dataset.read_fasta(spark, str(tmp_path / "none.fasta"), allow_empty=True).count() == 0
    with pytest.raises(fastx.InputError):
        dataset.read_fasta(spark, str(tmp_path / "none.fasta"))


def test_tables_of_a_bundle_have_their_columns(spark):
    held = spark.createDataFrame([("AACGC", 3), ("ACGCT", 5), ("AGCGT", 7), ("CGCTA", 7)], "kmer string, support long")
    units = graph.unitigs(held.filter("kmer <> 'AGCGT'"), 5)
    table = artifacts.unitig_evidence(units, 5, 2)
    assert len(table.columns) == 18 and table.first().placement_enumeration_status == "unavailable_remap_disabled"
    lines = [r.value for r in bundle.tsv_lines(table.drop("seq"), [F.col("length_bases").desc(), "sequence_sha256"]).collect()]
    assert lines[0].count("\t") == 16 and "\tNA\t" in lines[1]
    summary = artifacts.transform_summary(held, 5).first()
    assert len(summary) == 16 and (summary.input_support_mass, summary.output_support_mass, summary.removed_key_count) == (22, 19, 1)
    both = artifacts.of_all_k({5: table, 7: table})
    assert {r.k for r in both.collect()} == {5, 7} and artifacts.run_status(units.limit(0))["status"].endswith("no_unitigs_under_parameters")


def test_limits_raise_and_never_shorten(spark):
    with pytest.raises(ValueError, match="k must be 3 to 127; a quality"):
        limits.Parameters(k=128, minimum_quality=94)
    with pytest.raises(ValueError, match="rising"):
        limits.multi_k([31, 21])
    rows = spark.range(5)
    assert limits.at_most(rows, 5, "rows").count() == 5 and limits.multi_k([21, 31]) == [21, 31]
    with pytest.raises(limits.LimitError, match="more than 4 rows"):
        limits.at_most(rows, 4, "rows")
    assert [limits.pair_evidence_state(rows, p, n) for p, n in ((True, 5), (True, 4), (False, 9))] == ["available", "unavailable_fragment_limit", "not_paired_input"]
