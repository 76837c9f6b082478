"""The registered queries, with and without the text subpackage, and some of them against SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans import catalogue
from helixframe.streaming import counts

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_imports_without_the_text_subpackage():
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('helixframe.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError('No module named ' + repr(name), name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']
"""
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.parametrize("name", ["kmer_count_fragment", "window_stats", "node_degree", "unitig_evidence", "pair_links", "multik_conflicts", "multik_unresolved_sides", "spectrum_scores", "chimeric_junctions", "corrected_reads", "correction_accounting", "correction_alternatives", "candidate_evidence", "portfolio_counts"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = catalogue.QUERIES[name](spark, DATA)
    order = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in order)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    flat = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert order == sorted(con.execute(catalogue.ORACLE_SQL[name]).df().columns) and flat(found.select(*order).collect()) == flat(want)


def test_a_stream_of_reads_counts_like_a_batch(spark, tmp_path):
    frags = spark.createDataFrame([(0, 0, [("S", "AACGTTGC", None)]), (1, 0, [("S", "AACGTA", None)])], "fragment_id long, lane int, reads array<struct<role:string,seq:string,qual:string>>")
    frags.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frags.schema).parquet(str(tmp_path / "in"))
    query = counts.streaming_counts(stream, 5, 0).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, counts.streaming_counts(frags, 5, 0).collect()))
