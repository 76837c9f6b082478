"""Divergence of sources: how far apart the smoothed term shares of the sources of a language are, priced on hash-consed trees.

Terms are counted by (language, source) with partial counts in tasks. The terms that a language keeps are dealt to blocks; in a
block every source has a segment tree over the same term ids whose leaves are its counts. Equal subtrees are one node: level
by level, equal pairs of children get one number, for all sources of the task at once. Two sources are compared by walking
their trees together from the roots: at each level, equal pairs of nodes are kept once, so a pair of leaves is priced once
however often it occurs (most often, two subtrees without any occurrence), and prices are added up on the way back.

A source's smoothed share depends on its total alone besides the count, so the totals travel with the sources. Sources are dealt
to tiles; a task takes one block and the sources of one or two tiles, so its memory is bounded by TERMS * 2 * TILE whatever the number of
terms and sources. Prices are integers, so sums over blocks are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.durable import cut_lineage
from helixframe.llm.common import release, slices

#: A term is kept by a language in whose documents it stands at least so often; what is added to counts; the scale of shares.
DOCUMENTS, SMOOTH, SCALE = 30, 5, 1_000_000_000
#: Terms of a block (about), sources of a tile (about), ranks of the terms of a source.
TERMS, TILE, RANKS = 1024, 64, 50
#: Bytes of text whose terms are counted together in a task.
SLICE = 1 << 22
#: What parts terms: all of ASCII but its letters; and capital letters become small ones.
_FOLD = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) by partial counts: a key may have several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches, size=SLICE):
            terms = [t.translate(_FOLD).split() for t in texts]
            index: dict[bytes, int] = {}
            for words in terms:
                index.update(dict.fromkeys(words, 0))
            for i, term in enumerate(index):
                index[term] = i
            groups: dict[tuple[str, str], int] = {}
            of = [groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            ids = np.fromiter((index[w] for words in terms for w in words), np.int64, sum(map(len, terms)))
            document = np.repeat(np.arange(len(terms)), [len(w) for w in terms])
            once, n = np.unique(document * max(len(index), 1) + ids, return_counts=True)  # a document's terms
            key = np.array(of, np.int64)[once // max(len(index), 1)] * max(len(index), 1) + once % max(len(index), 1)
            found, at = np.unique(key, return_inverse=True)
            df, total = np.bincount(at, minlength=len(found)), np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)
            group, names, terms_of = found // max(len(index), 1), list(groups), pa.array(list(index), pa.binary()).cast(pa.string())
            columns = [pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, terms_of.take(pa.array(found % max(len(index), 1))), pa.array(total), pa.array(df.astype(np.int64))], names=["lang", "source", "term", "n", "df"])

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, df long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), in exact arithmetic."""
    wide = lambda c: c.cast("decimal(38,0)")
    over = wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, wide(total + kept * SMOOTH))


def shares(counts: np.ndarray, denominators: np.ndarray) -> np.ndarray:
    """The same of arrays of counts and of (total + SMOOTH * kept)."""
    if counts.max(initial=0) < (1 << 63) // SCALE - SMOOTH:
        return 1 + SCALE * (counts + SMOOTH) // denominators
    wide = SCALE * (counts.astype(object) + SMOOTH)  # beyond nine billion occurrences of a term in a source
    return (1 + wide // denominators.astype(object)).astype(np.int64)


def consed(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash-consed segment trees over the rows of a matrix of counts (one row a source, one column a term).

    From the leaves up, a list of (nodes, roots): `nodes` are the distinct counts (-1: beyond the last term) at the leaves and the distinct
    pairs of children's numbers above; `roots` has a row's node for each of its subtrees of that height, in the end one.
    """
    rows, columns = counts.shape
    full = np.full((rows, 1 << max(columns - 1, 0).bit_length()), -1, np.int64)
    full[:, :columns] = counts
    values, at = np.unique(full, return_inverse=True)
    levels = [(values, at.reshape(full.shape))]
    while levels[-1][1].shape[1] > 1:
        below, size = levels[-1][1], len(levels[-1][0])
        pairs, at = np.unique(below[:, 0::2] * size + below[:, 1::2], return_inverse=True)
        levels.append((np.stack([pairs // size, pairs % size], axis=1), at.reshape(rows, -1)))
    return levels


def prices(levels: list[tuple[np.ndarray, np.ndarray]], denominators: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sum over all terms of the differences of shares of each pair (left, right) of rows.

    All pairs walk down together; a pair of rows keeps each pair of nodes once.
    """
    roots = levels[-1][1][:, 0]
    pair, u, v = np.arange(len(left)), roots[left], roots[right]
    way = []
    for nodes, _ in reversed(levels[1:]):
        size = int(nodes.max()) + 1
        children = np.concatenate([(pair * size + nodes[u, k]) * size + nodes[v, k] for k in (0, 1)])
        once, at = np.unique(children, return_inverse=True)
        way.append(at)
        pair, u, v = once // (size * size), once // size % size, once % size
    counts = levels[0][0]
    a, b = counts[u], counts[v]
    price = np.abs(shares(np.maximum(a, 0), denominators[left[pair]]) - shares(np.maximum(b, 0), denominators[right[pair]]))
    price[a < 0] = 0
    for at in reversed(way):
        priced = price[at]
        price = priced[: len(at) // 2] + priced[len(at) // 2 :]
    return price


def _block_prices(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """One block of terms and the sources of one or two tiles: lang, a, b, value for each pair of sources a < b of the two tiles."""
    term = counts.column("term").combine_chunks().dictionary_encode()
    ids, n = term.indices.to_numpy(), counts.column("n").to_numpy()
    # Terms by falling number of occurrences, so that rare ones stand together.
    places = np.argsort(np.lexsort((np.arange(len(term.dictionary)), -np.bincount(ids, weights=n))))
    names = sources.column("source").to_pylist()
    row = {s: k for k, s in enumerate(names)}
    matrix = np.zeros((len(names), sources.column("in_block")[0].as_py()), np.int64)  # terms that none of these sources has come last
    of = np.array([row[s] for s in counts.column("source").to_pylist()], np.int64)
    np.add.at(matrix, (of, places[ids]), n)
    low, high = sources.column("low")[0].as_py(), sources.column("high")[0].as_py()
    tile = sources.column("tile").to_numpy()
    firsts, seconds = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    left, right = np.repeat(firsts, len(seconds)), np.tile(seconds, len(firsts))
    if low == high:
        left, right = left[left < right], right[left < right]
    levels, denominators = consed(matrix), np.maximum(sources.column("denominator").to_numpy(), 1)
    step = max(1, (1 << 20) // max(matrix.shape[1], 1))  # pairs that walk down at a time
    value = [prices(levels, denominators, left[k : k + step], right[k : k + step]) for k in range(0, len(left), step)]
    lang = sources.column("lang")[0].as_py()
    told = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": told.take(pa.array(left)), "b": told.take(pa.array(right)), "value": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64), pa.int64())})


def divergences(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each other source of the language, the sum over its kept terms of the differences of both sources' shares, all ranks.
    Part `term`: the kept terms that stand in the source with a larger share than in the whole language, by
    the difference, down to rank `ranks`. Rank 1 is the largest value; equal ones go by the item's bytes.

    Null texts, languages and sources count as empty. A source without terms has its pairs, a language
    with one source none. Repeated rows count as often as they occur. Other columns are not read. An empty table gives an empty result.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    named = docs.select(none("lang"), none("source"), "text")
    # One exchange: a term of a language meets in one place, with at most a row of each task and source.
    met = term_counts(named).repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    counted = met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = cut_lineage(counted.select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("df"), F.sum("n").over(of_term).alias("whole")).filter(F.col("df") >= documents).drop("df"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    distinct = kept.groupBy("lang", "term").agg(F.max("whole").alias("whole"))
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]))

    of_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = kept.join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    top = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).filter("value > 0").withColumn("rank", F.row_number().over(of_source)).filter(F.col("rank") <= ranks)

    # Blocks and tiles of a language, by its numbers of terms and sources.
    per = groups.groupBy("lang").agg(F.max("kept").alias("terms"), F.count("*").alias("sources"))
    per = per.select("lang", F.greatest(F.ceil(F.col("terms") / terms), F.lit(1)).alias("blocks"), F.ceil(F.col("sources") / tile).alias("tiles"))
    tiled = groups.join(per, "lang").select("lang", "source", "blocks", "tiles", (F.col("total") + F.col("kept") * SMOOTH).alias("denominator"), F.pmod(F.xxhash64("source"), "tiles").alias("tile"))
    # A tile meets all tiles, the smaller number first.
    others = F.transform(F.sequence(zero, F.col("tiles") - 1), lambda t: F.named_struct(F.lit("low"), F.least("tile", t), F.lit("high"), F.greatest("tile", t)))
    block = F.pmod(F.xxhash64("term"), "blocks")
    unit = ["lang", "block", "low", "high"]
    rows = kept.join(tiled, ["lang", "source"]).select("lang", "source", "term", "n", block.alias("block"), F.inline(others))
    in_block = distinct.join(per, "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("in_block"))
    everyone = tiled.select("lang", "source", "tile", "denominator", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), others.alias("others")).join(in_block, ["lang", "block"]).select("*", F.inline("others")).drop("others")
    parts = rows.groupBy(*unit).cogroup(everyone.groupBy(*unit)).applyInArrow(_both, "lang string, a string, b string, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    # Sources of a language that keeps no term are in no block; their differences are zero.
    empty = groups.filter("kept = 0").select("lang", "source")
    both = both.unionByName(empty.join(empty.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", zero.alias("value")))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(of_source).alias("rank"))
    return pairs.unionByName(top)


def _both(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    return _block_prices(counts, sources)


#: The same in SQL.
DIVERGENCES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS kept, sum(whole) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v.kept), 0) AS kept, coalesce(any_value(v.lang_total), 0) AS lang_total, coalesce(any_value(t.total), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.kept)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.whole + 5)) // (g.lang_total + 5 * g.kept)::HUGEINT AS q
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
