"""The strand-symmetric de Bruijn graph of a set of k-mers, its unitigs and their links.

An edge is an oriented view (handle) of a canonical k-mer, a node a literal (k-1)-mer. Walks between
boundary nodes are found by pointer doubling: each round joins every handle's pointer with its pointer's
pointer, so a walk of L handles takes log2(L) rounds, and only unfinished handles take part. Coded handles are first
brought together by their minimizers, as neighbours mostly share one; chains within a slice of a partition are
contracted there, and only the first handle of each takes part in the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.durable import never_broadcast, stored
from helixframe.functions import dna, packed
from helixframe.operators import limits

#: Bases of a minimizer that brings handles together, and handles that are contracted at a time.
MINIMIZER, SLICE = 11, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def handles(counts: DataFrame, k: int) -> DataFrame:
    """spelling, kmer, orientation, support, src, dst, mate_spelling: one row per view, one only for a palindrome."""
    seen = counts.select("kmer", "support", F.explode(F.array_distinct(F.array("kmer", dna.revcomp("kmer")))).alias("spelling"))
    return seen.select("spelling", "kmer", F.when(F.col("spelling") == F.col("kmer"), "+").otherwise("-").alias("orientation"), "support", dna.prefix("spelling", k).alias("src"), dna.suffix("spelling", k).alias("dst"), dna.revcomp("spelling").alias("mate_spelling"))


def nodes(edges: DataFrame) -> DataFrame:
    """node, indeg, outdeg, in_mask, out_mask (a bit per base), is_palindrome, touches_self_rc, is_boundary."""
    fixed = F.col("spelling") == F.col("mate_spelling")
    bit = lambda c: F.expr(f"shiftleft(1, instr('ACGT', {c}) - 1)")
    none = F.lit(0)
    out = edges.select(F.col("src").alias("node"), none.alias("i"), F.lit(1).alias("o"), none.alias("im"), bit("right(spelling, 1)").alias("om"), fixed.alias("f"))
    into = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), none.alias("o"), bit("left(spelling, 1)").alias("im"), none.alias("om"), fixed.alias("f"))
    found = out.unionByName(into).groupBy("node").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"), F.bit_or("im").alias("in_mask"), F.bit_or("om").alias("out_mask"), F.max("f").alias("touches_self_rc"))
    found = found.withColumn("is_palindrome", dna.is_palindrome("node"))
    boundary = (F.col("indeg") != 1) | (F.col("outdeg") != 1) | F.col("is_palindrome") | F.col("touches_self_rc")
    return found.withColumn("is_boundary", boundary)


def nodes_of(counts: DataFrame, k: int) -> DataFrame:
    """`nodes` of the handles of k-mers; where these have a `code`, from codes alone.

    A handle at a node is told by its base there, so a mask of bases is all that has to be summed up. A node and its reverse
    complement mirror each other, so only the smaller is counted, and a k-mer that is its own reverse complement at one side.
    """
    if "code" not in counts.columns:
        return nodes(handles(counts, k))
    ids = _Ids(k)
    both = counts.select("code", ids.revcomp("code").alias("rc")).select("code", (F.col("code") == F.col("rc")).alias("f"), ids.source("code").alias("s"), ids.target("code").alias("t"))
    ends = both.select("*", ids.revcomp("s", k - 1).alias("rs"), ids.revcomp("t", k - 1).alias("rt"))
    bit = lambda base: F.call_function("shiftleft", F.lit(1), base.cast("int"))
    last, first = F.col("code").bitwiseAND(F.lit(3)), F.shiftright("code", 2 * (k - 1))
    fixed = F.when(F.col("f"), 256).otherwise(0)
    # Bits 0 to 3: bases that come in, 4 to 7: that go out, 8: a k-mer that is its own reverse complement.
    at_source = F.struct(F.least("s", "rs").alias("node"), (F.when(F.col("s") <= F.col("rs"), bit(last + 4)).otherwise(bit(3 - last)) + fixed).alias("mask"))
    at_target = F.struct(F.least("t", "rt").alias("node"), F.when(F.col("t") <= F.col("rt"), bit(first)).otherwise(bit(7 - first)).alias("mask"))
    met = ends.select(F.inline(F.when(F.col("f"), F.array(at_source)).otherwise(F.array(at_source, at_target)))).groupBy("node").agg(F.bit_or("mask").alias("mask"))
    low = lambda x: x.bitwiseAND(F.lit(15))
    other = lambda x: sum((F.call_function("shiftleft", F.shiftright(x, i).bitwiseAND(F.lit(1)), F.lit(3 - i)) for i in range(4)), F.lit(0))
    told = met.select("node", ids.revcomp("node", k - 1).alias("rc"), low(F.col("mask")).alias("i"), low(F.shiftright("mask", 4)).alias("o"), (F.col("mask") >= 256).alias("f"))
    mirrored = told.select("node", "rc", "i", "o", other(F.col("i")).alias("ri"), other(F.col("o")).alias("ro"), "f")
    alone = F.col("node") == F.col("rc")
    row = lambda node, into, out: F.struct(F.col(node).alias("id"), into.alias("in_mask"), out.alias("out_mask"))
    one = F.array(row("node", F.col("i").bitwiseOR(F.col("ro")), F.col("o").bitwiseOR(F.col("ri"))))
    two = F.array(row("node", F.col("i"), F.col("o")), row("rc", F.col("ro"), F.col("ri")))
    found = mirrored.select("f", alone.alias("is_palindrome"), F.inline(F.when(alone, one).otherwise(two)))
    degree = lambda c: F.bit_count(c).cast("long")
    named = found.select(dna.decode("id", k - 1).alias("node"), degree("in_mask").alias("indeg"), degree("out_mask").alias("outdeg"), "in_mask", "out_mask", "is_palindrome", F.col("f").alias("touches_self_rc"))
    boundary = (F.col("indeg") != 1) | (F.col("outdeg") != 1) | F.col("is_palindrome") | F.col("touches_self_rc")
    return named.withColumn("is_boundary", boundary)


class _Ids:
    """How handles of one k are named: by 64-bit codes up to 31 bases, by their spellings beyond."""

    def __init__(self, k: int):
        self.k, self.coded = k, k <= packed.LONGEST

    def of(self, spelling) -> Column:
        return dna.encode(spelling) if self.coded else F.col(spelling)

    def spelling(self, c: str) -> Column:
        return dna.decode(c, self.k) if self.coded else F.col(c)

    def revcomp(self, c: str, size: int | None = None) -> Column:
        return packed.revcomp_code(c, size or self.k) if self.coded else dna.revcomp(c)

    def source(self, c: str) -> Column:
        return F.shiftright(c, 2) if self.coded else dna.prefix(c, self.k)

    def target(self, c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1)) if self.coded else dna.suffix(c, self.k)

    def last_base(self, c: str) -> Column:
        return F.substr(F.lit(dna.EXACT), (F.col(c).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) if self.coded else dna.last_base(c)


def _rank(start: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling of (id, ptr, dist, done, ...). Returns the finished rows and those that never finish (cycles).

    A pointer that is done rests at its head. In every round an open walk finishes handles as long as it has
    unfinished ones, so a round without any leaves cycles only.
    """
    finished, left = start.filter("done"), start.filter("NOT done")
    others = [c for c in start.columns if c not in ("ptr", "dist", "done")]
    before = None
    for _ in range(max_rounds):
        n = left.count()
        if not n or n == before:
            return finished, left
        before = n
        target = finished.unionByName(left).select(F.col("id").alias("t"), F.col("ptr").alias("t_ptr"), F.col("dist").alias("t_dist"), F.col("done").alias("t_done"))
        # Pointers are distinct until they rest, so partitions are even and small: no side needs to be sorted.
        moved = stored(left.hint("shuffle_hash").join(target, F.col("ptr") == F.col("t")).select(*others, F.col("t_ptr").alias("ptr"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_done").alias("done")), shuffled=False)
        finished, left = finished.unionByName(moved.filter("done")), moved.filter("NOT done")
    raise RuntimeError(f"walks longer than 2^{max_rounds}")


def ranked(start: DataFrame, max_rounds: int = 40) -> DataFrame:
    """head, topology, step, id, support of chained handles (id, support, ptr, dist, done): each in its walk, cycles cut at their smallest handle."""
    linear, circling = _rank(start, max_rounds)
    named = lambda rows, topology: rows.select(F.col("ptr").alias("head"), F.lit(topology).alias("topology"), F.col("dist").alias("step"), "id", "support")
    placed = named(linear, "linear")
    if circling.isEmpty():
        return placed
    return placed.unionByName(named(_cycles(start.join(circling.select("id"), "id", "left_semi"), max_rounds), "closed_graph_walk"))


def _cycles(rows: DataFrame, max_rounds: int) -> DataFrame:
    """Isolated cycles: the smallest handle of each, found by doubling, is cut off from its predecessor and becomes the head."""
    ring = stored(rows.select("id", "ptr", F.least("id", "ptr").alias("low")))
    for _ in range(max_rounds):
        target = ring.select(F.col("id").alias("t"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        moved = stored(ring.join(target, F.col("ptr") == F.col("t")).select("id", F.col("t_ptr").alias("ptr"), F.least("low", "t_low").alias("low"), (F.col("t_low") < F.col("low")).alias("changed")))
        ring = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            break
    head = ring.filter("id = low").select("id")
    is_head = F.coalesce("is_head", F.lit(False))
    start = rows.select("id", "support", "ptr").join(head.withColumn("is_head", F.lit(True)), "id", "left").select("id", "support", F.when(is_head, F.col("id")).otherwise(F.col("ptr")).alias("ptr"), F.when(is_head, 0).otherwise(1).cast("long").alias("dist"), is_head.alias("done"))
    finished, _ = _rank(stored(start, shuffled=False), max_rounds)
    return finished


class _Keys:
    """Handles of one k as sortable numbers in tasks, and as they stand in rows: 64-bit codes up to 31 bases, beyond four bases in a byte."""

    def __init__(self, k: int):
        self.k, self.coded = k, k <= packed.LONGEST
        self.kind = "long" if self.coded else "binary"

    def given(self, column: pa.Array) -> np.ndarray:
        """The codes, or the base codes (a row each), of the k-mers of a column of codes or texts."""
        if self.coded:
            return column.to_numpy(zero_copy_only=False).view(np.uint64)
        return packed.base_codes(packed.text_bytes(column)[0]).reshape(-1, self.k)

    def revcomp(self, x: np.ndarray, size: int) -> np.ndarray:
        return packed.revcomp_codes(x, size) if self.coded else 3 - x[:, ::-1]

    def source(self, x: np.ndarray) -> np.ndarray:
        return x >> np.uint64(2) if self.coded else x[:, :-1]

    def target(self, x: np.ndarray) -> np.ndarray:
        return x & np.uint64((1 << 2 * (self.k - 1)) - 1) if self.coded else x[:, 1:]

    def ordered(self, x: np.ndarray) -> np.ndarray:
        """One value for each row, in the order of the spellings."""
        if self.coded:
            return x
        four = np.zeros((len(x), -(-x.shape[1] // 4) * 4), np.uint8)
        four[:, : x.shape[1]] = x
        whole = np.ascontiguousarray((four[:, ::4] << 6) | (four[:, 1::4] << 4) | (four[:, 2::4] << 2) | four[:, 3::4])
        return whole.view(f"S{whole.shape[1]}").ravel()

    def bases(self, x: np.ndarray) -> np.ndarray:
        """The base codes of handles, a row each."""
        return ((x[:, None] >> np.arange(2 * (self.k - 1), -1, -2, dtype=np.uint64)) & np.uint64(3)).astype(np.uint8) if self.coded else x

    def column(self, x: np.ndarray) -> pa.Array:
        if self.coded:
            return pa.array(x.view(np.int64))
        data = self.ordered(x)
        return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * data.itemsize), pa.py_buffer(data.tobytes())])

    def text(self, value: bytes) -> str:
        """The spelling of a handle of more than 31 bases as it stands in a row."""
        value = int.from_bytes(value, "big") >> (2 * (-self.k % 4))
        return "".join(dna.EXACT[(value >> 2 * i) & 3] for i in range(self.k - 1, -1, -1))


def _buckets(nodes: np.ndarray, size: int) -> np.ndarray:
    """For each node of `size` bases (a code, or a row of base codes) the bucket of its smallest mixed canonical minimizer; a node's reverse complement has the same."""
    m = min(MINIMIZER, size)
    mask = np.uint64((1 << 2 * m) - 1)
    least, rolled = None, np.zeros(len(nodes), np.uint64)
    for i in range(size):
        if nodes.ndim > 1:
            rolled = (rolled << np.uint64(2)) | nodes[:, i]
        if i < m - 1:
            continue
        part = (rolled if nodes.ndim > 1 else nodes >> np.uint64(2 * (i - m + 1))) & mask
        mixed = np.minimum(part, packed.revcomp_codes(part, m)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        least = mixed if least is None else np.minimum(least, mixed)
    return ((least * _ODD) >> np.uint64(33)).astype(np.int32)


def _to_nodes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """bucket, key, support: each k-mer in the buckets of its two nodes, once where these are one."""
    keys = _Keys(k)
    for batch in batches:
        if not batch.num_rows:
            continue
        given = keys.given(batch.column("key"))
        a, b = _buckets(keys.source(given), k - 1), _buckets(keys.target(given), k - 1)
        both = np.flatnonzero(a != b)
        for bucket, at in ((a, None), (b[both], pa.array(both))):
            rows = batch if at is None else batch.take(at)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), rows.column("key"), rows.column("support")], names=["bucket", "key", "support"])


def _before(handles_: np.ndarray, keys: _Keys) -> np.ndarray:
    """For each handle (rising) the place of the handle before it in its walk, -1 at a start.

    A node is inner if one handle comes in, one goes out, and no reverse complement is itself there. All handles at a node
    that counts must be given.
    """
    k = keys.k
    nodes_ = keys.source(handles_)
    source, target = keys.ordered(nodes_), keys.ordered(keys.target(handles_))
    by_target = np.argsort(target, kind="stable")
    ends = target[by_target]
    low = np.searchsorted(ends, source, "left")
    came, left = np.searchsorted(ends, source, "right") - low, np.searchsorted(source, source, "right") - np.searchsorted(source, source, "left")
    previous = by_target[np.minimum(low, len(handles_) - 1)]
    fixed = keys.ordered(handles_) == keys.ordered(keys.revcomp(handles_, k))
    inner = (came == 1) & (left == 1) & (source != keys.ordered(keys.revcomp(nodes_, k - 1))) & ~fixed & ~fixed[previous]
    return np.where(inner, previous, -1)


def _pieces(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The chains within some whole buckets, as rows of `_PIECES`. A handle belongs to the bucket of the node it leaves."""
    keys = _Keys(k)
    given = keys.given(batch.column("key"))
    at = np.unique(keys.ordered(given), return_index=True)[1]
    given, support = given[at], batch.column("support").to_numpy(zero_copy_only=False)[at]
    back = keys.revcomp(given, k)
    turned = keys.ordered(back) != keys.ordered(given)
    ids, support = np.concatenate([given, back[turned]]), np.concatenate([support, support[turned]])
    order = np.argsort(keys.ordered(ids), kind="stable")
    ids, support = ids[order], support[order]
    place = _before(ids, keys)
    # From here on handles are told by their places, which rise with them.
    own = np.flatnonzero(np.isin(_buckets(keys.source(ids), k - 1), np.unique(batch.column("bucket").to_numpy(zero_copy_only=False))))
    done, before = (place < 0)[own], np.where(place < 0, np.arange(len(ids)), place)[own]
    entry, off = _chains(own, before, done) if len(own) else (own, own)
    order = np.lexsort((off, entry))
    own, before, done, entry = own[order], before[order], done[order], entry[order]
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(own) else np.zeros(0, np.int64)
    ends = np.append(first, len(own)).astype(np.int32)
    letters = np.frombuffer(dna.EXACT.encode(), np.uint8)
    size = np.diff(ends).astype(np.int64) + np.where(done[first], k - 1, 0)
    behind = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    spelled = np.empty(behind[-1], np.uint8)
    last = np.ones(len(spelled), bool)
    starts = first[done[first]]
    lead = (behind[:-1][done[first]][:, None] + np.arange(k - 1)).ravel()
    last[lead] = False
    spelled[lead] = keys.bases(ids[own[starts]])[:, :-1].ravel()
    spelled[last] = ids[own] & np.uint64(3) if keys.coded else ids[own][:, -1]
    bases = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(behind), pa.py_buffer(letters[spelled].tobytes())])
    columns = [keys.column(ids[entry[first]]), keys.column(ids[own[ends[1:] - 1]]), keys.column(ids[before[first]]), pa.array(done[first]), bases, pa.ListArray.from_arrays(pa.array(ends), pa.array(support[own].astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["entry", "tail", "ptr", "done", "bases", "supports"])


_PIECES = "entry {0}, tail {0}, ptr {0}, done boolean, bases string, supports array<long>"


def _linked_pieces(counts: DataFrame, k: int) -> DataFrame:
    """Chains of handles that are found within buckets: entry (first handle), tail (last), ptr (the handle before the entry; itself at a
    walk's start), done (at a start), bases (each handle's last, at a walk's start the whole first handle) and supports.

    k-mers are dealt to the buckets of their nodes' minimizers, so a node's degrees are known in its bucket, and most neighbours
    meet. A bucket is held whole, and holds distinct k-mers about one minimizer only; those of small ones are linked together.
    """
    size = SLICE // 4

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < size:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = rows.column("bucket").to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            held = [rows.slice(whole)]
            if whole:
                yield _pieces(rows.slice(0, whole), k)
        if held:
            yield _pieces(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)

    keys = _Keys(k)
    key = F.col("kmer") if not keys.coded else F.col("code") if "code" in counts.columns else dna.encode("kmer")
    given = counts.select(key.alias("key"), F.col("support").cast("long").alias("support"))
    kind = "long" if keys.coded else "string"
    dealt = given.mapInArrow(lambda batches: _to_nodes(batches, k), f"bucket int, key {kind}, support long").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(link, _PIECES.format(keys.kind))


def _handles_of(pieces: DataFrame, k: int) -> DataFrame:
    """id, support, ptr of the handles of pieces: codes up to 31 bases, spellings beyond."""
    keys, mask = _Keys(k), (1 << 2 * (k - 1)) - 1
    kind = "long" if keys.coded else "string"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, ptr, bases, supports in zip(*(batch.column(c).to_pylist() for c in ("entry", "ptr", "bases", "supports")), strict=True):
                ids = [entry if keys.coded else keys.text(entry)]
                for base in bases[len(bases) - len(supports) + 1 :]:
                    ids.append((ids[-1] & mask) << 2 | dna.EXACT.index(base) if keys.coded else ids[-1][1:] + base)
                before = [ptr if keys.coded else keys.text(ptr), *ids[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(supports, pa.int64()), pa.array(before)], names=["id", "support", "ptr"])

    return pieces.select("entry", "ptr", "bases", "supports").mapInArrow(spread, f"id {kind}, support long, ptr {kind}")


def _chains(ids: np.ndarray, before: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each handle the first one of its chain among those given (its entry), and how many steps behind it it stands.

    `before` is the handle before each in its walk. A handle that is done, or whose `before` is not given, is an entry. So is each
    handle of a cycle that is given whole.
    """
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], before), len(ids) - 1)
    parent = order[at]
    inner = ~done & (ids[parent] == before) & (before != ids)
    parent, steps = np.where(inner, parent, np.arange(len(ids))), inner.astype(np.int64)
    for _ in range(max(1, len(ids).bit_length() + 1)):
        if not inner[parent].any():
            break
        steps, parent = steps + steps[parent], parent[parent]
    circling = inner[parent]
    return ids[np.where(circling, np.arange(len(ids)), parent)], np.where(circling, 0, steps)


def _walks_of_pieces(counts: DataFrame, k: int, max_rounds: int) -> DataFrame:
    """topology, steps (before, bases, supports of each piece, in order): the walks of k-mers. Only pieces are ranked."""
    pieces = stored(_linked_pieces(counts, k))
    ahead = pieces.select(F.col("tail").alias("p"), F.col("entry").alias("p_entry"), F.size("supports").cast("long").alias("p_size"))
    heads = pieces.filter("done").select(F.col("entry").alias("id"), F.col("entry").alias("ptr"), F.lit(0).cast("long").alias("dist"), "done")
    moved = pieces.filter("NOT done").join(never_broadcast(ahead), F.col("ptr") == F.col("p")).select(F.col("entry").alias("id"), F.col("p_entry").alias("ptr"), F.col("p_size").alias("dist"), "done")
    linear, circling = _rank(stored(heads.unionByName(moved), shuffled=False), max_rounds)
    step = lambda before: F.struct(before.alias("before"), "bases", "supports").alias("step")
    first = linear.select(F.col("id").alias("entry"), F.col("ptr").alias("head"), F.col("dist").alias("before"))
    found = pieces.join(never_broadcast(first), "entry").select("head", F.lit("linear").alias("topology"), step(F.col("before")))
    if not circling.isEmpty():
        rings = _handles_of(pieces.join(never_broadcast(circling.select(F.col("id").alias("entry"))), "entry", "left_semi"), k)
        one = _cycles(rings, max_rounds).select(F.col("ptr").alias("head"), F.col("dist").alias("before"), _Ids(k).last_base("id").alias("bases"), F.array(F.col("support").cast("long")).alias("supports"))
        gathered = _gathered(one.select("head", F.lit("closed_graph_walk").alias("topology"), step(F.col("before"))))
        return _gathered(found).unionByName(gathered)
    return _gathered(found)


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("head", "topology").agg(F.array_sort(F.collect_list("step")).alias("steps")).drop("head")


def unitigs(counts: DataFrame, k: int, max_rounds: int = 40) -> DataFrame:
    """unitig_id, seq, topology, edge_steps, canonical_kmers, minimum, lower median and maximum support, sequence_sha256.

    A walk and its reverse complement are one unitig, spelled as the smaller; a closed walk is spelled from
    its smallest rotation on either strand. A unitig is one row, so its steps meet in one task, each with its
    last base and support only. No walk holds a k-mer on both strands, as only boundaries turn a walk round.
    """
    limits.Parameters(k=k)
    whole = _walks_of_pieces(counts, k, max_rounds)
    supports = F.flatten("steps.supports")
    # A linear walk's first piece has its first handle whole; a closed one is spelled by its handles' last bases, so from any of its places.
    raw = F.concat_ws("", "steps.bases")
    spelled = whole.select("topology", F.size(supports).alias("n"), raw.alias("raw"), F.array_sort(supports).alias("supports"))
    linear = F.col("topology") == "linear"
    ring = F.when(~linear, F.col("raw"))
    turned = F.least(dna.minimum_rotation(ring), dna.minimum_rotation(dna.revcomp(ring)))
    closed = F.left(F.repeat(turned, F.lit(k)), F.col("n") + k - 1)
    made = spelled.filter(~linear | (F.col("raw") <= dna.revcomp("raw"))).withColumn("seq", F.when(linear, F.col("raw")).otherwise(closed))
    return made.groupBy("topology", "seq").agg(
        F.max(F.col("n").cast("long")).alias("edge_steps"),
        F.max(F.col("n").cast("long")).alias("canonical_kmers"),
        F.max(F.element_at("supports", 1)).alias("minimum_support"),
        F.max(F.expr("element_at(supports, cast((size(supports) - 1) div 2 as int) + 1)")).alias("lower_median_support"),
        F.max(F.element_at("supports", -1)).alias("maximum_support"),
    ).select(dna.unitig_id("seq", "topology", k).alias("unitig_id"), "seq", "topology", "edge_steps", "canonical_kmers", "minimum_support", "lower_median_support", "maximum_support", F.sha2("seq", 256).alias("sequence_sha256"))


def links(units: DataFrame, k: int) -> DataFrame:
    """from_segment, from_orientation, to_segment, to_orientation, in canonical form.

    Linear walks start and end at boundary nodes and meet nowhere else, so their ends are joined by the
    node's spelling; a closed walk is linked to itself.
    """
    linear = units.filter("topology = 'linear'")
    views = linear.select("unitig_id", F.inline(F.array(F.struct(F.lit("+").alias("o"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("o"), dna.revcomp("seq").alias("s")))))
    ends = views.select(F.right("s", F.lit(k - 1)).alias("node"), F.col("unitig_id").alias("a"), F.col("o").alias("oa"))
    starts = views.select(F.left("s", F.lit(k - 1)).alias("node"), F.col("unitig_id").alias("b"), F.col("o").alias("ob"))
    met = ends.join(starts, "node").select(dna.canonical_link("a", "oa", "b", "ob").alias("l"))
    closed = units.filter("topology <> 'linear'").select(F.struct(F.col("unitig_id").alias("a"), F.lit("+").alias("oa"), F.col("unitig_id").alias("b"), F.lit("+").alias("ob")).alias("l"))
    every = met.distinct().unionByName(closed)
    return every.select(F.col("l.a").alias("from_segment"), F.col("l.oa").alias("from_orientation"), F.col("l.b").alias("to_segment"), F.col("l.ob").alias("to_orientation"))


def link_overlaps(units: DataFrame, linked: DataFrame, k: int) -> DataFrame:
    """Links whose oriented sequences do not overlap by k-1 bases: empty if all is well."""
    a, b = units.select(F.col("unitig_id").alias("from_segment"), F.col("seq").alias("fs")), units.select(F.col("unitig_id").alias("to_segment"), F.col("seq").alias("ts"))
    oriented = lambda o, s: F.when(F.col(o) == "+", F.col(s)).otherwise(dna.revcomp(s))
    both = linked.join(a, "from_segment").join(b, "to_segment")
    return both.filter(F.right(oriented("from_orientation", "fs"), F.lit(k - 1)) != F.left(oriented("to_orientation", "ts"), F.lit(k - 1))).select(linked.columns)


def rc_asymmetry(counts: DataFrame, k: int) -> DataFrame:
    """Handles whose reverse complement is no handle: empty if the graph is strand-symmetric."""
    edges = handles(counts, k)
    return edges.join(edges.select(F.col("spelling").alias("mate_spelling")), "mate_spelling", "left_anti")

