"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A log that stores a conversation anew after every turn holds many prefixes of the same conversation.
Each turn gets a digest; bound to its position and combined over the turns before it, it gives a rolling
hash of every prefix in one window pass. A conversation whose whole hash is the hash of a proper prefix
of another one is a snapshot and goes (an anti-join); of equal conversations the one with the smallest
id stays. Only then are the texts moved, and rendered. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def _digest() -> Column:
    """Of a turn's role and text as they are: the role with its length before it, null apart from empty."""
    role = F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), "role"), F.lit("-"))
    return F.md5(F.concat(role, F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-"))).cast("binary"))


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("digest", _digest())


def _collapsed(turns: DataFrame) -> DataFrame:
    """conv_id, own (the digest of a turn without a conv_id), n_turns, n_copies of what is left."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "digest", F.row_number().over(order).cast("long").alias("n"), F.lead("digest").over(order).isNull().alias("last"))
    hashes = F.xxhash64("n", "digest"), F.xxhash64("digest", "n")
    rolled = named.select("conv_id", F.lit(None).cast("string").alias("own"), "n", "last", F.bit_xor(hashes[0]).over(so_far).alias("a"), F.bit_xor(hashes[1]).over(so_far).alias("b"))
    alone = turns.filter("conv_id IS NULL").select("conv_id", F.col("digest").alias("own"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("last"), "digest")
    rolled = rolled.unionByName(alone.select("conv_id", "own", "n", "last", hashes[0].alias("a"), hashes[1].alias("b")))
    at = F.struct(F.col("conv_id").isNull().alias("alone"), "conv_id", "own")
    whole = rolled.filter("last").groupBy("n", "a", "b").agg(F.min(at).alias("at"), F.count("*").alias("n_copies"))
    prefixes = rolled.filter("NOT last").select("n", "a", "b").distinct()
    return whole.join(prefixes, ["n", "a", "b"], "left_anti").select("at.conv_id", "at.own", F.col("n").alias("n_turns"), "n_copies")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another one, one of each content.

    Nulls, ties, repeated rows and empty tables count as in `format_chats`.
    """
    return _collapsed(_turns(conversations)).drop("own")


def _plain(name: str) -> Column:
    """The column as text in which no marker of the format can stand; null counts as empty.

    `<|` gets one more bar, so no two texts become one. A role is one line: its backslashes and line ends are written \\\\ and \\n.
    """
    text = F.coalesce(F.col(name), F.lit(""))
    if name == "role":
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: every maximal conversation as one text.

    Turns are ordered by `turn` (nulls first), equal ones by their digest; repeated rows are turns of
    their own. Conversations are compared as they are, null apart from empty; in the rendered text null roles and
    texts are empty, and markers of the format inside them are broken up without making two texts one. A row
    without a conv_id is a conversation of its own, of one turn, whose conv_id stays null. Other columns are
    not read. An empty table gives an empty result. A conversation is one row of the result, so it is
    rendered in one task; copies and snapshots never meet in one.
    """
    turns = _turns(conversations)
    kept = _collapsed(turns)
    rendered = turns.select("conv_id", "turn", "digest", F.concat(F.lit(START), _plain("role"), F.lit("\n"), _plain("text"), F.lit(END + "\n")).alias("line"))
    named = kept.filter("conv_id IS NOT NULL").select("conv_id", "n_turns", "n_copies")
    held = rendered.join(named, "conv_id").groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("turn", "digest", "line"))).alias("lines"))
    talks = held.select("conv_id", "n_turns", "n_copies", F.concat_ws("", "lines.line").alias("rendered"))
    single = rendered.filter("conv_id IS NULL").groupBy("digest").agg(F.first("line").alias("rendered"))
    alone = kept.filter("conv_id IS NULL").join(single, F.col("own") == F.col("digest")).select("conv_id", "n_turns", "n_copies", "rendered")
    return talks.unionByName(alone)


FORMAT_SQL = r"""
WITH d AS (
  SELECT conv_id, turn, md5(coalesce(cast(length(role) AS varchar) || ':' || role, '-') || coalesce('+' || text, '-')) AS digest,
         '<|im_start|>' || replace(replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n'), '<|', '<||') || chr(10) || replace(coalesce(text, ''), '<|', '<||') || '<|im_end|>' || chr(10) AS line
  FROM conversations),
s AS (
  SELECT conv_id, cast(NULL AS varchar) AS own, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM d WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest)
  UNION ALL
  SELECT NULL, digest, 1, 1, digest FROM d WHERE conv_id IS NULL),
f AS (SELECT prefix, n, min(conv_id) AS conv_id, min(own) AS own, count(*) AS n_copies FROM s WHERE n = total GROUP BY prefix, n),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n < s.total AND s.prefix = f.prefix)),
r AS (SELECT conv_id, NULL AS own, string_agg(line, '' ORDER BY turn NULLS FIRST, digest) AS rendered FROM d WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, digest, any_value(line) FROM d WHERE conv_id IS NULL GROUP BY digest)
SELECT m.conv_id, m.n AS n_turns, m.n_copies, r.rendered
FROM m JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.own IS NOT DISTINCT FROM CASE WHEN m.conv_id IS NULL THEN m.own END
"""
