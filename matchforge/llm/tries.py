"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of first turns; its owner is the smallest conversation that
starts with it. Owners only grow with depth, so each conversation owns a suffix
of its path. Along one conversation, windows mark the nodes it owns and sum up
words from a turn to the end: of all its turns, and of those whose nodes it owns.
Over the members of a node the first sums give each occurrence of the subtree's
turns, the second each of its nodes once; so one group-by over prefixes gives
(members - 1) times words, summed over the subtree, and counts children and
childless nodes by flags.

Turns become a 128-bit digest and a word count before anything is shuffled, and a
prefix becomes the sums of its turns' hashes, which hold their places. A node
that a third of all conversations share is counted within the tasks first;
its members learn the owner by a join of two tables in the shared folder, whose
large keys Spark splits. Ends are joined to strings by ranges of ids and hashed
as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.llm.common import stored

#: Conversations that share first turns, and the most turns that are shared.
GROUP, SHARED = 20, 4
#: Ids joined to one string.
JOINED = 4096
NODE = ["depth", "s1", "s2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, digest, n_words): turns by their place from 1; ties of `turn` by role, then by the text's digest."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("digest"), words(text).alias("n_words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.withColumn("at", F.row_number().over(order)).drop("turn")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, digest, n_words) of rebuilt conversations; one that has no turns has a row with `at` null."""
    turns = stored(own_turns(conversations), "turns")
    ids = turns.filter("at = 1").select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    first = turns.filter((F.col("at") < SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    rest = ["at", "role", "digest", "n_words"]
    lent = ids.join(first, "base").filter("at <= h").select("conv_id", *rest)
    kept = turns.filter(F.col("at") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).select("conv_id", *rest)
    every = lent.unionByName(kept)
    return every.unionByName(ids.select("conv_id", *(F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in rest)))


def occurrences(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, s1, s2, n_words, last): each rebuilt conversation at each node of its path, the root included.

    A prefix is known by its depth and by two sums of its turns' 64-bit hashes,
    each of which also holds the turn's depth.
    """
    path = Window.partitionBy("conv_id").orderBy("at")  # the row without turns comes first: the root
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    rows = rebuilt(conversations).withColumn("depth", F.row_number().over(path) - 1).withColumn("last", F.count("*").over(Window.partitionBy("conv_id")) - 1)

    def hashed(seed: str) -> Column:
        own = F.xxhash64(F.lit(seed), "depth", "role", "digest").cast("decimal(20,0)")
        return F.sum(F.when(F.col("depth") > 0, own).otherwise(F.lit(0).cast("decimal(20,0)"))).over(so_far)

    return rows.select("conv_id", "depth", hashed("a").alias("s1"), hashed("b").alias("s2"), F.coalesce("n_words", F.lit(0)).alias("n_words"), "last")


def joined_ends(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256) of the nodes at which conversations (conv_id) end.

    Rows are dealt out by ranges of (node, id), so that a node of very many
    conversations lies in many tasks; each gives strings of up to 4 096 ids.
    One task then hashes a node's strings in order, as a stream.
    """
    schema = ends.select(*NODE).schema
    fields = [pa.field("depth", pa.int64()), *(pa.field(c, pa.decimal128(schema[c].dataType.precision, 0)) for c in NODE[1:])]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lists = None, []  # [depth, s1, s2, first id, ids]
            for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv_id"]), strict=True):
                if key != node or len(lists[-1][4]) == JOINED:
                    node = key
                    lists.append([*key, conv_id, []])
                lists[-1][4].append(str(conv_id))
            columns = [list(c) for c in zip(*lists, strict=True)] or [[]] * 5
            columns[4] = [",".join(ids) for ids in columns[4]]
            types = [*(f.type for f in fields), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def given(done: list) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)] or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*(f.type for f in fields), pa.string()], strict=True)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append([*node, digest.hexdigest()])
                node, digest = key, hashlib.sha256(ids.encode())
            yield given(done)
        if node is not None:
            yield given([[*node, digest.hexdigest()]])

    of = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in NODE[1:])
    dealt = ends.select(*NODE, "conv_id").withColumn("depth", F.col("depth").cast("bigint")).repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    lists = dealt.mapInArrow(strings, f"depth bigint, {of}, first bigint, ids string")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, f"depth bigint, {of}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, one row each.

    conversations: conv_id, turn, role, text, and others that are left out.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation and are left out. A null
    role or text is the empty one; a null turn comes first. Rows of one turn are
    ordered by role, then by their text's digest; repeated rows are turns of
    their own. A conversation that loses all its turns is a member of the root.
    An empty table gives no rows, not even a root. Texts of any length become a
    digest and a count in the task that reads them. A conversation's turns,
    without their texts, meet in one task.
    """
    paths = stored(occurrences(conversations), "paths")
    nodes = stored(paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("last").alias("longest")), "nodes")
    known = paths.join(nodes, NODE)
    path = Window.partitionBy("conv_id").orderBy("depth")
    below = path.rowsBetween(0, Window.unboundedFollowing)
    owns = F.col("owner") == F.col("conv_id")
    marked = known.withColumn("owned", owns.cast("bigint")).select(
        *NODE, "conv_id", "owner", "owned",
        F.lag("owner").over(path).alias("parent"),
        F.coalesce(F.lead("owned").over(path), F.lit(0)).alias("child"),
        F.max(F.when((F.col("depth") == F.col("last")) & (F.col("longest") == F.col("last")), F.col("owned")).otherwise(0)).over(below).alias("leaf"),
        (F.sum("n_words").over(below) - F.sum(F.col("owned") * F.col("n_words")).over(below)).alias("spare"),
    )
    summed = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("spare").alias("saved_tokens"),
    )
    ends = joined_ends(paths.filter("depth = last"))
    result = ["conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return summed.join(ends, NODE, "left").select(*result, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The same over whole paths: every node as a list of turns, its subtree by all prefixes of each node."""
    # Reflected CRC-32 of a text, bit by bit; 3988292384 is the polynomial.
    step = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    return rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {crc} % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS path FROM h LEFT JOIN c b ON h.base = b.conv_id),
p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
n AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
children AS (SELECT node[1:depth - 1] AS parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN children ON n.node = children.parent),
words AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(node[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS n_words FROM known),
up AS (SELECT node[1:d] AS top, n_convs, n_children, n_words FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM words)),
s AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_words) AS saved_tokens FROM up GROUP BY top)
SELECT known.conv_id, known.depth, parent.conv_id AS parent_conv_id, known.n_convs, known.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, known.ends_sha256
FROM known JOIN s ON known.node = s.top LEFT JOIN n parent ON parent.node = known.node[1:known.depth - 1] AND known.depth = parent.depth + 1
"""
