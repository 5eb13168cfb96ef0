"""Merkle manifest of a dataset: one root, and for every row the proof that it is part of it.

Rows are the leaves of a tree of a fixed fanout for each group (source), and the
groups' subroots those of one tree above them. A row's digest is taken where it is
read, so no text is shuffled. The leaves of a group are numbered in order of their
id by a range sort, and dealt in aligned blocks of ``fanout ** BLOCK_LEVELS``; one task
hashes a block's subtree. Above the blocks the partitions exchange roots as in a
butterfly: in round r, blocks whose numbers differ only in digit r (to the base of
the fanout) meet, at most ``fanout`` of them, and each hashes their common
ancestor for itself. After the last round every block holds the root and its own
upper proof, and nothing is handed down the tree. Groups then go on
in the same way among each other: in a round each block reads the subroots of its
aligned run of groups.

Edge cases: every null column counts as such in the digest; a null group comes first,
and within a group null ids; rows with the same id stand in order of their digest, and
equal rows are interchangeable leaves; a lone leaf is its group's subroot, a lone
group's subroot the root; an empty table gives no rows; texts of any length are
hashed where they are read; only the named columns are read, ``extra`` columns get
names with an underscore before them, so other columns' names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchpulse.functions.joins import counted_side, join_null_safe
from searchpulse.llm.common import stored

FANOUT = 3
#: Levels that one task hashes: blocks of 729 leaves.
BLOCK_LEVELS = 6
#: Groups up to which a round's subroots (under 200 bytes a group) are broadcast.
BROADCAST_GROUPS = 50_000
#: Bits that Spark leaves for the row within a partition in its increasing ids.
ROW_BITS = 33

STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """A value with its length in bytes, a dash for null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``position`` (from 0) in order of ``order`` within equal ``scope``, and ``total``, the rows there.

    A range sort, a count for each partition and scope, and a running sum of these: no
    scope is ever sorted in one task.
    """
    names = [f"`{c}`" for c in df.columns]
    ordered = df.repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order)
    placed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    runs = placed.groupBy(*scope, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*scope)
    runs = runs.withColumns(
        {
            "_before": F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows"),
            "total": F.sum("_rows").over(whole),
        }
    )
    joined = join_null_safe(placed, counted_side(runs), [*scope, "_part"])
    return joined.select(*names, (F.col("_at") - F.col("_first") + F.col("_before")).alias("position"), "total")


def _levels(nodes: list[str], rounds: int | None, fanout: int):
    """Root of a run of leaves, and for each level the (left, right) siblings of its nodes.

    ``rounds`` None: until one node remains.
    """
    import hashlib

    levels = []
    while len(nodes) > 1 if rounds is None else len(levels) < rounds:
        sides, above = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            sides += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
            above.append(hashlib.sha256("".join(run).encode()).hexdigest())
        levels.append(sides)
        nodes = above
    return (nodes[0] if nodes else None), levels


def _block_roots(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """Root of each block of leaves; a group of one block is hashed until one node remains."""
    import pandas as pd

    def root(key, rows):
        rows = rows.sort_values("position")
        alone = rows["blocks"].iloc[0] == 1
        top, _ = _levels(rows["leaf"].tolist(), None if alone else block_levels, fanout)
        return pd.DataFrame({"_some": [key[0]], "_group": [key[1]], "block": [key[2]], "blocks": rows["blocks"].iloc[:1].tolist(), "node": [top]})

    keyed = leaves.select("_some", "_group", "block", "blocks", "position", "leaf").groupBy("_some", "_group", "block")
    return keyed.applyInPandas(root, "_some boolean, _group string, block long, blocks long, node string")


def _hashed(state: DataFrame, active: Column, digit: Column, roots: Column) -> DataFrame:
    """One round's ancestor: hashed from the roots that were swapped, and the siblings added to the proof."""
    mine = lambda side: F.array_join(F.transform(F.filter(roots, side), lambda x: x["node"]), "")
    left, right = mine(lambda x: x["digit"] < digit), mine(lambda x: x["digit"] > digit)
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return state.withColumns(
        {
            "steps": F.when(active, F.concat("steps", step)).otherwise(F.col("steps")),
            "node": F.when(active, digest(left, F.col("node"), right)).otherwise(F.col("node")),
        }
    )


def _rounds(n: int, fanout: int) -> int:
    """Rounds until ``n`` nodes have become one."""
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def exchange_blocks(state: DataFrame, rounds: int, fanout: int) -> DataFrame:
    """Butterfly rounds among the blocks of each group.

    In round r a block stands in a node of ``fanout ** r`` blocks, as member m of it.
    The members m of the nodes of an aligned run meet. The last node of a group may
    have fewer members than the others; these write to several partners, so that
    everyone gets every root of its run once.
    """
    for r in range(rounds):
        span = fanout**r
        index, member = F.floor(F.col("block") / span), F.col("block") % span
        run, digit = F.floor(index / fanout), index % fanout
        size = F.least(F.lit(span), F.col("blocks") - index * span)
        widest = F.least(F.lit(span), F.col("blocks") - run * span * fanout)
        letters = state.withColumns({"_run": run, "_digit": digit, "_member": member})
        letters = letters.withColumn("_to", F.explode(F.sequence(member, widest - 1, size)))
        meeting = Window.partitionBy("_some", "_group", "_run", "_to")
        sent = F.collect_list(F.struct(F.col("_digit").alias("digit"), "node")).over(meeting)
        met = letters.withColumn("_roots", F.array_sort(sent)).where("_to = _member")
        met = _hashed(met, F.col("blocks") > span, F.col("_digit"), F.col("_roots"))
        state = met.drop("_run", "_digit", "_member", "_to", "_roots")
    return state


def exchange_groups(state: DataFrame, groups: int, fanout: int) -> DataFrame:
    """Rounds among the groups: every block reads the roots of its aligned run of nodes, as any block of each node holds it."""
    state = state.withColumns({"subroot": F.col("node")})
    for r in range(_rounds(groups, fanout)):
        span = fanout**r
        index = F.floor(F.col("number") / span)
        here = state.withColumns({"_run": F.floor(index / fanout), "_digit": index % fanout})
        letters = here.where((F.col("block") == 0) & (F.col("number") % span == 0))
        letters = letters.groupBy("_run").agg(F.array_sort(F.collect_list(F.struct(F.col("_digit").alias("digit"), "node"))).alias("_roots"))
        if groups <= BROADCAST_GROUPS:
            letters = F.broadcast(letters)
        met = _hashed(here.join(letters, "_run"), F.lit(True), F.col("_digit"), F.col("_roots"))
        state = stored(met.drop("_run", "_digit", "_roots"), f"merkle-groups-{r}")
    return state


def merkle_manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    extra: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """id, ``leaf``, ``subroot``, ``root`` and ``steps``, a row's siblings from the leaf to the root, and the ``extra`` columns.

    ``columns`` go into a row's digest, in this order. Groups are compared as text.
    """
    import numpy as np
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    group = F.col(group_col).cast("string")
    extra = {f"_{name}": col for name, col in (extra or {}).items()}
    leaves = docs.select(
        group.isNotNull().alias("_some"),
        F.coalesce(group, F.lit("")).alias("_group"),
        F.col(id_col).alias("_id"),
        leaf_digest(*[F.col(c) for c in columns]).alias("leaf"),
        *[col.alias(name) for name, col in extra.items()],
    )
    leaves = numbered(stored(leaves, "leaves"), ["_some", "_group"], ["_id", "leaf"])
    span = fanout**block_levels
    leaves = leaves.withColumns({"block": F.floor(F.col("position") / span), "blocks": F.ceil(F.col("total") / span)})

    blocks = stored(_block_roots(leaves, fanout, block_levels), "merkle-blocks")
    most = blocks.agg(F.max("blocks")).head()[0] or 0
    state = exchange_blocks(blocks.withColumn("steps", F.array().cast(STEPS)), _rounds(most, fanout), fanout)
    firsts = numbered(blocks.where("block = 0").select("_some", "_group"), [], ["_some", "_group"])
    firsts = firsts.select("_some", "_group", F.col("position").alias("number"))
    groups = firsts.count()
    firsts = F.broadcast(firsts) if groups <= BROADCAST_GROUPS else firsts
    state = stored(state.join(firsts, ["_some", "_group"]), "merkle-partitions")
    state = exchange_groups(state, groups, fanout)

    names = [f for f in leaves.schema if f.name in extra]

    def proofs(left, right):
        left = left.sort_by("position")
        upper = right.slice(0, 1).to_pylist()[0]
        alone = left.column("blocks")[0].as_py() == 1
        _, levels = _levels(left.column("leaf").to_pylist(), None if alone else block_levels, fanout)
        above = [(s["left"], s["right"]) for s in upper["steps"]]
        n, depth = left.num_rows, len(levels) + len(above)
        sides = [[], []]
        for i in range(n):
            for level in levels:
                a, b = level[i]
                sides[0].append(a)
                sides[1].append(b)
                i //= fanout
            sides[0] += [a for a, _ in above]
            sides[1] += [b for _, b in above]
        pairs = pa.StructArray.from_arrays([pa.array(s, pa.string()) for s in sides], ["left", "right"])
        steps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), pairs)
        same = lambda value: pa.array([value] * n, pa.string())
        return pa.Table.from_arrays(
            [left.column("_id"), left.column("leaf"), same(upper["subroot"]), same(upper["node"]), steps, *[left.column(f.name) for f in names]],
            ["_id", "leaf", "subroot", "root", "steps", *[f.name for f in names]],
        )

    keys = ["_some", "_group", "block"]
    own = leaves.select(*keys, "blocks", "position", "_id", "leaf", *[f.name for f in names]).groupBy(*keys)
    schema = f"_id {id_type}, leaf string, subroot string, root string, steps {STEPS}"
    schema = ", ".join([schema, *[f"{f.name} {f.dataType.simpleString()}" for f in names]])
    found = own.cogroup(state.select(*keys, "subroot", "node", "steps").groupBy(*keys)).applyInArrow(proofs, schema)
    return found.withColumnRenamed("_id", id_col)
