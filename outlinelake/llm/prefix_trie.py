"""Conversations as a trie of shared prefixes (operator 11).

A node is a distinct sequence of first d turns; its members are the conversations that start with it, its owner is the
smallest of them. A conversation that owns a node owns all its deeper ones too, so what it owns is a chain from its
first owned depth to its end, found by binary search: in each round every open conversation looks up the digest of its
prefix at the middle depth, and the smallest member of that digest, by two joins for all conversations at once. Chains
make up the tree: a chain hangs below the node one above its first. Sums run along each chain from its end upwards; a
chain's sum then goes to all nodes above it, which are the prefixes its conversation doesn't own, in one grouped sum,
so the number of jobs doesn't grow with how deep chains hang below each other.

A prefix's digest is its depth and two 64-bit sums over its turns of hashes of place and turn's SHA-256, so digests of
a conversation are running sums: conversations of any length are dealt by ranges of turns, and only a range's first
conversation gets something added from the ranges before. Look-ups of prefixes that many share go to a broadcast table
of at most HOT of them (the sum of all nodes' members is the number of prefixes, so no more can have a HOT-th of it
each); others are joined. The ids that end in a node are joined to pieces of text by range first, and only pieces meet
in the task that hashes them, as a stream.

Defined results: turns come in the order of turn (null first), then of their digest; null role or text is empty; rows
without conv_id are no conversation. Repeated rows are turns that count each time. Texts of any length are hashed where
they are read. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidied

#: Prefixes whose look-ups are broadcast, at most; ids in a piece of text.
HOT, IDS = 1000, 20_000
DIGEST = ["depth", "sum1", "sum2"]


@tidied
def _run(key: str, sums: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with `sums` as running sums of their key within this partition, its number, and whether a row is its last."""
    at, carry, held = None, [0] * len(sums), None
    part = TaskContext.get().partitionId()

    def out(b: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        end = np.zeros(b.num_rows, bool)
        end[-1] = last
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(end)], [*b.schema.names, "part", "last"])

    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        lens = np.diff(np.append(cuts, len(k)))
        columns = dict(zip(b.schema.names, b.columns, strict=True))
        for i, name in enumerate(sums):
            x = np.cumsum(columns[name].to_numpy().view(np.uint64), dtype=np.uint64)
            before = np.concatenate([np.zeros(1, np.uint64), x])[cuts]
            if at == k[0]:
                before[0] = np.uint64(-carry[i] % (1 << 64))
            x -= np.repeat(before, lens)
            carry[i] = int(x[-1])
            columns[name] = pa.array(x.view(np.int64))
        at = k[-1]
        if held is not None:
            yield out(held, False)
        held = pa.RecordBatch.from_arrays(list(columns.values()), b.schema.names)
    if held is not None:
        yield out(held, True)


@tidied
def _carry(key: str, sums: list[str], starts: dict[int, tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a partition's first key has in the partitions before."""
    for b in batches:
        if not b.num_rows:
            continue
        part, k, columns = b.column("part").to_numpy(), b.column(key).to_numpy(), dict(zip(b.schema.names, b.columns, strict=True))
        for p in np.unique(part).tolist():
            if p in starts and (own := (part == p) & (k == starts[p][0])).any():
                for name, more in zip(sums, starts[p][1], strict=True):
                    x = columns[name].to_numpy().view(np.uint64).copy()
                    x[own] += np.uint64(more)
                    columns[name] = pa.array(x.view(np.int64))
        yield pa.RecordBatch.from_arrays([c for n, c in columns.items() if n not in ("part", "last")], [n for n in columns if n not in ("part", "last")])


def running(rows: DataFrame, key: str, order: list[str | Column], sums: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """rows with the columns `sums` (longs) as running sums of those of the same key up to each row, modulo 2**64, and the stored table they are made of. key: not null; order: with the key a total order. Rows are dealt by ranges of key and order, so a key of any size is shared out; the driver sees a row a partition."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    local = materialise(dealt.mapInArrow(partial(_run, key, sums), f"{kinds}, part int, last boolean"), label)
    starts, at, total = {}, None, [0] * len(sums)
    for r in sorted(local.where("last").select("part", key, *sums).collect()):
        if at is not None:
            starts[r[0]] = (at, total)
        same = r[1] == at
        at, total = r[1], [(t * same + x) % (1 << 64) for t, x in zip(total, r[2:], strict=True)]
    return local.mapInArrow(partial(_carry, key, sums, starts), kinds), local


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest (of role and text), bytes (of the text), rid (a row number)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.withColumn("rid", F.monotonically_increasing_id())


def rebuilt(own: DataFrame, base: Column, most: int, head: Column) -> tuple[DataFrame, DataFrame]:
    """conv, depth, digest, bytes of conversations that start with the first `head` (at most `most`) turns of another one, `base`, and go on with their own after as many; and conv, length of all of them. own: conv, depth, digest, bytes."""
    known = own.groupBy("conv").agg(F.max("depth").alias("n")).withColumn("base", base).withColumn("head", head.cast("long"))
    of = known.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("there"))
    known = known.join(of, "base", "left").select("conv", "base", "head", "n", F.least("head", F.coalesce("there", F.lit(0))).cast("long").alias("taken"))
    first = own.where(F.col("depth") <= most).withColumnRenamed("conv", "base").join(known.select("base", "conv", "head"), "base").where("depth <= head").select("conv", "depth", "digest", "bytes")
    rest = own.join(known.select("conv", "head", "taken"), "conv").where("depth > head").select("conv", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "digest", "bytes")
    return first.unionByName(rest), known.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))


def owners(probes: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """probes with the owner of the node of their digest. Nodes that a HOT-th of all prefixes share are at most HOT, and broadcast; a probe of one of them doesn't meet in the join of the others."""
    many = F.col("n") >= max(2, total / HOT)
    hot = F.broadcast(nodes.where(many).select(*DIGEST, F.col("owner").alias("hot_owner")))
    rest = nodes.where(~many).select(*DIGEST, "owner", F.lit(None).cast("long").alias("apart"))
    p = probes.join(hot, DIGEST, "left")
    key = F.when(p.hot_owner.isNull(), F.lit(-1)).otherwise(F.pmod(F.col("conv"), F.lit(1 << 20))).cast("long")
    found = p.withColumn("apart", key).join(rest.withColumn("apart", F.lit(-1).cast("long")), [*DIGEST, "apart"], "left")
    return found.select(*probes.columns, F.coalesce("owner", "hot_owner").alias("owner"))


def first_owned(prefixes: DataFrame, nodes: DataFrame, lengths: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """conv, length, first (the smallest depth whose node the conversation owns; length + 1: none), above (the owner one depth higher) by binary search; and what is stored for it."""
    longest, total = lengths.agg(F.max("length")).first()[0] or 0, prefixes.count()
    state = lengths.select("conv", "length", F.lit(-1).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.lit(None).cast("long").alias("above"))
    done, stored = [], []
    for _ in range(max(1, math.ceil(math.log2(longest + 2)))):
        probes = state.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2)).join(prefixes.select("conv", *DIGEST), ["conv", "depth"])
        own = F.col("owner") == F.col("conv")
        asked = owners(probes, nodes, total)
        state = asked.select("conv", "length", F.when(own, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = materialise(state, "search")
        stored.append(state)
        done.append(state.where("high - low <= 1"))
        state = state.where("high - low > 1")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select("conv", "length", F.col("high").alias("first"), "above"), stored


@tidied
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: the ids of each node in pieces of text, with the first id of each."""
    for b in batches:
        if not b.num_rows:
            continue
        owner, depth, conv = (b.column(c).to_numpy() for c in ("owner", "depth", "conv"))
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])])
        new[::IDS] = True
        cuts = np.flatnonzero(new)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(cuts, len(conv)), pa.int64()), b.column("conv").cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(owner[cuts]), pa.array(depth[cuts]), pa.array(conv[cuts]), pc.binary_join(lists, ",").cast(pa.string())], ["owner", "depth", "first_id", "ids"])


@tidied
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which follow one another, joined by commas; one piece is held at a time."""
    at, sha, done = None, None, ([], [], [])

    def close() -> None:
        if at is not None:
            for column, x in zip(done, (*at, sha.hexdigest()), strict=True):
                column.append(x)

    for b in batches:
        for owner, depth, ids in zip(b.column("owner").to_pylist(), b.column("depth").to_pylist(), b.column("ids"), strict=True):
            raw = ids.as_buffer()
            if (owner, depth) == at:
                sha.update(b",")
                sha.update(raw)
            else:
                close()
                at, sha = (owner, depth), hashlib.sha256(raw)
        if len(done[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1]), pa.array(done[2])], ["owner", "depth", "ends_sha256"])
            done = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], ["owner", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of rows (owner, depth, conv): ids in ascending order, joined by commas."""
    pieces = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv").mapInArrow(_pieces, "owner long, depth long, first_id long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first_id").mapInArrow(_hashes, "owner long, depth long, ends_sha256 string")


def trie(turn_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of conversations: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. turn_rows: conv, depth (from 1, without gaps), digest, bytes; lengths: conv, length of all conversations, those without turns too."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "digest").alias(f"sum{seed}") for seed in (1, 2)]
    summed, stored = running(turn_rows.select("conv", "depth", *hashes, "bytes"), "conv", ["depth"], ["sum1", "sum2"], "turn-sums")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv", zero.alias("depth"), zero.alias("sum1"), zero.alias("sum2"), zero.alias("bytes"))
    prefixes = materialise(summed.unionByName(roots), "prefixes")
    discard(stored)
    nodes = materialise(prefixes.groupBy(*DIGEST).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "nodes")
    found, searched = first_owned(prefixes, nodes, lengths)
    found = materialise(found, "first-owned")
    discard(*searched)
    chains = found.where("first <= length")
    # what is known of single nodes by their owner: a chain's top and bottom, and the chains that hang there
    null, no = F.lit(None).cast("long"), F.lit(0)
    marks = chains.select(F.col("conv").alias("owner"), F.col("first").alias("depth"), F.lit(1).alias("top"), no.alias("bottom"), no.alias("hung"), "above")
    marks = marks.unionByName(chains.select(F.col("conv").alias("owner"), F.col("length").alias("depth"), no.alias("top"), F.lit(1).alias("bottom"), no.alias("hung"), null.alias("above")))
    marks = marks.unionByName(chains.where("first > 0").select(F.col("above").alias("owner"), (F.col("first") - 1).alias("depth"), no.alias("top"), no.alias("bottom"), F.lit(1).alias("hung"), null.alias("above")))
    marks = marks.groupBy("owner", "depth").agg(F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.sum("hung").alias("hung"), F.max("above").alias("above"))
    known = nodes.join(marks, ["owner", "depth"], "left").select("owner", *DIGEST, "n", F.coalesce("top", no).alias("top"), F.coalesce("bottom", no).alias("bottom"), F.coalesce("hung", zero).alias("hung"), "above", ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    known = known.withColumn("leaves", ((F.col("bottom") == 1) & (F.col("hung") == 0)).cast("long"))
    own, stored = running(known, "owner", [F.desc("depth")], ["saved", "leaves"], "chain-sums")
    own = materialise(own, "chains")
    discard(stored)
    # a chain's sums stand at its top
    tops = own.where("top = 1").select(F.col("owner").alias("conv"), F.col("depth").alias("first"), F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))
    given = prefixes.join(tops, "conv").where("depth < first").groupBy(*DIGEST).agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    ends = found.select(F.when(F.col("first") <= F.col("length"), F.col("conv")).otherwise(F.col("above")).alias("owner"), F.col("length").alias("depth"), "conv")
    out = own.join(given, DIGEST, "left").join(ends_digests(ends), ["owner", "depth"], "left")
    parent = F.when(F.col("top") == 1, F.col("above")).otherwise(F.col("owner"))
    out = out.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("hung") + 1 - F.col("bottom")).alias("n_children"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    result = materialise(out, "trie")
    discard(prefixes, nodes, found, own)
    return result


def rebuilt_trie(conversations: DataFrame, base: Column, most: int, head: Column) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) that start with the first turns of another; see rebuilt(). base and head are made of the column conv."""
    own, stored = running(turns(conversations).withColumn("depth", F.lit(1).cast("long")), "conv", [F.col("turn").asc_nulls_first(), "digest", "rid"], ["depth"], "turns")
    rows, lengths = rebuilt(own.select("conv", "depth", "digest", "bytes"), base, most, head)
    lengths = materialise(lengths, "lengths")
    result = trie(rows, lengths)
    discard(stored, lengths)
    return result
