"""MinHash near-duplicates by an inverted join of signature coordinates (operator 9).

Every text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of K minima. Equal sets are one
class. A class is posted under its (coordinate, value) pairs. A pair of sets with Jaccard similarity of `percent` or
more agrees in at least `matches` of the K coordinates (but for two pairs in a million at 85 and 40, and one at 80
and 35, if the similarity is no higher than that, fewer above), so of each class only a prefix of its postings, rarest first, has to be joined: values
that no other class has come first and need no posting, and a class with fewer than `matches` shared values has no
partner at all.

A posting list isn't expanded into all pairs. First each list's hub, the member whose values most others share (of
equals the smallest), is compared with the other members: collisions are counted on the stored signatures, and texts are read only of pairs above the match threshold,
to be confirmed on full sets; a hub of many members is sent once for each CHUNK of them. So a group of copies costs a
pair or a few a member. Lists whose members then are in several components are dealt into pairs of blocks of bounded
size, but for pairs of blocks within one component; there the postings of both blocks are merged, values that only one has being skipped, and the collisions of each
pair of different components counted; a pair with several lists in common counts in that of the smallest key. Texts
follow only of members with a pair above the threshold; such pairs are confirmed where the blocks are, and only links
that join components leave them.

Defined results: null and empty texts and texts without words have no shingles, link with nothing and are their own
component; a text of fewer than five words has one shingle, the whole sequence. Texts of any length are taken whole.
A component is named by its smallest doc_id (null only if it has no other); repeated rows are of one class. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import side_files
from .common import bounded, discard, flat, gathered, hashed, materialise, mixed, numbered, powers, scan_parts, spread, tidied, words
from .components import components
from .side_files import Side

K, MATCHES, WORDS, PERCENT, BLOCK, CHUNK = 64, 40, 5, 85, 256, 256
_rng = np.random.default_rng(9)
MULTIPLIERS = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2)
BASE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    offsets, codes, dictionary = words(column)
    w = hashed(dictionary)[codes]
    n = max(0, len(w) - WORDS + 1)
    rolling = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(WORDS, BASE)):
        rolling += w[j : j + n] * p
    rolling = mixed(rolling)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolling[a : b - WORDS + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w[a:b]:
                h = mixed((h * BASE + x)[None])[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Of each coordinate 32 bits that stand for the least hash: whole hashes are compared, so that chance agreements stay rare however many texts there are."""
    low = np.full(K, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[at : at + 1024, None] ^ OFFSETS) * MULTIPLIERS).min(axis=0), out=low)
    return (mixed(low) >> np.uint64(32)).astype(np.uint32)


def signs_of(column: pa.Array) -> np.ndarray:
    """Stored signatures as rows of K numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


@tidied
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for t in gathered(batches, limit=2 << 20):
            sets = shingle_sets(flat(t["text"]))
            names, signs = [], []
            for s in sets:
                twice = [int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(seed)))) if len(s) else 0 for seed in (0x51, 0xA7C3)]
                names.append(np.array([*twice, len(s)], np.uint64).tobytes())
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([flat(t["rid"]), flat(t["doc_id"]), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())], ["rid", "doc_id", "n_shingles", "set_name", "signature"])


def keys_of(signs: np.ndarray) -> np.ndarray:
    """The name of each (coordinate, value) pair of signatures."""
    return mixed(signs.astype(np.uint64) | (np.arange(K, dtype=np.uint64) << np.uint64(32))[None, :]).view(np.int64)


@tidied
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(signs_of(part.column("signature"))).reshape(-1)), pa.array(np.repeat(part.column("cid").to_numpy(), K))], ["key", "cid"])


@tidied
def _agreeing(matches: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree in `matches` coordinates at least."""
    for b in batches:
        if b.num_rows:
            good = (signs_of(b.column("sign_a")) == signs_of(b.column("sign_b"))).sum(axis=1) >= matches
            yield b.select(["a", "b"]).filter(pa.array(good))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@tidied
def _sent(columns: list[str], folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a scan's texts those that are asked for, once for each place they go to."""
    side = Side(folder)
    for b in batches:
        if b.num_rows:
            doc, *to = side.of(b.column("rid").to_numpy(), *columns)
            for at in range(0, len(doc), 500):
                mine = slice(at, at + 500)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[mine]) for x in to), pa.array(b.column("rid").to_numpy()[doc[mine]]), b.column("text").take(pa.array(doc[mine]))], [*columns, "cid", "text"])


def sent(texts_: DataFrame, to: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows of `to` (longs and bytes, with the row number of a text as rid) with that text, and the folder that they are read from; no other text leaves its partition."""
    columns = [f for f in to.schema.fields if f.name != "rid"]
    folder = side_files.write(to, texts_, label)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    return texts_.mapInArrow(partial(_sent, [f.name for f in columns], folder), f"{kinds}, cid long, text string"), folder


@tidied
def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, chunk), the hub before its members: the pairs that are similar on full sets."""
    with np.errstate(over="ignore"):
        now, held = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets, linked = shingle_sets(part.column("text")), []
                for i, (a, chunk, cid) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "chunk", "cid")), strict=True)):
                    if (a, chunk) != now:
                        now, held = (a, chunk), sets[i]
                        if a != cid:
                            raise RuntimeError("a hub's text is missing")
                    linked.append(a != cid and similar(held, sets[i], percent))
                out = part.filter(pa.array(linked, pa.bool_()))
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("cid")], ["a", "b"])


def listed(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of a block of signatures: keys, and the row of each."""
    return keys_of(signs).reshape(-1), np.repeat(np.arange(len(signs)), K)


def collisions(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many keys each row of one block shares with each row of the other: their postings (keys, rows) are merged in order of key, and keys of one block only are skipped."""
    counts = np.zeros(shape[0] * shape[1], np.int32)
    (left_keys, left), (right_keys, right) = ((k[order], rows[order]) for k, rows in (one, two) for order in [np.argsort(k, kind="stable")])
    names, start, n = np.unique(left_keys, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(right_keys, names), np.searchsorted(right_keys, names, "right")
    met = np.flatnonzero(hi > lo)
    for at in range(0, len(met), 64):  # a key gives at most a block's square of pairs
        some = met[at : at + 64]
        mine = spread(start[some], n[some])
        width, first = np.repeat(hi[some] - lo[some], n[some]), np.repeat(lo[some], n[some])
        counts += np.bincount(np.repeat(left[mine], width) * shape[1] + right[spread(first, width)], minlength=len(counts)).astype(np.int32)
    return counts.reshape(shape)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of equal (key, lo, hi)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        names = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            name = tuple(names[a].tolist())
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(t: pa.Table, matches: int) -> np.ndarray:
    """Pairs of rows of a group that lie in its two blocks, in different components, agree in `matches` coordinates, and have no list of a smaller key in common, where they would be compared too."""
    block, lo, hi, comp, key = (t[c].to_numpy() for c in ("block", "lo", "hi", "comp", "key"))
    signs, lists = signs_of(flat(t["signature"])), flat(t["keys"])
    owner, keys = np.repeat(np.arange(len(t)), np.diff(np.asarray(lists.offsets))), lists.flatten().to_numpy()
    owner, keys = owner[keys < key[0]], keys[keys < key[0]]
    one, two = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    place = np.zeros(len(t), np.int64)
    smaller = []
    for rows in (one, two):
        place[rows] = np.arange(len(rows))
        inside = np.isin(owner, rows)
        smaller.append((keys[inside], place[owner[inside]]))
    shape = (len(one), len(two))
    good = (collisions(listed(signs[one]), listed(signs[two]), shape) >= matches) & (comp[one][:, None] != comp[two][None, :])
    if lo[0] == hi[0]:
        good = np.triu(good, 1)
    if good.any():
        good &= collisions(*smaller, shape) == 0
    i, j = np.nonzero(good)
    return np.stack([one[i], two[j]], axis=1)


@tidied
def _suspects(matches: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of groups that have a pair to confirm, with the places (16 bits, in order of cid) of their partners among them."""
    with np.errstate(over="ignore"):
        for t in _groups(batches):
            pairs = _pairs(t, matches)
            if len(pairs):
                rows, at = np.unique(pairs, return_inverse=True)
                at = at.reshape(pairs.shape)
                order = np.argsort(at[:, 0], kind="stable")
                ends = np.searchsorted(at[order, 0], np.arange(len(rows) + 1))
                partners = [at[order[a:z], 1].astype("<u2").tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out = t.select(["key", "lo", "hi", "comp", "cid"]).take(pa.array(rows)).append_column("partners", pa.array(partners, pa.binary()))
                yield out.combine_chunks().to_batches()[0]


@tidied
def _spanning(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the links between components, as many as join them: its pairs are confirmed on full sets unless they are joined already."""
    with np.errstate(over="ignore"):
        for t in _groups(batches):
            sets = shingle_sets(flat(t["text"]))
            cid, comp = t["cid"].to_pylist(), t["comp"].to_pylist()
            up = {c: c for c in comp}

            def top(c: int, up=up) -> int:
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            out = []
            for i, partners in enumerate(t["partners"].to_pylist()):
                for j in np.frombuffer(partners, "<u2").tolist():
                    x, y = top(comp[i]), top(comp[j])
                    if x != y and similar(sets[i], sets[j], percent):
                        up[max(x, y)] = min(x, y)
                        out.append((cid[i], cid[j]))
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _placed(member: DataFrame) -> DataFrame:
    """key, lo, hi, block and all columns of `member` (key, cid, comp and others): each row once for each pair of blocks that it is compared in. A component with BLOCK members or more in a list has blocks of its own, which are not compared with one another, as their members are joined already; the members of the others share blocks. So a list of one large component and a few members outside it costs the members times the blocks outside, not its square."""
    sizes = materialise(member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")), "sizes")
    owner = F.when(F.col("m") >= BLOCK, F.col("comp")).otherwise(F.lit(-1))
    owned = sizes.groupBy(F.col("key").alias("k"), owner.alias("owner")).agg(F.ceil(F.sum("m") / F.lit(BLOCK)).alias("blocks"))
    blocks = owned.select("k", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    named = F.struct(F.col("owner").alias("o"), F.xxhash64("owner", "i").alias("b"))
    of_list = blocks.groupBy("k").agg(F.collect_list(named).alias("others"))  # one for BLOCK members of a list
    own = owned.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("owner", "blocks"))).alias("widths"))
    layout = materialise(of_list.join(own, "k"), "layout")
    mine = F.coalesce(F.when(F.map_contains_key("widths", F.col("comp")), F.col("comp")), F.lit(-1))
    rows = member.join(layout, F.col("key") == F.col("k")).withColumn("owner", mine)
    rows = rows.withColumn("block", F.xxhash64("owner", F.pmod(F.xxhash64("cid"), F.element_at("widths", F.col("owner")))))
    met = F.filter("others", lambda x: (x.o != F.col("owner")) | ((x.o == -1) & (F.col("owner") == -1)))
    rows = rows.withColumn("other", F.explode(F.transform(met, lambda x: x.b)))
    out = materialise(rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *(c for c in member.columns if c != "key")), "placed")
    discard(sizes, layout)
    return out


def _rest(lists: DataFrame, comps: DataFrame, signs: DataFrame, texts_: DataFrame, percent: int, matches: int) -> DataFrame | None:
    """a, b: links that the hubs didn't show, from the lists whose members are in several components still; None: there are no such lists. Lists of the same members count once. A list is dealt into blocks, and each pair of blocks is compared in one place."""
    parts = scan_parts(texts_)
    now = materialise(lists.join(comps, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("root", "cid").alias("comp")), "members")
    of_list = now.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("name"))
    open_lists = materialise(of_list.where("first < last").groupBy("n", "name").agg(F.min("key").alias("open_key")), "open")
    if open_lists.isEmpty():
        discard(now, open_lists)
        return None
    member = materialise(now.join(open_lists, F.col("key") == F.col("open_key")).select("key", "cid", "comp"), "open-members")
    own = member.groupBy(F.col("cid").alias("c")).agg(F.collect_list("key").alias("keys"))  # at most K of a class
    known = materialise(own.join(signs, F.col("c") == F.col("cid")).select("c", "signature", "keys"), "known")
    placed = _placed(member.join(known, F.col("cid") == F.col("c")).select("key", "cid", "comp", "signature", "keys"))
    dealt = placed.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")
    suspects = materialise(dealt.mapInArrow(partial(_suspects, matches), "key long, lo long, hi long, comp long, cid long, partners binary"), "suspects")
    discard(now, open_lists, member, known, placed)
    told, folder = sent(texts_, suspects.withColumnRenamed("cid", "rid"), "suspect-files")
    dealt = told.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")
    more = materialise(dealt.mapInArrow(partial(_spanning, percent), "a long, b long"), "more-links")
    discard(suspects, folder)
    return more


def links(classes: DataFrame, texts_: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame | None:
    """node, root of classes (cid, signature) that have links; texts_ is the scan of texts by rid. None: no class can have any."""
    signs = classes.select("cid", "signature")
    postings = materialise(signs.mapInArrow(_postings, "key long, cid long"), "postings")
    several = materialise(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n"), "several")
    shared = materialise(postings.join(several, F.col("key") == F.col("k")).select("key", "cid", "n"), "shared-postings")
    discard(postings, several)
    # a class's postings, at most K, rarest first; values of its own stand before them all
    of_class = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all")).where(F.size("all") >= matches)
    # the more others share a class's values, the likelier it is what they are copies of
    of_class = of_class.withColumn("met", F.aggregate("all", F.lit(0).cast("long"), lambda total, x: total + x.n))
    prefix = of_class.select("cid", "met", F.explode(F.expr(f"slice(all, 1, size(all) - {matches} + 1)")).alias("p")).select(F.col("p.key").alias("key"), "cid", "met")
    prefix = materialise(prefix, "prefix")
    top = F.max(F.struct("met", (-F.col("cid")).alias("last"))).alias("top")
    hubs = materialise(prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n"), top).where("n > 1").select(F.col("key").alias("k"), (-F.col("top.last")).alias("hub")), "hubs")
    lists = materialise(prefix.join(hubs, F.col("key") == F.col("k")).select("key", "hub", "cid"), "lists")
    discard(shared, prefix, hubs)
    if lists.isEmpty():
        discard(lists)
        return None
    pairs = materialise(lists.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    of = lambda x: signs.select(F.col("cid").alias(f"of_{x}"), F.col("signature").alias(f"sign_{x}"))
    both = pairs.join(of("b"), F.col("b") == F.col("of_b")).select("a", "b", "sign_b")
    both = both.join(of("a"), F.col("a") == F.col("of_a")).select("a", "b", "sign_a", "sign_b")
    near = materialise(both.mapInArrow(partial(_agreeing, matches), "a long, b long"), "near")
    hubs = materialise(near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("chunks")).withColumnRenamed("a", "hub"), "near-hubs")
    chunk = F.pmod(F.xxhash64("b"), F.col("chunks"))
    to = near.join(hubs, F.col("a") == F.col("hub")).select("a", chunk.alias("chunk"), F.col("b").alias("rid"))
    to = to.unionByName(hubs.select(F.col("hub").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("rid")))
    told, folder = sent(texts_, to, "pair-files")
    order = told.repartition(scan_parts(texts_), "a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("cid"), "cid")
    linked = materialise(order.mapInArrow(partial(_confirm, percent), "a long, b long"), "links")
    discard(pairs, near, hubs, folder)
    comps = components(linked)
    more = _rest(lists.drop("hub"), comps, signs, texts_, percent, matches)
    discard(linked, lists)
    if more is None:
        return comps
    if not more.isEmpty():
        first, comps = comps, components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
        discard(first)
    discard(more)
    return comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept, first of each row. Sets of `percent` or more similarity are linked. kept: the row has its component's doc_id; first: true of one row of each component, whatever doc_ids repeat (rid: see numbered())."""
    rows = numbered(bounded(docs)).select("rid", F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts_ = rows.select("rid", "text")
    signed = materialise(rows.mapInArrow(_signatures, "rid long, doc_id long, n_shingles long, set_name binary, signature binary"), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid"))
    classes = materialise(signed.where("n_shingles > 0").groupBy("set_name").agg(best.alias("best"), F.min("rid").alias("cid"), F.any_value("signature").alias("signature")), "classes")
    comps = links(classes.select("cid", "signature"), texts_, percent, matches)
    named, stored = classes.select("set_name", "cid", "best"), [signed, classes]
    if comps is None:
        named = named.select("set_name", F.col("best").alias("top"))
    else:
        tops = materialise(named.join(comps, F.col("cid") == F.col("node")).groupBy("root").agg(F.min("best").alias("top")).withColumnRenamed("root", "r"), "tops")
        roots = materialise(comps.join(tops, F.col("root") == F.col("r")).select("node", "top"), "roots")
        named = named.join(roots, F.col("cid") == F.col("node"), "left").select("set_name", F.coalesce("top", "best").alias("top"))
        stored += [comps, tops, roots]
    named = materialise(named, "named")
    out = signed.select("rid", "doc_id", "n_shingles", "set_name").join(named, "set_name", "left")
    out = out.withColumn("component_id", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")))
    out = out.select("rid", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("first"))
    out = materialise(out, "near-duplicates")
    discard(named, *stored)
    return out
