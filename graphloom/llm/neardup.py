"""Operator 2: near-duplicates by MinHash bands and sequential Bayesian verification.

1. Texts with the same set of shingles form a class, named by a digest of the set.
2. Classes meet in buckets of signature bands (28 of 5 rows: a pair at similarity 0.85 shares none
   with odds of 8e-8; the pipeline's stage takes 40 bands, which give 1e-7 at 0.8).
3. A bucket's smallest members (1, 4, 16, ... as the rounds go) are its hubs, those of its largest component first.
   Kernels compare members with hubs, so pairs never become rows unless they look similar: signatures (low bytes
   of 384 minima) are compared a batch at a time and a pair goes when the posterior odds of
   reaching the threshold (uniform prior) fall under ``MISS``.
4. What survives is verified on the full sets, and links join classes into components.
5. Buckets whose members share a component are settled; hubs, which met everyone, leave.  Rounds
   end when no bucket is open, so every pair of a bucket was compared or is connected already.

A large bucket is dealt over tasks by a salt; its hubs go to each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, release, text_groups
from graphloom.llm.components import components
from graphloom.llm.shingles import MinHash, band_keys, set_key, shingle_list, shingle_lists

#: Odds of dropping a linked pair at each of the twelve looks at its signatures.
MISS = 1e-7
BATCH = 32
HASHES = 384
GROWTH = 4
SALT_ROWS = 4096
PAIRS = 200_000
#: Characters of texts that are worked on together.
GROUP_CHARS = 1 << 21


def least_matches(threshold: float, hashes: int, miss: float) -> list[tuple[int, int]]:
    """After n compared values, the least number of matches that keeps a pair.  With a uniform prior,
    the posterior odds of similarity >= t after m matches of n are P(Bin(n+1, t) <= m).  Bytes
    also agree by chance, which lifts the threshold."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        out.append((n, m))
    return out


def _fingerprints(df: DataFrame, kind: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, n, node, sig, heads``: size and digest of the set, low bytes of the minima, 32 bits of each band's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(max(HASHES, bands * rows))
        for b in batches:
            for lo, texts in text_groups(b.column(1), GROUP_CHARS):
                part = b.slice(lo, len(texts))
                lists = shingle_lists([(t or "").encode() for t in texts], shingle)
                minima = family.signatures(lists)
                keys = band_keys(minima, bands, rows)
                sets = [np.unique(x) for x in lists]
                low = minima[:, :HASHES].astype(np.uint8)
                columns = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in low], pa.binary()),
                    pa.array(list(keys.astype(np.uint32).view(np.int32)), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n", "node", "sig", "heads"])

    return df.mapInArrow(run, f"id {kind}, n long, node binary, sig binary, heads array<int>")


def _promising(met: DataFrame, threshold: float, first_only: bool) -> DataFrame:
    """``hub, node`` of the pairs that signatures don't rule out.  ``met``: ``key, salt, member, band, node, comp,
    sig, heads, leads``, each (key, salt) with its hubs (member false) before its members; ``leads``: the bands in whose
    buckets a hub is one.  A pair that shares several bands comes from one of them alone: the first in which the
    hub is one (if the smallest are hubs), or if ``first_only``, the first of all: its bucket there stays open until one of
    the pair was a hub, or both are connected."""
    steps = least_matches(threshold, HASHES, MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[bytes] = []
        comps: list[bytes] = []
        sigs: list[bytes] = []
        heads: list[list[int]] = []
        leads: list[list[int] | None] = []
        band_of: list[int] = []
        both: list[bool] = []  # members that are hubs of their bucket as well
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        waiting = 0
        group, hubs, members, names = None, [], [], set()

        def close() -> None:
            """Pairs of the group's hubs with the members met so far."""
            nonlocal waiting, members
            if hubs and members:
                h, m = np.array(hubs), np.array(members)
                left.append(np.repeat(h, len(m)))
                right.append(np.tile(m, len(h)))
                waiting += len(h) * len(m)
            members = []

        def test() -> pa.RecordBatch:
            i, j = np.concatenate(left), np.concatenate(right)
            name = np.frombuffer(b"".join(nodes), ">u8").reshape(-1, 2)
            part = np.frombuffer(b"".join(comps), ">u8").reshape(-1, 2)
            x = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, HASHES)
            before = ~np.array(both)[j] | (name[i, 0] < name[j, 0]) | ((name[i, 0] == name[j, 0]) & (name[i, 1] < name[j, 1]))
            apart = (part[i] != part[j]).any(axis=1)
            i, j = i[before & apart], j[before & apart]
            matches, done = np.zeros(len(i), np.int64), 0
            for n, least in steps:
                matches += (x[i, done:n] == x[j, done:n]).sum(axis=1)
                keep = matches >= least
                i, j, matches, done = i[keep], j[keep], matches[keep], n
            head = np.array(heads, np.int32)
            shared = head[i] == head[j]
            if not first_only:
                led = np.zeros(head.shape, bool)
                for k in np.unique(i):
                    led[k, leads[k]] = True
                shared &= led[i]
            own = shared.argmax(axis=1) == np.array(band_of)[j]
            i, j = i[own], j[own]
            out = pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in i], pa.binary()), pa.array([nodes[k] for k in j], pa.binary())], names=["hub", "node"])
            return out

        def drop() -> None:
            """Forgets all rows but the open group's hubs."""
            nonlocal nodes, comps, sigs, heads, leads, band_of, both, left, right, waiting, hubs
            nodes, comps, sigs, heads, leads, band_of, both = ([v[k] for k in hubs] for v in (nodes, comps, sigs, heads, leads, band_of, both))
            hubs, left, right, waiting = list(range(len(hubs))), [], [], 0

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for key, salt, member, band, node, comp, sig, head, lead in zip(*columns, strict=True):
                if (key, salt) != group:
                    close()
                    group, hubs, names = (key, salt), [], set()
                    if waiting >= PAIRS or len(nodes) >= PAIRS // 8:
                        if left:
                            yield test()
                        drop()
                elif member and len(members) * max(1, len(hubs)) >= PAIRS:
                    close()
                    yield test()
                    drop()
                (members if member else hubs).append(len(nodes))
                if not member:
                    names.add(node)
                both.append(node in names)
                nodes.append(node)
                comps.append(comp)
                sigs.append(sig)
                heads.append(head)
                leads.append(lead)
                band_of.append(band)
        close()
        if left:
            yield test()

    return met.select("key", "salt", "member", "band", "node", "comp", "sig", "heads", "leads").mapInArrow(run, "hub binary, node binary")


def _linked(pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs whose full sets reach the threshold; rows of a hub stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_set = None, None
        for b in batches:
            hubs, nodes, hub_texts, texts = (c.to_pylist() for c in b.columns)
            keep = []
            for i, (hub, node) in enumerate(zip(hubs, nodes, strict=True)):
                if hub != last_key:
                    last_key, last_set = hub, np.unique(shingle_list((hub_texts[i] or "").encode(), shingle))
                other = np.unique(shingle_list((texts[i] or "").encode(), shingle))
                # a row that only shares its id with another text has another key
                if set_key(last_set) != hub or set_key(other) != node:
                    last_key = None if set_key(last_set) != hub else last_key
                    continue
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * both >= percent * (len(last_set) + len(other) - both):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    return (
        pairs.select("hub", "node", "hub_text", "text")
        .sortWithinPartitions("hub")
        .mapInArrow(run, "hub binary, node binary")
    )


def near_duplicates(
    df: DataFrame,
    percent: int = 80,
    shingle: int = 5,
    bands: int = 40,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles long, component_id, kept boolean`` for every row of ``df``.

    Rows are linked when 100 * intersection >= ``percent`` * union of their sets of ``shingle``
    words (see ``shingles``); ``component_id`` is the smallest id reachable, ``kept`` tells
    whether it is the row's own.  Null or empty text and text without words: no shingles, not
    linked, kept.  Rows without an id are kept and link with nothing.  Repeated rows belong to
    the same component and agree on ``kept``.  Other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = df.sparkSession
    prints = cut(_fingerprints(docs, kind, shingle, bands, rows))
    usable = prints.where("n > 0 and id is not null")
    classes = cut(usable.groupBy("node").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("heads").alias("heads")))
    owners = cut(prints.select("id", "n", "node"))  # the wide columns are kept once for each class
    del prints, usable
    release(spark)
    # 32 bits of a key and the band's number; what they bring together by chance, the signatures tell apart
    keyed = classes.select("node", F.transform("heads", lambda h, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("keys"))
    banded = keyed.select("node", F.explode("keys").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    # one row a class, with the keys of the buckets that it is in
    state = cut(banded.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys")).select("node", F.col("node").alias("comp"), "keys"))
    del keyed, banded, shared
    release(spark)
    cand = state.select("node")
    sigs = cut(classes.select("node", "rep", "sig", "heads").join(cand, "node"))
    named = cut(classes.select("node", "rep"))
    del classes, cand
    release(spark)
    texts = cut(
        sigs.select("node", "rep").join(docs.where("id is not null"), F.col("rep") == F.col("id"))
        .select("node", "text", F.md5("text").alias("digest"))
        .dropDuplicates(["node", "digest"])
        .drop("digest")
    )
    release(spark)
    comps, hubs = None, 1
    while True:
        rows = state.select("node", "comp", F.explode("keys").alias("key"))
        # members of a bucket's largest component come first as hubs: they only meet those that are not connected to it
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m"), F.min_by("comp", F.struct(-F.col("m"), "comp")).alias("main"))
        keys = keys.where("comps > 1").select("key", "main", F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("salts"))
        opened = cut(rows.join(keys, "key").select("key", "node", "comp", "salts", (F.col("comp") != F.col("main")).alias("aside")))
        if opened.isEmpty():
            break
        order = Window.partitionBy("key").orderBy("aside", "node")
        chosen = cut(opened.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs).drop("place", "aside"))
        salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
        # a class meets its signature once and then goes to its buckets
        wide = sigs.select("node", "sig", "heads")
        of = opened.groupBy("node").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("key", "salts")).alias("of"))
        members = of.join(wide, "node").select("node", "comp", "sig", "heads", F.explode("of").alias("of")).select("node", "comp", "sig", "heads", "of.key", "of.salts")
        members = members.withColumns({"salt": salt, "member": F.lit(True), "leads": F.lit(None).cast("array<int>")})
        leads = chosen.groupBy("node").agg(F.collect_list(F.shiftright("key", 32).cast("int")).alias("leads"))
        copies = chosen.join(wide.join(leads, "node"), "node").withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "member": F.lit(False)})
        met = members.unionByName(copies).withColumn("band", F.shiftright("key", 32).cast("int"))
        met = met.repartition("key", "salt").sortWithinPartitions("key", "salt", "member", "node")
        likely = cut(_promising(met, percent / 100, hubs > 1).distinct())
        hub_texts = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
        found = _linked(likely.join(texts, "node").join(hub_texts, "hub"), percent, shingle)
        links = found.select(F.col("hub").alias("a"), F.col("node").alias("b"))
        # earlier links count as what they connected
        links = cut(links if comps is None else links.union(comps.where("node <> component").select("node", "component")))
        comps = cut(components(links))
        # hubs met everyone and leave; classes go on with what they are connected to by now
        gone = chosen.groupBy("node").agg(F.collect_list("key").alias("gone"))
        state = opened.groupBy("node").agg(F.collect_list("key").alias("keys")).join(gone, "node", "left").join(comps, "node", "left")
        state = cut(state.select("node", F.coalesce("component", "node").alias("comp"), F.array_except("keys", F.coalesce("gone", F.array().cast("array<bigint>"))).alias("keys")))
        hubs *= GROWTH
        del rows, sizes, keys, opened, chosen, wide, of, members, leads, copies, met, likely, found, links, gone
        release(spark)
    if comps is not None:
        labels = named.join(comps, "node")
        least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
        least = labels.join(least, "component").select("node", "component_id")
        named = named.join(least, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    else:
        named = named.withColumnRenamed("rep", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (
        owners.join(named, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce(own, F.col("id"))).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
