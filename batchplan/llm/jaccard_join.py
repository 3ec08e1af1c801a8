"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle.

Sets are grouped into size bands; sets that can link lie in one band or in neighbouring ones. For each band the universe of
tokens is hashed into m segments, x of which also index their one-deletion neighbourhoods. Two sets that link differ in at
most H tokens, so with m + x > H some plain segment is equal or some neighbourhood segment differs by at most one token. m and x are chosen
for each band by cost: rows to index against unrelated sets expected to meet in empty segments.

Sets that link meet in at least as many segments as their sizes say, which is more than one for most sizes. A set that meets others in fewer
is done. Of such a number t each set may leave out the t - 1 buckets that come last in one order of all buckets: those that two sets leave
out together are at most as many as one of them leaves out, so sets that link still meet. What goes is the crowded buckets, in which unrelated sets meet by
empty segments or by frequent tokens, and whose pairs grow with the square of the input.

Only components are asked for, so the sets that meet in a segment are not all compared. Equal sets are one class. Each member is
first verified against the heaviest of its hubs, the members of its buckets that meet most others. Of what that leaves in different
components, the members of an ordinary bucket are paired; sets of their sizes that link meet in a known least number of segments,
which most pairs that met by chance do not reach, and bitmaps refuse nearly all others before any set is sent. The members
of a large bucket are verified against every hub, then against a second one. Two members x, y that remain apart have known differences
D from the hub, and |x ^ y| = |Dx ^ Dy|, so they can link only if Dx and Dy overlap by a computable least number of tokens: a prefix
join on the differences finds every such pair, and these are verified exactly. So a bucket costs its size times a constant, whatever its size. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchplan.llm.components import components
from batchplan.llm.shingles import identity, mix, shingle_set
from batchplan.llm.spark_io import freeing, settled, written

_U = np.uint64
#: Rows of signatures that a task sorts at a time, and members of one bucket among them beyond which they are dealt apart.
BUFFER, CROWD, SALTS = 750_000, 64, 64
#: Least bytes of a set's parity bitmap, and members of a bucket up to which it is compared pair by pair instead of by differences: half as many
#: rows of two keys for a member cost about what its set and the prefix of its differences do.
BITMAP, PAIRWISE = 256, 256
#: Members of a bucket beyond which sets leave it out if they may, and segments beyond what is needed, so that they may.
LEAVE_OUT, SPARE = 16, 3
#: Ids of candidate documents, and pairs (some 60 bytes each), are sent to every task up to so many; beyond it text and sets are shuffled.
MOST_BROADCAST, MOST_PAIRS = 1_000_000, 300_000
#: Classes for each file of a frame about them at least, if every core has one; few classes in many partitions would be files of a few rows.
FILE_OF = 1_000


def bands(longest: int, num: int, den: int) -> list[int]:
    """First sizes of the bands 0, 1, ...; a set's partners lie in its band or a neighbouring one."""
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * den // num + 1)
    return out


def _often(mean: float, e: int) -> float:
    """Expected number of empty segments that are signed if up to e of them are left out: those of sets with more, Poisson."""
    term, below = math.exp(-mean), 0.0
    for k in range(1, e + 1):
        term *= mean / k
        below += k * term
    return max(0.0, mean - below)


def allocate(h: int, size: float, n: int) -> tuple[int, int, int]:
    """(m, x, e): segments, how many of them index one-deletion neighbourhoods, and how many empty ones are left out.

    Without neighbourhoods m = h + 1 + e: a set with at most e empty segments does not sign them, as any other set has at most as many
    in common with it and h + 1 segments remain. With them m + x = h + 1 and e = 0. Cost of a set: its index rows, and twenty
    times the (nearly) empty segments that make it meet unrelated ones.
    """
    best = None

    def offer(cost: float, m: int, x: int, e: int) -> None:
        nonlocal best
        if best is None or cost < best[0]:
            best = (cost, m, x, e)

    for e in range(40):
        m = h + 1 + e
        offer(m + 20 * min(1.0, n / 100) * _often(m * math.exp(-size / m), e), m, 0, e)
    for m in range(math.ceil((h + 1) / 2), h + 1):
        x, load = h + 1 - m, size / m
        offer(m + x * load + 20 * min(1.0, n / 100) * math.exp(-load) * (m - x + x * (1 + load)), m, x, 0)
    return best[1:]


def _signatures(s: np.ndarray, scheme: int, m: int, x: int, e: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        where = ((mix(s ^ _U(scheme * 0x9E3779B9 + 1)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        token = mix(s + _U(0x51ED270B))
        order = np.argsort(where, kind="stable")
        where, token = where[order], token[order]
        sums = np.zeros(m, _U)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        sums[where[first]] = np.add.reduceat(token, first)
        key = mix(np.arange(m, dtype=_U) + _U((scheme + 1) << 32))
        out = [mix(sums ^ key)]
        if m - len(first) <= e:  # few enough empty segments
            out = [out[0][where[first]]]
        if x:
            few = where < x
            out.append(mix((sums[where[few]] - token[few]) ^ key[where[few]]))
        return np.unique(np.concatenate(out)) & ~_U(1) | _U(scheme & 1)  # a set has at most two schemes, one after the other


def least_met(n: int, scheme: int, first: list[int], schemes: dict[int, tuple[int, int, int]], num: int, den: int) -> int:
    """In how many segments that it signs a set of n tokens meets any set that it links to by this scheme, at least; with neighbourhoods 1."""
    m, x, e = schemes[scheme]
    last = first[scheme + 1] - 1 if scheme + 1 < len(first) else n * den // num
    return 1 if x else max(1, m - e - (n + min(n * den // num, max(n, last))) * (den - num) // (den + num))


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    n = len(a) + len(b)
    common = n - len(np.unique(np.concatenate((a, b))))
    return den * common >= num * (n - common)


def _bitmap(s: np.ndarray) -> bytes:
    """One bit for each token, flipped by it: two sets differ in at least as many tokens as their bitmaps in bits.

    Four bits or more for each token, so that unrelated sets of any size differ in more bits than linked ones may.
    """
    size = BITMAP
    while 2 * size < len(s):
        size *= 2
    hits = np.bincount((mix(s ^ _U(0x2545F491)) % _U(8 * size)).astype(np.int64), minlength=8 * size)
    return np.packbits((hits & 1).astype(bool)).tobytes()


def _apart_by(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


SETS = "doc_id long, n long, hi long, cid binary"
SIGNED = "sig long, k long, own long"
KEPT = "cid binary, n long, bits binary, tokens binary"
EDGE = "a binary, b binary"
TOKENS = "hub binary, x binary, root binary, n long, d long, inside boolean, token long"


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, files: int | None = None) -> DataFrame:
    """The pairs (a, b) whose sets link. Pairs whose bitmaps differ too much go before whole sets are sent."""
    sides = [[F.col("cid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("bits", "n"))] for c in "ab"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column(4).to_numpy() + b.column(5).to_numpy()) * (den - num) // (den + num)
            ok = [_apart_by(x, y) <= m for x, y, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = pairs.select("a", "b").join(sets.select(*sides[0]), "a").join(sets.select(*sides[1]), "b")
    pairs = written(pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(freeing(near), EDGE), files)
    left, right = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("s")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("t"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(s.as_buffer(), _U), np.frombuffer(t.as_buffer(), _U), num, den) for s, t in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sent = F.broadcast if pairs.count() <= MOST_PAIRS else lambda x: x
    right = right.join(sent(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(sent(pairs), "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(freeing(test), EDGE)


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row for each input row.

    Sets link when den * intersection >= num * union; component_id is the smallest id reachable by links, itself included. Null texts
    and texts without words have the empty set and link with nothing. Repeated rows and rows of equal id are documents
    of their own. A document of null id has the smallest id of its component, null if there is none. Other columns are not
    read; an empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
            cid = [identity(s) if len(s) else None for s in sets]
            yield _batch(SETS, b.column(0), [len(s) for s in sets], [c and int.from_bytes(c[:8], "little", signed=True) for c in cid], cid)

    measured = written(text.mapInArrow(freeing(measure), SETS))
    classes = settled(measured.where("cid is not null").groupBy("cid", "hi").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    sizes = {r.n: r.c for r in classes.groupBy("n").agg(F.count("*").alias("c")).collect()}  # a row for each size of set
    links = _links(text, classes, sizes, width, num, den) if sizes else None
    if links is None:
        return measured.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    roots = components(links)
    rooted = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("cid").alias("c"), "component_id")
    out = measured.join(named, F.col("cid") == F.col("c"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _links(text: DataFrame, classes: DataFrame, sizes: dict[int, int], width: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between classes with the same components as all links."""
    spark = text.sparkSession
    first = bands(max(sizes), num, den)
    band_of = np.searchsorted(np.array(first), np.arange(max(sizes) + 1), "right") - 1
    held = np.zeros(len(first) + 1, np.int64)
    total = np.zeros(len(first) + 1)
    for n, c in sizes.items():
        held[band_of[n]] += c
        total[band_of[n]] += n * c
    schemes = {}
    for j in range(len(first)):
        last = (first[j + 1] if j + 1 < len(first) else first[j] * den // num + 1) - 1
        h = 2 * last * (den - num) // (den + num)
        n = int(held[j] + (held[j - 1] if j else 0))
        if h and n > 1 and held[j]:
            spare = min(SPARE, h // 4)
            schemes[j] = allocate(h + spare, (total[j] + (total[j - 1] if j else 0)) / n, n)
    files = max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // FILE_OF)
    bound = spark.sparkContext.broadcast((band_of, first, schemes))  # a number for each size of set

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_of, first, schemes = bound.value
        parts: list[tuple[np.ndarray, int]] = []
        rows, done = 0, set()

        def flush():
            sig = np.concatenate([p for p, _ in parts])
            k = np.repeat(np.array([k for _, k in parts], np.int64), [len(p) for p, _ in parts])
            order = np.lexsort((k, sig))
            sig, k = sig[order].astype(np.int64), k[order]
            starts = np.flatnonzero(np.diff(sig, prepend=sig[0] - 1 if len(sig) else 0))
            members = np.diff(np.append(starts, len(sig)))
            # Of a crowded bucket the first member goes on for all; the others carry it and are dealt apart.
            own = np.where(np.repeat(members > CROWD, members), np.repeat(k[starts], members), k)
            for at in range(0, len(sig), 200_000):
                yield _batch(SIGNED, sig[at : at + 200_000], k[at : at + 200_000], own[at : at + 200_000])

        for b in batches:
            for t in b.column(1):
                s = shingle_set(t.as_py(), width)
                if not len(s):
                    continue
                k = int.from_bytes(identity(s)[:8], "little", signed=True)
                if k in done:  # a copy met before in this task
                    continue
                if len(done) < 200_000:
                    done.add(k)
                j = int(band_of[len(s)])
                for scheme in (j, j + 1):
                    if scheme in schemes and (scheme == j or len(s) * den // num >= first[scheme]):
                        parts.append((_signatures(s, scheme, *schemes[scheme]), k))
                        rows += len(parts[-1][0])
                if rows >= BUFFER:
                    yield from flush()
                    parts, rows = [], 0
        if parts:
            yield from flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (sig, k): each member with the least member of its bucket, for buckets of two or more."""
        last = hub = None
        for b in batches:
            if not b.num_rows:
                continue
            sig, k, own = (c.to_numpy() for c in b.columns)
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            hubs = k[starts].copy()
            if last is not None and sig[0] == last:
                hubs[0] = hub
            last, hub = sig[-1], hubs[-1]
            hubs = np.repeat(hubs, np.diff(np.append(starts, len(sig))))
            repeated = np.concatenate(([False], (sig[1:] == sig[:-1]) & (k[1:] == k[:-1]) & (own[1:] == own[:-1])))
            keep = (k != hubs) & ~repeated
            far = (own != k) & (own != hubs) & ~repeated
            yield _batch(SIGNED, np.concatenate((sig[keep], sig[far])), np.concatenate((k[keep], k[far])), np.concatenate((hubs[keep], own[far])))

    signed = text.mapInArrow(freeing(sign), SIGNED)
    dealt = signed.repartition(F.xxhash64("sig", F.when(F.col("own") != F.col("k"), F.pmod("k", F.lit(SALTS))).otherwise(-1)))
    buckets = written(dealt.sortWithinPartitions("sig", "k", "own").mapInArrow(freeing(met), SIGNED), files)

    least = [(n, scheme & 1, least_met(n, scheme, first, schemes, num, den)) for n in sizes for scheme in (int(band_of[n]), int(band_of[n]) + 1) if scheme in schemes]
    least = pa.table([pa.array(c, pa.int32()) for c in zip(*least, strict=True)] or [pa.array([], pa.int32())] * 3, names=["n", "odd", "least"])
    members = _able(buckets, classes.select(F.col("hi").alias("k"), "cid", "n"), spark.createDataFrame(least), files)

    # Hubs: of each bucket the member that meets most others.
    members = _crowds(members)
    weights = members.groupBy("cid").agg(F.sum("size").alias("w"))
    members = written(members.join(weights, "cid").select("sig", "cid", "n", "w", "out"), files)
    hubs = members.groupBy("sig").agg(F.max_by(F.struct("cid", "n", "w"), F.struct("w", "cid")).alias("hub"), F.count("*").alias("size"))
    able = F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num
    met_hub = members.join(hubs, "sig").where((F.col("cid") != F.col("hub.cid")) & able)
    starred = written(met_hub.groupBy(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).agg(F.max("hub.w").alias("w"), F.max((F.col("size") > PAIRWISE).cast("int")).alias("large")), files)

    wanted = settled(members.select("cid").distinct())
    reps = wanted.join(classes, "cid").select(F.col("rep").alias("id"), "cid")
    count = wanted.count()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in (shingle_set(t.as_py(), width) for t in b.column(1)) if len(s)]
            yield _batch(KEPT, [identity(s) for s in sets], [len(s) for s in sets], [_bitmap(s) for s in sets], [s.tobytes() for s in sets])

    ids = reps.select("id").distinct()
    own = text.join(F.broadcast(ids) if count <= MOST_BROADCAST else ids, text["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = written(own.mapInArrow(freeing(again), KEPT).join(F.broadcast(wanted) if count <= MOST_BROADCAST else wanted, "cid").groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("tokens").alias("tokens")), files)

    # Each member first meets the heaviest of its hubs, then in ordinary buckets the members of other components.
    heavy = starred.groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b"))
    links = settled(_verified(heavy, sets, num, den, files))
    roots = settled(components(links))
    rows = written(_rooted(members.join(hubs.select("sig", "size"), "sig"), "cid", roots, "root"), files)
    pairs = _ordinary_pairs(rows.where(F.col("size") <= PAIRWISE), first, schemes, num, den)
    links = links.unionByName(settled(_verified(pairs, sets, num, den, files)))
    # Large buckets: all hubs, a second hub for what their hub's component has not taken in, and differences for the rest.
    members = members.join(hubs.where(F.col("size") > PAIRWISE).select("sig"), "sig", "left_semi")
    if members.isEmpty():
        return links
    roots = settled(components(links))
    members = written(members, files)
    starred = starred.where("large = 1").select("a", "b")
    more = _rooted(_rooted(starred, "a", roots, "ra"), "b", roots, "rb").where("ra <> rb")
    links = links.unionByName(settled(_verified(more, sets, num, den, files)))
    heaviest = lambda rows: rows.groupBy("sig").agg(F.max_by(F.struct("cid", "n", "w"), F.struct("w", "cid")).alias("hub"))
    apart = _apart(members, links)
    second = apart.join(heaviest(apart), "sig").where((F.col("cid") != F.col("hub.cid")) & able).select(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).distinct()
    links = links.unionByName(settled(_verified(second, sets, num, den, files)))
    roots = settled(components(links))
    rows = members.join(hubs, "sig").where(F.col("cid") != F.col("hub.cid")).select(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).distinct()
    rest = written(_by_difference(_rooted(_rooted(rows, "a", roots, "ra"), "b", roots, "rb"), sets, num, den, files), files)
    return links.unionByName(_verified(rest, sets, num, den, files))


def _crowds(members: DataFrame) -> DataFrame:
    """The members with the size of their bucket, of buckets of two or more."""
    return members.join(members.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "sig")


def _able(buckets: DataFrame, keys: DataFrame, least: DataFrame, files: int | None = None) -> DataFrame:
    """(sig, cid, n, out): the members of the buckets (sig, k, own) without sets that meet others too seldom to link by that scheme, and without the
    crowded buckets that a set may leave out, `out` in number. least: (n, odd, least), in how many buckets a set of n tokens meets any partner, for its even and its odd scheme."""
    of = Window.partitionBy("k", "cid", "odd")
    met = F.count("*").over(of)
    every = buckets.select("sig", "k").unionByName(buckets.select("sig", F.col("own").alias("k"))).repartition("k").distinct().join(keys, "k")
    every = every.withColumn("odd", F.col("sig").bitwiseAND(F.lit(1)).cast("int")).join(F.broadcast(least), ["n", "odd"])
    for _ in range(2):
        every = _crowds(written(every.withColumn("met", met).where("met >= least").drop("met"), files))
        every = every.withColumn("met", met).where("met >= least").drop("met") if _ else every.drop("size")
    last = F.row_number().over(of.orderBy(F.desc("size"), "sig"))
    goes = (F.col("size") > LEAVE_OUT) & (F.col("last") < F.col("least"))
    every = every.withColumn("last", last).withColumn("goes", goes).withColumn("out", F.count_if("goes").over(of))
    return written(every.where("not goes").select("sig", "cid", "n", "out"), files)


def _rooted(frame: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return frame.join(r, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", column)).drop("__node", "__root")


def _ordinary_pairs(rows: DataFrame, first: list[int], schemes: dict[int, tuple[int, int, int]], num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in as many buckets as sets of their sizes must if they link; rows: (sig, cid, n, out, root).

    Sets that link differ in at most H tokens, so of a scheme's m segments at least m - H are equal, and at most e of these are
    empty and unsigned. Two sets share the scheme of the larger one's band and, within one band, the next one if both sign it.
    Schemes with neighbourhoods count for nothing; one bucket is always asked for.
    """
    split = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    rows = rows.join(split, "sig")
    p, q = rows.alias("p"), rows.alias("q")
    able = F.least("p.n", "q.n") * den >= F.greatest("p.n", "q.n") * num
    met = p.join(q, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.cid") < F.col("q.cid")) & (F.col("p.root") != F.col("q.root")) & able)
    starts = F.array(*(F.lit(f) for f in first))
    band = lambda n: F.size(F.filter(starts, lambda f: f <= n))  # noqa: E731  from 1
    main = F.pmod(band(F.greatest("p.n", "q.n")) - 1, F.lit(2)) == F.col("p.sig").bitwiseAND(F.lit(1))
    out = F.greatest("p.out", "q.out")
    met = met.select(F.col("p.cid").alias("a"), F.col("q.cid").alias("b"), F.least("p.n", "q.n").alias("less"), F.greatest("p.n", "q.n").alias("more"), main.alias("main"), out.alias("out"))
    met = met.groupBy("a", "b").agg(F.count_if("main").alias("times"), F.count_if(~F.col("main")).alias("others"), F.min("less").alias("less"), F.min("more").alias("more"), F.max(F.when(F.col("main"), F.col("out"))).alias("out"), F.max(F.when(~F.col("main"), F.col("out"))).alias("outs"))
    plain = F.array(*(F.lit(m - e if m and not x else 0) for m, x, e in (schemes.get(j, (0, 0, 0)) for j in range(len(first) + 1))))
    differ = F.floor((F.col("less") + F.col("more")) * (den - num) / (den + num))
    asked = lambda j: F.greatest(F.lit(0), F.element_at(plain, j) - differ)
    signs = F.floor(F.col("less") * den / num) >= F.try_element_at(starts, band(F.col("more")) + 1)
    own, both = asked(band(F.col("more"))), F.when((band(F.col("less")) == band(F.col("more"))) & signs, asked(band(F.col("more")) + 1)).otherwise(0)
    enough = (F.col("times") >= F.greatest(F.lit(1), own - F.col("out"))) & ((both <= 0) | (F.col("others") >= F.greatest(F.lit(1), both - F.col("outs"))))
    return met.where(enough).select("a", "b")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, without those of the hub's."""
    roots = settled(components(links))
    rows = _rooted(members, "cid", roots, "root")
    hubs = rows.groupBy("sig").agg(F.max_by("root", F.struct("w", "cid")).alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return rows.join(hubs, "sig").where("root <> most").select("sig", "cid", "n", "w")


def _by_difference(rows: DataFrame, sets: DataFrame, num: int, den: int, files: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components that may link, by their differences from a common hub; rows: (a, b, ra, rb), members with their hub and the components of both."""
    wide = rows.groupBy("b").agg(F.max((F.col("ra") != F.col("rb")).cast("int")).alias("open")).where("open = 1").select("b")
    rows = rows.join(wide, "b").select("a", "b", F.col("ra").alias("root"), (F.col("ra") == F.col("rb")).alias("inside"))
    held = rows.join(sets.select(F.col("cid").alias("a"), "n"), "a").groupBy("b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("s")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("t")).join(held, "b")
    most = lambda n, p: (n + p) * (den - num) // (den + num)  # noqa: E731  tokens by which linked sets of these sizes may differ

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member's difference from the hub, what the hub lacks first: the prefix that any partner must share, and a row without token for the sizes."""
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for x, hub, root, inside, s, t, lo, hi in zip(*b.columns, strict=True):
                s, t = np.frombuffer(s.as_buffer(), _U), np.frombuffer(t.as_buffer(), _U)
                d = np.concatenate((np.setdiff1d(s, t, True), np.setdiff1d(t, s, True)))
                n = len(s)
                others = np.arange(max(lo.as_py(), -(-n * num // den)), min(hi.as_py(), n * den // num) + 1)  # sizes of partners
                least = len(d) - most(n, others[-1])
                if inside.as_py():  # partners are not linked to the hub
                    least = max(least, -(-(len(d) + 1 + int((most(others, len(t)) - most(others, n)).min())) // 2))
                prefix = d[: len(d) - max(1, least) + 1]
                for c, v in zip(out, (hub.as_py(), x.as_py(), root.as_py(), n, len(d), inside.as_py()), strict=False):
                    c.extend([v] * (len(prefix) + 1))
                out[6].extend([*prefix.astype(np.int64).tolist(), None])
            yield _batch(TOKENS, *out)

    tokens = written(rows.join(left, "a").join(right, "b").select("a", "b", "root", "inside", "s", "t", "lo", "hi").mapInArrow(freeing(differ), TOKENS), files)
    shared = tokens.where("token is not null")
    often = shared.groupBy("hub", "token").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hub", "token")
    shared = shared.join(often, ["hub", "token"])
    p, q = shared.alias("p"), shared.alias("q")
    may = ((F.col("p.d") + F.col("q.d")) * 1 <= F.floor((F.col("p.n") + F.col("q.n")) * (den - num) / (den + num)) + 2 * F.least("p.d", "q.d")) & (F.least("p.n", "q.n") * den >= F.greatest("p.n", "q.n") * num)
    met = p.join(q, (F.col("p.hub") == F.col("q.hub")) & (F.col("p.token") == F.col("q.token")) & (F.col("p.root") < F.col("q.root")) & may).select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))
    # Differences so small that they need not overlap: then x links to the inside member with most room, or by this to none.
    alone = tokens.where("token is null")
    best = alone.where("inside").groupBy("hub").agg(F.max_by("x", F.struct((F.col("n") * (den - num) - F.col("d") * (den + num)).alias("room"), "x")).alias("best"))
    near = alone.where("not inside").join(best, "hub").select(F.col("x").alias("a"), F.col("best").alias("b"))
    return met.unionByName(near).distinct()
