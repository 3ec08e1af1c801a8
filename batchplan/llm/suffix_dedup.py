"""Removal of repeated byte strings by a sparse suffix array, merged across tasks with known common prefixes.

A string of `length` bytes has one minimizer: the leftmost of its K-byte grams with the least hash. Equal strings have it at the
same place, so it is enough to sort suffixes at minimizers (about one in 170 bytes), to the right from the minimizer and,
reversed, to the left from it, and of these only those whose gram occurs twice or more.

Each task sorts its suffixes and front-codes them: a suffix is sent as the length of the prefix it shares with the one before
and the rest. Runs that meet are combined by a loser tree whose entries carry the prefix they share with the last winner:
entries that differ in that number are ordered by it alone, others are compared behind it, and the merged order comes
out with the common prefix of neighbours. These numbers give the branching nodes on a suffix's path. A string of `length` bytes
around a minimizer lies under one node to the right and one to the left; it repeats exactly if that pair of nodes holds
two or more minimizers, which is a count with partial sums and needs no pairs.

Equal texts are collapsed before all this; whole copies are repeated throughout.

Strings of words that other documents hold as well are often shorter than that. They are found by the same minimizers, over hashes of
words: of a gram that two different texts hold, the hashes of the strings around it are compared, without an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from batchplan.llm.shingles import hashed_words, mix
from batchplan.llm.spark_io import freeing, written

_U = np.uint64
K = 64
#: Words of a gram of words. Grams of bytes are numbered from 0 on, those of words below.
GRAM = 8
_PLACE = _U((1 << 24) - 1)
_LARGEST = (1 << 63) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_LETTERS = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
#: Strings of one text that are looked at together, bytes of suffixes sorted in a run, and suffixes that meet in a merge.
CHUNK, RUN, MERGE = 1 << 22, 24_000_000, 10_000
ANCHOR = "gram long, h1 long, h2 long, at long"
RUNS = "part int, run binary, h1 long, h2 long, p int, gram long, right binary, left binary, low int, high int, windows array<long>"
PATH = "side int, class binary, depths array<int>, nodes array<long>"
KEPT = "spans array<struct<start: long, end: long>>, kept binary, n_shared_words long"
STEP = "gram long, u long, v long, low int, high int, right binary, left binary, n long"


def spoken(b: np.ndarray) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+, taken eight bytes at a time; words of over 64 bytes are hashed by their letters."""
    edges = np.flatnonzero(np.diff(_BLANK[b], prepend=True, append=True))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix((eight[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(_U) * _U(_MULTIPLIER))
        for done in range(8, min(64, int(sizes.max(initial=0))), 8):
            more = np.flatnonzero(sizes > done)
            h[more] = mix(h[more] * _U(_MULTIPLIER) + (eight[starts[more] + done] & _MASKS[np.minimum(sizes[more] - done, 8)]))
    if sizes.max(initial=0) > 64:
        h = np.where(sizes > 64, hashed_words(b), h)
    return h


def strings(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n units in a row."""
    h, power, s = units, _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while 2 * s <= n and len(h):
            h = h[:-s] * _U(power) + h[s:]
            power, s = power * power % (1 << 64), 2 * s
        return mix(h) if s == n else mix(mix(h[: max(0, len(h) - (n - s))]) * _U(_MULTIPLIER) + h[n - s :])


def anchors(b: np.ndarray, length: int, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, hash of the gram of k, lowest and highest distance from a string's start) of the minimizers of all strings of `length` bytes, or of hashed words."""
    for first in range(0, len(b) - length + 1, CHUNK):
        part = b[first : first + CHUNK + length - 1]
        g = strings(_LETTERS[part] if part.dtype == np.uint8 else part, k)
        low = (g & ~_PLACE) | np.arange(len(g), dtype=_U)
        wide, s = length - k + 1, 1
        while 2 * s <= wide:
            low = np.minimum(low[:-s], low[s:])
            s *= 2
        if s < wide:
            low = np.minimum(low[: len(low) - (wide - s)], low[wide - s :])
        p = (low & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        ends = np.append(starts[1:], len(p)) - 1
        at = p[starts]
        yield at + first, g[at].astype(np.int64), at - ends, at - starts


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(sorted_keys: list[bytes]) -> bytes:
    shared, rests, last = [], [], b""
    for key in sorted_keys:
        shared.append(common(last, key, 0))
        rests.append(key[shared[-1] :])
        last = key
    return np.array([len(shared), *shared, *map(len, rests)], "<u4").tobytes() + b"".join(rests)


def front_decode(run: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, prefix shared with the one before), one at a time."""
    n = int(np.frombuffer(run, "<u4", 1)[0])
    numbers = np.frombuffer(run, "<u4", 2 * n, 4).tolist()
    at, last = 4 + 8 * n, b""
    for shared, rest in zip(numbers[:n], numbers[n:], strict=True):
        last = last[:shared] + run[at : at + rest]
        at += rest
        yield last, shared


class LoserTree:
    """Merges sorted runs; yields (key, prefix shared with the key before) for each distinct key in order.

    An entry is [key, shared, run]; shared is the common prefix with the last winner, so entries are only compared
    behind it.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers: list[list | None] = [None] * self.size

    def _next(self, run: int) -> list | None:
        got = next(self.runs[run], None) if run < len(self.runs) else None
        return None if got is None else [got[0], got[1], run]

    @staticmethod
    def _play(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = a[0], b[0]
        shared = common(x, y, a[1])
        if x[shared : shared + 1] > y[shared : shared + 1]:
            a, b = b, a
        b[1] = shared
        return a, b

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        level = [self._next(r) for r in range(self.size)]
        for e in level:
            if e:
                e[1] = 0
        node = self.size
        while len(level) > 1:
            node //= 2
            up = []
            for k in range(0, len(level), 2):
                won, self.losers[node + k // 2] = self._play(level[k], level[k + 1])
                up.append(won)
            level = up
        winner, last = level[0], None
        while winner is not None:
            if last is None or not (winner[1] == len(last) == len(winner[0])):
                yield winner[0], winner[1]
            last, run = winner[0], winner[2]
            winner = self._next(run)
            node = (run + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2


def paths(merged: Iterator[tuple[bytes, int]]) -> Iterator[tuple[bytes, list[int]]]:
    """(key, depths): for each key the prefixes that it shares with any other key of its gram (the first 8 bytes), and its own length; by group of gram."""

    def group(keys: list[bytes], shared: list[int]) -> Iterator[tuple[bytes, list[int]]]:
        found: list[set[int]] = []
        stack: list[int] = []
        for s in shared:
            if found:
                while stack and stack[-1] >= s:
                    stack.pop()
                stack.append(s)
            found.append(set(stack))
        stack = []
        for k in range(len(keys) - 2, -1, -1):
            s = shared[k + 1]
            while stack and stack[-1] >= s:
                stack.pop()
            stack.append(s)
            found[k].update(stack)
        for key, depths in zip(keys, found, strict=True):
            yield key, sorted(depths | {8, len(key)})

    keys: list[bytes] = []
    shared: list[int] = []
    for key, s in merged:
        if keys and s < 8:
            yield from group(keys, shared)
            keys, shared = [], []
        keys.append(key)
        shared.append(s)
    if keys:
        yield from group(keys, shared)


def _short(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _signed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _shared(b: np.ndarray, words: int, windows: np.ndarray | None) -> int:
    """Words of a text that lie in one of these strings of words; without any given, in a string of that many words."""
    if windows is None:
        n = np.count_nonzero(np.diff(_BLANK[b], prepend=True, append=True)) // 2
        return n if n >= words else 0
    w = strings(spoken(b), words)
    hit = np.isin(w.view(np.int64), windows)
    edges = np.zeros(len(w) + words, np.int32)
    edges[: len(w)] += hit
    edges[words:] -= hit
    return int(np.count_nonzero(np.cumsum(edges)))


def _cut_out(b: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal runs, the rest) for half-open spans in any order."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    edges = [0, *(x for run in runs for x in run), len(b)]
    return [tuple(run) for run in runs], b"".join([b[i:k] for i, k in zip(edges[::2], edges[1::2], strict=True)])


def digests(found: DataFrame, id_col: str = "doc_id") -> list[Column]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of what deduplicated() returns."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return [found[id_col], found["n_bytes"], removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def suffix_dedup(docs: DataFrame, length: int = 400, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of deduplicated(): n_spans counts the runs, kept_sha256 is of the kept bytes."""
    found = deduplicated(docs, length, id_col=id_col, text_col=text_col)
    return found.select(*digests(found, id_col))


def deduplicated(docs: DataFrame, length: int = 400, words: int = 51, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array of (start, end), kept binary, n_shared_words), one row for each input row.

    Removed is each byte covered by a string of `length` bytes that starts at two or more places of the input, the same document included;
    spans are the maximal runs of removed bytes in order and kept is what the others make up, which need not be whole characters. Null texts are empty. Repeated rows and
    rows of equal id are documents of their own, so equal texts of `length` bytes or more lose everything. Very long texts are
    looked at in stretches. Other columns are not read; an empty table gives an empty result. length must be over 64.

    n_shared_words tells of passages, long or short in bytes, and removes nothing: the words [^\\x20\\x09-\\x0D]+ that lie in a string of `words` words which another row holds
    as well. Strings are compared by 64-bit hashes. words must be over 8.
    """
    if length <= K or words <= GRAM:
        raise ValueError(f"length must be over {K}, words over {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))
    long = rows.where(F.col("n_bytes") >= min(length, 2 * words - 1))
    texts = long.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.min("n_bytes").alias("size"))

    def places(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for p, g, low, high in anchors(b, length):
            yield p, g & _LARGEST, low, high
        for p, g, low, high in anchors(spoken(b), words, GRAM):
            yield p, g | ~_LARGEST, low, high

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for t, h1, h2 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (h1, h2) in done:  # a copy met before in this task
                    continue
                if len(done) < 500_000:
                    done.add((h1, h2))
                for p, g, low, high in places(np.frombuffer(t.as_buffer(), np.uint8)):
                    for c, v in zip(out, (g, np.full(len(p), h1), np.full(len(p), h2), p << 32 | low << 16 | high), strict=True):
                        c.append(v)
                    held += len(p)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["gram", "h1", "h2", "at"])
                    out, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["gram", "h1", "h2", "at"])

    found = written(long.select("text", "h1", "h2").mapInArrow(freeing(find), ANCHOR))
    ends = [f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("h1", "h2", "at")]  # a copy in another task has the same places
    often = found.groupBy("gram").agg(*ends).where("minh1 <> maxh1 or minh2 <> maxh2 or gram >= 0 and minat <> maxat").select("gram")
    candidates = written(found.join(often, "gram").select("gram", "h1", "h2", "at"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), candidates.where("gram >= 0").count() // MERGE)

    by_text = candidates.groupBy("h1", "h2").agg(F.collect_set(F.struct("gram", "at")).alias("found")).join(texts.select("h1", "h2", "rep"), ["h1", "h2"])
    own = rows.select("id", "text", "h1", "h2").alias("r").join(by_text.alias("f"), F.col("r.id").eqNullSafe(F.col("f.rep")) & (F.col("r.h1") == F.col("f.h1")) & (F.col("r.h2") == F.col("f.h2")))
    own = own.select("text", "r.h1", "r.h2", "found.gram", "found.at")
    fields = [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (c.split() for c in RUNS.split(", "))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Front-coded runs for each part, the anchors with the classes of their two suffixes, and strings of words."""
        keys: dict[int, set[bytes]] = {}
        held = 0

        def flush():
            for part, own in keys.items():
                yield _rows(fields, part=[part], run=[front_code(sorted(own))])

        for b in batches:
            for t, h1, h2, grams, ats in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                body, out, words_at = t.as_buffer().to_pybytes(), {n: [] for n, _ in fields[2:-1]}, []
                for g, at in sorted(set(zip(grams.as_py(), ats.as_py(), strict=True))):
                    if g < 0:
                        words_at.append(slice((at >> 32) - (at & 0xFFFF), (at >> 32) - (at >> 16 & 0xFFFF) + 1))
                        continue
                    p, low, high = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
                    head = (g % (1 << 64)).to_bytes(8, "big")
                    right, left = head + body[p : p + length - low], head + body[p - high : p][::-1]
                    for side, key in enumerate((right, left)):
                        own = keys.setdefault(2 * (g % parts) + side, set())
                        if key not in own:
                            own.add(key)
                            held += len(key)
                    for c, v in zip(out.values(), (h1, h2, p, g, _short(right), _short(left), low, high), strict=True):
                        c.append(v)
                yield _rows(fields, **out)
                if words_at:
                    w = strings(spoken(np.frombuffer(body, np.uint8)), words)
                    yield _rows(fields, windows=[np.unique(np.concatenate([w[s] for s in words_at])).view(np.int64)], h1=[h1])
                if held > RUN:
                    yield from flush()
                    keys, held = {}, 0
        yield from flush()

    made = written(own.mapInArrow(freeing(cut), RUNS))
    runs = made.where("run is not null").select("part", "run")
    placed = made.where("gram is not null").select("h1", "h2", "p", "gram", "right", "left", "low", "high")

    def merge(table: pa.Table) -> pa.Table:
        side = table.column("part")[0].as_py() % 2
        out: list[list] = [[], [], [], []]
        for key, depths in paths(iter(LoserTree([front_decode(r.as_py()) for r in table.column("run")]))):
            for c, v in zip(out, (side, _short(key), [d - 8 for d in depths], [_signed(key[:d]) for d in depths]), strict=True):
                c.append(v)
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))], names=["side", "class", "depths", "nodes"])

    merged = written(runs.groupBy("part").applyInArrow(merge, PATH))
    kinds = placed.groupBy("gram", "right", "left", "low", "high").agg(F.count("*").alias("n"))
    of = lambda side, name: merged.where(F.col("side") == side).select(F.col("class").alias(name), F.col("depths").alias(f"{name}_depths"), F.col("nodes").alias(f"{name}_nodes"))
    walks = kinds.join(of(0, "right"), "right").join(of(1, "left"), "left")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each kind of anchor the pairs of nodes over its strings: as the start moves left, the right node rises and the left one descends."""
        names = [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in STEP.split(", "))]
        for b in batches:
            out: dict[str, list] = {n: [] for n, _ in names}
            for r in b.to_pylist():
                d = r["low"]
                rd, rn, ld, ln = r["right_depths"], r["right_nodes"], r["left_depths"], r["left_nodes"]
                i, j = len(rd) - 1, 0
                while d <= r["high"]:
                    while i and rd[i - 1] >= length - d:
                        i -= 1
                    while ld[j] < d:
                        j += 1
                    end = min(r["high"], ld[j], length - rd[i - 1] - 1 if i else r["high"])
                    for n, v in (("gram", r["gram"]), ("u", rn[i]), ("v", ln[j]), ("low", d), ("high", end), ("right", r["right"]), ("left", r["left"]), ("n", r["n"])):
                        out[n].append(v)
                    d = end + 1
            yield _rows(names, **out)

    steps = written(walks.select("gram", "right", "left", "low", "high", "n", "right_depths", "right_nodes", "left_depths", "left_nodes").mapInArrow(freeing(climb), STEP))
    again = steps.groupBy("gram", "u", "v").agg(F.sum("n").alias("total")).where("total > 1").select("gram", "u", "v")
    hit = steps.join(again, ["gram", "u", "v"]).select("gram", "right", "left", F.col("low").alias("from"), F.col("high").alias("to"))
    spans = placed.join(hit, ["gram", "right", "left"]).groupBy("h1", "h2").agg(F.collect_set(F.struct((F.col("p") - F.col("to")).alias("start"), (F.col("p") - F.col("from") + length).alias("end"))).alias("spans"))

    each = Window.partitionBy("window")
    windows = made.where("windows is not null").select("h1", F.explode("windows").alias("window"))
    shared = windows.select("window", "h1", F.min("h1").over(each).alias("low"), F.max("h1").over(each).alias("high")).where("low <> high")
    shared = written(shared.groupBy("h1").agg(F.collect_list("window").alias("windows")))
    marks = texts.join(spans, ["h1", "h2"], "left").join(shared, "h1", "left").where("copies > 1 or spans is not null or windows is not null")
    copied = F.col("copies") > 1
    marks = written(marks.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), copied.alias("copied"), (copied & (F.col("size") >= length)).alias("whole"), "spans", "windows"))
    body = rows.join(marks, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")), "left")
    body = body.select("id", "text", "n_bytes", F.coalesce("whole", F.lit(False)).alias("whole"), "spans.start", "spans.end", F.coalesce("copied", F.lit(False)).alias("copied"), "windows")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, kept, shared = [], [], []
            for t, n, whole, s, e, copied, w in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), b.column(6).to_pylist(), b.column(7), strict=True):
                own, rest = t.as_buffer().to_pybytes(), zip(s.as_py() or (), e.as_py() or (), strict=True)
                own, rest = ([(0, n)], b"") if whole else _cut_out(own, rest) if s.is_valid else ([], own)
                runs.append(own)
                kept.append(rest)
                known = w.values.to_numpy() if w.is_valid and not copied else None
                shared.append(_shared(np.frombuffer(t.as_buffer(), np.uint8), words, known) if copied or known is not None else 0)
            edges = np.array([x for own in runs for run in own for x in run], np.int64)
            each = pa.StructArray.from_arrays([pa.array(edges[::2]), pa.array(edges[1::2])], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), spans, pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], names=["id", "n_bytes", "spans", "kept", "n_shared_words"])

    kind = StructType([body.schema["id"], body.schema["n_bytes"], *StructType.fromDDL(KEPT)])
    return body.mapInArrow(freeing(remove), kind).withColumnRenamed("id", id_col)


def _rows(fields: list[tuple[str, pa.DataType]], **columns) -> pa.RecordBatch:
    """A batch of these columns, the other fields null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in fields], names=[name for name, _ in fields])
