"""Near copies among a collection too large for pairwise comparison.

A T-occurrence search over an inverted index of word shingles, after
DivideSkip.  For every text the overlap T that any partner needs divides its
shingles: the T - S most frequent ones have long lists, which are set aside;
the lists of the rest are short and are merged, and a pair must occur in at
least S of them (S is ``short_lists``; in T where T is smaller).  Pairs that
come out of the merge are probed by binary search for the shingles set aside
and kept where the overlap reaches T.

The collection is joined with itself and its index lies in shards, which shapes
two steps.  A shard counts the occurrences of a pair in its own lists, and the
shards' counts are added before they are held against S.  Long lists are not
built: a text stands in the list of a shingle if and only if the shingle stands
in the sorted set of the text, so the probes go there.

1. One pass counts all shingles in a sketch of fixed size (its order decides
   which lists are short; any order gives the same result) and keys each text
   by its words, so copies are one text from here on.
2. One pass sends the entries of each text's short lists to the shards of the
   index.  A shard holds a bounded number of entries and of texts; a list longer
   than ``long_list`` is cut into blocks that meet pairwise.  A shard merges its
   lists; a bitmap of each text's shingles rejects pairs that cannot reach T.
   A text goes to each shard that has a list of its own, so the index outgrows
   the input where shards are many: then the entries are written once, and the
   shards are built and merged in rounds, of which each leaves only its pairs.
3. The shingle sets of the texts that came up are read again and probed.

Defined results: null contents and those with fewer than ``k`` words have no
partners; repeated rows count once; a chunk id with two contents is compared
with each; a chunk never pairs with its own id; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.hashing import mix, shingle_hashes, text_keys, word_hashes
from folioscope.session import checkpoint, spread

_PARTS = 64
#: 64-bit words of a text's bitmap, and the most shingles for which each is used.
_WIDTHS = ((2, 80), (4, 160), (8, 320), (16, 640), (32, 1 << 40))
#: Characters of the texts that are hashed at once.
_TOGETHER = 1 << 23


def _batches(frames: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words per row, shingles, shingles per row) with the word hashes of each batch."""
    for whole in frames:
        # a text's number within a batch has 16 bits
        held = np.cumsum(np.fromiter(map(len, whole["content"]), dtype=np.int64, count=len(whole)))
        cuts = np.flatnonzero(np.diff(held // _TOGETHER)) + 1
        edges = sorted({0, len(whole), *cuts.tolist(), *range(0, len(whole), 1 << 15)})
        for at, end in zip(edges, edges[1:]):
            frame = whole.iloc[at:end]
            words, counts = word_hashes(frame["content"].tolist())
            grams, runs = shingle_hashes(words, counts, k)
            yield frame, words, counts, grams, runs


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, which compress to little where most are small."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1) if len(values) else b""


def _unpack_numbers(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts added."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts[order], first)


def _distinct(grams: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingles of each text, and their number."""
    owner = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    keys = _sorted_distinct((owner << np.uint64(48)) | (grams >> np.uint64(16)))
    return keys & np.uint64((1 << 48) - 1), np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(runs))


def _needed(total: np.ndarray, t: Fraction) -> np.ndarray:
    """Least overlap of two sets of ``total`` elements together for a Jaccard of ``t``."""
    num, den = t.numerator, t.numerator + t.denominator
    return -(-(num * total) // den)


def _short(n: np.ndarray, t: Fraction, short_lists: int) -> np.ndarray:
    """How many of a text's n lists are short: all but T - S, for the least T that a partner of any size needs."""
    least = -(-(t.numerator * n) // t.denominator)
    return np.minimum(n, n - least + short_lists)


def _widths(n: np.ndarray) -> np.ndarray:
    lanes, most = zip(*_WIDTHS)
    return np.array(lanes)[np.searchsorted(np.array(most), n)]


def _bitmaps(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parity bitmaps of all texts one after the other, lanes of each text)."""
    lanes = _widths(n)
    out = np.zeros(int(lanes.sum()), dtype=np.uint64)
    at = _starts(lanes)
    for width in np.unique(lanes).tolist():
        texts = np.flatnonzero(lanes == width)
        own = grams[np.repeat(lanes == width, n)]
        bit = (own >> np.uint64(20)) & np.uint64(64 * width - 1)
        lane, flag = bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))
        begin = _starts(n[texts])
        for w in range(width):
            out[at[texts] + w] = np.bitwise_xor.reduceat(np.where(lane == np.uint64(w), flag, np.uint64(0)), begin)
    return out, lanes


_COUNTED = "chunk_id string, content_key long, k1 long, k2 long, part int, counts binary"


def _count_pass(chunks: DataFrame, k: int, bits: int) -> DataFrame:
    """Members (``part`` null) and the parts of each task's sketch."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << bits, dtype=np.int64)
        for frame, words, counts, grams, runs in _batches(frames, k):
            sketch += np.bincount((grams >> np.uint64(16)) & np.uint64((1 << bits) - 1), minlength=1 << bits)
            k1, k2 = text_keys(words, counts)
            keep = runs > 0
            yield pd.DataFrame(
                {
                    "chunk_id": frame["chunk_id"].to_numpy()[keep],
                    "content_key": frame["content_key"].to_numpy()[keep],
                    "k1": k1[keep].view(np.int64),
                    "k2": k2[keep].view(np.int64),
                    "part": pd.array([None] * int(keep.sum()), dtype="Int32"),
                    "counts": None,
                }
            )
        packed = [_pack(p) for p in sketch.reshape(_PARTS, -1)]
        yield pd.DataFrame({"chunk_id": None, "content_key": 0, "k1": 0, "k2": 0, "part": range(_PARTS), "counts": packed})

    return chunks.mapInPandas(scan, _COUNTED)


def _sketch(counted: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches: 2**bits counters, whatever the size of the collection."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one part's blobs of all tasks pass one by one
        total = {}
        for frame in frames:
            for part, blob in zip(frame["part"].tolist(), frame["counts"]):
                total[part] = total.get(part, 0) + _unpack_numbers(blob, np.int64)
        yield pd.DataFrame({"part": list(total), "counts": [_pack(x) for x in total.values()]})

    blobs = counted.where("part is not null").select("part", "counts")
    parts = blobs.repartitionById(_PARTS // 4, "part").mapInPandas(add, "part int, counts binary").collect()
    out = np.zeros((_PARTS, (1 << bits) // _PARTS), dtype=np.int64)
    for row in parts:
        out[row["part"]] = _unpack_numbers(row["counts"], np.int64)
    return out.reshape(-1)


def _frequency_order(often: np.ndarray) -> np.ndarray:
    """16 bits that grow with a count of any size: its leading binary digits as a float."""
    return (often.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint64)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _entries(k: int, t: Fraction, short_lists: int, shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[tuple[np.ndarray, ...]]]:
    """A function from batches of rows to ``(k1, n, maps, texts, shingles, ranks)``: a batch's texts and the entries of their short lists."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        sketch = shared.value
        mask = np.uint64(len(sketch) - 1)
        seen: set[int] = set()
        for _, words, counts, grams, runs in _batches(frames, k):
            k1, _ = text_keys(words, counts)
            # copies met before in this task add nothing to the index
            fresh = np.zeros(len(k1), dtype=bool)
            if len(seen) > 1_000_000:
                seen.clear()
            for row, key in enumerate(k1.tolist()):
                if runs[row] and key not in seen:
                    seen.add(key)
                    fresh[row] = True
            grams = grams[np.repeat(fresh, runs)]
            k1, runs = k1[fresh], runs[fresh]
            if not len(runs):
                continue
            grams, n = _distinct(grams, runs)
            owner = np.repeat(np.arange(len(n)), n)
            maps, _ = _bitmaps(grams, n)
            often = sketch[grams & mask]
            # rarest first within each text; shingles come sorted, so a stable sort leaves ties in their order
            order = np.argsort((owner.astype(np.uint64) << np.uint64(16)) | _frequency_order(often), kind="stable")
            rank = np.arange(len(order)) - np.repeat(_starts(n), n)
            # a shingle that the sketch has seen once is in no other text
            short = (rank < np.repeat(_short(n, t, short_lists), n)) & (often[order] > 1)
            rank, short = rank[short], order[short]
            yield k1, n, maps, owner[short], grams[short], rank

    return scan


def _shard_rows(k1: np.ndarray, n: np.ndarray, maps: np.ndarray, who: np.ndarray, gram: np.ndarray, rank: np.ndarray, sketch: np.ndarray, shards: int, long_list: int, low: int, high: int) -> pd.DataFrame:
    """``shard, blob``: a batch's entries for the shards from ``low`` to ``high``, counted from ``low``, with the texts they name."""
    lanes = _widths(n)
    map_at = _starts(lanes)
    blocks = sketch[gram & np.uint64(len(sketch) - 1)] // long_list + 1
    single = blocks == 1
    spots, texts, places = [], [], []

    def put(spot: np.ndarray, at: np.ndarray) -> None:
        shard = (spot >> np.uint64(32)) % np.uint64(shards)
        own = np.flatnonzero((shard >= np.uint64(low)) & (shard < np.uint64(high)))
        spots.append(((shard[own] - np.uint64(low)) << np.uint64(32)) | (spot[own] & np.uint64(0xFFFFFFFF)))
        texts.append(who[at[own]])
        places.append(rank[at[own]])

    put(mix(gram[single]), np.flatnonzero(single))
    for many in np.unique(blocks[~single]).tolist():
        at = np.flatnonzero(blocks == many)
        own = (k1[who[at]] % np.uint64(many)).astype(np.int64)
        for other in range(many):
            pair = np.minimum(own, other) * many + np.maximum(own, other)
            put(mix(gram[at] ^ mix(pair.astype(np.uint64) + np.uint64(1))), at)
    spot, text, ranks = np.concatenate(spots), np.concatenate(texts), np.concatenate(places)
    by = np.argsort(spot)
    spot, text, ranks = spot[by], text[by], ranks[by]
    shard, names = (spot >> np.uint64(32)).astype(np.int64), spot.astype(np.uint32)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    ids, blobs = [], []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
        if lo == hi:
            continue
        used, local = np.unique(text[lo:hi], return_inverse=True)
        pick = np.repeat(map_at[used], lanes[used]) + _within(lanes[used])
        ids.append(int(shard[lo]))
        blobs.append(
            _framed(
                _pack(np.diff(names[lo:hi], prepend=np.uint32(0)).astype(np.uint32)),
                _pack(local.astype(np.uint32)),
                _pack(ranks[lo:hi].astype(np.uint32)),
                _pack(n[used].astype(np.uint32)),
                k1[used].tobytes(),
                maps[pick].tobytes(),
            )
        )
    return pd.DataFrame({"shard": ids, "blob": blobs})


def _packed_batch(k1: np.ndarray, n: np.ndarray, maps: np.ndarray, who: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> bytes:
    """A batch of ``_entries``: a shingle takes its six bytes, the rest little."""
    return _framed(
        k1.tobytes(),
        _pack(n.astype(np.uint32)),
        maps.tobytes(),
        _pack(np.bincount(who, minlength=len(n)).astype(np.uint32)),
        _pack(np.diff(rank, prepend=0).astype(np.int32)),
        np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(),
    )


def _unpacked_batch(blob: bytes) -> tuple[np.ndarray, ...]:
    k1, n, maps, many, steps, six = _parts_of(blob)
    many = _unpack_numbers(many, np.uint32).astype(np.int64)
    gram = np.zeros((len(six) // 6, 8), dtype=np.uint8)
    gram[:, :6] = np.frombuffer(six, dtype=np.uint8).reshape(-1, 6)
    return (
        np.frombuffer(k1, dtype=np.uint64),
        _unpack_numbers(n, np.uint32).astype(np.int64),
        np.frombuffer(maps, dtype=np.uint64),
        np.repeat(np.arange(len(many)), many),
        gram.view("<u8").reshape(-1).astype(np.uint64),
        np.cumsum(_unpack_numbers(steps, np.int32), dtype=np.int64),
    )


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes), sizes)


def _framed(*parts: bytes) -> bytes:
    return b"".join((np.array([len(p) for p in parts], dtype=np.int64).tobytes(), *parts))


def _parts_of(blob: bytes) -> list[bytes]:
    ends = 48 + np.cumsum(np.frombuffer(blob, dtype=np.int64, count=6))
    return [blob[a:b] for a, b in zip([48, *ends.tolist()], ends.tolist())]


def _unpack(blob: bytes):
    names, local, ranks, n, keys, maps = _parts_of(blob)
    return (
        np.frombuffer(keys, dtype=np.uint64),
        _unpack_numbers(n, np.uint32),
        np.frombuffer(maps, dtype=np.uint64),
        np.cumsum(_unpack_numbers(names, np.uint32), dtype=np.uint64).astype(np.uint32),
        _unpack_numbers(local, np.uint32),
        _unpack_numbers(ranks, np.uint32),
    )


_SHARDED = "shard int, blob binary"
_MET = "a long, b long, n int, least int"


def _shard_texts(blobs: Iterable[bytes]) -> tuple[np.ndarray, ...]:
    """(keys, sizes, lanes, bitmaps, where each bitmap begins) of the shard's texts, (names, texts, ranks) of its entries.

    A text that came from several tasks has the same entries from each: the
    first ones stay.
    """
    parts, held = [], 0
    for keys, n, maps, names, local, ranks in map(_unpack, blobs):
        parts.append((keys, n, maps, names, local + np.uint32(held), ranks))
        held += len(keys)
    raw, all_n, all_maps, names, text, ranks = (np.concatenate(p) for p in zip(*parts))
    del parts
    all_n = all_n.astype(np.int64)
    lanes = _widths(all_n)
    keys, first, back = np.unique(raw, return_index=True, return_inverse=True)
    if len(keys) < len(raw):
        own = np.zeros(len(raw), dtype=bool)
        own[first] = True
        own = own[text]
        names, text, ranks = names[own], text[own], ranks[own]
    return keys, all_n[first], lanes[first], all_maps, _starts(lanes)[first], names, back.astype(np.int32)[text], ranks


def _merge_shard(
    blobs: Iterable[bytes], t: Fraction, short_lists: int, block: int = 500_000, most_kept: int = 1_000_000, section: int = 500_000
) -> Iterator[pd.DataFrame]:
    """Merge the shard's lists: how often each pair that may still reach T occurs in them, and how often it must.

    A list is in order of text size.  From an entry's place among its text's
    shingles follow the sizes that a partner may have, a range of the list; the
    partner's place must allow the same, and the bitmaps of both must.  Lists
    are merged in sections of about ``section`` entries, and counts of a pair
    may come in several rows, so a shard's pairs are not held at once.
    """
    blobs = iter(blobs)
    if (head := next(blobs, None)) is None:
        return
    keys, n, lanes, all_maps, map_at, all_names, all_text, all_ranks = _shard_texts(b for part in ([head], blobs) for b in part)
    num, both = t.numerator, t.numerator + t.denominator
    # maps of all texts at every width, wider ones folded
    folded = {}
    row_at = {}
    for width, _ in _WIDTHS:
        rows = np.flatnonzero(lanes >= width)
        if not len(rows):
            break
        grid = np.zeros((len(rows), width), dtype=np.uint64)
        for wide in np.unique(lanes[rows]).tolist():
            of = np.flatnonzero(lanes[rows] == wide)
            for at in range(0, wide, width):
                for lane in range(width):
                    grid[of, lane] ^= all_maps[map_at[rows[of]] + at + lane]
        folded[width] = grid
        at = np.zeros(len(keys), dtype=np.int32)
        at[rows] = np.arange(len(rows), dtype=np.int32)
        row_at[width] = at
    del all_maps, map_at
    found, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    fresh: list[np.ndarray] = []

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([found, *fresh])
        return _added(codes, np.concatenate([seen, np.ones(len(codes) - len(found), dtype=np.int64)]))

    def rows_of(found: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
        x, y = found // len(keys), found % len(keys)
        least = np.minimum(short_lists, _needed(n[x] + n[y], t))
        a, b = keys[x].view(np.int64), keys[y].view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": seen, "least": least})

    sections = max(1, -(-len(all_names) // section))
    for part in range(sections):
        inside = np.flatnonzero((all_names.astype(np.uint64) * np.uint64(sections)) >> np.uint64(32) == np.uint64(part))
        names, text, ranks = all_names[inside], all_text[inside].astype(np.int64), all_ranks[inside].astype(np.int64)
        size = n[text]
        order = np.argsort((names.astype(np.uint64) << np.uint64(32)) | np.minimum(size, 0xFFFFFFFF).astype(np.uint64), kind="stable")
        names, text, ranks, size = names[order], text[order], ranks[order], size[order]
        # the largest partner that an entry's place allows, for one of the first S shingles that a pair shares
        most = (both * (size - ranks + short_lists - 1) - num * size) // num
        # only entries that allow a partner of their own size or more can be the smaller side
        small = np.flatnonzero(most >= size)
        base = names.astype(np.uint64) << np.uint64(32)
        held = (base | size.astype(np.uint64))[small]
        least = -(-(num * size) // t.denominator)
        lo = np.searchsorted(held, base | least.astype(np.uint64), side="left")
        top = np.minimum(most, size)
        hi = np.searchsorted(held, base | np.maximum(top, 0).astype(np.uint64), side="right")
        hi = np.where(top >= least, hi, lo)
        count = np.maximum(hi - lo, 0)
        ends = np.cumsum(count)
        begin = 0
        while begin < len(count):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + block, side="right")))
            many = count[begin:stop]
            i = np.repeat(np.arange(begin, stop), many)
            j = small[np.repeat(lo[begin:stop], many) + _within(many)]
            begin = stop
            ok = (most[j] >= size[i]) & ((size[j] < size[i]) | (text[j] < text[i]))
            a, b = text[i[ok]], text[j[ok]]
            total = n[a] + n[b]
            spare = total - 2 * _needed(total, t)
            width = np.minimum(lanes[a], lanes[b])
            for w, grid in folded.items():
                own = np.flatnonzero(width == w)
                if not len(own):
                    continue
                left, right = row_at[w][a[own]], row_at[w][b[own]]
                apart = np.zeros(len(own), dtype=np.uint16)
                for lane in range(w):
                    apart += np.bitwise_count(grid[left, lane] ^ grid[right, lane])
                near = own[apart <= spare[own]]
                if len(near):
                    fresh.append(np.minimum(a[near], b[near]) * len(keys) + np.maximum(a[near], b[near]))
            if sum(map(len, fresh)) > most_kept // 4:
                found, seen = gathered()
                fresh.clear()
            if len(found) > most_kept:
                yield rows_of(found, seen)
                found, seen = found[:0], seen[:0]
    found, seen = gathered()
    if len(found):
        yield rows_of(found, seen)


def _shards(sketch: np.ndarray, texts: int, share: float, short_lists: int, shard_entries: int, shard_bytes: int, round_bytes: float, long_list: int) -> tuple[int, int]:
    """(shards of the index, rounds they are built in).

    A shard's memory is its entries and its texts with their bitmaps: both
    have a bound.  A round's index has a bound by the shingles of the input.
    """
    mean = max(1.0, float(sketch.sum(dtype=np.int64)) / max(1, texts))
    each = short_lists + mean * share
    # an entry of a list in blocks comes once a block; short lists are the rarest shingles
    often = np.sort(sketch)
    often = often[: np.searchsorted(np.cumsum(often), min(1.0, each / mean) * texts * mean, side="right")]
    if len(often) and often[-1]:
        each *= float((often * (often // long_list + 1)).sum()) / float(often.sum())
    text_bytes = 8 + 8 * min(32.0, max(2.0, mean / 24))
    shards = max(4, int(-(-texts * each // shard_entries)))
    most = shard_bytes / text_bytes
    if texts > most:
        shards = max(shards, int(-(-each // -np.log1p(-most / texts))))
    index = shards * texts * -np.expm1(-each / shards) * text_bytes + texts * each * 4
    return shards, min(shards, max(1, int(-(-index // (max(1, texts) * mean * round_bytes)))))


def _release(spark) -> None:
    """Let go of frames that are out of use, so that Spark removes their shuffle files."""
    gc.collect()
    # the scheduler and the listeners hold their last event, and with it its plan, until another comes
    spark.range(1).count()
    # Python's side of a frame is let go of by a thread that looks once a second
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def _asked_rows(rows: DataFrame, pairs: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """The rows whose content may be a text of some pair.

    Their content keys set bits of a table of 2**bits bits, which is broadcast
    (2**(bits-6) rows at most), so that other contents never leave the JVM.
    """
    texts = members.select(F.col("k1").alias("key"), "content_key").distinct()
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts, "key")
    word, flag = F.shiftright(F.pmod("content_key", F.lit(1 << bits)), 6).alias("word"), F.expr(
        f"shiftleft(1L, cast(pmod(content_key, {1 << bits}) % 64 as int))"
    )
    table = keys.groupBy(word).agg(F.bit_or(flag).alias("flags"))
    marked = rows.withColumn("word", word).join(F.broadcast(table), "word")
    return marked.where(F.col("flags").bitwiseAND(flag) != 0).select("content")


def _set_pass(rows: DataFrame, k: int) -> DataFrame:
    """``k1, k2, grams`` of texts: sorted 48-bit shingles."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, words, counts, grams, runs in _batches(frames, k):
            k1, k2 = text_keys(words, counts)
            hit = (runs > 0) & ~pd.DataFrame({"k1": k1, "k2": k2}).duplicated().to_numpy()
            sets, n = _distinct(grams[np.repeat(hit, runs)], runs[hit])
            ends = np.cumsum(n)
            yield pd.DataFrame(
                {
                    "k1": k1[hit].view(np.int64),
                    "k2": k2[hit].view(np.int64),
                    "grams": [sets[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist())],
                }
            )

    return rows.mapInPandas(scan, "k1 long, k2 long, grams binary")


_LINKS = "a1 long, a2 long, b1 long, b2 long, shared int, similarity double"


def _probe(frames: Iterator[pd.DataFrame], t: Fraction) -> Iterator[pd.DataFrame]:
    """Probe each pair's larger set by binary search for the smaller one's shingles."""
    for frame in frames:
        out = []
        for a1, a2, left, b1, b2, right in frame.itertuples(index=False):
            x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = int((y[at] == x).sum())
            union = len(x) + len(y) - shared
            if shared * t.denominator >= union * t.numerator:
                out.append((a1, a2, b1, b2, shared, shared / union))
        yield pd.DataFrame(out, columns=["a1", "a2", "b1", "b2", "shared", "similarity"])


def near_copies(
    chunks: DataFrame,
    k: int = 5,
    threshold: Fraction = Fraction(4, 5),
    sketch_bits: int = 22,
    shard_entries: int = 3_000_000,
    long_list: int = 4_096,
    filter_bits: int = 23,
    short_lists: int = 2,
    shard_bytes: int = 28_000_000,
    round_bytes: float = 4,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of different texts over the threshold, and each chunk's text.

    ``links``: ``a1, a2, b1, b2, shared, similarity`` between text keys;
    ``members``: ``chunk_id, k1, k2``.  Copies share a key and need no link.
    The sketch (2**sketch_bits counters) and the key filter
    (2**filter_bits bits) are what is broadcast: fixed sizes.  A shard has up
    to about ``shard_entries`` entries and ``shard_bytes`` of texts' keys and
    bitmaps, a round of the index ``round_bytes`` for each shingle of the input.
    """
    spark = chunks.sparkSession
    rows = spread(
        chunks.where("content is not null and chunk_id is not null").select("chunk_id", "content", F.xxhash64("content").alias("content_key"))
    )
    counted = checkpoint(_count_pass(rows, k, sketch_bits))
    found = counted.where("part is null").select("chunk_id", "content_key", "k1", "k2")
    members = found.select("chunk_id", "k1", "k2").distinct()
    sketch = _sketch(counted, sketch_bits)
    texts = counted.where("part is null").count()
    shards, rounds = _shards(sketch, texts, float(1 - threshold), short_lists, shard_entries, shard_bytes, round_bytes, long_list)
    shared = spark.sparkContext.broadcast(sketch)
    entries = _entries(k, threshold, short_lists, shared)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one partition is one shard
        yield from _merge_shard((b for f in frames for b in f["blob"]), threshold, short_lists)

    def merged(blobs: DataFrame, n: int) -> DataFrame:
        # by number, so that no task is given several shards
        return blobs.repartitionById(n, "shard").select("blob").mapInPandas(merge, _MET)

    if rounds == 1:
        met = merged(rows.mapInPandas(lambda f: (_shard_rows(*e, shared.value, shards, long_list, 0, shards) for e in entries(f)), _SHARDED), shards)
    else:
        table = checkpoint(rows.mapInPandas(lambda f: (pd.DataFrame({"batch": [_packed_batch(*e)]}) for e in entries(f)), "batch binary"))
        done = []
        for i in range(rounds):
            low, high = shards * i // rounds, shards * (i + 1) // rounds

            def cut(frames: Iterator[pd.DataFrame], low: int = low, high: int = high) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for batch in frame["batch"]:
                        yield _shard_rows(*_unpacked_batch(batch), shared.value, shards, long_list, low, high)

            done.append(checkpoint(merged(table.mapInPandas(cut, _SHARDED), high - low)))
            _release(spark)
        met = reduce(DataFrame.unionByName, done)
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
    pairs = checkpoint(met.where("n >= least").select("a", "b"))
    sets = _set_pass(_asked_rows(rows, pairs, found, filter_bits), k).groupBy("k1", "k2").agg(F.first("grams").alias("grams"))
    left = sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("grams").alias("left"))
    right = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("grams").alias("right"))
    met = pairs.join(left, F.col("a") == F.col("a1")).join(right, F.col("b") == F.col("b1"))
    links = met.select("a1", "a2", "left", "b1", "b2", "right").mapInPandas(lambda f: _probe(f, threshold), _LINKS)
    return links, members


def _copy_pairs(members: DataFrame, block: int) -> DataFrame:
    """``ca, cb``: the pairs among copies of a text.

    The chunks of a text go to blocks of about ``block``, and blocks meet
    pairwise, so no task has all the pairs of a text with many copies.
    """
    many = members.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    own = members.join(many, ["k1", "k2"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = other.select("k1", "k2", F.col("own").alias("i"), F.col("other").alias("j"), F.col("chunk_id").alias("ca"))
    b = other.select("k1", "k2", F.col("other").alias("i"), F.col("own").alias("j"), F.col("chunk_id").alias("cb"))
    return a.join(b, ["k1", "k2", "i", "j"]).where("ca < cb").select("ca", "cb")


def chunk_pairs(links: DataFrame, members: DataFrame, block: int = 1_024) -> DataFrame:
    """``chunk_id_a, chunk_id_b``: every pair of chunks, copies included, the smaller id first."""
    a = members.select(F.col("chunk_id").alias("ca"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = members.select(F.col("chunk_id").alias("cb"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    linked = links.select("a1", "a2", "b1", "b2").join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("ca", "cb")
    copies = _copy_pairs(members, block)
    return (
        linked.unionByName(copies)
        .where("ca <> cb")
        .select(F.least("ca", "cb").alias("chunk_id_a"), F.greatest("ca", "cb").alias("chunk_id_b"))
        .distinct()
    )


def near_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """``chunk_id, class_id, links``: one row per chunk; copies are not expanded.

    The class is the connected component of its text among the links, named by
    its least chunk id; ``links`` counts the different texts that its text is
    linked to.  Labels spread by joins and jump to their label's label, so the
    rounds grow with the logarithm of a component's width; every round is
    written to the checkpoint folder.
    """
    names = members.groupBy("k1", "k2").agg(F.min("chunk_id").alias("name"))
    a = names.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("name").alias("x"))
    b = names.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("name").alias("y"))
    edges = links.select("a1", "a2", "b1", "b2").join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y")
    both = checkpoint(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    degree = both.groupBy(F.col("x").alias("name")).agg(F.count("*").alias("links"))
    label = checkpoint(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        spread = label.join(near, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = label.select(F.col("x").alias("m"), F.col("l").alias("far"))
        step = checkpoint(spread.join(jump, "m", "left").select("x", "l", F.least("m", F.coalesce("far", "m")).alias("m")))
        changed = step.where("l <> m").take(1)
        label = step.select("x", F.col("m").alias("l"))
        if not changed:
            break
    named = members.join(names, ["k1", "k2"]).select("chunk_id", "name")
    return (
        named.join(label.select(F.col("x").alias("name"), F.col("l").alias("class_id")), "name", "left")
        .join(degree, "name", "left")
        .select("chunk_id", F.coalesce("class_id", "name").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
