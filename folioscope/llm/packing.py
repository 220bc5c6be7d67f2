"""Texts put into containers of fixed capacity, sized in tokens of a public tokenizer.

Texts are counted in one pass; items go to shards of bounded size, and within a
shard the largest come first to the bin with the least room that still takes
them (best fit).  Bins are ordered by residual and carry bitmaps of the sources
and the duplicate clusters that they take no more of; the successor search goes
on through the roomier bins until the tightest compatible one is found, however
far it is, and a new bin is opened when there is none.

*Clusters* are the classes of near copies (five words, similarity 0.8, see
:mod:`folioscope.llm.neardup`), copies included: no container holds two of one.
*Sources*: a container holds at most the quota of each, the items of the source
spread evenly over the least number of containers with ``slack`` more, rounded
up.  A source with fewer items than there are containers has quota 1, so no
container holds it twice; only where capacity is so large that a source must
repeat does its quota rise.

Only a text above the capacity is split, into full pieces and a rest.

Defined results: null and empty texts have no tokens and are in no container;
repeated rows of one id and text count once; an id with two texts is two items,
numbered by ``part``; a null source is a source of its own; other columns are
not read.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import neardup
from folioscope.session import checkpoint, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Text between two points at which the tokenizer's own pattern always cuts.
_UNIT = re.compile(r"\s*\S+|\s+$")


def load_vocabulary(path: str = VOCABULARY) -> tuple[str, dict[bytes, int]]:
    """The tokenizer's pattern and ranks, read where the query is planned; workers get them by broadcast."""
    import public_tokenizers

    with open(path, "rb") as lines:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TokenCounter:
    """Exact token counts; the units of a text are encoded once per worker.

    The tokenizer's pattern never joins a run of non-blanks with the blanks
    behind it, so a text's count is the sum over its units.
    """

    def __init__(self, vocabulary: tuple[str, dict[bytes, int]], most_units: int = 2_000_000) -> None:
        import tiktoken

        pattern, ranks = vocabulary
        self.encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most_units = most_units

    def count(self, text: str) -> int:
        known = self.known
        units = _UNIT.findall(text)
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            if len(known) > self.most_units:
                known.clear()
            for unit in units:
                if unit not in known:
                    known[unit] = len(self.encoding.encode_ordinary(unit))
            return sum(map(known.__getitem__, units))


_SIZES = "doc_id long, source string, item string, tokens int"


def _items(documents: DataFrame) -> DataFrame:
    """``doc_id, source, item, text``; ``item`` names an id's text."""
    return documents.where("doc_id is not null and text is not null and text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))).alias("item"),
        "text",
    )


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, item, tokens`` of every text."""

    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(shared.value)
        for frame in frames:
            out = frame[["doc_id", "source", "item"]].copy()
            out["tokens"] = [counter.count(t) for t in frame["text"]]
            yield out

    return spread(_items(documents)).mapInPandas(scan, _SIZES).distinct()


def duplicate_clusters(sizes: DataFrame, documents: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``sizes`` with ``cluster``: the class of near copies, or of equal texts where they have fewer than ``k`` words."""
    texts = _items(documents).select(F.col("item").alias("chunk_id"), F.col("text").alias("content"))
    classes = neardup.near_classes(*neardup.near_copies(texts, k, threshold)).groupBy(F.col("chunk_id").alias("item")).agg(
        F.min("class_id").alias("cluster")
    )
    equal = F.concat(F.lit("text:"), F.substring_index("item", ":", -1))
    return sizes.join(classes, "item", "left").withColumn("cluster", F.coalesce("cluster", equal))


class Bins:
    """Open bins by residual, in blocks that know what all their bins refuse."""

    WIDTH = 128

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []
        self.refuse: list[int] = []
        self.full: list[int] = []

    def take(self, size: int, mask: int) -> tuple[int, int] | None:
        """Removes and returns (residual, bin) of the tightest bin with ``size`` left that refuses nothing of ``mask``."""
        at = bisect_left(self.last, (size, -1))
        for k in range(at, len(self.blocks)):
            if self.refuse[k] & mask:
                continue
            block = self.blocks[k]
            for i in range(bisect_left(block, (size, -1)) if k == at else 0, len(block)):
                if not self.full[block[i][1]] & mask:
                    found = block.pop(i)
                    self._renew(k)
                    return found
        return None

    def put(self, residual: int, number: int) -> None:
        at = min(bisect_left(self.last, (residual, number)), len(self.blocks) - 1)
        if at < 0:
            self.blocks, self.last, self.refuse, at = [[]], [(0, 0)], [0], 0
        block = self.blocks[at]
        insort(block, (residual, number))
        if len(block) > 2 * self.WIDTH:
            self.blocks.insert(at + 1, block[self.WIDTH :])
            del block[self.WIDTH :]
            self.last.insert(at + 1, (0, 0))
            self.refuse.insert(at + 1, 0)
            self._renew(at + 1)
        self._renew(at)

    def _renew(self, k: int) -> None:
        block = self.blocks[k]
        if not block:
            del self.blocks[k], self.last[k], self.refuse[k]
            return
        self.last[k] = block[-1]
        refuse = -1
        for _, number in block:
            refuse &= self.full[number]
            if not refuse:
                break
        self.refuse[k] = refuse


def source_quotas(items: list[tuple[int, str, int]], capacity: int, slack: float) -> dict[str, int]:
    """How many items of each source a container may hold."""
    containers = max(1, -(-sum(size for size, _, _ in items) // capacity))
    counts = Counter(source for _, source, _ in items)
    return {s: max(1, int(-(-n * slack // containers))) for s, n in counts.items()}


def pack_shard(items: list[tuple[int, str, int]], capacity: int, slack: float = 2.0) -> list[list[int]]:
    """Bins of item positions; ``items`` are (size, source, cluster or -1), ties in the order given."""
    quota = source_quotas(items, capacity, slack)
    source_bit = {s: 1 << k for k, s in enumerate(sorted(quota))}
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], i))
    open_bins = Bins()
    bins: list[list[int]] = []
    held: list[Counter[str]] = []
    for i in order:
        size, source, cluster = items[i]
        bit = 1 << (len(quota) + cluster) if cluster >= 0 else 0
        found = open_bins.take(size, source_bit[source] | bit)
        if found is None:
            found = (capacity, len(bins))
            bins.append([])
            held.append(Counter())
            open_bins.full.append(0)
        residual, number = found
        bins[number].append(i)
        held[number][source] += 1
        open_bins.full[number] |= bit | (source_bit[source] if held[number][source] >= quota[source] else 0)
        if residual > size:
            open_bins.put(residual - size, number)
    return bins


_PACKED = (
    "capacity int, container string, doc_id long, part int, first_token int, n_tokens int, source string, cluster string, "
    "source_quota int, split boolean"
)


def pack(
    documents: DataFrame, limits: DataFrame, shard_items: int = 20_000, path: str = VOCABULARY, slack: float = 2.0
) -> DataFrame:
    """``capacity, container, doc_id, part, first_token, n_tokens, source, cluster, source_quota, split`` of every member.

    A shard holds about ``shard_items`` items of all sources by key hash, so no
    source or cluster gathers in one task; a shard wastes at most its last few
    bins.
    """
    sizes = checkpoint(duplicate_clusters(token_sizes(documents, path).where("tokens > 0"), documents))
    capacities = [
        r[0]
        for r in limits.where("purpose = 'pack' and unit = 'tokens' and max_size > 0").select("max_size").distinct().orderBy("max_size").collect()
    ]
    spark = documents.sparkSession
    if not capacities:
        return spark.createDataFrame([], _PACKED)
    shards = max(1, -(-sizes.count() // shard_items))
    each = sizes.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities]))).withColumn(
        "shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")
    )

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(frame["capacity"].iloc[0]), int(frame["shard"].iloc[0])
        frame = frame.sort_values(["doc_id", "item", "source"]).reset_index(drop=True)
        repeated = frame["cluster"].value_counts()
        numbers = {c: k for k, c in enumerate(sorted(repeated.index[repeated > 1]))}
        part_of = frame.groupby("doc_id").cumcount()
        items, rows = [], []
        for doc, source, tokens, cluster, part in zip(frame["doc_id"], frame["source"], frame["tokens"], frame["cluster"], part_of):
            first, left = 0, int(tokens)
            while left:
                size = min(left, capacity)
                items.append((size, source, numbers.get(cluster, -1)))
                rows.append((int(doc), int(part), first, size, source, cluster if cluster in numbers else None, tokens > capacity))
                first, left = first + size, left - size
        quota = source_quotas(items, capacity, slack)
        out = []
        for k, members in enumerate(pack_shard(items, capacity, slack)):
            out += [(capacity, f"{capacity}-{shard}-{k}", *rows[i][:6], quota[rows[i][4]], rows[i][6]) for i in members]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])

    return each.groupBy("capacity", "shard").applyInPandas(fill, _PACKED)


def rule_breaks(packed: DataFrame) -> DataFrame:
    """``capacity, container, rule`` of containers that break a rule; empty if all is well."""
    filled = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("tokens"))
    sources = packed.groupBy("capacity", "container", "source").agg(F.count("*").alias("n"), F.max("source_quota").alias("quota"))
    clusters = packed.where("cluster is not null").groupBy("capacity", "container", "cluster").agg(F.count("*").alias("n"))
    named = lambda rows, rule: rows.select("capacity", "container", F.lit(rule).alias("rule"))
    return (
        named(filled.where("tokens > capacity"), "over capacity")
        .unionByName(named(sources.where("n > quota"), "source over its quota"))
        .unionByName(named(clusters.where("n > 1"), "two of one cluster"))
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, members, tokens and the share of room used, per capacity."""
    return packed.groupBy("capacity").agg(
        F.countDistinct("container").alias("containers"),
        F.count("*").alias("members"),
        F.sum("n_tokens").alias("tokens"),
        F.round(F.sum("n_tokens") / (F.countDistinct("container") * F.col("capacity")), 6).alias("used"),
    )
