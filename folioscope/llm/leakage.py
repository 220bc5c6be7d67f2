"""Evaluation passages inside training text.

The normalised items form one generalised suffix automaton, which is sent to
the workers; all words of the training texts stream through it while the length
of the longest match ending at each word is tracked, and runs of ``least`` words
or more are reported with the items that hold them.

The automaton's size depends on the items alone.  More than ``block_words``
words of items are cut into blocks, each with its own automaton and its own
pass over the corpus; nothing grows with the corpus.

Defined results: null or short texts and items match nothing; repeated rows
give the same rows; items with the same text are all reported; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.words import WORD, words
from folioscope.session import spread

SPANS = "doc_id long, item_id long, first_word int, n_words int, start int, end int, doc_words int"


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of each state as a bitmap."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.least = least
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, owners = [-1], [0], [0]
        for bit, (_, tokens) in enumerate(items):
            last = 0
            for token in tokens:
                code = self.vocabulary.setdefault(token, len(self.vocabulary))
                last = self._extend(last, code, owners)
                owners[last] |= 1 << bit
        # an item that passes a state also passes the states of its suffixes
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        # for a match of at least ``least`` words: the owners of its last ``least`` words, as a number of their set
        self.sets = [0]
        number = {0: 0}
        self.owners_of_run = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= least:
                up = self.link[state]
                if self.length[up] >= least:
                    self.owners_of_run[state] = self.owners_of_run[up]
                    continue
                held = owners[state]
                if held not in number:
                    number[held] = len(self.sets)
                    self.sets.append(held)
                self.owners_of_run[state] = number[held]

    def _extend(self, last: int, code: int, owners: list[int]) -> int:
        if code in self.next[last]:
            to = self.next[last][code]
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, code, to, owners)
        new = self._state(self.length[last] + 1, {}, owners, 0)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][code]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._clone(at, code, to, owners)
        return new

    def _clone(self, at: int, code: int, to: int, owners: list[int]) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]), owners, owners[to])
        self.link[copy] = self.link[to]
        self.link[to] = copy
        while at >= 0 and self.next[at].get(code) == to:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, following: dict[int, int], owners: list[int], owned: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        owners.append(owned)
        return len(self.length) - 1

    def runs(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, words) of every maximal run of at least ``least`` shared words."""
        following, link, length, least, owners = self.next, self.link, self.length, self.least, self.owners_of_run
        out: list[tuple[int, int, int]] = []
        open_runs: dict[int, int] = {}
        active = state = matched = 0
        for at, code in enumerate(map(self.vocabulary.get, tokens)):
            to = following[state].get(code)
            if to is None:
                # a word that no item holds leads back to the empty match at once
                if code is None:
                    state = 0
                while state and to is None:
                    state = link[state]
                    to = following[state].get(code)
                matched = length[state]
            if to is not None:
                state = to
                matched += 1
            now = owners[state] if matched >= least else 0
            if now != active:
                before, after = self.sets[active], self.sets[now]
                self._switch(before & ~after, after & ~before, at, open_runs, out)
                active = now
        if active:
            self._switch(self.sets[active], 0, len(tokens), open_runs, out)
        return out

    def _switch(self, closed: int, opened: int, at: int, open_runs: dict[int, int], out: list) -> None:
        while closed:
            bit = (closed & -closed).bit_length() - 1
            first = open_runs.pop(bit)
            out.append((self.ids[bit], first, at - first))
            closed &= closed - 1
        while opened:
            bit = (opened & -opened).bit_length() - 1
            open_runs[bit] = at - self.least + 1
            opened &= opened - 1


def _blocks(items: DataFrame, least: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    held = 0
    named = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    for row in named.distinct().orderBy("item_id", "text").toLocalIterator():
        tokens = words(row["text"])
        if len(tokens) < least:
            continue
        if held + len(tokens) > block_words and block:
            yield block
            block, held = [], 0
        block.append((row["item_id"], tokens))
        held += len(tokens)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 12, block_words: int = 100_000) -> DataFrame:
    """Maximal shared runs of at least ``least`` words: one row per document, item and run."""
    if least < 1:
        raise ValueError("least must be positive")
    spark = documents.sparkSession
    corpus = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    parts = []
    for block in _blocks(items, least, block_words):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, least))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for frame in frames:
                out = []
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    tokens = words(text)
                    found = automaton.runs(tokens)
                    if not found:
                        continue
                    at = [m.span() for m in WORD.finditer(text)]
                    if len(at) != len(tokens):  # lower-casing changed the number of characters
                        at = [m.span() for m in WORD.finditer(text.lower())]
                    for item, first, n in found:
                        out.append((doc, item, first, n, at[first][0], at[first + n - 1][1], len(tokens)))
                yield pd.DataFrame(
                    out, columns=["doc_id", "item_id", "first_word", "n_words", "start", "end", "doc_words"]
                )

        parts.append(corpus.mapInPandas(scan, SPANS))
    if not parts:
        return spark.createDataFrame([], SPANS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def remove_leaks(documents: DataFrame, leaks: DataFrame, span_words: int = 12, most_share: float = 0.5) -> DataFrame:
    """``doc_id, text, removed_words, dropped`` of the affected documents.

    Runs of ``span_words`` or more are cut out; where they cover more than
    ``most_share`` of the document's words the whole text goes (null).
    """
    per_doc = (
        leaks.where(F.col("n_words") >= span_words)
        .groupBy("doc_id", "doc_words")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_word", "n_words"))).alias("spans"))
    )
    united = F.expr(
        """aggregate(spans, array(named_struct('a', -1, 'b', -1, 'f', -1, 'l', -1)), (acc, s) ->
             case when s.start <= element_at(acc, -1).b
               then concat(slice(acc, 1, size(acc) - 1), array(named_struct(
                 'a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.end),
                 'f', element_at(acc, -1).f, 'l', greatest(element_at(acc, -1).l, s.first_word + s.n_words))))
               else concat(acc, array(named_struct('a', s.start, 'b', s.end, 'f', s.first_word, 'l', s.first_word + s.n_words)))
             end)"""
    )
    joined = per_doc.withColumn("cuts", F.slice(united, 2, F.size(united))).join(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").distinct(), "doc_id"
    )
    covered = F.expr("aggregate(cuts, 0, (n, c) -> n + c.l - c.f)")
    kept = F.expr(
        """concat(array_join(transform(cuts, (c, i) -> substring(text,
             case when i = 0 then 1 else cuts[i - 1].b + 1 end,
             c.a - case when i = 0 then 0 else cuts[i - 1].b end)), ''),
           substring(text, element_at(cuts, -1).b + 1))"""
    )
    gone = covered > F.col("doc_words") * most_share
    return joined.select("doc_id", F.when(~gone, kept).alias("text"), covered.alias("removed_words"), gone.alias("dropped"))
