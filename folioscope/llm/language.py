"""Languages of records and of their foreign segments.

Each language has unigram probabilities over the pieces of one fixed public
vocabulary.  The score of a word is the log of the sum over all its
segmentations (a forward algorithm); pieces never cross words, so a text's
score is the sum over its words and each word is summed once per worker.

The probabilities are fitted on a bounded sample of labelled rows by
expectation-maximisation over all segmentations, twice: first with the labels
as they are, then with the sample's parts put to the language that the first
fit gives them, which undoes wrong labels and mixed rows.  Everything else -
scores, segments, results - covers all rows.

Defined results: null and blank texts have no language; words with digits and
words over ``LONGEST`` characters do not count; a record without label, or
whose label names no known language, has none; repeated rows count once; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.words import WORD
from folioscope.session import spread

LANGUAGES = ("en", "fr", "de", "es", "it", "pt")
#: Names and codes by which a label names a language.
LABELS = {
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
LONGEST = 40
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A word's log probability counts at most this far below its best language.
CLAMP = 5.0
_UNKNOWN_CHARACTER = 1e-9
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"")


def named_languages(label: Column) -> Column:
    """The languages that a label names, sorted; empty if none."""
    tokens = F.regexp_extract_all(F.lower(label), F.lit(r"(\p{L}+)([-_]\p{L}{2,4})?"), F.lit(1))
    table = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)])
    codes = F.filter(F.transform(tokens, lambda t: F.element_at(table, t)), lambda c: c.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(codes)), F.array().cast("array<string>"))


class PieceModel:
    """Piece probabilities per language; the word scores of a worker."""

    def __init__(self, pieces: list[str]) -> None:
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest_piece = max(map(len, pieces), default=1)
        self.probability = np.full((len(pieces) + 1, len(LANGUAGES)), 1.0 / max(1, len(pieces)))
        self.probability[-1] = _UNKNOWN_CHARACTER

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of the segmentation lattice; unknown characters get the last row."""
        text = "▁" + word
        out = []
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest_piece) + 1):
                k = self.index.get(text[i:j])
                if k is not None:
                    out.append((i, j, k))
                elif j == i + 1:
                    out.append((i, j, -1))
        return out

    def lattice(self, words: list[str]) -> "Lattice":
        return Lattice([self.edges(w) for w in words], [len(w) + 1 for w in words])

    def log_scores(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word."""
        lattice = self.lattice(words)
        score = np.log(np.maximum(lattice.forward(self.probability)[lattice.last], 1e-300))
        return np.maximum(score, score.max(axis=1, keepdims=True) - CLAMP)

    def fit(self, counts: list[Counter], rounds: int = 3, prior: float = 0.05) -> None:
        """Expectation-maximisation of all languages at once from word counts per language."""
        every = sorted(set().union(*counts))
        weights = np.array([[c[w] for c in counts] for w in every], dtype=float).reshape(len(every), len(counts))
        lattice = self.lattice(every)
        known = len(self.index)
        for _ in range(rounds):
            expected = lattice.expected(self.probability, weights) + prior
            self.probability[:known] = expected[:known] / expected[:known].sum(axis=0)
            self.probability[-1] = _UNKNOWN_CHARACTER


class Lattice:
    """The segmentation lattices of many words as arrays: edges by the place where they start, words in order."""

    def __init__(self, edges: list[list[tuple[int, int, int]]], lengths: list[int]) -> None:
        sizes = np.array(lengths, dtype=np.int64) + 1
        first = np.cumsum(sizes) - sizes
        self.first, self.last, self.nodes = first, first + sizes - 1, int(sizes.sum())
        counts = np.fromiter(map(len, edges), dtype=np.int64, count=len(edges))
        flat = np.array([e for word in edges for e in word], dtype=np.int64).reshape(-1, 3)
        owner = np.repeat(np.arange(len(edges)), counts)
        order = np.lexsort((owner, flat[:, 0]))
        self.owner, flat = owner[order], flat[order]
        self.begin, self.end, self.piece = flat[:, 0] + first[self.owner], flat[:, 1] + first[self.owner], flat[:, 2]
        cuts = np.flatnonzero(np.diff(flat[:, 0], prepend=-1, append=-1)) if len(flat) else np.zeros(1, dtype=np.int64)
        self.places = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """The sum over all ways from a word's beginning to each node."""
        out = np.zeros((self.nodes, probability.shape[1]))
        out[self.first] = 1.0
        for a, b in self.places:
            # the edges of one place end in different nodes
            out[self.end[a:b]] += out[self.begin[a:b]] * probability[self.piece[a:b]]
        return out

    def backward(self, probability: np.ndarray) -> np.ndarray:
        """The sum over all ways from each node to its word's end."""
        out = np.zeros((self.nodes, probability.shape[1]))
        out[self.last] = 1.0
        for a, b in reversed(self.places):
            begin = self.begin[a:b]
            starts = np.flatnonzero(np.diff(begin, prepend=-1))
            out[begin[starts]] = np.add.reduceat(out[self.end[a:b]] * probability[self.piece[a:b]], starts, axis=0)
        return out

    def expected(self, probability: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, of words that occur ``weights`` times."""
        forward, backward = self.forward(probability), self.backward(probability)
        scale = weights / np.maximum(forward[self.last], 1e-300)
        used = forward[self.begin] * probability[self.piece] * backward[self.end] * scale[self.owner]
        out = np.zeros_like(probability)
        pieces = np.where(self.piece < 0, len(probability) - 1, self.piece)
        for language in range(probability.shape[1]):
            out[:, language] = np.bincount(pieces, weights=used[:, language], minlength=len(probability))
        out[-1] = 0.0
        return out


class WordScores:
    """Ids of words and their score rows; grows with the words a task meets."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), dtype=np.float32)
        self.counts = np.zeros(1024, dtype=np.int32)

    def lookup(self, tokens: list[str]) -> np.ndarray:
        ids = self.ids
        new = list(set(tokens).difference(ids))
        if new:
            counted = [len(w) <= LONGEST and w.isalpha() for w in new]
            while len(ids) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            at = np.arange(len(ids), len(ids) + len(new))
            ids.update(zip(new, at.tolist()))
            scored = [w for w, c in zip(new, counted) if c]
            if scored:
                self.rows[at[counted]] = self.model.log_scores(scored)
                self.counts[at[counted]] = 1
        return np.fromiter(map(ids.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def _units(text: str) -> list[str]:
    return text.replace(". ", ".\n").replace("? ", "?\n").replace("! ", "!\n").split("\n")


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """Lower-case pieces of the public vocabulary that stay within one word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for k in range(model.get_piece_size()):
        p = model.id_to_piece(k)
        bare = p[1:] if p.startswith("▁") else p
        if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)) and p == p.lower():
            if (bare.isalpha() or p == "▁") and "▁" not in bare:
                pieces.append(p)
    return pieces


def fit_model(sample: Iterable[tuple[str, str]], pieces: list[str]) -> PieceModel:
    """A model from (language, text) rows; the second fit follows the first one's view of the parts."""
    parts = []
    for code, text in sample:
        for unit in _units(_QUOTED.sub(" ", text)):
            words = [w for w in WORD.findall(unit.lower()) if w.isalpha() and len(w) <= LONGEST]
            if words:
                parts.append((LANGUAGES.index(code), words))
    model = PieceModel(pieces)
    counts = [Counter() for _ in LANGUAGES]
    for code, words in parts:
        counts[code].update(words)
    model.fit(counts)
    scores = WordScores(model)
    counts = [Counter() for _ in LANGUAGES]
    for code, words in parts:
        ids = scores.lookup(words)
        for word, lang in zip(words, best_path(scores.rows[ids])):
            counts[lang][word] += 1
    model.fit(counts)
    return model


def best_path(rows: np.ndarray, switch: float = 10.0) -> list[int]:
    """The language of each word: the best path with a price for every change."""
    best = rows[0].astype(float)
    back = []
    for row in rows[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def labelled_sample(
    pages: DataFrame, metadata: DataFrame, queries: DataFrame, rows_per_language: int = 120
) -> list[tuple[str, str]]:
    """(language, text) of at most ``rows_per_language`` pages and twice as many queries per language.

    Rows whose label names exactly one language, lowest key hash first; Spark
    keeps that many rows per task before any shuffle, so the bound holds at
    every size.  Page texts are read for the chosen pages only.
    """

    def lowest(rows: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("key"), "key"))
        return rows.withColumn("place", place).where(F.col("place") <= n)

    one = lambda label: F.when(F.size(named_languages(label)) == 1, F.element_at(named_languages(label), 1))
    docs = metadata.select("doc_id", one(F.col("doc_language")).alias("code")).where("code is not null").distinct()
    keys = (
        pages.where("status = 'success'").select("doc_id", F.col("page_id").alias("key")).distinct().join(docs, "doc_id")
    )
    chosen = {r["key"]: r["code"] for r in lowest(keys, rows_per_language).select("key", "code").collect()}
    texts = (
        pages.where((F.col("status") == "success") & F.col("page_id").isin(list(chosen)))
        .select("page_id", "content")
        .distinct()
        .collect()
    )
    asked = (
        queries.where("text is not null")
        .select(one(F.col("language")).alias("code"), F.col("text"), F.col("query_id").alias("key"))
        .where("code is not null")
        .distinct()
    )
    rows = [(chosen[r["page_id"]], r["content"]) for r in texts if r["content"]]
    rows += [(r["code"], r["text"]) for r in lowest(asked, 2 * rows_per_language).select("code", "text").collect()]
    return sorted(rows)


#: A record's sums: one row per language of its kept segments, one without language for the whole record.
_SCORES = [f"score_{code}" for code in LANGUAGES]
_SUMS = "record_key string, language_code string, words long, segments long, confidence double, " + ", ".join(
    f"{c} double" for c in ("counted", *_SCORES)
)
_PAGE_SUMS = _SUMS + ", page_id long, content_key long"
SEGMENTS = (
    "record_kind string, record_key string, page_id long, first_word int, words int, language_code string, "
    "segment string, confidence double, kept boolean"
)


def _confidence(gap: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Odds per two words, so that length alone makes nothing certain."""
    odds = gap / np.maximum(counted, 1) * 2
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _gap(total: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How far each row's language is above its best other one."""
    at = np.arange(len(code))
    gap = total[at, code][:, None] - total
    gap[at, code] = np.inf
    return gap.min(axis=1)


def _sums(keys: np.ndarray, parts: pd.DataFrame, total: np.ndarray, weight: str) -> pd.DataFrame:
    """``_SUMS`` of one batch of segments."""
    kept = parts["kept"].to_numpy()
    words = parts[weight].to_numpy()
    rows = pd.DataFrame(
        {"record_key": keys, "language_code": parts["language_code"], "words": words, "segments": 1, "confidence": parts["confidence"] * words}
    )[kept]
    rows = rows.groupby(["record_key", "language_code"], as_index=False).sum()
    whole = pd.DataFrame(total.astype(float), columns=_SCORES)
    whole.insert(0, "counted", parts["counted"].to_numpy(dtype=float))
    whole.insert(0, "record_key", keys)
    whole = whole.groupby("record_key", as_index=False).sum()
    out = pd.concat([rows, whole], ignore_index=True).reindex(columns=[c.split()[0] for c in _SUMS.split(", ")])
    out["language_code"] = out["language_code"].astype(object).where(out["language_code"].notna(), None)
    return out.fillna({c: 0 for c in out.columns[2:]}).astype({"words": "int64", "segments": "int64"})


def _page_parts(frame: pd.DataFrame, scores: WordScores, least_words: int) -> tuple[pd.DataFrame, np.ndarray] | None:
    """The segments of a batch of pages, ``row`` telling the page, and their scores."""
    tokens: list[str] = []
    sizes: list[int] = []
    owner: list[int] = []
    block: list[int] = []
    begins: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    blocks = 0
    for k, text in enumerate(frame["content"]):
        blocks += 1
        at, first = 0, len(tokens)
        for unit in _units(text):
            found = WORD.findall(unit.lower())
            if found:
                before.append(len(tokens) - first)
                tokens += found
                sizes.append(len(found))
                owner.append(k)
                block.append(blocks)
                begins.append(at)
                ends.append(at + len(unit))
            else:
                blocks += 1
            at += len(unit) + 1
    if not tokens:
        return None
    ids = scores.lookup(tokens)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    unit_scores = np.add.reduceat(scores.rows[ids], starts, axis=0)
    unit_words = np.add.reduceat(scores.counts[ids], starts)
    of, part = np.array(owner), np.array(block)
    # a part too short to tell follows its block
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    whole = np.add.reduceat(unit_scores, edge, axis=0).argmax(axis=1)
    whole = np.repeat(whole, np.diff(np.append(edge, len(part))))
    ranked = np.sort(unit_scores, axis=1)
    sure = (ranked[:, -1] - ranked[:, -2] > 6) & (unit_words >= 3)
    language = np.where(sure, unit_scores.argmax(axis=1), whole)
    change = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(language, prepend=-1) != 0))
    counted = np.add.reduceat(unit_words, change)
    total = np.add.reduceat(unit_scores, change, axis=0)
    code = language[change]
    last = np.append(change[1:], len(part)) - 1
    parts = pd.DataFrame(
        {
            "row": of[change],
            "first_word": np.array(before)[change],
            "words": np.add.reduceat(np.array(sizes), change),
            "counted": counted,
            "language_code": np.array(LANGUAGES, dtype=object)[code],
            "confidence": _confidence(_gap(total, code), counted),
            "kept": counted >= least_words,
            "begin": np.array(begins)[change],
            "end": np.array(ends)[last],
        }
    )
    counts = (counted > 0).nonzero()[0]
    return (parts.iloc[counts].reset_index(drop=True), total[counts]) if len(counts) else None


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.where("status = 'success' and content is not null and doc_id is not null")


def page_segments(pages: DataFrame, model: PieceModel, least_words: int = 25) -> DataFrame:
    """``SEGMENTS`` of success pages: every part with counted words, in its language.

    A page is cut at lines and sentence ends; parts of one block (between blank
    lines) and one language are joined into segments.  ``kept`` are those with
    at least ``least_words`` counted words, which are running text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for frame in frames:
            found = _page_parts(frame, scores, least_words)
            if found:
                parts = found[0]
                row = parts["row"].to_numpy()
                texts = frame["content"].tolist()
                parts["record_kind"] = "document"
                parts["record_key"] = frame["doc_id"].to_numpy()[row]
                parts["page_id"] = frame["page_id"].to_numpy()[row]
                parts["segment"] = [texts[k][i:j].strip() for k, i, j in zip(row, parts["begin"], parts["end"])]
                parts["confidence"] = parts["confidence"].round(6)
                yield parts[[c.split()[0] for c in SEGMENTS.split(", ")]]

    rows = _page_rows(pages).select("page_id", "doc_id", "content").distinct()
    return rows.mapInPandas(scan, SEGMENTS)


def page_languages(pages: DataFrame, model: PieceModel, least_words: int = 25) -> DataFrame:
    """``record_key, language_code, words, segments, confidence`` per report and language, of its kept segments.

    A report without one has its best language over all counted words, with
    ``segments`` 0.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for frame in frames:
            found = _page_parts(frame, scores, least_words)
            if found:
                parts, total = found
                sums = _sums(parts["row"].to_numpy(), parts, total, "counted")
                row = sums["record_key"].to_numpy(dtype=np.int64)
                for name, column in (("record_key", "doc_id"), ("page_id", "page_id"), ("content_key", "content_key")):
                    sums[name] = frame[column].to_numpy()[row]
                yield sums

    rows = spread(_page_rows(pages).select("page_id", "doc_id", "content", F.xxhash64("content").alias("content_key")))
    # repeated rows are told by their sums' keys, so texts are not shuffled to find them
    once = rows.mapInPandas(scan, _PAGE_SUMS).dropDuplicates(["record_key", "page_id", "content_key", "language_code"])
    return _languages(once.drop("page_id", "content_key"))


def _languages(sums: DataFrame) -> DataFrame:
    """The languages of each record: of its kept segments if there is one, else the best of the whole."""
    total = sums.groupBy("record_key", "language_code").agg(
        *[F.sum(c).alias(c) for c in ("words", "segments", "confidence", "counted", *_SCORES)]
    )
    scores = F.array(*[F.col(c) for c in _SCORES])
    ordered = F.sort_array(scores, asc=False)
    best = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position(scores, ordered[0]).cast("int"))
    odds = F.least(F.lit(30.0), (ordered[0] - ordered[1]) / F.col("counted") * 2)
    whole = F.col("segments") == 0
    any_kept = F.max("segments").over(Window.partitionBy("record_key"))
    return (
        total.select(
            "record_key",
            F.when(whole, best).otherwise(F.col("language_code")).alias("language_code"),
            F.when(whole, F.col("counted").cast("long")).otherwise(F.col("words")).alias("words"),
            "segments",
            F.round(F.when(whole, 1 / (1 + F.exp(-odds))).otherwise(F.col("confidence") / F.col("words")), 6).alias("confidence"),
        )
        .withColumn("any_kept", any_kept)
        .where("segments > 0 or any_kept = 0")
        .drop("any_kept")
    )


def _query_parts(
    frame: pd.DataFrame, scores: WordScores, least_words: int, least_gap: float
) -> tuple[pd.DataFrame, np.ndarray] | None:
    """The clauses of a batch of queries, ``row`` telling the query, and their scores."""
    out, totals = [], []
    for row, text in enumerate(frame["text"]):
        found = list(WORD.finditer(_QUOTED.sub(lambda m: " " * len(m.group()), text)))
        ids = scores.lookup([m.group().lower() for m in found])
        # a query that is nothing but a title has the title's language, which is no clause
        titled = not scores.counts[ids].any()
        if titled:
            found = list(WORD.finditer(text))
            ids = scores.lookup([m.group().lower() for m in found])
        if not found:
            continue
        rows = scores.rows[ids]
        path = best_path(rows)
        begin = 0
        for k in range(1, len(path) + 1):
            if k < len(path) and path[k] == path[begin]:
                continue
            part = rows[begin:k].sum(axis=0)
            counted = int(scores.counts[ids[begin:k]].sum())
            gap = float(part[path[begin]] - np.delete(part, path[begin]).max())
            if counted:
                kept = not titled and counted >= least_words and gap >= least_gap
                segment = text[found[begin].start() : found[k - 1].end()]
                confidence = float(_confidence(np.float64(gap), np.float64(counted)))
                out.append((row, begin, k - begin, counted, LANGUAGES[path[begin]], segment, confidence, kept))
                totals.append(part)
            begin = k
    columns = ["row", "first_word", "words", "counted", "language_code", "segment", "confidence", "kept"]
    return (pd.DataFrame(out, columns=columns), np.array(totals)) if out else None


def _query_rows(queries: DataFrame) -> DataFrame:
    return queries.where("query_id is not null and text is not null").select("query_id", "text").distinct()


def query_segments(queries: DataFrame, model: PieceModel, least_words: int = 4, least_gap: float = 6.0) -> DataFrame:
    """``SEGMENTS`` of queries: the clauses of each with language, place and confidence.

    Quoted titles are left out first, unless there is nothing else.  ``kept``
    are clauses with at least ``least_words`` counted words that beat every
    other language by ``least_gap``.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for frame in frames:
            found = _query_parts(frame, scores, least_words, least_gap)
            if found:
                parts = found[0]
                parts["record_kind"] = "query"
                parts["record_key"] = frame["query_id"].to_numpy()[parts["row"].to_numpy()].astype(str)
                parts["page_id"] = None
                parts["confidence"] = parts["confidence"].round(6)
                yield parts[[c.split()[0] for c in SEGMENTS.split(", ")]]

    return _query_rows(queries).mapInPandas(scan, SEGMENTS)


def query_languages(queries: DataFrame, model: PieceModel, least_words: int = 4, least_gap: float = 6.0) -> DataFrame:
    """``record_key, language_code, words, segments, confidence`` per query and language, as ``page_languages``."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for frame in frames:
            found = _query_parts(frame, scores, least_words, least_gap)
            if found:
                parts, total = found
                yield _sums(frame["query_id"].to_numpy()[parts["row"].to_numpy()].astype(str), parts, total, "words")

    return _languages(_query_rows(queries).mapInPandas(scan, _SUMS))


def record_languages(pages: DataFrame, metadata: DataFrame, queries: DataFrame, model: PieceModel) -> DataFrame:
    """``record_kind, record_key, language_code, words, confidence, segments, labels`` of every record and language.

    ``segments`` counts the kept ones; 0 tells that the whole record was judged,
    and a record without counted words has no language with confidence 0.
    """

    def labels(rows: DataFrame, key: str, label: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record_key")).agg(
            F.array_distinct(F.flatten(F.collect_set(named_languages(F.col(label))))).alias("labels")
        )

    def records(kind: str, found: DataFrame, named: DataFrame) -> DataFrame:
        return named.join(found, "record_key", "left").select(
            F.lit(kind).alias("record_kind"),
            "record_key",
            "language_code",
            F.coalesce("words", F.lit(0)).alias("words"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("segments", F.lit(0)).alias("segments"),
            "labels",
        )

    return records("document", page_languages(pages, model), labels(metadata, "doc_id", "doc_language")).unionByName(
        records("query", query_languages(queries, model), labels(queries, "query_id", "language"))
    )


def unlabelled_languages(records: DataFrame) -> DataFrame:
    """Languages with kept segments in the record that its label does not name."""
    return (
        records.where("segments > 0")
        .where(~F.array_contains("labels", F.col("language_code")))
        .select("record_kind", "record_key", "language_code")
        .distinct()
    )
