"""Noise of scanned pages found and repaired.

Word counts of all scanned pages give a vocabulary of frequent words, and the
pairs within a window give each of them a skip-gram vector.  A rare word is
linked to the frequent neighbours that plausible glyph edits turn it into, or,
if there is none, to the words that all pages' counts hold; at each of its
occurrences the vectors of the candidates are held against the words around
it, and the best one is taken if counts and context together speak for a
misreading.  Then furniture is removed, broken words are joined and lines are
reflowed.

Noise of a page: ``hyphen`` a word broken at a line end by a mark that is not
its own; ``chars`` misread characters in the running text; ``header`` a line at
the top or bottom that names the report or a chapter where at least two pages
of the report have one; ``folio`` a line there that is only the page number.

Defined results: pages that are not scanned, not successful or null have no
noise; repeated rows count once; a report without publisher has headers with
chapter names only; a word that no candidate explains is left as it is; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import skipgram
from folioscope.session import checkpoint

#: What a scanner reads, and what it saw.
GLYPHS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("!", "i"), ("!", "l"), ("!", "í"),
    ("|", "l"), ("|", "i"), ("(", "c"), ("†", "t"), ("æ", "a"), ("€", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("c", "e"),
    ("ri", "n"), ("ii", "u"), ("cl", "d"), ("(l", "d"), ("rn", "m"), ("vv", "w"), ("b", "h"), ("m", "in"), ("m", "rn"), ("l", "i"),
    ("u", "ll"), ("li", "h"),
)
_MARKS = "-‐­¬"
_BROKEN = re.compile(rf"([{_MARKS}])[ \t]*\n\s*")
_ENDS_BROKEN = re.compile(rf"([^\W\d_]{{2,}})([{_MARKS}])[ \t]*$")
_SPLIT = re.compile(r"[\s'’‘`/]+")
_STRIP = ".,;:\"«»“”„)]…?*_#[{}<>"
_LETTERS = re.compile(r"[^\W\d_]+")
_FOLIO = re.compile(r"^[\W_]*(?:(?:page|seite|página|pagina|p\.?)\s*)?(\d{1,3}(?:\s*/\s*\d{1,3})?|[ivxlc]{1,9})[\W_]*$")
_ROMAN = re.compile(r"^(?=.)c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBERED = re.compile(r"^[\W_]*[\dlOoI]{1,4}\s{2,}\S|\S\s{2,}[\dlOoI]{1,4}[\W_]*$|\|")
EDGE = 5


_ALIKE = str.maketrans("1!|l0(eæ†5896h€", "iiiiocc" + "atsbgbbc")


class _Memo(dict):
    """A function's values by argument, forgotten when there are too many."""

    def __init__(self, function, most: int = 500_000) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) > self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def _skeleton(text: str) -> str:
    text = text.replace("cl", "d").replace("(l", "d").translate(_ALIKE)
    for seen, meant in (("vv", "w"), ("ii", "u"), ("in", "m"), ("ri", "n"), ("rn", "m"), ("in", "m")):
        text = text.replace(seen, meant)
    return text


_SKELETONS = _Memo(_skeleton)


def skeleton(text: str) -> str:
    """A form in which a word and its misreadings are alike."""
    return _SKELETONS[text.lower()]


def _parts(raw: str) -> tuple[str, ...]:
    """The word-like strings of one run without blanks, in lower case."""
    out = []
    for piece in _SPLIT.split(raw):
        word = piece.strip(_STRIP)
        if len(word) > 1 and word[-1] in "!":
            word = word[:-1]
        if "-" in word or "‐" in word:
            if len(word) > 3:
                out.append(word)
            out += [p for p in re.split("[-‐]", word) if p]
        elif word:
            out.append(word)
    return tuple(out)


_PARTS = _Memo(_parts)


def _is_inside(m: re.Match) -> bool:
    """Whether a mark at a line end stands between a letter and a letter or digit."""
    text = m.string
    return m.start() > 0 and text[m.start() - 1].isalpha() and m.end() < len(text) and text[m.end()].isalnum()


def _around(m: re.Match) -> tuple[str, str]:
    """The runs without blanks before and behind a broken line end."""
    left = m.string[max(0, m.start() - 80) : m.start()].split()
    right = m.string[m.end() : m.end() + 80].split(None, 1)
    return left[-1] if left else "", right[0] if right else ""


def _runs(text: str) -> list[str]:
    """Runs without blanks in lower case, words joined over broken line ends."""
    return _BROKEN.sub(lambda m: "" if _is_inside(m) else m.group(), text).lower().split()


def tokens(text: str) -> list[str]:
    """Word-like strings in lower case: joined over broken line ends, odd characters kept."""
    parts = _PARTS
    return [w for raw in _runs(text) for w in parts[raw]]


def _is_folio(line: str) -> bool:
    bare = line.strip().lower()
    m = _FOLIO.match(bare)
    if m:
        if m.group(1)[0].isdigit() or _ROMAN.match(m.group(1)):
            return True
    core = re.sub(r"^[\W_]+|[\W_]+$", "", line.strip())
    fixed = core.translate(str.maketrans("lIOo!|", "110011"))
    return bool(re.match(r"^\d{1,3}(\s*/\s*\d{1,3})?$", fixed)) and len(core) < 9


def _edge_lines(lines: list[str]) -> list[int]:
    filled = [i for i, line in enumerate(lines) if line.strip()]
    return sorted({*filled[:EDGE], *filled[-EDGE:]})


def _line_role(line: str, publisher: set[str]) -> tuple[str, str]:
    """('folio' | 'named' | 'chapter' | 'notice' | 'text', key): what an edge line may be."""
    bare = line.strip()
    if len(bare) < 24 and _is_folio(bare):
        return "folio", ""
    alike = _skeleton(bare.lower())
    if not (publisher and all(p in alike for p in publisher)) and (len(bare) > 70 or not _NUMBERED.search(bare)):
        return "text", ""
    raw = re.findall(r"[^\W_][^\s,.;:|]*", line)
    words = [skeleton(w) for w in raw if not re.fullmatch(r"[\dlLoOiI!/]+", w)]
    named = bool(publisher) and publisher <= set(words)
    rest = [w for w in words if w not in publisher]
    closed = bool(re.search(r"[.;,:!?]\W*$", line))
    if named and (len(rest) > 5 or closed):
        return "notice", ""
    if named and rest:
        return "named", " ".join(rest)
    if not named and 1 <= len(rest) <= 5 and not closed and _NUMBERED.search(bare):
        return "chapter", " ".join(rest)
    return "text", ""


def scanned_pages(pages: DataFrame) -> DataFrame:
    """Scanned pages, repeated rows once, over as many tasks as shuffles have: what follows is heavy for its bytes."""
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pages.where("status = 'success' and content is not null and metadata['parser'] = 'layout'")
        .select("page_id", "doc_id", "page_number", "content")
        .repartition(partitions, "page_id")
        .distinct()
    )


def word_counts(scanned: DataFrame) -> DataFrame:
    """``word, n`` over all scanned pages, counted per task first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def words() -> pd.DataFrame:
            total: Counter[str] = Counter()
            for raw, n in seen.items():
                for word in _PARTS[raw]:
                    total[word] += n
            seen.clear()
            return pd.DataFrame(list(total.items()), columns=["word", "n"])

        for frame in frames:
            for text in frame["content"]:
                seen.update(_runs(text))
            if len(seen) > 500_000:
                yield words()
        yield words()

    return scanned.select("content").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, least: int = 20, least_share: float = 1e-6) -> dict[str, int]:
    """Words with at least ``least`` occurrences and ``least_share`` of all: fewer than 1 / ``least_share``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(least, total * least_share)).collect()
    return {r["word"]: r["n"] for r in rows}


def glyph_fixes(word: str, edits: int = 1) -> set[str]:
    """What the word may have been, with at most ``edits`` misread places."""
    found, last = set(), {word}
    for _ in range(edits):
        new = set()
        for w in last:
            for seen, meant in GLYPHS:
                at = w.find(seen)
                while at >= 0:
                    new.add(w[:at] + meant + w[at + len(seen) :])
                    at = w.find(seen, at + 1)
        found |= new
        last = new
    found.discard(word)
    return found


_NOTED = "kind string, page_id long, doc_id string, word string, nth int, near array<int>, key string, line_no int, blob binary"
_NOTED_COLUMNS = [c.split()[0] for c in _NOTED.split(", ")]
_WINDOW = 2


def _note_pass(scanned: DataFrame, metadata: DataFrame, known: dict[str, int], contexts: int) -> DataFrame:
    """Rare words with the frequent words near them, broken words, edge lines of each page; pair counts of each task.

    Words are numbered by frequency, so the first ``contexts`` numbers are the
    context words.  Pair counts leave a task as one row per block of words.
    """
    order = sorted(known, key=lambda w: (-known[w], w))
    shared = scanned.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(order)})
    owners = metadata.where("doc_id is not null").groupBy("doc_id").agg(F.max("publisher").alias("publisher"))
    rows = scanned.join(owners, "doc_id", "left").select("page_id", "doc_id", "content", "publisher")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value.get
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for frame in frames:
            out, new = [], []
            for page, doc, text, publisher in frame.itertuples(index=False):
                names = {skeleton(w) for w in re.findall(r"[^\W_]+", publisher)} if isinstance(publisher, str) else set()
                lines = text.split("\n")
                running = list(lines)
                for i in _edge_lines(lines):
                    role, key = _line_role(lines[i], names)
                    if role != "text":
                        running[i] = ""
                    if role in ("folio", "named", "chapter"):
                        out.append((role, page, doc, None, None, None, key, i, None))
                body = "\n".join(line for line, whole in zip(running, lines) if line or not whole.strip())
                for m in _BROKEN.finditer(body):
                    if _is_inside(m) and _is_broken(m.group(1), *_around(m), shared.value):
                        out.append(("hyphen", page, doc, None, None, None, None, None, None))
                        break
                else:
                    last = _ENDS_BROKEN.search(body.rstrip())
                    if last and last.group(1).lower() not in shared.value:
                        out.append(("hyphen", page, doc, None, None, None, None, None, None))
                words = tokens(body)
                ids = np.array([number(w, -1) for w in words], dtype=np.int64)
                is_context = (ids >= 0) & (ids < contexts)
                for gap in range(1, _WINDOW + 1):
                    for word, context, near in ((ids[:-gap], ids[gap:], is_context[gap:]), (ids[gap:], ids[:-gap], is_context[:-gap])):
                        both = (word >= 0) & near
                        new.append(word[both] * contexts + context[both])
                seen: Counter[str] = Counter()
                for i in np.flatnonzero(ids < 0).tolist():
                    w = words[i]
                    if w.upper() != w:
                        near = [int(ids[k]) for k in range(max(0, i - _WINDOW), min(len(words), i + _WINDOW + 1)) if is_context[k]]
                        out.append(("rare", page, doc, w, seen[w], near, None, None, None))
                        seen[w] += 1
            if new:
                codes, counts = _summed(np.concatenate([codes, *new]), np.concatenate([counts, np.ones(sum(map(len, new)), dtype=np.int64)]))
            yield pd.DataFrame(out, columns=_NOTED_COLUMNS)
            if len(codes) > 8_000_000:
                yield _pair_rows(codes, counts, contexts)
                codes, counts = codes[:0], counts[:0]
        yield _pair_rows(codes, counts, contexts)

    return rows.mapInPandas(scan, _NOTED)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts added."""
    every, at = np.unique(codes, return_inverse=True)
    return every, np.bincount(at, weights=counts, minlength=len(every)).astype(np.int64)


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(codes.astype(np.uint32).tobytes() + counts.astype(np.uint64).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zlib.decompress(blob)
    n = len(body) // 12
    return np.frombuffer(body, np.uint32, n).astype(np.int64), np.frombuffer(body[4 * n :], np.uint64).astype(np.int64)


def _pair_rows(codes: np.ndarray, counts: np.ndarray, contexts: int) -> pd.DataFrame:
    """One row per block of words; ``line_no`` is the block."""
    blocks = codes // (contexts * skipgram.BLOCK)
    out = []
    for block in np.unique(blocks).tolist():
        own = blocks == block
        blob = _packed(codes[own] - block * contexts * skipgram.BLOCK, counts[own])
        out.append(("pairs", None, None, None, None, None, None, block, blob))
    return pd.DataFrame(out, columns=_NOTED_COLUMNS)


def _is_broken(mark: str, left: str, right: str, known: dict[str, int]) -> bool:
    """Whether the mark between the parts of a word at a line end is not the word's own."""
    if mark in "\xad¬":
        return True
    a, b = left.lower().lstrip("(\"«“'"), right.lower().rstrip(_STRIP + "!-‐" + "'’")
    tail, head = re.split(r"[-‐'’]", a)[-1], re.split(r"[-‐'’]", b)[0]
    if tail + head in known:
        return True
    if f"{a}-{b}" in known or f"{tail}-{head}" in known or f"{a}-{head}" in known or f"{tail}-{b}" in known:
        return False
    return not (tail in known and head in known) and not head[:1].isdigit()


def word_vectors(noted: DataFrame, known: dict[str, int], contexts: int) -> tuple[DataFrame, np.ndarray]:
    """(``fix, vector`` of every frequent word, vectors of the context words).

    A block's table (``BLOCK`` words by ``contexts``) is what one task holds; to
    the driver come the first block and the column sums.
    """
    spark = noted.sparkSession
    order = sorted(known, key=lambda w: (-known[w], w))
    contexts = min(contexts, max(1, len(order)))
    shape = (skipgram.BLOCK, contexts)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape[0] * shape[1], dtype=np.int64)
        for blob in frame["blob"]:
            codes, counts = _unpacked(blob)
            np.add.at(total, codes, counts)
        at = np.flatnonzero(total)
        margin = total.reshape(shape).sum(axis=0)
        return pd.DataFrame({"block": frame["line_no"].iloc[:1], "blob": [_packed(at, total[at])], "margin": [margin.tobytes()]})

    blocks = checkpoint(
        noted.where("kind = 'pairs'").select("line_no", "blob").groupBy("line_no").applyInPandas(add, "block int, blob binary, margin binary")
    )

    def table(blob: bytes) -> np.ndarray:
        total = np.zeros(shape[0] * shape[1])
        codes, counts = _unpacked(blob)
        total[codes] = counts
        return total.reshape(shape)

    margin = sum((np.frombuffer(r[0], dtype=np.int64) for r in blocks.select("margin").collect()), np.zeros(contexts))
    share = margin / max(1.0, margin.sum())
    first = blocks.where("block = 0").select("blob").first()
    context = skipgram.learn_contexts(table(first[0])[: len(order)] if first else np.zeros((1, contexts)))
    shared = spark.sparkContext.broadcast((order, share, context))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, shares, learned = shared.value
        for frame in frames:
            for block, blob in frame.itertuples(index=False):
                own = words[block * shape[0] : (block + 1) * shape[0]]
                vectors = skipgram.solve_words(table(blob)[: len(own)], shares, learned)
                yield pd.DataFrame({"fix": own, "vector": list(vectors.astype(np.float32))})

    return blocks.select("block", "blob").mapInPandas(solve, "fix string, vector array<float>"), context


#: A misreading of one form is expected at most in this share of a word's occurrences.
_RATE = 0.05
#: Context may outweigh a factor of e to this power in the counts.
_CONTEXT = 2.0


def expected_misreadings(n: np.ndarray | float) -> np.ndarray | float:
    """The most misreadings of one kind that a word seen ``n`` times may have: the rate, and three deviations."""
    return _RATE * n + 3 * np.sqrt(_RATE * n)


def candidates(rare: DataFrame, counts: DataFrame, known: dict[str, int]) -> DataFrame:
    """``word, n, fix, of``: what each rare word may be, with the counts of both.

    Frequent words by one glyph edit, else by two; where there are none, any
    counted word by one edit, or the commonest word of the same skeleton,
    however many edits that is.
    """
    shared = rare.sparkSession.sparkContext.broadcast(known)
    asked = rare.select("word").distinct().join(counts, "word")

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for frame in frames:
            out = []
            for word, n in frame.itertuples(index=False):
                fixes = sorted(glyph_fixes(word))
                near = [f for f in fixes if f in words]
                if not near and len(word) > 4:
                    near = sorted(f for f in glyph_fixes(word, 2) if f in words)
                near = [f for f in near if np.log(expected_misreadings(words[f]) / n) >= -_CONTEXT]
                out += [(word, n, f, words[f], None) for f in near]
                if not near:
                    out += [(word, n, f, None, None) for f in fixes]
                    out.append((word, n, None, None, skeleton(word)))
            yield pd.DataFrame(out, columns=["word", "n", "fix", "of", "form"])

    proposed = asked.mapInPandas(propose, "word string, n long, fix string, of long, form string")

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(skeleton(w), w, n) for w, n in frame[["word", "n"]].itertuples(index=False) if w.upper() != w]
            yield pd.DataFrame(rows, columns=["form", "fix", "of"])

    commonest = (
        counts.mapInPandas(forms, "form string, fix string, of long")
        .groupBy("form")
        .agg(F.max_by(F.struct("fix", "of"), F.struct("of", "fix")).alias("best"))
        .select("form", "best.fix", "best.of")
    )
    enough = F.col("n") <= _RATE * F.col("of") + 3 * F.sqrt(_RATE * F.col("of"))
    named = counts.select(F.col("word").alias("fix"), F.col("n").alias("of"))
    by_edit = proposed.where("of is null and fix is not null").select("word", "n", "fix").join(named, "fix").where(enough)
    by_form = proposed.where("form is not null").select("word", "n", "form").join(commonest, "form").where(enough & (F.col("fix") != F.col("word")))
    columns = ["word", "n", "fix", "of"]
    return (
        proposed.where("of is not null").select(columns).unionByName(by_edit.select(columns)).unionByName(by_form.select(columns)).distinct()
    )


def corrections(noted: DataFrame, counts: DataFrame, known: dict[str, int], contexts: int, use_vectors: bool = True) -> DataFrame:
    """``page_id, word, nth, fix`` of every misread occurrence, decided in its own context.

    ``use_vectors`` off leaves the vectors out, which shows what they decide.
    """
    rare = noted.where("kind = 'rare'").select("page_id", "word", "nth", "near")
    vectors, context = word_vectors(noted, known, contexts)
    if not use_vectors:
        vectors = vectors.where("false")
    choices = (
        candidates(rare, counts, known)
        .join(vectors, "fix", "left")
        .groupBy("word", "n")
        .agg(F.collect_list(F.struct("fix", "of", "vector")).alias("choices"))
    )
    shared = noted.sparkSession.sparkContext.broadcast(context)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        ready: dict[str, tuple] = {}
        for frame in frames:
            out = []
            if len(ready) > 100_000:
                ready.clear()
            for page, word, nth, near, n, found in frame.itertuples(index=False):
                if word not in ready:
                    ready[word] = _scored(found, n)
                fixes, scores, vectors, has = ready[word]
                if has.any() and near is not None and len(near):
                    around = learned[[k for k in near if k < len(learned)]]
                    scores = scores + np.where(has, skipgram.context_evidence(vectors, around, _CONTEXT), 0)
                best = int(scores.argmax())
                if scores[best] >= 0:
                    out.append((page, word, nth, fixes[best]))
            yield pd.DataFrame(out, columns=["page_id", "word", "nth", "fix"])

    met = rare.join(choices, "word").select("page_id", "word", "nth", "near", "n", "choices")
    return met.mapInPandas(choose, "page_id long, word string, nth int, fix string")


def _scored(found, n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A word's candidates in order, their count scores, vectors, and whether they have one."""
    found = sorted(found, key=lambda c: (-c["of"], c["fix"]))
    has = np.array([c["vector"] is not None for c in found])
    width = max((len(c["vector"]) for c in found if c["vector"] is not None), default=1)
    vectors = np.array([c["vector"] if c["vector"] is not None else np.zeros(width) for c in found], dtype=float)
    scores = np.log(expected_misreadings(np.array([c["of"] for c in found], dtype=float)) / n)
    return [c["fix"] for c in found], scores, vectors, has


def _headers(noted: DataFrame, least_pages: int = 2, least_share: float = 0.25) -> DataFrame:
    """``page_id, line_no`` of running headers.

    A chapter line is one if its report repeats it, or if a good share of the
    lines like it stand in reports that repeat them: then it is a header that
    this report has once.
    """
    lines = noted.where("kind in ('named', 'chapter')").select("kind", "page_id", "doc_id", "key", "line_no")
    in_report = lines.where("kind = 'chapter'").groupBy("doc_id", "key").agg(F.countDistinct("page_id").alias("pages"))
    repeated = F.col("pages") >= least_pages
    anywhere = in_report.groupBy("key").agg((F.sum(F.when(repeated, F.col("pages")).otherwise(0)) / F.sum("pages")).alias("share"))
    chapters = (
        lines.where("kind = 'chapter'").join(in_report, ["doc_id", "key"]).join(anywhere, "key").where(repeated | (F.col("share") >= least_share))
    )
    columns = ["page_id", "doc_id", "line_no"]
    all_lines = lines.where("kind = 'named'").select(columns).unionByName(chapters.select(columns))
    reports = all_lines.groupBy("doc_id").agg(F.countDistinct("page_id").alias("pages")).where(repeated)
    return all_lines.join(reports.select("doc_id"), "doc_id", "left_semi").select("page_id", "line_no").distinct()


@dataclass(frozen=True)
class ScanStudy:
    """What all scanned pages tell: noted rows, corrections, headers, and the frequent words with their counts."""

    noted: DataFrame
    fixes: DataFrame
    headers: DataFrame
    known: dict[str, int]


def study_scans(pages: DataFrame, metadata: DataFrame, contexts: int = 512, use_vectors: bool = True) -> ScanStudy:
    """Everything about the scanned pages that no single page tells."""
    scanned = scanned_pages(pages)
    counts = checkpoint(word_counts(scanned))
    frequent = frequent_words(counts)
    known = {w: n for w, n in frequent.items() if not _misread(w, frequent)}
    noted = checkpoint(_note_pass(scanned, metadata, known, min(contexts, max(1, len(known)))))
    fixes = checkpoint(corrections(noted, counts, known, contexts, use_vectors))
    return ScanStudy(noted, fixes, _headers(noted), known)


def _misread(word: str, frequent: dict[str, int]) -> bool:
    """A misreading common enough to be frequent itself."""
    return len(word) > 2 and not word.isdecimal() and any(frequent.get(f, 0) >= 20 * frequent[word] for f in glyph_fixes(word))


def scan_noise(study: ScanStudy) -> DataFrame:
    """``page_id, noise`` of every page and kind."""
    noted = study.noted
    parts = [
        noted.where("kind = 'hyphen'").select("page_id", F.lit("hyphen").alias("noise")),
        study.fixes.select("page_id", F.lit("chars").alias("noise")),
        study.headers.select("page_id", F.lit("header").alias("noise")),
        noted.where("kind = 'folio'").select("page_id", F.lit("folio").alias("noise")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def repair_scans(pages: DataFrame, study: ScanStudy, metadata: DataFrame | None = None) -> DataFrame:
    """``page_id, content``: scanned pages without furniture, mended and reflowed.

    A paragraph that runs over a page end stands whole on the page where it
    begins.  Notices at the edges (they name the publisher in ``metadata``, or
    stand at the edge of another page of the report) are paragraphs of their
    own and are stepped over.  Nothing is joined over a failed page, or where
    two rows claim one page number.
    """
    furniture = (
        study.noted.where("kind = 'folio'").select("page_id", "line_no").unionByName(study.headers).groupBy("page_id").agg(
            F.collect_set("line_no").alias("gone")
        )
    )
    wrong = (
        study.fixes.groupBy("page_id", "word")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fix"))), lambda c: c["fix"]).alias("fix"))
        .groupBy("page_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("fixes"))
    )
    shared = pages.sparkSession.sparkContext.broadcast(study.known)
    rows = scanned_pages(pages).join(furniture, "page_id", "left").join(wrong, "page_id", "left")
    if metadata is None:
        rows = rows.withColumn("publisher", F.lit(None).cast("string"))
    else:
        owners = metadata.where("doc_id is not null").groupBy("doc_id").agg(F.max("publisher").alias("publisher"))
        rows = rows.join(owners, "doc_id", "left")
    columns = ["report", "page_id", "page_number", "content", "gone", "fixes", "publisher"]
    rows = rows.withColumn("report", F.coalesce(F.concat(F.lit("d"), "doc_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"))))
    # pages that did not come through stand between their neighbours
    lost = pages.where("doc_id is not null and status = 'failed' and metadata['parser'] = 'layout'").select(
        F.concat(F.lit("d"), "doc_id").alias("report"), "page_number"
    ).distinct()

    def mend(frame: pd.DataFrame) -> pd.DataFrame:
        names: set[str] = set()
        for publisher in {p for p in frame["publisher"].tolist() if isinstance(p, str)}:
            names |= {skeleton(w) for w in re.findall(r"[^\W_]+", publisher)}
        seen: Counter[str] = Counter()
        kept, mended = [], []
        for content, gone in zip(frame["content"].tolist(), frame["gone"].tolist()):
            if content is None:
                kept.append(None)
                continue
            drop = set() if gone is None else set(gone)
            lines = [line for i, line in enumerate(content.split("\n")) if i not in drop]
            kept.append(lines)
            seen.update({_edge_key(lines[i]) for i in _edge_lines(lines)})
        for fixes, lines in zip(frame["fixes"].tolist(), kept):
            if lines is None:
                mended.append(None)
                continue
            notices = set()
            for i in _edge_lines(lines):
                key = _edge_key(lines[i])
                # a line that fills a page is text; notices come once or twice
                if _line_role(lines[i], names)[0] == "notice" or (
                    key and seen[key] > 1 and sum(_edge_key(line) == key for line in lines) <= 2
                ):
                    notices.add(i)
            correct = _corrector(dict(fixes) if fixes is not None else {})
            blocks: list[tuple[str, bool]] = []
            for notice, part in itertools.groupby(range(len(lines)), lambda i: i in notices):
                if notice:
                    texts = [lines[i] for i in part]
                else:
                    texts = ["\n".join(lines[i] for i in part)]
                for text in texts:
                    body = correct(_BROKEN.sub(lambda m: _joint(m, shared.value), text))
                    blocks += [(t, notice) for t in (" ".join(b.split()) for b in re.split(r"\n\s*\n", body)) if t]
            mended.append(blocks)
        _join_pages(frame["page_number"].tolist(), mended, shared.value)
        out = [(page, "\n\n".join(t for t, _ in blocks)) for page, blocks in zip(frame["page_id"], mended) if blocks is not None]
        return pd.DataFrame(out, columns=["page_id", "content"])

    every = rows.select(columns).unionByName(
        lost.join(rows.select("report").distinct(), "report", "left_semi"), allowMissingColumns=True
    )
    return every.groupBy("report").applyInPandas(mend, "page_id long, content string")


def _edge_key(line: str) -> str:
    """A long line with its numbers left out; empty for a short one."""
    if len(line) < 40:
        return ""
    key = " ".join(_LETTERS.findall(line.lower()))
    return key if len(key) >= 40 else ""


_CLOSED = re.compile(r"[.!?:…][\W_]*$")


def _join_pages(numbers: list[int | None], pages: list[list[tuple[str, bool]] | None], known: dict[str, int]) -> None:
    """Moves what continues a paragraph of an earlier page to its end; blocks are (text, whether a notice)."""
    claims = Counter(n for n in numbers if not pd.isna(n))
    order = sorted((i for i, n in enumerate(numbers) if not pd.isna(n)), key=lambda i: numbers[i])
    open_at: tuple[int, int] | None = None
    for i in order:
        blocks = pages[i]
        if blocks is None or claims[numbers[i]] > 1:
            open_at = None
            continue
        prose = [k for k, (_, notice) in enumerate(blocks) if not notice]
        if not prose:
            continue
        if open_at is not None:
            at, k = open_at
            joined = _continued(pages[at][k][0], blocks[prose[0]][0], known)
            if joined is not None:
                pages[at][k] = (joined, False)
                del blocks[prose[0]]
                if len(prose) == 1:
                    continue
                prose = [k for k, (_, notice) in enumerate(blocks) if not notice]
        open_at = (i, prose[-1])


def _continued(tail: str, head: str, known: dict[str, int]) -> str | None:
    """The two parts of one paragraph as one; None where the second does not continue the first."""
    broken = _ENDS_BROKEN.search(tail)
    if broken and head[:1].isalpha():
        return _BROKEN.sub(lambda m: _joint(m, known), f"{tail}\n{head}")
    if _CLOSED.search(tail) or not tail or "|" in tail or "|" in head or not head[:1].isalnum():
        return None
    # a small letter goes on; a name, a noun or a number does so behind running text only
    if head[:1].islower() or (len(tail.split()) >= 12 and len(head.split()) >= 4 and _CLOSED.search(head)):
        return f"{tail} {head}"
    return None


def _joint(m: re.Match, known: dict[str, int]) -> str:
    """What stands between the parts of a word at a line end: nothing, or a mark of its own."""
    if not _is_inside(m):
        return m.group()
    return "" if _is_broken(m.group(1), *_around(m), known) else m.group(1)


_INSIDE = "!|(†€"


def _is_whole(text: str, begin: int, end: int) -> bool:
    """Whether no letter or digit, nor a misread character beside one, stands next to the span."""
    if begin and (text[begin - 1].isalnum() or (text[begin - 1] in _INSIDE and begin > 1 and text[begin - 2].isalnum())):
        return False
    return end == len(text) or not (
        text[end].isalnum() or (text[end] in _INSIDE and end + 1 < len(text) and text[end + 1].isalnum())
    )


def _corrector(fixes: dict[str, list[str]]):
    """A function that corrects a page's whole words in order of occurrence, in one pass over a text."""
    if not fixes:
        return lambda text: text
    found: Counter[str] = Counter()

    def correct(text: str) -> str:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places = []
        for word in fixes:
            at = low.find(word)
            while at >= 0:
                if _is_whole(text, at, at + len(word)):
                    places.append((at, -len(word), word))
                at = low.find(word, at + 1)
        out, done = [], 0
        # of words that begin at one place, the longest
        for at, _, word in sorted(places):
            if at < done:
                continue
            found[word] += 1
            choices, end = fixes[word], at + len(word)
            out += [text[done:at], _cased(text[at:end], choices[min(found[word], len(choices)) - 1])]
            done = end
        return "".join([*out, text[done:]])

    return correct


def _cased(seen: str, right: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right
