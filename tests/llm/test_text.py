"""Near copies, languages, scans and truncation."""

import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import hashing, language, neardup, queries, scans, skipgram, truncation
from folioscope.llm.words import words


def similar(rows, k, t):
    sets = []
    for cid, text in set(rows):
        w = words(text or "")
        g = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if cid is not None and g:
            sets.append((cid, g))
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            o = len(x & y)
            if a != b and o >= t * (len(x) + len(y) - o):
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("long_list,short_lists", [(3, 2), (4096, 3), (4096, 1)])
@pytest.mark.parametrize("k,t", [(3, Fraction(3, 5)), (5, Fraction(4, 5)), (1, Fraction(1))])
def test_near_copies_match_brute_force(spark, k, t, long_list, short_lists):
    rng = random.Random(5)
    pool = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(60):
        base = rng.choices(pool, k=rng.randrange(0, 120))
        for j in range(rng.randrange(1, 4)):
            copy = [w if rng.random() > 0.04 * j else rng.choice(pool) for w in base]
            rows.append((f"c{i}-{j}", "_ ".join(copy).upper() if j == 1 else " ".join(copy)))
    rows += [rows[0], ("again", rows[5][1]), ("c0-0", "another text of the same id " * 3), ("null", None), ("empty", ""), (None, rows[3][1]), ("long", " ".join(rng.choices(pool, k=3000)))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, content string, k1 int")
    found = neardup.near_copies(frame, k, t, sketch_bits=12, shard_entries=500, long_list=long_list, filter_bits=10, short_lists=short_lists)
    pairs = [tuple(r) for r in neardup.chunk_pairs(*found, block=2).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == similar(rows, k, t)


def test_near_copies_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    pool = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(80):
        base = rng.choices(pool, k=rng.randrange(0, 200))
        rows += [(f"c{i}-{j}", " ".join(w if rng.random() > 0.03 * j else rng.choice(pool) for w in base)) for j in range(3)]
    rows += [(f"again{i}", content) for i, (_, content) in enumerate(rows[:100])]
    frame = spark.createDataFrame(rows, "chunk_id string, content string").repartition(5)
    cut, layouts = neardup._shards, []
    monkeypatch.setattr(neardup, "_shards", lambda *a: layouts.append(cut(*a)) or layouts[-1])
    found = neardup.near_copies(frame, 3, Fraction(3, 5), sketch_bits=12, long_list=20, filter_bits=10, shard_bytes=5_000, round_bytes=6)
    pairs = [tuple(r) for r in neardup.chunk_pairs(*found).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == similar(rows, 3, Fraction(3, 5))
    (shards, rounds), = layouts
    assert 1 < rounds < shards


def test_shards_stay_small_however_many_texts():
    for texts in (10_000, 1_000_000, 100_000_000):
        sketch = np.full(1 << 12, texts * 108 // (1 << 12))
        # without lists in blocks
        shards, rounds = neardup._shards(sketch, texts, 0.4, 2, 3_000_000, 28_000_000, 4, 1 << 40)
        entries = texts * (2 + 0.4 * 108)
        held = texts * (1 - (1 - 1 / shards) ** (entries / texts))
        assert entries / shards < 3_100_000 and held * (8 + 8 * 108 / 24) < 28_500_000
        assert (shards * held * (8 + 8 * 108 / 24) + 4 * entries) / rounds < 1.1 * 4 * 108 * texts


def test_merge_of_a_shard_with_many_texts_takes_little_memory():
    texts, each = 600_000, 10_000
    names = (np.arange(texts // 2, dtype=np.uint32) * np.uint32(14_000)).repeat(2)

    def blobs():
        for at in range(0, texts, each):
            steps = np.diff(names[at : at + each], prepend=np.uint32(0))
            numbers = (steps, np.arange(each), np.zeros(each), np.full(each, 100))
            keys, maps = np.arange(at, at + each, dtype=np.uint64), np.zeros(4 * each, dtype=np.uint64)
            yield neardup._framed(*(neardup._pack(x.astype(np.uint32)) for x in numbers), keys.tobytes(), maps.tobytes())

    shard = list(blobs())
    tracemalloc.start()
    pairs = sum(map(len, neardup._merge_shard(shard, Fraction(3, 5), 1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == texts // 2 and peak < 320 * texts


def test_near_copies_of_nothing(spark):
    frame = spark.createDataFrame([], "chunk_id string, content string")
    assert neardup.chunk_pairs(*neardup.near_copies(frame)).count() == 0


def test_classes(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("a", text), ("b", text.upper()), ("c", text + " x"), ("d", "x y z " + text), ("e", "nothing of that kind at all here"), ("f", "one")]
    frame = spark.createDataFrame(rows, "chunk_id string, content string")
    got = {r.chunk_id: (r.class_id, r.links) for r in neardup.near_classes(*neardup.near_copies(frame, 3, Fraction(3, 5))).collect()}
    assert {got[c][0] for c in "abcd"} == {"a"} and got["e"] == ("e", 0) and "f" not in got


@given(st.lists(st.text(max_size=60), max_size=8))
def test_hashed_words_are_the_words(texts):
    texts = [t.replace("\n", " ") if "İ" in t else t for t in texts]
    hashes, counts = hashing.word_hashes(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    grams, runs = hashing.shingle_hashes(hashes, counts, 3)
    assert runs.tolist() == [max(0, len(words(t)) - 2) for t in texts] and len(grams) == runs.sum()


EN = "the board reported that the credit of the bank was stable and the loans grew in the period "
FR = "le conseil a indiqué que le crédit de la banque est resté stable et que les prêts ont augmenté "
DE = "der vorstand erklärt dass der kredit der bank stabil blieb und die einlagen im jahr gewachsen sind "


@pytest.fixture(scope="module")
def model():
    return language.fit_model([("en", EN * 3), ("fr", FR * 3), ("de", DE * 3), ("en", FR)], language.vocabulary_pieces())


def test_forward_scores_sum_all_segmentations(model):
    def brute(text, k):
        if not text:
            return 1.0
        total = 0.0
        for j in range(1, len(text) + 1):
            piece = model.index.get(text[:j], None if j > 1 else -1)
            if piece is not None:
                total += model.probability[piece, k] * brute(text[j:], k)
        return total

    for word in ("board", "crédit", "ж", "x"):
        want = np.log([max(brute("▁" + word, k), 1e-300) for k in range(len(language.LANGUAGES))])
        assert np.allclose(model.log_scores([word, "a", word])[2], np.maximum(want, want.max() - language.CLAMP))


def test_labels(spark):
    rows = [("English",), ("en-GB",), ("DE + EN",), ("deu/spanish",), ("Français",), ("other",), ("null",), (None,), ("",), ("pt_BR",), ("-",)]
    got = spark.createDataFrame(rows, "l string").select(language.named_languages(queries.F.col("l")).alias("n")).collect()
    assert [list(r.n) for r in got] == [["en"], ["en"], ["de", "en"], ["de", "es"], ["fr"], [], [], [], [], ["pt"], []]


def test_records(spark, model):
    pages = spark.createDataFrame(
        [(1, "a", EN * 2 + "\n\n" + FR * 3, "success"), (1, "a", EN * 2 + "\n\n" + FR * 3, "success"), (2, "b", DE * 3, "success"), (3, "b", None, "failed"), (4, "c", "", "success"), (5, "x", FR * 3, "success"), (6, None, FR, "success")],
        "page_id long, doc_id string, content string, status string",
    )
    meta = spark.createDataFrame([("a", "english"), ("b", None), ("b", "n/a"), ("c", "fr"), (None, "fr")], "doc_id string, doc_language string")
    asked = spark.createDataFrame([(1, EN + FR, "EN"), (1, EN + FR, "EN"), (2, None, "fr"), (3, "", None), (4, "«" + FR + "» " + EN, "en"), (5, "12 34", "x")], "query_id long, text string, language string")
    got = {tuple(r) for r in language.unlabelled_languages(language.record_languages(pages, meta, asked, model)).collect()}
    assert got == {("document", "a", "fr"), ("document", "b", "de"), ("query", "1", "fr")}
    empty = language.record_languages(pages.limit(0), meta.limit(0), asked.limit(0), model)
    assert empty.count() == 0


def test_segments_of_pages_and_short_records(spark, model):
    short = "le conseil a indiqué"
    pages = spark.createDataFrame(
        [(1, "a", "x\n" + EN * 2 + "\n\n" + FR * 3, "success"), (1, "a", "x\n" + EN * 2 + "\n\n" + FR * 3, "success"), (2, "b", short, "success"), (3, "c", "12 34", "success")],
        "page_id long, doc_id string, content string, status string",
    )
    got = {(r.record_key, r.page_id, r.language_code, r.kept): r for r in language.page_segments(pages, model).collect()}
    long = got["a", 1, "fr", True]
    assert long.segment == (FR * 3).strip() and long.words == len(FR.split()) * 3 and long.first_word == 1 + 2 * len(EN.split())
    assert got["b", 2, "fr", False].segment == short and not any(k == "c" for k, *_ in got)
    meta = spark.createDataFrame([("a", "en"), ("b", "en"), ("c", "en"), ("d", "en")], "doc_id string, doc_language string")
    asked = spark.createDataFrame([(1, "le conseil?", "en"), (2, "«" + FR + "»", "en"), (3, "12", "en"), (4, EN, "en")], "query_id long, text string, language string")
    records = language.record_languages(pages, meta, asked, model)
    rows = {(r.record_kind, r.record_key, r.language_code): r for r in records.collect()}
    assert len(rows) == 9 and rows["document", "a", "fr"].words == len(FR.split()) * 3 and rows["document", "a", "fr"].segments == 1
    for key in (("document", "b", "fr"), ("query", "1", "fr"), ("query", "2", "fr")):
        assert rows[key].segments == 0 and 0.5 < rows[key].confidence < 1
    assert all(rows[key].confidence == 0 for key in (("document", "c", None), ("document", "d", None), ("query", "3", None)))
    assert {tuple(r) for r in language.unlabelled_languages(records).collect()} == {("document", "a", "fr")}


def test_best_path_switches_only_for_a_gain():
    rows = np.array([[0, -3]] * 5 + [[-3, 0]] * 5, dtype=float)
    assert language.best_path(rows, 10) == [0] * 5 + [1] * 5
    assert language.best_path(rows[:6], 10) == [0] * 6


def test_glyph_fixes_and_furniture():
    assert "towards" in scans.glyph_fixes("towarcls") and "while" in scans.glyph_fixes("vvhilc", 2)
    assert all(map(scans._is_folio, ("35", "[ 11 ]", "- 16 -", "33/40", "xvi", "[ 2O ]", "l6/l7")))
    assert not any(map(scans._is_folio, ("2013", "in 2013.", "", "mix", "12 million")))
    assert scans._line_role("Acme Group | Notes to the accounts | 25", {scans.skeleton("acme"), scans.skeleton("group")})[0] == "named"
    assert scans._line_role("Compiled and reviewed by Acme Group group accounting in 2017.", {scans.skeleton("acme"), scans.skeleton("group")})[0] == "notice"


def test_scan_noise(spark):
    line = "The dividend proposal of the bank was restated and the dividend proposal grew in the year.\n"
    body = line * 30
    noisy = "Acme Group Annual report 2020\n" + body + "The dividcnd propo-\nsal was long-\nterm and (erfect today.\n- 12 -"
    rows = [(i, "d", i, body + "cerfect long-term planning.\n" * 3, "success", {"parser": "layout"}) for i in range(20)]
    rows += [(50, "d", 50, noisy, "success", {"parser": "layout"}), (51, "d", 51, "ACME GROUP ANNUAL REPORT 2020\n" + body, "success", {"parser": "layout"})]
    rows += [(60, "e", 0, noisy, "success", {"parser": "stream"}), (61, "d", 61, None, "failed", {"parser": "layout"}), (62, "d", 62, noisy, "success", None), rows[20]]
    pages = spark.createDataFrame(rows, "page_id long, doc_id string, page_number int, content string, status string, metadata map<string,string>")
    meta = spark.createDataFrame([("d", "Acme Group"), ("d", "Acme Group"), ("e", None)], "doc_id string, publisher string")
    study = scans.study_scans(pages, meta, contexts=64)
    got = {tuple(r) for r in scans.scan_noise(study).collect()}
    assert got == {(50, "hyphen"), (50, "chars"), (50, "header"), (50, "folio"), (51, "header")}
    mended = {r.page_id: r.content for r in scans.repair_scans(pages, study).collect()}
    assert "dividend proposal was long-term" in mended[50] and "12" not in mended[50] and "\n" not in mended[50]
    assert scans.scan_noise(scans.study_scans(pages.limit(0), meta)).count() == 0


def test_paragraphs_over_page_ends(spark):
    notice = "Compiled and reviewed by Acme Group group accounting in 2017."
    texts = {
        0: f"Whole.\n\nThe dividend proposal of the bank was re-\n{notice}", 1: f"{notice}\nstated in the year\nand grew",
        2: "once again in the region.\n\nThe loan book fell", 3: None, 4: "in a failed neighbour.\n\nOutlook", 5: "New things began here.",
    }
    rows = [(i, "d", i, t, "success" if t else "failed", {"parser": "layout"}) for i, t in texts.items()]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, doc_id string, page_number int, content string, status string, metadata map<string,string>")
    meta = spark.createDataFrame([("d", "Acme Group")], "doc_id string, publisher string")
    got = {r.page_id: r.content for r in scans.repair_scans(pages, scans.study_scans(pages, meta, contexts=8), meta).collect()}
    assert got == {
        0: f"Whole.\n\nThe dividend proposal of the bank was restated in the year and grew once again in the region.\n\n{notice}",
        1: notice, 2: "The loan book fell", 4: "in a failed neighbour.\n\nOutlook", 5: "New things began here.",
    }


def test_endings(spark):
    cases = {
        "It ended well.": "sentence", "Was it? ": "sentence", "It ended (more)": "open", "It ended [...]": "open", "once again. …": "sentence",
        "It ended in the mid": "open", "It stood at 539.": "open", "It was so in 2013.": "sentence", "x.\n## Outlook for N": "heading",
        "x.\n- the loan book": "list", "x.\n| a | 12 |": "table", "Total ......... 12,5": "total", "— Anna Berg": "signature",
        "Paris, 4/5/2019": "date", "reports.x.example/2019/7": "link", "x\n[1] [2] [3] ...": "notes", "  \n": "none", "Segu&am": "open", "wor�": "open",
    }
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(cases)], "doc_id long, text string, source string")
    got = {r.doc_id: r.ending for r in truncation.text_endings(frame).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_truncation_finds_limits_and_cut_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        text = " ".join("some words of a sentence here." for _ in range(rng.randrange(5, 60)))[: rng.randrange(100, 1500)]
        text = text[: text.rfind(".") + 1]
        rows.append((i, text[:600] if i % 2 and len(text) > 600 else text, "a" if i % 2 else None))
    rows += [(900, None, "a"), (901, "", "a"), (902, "cut in the mid", None), rows[0]]
    rows += [(1000 + i, f"Outlook of things {i}\nA text.\nOutlook", "c") for i in range(5)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, chars int")
    judged = truncation.detect_truncation(frame).cache()
    cut = {r.doc_id for r in judged.where("truncated").collect()}
    want = {d for d, t, _ in rows if t and not t.rstrip().endswith(".") and d < 1000}
    assert {d for d in cut if d < 1000} == want
    limits = truncation.length_limits(truncation.text_endings(frame)).where("source = 'a' and unit = 'chars'").collect()
    assert 600 in {r["size"] for r in limits}
    assert sum(r.texts for r in truncation.truncation_report(judged).collect()) == judged.count()
    assert truncation.detect_truncation(frame.limit(0)).count() == 0


def test_limits_decide_which_endings_are_cut(spark):
    # a form that stands whole inside many texts is cut where a limit ends it, and whole elsewhere
    rng = random.Random(7)
    rows = []
    for i in range(300):
        body = " ".join("some words of a sentence here." for _ in range(rng.randrange(4, 12)))
        rows.append((i, f"Net result of the group\n{body}\nOutlook for the group\n{body}"))
    padded = lambda last, size: "z" * (size - len(last) - 2) + ".\n" + last
    rows += [(1000 + i, padded(f"The group of {'x' * i} grew in the fir", 900)) for i in range(12)]
    rows += [(2000, padded("Net result of the group", 777)), (3000, padded("Outlook for the group", 900))]
    frame = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, source string")
    on = {r.doc_id: r.cut_class for r in truncation.detect_truncation(frame).where("truncated").collect()}
    off = {r.doc_id: r.cut_class for r in truncation.detect_truncation(frame, use_limits=False).where("truncated").collect()}
    assert on == {3000: "limit"} | {1000 + i: "limit" for i in range(12)}
    assert off == {1000 + i: "transfer" for i in range(12)}


def test_whole_forms_do_not_depend_on_size(spark):
    def whole(times):
        rows = [f"Net result\nA text.\nOutlook of {i % 7}" if i % 4 else "Outlook of 3\nA text.\nNet result" for i in range(20 * times)]
        frame = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "doc_id long, text string, source string")
        return {r.shape for r in truncation.whole_forms(frame, truncation.text_endings(frame)).collect()}

    # inside 15 of 21 times, against inside 5 of 21 times
    assert whole(1) == whole(20) == {"Net result"}


def test_vectors_choose_the_correction_in_its_context(spark):
    # one misreading stands for two words; the counts prefer "plano", the context of the second page tells "piano"
    a, b = "the bank sold its plano debt today again and so the bank sold its plano debt today again.", "le mani sul piano forte del maestro vecchio e le mani sul piano forte del maestro."
    rows = [(i, "d", i, " ".join([a] * 6 if i % 5 else [b] * 6), "success", {"parser": "layout"}) for i in range(60)]
    rows += [(100, "d", 100, "the bank sold its p!ano debt today again.\nle mani sul p!ano forte del maestro.", "success", {"parser": "layout"})]
    pages = spark.createDataFrame(rows, "page_id long, doc_id string, page_number int, content string, status string, metadata map<string,string>")
    meta = spark.createDataFrame([("d", None)], "doc_id string, publisher string")
    fixes = lambda use: {(r.nth, r.fix) for r in scans.study_scans(pages, meta, use_vectors=use).fixes.where("page_id = 100").collect()}
    assert fixes(True) == {(0, "plano"), (1, "piano")}
    assert fixes(False) == {(0, "plano"), (1, "plano")}
    study = scans.study_scans(pages, meta)
    mended = {r.page_id: r.content for r in scans.repair_scans(pages, study).collect()}
    assert mended[100] == "the bank sold its plano debt today again. le mani sul piano forte del maestro."


def test_corrections_replace_whole_words_only():
    correct = scans._corrector({"ccnt": ["cent"], "p!ari": ["plan"], "of": ["off", "of"]})
    assert correct("Ccnt ccntre p!ari p!arined of, OF of") == "Cent ccntre plan p!arined off, OF of"
    known = {"long", "term", "long-term", "plus-value", "propo", "restated"}
    assert scans._joint(scans._BROKEN.search("a long-\nterm loan"), known) == "-"
    assert scans._joint(scans._BROKEN.search("was re-\nstated"), known) == ""
    assert scans._joint(scans._BROKEN.search("la plus-\nvalue"), known) == "-"


def test_skipgram_vectors_estimate_mutual_information():
    rng = np.random.default_rng(3)
    topics = np.repeat([0, 1], 8)
    counts = rng.poisson(np.where(topics[:, None] == topics[None, :], 60, 3)).astype(float)
    context = skipgram.learn_contexts(counts, width=4)
    share = counts.sum(axis=0) / counts.sum()
    vectors = skipgram.solve_words(counts, share, context)
    told = vectors @ context.T
    want = np.log(counts * counts.sum() / np.outer(counts.sum(axis=1), counts.sum(axis=0)) + 1e-3)
    assert np.corrcoef(told.ravel(), want.ravel())[0, 1] > 0.9
    assert (skipgram.context_evidence(vectors[[0, 15]], context[:4]) > 0).tolist() == [True, False]
    assert skipgram.solve_words(np.zeros((2, 16)), share, context).shape == (2, 4)
