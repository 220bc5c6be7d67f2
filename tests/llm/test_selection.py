"""Top N, splitting, packing, repeated lines and leaked passages against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import leakage, packing, site_lines, split, topn
from folioscope.llm.words import words

NAN = float("nan")


def best(rows, n):
    top = defaultdict(dict)
    for g, i, s in rows:
        if None not in (g, i, s) and s == s:
            top[g][i] = max(s, top[g].get(i, float("-inf")))
    return {(g, i, s, r) for g, d in top.items() for r, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


@pytest.mark.parametrize("heavy_share", [1, 8, 100])
def test_top_n_heavy_and_light(spark, heavy_share):
    rng = random.Random(1)
    rows = [(0, rng.randrange(400), rng.choice([0.5, 0.25, None, NAN, rng.random()])) for _ in range(3000)]
    rows += [(g, rng.randrange(20), round(rng.random(), 1)) for g in range(1, 40) for _ in range(15)]
    rows += [(None, 1, 0.5), (1, None, 0.5), (99, 1, None), (98, 1, NAN)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "query_id long, page_id long, score double, g string, rank int")
    got = topn.top_n(frame, 10, heavy_share=heavy_share).collect()
    assert {tuple(r) for r in got} == best(rows, 10) and len(got) == len(best(rows, 10))


def test_top_n_of_nothing(spark):
    frame = spark.createDataFrame([], "query_id long, page_id long, score double")
    assert topn.top_n(frame, 3).collect() == []
    with pytest.raises(ValueError):
        topn.top_n(frame, 0)


@given(st.text(alphabet="abc .,\n", max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_cut_points(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            split.cut_points(text, size, overlap)
        return
    spans = split.cut_points(text, size, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= size for a, b in spans)
    assert all(prev[1] - cur[0] == overlap and prev[1] < cur[1] for prev, cur in zip(spans, spans[1:]))


def test_cuts_lie_at_strong_boundaries():
    text = "Word word word. " * 20 + "\n\n" + "Other words here. " * 20
    (first, second) = split.cut_points(text, 400, 0)
    assert text[first[1]].isspace() and text[: first[1]].rstrip().endswith(".")
    assert split.cut_points("x" * 5000, 1200, 120)[1][0] + 120 == split.cut_points("x" * 5000, 1200, 120)[0][1]


@given(st.lists(st.integers(1, 90), min_size=1, max_size=12), st.integers(20, 60), st.integers(0, 10))
def test_no_bare_cut_where_a_boundary_lies_in_the_piece(lengths, size, overlap):
    text = " ".join("x" * n for n in lengths)
    spans = split.cut_points(text, size, overlap)
    for (a, b), _ in zip(spans, spans[1:]):
        begin = a + overlap if a else overlap
        assert text[b] == " " or " " not in text[begin + 1 : b + 1]


def test_pieces_are_added_until_cuts_reach_boundaries(spark):
    # every other word nearly fills a piece, so far more pieces than the least number are needed
    text = " ".join(["x" * 55, "y" * 10] * 20)
    spans = split.cut_points(text, 60, 0)
    assert all(text[b] == " " for _, b in spans[:-1]) and len(spans) > -(-len(text) // 60) + 5
    limits = spark.createDataFrame([(1, "page", "characters", 30, 9), (2, "page", "characters", 40, 2)], "limit_id int, purpose string, unit string, max_size int, overlap int")
    assert [tuple(r) for r in split.size_table(limits).collect()] == [("page", 30, 9)]


def test_split_items_and_page_ids(spark):
    limits = spark.createDataFrame([(1, "page", "characters", 30, 5), (2, "chunk", "characters", 20, 4), (3, "pack", "tokens", 9, 0)], "limit_id int, purpose string, unit string, max_size int, overlap int")
    a, b = "First page text here. It goes on.", "Second page has more text."
    items = spark.createDataFrame([("page", "1", a, 0), ("page", "1", a, 0), ("page", "2", None, 0), ("page", "3", "", 0), ("page", "4", "short", 0), ("chunk", "c", (a + "\n" + b)[5:50], 1), ("other", "9", a * 9, 1)], "item_kind string, item_key string, content string, max_size int")
    pieces = split.split_items(items, limits).cache()
    assert {(r.item_kind, r.item_key) for r in pieces.collect()} == {("page", "1"), ("chunk", "c")}
    assert pieces.where("item_key = '1'").count() == 2
    pages = spark.createDataFrame([(10, "d", 0, a, "success"), (10, "d", 0, a, "success"), (11, "d", 1, b, "success"), (12, "d", 2, None, "failed")], "page_id long, doc_id string, page_number int, content string, status string")
    chunks = spark.createDataFrame([("c", "d", [10, 11], 5)], "chunk_id string, doc_id string, page_ids array<long>, char_start int")
    for r in split.chunk_piece_pages(pieces, chunks, pages).collect():
        lo, hi = r.start + 5, r.end + 5
        want = [p for p, s, e in ((10, 0, len(a)), (11, len(a) + 1, len(a) + 1 + len(b))) if lo < e and hi > s]
        assert list(r.page_ids) == want
    assert split.split_items(items.limit(0), limits).count() == 0


def test_packing_keeps_its_rules(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "\n\n", "42", "naïve"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(150)] + ["copy of one text"] * 5 + ["long " * 300]
    rows = [(i, t, "big" if i % 3 else None, 1) for i, t in enumerate(texts)] + [(0, texts[0], None, 1), (900, None, "s", 1), (901, "", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    limits = spark.createDataFrame([("pack", "tokens", 64), ("pack", "tokens", 256), ("page", "characters", 9)], "purpose string, unit string, max_size int")
    packed = packing.pack(docs, limits, shard_items=60).cache()
    assert packing.rule_breaks(packed).count() == 0
    out = packed.collect()
    counter = packing.TokenCounter(packing.load_vocabulary())
    for capacity in (64, 256):
        bins, parts = defaultdict(list), defaultdict(list)
        for r in out:
            if r.capacity == capacity:
                bins[r.container].append(r)
                parts[r.doc_id].append((r.first_token, r.n_tokens))
        assert all(sum(r.n_tokens for r in b) <= capacity for b in bins.values())
        assert set(parts) == set(range(len(texts)))
        for doc, pieces in parts.items():
            total = len(counter.encoding.encode_ordinary(texts[doc]))
            assert sum(n for _, n in pieces) == total and (len(pieces) == 1) == (total <= capacity)
        copies = [{r.doc_id for r in b} & set(range(150, 155)) for b in bins.values()]
        assert max(map(len, copies)) == 1
        assert all(n <= b[0].source_quota for b in bins.values() for n in Counter(r.source for r in b if r.source == b[0].source).values())
    assert packing.pack(docs.limit(0), limits).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # nine containers at least, so no source repeats in one
    items = [(60, "a", -1)] * 12 + [(50, "b", 0), (45, "b", 1), (40, "b", 0), (38, "c", 0), (1, "c", 0)]
    bins = packing.pack_shard(items, 100)
    by = {i: b for b in bins for i in b}
    assert packing.source_quotas(items, 100, 1.0) == {"a": 2, "b": 1, "c": 1}
    assert all(len({0, 1} & {items[i][2]}) <= 1 for b in bins for i in b)
    assert by[14] == [0, 14] and sorted(by[15]) != sorted(by[12]) and 16 not in by[12] + by[14] + by[15]


def test_bins_find_what_a_scan_finds():
    rng = random.Random(8)
    bins = packing.Bins()
    held: list[tuple[int, int]] = []
    for step in range(4000):
        if rng.random() < 0.6 or not held:
            bins.full.append(rng.choice([0, 1, 2, 4, 3, 7]) if rng.random() < 0.5 else 7)
            held.append((rng.randrange(1, 500), len(bins.full) - 1))
            bins.put(*held[-1])
        else:
            size, mask = rng.randrange(1, 500), rng.choice([1, 2, 4, 3])
            want = min((r, b) for r, b in held if r >= size and not bins.full[b] & mask) if any(
                r >= size and not bins.full[b] & mask for r, b in held
            ) else None
            assert bins.take(size, mask) == want
            if want:
                held.remove(want)


def test_no_container_holds_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 5)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(near)] + [(100 + i, f"short text {i}", "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(docs, spark.createDataFrame([("pack", "tokens", 2000)], "purpose string, unit string, max_size int")).collect()
    assert len({r.container for r in out if r.doc_id < 5}) == 5 and len({r.cluster for r in out if r.doc_id < 5}) == 1


def lines_by_hand(pages, owners, least_docs, share, letters):
    import re

    held, seen = defaultdict(set), []
    for page, doc, content in set(pages):
        for no, line in enumerate((content or "").split("\n")):
            key = re.sub(r"\d+", "0", " ".join(words(line)))
            if content is not None and sum(c.isalpha() for c in key) >= letters:
                for source in owners.get(doc, ()):
                    held[source, key].add(doc)
                    seen.append((page, no, source, key))
    size = defaultdict(set)
    for doc, sources in owners.items():
        for s in sources:
            size[s].add(doc)
    return {(p, n) for p, n, s, k in seen if len(held[s, k]) >= max(least_docs, share * len(size[s]))}


def test_repeated_lines(spark):
    rng = random.Random(3)
    notes = ["Please share THIS report, page {}", "All rights are reserved by the house_{}", "Short {}"]
    owners = {f"d{i}": {"big"} if i % 3 else {"small", "big"} for i in range(30)}
    pages = []
    for i in range(90):
        lines = [rng.choice(notes).format(rng.randrange(99)) if rng.random() < 0.3 else f"unique words of line {rng.random()} {'abc' * rng.randrange(9)}" for _ in range(6)]
        pages.append((i, f"d{rng.randrange(33)}", "\n".join(lines)))
    pages += [pages[0], (500, "d1", None), (501, "d1", ""), (502, None, "Please share THIS report, page 3")]
    frame = spark.createDataFrame([(*p, "k", 5) for p in pages], "page_id long, doc_id string, content string, k1 string, ordinal int")
    meta = spark.createDataFrame([(d, s, 1) for d, ss in owners.items() for s in ss] + [("d0", "big", 2), ("x", None, 1), (None, "big", 1)], "doc_id string, publisher string, slot int")
    for least, share in ((4, 0.2), (2, 0.0), (3, 0.6)):
        got = site_lines.find_repeated_lines(frame, meta, least, share)
        assert {(r.page_id, r.line_no) for r in got.collect()} == lines_by_hand(pages, owners, least, share, 20)
    clean = {r.page_id: r.content for r in site_lines.remove_lines(frame, got).collect()}
    gone = defaultdict(set)
    for p, n in lines_by_hand(pages, owners, 3, 0.6, 20):
        gone[p].add(n)
    text = {p: c for p, _, c in pages}
    assert clean == {p: "\n".join(x for i, x in enumerate(text[p].split("\n")) if i not in g) for p, g in gone.items()}
    assert site_lines.find_repeated_lines(frame.limit(0), meta).count() == 0


def runs_by_hand(docs, items, least):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text or "")
        for i in range(len(w) - least + 1):
            grams[tuple(w[i : i + least])].add(item)
    out = set()
    for doc, text in docs:
        w = words(text or "")
        for i in range(len(w) - least + 1):
            out |= {(doc, item) for item in grams.get(tuple(w[i : i + least]), ())}
    return out


@pytest.mark.parametrize("block_words", [40, 10**6])
def test_leaks(spark, block_words):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(3, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "a b")]
    items += [(60, items[0][1]), items[1]]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(pool, k=rng.randrange(30)))]
        if d % 2:
            w = items[rng.randrange(12)][1].split()
            parts.insert(rng.randrange(2), ", ".join(w[rng.randrange(3) :]).upper())
        docs.append((d, " ".join(parts)))
    docs += [docs[0], (100, None), (101, ""), (102, items[2][1] * 50)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.find_leaks(frame, asked, least=8, block_words=block_words)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == runs_by_hand(docs, items, 8)
    text = dict(docs)
    for r in rows:
        assert words(text[r.doc_id][r.start : r.end]) == words(text[r.doc_id])[r.first_word : r.first_word + r.n_words]
    for r in leakage.remove_leaks(frame, got, 8, 0.9).collect():
        assert r.dropped == (r.text is None)
        assert r.dropped or len(words(r.text)) == len(words(text[r.doc_id])) - r.removed_words
    assert leakage.find_leaks(frame.limit(0), asked).count() == 0
    assert leakage.find_leaks(frame, asked.limit(0)).count() == 0


def test_search_goes_on_to_the_tightest_bin_without_the_source():
    items = [(60, "a", -1)] * 20 + [(60, "b", -1), (40, "a", -1)]
    assert [20, 21] in packing.pack_shard(items, 100, slack=0.5)
