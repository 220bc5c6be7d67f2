import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioscope import schemas
from folioscope.errors import ChunkingError
from folioscope.operators import chunking as C
from folioscope.operators.documents import page_offsets, reconstruct
from folioscope.operators.encoders import HashEncoder, HashTokenEncoder


def pages(spark, rows):
    full = [(p, d, n, c, "text", s, {}) for p, d, n, c, s in rows]
    return spark.createDataFrame(full, schemas.PARSED_PAGE)


GAPS = [(10, "doc", 0, "abc", "success"), (11, "doc", 1, "", "empty"), (12, "doc", 2, None, "failed"), (13, "doc", 3, "xyz", "success")]


def test_reconstruction_skips_unusable_pages(spark):
    row = reconstruct(pages(spark, [*GAPS, GAPS[0]])).first()
    assert row.text == "abc\nxyz"
    assert [(r.page_id, r.start, r.end) for r in row.page_ranges] == [(10, 0, 3), (13, 4, 7)]
    assert {(r.page_id, r.start, r.end) for r in page_offsets(pages(spark, GAPS)).collect()} == {(10, 0, 3), (13, 4, 7)}


def test_page_strategy_numbers_usable_pages(spark):
    got = C.chunk(pages(spark, GAPS), C.ChunkingConfig("page")).collect()
    assert sorted((r.chunk_id, list(r.page_ids)) for r in got) == [("doc:00000000", [10]), ("doc:00000001", [13])]


def test_spans_get_pages_and_separator_only_chunks_vanish(spark):
    C.register_chunker("test_spans", replace=True)(lambda text: [(0, 2), (2, 5), (3, 4)])
    got = C.chunk(pages(spark, [(10, "doc", 0, "abc", "success"), (11, "doc", 1, "defg", "success")]), C.ChunkingConfig("test_spans"))
    assert sorted((r.chunk_id, list(r.page_ids)) for r in got.collect()) == [("doc:00000000", [10]), ("doc:00000001", [10, 11])]


@pytest.mark.parametrize("name,options", [("token", {"chunk_size": 7, "chunk_overlap": 2}), ("sentence", {"chunk_size": 12}), ("recursive", {"chunk_size": 9, "min_characters_per_chunk": 2}), ("fast", {"chunk_size": 8})])
def test_native_and_python_strategies_cover_the_text(spark, name, options):
    text = "One two. Three, four!\nFive 😀 six\n\nseven eight nine ten"
    got = C.chunk(pages(spark, [(1, "d", 0, text, "success")]), C.ChunkingConfig(name, options)).orderBy("start").collect()
    assert got[0].start == 0 and got[-1].end == len(text)
    assert all(text[r.start : r.end] == r.content for r in got)
    assert all(a.end >= b.start for a, b in zip(got, got[1:]))
    if name == "token":
        assert [(r.start, r.end) for r in got] == list(C.token_spans(text, **options))


@given(st.text(max_size=200), st.integers(1, 40), st.integers(0, 39))
def test_window_spans(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ChunkingError):
            list(C.token_spans(text, size, overlap))
        return
    spans = list(C.token_spans(text, size, overlap))
    assert (not text) == (not spans)
    assert all(b - a <= size for a, b in spans)
    assert not spans or spans[-1][1] == len(text)
    assert all(prev[1] - cur[0] == overlap for prev, cur in zip(spans, spans[1:]))


@given(st.text(max_size=200), st.integers(4, 40))
def test_fast_spans_are_bounded_in_bytes(text, size):
    spans = list(C.fast_spans(text, size))
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(len(text[a:b].encode("utf-8", "surrogatepass")) <= size for a, b in spans)


@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 30))
def test_recursive_spans_cover_and_fit(text, size):
    spans = C.recursive_spans(text, size, 1)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= size for a, b in spans)


def test_function_output_is_checked():
    assert [s.start for s in C.normalize_spans("aXa", ["a", "a"])] == [0, 2]
    for bad in ("text", ["zz"], [""], [(0, 0)], [(0, 9)], [{"content": "b", "start": 0, "end": 1}]):
        with pytest.raises(ChunkingError):
            C.normalize_spans("abc", bad)


def test_semantic_late_and_neural():
    text = "cats purr. cats purr loud. stocks fell today. stocks fell again."
    assert len(C.semantic_spans(text, HashEncoder(64), threshold=0.3)) == 2
    late = list(C.late_spans(text, HashTokenEncoder(8), "m", chunk_size=30))
    assert all(len(s.embedding) == 8 and text[s.start : s.end] == s.content for s in late)
    assert C.neural_spans("aaaabbbb", lambda t: [4], 2) == [(0, 4), (4, 8)]


def test_registry_and_description(spark):
    with pytest.raises(ChunkingError):
        C.register_chunker("token")(lambda t: [])
    with pytest.raises(ChunkingError):
        C.get_chunker("nothing")
    assert C.list_chunker_options("token")["chunk_size"]["default"] == 2048
    with pytest.raises(ChunkingError):
        C.chunk(pages(spark, GAPS), C.ChunkingConfig("sentence", {"nonsense": 1}))


def test_token_encoder_encodes_every_word():
    (vectors,) = HashTokenEncoder(4).encode(["word " * 600 + "tail"])
    assert len(vectors) == 601 and vectors[-1] == HashTokenEncoder(4).encode(["tail"])[0][0]


class Halves(C.DocumentChunker):
    def check_options(self, options):
        if set(options) - {"shift"}:
            raise ChunkingError("unknown option")

    def chunk_documents(self, documents, options):
        half = documents.selectExpr("doc_id", "length(text) n", f"cast(length(text) / 2 as int) + {options.get('shift', 0)} m")
        return half.selectExpr("doc_id", "explode(array(named_struct('place', 0, 'start', 0, 'end', m), named_struct('place', 1, 'start', m, 'end', n))) s").select("doc_id", "s.*")


def test_a_chunker_with_full_control(spark):
    C.register_chunker("halves", replace=True)(Halves())
    got = C.chunk(pages(spark, GAPS), C.ChunkingConfig("halves")).collect()
    assert sorted((r.chunk_id, r.content, list(r.page_ids), r.metadata["strategy"]) for r in got) == [
        ("doc:00000000", "abc", [10], "halves"), ("doc:00000001", "\nxyz", [13], "halves"),
    ]
    with pytest.raises(ChunkingError):
        C.chunk(pages(spark, GAPS), C.ChunkingConfig("halves", {"shift": 9}))
    with pytest.raises(ChunkingError):
        C.chunk(pages(spark, GAPS), C.ChunkingConfig("halves", {"other": 9}))


@pytest.mark.parametrize("size,overlap", [(4, 1), (5, 4), (3, 0), (100, 0), (7, 5)])
def test_windows_equal_slices(spark, size, overlap):
    text = "aé😀\nb cd ef\r\ngh𝄞ij klm"
    rows = pages(spark, [(1, "d", 0, text, "success"), (2, "d", 1, "x" * 9, "success"), (3, "e", 0, "q", "success")])
    got = {(r.doc_id, r.start): (r.end, r.content) for r in C.chunk(rows, C.ChunkingConfig("token", {"chunk_size": size, "chunk_overlap": overlap})).collect()}
    whole = {"d": f"{text}\n{'x' * 9}", "e": "q"}
    want = {}
    for doc, t in whole.items():
        for a, b in C.token_spans(t, size, overlap):
            if not (t[a:b] == "\n" and a == len(text)):
                want[doc, a] = (b, t[a:b])
    assert got == want
