import json

import pytest

from folioscope import schemas
from folioscope.errors import ArtifactError, BenchmarkError, CollectionError, ParsingError
from folioscope.functions import identity
from folioscope.operators import adapters as A
from folioscope.operators import parsing as P
from folioscope.operators.chunking import ChunkingConfig
from folioscope.operators.encoders import HashEncoder, HashTokenEncoder
from folioscope.operators.indexing import IndexingConfig
from folioscope.plans.experiment import EvaluationConfig, ExperimentConfig, RetrievalConfig, run_benchmark
from folioscope.plans.reports import comparison_table, metric_grid
from folioscope.sources import artifacts
from folioscope.sources import collection as S
from folioscope.sources.records import read_jsonl, read_qrels, write_jsonl
from folioscope.streaming.pages import parse_arrivals


def make_collection(tmp_path):
    (tmp_path / "b.txt").write_text("cats purr\fdogs bark loudly")
    (tmp_path / "A.TXT").write_text("stocks fell today")
    (tmp_path / "notes.md").write_text("ignored")
    (tmp_path / "q.jsonl").write_text('{"query_id": 0, "text": "stocks fell", "language": "en"}\n\n{"query_id": 1, "text": "dogs bark"}\n')
    (tmp_path / "r.tsv").write_text("query_id\tpage_id\tscore\tnote\n0\t0\t1\tx\n1\t2\t2\ty\n")


def test_initialize_and_load(spark, tmp_path):
    make_collection(tmp_path)
    got = S.initialize_collection(spark, str(tmp_path), queries=str(tmp_path / "q.jsonl"), qrels=str(tmp_path / "r.tsv"), suffix="txt", counter=S.form_feed_pages)
    assert sorted(map(tuple, got.pages.select("page_id", "doc_id", "page_number").collect())) == [(0, "A", 0), (1, "b", 0), (2, "b", 1)]
    assert {r.query_id: dict(r.extra) for r in got.queries.collect()} == {0: {"language": "en"}, 1: {}}
    assert got.qrels.count() == 2
    assert not S.document_conflicts(got.documents, S.scan_documents(spark, str(tmp_path), "txt")).take(1)


def test_broken_collections(spark, tmp_path):
    make_collection(tmp_path)
    (tmp_path / "r.tsv").write_text("query_id\tpage_id\tscore\n0\t99\t1\n")
    with pytest.raises(CollectionError, match="unknown page"):
        S.initialize_collection(spark, str(tmp_path), queries=str(tmp_path / "q.jsonl"), qrels=str(tmp_path / "r.tsv"), suffix="txt", counter=S.form_feed_pages)
    with pytest.raises(CollectionError, match="together"):
        S.initialize_collection(spark, str(tmp_path), queries=str(tmp_path / "q.jsonl"), suffix="txt")


@pytest.mark.parametrize("line", ['{"page_id": 0}', "[1]", "nonsense", '{"page_id": "x", "doc_id": "d", "page_number": 0}', '{"page_id": 0, "doc_id": "d", "page_number": 0, "more": 1}'])
def test_broken_lines(spark, tmp_path, line):
    path = tmp_path / "x.jsonl"
    path.write_text(line + "\n")
    with pytest.raises(CollectionError):
        read_jsonl(spark, str(path), schemas.PAGE)


def test_jsonl_round_trip_keeps_extras(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a \"q\"", {"x": "1"}), (1, "b", {})], schemas.QUERY)
    write_jsonl(rows, str(tmp_path / "out"))
    back = read_jsonl(spark, str(tmp_path / "out"), schemas.QUERY, extra="extra")
    assert sorted((r.query_id, r.text, dict(r.extra)) for r in back.collect()) == [(0, 'a "q"', {"x": "1"}), (1, "b", {})]
    (tmp_path / "q.tsv").write_text("query_id\tpage_id\n1\t2\n")
    with pytest.raises(CollectionError):
        read_qrels(spark, str(tmp_path / "q.tsv"))


class Failing:
    formats, options = ("text",), frozenset()

    def pages(self, data, numbers, language, config):
        if data == b"bad":
            raise ValueError("broken document")
        return {n: data.decode() if n == 0 else ("  " if n == 1 else None) for n in numbers}


def test_parsing_isolates_failures_and_reuses_pages(spark):
    P.register_parser("failing", Failing(), replace=True)
    pages = spark.createDataFrame([(0, "ok", 0), (1, "ok", 1), (2, "ok", 2), (3, "bad", 0), (4, "none", 0)], schemas.PAGE)
    sources = spark.createDataFrame([("ok", bytearray(b"text"), "en"), ("bad", bytearray(b"bad"), "en")], "doc_id string, data binary, language string")
    config = P.ParsingConfig("failing")
    rows = P.parse_collection(pages, sources, config).cache()
    P.require_complete(pages, rows)
    got = {r.page_id: (r.status, r.content, r.metadata.get("error_type")) for r in rows.collect()}
    assert got == {0: ("success", "text", None), 1: ("empty", "", None), 2: ("failed", None, "MissingPage"), 3: ("failed", None, "ValueError"), 4: ("failed", None, "ParsingError")}
    assert P.missing_pages(pages, rows).count() == 0
    assert P.missing_pages(pages, rows, retry_failed=True).count() == 3
    fixed = sources.where("doc_id = 'ok'").union(spark.createDataFrame([("bad", bytearray(b"now good"), "en")], sources.schema))
    again = P.parse_collection(pages, fixed, config, cache=rows, retry_failed=True)
    assert {r.page_id: r.content for r in again.collect()}[3] == "now good"
    only = P.parse_collection(pages, fixed, config, cache=rows, retry_failed=True, doc_id="ok")
    assert {r.page_id: r.status for r in only.collect()}[3] == "failed"
    with pytest.raises(ParsingError):
        P.parse_collection(pages, sources, config, doc_id="unknown")


def test_overwriting_parses_anew(spark):
    P.register_parser("failing", Failing(), replace=True)
    pages = spark.createDataFrame([(0, "ok", 0), (1, "other", 0)], schemas.PAGE)
    source = lambda a, b: spark.createDataFrame([("ok", bytearray(a), "en"), ("other", bytearray(b), "en")], "doc_id string, data binary, language string")
    config = P.ParsingConfig("failing")
    held = P.parse_collection(pages, source(b"one", b"two"), config).cache()
    held.count()
    text = lambda rows: {r.page_id: r.content for r in rows.collect()}
    new = source(b"new one", b"new two")
    assert text(P.parse_collection(pages, new, config, held)) == {0: "one", 1: "two"}
    assert text(P.parse_collection(pages, new, config, held, overwrite=True)) == {0: "new one", 1: "new two"}
    assert text(P.parse_collection(pages, new, config, held, doc_id="ok", overwrite=True)) == {0: "new one", 1: "two"}


def test_exactly_one_row_of_every_page(spark):
    pages = spark.createDataFrame([(0, "a", 0), (1, "a", 1)], schemas.PAGE)
    row = lambda page, number, form="text": (page, "a", number, "x", form, "success", {})
    good = [row(0, 0), row(1, 1)]
    P.require_complete(pages, spark.createDataFrame(good, schemas.PARSED_PAGE))
    for bad in ([*good, good[0]], good[:1], [row(0, 0), row(1, 2)], [row(0, 0), row(1, 1, "markdown")]):
        with pytest.raises(ParsingError):
            P.require_complete(pages, spark.createDataFrame(bad, schemas.PARSED_PAGE))


def test_adapters_with_backends(spark):
    seen = []

    def backend(data, settings):
        seen.append(settings)
        if data == b"bad":
            raise ValueError("broken")
        return {0: "first", 1: "  ", 5: "elsewhere"}

    parser = A.BackendParser("thing", lambda: backend, options=A.DOCLING.options, exclusive=A.DOCLING.exclusive, only=A.DOCLING.only)
    config = lambda form="markdown", **options: P.ParsingConfig("thing", form, options)
    assert parser.pages(b"x", [0, 1, 2], "German", config(use_ocr=True)) == {0: "first", 1: "  ", 2: None}
    assert seen[-1]["language"] == "deu" and seen[-1]["mode"] == "ocr" and seen[-1]["describe_pictures"] is False
    assert [A.recognition_code(x) for x in (None, " ", "PT", "ltz")] == ["eng", "eng", "por", "ltz"]
    for bad in (config(use_ocr=True, use_vlm=True), config(use_vlm=True, describe_pictures=True), config("text", describe_pictures=True), config(use_ocr=1)):
        with pytest.raises(ParsingError):
            parser.settings(bad, "en")
    P.register_parser("thing", parser, replace=True)
    A.register_adapters(replace=True)
    with pytest.raises(ParsingError):
        P.resolve_parser(P.ParsingConfig("marker", "text"))
    pages = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "b", 0)], schemas.PAGE)
    sources = spark.createDataFrame([("a", bytearray(b"x"), "en"), ("b", bytearray(b"bad"), "en")], "doc_id string, data binary, language string")
    got = {r.page_id: (r.status, r.metadata.get("error_type")) for r in P.parse_collection(pages, sources, config()).collect()}
    assert got == {0: ("success", None), 1: ("empty", None), 2: ("failed", "MissingPage"), 3: ("failed", "ValueError")}
    # a library that is not there fails the pages with its name
    rows = P.parse_collection(pages, sources, P.ParsingConfig("docling")).collect()
    assert {r.status for r in rows} == {"failed"} and "docling is not installed" in rows[0].metadata["error_message"]


def test_records_must_agree_with_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text("three")
    counted = S.count_pages(S.scan_documents(spark, str(tmp_path), "txt"), S.form_feed_pages)
    rule = lambda *rows: {(r.doc_id, r.rule) for r in S.document_conflicts(spark.createDataFrame(list(rows), "doc_id string, file_name string, page_number int"), counted).collect()}
    assert rule(("a", "a.txt", 2), ("b", "b.txt", 1)) == set()
    assert rule(("a", "a.txt", 3), ("b", "B.txt", 1)) == {("a", "other number of pages"), ("b", "other file name")}
    assert rule(("a", "a.txt", 2), ("c", "c.txt", 1)) == {("b", "no record"), ("c", "no file")}


def test_parser_registry_and_formats():
    with pytest.raises(ParsingError):
        P.register_parser("html", P.HtmlParser())
    with pytest.raises(ParsingError):
        P.resolve_parser(P.ParsingConfig("plain", "markdown"))
    with pytest.raises(ParsingError):
        P.same_format([P.ParsingConfig("html", "text"), P.ParsingConfig("html", "markdown")])
    page = P.HtmlParser().pages(b"<h1>T</h1><p>a &amp; b</p><script>x</script><hr class='page'><li>c</li>", [0, 1, 2], "en", P.ParsingConfig("html", "markdown"))
    assert page == {0: "# T\na & b", 1: "- c", 2: None}
    assert P.split_pages("{0}=====PAGE=====\none\n{2}=====PAGE=====\n two ") == {0: "one", 2: "two"}
    with pytest.raises(ParsingError):
        P.split_pages("{0}=====PAGE=====\n{0}=====PAGE=====")


def test_identity(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "query_id long, text string")
    b = spark.createDataFrame([(1, "y", "z"), (0, "x", "z")], "query_id long, text string, extra string")
    one = lambda f: identity.query_set_identity(f).first().identity
    assert one(a) == one(b) != one(a.limit(1))
    assert identity.digest({"b": 1, "a": 2}) == identity.digest({"a": 2, "b": 1})
    with pytest.warns(RuntimeWarning):
        first = identity.chunking_payload("x", {"f": len}, None)
    with pytest.warns(RuntimeWarning):
        assert first != identity.chunking_payload("x", {"f": len}, None)
    assert identity.chunking_payload("x", {"f": len}, "k") == identity.chunking_payload("x", {"f": len}, "k")
    assert one(a) == one(a.union(a)) and one(a.limit(0)) != one(a)
    shifted = spark.createDataFrame([(0, "1:x"), (11, "y")], "query_id long, text string")
    assert one(shifted) != one(spark.createDataFrame([(0, "1"), (1, "xy")], "query_id long, text string"))
    options = {"t": (1, 2), "s": {"b", "a"}, "n": {"m": None}, "c": ChunkingConfig("y", {"z": 1.5})}
    told = identity.chunking_payload("x", options, None)["options"]
    assert told["t"] == [1, 2] and told["s"] == ["a", "b"] and told["c"]["fields"]["options"] == {"z": 1.5}


def test_artifact_states(spark, tmp_path):
    payload = {"x": 1}
    name = identity.digest(payload)
    assert artifacts.state(str(tmp_path), "chunking", name) == "missing"
    artifacts.save(str(tmp_path), "chunking", payload, {"data": spark.range(3)})
    assert artifacts.load(spark, str(tmp_path), "chunking", payload).count() == 3
    with pytest.raises(ArtifactError):
        artifacts.save(str(tmp_path), "chunking", payload, {"data": spark.range(3)}, replace=False)
    artifacts.save(str(tmp_path), "chunking", payload, {"data": artifacts.load(spark, str(tmp_path), "chunking", payload).where("id > 0")})
    assert artifacts.load(spark, str(tmp_path), "chunking", payload).count() == 2
    assert len(list((tmp_path / "chunking" / name).glob("v-*"))) == 1
    (tmp_path / "chunking" / name / "manifest.json").unlink()
    assert artifacts.state(str(tmp_path), "chunking", name) == "partial"
    with pytest.raises(ArtifactError):
        artifacts.load(spark, str(tmp_path), "chunking", payload)


def test_artifacts_at_a_uri(spark, tmp_path):
    root = tmp_path.as_uri()
    name = artifacts.save(root, "parsing", {"y": 1}, {"data": spark.range(2)})
    assert artifacts.state(root, "parsing", name) == "complete"
    assert artifacts.load(spark, root, "parsing", {"y": 1}).count() == 2
    assert artifacts.reference(root, "parsing", name)["path"] == f"{root}/parsing/{name}"
    with pytest.raises(ArtifactError):
        artifacts.reference(root, "parsing", "unknown")


def test_benchmark_of_two_experiments(spark, tmp_path):
    pages = spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "b", 1)], schemas.PAGE)
    sources = spark.createDataFrame([("a", bytearray(b"stocks fell today"), "en"), ("b", bytearray(b"cats purr\fdogs bark loudly"), "en")], "doc_id string, data binary, language string")
    queries = spark.createDataFrame([(0, "stocks fell"), (1, "dogs bark")], "query_id long, text string")
    qrels = spark.createDataFrame([(0, 0, 1), (1, 2, 2)], schemas.QREL)

    def config(kind, chunker="page"):
        return ExperimentConfig(P.ParsingConfig("plain"), ChunkingConfig(chunker), IndexingConfig("hash", kind), RetrievalConfig(top_k=5), EvaluationConfig(k=(1, 5)))

    experiments = {"dense": (config("dense"), HashEncoder(64)), "late": (config("late_interaction", "sentence"), HashTokenEncoder(16))}
    name, table, results = run_benchmark(spark, str(tmp_path), pages, sources, queries, qrels, experiments)
    assert results["dense"].metrics["nDCG@1"] == 1.0 and results["late"].metrics["RR@5"] == 0.75
    assert results["dense"].artifacts["parsing"] == results["late"].artifacts["parsing"]
    assert "Experiment" in table and (tmp_path / "benchmarks" / name / "results.txt").exists()
    assert json.loads((tmp_path / "benchmarks" / name / "results.json").read_text())["late"]["RR@5"] == 0.75
    with pytest.raises(BenchmarkError):
        run_benchmark(spark, str(tmp_path), pages, sources, queries, qrels, {})
    with pytest.raises(BenchmarkError, match="'x'"):
        run_benchmark(spark, str(tmp_path), pages, sources, queries, qrels, {"x": (config("dense", "unknown"), HashEncoder(8))})


def test_report_layout():
    values = {f"{m}@{k}": 0.5 for m in ("nDCG", "RR") for k in (1, 5)}
    assert "| 5 | 0.5000 | 0.5000 |" in metric_grid(values, ["nDCG", "RR"], [1, 5])
    lines = comparison_table([("one", values)], ["nDCG", "RR"], [1, 5]).split("\n")
    assert len({len(x) for x in lines}) == 1 and lines[0].split() == ["Experiment", "nDCG@1", "nDCG@5", "RR@1", "RR@5"]
    with pytest.raises(BenchmarkError):
        comparison_table([("one", {})], ["nDCG"], [1])


def test_stream_parses_each_page_once(spark, tmp_path):
    schema = schemas.PAGE
    sources = spark.createDataFrame([("a", bytearray(b"one\ftwo"), "en")], "doc_id string, data binary, language string")
    target, incoming = str(tmp_path / "parsed"), str(tmp_path / "in")
    for rows in ([(0, "a", 0)], [(0, "a", 0), (1, "a", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        parse_arrivals(stream, lambda: sources, P.ParsingConfig("plain"), target, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.page_id, r.content) for r in spark.read.parquet(target).collect()) == [(0, "one"), (1, "two")]
