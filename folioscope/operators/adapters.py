"""Parsers for PDF documents on top of libraries that may not be installed.

Each adapter states its formats, options and the full settings that follow from
them, and calls its library through a *backend*: a function ``(bytes, settings)
-> {0-based page: content}``.  The backend is loaded on first use in the worker;
where the library is missing, the document's pages fail with that reason.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from folioscope.errors import ParsingError
from folioscope.operators.parsing import FORMATS, SENTINEL, ParsingConfig, register_parser, split_pages

Backend = Callable[[bytes, dict[str, Any]], Mapping[int, str | None]]

#: Codes of the recognition engine by language code or name.
RECOGNITION_CODES = {
    "en": "eng", "english": "eng", "fr": "fra", "french": "fra", "de": "deu", "german": "deu", "es": "spa", "spanish": "spa",
    "it": "ita", "italian": "ita", "pt": "por", "portuguese": "por",
}


def recognition_code(language: str | None) -> str:
    """The engine's code of a language; unknown names pass in lower case, none means English."""
    name = (language or "").strip().lower()
    return RECOGNITION_CODES.get(name, name) or "eng"


@dataclass(frozen=True)
class BackendParser:
    """A parser whose work a library does.

    ``exclusive`` lists pairs of options that cannot be on together, ``only``
    the format that an option needs.
    """

    library: str
    load: Callable[[], Backend]
    formats: tuple[str, ...] = FORMATS
    options: frozenset[str] = frozenset()
    exclusive: tuple[tuple[str, str], ...] = ()
    only: Mapping[str, str] = field(default_factory=dict)

    def settings(self, config: ParsingConfig, language: str | None) -> dict[str, Any]:
        """All settings of one document, defaults included; wrong options raise."""
        on = {o: config.options.get(o, False) for o in sorted(self.options)}
        for option, value in on.items():
            if not isinstance(value, bool):
                raise ParsingError(f"option {option} must be true or false")
        for a, b in self.exclusive:
            if on[a] and on[b]:
                raise ParsingError(f"options {a} and {b} exclude each other")
        for option, form in self.only.items():
            if on[option] and config.output_format != form:
                raise ParsingError(f"option {option} needs the format {form}")
        mode = "vlm" if on.get("use_vlm") else "ocr" if on.get("use_ocr") else "standard"
        return {**on, "mode": mode, "output_format": config.output_format, "language": recognition_code(language)}

    def pages(self, data: bytes, numbers: list[int], language: str, config: ParsingConfig) -> dict[int, str | None]:
        settings = {**self.settings(config, language), "pages": list(numbers)}
        try:
            backend = self.load()
        except ImportError as error:
            raise ParsingError(f"{self.library} is not installed; register another parser for PDF") from error
        found = backend(data, settings)
        return {n: found.get(n) for n in numbers}


def _pymupdf4llm() -> Backend:
    import pymupdf
    import pymupdf4llm

    def convert(data: bytes, settings: dict[str, Any]) -> dict[int, str | None]:
        out: dict[int, str | None] = {}
        with pymupdf.open(stream=data, filetype="pdf") as document:
            for n in settings["pages"]:
                try:
                    if settings["output_format"] == "markdown":
                        out[n] = pymupdf4llm.to_markdown(document, pages=[n], use_ocr=settings["use_ocr"], ocr_language=settings["language"])
                    else:
                        page = document[n]
                        read = page.get_textpage_ocr(language=settings["language"], full=True) if settings["use_ocr"] else None
                        out[n] = page.get_text(textpage=read)
                except Exception:
                    out[n] = None
        return out

    return convert


def _docling() -> Backend:
    from io import BytesIO

    from docling.datamodel.base_models import DocumentStream, InputFormat
    from docling.datamodel.pipeline_options import PdfPipelineOptions, VlmPipelineOptions
    from docling.document_converter import DocumentConverter, PdfFormatOption

    def convert(data: bytes, settings: dict[str, Any]) -> dict[int, str | None]:
        if settings["mode"] == "vlm":
            from docling.pipeline.vlm_pipeline import VlmPipeline

            option = PdfFormatOption(pipeline_cls=VlmPipeline, pipeline_options=VlmPipelineOptions())
        else:
            chosen = PdfPipelineOptions(do_ocr=settings["use_ocr"], do_table_structure=True, do_picture_description=settings["describe_pictures"])
            chosen.ocr_options.lang = [settings["language"]]
            option = PdfFormatOption(pipeline_options=chosen)
        converter = DocumentConverter(format_options={InputFormat.PDF: option})
        document = converter.convert(DocumentStream(name="document.pdf", stream=BytesIO(data))).document
        export = document.export_to_markdown if settings["output_format"] == "markdown" else document.export_to_text
        out: dict[int, str | None] = {}
        for n in settings["pages"]:
            try:
                out[n] = export(page_no=n + 1)
            except Exception:
                out[n] = None
        return out

    return convert


def _marker() -> Backend:
    import tempfile

    from marker.config.parser import ConfigParser
    from marker.converters.pdf import PdfConverter
    from marker.models import create_model_dict

    def convert(data: bytes, settings: dict[str, Any]) -> dict[int, str | None]:
        chosen = ConfigParser(
            {"output_format": "markdown", "paginate_output": True, "page_separator": SENTINEL, "force_ocr": settings["use_ocr"], "use_llm": settings["describe_pictures"]}
        )
        converter = PdfConverter(artifact_dict=create_model_dict(), config=chosen.generate_config_dict(), llm_service=chosen.get_llm_service())
        # the library reads files only; this one lives as long as the call
        with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
            file.write(data)
            file.flush()
            return dict(split_pages(converter(file.name).markdown, SENTINEL))

    return convert


PYMUPDF4LLM = BackendParser("pymupdf4llm", _pymupdf4llm, options=frozenset({"use_ocr"}))
DOCLING = BackendParser(
    "docling",
    _docling,
    options=frozenset({"use_ocr", "use_vlm", "describe_pictures"}),
    exclusive=(("use_ocr", "use_vlm"), ("use_vlm", "describe_pictures")),
    only={"describe_pictures": "markdown"},
)
MARKER = BackendParser("marker", _marker, formats=("markdown",), options=frozenset({"use_ocr", "describe_pictures"}))


def register_adapters(replace: bool = False) -> None:
    for parser in (PYMUPDF4LLM, DOCLING, MARKER):
        register_parser(parser.library, parser, replace)
