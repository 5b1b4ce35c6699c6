"""Text and words of images by an external OCR program, if there is one.

An image that can't be recognised gets a status instead of failing the job:
``OCR_LIBRARY_MISSING`` (Python's binding or image library), ``OCR_NOT_AVAILABLE`` (the
program) or ``OCR_FAILED: …`` (it ran and raised).
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from boundsmith.sources.readers import resolve_ocr_binary

#: The fields of a word as the program tells them.
WORD = ("block_num", "par_num", "line_num", "text", "conf", "left", "top", "width", "height")


class Unavailable(Exception):
    """Holds the status that every image gets."""


class Program:
    """The program behind its Python binding; both are looked for when a task needs them."""

    def __init__(self, load: Callable[[str], object] = importlib.import_module, resolve: Callable[[], str | None] = resolve_ocr_binary) -> None:
        try:
            self.binding, self.images = load("pytesseract"), load("PIL.Image")
        except ImportError as e:
            raise Unavailable("OCR_LIBRARY_MISSING") from e
        path = resolve()
        if path is None:
            raise Unavailable("OCR_NOT_AVAILABLE")
        self.binding.pytesseract.tesseract_cmd = path

    def text(self, content: bytes) -> str:
        return self.binding.image_to_string(self.images.open(io.BytesIO(content)))

    def words(self, content: bytes) -> dict[str, list]:
        return self.binding.image_to_data(self.images.open(io.BytesIO(content)), output_type=self.binding.Output.DICT)


def _recognised(images: DataFrame, ask: Callable, empty: object, program: Callable, schema: pa.Schema, ddl: str, rows: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            engine, why = program(), None
        except Unavailable as e:
            engine, why = None, str(e)
        for batch in batches:
            out = []
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                status, got = why or "OK", empty
                if engine is not None:
                    try:
                        got = ask(engine, content)
                    except Exception as e:  # noqa: BLE001  whatever the program raises is the image's status
                        status = f"OCR_FAILED: {e}"
                out += rows(image, status, got)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return images.select("image", "content").mapInArrow(run, ddl)


def image_texts(images: DataFrame, program: Callable = Program) -> DataFrame:
    """``image, status, text`` of ``image, content``; the text of an image without status ``OK`` is null."""
    schema = pa.schema([("image", pa.string()), ("status", pa.string()), ("text", pa.string())])
    return _recognised(
        images, lambda engine, content: engine.text(content), None, program, schema, "image string, status string, text string",
        lambda image, status, got: [{"image": image, "status": status, "text": got}],
    )


def image_words(images: DataFrame, program: Callable = Program) -> DataFrame:
    """``image, status, word_idx`` and the fields of ``WORD``, for ``tables.words_to_lines``.

    An image without words has one row, whose text is null.
    """
    names = ("image", "status", "word_idx", *WORD)
    kinds = {"word_idx": pa.int32(), "block_num": pa.int32(), "par_num": pa.int32(), "line_num": pa.int32()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def rows(image: str, status: str, got: dict) -> list[dict]:
        told = [dict(zip(WORD, values, strict=True)) for values in zip(*(got[n] for n in WORD), strict=True)] if got else [dict.fromkeys(WORD)]
        return [
            {"image": image, "status": status, "word_idx": k} | {n: int(v) if n in kinds and v is not None else None if v is None else str(v) for n, v in word.items()}
            for k, word in enumerate(told)
        ]

    ddl = ", ".join(f"{n} {'int' if n in kinds else 'string'}" for n in names)
    return _recognised(images, lambda engine, content: engine.words(content), None, program, schema, ddl, rows)
