"""Recognition of images: tags are found, each image is given to an engine once, its answer takes the tag's place."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import tags
from docloom.tables import bounded_batches

#: What an engine is asked, by language.
PROMPTS = {"ko": "이미지의 내용을 텍스트로 설명하세요.", "en": "Describe the content of the image as text."}
#: An engine takes bytes, type and prompt and gives text.
Engine = Callable[[bytes, str, str], str]


def answer(engine: Engine, data: bytes, kind: str, prompt: str) -> tuple[str | None, str | None]:
    """The engine's text as a figure tag, and None; or None, so that the tag stays, and why the engine failed."""
    try:
        text = engine(data, kind, prompt)
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"
    return (f"[Figure:{text.strip()}]", None) if text and text.strip() else (None, "no text")


def tesseract(languages: str = "kor+eng", options: str = "") -> Engine:
    """An engine of the local recogniser, where its packages are installed; it has no use for a prompt."""

    def engine(data: bytes, kind: str, prompt: str) -> str:
        import io

        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang=languages, config=options)

    return engine


class Progress:
    """Numbers of images asked for, recognised and failed while a job runs; an attempt of a task that is run again counts again."""

    def __init__(self, spark: SparkSession):
        self.asked, self.done, self.failed = (spark.sparkContext.accumulator(0) for _ in range(3))

    def __repr__(self) -> str:
        return f"{self.done.value} of {self.asked.value} recognised, {self.failed.value} failed"


def asked(images: DataFrame, engine: Engine, language: str = "ko", progress: Progress | None = None) -> DataFrame:
    """``path, said, error`` of images ``path, content, kind``: what the engine said of each, or why it failed."""
    prompt = PROMPTS[language]
    counts = (progress.asked, progress.done, progress.failed) if progress else None

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            said, errors = [], []
            for d, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                text, error = answer(engine, d or b"", k or "image/png", prompt)
                said.append(text)
                errors.append(error)
                if counts:
                    counts[0].add(1)
                    counts[1 if error is None else 2].add(1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(errors, pa.string())], ["path", "said", "error"])

    return bounded_batches(images.select("path", "content", "kind")).mapInArrow(ask, "path string, said string, error string")


def recognised(texts: DataFrame, images: DataFrame, engine: Engine, key: str, text: str = "text", language: str = "ko", progress: Progress | None = None) -> DataFrame:
    """``key`` and ``text`` with image tags replaced by what the engine said of the images ``path, content, kind``.

    Each path is asked for once, however many tags name it. Tags of missing images and those the engine fails
    on stay; texts without tags and null texts are as they were. Rows with one key and text count once.
    """
    each = texts.select(key, text).distinct()
    named = each.select(key, text, F.explode(tags.values(F.col(text), "image")).alias("path"))
    wanted = images.select("path", "content", "kind").dropDuplicates(["path"]).join(named.select("path").distinct(), "path", "left_semi")
    said = asked(wanted, engine, language, progress).where("said IS NOT NULL").drop("error")
    answers = named.join(said, "path").groupBy(key, text).agg(F.map_from_entries(F.collect_set(F.struct("path", "said"))).alias("said"))

    def put(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regex = re.compile(tags.pattern("image", True))
        for part in parts:
            out = []
            for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                known = dict(m or ())
                out.append(t if t is None else regex.sub(lambda x, known=known: known.get(x[1], x[0]), t))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], [key, text])

    a = answers.withColumnRenamed(key, "_k").withColumnRenamed(text, "_t")
    joined = each.join(a, F.col(key).eqNullSafe(F.col("_k")) & F.col(text).eqNullSafe(F.col("_t")), "left").select(key, text, "said")
    return bounded_batches(joined).mapInArrow(put, f"`{key}` {texts.schema[key].dataType.simpleString()}, `{text}` string")
