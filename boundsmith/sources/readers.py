"""Where descriptions, projects and OCR words come from."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COURSE_ROW = "struct<id:string,type:string,direction:string,distance:string,radius:string,delta:string,source:string>"
OCR_LINE = "struct<text:string,confidence:double,x:int,y:int,width:int,height:int>"
ROW_AUDIT = (
    "struct<row_index:int,source:string,original_text:string,method:string,confidence:string,reason:string,"
    "residual:double,bearing_text:string,distance_text:string,direction_word:string,timestamp:string>"
)
PROJECT_SCHEMA = (
    "version int, legal_text string, start_x string, start_y string, ocr_draft string, reference_image_path string, "
    f"ocr_lines array<{OCR_LINE}>, course_rows array<{COURSE_ROW}>, row_audits array<{ROW_AUDIT}>, closure string"
)
PROJECT_VERSION = 1


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, source_text``: each file is one description, named by its path."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("source_text"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECT_SCHEMA).json(path, multiLine=True)


def project_problem(raw: Column) -> Column:
    """Null if the JSON text is a project that can be read, else what is wrong with it."""
    version = F.get_json_object(raw, "$.version")
    number = version.try_cast("int")
    return (
        F.when(~F.trim(raw).startswith("{") | F.get_json_object(raw, "$").isNull(), "project file must hold an object").when(version.isNull(), "missing version")
        .when(number.isNull(), "version is no number").when(number > PROJECT_VERSION, F.concat(F.lit("unsupported version "), version))
        .when(F.get_json_object(raw, "$.course_rows").isNull(), "missing course_rows")
    )


def resolve_ocr_binary(env: dict[str, str] | None = None, exists: Callable[[str], bool] = os.path.exists, which: Callable[[str], str | None] = shutil.which) -> str | None:
    """The OCR program: a configured path, usual places, then the search path."""
    env = dict(os.environ) if env is None else env
    local = env.get("LOCALAPPDATA")
    places = [
        env.get("TESSERACT_CMD"), r"C:\Program Files\Tesseract-OCR\tesseract.exe", r"C:\Program Files (x86)\Tesseract-OCR\tesseract.exe",
        rf"{local}\Programs\Tesseract-OCR\tesseract.exe" if local else None,
    ]
    return next((p for p in places if p and exists(p)), None) or which("tesseract")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as ``image, content, status``; without an OCR program the status says so."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,tif,tiff}").load(path)
    status = "READY" if resolve_ocr_binary() else "OCR_NOT_AVAILABLE"
    return rows.select(F.col("path").alias("image"), "content", F.lit(status).alias("status"))
