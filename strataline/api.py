"""The four runs as functions. Options come as one object or as keywords, not both."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from strataline.plans import export, model, quality, reconstruct, verify


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def export_tables(source, output, *, spark: SparkSession | None = None, options: model.ExportOptions | None = None, progress: Callable | None = None, **keywords) -> model.Run:
    if options is not None and keywords:
        raise ValueError("options and keywords can't be given together")
    return export.export_tree(session(spark), str(source), str(output), options or model.ExportOptions(**keywords), progress)


def reconstruct_tables(source, output, *, spark: SparkSession | None = None, options: model.ReconstructionOptions | None = None, progress: Callable | None = None, **keywords) -> model.Run:
    if options is not None and keywords:
        raise ValueError("options and keywords can't be given together")
    chosen = options or model.ReconstructionOptions(**keywords)
    return reconstruct.reconstruct_tree(session(spark), str(source), str(output), chosen.input_format, chosen.memo, chosen.overwrite, progress)


def verify_export(source, output, *, spark: SparkSession | None = None, formats: str | Iterable[str] = model.FORMATS, strict: bool = True, report: str | None = None, write_report: bool = True) -> model.Run:
    return verify.verify_tree(session(spark), str(source), str(output), formats, strict, report, write_report)


def check_quality(source, output, *, spark: SparkSession | None = None, overwrite: bool = False, max_differences: int = 20, progress: Callable | None = None) -> model.Run:
    return quality.check_tree(session(spark), str(source), str(output), overwrite, max_differences, progress)
