"""Particle tables from structured arrays of other programs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.functions.angles import pose_angles
from motes.functions.keys import image_key
from motes.operators.checks import require
from motes.operators.summaries import optics_from_folders

# Names of the fields that are read.
POSE, SHIFT = "alignments3D/pose", "alignments3D/shift"
PIXEL_SIZES = ("alignments3D/psize_A", "blob/psize_A", "location/micrograph_psize_A")
OPTICS = {
    "_rlnVoltage": "ctf/accel_kv",
    "_rlnSphericalAberration": "ctf/cs_mm",
    "_rlnAmplitudeContrast": "ctf/amp_contrast",
    "_rlnImagePixelSize": "blob/psize_A",
}
LENGTHS = {"_rlnDefocusU": "ctf/df1_A", "_rlnDefocusV": "ctf/df2_A", "_rlnCtfBfactor": "ctf/bfactor"}
RADIANS = {"_rlnDefocusAngle": "ctf/df_angle_rad", "_rlnPhaseShift": "ctf/phase_shift_rad"}
ONE_BASED = {"_rlnRandomSubset": "alignments3D/split", "_rlnClassNumber": "alignments3D/class"}


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def shift_origins(df: DataFrame, missing_to_zero: bool = False, shift: str = SHIFT, pixels: tuple[str, ...] = PIXEL_SIZES) -> DataFrame:
    """Add ``_rlnOriginXAngst`` and ``_rlnOriginYAngst``: the shift in pixels times the first pixel size that a row has.

    A table without a shift field, or a row without one, is an error unless ``missing_to_zero``. A
    shift without any pixel size is always an error.
    """
    if shift not in df.columns and not missing_to_zero:
        raise ValueError(f"no field {shift}; pass missing_to_zero=True to have origins of zero")
    if shift not in df.columns:
        return df.withColumns({"_rlnOriginXAngst": F.lit(0.0), "_rlnOriginYAngst": F.lit(0.0)})
    known = [_field(p).cast("double") for p in pixels if p in df.columns]
    if not known:
        raise ValueError(f"{shift} has no pixel size beside it; tried {', '.join(pixels)}")
    there, pixel = _field(shift).isNotNull(), F.coalesce(*known)
    sized = require(df, ~there | pixel.isNotNull(), f"a row has {shift} and none of {', '.join(pixels)}")
    if not missing_to_zero:
        sized = require(sized, there, f"a row has no {shift}; pass missing_to_zero=True to have origins of zero")
    at = [F.when(there, _field(shift)[i].cast("double") * pixel).otherwise(F.lit(0.0)) for i in range(2)]
    return sized.withColumns({"_rlnOriginXAngst": at[0], "_rlnOriginYAngst": at[1]})


def pose_columns(df: DataFrame, length: int = 3, missing_to_zero: bool = False, pose: str = POSE) -> DataFrame:
    """Add ``_rlnAngleRot``, ``_rlnAngleTilt`` and ``_rlnAnglePsi`` from a pose of 3, 4 or 9 numbers.

    A table without a pose field, or a row without a pose, is an error unless ``missing_to_zero``. So is a
    pose of another length.
    """
    names = ("_rlnAngleRot", "_rlnAngleTilt", "_rlnAnglePsi")
    if pose not in df.columns and not missing_to_zero:
        raise ValueError(f"no field {pose}, from which {', '.join(names)} come; pass missing_to_zero=True to have angles of zero")
    if pose not in df.columns:
        return df.withColumns({n: F.lit(0.0) for n in names})
    there = _field(pose).isNotNull()
    if not missing_to_zero:
        df = require(df, there, f"a row has no {pose}; pass missing_to_zero=True to have angles of zero")
    df = require(df, ~there | (F.size(_field(pose)) == length), f"a {pose} does not have {length} numbers")
    angles = pose_angles(_field(pose), length)
    return df.withColumns({n: F.when(there, a).otherwise(F.lit(0.0)) for n, a in zip(names, angles, strict=True)})


def particles_from_array(df: DataFrame, pose_length: int = 3, missing_to_zero: bool = False, order: str = "_row") -> tuple[DataFrame, DataFrame]:
    """Optics and particle table of a structured array as ``stacks.read_structured`` gives it.

    Particles keep ``order``. Image keys count from 1; a ``>`` before a path is dropped. A micrograph is what comes before
    ``/extract`` in the path; each, by first appearance, is an optics group with the values of its first particle. Subsets
    and classes count from 1 and are 1 where the array has none. Angles are in degrees and origins in Å; see
    ``pose_columns`` and ``shift_origins`` for what is missing.
    """
    path = F.regexp_replace(_field("blob/path"), "^>+", "")
    posed = shift_origins(pose_columns(df, pose_length, missing_to_zero), missing_to_zero)
    plain: Mapping[str, Column] = {
        "_rlnImageName": image_key(_field("blob/idx").cast("bigint") + 1, path),
        **{n: posed[n] for n in ("_rlnAngleRot", "_rlnAngleTilt", "_rlnAnglePsi", "_rlnOriginXAngst", "_rlnOriginYAngst")},
        **{n: _field(f).cast("double") for n, f in LENGTHS.items()},
        **{n: F.degrees(_field(f).cast("double")) for n, f in RADIANS.items()},
        **{n: (_field(f).cast("int") + 1 if f in df.columns else F.lit(1)) for n, f in ONE_BASED.items()},
        **{n: _field(f).cast("double") for n, f in OPTICS.items()},
        "_rlnImageSize": F.element_at(_field("blob/shape"), -1).cast("int"),
        "_folder": F.split(path, "/extract")[0],
    }
    table = posed.select(order, *[c.alias(n) for n, c in plain.items()])
    optics, mapped = optics_from_folders(table.withColumnRenamed("_folder", "_micrograph"), F.col("_micrograph"), [*OPTICS, "_rlnImageSize"], order)
    optics = optics.withColumnRenamed("optics_group", "_rlnOpticsGroup").drop("optics_name").withColumn("_rlnImageDimensionality", F.lit(2))
    particles = mapped.withColumnRenamed("optics_group", "_rlnOpticsGroup").drop(*OPTICS, "_rlnImageSize", "_micrograph")
    return optics, particles
