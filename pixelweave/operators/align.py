"""Orientation of a camera on a stage, and registration of two lenses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import kernels

#: Fixed values, in their order, which decides between layouts that are equally near: degrees clockwise and whether mirrored first, and the rows of the matrix from
#: the picture to the stage.
LAYOUTS = {
    (0, False): ((1, 0), (0, 1)),
    (90, False): ((0, -1), (1, 0)),
    (180, False): ((-1, 0), (0, -1)),
    (270, False): ((0, 1), (-1, 0)),
    (0, True): ((-1, 0), (0, 1)),
    (90, True): ((0, -1), (-1, 0)),
    (180, True): ((1, 0), (0, -1)),
    (270, True): ((0, 1), (1, 0)),
}
#: Fixed bounds of what is accepted.
RESIDUAL, AGREEMENT, PIXELS_APART, SCHEMA = 0.25, 0.5, 0.05, 3


def nearest_layout(matrices: DataFrame) -> DataFrame:
    """(case_id, rotation_deg, reflection, stage_x_from_image, stage_y_from_image, residual) for rows (case_id, m00, m01, m10, m11).

    The layout of least Frobenius distance, the earlier one on ties.
    """
    options = [
        F.struct(
            F.sqrt(sum(((F.col(f"m{i}{j}") - float(m[i][j])) * (F.col(f"m{i}{j}") - float(m[i][j])) for i in (0, 1) for j in (0, 1)), F.lit(0.0))).alias("residual"),
            F.lit(n).alias("order"),
            F.lit(turn).alias("rotation_deg"),
            F.lit(mirror).alias("reflection"),
            F.lit(signed_axis(m[0])).alias("stage_x_from_image"),
            F.lit(signed_axis(m[1])).alias("stage_y_from_image"),
        )
        for n, ((turn, mirror), m) in enumerate(LAYOUTS.items())
    ]
    return matrices.select("case_id", F.array_min(F.array(*options)).alias("best")).select("case_id", "best.rotation_deg", "best.reflection", "best.stage_x_from_image", "best.stage_y_from_image", "best.residual")


def negative_inverse(m00: Column, m01: Column, m10: Column, m11: Column) -> list[Column]:
    """Entries of minus the inverse of a 2 by 2 matrix; null if there is none."""
    det = m00 * m11 - m01 * m10
    over = lambda x: F.when(det != 0, -x / det)
    return [over(m11), over(-m01), over(-m10), over(m00)]


def pixel_sizes(shift_x: tuple[Column, Column], shift_y: tuple[Column, Column], move_um: Column) -> list[Column]:
    """µm per pixel along each stage axis, from the picture's shifts (columns, rows) after a move along it; null if there was none."""
    out = []
    for dc, dr in (shift_x, shift_y):
        length = F.sqrt(dc * dc + dr * dr)
        out.append(F.when(length > 0, move_um / length))
    return out


def orientation_document(shifts: DataFrame) -> DataFrame:
    """From (case_id, x_dc, x_dr, y_dc, y_dr, move_um): pixel size, layout, whether it is accepted, and why not."""
    px, py = pixel_sizes((F.col("x_dc"), F.col("x_dr")), (F.col("y_dc"), F.col("y_dr")), F.col("move_um"))
    found = shifts.withColumn("px", px).withColumn("py", py).withColumn("pixel_um", (F.col("px") + F.col("py")) / 2)
    # what the picture does is the opposite of what the stage does
    per = lambda n: F.col(n) * F.col("pixel_um") / F.col("move_um")
    entries = negative_inverse(per("x_dc"), per("y_dc"), per("x_dr"), per("y_dr"))
    found = found.withColumns({f"m{i // 2}{i % 2}": e for i, e in enumerate(entries)})
    best = nearest_layout(found.where("pixel_um is not null and m00 is not null"))
    out = found.join(best, "case_id", "left")
    ok = F.coalesce(F.col("residual") <= RESIDUAL, F.lit(False))
    why = F.when(F.col("pixel_um").isNull(), "the picture did not move").when(F.col("residual").isNull(), "both moves shift the picture the same way").when(~ok, "the camera is turned against the stage").otherwise("")
    warn = F.abs(F.col("px") - F.col("py")) > PIXELS_APART * F.col("pixel_um")
    return out.select("case_id", F.lit(SCHEMA).alias("schema_version"), "pixel_um", "rotation_deg", "reflection", "stage_x_from_image", "stage_y_from_image", "residual", ok.alias("accepted"), why.alias("why"), F.coalesce(warn, F.lit(False)).alias("pixels_differ"))


def registration_verdict(cases: DataFrame) -> DataFrame:
    """From (case_id, dx_um, dy_um, z_a, z_b, bracketed_a, bracketed_b, agreement): the offset in z, whether all is accepted, and why not.

    A side without a stack has null heights and brackets.
    """
    both = F.col("bracketed_a") & F.col("bracketed_b")
    dz = F.when(F.coalesce(both, F.lit(False)), F.col("z_b") - F.col("z_a"))
    open_ = ~F.coalesce(F.col("bracketed_a"), F.lit(True)) | ~F.coalesce(F.col("bracketed_b"), F.lit(True))
    ok = (F.col("agreement") >= AGREEMENT) & ~open_
    why = F.when(open_, "a stack's sharpest plane is at its end: refocus").when(F.col("agreement") < AGREEMENT, "the pictures agree too little").otherwise("")
    return cases.select("case_id", "dx_um", "dy_um", dz.alias("dz_um"), ok.alias("accepted"), why.alias("why"))


def zoom(a: np.ndarray, factor: float) -> np.ndarray:
    """Linear interpolation on a grid that keeps first and last pixels; the picture itself within 1e-9 of no change."""
    if abs(factor - 1) < 1e-9:
        return a
    for axis in (0, 1):
        n, m = a.shape[axis], max(1, round(a.shape[axis] * factor))
        at = np.linspace(0, n - 1, m)
        low = np.minimum(at.astype(int), n - 1)
        part = (at - low).reshape(-1, *[1] * (1 - axis))
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, n - 1), axis) * part
    return a


def middle(a: np.ndarray, height: int, width: int) -> np.ndarray:
    top, left = (a.shape[0] - height) // 2, (a.shape[1] - width) // 2
    return a[top : top + height, left : left + width]


def register(a: np.ndarray, b: np.ndarray, um_a: float, um_b: float) -> tuple[float, float, float]:
    """x and y in µm from the middle of ``a`` to that of ``b``, and how well they agree; the finer picture is made coarser."""
    um = max(um_a, um_b)
    a, b = zoom(a, um_a / um), zoom(b, um_b / um)
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    (dr, dc), score = kernels.measured_shift(middle(a, h, w), middle(b, h, w))
    return dc * um, dr * um, score


def signed_axis(row: tuple[float, float]) -> str:
    """The image axis that a stage axis comes from, by its row of the matrix: +X, -X, +Y or -Y."""
    along = max((0, 1), key=lambda i: (abs(row[i]), -i))
    return "+-"[row[along] < 0] + "XY"[along]


def turned(matrix: tuple) -> float:
    """Angle of a 2 by 2 matrix's first column, in degrees."""
    return math.degrees(math.atan2(matrix[1][0], matrix[0][0]))
