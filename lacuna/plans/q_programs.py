"""Whole programs: a grid with holes in, the filled grid out. Each is a setting of the filling loop; SQL cannot express the loop, so tests hold them against plain versions."""

from __future__ import annotations

from ..operators import loop
from ..sources import grid
from .base import R, query, rd

#: Candidates that a first stage hands on, and those from which a person's choice is taken.
FIRST, SHOWN = 1000, 100
#: An eighth of the grid's width.
EIGHTH = 8

PROGRAMS = {
    "d_classical": {"blur": 2.0, "order": "criminisi", "neighborhood": EIGHTH},
    "d_classical_whole": {"blur": 3.0, "order": "criminisi"},
    "d_gradient_histograms": {"blur": 3.0, "order": "confidence", "k": FIRST, "second": "gradient_histogram"},
    "d_histograms": {"blur": 2.0, "order": "criminisi", "k": FIRST, "second": "histogram"},
    "d_texture": {"blur": 2.0, "order": "criminisi", "k": FIRST, "second": "gradient_histogram"},
    "d_verification": {"blur": 2.0, "order": "criminisi", "k": SHOWN, "accept": 0.03},
}


def _program(name: str, how: dict) -> None:
    @query(name)
    def run(spark, sf):
        return loop.inpaint(grid.pixels(spark, sf), R, **how).select("x", "y", rd("v").alias("v"), "iter", "src_x", "src_y")


for _n, _h in PROGRAMS.items():
    _program(_n, _h)
