"""Drawing simulation results as text, or with matplotlib where it is installed."""

from __future__ import annotations

import sys
from abc import ABC, abstractmethod
from typing import TextIO

from .simulate import SimulationResult


def percentiles(confidence_level: float) -> tuple[float, float]:
    """Lower and upper percentile of a confidence level."""
    low = (100 - confidence_level * 100) / 2
    return low, 100 - low


class SimulationStyle(ABC):
    @abstractmethod
    def draw(self, title: str, result: SimulationResult, rows: list, histogram: bool) -> None: ...


class SimulationReportStyle(SimulationStyle):
    """A table in text; at most ``max_partitions`` rows."""

    def __init__(self, out: TextIO | None = None):
        self.out = out or sys.stdout

    def draw(self, title, result, rows, histogram):
        low, high = percentiles(result.confidence_level)
        head = ["Partition", f"{low:.3g}th percentile", result.output_unit, f"{high:.3g}th percentile", *(["Frequency"] if histogram else [])]
        number = lambda x: "-" if x is None else f"{x:.6g}"
        table = [head, *[[str(r["partition"]), number(r["lower_bound"]), number(r["mean"]), number(r["upper_bound"]), *([str(r["frequency"])] if histogram else [])] for r in rows]]
        widths = [max(len(line[i]) for line in table) for i in range(len(head))]
        line = lambda cells: "  ".join(c.rjust(w) for c, w in zip(cells, widths))
        baseline = [] if result.baseline is None else [f"Baseline = {result.baseline:.6g}"]
        print("\n".join([title, "=" * len(title), "", *baseline, "", line(table[0]), line(["-" * w for w in widths]), *map(line, table[1:]), ""]), file=self.out)


class SimulationMatplotStyle(SimulationStyle):
    def draw(self, title, result, rows, histogram):
        import matplotlib.pyplot as plt

        figure, axes = plt.subplots(2 if histogram else 1, 1, squeeze=False)
        x, top = [str(r["partition"]) for r in rows], axes[0][0]
        top.plot(x, [r["mean"] for r in rows], marker="o")
        top.fill_between(x, [r["lower_bound"] for r in rows], [r["upper_bound"] for r in rows], alpha=0.3)
        top.axhline(result.baseline or 0.0, linestyle="--")
        top.set_title(title)
        top.set_ylabel(result.output_unit)
        if histogram:
            axes[1][0].bar(x, [r["frequency"] for r in rows])
        figure.tight_layout()


class SimulationDrawer:
    STYLES = {"text": SimulationReportStyle, "matplot": SimulationMatplotStyle}

    def __init__(self, style: str | SimulationStyle = "text", *, histogram: bool = True):
        if isinstance(style, str) and style not in self.STYLES:
            raise KeyError(f"unknown style: {style}")
        self.style, self.histogram = self.STYLES[style]() if isinstance(style, str) else style, histogram

    def draw(self, result: SimulationResult, title: str | None = None) -> None:
        """Categories come by mean prediction, ranges in their own order."""
        order = "partition_idx" if result.partitioning.bounds else "mean"
        rows = result.frame.orderBy(order, "partition_idx").collect()
        self.style.draw(title or f"Simulation: {result.feature_name}", result, rows, self.histogram)
