"""Reading order of one page's boxes, for readers that hold a page in hand."""

from __future__ import annotations


def ordered(boxes: list[tuple[str, float, float, float, float, bool]], page: tuple[float, float, float, float]) -> str:
    """Boxes are (text, x0, y0, x1, y1, vertical)."""
    upright = sum(b[5] for b in boxes)
    middle = (page[0] + page[2]) / 2
    left = sum((b[1] + b[3]) / 2 < middle for b in boxes)
    n = len(boxes)
    if upright > n - upright and upright >= 3:
        key = lambda b: (-b[1], -b[4])
    elif n >= 6 and left >= 2 and n - left >= 2 and 0.3 < left / n < 0.7:
        key = lambda b: ((b[1] + b[3]) / 2 >= middle, -b[4], b[1])
    else:
        key = lambda b: (-b[4], b[1])
    return "\n".join(t for b in sorted(boxes, key=key) if (t := b[0].strip()))
