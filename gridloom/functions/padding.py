"""Border padding: how far the detection canvas extends beyond the image."""

from __future__ import annotations

from math import isqrt

#: Padding where none is given.
DEFAULT_PADDING = 16


def resolve_padding(border_padding: int | None = None) -> int:
    """Unset (None or -1) means the default, 0 means none; other negative numbers are an error."""
    if border_padding is None or border_padding == -1:
        return DEFAULT_PADDING
    if border_padding < 0:
        raise ValueError(f"border_padding must be -1 or at least 0, got {border_padding}")
    return border_padding


def max_boundary_spacing(border_padding: int = DEFAULT_PADDING) -> int:
    """The largest spacing s of seeds on the border whose circumcentres stay on the canvas: s * s <= 8 * padding."""
    return isqrt(8 * border_padding) if border_padding > 0 else 0
