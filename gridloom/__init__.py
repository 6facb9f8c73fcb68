"""Planar geometry on bounded integer grids, and corpus preparation, as Spark DataFrame plans."""

from importlib import import_module

_PUBLIC = {
    "triangulate": "gridloom.plans.pipeline",
    "triangulate_frame": "gridloom.plans.pipeline",
    "Voronoi": "gridloom.plans.pipeline",
    "GridTriangulation": "gridloom.plans.pipeline",
    "Delaunay": "gridloom.streaming.mesh",
    "DEFAULT_PADDING": "gridloom.functions.padding",
    "max_boundary_spacing": "gridloom.functions.padding",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
