"""Convex hulls as inequalities, by numpy on the driver: vertex counts are small, the result becomes literals.

Half-space membership in the closed hull selects what cutting the hull axis by axis would, in one filter.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

#: In coordinates scaled to the hull: how far outside a facet, or off a flat hull, a point may be.
EPSILON = 1e-9


@dataclass(frozen=True)
class HalfSpaces:
    """Points with ``normals @ ((x - centre) / scale) <= offsets`` and ``abs(flat @ ...) <= epsilon``."""

    centre: np.ndarray
    scale: np.ndarray
    normals: np.ndarray
    offsets: np.ndarray
    flat: np.ndarray

    def contains(self, points: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
        y = (np.atleast_2d(np.asarray(points, float)) - self.centre) / self.scale
        inside = np.ones(len(y), bool)
        if len(self.normals):
            inside &= (y @ self.normals.T <= self.offsets + epsilon).all(axis=1)
        if len(self.flat):
            inside &= (np.abs(y @ self.flat.T) <= epsilon).all(axis=1)
        return inside


def half_spaces(vertices: np.ndarray) -> HalfSpaces:
    """The closed convex hull of some points (not all need be extreme), of any dimension, flat ones included."""
    v = np.unique(np.asarray(vertices, float), axis=0)
    centre = (v.min(axis=0) + v.max(axis=0)) / 2
    scale = np.maximum((v.max(axis=0) - v.min(axis=0)) / 2, 0)
    scale = np.where(scale > 1e-14 * np.maximum(1, np.abs(centre)), scale, 1.0)
    y = (v - centre) / scale
    mean = y.mean(axis=0)
    _, sizes, axes = np.linalg.svd(y - mean, full_matrices=True)
    rank = int((sizes > 1e-10).sum())
    basis, rest = axes[:rank], axes[rank:]
    flat_offsets = rest @ mean
    shift = rest.T @ flat_offsets if len(rest) else np.zeros(len(centre))  # the hull's plane as a plane through zero
    normals, offsets = _facets((y - mean) @ basis.T)
    own = normals @ basis if rank else np.empty((0, len(centre)))
    offsets = offsets + own @ (mean - shift) if rank else np.empty(0)
    return HalfSpaces(centre + shift * scale, scale, own, offsets, rest)


def _facets(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals and offsets of the facets of points that span their space."""
    n, d = z.shape
    if d == 0:
        return np.empty((0, 0)), np.empty(0)
    if d == 1:
        return np.array([[1.0], [-1.0]]), np.array([z.max(), -z.min()])
    if d == 2:
        ring = convex_ring(z)
        edge = np.roll(ring, -1, axis=0) - ring
        normals = np.stack([edge[:, 1], -edge[:, 0]], axis=1) / np.linalg.norm(edge, axis=1, keepdims=True)
        return normals, (normals * ring).sum(axis=1)
    found: dict[tuple, tuple[np.ndarray, float]] = {}
    picks = np.array(list(itertools.combinations(range(n), d)))
    for part in np.array_split(picks, max(1, len(picks) // 20_000)):
        corners = z[part]
        _, s, vt = np.linalg.svd(corners[:, 1:] - corners[:, :1], full_matrices=True)
        normal = vt[:, -1]
        solid = s[:, -1] > 1e-9
        level = np.einsum("kd,kd->k", normal, corners[:, 0])
        side = np.einsum("kd,nd->kn", normal, z) - level[:, None]
        for sign in (1, -1):
            ok = solid & (sign * side <= 1e-9).all(axis=1)
            for a, b in zip(sign * normal[ok], sign * level[ok]):
                found.setdefault(tuple(np.round([*a, b], 7) + 0.0), (a, b))
    return np.array([a for a, _ in found.values()]), np.array([b for _, b in found.values()])


def convex_ring(points: np.ndarray) -> np.ndarray:
    """The extreme points of a planar set, counter-clockwise."""
    pts = sorted(map(tuple, points))

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 1e-12:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def disk_vertices(centre: tuple[float, float], radius: tuple[float, float], corners: int = 12) -> np.ndarray:
    """A regular polygon around an ellipse with axis-parallel radii: its sides touch the ellipse."""
    at = 2 * np.pi * np.arange(corners) / corners
    out = 1 / np.cos(np.pi / corners)
    return np.array(centre) + np.array(radius) * out * np.stack([np.cos(at), np.sin(at)], axis=1)


def ellipsoid_vertices(centre: tuple, radius: tuple) -> np.ndarray:
    """An icosahedron around an ellipsoid."""
    edge = 2 / np.tan(np.radians(138.19) / 2) * np.tan(np.pi / 3)  # 138.19: the dihedral angle
    a, b = edge / 2, edge * (1 + np.sqrt(5)) / 4
    signs = list(itertools.product((-1, 1), repeat=2))
    unit = [(0, s * a, t * b) for s, t in signs] + [(s * a, t * b, 0) for s, t in signs] + [(t * b, 0, s * a) for s, t in signs]
    return np.array(centre) + np.array(radius) * np.array(unit)


def box_corners(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.array(list(itertools.product(*zip(low, high))))
