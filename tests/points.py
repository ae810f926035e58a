"""Points for tests of the chunk coder."""

import numpy as np

from voxelweave.sources.records import POINT


def some_points(fmt, n, seed=0, channels=1):
    """Points along a wandering path, with everything that may change changing now and then."""
    r = np.random.default_rng(seed)
    p = np.zeros(n, dtype=POINT[fmt])
    for k, axis in enumerate("XYZ"):
        p[axis] = np.cumsum(r.integers(-40, 60, n)) + np.where(r.random(n) < 0.02, r.integers(-(10**6), 10**6, n), 0) + 1000 * k
    p["Intensity"] = np.where(r.random(n) < 0.7, 500, r.integers(0, 65536, n))
    some = lambda most, share, start=0: np.where(r.random(n) < share, r.integers(0, most, n), start)
    p["Classification"], p["UserData"], p["PointSourceId"] = some(256, 0.2, 2), some(256, 0.1), some(65536, 0.05, 7)
    if fmt == 0:
        number = r.integers(0, 8, n)
        p["bits"] = number << 3 | np.minimum(number, r.integers(0, 8, n)) | some(4, 0.3) << 6
        p["ScanAngle"] = some(180, 0.2) - 90
        return p
    number = np.where(r.random(n) < 0.5, 1, r.integers(0, 16, n))
    p["returns"] = number << 4 | np.where(r.random(n) < 0.6, np.minimum(1, number), r.integers(0, 16, n))
    p["flags"] = some(16, 0.2) | r.integers(0, channels, n) << 4 | some(4, 0.3) << 6
    p["ScanAngle"] = some(60000, 0.1) - 30000
    t = np.cumsum(np.where(r.random(n) < 0.3, 0, 1) * np.where(r.random(n) < 0.9, 64, r.integers(-(10**4), 10**5, n)))
    t = t + np.where(r.random(n) < 0.03, 1 << 40, 0) + (4_600_000_000 << 30)
    p["GpsTime"] = t.astype("<i8").view("<f8")
    if fmt >= 7:
        for c in ("Red", "Green", "Blue"):
            p[c] = np.where(r.random(n) < 0.5, p["Intensity"], some(65536, 0.5, 300))
    if fmt == 8:
        p["Nir"] = some(65536, 0.5, 77)
    return p
