"""Small planted fixtures and brute-force references."""

import numpy as np
import pandas as pd


def cells(spark, layers, partitions=3):
    """``{layer: (n x p matrix)}`` to long cells with zero-padded ids."""
    frames = []
    for name, x in layers.items():
        n, p = x.shape
        frames.append(
            pd.DataFrame(
                {
                    "layer": name,
                    "sample_id": np.repeat([f"s{i:03d}" for i in range(n)], p),
                    "feature_id": np.tile([f"f{j:04d}" for j in range(p)], n),
                    "value": x.ravel(),
                }
            )
        )
    return spark.createDataFrame(pd.concat(frames)).repartition(partitions)


def matrix(long, row, column, value):
    """Long Spark rows to a numpy matrix ordered by ids."""
    return long.toPandas().pivot(index=row, columns=column, values=value).sort_index().to_numpy()


def planted(rng, n, p, signal, noise, specific=0.0, k=2):
    """Layers that share one feature axis; each may have an axis of its own."""
    v = rng.normal(size=p)
    v /= np.linalg.norm(v)
    out = {}
    for i in range(k):
        u = rng.normal(size=n)
        u = (u - u.mean()) / np.linalg.norm(u - u.mean())
        x = signal * np.outer(u, v) + noise * rng.normal(size=(n, p))
        if specific:
            w = rng.normal(size=p)
            w -= v * (w @ v)
            t = rng.normal(size=n)
            t -= u * (t @ u)
            x += specific * np.outer(t / np.linalg.norm(t), w / np.linalg.norm(w))
        out[f"L{i}"] = x
    return out, v


def angle(a, b):
    c = abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b)
    return np.degrees(np.arccos(min(1.0, c)))


def double_well(rng, n, beta=2.0):
    """Draws from exp(-beta (x^2-1)^2): wells at -1 and 1, barrier at 0."""
    out = []
    while len(out) < n:
        x = rng.uniform(-2, 2, 4 * n)
        out.extend(x[rng.uniform(size=len(x)) < np.exp(-beta * (x * x - 1) ** 2)])
    return np.array(out[:n])


def projector_gap(a, b):
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(qa @ qa.T - qb @ qb.T)
