"""Relative covariance templates: us, diag, cs, ar1. Parameters, bounds, Cholesky factors and conversions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Structure:
    kind: str
    nc: int
    hom: bool = False

    @property
    def n_par(self) -> int:
        if self.kind == "us":
            return self.nc * (self.nc + 1) // 2
        return (1 if self.hom else self.nc) + (self.kind in ("cs", "ar1") and self.nc > 1)

    def start(self) -> np.ndarray:
        if self.kind == "us":
            return _pack(np.eye(self.nc))
        sds = np.ones(1 if self.hom else self.nc)
        return np.append(sds, 0.0) if self.n_par > len(sds) else sds

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "us":
            low = _pack(np.where(np.eye(self.nc) > 0, 0.0, -np.inf))
            return low, np.full(len(low), np.inf)
        n = 1 if self.hom else self.nc
        low, up = np.zeros(n), np.full(n, np.inf)
        if self.n_par > n:
            low, up = np.append(low, -1.0 if self.kind == "ar1" else -1 / (self.nc - 1)), np.append(up, 1.0)
        return low, up

    def correlation(self, rho: float) -> np.ndarray:
        i = np.arange(self.nc)
        if self.kind == "ar1":
            return rho ** np.abs(i[:, None] - i[None, :])
        return np.where(i[:, None] == i[None, :], 1.0, rho)

    def factor(self, par: np.ndarray) -> np.ndarray:
        """The lower triangular factor of the relative covariance."""
        par = np.asarray(par, float)
        if self.kind == "us":
            out = np.zeros((self.nc, self.nc))
            out.T[np.triu_indices(self.nc)] = par
            return out
        n = 1 if self.hom else self.nc
        sds = np.full(self.nc, par[0]) if self.hom else par[:n]
        if self.n_par == n:
            return np.diag(sds)
        return sds[:, None] * semichol(self.correlation(float(par[n])))

    def __post_init__(self):
        if self.kind not in ("us", "diag", "cs", "ar1") or self.nc < 1:
            raise ValueError(f"no structure {self.kind!r} of {self.nc} effects")

    def simulate(self, rng: np.random.Generator) -> np.ndarray:
        """Parameters drawn at random: log-normal spreads, normal off-diagonals, a uniform correlation within its bounds."""
        low, up = self.bounds()
        out = np.where(low == 0.0, rng.lognormal(size=self.n_par), rng.normal(size=self.n_par))
        if self.kind in ("cs", "ar1") and self.nc > 1:
            out[-1] = rng.uniform(low[-1], up[-1])
        return out

    def checked(self, par: np.ndarray) -> np.ndarray:
        """par as an array of the right length within its bounds, or an error."""
        par, (low, up) = np.asarray(par, float), self.bounds()
        if par.shape != (self.n_par,):
            raise ValueError(f"{self.n_par} parameters are needed, not {par.size}")
        if (par < low).any() or (par > up).any():
            raise ValueError("parameters out of bounds")
        return par

    def par_names(self, group: str, effects: tuple[str, ...]) -> list[str]:
        """Names of the parameters: group.effect, group.effect.effect below the diagonal, group.rho."""
        if self.kind == "us":
            return [f"{group}.{effects[j]}" if i == j else f"{group}.{effects[i]}.{effects[j]}" for j in range(self.nc) for i in range(j, self.nc)]
        names = [f"{group}.sd"] if self.hom and self.nc > 1 else [f"{group}.{e}" for e in effects[: 1 if self.hom else self.nc]]
        return names + [f"{group}.rho"] * (self.n_par > len(names))

    # -- the factor's own coordinates ---------------------------------------------------------------
    def theta_index(self) -> np.ndarray:
        """For each entry of the factor's lower triangle, column by column, the number of its theta (-1: always zero)."""
        rows, cols = np.tril_indices(self.nc)[0], np.tril_indices(self.nc)[1]
        order = np.lexsort((rows, cols))
        rows, cols = rows[order], cols[order]
        if self.kind == "us":
            return np.arange(len(rows))
        if self.kind == "diag" or self.nc == 1:
            return np.where(rows == cols, 0 if self.hom else cols, -1)
        if not self.hom:
            return np.arange(len(rows))
        # equal spreads: ar1 has a first column and one factor of it, cs an entry on and one below the diagonal of each column
        if self.kind == "ar1":
            return np.where(cols == 0, rows, self.nc + rows - cols)
        return np.where(rows == cols, 2 * cols, 2 * cols + 1)

    def n_theta(self) -> int:
        return int(self.theta_index().max()) + 1

    def theta(self, par: np.ndarray) -> np.ndarray:
        """The independent entries of the factor."""
        index, flat = self.theta_index(), _pack(self.factor(par))
        out = np.zeros(self.n_theta())
        out[index[index >= 0]] = flat[index >= 0]
        return out

    def factor_of(self, theta: np.ndarray) -> np.ndarray:
        """The factor with the given independent entries."""
        index = self.theta_index()
        out = np.zeros((self.nc, self.nc))
        out.T[np.triu_indices(self.nc)] = np.where(index >= 0, np.asarray(theta, float)[np.maximum(index, 0)], 0.0)
        return out

    def theta_names(self, group: str, effects: tuple[str, ...]) -> list[str]:
        index = self.theta_index()
        first = [int(np.flatnonzero(index == k)[0]) for k in range(self.n_theta())]
        pairs = [(i, j) for j in range(self.nc) for i in range(j, self.nc)]
        return [f"{group}.{effects[j]}" if i == j else f"{group}.{effects[i]}.{effects[j]}" for i, j in (pairs[k] for k in first)]

    def par_of(self, theta: np.ndarray) -> np.ndarray:
        """The parameters behind the factor's entries; a correlation that a zero spread hides is 0."""
        m = self.factor_of(theta)
        if self.kind == "us":
            return _pack(m)
        return self.par_of_cov(m @ m.T)

    def par_of_cov(self, v: np.ndarray) -> np.ndarray:
        """The parameters behind a relative covariance of this structure."""
        if self.kind == "us":
            return _pack(semichol(v))
        sd = np.sqrt(np.maximum(0, np.diag(v)))
        own = sd[:1] if self.hom else sd
        if self.n_par == len(own):
            return own
        at = sd[0] * sd[1]
        return np.append(own, v[1, 0] / at if at > 0 else 0.0)

    def sdcor(self, par: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Standard deviations and the correlations below the diagonal, column by column."""
        r = cov2sdcor(sigma**2 * self.factor(par) @ self.factor(par).T)
        return np.diag(r).copy(), r.T[np.triu_indices(self.nc, 1)]

    def par_of_sdcor(self, sd: np.ndarray, cor: np.ndarray, sigma: float = 1.0) -> np.ndarray:
        r = np.diag(np.asarray(sd, float) / sigma)
        r.T[np.triu_indices(self.nc, 1)] = np.nan_to_num(np.asarray(cor, float))
        r = np.tril(r) + np.tril(r, -1).T
        return self.par_of_cov(sdcor2cov(r))

    def profile_par(self, par: np.ndarray, sigma: float, scale: str = "sdcor") -> np.ndarray:
        """Coordinates for profiles: spreads and correlations on the response's scale, or for us and diag variances and covariances."""
        if scale == "varcov":
            if self.kind in ("cs", "ar1"):
                raise ValueError(f"{self.kind} is profiled by spreads and correlation only")
            v = sigma**2 * self.factor(par) @ self.factor(par).T
            return _pack(np.tril(v)) if self.kind == "us" else np.diag(v)[: self.n_par].copy()
        if self.kind == "us":
            return _pack(np.tril(cov2sdcor(sigma**2 * self.factor(par) @ self.factor(par).T)))
        out = np.asarray(par, float).copy()
        n = 1 if self.hom else self.nc
        out[:n] *= sigma
        return out

    def par_of_profile(self, prof: np.ndarray, sigma: float, scale: str = "sdcor") -> np.ndarray:
        prof = np.asarray(prof, float)
        if self.kind == "us":
            m = np.zeros((self.nc, self.nc))
            m.T[np.triu_indices(self.nc)] = prof
            m = m + np.tril(m, -1).T
            return _pack(semichol((sdcor2cov(np.nan_to_num(m)) if scale == "sdcor" else m) / sigma**2))
        if scale == "varcov":
            return np.sqrt(np.maximum(prof, 0)) / sigma
        out, n = prof.copy(), 1 if self.hom else self.nc
        out[:n] /= sigma
        return out

    def profile_bounds(self, scale: str = "sdcor") -> tuple[np.ndarray, np.ndarray]:
        if self.kind != "us":
            return self.bounds()
        diagonal = _pack(np.eye(self.nc)) > 0
        return np.where(diagonal, 0.0, -1.0 if scale == "sdcor" else -np.inf), np.where(diagonal, np.inf, 1.0 if scale == "sdcor" else np.inf)

    def profile_names(self, effects: tuple[str, ...], group: str) -> list[str]:
        if self.kind == "us":
            return [f"sd_{effects[j]}|{group}" if i == j else f"cor_{effects[i]}.{effects[j]}|{group}" for j in range(self.nc) for i in range(j, self.nc)]
        n = 1 if self.hom else self.nc
        return [f"sd_{e}|{group}" for e in effects[:n]] + [f"rho|{group}"] * (self.n_par > n)

    def singular(self, par: np.ndarray, tol: float = 1e-4) -> bool:
        low, up = self.bounds()
        return bool((np.minimum(np.asarray(par) - low, up - np.asarray(par)) < tol).any())


def _pack(m: np.ndarray) -> np.ndarray:
    """Lower triangle, column by column."""
    return m.T[np.triu_indices(len(m))]


def make(kind: str, nc: int, hom: bool | None = None) -> Structure:
    return Structure(kind, nc, (kind == "ar1") if hom is None else hom)


def semichol(m: np.ndarray) -> np.ndarray:
    """Cholesky factor of a matrix that may be only semi-definite."""
    n = len(m)
    out = np.zeros((n, n))
    for j in range(n):
        v = m[j, j] - out[j, :j] @ out[j, :j]
        out[j, j] = np.sqrt(v) if v > 1e-14 else 0.0
        if out[j, j] > 0:
            out[j + 1 :, j] = (m[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out


def sdcor2cov(m: np.ndarray) -> np.ndarray:
    """Standard deviations on the diagonal and correlations beside it, as a covariance."""
    sd = np.diag(m)
    r = np.array(m, float)
    np.fill_diagonal(r, 1.0)
    return r * np.outer(sd, sd)


def cov2sdcor(v: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(v))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = v / np.outer(sd, sd)
    np.fill_diagonal(r, sd)
    return r


def vec2_st(v: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Each factor as S T in one matrix: spreads on the diagonal, the unit lower triangle below."""
    out = []
    for m in vec2mlist(v, sizes):
        low = np.tril(m)
        d = np.diag(low)
        t = low / np.where(d == 0, 1.0, d)[None, :]
        np.fill_diagonal(t, d)
        out.append(t)
    return out


def vec_size(n: int) -> int:
    """The order of a matrix whose lower triangle has n entries."""
    k = int(round((np.sqrt(8 * n + 1) - 1) / 2))
    if k * (k + 1) // 2 != n:
        raise ValueError(f"{n} is no size of a triangle")
    return k


def safe_chol(m: np.ndarray) -> np.ndarray:
    """Cholesky factor; of a zero or semi-definite matrix, too."""
    return semichol(np.asarray(m, float))


def vec2mlist(v: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        m = np.zeros((n, n))
        m.T[np.triu_indices(n)] = v[at : at + n * (n + 1) // 2]
        out.append(m + np.tril(m, -1).T)
        at += n * (n + 1) // 2
    return out


def mlist2vec(ms: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([_pack(np.tril(m)) for m in ms])


def cv_to_vv(v: np.ndarray, sizes: list[int], s: float = 1.0) -> np.ndarray:
    """Cholesky vector to variance-covariance vector, times s squared."""
    return mlist2vec([s * s * np.tril(m) @ np.tril(m).T for m in vec2mlist(v, sizes)])


def vv_to_cv(v: np.ndarray, sizes: list[int], s: float = 1.0) -> np.ndarray:
    return mlist2vec([semichol(m / (s * s)) for m in vec2mlist(v, sizes)])


def cv_to_sv(v: np.ndarray, sizes: list[int], s: float = 1.0) -> np.ndarray:
    return mlist2vec([cov2sdcor(s * s * np.tril(m) @ np.tril(m).T) for m in vec2mlist(v, sizes)])


def sv_to_cv(v: np.ndarray, sizes: list[int], s: float = 1.0) -> np.ndarray:
    return mlist2vec([semichol(sdcor2cov(m) / (s * s)) for m in vec2mlist(v, sizes)])


def re_pca(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations and rotation of the principal components of a random-effects covariance."""
    u, sd, _ = np.linalg.svd(factor)
    return sd, u
