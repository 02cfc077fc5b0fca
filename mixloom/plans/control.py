"""Controls of fits: which checks to run and how loud, which optimizer, how exact."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

ACTIONS = ("ignore", "message", "warning", "stop")


class ModelWarning(UserWarning):
    """A remark of a check; message or warning by its level."""


@dataclass(frozen=True)
class Checks:
    """Level of each check of the data: ignore, message, warning or stop."""

    levels_above_one: str = "stop"  # every grouping factor has two levels
    levels_above_four: str = "ignore"  # and five
    levels_below_rows: str = "stop"  # fewer levels than rows
    effects_below_rows: str = "stop"  # fewer random effects of a term than rows
    rank_z: str = "ignore"  # random-effects columns are independent
    rank_x: str = "message"  # dependent fixed-effect columns are dropped (stop: an error)
    scale_x: str = "warning"  # columns of very different spread
    constant_response: str = "stop"

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) not in ACTIONS:
                raise ValueError(f"{f.name} must be one of {', '.join(ACTIONS)}")


@dataclass(frozen=True)
class Convergence:
    gradient_tol: float = 2e-3
    singular_tol: float = 1e-4
    hessian_tol: float = 1e-6
    relative_tol: float | None = None
    most_rows: float = 1e4  # beyond these rows derivatives are left out, unless None
    most_parameters: int = 10


@dataclass(frozen=True)
class Control:
    """Everything a fit may be told. optimizer: a name of optimize.OPTIMIZERS or a callable (f, start, lower, upper, **options)."""

    optimizer: str | Callable = "quadratic"
    options: dict = field(default_factory=dict)
    restart_edge: bool = True
    boundary_tol: float = 1e-5
    derivatives: bool = True
    autoscale: bool = False
    checks: Checks = Checks()
    convergence: Convergence = Convergence()
    tol_pirls: float = 1e-10
    steps_pirls: int = 100
    first_stage: bool = True  # generalized models: fit with profiled fixed effects first

    def with_(self, **changes) -> Control:
        own = {f.name for f in fields(Checks)}
        checks = replace(self.checks, **{k: v for k, v in changes.items() if k in own})
        conv = {f.name for f in fields(Convergence)}
        convergence = replace(self.convergence, **{k: v for k, v in changes.items() if k in conv})
        return replace(self, checks=checks, convergence=convergence, **{k: v for k, v in changes.items() if k not in own | conv})


def lmm_control(**changes) -> Control:
    return Control().with_(**changes)


def glmm_control(**changes) -> Control:
    return Control(restart_edge=False).with_(most_parameters=changes.pop("most_parameters", 20), **changes)


def nlmm_control(**changes) -> Control:
    return Control(optimizer="simplex", restart_edge=False).with_(**changes)


def report(level: str, text: str, into: list[str] | None = None) -> None:
    """Raises, warns, or keeps a remark, as the check's level says."""
    if level == "ignore":
        return
    if level == "stop":
        raise ValueError(text)
    if into is not None:
        into.append(text)
    if level == "warning":
        warnings.warn(text, ModelWarning, stacklevel=3)


def check_arguments(kind: str, given: dict, known: set[str]) -> None:
    """Unknown keyword arguments of a fit are an error that names them; a family for a linear fit, too."""
    if kind == "lmm" and given.get("family") not in (None, "gaussian"):
        raise TypeError("a family asks for a generalized fit")
    extra = sorted(k for k in given if k not in known and k != "family")
    if extra:
        raise TypeError(f"unknown arguments: {', '.join(extra)}")
