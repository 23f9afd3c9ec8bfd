"""Settings of a study, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from fellscape.operators.rescale import Bounds
from fellscape.operators.sample import check_subsample


@dataclass(frozen=True)
class Study:
    """Inputs, responses and everything a run needs to know.

    ``bounds`` are the declared limits of the inputs, ``target`` the limits they are mapped to
    (None leaves the inputs alone). Each population can be left out: no ``responses``, no ``fids``
    or no ``generated``. How much runs at once is the cluster's business.
    """

    bounds: Bounds
    responses: tuple[str, ...]
    target: Bounds | None = None
    normalize_x: bool = True
    normalize_y: bool = True
    problem_label: str = "problem"
    id_col: str = "sample_id"
    bootstrap: bool = True
    ratio: float = 0.8
    repeats: int = 2
    fids: tuple[int, ...] = tuple(range(1, 25))
    iids: tuple[int, ...] = (1,)
    generated: int = 5
    seed: int = 42
    blocks: int = 2
    families: tuple[str, ...] = field(default=("ela_meta", "ela_distr", "ela_level", "pca", "limo", "nbc", "disp", "ic"))

    def __post_init__(self):
        if not self.responses and not self.functions and not self.generated:
            raise ValueError("a study needs a response, a benchmark function or a generated one")
        if any(hi <= lo for lo, hi in zip(self.bounds.lower, self.bounds.upper)):
            raise ValueError("every upper bound must exceed its lower bound")
        if self.normalize_x and self.target is None:
            object.__setattr__(self, "target", Bounds.cube(self.bounds.names))
        if self.target is not None and len(self.target.names) != len(self.bounds.names):
            raise ValueError("target bounds must cover every input")
        if self.bootstrap:
            check_subsample(self.ratio, self.repeats)
        if self.generated < 0:
            raise ValueError("the number of generated functions cannot be negative")

    @property
    def x(self) -> list[str]:
        return list(self.bounds.names)

    @property
    def box(self) -> Bounds:
        """Limits of the inputs the features see."""
        return self.target if self.normalize_x else self.bounds

    @property
    def reps(self) -> list[int]:
        return list(range(self.repeats)) if self.bootstrap else [0]

    @property
    def functions(self) -> list[tuple[int, int]]:
        return [(f, i) for f in self.fids for i in self.iids]
