"""All parameters of a run in one place, checked once."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Defaults of the grids.
KS = (15, 21, 31)
KS_LONG = (15, 21, 31, 41, 51)
ALPHAS = (0.001, 0.01, 0.1, 1.0)
ALPHAS_FINE = (1.0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-6)


@dataclass(frozen=True)
class Config:
    """One run: which k-mers count, how counts become probabilities, which weight and which distance.

    validity: "acgt" counts k-mers of A, C, G, T only; "no_n" all that hold no N. boundary: "file" joins the records of a
    file, so that k-mers span them; "record" does not. singletons: what silhouettes do with classes of one sample: "zero"
    scores them 0, "exclude" leaves them out. clip: which negative distances become 0: "symmetric", "directed" or "none".
    """

    k: int = 15
    alpha: float = 1.0
    beta: float | None = None
    epsilon: float = 1e-12
    log_base: float = 2.0
    weight: str = "one"
    cap_weight: float | None = None
    scale_weight: bool = False
    canonical: bool = False
    validity: str = "acgt"
    boundary: str = "file"
    strict_idf: bool = False
    idf_min_df: int = 1
    idf_max_df_fraction: float = 1.0
    idf_power: float = 1.0
    singletons: str = "zero"
    clip: str = "symmetric"
    clear_above: float = 0.10
    middle: str = "weak/ambiguous"

    def __post_init__(self):
        checks = (
            (self.k >= 1, "k must be at least 1"),
            (self.alpha >= 0, "alpha must not be negative"),
            (self.beta is None or self.beta >= 0, "beta must not be negative"),
            (self.epsilon > 0, "epsilon must be positive"),
            (self.log_base > 0 and self.log_base != 1, "log_base must be positive and not 1"),
            (self.cap_weight is None or self.cap_weight > 0, "cap_weight must be positive"),
            (self.idf_min_df >= 1, "idf_min_df must be at least 1"),
            (0 < self.idf_max_df_fraction <= 1, "idf_max_df_fraction must be above 0 and at most 1"),
            (self.idf_power >= 0, "idf_power must not be negative"),
            (self.weight in ("one", "neglog", "inverse", "inverse_sqrt"), f"unknown weight {self.weight}"),
            (self.validity in ("acgt", "no_n"), f"unknown validity {self.validity}"),
            (self.boundary in ("file", "record"), f"unknown boundary {self.boundary}"),
            (self.singletons in ("zero", "exclude"), f"unknown singletons {self.singletons}"),
            (self.clip in ("symmetric", "directed", "none"), f"unknown clip {self.clip}"),
        )
        for fine, said in checks:
            if not fine:
                raise ValueError(said)
        if self.weight != "one" and self.beta is None:
            raise ValueError("a weight of global frequencies needs beta")

    def but(self, **changes) -> Config:
        return replace(self, **changes)


#: A configuration for each family of distances, as published results were made.
PRESETS = {
    "kl": Config(alpha=1.0),
    "kl_neglog": Config(alpha=1.0, beta=1.0, weight="neglog", scale_weight=True, validity="no_n"),
    "kl_inverse": Config(alpha=1.0, beta=1.0, weight="inverse", scale_weight=True, clip="none"),
    "kl_inverse_sqrt": Config(alpha=1.0, beta=1.0, weight="inverse_sqrt", scale_weight=True, clip="none"),
    "tfidf_kl": Config(clip="none"),
    "jsd": Config(alpha=0.0),
    "cosine": Config(validity="no_n"),
    "kwip": Config(canonical=True),
    "low_memory": Config(singletons="exclude", clear_above=0.05),
}
