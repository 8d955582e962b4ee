"""Parameters of the commands, with their defaults, and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of modes, and the defaults of the parameters below.
COUNTING = ("total", "smart_shared", "unique")
MAPPING = ("end-to-end", "local")
NORMALIZATION = ("coverage", "fpkm", "raw")
TREE_FORMATS = ("png", "svg", "pdf", "txt")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


def _share(name: str, value: float | None) -> None:
    if value is not None and not 0 <= value <= 1:
        raise ValueError(f"{name} must lie between 0 and 1, not {value}")


@dataclass(frozen=True)
class MappingConfig:
    mapping: str = "end-to-end"
    trim: int = 80
    alignments: int = 100
    counting: str = "smart_shared"
    core_size: int = 100
    identity: float | None = None

    def __post_init__(self) -> None:
        _one_of("mapping", self.mapping, MAPPING)
        _one_of("counting", self.counting, COUNTING)
        _share("identity", self.identity)


@dataclass(frozen=True)
class ProfileConfig:
    rarefaction_level: int = 0
    seed: int = 1234
    normalization: str = "coverage"
    coverage_factor: float = 100.0
    core_size: int = 100
    msp_filter: float | None = None
    completeness: float = 0.9
    trim: int = 80

    def __post_init__(self) -> None:
        _one_of("normalization", self.normalization, NORMALIZATION)
        _share("msp_filter", self.msp_filter)
        _share("completeness", self.completeness)


@dataclass(frozen=True)
class MergeConfig:
    min_abundance: float = 0.0
    min_occurrence: int = 1
    remove_empty_samples: bool = False
    biom: bool = False
    prefix: str = "output"
    genes: bool = False


@dataclass(frozen=True)
class StrainConfig:
    max_depth: int = 100
    min_depth: int = 3
    min_snp_depth: int = 3
    min_frequency: float = 0.1
    ploidy: int = 1
    min_msp_coverage: float = 80
    min_gene_coverage: float = 0.5
    core_size: int = 100
    gap: str = "N"

    def __post_init__(self) -> None:
        _share("min_frequency", self.min_frequency)
        _share("min_gene_coverage", self.min_gene_coverage)


@dataclass(frozen=True)
class TreeConfig:
    max_gap: float = 1.0
    min_info_sites: int = 10
    model: str = "GTR"
    gap: str = "N"

    def __post_init__(self) -> None:
        _one_of("model", self.model, ("GTR", "TN93"))
        _share("max_gap", self.max_gap)


@dataclass(frozen=True)
class Catalogue:
    """Names of a reference catalogue's parts."""

    name: str
    database_type: str = "complete"
    functional: tuple[str, ...] = field(default=("mustard", "kegg", "dbcan", "resfinder", "resfinderfg"))
    module_databases: tuple[str, ...] = field(default=("kegg", "eggnog", "tigrfam"))
