"""Settings from INI files, as frozen objects."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from fairspark.operators import feature_search, pipeline_search
from fairspark.plans.assessment import PUBLISHED, Plan


@dataclass(frozen=True)
class Run:
    """A run: how many seeds from which, passes of a correction, files of settings, where results go, and which surrogates take part."""

    seed: int
    runs: int
    iterations: int
    datasets: str
    algorithms: str
    results: str
    surrogates: tuple[str, ...]


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    target: str
    protected: tuple[str, ...]
    train: float
    validation: float
    test: float


def _read(path: str) -> configparser.ConfigParser:
    parser = configparser.ConfigParser()
    parser.optionxform = str
    if not parser.read(path):
        raise ValueError(f"no settings in {path}")
    return parser


def _section(parser: configparser.ConfigParser, name: str) -> dict[str, str]:
    if not parser.has_section(name):
        raise ValueError(f"section {name} is missing")
    return dict(parser[name])


def _option(section: dict[str, str], name: str, where: str) -> str:
    if name not in section:
        raise ValueError(f"option {name} is missing in {where}")
    return section[name]


#: Names of surrogates in settings, where they differ from ours.
SURROGATE_NAMES = {"svm": "rbf_svc"}


def run_config(path: str, section: str = "global", classifiers: str = "surrogate_classifiers") -> Run:
    """Switches are read as booleans: False switches a surrogate off."""
    parser = _read(path)
    main = _section(parser, section)
    of = lambda name: _option(main, name, section).strip('"')
    on = [SURROGATE_NAMES.get(k, k) for k in _section(parser, classifiers) if parser.getboolean(classifiers, k)]
    return Run(int(of("seed")), int(of("num_runs")), int(of("num_iterations_algorithms")), of("dataset_configs"), of("algorithms_configs"), of("results_path"), tuple(on))


def dataset_config(path: str, name: str) -> DatasetConfig:
    """The section of that name, or the one whose option ``name`` says so."""
    parser = _read(path)
    found = name if parser.has_section(name) else next((s for s in parser.sections() if parser[s].get("name") == name), name)
    section = _section(parser, found)
    of = lambda key: _option(section, key, found)
    protected = section.get("protected_attributes") or section.get("protected")
    if not protected:
        raise ValueError(f"option protected_attributes is missing in {found}")
    return DatasetConfig(section.get("name", name), of("target"), tuple(x.strip() for x in protected.split(",") if x.strip()), float(of("train_size")), float(of("validation_size")), float(of("test_size")))


def algorithm_config(path: str, name: str) -> dict[str, float | int | str]:
    """An algorithm's parameters; numbers as numbers."""
    out: dict[str, float | int | str] = {}
    for key, value in _section(_read(path), name).items():
        try:
            out[key] = int(value)
        except ValueError:
            try:
                out[key] = float(value)
            except ValueError:
                out[key] = value
    return out


def pool(settings: dict[str, float | int | str], prefix: str = "algorithm_") -> dict[int, str]:
    """algorithm_1, algorithm_2, ... as 0, 1, ..."""
    return {int(k[len(prefix) :]) - 1: str(v) for k, v in settings.items() if k.startswith(prefix)}


def plan(path: str, seed: int = 42, surrogates: tuple[str, ...] = PUBLISHED.surrogates, evolution: str | None = None, repair: str = "Repair", features: str = "FeatureSearch", sequences: str = "SequenceSearch", pools: str = "Pool") -> Plan:
    """What corrections run with, from the sections of an INI file; all their options must be there."""
    a, b, c = (algorithm_config(path, s) for s in (repair, features, sequences))
    of = lambda section, where: lambda name: _option(section, name, where)
    f, g = of(b, features), of(c, sequences)
    members = pool(algorithm_config(path, pools))
    return Plan(
        seed=seed, surrogates=tuple(surrogates), repair_level=float(_option(a, "repair_level", repair)), evolution=evolution,
        features=feature_search.Settings(size=f("population_size"), generations=f("num_generations"), tournament=f("tournament_size"), crossover=f("probability_crossover"), mutation=f("probability_mutation"), folds=f("n_splits"), low=f("min_feature_prob"), high=f("max_feature_prob")),
        sequences=pipeline_search.Settings(size=g("population_size"), generations=g("num_generations"), tournament=g("tournament_size"), elite=g("elite_size"), crossover=g("probability_crossover"), mutation=g("probability_mutation"), threshold=g("threshold_k")),
        pool=tuple(pipeline_search.pool_of([members[k] for k in sorted(members)])),
    )
