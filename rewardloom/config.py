"""Plain configuration objects."""

from __future__ import annotations

from dataclasses import dataclass, field

# Languages the code layout accepts.
CODE_LANGUAGES = ("python", "javascript", "r", "java", "bash")


@dataclass(frozen=True)
class RewardConfig:
    """Parameters of the configurable rewards.

    ``max_power_bits`` bounds the integer powers an equation may compute; an equation that needs a larger one is not
    evaluated, and its reward is null.
    """

    cosine_min_value_wrong: float = 0.0
    cosine_max_value_wrong: float = -0.5
    cosine_min_value_correct: float = 0.5
    cosine_max_value_correct: float = 1.0
    cosine_max_len: int = 1000
    repetition_n_grams: int = 3
    repetition_max_penalty: float = -1.0
    code_language: str = "python"
    max_power_bits: int = 1 << 20

    def __post_init__(self) -> None:
        if self.repetition_max_penalty > 0:
            raise ValueError(f"repetition_max_penalty {self.repetition_max_penalty} must not be positive")
        if self.max_power_bits < 1:
            raise ValueError("max_power_bits must be positive")
        if self.repetition_n_grams < 1:
            raise ValueError("repetition_n_grams must be at least 1")
        if self.cosine_max_len <= 0:
            raise ValueError("cosine_max_len must be positive")
        if self.code_language not in CODE_LANGUAGES:
            raise ValueError(f"code_language must be one of {', '.join(CODE_LANGUAGES)}")


@dataclass(frozen=True)
class TaskSource:
    """One dataset of a mix. ``layout`` locates a split, as ``{root}/{split}`` by default."""

    name: str
    root: str
    fraction: float = 1.0
    id_column: str = "id"
    splits: tuple[str, ...] = ("train", "test")
    layout: str = "{root}/{split}"


@dataclass(frozen=True)
class MixConfig:
    sources: tuple[TaskSource, ...]
    configs: tuple[str, ...] | None = None
    columns_to_keep: tuple[str, ...] | None = None
    shuffle: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        if self.configs is not None and len(self.configs) != len(self.sources):
            raise ValueError("configs must have one entry per source")
        bad = [s.name for s in self.sources if not 0.0 <= s.fraction <= 1.0]
        if bad:
            raise ValueError(f"fractions must lie in [0, 1]: {', '.join(bad)}")
        if not self.sources or not any(s.splits for s in self.sources):
            raise ValueError("a mix needs at least one source with a split")
        names = [s.name for s in self.sources]
        if len(set(names)) != len(names):
            raise ValueError("source names must be unique")


@dataclass(frozen=True)
class SamplingConfig:
    """Batch geometry of a training run."""

    num_generations: int
    per_device_batch_size: int
    num_processes: int = 1
    gradient_accumulation_steps: int = 1
    num_iterations: int = 1
    seed: int = 42

    @property
    def rows_per_step(self) -> int:
        return self.per_device_batch_size * self.num_processes

    @property
    def effective_batch(self) -> int:
        return self.rows_per_step * self.gradient_accumulation_steps

    @property
    def prompts_per_batch(self) -> int:
        return self.effective_batch // self.num_generations

    def valid_generations(self) -> list[int]:
        """Group sizes that divide the rows one step holds over all devices."""
        return [g for g in range(2, self.rows_per_step + 1) if self.rows_per_step % g == 0]

    def __post_init__(self) -> None:
        if self.num_generations not in self.valid_generations():
            raise ValueError(
                f"num_generations {self.num_generations} must be one of {self.valid_generations()} "
                f"for {self.rows_per_step} rows per step"
            )


@dataclass(frozen=True)
class LossConfig:
    beta: float = 0.04
    epsilon_low: float = 0.2
    epsilon_high: float | None = None

    @property
    def upper(self) -> float:
        return self.epsilon_low if self.epsilon_high is None else self.epsilon_high


@dataclass(frozen=True)
class RewardPlan:
    """Reward names and their weights. ``custom`` names the caller's own rewards; they come last, in weights as well."""

    names: tuple[str, ...]
    weights: tuple[float, ...] = field(default=())
    custom: tuple[str, ...] = field(default=())

    def resolved_weights(self, used: list[str] | tuple[str, ...] | None = None) -> tuple[float, ...]:
        """One weight per reward in use, 1.0 each unless given; a wrong number of weights is an error."""
        used = (*self.names, *self.custom) if used is None else used
        if not self.weights:
            return tuple(1.0 for _ in used)
        if len(self.weights) != len(used):
            raise ValueError(f"{len(self.weights)} weights for {len(used)} rewards")
        return self.weights
