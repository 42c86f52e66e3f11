"""Memory budgets: a planning target for tasks, never enforced at run time."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

MIB = 1 << 20
PROCESS_OVERHEAD = 448 * MIB
WORKER_OVERHEAD = 96 * MIB
_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4}


def parse_bytes(value: int | str) -> int:
    """``512 MiB`` counts by 1024, ``2 GB`` by 1000."""
    if isinstance(value, bool):
        raise TypeError("a byte count is a number or a string")
    if isinstance(value, int):
        if value <= 0:
            raise ValueError("a byte count must be positive")
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?)(i?)B\s*", value, re.I)
    if not m:
        raise ValueError(f"{value!r} is no byte count")
    out = int(float(m[1]) * (1024 if m[3] else 1000) ** _UNITS[m[2].upper()])
    if out <= 0:
        raise ValueError("a byte count must be positive")
    return out


@dataclass(frozen=True)
class Budget:
    total_bytes: int
    overhead_bytes: int
    reserve_bytes: int = 0

    @property
    def task_bytes(self) -> int:
        return max(0, self.total_bytes - self.overhead_bytes - self.reserve_bytes)

    @property
    def attainable(self) -> bool:
        """Whether the process alone leaves anything of the total."""
        return self.total_bytes >= PROCESS_OVERHEAD + self.reserve_bytes

    def to_dict(self) -> dict:
        return asdict(self) | {"task_bytes": self.task_bytes, "attainable": self.attainable}


def resolve_budget(limit: int | str, reserve: int = 0) -> Budget:
    total = parse_bytes(limit)
    out = Budget(total, min(PROCESS_OVERHEAD, total // 2), reserve)
    if out.task_bytes == 0:
        raise MemoryError(f"a limit of {limit!r} leaves nothing for tasks beside {reserve} reserved bytes")
    return out


def workers(budget: Budget, per_task: int, requested: int | None, cores: int) -> int:
    """Tasks that may run at once."""
    if per_task > budget.task_bytes:
        raise MemoryError(f"a task takes about {per_task} bytes, {budget.task_bytes} are allowed")
    fit = 1 + (budget.task_bytes - per_task) // (per_task + WORKER_OVERHEAD)
    return max(1, min(fit, cores, requested or cores))
