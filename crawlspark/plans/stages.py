"""Named stages that users may replace, precede or follow with their own DataFrame functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class Plan:
    """An ordered list of stages with hooks; ``run`` chains them lazily."""

    def __init__(self, stages: list[tuple[str, Stage]]):
        self._stages, self._before, self._after = dict(stages), {}, {}

    def stages(self) -> list[str]:
        return list(self._stages)

    def _known(self, name: str, function: Callable, arity: int) -> None:
        if name not in self._stages:
            raise KeyError(f"no stage {name!r}; stages: {', '.join(self._stages)}")
        try:
            inspect.signature(function).bind(*range(arity))
        except TypeError:
            raise TypeError(f"a hook of {name!r} takes {arity} argument(s)") from None

    def replace(self, name: str, function: Stage) -> Plan:
        self._known(name, function, 1)
        self._stages[name] = function
        return self

    def before(self, name: str, function: Stage) -> Plan:
        """``function(df)`` runs on what the stage gets."""
        self._known(name, function, 1)
        self._before.setdefault(name, []).append(function)
        return self

    def after(self, name: str, function: Callable[[DataFrame, DataFrame], DataFrame]) -> Plan:
        """``function(result, given)`` runs on what the stage returns and on what it got."""
        self._known(name, function, 2)
        self._after.setdefault(name, []).append(function)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage in self._stages.items():
            for hook in self._before.get(name, []):
                df = hook(df)
            result = stage(df)
            for hook in self._after.get(name, []):
                result = hook(result, df)
            df = result
        return df
